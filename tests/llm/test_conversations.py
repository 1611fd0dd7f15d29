"""Conversation repair against a search over all edits of whole conversations."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from perilframe.llm import conversations, queries

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search with whole audits; rows are (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        follow = NEXT[last]
        name = {"u": "user", "a": "assistant"}[follow]
        heapq.heappush(heap, (cost + 3, audit + "I", i, follow, out + ((name, ""),)))
        if i == len(rows):
            continue
        role, text, gone, cut = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
        if gone:
            continue
        extra = 3 if cut else 0
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, follow, out + ((name, text),)))
        if role[:1] == follow or (role[:1] == "s" and last == ""):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], out + ((role, text),)))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def brute(ids, rows):
    """Per conversation id the row that the query must return; rows are damaged already."""
    groups = {c: [] for c in ids}
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, told, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in turns:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[2][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, left = cheapest(told)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, row string, seg long, c string, whole boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", True) for r in rows], SCHEMA)


def made(seed=1, n=120):
    rng, rows = random.Random(seed), []
    texts = ["One.", "Two!", "Three?", "cut off", " \t", "", "End. \n", None, "no end ", "x."]
    for conv in range(n):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "sys", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice(texts)))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, None, "system", "Be kind.")]
    return rows + rows[:7] + rows[:7]


def query(spark, rows):
    df = frame(spark, rows)
    return conversations.repair(conversations.damaged(df), df)


def test_against_all_edits(spark):
    rows = made()
    got = query(spark, rows)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute({r[0] for r in rows}, damage(rows))


def test_conversations_of_several_segments(spark, monkeypatch):
    """A conversation with most rows, cut into many short segments over several tasks."""
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 5)
    monkeypatch.setattr(conversations, "REPEATED", 3)
    rng, rows = random.Random(5), made(2, 40)
    for turn in range(400):
        role = rng.choice(["user", "assistant", "system", "tool"]) if turn % 3 else ("user", "assistant")[turn % 2]
        rows.append((1000, turn // 2 if turn > 300 else turn, role, rng.choice([f"Turn {turn}.", "cut", "Again.", ""])))
    got = sorted(map(tuple, query(spark, rows).collect()), key=repr)
    assert got == brute({r[0] for r in rows}, damage(rows))


def test_repaired_turns(spark):
    rows = damage(made(3, 30))
    got = conversations.repaired(frame(spark, rows)).collect()
    text = {}
    for r in sorted(got, key=lambda r: r["at"]):
        text.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = {r[0]: r[-1] for r in brute({r[0] for r in rows}, rows)}
    assert {c: hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest() for c in want} == want


def test_on_the_tables(spark, sf):
    got = queries.QUERIES["op13_conversation_repair"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute({r[0] for r in rows}, damage(rows))


def test_empty_and_long(spark):
    assert query(spark, []).count() == 0
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in query(spark, [(dropped, 0, "user", "Hi.")]).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]
    long = [(7, 1, "user", "word " * 200_000 + "." + " " * 100_000), (7, 2, "assistant", "y" * 300_000 + "!")]
    assert [tuple(r) for r in query(spark, long).collect()] == brute({7}, damage(long))


def test_grammar_gives_what_symbols_give():
    rng = random.Random(9)
    plain = conversations.transfer([])
    rules = [("u", "a"), ("a", "u"), (chr(conversations.RULES_AT), chr(conversations.RULES_AT)), ("D", "U")]
    ruled = conversations.transfer(rules)
    togo = [conversations.INSERT * conversations.LAST[s] for s in conversations.STATES]
    for _ in range(300):
        text = "".join(rng.choice(conversations.SYMBOLS) for _ in range(rng.randrange(0, 14)))
        assert conversations.walk(text, plain, 0, togo) == conversations.walk(conversations.shorten(text, rules), ruled, 0, togo)
        assert conversations.matrix_of(text, plain) == conversations.matrix_of(conversations.shorten(text, rules), ruled)
