"""Cheapest repair of conversation structure: min-plus transfer matrices over a Re-Pair grammar."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..session import stable
from .common import keyed, prepare

# White space, sentence ends, roles of added turns, the costs of edits and of a truncated turn that stays.
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
USER, ASSISTANT = "user", "assistant"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")

# States of a legal conversation: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = range(4)
KEEPS = {"s": {START: SYSTEM}, "u": {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}, "x": {}}
TURN = {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED, ASKED: ANSWERED}  # where an added or changed turn leads

SEGMENT_ROWS, SEGMENT_CHARS = 1024, 4 * 1024 * 1024
ROUNDS, ROUND_RULES, REPEATED = 6, 64, 16  # of Re-Pair: rounds, rules a round, occurrences that a rule needs
RULES_AT = 0xE000  # code points of rules


# A transfer matrix is a tuple of 16 entries, None or (cost, rope): the cheapest edits from state p to state q. A rope is a
# text or a pair of ropes, shared by all that contain it. No edits of a segment are a prefix of others that cost
# the same, as they use up the same rows, so the least of joined ropes joins the least ropes.


def rope_text(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo.extend((r[1], r[0]))
    return "".join(out)


def _better(a, b):
    """The cheaper entry, of equal ones that whose text comes first."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if rope_text(a[1]) <= rope_text(b[1]) else b


def _then(a, b):
    if a is None or b is None:
        return None
    if not a[1] or not b[1]:
        return a[0] + b[0], a[1] or b[1]
    return a[0] + b[0], (a[1], b[1])


def compose(left, right):
    out = []
    for p in STATES:
        for q in STATES:
            best = None
            for m in STATES:
                best = _better(best, _then(left[4 * p + m], right[4 * m + q]))
            out.append(best)
    return tuple(out)


def _inserts():
    """Entries for added turns alone, none included."""
    out = [None] * 16
    for p in STATES:
        q, n = p, 0
        while out[4 * p + q] is None:
            out[4 * p + q] = (INSERT * n, "I" * n)
            q, n = TURN[q], n + 1
    return tuple(out)


def _edits(symbol: str):
    """One row's edits: the symbol is its role's initial, upper case if truncated, D if it must go."""
    out = [None] * 16
    for p in STATES:
        out[5 * p] = (DELETE, "D")
        if symbol == "D":
            continue
        extra = TRUNCATED if symbol.isupper() else 0
        q = TURN[p]
        out[4 * p + q] = _better(out[4 * p + q], (REROLE + extra, "R"))
        q = KEEPS[symbol.lower()].get(p)
        if q is not None:
            out[4 * p + q] = _better(out[4 * p + q], (extra, "K"))
    return tuple(out)


SYMBOLS = "suaxSUAXD"


def transfer(rules: list[tuple[str, str]]) -> dict:
    """The matrix of every symbol and rule, each rule from its two parts; rules come after their parts.

    Turns are added before a row, or at the very end.
    """
    added = _inserts()
    matrices = {s: compose(added, _edits(s)) for s in SYMBOLS}
    for i, (a, b) in enumerate(rules):
        matrices[chr(RULES_AT + i)] = compose(matrices[a], matrices[b])
    return matrices


# What is still to add at the end of a conversation, by state.
LAST = {START: 0, SYSTEM: 2, ASKED: 1, ANSWERED: 0}


def shorten(text: str, rules: list[tuple[str, str]], first: int = 0) -> str:
    for i, (a, b) in enumerate(rules, first):
        text = text.replace(a + b, chr(RULES_AT + i))
    return text


def walk(packed: str, matrices: dict, start: int, togo: list) -> tuple[int, int, str] | None:
    """(state at the end, cost, audit) of the cheapest edits from `start`, given the cost from each end state on (None: no way)."""
    row = [(0, "") if s == start else None for s in STATES]
    for symbol in packed:
        m = matrices[symbol]
        after = []
        for q in STATES:
            best = None
            for p in STATES:
                best = _better(best, _then(row[p], m[4 * p + q]))
            after.append(best)
        row = after
    ends = [(row[q][0] + togo[q], rope_text(row[q][1]), q) for q in STATES if row[q] is not None and togo[q] is not None]
    if not ends:
        return None
    total, audit, q = min(ends)
    return q, total - togo[q], audit


def matrix_of(packed: str, matrices: dict) -> list:
    out = tuple((0, "") if p == q else None for p in STATES for q in STATES)
    for symbol in packed:
        out = compose(out, matrices[symbol])
    return [e and e[0] for e in out]


def messages(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of audit, from a state on."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, text = roles[i], texts[i]
            state = {"s": SYSTEM, "u": ASKED, "a": ANSWERED}[role[0]]
        else:
            state = TURN[state]
            role, text = USER if state == ASKED else ASSISTANT, texts[i] if edit == "R" else ""
        i += edit != "I"
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def _rules(sequences: DataFrame) -> tuple[list[tuple[str, str]], DataFrame]:
    """Re-Pair over all distinct sequences: rules, and (symbols, packed).

    In a round, the most frequent pairs that can't overlap each other become rules at once. Pair counts are combined in
    the tasks; only the top ones reach the driver. How many rules there are changes the work, not the result.
    """
    now = stable(sequences.select("symbols", F.col("symbols").alias("packed")))
    rules: list[tuple[str, str]] = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total.update(map(str.__add__, s, s[1:]))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(total), pa.string()), "n": pa.array(total.values(), pa.int64())})

    for _ in range(ROUNDS):
        pairs = now.select("packed").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.where(F.col("n") >= REPEATED).orderBy(F.col("n").desc(), "pair").limit(4 * ROUND_RULES).collect()
        made, lefts, rights = [], set(), set()
        for pair, _n in top:
            a, b = pair
            # A pair of one symbol twice overlaps only itself; `replace` takes it from the left.
            if len(made) < ROUND_RULES and a not in rights and b not in lefts and (a != b or a not in lefts | rights):
                made.append((a, b))
                lefts.add(a)
                rights.add(b)
        if not made:
            break
        first = len(rules)
        rules += made

        def replace(batches: Iterator[pa.RecordBatch], made=made, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = [shorten(s, made, first) for s in batch.column("packed").to_pylist()]
                yield pa.RecordBatch.from_pydict({"symbols": batch.column("symbols"), "packed": packed})

        now = stable(now.mapInArrow(replace, "symbols string, packed string"))
    return rules, now


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """work(row dicts) -> row dicts, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(work(batch.to_pylist()), schema=arrow)

    return df.mapInArrow(run, fields)


def judged(conversations: DataFrame) -> DataFrame:
    """Rows with their conversation's key c, their place, first fault (0 none, 1 blank, 2 duplicate, 3 truncated) and symbol.

    Copies of a turn inside a conversation are found by counts per hash of role and text; only those of repeated hashes
    meet the rows again.
    """
    known = F.col("turn").isNotNull()
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    body = F.rtrim("text", F.lit(WHITE))
    rows = keyed(
        conversations, conv_id="conv_id", turn=F.col("turn").cast("long"),
        role=F.coalesce(F.col("role").cast("string"), F.lit(" ")), text=text,
    ).withColumn("c", F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.select("*", F.struct(known.alias("known"), "turn", "row").alias("place"), same.alias("same"))
    copies = rows.groupBy("c", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(stable(copies.drop("n")), ["c", "same"], "left")
    fault = (
        F.when(body == "", 1).when(F.col("place") > F.col("first"), 2)
        .when(~F.contains(F.lit(ENDS), F.substring(body, -1, 1)), 3).otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return found.withColumn("fault", fault).select(
        "c", "conv_id", "turn", "role", "text", "row", "fault", initial.alias("initial"),
        F.when(F.col("fault").isin(1, 2), "D").when(F.col("fault") == 3, F.upper(symbol)).otherwise(symbol).alias("symbol"),
    )


COUNTS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"


def segments(rows: DataFrame) -> DataFrame:
    """Ordered conversations in segments of at most SEGMENT_ROWS rows or about SEGMENT_CHARS characters.

    Range partitions by conversation and order hold any conversation, also one with a third of all rows, in many
    tasks. `whole` segments are surely a conversation; the others may go on in a neighbour.
    """
    order = ["c", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (
        f"part int, seg long, c string, conv_id {kind}, whole boolean, symbols string, first string, last string, "
        f"{COUNTS}, roles array<string>, texts array<string>"
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = ["c", "conv_id", "turn", "role", "text", "fault", "initial", "symbol"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, now, chars, out = TaskContext.get().partitionId(), 0, None, 0, []

        def begin(c, conv_id, fresh: bool) -> dict:
            return dict(part=part, seg=seg, c=c, conv_id=conv_id, whole=fresh, symbols=[], first=None, last="", blank=0,
                        duplicate=0, truncated=0, illegal=0, low=None, high=None, turns=0, roles=[], texts=[])

        def done(s: dict, ends: bool) -> None:
            s["whole"] = s["whole"] and ends
            s["symbols"] = "".join(s["symbols"])
            out.append(s)

        for batch in batches:
            for c, conv_id, turn, role, text, fault, initial, symbol in zip(*(batch.column(n).to_pylist() for n in columns)):
                if now is None or now["c"] != c:
                    if now is not None:
                        done(now, True)
                    # The first conversation of a partition may have begun in the one before.
                    fresh, seg, chars = now is not None, seg + 1, 0
                    now = begin(c, conv_id, fresh)
                elif len(now["symbols"]) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                    done(now, False)
                    seg, chars = seg + 1, 0
                    now = begin(c, conv_id, False)
                if now["first"] is None:
                    now["first"] = initial
                elif now["last"] + initial not in LEGAL:
                    now["illegal"] += 1
                now["last"] = initial
                if turn is not None:
                    now["turns"] += turn != now["high"]
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                if fault:
                    now[("blank", "duplicate", "truncated")[fault - 1]] += 1
                now["symbols"].append(symbol)
                now["roles"].append(role)
                now["texts"].append(None if symbol == "D" else text)
                chars += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if now is not None:
            done(now, False)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    lined = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stable(lined.select(*columns).mapInArrow(cut, fields))


def mended(conversations: DataFrame) -> DataFrame:
    """Segments of repaired conversations: c, conv_id, part and seg (their order), whole, faults, turns, cost, audit, roles, texts.

    Sequences of symbols are solved once for all conversations that share them. A conversation of several segments is
    solved by the segments' cost matrices from the end, the edits each segment would then take from each state, and
    the states from the start; a conversation gives one row of 16 numbers per SEGMENT_ROWS rows to one task.
    """
    spark = prepare(conversations.sparkSession)
    segs = segments(judged(conversations))
    rules, packed = _rules(segs.select("symbols").distinct())
    shared = spark.sparkContext.broadcast((rules, transfer(rules)))

    def solve(rows: list[dict]) -> list[dict]:
        _, matrices = shared.value
        togo = [INSERT * LAST[s] for s in STATES]
        out = []
        for r in rows:
            state, cost, audit = walk(r["packed"], matrices, START, togo)
            out.append(dict(symbols=r["symbols"], cost=cost + togo[state], audit=audit + "I" * LAST[state]))
        return out

    solved = stable(_mapped(packed, "symbols string, cost long, audit string", solve))
    alone = segs.where("whole").join(solved, "symbols").withColumn("state", F.lit(START))
    several = _several(segs.where("not whole"), shared)
    columns = [*[c for c in segs.columns if c != "symbols"], "state", "cost", "audit"]
    both = alone.select(columns).unionByName(several.select(columns))

    fields = StructType.fromDDL("roles array<string>, texts array<string>")
    kept = both.drop("roles", "texts", "state").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = StructType(kept.fields + fields.fields)
    arrow = to_arrow_schema(whole)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [messages(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("audit", "roles", "texts", "state")))]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in kept.names}, "roles": [m[0] for m in made], "texts": [m[1] for m in made],
            }, schema=arrow)

    return both.mapInArrow(write, whole)


def _several(segs: DataFrame, shared) -> DataFrame:
    """Add state (at its start), cost and audit to the segments of conversations that may have several."""
    names = ["c", "part", "seg"]

    def measure(rows: list[dict]) -> list[dict]:
        rules, matrices = shared.value
        return [{**{k: r[k] for k in names}, "m": matrix_of(shorten(r["symbols"], rules), matrices)} for r in rows]

    def from_end(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            togo = [INSERT * LAST[s] for s in STATES]
            for i, s in enumerate(reversed(r["line"])):
                out.append(dict(c=r["c"], part=s["part"], seg=s["seg"], togo=togo, ends=i == 0))
                ways = [[s["m"][4 * p + q] + togo[q] for q in STATES if s["m"][4 * p + q] is not None and togo[q] is not None] for p in STATES]
                togo = [min(w) if w else None for w in ways]
        return out

    def choose(rows: list[dict]) -> list[dict]:
        rules, matrices = shared.value
        out = []
        for r in rows:
            packed = shorten(r["symbols"], rules)
            ways = [walk(packed, matrices, p, r["togo"]) for p in STATES]
            out.append({**{k: r[k] for k in names}, "ends": r["ends"], "ways": [w and dict(zip(("q", "cost", "audit"), w)) for w in ways]})
        return out

    def from_start(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            state = START
            for s in r["line"]:
                out.append(dict(c=r["c"], part=s["part"], seg=s["seg"], state=state))
                state = s["q"][state]
        return out

    def line(df: DataFrame, *of) -> DataFrame:
        return df.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "seg", *of))).alias("line"))

    keys = "c string, part int, seg long"
    segs = stable(segs)
    matrices = _mapped(segs.select(*names, "symbols"), f"{keys}, m array<long>", measure)
    togo = _mapped(line(matrices, "m"), f"{keys}, togo array<long>, ends boolean", from_end)
    way = "struct<q:int,cost:long,audit:string>"
    choices = stable(_mapped(
        segs.select(*names, "symbols").join(togo, names), f"{keys}, ends boolean, ways array<{way}>", choose
    ))
    states = _mapped(line(choices, F.col("ways.q").alias("q")), f"{keys}, state int", from_start)
    one = F.element_at("ways", F.col("state") + 1)
    added = F.when(F.col("ends"), F.element_at(F.array(*[F.lit(LAST[s]) for s in STATES]), one["q"] + 1)).otherwise(0)
    told = choices.join(states, names).select(
        *names, "state", (one["cost"] + INSERT * added).alias("cost"), F.concat(one["audit"], F.repeat(F.lit("I"), added)).alias("audit")
    )
    return segs.join(stable(told), names)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns, one row each: conv_id, at (its number), role, text."""
    rows = stable(mended(conversations).select("c", "conv_id", "part", "seg", F.size("roles").alias("n"), "roles", "texts"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part", "seg").rowsBetween(Window.unboundedPreceding, -1))
    starts = stable(rows.select("part", "seg", F.coalesce(before, F.lit(0)).alias("start")))
    each = rows.join(starts, ["part", "seg"]).select("conv_id", "start", F.posexplode(F.arrays_zip("roles", "texts")))
    return each.select("conv_id", (F.col("start") + F.col("pos")).alias("at"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns go by number, null first, ties by role and text; null roles and texts are one space, rows with a null conv_id are
    one conversation, repeated rows are duplicates. `ids` names conversations that must have a row: those without turns
    get zeros, an empty audit and the hash of the empty text. An empty table gives no more rows than `ids`; extra columns are
    left out. Very long texts and conversations are cut into segments; one row's text is never cut.

    The hash of a conversation of several segments is taken by one task that streams them in order, as
    the hash and the audit text allow no other way; all else is done per segment.
    """
    told = stable(mended(conversations))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    digest = F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    alone = told.where("whole").select("conv_id", gaps.alias("gaps"), *names, digest.alias("repaired_sha256"))

    kind = told.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(f"conv_id {kind}, {SUMMARY}")
    arrow = to_arrow_schema(fields)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, audit, digest, some = None, None, [], None, False

        def done() -> dict:
            gaps = 0 if now["high"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return {**{n: now[n] for n in ("conv_id", *names)}, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if now is None or s["c"] != key:
                    if now is not None:
                        out.append(done())
                    key, now, audit, digest, some = s["c"], dict(s), [], hashlib.sha256(), False
                else:
                    for n in ("blank", "duplicate", "truncated", "illegal", "cost"):
                        now[n] += s[n]
                    now["illegal"] += now["last"] + s["first"] not in LEGAL
                    now["last"] = s["last"]
                    if s["low"] is not None:
                        now["turns"] += s["turns"] - (s["low"] == now["high"])
                        now["low"] = s["low"] if now["low"] is None else now["low"]
                        now["high"] = s["high"]
                audit.append(s["audit"])
                for role, text in zip(s["roles"], s["texts"]):
                    digest.update((("\n" if some else "") + role + ":" + text).encode())
                    some = True
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=arrow)

    several = told.where("not whole").repartition("c").sortWithinPartitions("c", "part", "seg").mapInArrow(join, fields)
    both = alone.unionByName(several)
    if ids is None:
        return both
    wanted = ids.select("conv_id").distinct()
    both = both.withColumnRenamed("conv_id", "_id").withColumn("_found", F.lit(True))
    joined = wanted.join(stable(both), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return joined.select(
        "conv_id", *[F.coalesce(f.name, empty.get(f.name, F.lit(0).cast("long"))).alias(f.name) for f in fields.fields[1:]]
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows broken by the checksum of `conv_id:turn` modulo 20 (nulls: one space): 0 goes, 1 loses its text, 2 its sentence
    ends, 3 comes twice, 4 becomes the user's. The rest and all other columns stay."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    marked = conversations.withColumns({"text": text, "role": F.when(fate == 4, F.lit(USER)).otherwise(F.col("role"))})
    # The fate is taken from the ids, which stay.
    return marked.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_copy")

