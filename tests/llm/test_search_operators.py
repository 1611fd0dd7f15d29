"""Decontamination and hard negatives against plain-Python answers."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures
from perilframe.llm import decontaminate, hard_negatives

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def hits(rows, items, size=10):
    """Per row (doc_id, n_words, n_hit, n_items, hash, contaminated), by trying every window at every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


def contaminated_rows():
    rows = [r for r in fixtures.documents() if len(r[1] or "") < 4000]
    quote = fixtures.words(77, 30, fixtures.ENGLISH)
    other = fixtures.words(78, 12, fixtures.FRENCH)
    items = [(1, quote), (2, other), (3, "Zebra crossing"), (4, "quagga"), (5, None), (6, " . "), (None, "null item here"),
             (10, quote), (11, "É" + " é" * 14), (12, " ".join(["go"] * 12))]
    more = [
        ("so " + quote.upper() + " end",), (quote[: len(quote) // 2],), ("a zebra\n CROSSING, quagga zebra",), ("it goes " + other + ". " + other,),
        ("null-item/here",), ("É" + " é" * 40,), ("go " * 300,), ("quagga",), (None,), ("",), (" ".join(quote.split()[5:18]) + " x" * 50,),
    ]
    rows += [(500 + i, t, None, None, None, "r", 1, "h", "k") for i, (t,) in enumerate(more)]
    return rows + rows[-3:], items


def test_contamination(spark):
    rows, items = contaminated_rows()
    docs = fixtures.frame(spark, rows)
    benchmark = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, row string")
    got = decontaminate.contamination(docs, benchmark)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert fixtures.counted(got.collect()) == hits(rows, items)
    # Several sets of windows and texts read in small parts give the same.
    for window, patterns, part in ((10, 7, 40), (4, 5, 9), (3, 1000, 13)):
        found = decontaminate.passages(docs, benchmark, window, patterns, part).collect()
        want = hits(rows, items, window)
        digest = lambda r: hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert want == Counter(
            (r["doc_id"], r["n_words"], sum(s["n"] for s in r["spans"]), len(r["items"]), digest(r), bool(r["spans"])) for r in found
        )


def test_contamination_of_empty_tables(spark):
    docs = fixtures.frame(spark, fixtures.documents()[:5])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate.contamination(docs, benchmark).collect()} == {False}
    some = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), some).count() == 0


def test_passages_are_taken_out(spark):
    quote = fixtures.words(77, 30, fixtures.ENGLISH)
    made = [(1, f"Before, {quote.upper()}! After 😀 {quote}."), (2, "clean text"), (3, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, quote)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.without_passages(docs, benchmark, mark="_").collect()}
    assert got == {1: "Before, _! After 😀 _.", 2: "clean text", 3: None}
    spans = decontaminate.passages(docs, benchmark).where("doc_id = 1").first()["spans"]
    assert [made[0][1][s["start"] : s["end"]].lower() for s in spans] == [quote, quote]


def test_long_text_with_a_late_passage(spark):
    quote = fixtures.words(77, 12, fixtures.GERMAN)
    text = "wort " * 300_000 + quote + " " + "a" * 300_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(9, quote)], "item_id long, text string")).first()
    assert (got["n_words"], got["n_hit"], got["n_items"]) == (300_013, 12, 1)


def mined(rows, anchor, positives=5, negatives=10):
    out = []
    for k, (a_id, a_label, a) in enumerate(rows):
        if not anchor(a_id):
            continue
        told = [(int(np.dot(np.array(a, dtype=object), np.array(v, dtype=object))), i, label) for j, (i, label, v) in enumerate(rows)
                if j != k and len(v) == len(a)]
        told.sort(key=lambda r: (-r[0], r[1]))
        for p, p_id, _ in [r for r in told if r[2] == a_label][:positives]:
            inside = [(s, i) for s, i, label in told if label != a_label and 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(a_id, p_id, at, i, p, s) for at, (s, i) in enumerate(inside, 1)]
    return Counter(out)


def vectors(seed=1, n=400, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 90
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + rng.normal(size=dims) * 40).astype(int).tolist()) for i in range(n)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(150)] + [(2000 + i, 2, rows[3][2]) for i in range(40)]  # equal vectors
    rows += [rows[7], rows[7], (7, 3, rows[9][2]), (20, 1, rows[3][2]), (20, 1, rows[3][2])]  # repeated rows and ids
    rows += [(3000 + i, i % 2, [i, 5 - i, 3]) for i in range(30)]  # another length
    rows += [(4000, 0, [0] * dims), (4010, 9, [1] * dims)]
    return rows


BAD = [(None, 1, [1] * 8), (5000, None, [1] * 8), (5010, 1, None), (5020, 1, [1, None] * 4), (5030, 1, []), (5040, 1, [2**40] * 8)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "p") for r in rows], "vec_id long, label int, v array<long>, point string, cell int, row string")


def test_hard_negatives(spark):
    rows = vectors()
    got = hard_negatives.mine(frame(spark, rows + BAD), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert fixtures.counted(got.collect()) == mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_in_small_cells(spark, monkeypatch):
    for name, size in dict(CELL_ROWS=4, PART_ROWS=40, BLOCK=16, CHUNK=5, PROBE=20).items():
        monkeypatch.setattr(hard_negatives, name, size)
    monkeypatch.setattr(hard_negatives, "HELD", 7)
    rows = vectors(2, 300, 7)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, 3, 4)
    assert fixtures.counted(got.collect()) == mined(rows, lambda i: i % 10 == 0, 3, 4)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [2**28 + rng.randrange(50) for _ in range(8)]) for i in range(40)]
    low = [(i + 100, i % 2, [2**27 + rng.randrange(50) for _ in range(8)]) for i in range(40)]
    got = hard_negatives.mine(frame(spark, rows + low), F.col("vec_id") % 10 == 0)
    want = mined(rows + low, lambda i: i % 10 == 0)
    assert want and fixtures.counted(got.collect()) == want


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, BAD), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, [(11, 1, [1, 2])]), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, [(10, 1, [1, 2])]), F.col("vec_id") % 10 == 0).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.001, 1.0],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(hard_negatives.quantised("v")).collect()] == [[128, -1, 256], None, None, None, None, []]


def test_cells_come_best_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * 100
    books = [hard_negatives._codebook(x[:, :3], 7), hard_negatives._codebook(x[:, 3:], 5)]
    cell = hard_negatives._nearest(x[:, :3], books[0]) * 5 + hard_negatives._nearest(x[:, 3:], books[1])
    radii = [np.array([max([np.linalg.norm(r[h] - b[c]) for r, k in zip(x, cell) if divmod(k, 5)[side] == c], default=0)
                       for c in range(len(b))]) for side, (h, b) in enumerate(zip((slice(3), slice(3, 6)), books))]
    cells = hard_negatives.Cells(books, radii, np.bincount(cell, minlength=35))
    q = rng.normal(size=6)
    order = list(cells.best_first(q))
    assert [b for b, _, _ in order] == sorted((b for b, _, _ in order), reverse=True)
    assert sorted(c for _, _, c in order) == sorted(set(cell.tolist()))
    for best, low, c in order:
        score = x[cell == c] @ q
        assert low <= score.min() and score.max() <= best


@pytest.mark.parametrize("length", [1, 2, 3, 6])
def test_patterns_skip_nothing(length):
    rng = random.Random(length)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(60)] for _ in range(20)]
    windows = {tuple(t[i : i + length]) for t in texts[:3] for i in range(0, 50, 7)}
    table = decontaminate.Patterns(length, [(w, [b" ".join(w)]) for w in windows])
    for t in texts:
        got = [(end, items[0]) for end, items in table.occurrences(t)]
        assert got == [(i + length, b" ".join(t[i : i + length])) for i in range(len(t) - length + 1) if tuple(t[i : i + length]) in windows]
