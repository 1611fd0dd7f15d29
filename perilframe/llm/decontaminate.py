"""Benchmark passages inside documents by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from ..session import stable
from .common import keyed, map_texts, prepare

# Words (of texts in UTF-8 with A-Z lower-cased; the same words with A-Z in code points), words of a window.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_IN_TEXT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WINDOW = 10

PATTERNS = 200_000  # (window, item) pairs searched for in one pass over the documents, about
PART = 4 * 1024 * 1024  # bytes of a text whose words are held at once, about


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def _parts(raw: bytes, size: int) -> Iterator[bytes]:
    """raw in parts that end between words; a word longer than a part stays whole."""
    start = 0
    while start < len(raw):
        end = start + size
        if end < len(raw):
            ahead = WORD.match(raw, end - 1)
            end = ahead.end() if ahead else end
        yield raw[start:end]
        start = end


class Patterns:
    """Shift table and suffix buckets for windows of one length.

    A block is the last two words seen (one, for windows of one word). The shift of a block is how far the search may
    move on before a window can end; a block of no window moves it past itself. Where the shift is 0, the block's
    bucket holds the windows that end so, and comparing all words confirms.
    """

    def __init__(self, length: int, windows: Iterable[tuple[tuple[bytes, ...], list]]):
        self.length, self.block = length, min(2, length)
        self.past = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for window, items in windows:
            for end in range(self.block, length + 1):
                at = window[end - self.block : end]
                self.shift[at] = min(self.shift.get(at, self.past), length - end)
            self.buckets.setdefault(window[-self.block :], {}).setdefault(window, []).extend(items)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(end, items) of every window in words, by end."""
        at, n, shift, past, block, length = self.length, len(words), self.shift.get, self.past, self.block, self.length
        while at <= n:
            tail = tuple(words[at - block : at])
            move = shift(tail, past)
            if move:
                at += move
                continue
            items = self.buckets[tail].get(tuple(words[at - length : at]))
            if items is not None:
                yield at, items
            at += 1


def search(tables: list[Patterns], text: str | None, part: int = PART) -> tuple[int, list[list[int]], set]:
    """Words of text, runs [first, end) of words inside windows, and the items whose windows occur.

    A long text is read part by part; the words that a window may still need are carried over.
    """
    carry = max((t.length for t in tables), default=1) - 1
    kept: list[bytes] = []
    spans: list[tuple[int, int]] = []
    items: set = set()
    total = 0
    for piece in _parts((text or "").encode().lower(), part):
        words = kept + WORD.findall(piece)
        base = total - len(kept)
        total = base + len(words)
        for table in tables:
            for end, found in table.occurrences(words):
                spans.append((base + end - table.length, base + end))
                items.update(found)
        kept = words[-carry:] if carry else []
    runs: list[list[int]] = []
    for first, end in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    return total, runs, items


def _places(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code points [start, end) of the runs of words."""
    out, words, at = [], WORD_IN_TEXT.finditer(text), -1
    for first, end in runs:
        while at < first:
            at, word = at + 1, next(words)
        start = word.start()
        while at < end - 1:
            at, word = at + 1, next(words)
        out.append((start, word.end()))
    return out


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item) of the benchmark: `window` is its words joined by spaces, `item` the id as text (null: empty).

    Every run of `window` words is one, and all words of an item with fewer; an item without words has none.
    """

    def work():
        def batch(texts: list) -> dict[str, list]:
            made = []
            for t in texts:
                words = [w.decode() for w in words_of(t)]
                made.append([" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else [])
            return {"windows": made}

        return batch

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    cut = map_texts(named, "item string, windows array<string>", work, ("item",))
    return cut.select(F.explode("windows").alias("window"), "item").distinct()


def _scan(rows: DataFrame, pairs: list, part: int) -> DataFrame:
    """row, doc_id, n_words, spans, items for one set of (window, item) pairs."""
    grouped: dict[str, list[str]] = {}
    for w, item in pairs:
        grouped.setdefault(w, []).append(item)
    shared = rows.sparkSession.sparkContext.broadcast(grouped)  # plain strings: tables are built by the task

    def work():
        by_length: dict[int, list] = {}
        for w, found in shared.value.items():
            words = tuple(w.encode().split(b" "))
            by_length.setdefault(len(words), []).append((words, found))
        tables = [Patterns(n, some) for n, some in sorted(by_length.items())]

        def batch(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"n_words": [], "spans": [], "items": []}
            for t in texts:
                n, runs, items = search(tables, t, part)
                places = _places(t, runs) if runs else []
                out["n_words"].append(n)
                out["spans"].append([dict(first=f, n=e - f, start=s, end=z) for (f, e), (s, z) in zip(runs, places)])
                out["items"].append(sorted(items))
            return out

        return batch

    kept = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ("row", "doc_id"))
    span = "struct<first:bigint,n:bigint,start:bigint,end:bigint>"
    return map_texts(rows, f"{kept}, n_words long, spans array<{span}>, items array<string>", work, ("row", "doc_id"))


def _merged(spans):
    """Sorted spans with those that overlap or touch made one."""
    none = F.slice(spans, 1, 0)

    def put(got, s):
        last = F.element_at(got, -1)
        joined = F.struct(
            last["first"].alias("first"), (F.greatest(last["first"] + last["n"], s["first"] + s["n"]) - last["first"]).alias("n"),
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        touches = (F.size(got) > 0) & (s["first"] <= last["first"] + last["n"])
        return F.when(touches, F.concat(F.slice(got, 1, F.size(got) - 1), F.array(joined))).otherwise(F.concat(got, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, put)


def passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, patterns: int = PATTERNS, part: int = PART
) -> DataFrame:
    """One row per input row: row, doc_id, n_words, spans, items.

    `spans` are the runs of words inside any occurrence of a benchmark window: first word, number of words, and their
    code points [start, end); `items` are the ids, as sorted distinct text, of the items whose windows occur. Null
    texts have no words, nor do empty ones; a text without a window has no spans. Rows of the benchmark with the same id
    are one item, a null id is the empty text; a window of several items counts for each. Repeated rows of docs are
    searched one by one, very long texts part by part. Empty tables give no rows or no spans; extra columns are left out.

    Distinct windows are dealt by hash into sets of about `patterns` pairs with their items. A set is what one pass
    broadcasts, whatever the size of the benchmark; more sets mean more passes, whose findings meet by row.
    """
    spark = prepare(docs.sparkSession)
    rows = keyed(docs, doc_id="doc_id", text="text")
    pairs = stable(windows_of(benchmark, window))
    sets = max(1, -(-pairs.count() // patterns))
    number = F.pmod(F.xxhash64("window", "item"), F.lit(sets))
    scans = [_scan(rows, [tuple(r) for r in pairs.where(number == i).collect()], part) for i in range(sets)]
    if len(scans) == 1:
        return scans[0]
    hits = [s if i == 0 else s.where(F.size("spans") > 0) for i, s in enumerate(scans)]
    found = stable(_union(hits))
    whole = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"),
    )  # at most one row of each set
    return whole.select("row", "doc_id", "n_words", _merged("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids joined by commas), contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["n"])
    return passages(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, mark: str = " ") -> DataFrame:
    """The rows of docs with `mark` in place of every benchmark passage; all other rows and columns as they are."""
    from .common import filed, plain_names, restore

    docs = filed(docs)
    names = plain_names(docs)
    text = next(c for c, n in names.items() if n == "text")
    found = stable(passages(docs, benchmark, window).where(F.size("spans") > 0).select("row", "spans"))
    held = keyed(docs, **{c: F.col(f"`{n}`") for c, n in names.items()}).join(found, "row", "left")
    # From the last span back, so that the places of those before it still hold.
    cut = F.aggregate(
        F.reverse("spans"), F.col(text),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.lit(mark), F.substring(t, s["end"].cast("int") + 1, F.char_length(t))),
    )
    return restore(held.withColumn(text, F.when(F.col("spans").isNotNull(), cut).otherwise(F.col(text))), names)


# The same by joining all windows of words with each other.
ORACLE_SQL = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
pattern AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_aggregate(w[i : i + least(len(w), 10) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM pattern),
place AS (
  SELECT r, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN lengths WHERE len(w) >= n)),
hit AS (SELECT r, i, place.n, item FROM place JOIN pattern ON place.win = pattern.win AND place.n = pattern.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
