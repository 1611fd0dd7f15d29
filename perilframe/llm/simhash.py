"""Near duplicates by SimHash fingerprints of word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stable
from .common import components, drop_rows, filed, keyed, map_texts, prepare

SHINGLE, MOST_BITS = 4, 4
BLOCKS = 8
DENSE_CELL = 2048
WORD_END = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(data: bytes, size: int, block: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by size - 1 words, so that every shingle is in exactly one run."""
    carried: list[bytes] = []
    at = 0
    while at < len(data) or not at:
        end = min(len(data), at + block)
        if end < len(data):  # finish the word
            rest = WORD_END.search(data, end)
            end = rest.start() if rest else len(data)
        words = carried + data[at:end].split()
        at = max(end, 1)
        if at >= len(data):
            yield words
        elif len(words) >= size:
            yield words
            carried = words[len(words) - size + 1 :]
        else:
            carried = words


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 majority bits over XXH64 (seed 42) of all `size`-word shingles, as a signed long.

    Words are parted by ASCII white space, A-Z are lowered. A text of fewer words is one shingle; without words it is 0.
    """
    import xxhash

    ones, total = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_digest
    for words in _word_runs(text.encode().lower(), size):  # bytes: exactly the ASCII letters and white space
        if not words or (total and len(words) < size):
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        n = max(1, len(words) - size + 1)
        hashes = b"".join([digest(line[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += n
    return int(np.packbits(2 * ones > total).view(">i8")[0]) if total else 0


def fingerprints(rows: DataFrame, keep: tuple[str, ...], size: int = SHINGLE) -> DataFrame:
    """keep columns and `print`, the fingerprint of every whole text; null counts as empty."""

    def work():
        return lambda texts: {"print": [fingerprint(t or "", size) for t in texts]}

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return map_texts(rows, f"{kept}, print long", work, keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_counts(print_: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each written with that many ones: 00, 01 or 11.

    Two such codes differ in as many bits as the Manhattan distance of the counts, which is at most the number
    of bits in which the fingerprints differ.
    """
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(print_, 1)
    both = print_.bitwiseAND(shifted).bitwiseAND(low)
    some = print_.bitwiseOR(shifted).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(some)


def _cells(prints: DataFrame, most: int) -> DataFrame:
    """Grid cells of each fingerprint: the segment counts of BLOCKS - most out of BLOCKS blocks of segments.

    Within a Manhattan distance of `most`, at most that many blocks can differ, so two such
    fingerprints share a cell.
    """
    counts = segment_counts(F.col("print"))
    cells = []
    for chosen in combinations(range(BLOCKS), BLOCKS - most):
        mask = sum(255 << (8 * i) for i in chosen)
        cells.append(F.struct(F.lit(sum(1 << i for i in chosen)).alias("blocks"), counts.bitwiseAND(F.lit(_signed(mask))).alias("at")))
    return prints.select("print", F.inline(F.array(*cells)))


def _first_shared(a: Column, b: Column, n: int) -> Column:
    """The lowest n blocks with equal segment counts, as bits: each pair is taken in one cell only."""
    x = a.bitwiseXOR(b)
    equal = sum((F.when(x.bitwiseAND(F.lit(_signed(255 << (8 * i)))) == 0, 1 << i).otherwise(0) for i in range(BLOCKS)), F.lit(1))
    lowest = [sum(1 << i for i in [i for i in range(BLOCKS) if m >> i & 1][:n]) for m in range(1 << BLOCKS)]
    return F.element_at(F.array(*[F.lit(m) for m in lowest]), equal)


def links(prints: DataFrame, most: int = MOST_BITS, dense_cell: int = DENSE_CELL) -> DataFrame:
    """(a, b) edges whose components are those of all fingerprints differing in at most `most` bits.

    `prints` has distinct fingerprints. A grid range join under the Manhattan distance of segment counts finds
    the candidates; distance bound and true distance stand in the join condition, so only
    verified pairs leave it, each once. Cells with more than `dense_cell` fingerprints are not
    joined pair by pair: their members meet at points halfway, see _halfway.
    """
    if not 0 < most < BLOCKS:
        raise ValueError(f"most must be between 1 and {BLOCKS - 1}")
    cell = Window.partitionBy("blocks", "at")
    shared = stable(_cells(prints, most).withColumn("n", F.count("*").over(cell)).where("n > 1"))
    sparse = shared.where(F.col("n") <= dense_cell).select("blocks", "at", "print", segment_counts(F.col("print")).alias("counts"))
    a = sparse.select("blocks", "at", F.col("print").alias("a"), F.col("counts").alias("ca"))
    b = sparse.select(F.col("blocks").alias("blocks_b"), F.col("at").alias("at_b"), F.col("print").alias("b"), F.col("counts").alias("cb"))
    near = (
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= most)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
        & (F.col("blocks") == _first_shared(F.col("ca"), F.col("cb"), BLOCKS - most))
    )
    found = a.join(b, (F.col("blocks") == F.col("blocks_b")) & (F.col("at") == F.col("at_b")) & near).select("a", "b")
    # A pair's one cell may be dense while another is not; members of dense cells are linked among themselves.
    crowded = stable(shared.where(F.col("n") > dense_cell).select("print").distinct())
    return found if crowded.isEmpty() else found.unionByName(_halfway(crowded, most))


def _halfway(prints: DataFrame, most: int) -> DataFrame:
    """Edges for fingerprints with many neighbours, in time linear in their number.

    Two fingerprints differ in at most `most` bits exactly if one point lies within ceil(most / 2) bits of one
    and floor(most / 2) of the other. Each fingerprint visits the points around it; those that meet
    at a point are linked to the smallest one that came from the shorter radius, and to one another through it.
    """
    near, far = most // 2, most - most // 2

    def around(radius: int) -> list[int]:
        masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
        return [_signed(m) for m in masks]

    def visits(radius: int) -> DataFrame:
        masks = F.array(*[F.lit(m) for m in around(radius)])
        return prints.select("print", F.explode(masks).alias("_m")).select(
            "print", F.col("print").bitwiseXOR(F.col("_m")).alias("point")
        )

    inner = visits(near).groupBy("point").agg(F.min("print").alias("b"))
    outer = visits(far)
    return outer.join(inner, "point").where("print <> b").select(F.col("print").alias("a"), "b").distinct()


def groups(docs: DataFrame, size: int = SHINGLE, most: int = MOST_BITS, dense_cell: int = DENSE_CELL) -> DataFrame:
    """Per input row: row, doc_id, print, component_id, component_row.

    Rows with equal fingerprints are one fingerprint; fingerprints within `most` bits link, and everything
    reachable is a group, named by its smallest doc_id (null last) and that row. Texts without words (null, empty)
    have fingerprint 0 and link like any other. Repeated rows fall into the same group. Very long texts are hashed whole, by
    one task each; an empty table gives no rows; extra columns are left out. Only distinct fingerprints are joined and connected.
    """
    prepare(docs.sparkSession)
    rows = stable(fingerprints(keyed(docs, doc_id="doc_id", text="text"), ("row", "doc_id"), size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    prints = stable(rows.groupBy("print").agg(first))
    nodes = components(links(prints.select("print"), most, dense_cell))
    rooted = prints.join(nodes, prints["print"] == nodes["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first"
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    told = stable(
        rooted.select("print", "root").join(named, "root").select(
            "print", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row")
        )
    )
    return rows.join(told, "print").select("row", "doc_id", "print", "component_id", "component_row")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs, size, most).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """The first row of each group, with all columns of docs."""
    docs = filed(docs)
    return drop_rows(docs, groups(docs, size, most).where(F.col("row") != F.col("component_row")))
