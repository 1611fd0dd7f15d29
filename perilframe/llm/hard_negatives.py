"""Hard negatives for anchors among labelled vectors, found through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stable
from .common import keyed, prepare

SAMPLE = 20_000  # vectors that the codebooks are fitted on, at most
CODES = 128  # codewords of a half space, at most
CELL_ROWS = 256  # vectors of a cell, about, while the codebooks may still grow
PART_ROWS = 4096  # vectors of the consecutive cells that one request asks for, about
BLOCK = 4096  # vectors compared at once
CHUNK = 256  # anchors compared at once, about
PROBE = 4096  # vectors that an anchor looks at before it knows where to stop
HELD = 50_000  # lists of best scores that a task keeps, before it hands them on


def _ints(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims)


def _codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds, from centres spread over the rows; the same rows give the same."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


class Cells:
    """Codebooks of both halves, how far members lie from their codewords, and how many members a cell has."""

    def __init__(self, books: list[np.ndarray], radii: list[np.ndarray], counts: np.ndarray):
        self.books, self.radii, self.counts = books, radii, counts

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half and codeword, the least and greatest half score with q that a member can have."""
        out, half = [], self.books[0].shape[1]
        for part, book, radius in zip((q[:half], q[half:]), self.books, self.radii):
            middle = book @ part
            reach = np.sqrt(part @ part) * radius
            slack = 1e-9 * (1 + np.abs(middle) + reach)
            out.append((middle - reach - slack, middle + reach + slack))
        return out

    def best_first(self, q: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(greatest, least score a member can have, cell) by falling greatest score: a multi-sequence walk with a heap."""
        (low0, up0), (low1, up1) = self.bounds(q)
        first, second = np.argsort(-up0, kind="stable"), np.argsort(-up1, kind="stable")
        n, m = len(first), len(second)
        done = np.zeros((n, m), dtype=bool)
        heap = [(-(up0[first[0]] + up1[second[0]]), 0, 0)]
        while heap:
            best, i, j = heapq.heappop(heap)
            done[i, j] = True
            cell = int(first[i]) * m + int(second[j])
            if self.counts[cell]:
                yield -best, low0[first[i]] + low1[second[j]], cell
            if i + 1 < n and (j == 0 or done[i + 1, j - 1]):
                heapq.heappush(heap, (-(up0[first[i + 1]] + up1[second[j]]), i + 1, j))
            if j + 1 < m and (i == 0 or done[i - 1, j + 1]):
                heapq.heappush(heap, (-(up0[first[i]] + up1[second[j + 1]]), i, j + 1))

    def visit(self, q: np.ndarray, least: float | None, most: float) -> list[int]:
        """Cells to look into: without `least` the best ones until PROBE members are seen, else all the others that can
        hold a score of `least` or more. Cells whose every score is above `most` are passed over."""
        seen, probing, out = 0, True, []
        for best, low, cell in self.best_first(q):
            if least is not None and best < least:
                break
            if low > most:
                continue
            if probing:
                seen += int(self.counts[cell])
            if probing == (least is None):
                out.append(cell)
            if probing and seen >= PROBE:
                if least is None:
                    break
                probing = False
        return out


def _codes(rows: DataFrame, dims: int) -> tuple[list[np.ndarray], DataFrame, Cells]:
    """Fit the codebooks on a sample, put every vector into its cell and measure the cells: (books, coded, cells)."""
    spark, half = rows.sparkSession, max(1, dims // 2)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id", "point"), "vec_id", "point").limit(SAMPLE).select("point").collect()
    x = np.stack([np.frombuffer(r[0], dtype="<i4") for r in drawn]).astype(np.float64)
    k = max(1, min(CODES, int(np.sqrt(n / CELL_ROWS)), len(x)))
    books = [_codebook(x[:, :half], k), _codebook(x[:, half:], k) if dims > half else np.zeros((1, 0))]
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = _ints(batch.column("point"), dims).astype(np.float64)
            near, far = [], []
            for part, book in zip((x[:, :half], x[:, half:]), books):
                at = _nearest(part, book)
                near.append(at)
                far.append(np.sqrt(((part - book[at]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("vec_id", "label", "own", "copy", "point")},
                "cell": (near[0] * len(books[1]) + near[1]).astype(np.int32), "far0": far[0], "far1": far[1],
            })

    schema = "vec_id long, label long, own boolean, copy int, point binary, cell int, far0 double, far1 double"
    coded = stable(rows.mapInArrow(code, schema))
    m = len(books[1])
    counts, radii = np.zeros(len(books[0]) * m, dtype=np.int64), [np.zeros(len(books[0])), np.zeros(m)]
    for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far0").alias("r0"), F.max("far1").alias("r1")).collect():
        i, j = divmod(r["cell"], m)
        counts[r["cell"]] = r["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], r["r0"]), max(radii[1][j], r["r1"])
    return books, coded, Cells(books, [r * (1 + 1e-9) for r in radii], counts)


def _blocks(coded: DataFrame, parts: np.ndarray) -> DataFrame:
    """The index: vectors by cell in blocks of at most BLOCK, none across two parts: part, cells, ids, labels, owns, points.

    Range partitions of (cell, id, copy) spread a cell that holds a third of all vectors over many tasks.
    """
    spark = coded.sparkSession
    order = ["cell", "vec_id", "label", "copy", "point"]
    n = max(1, -(-coded.count() // (4 * BLOCK)))
    lined = coded.drop("far0", "far1").repartitionByRange(n, *order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = shared.value, []

        def emit(rows: list) -> pa.RecordBatch:
            vec_id, label, own, cell, point = (list(x) for x in zip(*rows))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([int(parts[cell[0]])], pa.int32()), "cells": pa.array([cell], pa.list_(pa.int32())),
                "ids": [vec_id], "labels": [label], "owns": [own], "points": [b"".join(point)],
            })

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "own", "cell", "point"))):
                if held and (len(held) == BLOCK or parts[row[3]] != parts[held[0][3]]):
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return stable(lined.mapInArrow(
        cut, "part int, cells array<int>, ids array<long>, labels array<long>, owns array<boolean>, points binary"
    ))


ASK = "a long, vec_id long, label long, point binary, windows array<struct<slot:int,low:long,high:long,least:long>>"


def _ask(asking: DataFrame, cells: Cells, parts: np.ndarray, probing: bool, chunks: int) -> DataFrame:
    """(part, chunk, asks) for anchors with windows: which cells of which part each wants to see.

    `least` of a window is the score below which nothing can come in any more; the walk ends below the least of them.
    An anchor asks a part once; anchors of a chunk ask together.
    """
    shared = asking.sparkSession.sparkContext.broadcast((cells.books, cells.radii, cells.counts, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, radii, counts, parts = shared.value
        cells = Cells(books, radii, counts)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("part", "cells", "a", "vec_id", "label", "point", "windows")}
            for row in batch.to_pylist():
                open_ = [w for w in row["windows"] if w["least"] <= w["high"]]
                if not open_:
                    continue
                q = np.frombuffer(row["point"], dtype="<i4").astype(np.float64)
                least = None if probing else min(w["least"] for w in open_)
                wanted = np.array(cells.visit(q, least, max(w["high"] for w in open_)), dtype=np.int32)
                for part in np.unique(parts[wanted]) if len(wanted) else ():
                    out["part"].append(int(part))
                    out["cells"].append(wanted[parts[wanted] == part].tolist())
                    for c in ("a", "vec_id", "label", "point"):
                        out[c].append(row[c])
                    out["windows"].append(open_)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(f"part int, cells array<int>, {ASK}")
    schema = to_arrow_schema(fields)
    asked = asking.mapInArrow(ask, fields)
    one = F.struct("cells", "a", "vec_id", "label", "point", "windows")
    return asked.groupBy("part", F.pmod("a", F.lit(chunks)).alias("chunk")).agg(F.collect_list(one).alias("asks"))


def _answer(blocks: DataFrame, asks: DataFrame, dims: int, take: int, same: bool) -> DataFrame:
    """(a, slot, score, vec_id): per anchor and window, the best `take` members of every block that were asked for.

    Only the asks and the blocks are shuffled, by part; their pairs are compared where they meet, and a task merges the
    lists of its blocks. Scores are exact: in doubles where no sum can leave their integers, else in long integers.
    """

    def best(score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) > take:
            last = np.partition(score[at], len(at) - take)[len(at) - take]
            at = at[score[at] >= last]
        return at[np.lexsort((ids[at], -score[at]))[:take]]

    def lists(held: dict[tuple, list]) -> pa.RecordBatch:
        rows = [(a, slot, -score, i) for (a, slot), best in held.items() for score, i in sorted(best)[:take]]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["a", "slot", "score", "vec_id"],
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["points"], dtype="<i4").reshape(-1, dims)
                q = np.frombuffer(b"".join(r["point"] for r in row["asks"]), dtype="<i4").reshape(-1, dims)
                size = float(np.abs(x.astype(np.int64)).max()) * float(np.abs(q.astype(np.int64)).max()) * dims
                kind = np.float64 if size < 2**53 else np.int64
                scores = (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
                ids, labels = np.array(row["ids"]), np.array(row["labels"])
                names, cell = np.unique(np.array(row["cells"]), return_inverse=True)
                own = np.array(row["owns"])
                for r, score in zip(row["asks"], scores):
                    seen = np.isin(names, r["cells"])[cell] & ((labels == r["label"]) == same)
                    if same:
                        me = np.flatnonzero(own & (ids == r["vec_id"]) & (labels == r["label"]))
                        seen[[i for i in me if x[i].tobytes() == r["point"]]] = False
                    for w in r["windows"]:
                        at = best(score, ids, np.flatnonzero(seen & (score >= w["least"]) & (score <= w["high"])))
                        if len(at):
                            some = held.setdefault((r["a"], w["slot"]), [])
                            some.extend(zip((-score[at]).tolist(), ids[at].tolist()))
                            if len(some) > 8 * take:
                                some[:] = sorted(some)[:take]
                if len(held) > HELD:
                    yield lists(held)
                    held = {}
        if held:
            yield lists(held)

    pairs = blocks.join(asks, "part").select("cells", "ids", "labels", "owns", "points", "asks")
    return pairs.mapInArrow(answer, "a long, slot int, score long, vec_id long")


def _ranked(found: DataFrame, take: int) -> DataFrame:
    order = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def _search(anchors: DataFrame, windows: DataFrame, index: tuple, dims: int, take: int, same: bool, chunks: int) -> DataFrame:
    """(a, slot, score, vec_id, rank): the best `take` of every window (a, slot, low, high), certified.

    A probe of the best cells tells from which score on a window is full; the second walk stops at the first cell that
    can't reach that score, so nothing better is left unseen.
    """
    blocks, cells, parts = index

    def run(open_: DataFrame, probing: bool) -> DataFrame:
        told = open_.groupBy("a").agg(F.collect_list(F.struct("slot", "low", "high", "least")).alias("windows"))
        asking = anchors.join(told, "a").select("a", "vec_id", "label", "point", "windows")
        asks = stable(_ask(asking, cells, parts, probing, chunks))
        return stable(_ranked(_answer(blocks, asks, dims, take, same), take))

    probe = run(windows.withColumn("least", F.col("low")), True)
    full = probe.where(F.col("rank") == take).select("a", "slot", F.col("score").alias("full"))
    rest = windows.join(full, ["a", "slot"], "left").select("a", "slot", "low", "high", F.coalesce("full", "low").alias("least"))
    found = probe.drop("rank").unionByName(run(stable(rest), False).drop("rank"))
    return stable(_ranked(found, take))


def quantised(vector: Column | str, scale: int = 256):
    """Components as whole numbers floor(scale * x); null if any is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label (whole numbers) and v, an array of whole numbers. A score is the inner product with an
    anchor; higher comes first, ties by smaller vec_id. For each anchor and each of its best `positives` other rows of
    the label, the best `negatives` of other labels with low * positive <= 100 * negative <= high * positive.

    Rows with a null vec_id, label, vector or component, without components, or with components so large that a score
    might not fit a long (beyond 2^30 / sqrt(length)) take no part. Vectors of different lengths never meet. A repeated row is a
    row like any other, so it is another row's positive. Equal vectors with one label are told apart by id alone, so
    of those only as many as a list can need are kept, the smallest ids: a vector that a third of all rows share
    costs no more. An anchor without positives, or a positive without negatives, gives no rows; an empty table neither.

    The half-space codebooks are fitted on at most SAMPLE vectors, every vector is in the index, and answers are exact.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col("v")
    size = (F.lit(2.0**30) / F.sqrt(F.size("v")))
    fine = v.isNotNull() & (F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= size))
    named = keyed(vectors, vec_id=F.col("vec_id").cast("long"), label=F.col("label").cast("long"), v=F.col("v"), anchor=is_anchor)
    rows = stable(named.where("vec_id is not null and label is not null").where(fine))
    found = None
    for dims in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        part = _mine(rows.where(F.size("v") == dims), dims, positives, negatives, low, high)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return found


def _mine(rows: DataFrame, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dims)
            kept = {c: batch.column(c) for c in batch.schema.names if c != "v"}
            yield pa.RecordBatch.from_pydict({**kept, "point": [r.tobytes() for r in x]})

    row = rows.schema["row"].dataType.simpleString()
    packed = stable(rows.select("row", "vec_id", "label", "anchor", "v").mapInArrow(
        pack, f"row {row}, vec_id long, label long, anchor boolean, point binary"
    ))
    alike = Window.partitionBy("label", "point").orderBy("vec_id", "row")
    kept = packed.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= max(positives + 1, negatives))
    own = ~F.coalesce(F.lag("vec_id").over(alike) == F.col("vec_id"), F.lit(False))
    kept = stable(kept.select("vec_id", "label", own.alias("own"), "copy", "point"))
    _, coded, cells = _codes(kept, dims)
    parts = (np.cumsum(cells.counts) // PART_ROWS).astype(np.int32)
    index = (_blocks(coded, parts), cells, parts)

    anchors = stable(packed.where("anchor").select(F.monotonically_increasing_id().alias("a"), "vec_id", "label", "point"))
    n = anchors.count()
    if not n:
        return packed.limit(0).select(*[F.col("vec_id").alias(c) for c in ("anchor_id", "positive_id")], F.lit(1).alias("rank"),
                                      *[F.col("vec_id").alias(c) for c in ("negative_id", "positive_score", "negative_score")])
    chunks = -(-n // CHUNK)
    everything = anchors.select("a", F.lit(0).alias("slot"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high"))
    best = _search(anchors, everything, index, dims, positives, True, chunks)
    best = stable(best.select("a", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # Bounds of the negatives' scores in whole numbers; `div` cuts towards zero, and only positive scores open a window.
    wide = lambda share: F.lit(share).cast("decimal(38,0)") * F.col("positive_score")
    lowest, highest = F.ceil(wide(low) / 100).cast("long"), F.floor(wide(high) / 100).cast("long")
    windows = stable(best.select("a", "slot", lowest.alias("low"), highest.alias("high")).where("low <= high"))
    found = _search(anchors, windows, index, dims, negatives, False, chunks)
    return (
        found.join(best, ["a", "slot"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


# The same by scoring every anchor with every row.
ORACLE_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, a.label AS anchor_label, b.k, b.vec_id, b.label,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.k <> b.k AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT ak, anchor_id, anchor_label, k AS pk, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id, k) <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.ak, pk ORDER BY score DESC, vec_id, k) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.ak = pos.ak AND s.label <> pos.anchor_label
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
