"""Near duplicates among vectors by an epsilon grid order join under cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..session import stable
from .common import components, prepare

LEAST = 0.9
LEADING = 6  # principal dimensions of the grid
BLOCK = 2048  # vectors of a sequence interval at the lowest level
STRIPE = (16, 64)  # blocks of a stripe, at least and at most
TILE = 512
SLACK = 1e-9  # for rounding in bounds and in scores of unit vectors
BORDER = 1 << 15  # pairs near the threshold that are settled at once


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _links(ux: np.ndarray, uy: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least `least`: by their unit vectors ux, uy, and where those are too close
    to call, by dot / sqrt(x2 * y2) of the vectors themselves, which other rows have no part in."""
    score = ux @ uy.T
    near = score >= least
    a, b = np.nonzero(np.abs(score - least) <= SLACK)
    for start in range(0, len(a), BORDER):
        i, j = a[start : start + BORDER], b[start : start + BORDER]
        p, q = _scaled(x[i]), _scaled(y[j])
        squares = np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q)
        near[i, j] = np.einsum("ij,ij->i", p, q) / np.sqrt(squares) >= least
    return near


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: not null or empty, all components finite, not zero. Grouped: equal ones are one class."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(fine & F.exists(v, lambda x: x != 0))
    plain = _no_minus_zero(vectors)
    return rows.select("vec_id", plain.alias("v")).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def _no_minus_zero(vectors: DataFrame):
    """v with 0.0 for -0.0, which is the same number."""
    zero = F.lit(0.0).cast(vectors.schema["v"].dataType.elementType)
    return F.transform("v", lambda x: x + zero)


def _kind(classes: DataFrame) -> str:
    return "<f4" if classes.schema["v"].dataType.elementType == FloatType() else "<f8"


def _axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Principal axes from second moments of the unit vectors, the leading one first.

    Each task sums its part; dims * dims sums meet, whatever the number of vectors.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dims))
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": np.arange(dims * dims), "value": total.ravel()})

    sums = classes.select("v").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(dims * dims)
    for cell, value in sums.collect():
        total[cell] = value
    values, axes = np.linalg.eigh(total.reshape(dims, dims))
    return axes[:, np.argsort(-values)]


def _blocks(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Classes in epsilon grid order, cut into blocks: block, members, their vectors, and the bounds of all.

    The order is by grid cell on the leading principal dimensions, first dimension first; range partitions of it
    are cut into intervals of at most BLOCK. Order and bounds are those of the unit vectors in principal axes; `points`
    are the vectors themselves.
    """
    spark, dims, kind = classes.sparkSession, len(axes), _kind(classes)
    leading = min(LEADING, dims)
    shared = spark.sparkContext.broadcast(axes)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dims)) @ shared.value
            cells = np.floor(x[:, :leading] / eps).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "first": batch.column("first"), "n": batch.column("n"),
                "cells": pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), leading).cast(pa.list_(pa.int32())),
                "along": x[:, 0],
                "point": [row.tobytes() for row in _matrix(batch.column("v"), dims).astype(kind)],
            })

    turned = stable(classes.mapInArrow(turn, "first long, n long, cells array<int>, along double, point binary"))
    parts = max(1, -(-turned.count() // BLOCK))
    order = ["cells", "along", "first"]
    ordered = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def emit(rows: list) -> pa.RecordBatch:
            first, n, points = (list(x) for x in zip(*rows))
            data = b"".join(points)
            x = _unit(np.frombuffer(data, kind).astype(np.float64).reshape(len(rows), dims)) @ shared.value
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "k": pa.array([k], pa.int64()), "first": [first], "n": [n],
                "points": [data], "low": [x.min(axis=0)], "high": [x.max(axis=0)],
            })

        for batch in batches:
            held.extend(zip(*(batch.column(c).to_pylist() for c in ("first", "n", "point"))))
            while len(held) >= BLOCK:
                yield emit(held[:BLOCK])
                held, k = held[BLOCK:], k + 1
        if held:
            yield emit(held)

    schema = "part long, k long, first array<long>, n array<long>, points binary, low array<double>, high array<double>"
    made = stable(ordered.mapInArrow(cut, schema))
    width = (made.agg(F.max("k")).first()[0] or 0) + 1
    return made.withColumn("block", F.col("part") * width + F.col("k")).drop("part", "k")


def _near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(i, j), i <= j, of blocks that may hold a pair within eps, by recursion over sequence intervals.

    An interval of a level is a run of blocks; its bounds are those of its blocks. From the interval that holds all,
    each pair of intervals whose bounds are at most eps apart is replaced by the pairs of its halves.
    """
    bounds = blocks.select("block", "low", "high")
    top = bounds.agg(F.max("block")).first()[0]
    levels = max(0, int(top).bit_length()) if top is not None else 0
    pairs = bounds.sparkSession.createDataFrame([(0, 0)], "i long, j long")
    for level in range(levels, -1, -1):
        interval = F.shiftright("block", level)
        sides = bounds.select(interval.alias("at"), F.posexplode(F.arrays_zip("low", "high")).alias("d", "b"))
        boxes = sides.groupBy("at", "d").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
        ordered = boxes.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("box"))
        if level < levels:
            half = F.array(F.lit(0), F.lit(1))
            halves = pairs.select("i", "j", F.explode(half).alias("di")).select("*", F.explode(half).alias("dj"))
            pairs = halves.select((2 * F.col("i") + F.col("di")).alias("i"), (2 * F.col("j") + F.col("dj")).alias("j"))
            pairs = pairs.where("i <= j")
        a = ordered.select(F.col("at").alias("i"), F.col("box").alias("a"))
        b = ordered.select(F.col("at").alias("j"), F.col("box").alias("b"))
        gap = F.zip_with("a", "b", lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0)))
        apart = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
        pairs = stable(pairs.join(a, "i").join(b, "j").where(apart <= eps * eps * (1 + SLACK) + SLACK).select("i", "j"))
    return pairs


def _compare(blocks: DataFrame, pairs: DataFrame, dims: int, least: float, kind: str) -> DataFrame:
    """Per pair of blocks: for members with a link, how many vectors they link to, and edges that connect what links.

    Runs of neighbouring blocks are stripes. A task compares two stripes and gets each of their blocks once, if a pair
    needs it: first its list of pairs, then block after block. So a block is sent as often as it has near stripes, not
    near blocks. A pair of blocks gives at most one row per member, so no pairs of vectors leave a task.
    """
    count = blocks.agg(F.max("block")).first()[0]
    stripe = max(STRIPE[0], min(STRIPE[1], int(np.ceil(np.sqrt((count or 0) + 1)))))
    cells = ((count or 0) // stripe + 1) * ((count or 0) // stripe + 2) // 2
    striped = pairs.select(F.floor(F.col("i") / stripe).alias("s"), F.floor(F.col("j") / stripe).alias("t"), "i", "j")
    lists = striped.groupBy("s", "t").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("pairs"))  # at most stripe ** 2
    needed = striped.select("s", "t", F.explode(F.array("i", "j")).alias("block")).distinct()
    fields = {"first": "array<bigint>", "n": "array<bigint>", "points": "binary"}
    sent = needed.join(blocks.select("block", *fields), "block").select(
        "s", "t", "block", *fields, F.lit(None).cast("array<struct<i:bigint,j:bigint>>").alias("pairs")
    )
    head = lists.select("s", "t", F.lit(-1).cast("bigint").alias("block"), *[F.lit(None).cast(k).alias(c) for c, k in fields.items()], "pairs")
    work = sent.unionByName(head).repartition(min(cells, 4096), "s", "t").sortWithinPartitions("s", "t", "block")

    def links_of(i: tuple, j: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (fx, nx, x, ux), (fy, ny, y, uy) = i, j
        links = [np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)]
        edges = []
        for start in range(0, len(x), TILE):
            near = _links(ux[start : start + TILE], uy, x[start : start + TILE], y, least)
            if same:
                r = np.arange(len(near))
                near[r, start + r] = False
            a, b = np.nonzero(near)
            if not len(a):
                continue
            np.add.at(links[0], a + start, ny[b])
            if not same:
                np.add.at(links[1], b, nx[a + start])
            edges.append(_spanning(a + start, b + (0 if same else len(x))))
        if edges:
            ids = np.concatenate((fx, fy))
            a, b = _spanning(*np.concatenate(edges, axis=1))
            yield pa.RecordBatch.from_pydict({"a": ids[a], "b": ids[b], "links": np.zeros(len(a), dtype=np.int64)})
            for f, n in zip((fx, fy), links):
                got = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"a": f[got], "b": f[got], "links": n[got]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        wanted: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] < 0:
                    held, wanted = {}, row["pairs"]
                    continue
                x = np.frombuffer(row["points"], kind).astype(np.float64).reshape(-1, dims)
                new = row["block"]
                held[new] = (np.array(row["first"], dtype=np.int64), np.array(row["n"], dtype=np.int64), x, _unit(x))
                # Blocks come in order, so a pair is complete with its larger block.
                for pair in wanted:
                    if pair["j"] == new:
                        yield from links_of(held[pair["i"]], held[new], pair["i"] == new)

    return work.mapInArrow(compare, "a long, b long, links long")


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A forest with the components of the edges (a, b): each node and the smallest node it reaches, where they differ."""
    nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    while (root[root] != root).any():
        root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[child], nodes[root[child]]])


def link_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is at least `least` (above 0); n_links counts the other rows a
    vector links to directly, component_id is the smallest vec_id reachable, kept says whether that is the
    row's own. A vector that is null, empty, zero or holds null or non-finite components links with nothing; a
    null vec_id takes part in no link. Equal vectors are one class, so a vector that a third of all
    rows share is compared once. Vectors of different lengths never link. An empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    given = vectors.schema["embedding"].dataType
    exact = given if given == ArrayType(FloatType(), given.containsNull) else ArrayType(DoubleType())
    rows = stable(vectors.select("vec_id", F.col("embedding").cast(exact).alias("v")))
    classes = stable(_usable(rows.where("vec_id is not null")))
    sizes = sorted(r[0] for r in classes.select(F.size("v")).distinct().collect())
    eps = float(np.sqrt(2 - 2 * least))
    found = None
    for dims in sizes:
        same = classes.where(F.size("v") == dims)
        blocks = _blocks(same, _axes(same, dims), eps)
        part = _compare(blocks, _near_blocks(blocks, eps), dims, least, _kind(same))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = stable(found)
    roots = components(found.where("a <> b"))
    links = found.where("a = b").groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("links"))
    told = classes.join(links, "first", "left").join(roots.withColumnRenamed("node", "first"), "first", "left")
    told = stable(told.select("v", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "first").alias("root")))
    keyed_rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), _no_minus_zero(rows)).alias("v"))
    joined = keyed_rows.join(told, "v", "left")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"),
    )
