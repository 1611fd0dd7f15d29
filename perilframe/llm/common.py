"""Helpers shared by the text and vector operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import configure, stable

# Functions for executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

BATCH_ROWS = 1024
BATCH_BYTES = 4 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, Arrow batches bounded by rows and bytes, and Bloom filters for joins.

    A join of whole texts with the few that matter shuffles only texts whose key a Bloom filter of the small side
    may hold. Spark builds it, of bounded size, where the small side is too large to broadcast but below 1 GB.
    """
    configure(spark)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _scans_once(df: DataFrame) -> bool:
    """Whether df is one table scan, each row at most once: Spark hands _metadata through explodes and joins too."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if not plan.nodeName().startswith("LogicalRelation"):
        return False
    relation = plan.relation()
    if not relation.getClass().getSimpleName() == "HadoopFsRelation":
        return False
    paths = relation.location().rootPaths()
    return paths.distinct().size() == paths.size()


def filed(df: DataFrame) -> DataFrame:
    """df if it is a scan of files, whose rows can be told by them; else df written to a table."""
    if not _scans_once(df):
        return stable(df)
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index"))
        return df
    except AnalysisException:
        return stable(df)


def keyed(df: DataFrame, **named: Column | str) -> DataFrame:
    """The named columns plus `row`, a key that is unique per input row and the same in every scan.

    The key is the file and the row number in it. A caller that keys a frame twice passes it through `filed` first.
    """
    df = filed(df)
    place = df.metadataColumn("_metadata")
    row = F.struct(place.getField("file_path").alias("file"), place.getField("row_index").alias("at"))
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    return df.select(row.alias("row"), *columns)


CROWD = 32  # equal rows that may share a hash


def spread_marks(rows: DataFrame) -> DataFrame:
    """Set `mark`, a hash of a row's id and text, to one with the row's place where more than CROWD rows have it.

    So many equal rows don't fall together, and the marks of all others don't depend on how the table was written. The
    place is `row` without the folder and the id of the write. `rows` is a written table.
    """
    crowded = rows.groupBy("mark").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD)
    write = "-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    name = F.regexp_replace(F.substring_index("row.file", "/", -1), write, "")
    own = F.when(F.col("_n").isNull(), F.col("mark")).otherwise(F.xxhash64("mark", name, "row.at"))
    return rows.join(stable(crowded), "mark", "left").select(*[c for c in rows.columns if c != "mark"], own.alias("mark"))


def plain_names(df: DataFrame) -> dict[str, str]:
    """Names c0, c1, ... for the columns of df, so that no helper column can clash with them."""
    return {f"c{i}": c for i, c in enumerate(df.columns)}


def restore(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in names.items()])


def drop_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs (see `filed`) whose key is not in `rows`, with the columns of docs."""
    names = plain_names(docs)
    held = keyed(docs, **{c: F.col(f"`{n}`") for c, n in names.items()})
    return restore(held.join(stable(rows.select("row")), "row", "left_anti"), names)


def map_texts(
    df: DataFrame, schema: str | StructType, work: Callable[[], Callable[[list[str]], dict[str, list]]],
    keep: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """Add columns computed from whole texts, batch by batch; `keep` columns pass through.

    `work` runs once per task and returns the function for a batch of texts (None for null). The schema
    names the kept columns first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = work()
        for batch in batches:
            made = fn(batch.column(text).to_pylist())
            kept = {k: batch.column(k) for k in keep}
            yield pa.RecordBatch.from_pydict({**kept, **made}, schema=out)

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)
    return df.select(*keep, *([] if text in keep else [text])).mapInArrow(run, fields)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every larger end `a` has one smaller end `b`, and no `b` is also an `a`."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return per_node.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Large-star and small-star steps until the edges form stars. A node's minimum is combined map-side and
    written; the join that hands it to the node's edges reads two written tables, so AQE can split a
    node with very many edges. Edges are distinct and never more than at the start plus one per node.
    """
    spark = edges.sparkSession
    big, small = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = stable(edges.where(F.col(a) != F.col(b)).select(big, small).distinct())
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stable(large.where("a <> b").distinct())
        low = stable(now.groupBy("a").agg(F.min("b").alias("m")))
        joined = now.join(low, "a")
        small_star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        now = stable(small_star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
