"""Exact duplicates of whole texts, white space aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable
from .common import drop_rows, filed, keyed, prepare

# Fixed value: the characters that do not count when texts are compared.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _hash(sha256: Column) -> Column:
    """128 bits of the content hash; never null, which spares the optimizer a filter that computes it again."""
    return F.coalesce(F.unhex(F.substring(sha256, 1, 32)), F.lit(b""))


def classes(docs: DataFrame) -> DataFrame:
    """Per input row: row, doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit content hash; of a group the row with the most code points stays, then the
    smallest doc_id (null last), then the first row. Members' bytes are compared with those of the
    row that stays; should some differ (a hash collision), these rows are grouped by their text itself, by
    the same rule. Null text counts as empty. Repeated rows are equal texts; one of them stays. A very long text is one
    value like any other; an empty table gives no rows.

    The hash groups shuffle a few numbers per row, combined map-side. Texts are shuffled for groups of more than
    one row alone, and the joins read written tables, so AQE splits a group that holds a third of all rows.
    """
    prepare(docs.sparkSession)
    source = keyed(docs, doc_id="doc_id", text="text")
    sha = F.sha2(normalised("text"), 256)
    chars = F.char_length(F.coalesce("text", F.lit("")))
    rows = stable(source.select("row", "doc_id", sha.alias("sha"), chars.alias("chars")).withColumn("hash", _hash(F.col("sha"))))

    best = F.struct((-F.col("chars")).alias("least"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(best).alias("best")).where("n > 1")
    shared = stable(groups.select("hash", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))

    differ = _collisions(source, shared)
    unequal = differ.groupBy("hash").agg(F.count("*").alias("unequal"))
    sized = shared.join(unequal, "hash", "left").select(
        "hash", "keep_id", "keep_row", (F.col("n") - F.coalesce("unequal", F.lit(0))).alias("n")
    )
    alone = F.col("n").isNull()
    told = rows.join(stable(sized), "hash", "left").select(
        "row", "doc_id", "sha",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )
    fixed = differ.select("row", *[F.col(c).alias(f"_{c}") for c in ("keep_id", "group_size", "kept")])
    corrected = told.join(fixed, "row", "left")
    found = F.col("_kept").isNotNull()
    return corrected.select(
        "row", "doc_id",
        *[F.when(found, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("keep_id", "group_size", "kept")],
        F.col("sha").alias("text_sha256"),
    )


def _collisions(source: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows whose bytes differ from the row that stays in their hash group, with their own classes."""
    # `n > 1` holds for all of `shared`; said here, it lets Spark filter the texts by these hashes before the shuffle.
    chars = F.char_length(F.coalesce("text", F.lit("")))
    texts = source.select("row", "doc_id", chars.alias("chars"), normalised("text").alias("body"))
    texts = texts.withColumn("hash", _hash(F.sha2("body", 256)))
    members = stable(texts.join(shared.where("n > 1").select("hash", "keep_row"), "hash"))
    stays = members.where(F.col("row") == F.col("keep_row")).select("hash", F.col("body").alias("kept_body"))
    differ = stable(members.join(stays, "hash").where("body <> kept_body").select("row", "doc_id", "chars", "hash", "body"))
    best = F.struct((-F.col("chars")).alias("least"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    own = differ.groupBy("hash", "body").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    return differ.join(own, ["hash", "body"]).select(
        "row", "hash", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs. An empty table stays empty."""
    docs = filed(docs)
    return drop_rows(docs, classes(docs).where("not kept"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return classes(docs).drop("row")


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents),
r AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r"""
