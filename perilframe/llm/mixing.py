"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stable
from .common import filed, keyed, plain_names, prepare, restore, spread_marks

# A token of the mix, the weights that sources take in turn, the mix's size and the most of a source.
TOKEN = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0

BLOCK = 32  # tokens, at most
FINE = 100  # blocks that the target of a source's shard holds on average, at least, while a block is over one token
SHARD_DOCS = 256  # documents of a shard, about
REGION_SHARDS = 256  # shards of a region, about


def token_count(text: str | Column) -> Column:
    """Tokens become one letter each, white space goes: a very long text needs no list of its tokens."""
    letters = F.regexp_replace(F.regexp_replace(text, TOKEN, "x"), "[^x]+", "")
    return F.coalesce(F.char_length(letters), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add target, in tokens, to one row per source with its source_size.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all tokens; no target
    exceeds `most` times its source, the excess goes to the others by weight until none does. Ordered by
    cap / weight, the sources that stop are the first ones, so one pass of running sums finds the end of the
    resharing. Works on the table of sources, never on documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1)))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = weighed.withColumn("cap", most * F.col("source_size")).select(
        "*",
        (share * F.sum("source_size").over(everything)).alias("_whole"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("_spent"),
        F.sum("weight").over(rest).alias("_open"),
    )
    level = (F.col("_whole") - F.col("_spent")) / F.col("_open")
    # Levels rise while sources stop and fall after the first one that does not: its level, the highest of those that
    # do not stop, holds for it and all after it.
    stops = F.col("cap") <= level * F.col("weight")
    final = capped.withColumn("_level", F.max(F.when(~stops, level)).over(everything))
    return final.select(
        *sources.columns, F.when(stops, F.col("cap")).otherwise(F.col("_level") * F.col("weight")).alias("target")
    )


def apportion(shares: DataFrame, group: list[str], order: list[str], weight: str, seats: str, most: str) -> DataFrame:
    """Add `quota`: a group's `seats` dealt to its rows by highest quotients weight / (2 k + 1), at most `most` each.

    Rounding weight / d with a divisor d that is sure to be too large hands out all but a few seats per row;
    the quotients that can still win are few more than the group has rows, and the best of them get the rest.
    `seats` and the group's total weight stand on every row; ties go by `order`.
    """
    rows = Window.partitionBy(*group)
    total, n = F.sum(weight).over(rows), F.count("*").over(rows)
    sized = shares.withColumn("_total", total).withColumn("_n", n)
    rounded = lambda divisor: F.floor(F.col(weight) / divisor + 0.5)
    enough = (F.col(seats) > F.col("_n")) & (F.col("_total") > 0)
    large = F.col("_total") / (F.col(seats) - F.col("_n") / 2)
    small = F.col("_total") / (F.col(seats) + F.col("_n") / 2)
    lowest = F.when(enough, rounded(large)).otherwise(0)
    highest = F.when(F.col("_total") > 0, rounded(small) + 1).otherwise(0)
    bounded = sized.withColumn("_low", F.least(lowest, F.col(most))).withColumn("_high", F.least(highest, F.col(most)))
    bounded = bounded.withColumn("_left", F.col(seats) - F.sum("_low").over(rows))
    more = bounded.where("_high > _low").select(
        *group, *order, "_left", weight, F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k")
    )
    best = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), *order, "_k")
    won = more.withColumn("_place", F.row_number().over(best)).where("_place <= _left")
    keys = [*group, *order]
    counted = won.groupBy(*keys).agg(F.count("*").alias("_won")).withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return bounded.join(counted, same, "left").select(
        *shares.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota")
    )


def _placed(docs: DataFrame, seed: int, block: int) -> DataFrame:
    """The rows of docs with their source's target, their shard, its size and the tokens it gives, and their place in it."""
    prepare(docs.sparkSession)
    mark = F.xxhash64("doc_id", "text")
    rows = stable(spread_marks(stable(keyed(docs, doc_id="doc_id", source="source", size=token_count("text"), mark=mark))))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    everything = Window.partitionBy()
    aimed = targets(stable(per_source)).withColumn("_shards", F.ceil(F.col("_docs") / SHARD_DOCS))
    finest = F.min(F.when(F.col("target") > 0, F.col("target") / F.col("_shards") / FINE)).over(everything)
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce(finest, F.lit(1.0))))).cast("long")
    aimed = aimed.withColumn("_block", length)
    whole = aimed.select(
        "*", F.lit(1).alias("_one"), F.round(F.sum("target").over(everything) / F.col("_block")).cast("long").alias("_seats"),
        _room("source_size").alias("_most"),
    )
    sources = stable(
        apportion(whole, ["_one"], ["source"], "target", "_seats", "_most").select(
            "source", "source_size", "target", "_block", F.col("quota").alias("_blocks"), "_shards"
        )
    )

    spread = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "row", "doc_id", rows["source"], "size", "source_size", "target", "_block", "_blocks",
        F.xxhash64(F.lit(seed), "mark").alias("_order"), "_shards", "mark",
    )
    spread = spread.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), "_shards")).drop("mark")
    spread = spread.withColumn("_region", F.floor(F.col("_shard") / REGION_SHARDS))
    shards = stable(
        spread.groupBy("source", "_region", "_shard").agg(
            F.sum("size").alias("_size"), F.max("_blocks").alias("_blocks"), F.max("_block").alias("_block")
        ).withColumn("_most", _room("_size"))
    )
    regions = shards.groupBy("source", "_region").agg(
        F.sum("_size").alias("_size"), F.max("_blocks").alias("_blocks"), F.sum("_most").alias("_most")
    )
    regions = apportion(regions, ["source"], ["_region"], "_size", "_blocks", "_most")
    regions = regions.select(F.col("source").alias("_s"), F.col("_region").alias("_r"), F.col("quota").alias("_regional"))
    at = shards["source"].eqNullSafe(regions["_s"]) & (shards["_region"] == regions["_r"])
    cells = shards.join(regions, at).select("source", "_region", "_shard", "_size", "_regional", "_most", "_block")
    quotas = stable(apportion(cells, ["source", "_region"], ["_shard"], "_size", "_regional", "_most"))
    wanted = F.least(F.col("quota") * F.col("_block"), (F.lit(MOST) * F.col("_size")).cast("long"))
    quotas = quotas.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_size", wanted.alias("_wanted"))
    laps = F.when(F.col("_size") > 0, F.floor(F.col("_wanted") / F.col("_size"))).otherwise(0).cast("long")  # times taken whole
    return spread.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h"))).select(
        "row", "doc_id", "source", "size", "source_size", "target", "_shard", "_order", "_size", "_wanted", laps.alias("_laps")
    )


def _room(size: str) -> Column:
    """Blocks that `size` tokens can fill, taken up to MOST times; the last may be filled in part."""
    return F.ceil(MOST * F.col(size) / F.col("_block"))


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Per input row: row, doc_id, size, source_size, target, taken.

    Sources get blocks of `block` tokens by Sainte-Lague, and so do a source's regions and a region's shards. In a
    shard, documents stand in seeded order and are cut into blocks; the quota takes blocks from the
    front and starts over at the end, so no document is taken more than `most` times. Blocks are shorter, down to one
    token, where a source is so small that a shard's target would not hold FINE of them. The same rows and
    seed give the same mix. Null or wordless texts have size 0 and nothing taken; a source without tokens has target
    0; the null source is one source. Repeated rows are taken one by one; their order is by file and row, and so is the
    shard of very many equal ones. A very long text is counted without a list of its tokens and may be taken in
    part. An empty table gives no rows.

    A source's documents are spread over shards of a few hundred, as many as it needs, so a source with a third
    of all rows is ordered by many tasks. Shards and regions, not documents, meet in the apportionment.
    """
    placed = _placed(docs, seed, block)
    line = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "row")
    start = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("_wanted") - F.col("_laps") * F.col("_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return placed.withColumn("_start", start).select(
        "row", "doc_id", "source", "size", "source_size", "target",
        (F.col("_laps") * F.col("size") + partial).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix(docs, seed).select("doc_id", "size", "source_size", "target", "taken")


def _whole_picks(placed: DataFrame) -> DataFrame:
    """(row, times): whole documents for every shard's tokens, in seeded order.

    Each document comes as often as its shard is taken whole. Of the rest, a document is taken once more if what is
    left still holds it, so a long one that does not fit leaves the place to those after it; at the end the shortest
    one left over comes too if that is nearer to the quota. A shard of a few hundred documents is one row here.
    """
    line = F.sort_array(F.collect_list(F.struct("_order", "doc_id", "row", "size")))
    shards = placed.where("size > 0 and _wanted > 0").groupBy("source", "_shard").agg(
        F.first("_laps").alias("_laps"), F.first(F.col("_wanted") - F.col("_laps") * F.col("_size")).alias("_rest"),
        line.alias("_line"),
    )
    none = F.array().cast("array<boolean>")
    step = lambda s, d: F.struct(
        F.when(d["size"] <= s["left"], s["left"] - d["size"]).otherwise(s["left"]).alias("left"),
        F.concat(s["got"], F.array(d["size"] <= s["left"])).alias("got"),
    )
    filled = shards.withColumn("_fill", F.aggregate("_line", F.struct(F.col("_rest").alias("left"), none.alias("got")), step))
    marked = filled.withColumn("_zip", F.zip_with("_line", "_fill.got", lambda d, got: F.struct(
        d["row"].alias("row"), d["size"].alias("size"), got.alias("got"), d["_order"].alias("order"), d["doc_id"].alias("doc_id"))))
    over = F.filter("_zip", lambda d: ~d["got"])
    shortest = F.array_min(F.transform(over, lambda d: F.struct(d["size"], d["order"], d["doc_id"], d["row"])))
    last = marked.withColumn("_last", F.when(shortest["size"] < 2 * F.col("_fill.left"), shortest["row"]))
    each = last.select("_laps", "_last", F.explode("_zip").alias("d"))
    extra = F.col("d.got") | F.coalesce(F.col("d.row") == F.col("_last"), F.lit(False))
    return each.select("d.row", (F.col("_laps") + extra.cast("int")).cast("int").alias("times")).where("times > 0")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of the mix with all columns of docs, whole documents only (see `_whole_picks`).

    Beside the rounding to blocks, a shard misses its quota by at most half of its shortest left-out document.
    """
    docs = filed(docs)
    names = plain_names(docs)
    times = stable(_whole_picks(_placed(docs, seed, BLOCK)))
    # Most rows stay, so their keys are as many as the documents: never a side to broadcast.
    held = keyed(docs, **{c: F.col(f"`{n}`") for c, n in names.items()}).join(times.hint("merge"), "row")
    return restore(held.select(*names, F.explode(F.sequence(F.lit(1), "times"))), names)
