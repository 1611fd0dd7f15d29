"""Secrets in texts, by patterns and by linking the parts of credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stable
from .common import prepare

# The base patterns (the group is the part whose length counts), their least lengths, and their order.
ASSIGN = "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "((?<![0-9a-f])[0-9a-f]{24,})"
BASE = {"assign": (ASSIGN, 6), "access": (ACCESS, 20), "hex": (HEX, 24)}
# Parts of credentials that say little alone.
IDENTIFIER = "((?i)(?:client|account|tenant|user)_?(?:id|name)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{4,})"
KEY = "((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]))"
ENDPOINT = "(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)"
PARTS = {"identifier": (IDENTIFIER, 4), "key": (KEY, 40), "endpoint": (ENDPOINT, 8)}
KINDS = [*BASE, *PARTS]

REACH = 400  # code points between the starts of parts of one credential, where they don't stand on lines of one block
BLANK = "\\n(?:[\\x20\\t\\r]*\\n)+"  # ends a block of lines; no match reaches over a line end


def _matches(text: Column, pattern: str, maybe: Column) -> Column:
    """Per match: the gap before it, its length, and its group's length, in code points; line and block ends in the gap.

    Splitting at the pattern gives the gaps and extracting gives the matches, both from left to right
    without overlap. `maybe` is a cheap necessary condition.
    """
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.char_length)
    group = F.transform(F.regexp_extract_all(text, p, F.lit(1)), F.char_length)
    before = F.transform(F.slice(gaps, 1, F.size(whole)), lambda g: F.struct(
        F.char_length(g).alias("gap"), F.regexp_count(g, F.lit("\n")).alias("lines"), F.regexp_count(g, F.lit(BLANK)).alias("blocks")
    ))
    return F.when(maybe, F.arrays_zip(before.alias("before"), whole.alias("whole"), group.alias("group")))


def _found(docs: DataFrame) -> DataFrame:
    """One pass over the texts: uid, doc_id and, per kind, the matches in order. Written, as everything else reads it."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    has = lambda c, *words: F.greatest(*[c.contains(w) for w in words]) if len(words) > 1 else c.contains(words[0])
    identified = has(text, "AKIA") | text.rlike("(?i)(?:client|account|tenant|user)_?(?:id|name)[\"']?\\x20*[:=]")
    maybe = {
        "assign": has(low, "passw", "secret", "token", "apikey", "api_key"),
        "access": has(text, "AKIA"),
        "hex": text.rlike("[0-9a-f]{24}"),
        "identifier": identified,
        "key": identified | has(text, "://"),
        "endpoint": has(text, "://"),
    }
    patterns = {**BASE, **PARTS}
    columns = [_matches(F.col("text"), patterns[k][0], maybe[k]).alias(k) for k in KINDS]
    return stable(
        docs.select("doc_id", text.alias("text")).select("doc_id", *columns).withColumn("uid", F.monotonically_increasing_id())
    )


def _spans(found: DataFrame) -> DataFrame:
    """uid, kind (number), start, end, line, block for every match that is long enough; running sums give the places."""
    least = {k: n for k, (_, n) in {**BASE, **PARTS}.items()}
    kinds = F.array(*[
        F.struct(F.lit(i).alias("kind"), F.lit(least[k]).alias("least"), F.col(k).alias("matches")) for i, k in enumerate(KINDS)
    ])
    by_kind = found.select("uid", F.inline(kinds)).where("size(matches) > 0")
    rows = by_kind.select("uid", "kind", "least", F.posexplode("matches").alias("at", "m")).select(
        "uid", "kind", "least", "at", "m.before.*", "m.whole", "m.group"
    )
    along = Window.partitionBy("uid", "kind").orderBy("at")
    end = F.sum(F.col("gap").cast("long") + F.col("whole")).over(along)
    placed = rows.select("*", end.alias("end"), F.sum("lines").over(along).alias("line"), F.sum("blocks").over(along).alias("block"))
    return placed.where(F.col("group") >= F.col("least")).select(
        "uid", "kind", (F.col("end") - F.col("whole")).alias("start"), "end", "line", "block"
    )


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """The parts that complementary parts complete, within `reach` in the same text or on other lines of the same block.

    A block is the lines between two blank ones; a line alone may be a whole minified file, so on it `reach` decides.
    A key is completed by an access identifier or a named identifier, an identifier by a key or an assigned secret, an
    endpoint by both. The interval join meets parts in cells of `reach` code points, each row in its own
    cell and its partners' also in the neighbours'; a cell holds a bounded number of spans. A block needs no pairs: the
    first and the last line of a role tell whether another line has it.
    """
    number = {k: i for i, k in enumerate(KINDS)}
    of = lambda *kinds: F.col("kind").isin(*[number[k] for k in kinds])
    role = F.when(of("access", "identifier"), "identity").when(of("key", "assign"), "key")
    weak = spans.where(of(*PARTS)).withColumn("cell", F.floor(F.col("start") / reach))
    parts = spans.withColumn("role", role).where("role is not null")
    others = parts.select("uid", "role", F.col("start").alias("s"), F.floor(F.col("start") / reach).alias("c"))
    others = others.select("uid", "role", "s", F.explode(F.array(F.col("c") - 1, "c", F.col("c") + 1)).alias("cell"))
    near = weak.join(others, ["uid", "cell"]).where(F.abs(F.col("s") - F.col("start")) <= reach)

    roles = ("identity", "key")
    lines = [f(F.when(F.col("role") == r, F.col("line"))).alias(f"{n}_{r}") for r in roles for n, f in (("first", F.min), ("last", F.max))]
    blocks = parts.groupBy("uid", "block").agg(*lines)
    elsewhere = lambda r: (F.col(f"first_{r}") < F.col("line")) | (F.col(f"last_{r}") > F.col("line"))
    place = ("uid", "kind", "start", "end")
    met = near.select(*place, *[(F.col("role") == r).alias(r) for r in roles]).unionByName(
        weak.join(blocks, ["uid", "block"]).select(*place, *[elsewhere(r).alias(r) for r in roles])
    )
    has = lambda r: F.max(F.when(F.col(r), 1).otherwise(0)).alias(r)
    seen = met.groupBy(*place).agg(*[has(r) for r in roles])
    complete = (
        ((F.col("kind") == number["key"]) & (F.col("identity") == 1))
        | ((F.col("kind") == number["identifier"]) & (F.col("key") == 1))
        | ((F.col("kind") == number["endpoint"]) & (F.col("identity") == 1) & (F.col("key") == 1))
    )
    return seen.where(complete).select("uid", "kind", "start", "end")


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are matches of the three patterns; linked spans are the weak parts of credentials that
    complementary parts near them or in their block of lines complete. Null text counts as empty: no spans. Repeated rows and rows with
    null ids are scanned one by one; extra columns are left out, an empty table gives no rows. Spans that start together go
    by the order of their kinds. Texts, very long ones too, are read once and do not move; only matches are shuffled.
    """
    prepare(docs.sparkSession)
    found = _found(docs)
    spans = stable(_spans(found))
    told = spans.where(F.col("kind") < len(BASE)).drop("line", "block").unionByName(_linked(spans, reach))
    place = F.struct("start", "kind", "end")
    base = F.col("kind") < len(BASE)
    per_text = told.groupBy("uid").agg(
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.collect_list(F.when(base, place)).alias("base"),
        F.collect_list(place).alias("all"),
    ).select("uid", *[f"n_{k}" for k in BASE], _written(F.col("base")).alias("base"), _written(F.col("all")).alias("spans"))
    joined = found.select("uid", "doc_id").join(per_text, "uid", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
