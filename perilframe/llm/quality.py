"""Quality of texts: heuristic labellers, a model of their accuracies, and a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import stable
from .common import keyed, map_texts, prepare, spread_marks

SAMPLE_DOCS = 4000  # bound of the documents that the scorer is fitted on
BUCKETS = 1 << 14
REPEATED = 4.0  # scale of the one feature that is not a share of words
ROUNDS = 100
KEEP = 0.5

_SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-")
_UPPER = bytes(range(0x41, 0x5B))
_ASCII_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_ABOVE_ASCII = bytes(range(0x80, 0x100))


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


class Seen:
    """What the labellers look at, from one pass over a text."""

    def __init__(self, text: str):
        data = text.encode()
        count = lambda chars: len(data) - len(data.translate(None, chars))
        words = data.split()
        self.words = len(words)
        bare = sum(map(len, words))
        self.symbols = _share(count(_SYMBOLS), bare)
        letters = count(_ASCII_LETTERS)
        self.upper = _share(count(_UPPER), letters)
        self.letters = _share(letters + count(_ABOVE_ASCII), bare)
        self.shouts = _share(data.count(b"!"), self.words)
        self.top_word = _share(Counter(words).most_common(1)[0][1], self.words) if words else 1.0
        self.pairs = _share(len(set(zip(words, words[1:]))), max(1, self.words - 1)) if words else 0.0
        self.word_length = _share(bare, self.words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        self.same_lines = 1 - _share(len(set(lines)), len(lines)) if lines else 0.0
        self.ends = _share(sum(data.count(c) for c in (b". ", b".\n", b"? ", b"! ")) + data.rstrip().endswith((b".", b"?", b"!")), self.words)


def _bad(value: bool) -> int:
    return -1 if value else 0


# Each votes 1 (good), -1 (bad) or 0 (no opinion). Most know one kind of junk and are silent about the rest.
LABELLERS: dict[str, Callable[[Seen], int]] = {
    "symbols": lambda s: _bad(s.symbols > 0.05),
    "upper_case": lambda s: _bad(s.upper > 0.5),
    "shouts": lambda s: _bad(s.shouts > 0.2),
    "one_word_again": lambda s: _bad(s.words >= 10 and s.top_word > 0.25),
    "pairs_again": lambda s: _bad(s.words >= 10 and s.pairs < 0.75),
    "few_letters": lambda s: _bad(s.letters < 0.7),
    "lines_again": lambda s: _bad(s.same_lines > 0.4),
    "odd_words": lambda s: _bad(not 2 <= s.word_length <= 25),
    "sentences": lambda s: 1 if s.ends >= 0.01 else 0,
}


def pattern_of(seen: Seen) -> int:
    """All votes on a text as one number, base 3."""
    number = 0
    for vote in LABELLERS.values():
        number = number * 3 + vote(seen) + 1
    return number


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """Votes (as 0, 1, 2) by pattern and labeller."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // powers % 3


class WeakLabels:
    """Accuracies of the labellers, by expectation-maximisation over the counts of vote patterns.

    Votes are taken as independent given the class; each labeller has a vote distribution per class.
    It starts from the votes against, which also say which class is the good one.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
        votes = votes_of(patterns)
        seen = np.eye(3)[votes]  # pattern, labeller, vote
        good = np.where((votes == 0).any(axis=1), 0.1, 0.9)
        for _ in range(rounds):
            weight = np.stack([counts * (1 - good), counts * good])  # class, pattern
            self.prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
            table = np.einsum("cp,plv->clv", weight, seen) + 0.1
            self.table = table / table.sum(axis=2, keepdims=True)
            again = self.posterior(patterns)
            done = np.abs(again - good).max(initial=0.0) < 1e-9
            good = again
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of the good class."""
        seen = np.eye(3)[votes_of(patterns)]
        log = np.log(self.prior)[:, None] + np.einsum("plv,clv->cp", seen, np.log(self.table))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per labeller: how often its votes are right, of those it gives; and how often it votes."""
        out = {}
        for i, name in enumerate(LABELLERS):
            right = self.prior[0] * self.table[0, i, 0] + self.prior[1] * self.table[1, i, 2]
            given = (self.prior[:, None] * self.table[:, i, [0, 2]]).sum()
            out[name] = (float(right / given), float(given))
        return out


_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def _token_buckets(word: str) -> tuple[int, int]:
    """Hash buckets of a word's shape and of its ending, both free of what the word means."""
    case = "X" if word.isupper() and len(word) > 1 else "x"
    shape = _RUNS[1].sub("9", _RUNS[0].sub(case, word))[:12]
    return zlib.crc32(f"s{shape}".encode()) % BUCKETS, zlib.crc32(f"e{word[-2:]}".encode()) % BUCKETS


def bucket_counts(text: str, known: dict[str, tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Hash buckets of a text's words and how many words fall into each; `known` keeps the buckets of words met before."""
    totals: Counter = Counter()
    for word, n in Counter(text.split()).items():
        found = known.get(word)
        if found is None:
            found = known[word] = _token_buckets(word)
        for bucket in found:
            totals[bucket] += n
    buckets = sorted(totals)
    return buckets, [totals[b] for b in buckets]


def features(buckets: list[int], counts: list[int], words: int, pairs: float) -> tuple[list[int], list[float]]:
    """Hashed features and their weights: buckets by their share of the words, and how repetitive the text is."""
    return [*buckets, BUCKETS], [*[n / max(1, words) for n in counts], REPEATED * (1 - pairs)]


class LinearScorer:
    """Logistic regression on hashed features, fitted to probabilities by full-batch gradient steps."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], target: np.ndarray, steps: int = 500):
        self.weight, self.bias = np.zeros(BUCKETS + 1), 0.0
        if not rows:
            return
        owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
        bucket = np.concatenate([np.array(b, dtype=np.int64) for b, _ in rows])
        value = np.concatenate([np.array(v) for _, v in rows])
        share = target.mean()
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        size = np.zeros(BUCKETS + 1)  # sum of squared gradients
        for _ in range(steps):
            score = np.bincount(owner, value * self.weight[bucket], len(rows)) + self.bias
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
            gradient = np.bincount(bucket, value * error[owner], BUCKETS + 1) / len(rows) + 1e-5 * self.weight
            size += gradient**2
            self.weight -= 0.5 * gradient / (np.sqrt(size) + 1e-8)
            self.bias -= 0.5 * float(error.mean())

SEEN = "mark bigint, empty boolean, pattern int, words bigint, pairs double, bucket array<int>, n array<int>"


def look(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A written table of what fitting and scoring need of each row, so that texts are read once: keep columns k0, k1, ...,
    a hash of id and text, the vote pattern, and bucket counts."""

    def work():
        known: dict[str, tuple[int, int]] = {}

        def batch(texts: list) -> dict[str, list]:
            if len(known) > 100_000:
                known.clear()
            out: dict[str, list] = {c: [] for c in ("empty", "pattern", "words", "pairs", "bucket", "n")}
            for t in texts:
                seen, (bucket, n) = Seen(t or ""), bucket_counts(t or "", known)
                # Words as the labellers part them differ from those that are hashed for a few control characters.
                made = (t is None, pattern_of(seen), len((t or "").split()), seen.pairs, bucket, n)
                for column, value in zip(out.values(), made):
                    column.append(value)
            return out

        return batch

    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*named, "text", F.xxhash64("doc_id", "text").alias("mark"))
    kept = tuple(f"k{i}" for i in range(len(keep)))
    types = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in kept)
    return stable(map_texts(rows, types + SEEN, work, (*kept, "mark")))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[WeakLabels, LinearScorer]:
    """Labeller accuracies from the votes on all documents, and a scorer from a sample's posteriors."""
    return fit_seen(look(docs), sample)


def fit_seen(seen: DataFrame, sample: int) -> tuple[WeakLabels, LinearScorer]:
    """See `fit`; from the table of `look`.

    The sample is the `sample` rows, of those with a text, with the smallest hashes (see `spread_marks`). At most
    3 ** labellers pattern counts and the sample's bucket counts reach the driver.
    """
    counts = sorted(tuple(r) for r in seen.groupBy("pattern").count().collect())
    patterns = np.array([p for p, _ in counts], dtype=np.int64)
    labels = WeakLabels(patterns, np.array([n for _, n in counts], dtype=float))

    texts = seen.where(~F.col("empty"))
    marked = stable(keyed(texts, mark="mark"))
    # Twice the share is sure to hold the smallest ones, and keeps the rows that are sorted in one place few.
    share = min(1.0, 2 * sample / max(1, marked.count()))
    place = F.pmod(F.xxhash64("mark"), F.lit(1 << 32))
    least = spread_marks(marked).withColumn("place", place).where(F.col("place") < int(share * (1 << 32)))
    chosen = stable(least.orderBy("place", "row").limit(sample).select("row"))
    drawn = keyed(texts, pattern="pattern", words="words", pairs="pairs", bucket="bucket", n="n").join(chosen, "row", "left_semi")
    rows = sorted(tuple(r) for r in drawn.select("bucket", "n", "words", "pairs", "pattern").collect())
    target = labels.posterior(np.array([r[-1] for r in rows], dtype=np.int64).reshape(-1))
    return labels, LinearScorer([features(*r[:4]) for r in rows], target)


def classify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE_DOCS) -> DataFrame:
    """keep columns, weak_label (posterior of the votes), quality (the scorer's probability) and kept, per row.

    Null text counts as empty and is never kept, nor is a text without words. Repeated rows and null ids
    are judged like others, rows that tie in the sample's order go by their place; extra columns are left out. Very long
    texts are read whole, by one task each. With no documents the result is empty.
    """
    prepare(docs.sparkSession)
    seen = look(docs, keep)
    labels, scorer = fit_seen(seen, sample)
    patterns = [r[0] for r in seen.select("pattern").distinct().collect()]
    weak = dict(zip(patterns, labels.posterior(np.array(patterns, dtype=np.int64).reshape(-1)).tolist()))
    # Plain values only: workers know no class of this library.
    shared = seen.sparkSession.sparkContext.broadcast((weak, scorer.weight, scorer.bias))
    kept = [f"k{i}" for i in range(len(keep))]
    types = "".join(f"{k} {seen.schema[k].dataType.simpleString()}, " for k in kept)
    fields = StructType.fromDDL(types + "weak_label double, quality double, kept boolean")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, weight, bias = shared.value
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            words, lists = column("words"), batch.column("bucket")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            value = batch.column("n").flatten().to_numpy() / np.maximum(words, 1)[owner]
            score = np.bincount(owner, value * weight[lists.flatten().to_numpy()], len(lists))
            score += weight[BUCKETS] * REPEATED * (1 - column("pairs")) + bias
            quality = np.where(words > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0)
            yield pa.RecordBatch.from_pydict({
                **{k: batch.column(k) for k in kept}, "weak_label": [weak[p] for p in column("pattern").tolist()],
                "quality": quality, "kept": (words > 0) & (quality >= KEEP),
            }, schema=out)

    judged = seen.select(*kept, "pattern", "words", "pairs", "bucket", "n").mapInArrow(judge, fields)
    return judged.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "weak_label", "quality", "kept")
