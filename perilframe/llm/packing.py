"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stable
from .common import map_texts, prepare
from .token_counts import UnitTable

# Fixed value: the vocabulary's one special string and its id, as its description states them.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256

SALTS = 64


class Encoder:
    """Ids of whole texts. Units of text unknown to the task are encoded together, once per batch."""

    LONG = 1000

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID}
        )
        self.units = UnitTable([END_OF_TEXT])
        self.reset()

    def reset(self) -> None:
        """Unit i has ids flat[starts[i]:starts[i + 1]]."""
        self.units.clear()
        self.flat, self.starts = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has. The special id parts them in one call.

        Long units are split into pre-tokens here, as the encoder's own splitting gives up on them.
        """
        short = [u if len(u) <= self.LONG else "" for u in new]
        ids = self.encoding.encode_to_numpy(END_OF_TEXT.join(short), allowed_special="all")
        marks = np.flatnonzero(ids == END_OF_TEXT_ID)
        sizes = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
        ids = ids[ids != END_OF_TEXT_ID]
        if max(map(len, new), default=0) > self.LONG:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, unit in enumerate(new):
                if len(unit) > self.LONG:
                    pieces = map(str.encode, self.units.pre_tokens.split(unit))
                    parts[i] = np.array([x for p in pieces for x in self.encoding._core_bpe.encode_single_piece(p)], "<u4")
            ids, sizes = np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts])
        return ids, sizes

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) > self.units.limit:
            self.reset()
        found, per_text = self.units.numbers(texts)
        if new := self.units.since(len(self.starts) - 1):
            ids, sizes = self._encode(new)
            self.flat = np.concatenate((self.flat, ids))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        special = found < 0
        first = np.where(special, len(self.flat), self.starts[found])
        sizes = np.where(special, 1, self.starts[found + 1] - self.starts[found])
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        ids = np.append(self.flat, np.uint32(END_OF_TEXT_ID))[at]
        return np.split(ids, np.append(0, ends)[np.cumsum(per_text)[:-1]]) if texts else []


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be shorter than capacity."""
    n, start, piece = len(ids), 0, 0
    view = memoryview(ids.astype("<u4", copy=False).tobytes())
    while start < n:
        length = capacity if start else (n % capacity or min(n, capacity))
        yield piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])
        start, piece = start + length, piece + 1


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first_rank, documents, first_sequence, per_sequence, used) that place every document.

    Best fit over range-sorted documents and gaps, one bulk step per length from the longest down. In a step the
    documents of one length sweep the gaps from the smallest that can hold them: the sequences of a gap class
    take as many documents each as fit, in rank order, until the documents run out; what is left opens new
    sequences. The gaps are then updated and the next shorter length follows. As equal documents are
    interchangeable this is best-fit decreasing, with one sequence after another, done for whole classes.

    State is counts per length and ranges of sequences with equal gap. A range that takes part halves its gap
    at least, a length opens two ranges and splits one, so the plan has at most about
    5 * capacity * log2(capacity) rows however many documents there are.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, sequences)
    order: list[int] = []  # the gaps, ascending
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(order, length)) < len(order):
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = gap // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - gap))
                rank, left = rank + full * per, left - full * per
                put(gap - per * length, first, full)
            if full < n and left:
                plan.append((length, rank, left, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, n - full)
        per = capacity // length
        if full := left // per:
            plan.append((length, rank, full * per, opened, per, 0))
            put(capacity - per * length, opened, full)
            rank, left, opened = rank + full * per, left - full * per, opened + full
        if left:
            plan.append((length, rank, left, opened, left, 0))
            put(capacity - left * length, opened, 1)
            opened += 1
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int, ids: tuple[str, ...]) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with a `length` of 1 to capacity.

    `ids` tell pieces apart; pieces that agree in all of them are interchangeable. Documents get their rank among
    those of their length within salted groups, so a length that a third of all pieces share is ranked by many
    tasks. Only piece counts by (length, salt) reach the driver: at most capacity * SALTS rows.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "_salt").count().collect()
    counts: dict[int, int] = {}
    first_rank = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    for length, salt, n in sorted(groups):
        first_rank[length, salt] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    shared = spark.sparkContext.broadcast((first_rank, best_fit_plan(counts, capacity)))

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*ids)) - 1)
    fields = ranked.drop("_salt", "_rank").schema.add("sequence_id", "long").add("offset", "long")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_rank, plan = shared.value
        width = int(plan[:, 1].max(initial=0)) + 1
        starts = plan[:, 0] * width + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            salt = batch.column("_salt").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) + first_rank[length, salt]
            # A length has few plan rows, so ranks beyond the last row's start still belong to it.
            row = plan[np.searchsorted(starts, length * width + np.minimum(rank, width - 1), side="right") - 1]
            step = rank - row[:, 1]
            made = {c: batch.column(c) for c in fields.names[:-2]}
            made["sequence_id"] = row[:, 3] + step // row[:, 4]
            made["offset"] = row[:, 5] + step % row[:, 4] * length
            yield pa.RecordBatch.from_pydict(made, schema=out)

    return ranked.mapInArrow(place, fields)


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's ids packed into sequences.

    A document is its text's ids and id 0 at the end; null text is empty, so it is id 0 alone. Documents longer
    than `capacity` are cut into pieces of that length, the first may be shorter. Repeated rows are packed as
    often as they occur; ties of length go by a hash of the id and then the id; null ids are
    packed like others. An empty table gives no rows. Extra columns are left out.

    Texts are tokenized once, into a written table of pieces; texts and ids never move between tasks.
    """
    prepare(docs.sparkSession)

    def work():
        encoder, end = Encoder(ranks_path), np.zeros(1, dtype=np.uint32)

        def batch(texts: list) -> dict[str, list]:
            return {"pieces": [
                [dict(zip(("piece", "start", "length", "ids_crc32"), p)) for p in cut(np.append(ids, end), capacity)]
                for ids in encoder.batch([t or "" for t in texts])
            ]}

        return batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    piece = "struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
    cut_up = map_texts(docs, f"doc_id {kind}, pieces array<{piece}>", work)
    pieces = stable(cut_up.select("doc_id", F.inline("pieces")))
    return pack(pieces, capacity, ("doc_id", "piece"))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: tokens used and its pieces in order; a sequence has at most `capacity` pieces."""
    place = F.struct("offset", "length", "doc_id", "piece", "start")
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("used"), F.array_sort(F.collect_list(place)).alias("pieces")
    )
