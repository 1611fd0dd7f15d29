"""Token counts of whole texts under a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

# The pre-tokenizer's alternatives and white space, as the vocabulary was made with.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

BLOCK = 1_000_000


def _class_of(initial: str, top: int) -> str:
    """Ranges of the code points up to `top` whose Unicode category starts with `initial`, as a regex class body."""
    points = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] == initial]
    edges = np.flatnonzero(np.diff(points) > 1)
    first = np.concatenate(([0], edges + 1))
    last = np.concatenate((edges, [len(points) - 1]))
    return "".join(f"\\U{points[i]:08x}-\\U{points[j]:08x}" for i, j in zip(first, last))


ABOVE_16_BITS = re.compile("[\U00010000-\U0010ffff]")
CUT = re.compile(f" (?=[^{WHITE_SPACE}])")
NO_CUT = re.compile(f" (?![^{WHITE_SPACE}])")


class PreTokens:
    """The pre-tokenizer as patterns of the standard library, and cheaper units that it never cuts across.

    Letters are tried first, as no other alternative can start with one. Texts without characters above
    16 bits take a pattern with short classes; both split alike.
    """

    def __init__(self):
        self.narrow, self.wide = self._pattern(0xFFFF), None

    @staticmethod
    def _pattern(top: int) -> re.Pattern:
        letter, number = _class_of("L", top), _class_of("N", top)
        s = WHITE_SPACE
        return re.compile(
            f" ?[{letter}]+|{CONTRACTIONS}| ?[{number}]+| ?[^{s}{letter}{number}]+|[{s}]+(?![^{s}])|[{s}]+"
        )

    def split(self, text: str) -> list[str]:
        pattern = self.narrow
        if not text.isascii() and ABOVE_16_BITS.search(text):
            if self.wide is None:
                self.wide = self._pattern(sys.maxunicode)
            pattern = self.wide
        return pattern.findall(text)

    @staticmethod
    def units(text: str) -> Iterator[tuple[str, list[str]]]:
        """Blocks (head, tails): the text is head, then every tail with a space before it, block after block.

        A pre-token starts at every space that is followed by something else than white space, whatever
        stands before it, so head and spaced tails split into pre-tokens independently.
        """
        start = 0
        while start < len(text) or not start:
            cut = CUT.search(text, start + BLOCK) if len(text) - start > BLOCK else None
            end = cut.start() if cut else len(text)
            block = text[start:end] if start or cut else text
            start = end or 1
            parts = block.split(" ")
            if NO_CUT.search(block):
                joined: list[list[str]] = [[parts[0]]]
                for part in parts[1:]:
                    if not part or WHITE.match(part):
                        joined[-1].append(part)
                    else:
                        joined.append([part])
                parts = [" ".join(p) for p in joined]
            yield parts[0], parts[1:]


WHITE = re.compile(f"[{WHITE_SPACE}]")


class UnitTable(dict):
    """Numbers for the units of texts: tails by themselves, heads as 1-tuples. An unknown unit gets the next number.

    A task keeps one table, so a unit is tokenized once; past `limit` units it starts anew between batches.
    """

    def __init__(self, special: list[str], limit: int = 500_000):
        super().__init__()
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.limit, self.pre_tokens = limit, PreTokens()

    def __missing__(self, unit) -> int:
        number = self[unit] = len(self)
        return number

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts in order, a special string as -1; and how many each text has."""
        found, sizes = [], []
        for text in texts:
            before = len(found)
            for i, part in enumerate(self.special.split(text) if self.special else [text]):
                if i:
                    found.append(np.array([-1], dtype=np.int32))
                for head, tails in self.pre_tokens.units(part):
                    found.append(np.array([self[(head,)]], dtype=np.int32))
                    found.append(np.fromiter(map(self.__getitem__, tails), dtype=np.int32, count=len(tails)))
            sizes.append(sum(map(len, found[before:])))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def since(self, number: int) -> list[str]:
        """The units numbered from `number` on, as text."""
        return [u[0] if type(u) is tuple else " " + u for u in islice(self, number, None)]


class RankMerger:
    """Rank-synchronous merging of many byte sequences held as one ragged array.

    In every round each sequence merges all places of its lowest-rank pair at the same time, from left to
    right; a sequence without a mergeable pair is finished. Pair ranks are looked up in the sorted merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        shown = self._shown_bytes()
        self.byte_symbol = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made
        self.none = len(pairs)

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The printable character that stands for each byte in the vocabulary file."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        kept = set(plain)
        return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.byte_symbol[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        result = sizes.copy()
        inner = owner[1:] == owner[:-1]
        ranks = np.full(len(symbols), self.none, dtype=np.int64)  # of the pair that starts here
        at = np.flatnonzero(inner)
        ranks[at] = self._ranks(symbols[at], symbols[at + 1])
        while len(symbols):
            starts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
            best = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            live = best < self.none
            result[owner[starts[~live]]] = lengths[~live]
            if not live.any():
                break
            keep = np.repeat(live, lengths)
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            target = np.repeat(best[live], lengths[live])
            hit = np.flatnonzero(ranks == target)
            # Runs of overlapping hits (a a a): every second one merges, from the left.
            new_run = np.concatenate(([True], np.diff(hit) > 1))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hit + 1] = False
            merged = np.zeros(len(symbols), dtype=bool)
            merged[hit] = True
            symbols, owner, ranks, merged = symbols[stay], owner[stay], ranks[stay], merged[stay]
            same = np.append(owner[1:] == owner[:-1], False)
            touched = merged.copy()
            touched[:-1] |= merged[1:]
            ranks[touched] = self.none
            at = np.flatnonzero(touched & same)
            ranks[at] = self._ranks(symbols[at], symbols[at + 1])
        return result


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes, n_tokens and over_limit of every whole text, one row per input row.

    A null text counts as empty (0 bytes, 0 tokens). The vocabulary's special strings inside a text count as
    one token each. Repeated rows, ties, null ids and extra columns do not matter: every row is counted alone.
    Long texts are taken block by block; nothing is truncated. An empty table gives no rows.
    """

    def work():
        merger = RankMerger(tokenizer_path)
        units = UnitTable(merger.special)
        sizes = np.zeros(0, dtype=np.int64)  # tokens by unit

        def merged(new: list[str]) -> np.ndarray:
            words = [units.pre_tokens.split(u) for u in new]
            number = {w: i for i, w in enumerate({w for ws in words for w in ws})}
            counts = merger.count([w.encode() for w in number])
            flat = np.append(0, np.cumsum(counts[np.fromiter((number[w] for ws in words for w in ws), dtype=np.int64)]))
            return np.diff(flat[np.append(0, np.cumsum([len(ws) for ws in words], dtype=np.int64))])

        def batch(texts: list) -> dict[str, list]:
            nonlocal sizes
            texts = [t or "" for t in texts]
            if len(units) > units.limit:
                units.clear()
                sizes = sizes[:0]
            found, per_text = units.numbers(texts)
            sizes = np.append(sizes, merged(units.since(len(sizes))))
            tokens = np.append(0, np.cumsum(np.where(found < 0, 1, sizes[found])))
            ends = np.cumsum(per_text)
            n_tokens = tokens[ends] - tokens[ends - per_text]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n_tokens, "over_limit": n_tokens > limit}

        return batch

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_texts(docs, f"{fields}, n_bytes long, n_tokens long, over_limit boolean", work, keep)
