"""Language of whole texts by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_texts, plain_names, prepare, restore

# Bounds of the sample that a model is learned from: languages (those with most labelled documents), and per language.
SAMPLE_LANGUAGES = 256
SAMPLE_DOCS = 120
SAMPLE_CHARS = 500  # of each sampled document, in pieces from all over its text
PIECES = 5

LONG_WORD = 64  # characters; longer words are not kept
PART = 256  # letters that are parsed in one go

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
LEAST_PHRASE = 1.5  # letters; texts in no known script fall apart into single letters


def plain_words(text: str) -> list[str]:
    """Lower-case words of letters, each with a space before and after it."""
    return [f" {w} " for w in NOT_LETTERS.sub(" ", text.lower()).split()]


def parts_of(word: str) -> list[str]:
    """A word in parts of at most PART characters."""
    return [word[i : i + PART] for i in range(0, len(word), PART)]


class SuffixAutomaton:
    """The substrings of a text, as sorted transitions (state, numbered letter) -> state; state 1 is the start.

    There are at most three transitions a character, however many letters the languages have together.
    """

    def __init__(self, text: str, letters: dict[str, int]):
        follow: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for code in map(letters.__getitem__, text):
            current = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p and code not in follow[p]:
                follow[p][code] = current
                p = link[p]
            if not p:
                link[current] = 1
            else:
                q = follow[p][code]
                if length[q] == length[p] + 1:
                    link[current] = q
                else:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[current] = copy
                    while p and follow[p].get(code) == q:
                        follow[p][code] = copy
                        p = link[p]
            last = current
        width = len(letters) + 1
        edges = sorted((state * width + code, to) for state, ways in enumerate(follow) for code, to in ways.items())
        self._set(np.array([k for k, _ in edges], dtype=np.int64), np.array([to for _, to in edges], dtype=np.int32), width, len(follow))

    def _set(self, keys: np.ndarray, targets: np.ndarray, width: int, states: int) -> None:
        self.keys, self.targets, self.width, self.states = keys, targets, width, states
        # Where each state's transitions begin; most states have one, which needs no search.
        self.begin = np.searchsorted(keys, np.arange(states + 1, dtype=np.int64) * width).astype(np.int32)
        self.ways = np.diff(self.begin)
        self.first = np.append(keys % width, -1).astype(np.int32)
        self.leads = np.append(targets, 0).astype(np.int32)
        self.root = np.zeros(width, dtype=np.int64)
        here = slice(self.begin[1], self.begin[2])
        self.root[keys[here] % width] = targets[here]

    def plain(self) -> tuple:
        return self.keys, self.targets, self.width, self.states

    @classmethod
    def of(cls, plain: tuple) -> SuffixAutomaton:
        made = cls.__new__(cls)
        made._set(*plain)
        return made

    def next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states reached, 0 where there is no transition."""
        at, ways = self.begin[state], self.ways[state]
        hit = (self.first[at] == code) & (ways > 0)
        out = np.where(hit, self.leads[at], 0).astype(np.int64)
        more = np.flatnonzero(~hit & (ways > 1))
        if len(more):
            key = state[more] * self.width + code[more]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[more] = np.where(self.keys[place] == key, self.targets[place], 0)
        return out

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many longest matches each row of codes parses into; a letter without a match is a phrase."""
        state = np.ones(len(codes), dtype=np.int64)
        count = np.zeros(len(codes), dtype=np.int64)
        for at in range(codes.shape[1]):
            live = np.flatnonzero(lengths > at)
            if not len(live):
                break
            code = codes[live, at].astype(np.int64)
            after = self.next(state[live], code)
            broken = after == 0
            count[live] += broken & (state[live] != 1)
            again = self.root[code]
            state[live] = np.where(broken, np.where(again == 0, 1, again), after)
            # A letter unknown to the language is a phrase of its own, and the next one starts anew.
            count[live[broken & (again == 0)]] += 1
        return count + (state != 1)


class Languages:
    """Phrase counts of words under each language, kept per task for the words it has met."""

    def __init__(self, samples: dict[str, str], limit: int = 400_000):
        self.names = sorted(samples)
        alphabet = sorted(set("".join(samples.values())))
        self.letters = {c: i + 1 for i, c in enumerate(alphabet)}
        self.automata = [SuffixAutomaton(samples[n], self.letters) for n in self.names]
        self.scale = [max(1.0, np.log2(max(2, len(samples[n])))) for n in self.names]
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.table = np.zeros((0, len(self.names) + 1))

    def plain(self) -> tuple:
        """All that was learned in plain values, for workers that know no class of this library."""
        return self.names, self.letters, self.scale, self.limit, [a.plain() for a in self.automata]

    @classmethod
    def of(cls, plain: tuple) -> Languages:
        made = cls.__new__(cls)
        made.names, made.letters, made.scale, made.limit, tables = plain
        made.automata = [SuffixAutomaton.of(t) for t in tables]
        made._forget()
        return made

    def _measure(self, words: list[str]) -> np.ndarray:
        """Per word: normalised phrases under each language, and letters.

        Phrases are weighed by the bits that point to one of a sample's places, so that a longer sample does not
        win by its length.
        """
        rows = np.zeros((len(words), len(self.names) + 1))
        parts = [(i, p) for i, w in enumerate(words) for plain in plain_words(w) for p in parts_of(plain)]
        parts.sort(key=lambda x: len(x[1]))
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            lengths = np.array([len(p) for _, p in some])
            codes = np.zeros((len(some), int(lengths.max())), dtype=np.int32)
            get = self.letters.get
            for r, (_, p) in enumerate(some):
                codes[r, : len(p)] = [get(c, 0) for c in p]
            owner = np.array([i for i, _ in some])
            for k, automaton in enumerate(self.automata):
                np.add.at(rows[:, k], owner, automaton.phrases(codes, lengths) * self.scale[k])
            np.add.at(rows[:, -1], owner, [len(p) - p.count(" ") for _, p in some])
        return rows

    def batch(self, texts: list) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and letters per phrase, by text."""
        if len(self.words) > self.limit:
            self._forget()
        found, long_words, owners = [], [], []
        for i, text in enumerate(texts):
            # Words as white space parts them; very long ones are measured anew each time.
            split = (text or "").split()
            if len(max(split, key=len, default="")) > LONG_WORD:
                some = [w for w in split if len(w) > LONG_WORD]
                long_words += some
                owners += [i] * len(some)
                split = [w for w in split if len(w) <= LONG_WORD]
            number = self.words
            for w in set(split).difference(number):
                number[w] = len(number)
            found.append(np.fromiter(map(number.__getitem__, split), dtype=np.int64, count=len(split)))
        new = list(islice(self.words, len(self.table), None))
        if new:
            self.table = np.concatenate((self.table, self._measure(new)))
        totals = np.array([self.table[at].sum(axis=0) for at in found]).reshape(len(found), len(self.names) + 1)
        if long_words:
            np.add.at(totals, owners, self._measure(long_words))
        names, scores, lengths = [], [], []
        for total in totals:
            if not total[-1] or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                lengths.append(0.0)
                continue
            order = np.argsort(total[:-1], kind="stable")
            best = total[order[0]]
            names.append(self.names[order[0]])
            scores.append(float(1 - best / total[order[1]]) if len(order) > 1 else 1.0)
            lengths.append(float(total[-1] * self.scale[order[0]] / best))
        return names, scores, lengths


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_words(pieces: list[tuple[str, bool, bool]]) -> list[str]:
    """Words of pieces (text, cut at its start, cut at its end); a word that a cut goes through is left out, unless it is all
    there is, as in a script without spaces."""
    out = []
    for text, starts_cut, ends_cut in pieces:
        words = plain_words(text)
        first = 1 if starts_cut and words and not NOT_LETTERS.match(text) else 0
        last = len(words) - (1 if ends_cut and words and not NOT_LETTERS.match(text[-1]) else 0)
        out += words[first:last] if first < last else words
    return out


def learn(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars_each: int = SAMPLE_CHARS) -> dict[str, str]:
    """language -> sample of its labelled text, from at most docs_each documents and about chars_each characters of each.

    Held-out documents and null labels take no part. Documents come by a hash of their id; the rank limit is
    applied before rows are shuffled. A longer text gives pieces of equal length, each from a seeded place in its own
    part of the text. Of more than SAMPLE_LANGUAGES labels, those with most documents are learned.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    top = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(SAMPLE_LANGUAGES + 1).collect()
    if len(top) > SAMPLE_LANGUAGES:
        labelled = labelled.where(F.col("lang").isin([r["lang"] for r in top[:-1]]))
    size, each = F.char_length("text"), chars_each // PIECES
    pieces = []
    for i in range(PIECES):
        low, high = F.floor(size * i / PIECES), F.floor(size * (i + 1) / PIECES)
        at = (low + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), high - low - each))).cast("int")
        pieces.append(F.struct(F.substring("text", at + 1, F.lit(each)).alias("text"), (at > 0).alias("a"), (at + each < size).alias("b")))
    whole = F.array(F.struct(F.col("text"), F.lit(False).alias("a"), F.lit(False).alias("b")))
    sample = labelled.where(size > 0).select(
        "lang", "doc_id", F.when(size <= chars_each, whole).otherwise(F.array(*pieces)).alias("sample")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "sample")
    rows = sample.withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_each)
    texts: dict[str, list[str]] = {}
    for lang, drawn in sorted((r["lang"], [tuple(p) for p in r["sample"]]) for r in rows.select("lang", "sample").collect()):
        texts.setdefault(lang, []).extend(sample_words(drawn))
    return {lang: "".join(words) for lang, words in texts.items() if words}


def identify(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: dict[str, str] | None = None, text: str = "text"
) -> DataFrame:
    """keep columns, lang_pred, score (0 to 1) and phrase (letters) of every whole text, one row per input row.

    The language that parses the text's words into the fewest normalised phrases wins; the score is how much
    fewer than the next one's, the phrase length says how well it fits at all. A null text or one without letters is `und` with score 0, as is everything
    if there is no labelled text. Ties go to the first language by name. Labels, sources and ids are no inputs. Repeated
    rows are told alike, an empty table gives no rows, and very long texts and words are parsed whole, words of over PART
    characters part by part.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Languages(learn(docs) if model is None else model).plain())

    def work():
        languages = Languages.of(shared.value)

        def batch(texts: list) -> dict[str, list]:
            return dict(zip(("lang_pred", "score", "phrase"), languages.batch(texts)))

        return batch

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_texts(docs, f"{kept}, lang_pred string, score double, phrase double", work, keep, text)


def predictions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, least: float = LEAST_PHRASE) -> DataFrame:
    """The rows whose text has a language, with all columns of docs.

    Texts without letters go, and texts that even the best language parses into phrases shorter than `least`.
    """
    names = plain_names(docs)
    text = next(c for c, n in names.items() if n == "text")
    held = docs.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
    told = identify(held, tuple(names), learn(docs), text)
    return restore(told.where((F.col("lang_pred") != UNKNOWN) & (F.col("phrase") >= least)), names)
