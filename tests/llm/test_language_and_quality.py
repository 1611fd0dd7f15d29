"""Language and quality models against plain-Python forms of them, and in workers that don't have the package."""

import os
import subprocess
import sys
import textwrap
import zlib

import numpy as np
import pytest

import fixtures
from perilframe.llm import langid, quality

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MODEL = {"en": fixtures.ENGLISH, "fr": fixtures.FRENCH, "de": fixtures.GERMAN}


def cross_parse(text, sample):
    """Longest matches of each word of text against the sample, one after another."""
    sample, count = "".join(langid.plain_words(sample)), 0
    for word in (p for w in langid.plain_words(text) for p in langid.parts_of(w)):
        at = 0
        while at < len(word):
            n = 1
            while at + n < len(word) and word[at : at + n + 1] in sample:
                n += 1
            at, count = at + n, count + 1
    return count


def told(text, model):
    letters = sum(len(w) - 2 for w in langid.plain_words(text or ""))
    if not letters:
        return "und", 0.0
    cost = {lang: cross_parse(text, s) * np.log2(len("".join(langid.plain_words(s)))) for lang, s in model.items()}
    first, second = sorted(cost, key=lambda k: (cost[k], k))[:2]
    return first, 1 - cost[first] / cost[second]


def test_language_and_score(spark):
    texts = [fixtures.words(i, 3 + i, base) for i, base in enumerate([fixtures.ENGLISH, fixtures.FRENCH, fixtures.GERMAN] * 6)]
    texts += ["Zürich 2024, köln", "x", "haus", "la house die", "a" * 700, "the " * 3000 + "river", None, "", "12 34", "мир"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = {k: "".join(langid.plain_words(v)) for k, v in MODEL.items()}
    got = langid.identify(df, model=model).collect()
    for r in got:
        lang, score = told(texts[r["doc_id"]], MODEL)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score), texts[r["doc_id"]]


CHINESE = [chr(0x4E00 + k) for k in range(3000)]


def sentence(seed, n=30, letters=CHINESE):
    return "".join(letters[zlib.crc32(f"{seed}:{i}".encode()) % len(letters)] for i in range(n))


def test_unspaced_text_is_learned(spark):
    """Texts of one word each teach a language too, and one with thousands of letters costs no one much memory."""
    common = CHINESE[:60]
    rows = [(i, sentence(i, 40, common), "zh") for i in range(90)] + [(1000 + i, fixtures.words(i, 40, fixtures.ENGLISH), "en") for i in range(60)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    model = langid.Languages({"zh": "".join(sentence(i, 500) for i in range(120)), "en": fixtures.ENGLISH})
    names, letters, scale, limit, tables = model.plain()
    held = [langid.SuffixAutomaton.of(t) for t in tables]
    assert sum(v.nbytes for a in held for v in vars(a).values() if isinstance(v, np.ndarray)) < 50_000_000


def test_samples_come_from_the_whole_text(spark):
    head = "licence " * 200
    rows = [(i, head + fixtures.words(i, 400, fixtures.GERMAN), "de") for i in range(30)]
    rows += [(100 + i, head + fixtures.words(i, 400, fixtures.FRENCH), "fr") for i in range(30)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert " haus " in learned["de"] and " ville " in learned["fr"]
    assert all(len(v) <= 30 * (langid.SAMPLE_CHARS + 200) for v in learned.values())


def test_pieces_lose_only_cut_words():
    assert langid.sample_words([("lf a house is he", True, True)]) == [" a ", " house ", " is "]
    assert langid.sample_words([(" a house ", True, True)]) == [" a ", " house "]
    assert langid.sample_words([("onlyone", False, False), ("cutboth", True, True)]) == [" onlyone ", " cutboth "]


def plain_em(patterns, counts, rounds):
    """The same model, one labeller and pattern at a time."""
    votes = [[(p // 3 ** (len(quality.LABELLERS) - 1 - i)) % 3 for i in range(len(quality.LABELLERS))] for p in patterns]
    good = [0.1 if 0 in v else 0.9 for v in votes]
    for _ in range(rounds):
        prior, table = [], []
        for c in (0, 1):
            weight = [n * (g if c else 1 - g) for n, g in zip(counts, good)]
            prior.append((sum(weight) + 1) / (sum(counts) + 2))
            rows = []
            for i in range(len(quality.LABELLERS)):
                mass = [sum(w for w, v in zip(weight, votes) if v[i] == k) + 0.1 for k in range(3)]
                rows.append([m / sum(mass) for m in mass])
            table.append(rows)
        again = []
        for v in votes:
            like = [prior[c] * float(np.prod([table[c][i][k] for i, k in enumerate(v)])) for c in (0, 1)]
            again.append(like[1] / sum(like))
        if max(abs(a - b) for a, b in zip(again, good)) < 1e-9:
            return again
        good = again
    return good


def quality_rows():
    rows = [(i, fixtures.words(i, 60 + i, fixtures.ENGLISH).capitalize() + ".") for i in range(40)]
    rows += [(100 + i, fixtures.words(i, 30, fixtures.ENGLISH).upper() + "!! ###") for i in range(12)]
    rows += [(200 + i, "same same words " * 20) for i in range(8)] + [(300, None), (301, ""), (301, ""), (302, "x\x1cy z")]
    return rows


def test_weak_labels_and_scorer(spark):
    rows = quality_rows()
    seen = [quality.Seen(t or "") for _, t in rows]
    numbers = [quality.pattern_of(s) for s in seen]
    patterns = sorted(set(numbers))
    want = dict(zip(patterns, plain_em(patterns, [numbers.count(p) for p in patterns], quality.ROUNDS)))

    # The scorer, by steps over plain dictionaries.
    def row(text, s):
        words = (text or "").split()
        made = {}
        for w in words:
            for b in quality._token_buckets(w):
                made[b] = made.get(b, 0) + 1 / len(words)
        made[quality.BUCKETS] = quality.REPEATED * (1 - s.pairs)
        return made

    made = [row(t, s) for (_, t), s in zip(rows, seen)]
    used = [(m, want[p]) for m, p, (_, t) in zip(made, numbers, rows) if t is not None]
    share = sum(t for _, t in used) / len(used)
    weight, size, bias = {}, {}, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    names = {b for m, _ in used for b in m}
    for _ in range(500):
        errors = [sigmoid(sum(v * weight.get(b, 0.0) for b, v in m.items()) + bias) - t for m, t in used]
        grown = {b: 1e-5 * weight.get(b, 0.0) for b in names}
        for (m, _), e in zip(used, errors):
            for b, v in m.items():
                grown[b] += v * e / len(used)
        for b, g in grown.items():
            size[b] = size.get(b, 0.0) + g * g
            weight[b] = weight.get(b, 0.0) - 0.5 * g / (size[b] ** 0.5 + 1e-8)
        bias -= 0.5 * float(np.mean(errors))

    got = quality.classify(spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, pattern int, n string")).collect()
    told = sorted((r["doc_id"], r["weak_label"], r["quality"], r["kept"]) for r in got)
    expected = []
    for (d, t), p, m in zip(rows, numbers, made):
        score = sigmoid(sum(v * weight.get(b, 0.0) for b, v in m.items()) + bias) if (t or "").split() else 0.0
        expected.append((d, want[p], score, bool((t or "").split()) and score >= quality.KEEP))
    for a, b in zip(told, sorted(expected)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6) and a[2] == pytest.approx(b[2], abs=1e-4) and a[3] == b[3]


def test_very_long_texts(spark):
    text = fixtures.words(1, 60_000, fixtures.ENGLISH) + "b" * 100_000 + "."
    df = spark.createDataFrame([(1, text), (2, "the people by the river.")], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.identify(df, model=MODEL).collect()} == {"en"}
    assert quality.classify(df).count() == 2


def test_models_run_where_the_package_is_not_importable(tmp_path):
    """Workers get plain values: the job is started from another folder, and only the driver knows the package."""
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from perilframe.session import local_session
        from perilframe.llm import langid, quality
        spark = local_session("2", "far", **{{"spark.executorEnv.PYTHONPATH": ""}})
        docs = spark.createDataFrame([(i, "the house by the river", "en") for i in range(9)], "doc_id long, text string, lang string")
        assert langid.predictions(docs).count() == 9 and {{r["lang_pred"] for r in langid.predictions(docs).collect()}} == {{"en"}}
        assert len(quality.classify(docs).collect()) == 9
        print("fine")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
