"""Copies, near copies, mixing, packing, vectors and the pipeline against plain-Python answers."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers_files
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import fixtures
from perilframe.llm import common, embed_dedup, exact_dedup, langid, mixing, packing, simhash
from perilframe.llm.common import components, prepare

RANKS = tokenizers_files.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return fixtures.frame(spark, rows).coalesce(1)


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_exact_copies(docs, rows):
    told, stays = fixtures.exact_classes(rows)
    df = exact_dedup.exact_copies(docs)
    assert python_free(df)
    want = Counter((rows[i][0], keep, n, i in stays, sha) for i, (keep, n, sha) in told.items())
    assert fixtures.counted(df.collect()) == want
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_drop_copies_keeps_one_of_each(docs, rows):
    _, stays = fixtures.exact_classes(rows)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert fixtures.counted(left.collect()) == fixtures.counted(rows[i] for i in stays)
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("derive", ["explode", "join", "twice"])
def test_rows_of_derived_frames_are_told_apart(spark, tmp_path, derive):
    """Explodes and joins hand on the file's row number, once per row made of it."""
    one, two, three = (fixtures.words(i, 40, base) for i, base in enumerate((fixtures.ENGLISH, fixtures.FRENCH, fixtures.GERMAN)))
    lines = [(1, [one, two], "a"), (2, [two, three], "a"), (3, [two, one], "b")]
    spark.createDataFrame(lines, "doc_id long, lines array<string>, source string").coalesce(1).write.parquet(f"{tmp_path}/lines")
    table = spark.read.parquet(f"{tmp_path}/lines")
    if derive == "explode":
        docs = table.select("doc_id", "source", F.explode("lines").alias("text"))
    elif derive == "join":
        at = spark.createDataFrame([(0,), (1,)], "at int")
        docs = table.join(at, at["at"] < F.size("lines")).select("doc_id", "source", F.col("lines")[F.col("at")].alias("text"))
    else:
        ends = [table.select("doc_id", "source", F.col("lines")[i].alias("text")) for i in (0, 1)]
        docs = ends[0].unionByName(ends[1])
    assert {r["text"] for r in exact_dedup.drop_copies(docs).collect()} == {one, two, three}
    assert exact_dedup.drop_copies(docs).count() == 3
    prints = [fixtures.fingerprint(r["text"]) for r in docs.collect()]
    assert simhash.drop_near_duplicates(docs).count() == len(set(fixtures.near_groups(prints, 4)))
    assert mixing.mix(docs).select("row").distinct().count() == 6
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.mixed_documents(docs).collect())
    whole = {(r["doc_id"], r["source"], r["text"]) for r in docs.collect()}
    assert set(got) <= whole and max(got.values()) <= 2


def test_plain_scans_are_not_written(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(f"{tmp_path}/plain")
    table = spark.read.parquet(f"{tmp_path}/plain")
    monkeypatch.setattr(common, "stable", lambda df: None)
    assert common.filed(table) is table and common.filed(table.where("id > 1").select("id")) is not None
    assert common.filed(table.select("id", F.explode(F.array(F.lit(1), F.lit(2))))) is None
    assert common.filed(spark.read.parquet(f"{tmp_path}/plain", f"{tmp_path}/plain")) is None
    assert common.filed(table.where(F.rand() < 0.5)) is None


def test_colliding_hashes_are_told_apart(docs, rows, monkeypatch):
    """With a hash of two bits nearly every group mixes different texts."""
    monkeypatch.setattr(exact_dedup, "_hash", lambda sha: F.unhex(F.translate(F.substring(sha, 1, 1), "0123456789abcdef", "0000111122223333")))
    told, stays = fixtures.exact_classes(rows)
    want = Counter((rows[i][0], keep, n, i in stays, sha) for i, (keep, n, sha) in told.items())
    assert fixtures.counted(exact_dedup.exact_copies(docs).collect()) == want


def test_fingerprints(rows):
    for r in rows:
        assert simhash.fingerprint(r[1] or "") % (1 << 64) == fixtures.fingerprint(r[1])
    assert simhash.fingerprint("One two\tTHREE É") % (1 << 64) == fixtures.fingerprint("one TWO three É")


def test_long_texts_are_fingerprinted_run_by_run():
    text = fixtures.words(3, 3000, fixtures.ENGLISH)
    data = text.encode()
    shingles = lambda runs: [tuple(r[i : i + 4]) for r in runs for i in range(len(r) - 3)]
    assert shingles(simhash._word_runs(data, 4, 64)) == shingles([data.split()])
    assert list(simhash._word_runs(b"", 4)) == [[]] and list(simhash._word_runs(b"a b", 4, 1))[-1] == [b"a", b"b"]


def test_near_duplicates(docs, rows):
    prints = [fixtures.fingerprint(r[1]) for r in rows]
    group = fixtures.near_groups(prints, 4)
    smallest = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            smallest[g] = min(smallest.get(g, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", smallest.get(g)) for r, p, g in zip(rows, prints, group))
    assert fixtures.counted(simhash.near_duplicates(docs).collect()) == want
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(set(group))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _clustered(n: int) -> list[int]:
    rng = random.Random(4)
    out = set()
    for _ in range(n // 20):
        centre = rng.getrandbits(64)
        for _ in range(20):
            x = centre
            for _ in range(rng.randrange(0, 9)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out) + [0, (1 << 64) - 1]


@pytest.mark.parametrize("most, dense", [(4, 2048), (4, 2), (3, 2), (1, 2048)])
def test_links_lose_nothing(spark, most, dense):
    """Also when most cells count as dense and are linked through the points halfway."""
    prints = sorted(set(_clustered(400)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    if dense == 2:
        prints, signed = prints[:60], signed[:60]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), most, dense).collect()
    number = {s: i for i, s in enumerate(signed)}
    assert all((prints[number[a]] ^ prints[number[b]]).bit_count() <= most for a, b in found)
    assert fixtures.reach(len(prints), [(number[a], number[b]) for a, b in found]) == fixtures.reach(
        len(prints), [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= most]
    )


def test_segment_counts_bound_the_distance(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long")
    bound = F.bit_count(simhash.segment_counts(F.col("a")).bitwiseXOR(simhash.segment_counts(F.col("b"))))
    for (a, b), (got,) in zip(pairs, df.select(bound).collect()):
        counts = lambda x: [(x >> i & 3).bit_count() for i in range(0, 64, 2)]
        assert got == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    want = fixtures.reach(500, edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: want[i] for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix(docs, rows):
    df = mixing.mixture(docs)
    assert python_free(df) and df.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    aim, taken = fixtures.targets(size), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(aim[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    for s in aim:
        assert abs(taken[s] - aim[s]) <= 2 * mixing.BLOCK, s
    assert fixtures.counted(mixing.mixture(docs).collect()) == fixtures.counted(df.collect())
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_mix_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 8)
    monkeypatch.setattr(mixing, "REGION_SHARDS", 4)
    made = [(i, fixtures.words(i, 40 + i % 50, fixtures.ENGLISH), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    taken, aim = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        aim[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in aim:
        assert abs(taken[s] - aim[s]) <= 0.02 * aim[s] + 2 * mixing.BLOCK


def test_null_and_repeated_ids_are_spread_over_marks(spark):
    texts = [fixtures.words(i, 20, fixtures.ENGLISH) for i in range(300)]
    made = [(None, t) for t in texts] + [(7, t) for t in texts] + [(None, "one text")] * 300 + [(8, "few")] * 5
    df = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    rows = common.stable(common.keyed(df, doc_id="doc_id", mark=F.xxhash64("doc_id", "text")))
    got = Counter(r["mark"] for r in common.spread_marks(rows).collect())
    assert sorted(got.values()) == [1] * 900 + [5]


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(3)
    made, want = [], {}
    for g in range(12):
        n, seats = rng.randrange(1, 9), rng.randrange(0, 60)
        weights = [float(rng.choice([0, 1, 3, 5, 50, 500])) for _ in range(n)]
        most = [1000] * n
        for i, q in enumerate(fixtures.sainte_lague(weights, seats, most)):
            want[g, i] = q
            made.append((g, i, weights[i], seats, most[i]))
    df = spark.createDataFrame(made, "g int, i int, w double, seats long, most long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "w", "seats", "most").collect()}
    assert got == want


def test_mixed_documents_keep_columns(docs):
    left = mixing.mixed_documents(docs)
    assert left.columns == docs.columns
    times = Counter(r["doc_id"] for r in left.collect() if r["doc_id"] != 170)
    assert max(times.values()) <= 2


def test_packing(docs, rows):
    library = Tokenizer.from_file(tokenizers_files.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(library.encode(r[1] or "", add_special_tokens=False).ids + [0])
    got = packing.pack_documents(docs, RANKS, 2048).collect()
    want = Counter()
    for d, several in ids.items():
        for x in several:
            first = len(x) % 2048 or min(2048, len(x))
            starts = [0, *range(first, len(x), 2048)]
            for p, s in enumerate(starts):
                part = x[s : first if p == 0 else s + 2048]
                want[d, p, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == fixtures.best_fit([r["length"] for r in got], 2048)
    assert packing.pack_documents(docs.limit(0), RANKS).count() == 0
    sequences = packing.packed_sequences(packing.pack_documents(docs, RANKS, 2048)).collect()
    assert sum(r["used"] for r in sequences) == sum(r["length"] for r in got)


def test_best_fit_plan_places_every_document_once():
    rng = random.Random(5)
    for capacity in (1, 7, 100, 2048):
        lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(1500)]
        counts = Counter(lengths)
        plan = packing.best_fit_plan(dict(counts), capacity)
        used, placed = Counter(), Counter()
        for length, rank, n, first, per, offset in plan.tolist():
            assert rank == placed[length]
            placed[length] += n
            for j in range(n):
                used[first + j // per] += length
        assert placed == counts and max(used.values()) <= capacity
        assert len(used) == fixtures.best_fit(lengths, capacity)
        assert len(plan) <= 5 * capacity * max(1, capacity.bit_length())


def brute_links(vectors, least):
    fine = {}
    for i, v in enumerate(vectors):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, dtype=float) / np.abs(v).max()  # squares of very large numbers overflow
            fine[i] = scaled / np.linalg.norm(scaled)
    return [(i, j) for i in fine for j in fine if j < i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= least]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    monkeypatch.setattr(embed_dedup, "TILE", 16)


def test_vectors(spark, small_blocks):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 3
    vectors = [(c + 0.25 * rng.normal(size=8)).tolist() for c in centres for _ in range(12)]
    vectors += [vectors[0]] * 40 + [[-x for x in vectors[0]], [0.0] * 8, [0.0] * 8, None, [], [1.0, None] + [0.0] * 6]
    vectors += [[float("nan")] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [x * 1e200 for x in vectors[5]], [-0.0, 1.0], [0.0, 1.0]]
    made = [(3 * i, v, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(4)
    links = brute_links(vectors, 0.9)
    degree, root = Counter(i for e in links for i in e), fixtures.reach(len(vectors), links)
    want = Counter((3 * i, degree[i], 3 * root[i], i == root[i]) for i in range(len(vectors)))
    want[None, 0, None, True] += 1
    assert fixtures.counted(embed_dedup.link_vectors(df).collect()) == want
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


def test_registered_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    root = fixtures.reach(len(x), zip(*np.nonzero(near)))
    ids = [r["vec_id"] for r in rows]
    want = Counter((ids[i], int(near[i].sum()) - 1, ids[root[i]], i == root[i]) for i in range(len(x)))
    assert fixtures.counted(embed_dedup.link_vectors(df).collect()) == want


def test_far_blocks_are_skipped(spark, small_blocks):
    """Four tight, well-parted bundles: blocks of different bundles are not compared."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.eye(4)[i] + 0.01 * rng.normal(size=(64, 4)) for i in range(4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    classes = embed_dedup._usable(df)
    eps = float(np.sqrt(0.2))
    blocks = embed_dedup._blocks(classes, embed_dedup._axes(classes, 4), eps)
    n = blocks.count()
    assert embed_dedup._near_blocks(blocks, eps).count() < n * (n + 1) / 2


def test_pipeline_stages(spark, docs, rows):
    """Each stage against the brute force on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "source_mix", "sequences"]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in frame.collect()]
        made = stage(spark, frame, None)
        if name == "language":
            told = langid.identify(frame).collect()
            gone = {r["doc_id"] for r in told if r["lang_pred"] == "und" or r["phrase"] < langid.LEAST_PHRASE}
            assert Counter(tuple(r) for r in made.collect()) == Counter(r for r in before if r[0] not in gone)
        elif name == "exact_copies":
            told, stays = fixtures.exact_classes(before)
            assert Counter(fixtures.bare(r["text"]) for r in made.collect()) == Counter(fixtures.bare(before[i][1]) for i in stays)
        elif name == "near_copies":
            assert made.count() == len(set(fixtures.near_groups([fixtures.fingerprint(r[1]) for r in before], 4)))
        elif name == "source_mix":
            size = Counter()
            for r in before:
                size[r[3]] += len(r[1].split())
            got = Counter()
            for r in made.collect():
                got[r["source"]] += len(r["text"].split())
            aim = fixtures.targets(size)
            longest = max(len(r[1].split()) for r in before)
            assert all(abs(got[s] - aim[s]) <= mixing.BLOCK + longest for s in aim)
        else:
            assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            pieces = [r["length"] for r in made.collect()]
            assert len({r["sequence_id"] for r in made.collect()}) == fixtures.best_fit(pieces, corpus_pipeline.CAPACITY)
        if name != "sequences":
            assert made.columns == frame.columns
            path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/stage-{name}"
            made.write.mode("overwrite").parquet(path)
            frame = spark.read.parquet(path)


def test_links_at_the_threshold(spark, small_blocks):
    """0/1 vectors with a cosine of exactly 9/10 link, whatever the other rows are; and so they do at any length."""
    rng = np.random.default_rng(12)
    made = []
    for i in range(200):
        a = np.zeros(64)
        on = rng.permutation(64)
        a[on[:10]] = 1
        b = a.copy()
        b[on[9]], b[on[10]] = 0, 1
        made += [(2 * i, a * (i + 1)), (2 * i + 1, b * 2.0**-100 if i % 2 else b)]
    others = [(10_000 + i, rng.normal(size=64)) for i in range(50)]
    rows = [(i, v.tolist()) for i, v in made + others]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(df).collect()}
        assert all(got[i] >= 1 for i, _ in made)
