"""The source mix against brute-force targets, on the driver's tables and on made sources; the pipeline on the same tables."""

from collections import Counter

import pytest

import corpus_pipeline
import fixtures
import oracle
from perilframe.llm import mixing

# Sizes of documents as SQL; targets follow from them.
SIZES = "SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents"


def close(taken: Counter, aim: dict, block: float):
    for s, t in aim.items():
        assert abs(taken[s] - t) <= max(1.0, min(block, t / mixing.FINE * 2)), (s, taken[s], t)


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_targets_on_the_tables(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    sizes = oracle.connect(folder).execute(SIZES).fetchall()
    whole = Counter()
    for _, source, size in sizes:
        whole[source] += size
    aim, source_of = fixtures.targets(whole), {d: s for d, s, _ in sizes}
    got = mixing.mixture(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n) for d, _, n in sizes)
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == whole[s] and r["target"] == pytest.approx(aim[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    close(taken, aim, mixing.BLOCK)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(whole.values()), rel=0.001)


@pytest.mark.parametrize("sources, words", [(3, 100), (4, 90), (20, 55), (2000, 6)])
def test_small_and_many_sources(spark, sources, words):
    made = [(i, " ".join("w" * (words if i % 7 else words - 3)), f"s{i:04}") for i in range(sources)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    aim = fixtures.targets({s: len(t.split()) for _, t, s in made})
    for r in got:
        assert r["target"] == pytest.approx(aim[r["source"]])
        assert abs(r["taken"] - aim[r["source"]]) <= 1 and r["taken"] <= 2 * r["size"]


def test_whole_documents_fill_the_place_of_a_long_one(spark):
    """Without the fill, a shard whose first document does not fit would give nothing or far too much."""
    made = [(i, " ".join("w" * 10), f"s{i % 4}") for i in range(400)] + [(1000 + k, " ".join("w" * 900), f"s{k}") for k in range(4)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    aim = {r["source"]: r["target"] for r in mixing.mix(df).select("source", "target").distinct().collect()}
    words, times = Counter(), Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r["source"]] += len(r["text"].split())
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    for s, t in aim.items():
        assert abs(words[s] - t) <= mixing.BLOCK + 5, (s, words[s], t)


def test_pipeline_on_the_tables(spark, sf):
    made = corpus_pipeline.run(spark, sf)
    rows = made.collect()
    assert len(rows) > 100
    per = Counter()
    for r in rows:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= corpus_pipeline.CAPACITY
    assert len(per) <= 1.02 * -(-sum(per.values()) // corpus_pipeline.CAPACITY) + 1
