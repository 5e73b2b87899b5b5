"""Every stage of the pipeline against brute force, on the smallest tables and on odd rows."""

import hashlib
import random
import re

import brute
import corpus_pipeline
import pytest
from flowpanel.llm import quality_rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None), (None, "a b c", "en", "s", 5)], docs.schema)
    return docs.unionByName(extra).cache()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted(-1 if r[0] is None else r[0] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(spark, rows):
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, rows, SF)
        assert out.dtypes == rows.dtypes, name


def test_quality_stage(spark, rows):
    stats = quality_rules.statistics(rows)
    cuts = quality_rules.thresholds(stats, spark.read.parquet(f"{SF}/labels.parquet"))
    gone = {r["doc_id"] for r in quality_rules.apply_rules(stats, cuts).where("not kept").collect()} - {None}
    assert ids(stage("quality_rules")(spark, rows, SF)) == [d for d in ids(rows) if d not in gone]
    assert 10**6 in gone


def test_line_stage(spark, rows):
    data = [(r["doc_id"], r["text"]) for r in rows.collect() if r["doc_id"] is not None]
    gone = brute.line_keepers(data)
    got = {r["doc_id"]: r for r in stage("line_dedup")(spark, rows, SF).collect()}
    for d, t in data:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        if gone[d] and not re.search(brute.SPACE, kept):  # all its lines are kept elsewhere
            assert d not in got
            continue
        assert got[d]["text"] == kept
        assert not gone[d] or got[d]["n_chars"] == len(kept)


def test_duplicate_stage(spark, rows):
    data = sorted(((r["doc_id"], r["text"]) for r in rows.collect() if r["doc_id"] is not None), key=lambda x: x[0])
    root = brute.components([brute.shingles(t) for _, t in data])
    assert ids(stage("ngram_jaccard")(spark, rows, SF)) == sorted([-1] + [d for i, (d, _) in enumerate(data) if root[i] == i])


def test_benchmark_stage(spark, rows):
    items = [brute.shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in rows.collect():
        own = brute.shingles(r["text"])
        if not any(s and 100 * len(s & own) >= 80 * len(s) for s in items):
            want.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert ids(stage("decontaminate")(spark, rows, SF)) == sorted(want) and len(want) < rows.count()


def test_stages_take_empty_tables_and_long_texts(spark, rows):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    text = "\n".join(" ".join(rnd.choice(words) for _ in range(20)) for _ in range(20_000))  # 2.4 MB
    long = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short", "en", "s", 5)], rows.schema)
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, rows.limit(0), SF).count() == 0, name
        got = {r["doc_id"]: r["text"] for r in run(spark, long, SF).collect()}
        assert got[1] == text, name
    assert corpus_pipeline.encode(spark, rows.limit(0), SF).count() == 0
    found = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, long, SF).collect()}
    assert found[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert 0 < got.count() < rows.count() and got.where(F.col("n_tokens") == 0).count() == 0
