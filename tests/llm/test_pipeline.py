"""The pipeline's stages against their rules, on the smallest tables."""

import collections

import pytest

import corpus_pipeline
from lakeassay.llm import decontaminate, jaccard_join, mixing, rule_ensemble

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        before = docs
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def ids(df):
    return [r[0] for r in df.select("doc_id").collect()]


def test_stages(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "token_ids"]
    for name, (before, after) in steps.items():
        assert name == "token_ids" or after.schema == before.schema
    before, after = steps["quality"]
    judged = rule_ensemble.classify_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(ids(after)) == sorted(r.doc_id for r in judged if r.predicted == 1)
    before, after = steps["near_duplicates"]
    members = jaccard_join.near_duplicates(before)[0].collect()
    assert sorted(ids(after)) == sorted({r.component_id for r in members})
    before, after = steps["decontamination"]
    leaks = {r.doc_id for r in decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(ids(after)) == sorted(set(ids(before)) - leaks)
    before, after = steps["mixture"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert collections.Counter(ids(after)) == {i: n for i, n in copies.items() if n}
    before, after = steps["token_ids"]
    assert sorted(ids(after)) == sorted(ids(before))


def test_run_gives_the_same(spark, steps):
    key = lambda r: (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, steps["token_ids"][1].collect()))


def test_documents_without_id_pass_the_filters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with_null = docs.limit(40).unionByName(docs.where("doc_id = 3").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    out = corpus_pipeline.near_duplicates(spark, with_null, SF)
    assert out.where("doc_id IS NULL").count() == 1


def test_mixture_of_rows_without_ids_or_with_shared_ones(spark):
    rows = [(None if k % 3 == 0 else k // 2, f"word{k} " * (k % 9 + 1), "en", "ab"[k % 2], 7, 1, 2) for k in range(200)]
    rows += [(5000, "same text here", "en", "a", 7, 1, 2)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies long, place long, turn long")
    out = corpus_pipeline.mixture(spark, docs, SF)
    assert out.columns == docs.columns
    got, want = collections.Counter(), collections.Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    assert got == want
    assert corpus_pipeline.mixture(spark, docs.where("doc_id < 0"), SF).count() == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    out = corpus_pipeline.near_duplicates(spark, docs.union(docs.limit(7)), SF)
    assert out.columns == docs.columns and max(collections.Counter(ids(out)).values()) == 1
