import inspect

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pagewright.llm import quality, tiling, toxicity
from pagewright.session import BATCH_BYTES
from tests.llm.test_ngram_join import brute

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "decontamination", "pieces"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


def test_pipeline_equals_its_decisions_one_by_one(spark):
    """Each stage against the decisions of its operator or brute force on the stage's own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, quality.learn(docs, labels)).collect() if r.predicted}
    left = docs.where(docs.doc_id.isin(*good))
    clean = {r.doc_id for r in toxicity.score(left, toxicity.learn(left, labels)).collect() if not r.toxic}
    ids = sorted(clean)
    _, _, classes = brute([texts[i] for i in ids])
    distinct = {ids[c] for c in set(classes)}
    rest = docs.where(docs.doc_id.isin(*distinct))
    final = {r.doc_id for r in tiling.contamination(rest, benchmark).collect() if not r.contaminated}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == final and len(rows) == len(final)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert 0 < len(final) < len(distinct) <= len(clean) < len(good) < len(texts)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents([None, "", "a b c", "a b c", "w " * 30_000], [None, 1, 2, 2, 3])
    out = stage(spark, docs, SF_DIR)
    assert out.columns == (docs.columns if name != "pieces" else ["doc_id", "ids", "n_tokens", "round_trip"])
    assert 1 <= out.count() <= 5
    assert stage(spark, documents([]), SF_DIR).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_workers_get_small_batches(spark, monkeypatch, name):
    """Whatever the rows of a partition: 12 MB of texts in one task reach its worker about a megabyte at a time."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "concat(id % 7, repeat(' lorem ipsum dolor', 110)) AS text")
    plain, most, mapped = type(docs).mapInArrow, 2 * BATCH_BYTES, []

    def watched(frame, run, schema):
        def small(batches):
            for batch in batches:
                assert batch.num_rows == 1 or batch.nbytes <= most, f"{batch.nbytes} bytes in a batch"
                yield batch

        mapped.append(schema)
        return plain(frame, lambda batches: run(small(batches)), schema)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR).count() <= 6000
    assert mapped


def test_batch_size_of_the_session_is_kept(spark, documents):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "3m")
    try:
        assert quality.score(documents(["a b"]), None).count() == 1
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key)
