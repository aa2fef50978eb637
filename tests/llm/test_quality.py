import random

import numpy as np
import pyarrow as pa

from pagewright.llm import quality

random.seed(5)
WORDS = [a + b + c for a in "bdkmst" for b in "aeio" for c in ("n", "r", "sh", "t")]


def prose(n=80):
    return " ".join(random.choice(WORDS) + random.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def junk(n=80):
    return " ".join(random.choice(WORDS).upper() + random.choice(["!!", "***", "$$$"]) for _ in range(n))


def labels(spark, good, bad=()):
    return spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad], "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart_without_negatives(spark, documents):
    docs = documents([prose() if i % 5 else junk() for i in range(400)])
    model = quality.learn(docs, labels(spark, [i for i in range(0, 400, 1) if i % 5 and i % 2]))
    assert 0.6 < model.prior < 0.95
    rows = quality.score(docs, model).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert 60 < len(held) < 140
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    docs = documents([prose() if i % 5 else junk() for i in range(120)])
    held = {r.doc_id for r in docs.select("doc_id", quality.held_out().alias("h")).collect() if r.h}
    good = [i for i in range(120) if i % 5 and i not in held]
    one = quality.learn(docs, labels(spark, good))
    two = quality.learn(docs, labels(spark, good + sorted(held)))
    assert np.allclose(one.weights, two.weights)


def test_empty_null_and_long_texts(spark, documents):
    docs = documents([None, "", " \n", "x" * 200_000, prose(), prose(), junk()], [None, 1, 2, 3, 4, 4, 5])
    assert quality.learn(docs, labels(spark, [])) is None
    rows = quality.score(docs, None).collect()
    assert [r.score for r in rows] == [0.5] * 7 and quality.keep_good(docs, None).count() == 7
    model = quality.learn(docs, labels(spark, [4]))
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert rows[1].score == rows[2].score == rows[None].score and rows[None].held_out is False
    assert quality.score(documents([]), model).collect() == []


def test_filter_keeps_columns_and_decisions(spark, documents):
    docs = documents([prose() if i % 5 else junk() for i in range(100)])
    model = quality.learn(docs, labels(spark, [i for i in range(100) if i % 5]))
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good


def test_prior_from_tails():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(quality.estimate_prior(positive, mixed) - 0.7) < 0.05


def test_features_do_not_depend_on_the_batch():
    texts = [prose(), "", junk(), None, prose(3)]
    together = quality.features(pa.array(texts))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)


def test_the_layout_of_files_and_repeated_ids_do_not_matter(spark, documents):
    texts = [prose() if i % 5 else junk() for i in range(300)]
    docs, known = documents(texts), labels(spark, [i for i in range(0, 300) if i % 5 and i % 2])

    def scores(frame):
        return sorted((r.doc_id, r.score) for r in quality.score(docs, quality.learn(frame, known)).collect())

    once = scores(docs)
    assert once == scores(docs.repartition(7, "text")) == scores(docs.orderBy("text").coalesce(1))
    # An id that half of all rows share counts once.
    many = docs.unionByName(documents([texts[1]] * 300, [1] * 300))
    assert scores(many) == once


def test_a_sample_has_one_row_for_each_id(spark, documents):
    from pagewright.llm import hashing

    docs = documents(["a", "b", None, "a", "c"], [1, 1, 1, 2, None])
    rows = hashing.one_text_each(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2]
