import random

import numpy as np
import pytest

from pagewright.llm import toxicity

random.seed(6)
WORDS = [a + b + c for a in "bdkmst" for b in "aeio" for c in ("n", "r", "sh", "t")]
BAD = ["vilest", "crudly", "nastyo", "foulix"]


def text(bad=0, n=60):
    return " ".join([random.choice(WORDS) for _ in range(n)] + random.sample(BAD, bad)).title()


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, text(i % 4 if i % 5 == 0 else 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(any(b in t.lower() for b in BAD))) for i, t in rows[:400]], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.learn(docs, labels), dict(rows)


def test_severity_grows_with_the_number_of_toxic_words(learned):
    docs, _, model, texts = learned
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 600
    by = {k: [r.severity for r in rows if sum(b in texts[r.doc_id].lower() for b in BAD) == k] for k in range(4)}
    assert np.mean(by[0]) < np.mean(by[1]) < np.mean(by[2]) <= np.mean(by[3]) <= 2
    assert all(r.toxic == any(b in texts[r.doc_id].lower() for b in BAD) for r in rows)
    assert all(0 <= r.chance <= 1 and r.chance <= r.severity + 1e-9 for r in rows)
    assert list(model.thresholds) == sorted(model.thresholds)


def test_a_clean_long_text_stays_and_one_word_suffices(learned, documents):
    _, _, model, _ = learned
    docs = documents([text(0, 20_000), text(1, 300), None, "", "a" * 100_000, "VILEST!"])
    assert [r.toxic for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [False, True, False, False, False, True]
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_without_labels_nothing_is_toxic(spark, documents):
    docs = documents(["vilest", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, none) is None
    assert [r.severity for r in toxicity.score(docs, None).collect()] == [0, 0]
    assert toxicity.score(documents([]), None).collect() == []


def test_slopes_are_derivatives_of_the_likelihood():
    rng = np.random.default_rng(1)
    score, t, y = rng.normal(size=6), np.array([-0.5, 0.8]), np.array([0, 1, 2, 0, 1, 2])

    def value(score, t):
        p = 1 / (1 + np.exp(-(score[:, None] - t)))
        wide = np.concatenate([np.ones((6, 1)), p, np.zeros((6, 1))], 1)
        return np.log(wide[range(6), y] - wide[range(6), y + 1]), p

    by_score, by_t = toxicity.likelihood_slopes(value(score, t)[1], y)
    e = 1e-6
    assert np.allclose((value(score + e, t)[0] - value(score - e, t)[0]) / (2 * e), by_score, atol=1e-5)
    for k in range(2):
        d = np.eye(2)[k] * e
        assert np.allclose((value(score, t + d)[0] - value(score, t - d)[0]) / (2 * e), by_t[:, k], atol=1e-5)


def test_cut_lies_in_the_widest_gap_without_errors():
    assert toxicity.best_cut(np.array([0.1, 0.2, 0.9]), np.array([False, False, True])) == pytest.approx(0.55)
    # Equal chances can't be separated.
    assert toxicity.best_cut(np.array([0.1, 0.1, 0.9]), np.array([False, True, True])) == pytest.approx(0.5)
