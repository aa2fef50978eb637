import pathlib
import random

import pyarrow as pa
import pytest

from pagewright.llm import graphs, ngram_join
from tests.llm.test_hashing import grams

random.seed(7)


def words(n):
    return [f"w{random.randint(0, 5000)}" for _ in range(n)]


def corpus():
    texts = []
    for _ in range(30):  # unrelated
        texts.append(" ".join(words(random.randint(1, 120))))
    base = words(150)
    for _ in range(60):  # a family of near copies, some within the threshold of each other
        own = list(base)
        for _ in range(random.randint(0, 5)):
            own[random.randint(0, 149)] = f"x{random.randint(0, 10**6)}"
        texts.append(" ".join(own))
    shared = words(40)
    for _ in range(20):  # a passage in common is not enough
        texts.append(" ".join(words(60) + shared + words(60)))
    texts += [texts[0]] * 15 + [texts[35].upper()] * 5 + [None, "", "  ", None, "one two", "One  two", "one two three"]
    return texts


def brute(texts, threshold=0.8):
    sets = [frozenset(grams(t)) for t in texts]
    near = [[j for j, b in enumerate(sets) if a and b and j != i and len(a & b) >= threshold * len(a | b) - 1e-9]
            for i, a in enumerate(sets)]
    out = list(range(len(texts)))
    for i in range(len(texts)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = min(seen)
    return sets, near, out


@pytest.mark.parametrize("block", [400, 7])
def test_links_and_classes_equal_brute_force(documents, block):
    texts = corpus()
    sets, near, classes = brute(texts)
    rows = ngram_join.similarity_classes(documents(texts), block=block).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r.doc_id
        assert r.class_id == classes[i]
        assert r.links == sum(sets[j] != sets[i] for j in near[i])
        assert r.linked_sets == len({sets[j] for j in near[i] if sets[j] != sets[i]})
        assert r.copies == sum(sets[j] == sets[i] for j in near[i])


def test_one_document_of_each_class_stays(documents):
    texts = corpus()
    _, _, classes = brute(texts)
    docs = documents(texts)
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes))


def test_repeated_rows_and_null_ids(documents):
    long = " ".join(words(50))
    docs = documents([long, long, long, "a b c", "a b c", None], [1, 1, 2, None, None, None])
    rows = ngram_join.similarity_classes(docs).collect()
    assert sorted((r.class_id, r.copies) for r in rows if r.doc_id) == [(1, 2)] * 3
    kept = [r.doc_id for r in ngram_join.keep_one_of_each(docs).collect()]
    assert sorted(kept, key=str) == [1, None, None]
    assert ngram_join.similarity_classes(documents([])).collect() == []
    assert ngram_join.keep_one_of_each(documents([])).collect() == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9998), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.999999, 10)


def test_equal_sets_have_equal_keys():
    from pagewright.llm import hashing

    values, starts = hashing.shingle_sets(pa.array(["a b c d e f", "A  b c d e f", "a b c d e g"]), 5)
    keys = ngram_join.set_keys(values, starts)
    assert (keys[:, 0] == keys[:, 1]).all() and (keys[:, 0] != keys[:, 2]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200), (200, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in graphs.connected_components(frame).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 200, 300: 200}
    assert graphs.connected_components(frame.where("a < 0")).collect() == []


def test_bands_are_those_of_the_readme():
    bands, rows = ngram_join.choose_bands(0.8, 0.9998)
    readme = (pathlib.Path(__file__).parents[2] / "README.md").read_text()
    assert f"{bands} bands of {rows} rows (recall 0.9998 at 0.8)" in readme
