import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import rules_forest
from pagewright.llm.rules_forest import Forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i: i + 3])] > 1}
    seen, lines, repeats = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, repeats, len(covered)


def test_counts_against_regular_expressions():
    draw = random.Random(4)
    texts = [None, "", "\n\n \n", "a", "a a a a", "a b c\na b c\n a b c\nd", "é#ß x\x85y"]
    texts += ["".join(draw.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "$", "日"]) for _ in range(draw.randint(0, 300))) for _ in range(200)]
    found = rules_forest.counts(pa.array(texts, pa.string()))
    assert list(zip(*(found[c].tolist() for c in rules_forest.COUNTS))) == [by_hand(t) for t in texts]


def path_by_hand(forest, tree, row):
    node, depth = 0, 0
    while forest.statistic[tree, node] >= 0:
        node = int(forest.child[tree, node]) + int(row[forest.statistic[tree, node]] >= forest.place[tree, node])
        depth += 1
    return depth, forest.length[tree, node]


def test_paths_are_those_of_single_rows():
    x = np.random.default_rng(5).normal(size=(600, 4))
    forest = Forest.grow(x, 20, 64, [0, 1, 2, 3], 3)
    lengths = [[path_by_hand(forest, t, row) for t in range(20)] for row in x[:40]]
    want = [2 ** -(np.mean([n for _, n in paths]) / rules_forest.expected_path(64)) for paths in lengths]
    assert np.allclose(forest.score(x[:40]), want)
    assert all(depth <= 6 and length >= depth for paths in lengths for depth, length in paths)


def test_outliers_have_short_paths_and_constant_statistics_split_nothing():
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(1000, 4)), [[9, 9, 9, 9]]])
    scores = Forest.grow(x, 100, 256, [0, 1, 2, 3], 1).score(x)
    assert scores.argmax() == 1000
    flat = Forest.grow(np.ones((300, 4)), 5, 64, [0, 1, 2, 3], 1).score(np.array([[1.0] * 4, [5.0] * 4]))
    assert flat[0] == flat[1]


def test_cut_loses_few_good_rows():
    good, bad = np.zeros(1001), np.zeros(1001)
    good[400], good[700], bad[600], bad[420] = 996, 4, 50, 50
    gain, cut = rules_forest.best_cut(good, bad, 1000, 100)
    assert gain == pytest.approx(1 - 0.004) and 0.4 < cut <= 0.42
    good[410] = 100
    gain, cut = rules_forest.best_cut(good, bad, 1100, 100)
    assert 0.41 < cut <= 0.42


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    texts, quality = [], []
    for i in range(240):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(60, 200))]
        bad = i % 6 == 0
        if bad:
            words = [w + draw.choice(["###", "$$$", "%%%"]) for w in words]
        texts.append(" ".join(words))
        quality.append(0 if bad else 1)
    return texts, quality


def judged(documents, spark, texts, labels, ids=None):
    rows = spark.createDataFrame([(i, q, 0, "x") for i, q in labels], "doc_id long, quality int, toxic int, text string")
    return {(r["doc_id"], r["n_words"]): r for r in rules_forest.judge(documents(texts, ids), rows).collect()}


def test_unlabelled_bad_documents_go_and_good_ones_stay(documents, spark, corpus):
    texts, quality = corpus
    rows = judged(documents, spark, texts + [None, "", "too short"], [(i, q) for i, q in enumerate(quality) if i % 2 == 0])
    kept = {i: r["kept"] for (i, _), r in rows.items()}
    assert [kept[i] for i in range(240)] == [q == 1 for q in quality]
    for i in (240, 241, 242):
        row = next(r for (j, _), r in rows.items() if j == i)
        assert row["base_failed"] and not row["kept"] and row["scores"] is None
    # The layout of the rows does not matter.
    frame = documents(texts)
    label = spark.createDataFrame([(i, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    one, two = (sorted((r["doc_id"], *r["scores"]) for r in rules_forest.judge(f, label).collect())
                for f in (frame, frame.repartition(5, "text")))
    assert one == two


def test_without_labels_of_both_kinds_only_base_rules_apply(documents, spark, corpus):
    texts, _ = corpus
    for labels in ([], [(0, 1)], [(0, 0), (None, 1), (1, None)]):
        assert all(r["kept"] for r in judged(documents, spark, texts, labels).values())


def test_copies_nulls_and_empty_tables(documents, spark, corpus):
    texts, quality = corpus
    many = [texts[1]] * 200 + texts
    rows = rules_forest.judge(documents(many, [7] * 200 + list(range(1000, 1240))), spark.createDataFrame(
        [(1000 + i, q) for i, q in enumerate(quality)], "doc_id long, quality int")).collect()
    assert sum(r["doc_id"] == 7 for r in rows) == 200 and all(r["kept"] for r in rows if r["doc_id"] == 7)
    assert [r["kept"] for r in sorted(rows, key=lambda r: r["doc_id"]) if r["doc_id"] >= 1000] == [q == 1 for q in quality]
    label = spark.createDataFrame([], "doc_id long, quality int")
    assert rules_forest.judge(documents([]), label).count() == 0
    assert [r["kept"] for r in rules_forest.judge(documents([None], [3]), label).collect()] == [False]
