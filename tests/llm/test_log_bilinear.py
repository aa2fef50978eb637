import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import log_bilinear as L

random.seed(9)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def corpus(n=150):
    """Two languages: what comes next depends on what was."""
    tongues = [[f"{c}{k}" for k in range(40)] for c in ("ka", "zo")]
    return [" ".join(random.choices(tongues[i % 2], [1 / (k + 1) for k in range(40)], k=60)) for i in range(n)]


def test_counts_and_base_scores(documents):
    texts = [*corpus(60), None, "", "  É É\t", "rare" + "x" * 50_000, "Ka0 KA0 ka0"]
    ids = [*range(len(texts) - 1), None]
    rows = L.score(documents(texts, ids)).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    counts = Counter(t for text, h in zip(texts, held) if not h for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, text, h in zip(ids, texts, held):
        r, own = by[i], tokens(text)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (h, len(own), total)
        assert r.n_known == sum(t in counts for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own), abs=1e-8)
        assert r.score < 0


def test_joined_counts_give_the_same(documents, monkeypatch):
    docs = documents([*corpus(40), "one two three four", "one five"])
    whole = {r.doc_id: (r.n_known, r.base_score) for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "KNOWN", 8)
    for r in L.score(docs).collect():
        assert r.n_known == whole[r.doc_id][0] and r.base_score == pytest.approx(whole[r.doc_id][1], abs=1e-8)


def test_held_out_texts_are_likelier_than_by_frequencies(documents):
    rows = [r for r in L.score(documents(corpus(300))).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.15  # knowing the language is worth log10(2) at most


def test_chances_are_normalised():
    alone = np.random.default_rng(0).random(L.ALL) + 0.1
    alone /= alone.sum()
    first, second = np.arange(500) % 40, (np.arange(500) * 7) % 60
    parts = [L.contrast(first, second, np.ones(500), alone, steps=20, seed=k) for k in (1, 2)]
    mixing = np.array([0.2, 0.5, 0.3])
    one, two = L.Model(np.zeros(0), *map(list, zip(*parts)), alone, mixing).tables()
    assert np.allclose(one.sum(1)[:, None] + two.sum(1) + mixing[0] * alone.sum(), 1, atol=1e-5)


def test_contrast_learns_conditional_chances():
    rng = np.random.default_rng(1)
    truth = rng.dirichlet(np.ones(6) * 0.7, 6)
    first, second = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6), indexing="ij"))
    weight = truth.ravel() * 1000
    alone = truth.mean(0)
    left, right, bias = L.contrast(first, second, weight, alone, steps=1500)
    assert np.abs(L.softmax_rows(left @ right.T + bias) - truth).max() < 0.08


def test_mixing_weights_maximise_the_likelihood():
    chances = np.array([[0.9, 0.1]] * 70 + [[0.1, 0.9]] * 30)
    best = L.mix_weights(chances, 200)
    grid = [np.log(chances @ [w, 1 - w]).sum() for w in np.linspace(0.01, 0.99, 99)]
    assert np.log(chances @ best).sum() >= max(grid) - 1e-6


def test_without_training_texts_and_without_rows(documents):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = L.score(documents(["a b"], [held])).collect()[0]
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row.score)
    assert L.score(documents([])).collect() == []


def test_every_pair_of_a_large_table_is_learned():
    # More cells than a fixed number of draws could see: each unit is followed by one of its own.
    size = 1_200
    first, second = (x.ravel() for x in np.meshgrid(np.arange(size), np.arange(size), indexing="ij"))
    weight = np.where((first * 7 + 3) % size == second, size / 4, 0.75)
    left, right, bias = L.contrast(first, second, weight, np.full(size, 1 / size), steps=L.STEPS)
    likely = L.softmax_rows(left @ right.T + bias)[np.arange(size), (np.arange(size) * 7 + 3) % size]
    assert np.quantile(likely, 0.01) > 0.02


def test_mixing_weights_follow_all_places_of_a_small_corpus(spark, documents):
    # A place tells the next token, the one two back tells nothing.
    step = {c: d for c, d in zip("abcdefgh", "cdaefhgb")}
    texts = []
    for i in range(60):
        text = [random.choice("abcdefgh")]
        for _ in range(30):
            text.append(step[text[-1]] if random.random() < 0.8 else random.choice("abcdefgh"))
        texts.append(" ".join(text))
    training = documents(texts).select("doc_id", "text")
    names = np.unique(L.Stream.of(documents(texts).select("text").toArrow().column("text").combine_chunks()).hashes)
    alone = np.where(np.arange(L.ALL) < len(names), 1.0, 1e-9)
    alone /= alone.sum()
    model = L.fit(training, names, alone)
    assert model.mixing[1] > 0.5
    shares, n = L.mixture_shares(training, model)
    assert n.sum() == sum(len(tokens(t)) for t in texts) and np.allclose(shares.sum(1), 1)
