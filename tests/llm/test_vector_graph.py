import numpy as np
import pytest

from pagewright.llm import vector_graph as V


def table(spark, rows):
    return spark.createDataFrame(
        [(i, v if v is None else [None if x is None else float(x) for x in v], 0, 1.0) for i, v in rows],
        "vec_id long, embedding array<float>, label int, score double")


def brute(ids, vectors, every, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = unit @ unit[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32)
    vectors[1000:2000] = vectors[0] + rng.normal(size=(1000, 24)).astype(np.float32) * 1e-3  # a dense cluster
    frame = table(spark, enumerate(vectors.tolist()))
    valid = V.valid_vectors(frame)
    index = V.build_index(valid, shard_size=1000)
    assert index.count() == 3000 and index.select("shard").distinct().count() == 3
    rows = V.neighbours(index, index.where("vec_id % 50 = 0").select("vec_id", "vector"), 5).collect()
    expected = brute(np.arange(3000), vectors.astype(float), 50, 5)
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == expected.keys() and all(len(v) == 5 for v in found.values())
    hits = [len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 5 for q in expected]
    assert np.mean(hits) >= 0.9
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q, best in found.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True)
        assert all(s == pytest.approx(unit[q] @ unit[i], abs=1e-12) for i, s in best)


def test_ties_invalid_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (3, [2, 0]), (2, [5, 0]), (7, [0, 1]), (9, [1, 1]), (1, [1, 0, 0]), (50, [0, 0]), (100, None), (150, []), (200, [1, None]),
            (250, [nan, 1]), (300, [inf, 1]), (None, [1, 0]), (3, [2, 0]), (350, [1, 0]), (400, [1, 0, 1])]
    found = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in V.nearest(table(spark, rows), k=7).collect())
    half = round(0.5 ** 0.5, 6)
    assert found == [
        (0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 3, 1.0), (0, 4, 350, 1.0), (0, 5, None, 1.0), (0, 6, 9, half), (0, 7, 7, 0.0),
        (350, 1, 0, 1.0), (350, 2, 2, 1.0), (350, 3, 3, 1.0), (350, 4, 3, 1.0), (350, 5, None, 1.0), (350, 6, 9, half), (350, 7, 7, 0.0),
        (400, 1, 1, half)]
    assert V.nearest(table(spark, [])).collect() == []
    assert V.nearest(table(spark, [(0, [1, 2])])).collect() == []


def test_pruning_keeps_diverse_edges():
    angles = np.array([0, 0.1, 0.11, 0.12, -0.5])
    points = np.stack([np.cos(angles), np.sin(angles)], 1).astype(np.float32)
    kept = V.prune(points, np.array([0]), np.array([[1, 2, 3, 4, 4, 0, -1]]), 3)
    # 2 and 3 are nearer to 1 than to the centre; 4 lies on the other side.
    assert kept.tolist() == [[1, 4, -1]]


def test_every_vector_can_be_reached():
    vectors = V._unit(np.random.default_rng(4).normal(size=(700, 16))).astype(np.float32)
    edges, entry = V.build(vectors)
    seen, todo = {entry}, [entry]
    while todo:
        for i in edges[todo.pop()]:
            if i >= 0 and i not in seen:
                seen.add(int(i))
                todo.append(int(i))
    assert len(seen) == 700


def test_a_third_of_the_rows_are_copies(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(1800, 16)).astype(np.float32)
    vectors[::3] = vectors[0]
    vectors[1::30] = vectors[1] * np.float32(4)  # a group that differs from one vector by a factor
    found = {}
    for r in sorted(V.nearest(table(spark, enumerate(vectors.tolist())), shard_size=400).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.rank, r.score))
    assert sorted(found) == list(range(0, 1800, 50))
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = []
    for q, best in found.items():
        scores = np.round(unit @ unit[q], 9)
        expected = [i for i in np.lexsort((np.arange(1800), -scores)) if i != q][:5]
        assert [rank for _, rank, _ in best] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(scores[i], abs=1e-8) for i, _, s in best)
        if q % 3 == 0 or q % 30 == 1:
            assert [i for i, _, _ in best] == expected
        hits.append(len({i for i, _, _ in best} & set(expected)) / 5)
    assert np.mean(hits) >= 0.95


def test_every_row_is_a_candidate_by_its_own_vector(spark):
    rng = np.random.default_rng(8)
    ids = [int(i) for i in rng.integers(0, 200, 600)]  # each id about three times
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[::4] = vectors[0]
    vectors[1::40] = vectors[0] * np.float32(3)
    vectors[2::40] = vectors[0] * np.float32(2 ** -40)
    vectors[3::40] = -vectors[0]
    ids[4] = ids[5] = ids[6] = 50
    vectors[5] = vectors[6] = vectors[9]
    found = {}
    for r in V.nearest(table(spark, list(zip(ids, vectors.tolist()))), shard_size=100).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide = vectors.astype(float)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    expected, names = {}, np.array(ids)
    for q in np.flatnonzero(names % 50 == 0):
        scores = np.round(unit @ unit[q], 12)
        scores[q] = -2
        expected.setdefault(ids[q], []).extend((rank + 1, ids[i], scores[i]) for rank, i in enumerate(np.lexsort((names, -scores))[:5]))
    assert found.keys() == expected.keys() and len(expected[50]) >= 15
    for q, rows in expected.items():
        ours, theirs = sorted((rank, round(score, 9)) for rank, _, score in found[q]), sorted((rank, round(score, 9)) for rank, _, score in rows)
        assert [rank for rank, _ in ours] == [rank for rank, _ in theirs]
        assert [score for _, score in ours] == pytest.approx([score for _, score in theirs], abs=1e-8)
        # Scores of vectors that are equal but for rounding tie here and differ there: compare the ids of clear places.
        clear = [r for r in rows if r[2] < 1 - 1e-9]
        assert sorted((rank, i) for rank, i, _ in clear) == sorted((rank, i) for rank, i, s in found[q] if s < 1 - 1e-9)
        assert all(-1 <= s <= 1 for _, _, s in found[q])


def test_scores_of_copies_are_exactly_one(spark):
    v = np.array([0.1, 0.7, 0.3, -0.9], np.float32)
    rows = [(0, v.tolist()), (9, v.tolist()), (4, (v * np.float32(8)).tolist()), (5, (v * np.float32(3)).tolist()), (7, (-v).tolist())]
    found = [(r.vec_id, r.score) for r in sorted(V.nearest(table(spark, rows)).collect(), key=lambda r: r.rank)]
    assert {i: s for i, s in found if i in (4, 9)} == {4: 1.0, 9: 1.0}
    assert all(s <= 1 for _, s in found) and found[-1] == (7, -1.0) and dict(found)[5] == pytest.approx(1, abs=1e-7)
