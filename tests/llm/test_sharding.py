import zlib

from pagewright.llm import sharding


def check(rows, count=8):
    assert sorted(r.shard for r in rows) == sorted(x for x in (r.shard for r in rows) if 0 <= x < count)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def test_sizes_are_near_equal_and_groups_stay_together(documents):
    texts = ["word " * (1 + i % 7) + str(i // 2) for i in range(2000)]
    rows = sharding.shards(documents(texts)).collect()
    check(rows)
    assert len(rows) == 2000 and sum(r.size for r in rows) == sum(len(t) + 1 for t in texts)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 100
    of = {}
    for r in rows:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}


def test_a_group_with_most_rows_is_cut(documents):
    rows = sharding.shards(documents(["same text"] * 900 + [f"text {i}" for i in range(100)])).collect()
    check(rows)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 40


def test_nulls_repeats_long_and_empty(documents):
    rows = sharding.shards(documents([None, "", "é" * 5000, "a", "a"], [None, 1, 2, 3, 3])).collect()
    check(rows)
    assert sorted((r.size, r.doc_id) for r in rows if r.doc_id) == [(1, 1), (2, 3), (2, 3), (10001, 2)]
    none = next(r for r in rows if r.doc_id is None)
    assert none.size == 1 and none.text_crc32 is None
    assert sharding.shards(documents([])).collect() == []
