"""Numbers of addresses, and where the visited pairs of a crawl lie."""

import re

from pagewright.operators.addresses import Addresses
from pagewright.operators.crawl import _Visited


def test_numbers_differ_even_if_hashes_don_t(spark):
    words = ["a", "bb", "cc", "dd", "eee", "it's", None, "a"]
    rows = spark.createDataFrame([(w, 1) for w in words], "address string, n int")
    for hashed in ("xxhash64({0})", "cast(length({0}) as bigint)"):
        known = Addresses(rows, hashed)
        found = {r.address: r.n for r in rows.selectExpr("address", f"{known.number('address')} AS n").collect()}
        assert found.pop(None) is None
        assert len(set(found.values())) == 6
        assert {r.address: r.number for r in known.table.collect()} == found
        assert all(r.n == 1 for r in known.table.collect())
    assert len(known.clashes) == 4  # the last bit of a hash does not count


def test_visited_pairs_are_not_shuffled(spark):
    visited = _Visited(spark, "ok boolean")
    try:
        level = spark.range(100).selectExpr("id AS seed", "id * 7 AS url", "true AS ok")
        assert visited.add(level, 0) == 100
        assert visited.add(level.selectExpr("seed", "url + 1 AS url", "ok"), 1) == 100
        found = spark.range(50, 150).selectExpr("id AS seed", "id * 7 AS url", "true AS ok").distinct()
        new = visited.new(found)
        assert new.count() == 50
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = visited.new(found)._jdf.queryExecution().executedPlan().toString()
        side = plan[: plan.index("FileScan parquet")]
        # Below the join, the exchange is that of the frontier; the visited side begins with its sort.
        assert "Bucketed: true" in plan
        assert len(re.findall(r"Exchange hashpartitioning\(seed", plan)) == len(re.findall(r"Exchange hashpartitioning\(seed", side)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        visited.drop()
    assert visited.close().where("depth = 1").count() == 100


def test_scratch_folders_can_be_cleared(spark, monkeypatch):
    import os

    from pagewright import session

    monkeypatch.setattr(session, "_made", [])
    rows = session.written(spark.range(3), "cleared")
    folder = session._made[0]
    session.scratch_folder(spark, "never-written")
    assert rows.count() == 3 and os.path.isdir(folder)
    assert session.clear_scratch(spark) == 1
    assert not os.path.exists(folder) and session.clear_scratch(spark) == 0


def test_the_first_level_is_one_file_a_bucket(spark):
    visited = _Visited(spark, "ok boolean")
    try:
        assert visited.add(spark.range(0, 3000, 1, 7).selectExpr("id AS seed", "id * 7 AS url", "true AS ok"), 0) == 3000
        assert 1 < len(visited.level(0).inputFiles()) <= visited.buckets
    finally:
        visited.drop()
