"""Streams with state: arrivals, outcomes and tables that batches bring up to date."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright.plans import export_queries as E
from pagewright.sources.pages import fetch_outcomes
from pagewright.streaming import state as D


def files(spark, folder, batches, schema):
    """A stream of one file per batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).coalesce(1).write.mode(
            "append").parquet(folder)
    kept = spark.read.parquet(folder).schema
    return spark.readStream.schema(kept).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, rows, folder):
    with D.rocksdb_state(spark):
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{folder}/out").collect(), states


def test_arrivals_are_forgotten_after_a_while(spark, tmp_path):
    day = "2024-01-{:02d} 00:00:00".format
    batches = [
        [("http://a/x", day(1)), ("http://A/x#top", day(1)), ("http://a/y", day(1)), ("http://a/z", day(1))],
        [("http://a/x", day(2)), ("http://a/w", day(2))],
        [("http://a/w", day(4))],
        [("http://a/w", day(5)), ("http://a/old", "2023-01-01 00:00:00")],
        [("http://a/x", day(6)), ("http://a/v", day(6))],
        [("http://a/v", day(20)), (None, day(20))],
    ]
    stream = files(spark, str(tmp_path / "in"), batches, "url string, fetched_at string")
    rows, states = run(spark, D.dedup_arrivals(stream, "2 days"), str(tmp_path))
    got = sorted((r.url_norm or "", str(r.fetched_at)[:10]) for r in rows)
    # x again after its two days; the late address never; w is still known on day 5.
    assert got == sorted([("http://a/x", "2024-01-01"), ("http://a/y", "2024-01-01"), ("http://a/z", "2024-01-01"), ("http://a/w", "2024-01-02"),
                          ("http://a/x", "2024-01-06"), ("http://a/v", "2024-01-06"), ("", "2024-01-20")])
    assert len(states) >= 6 and max(states) > states[-1]


def test_outcomes_of_shuffled_attempts_are_those_of_the_batch(spark, tmp_path):
    draw, rows = random.Random(7), []
    for i in range(60):
        for attempt in range(1, draw.randint(1, 6) + 1):
            rows.append((f"u{i}", attempt, draw.choice([200, 404, 500]), f"t{i}-{attempt}", "2024-01-01 00:00:00"))
    batch = spark.createDataFrame(rows, "url string, attempt int, status int, page string, fetched_at string")
    want = sorted((r.url, r.attempts_made, r.succeeded, r.page or "") for r in fetch_outcomes(batch, payload=["page"]).collect())
    draw.shuffle(rows)
    batches = [rows[k::5] for k in range(5)] + [[("clock", 1, 500, "", "2024-03-01 00:00:00")]]
    stream = files(spark, str(tmp_path / "in"), batches, batch.schema)
    found, states = run(spark, D.stream_outcomes(stream, payload=["page"], patience="1 day"), str(tmp_path))
    assert sorted((r.url, r.attempts_made, r.succeeded, r.page or "") for r in found) == want
    assert states[-1] < max(states)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")

    def batch(*rows):
        return spark.createDataFrame(rows, "k string, n int, at int")

    def table():
        return sorted((r.k or "", r.n) for r in D.read_upserted(spark, path).collect())

    with pytest.raises(FileNotFoundError):
        D.read_upserted(spark, path)
    D.merge_batch(batch(("a", 1, 1), ("b", 2, 1), (None, 3, 1)), 0, path, ["k"])
    D.merge_batch(batch(("b", 9, 1), ("b", 5, 2), ("c", 7, 1)), 1, path, ["k"], ["at"])
    once = table()
    assert once == [("", 3), ("a", 1), ("b", 5), ("c", 7)]
    D.merge_batch(batch(("b", 9, 1), ("b", 5, 2), ("c", 7, 1)), 1, path, ["k"], ["at"])
    assert table() == once
    D.merge_batch(batch((None, 4, 1)), 2, path, ["k"])
    assert table() == [("", 4), ("a", 1), ("b", 5), ("c", 7)]
    # A version that was never finished is not seen; older ones go.
    (tmp_path / "table" / "batch-000000000003").mkdir()
    assert table() == [("", 4), ("a", 1), ("b", 5), ("c", 7)]
    assert not (tmp_path / "table" / "batch-000000000000").exists()


def test_a_stream_upserts_and_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    files(spark, folder, [[("a", 1, "2024-01-01 00:00:00")], [("a", 2, "2024-01-02 00:00:00"), ("b", 1, "2024-01-02 00:00:00")]],
          "k string, n int, fetched_at string")

    def go():
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        counts = stream.groupBy("k").agg(F.sum("n").alias("n"))
        D.upsert(counts, str(tmp_path / "table"), str(tmp_path / "checkpoint"), ["k"]).awaitTermination()
        return sorted(map(tuple, D.read_upserted(spark, str(tmp_path / "table")).collect()))

    assert go() == [("a", 3), ("b", 1)]
    files(spark, folder, [[("b", 5, "2024-01-03 00:00:00")]], "k string, n int, fetched_at string")
    assert go() == [("a", 3), ("b", 6)]
    assert go() == [("a", 3), ("b", 6)]


def test_a_large_batch_is_many_files_and_small_ones_stay_batches(spark, monkeypatch):
    monkeypatch.setattr(E, "_ROWS_A_FILE", 20)
    rows = spark.range(0, 200).selectExpr("id", "if(id < 5, id, 7) AS part").unionAll(spark.sql("SELECT 1000L AS id, 9L AS part"))
    stream, seen = E._in_batches(spark, rows, "test-batches"), {}

    def look(batch, number):
        found = batch.collect()
        seen[number] = (sorted(r.id for r in found), len({r.file for r in found}))

    folder = E.scratch_folder(spark, "test-batches")
    stream.withColumn("file", F.input_file_name()).writeStream.foreachBatch(look).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    assert [seen[n][0] for n in sorted(seen)] == [[0], [1], [2], [3], [4], list(range(5, 200)), [1000]]
    files = min(10, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert files > 1 and [f for _, f in seen.values()] == [1, 1, 1, 1, 1, files, 1]


def test_the_earliest_arrival_of_a_batch_counts_and_no_frame_is_built_for_it():
    class Handle:
        kept, timers = [], []

        def getValueState(self, *_):
            return self

        def exists(self):
            return False

        def update(self, value):
            self.kept.append(value)

        def registerTimer(self, at):
            self.timers.append(at)

    first = D._FirstArrival(10, ["url", "note", "_at"])
    first.init(Handle())
    rows = [Row("b", None, 5), Row("b", "x", 5), Row("a", None, 7), Row("c", "x", 5)]
    assert [tuple(r) for r in first.handleInputRows(("k",), iter(rows), None)] == [("b", "x")]
    assert Handle.kept == [(15,)] and Handle.timers == [15]
