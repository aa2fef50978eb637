"""Stream operators with state of their own, and the table that a stream keeps up to date.

The processors hold a few values per address and let go of them by timers, so an endless stream
needs memory for the addresses of a while only.  They need Spark's RocksDB state store
(`rocksdb_state`), which spills to disk and keeps its checkpoints next to those of the query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pagewright.functions.urls import normalize_url

# Tasks carry this module with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _milliseconds(spark: SparkSession, interval: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {interval})").first()[0])


class _FirstArrival(StatefulProcessor):
    """Remembers a key from its first row until `keep` milliseconds of event time later."""

    def __init__(self, keep: int, names: list[str]):
        self.keep, self.names, self.at = keep, names, names.index("_at")

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        # Of several rows in a batch the earliest counts; ties by the other columns.
        first = min((tuple(row) for row in rows), key=self._order)
        until = first[self.at] + self.keep
        self.seen.update((until,))
        self.handle.registerTimer(until)
        yield Row(**{name: value for name, value in zip(self.names, first) if name != "_at"})

    def _order(self, row: tuple) -> list:
        """Missing values come last."""
        rest = [v for i, v in enumerate(row) if i != self.at]
        return [(False, v) if v is not None and v == v else (True, None) for v in [row[self.at], *rest]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedup_arrivals(pages: DataFrame, keep_for: str, watermark: str = "0 seconds", event_time: str = "fetched_at") -> DataFrame:
    """The first arrival of each normalised URL in `keep_for` of event time.

    An address is forgotten when the watermark has passed its arrival by `keep_for`; then it counts as
    new.  Rows that are later than the watermark are dropped.  Result: the columns of
    `pages` and ``url_norm``.
    """
    spark = pages.sparkSession
    keyed = pages.withColumn("url_norm", F.expr(f"coalesce({normalize_url('url')}, url)")).withColumn(
        event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, watermark)
    timed = keyed.withColumn("_at", F.unix_millis(event_time))
    # Rows, not frames: a frame per address costs more than the work on it.
    return timed.groupBy("url_norm").transformWithState(
        _FirstArrival(_milliseconds(spark, keep_for), timed.columns), keyed.schema, "Append", "EventTime")


class _Attempts(StatefulProcessor):
    """The attempts on one address until the outcome is certain, or patience is over."""

    def __init__(self, retries: int, patience: int):
        self.retries, self.patience = retries, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.tried = handle.getMapState("tried", "attempt int", "ok boolean, payload string")
        self.open = handle.getValueState("open", "until long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, done = self.open.get() if self.open.exists() else (-1, False)
        latest = until
        for part in rows:
            latest = max(latest, int(part["at_ms"].max()) + self.patience)
            if done:
                continue
            for attempt, ok, payload in part[["attempt_number", "attempt_ok", "carried"]].itertuples(index=False):
                # What comes after the last retry can't change the outcome.
                if attempt <= self.retries and not self.tried.containsKey((int(attempt),)):
                    self.tried.updateValue((int(attempt),), (bool(ok), payload))
        found = None if done else self._outcome(certain=True)
        if latest != until:
            if until >= 0:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        if found is not None:
            self.tried.clear()
        self.open.update((latest, done or found is not None))
        if found is not None:
            yield self._row(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, done = self.open.get()
        found = None if done else self._outcome(certain=False)
        self.tried.clear()
        self.open.clear()
        if found is not None:
            yield self._row(key, found)

    def _outcome(self, certain: bool):
        """Attempts made, success and payload; None while an earlier attempt may still come."""
        tried = sorted((k[0], v[0], v[1]) for k, v in self.tried.iterator())
        for place, (attempt, ok, payload) in enumerate(tried, 1):
            if certain and attempt != place:
                return None
            if ok:
                return place, True, payload
        return (len(tried), False, None) if tried and (not certain or len(tried) == self.retries) else None

    def _row(self, key, found) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "attempts_made": [found[0]], "succeeded": [found[1]], "carried": [found[2]]})

    def close(self) -> None:
        pass


def stream_outcomes(attempts: DataFrame, max_retries: int = 3, key: str = "url", order: str = "attempt", ok: str = "status < 400",
                    payload: list[str] | None = None, patience: str = "1 hour", watermark: str = "10 minutes",
                    event_time: str = "fetched_at") -> DataFrame:
    """S4 on a stream: one row per address as soon as its outcome is certain.

    Attempts are numbered from 1 by `order` and may arrive in any order.  The outcome is
    certain at the first success whose earlier attempts have all failed, or when `max_retries`
    have failed; an address that stays incomplete is judged by what has arrived once the watermark has
    passed its last attempt by `patience`, and forgotten.  Result as that of `fetch_outcomes`.
    """
    carried = payload or []
    kinds = T.StructType([attempts.schema[c] for c in carried])
    packed = F.to_json(F.struct(*carried), {"ignoreNullFields": "false"}) if carried else F.lit("{}")
    rows = attempts.select(
        F.col(key).alias("key"), F.col(event_time).cast("timestamp").alias(event_time), F.col(order).cast("int").alias("attempt_number"),
        F.coalesce(F.expr(ok), F.lit(False)).alias("attempt_ok"), packed.alias("carried")).withWatermark(event_time, watermark).withColumn("at_ms", F.unix_millis(event_time))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("attempts_made", T.LongType()),
        T.StructField("succeeded", T.BooleanType()), T.StructField("carried", T.StringType())])
    processor = _Attempts(max_retries, _milliseconds(attempts.sparkSession, patience))
    found = rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    values = [F.from_json("carried", kinds)[c].alias(c) for c in carried]
    return found.select(F.col("key").alias(key), "attempts_made", "succeeded", *values)


# --- a table that a stream keeps up to date ---------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-")
                  and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _drop_version(spark: SparkSession, path: str, version: int) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_version(path, version))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _version(path: str, number: int) -> str:
    return f"{path}/batch-{number:012d}"


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Put a batch's rows into the table at `path`: one row per key, the batch's where it has one.

    The table's versions carry the numbers of batches.  A batch starts from the last version before
    its own, so a batch that runs again after a failure writes the same table again.  Of several rows of a key in a
    batch the last by `order` counts (without one, the largest).  The two latest versions stay.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order]) if order else F.struct(*rest)
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_v")).select(*keys, "_v.*").select(*batch.columns)
    earlier = [v for v in _versions(spark, path) if v < number]
    table = newest
    if earlier:
        old = spark.read.schema(batch.schema).parquet(_version(path, earlier[-1]))
        changed = newest.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        table = old.join(changed, same, "left_anti").unionByName(newest)
    table.write.mode("overwrite").parquet(_version(path, number))
    for version in earlier[:-1]:
        _drop_version(spark, path, version)


def upsert(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str] | None = None,
           mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Keep the table at `path` up to date with a stream of new or changed rows."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, path, keys, order)).option(
        "checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table as its last complete version has it."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no complete version below {path}")
    return spark.read.parquet(_version(path, versions[-1]))
