"""Streams with keyed state: rows of new keys, and work withdrawn when a decision changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Sets the session's state store to the one that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _plain(v):
    """A pandas value as Python's own, missing ones as None."""
    if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
        return None
    return v.item() if hasattr(v, "item") else v


class _Seen(StatefulProcessor):
    """The first row of a key, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = not self.seen.exists(), None
        for pdf in rows:
            first = pdf.head(1) if first is None else first
        if new and first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def new_keys(source: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """The stream's first row of each key that neither it nor `known`, read once at the first start, has had."""
    keyed_state(source.sparkSession)
    seed = None if known is None else known.select(*keys).distinct().groupBy(*keys)
    return source.groupBy(*keys).transformWithStateInPandas(_Seen(), source.schema, "append", "none", initialState=seed)


class _Last(StatefulProcessor):
    """The last decision of a key; a change withdraws what was made from the one before."""

    def __init__(self, keys: StructType, columns: StructType, order: str, idle_ms: int | None):
        self.keys, self.columns, self.order, self.idle_ms = keys, columns, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.columns)

    def _rest(self, timerValues) -> None:
        """An idle key is forgotten after a while; each row puts that off."""
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.last.get()) if self.last.exists() else None
        was, names, out = old, [f.name for f in self.columns], []
        got = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for values in zip(*(got[n] for n in names), strict=True):
            now = tuple(map(_plain, values))
            if now == was:
                continue
            if was is not None:
                out.append((*key, "withdraw", *was))
            out.append((*key, "task", *now))
            was = now
        if was != old:
            self.last.update(was)
        self._rest(timerValues)
        yield pd.DataFrame(out, columns=[*(f.name for f in self.keys), "action", *names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def withdrawals(decisions: DataFrame, keys: list[str], compare: list[str], order: str, idle_ms: int | None = None) -> DataFrame:
    """(*keys, action, *compare): the work that a stream of decisions starts and withdraws.

    The first row of a key is a task. A row whose compared columns differ from those of the key's last one, nulls
    being equal, first withdraws that one and then is a task; equal rows start nothing. Within a batch rows
    count in their `order`. With `idle_ms` a key without rows for so long is forgotten, and its next row is
    a first one; as its clock runs on, such a query ends only with a trigger of its own (once, or a stop). What is withdrawn is what `relational.stale` finds for finished records and current rows.
    """
    keyed_state(decisions.sparkSession)
    of = lambda names: StructType([StructField(n, decisions.schema[n].dataType) for n in names])
    schema = StructType([*of(keys).fields, StructField("action", StringType()), *of(compare).fields])
    rows = decisions.select(*dict.fromkeys([*keys, *compare, order]))
    return rows.groupBy(*keys).transformWithStateInPandas(_Last(of(keys), of(compare), order, idle_ms), schema, "append", "none" if idle_ms is None else "processingTime")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_batches(source: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """A query that writes each transformed batch to a folder batch=<n> of `target`, once.

    The ledger is the mark of success in each folder: a batch that has one is left alone when it is run again, one that
    was cut off is written anew in its place. Nothing that stands in the target is read.
    """

    def batch(df: DataFrame, n: int) -> None:
        folder = f"{target}/batch={n}"
        if _exists(df.sparkSession, f"{folder}/_SUCCESS"):
            df.write.format("noop").mode("overwrite").save()  # the keyed state still has to follow the batch
        else:
            transform(df).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def batches(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """What `append_batches` has written; folders without a mark of success, cut off and not yet written anew, don't count."""
    if not _exists(spark, target):
        return spark.createDataFrame([], schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/_SUCCESS")
    done = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    folders = [x.getPath().getParent().toString() for x in done or []]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_new(source: DataFrame, target: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame], known: DataFrame | None = None):
    """A query that appends transformed rows of keys that it has not had before; restarted, it goes on.

    Keys are kept as state, so the target isn't read again: only `known`, rows of an earlier target for instance,
    is read, at the first start. A batch run again after a failure adds none twice; see `append_batches`.
    """
    return append_batches(new_keys(source, keys, known), target, checkpoint, transform)

