"""Result logs: resuming, per-episode state and circuit breaking, in batch and as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the log yet."""
    return todo.join(done.select(key), key, "left_anti")


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream with each key once; state is dropped when the watermark has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def until_streak(df: DataFrame, group: str, order: str, bad: Column, streak: int) -> DataFrame:
    """Rows of each group up to the end of its first run of ``streak`` bad ones."""
    w = Window.partitionBy(group).orderBy(order)
    rows = df.withColumn("_bad", bad)
    rows = rows.withColumn("_island", F.sum((~F.col("_bad")).cast("int")).over(w))
    place = F.sum(F.col("_bad").cast("int")).over(Window.partitionBy(group, "_island").orderBy(order))
    rows = rows.withColumn("_hit", ((place >= streak) & F.col("_bad")).cast("int"))
    before = F.coalesce(F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).filter("_before = 0").drop("_bad", "_island", "_hit", "_before")


def fold_novelty(documents: DataFrame) -> DataFrame:
    """New URLs of each turn of an episode, by windows."""
    first = F.row_number().over(Window.partitionBy("episode", "url").orderBy("turn", "position")) == 1
    return documents.withColumn("new", first.cast("long")).groupBy("episode", "turn").agg(F.sum("new").alias("new_urls"))


def _keyed_states(spark: SparkSession) -> None:
    """Lists, maps and timers of keyed state live in RocksDB, which spills; states of other queries stay as they are set."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _mode(idle: int | None) -> str:
    """With timers a stream runs batches without rows, too, and so has always something to process."""
    return "None" if idle is None else "ProcessingTime"


class _Idle(StatefulProcessor):
    """State that goes when its key has had no rows for ``idle`` milliseconds; each batch with rows puts the timer off.  None keeps it."""

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def touched(self, timers) -> None:
        if self.idle is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _Novelty(_Idle):
    """An episode's URLs so far as a map: of a batch only its different URLs are looked up, the map is never read whole."""

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", "url string", "seen boolean")

    def forget(self) -> None:
        self.urls.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        first = batch.sort_values(["turn", "position"]).drop_duplicates("url")
        fresh = np.array([not self.urls.containsKey((u,)) for u in first["url"]], bool)
        for url in first["url"][fresh]:
            self.urls.updateValue((url,), (True,))
        counts = first["turn"][fresh].value_counts()
        turns = [int(t) for t in batch["turn"].unique()]
        self.touched(timerValues)
        yield pd.DataFrame({"episode": [key[0]] * len(turns), "turn": turns, "new_urls": [int(counts.get(t, 0)) for t in turns]})


def stream_novelty(stream: DataFrame, idle: int | None = 3_600_000) -> DataFrame:
    """fold_novelty() as a stream with keyed state; an episode is forgotten after ``idle`` milliseconds without rows.

    A turn's rows come in one micro-batch, and turns in their order.  Of an
    episode a task holds the rows of a batch, never those before.
    """
    _keyed_states(stream.sparkSession)
    rows = stream.select("episode", "turn", "position", "url").groupBy("episode")
    return rows.transformWithStateInPandas(_Novelty(idle), "episode long, turn long, new_urls long", "Append", _mode(idle))


class _Breaker(_Idle):
    """The length of the current run of bad rows, and whether the breaker has opened."""

    def __init__(self, group: str, order: str, bad: str, streak: int, idle: int | None) -> None:
        super().__init__(idle)
        self.names, self.streak = (group, order, bad), streak

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "length int, opened boolean")

    def forget(self) -> None:
        self.run.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, order, bad = self.names
        length, opened = self.run.get() if self.run.exists() else (0, False)
        self.touched(timerValues)
        if opened:
            return
        batch = pd.concat(list(rows)).sort_values(order)
        wrong = batch[bad].to_numpy(bool)
        # the run that a row ends: rows since the last good one, with the run before where there is none
        place = np.arange(len(wrong))
        last = np.maximum.accumulate(np.where(wrong, -1, place))
        runs = np.where(wrong, np.where(last < 0, place + 1 + length, place - last), 0)
        over = np.flatnonzero(runs >= self.streak)
        end = int(over[0]) + 1 if len(over) else len(wrong)
        self.run.update((int(runs[end - 1]), bool(len(over))))
        yield batch.iloc[:end][list(self.names)]


def stream_until_streak(stream: DataFrame, group: str, order: str, bad: str, streak: int, idle: int | None = 3_600_000) -> DataFrame:
    """until_streak() as a stream with keyed state: ``group``, ``order`` and ``bad`` of each row up to the end of the first run of ``streak`` bad ones.

    Rows after the run are dropped until the group has had none for ``idle``
    milliseconds: then its state goes and the breaker is closed again.
    Batches must follow each other in ``order``.
    """
    _keyed_states(stream.sparkSession)
    kinds = dict(stream.dtypes)
    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, {bad} boolean"
    return stream.select(group, order, bad).groupBy(group).transformWithStateInPandas(_Breaker(group, order, bad, streak, idle), schema, "Append", _mode(idle))


def drained(stream: DataFrame, target: str, schema: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in a new folder; its checkpoint is beside it."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(target)


class OnceLog:
    """A result log that a stream writes and that holds each key once, whatever is replayed.

    A batch goes to a folder of its own, which a replay overwrites, and counts
    from the moment that its file in ``commits`` is there; that file is made by
    one rename.  A batch that is committed already is skipped, and keys of
    other batches are left out.  Readers see committed folders only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, before: int | None = None) -> DataFrame:
        """The committed rows; of batches before one, if it is given."""
        folders = [f"{self.path}/data/{k}" for k in self.committed() if before is None or k < before]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch()."""
        if batch_id in self.committed():
            return
        fresh = remaining(batch.dropDuplicates([self.key]), self.read(batch_id), self.key)
        fresh.write.mode("overwrite").parquet(f"{self.path}/data/{batch_id}")
        self.commit(batch_id)

    def commit(self, batch_id: int) -> None:
        target, made = self._path(f"{self.path}/commits/{batch_id}"), self._path(f"{self.path}/commits/.{batch_id}-{uuid.uuid4().hex}")
        self._fs.create(made, False).close()
        self._fs.rename(made, target)

    def start(self, stream: DataFrame):
        """The running query."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.path}/checkpoint").start()
