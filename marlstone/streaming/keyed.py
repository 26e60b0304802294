"""Folds over a key's events in order: one rule, run over a table or over a stream.

A rule answers each event from what it holds of the key's earlier ones. The batch run sorts a key's events and passes them
through a task. The stream keeps the events that the watermark hasn't passed as keyed state and answers them in order once
it has, so files may come in any order within the watermark's delay and the answers are those of the batch run. Timers wake
a key when its next event is due and when what it holds has no effect any more, so that state doesn't outlive its use.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlstone.streaming.folders import new_folder


class RateLimit:
    """At most `limit` events in any window of so many seconds, both ends included; those turned away don't count."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.span = limit, int(seconds * 1e6)

    def answer(self, held: list[int], us: int, _: int) -> tuple[list[int], bool]:
        held = [x for x in held if x >= us - self.span]
        return ([*held, us], True) if len(held) < self.limit else (held, False)

    def until(self, held: list[int]) -> int:
        return max(held) + self.span


class RouteCache:
    """Whether the key is stored. An event's argument is the seconds to keep it, 0 for never; an answer that wasn't stored is
    stored, a hit doesn't extend it, and the last moment still hits."""

    def answer(self, held: list[int], us: int, seconds: int) -> tuple[list[int], bool]:
        if not seconds:
            return held, False
        if held and us <= held[0]:
            return held, True
        return [us + seconds * 1_000_000], False

    def until(self, held: list[int]) -> int:
        return held[0]


#: Seconds that an answer is kept, by its route; others are never kept.
ROUTE_SECONDS = {
    "identity": 86400, "overview": 21600, "guidance": 3600, "procedural": 3600, "pricing": 900, "unsupported": 0, "clarification": 0,
}


def seconds_of(route: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROUTE_SECONDS.items() for x in kv)), route), F.lit(0)).cast("long")


def _keyed(events: DataFrame, key: str, order: str, arg: Column | None, ts: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    # no leading underscore: the state operator would rename such a column
    return events.select(F.col(key).alias(key), F.col(order).alias(order), at.alias("at_time"), F.unix_micros(at).alias("at_us"), (F.lit(0).cast("long") if arg is None else arg).alias("at_arg"))


def folded(events: DataFrame, rule, key: str, order: str, to: str, arg: Column | None = None, ts: str = "ts") -> DataFrame:
    """(key, order, to): the rule's answer to each event, in the order of (ts, order) of its key. Events without time are not answered."""
    d = _keyed(events, key, order, arg, ts).where("at_us IS NOT NULL").drop("at_time").repartition(key).sortWithinPartitions(key, "at_us", order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, now = [], object()
        for b in batches:
            out = []
            for k, us, a in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != now:
                    held, now = [], k
                held, yes = rule.answer(held, us, a)
                out.append(yes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=[key, order, to])

    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.mapInArrow(run, f"`{key}` {kind[key]}, `{order}` {kind[order]}, `{to}` boolean")


class _InOrder(StatefulProcessor):
    def __init__(self, rule, kind: str, names: list[str]) -> None:
        self.rule, self.kind, self.names = rule, kind, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long")
        self.waiting = handle.getListState("waiting", f"us long, id {self.kind}, arg long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)  # the watermark, in milliseconds, has then passed it

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        new = [(int(us), i, int(a)) for p in rows for us, i, a, close in zip(p["at_us"], p[self.names[1]].tolist(), p["at_arg"], p["at_end"], strict=True) if not close]
        if new:
            self.waiting.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(map(tuple, self.waiting.get()))
        due, later = [w for w in waiting if w[0] < passed], [w for w in waiting if w[0] >= passed]
        held = [h[0] for h in self.held.get()]
        out = []
        for us, i, a in due:
            held, yes = self.rule.answer(held, us, a)
            out.append((key[0], i, yes))
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self._wake(later[0][0])
        if held and not later and self.rule.until(held) < passed:
            held = []
        if held:
            self.held.put([(h,) for h in held])
            if due and not later:
                self._wake(self.rule.until(held))
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def answered(stream: DataFrame, rule, key: str, order: str, to: str, arg: Column | None = None, ts: str = "ts", delay: str = "1 day", ends: DataFrame | None = None) -> DataFrame:
    """folded's answers to a stream of events, each given when the watermark has passed it. Events that come more than delay
    late may be dropped, as behind any watermark. ends: a stream of (ts) that are no events and only move the watermark."""
    d = _keyed(stream, key, order, arg, ts).where("at_us IS NOT NULL").withColumn("at_end", F.lit(False))
    if ends is not None:
        at = F.col("ts").cast("timestamp")
        e = ends.select(F.lit(None).cast(d.schema[key].dataType).alias(key), F.lit(None).cast(d.schema[order].dataType).alias(order), at.alias("at_time"), F.unix_micros(at).alias("at_us"), F.lit(0).cast("long").alias("at_arg"), F.lit(True).alias("at_end"))
        d = d.unionByName(e)
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    rule = _InOrder(rule, kind[order], [key, order, to])
    return d.withWatermark("at_time", delay).groupBy(key).transformWithStateInPandas(rule, f"`{key}` {kind[key]}, `{order}` {kind[order]}, `{to}` boolean", "append", "eventTime")


def state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs Spark's RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def answer_files(spark: SparkSession, path: str, schema: str, rule, key: str, order: str, to: str, arg: Column | None = None, ts: str = "ts", delay: str = "1 day", files: int = 4, folder: str | None = None, ended: bool = True) -> str:
    """Streams the event files of path through the rule until they are used up, and returns the folder with the answers
    (`answers`) and the checkpoint. Called again with that folder it goes on with new files. ended: nothing more comes, so
    the last events are answered too: a second start on the same checkpoint reads an end later than any event."""
    state_store(spark)
    folder = folder or new_folder(spark, to)
    end = "ts timestamp"
    spark.createDataFrame([], end).write.mode("append").parquet(f"{folder}/ends")

    def start() -> None:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        out = answered(events, rule, key, order, to, arg, ts, delay, spark.readStream.schema(end).parquet(f"{folder}/ends"))
        out.writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    start()
    if ended:
        spark.sql("SELECT timestamp'2250-01-01' AS ts").coalesce(1).write.mode("append").parquet(f"{folder}/ends")
        start()
    return folder


def answers(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/answers")
