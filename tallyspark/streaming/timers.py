"""Work that is due a while after an event: the second look after an upload, uploads that get no answer, and values that have come to rest.

Each comes as a plan over a table and as the same over a stream, where the watermark is the clock: what is due at a time is given out once no event
from before it can come any more, whatever the batches were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

# Seconds after an upload at which the list is looked at again, and of rest after which a setting is saved.
SECOND_LOOK, REST = 10, 0.3
_DUE = "key string, at timestamp, kind string"


def _after(time: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + F.lit(round(seconds * 1_000_000)))


def refreshes(done: DataFrame, seconds: float = SECOND_LOOK) -> DataFrame:
    """(key, at, kind) for uploads that ended well (key, ts): a refresh ``now`` for each, and one ``later``, ``seconds`` on, unless another upload of
    the key ends until then and so takes its place. Rows without a time ask for nothing; a null key is a key of its own."""
    rows = done.where("ts is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    following = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    last = rows.distinct().withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") > _after(F.col("ts"), seconds)))
    return rows.select("key", F.col("ts").alias("at"), F.lit("now").alias("kind")).unionByName(last.select("key", _after(F.col("ts"), seconds).alias("at"), F.lit("later").alias("kind")))


def unanswered(events: DataFrame, seconds: float) -> DataFrame:
    """(key, at, kind) for uploads (key, ts, kind of upload event): ``unanswered`` at the end of ``seconds`` in which an upload that was started, or tried again,
    neither ended nor was tried again. Null keys are one key; rows without a time or kind play no part."""
    rows = events.where("ts is not null and kind is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("kind").isin("started", "retried"), 1).when(F.col("kind").isin(*ENDS), 0).alias("open")).where("open is not null")
    rows = rows.groupBy("key", "ts").agg(F.min("open").alias("open"))  # an end counts before a start of the same time
    rows = rows.withColumn("_next", F.lead("ts").over(Window.partitionBy("key").orderBy("ts")))
    due = _after(F.col("ts"), seconds)
    return rows.where((F.col("open") == 1) & (F.col("_next").isNull() | (F.col("_next") > due))).select("key", due.alias("at"), F.lit("unanswered").alias("kind"))


#: Upload events that end one.
ENDS = ("finalized", "failed", "removed")


def _due_stream(rows: DataFrame, late: str, seconds: float, at_once: str | None, then: str) -> DataFrame:
    """Keyed state of the times that aren't decided yet. ``rows``: (key, ts, open); a time that opens is due ``seconds`` on, unless another time comes before.

    State holds a key's times of the last ``seconds`` and of the watermark's delay, and nothing once they are decided."""
    delay = round(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known: dict[int, int] = dict(zip(*state.get)) if state.exists else {}
        out: list[tuple] = []
        if not state.hasTimedOut:
            for batch in batches:
                for ts, opens in zip(batch["ts"], batch["open"]):
                    known[ts.value // 1000] = min(known.get(ts.value // 1000, 1), int(opens))
                    if at_once:
                        out.append((key[0], ts, at_once))
        clock, times = state.getCurrentWatermarkMs(), sorted(known)  # in microseconds, as Spark keeps them
        for i, t in enumerate(times):
            if t + delay >= 1000 * clock:  # a time that comes before it is due may still arrive
                times = times[i:]
                break
            if known[t] and (i + 1 == len(times) or times[i + 1] > t + delay):
                out.append((key[0], pd.Timestamp(t + delay, unit="us"), then))
        else:
            times = []
        if times:
            state.update((times, [known[t] for t in times]))
            state.setTimeoutTimestamp(max((times[0] + delay) // 1000, clock) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "kind"])

    return rows.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, _DUE, "times array<long>, opens array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def refreshes_stream(done: DataFrame, late: str = "1 minute", seconds: float = SECOND_LOOK) -> DataFrame:
    """``refreshes`` of a stream: each ``now`` at once, a ``later`` when its time has come. Appends only."""
    rows = done.where("ts is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("open"))
    return _due_stream(rows, late, seconds, "now", "later")


def unanswered_stream(events: DataFrame, seconds: float, late: str = "1 minute") -> DataFrame:
    """``unanswered`` of a stream, each given out when its time has come. Appends only."""
    opens = F.when(F.col("kind").isin("started", "retried"), 1).when(F.col("kind").isin(*ENDS), 0)
    rows = events.where("ts is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), opens.alias("open")).where("open is not null")
    return _due_stream(rows, late, seconds, None, "unanswered")


def settled(changes: DataFrame, values: tuple[str, ...], seconds: float = REST, late: str | None = None, order: str = "ts") -> DataFrame:
    """(key, at, values..): the last values, by ``order``, of each run of changes (key, ts, ..) that come within ``seconds`` of each other, and when they came to rest.

    On a stream give ``late``: a run is given out when the watermark has passed its end. A table and a stream give the same rows."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    window = F.session_window("ts", f"{round(seconds * 1000)} milliseconds").alias("w")
    last = rows.groupBy("key", window).agg(F.max_by(F.struct(*values), order).alias("last"))
    return last.select("key", F.col("w.end").alias("at"), *(F.col(f"last.{v}").alias(v) for v in values))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream that only appends over all that its source has, into a Parquet table; the table, read."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
