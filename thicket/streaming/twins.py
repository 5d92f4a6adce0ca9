"""Structured Streaming twins: the batch statistics kept fresh.

The batch operators have no event time; here it is added, with watermarks that bound state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from thicket.operators.graphbuild import chunks
from thicket.sources.files import RECORD_END, decoded, records


def read_stream(spark, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as the timestamp type that watermarks accept."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def refresh(
    stream: DataFrame, statistic: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None],
    checkpoint: str, every: str = "2 seconds", once: bool = False, failed: Callable[[DataFrame, int, Exception], None] | None = None,
) -> StreamingQuery:
    """Compute a statistic on every micro-batch and publish it.

    ``publish`` gets the statistic of one batch and its number, and adds it to what it keeps. A
    batch that fails is not committed: the query ends with the error and a restart does the batch
    again. With ``failed``, which must keep the batch's rows (a reject table), the stream goes on.
    """

    def run(batch: DataFrame, number: int) -> None:
        try:
            publish(statistic(batch), number)
        except Exception as error:
            if failed is None:
                raise
            failed(batch, number, error)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def daily_counts(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Logins per day; distinct users are approximate, as exact ones cannot be kept incrementally."""
    return (
        timed(log).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("total_logins"),
            F.count_if(F.col("status") == 1).alias("success_logins"),
            F.count_if(F.col("status") == 0).alias("failed_logins"),
            F.approx_count_distinct("user_id").alias("unique_users"),
        )
        .select(F.to_date("window.start").alias("date"), "total_logins", "success_logins", "failed_logins", "unique_users")
    )


def daily_users(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Logins per closed day with its exact number of users.

    State holds one row per user of a day that is still open; when the watermark has passed the day,
    these rows are emitted once and counted. Rows later than ``late`` are not counted, as elsewhere.
    """
    per_user = (
        timed(log).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "user_id")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == 1).alias("success"), F.count_if(F.col("status") == 0).alias("failed"))
    )
    days = per_user.groupBy(F.window(F.window_time("window"), "1 day")).agg(
        F.sum("total").alias("total_logins"), F.sum("success").alias("success_logins"), F.sum("failed").alias("failed_logins"),
        F.count("user_id").alias("unique_users"),
    )
    return days.select(F.to_date("window.start").alias("date"), "total_logins", "success_logins", "failed_logins", "unique_users")


def suspicious(log: DataFrame, threshold: int = 5, span: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Users and addresses with many failures in a sliding window."""
    return (
        timed(log).where(F.col("status") == 0).withWatermark("ts", late)
        .groupBy(F.window("ts", span, slide), "username", "login_ip")
        .agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_attempt"))
        .where(F.col("failures") >= threshold)
        .select(F.col("window.start").alias("since"), "username", "login_ip", "failures", "last_attempt")
    )


class _Rate(StatefulProcessor):
    """Keeps the last sample of a host. Samples older than it are passed on as late ones, without a rate.

    A host's rows of one micro-batch are held as three arrays of numbers and sent on in pieces.
    """

    #: Rows that are sent on at once.
    PIECE = 100_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, value double, id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["ts"].to_numpy().astype("datetime64[us]"), r["id"].to_numpy(), r["value"].to_numpy(dtype=float)) for r in rows]
        ts, ids, value = (np.concatenate(column) for column in zip(*parts, strict=True))
        order = np.lexsort((ids, ts))
        ts, ids, value = ts[order], ids[order], value[order]
        tick = ts.view("i8")
        late = np.zeros(len(ts), bool)
        late[1:] = (tick[1:] == tick[:-1]) & (ids[1:] == ids[:-1])
        previous = self.last.get() if self.last.exists() else None
        if previous is not None:
            last = np.datetime64(pd.Timestamp(previous[0]), "us")
            late |= (ts < last) | ((tick == last.astype("i8")) & (ids <= int(previous[2])))
        new = np.flatnonzero(~late)
        rate = np.full(len(ts), np.nan)
        if len(new):
            before, held = (last, float(previous[1])) if previous is not None else (ts[new[0]], value[new[0]])
            gap = np.diff(ts[new], prepend=before)
            seconds = np.where(np.isnat(gap), 0.0, gap.astype("i8") / 1e6)
            with np.errstate(divide="ignore", invalid="ignore"):
                change = np.diff(value[new], prepend=held) / seconds
            rate[new] = np.where((seconds > 0) & (change > 0), change, 0.0)
            at = new[-1]
            self.last.update((pd.Timestamp(ts[at]).to_pydatetime(), float(value[at]), int(ids[at])))
        for a in range(0, len(ts), self.PIECE):
            some = slice(a, a + self.PIECE)
            yield pd.DataFrame({"host": key[0], "id": ids[some], "ts": ts[some], "value": value[some], "rate": rate[some], "late": late[some]})

    def close(self) -> None:
        pass


def counter_rates(samples: DataFrame) -> DataFrame:
    """Rate of change per host with the previous sample kept as state between micro-batches.

    Every sample gives one row: a sample older than the last reported one is ``late`` and has no rate, so
    rows reported and rows rejected add up to rows read. A host's rows of one micro-batch are handled
    together, so bound the batch at the source (``per_trigger``) when hosts report a lot.
    """
    rows = timed(samples).select("host", "id", "ts", F.col("counter").cast("double").alias("value"))
    return rows.groupBy("host").transformWithStateInPandas(
        statefulProcessor=_Rate(),
        outputStructType="host string, id bigint, ts timestamp, value double, rate double, late boolean",
        outputMode="append",
        timeMode="None",
    )


def file_chunks(spark, path: str, **chunking) -> DataFrame:
    """Chunks of text files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    docs = files.select(F.xxhash64("path").alias("doc_id"), decoded(F.col("content")).alias("text"))
    return chunks(docs, **chunking)


def record_chunks(spark, path: str, **chunking) -> DataFrame:
    """Chunks of the documents in record files (``files.write_records``) as the files arrive; the name is the document's id."""
    raw = spark.readStream.format("text").option("lineSep", RECORD_END).schema("value string").load(path)
    docs = records(raw).select(F.col("path").alias("doc_id"), F.col("content").alias("text"))
    return chunks(docs, **chunking)


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a parquet folder, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
