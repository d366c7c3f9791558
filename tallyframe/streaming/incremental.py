"""Structured Streaming: deduplicated logs, windowed counts, breakers and incremental upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.operators.merging import upsert


def stream_of(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_by_key(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def breaker(stream: DataFrame, key: str, failed: str, limit: int = 50) -> DataFrame:
    """(key, run, open): the number of failures in a row of each key; open once it reaches the limit. State is one number."""

    def update(k, frames, state: GroupState):
        run = state.get[0] if state.exists else 0
        peak = run
        for f in frames:
            for bad in f[failed]:
                run = run + 1 if bad else 0
                peak = max(peak, run)
        state.update((run,))
        yield pd.DataFrame({key: [k[0]], "run": [run], "open": [peak >= limit]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, run long, open boolean", "run long", "update", GroupStateTimeout.NoTimeout)


def stalled(progress: DataFrame, time: str, seconds: int) -> DataFrame:
    """(last, gap, stalled): whether nothing was done for so long before now."""
    last = progress.agg(F.max(time).alias("last"))
    gap = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("last")
    return last.select("last", gap.alias("gap"), (gap > seconds).alias("stalled"))


def upsert_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Each micro-batch replaces its keys in the table at ``path``, version by version; a batch that is repeated writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        upsert(old, batch.dropDuplicates(keys), keys).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class Progress:
    """Rows done, rate and the latest batch of running queries, from Spark's own progress events."""

    def __init__(self, spark: SparkSession):
        from pyspark.sql.streaming import StreamingQueryListener

        progress = self
        self.rows, self.batches, self.rate = 0, 0, 0.0

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                progress.rows += event.progress.numInputRows
                progress.batches += 1
                progress.rate = event.progress.processedRowsPerSecond

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        self.listener = Listener()
        spark.streams.addListener(self.listener)
        self.spark = spark

    def stop(self) -> None:
        self.spark.streams.removeListener(self.listener)
