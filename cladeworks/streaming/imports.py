"""Message-driven stages as structured streams: dataset events arrive as files, each triggers one stage.

A control folder receives small JSON events (dataset, stage, attempt). A stream drops repeats of an
event within a watermark and hands each micro-batch to a handler; handlers are the same batch functions
that a job would call, and write by whole data sets, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "dataset string, stage string, attempt int, ts timestamp"
STAGES = ("normalize", "import", "analyze", "match", "index", "delete")


def events(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """The stream of events without repeats that arrive within ``delay``."""
    stream = spark.readStream.schema(EVENT).json(folder)
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dataset", "stage", "attempt"])


def dispatch(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Run a handler on each micro-batch's events of its stage, stages in their order; all that is there, then stop."""

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        try:
            for stage in (s for s in STAGES if s in handlers):
                mine = kept.filter(F.col("stage") == stage)
                if not mine.isEmpty():
                    handlers[stage](mine)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_datasets(rows: DataFrame, path: str, column: str = "dataset") -> None:
    """Write rows partitioned by data set and replace just the partitions that they hold: idempotent."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str, delay: str) -> DataFrame:
    """Counts per key and window; late rows within ``delay`` still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
