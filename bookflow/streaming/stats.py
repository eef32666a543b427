"""The mergeable statistics over an unbounded table: each micro-batch is reduced to moments, which Spark keeps as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.stats import finite, pearson


def running_signal_stats(long: DataFrame) -> DataFrame:
    """Per signal and date: finite values, mean, population deviation, extremes, r with the label. For complete or update mode; state is a row a group."""
    v = finite(F.col("value"))
    return long.groupBy("date", "signal").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), pearson(v, F.col("label").cast("double")).alias("r"))


def windowed_stats(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows of (ts, value): count, mean and deviation; windows close `late` behind the newest event and their state goes."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy(frame.alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return got.select("w.start", "w.end", "n", "mean", "std")


def day_rows(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A directory of Parquet files as a stream, `per_trigger` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def into_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to a Parquet table, exactly once, and ends when the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
