"""A stored dataset: a table partitioned by split and date, of which single days are rewritten and a run of days is read.

    store(days, path)                     rewrites exactly the days it is given
    sizes(spark, path)                    rows of each stored day, from the table of sizes beside it
    until(spark, path, "train", 50_000)   the first days of a split until so many rows are reached

A day's rows are counted as they are written, into a small table with the same partitions. Which days a
prefix needs is then decided on that table, and the read is joined to it, so Spark prunes the folders of all other days when it
runs (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["split", "date"]


def store(days: DataFrame, path: str) -> None:
    """Writes whole days (split, date, ...) over what is stored of them; other days stay. Writing a day again changes nothing."""
    rows = path.rstrip("/") + "/rows"
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(rows)
    # counted from what is stored: footers alone are read
    spark = days.sparkSession
    written = spark.read.parquet(rows).join(F.broadcast(days.select(*KEYS).distinct()), KEYS)  # a row a day
    written.groupBy(*KEYS).agg(F.count("*").alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path.rstrip("/") + "/sizes")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(split, date, n) of each stored day."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path.rstrip("/") + "/sizes").select(F.col("split").cast("string").alias("split"), F.col("date").cast("string").alias("date"), "n")


def chosen(spark: SparkSession, path: str, split: str, most: int) -> DataFrame:
    """(split, date, n, before) of a split's first days, until `most` rows are reached; the day that reaches them is the last, whole."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row a day
    return sizes(spark, path).where(F.col("split") == split).withColumn("before", before).where(F.col("before") < most)


def until(spark: SparkSession, path: str, split: str, most: int) -> DataFrame:
    """The rows of those days."""
    rows = spark.read.parquet(path.rstrip("/") + "/rows")
    rows = rows.withColumn("date", F.col("date").cast("string")) if dict(rows.dtypes)["date"] != "string" else rows
    days = chosen(spark, path, split, most).select("split", "date")
    return rows.join(F.broadcast(days), KEYS)  # a row a day
