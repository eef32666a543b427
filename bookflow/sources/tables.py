"""Adapters from the driver's tables to the canonical frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import with_gidx

TICK_SIGNALS = ["v", "k", "dv"]
TRADE_SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def ticks(spark: SparkSession, sf_dir: str, band: float = 5.0, gidx: bool = True) -> DataFrame:
    """`events` as an ordered, labelled series: v the value, k the property, dv the change within the day; label the sign of the next change beyond a dead band; a day's last event has no label and goes. Without gidx the days' sizes are not counted, which saves a scan."""
    day = Window.partitionBy("date").orderBy("ts")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("ts").cast("date").cast("string").alias("date"), "ts", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    e = e.select(
        "*",
        (F.row_number().over(day) - 1).cast("long").alias("seq"),
        (F.col("v") - F.coalesce(F.lag("v").over(day), F.col("v"))).alias("dv"),
        (F.lead("v").over(day) - F.col("v")).alias("step"),
    ).where("step is not null")
    hour = F.hour("ts")
    samples = e.select(
        "date",
        "seq",
        F.when(F.col("step") > band, 1).when(F.col("step") < -band, -1).otherwise(0).alias("label"),
        F.when(hour < 6, 0).when(hour < 10, 1).when(hour < 16, 2).when(hour < 20, 3).otherwise(4).alias("regime"),
        *TICK_SIGNALS,
    )
    return with_gidx(samples) if gidx else samples


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as labelled samples without order: the return flag is the label, the ship month the day."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    label = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return t.select(F.date_format("l_shipdate", "yyyy-MM").alias("date"), label.alias("label"), *TRADE_SIGNALS)


def two_clocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples and labels of different lengths: `events` in time order (gidx, v, k), `orders` in key order (i, label), labelled by what they come to."""
    from ..operators.clocks import with_position

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("ts", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    samples = with_position(e, F.date_trunc("hour", "ts"), ["ts"]).select("gidx", "v", "k")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    label = F.when(F.col("o_totalprice") > 300_000, 1).when(F.col("o_totalprice") < 150_000, -1).otherwise(0)
    labels = with_position(o, F.floor(F.col("o_orderkey") / 65_536), ["o_orderkey"], out="i").select("i", label.alias("label"))
    return samples, labels


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` with every component as a signal e0, e1, ..., as many as the longest vector has."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    return v.select("vec_id", (F.pmod("label", F.lit(3)) - 1).cast("int").alias("label"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(width)])
