"""Label analysis of a split: one frame of distribution, days, transitions and autocorrelation, from a table or from a stream.

Both ways go through the same partials, a row per day: counts of labels and of steps from each label to the next. In a
stream they are kept by a stateful processor a day, which also holds labels that came before their predecessors, so files
may arrive in any order; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.frames import halo
from ..operators.labels import autocorrelation
from ..operators.quality import percent
from ..schema import LABELS

#: An unknown label steps as Stable; it counts in totals only.
STATES = sorted(LABELS)
_COUNTS = ["n", *[f"n_{k}" for k in range(3)], *[f"t_{a}{b}" for a in range(3) for b in range(3)]]
DAYS = "date string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _state(label):
    return F.coalesce(F.when(label.isin(STATES), label - STATES[0]), F.lit(-STATES[0]))


def day_counts(df: DataFrame) -> DataFrame:
    """(date, n, n_0.., t_00..) of labels (date, seq, label), seq from 0 in each day. Days are cut into blocks with a halo of one row."""
    rows = halo(df.select("date", F.col("seq").alias("gidx"), F.col("label").cast("int").alias("label")), 1)
    rows = rows.withColumn("_was", F.lag("label").over(Window.partitionBy("date", "_block").orderBy("gidx")))
    rows = rows.where("_own").withColumns({"_a": F.when(F.col("gidx") > 0, _state(F.col("_was"))), "_b": _state(F.col("label"))})
    own = {f"n_{k}": F.count_if(F.col("label") == s) for k, s in enumerate(STATES)}
    steps = {f"t_{a}{b}": F.count_if((F.col("_a") == a) & (F.col("_b") == b)) for a in range(3) for b in range(3)}
    return rows.groupBy("date").agg(F.count("*").alias("n"), *[e.alias(c) for c, e in (own | steps).items()])


class _Day(StatefulProcessor):
    """A day's counts, the next position and the last label; labels beyond a gap wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = ", ".join(f"{c} long" for c in _COUNTS)
        self.day = handle.getValueState("day", f"{counts}, next long, last int")
        self.waiting = handle.getMapState("waiting", "seq long", "label int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {int(s): int(x) for pdf in rows for s, x in zip(pdf["seq"], pdf["label"])}
        held = list(self.day.get()) if self.day.exists() else [0] * len(_COUNTS) + [0, -2]
        count, at, last = dict(zip(_COUNTS, held)), held[-2], held[-1]
        new = {s: x for s, x in new.items() if s >= at}  # what came twice counts once
        while True:
            if at in new:
                label = new.pop(at)
            elif self.waiting.containsKey((at,)):
                label = self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
            else:
                break
            state = label - STATES[0] if label in STATES else -STATES[0]
            count["n"] += 1
            if label in STATES:
                count[f"n_{state}"] += 1
            if at:
                count[f"t_{last}{state}"] += 1
            at, last = at + 1, state
        for s, x in new.items():
            self.waiting.updateValue((s,), (x,))
        self.day.update((*(int(count[c]) for c in _COUNTS), at, last))
        yield pd.DataFrame({"date": [key[0]], **{c: [count[c]] for c in _COUNTS}})

    def close(self) -> None:
        pass


def stream_day_counts(stream: DataFrame) -> DataFrame:
    """day_counts() of an unbounded table, a new row for each day that a micro-batch touches. Needs the RocksDB state store (`stateful`)."""
    rows = stream.select("date", F.col("seq").cast("long").alias("seq"), F.col("label").cast("int").alias("label"))
    return rows.groupBy("date").transformWithStateInPandas(statefulProcessor=_Day(), outputStructType=DAYS, outputMode="Update", timeMode="None")


def stateful(spark: SparkSession) -> SparkSession:
    """The session with the state store that arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def into_versions(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's days as a folder of its own, over itself when a batch is run again, and ends when the input is used up."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return days.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest counts of each day that into_versions() has written."""
    rows = spark.read.schema(f"{DAYS}, batch long").option("basePath", path).parquet(path)
    return rows.groupBy("date").agg(F.max_by(F.struct(*_COUNTS), "batch").alias("c")).select("date", "c.*")


def report(days: DataFrame) -> DataFrame:
    """(section, item, other, n, value), from a row per day: `range` (first and last date, days), `distribution` (label, count, percent), `transition` (from, to, count, probability), `day` (date, label, count, percent)."""
    names = [LABELS[s] for s in STATES]
    total = days.agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS])
    row = lambda section, item, other, n, value: F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), other.cast("string").alias("other"), n.alias("n"), value.cast("double").alias("value"))
    none, n = F.lit(None), F.col("n")
    out_of = lambda a: sum((F.col(f"t_{a}{b}") for b in range(3)), F.lit(0))
    whole = [row("range", F.col("first"), F.col("last"), F.col("days"), none)]
    whole += [row("distribution", F.lit("total"), none, n, percent(n, n)), *[row("distribution", F.lit(x), none, F.col(f"n_{k}"), percent(F.col(f"n_{k}"), n)) for k, x in enumerate(names)]]
    whole += [row("transition", F.lit(STATES[a]), F.lit(STATES[b]), F.col(f"t_{a}{b}"), F.coalesce(F.try_divide(F.col(f"t_{a}{b}").cast("double"), out_of(a)), F.lit(0.0))) for a in range(3) for b in range(3)]
    each = [row("day", F.col("date"), F.lit(x), F.col(f"n_{k}"), percent(F.col(f"n_{k}"), n)) for k, x in enumerate(names)]
    return total.select(F.inline(F.array(*whole))).unionByName(days.select(F.inline(F.array(*each))))


def label_analysis(df: DataFrame, max_lag: int = 100, listed: int = 20) -> DataFrame:
    """report() of labels (date, seq, gidx, label) with section `autocorrelation` (lag, value): the first `listed` lags from 0 on, as far as max_lag."""
    series = df.select(F.lit("label").alias("signal"), "gidx", F.col("label").cast("double").alias("value"))
    acf = autocorrelation(series, min(max_lag, listed - 1))
    none = F.lit(None)
    return report(day_counts(df)).unionByName(acf.select(F.lit("autocorrelation").alias("section"), F.col("lag").cast("string").alias("item"), none.cast("string").alias("other"), none.cast("long").alias("n"), F.col("acf").alias("value")))
