"""The label stream against the batch result: files in any order, a restart between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.sources.tables import ticks
from bookflow.streaming import labels as st


@pytest.fixture
def spark_with_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    yield st.stateful(spark)
    spark.conf.unset(key)


def rows(df):
    return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def by_hand(days):
    """The composed result for {date: labels} by plain counting."""
    to = lambda x: x if x in (-1, 0, 1) else 0
    t = np.zeros((3, 3), int)
    for labels in days.values():
        for a, b in zip(labels, labels[1:]):
            t[to(a) + 1, to(b) + 1] += 1
    every = [x for labels in days.values() for x in labels]
    out = [("range", min(days), max(days), len(days), None), ("distribution", "total", None, len(every), 100.0)]
    for k, name in ((-1, "Down"), (0, "Stable"), (1, "Up")):
        out.append(("distribution", name, None, every.count(k), 100 * every.count(k) / len(every)))
        out += [("day", d, name, x.count(k), 100 * x.count(k) / len(x)) for d, x in days.items()]
        out += [("transition", str(k), str(j), int(t[k + 1, j + 1]), t[k + 1, j + 1] / max(1, t[k + 1].sum())) for j in (-1, 0, 1)]
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out), key=str)


def frame(spark, days):
    return spark.createDataFrame([(d, k, x) for d, labels in days.items() for k, x in enumerate(labels)], "date string, seq long, label int")


def test_batch_equals_plain_counting(spark):
    rng = np.random.default_rng(0)
    days = {f"2025-01-0{d}": [int(x) for x in rng.choice([-1, 0, 1, 7], size=n)] for d, n in ((1, 1), (2, 40), (3, 300))}
    assert rows(st.report(st.day_counts(frame(spark, days).repartition(7)))) == by_hand(days)


def test_days_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(st, "halo", lambda df, n, f=st.halo: f(df, n, 16))
    days = {"a": [-1, 0, 1, 1, 0] * 20, "b": [1] * 33}
    assert rows(st.report(st.day_counts(frame(spark, days)))) == by_hand(days)


def replay(spark, table, tmp_path, files):
    """`table` as that many files, by a hash and so out of order; the stream stops after the first half of them."""
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    parts = table.select("date", "seq", "label").withColumn("part", F.pmod(F.xxhash64("date", F.floor(F.col("seq") / 5)), F.lit(files)))
    table_schema = "date string, seq long, label int"
    for half in (0, 1):
        parts.where(F.col("part") % 2 == half).repartition(files // 2, "part").drop("part").write.mode("append").parquet(src)
        stream = spark.readStream.schema(table_schema).option("maxFilesPerTrigger", 3).parquet(src)
        st.into_versions(st.stream_day_counts(stream), out, at).awaitTermination()
    return st.latest(spark, out)


def test_stream_with_restart_equals_batch(spark_with_state, tmp_path):
    spark = spark_with_state
    table = ticks(spark, "/root/testdata/sf0.01").select("date", "seq", F.col("label").cast("int").alias("label")).cache()
    assert rows(st.report(replay(spark, table, tmp_path, 8))) == rows(st.report(st.day_counts(table)))


def test_stream_with_unknown_labels(spark_with_state, tmp_path):
    spark = spark_with_state
    days = {"a": [0, 5, 1, -1, 9, 9], "b": [1]}
    assert rows(st.report(replay(spark, frame(spark, days), tmp_path, 4))) == by_hand(days)
