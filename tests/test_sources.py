"""Per-day NumPy files, streaming statistics and the entry module."""

import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import quality as q
from bookflow.operators.frames import long_form
from bookflow.sources import days as stored
from bookflow.sources import npy
from bookflow.streaming import stats as st


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(0)
    for split, days in (("train", 3), ("val", 1)):
        at = tmp_path / split
        at.mkdir()
        for d in range(days):
            x = rng.normal(size=(20, 4, 98)).astype(np.float32)
            x[0, -1, 0] = np.nan
            np.save(at / f"2025-01-0{d + 1}_sequences.npy", x)
            np.save(at / f"2025-01-0{d + 1}_labels.npy", rng.integers(-1, 2, (20, 2)).astype(np.int8))
    test = tmp_path / "test"
    test.mkdir()
    np.save(test / "2025-02-01_features.npy", np.arange(500 * 98, dtype=np.float32).reshape(500, 98))
    np.save(test / "2025-02-01_labels.npy", rng.integers(-1, 2, 50).astype(np.int8))
    np.save(test / "2025-02-02_features.npy", np.zeros((10, 98), np.float32))
    return str(tmp_path)


def test_inventory(root):
    assert npy.structure(root) == ["train", "val", "test"]
    assert npy.layout(root, "train") == "sequences" and npy.layout(root, "test") == "features"
    assert npy.dates(root, "test") == ["2025-02-01", "2025-02-02"] and npy.unlabelled(root, "test") == ["2025-02-02"]
    assert npy.dates(root, "none") == []
    sizes = npy.file_sizes(root)
    assert sizes["train"]["n_samples"] == 60 and sizes["total"]["bytes"] == (60 + 20 + 510) * 98 * 4
    with pytest.raises(FileNotFoundError):
        npy.layout(root, "none")
    with pytest.raises(FileNotFoundError):
        npy.structure(root + "/none")


def test_read_aligned(spark, root):
    rows = npy.read_aligned(spark, root)
    assert {(r.split, r["count"]) for r in rows.groupBy("split").count().collect()} == {("train", 60), ("val", 20), ("test", 50)}
    # label i of the sample files takes row 10 i + 99, at most the last
    got = {r.seq: r.features[0] for r in rows.where("split = 'test'").collect()}
    assert all(got[i] == min(10 * i + 99, 499) * 98 for i in range(50))
    labelled = npy.horizon(rows.where("split = 'train'"), 1)
    assert labelled.count() == 60
    with pytest.raises(ValueError):
        npy.horizon(rows.where("split = 'train'"), 2)
    with pytest.raises(ValueError):
        npy.horizon(rows.where("split = 'train'"), -1)
    wide = npy.named(rows.where("split = 'train'"), ["ask_price_l0", "true_ofi"])
    quality = q.data_quality(long_form(wide, ["ask_price_l0", "true_ofi"], ("date", "seq"))).first()
    assert quality.nan_count == 3 and quality.columns_with_nan == ["ask_price_l0"]


def test_only_the_days_asked_for_are_opened(spark, root, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, Not

    seen = []
    monkeypatch.setattr(npy, "opened", lambda path, f=npy.opened: seen.append(path) or f(path))

    def read(filters, kind="features", **options):
        seen.clear()
        reader = npy._PushingReader(root, kind, **options)
        rest = list(reader.pushFilters(filters))
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        return rest, {(b.column("split")[0].as_py(), b.column("date")[0].as_py()) for b in batches}, len(set(seen))

    for kind in ("features", "labels"):
        assert read([EqualTo(("date",), "2025-01-02")], kind) == ([], {("train", "2025-01-02")}, 1)
        assert read([], kind, splits="train", dates="2025-01-02,2025-01-03") == ([], {("train", "2025-01-02"), ("train", "2025-01-03")}, 2)
        assert read([In(("split",), ("val", "test"))], kind)[1:] == ({("val", "2025-01-01"), ("test", "2025-02-01")}, 2)
        assert read([Not(EqualTo(("split",), "train")), LessThanOrEqual(("date",), "2025-01-31")], kind)[1:] == ({("val", "2025-01-01")}, 1)
    other = [GreaterThan(("seq",), 3), IsNull(("date",))]
    rest, days, n = read([*other, GreaterThan(("date",), "2025-01-02")])
    assert rest == other and days == {("train", "2025-01-03"), ("test", "2025-02-01")} and n == 2
    samples, labels = npy.read_days(spark, root)
    two = [samples.where(f"date = '{d}' and split = 'train'").groupBy("date").agg(F.count("*").alias("n")) for d in ("2025-01-01", "2025-01-02")]
    assert sorted(r.date for r in two[0].union(two[1]).collect()) == ["2025-01-01", "2025-01-02"]
    assert npy.read_aligned(spark, root, splits=["train"], dates=["2025-01-02"]).count() == 20
    with pytest.raises(ValueError):
        npy.read_aligned(spark, root, splits=["none"])
    samples, labels = npy.read_days(spark, root, push=True)
    one = samples.where("date = '2025-01-02' and split = 'train' and seq >= 5")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 15
    x = np.load(f"{root}/train/2025-01-02_sequences.npy")
    got = {r.seq: r.features for r in one.collect()}
    assert all(np.array_equal(np.float32(got[k]), x[k, -1]) for k in range(5, 20))
    assert {len(r.labels) for r in labels.where("split = 'train'").collect()} == {2}


def test_inventory_through_spark(spark, root):
    want = sorted((s, d, k, n) for s, d, k, _, n in npy.inventory(root))
    assert sorted((r.split, r.date, r.kind, r.bytes) for r in npy.files(spark, "file://" + root).collect()) == want
    assert npy.header(spark, f"{root}/test/2025-02-01_features.npy")[1:] == ((500, 98), np.dtype("<f4"))
    got = {r.split or "total": (r.n_days, r.n_samples, r.bytes) for r in npy.sizes(spark, root).collect()}
    assert got == {k: tuple(int(v[c]) for c in ("n_days", "n_samples", "bytes")) for k, v in npy.file_sizes(root).items()}
    plan = npy.sizes(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_stored_days(spark, tmp_path):
    at = str(tmp_path / "set")
    make = lambda days, value: spark.createDataFrame([(s, d, k, value) for s, d, n in days for k in range(n)], "split string, date string, seq long, value double")
    days = [("train", f"2025-01-{d:02}", 10 * d) for d in range(1, 7)] + [("val", "2025-01-01", 5)]
    stored.store(make(days, 1.0), at)
    read = lambda: sorted((r.split, str(r.date), r.n, r.s) for r in spark.read.parquet(at + "/rows").groupBy("split", "date").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect())
    first = read()
    for _ in range(2):  # writing a day again changes nothing
        stored.store(make([days[2]], 1.0), at)
        assert read() == first and sorted((r.split, r.date, r.n) for r in stored.sizes(spark, at).collect()) == sorted(days)
    stored.store(make([("train", "2025-01-03", 7)], 2.0), at)
    assert [x for x in read() if x[:2] == ("train", "2025-01-03")] == [("train", "2025-01-03", 7, 14.0)] and len(read()) == len(days)
    # 10 + 20 + 7 + 40 rows: the fourth day reaches 50
    got = stored.until(spark, at, "train", 50)
    assert sorted({str(r.date) for r in got.collect()}) == [f"2025-01-0{d}" for d in range(1, 5)] and got.count() == 77
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert stored.until(spark, at, "train", 0).count() == 0 and stored.until(spark, at, "none", 9).count() == 0 and stored.until(spark, at, "train", 10**9).count() == 10 + 20 + 7 + 40 + 50 + 60


def test_streaming_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").alias("date"), F.lit("v").alias("signal"), "value", (F.col("event_id") % 3 - 1).cast("int").alias("label"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = st.day_rows(spark, str(tmp_path / "in"), "date date, signal string, value double, label int")
    query = st.running_signal_stats(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.date: r for r in spark.table("running").collect()}
    for r in st.running_signal_stats(rows).collect():
        assert got[r.date].n == r.n and got[r.date].mean == pytest.approx(r.mean) and got[r.date].std == pytest.approx(r.std)


def test_windows_close_behind_the_watermark(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.day_rows(spark, str(tmp_path / "in"), "ts timestamp, value double")
    st.into_parquet(st.windowed_stats(stream, "6 hours"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.start: r.n for r in rows.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("value").alias("n")).select("w.start", "n").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 2


def test_entry_without_the_training_data_folders(monkeypatch):
    """The entry module imports and lists the rest when that subpackage and the pipeline are gone."""
    entry = importlib.import_module("__spark_entry__")
    for name in [n for n in sys.modules if n.startswith("bookflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("bookflow.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    names = set(entry.queries())
    assert "signal_day_stability" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names


def test_entry(spark, sf, monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setenv("ENTRY_SF_DIR", sf)
    assert entry.entry(spark).count() == 3
