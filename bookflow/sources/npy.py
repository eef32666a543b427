"""A Spark data source for per-day NumPy files, and what can be told from a dataset's files alone.

    root/train/2025-01-01_sequences.npy   (N, 100, 98): only the last timestep is kept
    root/train/2025-01-01_features.npy    (N, 98): samples, aligned with the sparser labels by computed key
    root/train/2025-01-01_labels.npy      (M,) or (M, H)

`spark.read.format("npy_days").option("kind", "features").load(root)` reads a split's days with an input
partition per stretch of rows, memory-mapped, so a task reads its rows only, and hands them on as Arrow batches. Options splits
and dates (comma-separated) name what is read: no other file is opened, neither to plan nor to read. With option push the source
also takes filters on split and date (comparisons, lists, their negations) from the plan. That is off by default: Spark 4.1 keeps
pushed filters with the loaded source, not with the scan, so a frame that is used twice in a query under different filters
would give the rows of one of them; load it once for each use. Files are opened where the task runs: the root must be mounted on
every executor. Write the result once to Parquet, partitioned by split and date (`days.py`), and analyse that.

`files` and `sizes` need no mount: they list through Spark's own file systems and never read a file's content.
"""

from __future__ import annotations

import ast
import operator
import os
import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not

from ..operators.frames import aligned
from ..schema import FEATURES

SPLITS = ("train", "val", "test")
ROWS = 50_000  # rows of an input partition
BATCH = 4096  # rows of an Arrow batch
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def opened(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def inventory(root: str) -> list[tuple[str, str, str, str, int]]:
    """(split, date, kind, path, bytes) of a dataset's files; kind is sequences, features, labels or metadata."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    found = []
    for split in SPLITS:
        at = os.path.join(root, split)
        for name in sorted(os.listdir(at)) if os.path.isdir(at) else []:
            stem, ext = os.path.splitext(name)
            date, _, kind = stem.rpartition("_")
            if (ext == ".npy" and kind in ("sequences", "features", "labels")) or (ext == ".json" and kind == "metadata"):
                path = os.path.join(at, name)
                found.append((split, date, kind, path, os.path.getsize(path)))
    return found


def structure(root: str) -> list[str]:
    """The splits that exist; an error if there are none."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    got = [s for s in SPLITS if os.path.isdir(os.path.join(root, s))]
    if not got:
        raise ValueError(f"{root} has none of {', '.join(SPLITS)}")
    return got


def layout(root: str, split: str) -> str:
    """sequences or features: which kind of feature files a split has; sequences win where both are."""
    if not os.path.isdir(os.path.join(root, split)):
        raise FileNotFoundError(os.path.join(root, split))
    kinds = {k for s, _, k, _, _ in inventory(root) if s == split}
    for kind in ("sequences", "features"):
        if kind in kinds:
            return kind
    raise ValueError(f"no feature files in {split}")


def dates(root: str, split: str) -> list[str]:
    """Days with feature files, with or without labels; none for a split that is not there."""
    if not os.path.isdir(os.path.join(root, split)):
        return []
    rows = inventory(root)
    kind = "sequences" if any(s == split and k == "sequences" for s, _, k, _, _ in rows) else "features"
    return [d for s, d, k, _, _ in rows if s == split and k == kind]


def unlabelled(root: str, split: str) -> list[str]:
    """Days whose labels are missing; reading leaves them out."""
    have = {d for s, d, k, _, _ in inventory(root) if s == split and k == "labels"}
    return [d for d in dates(root, split) if d not in have]


def file_sizes(root: str) -> dict[str, dict[str, float]]:
    """Samples and bytes (98 four-byte features a sample) of each split and in total, from file headers alone."""
    out: dict[str, dict[str, float]] = {}
    for split in SPLITS:
        for date in dates(root, split):
            kind = layout(root, split)
            shape = np.load(os.path.join(root, split, f"{date}_{kind}.npy"), mmap_mode="r").shape
            for k in (split, "total"):
                x = out.setdefault(k, {"n_days": 0, "n_samples": 0, "bytes": 0})
                x["n_days"] += 1
                x["n_samples"] += shape[0]
                x["bytes"] += shape[0] * len(FEATURES) * 4
    return out


class _Stretch(InputPartition):
    def __init__(self, path: str, split: str, date: str, first: int, last: int):
        self.path, self.split, self.date, self.first, self.last = path, split, date, first, last


def _test(f: Filter) -> tuple[str, Callable[[str], bool]] | None:
    """The column and the test of a filter that file names alone decide."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (inner[0], lambda x: not inner[1](x))
    if getattr(f, "attribute", None) not in (("split",), ("date",)):
        return None
    if isinstance(f, In):
        return f.attribute[0], lambda x: x in f.value
    if type(f) in _COMPARE and isinstance(f.value, str):
        return f.attribute[0], lambda x: _COMPARE[type(f)](x, f.value)
    return None


class _Reader(DataSourceReader):
    def __init__(self, root: str, kind: str, splits: str = "", dates: str = ""):
        self.root, self.kind = root, kind
        self.taken: list[Filter] = [In((column,), tuple(x.split(","))) for column, x in (("split", splits), ("date", dates)) if x]

    def partitions(self) -> list[InputPartition]:
        rows = inventory(self.root)
        labelled = {(s, d) for s, d, k, _, _ in rows if k == "labels"}
        sequences = {s for s, _, k, _, _ in rows if k == "sequences"}
        tests = [_test(f) for f in self.taken]
        out: list[InputPartition] = []
        for split, date, kind, path, _ in rows:
            wanted = kind == "labels" if self.kind == "labels" else kind == ("sequences" if split in sequences else "features")
            if not wanted or not all(ok(split if column == "split" else date) for column, ok in tests):
                continue
            if (split, date) not in labelled:
                warnings.warn(f"{split}/{date} has no labels and is left out", stacklevel=2)
                continue
            n = opened(path).shape[0]
            out += [_Stretch(path, split, date, a, min(a + ROWS, n)) for a in range(0, n, ROWS)]
        return out or [_Stretch("", "", "", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Stretch)
        if not partition.path:
            return
        whole = opened(partition.path)
        for a in range(partition.first, partition.last, BATCH):
            x = whole[a : min(a + BATCH, partition.last)]
            if self.kind == "labels":
                x = np.asarray(x).reshape(len(x), -1).astype(np.int8)
            else:
                x = np.ascontiguousarray(x[:, -1] if x.ndim == 3 else x, np.float32)
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32))
            names = [pa.array([v]).take(pa.array(np.zeros(len(x), np.int32))) for v in (partition.split, partition.date)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.arange(a, a + len(x))), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["split", "date", "seq", "labels" if self.kind == "labels" else "features"])


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f):
                self.taken.append(f)
            else:
                yield f


class NpyDays(DataSource):
    """Format npy_days; options kind: features (default) or labels, splits, dates, push."""

    @classmethod
    def name(cls) -> str:
        return "npy_days"

    def schema(self) -> str:
        return f"split string, date string, seq long, {'labels array<tinyint>' if self.options.get('kind') == 'labels' else 'features array<float>'}"

    def reader(self, schema) -> DataSourceReader:
        made = _PushingReader if self.options.get("push") == "true" else _Reader
        return made(self.options["path"], *(self.options.get(k, v) for k, v in (("kind", "features"), ("splits", ""), ("dates", ""))))


def read_days(spark: SparkSession, root: str, splits: list[str] | None = None, dates: list[str] | None = None, push: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, labels) of all splits and days, or of some. push: see above; it switches on the session's filter push-down for Python sources."""
    structure(root)
    if push:
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(NpyDays)
    read = spark.read.format("npy_days").options(splits=",".join(splits or []), dates=",".join(dates or []), push=str(push).lower())
    return tuple(read.option("kind", k).load(root) for k in ("features", "labels"))  # type: ignore[return-value]


def read_aligned(spark: SparkSession, root: str, window: int = 100, stride: int = 10, splits: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """(split, date, seq, labels, features): a row per label. Sequence files pair row by row, sample files by computed key; each split is opened in its own way only."""
    sequences = {s for s, _, k, _, _ in inventory(root) if k == "sequences"}
    wanted = [s for s in structure(root) if splits is None or s in splits]
    cols, out = ["split", "date", "seq", "labels", "features"], []
    if by_row := [s for s in wanted if s in sequences]:
        samples, labels = read_days(spark, root, by_row, dates)
        out.append(labels.join(samples, ["split", "date", "seq"]).select(cols))
    if by_key := [s for s in wanted if s not in sequences]:
        out.append(aligned(*read_days(spark, root, by_key, dates), window, stride).select(cols))
    if not out:
        raise ValueError(f"none of {splits} in {root}")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def files(spark: SparkSession, root: str) -> DataFrame:
    """(split, date, kind, path, bytes) of a dataset's files on any file system that Spark reads; contents are not."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/([^/]+)_(sequences|features|labels|metadata)\.(npy|json)$", k)
    rows = found.select(part(1).alias("split"), part(2).alias("date"), part(3).alias("kind"), part(4).alias("_ext"), "path", "bytes")
    return rows.where(F.col("split").isin(*SPLITS) & ((F.col("_ext") == "npy") != (F.col("kind") == "metadata"))).drop("_ext")


def header(spark: SparkSession, path: str) -> tuple[int, tuple[int, ...], np.dtype]:
    """Bytes of an .npy file's header, the shape and the type, from its first bytes, through Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        read = lambda n: bytes(stream.read() for _ in range(n))
        start = read(10)
        wide = 2 if start[6] == 1 else 4
        length = int.from_bytes(start[8:10] + (read(2) if wide == 4 else b""), "little")
        said = ast.literal_eval(read(length).decode("latin1"))
    finally:
        stream.close()
    return 8 + wide + length, tuple(said["shape"]), np.dtype(said["descr"])


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """(split, n_days, n_samples, bytes) per split and in total (null split): rows from file lengths and the header of one file of each split, bytes as 98 four-byte features a row."""
    rows = files(spark, root).where(F.col("kind").isin("sequences", "features"))
    # sequences win where a split has both; as many rows as splits
    kinds = rows.groupBy("split").agg(F.max("kind").alias("kind"), F.min_by("path", F.struct(F.col("kind") != "sequences", "path")).alias("path")).collect()
    counts, wanted = F.lit(None).cast("long"), F.lit(False)
    for r in kinds:
        head, shape, kind = header(spark, r.path)
        row = max(1, int(np.prod(shape[1:])) * kind.itemsize)
        own = (F.col("split") == r.split) & (F.col("kind") == r.kind)
        counts, wanted = F.when(own, ((F.col("bytes") - head) / row).cast("long")).otherwise(counts), wanted | own
    n = rows.where(wanted).withColumn("_n", counts).rollup("split").agg(F.count("*").alias("n_days"), F.sum("_n").alias("n_samples"))
    return n.where("n_days > 0").withColumn("bytes", F.col("n_samples") * (len(FEATURES) * 4))


def horizon(df: DataFrame, h: int | None = 0) -> DataFrame:
    """Adds label: that of horizon h. Out of range, negative too, is an error."""
    if h is None:
        return df
    width = df.agg(F.min(F.size("labels"))).first()[0]
    if h < 0 or (width is not None and h >= width):
        raise ValueError(f"horizon {h} of {width}")
    return df.withColumn("label", F.col("labels")[h].cast("int"))


def named(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The feature array as columns by name, all or some of the 98: what to store, so that scans read only what they use."""
    rest = [c for c in df.columns if c != "features"]
    return df.select(*rest, *[F.col("features")[FEATURES.index(c)].alias(c) for c in columns or FEATURES])
