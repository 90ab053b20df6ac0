"""Readers and writers of vector files, attribute JSON, snapshots and exports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FORMAT_VERSION, IndexConfig, wire_to_columns

#: Bytes of a vector file that one task reads.
SPLIT_BYTES = 64 << 20


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", dim: int | None = None, count: int | None = None, byte_range: bool = False) -> DataFrame:
    """(label, vector) from records of an int32 length and as many 4-byte numbers.

    All records have one length, so the file is a sequence of fixed-size rows
    and every task reads its own range.  Spark's ``binaryFile`` source lists
    the file; its fixed-length record reader splits it.  Row headers, and for
    floats finite values, are checked; ``byte_range`` also asks for whole
    numbers from 0 to 255.
    """
    sc = spark.sparkContext
    if dim is None:
        probe = sc._jvm.org.apache.hadoop.fs.Path(path)
        stream = probe.getFileSystem(sc._jsc.hadoopConfiguration()).open(probe)
        try:
            dim = int.from_bytes(bytes(stream.read() for _ in range(4)), "little")
        finally:
            stream.close()
    width = 4 + 4 * dim
    if kind not in ("fvecs", "ivecs"):
        raise ValueError("kind is fvecs or ivecs")
    number = np.float32 if kind == "fvecs" else np.int32
    raw = spark.createDataFrame(sc.binaryRecords(path, width).zipWithIndex().map(lambda x: (x[1], bytearray(x[0]))), "label long, raw binary")
    if count is not None:
        raw = raw.where(F.col("label") < count)

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = np.frombuffer(b"".join(pdf["raw"]), np.uint8).reshape(len(pdf), width)
            if (rows[:, :4].copy().view(np.int32) != dim).any():
                raise ValueError("a row's length differs from the first")
            x = rows[:, 4:].copy().view(number)
            if kind == "fvecs" and not np.isfinite(x).all():
                raise ValueError("a component is not finite")
            if byte_range and ((x < 0) | (x > 255) | (x != np.floor(x))).any():
                raise ValueError("a component is not a whole number from 0 to 255")
            yield pd.DataFrame({"label": pdf["label"], "vector": list(x)})

    return raw.mapInPandas(parse, "label long, vector array<float>" if kind == "fvecs" else "label long, vector array<int>")


def vecs_bytes(df: DataFrame, column: str = "vector", order: str = "label", kind: str = "fvecs") -> DataFrame:
    """(label, raw): each row's record of a vector file."""
    number = np.float32 if kind == "fvecs" else np.int32

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"label": pdf["label"], "raw": [np.int32(len(v)).tobytes() + np.asarray(v, number).tobytes() for v in pdf["v"]]})

    return df.select(F.col(order).cast("long").alias("label"), F.col(column).alias("v")).mapInPandas(pack, "label long, raw binary")


def write_local(records: DataFrame, path: str, header: bytes = b"") -> None:
    """Records (label, raw) as one file in order of label, streamed partition by partition through the driver.

    A single flat file has one writer by its nature; large tables belong in Parquet.
    """
    with open(path, "wb") as f:
        f.write(header)
        for r in records.orderBy("label").toLocalIterator(prefetchPartitions=True):
            f.write(r["raw"])


def read_nested_json(spark: SparkSession, path: str, lines: bool = False, count: int | None = None) -> DataFrame:
    """(label, attrs) from nested integer lists [row][attr][value...].

    JSON lines split over tasks; one big array is a single document by its format.
    """
    kind = "array<array<int>>" if lines else "array<array<array<int>>>"
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        # Rows are numbered inside their partition and counted by partition, so no task holds them all.
        at = F.monotonically_increasing_id()
        rows = text.select(F.from_json("value", kind).alias("attrs"), F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
        rows = rows.join(F.broadcast(offsets), "part").select((F.col("off") + F.col("nth")).cast("long").alias("label"), "attrs")
    else:
        rows = text.select(F.posexplode(F.from_json("value", kind)).alias("label", "attrs")).select(F.col("label").cast("long").alias("label"), "attrs")
    return rows if count is None else rows.where(F.col("label") < count)


def read_truth(spark: SparkSession, path: str, k: int, n_queries: int | None = None) -> DataFrame:
    """(qid, rk, label) from nested lists [query][label...]: the first k columns, never reshaped."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<long>>")).alias("qid", "labels"))
    if n_queries is not None:
        rows = rows.where(F.col("qid") < n_queries)
    rows = rows.where(F.assert_true(F.size("labels") >= k, F.lit(f"a truth row has fewer than {k} labels")).isNull())
    return rows.select(F.col("qid").cast("long").alias("qid"), F.posexplode(F.slice("labels", 1, k)).alias("rk", "label")).select("qid", (F.col("rk") + 1).cast("long").alias("rk"), "label")


def load_bundle(vectors: DataFrame, attrs: DataFrame, cfg: IndexConfig, n: int | None = None) -> DataFrame:
    """Points from vectors (label, vector) and nested attributes (label, attrs); both need the same labels."""
    if n is not None:
        vectors, attrs = vectors.where(F.col("label") < n), attrs.where(F.col("label") < n)
    both = vectors.join(attrs, "label", "full")
    both = both.where(F.assert_true(F.col("vector").isNotNull() & F.col("attrs").isNotNull(), F.lit("vectors and attributes differ in length")).isNull())
    return both.select("label", "vector", *wire_to_columns(F.col("attrs"), cfg.attr_types), F.lit(False).alias("deleted"))


# -- snapshots: Parquet tables and a manifest


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(path: str, cfg: IndexConfig, mode: str = "errorifexists", state: dict | None = None, **tables: DataFrame) -> None:
    """Tables as Parquet under ``path`` and, last, the manifest that makes them a snapshot."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    meta = cfg.manifest() | {"tables": sorted(tables), "state": state}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, without reading any table; other format versions are refused."""
    meta = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if meta.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"snapshot has format {meta.get('format_version')}, this code reads {FORMAT_VERSION}")
    return meta


def load(spark: SparkSession, path: str) -> tuple[IndexConfig, dict[str, DataFrame]]:
    meta = manifest(spark, path)
    names = IndexConfig.__dataclass_fields__
    cfg = IndexConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta.items() if k in names})
    return cfg, {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}


def snapshot_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


# -- exports


def truth_bytes(truth: DataFrame, k: int) -> tuple[bytes, DataFrame]:
    """Header (rows, k) and one record of k int32 labels per query, padded with -1."""
    n = truth.select("qid").distinct().count()
    rows = truth.where(F.col("rk") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rk", "label"))).alias("l"))
    rows = rows.select(F.col("qid").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get("l", i)["label"], F.lit(-1).cast("long")).cast("int")).alias("v"))

    return np.array([n, k], np.int32).tobytes(), ints_bytes(rows)


def ints_bytes(rows: DataFrame) -> DataFrame:
    """(label, raw) of int32 numbers from (label, v: array<int>)."""

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"label": pdf["label"], "raw": [np.asarray(v, np.int32).tobytes() for v in pdf["v"]]})

    return rows.select(F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v")).mapInPandas(pack, "label long, raw binary")


def rank_export(points: DataFrame, column: str = "a0") -> DataFrame:
    """(label, v: [rank]) of an attribute, ready for ``ints_bytes``."""
    from ..operators.stats import attr_rank

    return attr_rank(points, column).select("label", F.array(F.col("rk").cast("int")).alias("v"))


def one_attr_export(points: DataFrame) -> DataFrame:
    return points.select("label", F.array("a0").alias("v"))


def two_attr_export(points: DataFrame, first: str = "a0", second: str = "a2") -> DataFrame:
    return points.select("label", F.array(first, second).alias("v"))


def range_export(preds: DataFrame, bounds: tuple[str, ...] = ("lo", "hi")) -> DataFrame:
    """Bounds of one range, or of two with four columns."""
    return preds.select(F.col("qid").alias("label"), F.array(*bounds).alias("v"))


def csv_lines(points: DataFrame, column: str = "attrs") -> DataFrame:
    """(value): the first attribute's values, one CSV line a record."""
    return points.select(F.array_join(F.get(column, 0).cast("array<string>"), ",").alias("value"))


def keyword_lines(points: DataFrame, column: str = "a1") -> DataFrame:
    """(value): labels joined by comma and space."""
    return points.select(F.array_join(F.col(column).cast("array<string>"), ", ").alias("value"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Result rows appended to a metrics table; each append is a set of files of its own."""
    rows.write.mode("append").parquet(path)
