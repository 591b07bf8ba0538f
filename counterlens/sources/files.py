"""File sources and sinks: JSON lines, CSV, arrays, artifacts, markdown tables."""

from __future__ import annotations

import atexit
import io
import json
import shutil
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/files-{name}-{uuid.uuid4().hex}"
    if base is None:  # one process on one machine
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    else:
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends, if its session is still there."""
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines under an explicit schema. Strict fails at a bad line; otherwise bad lines are kept in ``_corrupt``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    loose = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(loose).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def bad_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file, line (from 1) and text of non-blank lines that are no JSON of the schema.

    Files are read in blocks. A line's number is its place in its block and the lines of
    the blocks before, of which there is a small table; no file is held whole.
    """
    lines = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_no")).withColumnRenamed("value", "text")
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_no").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("text", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = lines.where((F.trim("text") != "") & F.coalesce(parsed["_corrupt"].isNotNull(), F.lit(True)))
    return bad.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_no") - F.col("_first") + 1).alias("line"), "text")


def read_csv(spark: SparkSession, path: str | list[str], schema: str, multiline: bool = False) -> DataFrame:
    """Headed CSV, plain or gzipped; several paths are concatenated. Gzip cannot be split, so its rows are dealt anew."""
    out = spark.read.schema(schema).option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    paths = [path] if isinstance(path, str) else path
    return out.repartition(spark.sparkContext.defaultParallelism) if any(p.endswith(".gz") for p in paths) else out


def read_keyed(spark: SparkSession, pattern: str, schema: str, key_pattern: str) -> DataFrame:
    """All JSON-lines files that match a glob, with part of each file's name as ``file_key``."""
    return read_jsonl(spark, pattern, schema).withColumn("file_key", F.regexp_extract(F.input_file_name(), key_pattern, 1))


def read_arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """npz files as rows (file, name, row, x): one row for each first-axis entry of each named array."""
    schema = "file string, name string, row long, x array<double>"

    def unpack(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in names:
                        a = np.atleast_2d(z[name].astype(float)) if z[name].ndim != 1 else z[name].astype(float)[:, None]
                        rows += [(file, name, i, list(map(float, r.ravel()))) for i, r in enumerate(a)]
            yield pd.DataFrame(rows, columns=["file", "name", "row", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)


def write_arrays(df: DataFrame, path: str, key: str, vector: str) -> DataFrame:
    """npz files with arrays ``ids`` and ``w``, one of each batch, in a folder that all executors share; returns their names and sizes.

    Files of repeated attempts have names of their own; read those that the result names.
    """

    def run(batches):
        for batch in batches:
            fs, folder = pafs.FileSystem.from_uri(path)
            fs.create_dir(folder, recursive=True)
            held, name = io.BytesIO(), f"part-{uuid.uuid4().hex}.npz"
            np.savez(held, ids=batch.column(key).to_numpy(zero_copy_only=False), w=np.array(batch.column(vector).to_pylist(), float))
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(held.getvalue())
            yield pa.record_batch([pa.array([f"{path}/{name}"]), pa.array([batch.num_rows], pa.int64())], names=["file", "n"])

    return df.select(key, vector).mapInArrow(run, "file string, n long")


def read_artifact(spark: SparkSession, paths: list[str], required: bool = True) -> DataFrame | None:
    """The first of several JSON artifacts that exists, one row as text; None if optional and absent."""
    for path in paths:
        if exists(spark, path):
            return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("body"))
    if required:
        raise FileNotFoundError(paths)
    return None


def markdown_tables(lines: DataFrame) -> DataFrame:
    """Cells of markdown tables by section; ``lines`` has file, n, value. Sections carry forward to the lines below them."""
    below = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("value").startswith("#"), F.trim(F.regexp_replace("value", "^#+", "")))
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(below)).where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[\s:|-]+$"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("file", "section", "n", cells.alias("cells"))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of JSON lines for each split."""
    df.write.partitionBy(split).mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """Headed CSV; columns in ``decimals`` are printed with that many places."""
    fixed = [F.format_string(f"%.{decimals[c]}f", c).alias(c) if decimals and c in decimals else F.col(c) for c in df.columns]
    df.select(*fixed).write.mode("overwrite").option("header", True).csv(path)


def merge_summary(old: DataFrame, new: DataFrame, keys: list[str], mock: Column | None = None) -> DataFrame:
    """Upsert by key: new rows replace old ones. Refuses to put mock rows (``mock``) over real ones."""
    if mock is not None:
        clash = new.where(mock).select(*keys).join(old.where(~mock).select(*keys), keys, "left_semi")
        if clash.limit(1).count():
            raise ValueError("mock results would replace real ones")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new).orderBy(*keys)


def report(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a markdown table; a result of more than ``limit`` rows is an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows])


class CachedClient:
    """Responses of a remote service from a table of (key, body); never asks the network.

    A key is the path with its sorted parameters, less the access key. A key that is
    absent is an error; a body of NULL says that the service had nothing.
    """

    def __init__(self, cache: DataFrame):
        self.cache = cache

    @staticmethod
    def key(path: str, params: dict[str, str]) -> str:
        return path + "?" + "&".join(f"{k}={v}" for k, v in sorted(params.items()) if k != "apiKey")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (key) with body; raises if a key was never cached."""
        if wanted.join(self.cache, "key", "left_anti").limit(1).count():
            raise LookupError("not cached, and there is no network")
        return wanted.join(self.cache, "key")


def pairs_to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, for graphs and other artifacts."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def dump_json(value) -> str:
    return json.dumps(value, sort_keys=True)
