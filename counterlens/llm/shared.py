"""Scratch tables in the folder that every executor can reach.

The cluster names the folder in ``spark.checkpoint.dir``. Only where it is unset
(tests, single-process runs) a folder under /tmp is used; with a remote master an
unset folder is an error, since a local folder would not be seen by all executors.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


class Scratch:
    """Tables of one run of one operator, in a folder of their own.

    ``table`` writes and rereads a frame, which cuts its lineage: a lost executor
    costs only the tasks that it ran. ``drop`` removes the folder once the result
    that was built on it has been stored.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
        if spark.conf.get("spark.checkpoint.dir", None) is None:  # one process on one machine
            atexit.register(shutil.rmtree, self.base.removeprefix("file://"), ignore_errors=True)
        else:
            atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        """What was not dropped goes when the driver ends, if its session is still there."""
        if self.spark.sparkContext._jsc is not None:
            self.drop()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


HOT = 2_000


def with_each(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, hot: int = HOT) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row a key and in ``weight`` (not null) the rows of the key.

    A key is heavy if it holds more than one row in ``hot`` of ``total``: at most ``hot``
    keys are, and those are broadcast. The others are shuffled, none of them large.
    """
    heavy, others = F.col(weight) * hot > total, [c for c in table.columns if c not in keys]
    marked = rows.join(F.broadcast(table.where(heavy).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in others])), keys, "left")
    done = marked.where(F.col(f"_hot_{weight}").isNotNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in others])
    rest = marked.where(F.col(f"_hot_{weight}").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(table.where(~heavy), keys, "left").select(*rows.columns, *others))


def salted(rows: DataFrame, table: DataFrame, key: str, weights: DataFrame, limit: int) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key), for rows of ``table`` too large to broadcast.

    ``weights`` has (key, w), the rows of a key. A key of more than ``limit`` rows is dealt
    to as many tasks as that makes, each with the key's row of ``table``; only the keys and
    their numbers of tasks are broadcast, so ``limit`` must grow with the rows.
    """
    many = F.broadcast(weights.where(F.col("w") > limit).select(key, F.ceil(F.col("w") / F.lit(limit)).cast("int").alias("_salts")))
    dealt = rows.join(many, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copied = table.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def carry(docs: DataFrame, own: list[str]) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns other than ``own`` under names that no operator uses.

    Returns it, those names, and a function that gives a frame the columns of ``docs`` again.
    """
    names = {c: f"__carried_{i}" for i, c in enumerate(docs.columns) if c not in own}
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    renamed = docs.select(*own, *[column(c).alias(n) for c, n in names.items()])
    return renamed, list(names.values()), lambda df: df.select(*[F.col(names[c]).alias(c) if c in names else F.col(c) for c in docs.columns])
