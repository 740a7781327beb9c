"""Shared plumbing: the cluster's shared folder, written intermediate tables and word rules.

Every intermediate result that cuts lineage is a Parquet table below the folder named by
``spark.checkpoint.dir``, so that a lost executor never takes data with it. Python tasks reach
that folder through ``pyarrow.fs``, hence by any URI that it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``; ``bytes.split()`` without arguments follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="docengine-")
    return _own_folder[app]


class Scratch:
    """A folder of one operator call, with the tables that it writes and reads again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.written: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends at the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.written.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
            self.written.discard(name)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*self.written.difference(names))


def filesystem(uri: str):
    """The ``pyarrow`` file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create_folder(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; an operator's own names can't clash with further columns then."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether ``df``, a written table, may be broadcast: its rows are counted, at most ``limit`` bytes of them."""
    return df.limit(limit // row_bytes + 1).count() * row_bytes <= limit


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough; without one, the join shuffles."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def spread_join(left: DataFrame, right: DataFrame, key: str, row_bytes: int | None = 32, slices: int = 1000, how: str = "inner") -> DataFrame:
    """The join of two written tables on column ``key``, which is unique in ``right``, with hot keys of ``left`` dealt out.

    A small ``right`` is broadcast, unless ``row_bytes`` is None. Else a key with more than one in ``slices`` of the rows of ``left`` is hot; there are fewer than
    ``slices`` of these, and each is cut into parts of about that size, to which the row of ``right`` is copied.
    """
    if row_bytes and small_enough(right, row_bytes):
        return left.join(F.broadcast(right), key, how)
    part = max(1, left.count() // slices)
    hot = left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > part)
    hot = F.broadcast(hot.select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / part).cast("int").alias("hot_parts")).limit(slices))
    parts = F.coalesce("hot_parts", F.lit(1))
    many = left.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("hot_part", F.floor(F.rand(0) * parts).cast("int")).drop("hot_key", "hot_parts")
    one = right.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_key", "hot_parts")
    return many.join(one, [key, "hot_part"], how).drop("hot_part")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now, not at some later collection."""
    import gc
    import time

    # The last phase's files go at a later collection than the first: the engine's own events hold its plan for a moment.
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
