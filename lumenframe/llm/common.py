"""Shared helpers: the shared work folder, tables cut from lineage, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case, the only folding that the contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table for ``bytes.translate`` that lower-cases A-Z only.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Ids of at most this many rows (8 bytes each) may be broadcast.
BROADCAST_IDS = 500_000
#: Other tables of numbers may be broadcast if their counted rows, 8 bytes a column, are of at most this size.
BROADCAST_BYTES = 2_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and driver and executors are one process."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Tables written to the shared folder: each cuts the lineage and survives lost executors.

    What is left of them goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lumen_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more and lets Spark free their shuffle files."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._lumen_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def with_ids(df: DataFrame, ids: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """The rows of df whose key is in ids (one column, same name, distinct values).

    ids are broadcast only when they are counted and few; otherwise both sides shuffle.
    """
    n = ids.count() if count is None else count
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def join_small(df: DataFrame, other: DataFrame, on, how: str, count: int) -> DataFrame:
    """A join whose counted right side (numbers only) is broadcast when it is small enough, and shuffles otherwise."""
    return df.join(F.broadcast(other) if count * 8 * len(other.columns) <= BROADCAST_BYTES else other, on, how)


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive a task, and other operators run in them next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that to ASCII text, and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def keyed(df: DataFrame, id_col: str, *names: str) -> DataFrame:
    """The id as long, and the other named columns."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias(id_col), *[F.col(f"`{n}`") for n in names])


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, comp), comp the least id.

    Alternating stars: a large star links the greater neighbours of every vertex to
    its least one, a small star does so with the smaller ones, until the edges are
    stars around the least ids. The rounds grow with the logarithm of the longest
    path. Edges stay in the shared folder; only their number and a checksum come to
    the driver. Least neighbours are aggregated before they are shuffled, and the
    join on a hub's id is a plain one, which adaptive execution splits.
    """
    now = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def sum_of(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before, after = None, sum_of(now)
    while before != after:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ws.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = ws.save(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct())
        ws.drop(now, large)
        now, before, after = new, after, sum_of(new)
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
