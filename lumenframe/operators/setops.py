"""Set operations and concatenation. Intersect and except keep the left frame's duplicates; the SQL forms do not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _on(a: DataFrame, b: DataFrame):
    return reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(b[f"`{c}`"]) for c in a.columns])


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*a.columns).alias("b")
    return a.join(b, _on(a, b), "left_semi")


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*a.columns).alias("b")
    return a.join(b, _on(a, b), "left_anti")


def diagonal(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def hash_rows(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.select(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).alias("hash"))
