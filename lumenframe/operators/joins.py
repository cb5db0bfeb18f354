"""Joins: six equi joins in which null keys match, cross, predicate and as-of.

The equi joins use null-safe equality, which Spark still executes as hash or
sort-merge joins; which one, and what is broadcast, is left to the planner and
its statistics. The as-of join is a union and one window over the key, so it
never compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import place, range_cuts

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def equi(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str, suffix: str = "_right", hidden: str = "__o") -> DataFrame:
    """Left columns, then all right columns, suffixed where names clash."""
    taken = set(left.columns)
    names = {c: c + suffix if c in taken else c for c in right.columns if not c.startswith(hidden)}
    right = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if how == "cross":
        return left.crossJoin(right)
    on = [left[f"`{a}`"].eqNullSafe(right[f"`{names[b]}`"]) for a, b in zip(left_on, right_on)]
    cond: Column = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, HOW[how])


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], strategy: str = "backward", tolerance: float | None = None, suffix: str = "_right", hidden: str = "__o") -> DataFrame:
    """Each left row with the right row of the nearest key: at or before it, at or after it, or either.

    Of right rows with the nearest key one is taken: the first by the right frame's values.
    Without ``by`` a large input is cut into ranges of the key; each range takes the last match
    before it and the first after it from a table of one row for each range.
    """
    taken = set(left.columns)
    rcols = [c for c in right.columns if not c.startswith(hidden)]
    names = {c: c + suffix if c in taken else c for c in rcols}
    ltype = dict(left.dtypes)[left_on]
    stamp = ltype.startswith("timestamp") or ltype == "date"
    # Decimals keep their fraction: one decimal type for both sides, wide enough for either.
    whole = all(dict(f.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for f, c in ((left, left_on), (right, right_on)))
    exact = "bigint" if whole else "double" if "double" in (kinds := (ltype, dict(right.dtypes)[right_on])) or "float" in kinds else "decimal(38,12)"
    number = (lambda c: F.unix_micros(c.cast("timestamp"))) if stamp else (lambda c: c.cast(exact))
    keys = [f"__b{i}" for i in range(len(by))]
    rows = F.struct(*[F.col(f"`{c}`") for c in rcols]).alias("__r")
    r = right.where(F.col(f"`{right_on}`").isNotNull()).select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], number(F.col(f"`{right_on}`")).alias("__k"), rows)
    # One row for each key: ties and repeated rows do not multiply.
    r = r.groupBy(*keys, "__k").agg(F.min("__r").alias("__r"))
    l = left.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], number(F.col(f"`{left_on}`")).alias("__k"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"))
    both = l.select(*keys, "__k", "__l", F.lit(None).cast(r.schema["__r"].dataType).alias("__r")).unionAll(r.select(*keys, "__k", F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), "__r"))
    cuts = [] if keys else range_cuts(both.select("__k"), F.col("__k"))
    w = Window.partitionBy(*keys, "__p") if cuts else Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    if cuts:
        both = both.withColumn("__p", place(F.col("__k"), cuts))
    both = both.withColumn("__f", F.when(F.col("__r").isNotNull(), F.struct("__k", "__r")))
    back = F.last("__f", ignorenulls=True).over(w.orderBy("__k").rangeBetween(Window.unboundedPreceding, 0))
    # Left rows come before the right row of their key, so the next one is it. A frame of all rows that follow would be scanned for each row.
    ahead = F.expr("lead(__f) IGNORE NULLS").over(w.orderBy("__k", F.col("__l").isNull()))
    need = {"backward": [("__back", back)], "forward": [("__ahead", ahead)]}.get(strategy, [("__back", back), ("__ahead", ahead)])
    j = both.withColumns(dict(need)).where(F.col("__l").isNotNull())
    if cuts:
        j = j.join(F.broadcast(_outside(r, cuts)), "__p")
        j = j.withColumns({n: F.coalesce(n, n + "_out") for n, _ in need})
    if len(need) == 1:
        hit = F.col(need[0][0])
    else:
        nearer = F.col("__ahead").isNotNull() & (F.col("__back").isNull() | (F.col("__ahead")["__k"] - F.col("__k") < F.col("__k") - F.col("__back")["__k"]))
        hit = F.when(nearer, F.col("__ahead")).otherwise(F.col("__back"))
    j = j.withColumn("__hit", hit)
    if tolerance is not None:
        j = j.withColumn("__hit", F.when(F.abs(F.col("__hit")["__k"] - F.col("__k")) <= tolerance, F.col("__hit")))
    return j.select(*[F.col("__l")[c].alias(c) for c in left.columns], *[F.col("__hit")["__r"][c].alias(n) for c, n in names.items()])


def _outside(r: DataFrame, cuts: list) -> DataFrame:
    """For each range (``__p``): the last right row before it and the first one after it. One row for each range."""
    ends = r.select(place(F.col("__k"), cuts).alias("__p"), F.struct("__k", "__r").alias("f")).groupBy("__p").agg(F.max_by("f", F.col("f")["__k"]).alias("hi"), F.min_by("f", F.col("f")["__k"]).alias("lo"))
    grid = r.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__p")).join(ends, "__p", "left")
    w = Window.orderBy("__p")
    return grid.select("__p", F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__back_out"), F.expr("lead(lo) IGNORE NULLS").over(w).alias("__ahead_out"))
