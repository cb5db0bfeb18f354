"""Time windows: dynamic groups, trailing means over time, upsampling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
#: Windows count from a Monday, so weekly windows begin on Mondays.
ORIGIN = -3 * UNITS["d"]


def micros(text: str) -> int:
    """Microseconds of a duration such as ``1h30m``."""
    parts = re.findall(r"(\d+)(us|ms|s|m|h|d|w)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNITS[u] for n, u in parts)


def to_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def to_time(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def window_start(c: Column, every: str, offset: str | None = None, closed: str = "left") -> Column:
    """The start of the one window that a time falls into."""
    e, o = micros(every), micros(offset) if offset else 0
    t = to_micros(c) - F.lit(o + ORIGIN)
    start = t - F.pmod(t, F.lit(e))
    if closed in ("right", "none"):
        start = F.when(F.pmod(t, F.lit(e)) == 0, start - e).otherwise(start) if closed == "right" else F.when(F.pmod(t, F.lit(e)) != 0, start)
    return start + F.lit(o + ORIGIN)


def dynamic_key(c: Column, every: str, period: str | None = None, offset: str | None = None, closed: str = "left", label: str = "left") -> Column:
    start = window_start(c, every, offset, closed)
    return to_time(start + (micros(period or every) if label == "right" else 0))


def rolling_time(df: DataFrame, by: str, value: str, window: str, output: str, min_rows: int = 1, closed: str = "left", partition: list[str] | None = None, fn=F.avg) -> DataFrame:
    """An aggregate over the rows whose time lies in the window that ends at each row's time."""
    w, at = micros(window), Window.partitionBy(*(partition or [F.lit(0)])).orderBy(to_micros(F.col(f"`{by}`")))
    lo, hi = {"left": (-w, -1), "right": (-w + 1, 0), "both": (-w, 0), "none": (-w + 1, -1)}[closed]
    over = at.rangeBetween(lo, hi)
    v = F.col(f"`{value}`")
    return df.withColumn(output, F.when(F.count(v).over(over) >= min_rows, fn(v).over(over)))


def upsample(df: DataFrame, by: str, every: str, partition: list[str] | None = None) -> DataFrame:
    """A row for each step from the first to the last time (of each partition); steps without a row are null."""
    keys, e = partition or [], micros(every)
    t = to_micros(F.col(f"`{by}`"))
    ends = df.groupBy(*keys).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    grid = ends.where("__lo IS NOT NULL").select(*keys, F.explode(F.sequence("__lo", "__hi", F.lit(e))).alias("__t"))
    rest = [c for c in df.columns if c not in (by, *keys)]
    rows = df.groupBy(*keys, t.alias("__t")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__r")) if rest else None
    out = grid.join(rows, [*keys, "__t"], "left") if rows is not None else grid
    return out.select(*[to_time(F.col("__t")).alias(c) if c == by else F.col(c) if c in keys else F.col("__r")[c].alias(c) for c in df.columns])
