"""Statistics over columns and runs: describe, value counts, histogram, run lengths, ewm, order index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ("bigint", "int", "smallint", "tinyint", "double", "float")


def _c(name: str):
    return F.col(f"`{name}`")


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMBERS or t.startswith("decimal")]


def clean(df: DataFrame, c: str) -> Column:
    return F.when(~F.isnan(_c(c)), _c(c)) if dict(df.dtypes)[c] in ("double", "float") else _c(c)


REDUCERS = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "std_pop": F.stddev_pop, "var_pop": F.var_pop, "count": F.count, "product": lambda c: F.product(c.cast("double")),
}


def reduce(df: DataFrame, how: str, columns: list[str], skip_nan: bool = True) -> DataFrame:
    if how == "median":
        return at_shares(df, {c: clean(df, c) if skip_nan else _c(c) for c in columns}, [0.5]).select(*[_c(c)[0].alias(c) for c in columns])
    return df.agg(*[REDUCERS[how](clean(df, c) if skip_nan else _c(c)).alias(c) for c in columns])


#: Accuracy of the sketch that quantiles start from, and how far to either side of a share its cuts lie: beyond the sketch's error of 1 / SKETCH.
SKETCH, MARGIN = 2000, 0.0015


def at_shares(df: DataFrame, columns: dict[str, Column], shares: list[float], nearest: bool = False) -> DataFrame:
    """One row: for each column an array of its exact values at the shares, linear or of nearest rank; null for no values.

    No task holds all distinct values. Cuts from a sketch lie close around each share; rows of
    each cell between cuts are counted, then only cells that hold a wanted rank are grouped by
    value. The cuts decide how much that is, never the result.
    """
    kinds = dict(df.select(*[c.alias(n) for n, c in columns.items()]).dtypes)
    if nearest and len(set(kinds.values())) > 1:  # values keep their types: one type at a time
        row, *others = [at_shares(df, {n: columns[n] for n in columns if kinds[n] == k}, shares, nearest) for k in dict.fromkeys(kinds.values())]
        for o in others:
            row = row.crossJoin(o)
        return row.select(*[_c(n) for n in columns])
    many, ends = range(len(columns)), sorted({min(max(q + d, 0.0), 1.0) for q in shares for d in (-MARGIN, MARGIN)})
    values = df.select(*[(c if nearest else c.cast("double")).alias(f"__v{i}") for i, c in enumerate(columns.values())])
    sketch = values.agg(*[F.percentile_approx(f"__v{i}", ends, SKETCH).alias(f"__s{i}") for i in many])

    def cell(i: int) -> Column:
        """Rises with the value; values equal to a cut have a cell of their own."""
        v, s = F.col(f"__v{i}"), F.col(f"__s{i}")
        return sum(((s[k] < v).cast("int") + (s[k] <= v).cast("int") for k in range(len(ends))), F.lit(0))

    cells = F.array(*[F.struct(F.lit(i).alias("i"), cell(i).alias("b"), F.col(f"__v{i}").alias("v")) for i in many])
    rows = values.crossJoin(F.broadcast(sketch)).select(F.inline(cells)).where("v IS NOT NULL")
    counts = rows.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"))  # at most 2 * len(ends) + 1 rows a column
    w = Window.partitionBy("i")
    counts = counts.select("i", "b", "n", (F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w).alias("all"))

    def positions(n: Column) -> list[Column]:
        return [F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0)).cast("double") if nearest else F.lit(q) * (n - 1) for q in shares]

    ranks = F.array(*[f(p).cast("long") for p in positions(F.col("all")) for f in (F.floor, F.ceil)])
    wanted = counts.where(F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).drop("n")
    held = rows.join(F.broadcast(wanted), ["i", "b"]).groupBy("i", "b", "before", "all", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("i", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.select("i", "v", "n", "all", ranks.alias("r"), upto.alias("upto"))
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("r")[j] < F.col("upto")) & (F.col("r")[j] >= F.col("upto") - F.col("n")), F.col("v")))
    found = held.agg(*[F.array(*[at(i, j) for j in range(2 * len(shares))]).alias(f"__f{i}") for i in many], *[F.max(F.when(F.col("i") == i, F.col("all"))).alias(f"__n{i}") for i in many])

    def value(i: int, j: int, p: Column) -> Column:
        lo, hi = F.col(f"__f{i}")[2 * j], F.col(f"__f{i}")[2 * j + 1]
        return lo if nearest else F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return found.select(*[F.when(F.col(f"__n{i}").isNotNull(), F.array(*[value(i, j, p) for j, p in enumerate(positions(F.col(f"__n{i}")))])).alias(c) for i, c in enumerate(columns)])


def quantile(df: DataFrame, q: float, columns: list[str], nearest: bool = False) -> DataFrame:
    """Linear interpolation, or the value of nearest rank."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    return at_shares(df, {c: clean(df, c) for c in columns}, [q], nearest).select(*[_c(c)[0].alias(c) for c in columns])


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """statistic, then a column of values for each numeric column; one row of aggregates and one of quartiles, then an unpivot."""
    columns = columns or numeric(df)
    quarters = {"25%": 0, "50%": 1, "75%": 2}
    stats = {"count": F.count, "null_count": lambda c: F.count_if(c.isNull()), "mean": F.avg, "std": F.stddev_pop, "min": F.min, **quarters, "max": F.max}
    row = df.agg(*[fn(_c(c) if n == "null_count" else clean(df, c)).cast("double").alias(f"__{n}_{c}") for c in columns for n, fn in stats.items() if n not in quarters])
    row = row.crossJoin(at_shares(df, {c: clean(df, c) for c in columns}, [0.25, 0.5, 0.75]))
    row = row.select(*[F.array(*[F.struct(F.lit(n).alias("statistic"), (_c(c)[fn] if n in quarters else _c(f"__{n}_{c}")).alias("value")) for n, fn in stats.items()]).alias(c) for c in columns])
    z = row.select(F.explode(F.arrays_zip(*[_c(c) for c in columns])).alias("z"))
    return z.select(F.col("z")[columns[0]]["statistic"].alias("statistic"), *[F.col("z")[c]["value"].alias(c) for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(_c(column)).agg(F.count(F.lit(1)).alias("count"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    n = value_counts(df, column)
    total = F.sum("count")
    # -sum(p ln p) = ln N - sum(n ln n) / N, so no second pass for N.
    return n.agg((F.ln(total) - F.sum(F.col("count") * F.ln("count")) / total).alias(column))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """breakpoint (left edge) and count of equal-width bins."""
    ends = df.agg(F.min(clean(df, column)).cast("double").alias("lo"), F.max(clean(df, column)).cast("double").alias("hi"))
    v = df.select(clean(df, column).cast("double").alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(ends))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    placed = v.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b"))
    return grid.join(placed, "b", "left").select((F.col("lo") + F.col("b") * width).alias("breakpoint"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def runs(df: DataFrame, column: str, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """df with ``run``: the number of the run of equal values, from 0."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    change = (~_c(column).eqNullSafe(F.lag(_c(column)).over(w)) & (F.row_number().over(w) > 1)).cast("long")
    return df.withColumn("__change", change).withColumn("run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def interpolate(df: DataFrame, columns: list[str], order: list[Column], partition: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Linear between known values by row position, or by the values of ``by``. The ends take the nearest known value; by ``by`` they stay null."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    df = df.withColumn("__x", _c(by).cast("double") if by else F.row_number().over(w).cast("double"))
    for c in columns:
        known = F.when(_c(c).isNotNull(), F.struct(F.col("__x").alias("x"), _c(c).cast("double").alias("y")))
        df = df.withColumn("__k", known).withColumns({"__a": F.last("__k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.expr("lead(__k) IGNORE NULLS").over(w)})  # one pass: first over the rows that follow would take the square of them
        a, b = F.col("__a"), F.col("__b")
        line = a["y"] + (b["y"] - a["y"]) * (F.col("__x") - a["x"]) / (b["x"] - a["x"])
        filled = F.when(_c(c).isNotNull(), _c(c).cast("double")).when(a.isNotNull() & b.isNotNull(), line)
        df = df.withColumn(c, filled if by else filled.otherwise(F.coalesce(a["y"], b["y"]))).drop("__k", "__a", "__b")
    return df.drop("__x")


def ewm(df: DataFrame, column: str, order: list[str], alpha: float, output: str, partition: list[str], kind: str = "mean") -> DataFrame:
    """Recursive exponential weights (adjust=False) within each partition, in Arrow batches of one partition each."""
    schema = df.withColumn(output, F.lit(None).cast("double")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        mean, var, out = None, 0.0, []
        for x in pdf[column].tolist():
            if x is None or x != x:
                out.append(None)
                continue
            if mean is None:
                mean = x
            else:
                mean = alpha * x + (1 - alpha) * mean
                var = (1 - alpha) * var + alpha * (x - mean) ** 2
            out.append(mean if kind == "mean" else var if kind == "var" else var**0.5)
        return pdf.assign(**{output: pd.array(out, dtype="Float64")})

    return df.groupBy(*partition).applyInPandas(run, schema)


#: Rows that one range of an ordered pass is meant to hold, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000_000, 8192


def monotone(df: DataFrame, name: str) -> Column:
    """A number that never falls as the column rises in sort order; null for null. Strings count by their first bytes."""
    c, kind = _c(name), dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.unix_date(c)
    if kind == "boolean":
        return c.cast("int")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if kind.startswith("decimal"):
        return c.cast("double")
    return c if kind in NUMBERS else F.when(c.isNotNull(), F.lit(0))


def range_cuts(df: DataFrame, number: Column) -> list:
    """Approximate quantiles that cut the rows into ranges of about RANGE_ROWS; at most MOST_RANGES - 1 numbers, none for few rows."""
    ranges = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    if ranges < 2:
        return []
    shares = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))  # as text: thousands of literals are slow to build one by one
    cuts = df.select(number.alias("__n")).agg(F.expr(f"percentile_approx(__n, array({shares}), 50000)")).first()[0]
    return sorted({c for c in cuts or [] if c == c})


def place(number: Column, cuts: list) -> Column:
    """How many cuts lie below the number (0 for null): two short scans of sorted cuts."""
    if not cuts:
        return F.lit(0)
    wide = max(1, int(len(cuts) ** 0.5))
    whole, coarse = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(c) for c in cuts[::wide]])
    b = F.size(F.filter(coarse, lambda c: c < number))
    start = (b - 1) * wide
    return F.when(b <= 0, F.lit(0)).otherwise(start + F.size(F.filter(F.slice(whole, start + 1, F.lit(wide)), lambda c: c < number)))


def prefix(df: DataFrame, order: list[tuple[str, bool, bool]], keys: list[Column], value: Column | None, output: str) -> DataFrame:
    """A running sum (or, without value, a row number from 0) over all rows, not in one task.

    order: (column, descending, nulls last) of each key; keys: the same as sort keys. Rows are cut
    into ranges of the first key at approximate quantiles; each range runs alone and adds the
    totals of the ranges before it. Rows of one value of the first key stay in one range.
    """
    name, desc, last = order[0]
    number = monotone(df, name)
    cuts = range_cuts(df, number)
    at = F.lit(len(cuts)) - place(number, cuts) if desc else place(number, cuts)
    nulls = F.lit(len(cuts) + 1 if last else -1)
    v = F.lit(1).cast("long") if value is None else F.coalesce(value.cast("double"), F.lit(0.0))
    d = df.withColumn("__v", v).withColumn("__p", F.when(number.isNull(), nulls).otherwise(at) if cuts else F.lit(0))
    w = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn("__r", F.sum("__v").over(w))
    total = F.col("__r") - (1 if value is None else 0)
    if not cuts:
        return out.withColumn(output, total).drop("__v", "__p", "__r")
    totals = d.groupBy("__p").agg(F.sum("__v").alias("__t"))
    before = totals.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # at most MOST_RANGES + 1 rows
    return out.join(F.broadcast(before), "__p").withColumn(output, total + F.col("__b")).drop("__v", "__p", "__r", "__b")
