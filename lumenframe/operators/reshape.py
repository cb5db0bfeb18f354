"""Reshaping and nested data: unpivot, pivot, explode, unnest, dummies, transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pivot or dummy column set of more values than this is refused.
MOST_VALUES = 10_000


def _c(name: str):
    return F.col(f"`{name}`")


def unpivot(df: DataFrame, index: list[str], on: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    types = {dict(df.dtypes)[c] for c in on}
    if len(types) > 1:
        common = "double" if types <= {"int", "bigint", "double", "float"} else "string"
        df = df.withColumns({c: _c(c).cast(common) for c in on})
    return df.unpivot([_c(c) for c in index], [_c(c) for c in on], variable, value)


def distinct_values(df: DataFrame, column: str) -> list:
    """The column's distinct non-null values in order; they become columns, so they are few by nature."""
    rows = df.select(_c(column).alias("v")).where("v IS NOT NULL").distinct().limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"{column} has more than {MOST_VALUES} values")
    return sorted(r[0] for r in rows)


def pivot(df: DataFrame, index: list[str], on: str, values: str, agg: str = "first", columns: list | None = None) -> DataFrame:
    """Values of ``on`` as columns. Given ``columns``, nothing runs before the result does."""
    names = columns if columns is not None else distinct_values(df, on)
    fn = {"first": F.first, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "last": F.last}[agg]
    return df.groupBy(*[_c(i) for i in index]).pivot(on, names).agg(fn(_c(values)))


def explode(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns side by side; null and empty lists give one row of null."""
    if len(columns) == 1:
        return df.withColumn(columns[0], F.explode_outer(_c(columns[0])))
    names = [f"z{i}" for i in range(len(columns))]
    zipped = F.arrays_zip(*[F.coalesce(_c(c), F.array().cast(dict(df.dtypes)[c])) for c in columns])
    fields = T.StructType([T.StructField(n, df.schema[c].dataType.elementType) for n, c in zip(names, columns)])
    out = df.withColumn("__z", F.explode_outer(zipped.cast(T.ArrayType(fields))))
    return out.withColumns({c: F.col("__z")[n] for n, c in zip(names, columns)}).drop("__z")


def unnest(df: DataFrame, columns: list[str], prefix: bool = False) -> DataFrame:
    """Struct fields as columns, in name order; with prefix as ``column_field``."""
    out = []
    for c in df.columns:
        if c in columns:
            out += [_c(c)[f].alias(f"{c}_{f}" if prefix else f) for f in sorted(df.schema[c].dataType.names)]
        else:
            out.append(_c(c))
    return df.select(*out)


def dummies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's values as boolean columns ``column_value``."""
    out = []
    for c in df.columns:
        out += [F.coalesce(_c(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in distinct_values(df, c)] if c in columns else [_c(c)]
    return df.select(*out)


def transpose(df: DataFrame, index: str, columns: list | None = None) -> DataFrame:
    """Rows as columns, named by ``index``: an unpivot and a pivot, nothing on the driver but the names."""
    rest = [c for c in df.columns if c != index]
    return pivot(unpivot(df, [index], rest, "column", "value"), ["column"], index, "value", "first", columns)
