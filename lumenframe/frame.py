"""Frames: a thin facade over Spark DataFrames with an optional row order.

``Frame`` and ``LazyFrame`` share everything: Spark is lazy anyway. They differ
only where their semantics do (statistics of the lazy form are of the population,
nearest-rank against linear quantiles, ...). Row order lives in hidden columns
``__o*``: a sort adds its keys there, later steps carry them, and windows and
``first``/``last`` use them. Nothing is numbered or moved to one task for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import expr as E
from .operators import joins, reshape, setops, stats, temporal

HIDDEN = "__o"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _list(x) -> list:
    return [x] if isinstance(x, (str, E.Expr)) else list(x)


class Frame:
    population = False
    nearest_quantile = True
    skip_nan = True

    def __init__(self, df: DataFrame, order: list[tuple[str, bool, bool]] | None = None):
        """order: (hidden column, descending, nulls last) of each order key."""
        self.df, self.order = df, order or []

    # plumbing ---------------------------------------------------------------
    @classmethod
    def from_dict(cls, spark: SparkSession, data: dict[str, list], schema: str | None = None) -> Frame:
        names = list(data)
        rows = list(zip(*data.values(), range(len(next(iter(data.values())))))) if data else []
        if schema:
            df = spark.createDataFrame(rows, f"{schema}, {HIDDEN}0 long")
        else:
            df = spark.createDataFrame(rows, [*names, f"{HIDDEN}0"])
        return cls(df, [(f"{HIDDEN}0", False, False)])

    def _new(self, df: DataFrame, order: list | None = None) -> Frame:
        order = self.order if order is None else order
        have = set(df.columns)
        return type(self)(df, [o for o in order if o[0] in have])

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def to_spark(self) -> DataFrame:
        """The visible columns."""
        return self.df.select(*[_c(c) for c in self.columns])

    def _keys(self) -> list[Column]:
        out = []
        for name, desc, last in self.order:
            c = _c(name)
            out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if desc else (c.asc_nulls_last() if last else c.asc_nulls_first()))
        return out

    def with_order(self) -> Frame:
        """The order in which a source was read, where no order is known."""
        if self.order:
            return self
        return self._new(self.df.withColumn(f"{HIDDEN}0", F.monotonically_increasing_id()), [(f"{HIDDEN}0", False, False)])

    def _env(self, mode: str = "row") -> E.Env:
        env = E.Env(self.df, self._keys(), mode)
        env.order_names = [o[0] for o in self.order]
        return env

    def _compile(self, exprs: Iterable[E.Expr]) -> tuple[DataFrame, list[Column], bool]:
        """(frame that the columns need, columns, whether all are aggregates)."""
        es = [x for e in exprs for x in E.expand(e if isinstance(e, E.Expr) else E.col(e), self.columns)]
        pure = bool(es) and all(e.kind == "agg" for e in es)
        env = self._env("agg" if pure else "row")
        out = [e.build(env).alias(e.name) for e in es]
        return env.frame(), out, pure

    # projection ---------------------------------------------------------------
    def select(self, *exprs) -> Frame:
        df, out, pure = self._compile(exprs)
        if pure:
            return self._new(df.agg(*out), [])
        return self._new(df.select(*out, *[_c(o[0]) for o in self.order]))

    select_seq = sub_select_columns = select

    def with_columns(self, *exprs: E.Expr) -> Frame:
        es = [x for e in exprs for x in E.expand(e, self.columns)]
        env = self._env()
        new = {e.name: e.build(env) for e in es}
        return self._new(env.frame().withColumns(new).drop(*env.scalars, *env.made))

    with_columns_seq = with_columns

    def filter(self, predicate: E.Expr) -> Frame:
        env = self._env()
        c = predicate.build(env)
        if env.scalars or predicate.kind == "win":
            keep = self.with_columns(predicate.alias("__keep"))
            return self._new(keep.df.where("__keep").drop("__keep"))
        return self._new(self.df.where(c))


    def drop(self, *names: str) -> Frame: return self._new(self.df.drop(*names))
    drop_in_place = remove = drop
    def rename(self, mapping: dict[str, str]) -> Frame: return self._new(self.df.withColumnsRenamed(mapping))
    def cast(self, types: dict[str, str]) -> Frame: return self._new(self.df.withColumns({c: _c(c).cast(E.TYPES.get(t, t)) for c, t in types.items()}))
    def replace_column(self, i: int, e: E.Expr) -> Frame: return self.with_columns(e.alias(self.columns[i]))
    def insert_column(self, i: int, e: E.Expr) -> Frame:
        names = self.columns
        return self.with_columns(e).select(*names[:i], e.name, *names[i:])

    def match_to_schema(self, schema: dict[str, str]) -> Frame:
        have = set(self.columns)
        return self._new(self.df.select(*[(_c(c) if c in have else F.lit(None)).cast(E.TYPES.get(t, t)).alias(c) for c, t in schema.items()], *[_c(o[0]) for o in self.order]))

    def map_columns(self, names: list[str], fn: Callable[[E.Expr], E.Expr]) -> Frame: return self.with_columns(*[fn(E.col(n)).alias(n) for n in names])
    def pipe(self, fn: Callable, *args, **kw): return fn(self, *args, **kw)
    def pipe_with_schema(self, fn: Callable): return fn(self, dict(self.to_spark().dtypes))
    def map_rows(self, fn: Callable[[dict], dict], schema: str) -> Frame:
        import pandas as pd

        def run(it):
            for pdf in it:
                yield pd.DataFrame([fn(r) for r in pdf.to_dict("records")])

        return type(self)(self.to_spark().mapInPandas(run, schema))

    def map_batches(self, fn: Callable, schema: str | None = None) -> Frame:
        """fn gets iterators of Arrow batches (with schema) or the Spark DataFrame (without)."""
        return type(self)(self.to_spark().mapInArrow(fn, schema) if schema else fn(self.to_spark()))

    def _horizontal(self, name: str, fn) -> Frame: return self._new(self.df.select(fn([stats.clean(self.df, c) for c in stats.numeric(self.to_spark())]).alias(name), *[_c(o[0]) for o in self.order]))
    def max_horizontal(self) -> Frame: return self._horizontal("max", lambda cs: F.greatest(*cs))
    def min_horizontal(self) -> Frame: return self._horizontal("min", lambda cs: F.least(*cs))

    def sum_horizontal(self) -> Frame:
        return self._horizontal("sum", lambda cs: F.when(F.coalesce(*cs).isNotNull(), sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))))

    def mean_horizontal(self) -> Frame:
        return self._horizontal("mean", lambda cs: F.try_divide(sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0)), sum((c.isNotNull().cast("double") for c in cs), F.lit(0.0))))

    def hash_rows(self, seed: int = 0) -> Frame: return type(self)(setops.hash_rows(self.to_spark(), seed))
    def to_struct(self, name: str = "struct") -> Frame: return self._new(self.df.select(F.struct(*[_c(c) for c in self.columns]).alias(name), *[_c(o[0]) for o in self.order]))
    def to_dummies(self, *names: str) -> Frame: return type(self)(reshape.dummies(self.to_spark(), list(names)))

    # order and selection ----------------------------------------------------------
    def sort(self, by, descending=False, nulls_last: bool = False) -> Frame:
        keys = _list(by)
        desc = descending if isinstance(descending, (list, tuple)) else [descending] * len(keys)
        env = self._env()
        base = len(self.order) + sum(c.startswith(HIDDEN) for c in self.df.columns)
        new = {f"{HIDDEN}{base + i}": (k.build(env) if isinstance(k, E.Expr) else _c(k)) for i, k in enumerate(keys)}
        order = [(n, d, nulls_last) for n, d in zip(new, desc)] + self.order
        out = self._new(env.frame().withColumns(new).drop(*env.scalars, *env.made), order)
        return out

    def sorted_spark(self) -> DataFrame:
        """The visible columns in the frame's order."""
        return self.df.orderBy(*self._keys()).select(*[_c(c) for c in self.columns]) if self.order else self.to_spark()

    def limit(self, n: int) -> Frame:
        return self._new((self.df.orderBy(*self._keys()) if self.order else self.df).limit(n))

    head = limit
    def first(self) -> Frame: return self.limit(1)
    def clear(self) -> Frame: return self._new(self.df.limit(0))
    def top_k(self, k: int, by) -> Frame: return self.sort(by, descending=True).limit(k)
    def bottom_k(self, k: int, by) -> Frame: return self.sort(by).limit(k)

    def _flipped(self) -> Frame:
        f = self.with_order()
        return f._new(f.df, [(n, not d, not last) for n, d, last in f.order])

    def tail(self, n: int) -> Frame:
        out = self._flipped().limit(n)
        return out._new(out.df, [(a, not d, not last) for a, d, last in out.order])

    def last(self) -> Frame: return self.tail(1)
    def reverse(self) -> Frame: return self._flipped()

    def slice(self, offset: int, length: int) -> Frame:
        if offset < 0:
            return self.tail(-offset).limit(length)
        f = self.with_order()
        return f._new(f.df.orderBy(*f._keys()).offset(offset).limit(length))

    def with_row_index(self, name: str = "index", offset: int = 0) -> Frame:
        """Row numbers by order, range by range (``stats.prefix``)."""
        f = self.with_order()
        df = stats.prefix(f.df, f.order, f._keys(), None, name)
        return f._new(df.withColumn(name, (_c(name) + offset).cast("long")))

    with_row_count = with_row_index
    def gather_every(self, n: int, offset: int = 0) -> Frame: return (lambda f: f._new(f.df.where((_c("__i") >= offset) & ((_c("__i") - offset) % n == 0)).drop("__i")))(self.with_row_index("__i"))
    def sample(self, n: int | None = None, fraction: float | None = None, seed: int = 0) -> Frame: return self._new(self.df.sample(fraction=fraction, seed=seed) if n is None else self.df.orderBy(F.rand(seed)).limit(n))
    def shuffle(self, seed: int = 0) -> Frame: return self._new(self.df.withColumn(f"{HIDDEN}r", F.rand(seed)), [(f"{HIDDEN}r", False, False)])

    def unique(self, *subset: str, keep: str = "first") -> Frame:
        keys = list(subset) or self.columns
        if not self.order:
            return self._new(self.df.dropDuplicates(keys))
        w = Window.partitionBy(*[_c(k) for k in keys]).orderBy(*(self._keys() if keep == "first" else self._flipped()._keys()))
        return self._new(self.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))

    def is_duplicated(self) -> Frame: return self._new(self.df.select((F.count(F.lit(1)).over(Window.partitionBy(*[_c(c) for c in self.columns])) > 1).alias("is_duplicated"), *[_c(o[0]) for o in self.order]))
    def is_unique(self) -> Frame: return (lambda f: f._new(f.df.withColumn("is_unique", ~_c("is_duplicated")).drop("is_duplicated")))(self.is_duplicated())
    def set_sorted(self, by) -> Frame: return self.sort(by)
    def shift(self, n: int = 1) -> Frame: return self.with_columns(*[E.col(c).shift(n) for c in self.columns])
    def clone(self) -> Frame: return self
    rechunk = shrink_to_fit = lazy = clone
    def cache(self) -> Frame: return self._new(self.df.cache())

    # nulls ------------------------------------------------------------------------
    def fill_null(self, value: Any) -> Frame: return self._new(self.df.fillna(value, subset=self.columns))
    def fill_nan(self, value: float) -> Frame: return self._new(self.df.withColumns({c: F.when(F.isnan(_c(c)), F.lit(value)).otherwise(_c(c)) for c, t in self.df.dtypes if t in ("double", "float") and not c.startswith(HIDDEN)}))
    def drop_nulls(self, *subset: str) -> Frame: return self._new(self.df.dropna(subset=list(subset) or self.columns))

    def drop_nans(self, *subset: str) -> Frame:
        df = self.df
        for c, t in df.dtypes:
            if t in ("double", "float") and not c.startswith(HIDDEN) and (not subset or c in subset):
                df = df.where(~F.coalesce(F.isnan(_c(c)), F.lit(False)))
        return self._new(df)

    def interpolate(self, *names: str, partition: list[str] | None = None, by: str | None = None) -> Frame:
        f = self.with_order()
        return f._new(stats.interpolate(f.df, list(names) or stats.numeric(f.to_spark()), f._keys(), partition, by))

    # aggregation --------------------------------------------------------------------
    def group_by(self, *keys) -> GroupBy: return GroupBy(self, [E.col(k) if isinstance(k, str) else k for k in keys])

    def group_by_dynamic(self, by: str, every: str, period: str | None = None, offset: str | None = None, closed: str = "left", label: str = "left", window_column: str | None = None, group: list[str] | None = None) -> GroupBy:
        name = window_column or by
        key = E.Expr(lambda env: temporal.dynamic_key(_c(by), every, period, offset, closed, label), name)
        return GroupBy(self, [*[E.col(g) for g in group or []], key], drop_null=closed == "none")

    def _reduce(self, how: str) -> Frame:
        cols = self.columns if how in ("count", "min", "max") else stats.numeric(self.to_spark())
        if self.population and how in ("std", "var"):
            how += "_pop"
        return type(self)(stats.reduce(self.df, how, cols, self.skip_nan))

    def sum(self) -> Frame: return self._reduce("sum")
    def mean(self) -> Frame: return self._reduce("mean")
    def min(self) -> Frame: return self._reduce("min")
    def max(self) -> Frame: return self._reduce("max")
    def median(self) -> Frame: return self._reduce("median")
    def std(self) -> Frame: return self._reduce("std")
    def var(self) -> Frame: return self._reduce("var")
    def count(self) -> Frame: return self._reduce("count")
    def product(self) -> Frame: return self._reduce("product")
    def null_count(self) -> Frame: return type(self)(self.df.agg(*[F.count_if(_c(c).isNull()).alias(c) for c in self.columns]))
    def quantile(self, q: float) -> Frame: return type(self)(stats.quantile(self.df, q, stats.numeric(self.to_spark()), self.nearest_quantile))
    def n_unique(self, *subset: str) -> int: return self.df.select(*[_c(c) for c in subset or self.columns]).distinct().count()
    def approx_n_unique(self, *subset: str) -> int: return self.df.agg(F.approx_count_distinct(F.struct(*[_c(c) for c in subset or self.columns]))).first()[0]
    def corr(self, a: str, b: str) -> Frame: return type(self)(self.df.agg(F.coalesce(F.corr(_c(a), _c(b)), F.lit(0.0)).alias("corr")))
    def describe(self) -> Frame: return type(self)(stats.describe(self.to_spark()))
    def filter_aggregate(self, predicate: E.Expr, *aggs: E.Expr) -> Frame: return self.filter(predicate).select(*aggs)
    def value_counts(self, column: str) -> Frame: return type(self)(stats.value_counts(self.df, column))
    def hist(self, column: str, bins: int) -> Frame: return type(self)(stats.histogram(self.df, column, bins))
    def entropy(self, column: str) -> Frame: return type(self)(stats.entropy(self.df, column))
    def rle(self, column: str, partition: list[str] | None = None) -> Frame:
        f = self.with_order()
        r = stats.runs(f.df, column, f._keys(), partition)
        return type(self)(r.groupBy(*[_c(p) for p in partition or []], "run").agg(F.first(_c(column)).alias("value"), F.count(F.lit(1)).alias("len")))

    def rle_id(self, column: str, partition: list[str] | None = None) -> Frame: return (lambda f: f._new(stats.runs(f.df, column, f._keys(), partition)))(self.with_order())
    def ewm(self, column: str, alpha: float, output: str, partition: list[str], kind: str = "mean") -> Frame: return self._new(stats.ewm(self.df, column, [o[0] for o in self.order], alpha, output, partition, kind))
    def cum_sum_all(self, column: str, output: str) -> Frame: return (lambda f: f._new(stats.prefix(f.df, f.order, f._keys(), _c(column), output)))(self.with_order())

    def qcut(self, column: str, quantiles: list[float], output: str) -> Frame:
        breaks = stats.at_shares(self.df, {column: _c(column)}, quantiles).first()[0]
        return self.with_columns(E.col(column).cut(sorted(set(breaks))).alias(output))

    def partition_by(self, *keys: str) -> dict[tuple, Frame]:
        """A filtered frame for each distinct key; keys are few by nature, more than reshape.MOST_VALUES are refused."""
        rows = self.df.select(*[_c(k) for k in keys]).distinct().limit(reshape.MOST_VALUES + 1).collect()
        if len(rows) > reshape.MOST_VALUES:
            raise ValueError("too many keys")
        return {tuple(r): self._new(self.df.where(self._same(keys, r))) for r in rows}

    def _same(self, keys, row) -> Column:
        cond = F.lit(True)
        for k, v in zip(keys, row):
            cond = cond & _c(k).eqNullSafe(F.lit(v))
        return cond

    # joins ----------------------------------------------------------------------------
    def join(self, other: Frame, on=None, how: str = "inner", left_on=None, right_on=None, suffix: str = "_right") -> Frame:
        l, r = _list(left_on or on or []), _list(right_on or on or [])
        return self._new(joins.equi(self.df, other.to_spark(), l, r, how, suffix))

    def join_asof(self, other: Frame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by: list[str] | None = None, strategy: str = "backward", tolerance=None, suffix: str = "_right") -> Frame:
        t = temporal.micros(tolerance) if isinstance(tolerance, str) else tolerance
        return self._new(joins.asof(self.df, other.to_spark(), left_on or on, right_on or on, by or [], strategy, t, suffix))

    def join_where(self, other: Frame, *predicates: E.Expr, suffix: str = "_right") -> Frame:
        """Rows of both frames that meet all predicates; equalities among them become join keys."""
        out = self.join(other, how="cross", suffix=suffix)
        for p in predicates:
            out = out.filter(p)
        return out

    # sets -----------------------------------------------------------------------------
    def concat(self, *others: Frame, how: str = "vertical") -> Frame:
        if how == "horizontal":
            out = self
            for o in others:
                out = out.hstack(o)
            return out
        df = self.to_spark()
        for o in others:
            df = setops.diagonal([df, o.to_spark()]) if how == "diagonal" else setops.union_all(df, o.to_spark())
        return type(self)(df)

    vstack = extend = concat
    def union(self, o: Frame) -> Frame: return type(self)(setops.union(self.to_spark(), o.to_spark()))
    def union_all(self, o: Frame) -> Frame: return type(self)(setops.union_all(self.to_spark(), o.to_spark()))
    def intersect(self, o: Frame) -> Frame: return self._new(setops.intersect(self.to_spark(), o.to_spark()))
    def except_(self, o: Frame) -> Frame: return self._new(setops.except_(self.to_spark(), o.to_spark()))
    def merge_sorted(self, o: Frame, by) -> Frame: return self.concat(o).sort(by)

    def hstack(self, other: Frame) -> Frame:
        a, b = self.with_row_index("__i"), other.with_row_index("__i")
        taken = set(self.columns)
        names = {c: f"{c}_1" if c in taken else c for c in other.columns}
        r = b.df.select("__i", *[_c(c).alias(n) for c, n in names.items()])
        return a._new(a.df.join(r, "__i").drop("__i"))

    def update(self, other: Frame, on: list[str] | None = None) -> Frame:
        """The other frame's non-null values where keys (or row numbers) agree."""
        a, b, keys = (self, other, list(on)) if on else (self.with_row_index("__i"), other.with_row_index("__i"), ["__i"])
        cols = [c for c in other.columns if c not in keys and c in self.columns]
        r = b.df.select(*[_c(k) for k in keys], *[_c(c).alias(f"__u_{c}") for c in cols])
        df = a.df.join(r, keys, "left").withColumns({c: F.coalesce(_c(f"__u_{c}"), _c(c)) for c in cols})
        return a._new(df.select(*[_c(c) for c in self.columns], *[_c(o[0]) for o in a.order]))

    def with_context(self, other: Frame) -> Frame: return self._new(self.df.crossJoin(F.broadcast(other.to_spark().limit(1))))  # one row

    # reshape ----------------------------------------------------------------------------
    def explode(self, *names: str) -> Frame: return self._new(reshape.explode(self.df, list(names)))
    def unnest(self, *names: str) -> Frame: return self._new(reshape.unnest(self.df, list(names)))
    def flatten_struct(self, *names: str) -> Frame: return self._new(reshape.unnest(self.df, list(names), prefix=True))

    def unpivot(self, index: list[str], on: list[str] | None = None, variable: str = "variable", value: str = "value") -> Frame:
        return type(self)(reshape.unpivot(self.to_spark(), index, on or [c for c in self.columns if c not in index], variable, value))

    melt = unpivot
    def pivot(self, index, on: str, values: str, agg: str = "first", columns: list | None = None) -> Frame: return type(self)(reshape.pivot(self.to_spark(), _list(index), on, values, agg, columns))
    unstack = pivot
    def transpose(self, index: str, columns: list | None = None) -> Frame: return type(self)(reshape.transpose(self.to_spark(), index, columns))
    def upsample(self, by: str, every: str, partition: list[str] | None = None) -> Frame: return type(self)(temporal.upsample(self.to_spark(), by, every, partition))
    def rolling_mean(self, by: str, value: str, window: str, output: str, min_rows: int = 1, closed: str = "left", partition: list[str] | None = None) -> Frame: return self._new(temporal.rolling_time(self.df, by, value, window, output, min_rows, closed, partition))
    rolling = rolling_mean

    def window_sum(self, value: str, partition: list[str], order: str, output: str) -> Frame:
        w = Window.partitionBy(*[_c(p) for p in partition]).orderBy(_c(order)).rowsBetween(Window.unboundedPreceding, 0)
        return self._new(self.df.withColumn(output, F.sum(_c(value).cast("double")).over(w)))

    # SQL, metadata, export ------------------------------------------------------------------
    def sql(self, query: str, table: str = "self") -> Frame:
        from .sql import SQLContext

        return SQLContext(self.spark, {table: self}).execute(query)

    @property
    def schema(self) -> dict[str, str]: return dict(self.to_spark().dtypes)
    collect_schema = schema
    @property
    def width(self) -> int: return len(self.columns)
    @property
    def height(self) -> int: return self.df.count()
    @property
    def shape(self) -> tuple[int, int]: return self.height, self.width
    @property
    def dtypes(self) -> list[str]: return [t for _, t in self.to_spark().dtypes]
    def is_empty(self) -> bool: return self.df.isEmpty()
    def get_column(self, name: str):
        from .series import Series

        return Series(self.with_order(), name)

    def get_columns(self) -> list: return [self.get_column(c) for c in self.columns]
    iter_columns = get_columns
    def get_column_index(self, name: str) -> int: return self.columns.index(name)
    def item(self, row: int, column: str): return self.slice(row, 1).to_spark().first()[column]
    def row(self, i: int) -> tuple: return tuple(self.slice(i, 1).to_spark().first())
    def rows(self) -> list[tuple]: return [tuple(r) for r in self.sorted_spark().collect()]
    def iter_rows(self) -> Iterator[tuple]: return (tuple(r) for r in self.sorted_spark().toLocalIterator())
    def rows_by_key(self, key: str) -> dict: return {r[key]: tuple(r) for r in self.sorted_spark().collect()}
    def to_dicts(self) -> list[dict]: return [r.asDict() for r in self.sorted_spark().collect()]
    def to_dict(self) -> dict[str, list]: return {c: [r[c] for r in rows] for rows in [self.sorted_spark().collect()] for c in self.columns}
    def to_pandas(self): return self.sorted_spark().toPandas()
    def to_numpy(self): return self.to_pandas().to_numpy()
    def to_arrow(self): return self.sorted_spark().toArrow()
    def estimated_size(self) -> int: return int(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    def flags(self) -> dict: return {c: {"has_nulls": n > 0} for c, n in self.null_count().to_spark().first().asDict().items()}
    def equals(self, other: Frame) -> bool: return self.schema == other.schema and self.to_spark().exceptAll(other.to_spark()).isEmpty() and other.to_spark().exceptAll(self.to_spark()).isEmpty()
    def serialize(self) -> str:
        import json

        return json.dumps({"schema": self.schema, "rows": self.to_dicts()}, default=str)

    def glimpse(self, n: int = 10) -> str: return "\n".join(f"{c} <{t}> {', '.join(str(r[c]) for r in rows)}" for rows in [self.limit(n).sorted_spark().collect()] for c, t in self.schema.items())
    show = glimpse
    def explain(self, mode: str = "formatted") -> str: return self.spark._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)
    show_graph = explain

    def iter_slices(self, rows: int = 10_000) -> Iterator[list[tuple]]: return self.collect_batches(rows)
    def series(self, name: str): return self.get_column(name)
    def to_series(self, i: int = 0): return self.get_column(self.columns[i])
    def n_chunks(self) -> int: return 1
    def to_init_repr(self) -> str: return f"Frame.from_dict(spark, {self.to_dict()!r}, {', '.join(f'{c} {t}' for c, t in self.schema.items())!r})"
    style = to_init_repr
    def plot(self) -> dict: return {"columns": self.columns, "rows": self.to_dict()}
    def to_jax(self): return self.select(*[E.col(c).cast("Float64") for c in stats.numeric(self.to_spark())]).to_numpy()
    to_torch = to_jax
    def fold(self, fn: Callable[[E.Expr, E.Expr], E.Expr], name: str = "fold") -> Frame: return self.select(E.fold(E.col(self.columns[0]), fn, [E.col(c) for c in self.columns[1:]]).alias(name))
    filter_aggregate_direct = filter_aggregate
    v_stack = vstack

    @classmethod
    def deserialize(cls, spark: SparkSession, text: str) -> Frame:
        import json

        d = json.loads(text)
        rows = spark.createDataFrame([(json.dumps(r),) for r in d["rows"]], "j string")
        schema = ", ".join(f"`{c}` {t}" for c, t in d["schema"].items())
        return cls(rows.select(F.from_json("j", schema).alias("r")).select("r.*"))

    def write_avro(self, path: str): return io().write(self, path, "avro")

    def _no_sink(self, *_, **__):
        raise NotImplementedError("this sink is not offered; write Parquet, CSV, JSON, Arrow IPC or a database table")

    write_clipboard = write_delta = write_excel = write_iceberg = sink_delta = sink_iceberg = _no_sink
    def inspect(self) -> Frame: return self
    def remote(self) -> Frame: return self
    def explain_diagnostics(self) -> dict: return {"logical": self.explain("extended"), "physical": self.explain("formatted"), "schema": self.schema}

    # running ---------------------------------------------------------------------------------
    def collect(self) -> Frame: return Frame(self.df, self.order)
    collect_streaming = collect

    def collect_async(self) -> Future:
        with ThreadPoolExecutor(1) as pool:
            return pool.submit(self.to_dicts)

    def collect_batches(self, size: int = 10_000) -> Iterator[list[tuple]]:
        batch: list[tuple] = []
        for r in self.iter_rows():
            batch.append(r)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    sink_batches = collect_batches

    def profile(self) -> dict:
        import time

        t = time.time()
        n = self.df.count()
        return {"rows": n, "seconds": time.time() - t, "plan": self.explain("simple")}

    # sinks: see sources.io ----------------------------------------------------------------------
    def write_csv(self, path: str, header: bool = True, separator: str = ",", single: bool = False): return io().write(self, path, "csv", single, header=header, sep=separator, escape=chr(34))
    def write_json(self, path: str, single: bool = False): return io().write(self, path, "json", single)
    write_ndjson = sink_ndjson = write_json
    sink_csv = write_csv
    def write_parquet(self, path: str, compression: str = "snappy", partition_by: list[str] | None = None, single: bool = False): return io().write(self, path, "parquet", single, partition_by, compression=compression)
    sink_parquet = write_parquet
    def write_ipc(self, path: str): return io().write_ipc(self, path)
    write_ipc_stream = sink_ipc = write_ipc
    def write_database(self, url: str, table: str, if_exists: str = "fail", **options): return io().write_database(self, url, table, if_exists, options)


def io():
    from .sources import io as module

    return module


class LazyFrame(Frame):
    """The lazy form: statistics of the population, linear quantiles, NaN kept in frame aggregates."""

    population = True
    nearest_quantile = False
    skip_nan = False


class GroupBy:
    def __init__(self, frame: Frame, keys: list[E.Expr], drop_null: bool = False):
        self.frame, self.keys, self.drop_null = frame, keys, drop_null

    def agg(self, *aggs: E.Expr) -> Frame:
        """Keys, then aggregates. Groups have no order unless the result is sorted."""
        f = self.frame
        env = f._env("agg")
        df = f.df.groupBy(*[k.build(env).alias(k.name) for k in self.keys]).agg(*[a.build(env).alias(a.name) for e in aggs for a in E.expand(e, f.columns)])
        if self.drop_null:
            df = df.dropna(subset=[self.keys[-1].name])
        return type(f)(df)

    def grouping(self, kind: str, *aggs: E.Expr) -> Frame:
        """``cube`` or ``rollup`` over the keys."""
        f = self.frame
        env = f._env("agg")
        keys = [k.build(env) for k in self.keys]
        return type(f)(getattr(f.df, kind)(*keys).agg(*[a.build(env).alias(a.name) for a in aggs]))

    def count(self) -> Frame: return self.agg(E.count())
