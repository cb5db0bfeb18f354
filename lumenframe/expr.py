"""Expressions: lazily built trees that compile to Spark Columns.

An expression knows how to build its Column in an environment (the frame's
types, row order, partition keys). Aggregates inside a projection are evaluated
once and joined back as a broadcast row; order-dependent expressions become
windows over the frame's order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalar as S


class Env:
    """Where an expression is compiled. mode: ``row`` (projection) or ``agg`` (inside a group)."""

    def __init__(self, df: DataFrame, order: list[Column], mode: str = "row"):
        self.df, self.order, self.mode = df, order, mode
        self.order_names: list[str] = []
        self.types = dict(df.dtypes)
        self.parts: list[Column] = []
        self.scalars: dict[str, Column] = {}
        self.made: dict[str, Column] = {}

    def frame(self) -> DataFrame:
        """The frame with aggregates joined as one broadcast row, then helper columns."""
        df = self.df
        if self.scalars:
            df = df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in self.scalars.items()])))
        for k, c in self.made.items():
            df = df.withColumn(k, c)
        return df

    def type_of(self, c: Column) -> str:
        return self.frame().select(c.alias("c")).dtypes[0][1]  # analysed only, never run

    def ahead(self, c: Column) -> Column:
        """The next value after this row that is not null. ``first`` over the rows that follow would scan them all again for each row."""
        key = f"__m{len(self.made)}"
        self.made[key] = c
        return F.expr(f"lead({key}) IGNORE NULLS").over(self.window())

    def is_float(self, e: Expr, c: Column) -> bool:
        t = self.types.get(e.root) if e.root else None
        return (t or self.type_of(c)) in ("double", "float")

    def is_whole(self, e: Expr, c: Column) -> bool:
        t = self.types.get(e.root) if e.root else None
        return (t or self.type_of(c)) in ("bigint", "int", "smallint", "tinyint")

    def window(self):
        if not self.order:
            raise ValueError("this expression depends on row order; sort the frame or read it with an order")
        w = Window.partitionBy(*self.parts) if self.parts else Window
        return w.orderBy(*self.order)

    def running(self):
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


class Expr:
    """kind: ``row``, ``agg`` or ``win``; root: the column it is, if it is just a column."""

    __slots__ = ("build", "kind", "name", "root", "names")

    def __init__(self, build: Callable[[Env], Column], name: str, kind: str = "row", root: str | None = None, names: list[str] | None = None):
        self.build, self.name, self.kind, self.root, self.names = build, name, kind, root, names

    # construction -------------------------------------------------------
    def _map(self, fn: Callable[..., Column], *others: Any) -> Expr:
        es = [wrap(o) for o in others]
        return Expr(lambda env: fn(self.build(env), *(e.build(env) for e in es)), self.name, _kind(self, *es))

    def _env(self, fn: Callable[..., Column], *others: Any, kind: str | None = None) -> Expr:
        es = [wrap(o) for o in others]
        return Expr(lambda env: fn(env, self.build(env), *(e.build(env) for e in es)), self.name, kind or _kind(self, *es))

    def alias(self, name: str) -> Expr:
        return Expr(self.build, name, self.kind, self.root)

    def cast(self, to: str) -> Expr:
        return self._map(lambda c: c.cast(TYPES.get(to, to)))

    def try_cast(self, to: str) -> Expr:
        return self._map(lambda c: c.try_cast(TYPES.get(to, to)))

    def exclude(self, *names: str) -> Expr:
        return Expr(self.build, self.name, self.kind, names=["!", *(self.names or ["*"]), "!", *names])

    def meta(self) -> dict:
        return {"name": self.name, "kind": self.kind, "root": self.root}

    # comparison ---------------------------------------------------------
    def _compare(self, op: str, other: Any) -> Expr:
        o = wrap(other)

        def build(env: Env) -> Column:
            a, b = self.build(env), o.build(env)
            is_float = env.is_float(self, a) or (not isinstance(other, (str, bool)) and isinstance(other, (float, Expr)) and env.is_float(o, b))
            return S.compare(op, a, b, is_float)

        return Expr(build, self.name, _kind(self, o))

    def eq(self, o): return self._compare("eq", o)
    def ne(self, o): return self._compare("ne", o)
    def gt(self, o): return self._compare("gt", o)
    def ge(self, o): return self._compare("ge", o)
    def lt(self, o): return self._compare("lt", o)
    def le(self, o): return self._compare("le", o)
    __eq__, __ne__, __gt__, __ge__, __lt__, __le__ = eq, ne, gt, ge, lt, le
    __hash__ = object.__hash__

    def eq_missing(self, o): return self._map(lambda a, b: a.eqNullSafe(b), o)
    def ne_missing(self, o): return self._map(lambda a, b: ~a.eqNullSafe(b), o)
    def and_(self, o): return self._map(lambda a, b: a & b, o)
    def or_(self, o): return self._map(lambda a, b: a | b, o)
    def xor(self, o): return self._map(lambda a, b: a != b, o)
    def not_(self): return self._map(lambda a: ~a)
    __and__, __or__, __xor__, __invert__ = and_, or_, xor, not_

    def is_between(self, lo, hi): return self.ge(lo).and_(self.le(hi))
    def is_close(self, o, tolerance: float = 1e-9): return self._map(lambda a, b: F.abs(a - b) <= tolerance, o)
    def is_in(self, values: Iterable): return self._map(lambda c: F.coalesce(c.isin(*[v for v in values if v is not None]), F.lit(None in list(values))))
    def is_nan(self): return self._env(lambda env, c: F.coalesce(F.isnan(c), F.lit(False)) if env.is_float(self, c) else F.lit(False))
    def is_not_nan(self): return self._env(lambda env, c: F.when(c.isNull(), F.lit(False)).otherwise(~F.isnan(c)) if env.is_float(self, c) else c.isNotNull())
    def is_finite(self): return self._env(lambda env, c: S.finite(c, env.is_float(self, c)))
    def is_infinite(self): return self._env(lambda env, c: F.coalesce(F.abs(c) == F.lit(S.INF), F.lit(False)) if env.is_float(self, c) else F.lit(False))

    # arithmetic ---------------------------------------------------------
    def add(self, o): return self._env(lambda env, a, b: F.concat(a, b) if env.type_of(a) == "string" else a + b, o)
    def sub(self, o): return self._map(lambda a, b: a - b, o)
    def mul(self, o): return self._map(lambda a, b: a * b, o)

    def div(self, o):
        e = wrap(o)
        return Expr(lambda env: (lambda a, b: S.divide(a, b, env.is_whole(self, a) and env.is_whole(e, b)))(self.build(env), e.build(env)), self.name, _kind(self, e))

    true_div = div
    def floor_div(self, o): return self._map(lambda a, b: F.floor(a.cast("double") / b).cast("double"), o)
    floordiv = floor_div
    def mod(self, o): return self._map(lambda a, b: a.cast("double") % b, o)
    def pow(self, o): return self._map(lambda a, b: F.pow(a.cast("double"), b), o)
    def __add__(self, o): return self.add(o)
    def __radd__(self, o): return wrap(o).add(self)
    def __sub__(self, o): return self.sub(o)
    def __rsub__(self, o): return wrap(o).sub(self)
    def __mul__(self, o): return self.mul(o)
    def __rmul__(self, o): return wrap(o).mul(self)
    def __truediv__(self, o): return self.div(o)
    def __floordiv__(self, o): return self.floor_div(o)
    def __mod__(self, o): return self.mod(o)
    def __pow__(self, o): return self.pow(o)
    def __neg__(self): return self.neg()
    def clip(self, lo, hi): return self._map(lambda c, a, b: F.least(F.greatest(c.cast("double"), a), b), float(lo), float(hi))
    def round(self): return self._map(lambda c: F.round(c.cast("double"), 0))
    def round_dp(self, d: int): return self._map(lambda c: S.round_dp(c, d))
    def round_sig_figs(self, d: int): return self._map(lambda c: S.round_sig_figs(c, d))
    def atan2(self, x): return self._map(F.atan2, x)

    # null, replace ------------------------------------------------------
    def fill_null(self, v): return self._map(F.coalesce, v)
    def fill_nan(self, v): return self._map(lambda c, x: F.when(F.isnan(c), x).otherwise(c), v)
    def replace(self, old, new): return self._map(lambda c, a, b: F.when(c.eqNullSafe(a), b).otherwise(c), old, new)
    def replace_strict(self, old, new): return self._map(lambda c, a, b: F.when(c.eqNullSafe(a), b).otherwise(c), old, new)
    def filter(self, mask): return self._map(lambda c, m: F.when(m, c), mask)
    where = filter

    # strings ------------------------------------------------------------
    def str_replace(self, p, r): return self._map(lambda c: S.replace_first(c, p, r))
    def str_replace_all(self, p, r): return self._map(lambda c: S.replace_all(c, p, r))
    def str_substr(self, start, length): return self._map(lambda c: F.substr(c, F.lit(max(start, 1)), F.lit(length)))
    def str_left(self, n): return self._map(lambda c: S.left(c, n))
    def str_right(self, n): return self._map(lambda c: S.right(c, n))
    def str_pad_start(self, n, fill=" "): return self._map(lambda c: F.lpad(c, n, fill))
    def str_pad_end(self, n, fill=" "): return self._map(lambda c: F.rpad(c, n, fill))
    def str_split_part(self, sep, n): return self._map(lambda c: F.split_part(c, F.lit(sep), F.lit(n)))
    def str_pos(self, s): return self._map(lambda c: F.nullif(F.instr(c, s), F.lit(0)).cast("long"))
    def str_like(self, p): return self._map(lambda c: S.like(c, p))
    def str_concat(self, o): return self._map(F.concat, o)
    def str_concat_ws(self, sep, o): return self._map(lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.concat_ws(sep, a, b)), o)
    def starts_with(self, o): return self._map(lambda a, b: a.startswith(b), o)
    def ends_with(self, o): return self._map(lambda a, b: a.endswith(b), o)
    def contains(self, o): return self._map(lambda a, b: a.contains(b), o)
    def regexp_like(self, p): return self._map(lambda c: c.rlike(p))
    def truncate(self, n): return self.str_left(n)

    # lists, structs, JSON -------------------------------------------------
    def list_contains(self, v): return self._map(lambda c: F.array_contains(c, v))
    def list_get(self, i): return self._map(lambda c: F.get(c, i) if i >= 0 else F.lit(None))
    get = gather = list_get
    def index_of(self, v): return self._map(lambda c: F.array_position(c, v) - 1)
    def append(self, v): return self._map(F.array_append, v)
    def struct_field(self, n): return Expr(lambda env: self.build(env).getField(n), n, self.kind)
    def from_json(self, schema): return self._map(lambda c: F.from_json(c, schema))
    def repeat_by(self, n): return self._map(F.array_repeat, n)

    # order-dependent ------------------------------------------------------
    def _win(self, fn: Callable[[Env, Column], Column]) -> Expr:
        return Expr(lambda env: fn(env, self.build(env)), self.name, "win")

    def over(self, *keys) -> Expr:
        ks = [wrap(k if isinstance(k, Expr) else col(k)) for k in keys]

        def build(env: Env) -> Column:
            outer, env.parts = env.parts, [k.build(env) for k in ks]
            try:
                return self.build(env)
            finally:
                env.parts = outer

        return Expr(build, self.name, "win")

    def cum_sum(self): return self._win(lambda env, c: F.coalesce(F.sum(c.cast("double")).over(env.running()), F.lit(0.0)))
    def cum_count(self): return self._win(lambda env, c: F.count(c).over(env.running()))
    def cum_max(self): return self._win(lambda env, c: F.max(c).over(env.running()))
    def cum_min(self): return self._win(lambda env, c: F.min(c).over(env.running()))
    def cum_prod(self): return self._win(lambda env, c: F.product(c.cast("double")).over(env.running()))
    def shift(self, n=1): return self._win(lambda env, c: F.lag(c, n).over(env.window()) if n >= 0 else F.lead(c, -n).over(env.window()))
    def lag(self, n=1, default=None): return self._win(lambda env, c: F.lag(c, n, default).over(env.window()))
    def lead(self, n=1, default=None): return self._win(lambda env, c: F.lead(c, n, default).over(env.window()))
    def first_value(self): return self._win(lambda env, c: F.first(c).over(env.whole()))
    def last_value(self): return self._win(lambda env, c: F.last(c).over(env.whole()))
    def diff(self, n=1): return self._win(lambda env, c: c - F.lag(c, max(n, 1)).over(env.window()))
    def pct_change(self, n=1): return self._win(lambda env, c: F.try_divide(c - F.lag(c, n).over(env.window()), F.lag(c, n).over(env.window())))
    def forward_fill(self): return self._win(lambda env, c: F.last(c, ignorenulls=True).over(env.running()))
    def backward_fill(self): return self._win(lambda env, c: F.coalesce(c, env.ahead(c)))
    def reverse(self): return self._win(lambda env, c: F.element_at(F.collect_list(F.struct(c.alias("v"))).over(env.whole()), -F.row_number().over(env.window()))["v"])
    def row_number(self): return self._win(lambda env, c: F.row_number().over(env.window()).cast("long"))

    def rank(self, method: str = "ordinal", descending: bool = False):
        def build(env: Env, c: Column) -> Column:
            key = c.desc_nulls_first() if descending else c.asc_nulls_first()
            w = Window.partitionBy(*(env.parts or [F.lit(0)]))
            fn = {"ordinal": F.row_number, "min": F.rank, "dense": F.dense_rank}[method]
            return fn().over(w.orderBy(key, *env.order) if method == "ordinal" else w.orderBy(key)).cast("long")

        return self._win(build)

    def dense_rank(self): return self.rank("dense")

    def peak_max(self): return self._win(lambda env, c: F.coalesce((c > F.lag(c).over(env.window())) & (c > F.lead(c).over(env.window())), F.lit(False)))
    def peak_min(self): return self._win(lambda env, c: F.coalesce((c < F.lag(c).over(env.window())) & (c < F.lead(c).over(env.window())), F.lit(False)))
    def is_duplicated(self): return self._win(lambda env, c: F.count(F.lit(1)).over(Window.partitionBy(*env.parts, c)) > 1)
    def is_unique(self): return self._win(lambda env, c: F.count(F.lit(1)).over(Window.partitionBy(*env.parts, c)) == 1)
    def is_first_distinct(self): return self._win(lambda env, c: F.row_number().over(Window.partitionBy(*env.parts, c).orderBy(*env.order)) == 1)
    def is_last_distinct(self): return self._win(lambda env, c: F.lead(F.lit(1)).over(Window.partitionBy(*env.parts, c).orderBy(*env.order)).isNull())

    def _rolling(self, size: int, fn: Callable[[Column], Column] | float, strict: bool, minimum: int | None, order: Expr | None = None) -> Expr:
        # A number stands for a quantile: those take no window frame, so they come from the frame's sorted values.
        def build(env: Env, c: Column) -> Column:
            is_float = env.is_float(self, c)
            w = env.window() if order is None else Window.partitionBy(*(env.parts or [F.lit(0)])).orderBy(order.build(env), *env.order)
            w = w.rowsBetween(-(size - 1), 0)
            x = S.nan_to_null(c, is_float) if strict else c
            need = minimum if minimum is not None else (size if strict else 1)
            value = S.array_quantile(F.collect_list(x).over(w), fn) if isinstance(fn, float) else fn(x).over(w)
            return F.when(F.count(x).over(w) >= need, value)

        return self._win(build)

    # aggregates -------------------------------------------------------------
    def _agg(self, fn: Callable[[Env, Column], Column], name: str) -> Expr:
        def build(env: Env) -> Column:
            c = fn(env, self.build(env))
            if env.mode == "agg":
                return c
            if env.parts:
                return c.over(Window.partitionBy(*env.parts))
            key = f"__s{len(env.scalars)}"
            env.scalars[key] = c
            return F.col(key)

        return Expr(build, f"{name}_{self.name}", "agg")

    def _clean(self, env: Env, c: Column) -> Column:
        return S.nan_to_null(c, env.is_float(self, c))

    def sum(self): return self._agg(lambda env, c: F.sum(self._clean(env, c)), "sum")
    def mean(self): return self._agg(lambda env, c: F.avg(self._clean(env, c)), "mean")
    def min(self): return self._agg(lambda env, c: F.min(self._clean(env, c)), "min")
    def max(self): return self._agg(lambda env, c: F.max(self._clean(env, c)), "max")
    def median(self): return self._agg(lambda env, c: F.median(self._clean(env, c)), "median")
    def std(self, ddof: int = 1): return self._agg(lambda env, c: (F.stddev_samp if ddof else F.stddev_pop)(self._clean(env, c)), "std")
    def var(self, ddof: int = 1): return self._agg(lambda env, c: (F.var_samp if ddof else F.var_pop)(self._clean(env, c)), "var")
    def quantile(self, q: float): return self._agg(lambda env, c: F.percentile(self._clean(env, c), q), "quantile")
    def n_unique(self): return self._agg(lambda env, c: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0)), "n_unique")
    def count_distinct(self): return self._agg(lambda env, c: F.count_distinct(c), "count_distinct")
    def approx_n_unique(self): return self._agg(lambda env, c: F.approx_count_distinct(c), "approx_n_unique")
    def count(self): return self._agg(lambda env, c: F.count(c), "count")
    def null_count(self): return self._agg(lambda env, c: F.count_if(c.isNull()), "null_count")
    def product(self): return self._agg(lambda env, c: F.product(self._clean(env, c).cast("double")), "product")
    def skew(self): return self._agg(lambda env, c: F.coalesce(F.skewness(self._clean(env, c)), F.lit(0.0)), "skew")
    def kurtosis(self): return self._agg(lambda env, c: F.coalesce(F.kurtosis(self._clean(env, c)), F.lit(0.0)), "kurtosis")
    def mode(self): return self._agg(lambda env, c: F.mode(c), "mode")
    def implode(self): return self._agg(lambda env, c: F.collect_list(c), "implode")
    agg_groups = implode
    def nan_max(self): return self._agg(lambda env, c: F.max(c), "nan_max")
    def nan_min(self): return self._agg(lambda env, c: F.when(F.bool_or(F.isnan(c)), F.lit(S.NAN)).otherwise(F.min(c)), "nan_min")
    def all(self): return self._agg(lambda env, c: F.bool_and(F.coalesce(c, F.lit(False))), "all")
    def any(self): return self._agg(lambda env, c: F.bool_or(c), "any")
    def has_nulls(self): return self._agg(lambda env, c: F.bool_or(c.isNull()), "has_nulls")
    def dot(self, o): return self.mul(o).sum()
    def max_by(self, by): return self._by(by, F.max_by, "max_by", Column.isNotNull)
    def min_by(self, by): return self._by(by, F.min_by, "min_by", Column.isNull)

    def _by(self, by, fn, name, odd):
        """Of rows that tie on ``by``, min_by takes the least value and max_by the greatest, so a result does not hang on how rows are spread. Maps have no order."""
        b = wrap(by)

        def build(env: Env, c: Column) -> Column:
            k = b.build(env)
            return fn(c, k if "map<" in env.type_of(c) else F.when(k.isNotNull(), F.struct(k, odd(c), c)))

        return self._agg(build, name)

    def first(self): return self._agg(lambda env, c: F.min_by(F.struct(c.alias("v")), F.struct(*_order_keys(env)))["v"], "first")
    def last(self): return self._agg(lambda env, c: F.max_by(F.struct(c.alias("v")), F.struct(*_order_keys(env)))["v"], "last")
    item = first

    def arg_max(self): return self._agg(lambda env, c: F.max_by(F.struct(*_order_keys(env)), c), "arg_max")
    def arg_min(self): return self._agg(lambda env, c: F.min_by(F.struct(*_order_keys(env)), c), "arg_min")
    def lower_bound(self, v): return self._agg(lambda env, c: F.count_if(c < F.lit(v)), "lower_bound")
    search_sorted = lower_bound
    def upper_bound(self, v): return self._agg(lambda env, c: F.count_if(c <= F.lit(v)), "upper_bound")

    # lists of a group's values ------------------------------------------------
    # These change the number of rows, so as expressions they give one list for each group (or
    # partition). For a whole frame the Frame's methods of the same names stay distributed.
    def _gather(self, fn: Callable[[Column], Column], name: str, by: Any = None) -> Expr:
        def values(env: Env, c: Column) -> Column:
            keys = [wrap(by).build(env)] if by is not None else []
            keys += [F.col(k) for k in env.order_names]
            if not keys:
                return fn(F.collect_list(F.struct(c.alias("v"))).getField("v"))
            rows = F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], c.alias("v"))))
            return fn(rows.getField("v"))

        return self._agg(values, name)

    def head(self, n: int = 10): return self._gather(lambda a: F.slice(a, 1, n), "head")
    limit = head
    def tail(self, n: int = 10): return self._gather(lambda a: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n)), "tail")
    def slice(self, offset: int, length: int): return self._gather(lambda a: F.slice(a, offset + 1, length), "slice")
    def gather_every(self, n: int): return self._gather(lambda a: F.filter(a, lambda x, i: i % n == 0), "gather_every")
    def unique(self): return self._gather(F.array_distinct, "unique")
    def sort(self, descending: bool = False): return self._gather(lambda a: F.sort_array(a, not descending), "sort")
    def sort_by(self, by): return self._gather(lambda a: a, "sort_by", by)
    def top_k(self, k: int): return self._gather(lambda a: F.slice(F.sort_array(a, False), 1, k), "top_k")
    def bottom_k(self, k: int): return self._gather(lambda a: F.slice(F.sort_array(a), 1, k), "bottom_k")
    def top_k_by(self, by, k: int): return self._gather(lambda a: F.slice(F.reverse(a), 1, k), "top_k_by", by)
    def bottom_k_by(self, by, k: int): return self._gather(lambda a: F.slice(a, 1, k), "bottom_k_by", by)
    def shuffle(self): return self._gather(F.shuffle, "shuffle")
    def sample(self, n: int): return self._gather(lambda a: F.slice(F.shuffle(a), 1, n), "sample")
    def drop_nulls(self): return self._gather(F.array_compact, "drop_nulls")
    def drop_nans(self): return self._gather(lambda a: F.filter(a, lambda x: F.coalesce(~F.isnan(x), F.lit(True))), "drop_nans")
    def arg_sort(self): return self._gather(lambda a: F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))).getField("i"), "arg_sort")
    def arg_true(self): return self._gather(lambda a: F.array_compact(F.transform(a, lambda x, i: F.when(x, i))), "arg_true")
    def arg_unique(self): return self._gather(lambda a: F.transform(F.array_distinct(a), lambda v: F.array_min(F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i)), lambda i: i.isNotNull()))), "arg_unique")
    def value_counts(self): return self._gather(lambda a: F.transform(F.array_distinct(a), lambda v: F.struct(v.alias("value"), F.size(F.filter(a, lambda x: x.eqNullSafe(v))).alias("count"))), "value_counts")
    def unique_counts(self): return self._gather(lambda a: F.transform(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda x: x.eqNullSafe(v)))), "unique_counts")
    def entropy(self):
        def value(a: Column) -> Column:
            n = F.size(a).cast("double")
            shares = F.transform(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda x: x.eqNullSafe(v))) / n)
            return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.ln(p))

        return self._gather(value, "entropy")

    def hist(self, bins: int):
        def value(a: Column) -> Column:
            lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
            width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
            place = F.transform(F.array_compact(a), lambda x: F.least(F.floor((x - lo) / width), F.lit(bins - 1)))
            return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda p: p == b)))

        return self._gather(value, "hist")

    def rle(self):
        def value(a: Column) -> Column:
            starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(a, i - 1)), i)), lambda i: i.isNotNull())
            return F.transform(starts, lambda s, k: F.struct(F.get(a, s).alias("value"), (F.coalesce(F.get(starts, k + 1), F.size(a)) - s).alias("len")))

        return self._gather(value, "rle")

    def rle_id(self):
        def value(a: Column) -> Column:
            change = F.transform(a, lambda x, i: F.when((i > 0) & ~x.eqNullSafe(F.get(a, i - 1)), 1).otherwise(0))
            return F.transform(change, lambda _, i: F.aggregate(F.slice(change, F.lit(1), i + 1), F.lit(0), lambda acc, x: acc + x))

        return self._gather(value, "rle_id")

    def reshape(self, width: int): return self._gather(lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, F.lit(width))), "reshape")
    def extend_constant(self, v, n: int): return self._gather(lambda a: F.concat(a, F.array_repeat(F.lit(v), n)), "extend_constant")
    def cumulative_eval(self, fn: Callable[[Column], Column]): return self._gather(lambda a: F.transform(a, lambda x, i: fn(F.slice(a, F.lit(1), i + 1))), "cumulative_eval")

    def interpolate(self):
        def value(a: Column) -> Column:
            known = F.filter(F.transform(a, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

            def at(x: Column, i: Column) -> Column:
                p, q = F.array_max(F.filter(known, lambda k: k < i)), F.array_min(F.filter(known, lambda k: k > i))
                y, z = F.get(a, p).cast("double"), F.get(a, q).cast("double")
                return F.when(x.isNotNull(), x.cast("double")).otherwise(y + (z - y) * (i - p) / (q - p))

            return F.transform(a, at)

        return self._gather(value, "interpolate")

    def interpolate_by(self, by):
        """Linear in ``by``, which the frame is ordered by; the ends stay null."""
        b = wrap(by)

        def build(env: Env, c: Column) -> Column:
            x, known = b.build(env).cast("double"), F.when(c.isNotNull(), F.struct(b.build(env).cast("double").alias("x"), c.cast("double").alias("y")))
            lo, hi = F.last(known, ignorenulls=True).over(env.running()), env.ahead(known)
            return F.when(c.isNotNull(), c.cast("double")).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (x - lo["x"]) / (hi["x"] - lo["x"]))

        return self._win(build)

    def _ewm(self, alpha: float, pick: Callable[[Column, Column], Column], name: str, by: Any = None) -> Expr:
        def value(a: Column) -> Column:
            start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("out"))

            def step(acc: Column, x: Column) -> Column:
                x = x.cast("double")
                m = F.when(x.isNull(), acc["m"]).when(acc["m"].isNull(), x).otherwise(x * alpha + acc["m"] * (1 - alpha))
                v = F.when(x.isNull() | acc["m"].isNull(), acc["v"]).otherwise(acc["v"] * (1 - alpha) + (x - m) * (x - m) * alpha)
                return F.struct(m.alias("m"), v.alias("v"), F.array_append(acc["out"], F.when(x.isNotNull(), pick(m, v))).alias("out"))

            return F.aggregate(a, start, step, lambda acc: acc["out"])

        return self._gather(value, name, by)

    def ewm_mean(self, alpha: float = 0.5): return self._ewm(alpha, lambda m, v: m, "ewm_mean")
    def ewm_var(self, alpha: float = 0.5): return self._ewm(alpha, lambda m, v: v, "ewm_var")
    def ewm_std(self, alpha: float = 0.5): return self._ewm(alpha, lambda m, v: F.sqrt(v), "ewm_std")
    def ewm_mean_by(self, by, alpha: float = 0.5): return self._ewm(alpha, lambda m, v: m, "ewm_mean", by)

    def qcut(self, quantiles: list[float]):
        qs = [self.quantile(q) for q in quantiles]

        def build(env: Env) -> Column:
            c, breaks = self.build(env), [q.build(env) for q in qs]
            out = F.when(c.isNull(), F.lit(None).cast("string"))
            for b in breaks:
                out = out.when(c <= b, F.concat(F.lit("<= "), b.cast("string")))
            return out.otherwise(F.concat(F.lit("> "), breaks[-1].cast("string")))

        return Expr(build, self.name, "win")

    def _rank_in(self, size: int, order: Expr | None) -> Expr:
        def build(env: Env, c: Column) -> Column:
            w = env.window() if order is None else Window.partitionBy(*(env.parts or [F.lit(0)])).orderBy(order.build(env), *env.order)
            a = F.collect_list(c).over(w.rowsBetween(-(size - 1), 0))
            below, same = F.size(F.filter(a, lambda x: x < c)), F.size(F.filter(a, lambda x: x == c))
            return F.when(F.size(a) >= size, below + (same + 1) / 2)

        return self._win(build)

    def rolling_rank(self, size: int, strict: bool = True): return self._rank_in(size, None)
    def rolling_rank_by(self, by, size: int): return self._rank_in(size, wrap(by))
    def reinterpret(self, *_): raise NotImplementedError("values of one type are not bits of another here")

    @staticmethod
    def deserialize(text: str) -> Expr:
        """A column expression from ``{"root": name, "name": alias}``."""
        import json

        d = json.loads(text)
        return col(d["root"]).alias(d.get("name", d["root"]))

    # binning, user functions --------------------------------------------------
    def cut(self, breaks: list[float]):
        def build(c: Column) -> Column:
            out = F.when(c.isNull(), F.lit(None).cast("string"))
            for b in breaks:
                out = out.when(c <= b, F.lit(f"<= {b:g}"))
            return out.otherwise(F.lit(f"> {breaks[-1]:g}"))

        return self._map(build)

    def map_elements(self, fn: Callable, returns: str = "double"):
        f = F.udf(lambda x: None if x is None else fn(x), returns, useArrow=True)
        return self._map(f)

    def map_batches(self, fn: Callable, returns: str = "double"):
        return self._map(F.pandas_udf(fn, returns))

    def pipe(self, fn: Callable, *args): return fn(self, *args)

    def rolling_map(self, size: int, fn: Callable, returns: str = "double"):
        f = F.udf(lambda xs: fn(xs) if xs else None, returns)
        return self._win(lambda env, c: f(F.collect_list(c).over(env.window().rowsBetween(-(size - 1), 0))))

    # namespaces -----------------------------------------------------------------
    @property
    def str(self): return Names(self, "str_")
    @property
    def dt(self): return Names(self, "dt_")
    @property
    def list(self): return Names(self, "list_")
    @property
    def arr(self): return Names(self, "list_")
    @property
    def struct(self): return Names(self, "struct_")
    @property
    def bin(self): return Names(self, "bitwise_")
    @property
    def cat(self): return Names(self, "cat_")
    @property
    def ext(self): return Names(self, "ext_")

    def __getitem__(self, k): return self.struct_field(k) if isinstance(k, str) else self.list_get(k)
    def __repr__(self): return f"Expr({self.name}, {self.kind})"


class Names:
    """An accessor: ``e.str.lower()`` is ``e.str_lower()``."""

    def __init__(self, e: Expr, prefix: str):
        self._e, self._p = e, prefix

    def __getattr__(self, name: str):
        for full in (self._p + name, name):
            if hasattr(Expr, full):
                return getattr(self._e, full)
        raise AttributeError(name)


def _order_keys(env: Env) -> list[Column]:
    if not env.order:
        raise ValueError("this aggregate depends on row order; sort the frame or read it with an order")
    return [F.col(k) for k in env.order_names]


def _kind(*es: Expr) -> str:
    kinds = {e.kind for e in es}
    return "win" if "win" in kinds else "agg" if "agg" in kinds else "row"


def _plain(fn: Callable[[Column], Column]):
    return lambda self: self._map(fn)


_double = lambda fn: lambda c: fn(c.cast("double"))
UNARY: dict[str, Callable[[Column], Column]] = {
    "is_null": lambda c: c.isNull(), "is_not_null": lambda c: c.isNotNull(), "neg": lambda c: -c, "abs": F.abs,
    "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"), "sign": _double(F.signum),
    "sqrt": _double(F.sqrt), "cbrt": _double(F.cbrt), "exp": _double(F.exp), "log": S.log, "log10": lambda c: S.log(c, F.log10), "log1p": S.log1p,
    "sin": _double(F.sin), "cos": _double(F.cos), "tan": _double(F.tan), "cot": _double(F.cot), "sinh": _double(F.sinh), "cosh": _double(F.cosh), "tanh": _double(F.tanh),
    "arcsin": _double(F.asin), "arccos": _double(F.acos), "arctan": _double(F.atan), "arcsinh": _double(F.asinh), "arccosh": _double(F.acosh), "arctanh": _double(F.atanh),
    "degrees": _double(F.degrees), "radians": _double(F.radians),
    "bitwise_count_ones": lambda c: F.bit_count(c).cast("long"), "bitwise_count_zeros": lambda c: (64 - F.bit_count(c)).cast("long"),
    "bitwise_leading_zeros": S.leading_zeros, "bitwise_leading_ones": lambda c: S.leading_zeros(F.bitwise_not(c)),
    "bitwise_trailing_zeros": S.trailing_zeros, "bitwise_trailing_ones": lambda c: S.trailing_zeros(F.bitwise_not(c)),
    "str_len": lambda c: F.octet_length(c).cast("long"), "str_char_len": lambda c: F.char_length(c).cast("long"), "str_lower": F.lower, "str_upper": F.upper,
    "str_trim": S.trim, "str_l_trim": lambda c: S.trim(c, "left"), "str_r_trim": lambda c: S.trim(c, "right"), "str_reverse": F.reverse, "str_to_title": S.title,
    "dt_year": lambda c: F.year(c).cast("long"), "dt_month": lambda c: F.month(c).cast("long"), "dt_day": lambda c: F.dayofmonth(c).cast("long"), "dt_hour": lambda c: F.hour(c).cast("long"),
    "dt_minute": lambda c: F.minute(c).cast("long"), "dt_second": lambda c: F.second(c).cast("long"), "dt_weekday": lambda c: (F.weekday(c) + 1).cast("long"), "dt_ordinal_day": lambda c: F.dayofyear(c).cast("long"),
    "list_len": lambda c: F.array_size(c).cast("long"), "hash": F.xxhash64, "explode": F.explode_outer, "flatten": F.flatten, "struct_flatten": lambda c: c,
    "rechunk": lambda c: c, "set_sorted": lambda c: c, "to_physical": lambda c: c, "inspect": lambda c: c, "shrink_dtype": lambda c: c, "cat_codes": lambda c: F.xxhash64(c),
}
for _n, _f in UNARY.items():
    setattr(Expr, _n, _plain(_f))
for _n, _f in {"bitwise_and": "bitwiseAND", "bitwise_or": "bitwiseOR", "bitwise_xor": "bitwiseXOR"}.items():
    setattr(Expr, _n, lambda self, o, m=_f: self._map(lambda a, b: getattr(a, m)(b), o))

#: Rolling aggregates. Expression form: at least one value; Series form (strict): a full window, NaN left out.
ROLLING: dict[str, Callable[[Column], Column] | float] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "median": 0.5, "skew": F.skewness, "kurtosis": F.kurtosis}
for _n, _f in ROLLING.items():
    setattr(Expr, f"rolling_{_n}", lambda self, size, strict=False, min_periods=None, f=_f, n=_n: self._rolling(size, {"std": F.stddev_samp, "var": F.var_samp}.get(n, f) if strict else f, strict or n in ("min", "max"), min_periods if min_periods is not None else (size if strict else 1)))
    setattr(Expr, f"rolling_{_n}_by", lambda self, by, size, min_periods=None, f=_f, n=_n: self._rolling(size, {"std": F.stddev_samp, "var": F.var_samp}.get(n, f), True, min_periods, wrap(by)))
Expr.rolling = Expr.rolling_mean
Expr.rolling_quantile = lambda self, size, q, strict=True: self._rolling(size, float(q), strict, None)
Expr.rolling_quantile_by = lambda self, by, size, q: self._rolling(size, float(q), True, None, wrap(by))

#: Names of the engine's types.
TYPES = {"Int64": "bigint", "Float64": "double", "String": "string", "Boolean": "boolean", "Datetime": "timestamp_ntz", "Binary": "binary", "Decimal": "decimal(38,10)", "Categorical": "string", "Enum": "string", "Duration": "interval day to second"}


def wrap(v: Any) -> Expr:
    return v if isinstance(v, Expr) else lit(v)


def col(name: str) -> Expr:
    """A column, or every column that ``^regex$`` matches."""
    if name.startswith("^") and name.endswith("$"):
        return Expr(lambda env: F.col(name), name, names=[name])
    return Expr(lambda env: F.col(f"`{name}`"), name, root=name)


def all_() -> Expr:
    return Expr(lambda env: F.col("*"), "*", names=["*"])


def cols(*names: str) -> Expr:
    return Expr(lambda env: F.col(names[0]), names[0], names=list(names))


def exclude(*names: str) -> Expr:
    return all_().exclude(*names)


def lit(v: Any) -> Expr:
    return Expr(lambda env: F.lit(v), "literal")


def struct_cols(*names: str) -> Expr:
    return Expr(lambda env: F.struct(*[F.col(f"`{n}`") for n in names]), "struct")


def when(c, then, otherwise) -> Expr:
    a, b, d = wrap(c), wrap(then), wrap(otherwise)
    return Expr(lambda env: F.when(a.build(env), b.build(env)).otherwise(d.build(env)), b.name, _kind(a, b, d))


def fold(start, fn: Callable[[Expr, Expr], Expr], exprs: Iterable[Expr]) -> Expr:
    """A left fold over columns; fn combines two expressions."""
    return functools.reduce(fn, [wrap(e) for e in exprs], wrap(start))


def count() -> Expr:
    """Rows of the group, nulls included."""
    return Expr(lambda env: F.count(F.lit(1)), "count", "agg")


def expand(e: Expr, names: list[str]) -> list[Expr]:
    """Selectors as single columns."""
    if e.names is None:
        return [e]
    if e.names[0] == "!":
        cut = len(e.names) - 1 - e.names[::-1].index("!")
        base = expand(Expr(e.build, e.name, names=e.names[1:cut]), names)
        return [x for x in base if x.name not in e.names[cut + 1 :]]
    out: list[Expr] = []
    for n in e.names:
        out += [col(x) for x in names] if n == "*" else [col(x) for x in names if re.search(n, x)] if n.startswith("^") else [col(n)]
    return out
