"""Series: one ordered column, as a facade over a frame and a column name.

Element-wise and order-dependent methods are those of expressions and give a
Series; reductions run one aggregate and give a value (0 for empty input, as
documented). Rolling methods need a full window and leave NaN out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import expr as E
from .frame import Frame
from .operators import stats


class Series:
    def __init__(self, frame: Frame, name: str):
        self.frame, self.name = frame.with_order(), name

    @classmethod
    def of(cls, spark: SparkSession, name: str, values: list, dtype: str) -> Series:
        return cls(Frame.from_dict(spark, {name: values}, f"`{name}` {E.TYPES.get(dtype, dtype)}"), name)

    # plumbing ------------------------------------------------------------
    def _map(self, e: E.Expr) -> Series: return Series(self.frame.select(e.alias(self.name)), self.name)
    def _with(self, other: Series) -> tuple[Frame, str]:
        """A frame that holds the other series' values beside this one's, by row number."""
        o = other.frame.select(E.col(other.name).alias("other__"))
        return self.frame.select(E.col(self.name)).hstack(o), "other__"

    def _two(self, other: Any, method: str) -> Series:
        if isinstance(other, Series):
            f, o = self._with(other)
            return Series(f.select(getattr(E.col(self.name), method)(E.col(o)).alias(self.name)), self.name)
        return self._map(getattr(E.col(self.name), method)(other))

    def _value(self, e: E.Expr, empty: Any = None) -> Any:
        v = self.frame.select(e.alias("v")).to_spark().first()[0]
        return empty if v is None else v

    @property
    def _e(self) -> E.Expr: return E.col(self.name)

    # access -----------------------------------------------------------------
    @property
    def data_type(self) -> str: return self.frame.schema[self.name]
    def to_frame(self) -> Frame: return self.frame.select(self._e)
    def to_list(self) -> list: return [r[0] for r in self.to_frame().sorted_spark().collect()]
    def to_arrow(self): return self.to_frame().to_arrow().column(0)
    def to_pandas(self): return self.to_frame().to_pandas()[self.name]
    def to_numpy(self): return self.to_pandas().to_numpy()
    def value(self, i: int): return self.frame.item(i, self.name)
    item = value
    def __len__(self) -> int: return self.frame.height
    def len(self) -> int: return self.frame.height
    def is_empty(self) -> bool: return self.frame.is_empty()
    def alias(self, name: str) -> Series: return Series(self.frame.select(self._e.alias(name)), name)
    rename = alias
    def equals(self, other: Series) -> bool: return self.data_type == other.data_type and self.to_list() == other.to_list()
    def describe(self) -> dict: return {"len": self.len(), "null_count": self.null_count(), "dtype": self.data_type, "min": self.min(), "max": self.max(), "mean": self.mean()}

    def _typed(self) -> tuple[list, list[bool]]:
        """Values and the mask of those that are not null."""
        values = self.to_list()
        return values, [v is not None for v in values]

    int64_values = float64_values = string_values = bool_values = datetime_values = _typed
    @property
    def shape(self) -> tuple[int]: return (self.len(),)
    def n_chunks(self) -> int: return 1
    def chunk_lengths(self) -> list[int]: return [self.len()]
    def get_chunks(self) -> list[Series]: return [self]
    def flags(self) -> dict: return {"sorted": self.is_sorted(), "has_nulls": self.has_nulls()}
    def estimated_size(self) -> int: return self.to_frame().estimated_size()
    def to_jax(self): return self.cast("Float64").to_numpy()
    to_torch = to_jax
    def to_init_repr(self) -> str: return f"Series.of(spark, {self.name!r}, {self.to_list()!r}, {self.data_type!r})"
    def serialize(self) -> str: return self.to_frame().serialize()

    @classmethod
    def deserialize(cls, spark: SparkSession, text: str) -> Series:
        f = Frame.deserialize(spark, text)
        return cls(f, f.columns[0])

    def reshape(self, *shape: int) -> Series:
        if functools.reduce(lambda a, b: a * b, shape, 1) != self.len():
            raise ValueError("the shape does not hold as many values")
        return self

    def interpolate_by(self, by: Series) -> Series: return (lambda f: Series(f[0].interpolate(self.name, by=f[1]), self.name))(self._with(by))
    def ewm_mean_by(self, by: Series, alpha: float = 0.5) -> Series: return (lambda f: Series(f[0].sort(f[1]), self.name).ewm_mean(alpha))(self._with(by))
    def _by(self, method: str, by: Series, *args) -> Series: return (lambda f: Series(f[0].select(getattr(E.col(self.name), method)(E.col(f[1]), *args).alias(self.name)), self.name))(self._with(by))
    def rolling_rank(self, size: int) -> Series: return self._map(self._e.rolling_rank(size))

    # reductions -----------------------------------------------------------------
    def sum(self): return self._value(self._number().sum(), 0)
    def mean(self): return self._value(self._number().mean(), 0)
    def min(self): return self._extreme("min")
    def max(self): return self._extreme("max")
    def median(self): return self.quantile(0.5)
    def std(self): return self._value(self._e.std(), 0)
    def var(self): return self._value(self._e.var(), 0)
    def skew(self): return self._value(self._e.skew(), 0)
    def kurtosis(self): return self._value(self._e.kurtosis(), 0)
    def quantile(self, q: float): return (lambda v: 0 if v is None else v)(stats.quantile(self.frame.df, min(max(q, 0.0), 1.0), [self.name]).first()[0])
    def product(self): return self._value(self._e.product(), 0)
    def n_unique(self): return self._value(self._e.count_distinct(), 0)
    approx_n_unique = n_unique
    def count(self): return self._value(self._e.count(), 0)
    def null_count(self): return self._value(self._e.null_count(), 0)
    def has_nulls(self): return self._value(self._e.has_nulls(), False)
    has_validity = has_nulls
    def nan_min(self): return self._value(self._e.nan_min(), 0)
    def nan_max(self): return self._value(self._e.nan_max(), 0)
    def all(self): return self._value(self._e.all(), False)
    def any(self): return self._value(self._e.any(), False)
    def first(self): return self._value(self._e.first())
    def last(self): return self._value(self._e.last())
    def dot(self, other: Series): return (lambda f: f[0].select((E.col(self.name) * E.col(f[1])).sum().alias("v")).to_spark().first()[0])(self._with(other))
    def entropy(self): return stats.entropy(self.frame.df, self.name).first()[0]

    def _number(self) -> E.Expr: return self._e.cast("bigint") if self.data_type == "boolean" else self._e

    def _extreme(self, how: str):
        v = self._value(getattr(self._e, how)())
        return v if v is not None else self._value(self._e.nan_max(), 0)  # all NaN, or empty

    def mode(self):
        counts = self._indexed().groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"))
        return counts.orderBy(F.desc("n"), "i").first()[0]

    def _indexed(self):
        """Spark rows (i, v)."""
        return self.frame.select(self._e.alias("v")).with_row_index("i").to_spark().select("i", "v")

    def arg_max(self) -> int: return self._arg(F.desc("v"))
    def arg_min(self) -> int: return self._arg(F.asc("v"))

    def _arg(self, key) -> int:
        row = self._indexed().where("v IS NOT NULL").orderBy(key, "i").first()
        return -1 if row is None else row[0]

    def index_of(self, v) -> int: return (lambda r: -1 if r[0] is None else r[0])(self._indexed().where(F.col("v").eqNullSafe(F.lit(v))).agg(F.min("i")).first())
    def lower_bound(self, v) -> int: return self._value(self._e.lower_bound(v), 0)
    search_sorted = lower_bound
    def upper_bound(self, v) -> int: return self._value(self._e.upper_bound(v), 0)
    def is_sorted(self) -> bool: return not self.frame.select(self._e.diff().alias("d")).filter(E.col("d") < 0).height

    # order and selection ------------------------------------------------------------
    def sort(self, descending: bool = False) -> Series: return Series(self.frame.select(self._e).sort(self.name, descending), self.name)
    def head(self, n: int = 10) -> Series: return Series(self.frame.limit(n), self.name)
    limit = head
    def tail(self, n: int = 10) -> Series: return Series(self.frame.tail(n), self.name)
    def slice(self, offset: int, length: int) -> Series: return Series(self.frame.slice(offset, length), self.name)
    def reverse(self) -> Series: return Series(self.frame.reverse(), self.name)
    def gather_every(self, n: int) -> Series: return Series(self.frame.gather_every(n), self.name)
    def top_k(self, k: int) -> Series: return self.sort(True).head(k)
    def bottom_k(self, k: int) -> Series: return self.sort().head(k)
    def top_k_by(self, by: Series, k: int) -> Series: return (lambda f: Series(f[0].sort(f[1], True).limit(k), self.name))(self._with(by))
    def bottom_k_by(self, by: Series, k: int) -> Series: return (lambda f: Series(f[0].sort(f[1]).limit(k), self.name))(self._with(by))
    def filter(self, mask: Series) -> Series: return (lambda f: Series(f[0].filter(E.col(f[1])), self.name))(self._with(mask))
    def unique(self) -> Series: return Series(self.frame.unique(self.name), self.name)
    def drop_nulls(self) -> Series: return Series(self.frame.drop_nulls(self.name), self.name)
    def drop_nans(self) -> Series: return Series(self.frame.drop_nans(self.name), self.name)
    def sample(self, n: int, seed: int = 0) -> Series: return Series(self.frame.sample(n, seed=seed), self.name)
    def shuffle(self, seed: int = 0) -> Series: return Series(self.frame.shuffle(seed), self.name)
    def clear(self) -> Series: return Series(self.frame.clear(), self.name)
    def clone(self) -> Series: return self
    rechunk = shrink_to_fit = set_sorted = to_physical = clone

    def _pick(self, df) -> Series:
        """A series of rows (i, v) in the order of i."""
        return Series(Frame(df.select(F.col("v").alias(self.name), F.col("i").alias("__o0")), [("__o0", False, False)]), self.name)

    def arg_sort(self) -> Series:
        f = self.frame.select(self._e.alias("v")).with_row_index("i").sort("v")
        return Series(f.select(E.col("i").alias(self.name)), self.name)

    def arg_true(self) -> Series: return self._pick(self._indexed().where("v").select("i", F.col("i").alias("v")))
    def arg_unique(self) -> Series: return self._pick(self._indexed().groupBy("v").agg(F.min("i").alias("i")).select("i", F.col("i").alias("v")))
    def gather(self, places: list[int]) -> Series:
        at = self.frame.spark.createDataFrame(list(enumerate(places)), "k long, i long")
        return self._pick(at.join(self._indexed(), "i").select(F.col("k").alias("i"), "v"))

    def value_counts(self) -> Frame: return Frame(self._indexed().groupBy(F.col("v").alias(self.name)).agg(F.count(F.lit(1)).alias("count"), F.min("i").alias("__o0")), [("__o0", False, False)])
    def unique_counts(self) -> Series: return (lambda f: Series(f, "count"))(self.value_counts())
    def hist(self, bins: int) -> Frame: return self.frame.hist(self.name, bins)
    def qcut(self, quantiles: list[float]) -> Series: return Series(self.frame.qcut(self.name, quantiles, self.name), self.name)
    def rle(self) -> Frame: return self.frame.rle(self.name)
    def rle_id(self) -> Series: return Series(self.frame.rle_id(self.name), "run")
    def interpolate(self) -> Series:
        """Linear inside; the ends take the nearest known value."""
        inner = Series(self.frame.interpolate(self.name), self.name)
        return inner.forward_fill().backward_fill()

    def max_by(self, by: Series) -> Frame: return self._per(by, "max")
    def min_by(self, by: Series) -> Frame: return self._per(by, "min")
    def _per(self, by: Series, how: str) -> Frame: return (lambda f: f[0].group_by(f[1]).agg(getattr(E.col(self.name), how)().alias(self.name)).rename({f[1]: by.name}))(self._with(by))

    # structure ------------------------------------------------------------------------
    def append(self, other: Series) -> Series:
        n = self.frame.height
        return self._pick(self._indexed().unionAll(other._indexed().select((F.col("i") + n).alias("i"), "v")))

    extend = append
    def extend_constant(self, v, n: int) -> Series: return self.append(Series.of(self.frame.spark, self.name, [v] * n, self.data_type))
    def new_from_index(self, i: int, n: int) -> Series: return Series.of(self.frame.spark, self.name, [self.value(i)] * n, self.data_type)
    def implode(self) -> list: return self.to_list()
    def explode(self) -> Series: return Series(self.frame.drop_nulls(self.name).select(self._e.explode().alias(self.name)), self.name)
    flatten = explode
    def to_dummies(self) -> Frame: return self.to_frame().to_dummies(self.name)
    def scatter(self, places: list[int], values: list) -> Series:
        at = self.frame.spark.createDataFrame(list(zip(places, values)), f"i long, x {self.data_type}").withColumn("hit", F.lit(True))
        return self._pick(self._indexed().join(at, "i", "left").select("i", F.when(F.col("hit"), F.col("x")).otherwise(F.col("v")).alias("v")))

    def set(self, mask: Series, v) -> Series: return (lambda f: Series(f[0].select(E.when(E.col(f[1]), v, E.col(self.name)).alias(self.name)), self.name))(self._with(mask))
    def zip_with(self, mask: Series, other: Series) -> Series: return self._pick(self._indexed().join(mask._indexed().toDF("i", "m"), "i").join(other._indexed().toDF("i", "o"), "i").select("i", F.when(F.col("m"), F.col("v")).otherwise(F.col("o")).alias("v")))
    def replace_strict(self, old, new) -> Series:
        if self.index_of(old) < 0:
            raise ValueError(f"{old!r} does not occur")
        return self._map(self._e.replace(old, new))

    def cast(self, to: str) -> Series: return self._map(self._e.cast(to))
    def shrink_dtype(self) -> Series: return self.cast("bigint") if self.data_type == "double" and self._value((self._e == self._e.floor()).all(), False) else self
    def reinterpret(self, *_): raise NotImplementedError("values of one type are not bits of another here")

    def ewm_mean(self, alpha: float = 0.5, kind: str = "mean") -> Series:
        """Recursive over the whole column: one ordered pass, in one task by definition."""
        f = self.frame.with_columns(E.lit(0).alias("__g"))
        return Series(f.ewm(self.name, alpha, self.name + "_ewm", ["__g"], kind).select(E.col(self.name + "_ewm").alias(self.name)), self.name)

    def ewm_var(self, alpha: float = 0.5) -> Series: return self.ewm_mean(alpha, "var")
    def ewm_std(self, alpha: float = 0.5) -> Series: return self.ewm_mean(alpha, "std")


#: Methods that are those of expressions, element-wise or over the order.
_SAME = [n for n in E.UNARY if n not in ("explode", "flatten", "rechunk", "set_sorted", "to_physical", "shrink_dtype")] + (
    "is_nan is_not_nan is_finite is_infinite round round_sig_figs clip truncate is_between is_in replace fill_null fill_nan cut repeat_by map_elements shift diff pct_change "
    "forward_fill backward_fill peak_max peak_min is_duplicated is_unique is_first_distinct is_last_distinct rank rolling_map cum_max cum_min cum_prod"
).split()
_PAIRS = "add sub mul pow eq ne gt ge lt le eq_missing ne_missing is_close bitwise_and bitwise_or bitwise_xor".split()


def _same(name: str) -> Callable:
    return lambda self, *a, **k: self._map(getattr(self._e, name)(*a, **k))


for _n in _SAME:
    if not hasattr(Series, _n):
        setattr(Series, _n, _same(_n))
for _n in _PAIRS:
    setattr(Series, _n, functools.partialmethod(Series._two, method=_n))
for _n in [*E.ROLLING, "quantile"]:
    setattr(Series, f"rolling_{_n}", lambda self, size, *a, n=_n: self._map(getattr(self._e, f"rolling_{n}")(size, *a, strict=True)))
for _n in [*E.ROLLING, "quantile", "rank"]:
    setattr(Series, f"rolling_{_n}_by", lambda self, by, size, *a, n=_n: self._by(f"rolling_{n}_by", by, size, *a))
Series.div = lambda self, o: self._map(self._e.cast("double")._map(lambda a, b: F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))).otherwise(F.try_divide(a, b)), o))
Series.cum_sum = lambda self: self._map(E.when(self._e.is_not_null(), self._e.cum_sum(), E.lit(None)))
Series.cum_count = lambda self: self._map(E.when(self._e.is_not_null(), self._e.cum_count().cast("double"), E.lit(None)))
Series.not_ = lambda self: self._map(self._e.not_() if self.data_type == "boolean" else self._e._map(F.bitwise_not))
Series.str = property(lambda self: _Accessor(self, "str_"))
Series.dt = property(lambda self: _Accessor(self, "dt_"))
Series.list = property(lambda self: _Accessor(self, "list_"))
Series.arr = Series.list
Series.bin = property(lambda self: _Accessor(self, "bitwise_"))
Series.cat = property(lambda self: _Accessor(self, "cat_"))
Series.struct = property(lambda self: _Accessor(self, "struct_"))


class _Accessor:
    def __init__(self, s: Series, prefix: str):
        self._s, self._p = s, prefix

    def __getattr__(self, name: str) -> Callable:
        return lambda *a, **k: self._s._map(getattr(self._s._e, self._p + name)(*a, **k))
