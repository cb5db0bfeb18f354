"""Registered queries over families of expressions, aggregates, windows and series methods, each with equivalent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import col, lit, when
from ..frame import Frame, LazyFrame
from ..series import Series
from .suite import query


# scalar expressions ---------------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, log10(l_quantity) AS log10, ln(1 + l_tax) AS log1p, cos(l_tax) AS cos, tan(l_tax) AS tan, 1 / tan(l_quantity) AS cot,
  sinh(l_tax) AS sinh, cosh(l_tax) AS cosh, tanh(l_tax) AS tanh, asin(l_tax) AS arcsin, acos(l_tax) AS arccos, atan(l_tax) AS arctan, asinh(l_tax) AS arcsinh, acosh(l_quantity) AS arccosh, atanh(l_tax) AS arctanh,
  radians(l_quantity) AS radians, -l_quantity AS neg, l_quantity / l_extendedprice AS true_div, floor(l_extendedprice / l_quantity) AS floor_div, round(l_extendedprice / 7, 2) AS round_dp FROM lineitem""")
def math_family(t):
    q, x, p = col("l_quantity"), col("l_tax"), col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", q.log10().alias("log10"), x.log1p().alias("log1p"), x.cos().alias("cos"), x.tan().alias("tan"), q.cot().alias("cot"), x.sinh().alias("sinh"), x.cosh().alias("cosh"), x.tanh().alias("tanh"),
        x.arcsin().alias("arcsin"), x.arccos().alias("arccos"), x.arctan().alias("arctan"), x.arcsinh().alias("arcsinh"), q.arccosh().alias("arccosh"), x.arctanh().alias("arctanh"), q.radians().alias("radians"), q.neg().alias("neg"),
        q.true_div(p).alias("true_div"), p.floor_div(q).alias("floor_div"), (p / lit(7.0)).round_dp(2).alias("round_dp"),
    )


@query("""WITH e AS (SELECT *, CASE WHEN value > 90 THEN 'nan'::DOUBLE WHEN value > 80 THEN 'inf'::DOUBLE WHEN value > 70 THEN NULL ELSE value END AS x FROM events)
SELECT event_id, x IS NOT NULL AND NOT isnan(x) AS is_not_nan, x IS NOT NULL AND isfinite(x) AS is_finite, coalesce(isinf(x), false) AS is_infinite, x IS NOT NULL AS is_not_null,
  CASE WHEN isnan(x) THEN -1 ELSE x END AS fill_nan, x IS NOT DISTINCT FROM value AS eq_missing, x IS DISTINCT FROM value AS ne_missing, abs(value - 50) <= 5 AS is_close FROM e""")
def float_states(t):
    v = col("value")
    e = t.events.with_columns(when(v > 90.0, lit(float("nan")), when(v > 80.0, lit(float("inf")), when(v > 70.0, None, v))).alias("x"))
    x = col("x")
    return e.select("event_id", x.is_not_nan().alias("is_not_nan"), x.is_finite().alias("is_finite"), x.is_infinite().alias("is_infinite"), x.is_not_null().alias("is_not_null"), x.fill_nan(-1.0).alias("fill_nan"), x.eq_missing(v).alias("eq_missing"), x.ne_missing(v).alias("ne_missing"), v.is_close(lit(50.0), 5.0).alias("is_close"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, isodow(o_orderdate) AS wd, dayofyear(o_orderdate) AS od FROM orders""")
def date_parts(t):
    d = col("o_orderdate")
    return t.orders.select("o_orderkey", d.dt_year().alias("y"), d.dt_month().alias("m"), d.dt_day().alias("d"), d.dt_hour().alias("h"), d.dt_minute().alias("mi"), d.dt_second().alias("s"), d.dt_weekday().alias("wd"), d.dt_ordinal_day().alias("od"))


@query("""SELECT c_custkey, ltrim('  ' || c_name) AS l, rtrim(c_name || '  ') AS r, rpad(c_name, greatest(24, length(c_name))::INT, '*') AS padded, concat(c_name, c_mktsegment) AS joined, suffix(c_name, '7') AS ends FROM customer""")
def string_ends(t):
    n = col("c_name")
    return t.customer.select("c_custkey", (lit("  ") + n).str_l_trim().alias("l"), (n + lit("  ")).str_r_trim().alias("r"), n.str_pad_end(24, "*").alias("padded"), n.str_concat(col("c_mktsegment")).alias("joined"), n.ends_with("7").alias("ends"))


@query("""SELECT o_orderkey, 64 - bit_count(o_orderkey) AS zeros, 64 - length(bin(o_orderkey)) AS leading, length(bin(o_orderkey)) - length(rtrim(bin(o_orderkey), '0')) AS trailing,
  0 AS leading_ones, length(bin(o_orderkey)) - length(rtrim(bin(o_orderkey), '1')) AS trailing_ones FROM orders WHERE o_orderkey > 0""")
def bit_positions(t):
    k = col("o_orderkey")
    return t.orders.filter(k > 0).select("o_orderkey", k.bitwise_count_zeros().alias("zeros"), k.bitwise_leading_zeros().alias("leading"), k.bitwise_trailing_zeros().alias("trailing"), k.bitwise_leading_ones().alias("leading_ones"), k.bitwise_trailing_ones().alias("trailing_ones"))


# aggregates -------------------------------------------------------------------------
@query("""WITH e AS (SELECT *, CASE WHEN value > 20 THEN value END AS x FROM events)
SELECT event_type, bool_and(coalesce(x > 30, false)) AS all_, bool_or(x > 99) AS any_, bool_or(x IS NULL) AS has_nulls, count(DISTINCT user_id) AS count_distinct, sum(x * value) AS dot, max(x) AS nan_max, min(x) AS nan_min,
  arg_min(event_id, struct_pack(v := value, e := event_id)) AS min_by, product(1 + x / 1e6) AS product, count(x) AS n, count(*) FILTER (x IS NULL) AS nulls, skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1)) AS skew, kurtosis_pop(x) AS kurtosis FROM e GROUP BY 1""")
def aggregate_family(t):
    v, x = col("value"), col("x")
    e = t.events.with_columns(when(v > 20.0, v, None).alias("x"))
    return e.group_by("event_type").agg(
        (x > 30.0).all().alias("all_"), (x > 99.0).any().alias("any_"), x.has_nulls().alias("has_nulls"), col("user_id").count_distinct().alias("count_distinct"), x.dot(v).alias("dot"), x.nan_max().alias("nan_max"), x.nan_min().alias("nan_min"),
        col("event_id").min_by(v).alias("min_by"), (lit(1.0) + x / lit(1e6)).product().alias("product"), x.count().alias("n"), x.null_count().alias("nulls"), x.skew().alias("skew"), x.kurtosis().alias("kurtosis"),
    )


# windows ------------------------------------------------------------------------------
@query("""SELECT event_id, product(1 + value / 1e6) OVER r AS cum_prod, coalesce(value < lag(value) OVER w AND value < lead(value) OVER w, false) AS peak_min, count(*) OVER (PARTITION BY user_id, event_type) = 1 AS is_unique,
  lead(1) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL AS is_last, CASE WHEN count(*) OVER k >= 5 THEN var_pop(value) OVER k END AS rolling_var, lag(value, 2) OVER w AS shifted,
  CASE WHEN count(*) OVER k >= 5 THEN quantile_cont(value, 0.25) OVER k END AS rolling_quantile FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)""")
def window_family(t):
    v = col("value")
    return t.events.sort(["ts", "event_id"]).select(
        "event_id", (lit(1.0) + v / lit(1e6)).cum_prod().over("user_id").alias("cum_prod"), v.peak_min().over("user_id").alias("peak_min"), col("event_type").is_unique().over("user_id").alias("is_unique"),
        col("event_type").is_last_distinct().over("user_id").alias("is_last"), v.rolling_var(5, min_periods=5).over("user_id").alias("rolling_var"), v.shift(2).over("user_id").alias("shifted"), v.rolling_quantile(5, 0.25).over("user_id").alias("rolling_quantile"),
    )


_BY = {"sum": "sum", "mean": "avg", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "median": "median"}


@query("SELECT event_id, " + ", ".join(f"CASE WHEN count(*) OVER k >= 3 THEN {f}(value) OVER k END AS {n}" for n, f in _BY.items()) + " FROM events WINDOW k AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)")
def rolling_by(t):
    return t.events.sort("event_id").select("event_id", *[getattr(col("value"), f"rolling_{n}_by")(col("event_id"), 3, 3).over("user_id").alias(n) for n in _BY])


# frames ---------------------------------------------------------------------------------
@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS value FROM events) WHERE value IS NOT NULL")
def drop_nulls(t):
    return t.events.select("event_id", when(col("value") > 50.0, col("value"), None).alias("value")).drop_nulls()


@query("SELECT event_id, value FROM events WHERE value <= 50")
def drop_nans(t):
    return t.events.select("event_id", when(col("value") > 50.0, lit(float("nan")), col("value")).alias("value")).drop_nans()


@query("SELECT event_id, CASE WHEN value > 50 THEN 0 ELSE value END AS value FROM events")
def frame_fill_nan(t):
    return t.events.select("event_id", when(col("value") > 50.0, lit(float("nan")), col("value")).alias("value")).fill_nan(0.0)


# series ---------------------------------------------------------------------------------
def _series(t, name: str) -> Series:
    return Series(Frame(t.supplier.df).sort("s_suppkey"), name)


def _rows(named: dict[str, Series]) -> LazyFrame:
    """(method, i, v): the values of each series by position."""
    return LazyFrame(reduce(DataFrame.unionAll, [s._indexed().select(F.lit(n).alias("method"), F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")) for n, s in named.items()]))


def _long(parts: dict[str, str]) -> str:
    numbered = "SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey FROM supplier"
    return f"WITH s AS ({numbered}) " + " UNION ALL ".join(f"SELECT '{n}' AS method, i, ({e})::DOUBLE AS v FROM s" for n, e in parts.items())


REDUCED = {
    "sum": "sum(s_acctbal)", "mean": "avg(s_acctbal)", "min": "min(s_acctbal)", "max": "max(s_acctbal)", "median": "median(s_acctbal)", "std": "stddev_samp(s_acctbal)", "var": "var_samp(s_acctbal)",
    "n_unique": "count(DISTINCT s_acctbal)", "count": "count(s_acctbal)", "null_count": "count(*) - count(s_acctbal)", "first": "first(s_acctbal ORDER BY s_suppkey)", "last": "last(s_acctbal ORDER BY s_suppkey)", "nan_min": "min(s_acctbal)", "nan_max": "max(s_acctbal)", "kurtosis": "kurtosis_pop(s_acctbal)", "len": "count(*)",
}


@query("SELECT " + ", ".join(f'({e})::DOUBLE AS "{n}"' for n, e in REDUCED.items()) + " FROM supplier")
def series_reductions(t):
    s = _series(t, "s_acctbal")
    return LazyFrame(t.spark.createDataFrame([tuple(float(getattr(s, n)()) for n in REDUCED)], ", ".join(f"`{n}` double" for n in REDUCED)))


ELEMENTWISE = {"abs": "abs(v)", "sign": "sign(v)", "floor": "floor(v)", "ceil": "ceil(v)", "neg": "-v", "sin": "sin(v)", "exp": "exp(v / 1e4)", "sqrt": "sqrt(abs(v))", "clip": "least(greatest(v, 0), 5000)", "round": "round(v)"}


@query(_long(ELEMENTWISE))
def series_elementwise(t):
    s = _series(t, "s_acctbal")
    args = {"clip": (0.0, 5000.0)}
    on = {"exp": lambda: s.truediv(1e4) if hasattr(s, "truediv") else s._map(s._e / lit(1e4)), "sqrt": s.abs}
    return _rows({n: getattr(on.get(n, lambda: s)(), n)(*args.get(n, ())) for n in ELEMENTWISE})


ORDERED = {
    "cum_sum": "sum(v) OVER (ORDER BY i)", "cum_max": "max(v) OVER (ORDER BY i)", "cum_min": "min(v) OVER (ORDER BY i)", "cum_count": "count(v) OVER (ORDER BY i)", "shift": "lag(v) OVER (ORDER BY i)", "diff": "v - lag(v) OVER (ORDER BY i)",
    "reverse": "first_value(v) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 0 + list_extract((SELECT list(v ORDER BY i DESC) FROM s), (i + 1)::INT)",
}


@query(_long(ORDERED))
def series_cumulative(t):
    s = _series(t, "s_acctbal")
    return _rows({n: getattr(s, n)() for n in ORDERED})


SERIES_ROLLING = {n: f"CASE WHEN count(v) OVER (ORDER BY i ROWS 3 PRECEDING) >= 4 THEN {f}(v) OVER (ORDER BY i ROWS 3 PRECEDING) END" for n, f in _BY.items()}


@query(_long({f"rolling_{n}": e for n, e in SERIES_ROLLING.items()}))
def series_rolling(t):
    s = _series(t, "s_acctbal")
    return _rows({f"rolling_{n}": getattr(s, f"rolling_{n}")(4) for n in SERIES_ROLLING})


# lists of a group's values ----------------------------------------------------------------
@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS fresh, count(*) OVER (PARTITION BY user_id, event_type) AS times FROM events)
SELECT user_id, list(event_id ORDER BY event_id)[1:3] AS head, list(event_id ORDER BY event_id)[-3:] AS tail, list(event_id ORDER BY event_id)[2:3] AS slice, list(event_id ORDER BY value, event_id) AS sort_by,
  list(event_id ORDER BY value DESC, event_id DESC)[1:2] AS top_k_by, list(event_id ORDER BY value, event_id)[1:2] AS bottom_k_by, coalesce(list(event_id ORDER BY event_id) FILTER (value > 50), []) AS drop_nulls,
  list(pos ORDER BY value, pos) AS arg_sort, coalesce(list(pos ORDER BY pos) FILTER (value > 50), []) AS arg_true, list(pos ORDER BY pos) FILTER (fresh) AS arg_unique, list(times ORDER BY pos) FILTER (fresh) AS unique_counts,
  count(*) FILTER (value < 50) AS lower_bound, count(*) FILTER (value <= 50) AS upper_bound, list_sort(list(event_id)) AS sorted_ids, list(event_id ORDER BY event_id DESC)[1:2] AS top_k, list(event_id ORDER BY event_id)[1:2] AS bottom_k FROM e GROUP BY 1""")
def list_family(t):
    i, v, k = col("event_id"), col("value"), col("event_type")
    return t.events.sort("event_id").group_by("user_id").agg(
        i.head(3).alias("head"), i.tail(3).alias("tail"), i.slice(1, 2).alias("slice"), i.sort_by(v).alias("sort_by"), i.top_k_by(v, 2).alias("top_k_by"), i.bottom_k_by(v, 2).alias("bottom_k_by"), when(v > 50.0, i, None).drop_nulls().alias("drop_nulls"),
        v.arg_sort().alias("arg_sort"), (v > 50.0).arg_true().alias("arg_true"), k.arg_unique().alias("arg_unique"), k.unique_counts().alias("unique_counts"), v.lower_bound(50.0).alias("lower_bound"), v.upper_bound(50.0).alias("upper_bound"),
        i.sort().alias("sorted_ids"), i.top_k(2).alias("top_k"), i.bottom_k(2).alias("bottom_k"),
    )


# more series ----------------------------------------------------------------------------
TRIGONOMETRY = {"cos": "cos(v)", "tan": "tan(v)", "sinh": "sinh(v)", "cosh": "cosh(v)", "tanh": "tanh(v)", "arcsin": "asin(v)", "arccos": "acos(v)", "arctan": "atan(v)", "arcsinh": "asinh(v)", "arctanh": "atanh(v)", "cbrt": "cbrt(v)", "degrees": "degrees(v)", "radians": "radians(v)", "log1p": "ln(1 + v)"}


@query(_long({n: e.replace("(v)", "(v / 20000)").replace("+ v)", "+ v / 20000)") for n, e in TRIGONOMETRY.items()}))
def series_trigonometry(t):
    s = _series(t, "s_acctbal").div(20000.0)
    return _rows({n: getattr(s, n)() for n in TRIGONOMETRY})


PREDICATES = {"is_null": "v IS NULL", "is_not_null": "v IS NOT NULL", "is_nan": "isnan(v)", "is_not_nan": "NOT isnan(v)", "is_finite": "isfinite(v)", "is_infinite": "isinf(v)", "is_between": "v BETWEEN 0 AND 4000", "peak_max": "coalesce(v > lag(v) OVER (ORDER BY i) AND v > lead(v) OVER (ORDER BY i), false)",
    "peak_min": "coalesce(v < lag(v) OVER (ORDER BY i) AND v < lead(v) OVER (ORDER BY i), false)", "is_unique": "count(*) OVER (PARTITION BY v) = 1", "is_duplicated": "count(*) OVER (PARTITION BY v) > 1", "is_first_distinct": "row_number() OVER (PARTITION BY v ORDER BY i) = 1", "is_last_distinct": "lead(1) OVER (PARTITION BY v ORDER BY i) IS NULL"}


@query(_long(PREDICATES))
def series_predicates(t):
    s = _series(t, "s_acctbal")
    return _rows({n: getattr(s, n)(*((0.0, 4000.0) if n == "is_between" else ())) for n in PREDICATES})


PAIRS = {"add": "v + s_suppkey", "sub": "v - s_suppkey", "mul": "v * s_suppkey", "div": "v / (s_suppkey + 1)", "pow": "pow(s_suppkey, 2)", "eq": "v = s_suppkey", "ne": "v <> s_suppkey", "gt": "v > s_suppkey", "ge": "v >= s_suppkey", "lt": "v < s_suppkey", "le": "v <= s_suppkey", "eq_missing": "v IS NOT DISTINCT FROM s_suppkey", "ne_missing": "v IS DISTINCT FROM s_suppkey"}


@query(_long(PAIRS))
def series_pairs(t):
    a, b = _series(t, "s_acctbal"), _series(t, "s_suppkey")
    both, other = a._with(b)
    made = {"pow": b.pow(2.0), "div": Series(both.select((col("s_acctbal") / (col(other) + lit(1))).alias("s_acctbal")), "s_acctbal")}
    return _rows({n: made[n] if n in made else getattr(a, n)(b) for n in PAIRS})


BITS = {"bitwise_and": "s_suppkey & 12", "bitwise_or": "s_suppkey | 12", "bitwise_xor": "xor(s_suppkey, 12)", "bitwise_count_ones": "bit_count(s_suppkey)", "bitwise_count_zeros": "64 - bit_count(s_suppkey)", "bitwise_leading_zeros": "64 - length(bin(s_suppkey))", "bitwise_leading_ones": "0", "bitwise_trailing_zeros": "length(bin(s_suppkey)) - length(rtrim(bin(s_suppkey), '0'))", "bitwise_trailing_ones": "length(bin(s_suppkey)) - length(rtrim(bin(s_suppkey), '1'))"}


@query(_long(BITS).replace("FROM supplier", "FROM supplier WHERE s_suppkey > 0", 1))
def series_bits(t):
    s = Series(Frame(t.supplier.df).filter(col("s_suppkey") > 0).sort("s_suppkey"), "s_suppkey")
    return _rows({n: getattr(s, n)(*((12,) if n in ("bitwise_and", "bitwise_or", "bitwise_xor") else ())) for n in BITS})


_GAPS = "CASE WHEN v > 5000 THEN v END"
FILLS = {
    "fill_null": f"coalesce({_GAPS}, -1)", "forward_fill": "last_value(g IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)", "backward_fill": "first_value(g IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "cum_prod": "product(1 + v / 1e7) OVER (ORDER BY i)", "pct_change": "v / lag(v) OVER (ORDER BY i) - 1", "rank": "row_number() OVER (ORDER BY v, i)", "round_sig_figs": "round(v, (2 - floor(log10(abs(v))))::INT)", "replace": "CASE WHEN s_suppkey = 7 THEN 70 ELSE s_suppkey END",
}


@query(_long(FILLS).replace("s_suppkey FROM supplier", f"s_suppkey, {_GAPS.replace('v >', 's_acctbal >').replace('THEN v', 'THEN s_acctbal')} AS g FROM supplier", 1))
def series_fills(t):
    s, k = _series(t, "s_acctbal"), _series(t, "s_suppkey")
    gaps = s._map(when(col("s_acctbal") > 5000.0, col("s_acctbal"), None))
    return _rows({"fill_null": gaps.fill_null(-1.0), "forward_fill": gaps.forward_fill(), "backward_fill": gaps.backward_fill(), "cum_prod": s._map(lit(1.0) + col("s_acctbal") / lit(1e7)).cum_prod(), "pct_change": s.pct_change(), "rank": s.rank(), "round_sig_figs": s.round_sig_figs(3), "replace": k.replace(7, 70)})


STRINGS = {"str_len": "strlen(n)", "str_char_len": "length(n)", "str_lower": "lower(n)", "str_upper": "upper(n)", "str_trim": "trim(n)", "str_reverse": "reverse(n)", "str_l_trim": "ltrim(n)", "str_r_trim": "rtrim(n)"}


@query("WITH s AS (SELECT s_name AS n, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) " + " UNION ALL ".join(f"SELECT '{k}' AS method, i, ({e})::VARCHAR AS v FROM s" for k, e in STRINGS.items()))
def series_strings(t):
    s = _series(t, "s_name")
    return LazyFrame(reduce(DataFrame.unionAll, [getattr(s.str, n.removeprefix("str_"))()._indexed().select(F.lit(n).alias("method"), F.col("i").cast("long").alias("i"), F.col("v").cast("string").alias("v")) for n in STRINGS]))


DATES = {"dt_year": "year(d)", "dt_month": "month(d)", "dt_day": "day(d)", "dt_hour": "hour(d)", "dt_minute": "minute(d)", "dt_second": "second(d)", "dt_weekday": "isodow(d)", "dt_ordinal_day": "dayofyear(d)"}


@query("WITH s AS (SELECT o_orderdate AS d, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) " + " UNION ALL ".join(f"SELECT '{k}' AS method, i, ({e})::DOUBLE AS v FROM s" for k, e in DATES.items()))
def series_dates(t):
    s = Series(Frame(t.orders.df).sort("o_orderkey"), "o_orderdate")
    return _rows({n: getattr(s.dt, n.removeprefix("dt_"))() for n in DATES})


@query(_long({f"rolling_{n}_by": f"CASE WHEN count(v) OVER (ORDER BY s_suppkey ROWS 2 PRECEDING) >= 3 THEN {f}(v) OVER (ORDER BY s_suppkey ROWS 2 PRECEDING) END" for n, f in _BY.items()}))
def series_rolling_by(t):
    s, by = _series(t, "s_acctbal"), _series(t, "s_suppkey")
    return _rows({f"rolling_{n}_by": getattr(s, f"rolling_{n}_by")(by, 3, 3) for n in _BY})
