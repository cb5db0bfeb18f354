"""The engine's registered queries, each with equivalent SQL.

One entry or more for each family of the operator inventory; each reads whole
driver tables through ``scan_parquet`` and is built from the public API.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expr import col, count, exclude, fold, lit, struct_cols, when
from ..frame import LazyFrame
from ..sources.io import scan_parquet
from ..sql import SQLContext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "filter_group_sort_limit"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> LazyFrame:
        return scan_parquet(self.spark, f"{self.dir}/{name}.parquet")


def query(sql: str | None) -> Callable:
    def add(fn: Callable[[Tables], LazyFrame]) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir)).to_spark()
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# projection, filter, sort, limit ------------------------------------------------
@query("SELECT l_returnflag, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1 ORDER BY total DESC LIMIT 2")
def filter_group_sort_limit(t):
    return t.lineitem.filter(col("l_quantity") > 25).group_by("l_returnflag").agg(col("l_extendedprice").sum().alias("total"), count().alias("n")).sort("total", descending=True).limit(2)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def select_project(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (lit(1) - col("l_discount"))).alias("revenue"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT o_totalprice < 1000 AND o_totalprice BETWEEN 2000 AND 200000")
def filter_predicates(t):
    p = ((col("o_orderstatus") == "F") | col("o_orderpriority").is_in(["1-URGENT", "2-HIGH"])) & ~(col("o_totalprice") < 1000.0) & col("o_totalprice").is_between(2000.0, 200000.0)
    return t.orders.filter(p).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 2 AS dbl, l_extendedprice / l_quantity AS unit FROM lineitem")
def with_columns(t):
    return t.lineitem.with_columns((col("l_quantity") * 2).alias("dbl"), (col("l_extendedprice") / col("l_quantity")).alias("unit")).select("l_orderkey", "l_linenumber", "l_quantity", "dbl", "unit")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def sort_limit(t):
    return t.customer.sort(["c_acctbal", "c_custkey"], descending=[True, False]).limit(25).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def top_k(t):
    return t.orders.top_k(10, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_k(t):
    return t.orders.bottom_k(10, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7")
def tail(t):
    return t.customer.sort("c_custkey").tail(7).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 100")
def slice_rows(t):
    return t.customer.sort("c_custkey").slice(100, 20).select("c_custkey", "c_name")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def row_index(t):
    return t.orders.sort("o_orderkey").with_row_index("idx").select("o_orderkey", "idx")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i % 10 = 0")
def gather_every(t):
    return t.customer.sort("c_custkey").gather_every(10).select("c_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def unique_first(t):
    return t.orders.sort(["o_orderdate", "o_orderkey"]).unique("o_custkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def unique_rows(t):
    return t.part.select("p_brand", "p_size").unique()


@query("SELECT n_name AS nation, n_regionkey::BIGINT AS region FROM nation")
def rename_cast_drop(t):
    return t.nation.rename({"n_name": "nation", "n_regionkey": "region"}).cast({"region": "Int64"}).drop("n_nationkey")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def selectors(t):
    return t.customer.select(exclude("c_nationkey", "c_acctbal"))


@query("SELECT c_custkey, c_acctbal, c_acctbal - (SELECT avg(c_acctbal) FROM customer) AS above FROM customer")
def aggregate_in_select(t):
    return t.customer.select("c_custkey", "c_acctbal", (col("c_acctbal") - col("c_acctbal").mean()).alias("above"))


@query("SELECT s_suppkey, s_nationkey + s_suppkey * 2 AS folded, greatest(s_nationkey, s_suppkey % 7) AS top FROM supplier")
def fold_horizontal(t):
    s = t.supplier.cast({"s_nationkey": "Int64"})
    return s.select("s_suppkey", fold(0, lambda a, b: a + b, [col("s_nationkey"), col("s_suppkey"), col("s_suppkey")]).alias("folded"), when(col("s_nationkey") > col("s_suppkey")._map(lambda c: c % 7), col("s_nationkey"), col("s_suppkey")._map(lambda c: c % 7)).alias("top"))


# aggregation ----------------------------------------------------------------------
@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS s, avg(l_extendedprice) AS m, min(l_shipdate) AS lo, max(l_shipdate) AS hi,
 stddev_samp(l_discount) AS sd, var_samp(l_tax) AS vr, median(l_extendedprice) AS md, count(DISTINCT l_suppkey) AS nd FROM lineitem GROUP BY ALL""")
def group_by_all(t):
    return t.lineitem.group_by("l_returnflag", "l_linestatus").agg(
        count().alias("n"), col("l_quantity").sum().alias("s"), col("l_extendedprice").mean().alias("m"), col("l_shipdate").min().alias("lo"), col("l_shipdate").max().alias("hi"),
        col("l_discount").std().alias("sd"), col("l_tax").var().alias("vr"), col("l_extendedprice").median().alias("md"), col("l_suppkey").n_unique().alias("nd"),
    )


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
def group_by_first_last(t):
    return t.orders.sort(["o_orderdate", "o_orderkey"]).group_by("o_custkey").agg(col("o_orderkey").first().alias("first"), col("o_orderkey").last().alias("last"))


@query("SELECT p_brand, quantile_cont(p_retailprice, 0.9) AS q, count(p_size) AS c, max_by(p_name, (p_retailprice, p_partkey)) AS dearest FROM part GROUP BY 1")
def group_by_quantile_max_by(t):
    return t.part.group_by("p_brand").agg(col("p_retailprice").quantile(0.9).alias("q"), col("p_size").count().alias("c"), col("p_name").max_by(struct_cols("p_retailprice", "p_partkey")).alias("dearest"))


@query("SELECT sum(o_totalprice) AS o_totalprice, sum(o_custkey)::BIGINT AS o_custkey, sum(o_orderkey)::BIGINT AS o_orderkey FROM orders")
def frame_sum(t):
    return t.orders.sum()


@query("SELECT avg(c_acctbal) AS c_acctbal, avg(c_custkey) AS c_custkey, avg(c_nationkey) AS c_nationkey FROM customer")
def frame_mean(t):
    return t.customer.mean()


@query("SELECT stddev_pop(c_acctbal) AS c_acctbal, stddev_pop(c_custkey) AS c_custkey, stddev_pop(c_nationkey) AS c_nationkey FROM customer")
def frame_std_population(t):
    return t.customer.std()


@query("SELECT quantile_cont(l_quantity, 0.3) AS l_quantity, quantile_cont(l_extendedprice, 0.3) AS l_extendedprice FROM lineitem")
def frame_quantile(t):
    return t.lineitem.select("l_quantity", "l_extendedprice").quantile(0.3)


@query("SELECT count(*) - count(CASE WHEN c_acctbal > 0 THEN 1 END) AS bad, 0::BIGINT AS c_custkey FROM customer")
def null_count(t):
    return t.customer.select("c_custkey", col("c_acctbal").filter(col("c_acctbal") > 0).alias("bad")).null_count()


@query("SELECT corr(l_quantity, l_extendedprice) AS corr FROM lineitem")
def correlation(t):
    return t.lineitem.corr("l_quantity", "l_extendedprice")


@query("SELECT sum(l_extendedprice * l_discount) AS revenue, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")
def filter_aggregate(t):
    return t.lineitem.filter_aggregate((col("l_discount") >= 0.05) & (col("l_quantity") < 24.0), (col("l_extendedprice") * col("l_discount")).sum().alias("revenue"), count().alias("n"))


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
def value_counts(t):
    return t.customer.value_counts("c_mktsegment")


@query("SELECT -sum(p * ln(p)) AS event_type FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
def entropy(t):
    return t.events.entropy("event_type")


@query("SELECT lo + b * (hi - lo) / 10 AS breakpoint, count(v) AS count FROM (SELECT unnest(range(10)) AS b) g CROSS JOIN (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) LEFT JOIN (SELECT l_extendedprice AS v FROM lineitem) ON least(floor((v - lo) / ((hi - lo) / 10)), 9) = b GROUP BY lo, hi, b")
def histogram(t):
    return t.lineitem.hist("l_extendedprice", 10)


@query("""SELECT unnest(['count','null_count','mean','std','min','25%','50%','75%','max']) AS statistic,
 unnest([count(c_acctbal)::DOUBLE, 0::DOUBLE, avg(c_acctbal), stddev_pop(c_acctbal), min(c_acctbal), quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75), max(c_acctbal)]) AS c_acctbal FROM customer""")
def describe(t):
    return t.customer.select("c_acctbal").describe()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.group_by("l_returnflag", "l_linestatus").grouping("cube", count().alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t.orders.group_by("o_orderstatus", "o_orderpriority").grouping("rollup", col("o_totalprice").sum().alias("s"))


# joins ------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), left_on="o_custkey", right_on="c_custkey")


@query("SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders.select("o_orderkey", "o_custkey"), left_on="c_custkey", right_on="o_custkey", how="left")


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM (SELECT * FROM orders WHERE o_orderkey % 5 = 0) RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(t):
    return t.orders.filter(col("o_orderkey")._map(lambda c: c % 5) == 0).select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), left_on="o_custkey", right_on="c_custkey", how="right")


@query("SELECT n_name, n_nationkey, s_suppkey, s_nationkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 10) ON n_nationkey = s_nationkey")
def join_full(t):
    return t.nation.filter(col("n_nationkey") < 15).select("n_name", "n_nationkey").join(t.supplier.filter(col("s_nationkey") > 10).select("s_suppkey", "s_nationkey"), left_on="n_nationkey", right_on="s_nationkey", how="full")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders.filter(col("o_totalprice") > 200000.0), left_on="c_custkey", right_on="o_custkey", how="semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders, left_on="c_custkey", right_on="o_custkey", how="anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.select("r_name").join(t.nation.select("n_name"), how="cross")


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey AND n_regionkey = 1")
def join_predicate(t):
    return t.supplier.select("s_suppkey", "s_nationkey").join_where(t.nation.select("n_nationkey", "n_regionkey"), col("s_nationkey") < col("n_nationkey"), col("n_regionkey") == 1).select("s_suppkey", "n_nationkey")


@query("SELECT a.k, a.v, b.k AS k_right, b.w FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS k, s_suppkey AS v FROM supplier) a JOIN (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS k, n_name AS w FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(t):
    a = t.supplier.select(when(col("s_suppkey")._map(lambda c: c % 3) == 0, None, col("s_nationkey")).alias("k"), col("s_suppkey").alias("v"))
    b = t.nation.select(when(col("n_nationkey")._map(lambda c: c % 4) == 0, None, col("n_nationkey")).alias("k"), col("n_name").alias("w"))
    return a.join(b, on="k")


@query("""SELECT event_id, pe FROM (SELECT event_id, ts, user_id FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN
 (SELECT puser, pts, min(pe) AS pe FROM (SELECT event_id AS pe, ts AS pts, user_id AS puser FROM events WHERE event_type = 'purchase') GROUP BY ALL) p ON user_id = puser AND ts >= pts""")
def join_asof_backward(t):
    p = t.events.filter(col("event_type") == "purchase").select(col("event_id").alias("pe"), col("ts").alias("pts"), col("user_id"))
    return t.events.filter(col("event_type") != "purchase").select("event_id", "ts", "user_id").join_asof(p, left_on="ts", right_on="pts", by=["user_id"]).select("event_id", "pe")


@query("""SELECT event_id, pe FROM (SELECT event_id, ts, user_id FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN
 (SELECT puser, pts, min(pe) AS pe FROM (SELECT event_id AS pe, ts AS pts, user_id AS puser FROM events WHERE event_type = 'purchase') GROUP BY ALL) p ON user_id = puser AND ts <= pts""")
def join_asof_forward(t):
    p = t.events.filter(col("event_type") == "purchase").select(col("event_id").alias("pe"), col("ts").alias("pts"), col("user_id"))
    return t.events.filter(col("event_type") != "purchase").select("event_id", "ts", "user_id").join_asof(p, left_on="ts", right_on="pts", by=["user_id"], strategy="forward").select("event_id", "pe")


# windows ------------------------------------------------------------------------------
@query("""SELECT event_id, row_number() OVER w AS rn, lag(value) OVER w AS lg, lead(value, 2) OVER w AS ld, first(value) OVER f AS fv, last(value) OVER f AS lv, sum(value) OVER (PARTITION BY user_id) AS s
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_functions(t):
    v = col("value")
    return t.events.sort(["ts", "event_id"]).select("event_id", v.row_number().over("user_id").alias("rn"), v.lag().over("user_id").alias("lg"), v.lead(2).over("user_id").alias("ld"), v.first_value().over("user_id").alias("fv"), v.last_value().over("user_id").alias("lv"), v.sum().over("user_id").alias("s"))


@query("SELECT p_partkey, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def window_ranks(t):
    return t.part.select("p_partkey", col("p_size").rank("min").over("p_brand").alias("rk"), col("p_size").rank("dense").over("p_brand").alias("dr"))


@query("SELECT event_id, sum(value) OVER w AS cs, count(value) OVER w AS cc, max(value) OVER w AS mx, min(value) OVER w AS mn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cumulative(t):
    v = col("value")
    return t.events.sort(["ts", "event_id"]).select("event_id", v.cum_sum().over("user_id").alias("cs"), v.cum_count().over("user_id").alias("cc"), v.cum_max().over("user_id").alias("mx"), v.cum_min().over("user_id").alias("mn"))


@query("SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS cs FROM orders")
def cumulative_whole_table(t):
    return t.orders.sort("o_orderkey").cum_sum_all("o_totalprice", "cs").select("o_orderkey", "cs")


@query("SELECT event_id, sum(value) OVER w AS s, avg(value) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi, stddev_pop(value) OVER w AS sd, median(value) OVER w AS md FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def rolling_rows(t):
    v = col("value")
    return t.events.sort(["ts", "event_id"]).select("event_id", v.rolling_sum(5).over("user_id").alias("s"), v.rolling_mean(5).over("user_id").alias("m"), v.rolling_min(5).over("user_id").alias("lo"), v.rolling_max(5).over("user_id").alias("hi"), v.rolling_std(5).over("user_id").alias("sd"), v.rolling_median(5).over("user_id").alias("md"))


@query("SELECT event_id, value - lag(value) OVER w AS d, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS p, coalesce(value > lag(value) OVER w AND value > lead(value) OVER w, false) AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def diff_change_peaks(t):
    v = col("value")
    return t.events.sort(["ts", "event_id"]).select("event_id", v.diff().over("user_id").alias("d"), v.pct_change().over("user_id").alias("p"), v.peak_max().over("user_id").alias("peak"))


@query("SELECT event_id, last_value(x IGNORE NULLS) OVER w AS f, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (SELECT *, CASE WHEN value > 50 THEN value END AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def fill_forward_backward(t):
    x = when(col("value") > 50.0, col("value"), None)
    return t.events.sort(["ts", "event_id"]).with_columns(x.alias("x")).select("event_id", col("x").forward_fill().over("user_id").alias("f"), col("x").backward_fill().over("user_id").alias("b"))


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def window_sum(t):
    return t.events.window_sum("value", ["user_id"], "event_id", "running").select("event_id", "running")


@query("SELECT user_id, run, count(*) AS len, min(event_type) AS value FROM (SELECT *, (sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2")
def run_lengths(t):
    return t.events.sort(["ts", "event_id"]).rle("event_type", ["user_id"])


@query("""SELECT event_id, CASE WHEN x IS NOT NULL THEN x WHEN a IS NULL OR b IS NULL THEN coalesce(a.y, b.y) ELSE a.y + (b.y - a.y) * (i - a.i) / (b.i - a.i) END AS x FROM (
 SELECT event_id, x, i, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (
 SELECT *, CASE WHEN x IS NOT NULL THEN {'i': i, 'y': x} END AS k FROM (SELECT *, CASE WHEN value > 50 THEN value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS i FROM events)))""")
def interpolate(t):
    return t.events.sort(["ts", "event_id"]).with_columns(when(col("value") > 50.0, col("value"), None).alias("x")).interpolate("x", partition=["user_id"]).select("event_id", "x")


@query("""WITH RECURSIVE n AS MATERIALIZED (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, value AS ewm FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.user_id, n.i, 0.3::DOUBLE * n.value + 0.7::DOUBLE * r.ewm FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, ewm FROM r""")
def ewm_mean(t):
    return t.events.sort(["ts", "event_id"]).ewm("value", 0.3, "ewm", ["user_id"]).select("event_id", "ewm")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_size, p_brand) > 1 AS dup, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 AS fst FROM part")
def distinct_flags(t):
    return t.part.sort("p_partkey").select("p_partkey", struct_cols("p_size", "p_brand").is_duplicated().alias("dup"), col("p_brand").is_first_distinct().alias("fst"))


# time ---------------------------------------------------------------------------------------
@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS w, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2")
def group_by_dynamic(t):
    return t.events.group_by_dynamic("ts", "6h", window_column="w", group=["event_type"]).agg(count().alias("n"), col("value").sum().alias("s"))


@query("SELECT date_trunc('week', ts) AS w, avg(value) AS m FROM events GROUP BY 1")
def group_by_week(t):
    return t.events.group_by_dynamic("ts", "1w", window_column="w").agg(col("value").mean().alias("m"))


@query("SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS m FROM events")
def rolling_time(t):
    return t.events.rolling_mean("ts", "value", "1d", "m", partition=["user_id"]).select("event_id", "m")


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d GROUP BY 1)
SELECT g.user_id, g.ts, d.v FROM g LEFT JOIN d USING (user_id, ts)""")
def upsample(t):
    daily = t.events.group_by_dynamic("ts", "1d", group=["user_id"]).agg(col("value").sum().alias("v"))
    return daily.upsample("ts", "1d", ["user_id"])


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, isodow(o_orderdate) AS w, dayofyear(o_orderdate) AS o FROM orders")
def datetime_parts(t):
    d = col("o_orderdate").dt
    return t.orders.select("o_orderkey", d.year().alias("y"), d.month().alias("m"), d.day().alias("d"), d.hour().alias("h"), d.minute().alias("mi"), d.second().alias("s"), d.weekday().alias("w"), d.ordinal_day().alias("o"))


# reshape and nested -----------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem")
def unpivot(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").unpivot(["l_orderkey", "l_linenumber"])


@query("SELECT o_orderpriority, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS \"F\", sum(o_totalprice) FILTER (o_orderstatus = 'O') AS \"O\", sum(o_totalprice) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot(t):
    return t.orders.pivot("o_orderpriority", "o_orderstatus", "o_totalprice", "sum", columns=["F", "O", "P"])


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def explode(t):
    return t.embeddings.select("vec_id", col("embedding").alias("x")).explode("x").cast({"x": "Float64"})


@query("SELECT c_custkey, c_name AS a, c_acctbal AS b FROM customer")
def struct_unnest(t):
    s = t.customer.rename({"c_name": "a", "c_acctbal": "b"})
    return s.select("c_custkey", struct_cols("b", "a").alias("s")).unnest("s")


@query("SELECT n_nationkey, n_regionkey = 0 AS n_regionkey_0, n_regionkey = 1 AS n_regionkey_1, n_regionkey = 2 AS n_regionkey_2, n_regionkey = 3 AS n_regionkey_3, n_regionkey = 4 AS n_regionkey_4 FROM nation")
def dummies(t):
    return t.nation.select("n_nationkey", "n_regionkey").to_dummies("n_regionkey")


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS f, list_contains(embedding, embedding[2]) AS c FROM embeddings")
def list_functions(t):
    e = col("embedding")
    return t.embeddings.select("vec_id", e.list.len().alias("n"), e.list.get(0).cast("Float64").alias("f"), e._map(lambda c: F.array_contains(c, F.get(c, 1))).alias("c"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(t):
    return t.events.select("event_id", col("props").from_json("k string").struct_field("k").alias("k"))


# scalar functions ----------------------------------------------------------------------------------
@query("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, replace(p_name, ' ', '_') AS r, substr(p_name, 2, 4) AS s, left(p_brand, 3) AS lf, right(p_brand, 2) AS rt, reverse(p_brand) AS rv, lpad(p_brand, 12, '*') AS lp, split_part(p_type, ' ', 2) AS sp, nullif(strpos(p_name, 'a'), 0) AS ps, starts_with(p_type, 'S') AS st, contains(p_name, 're') AS ct, p_type LIKE '%AN%' AS lk, regexp_matches(p_brand, '[0-4]+$') AS rx, p_brand || '-' || p_type AS cc FROM part")
def string_functions(t):
    n, b, y = col("p_name"), col("p_brand"), col("p_type")
    return t.part.select(
        "p_partkey", n.str.upper().alias("u"), y.str.lower().alias("l"), n.str.char_len().alias("n"), n.str.replace_all(" ", "_").alias("r"), n.str.substr(2, 4).alias("s"), b.str.left(3).alias("lf"), b.str.right(2).alias("rt"),
        b.str.reverse().alias("rv"), b.str.pad_start(12, "*").alias("lp"), y.str.split_part(" ", 2).alias("sp"), n.str.pos("a").alias("ps"), y.starts_with("S").alias("st"), n.contains("re").alias("ct"), y.str.like("%AN%").alias("lk"), b.regexp_like("[0-4]+$").alias("rx"),
        b.str_concat_ws("-", y).alias("cc"),
    )


@query("SELECT doc_id, strlen(text) AS b, length(text) AS c, regexp_replace(text, '[aeiou]+', '#') AS f, trim(left(text, 40), chr(10) || ' ') AS t FROM documents")
def text_functions(t):
    x = col("text")
    return t.documents.select("doc_id", x.str.len().alias("b"), x.str.char_len().alias("c"), x.str.replace("[aeiou]+", "#").alias("f"), x.str.left(40).str_trim().alias("t"))


@query("SELECT l_orderkey, l_linenumber, sqrt(l_quantity) AS a, ln(l_quantity) AS b, exp(l_discount) AS c, sin(l_tax) AS d, floor(l_extendedprice) AS e, ceil(l_extendedprice) AS f, round(l_extendedprice) AS g, sign(l_discount - 0.05)::DOUBLE AS h, pow(l_quantity, 2) AS i, atan2(l_tax, l_quantity) AS j, degrees(l_tax) AS k, cbrt(l_quantity) AS m FROM lineitem")
def math_functions(t):
    q, p, d, x = col("l_quantity"), col("l_extendedprice"), col("l_discount"), col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", q.sqrt().alias("a"), q.log().alias("b"), d.exp().alias("c"), x.sin().alias("d"), p.floor().alias("e"), p.ceil().alias("f"), p.round().alias("g"), (d - 0.05).sign().alias("h"), q.pow(2.0).alias("i"), x.atan2(q).alias("j"), x.degrees().alias("k"), q.cbrt().alias("m"))


@query("SELECT o_orderkey, o_orderkey // 7 AS q, (o_orderkey % 7)::DOUBLE AS m, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, bit_count(o_orderkey)::BIGINT AS c, -o_orderkey AS n, abs(o_orderkey - 500) AS ab FROM orders")
def integer_functions(t):
    k = col("o_orderkey")
    return t.orders.select("o_orderkey", (k / 7).alias("q"), (k % 7).alias("m"), k.bitwise_and(12).alias("a"), k.bitwise_or(3).alias("o"), k.bitwise_xor(5).alias("x"), k.bitwise_count_ones().alias("c"), (-k).alias("n"), (k - 500).abs().alias("ab"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'big' ELSE 'small' END AS size, coalesce(CASE WHEN l_tax > 0.04 THEN l_tax END, 0) AS tax, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_returnflag END AS flag, least(greatest(l_discount, 0.02), 0.08) AS clipped, l_shipdate IS NULL AS isn FROM lineitem")
def conditional(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", when(col("l_quantity") > 30.0, lit("big"), lit("small")).alias("size"), col("l_tax").filter(col("l_tax") > 0.04).fill_null(0.0).alias("tax"), col("l_returnflag").replace("R", "returned").alias("flag"), col("l_discount").clip(0.02, 0.08).alias("clipped"), col("l_shipdate").is_null().alias("isn"))


@query("SELECT count(*) FILTER (isnan(x)) AS nans, avg(x) FILTER (NOT isnan(x)) AS mean, count(*) FILTER (NOT isnan(x) AND x > 10) AS gt, count(*) FILTER (isnan(x) OR x <> 20) AS ne FROM (SELECT CASE WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE l_quantity END AS x FROM lineitem)")
def nan_semantics(t):
    x = when(col("l_linenumber") == 2, lit(float("nan")), col("l_quantity"))
    f = t.lineitem.select(x.alias("x")).with_columns(col("x").is_nan().alias("n"), (col("x") > 10.0).alias("g"), (col("x") != 20.0).alias("d"))
    ones = lambda c: when(col(c), lit(1), None).count()
    return f.select(ones("n").alias("nans"), col("x").mean().alias("mean"), ones("g").alias("gt"), ones("d").alias("ne"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN '<= 10' WHEN p_size <= 30 THEN '<= 30' ELSE '> 30' END AS bin FROM part")
def cut(t):
    return t.part.select("p_partkey", col("p_size").cut([10, 30]).alias("bin"))


# set operations -----------------------------------------------------------------------------------------
@query("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.nation.select(col("n_nationkey").alias("k")).union(t.supplier.select(col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def set_union_all(t):
    return t.customer.select(col("c_custkey").alias("k")).concat(t.orders.select(col("o_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def set_intersect(t):
    return t.orders.select(col("o_custkey").alias("k")).intersect(t.customer.filter(col("c_acctbal") > 5000.0).select(col("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_except(t):
    return t.customer.select(col("c_custkey").alias("k")).except_(t.orders.select(col("o_custkey").alias("k")))


@query("SELECT r_regionkey, r_name, n_name FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) USING (i)")
def concat_horizontal(t):
    return t.region.sort("r_regionkey").hstack(t.nation.sort("n_nationkey").select("n_name"))


@query("SELECT c_custkey, c_name, coalesce(b, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS b FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def update(t):
    new = t.orders.group_by(col("o_custkey").alias("c_custkey")).agg(col("o_totalprice").max().alias("c_acctbal"))
    return t.customer.select("c_custkey", "c_name", "c_acctbal").update(new, on=["c_custkey"])


# SQL ---------------------------------------------------------------------------------------------------------
@query("SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def sql_five_way_join(t):
    names = ("customer", "orders", "lineitem", "supplier", "nation", "region")
    return SQLContext(t.spark, {n: getattr(t, n) for n in names}).execute(ORACLES["sql_five_way_join"])


@query("WITH big AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 5) SELECT c_mktsegment, count(*) AS customers, max(s) AS most FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment ORDER BY customers DESC")
def sql_cte_having(t):
    return SQLContext(t.spark, {"orders": t.orders, "customer": t.customer}).execute(ORACLES["sql_cte_having"])


@query("SELECT * EXCLUDE (c_nationkey), c_custkey // 10 AS bucket, CONCAT(c_name, '/', c_mktsegment) AS label FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def sql_dialect(t):
    return SQLContext(t.spark, {"customer": t.customer}).execute(ORACLES["sql_dialect"])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    disc = col("l_extendedprice") * (lit(1) - col("l_discount"))
    f = t.lineitem.filter(col("l_shipdate")._map(lambda c: c <= F.lit("1998-09-02").cast("timestamp_ntz")))
    return f.group_by("l_returnflag", "l_linestatus").agg(col("l_quantity").sum().alias("sum_qty"), col("l_extendedprice").sum().alias("sum_base"), disc.sum().alias("sum_disc"), (disc * (lit(1) + col("l_tax"))).sum().alias("sum_charge"), col("l_quantity").mean().alias("avg_qty"), col("l_discount").mean().alias("avg_disc"), count().alias("n"))


def sql_query(*tables: str) -> Callable:
    """A query whose text runs both here and on DuckDB: the dialect is translated, not restated."""

    def add(fn: Callable[[], str]) -> Callable:
        text = fn()
        QUERIES[fn.__name__] = lambda spark, sf_dir: SQLContext(spark, {n: getattr(Tables(spark, sf_dir), n) for n in tables}).execute(text).to_spark()
        ORACLES[fn.__name__] = text
        return fn

    return add


@sql_query("customer")
def sql_string_functions():
    return """SELECT c_custkey, left(c_name, -3) AS head, right(c_name, -9) AS rest, right(c_name, 2) AS last2, split_part(c_name, '#', -1) AS tail, strpos(c_name, '#') AS at,
        concat(c_name, NULL, c_nationkey) AS both_, array_to_string(string_to_array(c_mktsegment, 'I'), '.') AS parts, upper(c_mktsegment) || '|' || lower(c_name) AS cased,
        regexp_matches(c_name, '0{3}\\d*1') AS has, c_mktsegment ~ 'BUI.*' AS full_, c_mktsegment ^@ 'AUTO' AS pre, c_mktsegment ILIKE 'mach%' AS machine, strlen(c_name) AS bytes
        FROM customer"""


@sql_query("orders")
def sql_temporal():
    return """SELECT o_orderkey, extract(week FROM o_orderdate) AS week, extract(decade FROM o_orderdate) AS decade, date_part('century', o_orderdate) AS century, extract(dow FROM o_orderdate) AS dow,
        extract(isodow FROM o_orderdate) AS isodow, extract(isoyear FROM o_orderdate) AS isoyear, extract(quarter FROM o_orderdate) AS quarter, extract(second FROM o_orderdate) AS sec, extract(epoch FROM o_orderdate) AS epoch,
        strftime(o_orderdate, '%d.%m.%Y %H:%M') AS shown, CAST(o_orderdate + INTERVAL 1 MONTH < TIMESTAMP '1996-01-01 00:00:00' AS BOOLEAN) AS early
        FROM orders"""


@sql_query("lineitem")
def sql_casts_numeric():
    return """SELECT l_orderkey, l_linenumber, l_extendedprice::INTEGER AS whole, CAST(l_discount * 100 AS BIGINT) AS percent, TRY_CAST(l_returnflag AS INT) AS no_number, l_linenumber / 2 AS half, l_orderkey // 7 AS weeks,
        l_orderkey % 7 AS rem, mod(l_partkey, 5) AS m, sign(l_tax - 0.04) AS s, xor(l_orderkey, l_partkey) AS x, bit_count(l_orderkey) AS bits, greatest(l_quantity, NULL, 10) AS g, atan2(l_quantity, l_tax + 1) AS angle
        FROM lineitem"""


@sql_query("nation", "region")
def sql_star_modifiers():
    return """SELECT n.* REPLACE (upper(n_name) AS n_name) RENAME (n_regionkey AS region), r.* EXCLUDE (r_regionkey) FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey"""


@sql_query("customer", "orders")
def sql_quantified_subqueries():
    return """SELECT c_custkey, c_acctbal >= ALL (SELECT c_acctbal FROM customer) AS richest FROM customer
        WHERE c_acctbal > ANY (SELECT o_totalprice / 50 FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey <> ALL (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"""


@sql_query("orders")
def sql_lists_structs():
    return """WITH g AS (SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey) AS ks, {'n': count(*), 'top': max(o_totalprice)} AS st FROM orders GROUP BY ALL)
        SELECT o_custkey, ks[1] AS first_key, ks[99] AS none_, len(array_to_string(string_split(o_custkey::VARCHAR, '1'), '')) AS w, st.n AS n, st.top AS top, list_contains(ks, 7) AS seven, array_to_string(ks[2:3], ',') AS mid FROM g"""


@sql_query("events")
def sql_json_unnest():
    return """SELECT event_id, UNNEST([user_id, event_id, 0]) AS num, UNNEST(['u', 'e']) AS tag FROM events"""


@sql_query("supplier", "nation", "customer")
def sql_set_operations():
    return """(SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation) EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 ORDER BY k LIMIT 20"""


@sql_query("orders")
def sql_order_windows():
    return """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_orderpriority, '1-URGENT'), o_orderkey) AS n, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS quarter,
        lag(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders ORDER BY coalesce(nullif(o_orderpriority, '1-URGENT'), NULL), o_orderkey LIMIT 500"""


from . import families  # noqa: E402, F401  (registers its queries here)
