"""Ordered passes that run range by range give what one pass gives."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe import Frame, LazyFrame, Series, col
from lumenframe.operators import stats


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 20)


def test_place(spark, small_ranges):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    cuts = stats.range_cuts(df, F.col("x"))
    assert len(cuts) > 40
    got = df.select("x", stats.place(F.col("x"), cuts).alias("p")).collect()
    assert all(p == sum(c < x for c in cuts) for x, p in got)
    edges = spark.sql("SELECT explode(array(CAST(NULL AS DOUBLE), CAST('NaN' AS DOUBLE), -1D)) AS x").select(stats.place(F.col("x"), cuts)).collect()
    assert [r[0] for r in edges] == [0, len(cuts), 0]


@pytest.mark.parametrize("key", ["i", "s", "d"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_last", [False, True])
def test_row_index(spark, small_ranges, key, descending, nulls_last):
    rng = random.Random(3)
    rows = [(n, rng.choice([None, rng.randrange(40)]), rng.choice([None, "", "é", "abcdefgh", "abcdefgz", chr(97 + n % 26)]), rng.choice([float("nan"), rng.random()]), n % 2 == 0) for n in range(120)]
    df = spark.createDataFrame(rows, "n int, i int, s string, d double, b boolean")
    f = Frame(df).sort("n").sort(key, descending=descending, nulls_last=nulls_last)
    got = f.with_row_index("k").to_spark().orderBy("k").select("k", "n").collect()
    want = [r["n"] for r in f.sorted_spark().collect()]
    assert [r["k"] for r in got] == list(range(120))
    assert [r["n"] for r in got] == want


def test_running_sum(spark, small_ranges):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    got = Frame(df).sort("k", descending=True).cum_sum_all("v", "c").to_spark().orderBy(F.desc("k")).toPandas()
    assert (got["c"] == got["v"].cumsum()).all()


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof(spark, small_ranges, strategy, tolerance):
    rng = random.Random(5)
    left = pd.DataFrame({"t": sorted(rng.sample(range(2000), 150)), "a": range(150)})
    right = pd.DataFrame({"t": sorted({*rng.sample(range(300, 700), 40), *rng.sample(range(1500, 1900), 40)})})
    right["v"] = range(len(right))
    got = Frame(spark.createDataFrame(left)).join_asof(Frame(spark.createDataFrame(right)), on="t", strategy=strategy, tolerance=tolerance).to_spark().orderBy("t").toPandas()
    assert len(got) == len(left)
    for t, hit in zip(got["t"], got["t_right"]):
        pool = [r for r in right["t"] if (strategy == "nearest" or (r <= t) == (strategy == "backward") or r == t) and (tolerance is None or abs(r - t) <= tolerance)]
        want = min(pool, key=lambda r: abs(r - t), default=None)
        assert (want is None and pd.isna(hit)) or abs(hit - t) == abs(want - t)


def test_asof_null_and_empty(spark, small_ranges):
    left = spark.sql("SELECT id AS t FROM range(30) UNION ALL SELECT NULL")
    right = spark.sql("SELECT 5L AS t, 'x' AS v")
    got = {r["t"]: r["v"] for r in Frame(left).join_asof(Frame(right), on="t").to_spark().collect()}
    assert len(got) == 31 and got[None] is None and got[4] is None and got[5] == got[29] == "x"
    none = Frame(left).join_asof(Frame(right.where("false")), on="t").to_spark()
    assert none.count() == 31 and none.where("v IS NOT NULL").count() == 0


def _no_frame_of_all_rows_that_follow(f):
    assert "currentrow$(), unboundedfollowing$()" not in f.explain("formatted")
    return f


def test_looking_ahead_is_one_pass(spark):
    values = [None, 3.0, None, None, float("nan"), 5.0, None, 7.0, None]
    rows = [(n, n % 2, v) for n, v in enumerate(values)]
    f = Frame(spark.createDataFrame(rows, "n int, g int, v double")).sort("n")
    ahead = lambda rows: [next((v for v in rows[i:] if v is not None), None) for i in range(len(rows))]
    v = col("v")
    got = _no_frame_of_all_rows_that_follow(f.select("n", v.backward_fill().alias("b"), v.shift(1).backward_fill().alias("s"), v.backward_fill().over("g").alias("o"))).to_spark().orderBy("n").collect()
    assert repr([r["b"] for r in got]) == repr(ahead(values))
    assert repr([r["s"] for r in got]) == repr(ahead([None, *values[:-1]]))
    for g in (0, 1):
        assert repr([r["o"] for r in got if r["n"] % 2 == g]) == repr(ahead(values[g::2]))
    assert repr(sorted(r["n"] for r in f.sort(v.backward_fill()).to_spark().collect())) == repr(list(range(len(values))))
    kept = f.with_columns(v.backward_fill().alias("b"))
    assert kept.columns == ["n", "g", "v", "b"]
    line = f.filter(col("n") != 4)
    want = [3.0, 3.0, 11 / 3, 13 / 3, 5.0, 6.0, 7.0, 7.0]  # by row number
    got = _no_frame_of_all_rows_that_follow(line.interpolate("v")).to_spark().orderBy("n").collect()
    assert [r["v"] for r in got] == pytest.approx(want)
    by = _no_frame_of_all_rows_that_follow(line.select("n", v.interpolate_by(col("n")).alias("v"))).to_spark().orderBy("n").collect()
    assert [r["v"] for r in by] == pytest.approx([None, 3.0, 3.5, 4.0, 5.0, 6.0, 7.0, None], nan_ok=True)


@pytest.mark.parametrize("strategy", ["forward", "nearest"])
def test_asof_ahead_is_one_pass(spark, strategy):
    left, right = spark.sql("SELECT id AS t FROM range(12)"), spark.sql("SELECT t, 'x' || t AS v FROM VALUES (3L), (3L), (7L) AS r(t)")
    f = _no_frame_of_all_rows_that_follow(Frame(left).join_asof(Frame(right), on="t", strategy=strategy))
    got = {r["t"]: r["v"] for r in f.to_spark().collect()}
    split = 3 if strategy == "forward" else 5
    assert got == {t: "x3" if t <= split else "x7" if t <= 7 or strategy == "nearest" else None for t in range(12)}


@pytest.mark.parametrize("sketch", [1, 2000])
def test_quantiles_do_not_gather_all_values(spark, monkeypatch, sketch):
    """Poor cuts (a sketch of accuracy 1) change how much is grouped, not the result."""
    monkeypatch.setattr(stats, "SKETCH", sketch, raising=False)
    rng, nan = random.Random(7), float("nan")
    rows = [(rng.choice([None, nan, 15.0, 15.0, rng.gauss(0, 1), 1e300 * rng.random(), float("inf")]), rng.choice([None, *range(40)]), None) for _ in range(900)]
    df = spark.createDataFrame(rows, "d double, i long, e double").repartition(5)
    known = {c: sorted(v for r in rows if (v := r["die".index(c)]) is not None and v == v) for c in "die"}

    def linear(v, q):
        p = q * (len(v) - 1)
        lo, hi = v[int(p)], v[min(int(p) + 1, len(v) - 1)] if p % 1 else v[int(p)]
        return float(lo) if lo == hi else (int(p) + 1 - p) * lo + (p - int(p)) * hi

    for q in (0.0, 0.3, 0.97):
        got = LazyFrame(df).quantile(q)
        assert "percentile(" not in got.explain("formatted")
        assert got.rows() == [(linear(known["d"], q), linear(known["i"], q), None)]
        near = [known[c][max(math.ceil(q * len(known[c])) - 1, 0)] for c in "di"]
        assert Frame(df).quantile(q).rows() == [(*near, None)]
    assert "percentile(" not in Frame(df).describe().explain("formatted") and "percentile(" not in Frame(df).median().explain("formatted")
    parts = Frame(df).describe().select("statistic", "d", "i").rows()
    assert {n: (d, i) for n, d, i in parts if n.endswith("%")} == {f"{int(q * 100)}%": (linear(known["d"], q), linear(known["i"], q)) for q in (0.25, 0.5, 0.75)}
    assert Series(Frame(df), "i").quantile(0.3) == linear(known["i"], 0.3) and Series(Frame(df), "e").median() == 0
