"""Semantics on small frames: nulls, NaN, order, rolling and Series variants, IO round trips, SQL."""

import math
import os

import pytest

from lumenframe import Frame, LazyFrame, Series, SQLContext, all_, col, count, lit, struct_cols, when
from lumenframe.operators import joins
from lumenframe.sources import io

NAN = float("nan")


def frame(spark, data, schema):
    return Frame.from_dict(spark, data, schema)


def test_filter_group_sort(spark):
    f = frame(spark, {"city": ["kyiv", "lviv", "kyiv", "odesa"], "value": [10, 20, 30, 5]}, "city string, value long")
    g = f.filter(col("value") > 5).group_by("city").agg(col("value").sum().alias("s")).sort("s", descending=True)
    assert g.rows() == [("kyiv", 40), ("lviv", 20)]


def test_null_comparison_and_kleene(spark):
    f = frame(spark, {"a": [1, 2, None, 4]}, "a long")
    assert [r[0] for r in f.filter(col("a") != 2).rows()] == [1, 4]
    assert [r[0] for r in f.select((col("a") > 1) | lit(True)).rows()] == [True] * 4


def test_nan(spark):
    f = frame(spark, {"v": [1.0, NAN, 3.0, None]}, "v double")
    assert [r[0] for r in f.select((col("v") > 0.0).alias("k")).rows()] == [True, False, True, None]
    assert [r[0] for r in f.select((col("v") != 1.0).alias("k")).rows()] == [False, True, True, None]
    assert f.select(col("v").sum().alias("s"), col("v").mean().alias("m")).rows() == [(4.0, 2.0)]
    assert math.isnan(LazyFrame(f.df, f.order).mean().rows()[0][0])
    assert f.mean().rows() == [(2.0,)]


def test_integer_division_truncates(spark):
    f = frame(spark, {"a": [7, -7], "b": [2, 2]}, "a long, b long")
    assert [r[0] for r in f.select(col("a") / col("b")).rows()] == [3, -3]


def test_order(spark):
    f = frame(spark, {"a": [5, 1, 4, 2, 3], "b": [10, 20, 30, 40, 50], "g": [1, 1, 2, 1, 2]}, "a long, b long, g long")
    assert [r[0] for r in f.with_row_index().select("index").rows()] == [0, 1, 2, 3, 4]
    assert [r[0] for r in f.tail(2).select("a").rows()] == [2, 3]
    assert [r[0] for r in f.slice(1, 3).select("a").rows()] == [1, 4, 2]
    assert [r[0] for r in f.gather_every(2).select("a").rows()] == [5, 4, 3]
    assert [r[0] for r in f.reverse().select("a").rows()] == [3, 2, 4, 1, 5]
    assert [r[0] for r in f.select(col("a").shift(1).alias("a")).rows()] == [None, 5, 1, 4, 2]
    assert [r[0] for r in f.unique("g").select("g").rows()] == [1, 2]
    assert [r[0] for r in f.select(col("a").cum_count().over("g").alias("c")).rows()] == [1, 2, 1, 3, 2]
    assert [r[0] for r in f.limit(2).sort("a").select("a").rows()] == [1, 5]


def test_joins(spark):
    a = frame(spark, {"id": [1, 2, 3, None], "l": ["a", "b", "c", "d"]}, "id long, l string")
    b = frame(spark, {"id": [2, 4, None], "r": ["x", "y", "z"]}, "id long, r string")
    assert a.join(b, on="id").height == 2  # null keys match
    assert a.join(b, on="id", how="left").columns == ["id", "l", "id_right", "r"]
    assert sorted(r[1] for r in a.join(b, on="id", how="anti").rows()) == ["a", "c"]
    assert a.join(b, how="cross").height == 12
    assert a.join(b, on="id", how="full").height == 5


@pytest.mark.parametrize("how, want", [("backward", [100, 400, 800]), ("forward", [100, 800, None]), ("nearest", [100, 400, 800])])
def test_asof(spark, how, want):
    a = frame(spark, {"t": [1, 5, 10], "l": ["a", "b", "c"]}, "t long, l string")
    b = frame(spark, {"t": [1, 4, 8], "r": [100, 400, 800]}, "t long, r long")
    out = a.join_asof(b, on="t", strategy=how)
    assert [r[3] for r in out.sort("t").rows()] == want


def test_asof_tolerance(spark):
    a = frame(spark, {"ts": [10, 20, 30], "v": [1, 2, 3]}, "ts long, v long")
    b = frame(spark, {"ts": [5, 18, 29], "price": [100, 200, 300]}, "ts long, price long")
    assert [r[3] for r in a.join_asof(b, on="ts", tolerance=3).sort("ts").rows()] == [None, 200, 300]


def test_dynamic_and_upsample(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, h, m) for h, m in ((0, 0), (0, 30), (1, 0), (1, 15))]
    f = frame(spark, {"t": t, "v": [1, 2, 3, 4]}, "t timestamp_ntz, v long")
    assert [r[1] for r in f.group_by_dynamic("t", "1h").agg(col("v").sum().alias("s")).sort("t").rows()] == [3, 7]
    u = frame(spark, {"t": [t[0], t[0].replace(hour=2), t[0].replace(hour=3)], "v": [1, 2, 3]}, "t timestamp_ntz, v long").upsample("t", "1h")
    assert [r[1] for r in u.sort("t").rows()] == [1, None, 2, 3]


def test_rolling_variants(spark):
    s = Series.of(spark, "a", [1.0, None, 3.0, 4.0], "Float64")
    assert s.rolling_sum(2).to_list() == [None, None, None, 7.0]
    f = s.to_frame()
    assert [r[0] for r in f.select(col("a").rolling_sum(2).alias("a")).rows()] == [1.0, 1.0, 3.0, 7.0]
    assert Series.of(spark, "a", [3.0, 1.0, 4.0, 2.0], "Float64").rolling_median(3).to_list() == [None, None, 3.0, 2.0]


def test_series(spark):
    s = Series.of(spark, "a", [3, 1, 3, None], "Int64")
    assert (s.sum(), s.mean(), s.min(), s.max(), s.n_unique(), s.null_count(), s.mode()) == (7, 7 / 3, 1, 3, 2, 1, 3)
    assert (s.arg_max(), s.arg_min(), s.index_of(1), s.index_of(9)) == (0, 1, 1, -1)
    assert s.sort().to_list() == [None, 1, 3, 3]
    assert s.unique().to_list() == [3, 1, None]
    assert s.cum_sum().to_list() == [3.0, 4.0, 7.0, None]
    assert s.gather([2, 0]).to_list() == [3, 3]
    assert s.append(s).to_list() == [3, 1, 3, None] * 2
    assert s.add(s).to_list() == [6, 2, 6, None]
    assert s.eq(3).to_list() == [True, False, True, None]
    assert s.value_counts().rows() == [(3, 2), (1, 1), (None, 1)]
    assert Series.of(spark, "e", [], "Float64").sum() == 0
    assert Series.of(spark, "f", [1.0, None, 3.0, None, 5.0], "Float64").interpolate().to_list() == [1, 2, 3, 4, 5]
    assert Series.of(spark, "w", [1.0, 2.0], "Float64").ewm_mean(0.5).to_list() == [1.0, 1.5]


def test_strings(spark):
    f = frame(spark, {"s": ["  abc ", "héllo wörld", None]}, "s string")
    out = f.select(col("s").str.trim().alias("t"), col("s").str.len().alias("b"), col("s").str.char_len().alias("c"), col("s").str.to_title().alias("ti"), col("s").str.left(-2).alias("l"), col("s").str.replace("l", "$1").alias("r")).rows()
    assert out[0] == ("abc", 6, 6, "  Abc ", "  ab", "  abc ")
    assert out[1] == ("héllo wörld", 13, 11, "Héllo Wörld", "héllo wör", "hé$1lo wörld")
    assert out[2] == (None,) * 6


def test_bits(spark):
    f = frame(spark, {"a": [0, 1, 8, -1]}, "a long")
    rows = f.select(col("a").bitwise_leading_zeros().alias("x"), col("a").bitwise_trailing_zeros().alias("y"), col("a").bitwise_count_ones().alias("z")).rows()
    assert rows == [(64, 64, 0), (63, 0, 1), (60, 3, 1), (0, 0, 64)]


def test_reshape(spark):
    f = frame(spark, {"g": ["a", "a", "b", "b"], "k": ["x", "y", "x", "y"], "v": [1, 2, 3, 4]}, "g string, k string, v long")
    assert sorted(f.pivot("g", "k", "v").rows()) == [("a", 1, 2), ("b", 3, 4)]
    wide = f.pivot("g", "k", "v")
    assert sorted(wide.unpivot(["g"]).rows()) == [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 4)]
    assert sorted(wide.transpose("g").rows()) == [("x", 1, 3), ("y", 2, 4)]
    n = Frame(spark.sql("SELECT 1 AS id, array('a', 'b') AS tags UNION ALL SELECT 2, null UNION ALL SELECT 3, array()"))
    assert sorted(n.explode("tags").rows(), key=str) == [(1, "a"), (1, "b"), (2, None), (3, None)]
    s = f.select("g", struct_cols("k", "v").alias("s"))
    assert s.flatten_struct("s").columns == ["g", "s_k", "s_v"]


def test_aggregates_in_projection(spark):
    f = frame(spark, {"a": [1, 2, 3, 6]}, "a long")
    assert [r[0] for r in f.filter(col("a") > col("a").mean()).rows()] == [6]
    assert f.select(col("a").sum().alias("s"), count().alias("n")).rows() == [(12, 4)]
    assert f.select(all_()).columns == ["a"]
    assert [r[1] for r in f.with_columns(when(col("a") > 2, 1, 0).alias("k")).rows()] == [0, 0, 1, 1]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "ipc"])
def test_round_trip(spark, tmp_path, kind):
    f = frame(spark, {"id": [1, 2], "s": ["a,\"b", None], "x": [1.5, -2.0]}, "id long, s string, x double")
    path = str(tmp_path / f"t.{kind}")
    getattr(f, f"write_{kind}")(path)
    read = {"csv": io.scan_csv, "json": lambda s, p: io.scan_json(s, p, True), "parquet": io.scan_parquet, "ipc": io.scan_ipc}[kind]
    assert sorted(read(spark, path).select("id", "s", "x").rows()) == sorted(f.rows())


def test_partitions_are_strings_and_pruned(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    f = frame(spark, {"id": [1, 2], "year": ["2024", "2025"]}, "id long, year string")
    f.write_parquet(str(tmp_path / "p"), partition_by=["year"])
    got = io.scan_parquet(spark, str(tmp_path / "p")).filter(col("year") == "2025")
    assert got.rows() == [(2, "2025")]
    assert "PartitionFilters: [isnotnull(year" in got.explain()


def test_filter_reaches_the_scan(spark):
    f = io.scan_parquet(spark, "/root/testdata/sf0.001/orders.parquet").filter((col("o_totalprice") > 1000.0) & (col("o_custkey") == 7)).select("o_orderkey")
    plan = f.explain()
    assert "EqualTo(o_custkey,7)" in plan.split("PushedFilters")[1].split("\n")[0]
    assert "o_comment" not in plan and "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_sql(spark):
    a = frame(spark, {"a": [1, 2, 3], "c": ["w", "y", None]}, "a long, c string")
    ctx = SQLContext(spark, {"t": a})
    assert ctx.tables() == ["t"]
    assert ctx.execute("SELECT a // 2 AS h, CONCAT(c, '!') AS k FROM t ORDER BY c DESC").rows() == [(1, "y!"), (0, "w!"), (1, "!")]
    assert ctx.execute("SELECT * EXCLUDE (c) FROM t WHERE a IN (SELECT max(a) FROM t)").rows() == [(3,)]
    assert ctx.execute("SELECT normalize('é', 'NFC') AS n").rows() == [("é",)]
    ctx.execute("DELETE FROM t WHERE a > 2")
    assert ctx.execute("SELECT count(*) AS n FROM t").rows() == [(2,)]
    with pytest.raises(Exception):
        ctx.execute("SELECT * FROM missing")


def test_streaming_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    from lumenframe.streaming import windows

    spark.range(10).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v long").parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", [F.sum("v").alias("s")], "1 minute").writeStream.format("memory").queryName("w_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.sql("SELECT s FROM w_test").collect()) == [1, 5, 9, 13, 17]


def test_entry_without_llm():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names
    assert os.path.exists(e.__file__)


def test_list_expressions(spark):
    f = frame(spark, {"g": ["a", "a", "a", "b"], "v": [3, 1, 3, None], "x": [1.0, None, 3.0, 2.0]}, "g string, v long, x double")
    v, x = col("v"), col("x")
    r = f.group_by("g").agg(
        v.head(2).alias("h"), v.tail(1).alias("t"), v.unique().alias("u"), v.sort().alias("s"), v.arg_sort().alias("o"), v.rle_id().alias("r"), v.top_k(1).alias("k"),
        x.interpolate().alias("i"), x.ewm_mean(0.5).alias("e"), v.rle().alias("l"), v.value_counts().alias("c"), v.entropy().alias("n"),
    ).filter(col("g") == "a").to_dicts()[0]
    assert (r["h"], r["t"], r["u"], r["s"], r["o"], r["r"], r["k"]) == ([3, 1], [3], [3, 1], [1, 3, 3], [1, 0, 2], [0, 1, 2], [3])
    assert r["i"] == [1.0, 2.0, 3.0] and r["e"] == [1.0, None, 2.0]
    assert [tuple(y) for y in r["l"]] == [(3, 1), (1, 1), (3, 1)] and [tuple(y) for y in r["c"]] == [(3, 2), (1, 1)]
    assert math.isclose(r["n"], -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    assert [y[0] for y in f.select(v.rolling_rank(2).alias("r")).rows()] == [None, 1.0, 2.0, None]
    assert [y[0] for y in f.select(x.qcut([0.5]).alias("q")).rows()] == ["<= 2.0", None, "> 2.0", "<= 2.0"]


def test_serialize(spark):
    f = frame(spark, {"a": [1, 2], "s": ["x", None]}, "a long, s string")
    assert Frame.deserialize(spark, f.serialize()).equals(f)
    s = Series.of(spark, "a", [2.0, 1.0, 4.0], "Float64")
    by = Series.of(spark, "b", [3, 1, 2], "Int64")
    assert s.rolling_sum_by(by, 2).to_list() == [6.0, None, 5.0]
    with pytest.raises(NotImplementedError):
        f.write_excel("x")


def test_as_of_keys_that_are_decimals(spark):
    make = lambda rows, name: Frame(spark.createDataFrame(rows, f"k string, {name} int").selectExpr("cast(k AS decimal(10,2)) AS k", name))
    left, right = make([("1.10", 1), ("1.60", 2), ("2.00", 3), ("0.50", 4)], "a"), make([("1.50", 10), ("1.05", 20), ("2.00", 30)], "b")
    got = joins.asof(left.df, right.df, "k", "k", [])
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 20), (2, 10), (3, 30), (4, None)]


def test_interpolation_fills_the_ends(spark):
    f = Frame(spark.createDataFrame([(i, v) for i, v in enumerate([None, 2.0, None, 4.0, None])], "i int, v double")).sort("i").interpolate("v")
    assert [r.v for r in f.sorted_spark().orderBy("i").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0]


def test_csv_without_line_breaks_in_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    for quoted in (True, False):
        assert [tuple(r) for r in io.scan_csv(spark, str(tmp_path / "x.csv"), quoted_newlines=quoted).to_spark().collect()] == [(1, "x, y"), (2, "z")]


@pytest.mark.parametrize("ids", [[4, 5, 6, 7, 8, 9], [9, 8, 7, 6, 5, 4]])
def test_min_by_and_max_by_of_ties_do_not_hang_on_the_order_of_rows(spark, ids):
    key = {4: None, 5: 1.0, 6: 1.0, 7: 2.0, 8: 3.0, 9: 3.0}
    f = Frame(spark.createDataFrame([(i, key[i]) for i in ids], "i int, v double").coalesce(1))
    assert f.select(col("i").min_by(col("v")).alias("a"), col("i").max_by(col("v")).alias("b")).rows() == [(5, 9)]
    none = f.filter(col("i") == 4)
    assert none.select(col("i").min_by(col("v")).alias("a"), col("i").max_by(col("v")).alias("b")).rows() == [(None, None)]
