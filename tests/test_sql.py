"""The SQL dialect, each form against the value that it must give."""

import datetime as dt

import pytest

from lumenframe import Frame, SQLContext
from lumenframe.sql import translate


@pytest.fixture(scope="module")
def ctx(spark):
    t = Frame(spark.sql("SELECT * FROM VALUES (1, 4.5D, 'xx,yy,zz', timestamp_ntz'2024-01-07 01:02:03.123456'), (2, 2.5D, 'a.b', timestamp_ntz'2020-12-30 10:30:45.987654'), (3, -1.5D, null, timestamp_ntz'2006-01-01 23:59:59.555555') AS v(a, x, s, ts)"))
    u = Frame(spark.sql("SELECT * FROM VALUES (2, array(1, 2, 3), array('p', 'q'), '{\"k\": {\"m\": 7}}') AS v(a, l, m, j)"))
    return SQLContext(spark, {"t": t, "u": u})


SCALARS = [
    ("left('hello', -2)", "hel"),
    ("LEFT('hello', 2)", "he"),
    ("right('hello', -2)", "llo"),
    ("right('hello', 3)", "llo"),
    ("concat('a', NULL, 1)", "a1"),
    ("string_to_array('a.b', '.')", ["a", "b"]),
    ("split_part('xx,yy,zz', ',', -2)", "yy"),
    ("strpos('hello', 'l')", 3),
    ("strlen('é')", 2),
    ("regexp_matches('foobar', 'o{2}b')", True),
    ("regexp_matches('FOO', 'foo', 'i')", True),
    (r"regexp_matches('a1', '\d')", True),
    ("'foo' ~ 'fo'", False),
    ("'foo' ~ 'fo+'", True),
    ("'foo' !~ 'fo'", True),
    ("'foo' ^@ 'fo'", True),
    ("7 // 2", 3),
    ("xor(5, 3)", 6),
    ("bit_count(7)", 3),
    ("2.5::DOUBLE::int", 2),
    ("CAST(5.5 AS INTEGER)", 6),
    ("TRY_CAST('no' AS INT)", None),
    ("'12'::INT8", 12),
    ("512.5::NUMERIC(4,0)::int", 513),
    ("[10, 20, 30][2]", 20),
    ("[10, 20, 30][9]", None),
    ("[10, 20, 30, 40][2:3]", [20, 30]),
    ("array_to_string(['a', 'b'], '-')", "a-b"),
    ("{'k': 5}.k", 5),
    ("""'{"k": {"m": 7}}' ->> '$.k.m'""", "7"),
    ("strftime(TIMESTAMP '2024-01-07 01:02:03', '%Y/%m/%d at %H')", "2024/01/07 at 01"),
    ("strptime('07-01-2024', '%d-%m-%Y')", dt.datetime(2024, 1, 7)),
    ("date_part('century', DATE '2001-01-01')", 21),
    ("extract(decade FROM DATE '2024-01-07')", 202),
    ("extract(week FROM DATE '2006-01-01')", 52),
    ("extract(epoch FROM TIMESTAMP '1970-01-01 00:01:00')", 60.0),
    ("'it''s -- not // a comment'", "it's -- not // a comment"),
    ("$$dollar 'quoted'$$", "dollar 'quoted'"),
    ("2 >= ALL (SELECT 1 UNION ALL SELECT 2)", True),
    ("2 > ALL (SELECT 1 UNION ALL SELECT 2)", False),
    ("2 > ANY (SELECT 1 UNION ALL SELECT 5)", True),
    ("2 = ANY (SELECT 1 UNION ALL SELECT 5)", False),
    ("2 <> ALL (SELECT 1 UNION ALL SELECT 5)", True),
    ("2 > ALL (SELECT 1 WHERE false)", True),
    ("2 = ANY ([1, 2])", True),
]


@pytest.mark.parametrize("text, want", SCALARS, ids=[s for s, _ in SCALARS])
def test_scalar(ctx, text, want):
    assert ctx.execute(f"SELECT {text} AS v").rows() == [(want,)]


def test_seconds(ctx):
    got = ctx.execute("SELECT extract(second FROM ts) AS s, extract(millisecond FROM ts) AS ms, date_part('microsecond', ts) AS us FROM t WHERE a = 1").rows()
    assert got == [(3, 3123, 3123456)]


def test_columns(ctx):
    assert ctx.execute("SELECT * RENAME (a AS id) EXCLUDE (ts) FROM t LIMIT 0").columns == ["id", "x", "s"]
    assert ctx.execute("SELECT * EXCLUDE ts FROM t LIMIT 0").columns == ["a", "x", "s"]
    assert ctx.execute("SELECT * REPLACE (a * 2 AS a) FROM t WHERE a = 2").select("a", "x").rows() == [(4, 2.5)]
    assert ctx.execute("SELECT COLUMNS('^(a|x)$') FROM t WHERE a = 2").rows() == [(2, 2.5)]
    assert ctx.execute("WITH w AS (SELECT a, x FROM t) SELECT w.* REPLACE (0 AS x) FROM w WHERE a = 1").rows() == [(1, 0)]
    assert ctx.execute("SELECT k.* RENAME (x AS y) FROM (SELECT a, x FROM t) AS k LIMIT 0").columns == ["a", "y"]


def test_order(ctx):
    assert ctx.execute("SELECT a FROM t ORDER BY s").rows() == [(2,), (1,), (3,)]
    assert ctx.execute("SELECT a FROM t ORDER BY coalesce(s, NULL) DESC NULLS FIRST, a").rows() == [(3,), (1,), (2,)]
    assert ctx.execute("SELECT a FROM (SELECT * FROM t ORDER BY abs(x), a LIMIT 2) ORDER BY 1").rows() == [(2,), (3,)]
    assert ctx.execute("SELECT a, row_number() OVER (ORDER BY substr(s, 1, 1)) AS n FROM t ORDER BY ALL").rows() == [(1, 2), (2, 1), (3, 3)]
    assert ctx.execute("SELECT a FROM t UNION ALL SELECT 9 ORDER BY a DESC LIMIT 1").rows() == [(9,)]


def test_lists(ctx):
    assert ctx.execute("SELECT a, UNNEST(l) AS x, UNNEST(m) AS y FROM u").rows() == [(2, 1, "p"), (2, 2, "q"), (2, 3, None)]
    assert ctx.execute("SELECT UNNEST(l) AS x FROM u").rows() == [(1,), (2,), (3,)]
    assert ctx.execute("SELECT array_agg(a ORDER BY x DESC) AS l FROM t").rows() == [([1, 2, 3],)]
    assert ctx.execute("SELECT t.a FROM t SEMI JOIN u ON t.a = u.a").rows() == [(2,)]
    assert ctx.execute("SELECT a FROM t WHERE a NOT IN (SELECT a FROM u) ORDER BY a").rows() == [(1,), (3,)]
    assert ctx.execute("SELECT j ->> '$.k.m' AS m, l[1] AS f FROM u").rows() == [("7", 1)]


def test_files(ctx, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("k,v\n1,a\n2,b\n")
    assert ctx.execute(f"SELECT v FROM read_csv('{path}') WHERE k = 2").rows() == [("b",)]


def test_unbalanced():
    with pytest.raises(ValueError):
        translate("SELECT (1")
