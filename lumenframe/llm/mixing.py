"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document has the same expected number of copies
e = target / source size. The prefix sums of e over the source's documents,
shifted by one random offset in [0, 1), cross integers; each crossing emits the
document once. As e is constant in a source, the k-th prefix sum is k * e, so
only ranks are needed: documents fall into cells (quarter of a power-of-two size class, two
hex digits of a hash of the id), ranks inside a cell are local, and the cells'
prefix counts are added. A source with a third of all rows so spreads over
thousands of cells. Ordering by size class makes the words taken, not only the
documents, come near the target.

Defined cases: null text has size 0; documents of size 0 are never taken and do
not enter the ranks; a null source is a source, last in order; repeated rows are
documents of their own; columns named in ``extra`` stay with their row, and order
rows of equal size and id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, keyed

WORD = r"[^\x20\x09-\x0D]+"
#: Targets stop at this multiple of a source's size.
MOST = 3


def offset_of(source: Column, seed: str) -> Column:
    """One number in [0, 1) for each source, from 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target from sizes (source, source_size), one row a source.

    Sources share the total by weight; a target stops at MOST times its source's
    size and the rest is shared again. Sorted by cap / weight, the sources that
    stop are the first ones, so running sums give the final level at once. The
    windows run over the table of sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", (MOST * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("c_before", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("w_from", F.col("all_w") - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    t = t.withColumn("stops", (F.col("total") - F.col("c_before")) * F.col("w") > F.col("cap") * F.col("w_from"))
    t = t.withColumn("c_stop", F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)).withColumn("w_rest", F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(everything))
    level = (F.col("total") - F.col("c_stop")) / F.col("w_rest")
    return t.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", extra: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of ``extra``, size, source_size, target, copies, taken; one row for each input row."""
    ws = Workspace(docs.sparkSession, "mix")
    extra = extra or []
    d = keyed(docs, id_col, text_col, source_col, *extra).toDF("doc_id", "text", "source", *extra)
    sized = ws.save(
        d.select("doc_id", "source", *extra, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .withColumn("cls", F.when(F.col("size") > 0, F.length(F.bin("size")) * 100 + F.rpad(F.substring(F.bin("size"), 2, 2), 2, "0").cast("int")).otherwise(0))
        .withColumn("cell", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2))
    )
    cells = ws.save(sized.groupBy("source", "cls", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("s")))
    goal = ws.save(targets(cells.groupBy("source").agg(F.sum("s").alias("source_size")), weights))
    # At most 256 size classes x 256 cells for each source.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cls", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cells.where("cls > 0").select("source", "cls", "cell", before.alias("base"))
    base = base.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "cls", "cell", "base", "source_size", "target")
    empty = cells.where("cls = 0").alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "cls", "cell", F.lit(0).cast("long").alias("base"), "source_size", "target")
    base = ws.save(base.unionByName(empty))
    ranked = sized.withColumn("k", F.row_number().over(Window.partitionBy("source", "cls", "cell").orderBy("size", "doc_id", *extra)))
    j = ranked.alias("r").join(base.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.cls") == F.col("b.cls")) & (F.col("r.cell") == F.col("b.cell")))
    e, k, u = F.col("target") / F.col("source_size"), F.col("base") + F.col("k"), offset_of(F.col("r.source"), seed)
    copies = F.when(F.col("size") > 0, (F.floor(u + k * e) - F.floor(u + (k - 1) * e)).cast("long")).otherwise(F.lit(0).cast("long"))
    return j.select("doc_id", *extra, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY source
), a AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w FROM src
), b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS c_before, all_w - coalesce(sum(w) OVER o, 0) AS w_from
  FROM a WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, (total - c_before) * w > cap * w_from AS stops FROM b),
d AS (
  SELECT *, sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS c_stop, sum(CASE WHEN stops THEN 0 ELSE w END) OVER () AS w_rest FROM c
), g AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE (total - c_stop) / w_rest * w END AS target FROM d),
r AS (
  SELECT s.doc_id, s.size, s.source, g.source_size, g.target,
    row_number() OVER (PARTITION BY s.source, s.size = 0 ORDER BY length(bin(s.size)) * 100 + rpad(substr(bin(s.size), 2, 2), 2, '0')::INT, substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 2), s.size, s.doc_id) AS k,
    ('0x' || substr(md5('mix:' || coalesce(s.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN g ON s.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (floor(u + k * (target / source_size)) - floor(u + (k - 1) * (target / source_size)))::BIGINT END AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM e
"""
