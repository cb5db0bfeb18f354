"""Embedding near-dedup by sorted projection passes.

Each pass hashes a vector by the signs of random projections; the bits, taken as
one number, order the vectors of a label lexicographically, and each vector is
compared with the next ``window`` ones. Range partitions keep the order; the
rows at their ends travel to the ranges before that their windows begin in, so no window is
cut, however short a range. Pairs of at least ``threshold`` are united across passes. Vectors
are hashed from the centre of their label, so a direction that a label has in common orders nothing.

Where ``passes`` is not given, their number first follows the number of vectors, as
if directions were spread evenly. Labels can be denser than that, so recall is then
measured, by one rule for inputs of any size: all links of ``queries`` vectors (the first ones
by a hash of vector and round) are counted by brute force. While more than 1 - ``recall`` of
them are outside components, further passes with windows twice as wide follow and other
vectors are asked; windows that span all vectors end this. Brute force only measures: every
link that unites comes from a window of a pass.

Equal vectors of a label are one representative first, so copies neither fill
windows nor make pairs. Tasks send on only pairs that unite something new.
Inside each component the direct links are then counted
over all its representatives, tile against tile; counts, not pairs, leave a tile.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite
components, and rows of null label link with nothing; vectors of different
lengths never link; repeated ids count as vectors of their own, and a null id
takes part but is never the least; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, keyed

BITS = 60
#: Centres of at most this many labels may be broadcast.
BROADCAST_LABELS = 10_000


def passes_for(rows: int, threshold: float, window: int, recall: float = 0.97, least: int = 16) -> int:
    """Passes that bring a pair right at the threshold into a window with probability ``recall``.

    Vectors that share the first log2(rows / window) bits fill about one window; each
    bit of the pair agrees with probability 1 - angle / pi.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    met = agree ** max(0.0, math.log2(max(1, rows) / window))
    return max(least, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else least


def projections(dim: int, one_pass: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, one_pass, dim]).standard_normal((dim, BITS))


def unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    m = m / np.abs(m).max(axis=1, keepdims=True)  # tiny and huge components neither vanish nor overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def window_pairs(rep: np.ndarray, u: np.ndarray, window: int, threshold: float, fresh: int = 0) -> tuple[list, list]:
    """Pairs of at least the threshold up to ``window`` rows apart; those whose later row is at ``fresh`` or after."""
    a, b = [], []
    for k in range(1, min(window, len(rep) - 1) + 1):
        lo = max(0, fresh - k)
        cos = np.einsum("ij,ij->i", u[lo:-k], u[lo + k :])
        hit = lo + np.flatnonzero(cos >= threshold)
        a.append(rep[hit])
        b.append(rep[hit + k])
    return a, b


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that unite something new: enough for components, and fewer than there are ids."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))
    keep = []
    for k, (x, y) in enumerate(zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, passes_at_once: int = 4, window: int = 10, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = 1024, queries: int = 1024, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each input row."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "vectors")
    d = keyed(vectors, id_col, vector_col, label_col).toDF("vec_id", "v", "label")
    v = F.col("v").cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    d = d.withColumn("sound", sound)
    zero_free = F.transform("v", lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(dict(d.dtypes)["v"])
    good = d.where("sound").select("vec_id", "label", zero_free.alias("v"))
    # Equal vectors: one representative, numbered by a hash of its content.
    content = good.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.hash("v", "label").alias("h2"))
    members = ws.save(content.select("vec_id", "h1", "h2"))
    reps = ws.save(content.groupBy("h1", "h2").agg(F.min_by(F.struct("label", "v"), F.coalesce("vec_id", F.lit(2**63 - 1))).alias("x"), F.min("vec_id").alias("least"), F.count("*").alias("copies")).select("h1", "h2", F.xxhash64("h1", "h2").alias("rep"), "x.label", "x.v", "least", "copies", F.size("x.v").alias("dim")))
    measured, n_reps = passes is None, reps.count()
    if passes is None:
        passes = passes_for(n_reps, threshold, window)
    # A label can hold any share of the rows: ranges are cut by label and key together.
    label_type = dict(reps.dtypes)["label"]

    def sums(batches):
        for pdf in batches:
            got = [(label, np.int32(dim), len(part), unit(part["v"]).sum(axis=0)) for (label, dim), part in pdf.groupby(["label", "dim"])]
            yield pd.DataFrame(got, columns=["label", "dim", "n", "c"])

    def centre(pdf):
        return pd.DataFrame({"label": pdf["label"].head(1), "dim": pdf["dim"].head(1), "c": [np.sum(np.stack(pdf["c"]), axis=0) / pdf["n"].sum()]})

    # One row for each batch and label comes together; labels that fit one window need no centre.
    parts = ws.save(reps.select("label", "dim", "v").mapInPandas(sums, f"label {label_type}, dim int, n long, c array<double>"))
    large = parts.groupBy("label", "dim").agg(F.sum("n").alias("all")).where(F.col("all") > window).select("label", "dim")
    centres = ws.save(parts.join(large, ["label", "dim"], "left_semi").groupBy("label", "dim").applyInPandas(centre, f"label {label_type}, dim int, c array<double>"))
    placed = reps.select("rep", "label", "v", "dim").join(F.broadcast(centres) if centres.count() <= BROADCAST_LABELS else centres, ["label", "dim"], "left")

    def recall_of(asked: DataFrame, comp: DataFrame) -> tuple[int, int]:
        """How many links the vectors of asked (few) have with all others, by brute force, and how many of them components miss."""
        own = F.coalesce("comp", "rep").alias("own")
        got = asked.select("rep", "label", "dim", "v").join(comp.toDF("rep", "comp"), "rep", "left").select("rep", "label", "dim", "v", own).toPandas()
        known = {k: (q["rep"].to_numpy(), q["own"].to_numpy(), unit(q["v"])) for k, q in got.groupby(["label", "dim"])}

        def run(batches):
            for pdf in batches:
                for k, part in pdf.groupby(["label", "dim"]):
                    if k not in known:
                        continue
                    q, of, u = known[k]
                    rep, v = part["rep"].to_numpy(), unit(part["v"])
                    for lo in range(0, len(rep), 1024):
                        i, j = np.nonzero(v[lo : lo + 1024] @ u.T >= threshold)
                        links = pd.DataFrame({"rep": rep[lo + i], "of": of[j]})[rep[lo + i] != q[j]]
                        yield links.groupby(["rep", "of"]).size().reset_index(name="n")

        links = reps.select("rep", "label", "dim", "v").mapInPandas(run, "rep long, of long, n long")
        return tuple(links.join(comp.toDF("rep", "comp"), "rep", "left").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.coalesce("comp", "rep") != F.col("of"), F.col("n"))), F.lit(0))).first())

    edge_tables = []

    def one_round(first_pass: int, last_pass: int, window: int) -> None:
        """Adds the edges of the passes."""
        for first in range(first_pass, last_pass, passes_at_once):
            edge_tables.append(edges_of(list(range(first, min(first + passes_at_once, last_pass))), window))

    def edges_of(group: list[int], window: int) -> DataFrame:
        def hashed(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                for dim, part in pdf.groupby("dim"):
                    u = unit(part["v"])
                    has = part["c"].notna().to_numpy()
                    if has.any():
                        u[has] -= np.stack(part["c"][has])
                    for g in group:
                        bits = (u @ projections(int(dim), g, seed)) > 0
                        key = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        yield pd.DataFrame({"pass": np.int32(g), "label": part["label"].to_numpy(), "dim": np.int32(dim), "key": key, "rep": part["rep"].to_numpy(), "v": part["v"].to_numpy()})

        rows = placed.mapInPandas(hashed, f"pass int, label {label_type}, dim int, key long, rep long, v array<double>")
        order = ["pass", "label", "dim", "key", "rep"]
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
        ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

        def windows(batches):
            part = TaskContext.get().partitionId()
            held, start, last = None, None, None
            out_a, out_b = [], []
            for pdf in batches:
                if not len(pdf):
                    continue
                if start is None:
                    start = pdf.head(window)
                elif len(start) < window:
                    start = pd.concat([start, pdf.head(window - len(start))])
                pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
                fresh = 0 if held is None else len(held)
                for _, run in pdf.groupby(["pass", "label", "dim"], sort=False):
                    at = int((run.index < fresh).sum())
                    a, b = window_pairs(run["rep"].to_numpy(), unit(run["v"]), window, threshold, at)
                    out_a += a
                    out_b += b
                held = pdf.tail(window)
                if sum(map(len, out_a)) > 50_000:
                    yield pairs(out_a, out_b)
                    out_a, out_b = [], []
            if out_a:
                yield pairs(out_a, out_b)
            if held is not None:
                # The ends: a range's last rows meet the first rows of the ranges after it.
                yield ends(start, part, 1)
                yield ends(held, part, 0)

        def pairs(a, b):
            a, b = forest(np.concatenate(a), np.concatenate(b))
            return pd.DataFrame({"a": a, "b": b, "part": None, "side": None, "at": None, "pass": None, "label": None, "dim": None, "key": None, "v": None})

        def ends(rows_, part, side):
            return pd.DataFrame({"a": rows_["rep"], "b": None, "part": part, "side": side, "at": np.arange(len(rows_)), "pass": rows_["pass"], "label": rows_["label"], "dim": rows_["dim"], "key": rows_["key"], "v": rows_["v"]})

        found = ws.save(ordered.mapInPandas(windows, f"a long, b long, part int, side int, at int, pass int, label {label_type}, dim int, key long, v array<double>"))

        def across(pdf):
            pdf = pdf.sort_values(["pass", "label", "dim", "key", "a"], kind="stable")
            out_a, out_b = [], []
            for _, run in pdf.groupby(["pass", "label", "dim"], sort=False):
                a, b = window_pairs(run["a"].to_numpy(), unit(run["v"]), window, threshold)
                out_a += a
                out_b += b
            none = [np.zeros(0, dtype=np.int64)]
            a, b = forest(np.concatenate(out_a or none), np.concatenate(out_b or none))
            return pd.DataFrame({"a": a, "b": b})

        # A range's end meets the next ``window`` rows, of as many ranges as these span: 2 x window rows at most.
        size = {r["part"]: r["n"] for r in found.where("side = 0").groupBy("part").agg(F.count("*").alias("n")).collect()}
        spans, filled = [], sorted(size)
        for i, cut in enumerate(filled):
            before = 0
            for part in filled[i + 1 :]:
                if before >= window:
                    break
                spans.append((part, cut, before))
                before += size[part]
        tails = found.where("side = 0").withColumn("cut", F.col("part"))
        heads = found.where("side = 1").join(F.broadcast(spark.createDataFrame(spans, "part int, cut int, before int")), "part").where(F.col("before") + F.col("at") < window)
        crossing = tails.unionByName(heads.drop("before")).groupBy("cut").applyInPandas(across, "a long, b long")
        edges = ws.save(found.where("part IS NULL").select("a", "b").union(crossing).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ws.drop(found)
        return edges

    def united() -> DataFrame:
        return components(ws, reduce(DataFrame.union, edge_tables).distinct())

    one_round(0, passes, window)
    comp = united()
    turn, width = 0, window
    while measured:
        asked = reps.withColumn("o", F.xxhash64("rep", F.lit(turn))).orderBy("o").limit(queries)
        total, missed = recall_of(asked, comp)
        if missed <= (1 - recall) * total or width >= n_reps:
            break
        turn, width = turn + 1, 2 * width
        one_round(passes, passes + passes_at_once, width)
        passes += passes_at_once
        comp = united()
    # Direct links inside components, tile against tile.
    inside = reps.join(comp, reps["rep"] == comp["id"]).select("comp", "rep", "copies", "v", "least")
    sizes = inside.groupBy("comp").agg(F.count("*").alias("m"), F.min("least").alias("component_id"))
    sizes = ws.save(sizes.withColumn("tiles", F.ceil(F.col("m") / tile).cast("int")))
    tiled = inside.join(sizes.select("comp", "tiles"), "comp").withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

    def count(pdf):
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        x, y = pdf[pdf["t"] == lo], pdf[pdf["t"] == hi]
        if not len(x) or not len(y):
            return pd.DataFrame({"rep": np.zeros(0, dtype=np.int64), "links": np.zeros(0, dtype=np.int64)})
        near = unit(x["v"]) @ unit(y["v"]).T >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"rep": x["rep"].to_numpy(), "links": near @ y["copies"].to_numpy()})
        return pd.DataFrame({"rep": np.r_[x["rep"].to_numpy(), y["rep"].to_numpy()], "links": np.r_[near @ y["copies"].to_numpy(), near.T @ x["copies"].to_numpy()]})

    counted = tiled.select("comp", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), "t", "rep", "copies", "v").groupBy("comp", "lo", "hi").applyInPandas(count, "rep long, links long")
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    of_comp = comp.join(sizes.select("comp", "component_id"), "comp").select(F.col("id").alias("rep"), "component_id")
    of_rep = ws.save(reps.select("h1", "h2", "rep", "copies", "least").join(of_comp, "rep", "left").join(links, "rep", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    linked = members.join(of_rep, ["h1", "h2"]).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = d.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
