"""N-gram Jaccard self-join by vertical partitioning, with components of the links.

Every text becomes the set of its word n-grams, as 63-bit hashes; the global
n-gram order is by hash, rare n-grams before frequent ones. Texts of equal sets
(by size and two further hashes, 126 bits, of the set) are one class. Then:

1. Candidates by prefix. A pair of enough overlap shares an n-gram among the
   first ones of either set, so the lists of classes by such an n-gram hold every
   pair. N-grams that ``heavy`` or more prefixes share go last in the order, so
   lists stay short and candidates grow in proportion to the input.
2. Partial overlaps. The order is cut into fragments. The first fragment of each
   set is at hand from step 1: its overlap, and the sizes of what is left, bound
   the whole overlap from above and drop most candidates. The remaining
   fragments' overlaps are counted apart and summed for each pair.
3. Crowded classes: those whose prefix is mostly heavy n-grams (members of large
   groups of near copies). They get an order of their own, by how many crowded
   classes share an n-gram; against the others they are joined by the light
   n-grams of their whole sets. Classes that even so consist of heavy n-grams
   compare with the hub of each list first; then only classes that are still in
   other components meet, and only if their light n-grams are so few that the
   pair can link without sharing one.

No step drops, caps or samples: each filter is a bound that a linked pair meets.
Work tables are deleted as soon as nothing reads them.

Defined cases: null text and text without words have an empty set and are alone
in their component; fewer words than n make one n-gram of them all; equal texts
and repeated rows are one class; ids may repeat or be null (a null id is never
the least); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, Workspace, components, join_small, keyed

FRAGMENTS = 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    raw = [(t or "").encode().translate(FOLD) for t in texts]
    a = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    out = [np.zeros(0, dtype=np.int64)] * len(raw)
    word = ~_BLANK[a]
    if not word.any():
        return out
    with np.errstate(over="ignore"):
        start = np.flatnonzero(word & np.r_[True, ~word[:-1]])
        index = np.cumsum(np.r_[word[:1], word[1:] & ~word[:-1]]) - 1
        at = np.flatnonzero(word)
        place = at - start[index[at]]
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), _P)], dtype=np.uint64)
        terms = _BYTE[a[at]] * power[place]
        w = _mix(np.add.reduceat(terms, np.flatnonzero(place == 0)) + np.uint64(1))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        n = len(w)
        g = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            g = _mix(g * _P + w[j : n - k + 1 + j] + np.uint64(j)) if len(g) else g
        g = (g >> np.uint64(1)).astype(np.int64)
        for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if hi - lo >= k:
                out[i] = np.unique(g[lo : hi - k + 1])
            elif hi > lo:
                h = np.uint64(hi - lo)
                for x in w[lo:hi]:
                    h = _mix(np.array([h * _M1 + x + np.uint64(77)], dtype=np.uint64))[0]
                out[i] = np.array([h >> np.uint64(1)], dtype=np.int64)
    return out


def _pieces(batches, chars: int = 1_000_000):
    """(ids, texts) of about so many characters."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < chars:
                size += len(texts[hi] or "")
                hi += 1
            yield ids.slice(lo, hi - lo), texts[lo:hi]
            lo = hi


def _class_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    with np.errstate(over="ignore"):
        u = s.astype(np.uint64)
        sums = np.array([_mix(u * _P + np.uint64(3)).sum(), _mix((u ^ _M2) * _M1 + np.uint64(11)).sum()], dtype=np.uint64)
        return tuple((_mix(sums + np.uint64(len(s))) >> np.uint64(1)).tolist())


class Rule:
    """Integer bounds for similarity >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n):
        return n - -(-n * self.num // self.den) + 1

    def prefix_col(self, n: Column) -> Column:
        return n - F.ceil(n * F.lit(self.num) / F.lit(self.den)) + 1

    def overlap_col(self, n: Column, m: Column) -> Column:
        return F.ceil((n + m) * F.lit(self.num) / F.lit(self.num + self.den))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return (n * self.den >= m * self.num) & (m * self.den >= n * self.num)

    def kept(self, n: int) -> int:
        """How many of a set's first hashes travel: half as many again as the prefix."""
        p = self.prefix(n)
        return min(n, p + p // 2 + 8)


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, heavy: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each input row."""
    spark = docs.sparkSession
    ws, rule = Workspace(spark, "ngrams"), Rule(num, den)
    d = keyed(docs, id_col, text_col).toDF("doc_id", "text")

    def signatures(batches):
        # The table is written before anything reads it, so a task that runs anew may number its rows anew.
        row = TaskContext.get().partitionId() << 33
        for ids, texts in _pieces(batches):
            sets = shingle_sets(texts, k)
            first = [s[: rule.kept(len(s))] if len(s) else s for s in sets]
            keys = [_class_id(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(sets)), type=pa.int64()), ids, pa.array([len(s) for s in sets], type=pa.int64()), *(pa.array([x[i] for x in keys], type=pa.int64()) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32)), pa.array(np.concatenate(first)))],
                names=["row", "doc_id", "n", "k1", "k2", "first"],
            )
            row += len(sets)

    # Classes: c is the number of one of their rows, which stands for them.
    sig = ws.save(d.mapInArrow(signatures, "row long, doc_id long, n long, k1 long, k2 long, first array<long>"))
    classes = ws.save(sig.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("row").alias("c"), F.min("doc_id").alias("least")))
    n_classes = classes.count()
    reps = ws.save(join_small(sig.withColumnRenamed("row", "c"), classes.select("c"), "c", "left_semi", n_classes).select("c", "n", "first"))
    members = ws.save(sig.select("doc_id", "n", "k1", "k2").join(classes.select("n", "k1", "k2", "c"), ["n", "k1", "k2"], "left").select("doc_id", "n", "c"))
    ws.drop(sig)

    # Postings that another class shares, each with the number of heavy n-grams up to it.
    postings = reps.select("c", "n", F.posexplode("first").alias("pos", "s"))
    shared = ws.save(postings.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    is_heavy = F.col("df") >= heavy
    up = Window.partitionBy("c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    matched = ws.save(join_small(postings, shared, "s", "inner", shared.count()).withColumn("heavies", F.sum(is_heavy.cast("int")).over(up)))
    p = rule.prefix_col(F.col("n"))
    n_kept = F.least(F.col("n"), p + F.floor(p / 2) + 8)
    crowded = ws.save(matched.groupBy("c").agg(F.max("n").alias("n"), F.max("heavies").alias("h")).where((F.col("h") > 0) & (n_kept - F.col("h") < p)).select("c"))
    n_crowded = crowded.count()
    light = ws.save(join_small(matched.where(~is_heavy & (F.col("pos") + 1 - F.col("heavies") <= p)).select("s", "c", "n"), crowded, "c", "left_anti", n_crowded))
    ws.drop(matched)

    def pair(x: str, y: str, nx: str, ny: str) -> list[Column]:
        swap = F.col(x) > F.col(y)
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(swap, F.col(ny)).otherwise(F.col(nx)).alias("na"), F.when(swap, F.col(nx)).otherwise(F.col(ny)).alias("nb")]

    def candidates(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
        """Pairs (a, b, na, nb), a < b, of rows (s, c, n) that share s."""
        x, y = left.select("s", F.col("c").alias("x"), F.col("n").alias("nx")), right.select("s", F.col("c").alias("y"), F.col("n").alias("ny"))
        j = x.join(y, (x["s"] == y["s"]) & ((F.col("x") < F.col("y")) if same else (F.col("x") != F.col("y"))) & rule.sizes_fit(F.col("nx"), F.col("ny")))
        return j.select(*pair("x", "y", "nx", "ny")).distinct()

    def bounded(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs that the first fragment's overlap leaves possible.

        Its n-grams travel as their upper 31 bits, in the same order. Those of one
        set that fall together are counted as common, so the bound stays one.
        """
        need = ws.save(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct())
        r = join_small(reps, need, "c", "left_semi", need.count()).select("c", F.transform("first", lambda x: F.shiftright(x, 32).cast("int")).alias("f"))
        r = r.select("c", "f", (F.size("f") - F.size(F.array_distinct("f"))).alias("twice"))
        j = pairs.join(r.toDF("a", "fa", "ta"), "a").join(r.toDF("b", "fb", "tb"), "b")
        end = F.least(F.element_at("fa", -1), F.element_at("fb", -1))
        common = F.size(F.array_intersect("fa", "fb")) + F.least("ta", "tb")
        rest = F.least(F.col("na") - F.size(F.filter("fa", lambda x: x < end)), F.col("nb") - F.size(F.filter("fb", lambda x: x < end)))
        out = ws.save(j.where(common + rest >= rule.overlap_col(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb"))
        ws.drop(need)
        return out

    def full(cs: DataFrame, n_cs: int) -> DataFrame:
        """Whole sets of classes: rows (c, n, frag, part)."""

        def cut(batches):
            for _, texts in _pieces(batches):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                rows = [(len(s), *key, f, part) for s in sets for key in [_class_id(s)] for f, part in enumerate(np.split(s, np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.int64) << 60))) if len(part)]
                parts = [r[4] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[i] for r in rows], type=t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int32()))), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))],
                    names=["n", "k1", "k2", "frag", "part"],
                )

        want = ws.save(join_small(classes, cs, "c", "left_semi", n_cs))
        texts = join_small(d, want.where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi", n_cs).unionByName(d.where("doc_id IS NULL"))
        rows = texts.mapInArrow(cut, "n long, k1 long, k2 long, frag int, part array<long>")
        out = ws.save(join_small(rows, want.select("n", "k1", "k2", "c"), ["n", "k1", "k2"], "inner", n_cs).select("c", "n", "frag", "part").dropDuplicates(["c", "frag"]))
        ws.drop(want)
        return out

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose fragments' overlaps sum to enough."""
        x, y = sets.select(F.col("c").alias("a"), "frag", F.col("part").alias("pa")), sets.select(F.col("c").alias("b"), "frag", F.col("part").alias("pb"))
        j = pairs.join(x, "a").join(y, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("m"))
        total = j.groupBy("a", "b", "na", "nb").agg(F.sum("m").alias("m"))
        return total.where(F.col("m") * den >= (F.col("na") + F.col("nb") - F.col("m")) * num).select("a", "b")

    found = [candidates(light, light, True)]
    used, lists = [light], None
    if n_crowded:
        own = full(crowded, n_crowded)
        order = Window.partitionBy("c").orderBy("s")
        grams = own.select("c", "n", F.explode("part").alias("s"))
        # Against the others: the first light n-grams of the whole set, in the order of step 1.
        heavy_s = ws.save(shared.where(is_heavy).select("s"))
        first_light = ws.save(join_small(grams, heavy_s, "s", "left_anti", heavy_s.count()).withColumn("r", F.row_number().over(order)).where(F.col("r") <= p).select("s", "c", "n"))
        wanted = ws.save(first_light.select("s").distinct())
        met = join_small(postings.select("s", "c", "n"), wanted, "s", "left_semi", wanted.count())
        found.append(candidates(first_light, join_small(met, crowded, "c", "left_anti", n_crowded), False))
        # Among themselves: their own order.
        own_df = ws.save(grams.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
        met = join_small(grams.withColumn("pos", F.row_number().over(order)), own_df, "s", "inner", own_df.count()).withColumn("heavies", F.sum(is_heavy.cast("int")).over(up))
        met = ws.save(met.withColumn("lights", F.col("n") - F.sum(is_heavy.cast("int")).over(Window.partitionBy("c"))))
        own_light = met.where(~is_heavy & (F.col("pos") - F.col("heavies") <= p)).select("s", "c", "n")
        found.append(candidates(own_light, own_light, True))
        lists = ws.save(met.where(is_heavy & (F.col("heavies") <= p - F.col("lights"))).select("s", "c", "n", "lights", "heavies"))
        hubs = ws.save(lists.groupBy("s").agg(F.min_by(F.struct("c", "n"), F.struct("lights", "c")).alias("hub")).select("s", F.col("hub.c").alias("c"), F.col("hub.n").alias("n")))
        found.append(candidates(lists, hubs, False))
        used += [heavy_s, first_light, wanted, own_df, met]
    met_pairs = ws.save(reduce(DataFrame.union, found).distinct())
    ws.drop(shared, *used)
    possible = bounded(met_pairs)
    need = possible.select(F.col("a").alias("c")).union(possible.select("b")).distinct()
    need = ws.save(join_small(need, crowded, "c", "left_anti", n_crowded))
    sets = full(need, need.count())
    links = ws.save(linked(possible, sets.union(own) if n_crowded else sets))
    ws.drop(met_pairs, possible, need, sets)
    comp = components(ws, links)
    if n_crowded:
        labelled = ws.save(lists.join(comp.select(F.col("id").alias("c"), "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c")))
        hub_comp = labelled.join(hubs.select("s", F.col("c").alias("hub")), "s").where("c = hub").select("s", F.col("comp").alias("hub_comp"))
        reach = F.col("lights") + F.col("heavies")
        stray = labelled.join(hub_comp, "s").where("comp <> hub_comp").select("s", F.col("c").alias("x"), F.col("n").alias("nx"), reach.alias("px"), F.col("comp").alias("cx"))
        rest = labelled.select("s", F.col("c").alias("y"), F.col("n").alias("ny"), reach.alias("py"), F.col("comp").alias("cy"))
        # Pairs that share a light n-gram are candidates already. In the others the first common n-gram is
        # a heavy one, after all light ones of either set, and not later than the sizes of the pair allow.
        most = rule.overlap_col(F.col("nx"), F.col("ny"))
        fit = rule.sizes_fit(F.col("nx"), F.col("ny")) & (F.col("px") <= F.col("nx") - most + 1) & (F.col("py") <= F.col("ny") - most + 1)
        more = ws.save(stray.join(rest, "s").where((F.col("cx") != F.col("cy")) & fit).select(*pair("x", "y", "nx", "ny")).distinct())
        ws.drop(labelled, lists, hubs)
        if more.limit(1).count():
            links = ws.save(links.union(linked(bounded(more), own)))
            comp = components(ws, links)
        ws.drop(more, own)
    ws.drop(reps)
    least = comp.join(classes.select(F.col("c").alias("id"), "least"), "id").groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = ws.save(classes.join(comp.join(least, "comp").select(F.col("id").alias("c"), "component_id"), "c", "left").select("c", F.coalesce("component_id", "least").alias("component_id")))
    return members.join(of_class, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
