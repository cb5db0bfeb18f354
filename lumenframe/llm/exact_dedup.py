"""Exact dedup over an extendible-hash index on shared files (DataFrame functions only).

The index holds one entry for each distinct key hash, in buckets. A bucket is a
range of hashes: those that begin with the same bits, as many as its local depth.
The directory has one cell for each value of the first ``depth`` bits. While a
cell holds more than ``capacity`` keys the directory doubles, up to all 64 bits;
a bucket is the largest range of cells that holds no more (a range over capacity
is split, its halves have one more bit). Directory and buckets are tables in the
shared folder; only the number of keys and that of the fullest cell come to the
driver.

Every row finds its bucket through the directory. Buckets are dealt to owner
tasks. An owner sorts the chains of its key ranges by hash and then by the texts'
bytes, so texts that only collide stay apart, and elects the largest id of each
text. Chains of one row need no comparison. Copies are first aggregated in the
tasks that read them and then in 16 salted parts, so an owner gets at most 16
rows of a text, however many copies it has.

Defined cases: null text counts as empty; ids may repeat or be null (each input
row gives one output row; rows that share the kept id are all ``kept``); an empty
table gives an empty result; columns named in ``extra`` stay with their row, others are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fold_ascii, join_small, keyed

SALTS = 16


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth)


def build_directory(ws: Workspace, keys: DataFrame, n_keys: int, capacity: int) -> tuple[DataFrame, int, int]:
    """(cell, bucket, local_depth), the depth (of cells, in bits) and the number of cells in use; keys has distinct hashes h.

    The directory starts at the depth that even buckets of this capacity need, less two bits.
    """
    start = max(1, int(math.log2(max(n_keys, 1) / capacity)) - 2 if n_keys > capacity else 1)
    depth, cells = start, None
    while True:
        if cells is not None:
            ws.drop(cells)
        cells = ws.save(keys.groupBy(_cell(depth).alias("cell")).agg(F.count("*").alias("n")))
        used, fullest = cells.agg(F.count("*"), F.max("n")).first()
        if (fullest or 0) <= capacity or depth == 64:
            break
        depth += 1
    local = F.lit(depth)
    sums = cells
    for bits in range(depth - 1, start - 1, -1):  # the shortest prefix whose keys fit in one bucket
        prefix = F.shiftrightunsigned("cell", depth - bits)
        sums = sums.withColumn(f"n{bits}", F.sum("n").over(Window.partitionBy(prefix)))
        local = F.when(F.col(f"n{bits}") <= capacity, F.lit(bits)).otherwise(local)
    first = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")  # the bucket's first cell names it
    return ws.save(sums.select("cell", local.alias("local_depth")).withColumn("bucket", first)), depth, used


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000, extra: list[str] | None = None) -> DataFrame:
    """id, the columns of ``extra``, keep_id (largest id among equal texts), group_size, kept, text_sha256 and the index bucket."""
    ws = Workspace(docs.sparkSession, "exact")
    extra = extra or []
    d = keyed(docs, id_col, text_col, *extra).toDF("doc_id", "text", *extra)
    norm = fold_ascii(F.coalesce("text", F.lit("")))
    rows = ws.save(d.select("doc_id", norm.alias("norm"), *extra).select("doc_id", *extra, F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    keys = ws.save(rows.groupBy("h").agg(F.count("*").alias("n")))
    n_keys = keys.count()
    directory, depth, n_cells = build_directory(ws, keys, n_keys, capacity)
    # The index: buckets of entries, each bucket in the file of its owner, in order of the hash.
    index = ws.save(join_small(keys.withColumn("cell", _cell(depth)), directory, "cell", "inner", n_cells).select("bucket", "h", "n").repartition("bucket").sortWithinPartitions("bucket", "h"))
    shared = ws.save(index.where("n > 1").select("bucket", "h"))
    n_shared = shared.count()
    ws.drop(keys)
    texts = join_small(d.select("doc_id", norm.alias("norm")).withColumn("h", F.xxhash64("norm")), shared, "h", "inner", n_shared)
    salted = texts.groupBy("bucket", "h", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    owned = salted.repartition("bucket").groupBy("bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chains = ws.save(owned.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    routed = join_small(rows.withColumn("cell", _cell(depth)), directory, "cell", "inner", n_cells)
    return routed.join(chains, ["bucket", "h", "sha"], "left").select(
        "doc_id",
        *extra,
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
    )
