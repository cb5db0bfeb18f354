"""LM scoring by context-tree weighting, beside a unigram word model.

Byte model: a byte is eight binary decisions; each decision has a context tree
over the preceding 0 to ``depth`` bytes. A node estimates by Krichevsky-Trofimov
counts, and a node's probability of its training bits is half its own estimate
and half the product of its children's. The same weights, descending from the
root to the text's context, mix the estimates of all depths into the probability
of a decision. The tree grows with the corpus: it has a node for every context
that occurs in any document (contexts of held-out documents count zero there,
which leaves all weights as they are).

A gram is a byte and its context in one long, latest context byte first. Texts
are read once; each task gathers blocks of texts with the block's distinct grams
and words and cuts both into ranges by hash, a gram by its latest depth - 2 bytes.
Ranges stream the chunks of all blocks, so a range holds its distinct grams and
words, never the chunks together. The tree is then climbed two levels at a time:
nodes that share all but the last two bytes of their context meet in one task,
at most 2 ** 24 nodes whatever the corpus. Weights come down the same way, ranges
turn them into the log probability of each gram, and send each block the values of
its own grams and words, without these: the block finds them in its texts again, in
the order in which it dealt them, and scores the texts.

Defined cases: null text counts as empty: one end token, byte score 0; training
documents may be none (all counts are 0, each byte costs 8 bits); ids may repeat
or be null; an empty table gives no rows; further columns are ignored. Words count
as equal by 63 bits of a hash; grams are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, release

#: The end token; no word holds a space.
END = b" "
DEPTH = 6
BLOCK_CHARS = 16_000_000
#: Bytes of text that are turned into grams at a time.
PIECE = 2_000_000
RANGES = 65536
LN2 = math.log(2)


# numbers --------------------------------------------------------------------------
_LG = np.array([math.lgamma(k + 0.5) for k in range(64)])
_LF = np.array([math.lgamma(k + 1.0) for k in range(64)])


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2)."""
    x = np.maximum(n, 32) + 0.5
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, _LG[np.minimum(n, 63).astype(int)], big)


def _lfact(n: np.ndarray) -> np.ndarray:
    """log n!"""
    x = np.maximum(n, 32) + 1.0
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, _LF[np.minimum(n, 63).astype(int)], big)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma_half(a) + _lgamma_half(b) - math.log(math.pi) - _lfact(a + b)


_KT = _log_kt(*np.meshgrid(np.arange(64.0), np.arange(64.0), indexing="ij"))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    out = _KT[np.minimum(a, 63).astype(np.int64), np.minimum(b, 63).astype(np.int64)]
    big = np.flatnonzero((a > 63) | (b > 63))
    out[big] = _log_kt(a[big], b[big])
    return out


def pack(a: np.ndarray) -> bytes:
    """Numbers of one type as bytes, planes of equal significance together; ascending ones as differences."""
    if a.dtype == np.int64 and len(a) and (np.diff(a) >= 0).all():
        return b"d" + zstandard.compress(np.diff(a, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
    return b"p" + zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, dtype=np.int64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(np.frombuffer(zstandard.decompress(b[1:]), dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(a) if b[:1] == b"d" else a


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    k, n = np.concatenate([np.zeros(0, dtype=np.int64), *keys]), np.concatenate([np.zeros(0, dtype=np.int64), *counts])
    if not len(k):
        return k, n
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n, first)


# the tree -------------------------------------------------------------------------
def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """The gram of every byte of the texts, in order; each text begins after zero bytes."""
    pad = b"\0" * depth
    raw = b"".join([pad, pad.join(texts), b"\0" * (7 - depth)])
    window = np.ndarray((len(raw) - 7,), dtype="<i8", buffer=raw, strides=(1,))  # the context and the byte after it, in one read
    code = (window & (1 << 8 * depth) - 1) << 8 | window >> 8 * depth & 255
    ends = np.cumsum([len(t) + depth for t in texts])[:-1]
    keep = np.ones(len(code), dtype=bool)
    keep[(ends[:, None] - depth + np.arange(depth)).ravel()] = False  # the padding itself is not predicted
    return code[keep]


def leaves(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(node, zeros, ones) of the deepest contexts of ascending grams, and for each decision the node of each gram.

    A node is its context and, in the last byte, the bits decided before after a leading one.
    """
    keys, zeros, ones, at, done = [], [], [], [], 0
    for j in range(8):
        key, bit = g >> 8 << 8 | 1 << j | (g & 255) >> (8 - j), g >> (7 - j) & 1
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = np.flatnonzero(new)
        keys.append(key[first])
        zeros.append(np.add.reduceat(n * (1 - bit), first) if len(first) else n)
        ones.append(np.add.reduceat(n * bit, first) if len(first) else n)
        at.append(np.cumsum(new) - 1 + done)
        done += len(first)
    return np.concatenate(keys), np.concatenate(zeros).astype(float), np.concatenate(ones).astype(float), at


def climb(key: np.ndarray, z: np.ndarray, o: np.ndarray, weight: np.ndarray):
    """The nodes of the contexts one byte shorter: node, zeros, ones, log weighted probability, the share of their own estimate, and the place of each child's."""
    up, inv = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
    m = len(up)
    zu, ou = np.bincount(inv, z, m), np.bincount(inv, o, m)
    e = log_kt(zu, ou)
    w = np.logaddexp(e, np.bincount(inv, weight, m)) - LN2
    return up, zu, ou, w, np.exp(e - LN2 - w), inv


def mixed(acc: np.ndarray, rest: np.ndarray, z: np.ndarray, o: np.ndarray, stop) -> tuple[np.ndarray, np.ndarray]:
    """Adds a level: the probability of a one mixed so far, and the share left to deeper contexts."""
    return acc + rest * stop * (o + 0.5) / (z + o + 1), rest * (1 - stop)


def two_down(key, z, o, weight, top, acc, rest, leaf: bool):
    """acc and rest of nodes, from those (ascending) of the contexts two bytes shorter."""
    up, zu, ou, wu, stop, inv = climb(key, z, o, weight)
    at = np.searchsorted(top, up >> 16 << 8 | up & 255)
    a, r = mixed(acc[at], rest[at], zu, ou, stop)
    return mixed(a[inv], r[inv], z, o, 1.0 if leaf else np.exp(log_kt(z, o) - LN2 - weight))


def gram_logs(g: np.ndarray, n: np.ndarray, top: np.ndarray, acc: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 probability of each gram."""
    key, z, o, at = leaves(g, n)
    p, _ = two_down(key, z, o, log_kt(z, o), top, acc, rest, True)
    one, zero = np.log10(p), np.log10(1 - p)
    return sum((np.where(g >> (7 - j) & 1, one[i], zero[i]) for j, i in enumerate(at)), np.zeros(len(g)))


def whole_groups(batches: Iterator[pa.RecordBatch], size: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in pieces that cut no run of equal values of it."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows >= size:
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = np.searchsorted(cols[0], cols[0][-1])
            if cut:
                yield [c[:cut] for c in cols]
            held, rows = [[c[cut:] for c in cols]], rows - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


NODES = "key long, z double, o double, w double"


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batch(schema: str, *cols) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c).cast(_TYPES[t]) for c, t in zip(cols, types)], names=list(names))


def climb_two(nodes: DataFrame) -> DataFrame:
    """The nodes of the contexts two bytes shorter."""

    def run(batches):
        for _, key, z, o, w in whole_groups(batches):
            for _ in range(2):
                key, z, o, w, *_ = climb(key, z, o, w)
            yield _batch(NODES, key, z, o, w)

    return nodes.select(F.shiftright("key", 24).alias("grp"), "key", "z", "o", "w").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, NODES)


MIXED = "key long, acc double, rest double"


def descend_two(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """acc and rest of nodes, from those of the contexts two bytes shorter."""

    def run(batches):
        for _, top, key, a, b, w in whole_groups(batches):
            t = np.flatnonzero(top)
            t = t[np.argsort(key[t])]
            c = ~top.astype(bool)
            yield _batch(MIXED, key[c], *two_down(key[c], a[c], b[c], w[c], key[t], a[t], b[t], False))

    both = nodes.select(F.shiftright("key", 24).alias("grp"), F.lit(False).alias("top"), "key", F.col("z").alias("a"), F.col("o").alias("b"), "w")
    both = both.union(above.select(F.shiftright("key", 8), F.lit(True), "key", "acc", "rest", F.lit(0.0)))
    return both.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, MIXED)


def at_root(nodes: DataFrame) -> DataFrame:
    """acc and rest of the root's nodes: at most 255 rows."""

    def run(batches):
        for _, key, z, o, w in whole_groups(batches):
            yield _batch(MIXED, key, *mixed(np.zeros(len(key)), np.ones(len(key)), z, o, np.exp(log_kt(z, o) - LN2 - w)))

    return nodes.select(F.lit(0).alias("grp"), "key", "z", "o", "w").mapInArrow(run, MIXED)


class Places:
    """Finds numbers among distinct ones: a table of places by hash; numbers that others displace are in a further table."""

    def __init__(self, keys: np.ndarray, factor: int = 0x9E3779B97F4A7C15):
        self.keys, self.factor, self.bits = keys, np.uint64(factor), max(4, (4 * len(keys)).bit_length())
        own, slot = np.arange(len(keys), dtype=np.int32), self.slots(keys)
        self.table = np.zeros(1 << self.bits, dtype=np.int32)
        self.table[slot] = own
        self.displaced = np.flatnonzero(self.table[slot] != own).astype(np.int32)
        self.further = Places(keys[self.displaced], factor * factor % 2**64 | 1) if len(self.displaced) else None

    def slots(self, x: np.ndarray) -> np.ndarray:
        h = x.view(np.uint64) * self.factor
        return ((h ^ h >> np.uint64(32)) * self.factor >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, all of which are among the keys."""
        at = self.table[self.slots(x)]
        if self.further:
            others = np.flatnonzero(self.keys[at] != x)
            at[others] = self.displaced[self.further.find(x[others])]
        return at


# texts ----------------------------------------------------------------------------
def _word_hash(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) >> 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the place of each token of the texts among them, and the number of tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, type=pa.string())))
    starts, found = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    distinct, at = found.dictionary.to_pylist(), found.indices.to_numpy()
    # Splitting leaves empty strings at the ends of a text: the first one becomes the end token, the others go.
    count = np.diff(starts)
    whole = np.zeros(len(at) + len(texts), dtype=np.int64)
    last = starts[1:] + np.arange(len(texts))
    is_last = np.zeros(len(whole), dtype=bool)
    is_last[last] = True
    whole[~is_last], whole[last] = at, len(distinct)
    if "" in distinct:
        keep = whole != distinct.index("")
        owner = np.repeat(np.arange(len(texts)), count + 1)
        whole, count = whole[keep], np.bincount(owner[keep], minlength=len(texts)) - 1
    hashes = np.fromiter((_word_hash(w.encode()) for w in distinct), dtype=np.int64, count=len(distinct))
    return np.append(hashes, _word_hash(END)), whole, count + 1


def range_of(ctx: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each context of depth - 2 bytes."""
    return ((ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(ranges)).astype(np.int64)


def deal(g: np.ndarray, w: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of ascending grams and words, and the orders by range; within a range they still ascend."""
    gr, wr = range_of(g >> 24, ranges), w % ranges
    return gr, wr, np.argsort(gr, kind="stable"), np.argsort(wr, kind="stable")


def distinct_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts in order, and how often each occurs; sorted in place, the only long array."""
    g, done = np.empty(sum(map(len, texts)), dtype=np.int64), 0
    for piece in pieces(texts):
        some = grams(piece, depth)
        g[done : done + len(some)] = some
        done += len(some)
    g.sort()
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    return g[first], np.diff(np.append(first, len(g)))


def grams_of(texts: list[bytes], depth: int) -> np.ndarray:
    """Distinct grams of the texts in order; holds only the distinct ones of each piece."""

    def once(g: np.ndarray) -> np.ndarray:
        g.sort()
        return g[np.r_[True, g[1:] != g[:-1]][: len(g)]]

    return once(np.concatenate([np.zeros(0, dtype=np.int64), *(once(grams(piece, depth)) for piece in pieces(texts))]))


def rows_blob(table: pa.Table) -> bytes:
    """Rows as one compressed Arrow stream: texts compress far better together than one by one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about PIECE bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def score(docs: DataFrame, in_training: Column, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, the columns of ``extra``, n_tokens, n_known, train_tokens, base_score, score, bytes; one row for each input row.

    in_training: the rows of docs to learn from, as a boolean Column; depth: the longest context in bytes, 2, 4 or 6.
    """
    if depth not in (2, 4, 6):
        raise ValueError("depth is 2, 4 or 6")
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    extra = extra or []
    names = [id_col, text_col, *extra]
    d = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(in_training, F.lit(False)).alias("_train")).toDF("doc_id", "_text", *extra, "_train")
    kept = [f for f in d.schema.fields if f.name not in ("_text", "_train")]
    size = d.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = int(min(RANGES, max(16, size // 8_000_000)))

    def gather(batches: Iterator[pa.RecordBatch]):
        part, done = TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        learn: list[bool] = []
        cols: list[pa.RecordBatch] = []
        filled = 0

        def flush():
            # The table is written before anything reads it, so a task that runs anew may number its blocks anew.
            block = part << 24 | done
            found, times, words, word_times = [], [], [], []
            for trained in (True, False):
                some = [t for t, g in zip(texts, learn) if g == trained]
                for piece in pieces(some):
                    own, at, _ = tokens(piece)
                    words.append(own)
                    word_times.append(np.bincount(at, minlength=len(own)) * trained)
                k, n = distinct_grams([t for t in some if t], depth)
                found.append(k)
                times.append(n * trained)
            (w, wn), (g, gn) = summed(words, word_times), summed(found, times)
            del found, times, words, word_times, some
            table = pa.Table.from_batches(cols).combine_chunks()
            table = table.append_column("_text", pa.array(texts, type=pa.binary()))
            for lo in range(0, len(texts), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int64()), pa.nulls(1, pa.int32()), pa.array([rows_blob(table.slice(lo, 4096))], type=pa.binary()), *[pa.nulls(1, pa.binary())] * 3], names=schema_names)
            gr, wr, go, wo = deal(g, w, ranges)
            g, gn, w, wn = g[go], gn[go], w[wo], wn[wo]
            gc, wc = np.searchsorted(gr[go], np.arange(ranges + 1)), np.searchsorted(wr[wo], np.arange(ranges + 1))
            for lo in range(0, ranges, 64):
                r = [k for k in range(lo, min(lo + 64, ranges)) if gc[k] < gc[k + 1] or wc[k] < wc[k + 1]]
                blobs = [pa.array([pack(x[c[k] : c[k + 1]]) for k in r], type=pa.binary()) for x, c in ((g, gc), (gn, gc), (w, wc), (wn, wc))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(r), type=pa.int64()), pa.array(r, type=pa.int32()), *blobs], names=schema_names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                names_ = b.schema.names
                raw = [(t or "").encode() for t in b.column(1).to_pylist()]
                texts += raw
                learn += b.column(len(names_) - 1).to_pylist()
                cols.append(pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in range(2, len(names_) - 1))], names=[names_[0], *names_[2:-1]]))
                filled += sum(map(len, raw))
                if filled >= block_chars or len(texts) >= 60_000:
                    yield from flush()
                    texts, learn, cols, filled, done = [], [], [], 0, done + 1
        if texts:
            yield from flush()
        texts, cols = [], []
        release()

    schema_names = ["block", "range", "a", "b", "c", "d"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    gathered = ws.save(d.mapInArrow(gather, "block long, range int, a binary, b binary, c binary, d binary"))
    chunks = gathered.where("range IS NOT NULL").select("range", "block", "a", "b", "c", "d")

    def add_up(batches: Iterator[pa.RecordBatch]):
        now, parts, held = None, ([], [], [], []), 0

        def merge():
            (parts[0][:], parts[1][:]), (parts[2][:], parts[3][:]) = ([[x] for x in summed(parts[i], parts[i + 1])] for i in (0, 2))

        def emit():
            merge()
            n = parts[3][0]
            return _batch(totals, [now], *([pack(p[0])] for p in parts), [int(n.sum())], [int((n > 0).sum())])

        for b in batches:
            for r, *blobs in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in range(2, 6))):
                if r != now:
                    if now is not None:
                        yield emit()
                    now, parts, held = r, ([], [], [], []), 0
                for p, x in zip(parts, blobs):
                    p.append(unpack(x))
                held += len(parts[0][-1]) + len(parts[2][-1])
                if held > 4_000_000 + 2 * len(parts[0][0]):
                    merge()
                    held = 0
        if now is not None:
            yield emit()
        release()

    totals = "range int, a binary, b binary, c binary, d binary, n long, v long"
    total = ws.save(chunks.repartition("range").sortWithinPartitions("range").mapInArrow(add_up, totals))
    n_train, v_train = total.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def upper(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, z, o, _ = leaves(unpack(g), unpack(n))
                w = log_kt(z, o)
                for _ in range(2):
                    key, z, o, w, *_ = climb(key, z, o, w)
                yield _batch(NODES, key, z, o, w)

    levels = [ws.save(total.select("a", "b").mapInArrow(upper, NODES))]
    while len(levels) < depth // 2:
        levels.append(ws.save(climb_two(levels[-1])))
    top = at_root(levels[-1])
    for nodes in reversed(levels[:-1]):
        top = descend_two(nodes, top)


    def with_range(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(range_of(key >> 8, ranges), type=pa.int32()), *b.columns], names=["range", "key", "acc", "rest"])

    def values(batches: Iterator[pa.RecordBatch]):
        above: list[list[np.ndarray]] = []
        g = logs = w = wn = None
        for b in batches:
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                run = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    above.append([run.column(i).to_numpy(zero_copy_only=False) for i in (7, 8, 9)])
                elif kind[lo] == 1:
                    g, gn, w, wn = (unpack(run.column(i)[0].as_py()) for i in (3, 4, 5, 6))
                    key, acc, rest = (np.concatenate(x) for x in zip(*above)) if above else (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
                    o = np.argsort(key)
                    logs = gram_logs(g, gn, key[o], acc[o], rest[o]).astype(np.float32)
                    above = []
                else:
                    for block, a, c in zip(run.column(2).to_pylist(), run.column(3).to_pylist(), run.column(5).to_pylist()):
                        lp, times = logs[np.searchsorted(g, unpack(a))], wn[np.searchsorted(w, unpack(c))]
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at[lo]], type=pa.int32()), *(pa.array([pack(x)], type=pa.binary()) for x in (lp, times))], names=["block", "range", "b", "d"])
        release()

    none = F.lit(None)
    stream = top.mapInArrow(with_range, "range int, " + MIXED).select("range", F.lit(0).alias("kind"), none.cast("long").alias("block"), *[none.cast("binary").alias(x) for x in "abcd"], "key", "acc", "rest")
    for k, t in enumerate((total.select("*", none.cast("long").alias("block")), chunks.select("range", "block", "a", none.cast("binary").alias("b"), "c", none.cast("binary").alias("d"))), 1):
        stream = stream.union(t.select("range", F.lit(k), "block", "a", "b", "c", "d", none.cast("long"), none.cast("double"), none.cast("double")))
    valued = stream.repartition("range").sortWithinPartitions("range", "kind").mapInArrow(values, "block long, range int, b binary, d binary")
    floor = math.log10(n_train + v_train + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in left.column("a").to_pylist())
        texts, left = left.column("_text").to_pylist(), left.drop_columns("_text")
        found = [(own, at.astype(np.int32), n) for own, at, n in map(tokens, pieces(texts))]
        g, w = grams_of([t for t in texts if t], depth), np.unique(np.concatenate([own for own, _, _ in found]))
        lp, c = np.empty(len(g), dtype=np.float32), np.empty(len(w), dtype=np.int64)
        right = right.sort_by("range")
        _, _, go, wo = deal(g, w, ranges)
        lp[go] = np.concatenate([unpack(x, np.float32) for x in right.column("b").to_pylist()])
        c[wo] = np.concatenate([unpack(x) for x in right.column("d").to_pylist()])
        del right, go, wo
        grams_at = Places(g)
        scores: list[np.ndarray] = []
        known: list[np.ndarray] = []
        base: list[np.ndarray] = []
        toks: list[np.ndarray] = []
        for piece, (own, at, n) in zip(pieces(texts), found):
            size = np.array([len(t) for t in piece])
            logs = np.concatenate([[0.0], np.cumsum(lp[grams_at.find(grams(piece, depth))], dtype=np.float64)]) if size.sum() else np.zeros(1)
            ends = np.cumsum(size)
            scores.append(logs[ends] - logs[ends - size])
            times, first = c[np.searchsorted(w, own)], np.cumsum(n) - n
            known.append(np.add.reduceat((times > 0).astype(np.int64)[at], first))
            base.append(np.add.reduceat(np.log10(times + 1.0)[at], first) - n * floor)
            toks.append(n)
        known, base, toks = (np.concatenate(x) for x in (known, base, toks))
        cols = {f.name: left.column(f.name) for f in kept}
        cols |= {"n_tokens": pa.array(toks, type=pa.int64()), "n_known": pa.array(known, type=pa.int64()), "train_tokens": pa.array(np.full(len(toks), n_train)), "base_score": pa.array(base, type=pa.float64())}
        out = pa.table(cols | {"score": pa.array(np.concatenate(scores)), "bytes": pa.array([len(t) for t in texts], type=pa.int64())})
        del g, lp, w, c, grams_at, found
        release()
        return out

    rows = gathered.where("range IS NULL").select("block", "a")
    schema = fields + ", n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long"
    return rows.groupBy("block").cogroup(valued.groupBy("block")).applyInArrow(finish, schema)
