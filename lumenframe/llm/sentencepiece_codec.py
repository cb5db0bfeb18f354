"""SentencePiece encoding and decoding by a streaming lattice search.

The lattice has a boundary at each character; an edge is a piece. The search
keeps, for each boundary inside a window of the longest piece, the best path
that ends there, and commits ids as soon as the paths of all boundaries in the
window run through one common boundary.

What makes a path best depends on the model. For unigram models it is the sum of
piece scores (Viterbi). BPE models have merge ranks, which no sum of scores can
express; there a path is right if no merge would have crossed any of its
boundaries, which is a test of neighbouring pieces only (``Pieces.joined``).
Exactly one path to each boundary passes, so the same window and commits apply,
and the ids equal those of the merge procedure.

Paths always converge at a space that follows another character and at
characters outside the vocabulary, so texts are cut there and equal segments are
encoded once. Segments of up to ``SHORT`` characters run through the lattice
side by side in numpy; longer ones stream through the window. Runs of several
spaces hold pieces of equal rank, where the pair test is not defined; they are
merged directly.

Defined cases: null text and empty text have no ids, and decode to empty text; a
text of spaces only is encoded like any other; U+2581 in a text decodes to a
space, as in the format itself (``round_trip`` is false there); repeated rows
are encoded each; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, release

SPACE = "▁"
SHORT = 40
#: Segments whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = 1 << 62


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and settings of a model file, as plain values."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    kinds = "".join("u" if m.is_unknown(i) else "c" if m.is_control(i) else "b" if m.is_byte(i) else "x" if m.is_unused(i) else "n" for i in range(n))
    scores = [m.get_score(i) for i in range(n)]
    ranked = [s for s, k in zip(scores, kinds) if k == "n"]
    return {"pieces": [m.id_to_piece(i) for i in range(n)], "scores": scores, "kinds": kinds, "bpe": all(s == int(s) for s in ranked), "unk": m.unk_id()}


class Pieces:
    """A model's pieces with the tables that encoding and decoding need."""

    def __init__(self, model: dict):
        self.names, self.kinds, self.bpe, self.unk = model["pieces"], model["kinds"], model["bpe"], model["unk"]
        self.score = np.array(model["scores"], dtype=np.float64)
        self.ids = {p: i for i, p in enumerate(self.names) if self.kinds[i] == "n"}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.names) if self.kinds[i] == "b"}
        self.longest = max(map(len, self.ids), default=1)
        self.known = {p for p in self.ids if len(p) == 1}
        self.bytes_of = [b"" if k == "c" else bytes([int(p[3:5], 16)]) if k == "b" else " ⁇ ".encode() if k == "u" else p.replace(SPACE, " ").encode() for p, k in zip(self.names, self.kinds)]
        self.rank = np.full(len(self.names), -1, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) > 1:
                self.rank[i] = int(-self.score[i]) if self.bpe else 0
        self.left, self.right = np.full(len(self.names), -1), np.full(len(self.names), -1)
        self.reached = np.zeros(len(self.names), dtype=bool)
        if self.bpe:
            self._splits()
        self._table()

    def merged(self, text: str) -> list[tuple[int, int, int]]:
        """The merge procedure itself: (piece or -1, left, right) of each remaining symbol."""
        n = len(text)
        sym = [self.ids.get(c, -1) for c in text]
        last = [(-1, -1)] * n
        nxt, prv, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        ends = list(range(1, n + 1))

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (m := self.ids.get(text[i : ends[j]])) is not None and sym[i] >= 0 and sym[j] >= 0:
                heapq.heappush(heap, (-self.score[m], i, j, ends[j], m))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, j, end, m = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and nxt[i] == j and ends[j] == end):
                continue
            if end - i != len(self.names[m]):
                continue
            last[i], sym[i], ends[i], alive[j], nxt[i] = (sym[i], sym[j]), m, end, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [(sym[i], *last[i]) for i in range(n) if alive[i]]

    def _splits(self) -> None:
        keys, merged = [], []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.reached[i] = True
                continue
            if SPACE * 2 in p:
                continue
            if len(got := self.merged(p)) == 1:
                self.reached[i], self.left[i], self.right[i] = True, got[0][1], got[0][2]
            for k in range(1, len(p)):
                if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None:
                    keys.append(a << 20 | b)
                    merged.append(self.rank[i])
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = np.array([*np.array(keys, dtype=np.int64)[order], NONE]), np.array([*np.array(merged, dtype=np.int64)[order], NONE >> 1])

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' texts ends in just these two pieces.

        Goes back in time: of the two symbols at the boundary the one that was
        formed later is undone, and any merge of the two that would have come
        before that is a merge across the boundary. Of equal pieces the left one
        is formed first.
        """
        a, b = a.copy(), b.copy()
        ok, limit = np.ones(len(a), dtype=bool), np.full(len(a), NONE)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x << 20 | y
            at = np.searchsorted(self.pair_keys, key)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE >> 1)
            crossed = 2 * rank < limit[open_]
            ok[open_[crossed]] = False
            tx, ty = 2 * self.rank[x], 2 * self.rank[y] + 1
            ends = (tx < 0) & (ty < 0) | crossed
            undo_a = tx > ty
            limit[open_] = np.where(undo_a, tx, ty)
            a[open_], b[open_] = np.where(undo_a, self.right[x], x), np.where(undo_a, y, self.left[y])
            open_ = open_[~ends]
        return ok

    # A two-slot hash table of pieces for lookups of many substrings at once.
    MULT = np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, codes: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        for c in codes:
            h = h * self.MULT + np.uint64(c) + np.uint64(1)
        return h

    def _table(self) -> None:
        self.slot1, self.slot2, self.rest = np.full(1 << 20, -1, dtype=np.int32), np.full(1 << 20, -1, dtype=np.int32), {}
        self.hashes = np.zeros(len(self.names), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for p, i in self.ids.items():
                if self.bpe and not self.reached[i]:
                    continue
                h = self.hashes[i] = self._hash(np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32))
                s1, s2 = self._slots(h)
                if self.slot1[s1] < 0:
                    self.slot1[s1] = i
                elif self.slot2[s2] < 0:
                    self.slot2[s2] = i
                else:
                    self.rest[int(h)] = i

    @staticmethod
    def _slots(h):
        return (h ^ (h >> np.uint64(29))) & np.uint64((1 << 20) - 1), (h >> np.uint64(40)) & np.uint64((1 << 20) - 1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        s1, s2 = self._slots(h)
        i, j = self.slot1[s1], self.slot2[s2]
        out = np.where((i >= 0) & (self.hashes[i] == h), i, np.where((j >= 0) & (self.hashes[j] == h), j, -1))
        if self.rest:
            for k in np.flatnonzero((out < 0) & (i >= 0) & (j >= 0)):
                out[k] = self.rest.get(int(h[k]), -1)
        return out


def fallback(pieces: Pieces, char: str) -> list[int]:
    """Ids of a character outside the vocabulary: its bytes, or the unknown id."""
    return [pieces.byte[b] for b in char.encode("utf-8", "replace")] if pieces.byte else [pieces.unk]


def stream(pieces: Pieces, text: Iterator[str] | str) -> Iterator[list[int]]:
    """Ids of one segment, in parts, as soon as they are certain; memory is one window.

    Characters may come from any iterator. At each boundary the window holds the
    last piece (and score) of the best path to it.
    """
    tail, path = "", [(0, -1, 0.0, [])]  # boundaries from the last commit on: (start of last piece, piece, score, ids of a fallback)
    base, at = 0, 0
    for ch in text:
        at += 1
        tail = (tail + ch)[-pieces.longest :]
        best = None
        for k in range(1, len(tail) + 1):
            i = at - k
            if i < base or path[i - base] is None:
                continue
            p = pieces.ids.get(tail[-k:], -1)
            if p < 0 or pieces.bpe and not pieces.reached[p]:
                continue
            u = path[i - base][1]
            if pieces.bpe:
                if u < 0 or pieces.joined(np.array([u]), np.array([p]))[0]:
                    best = (i, p, 0.0, None)
                    break
            elif best is None or path[i - base][2] + pieces.score[p] > best[2]:
                best = (i, p, path[i - base][2] + pieces.score[p], None)
        if best is None and ch not in pieces.known:
            i = at - 1
            best = (i, -1, path[i - base][2] - 1e6, fallback(pieces, ch))
        path.append(best)
        # All surviving paths: those of the boundaries that a later piece can start from.
        live = {i for i in range(max(base, at - pieces.longest + 1), at + 1) if path[i - base] is not None}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(path[top - base][0])
        common = live.pop()
        if common > base:
            yield _ids(path, base, common)
            path, base = path[common - base :], common
            path[0] = (base, path[0][1], path[0][2], path[0][3])
    if at > base:
        yield _ids(path, base, at)


def _ids(path: list, base: int, end: int) -> list[int]:
    parts = []
    while end > base:
        i, p, _, extra = path[end - base]
        parts.append(extra if extra is not None else [p])
        end = i
    return [x for part in reversed(parts) for x in part]


def lattice(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many short segments, one after the other, and how many each has; every character is in the vocabulary."""
    n, lens = len(words), np.array([len(w) for w in words])
    width = int(lens.max())
    codes = np.zeros((n, width), dtype=np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    rows = np.repeat(np.arange(n), lens)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    codes[rows, cols] = flat
    last, start = np.full((n, width + 1), -1, dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
    score = np.full((n, width + 1), -np.inf)
    score[:, 0] = 0
    with np.errstate(over="ignore"):
        prefix, power = np.zeros((n, width + 1), dtype=np.uint64), [np.uint64(1)]
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * Pieces.MULT + codes[:, j] + np.uint64(1)
            power.append(power[-1] * Pieces.MULT)
        for j in range(1, width + 1):
            live = np.flatnonzero(lens >= j)
            ws, ps, ss = [], [], []
            for k in range(1, min(j, pieces.longest) + 1):
                p = pieces.lookup(prefix[live, j] - prefix[live, j - k] * power[k])
                hit = np.flatnonzero((p >= 0) & (score[live, j - k] > -np.inf))
                ws.append(live[hit])
                ps.append(p[hit].astype(np.int64))
                ss.append(np.full(len(hit), j - k))
            w, p, s = np.concatenate(ws), np.concatenate(ps), np.concatenate(ss)
            if pieces.bpe:
                u = last[w, s]
                keys, inverse = np.unique(u << 20 | p, return_inverse=True)
                good = (keys < 0) | pieces.joined(np.maximum(keys, 0) >> 20, keys & 0xFFFFF)
                good = good[inverse] | (u < 0)
                w, p, s = w[good], p[good], s[good]
                last[w, j], start[w, j], score[w, j] = p, s, 0
            else:
                total = score[w, s] + pieces.score[p]
                order = np.lexsort((total, w))
                w, p, s, total = w[order], p[order], s[order], total[order]
                top = np.flatnonzero(np.r_[w[1:] != w[:-1], True]) if len(w) else order
                last[w[top], j], start[w[top], j], score[w[top], j] = p[top], s[top], total[top]
    at, live, back = lens.copy(), np.arange(n), []
    while len(live):
        back.append((live, last[live, at[live]]))
        at[live] = start[live, at[live]]
        live = live[at[live] > 0]
    counts = np.bincount(np.concatenate([w for w, _ in back]), minlength=n)
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]), dtype=np.int32)
    for k, (w, p) in enumerate(back):
        ids[ends[w] - 1 - k] = p
    return ids, counts


class Codec:
    """Encodes and decodes whole texts; remembers the ids of segments."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._forget()
        other = "".join(re.escape(c) for c in sorted(c for c in self._foreign()))
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{other}]+|{SPACE}+|[{other}]" if other else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _forget(self) -> None:
        """at: number of each known segment; its ids are flat[start : start + count]."""
        self.at: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _foreign(self) -> set[str]:
        return {c for c in "\n\t\r" if c not in self.p.known}

    def _learn(self, words: list[str]) -> None:
        known = self.p.known
        short = [w for w in words if len(w) <= SHORT and known.issuperset(w) and SPACE * 2 not in w]
        flat, count = lattice(self.p, short) if short else (self.flat[:0], self.count[:0])
        if len(short) < len(words):
            others = set(words).difference(short)
            more = [self._long(w) for w in others]
            short += others
            flat = np.concatenate([flat, np.array([x for ids in more for x in ids], dtype=np.int32)])
            count = np.concatenate([count, np.array([len(ids) for ids in more], dtype=np.int64)])
        self.at.update(zip(short, range(len(self.at), len(self.at) + len(short))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def _long(self, w: str) -> list[int]:
        if SPACE * 2 in w and self.p.bpe:
            return [x for c, m in self._symbols(w) for x in ([m] if m >= 0 else fallback(self.p, c))]
        return [x for part in stream(self.p, w) for x in part]

    def _symbols(self, w: str) -> list[tuple[str, int]]:
        out, i = [], 0
        for m, _, _ in self.p.merged(w):
            k = len(self.p.names[m]) if m >= 0 else 1
            out.append((w[i : i + k], m))
            i += k
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more entry than texts)."""
        if len(self.at) > REMEMBERED:
            self._forget()
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = [w for ws in cut for w in ws]
        new = set(words).difference(self.at)
        if new:
            self._learn(list(new))
        index = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        counts = self.count[index]
        ends = np.cumsum(counts)
        flat = self.flat[np.repeat(self.start[index] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        at = np.r_[0, np.cumsum([len(ws) for ws in cut])].astype(np.int64)
        return flat, np.r_[0, ends][at]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.p.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_codec: dict[int, Codec] = {}


def _worker_codec(model: dict) -> Codec:
    key = hash((len(model["pieces"]), model["pieces"][-1], model["scores"][-1]))
    if key not in _codec:
        _codec.clear()
        _codec[key] = Codec(Pieces(model))
    return _codec[key]


def encode_decode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1_000_000) -> DataFrame:
    """id, n_ids, ids, n_bytes and round_trip (the decoded ids give the text); one row for each input row."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # the size of the vocabulary file

    def run(batches):
        codec = _worker_codec(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                yield from chunks(codec, batch.slice(lo, 2048))
        codec._forget()  # the worker may serve other operators next
        release()

    def chunks(codec, batch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < chunk_chars:
                size += len(texts[hi] or "")
                hi += 1
            part = [t or "" for t in texts[lo:hi]]
            flat, begin = codec.encode(part)
            whole = flat.tolist()
            same = [codec.decode(whole[a:b]) == t for t, a, b in zip(part, begin[:-1].tolist(), begin[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(np.diff(begin)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat, type=pa.int32())), pa.array([len(t.encode()) for t in part], type=pa.int64()), pa.array(same)],
                names=["doc_id", "n_ids", "ids", "n_bytes", "round_trip"],
            )
            lo = hi

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, n_bytes long, round_trip boolean")
