"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import functools
import hashlib
import json
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import embedding_dedup, exact_dedup, html_extraction, language_id, lm_scoring, mixing, ngram_join, pii, sentencepiece_codec, sharding

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h long, n long, s long, cid long, label int, row int, block int, score double, k int, bytes int"
WORDS = "the of and to in that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your".split()


def docs_rows(seed=0, n=60):
    r = random.Random(seed)
    texts = [None, "", " ", "one", "one two", "ONE two", "Ünïcode ÀÉ straße", "\n\t \r", "a" * 3000, ("long text " * 4000), "[](){}<>!?", "▁ x"]
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(5, 80))) for _ in range(n // 3)]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), " ".join(w[:-1]), " ".join(w[:3] + ["zzz"] + w[4:])]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "s1", None]), len(t or ""), "x", 1, 2, 3, 4, 5, 6, 7, 0.5, 8, 9) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[14]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(docs_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert sharding.shard(nothing).count() == 0
    assert ngram_join.jaccard_components(nothing).count() == 0
    assert pii.find_spans(nothing).count() == 0
    assert sentencepiece_codec.encode_decode(nothing).count() == 0
    assert language_id.predict_language(nothing, nothing).count() == 0
    assert lm_scoring.score(nothing, F.lit(True)).count() == 0
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_exact_dedup(docs):
    rows = [(r.doc_id, (r.text or "").encode().translate(FOLD)) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup.exact_dedup(docs, capacity=4).collect()
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t).hexdigest()) for i, t in rows)
    assert sorted(tuple(r)[:5] for r in got) == want
    assert len({r.bucket for r in got}) > 1


def plain_buckets(hashes, capacity, start):
    """(first bit prefix, depth) of each hash's bucket: split until no bucket is over capacity."""
    out, todo = {}, [(p, start, [h for h in hashes if h >> (64 - start) == p]) for p in range(1 << start)]
    while todo:
        prefix, depth, mine = todo.pop()
        if len(mine) > capacity and depth < 64:
            todo += [(prefix << 1 | bit, depth + 1, [h for h in mine if h >> (63 - depth) & 1 == bit]) for bit in (0, 1)]
        else:
            out.update({h: (prefix, depth) for h in mine})
    return out


@pytest.mark.parametrize("capacity", [1, 3, 40, 1000])
def test_directory_splits(spark, capacity):
    r = random.Random(capacity)
    hashes = {r.getrandbits(64) for _ in range(200)} | {(5 << 54) + r.getrandbits(50) for _ in range(60)}  # a crowded range
    keys = spark.createDataFrame([(h - (1 << 64) if h >> 63 else h,) for h in hashes], "h long")
    directory, depth, used = exact_dedup.build_directory(exact_dedup.Workspace(spark, "t"), keys, len(hashes), capacity)
    cells = {x.cell: (x.bucket, x.local_depth) for x in directory.collect()}
    start = max(1, int(math.log2(len(hashes) / capacity)) - 2 if len(hashes) > capacity else 1)
    want = plain_buckets(hashes, capacity, start)
    mask = (1 << 64) - 1
    got = {h: cells[c if (c := h >> (64 - depth)) < 1 << 63 else c - (1 << 64)] for h in hashes}
    assert {h: ((b & mask) >> (depth - local), local) for h, (b, local) in got.items()} == want
    assert max(collections.Counter(b for b, _ in got.values()).values()) <= capacity and used == len(cells)


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "Same Text" if i % 3 else f"text {i // 6}") for i in range(600)] + [(None, "only"), (None, "same text"), (7, "same text")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=10).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.lower()].append(i)
    want = collections.Counter((i, max((x for x in groups[t.lower()] if x is not None), default=None), len(groups[t.lower()])) for i, t in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want


def brute_targets(sizes, weights):
    """Water filling by repeated sharing."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 3 * sizes[i]}
        if not over:
            out.update({i: left * weights[i] / w for i in open_})
            break
        for i in over:
            out[i] = 3 * sizes[i]
            left -= 3 * sizes[i]
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def test_mixing(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    sums = [sum(size(r.text) for r in rows if r.source == s) for s in sources]
    goal = dict(zip(sources, brute_targets(sums, [i % 3 + 1 for i in range(len(sources))])))
    got = mixing.mix(docs)
    a, b = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    assert a == b  # reruns agree
    src = {r.doc_id: r.source for r in rows}
    for r in got.collect():
        assert r.size == size(next(x.text for x in rows if x.doc_id == r.doc_id))
        assert math.isclose(r.target, goal[src[r.doc_id]]) and r.taken == r.copies * r.size <= 3 * r.size
    for s in sources:
        e = goal[s] / max(sums[sources.index(s)], 1)
        mine = [r for r in got.collect() if src[r.doc_id] == s and r.size]
        assert abs(sum(r.copies for r in mine) - e * len(mine)) <= 1
        assert all(r.copies in (math.floor(e), math.ceil(e)) for r in mine)


def test_small_source_stops_at_three_times(spark):
    d = spark.createDataFrame([(i, "w " * 1000, "a") for i in range(20)] + [(100, "w w", "b")], "doc_id long, text string, source string")
    r = {x.doc_id: x for x in mixing.mix(d).collect()}
    assert r[100].target == 6.0 and r[100].taken == 6


def test_sharding(docs):
    got = sharding.shard(docs, shards=4).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    by = collections.defaultdict(set)
    for r in got:
        by[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_best_fit_matches_a_plain_search():
    r = random.Random(3)
    for _ in range(30):
        sizes = sorted((r.randint(1, 60) for _ in range(80)), reverse=True)
        bins, want = [], []
        for s in sizes:
            fit = [(b, i) for i, b in enumerate(bins) if b >= s]
            if fit:
                i = min(fit)[1]
            else:
                bins.append(100)
                i = len(bins) - 1
            bins[i] -= s
            want.append(i)
        assert sharding.best_fit_decreasing(sizes, 100) == want
        loads = collections.Counter()
        for s, b in zip(sizes, sharding.pack(sizes, 5)):
            loads[b] += s
        assert len(loads) <= 5 and max(loads.values()) <= sum(sizes) / 5 + max(sizes)


def components(sets, num, den):
    n = len(sets)
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * x >= num * (len(sets[i]) + len(sets[j]) - x):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


@pytest.mark.parametrize("k, num, heavy", [(3, 90, 2), (3, 90, 32), (5, 80, 3), (2, 50, 2), (1, 60, 2)])
def test_ngram_join(spark, docs, k, num, heavy):
    r = random.Random(k)
    rows = docs.select("doc_id", "text").collect()
    base = [r.choice(WORDS) + str(i) for i in range(40)]
    extra = []
    for i in range(70):  # a crowded group: one original, copies at many distances
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(40)] = f"q{r.randint(0, 15)}"
        extra.append((1000 + i, " ".join(w[: r.randint(30, 40)])))
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    ids = sorted({x.doc_id: x.text for x in rows} | dict(extra))
    text = {x.doc_id: x.text for x in rows} | dict(extra)
    sets = []
    for i in ids:
        w = (text[i] or "").encode().translate(FOLD).split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    want = {ids[i]: ids[c] for i, c in enumerate(components(sets, num, 100))}
    got = ngram_join.jaccard_components(d, k=k, num=num, den=100, heavy=heavy).collect()
    assert len(got) == len(rows) + len(extra)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[ids.index(r.doc_id)]) for r in got)


def test_embeddings(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((12, 16))
    v = [(b + 0.08 * r.standard_normal(16)).tolist() for b in base for _ in range(9)]
    rows = [(i, [float(np.float32(x)) for x in e], i % 2) for i, e in enumerate(v)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, None, 0), (503, [0.0] * 16, 0), (504, [float("nan")] + [1.0] * 15, 0), (505, rows[0][1], None), (506, [1.0, None] + [0.0] * 14, 1), (507, [], 0), (508, [1.0, 2.0], 0), (508, [1.0, 2.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = embedding_dedup.near_duplicates(d, tile=4).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(e), l) for i, e, l in rows if i < 502]
    links = collections.Counter()
    comp = {i: i for i, *_ in good}
    for a, x, l in good:
        for b, y, m in good:
            if a < b and l == m and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = comp[a], comp[b]
                comp = {k: min(p, q) if c in (p, q) else c for k, c in comp.items()}
    for r in got:
        if r.vec_id < 502:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)
        elif r.vec_id < 508:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.n_links == 1


def test_pii_base_against_plain_patterns():
    plain = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def ok(k, x):
        digits = re.sub(r"[^0-9]", "", x)
        return [True, k == 1 and all(int(p) <= 255 for p in x.split(".")), 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]

    r = random.Random(2)
    for _ in range(5000):
        t = "".join(r.choice(r.choice(["a@.b-", "1.2 3-", "+1 2()-.", "4 0-", "12345.", "ab@c.d+1"])) for _ in range(r.randint(0, 40)))
        assert sorted(pii.base_spans(t)[0]) == sorted((k, m.start(), m.end()) for k in range(4) for m in plain[k].finditer(t) if ok(k, m[0]))


def test_pii(spark):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [(i, f'Some words token = "{key[i:]}{i}a1b2c3d4" more, é mail me a{i}@b.org or +1 (017) 555-77{i:02d}', 1) for i in range(12)] + [(50, None, 1), (51, "", 1), (52, "clean prose without anything", 1)]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    for i in range(12):
        t = rows[i][1]
        found = [x.split(":") for x in got[i].spans.split(",")]
        assert [k for k, *_ in found] == ["email", "phone", "secret"]
        assert t[int(found[2][1]) : int(found[2][2])] == f"{key[i:]}{i}a1b2c3d4"
        assert got[i].base_sha256 == hashlib.sha256(",".join(":".join(x) for x in found[:2]).encode()).hexdigest()
    for i in (50, 51, 52):
        assert got[i].spans == "" and got[i].n_email == 0


def test_language(spark):
    r = random.Random(1)
    make = lambda ws: " ".join("".join(r.choice(ws) for _ in range(2)) for _ in range(r.randint(4, 40)))
    parts = {"aa": "the ing tion and er".split(), "bb": "eux que ment é la".split(), "cc": "sch ung ö ich der".split()}
    rows = [(i, make(parts[k]), k) for i, k in enumerate(list(parts) * 60)] + [(900, None, None), (901, "123 $$ 4", "aa"), (902, "", "bb"), (903, "ÖSCH " * 30000, "cc")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {x.doc_id: x for x in language_id.predict_language(d, d.where("doc_id % 5 < 3 or doc_id > 899"), ["lang"]).collect()}
    held = [x for x in got.values() if x.doc_id < 900 and x.doc_id % 5 > 2]
    assert sum(x.lang == x.lang_pred for x in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"]
    assert all(0 <= x.score <= 1 for x in got.values())


def test_lm(spark, docs):
    train = F.col("doc_id") % 5 != 0
    rows = docs.select("doc_id", "text").collect()
    c = collections.Counter()
    words = {}
    for r in rows:
        words[r.doc_id] = [*(r.text or "").encode().translate(FOLD).split(), b" "]
        if r.doc_id % 5:
            c.update(words[r.doc_id])
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(docs, train, block_chars=2000).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score <= 0 and (r.score < 0) == bool(r.bytes)


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_scores_equal_a_plain_context_tree(spark, depth):
    texts = [(1, "abracadabra, abracadabra! " * 3, True), (2, "abra é cadabra", True), (3, "", True), (4, None, True), (5, "abra\0cadab zzz\U0001f600", False), (5, "abracadabra, abracadabra!", False), (None, "a", False), (7, "x", True)]
    node = collections.defaultdict(lambda: [0, 0])
    below = collections.defaultdict(set)

    def decisions(text):
        a = b"\0" * depth + text.encode()
        for i in range(depth, len(a)):
            yield a[i - depth : i], [(1 << d | a[i] >> (8 - d), a[i] >> (7 - d) & 1) for d in range(8)]

    for _, text, train in texts:
        for ctx, bits in decisions(text if train and text else ""):
            for b, bit in bits:
                for d in range(depth + 1):
                    node[ctx[depth - d :], b][bit] += 1
                    if d:
                        below[ctx[depth - d + 1 :], b].add(ctx[depth - d :])

    @functools.cache
    def weights(ctx, b):
        z, o = node.get((ctx, b), (0, 0))
        e = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
        return (e, e) if len(ctx) == depth else (e, np.logaddexp(e, sum(weights(k, b)[1] for k in below.get((ctx, b), ()))) - math.log(2))

    def plain(text):
        total = 0.0
        for ctx, bits in decisions(text):
            for b, bit in bits:
                p, left = 0.0, 1.0
                for d in range(depth + 1):
                    n = node.get((ctx[depth - d :], b), (0, 0))
                    e, w = weights(ctx[depth - d :], b)
                    stop = 1.0 if d == depth else math.exp(e - math.log(2) - w)
                    p += left * stop * (n[bit] + 0.5) / (sum(n) + 1)
                    left *= 1 - stop
                total += math.log10(p)
        return total

    d = spark.createDataFrame([(i, t, g, "x") for i, t, g in texts], "doc_id long, text string, g boolean, score string")
    got = lm_scoring.score(d, F.col("g"), ["g"], depth=depth, block_chars=40).collect()
    assert sorted((str(r.doc_id), r.bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t, _ in texts)
    want = {(i, len((t or "").encode())): plain(t or "") for i, t, _ in texts}
    for r in got:
        assert math.isclose(r.score, want[r.doc_id, r.bytes], rel_tol=1e-5, abs_tol=1e-9)


def test_scores_without_training_cost_eight_bits_a_byte(spark):
    d = spark.createDataFrame([(1, "some text " * 50_000), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(d, F.lit(False)).collect()}
    assert math.isclose(got[1].score, -500_000 * 8 * math.log10(2), rel_tol=1e-6) and got[2].score == 0 and got[1].n_known == 0


def test_lm_blocks_get_values_without_their_grams(spark):
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 20_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 400)) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    scored = lm_scoring.score(d, F.lit(True), block_chars=100_000)
    assert len(scored.collect()) == len(texts)
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = collections.Counter()
    for f in (f for x in dirs for f in pathlib.Path(x).rglob("shuffle_*.data")):
        shuffles[int(f.name.split("_")[1])] += f.stat().st_size
    # The last shuffle brings the values: 2.6 bytes for each byte of these texts, 5.2 if their grams and words come along.
    assert shuffles[max(shuffles)] < 4 * sum(map(len, texts))


def test_lm_tokens_and_places():
    texts = [b"", b" ", b"A b\tA\x0bc\x1cd \r\n", "\u00c4 \u00e4\u00a0x\u2003y ".encode(), b"  a\x00b B", b"a" * 5000 + b" a"]
    hashes, at, n = lm_scoring.tokens(texts)
    fold = [bytes(c + 32 if 65 <= c <= 90 else c for c in t) for t in texts]
    want = [lm_scoring._word_hash(w) for t in fold for w in [*re.findall(rb"[^\x20\x09-\x0D]+", t), lm_scoring.END]]
    assert hashes[at].tolist() == want and n.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) + 1 for t in texts]
    rng = np.random.default_rng(5)
    for keys in (np.unique(rng.integers(0, 2**56, 50_000)), np.arange(3000) << 40, np.array([7]), np.zeros(0, dtype=np.int64)):
        keys = rng.permutation(keys)
        order = rng.integers(0, max(1, len(keys)), 4 * len(keys))
        assert np.array_equal(lm_scoring.Places(keys).find(keys[order]), order)


def test_tree_climbs_alike_in_pieces():
    r = np.random.default_rng(1)
    key = np.sort(r.integers(0, 50, 1000))
    rows = pa.table({"k": key, "v": np.arange(1000)})
    cut = list(lm_scoring.whole_groups(iter(rows.to_batches(max_chunksize=7)), 30))
    assert len(cut) > 5 and np.array_equal(np.concatenate([c[1] for c in cut]), np.arange(1000))
    assert len(set.union(*(set(c[0]) for c in cut))) == sum(len(set(c[0])) for c in cut)
    for a in (np.array([5, 3, -1]), np.arange(9), np.zeros(0, dtype=np.int64), np.array([1.5, -2.0], dtype=np.float32)):
        assert np.array_equal(lm_scoring.unpack(lm_scoring.pack(a), a.dtype), a)


def test_codec_equals_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces(sentencepiece_codec.read_model(sentencepiece_codec.MODEL)))
    r = random.Random(1)
    texts = ["a" * 500, "-" * 300 + "x" * 100, "▁▁ a▁b", " " * 50, "thereforeinternationalization" * 30, "", " ", "\n\n", "漢字 and é"]
    for _ in range(600):
        al = r.choice(["ab ", "aaa  ", "the and ing\n", " éñ漢x", "-*=/#", " the  in\t\t", "0123456789 .", "aaaaabc"])
        texts.append("".join(r.choice(al) for _ in range(r.randint(0, 90))))
    flat, at = codec.encode(texts)
    got = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == lib.encode(texts)
    assert all(codec.decode(g) == t for g, t in zip(got, texts) if "▁" not in t)


def test_streaming_commits_and_unigram_viterbi():
    pieces = {"a": -2.0, "b": -2.0, "ab": -2.5, "aba": -4.0, "ba": -3.0, "▁": -1.0, "▁a": -2.2}
    model = {"pieces": ["<unk>", *pieces], "scores": [0.0, *(s + 0.25 for s in pieces.values())], "kinds": "u" + "n" * len(pieces), "bpe": False, "unk": 0}
    p = sentencepiece_codec.Pieces(model)
    r = random.Random(5)
    for _ in range(200):
        t = "▁" + "".join(r.choice("ab") for _ in range(r.randint(1, 60)))
        best = [(0.0, [])] + [None] * len(t)
        for j in range(1, len(t) + 1):
            best[j] = max((best[i][0] + p.score[p.ids[t[i:j]]], best[i][1] + [p.ids[t[i:j]]]) for i in range(j) if t[i:j] in p.ids)
        parts = list(sentencepiece_codec.stream(p, iter(t)))
        assert math.isclose(sum(p.score[x] for part in parts for x in part), best[-1][0])
        ids, counts = sentencepiece_codec.lattice(p, [t, "▁ab"])
        assert math.isclose(sum(p.score[x] for x in ids[: counts[0]]), best[-1][0])


def test_codec_query(docs):
    got = sentencepiece_codec.encode_decode(docs).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got if r.doc_id != 11)
    assert all(r.n_ids == len(r.ids) for r in got)


PAGE = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div>{}<aside>Side</aside><footer>Foot &copy;</footer></body></html>"


def test_html(spark):
    cases = [
        (PAGE.format("<article><h1>Head &amp; one</h1><p>First<br>line &lt;b&gt;<p>Second  <b>bold</b>\n text<div class='comments'><p>Reader</p></div></article>"), "Head & one\nFirst line <b>\nSecond bold text"),
        (PAGE.format("<main><p>Only main &eacute;&#33;</p><form><input>Send</form></main>"), "Only main é!"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<p>no article here</p>", "no article here"),
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("<article><p>" + "word " * 50000 + "</article>", ("word " * 50000).strip()),
    ]
    rows = [(i, f"http://h{i}.org/{i}", h) for i, (h, _) in enumerate(cases)]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].text == want and got[i].n_chars == len(want)


def test_host_boilerplate(spark):
    rows = []
    for i in range(40):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        rows.append((i, f"https://user@Host.org:80/{i}", f"<div>Welcome to the site of all good things for everyone</div><div><p>Unique {words}</p></div><div>Made by the people who keep this fine site alive</div>"))
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    assert sorted(r.text for r in got) == sorted("Unique " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(40))


def plain_extract(pages, span):
    """Texts of pages (host, [(block, open)]): every stretch of span tokens that another, different page of the host holds goes."""
    out = []
    streams = [[w for t, _ in left for w in t.split()] for _, left in pages]
    grams = [{tuple(s[i : i + span]) for i in range(len(s) - span + 1)} for s in streams]
    for me, (host, left) in enumerate(pages):
        others = [grams[k] for k, (h, _) in enumerate(pages) if h == host and streams[k] != streams[me]]
        s, gone = streams[me], set()
        for i in range(len(s) - span + 1):
            if any(tuple(s[i : i + span]) in g for g in others):
                gone |= set(range(i, i + span))
        texts, lo = [], 0
        for t, is_open in left:
            words = t.split()
            keep = list(words)
            i = 0
            while is_open and i < len(words):
                j = i
                while j < len(words) and lo + j in gone:
                    j += 1
                if j - i >= span or j - i == len(words):
                    keep[i:j] = [None] * (j - i)
                i = max(j, i + 1)
            lo += len(words)
            if any(w is not None for w in keep):
                texts.append(" ".join(w for w in keep if w is not None))
        out.append("\n".join(texts))
    return out


@pytest.mark.parametrize("span", [2, 4, 8])
def test_host_suffix_array_against_all_stretches(spark, span):
    r = random.Random(span)
    passages = [" ".join(r.choice(WORDS) for _ in range(r.randint(3, 25))) for _ in range(8)]
    pages = []
    for i in range(50):
        parts = [(r.choice(passages) if r.random() < 0.5 else " ".join(f"{r.choice(WORDS)}{r.randint(0, 40)}" for _ in range(r.randint(1, 12))), True) for _ in range(r.randint(0, 9))]
        pages.append((f"h{min(i % 5, 2)}.org", parts))
    pages += [pages[3], pages[3]]  # copies of a page are one page
    rows = [(i, f"http://{h}/{i}", "".join(f"<p>{t}</p>" for t, _ in left)) for i, (h, left) in enumerate(pages)]
    got = {x.page_id: x.text for x in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), span=span).collect()}
    assert [got[i] for i in range(len(pages))] == plain_extract(pages, span)


def test_hints_in_an_article_go_by_repetition(spark):
    note = "All rights of this text are held by the people who wrote it"
    page = "<article><p>Keep {0}</p><div class='legal'>{1}</div><section class='related-work'>Work {0} came before</section></article>"
    rows = [(i, f"http://a.org/{i}", page.format(f"one{i}", note if i < 3 else "Only this page says so")) for i in range(4)]
    rows += [(None, "http://b.org/", page.format("x", note)), (4, None, page.format("y", "z")), (4, None, page.format("y", "z"))]
    got = sorted((r.page_id is None, r.page_id or 0, r.text) for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    text = lambda x, legal: "\n".join(t for t in (f"Keep {x}", legal, f"Work {x} came before") if t)
    want = [(False, i, text(f"one{i}", "" if i < 3 else "Only this page says so")) for i in range(4)] + [(False, 4, text("y", "z"))] * 2 + [(True, 0, text("x", note))]
    assert got == want


def test_host_array_holds_every_page(spark):
    note, quote = "All rights of this site are held by the people who wrote it", "A line that many writers of this site like to repeat"
    article = "<article><p>Own {0} words</p><p>{1}</p></article><aside>{1}</aside><footer>{2}</footer>"
    rows = [(i, f"http://a.org/{i}", article.format(f"x{i}", quote, note)) for i in range(6)]
    rows += [(6, "http://a.org/6", f"<div>No article here</div><div>{note}</div>"), (7, "http://b.org/7", f"<div>No article here</div><div>{note}</div>")]
    rows += [(8, "http://b.org/8", f"<article><p>Other</p><p>{quote}</p></article>"), (9, "http://b.org/9", "<nav>menu</nav>")]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    want = {i: f"Own x{i} words\n{quote}" for i in range(6)}  # a line of articles stays, also if sidebars quote it
    want |= {6: "No article here", 7: f"No article here\n{note}", 8: f"Other\n{quote}", 9: ""}  # the footers of other pages take the note of page 6
    assert got == want


def test_deep_markup_is_linear():
    import time

    took = []
    for n in (4000, 16000):
        t = time.perf_counter()
        assert html_extraction.blocks("<div>" * n + "x" + "</div></b>" * n) == [("x", False, False, False)]
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [r[:5] for r in docs_rows(3, 90)][:-2]  # doc_ids of a table are unique
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    # Brute force: letters, then the largest id of each text, then the least id of each near group, then the mix.
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {(r[1].encode().translate(FOLD)): r for r in left}
    left = sorted(last.values())
    sets = []
    for r in left:
        w = r[1].encode().translate(FOLD).split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    comp = components(sets, 80, 100)
    left = [r for i, r in enumerate(left) if comp[i] == i]
    d = spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mix(d).collect()}
    assert collections.Counter(r.doc_id for r in got) == collections.Counter({k: v for k, v in copies.items() if v})
    assert len(pipeline.STAGES) == 5 and json.dumps([n for n, _ in pipeline.STAGES])


def test_components_of_a_long_path(spark, monkeypatch):
    from lumenframe.llm import common

    n, r = 4096, random.Random(3)
    ids = list(range(n))
    r.shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(n + 5, n + 9), (n + 9, n + 5), (n + 7, n + 7)]
    ws = common.Workspace(spark, "path")
    got = common.components(ws, spark.createDataFrame(edges, "a long, b long"))
    assert {(x.id, x.comp) for x in got.collect()} == {(i, 0) for i in range(n)} | {(n + 5, n + 5), (n + 9, n + 5)}
    assert (ws.n - 1) / 2 <= 20  # two tables a round


def test_no_local_folder_on_a_cluster():
    from lumenframe.llm import common

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = Conf
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_root(Session())


def test_projection_passes_follow_the_rows():
    n = [embedding_dedup.passes_for(rows, 0.93, 10) for rows in (0, 10, 10_000, 10**6, 10**9)]
    assert n == sorted(n) and n[0] == 16 and n[-1] > n[2]
    agree = 1 - math.acos(0.93) / math.pi
    met = agree ** math.log2(10**9 / 10)
    assert 1 - (1 - met) ** n[-1] >= 0.97


SCRIPTS = {
    "latin": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīłńňőœřśšťůűźżž", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "russian": "абвгдежзийклмнопрстуфхцчшщ", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "chinese": "的一是不了在人有我他这中大来上个国和也子时道说", "japanese": "あいうえおかきくけこさしすせそたちつてと", "korean": "가나다라마바사아자차카타파하고노도로모보소오조초", "thai": "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอ",
}


def test_language_of_several_scripts(spark):
    r = random.Random(4)
    rows = []
    for i in range(8 * 60):
        k = list(SCRIPTS)[i % 8]
        rows.append((i, " ".join("".join(r.choice(SCRIPTS[k]) for _ in range(r.randint(2, 6))) for _ in range(r.randint(12, 40))), k))
    # Many accented letters, which most training texts hold.
    rows += [(1000 + i, " ".join(SCRIPTS["latin"]) + " abcdefghijklmnopqrstuvwxyz", "latin") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict_language(d, d.where("doc_id % 5 < 3"), ["lang"]).where("doc_id < 1000 and doc_id % 5 > 2").collect()
    for k in SCRIPTS:
        mine = [x.lang_pred == k for x in got if x.lang == k]
        assert sum(mine) / len(mine) > 0.95, k


def test_every_language_is_learnt(spark):
    rows = [(k * 12 + j, f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)} {chr(0x4E02 + 3 * k)}", f"l{k:02d}") for k in range(70) for j in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({y for _, y in language_id.training_rows(d)}) == 70
    got = language_id.predict_language(d, d, ["lang"]).collect()
    assert all(x.lang == x.lang_pred for x in got)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def run_pipeline(spark, path, rows):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(i, t, y, s, len(t)) for i, t, y, s in rows], DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    docs, out = spark.read.parquet(str(path / "documents.parquet")), {}
    ws = pipeline.Workspace(spark, "test")
    for name, stage in pipeline.STAGES[:-1]:
        docs = ws.save(stage(spark, docs, str(path)))
        out[name] = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    return out


def test_pipeline_with_ids_that_repeat_or_are_null(spark, tmp_path):
    r = random.Random(9)
    text = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(30)) for _ in range(12)]
    near = text[8] + " more"
    rows = [(1, text[0]), (1, text[1]), (2, text[1]), (1, text[2]), (3, text[2].upper()), (None, text[3]), (None, text[4]), (None, text[4]), (None, text[5]), (7, text[5]), (7, text[6]), (7, text[7]), (9, text[8]), (9, near), (None, text[9]), (4, text[9] + " more"), (5, text[10]), (5, text[10])]
    out = run_pipeline(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])
    want = [(1, text[0]), (2, text[1]), (3, text[2].upper()), (None, text[3]), (None, text[4]), (7, text[5]), (7, text[6]), (7, text[7]), (9, text[8]), (9, near), (None, text[9]), (4, text[9] + " more"), (5, text[10])]
    assert out["language_id"] == collections.Counter(rows)
    assert out["exact_dedup"] == collections.Counter(want)
    left = out["ngram_jaccard_join"]
    assert left == collections.Counter(x for x in want if x[1] not in (text[8], near, text[9])) + collections.Counter(x for x in left if x[1] in (text[8], near))
    assert sum(left[9, t] for t in (text[8], near)) == 1
    # One source of weight 1 takes each document once.
    assert out["mixing"] == left


def test_pipeline_decides_by_the_classifier(spark, tmp_path):
    r = random.Random(6)
    parts = {"aa": "the ing tion and er".split(), "bb": "eux que ment é la".split(), "cc": "sch ung ö ich der".split(), "dd": "zione gli per che".split()}
    make = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(2)) for _ in range(20))
    rows = [(i, make(k), k, "s") for i, k in enumerate(list(parts) * 40)]
    odd = [(900, "Ж Щ", None, "s"), (901, "жщ фы", None, "s")]  # nothing that a language's texts hold
    out = run_pipeline(spark, tmp_path, rows + odd)["language_id"]
    assert {i for i, _ in out} == {x[0] for x in rows}


def test_pipeline_without_labels_keeps_documents(spark, tmp_path):
    rows = [(1, "some words here", None, "s"), (2, "andere Wörter", None, "s"), (3, "123 $", None, "s")]
    assert {i for i, _ in run_pipeline(spark, tmp_path, rows)["language_id"]} == {1, 2}


def test_embeddings_of_a_dense_label(spark):
    r = np.random.default_rng(8)
    norm = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    common, n = norm(r.standard_normal((1, 64))), 3000
    base = norm(2.4 * common + norm(r.standard_normal((n, 64))))  # cosine 0.85 between most: few links
    twin = norm(base[:400] + 0.36 * norm(r.standard_normal((400, 64))))  # cosine 0.94 with the original
    v = np.concatenate([base, twin]).astype(np.float32)
    u = norm(v.astype(np.float64))
    d = spark.createDataFrame([(i, [float(y) for y in x], 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    assert len(a) > 300
    comp = {x.vec_id: x.component_id for x in embedding_dedup.near_duplicates(d).collect()}
    assert np.mean([comp[i] == comp[j] for i, j in zip(a.tolist(), b.tolist())]) >= 0.99


def test_brute_force_only_measures(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "passes_for", lambda *_: 1)
    r = np.random.default_rng(5)
    base = np.repeat(r.standard_normal((300, 16)), 2, axis=0)
    v = base + 0.09 * r.standard_normal(base.shape)
    d = spark.createDataFrame([(i, [float(y) for y in x], 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    comps = lambda **k: {x.vec_id: x.component_id for x in embedding_dedup.near_duplicates(d, window=1, **k).collect()}
    one_pass = comps(passes=1)
    assert len(set(one_pass.values())) > 300  # it misses pairs
    assert comps(recall=0.0) == one_pass  # all vectors are asked, but the passes alone decide


def test_windows_span_short_ranges(spark):
    r = np.random.default_rng(6)
    v = r.standard_normal((60, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    want = near.sum(axis=1) - 1
    d = spark.createDataFrame([(i, [float(y) for y in x], 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(d, passes=1, window=60).collect()}
    assert [got[i] for i in range(60)] == want.tolist()
