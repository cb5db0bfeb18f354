"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of n-grams of 1 to 3 letters that both
hold (presence, not counts), divided by the geometric mean of the kernels with
themselves. Nystroem landmarks, a bounded sample of labelled texts, turn it into
features; one ridge regression for each language on +1 / -1 is solved in closed
form. Landmarks and regressions multiply to one weight for each n-gram and
language, so a text is scored by adding up the weights of its n-grams.

N-grams are of code points, so every alphabet is told apart. Training reads
labelled rows of every language: at most ``per_lang`` of each and some
``most_rows`` in all, so fewer of each where there are many languages; they are
chosen by a hash of the id, and at most ``train_chars`` characters are read of
each; excerpts of the same rows teach short texts. Predictions read whole texts.

Defined cases: null text or text without letters is ``und`` with score 0; ties
go to the first language by code point; a table without labelled rows gives
``und`` everywhere; repeated rows are predicted each; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, release

UND = "und"
#: Code points take 21 bits; no letter has these values, which mark what is no 3-gram.
ONE, TWO = 0x1FFFFF, 0x1FFFFE

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Each code point's own value if it is a letter, else 0."""
    if not _letters:
        _letters.append(np.array([cp if chr(cp).isalpha() else 0 for cp in range(0x110000)], dtype=np.int64))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The text's distinct n-grams of 1 to 3 letters as sorted codes; a blank may stand at either end of one."""
    c = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not c.any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate(([0], c, [0]))
    left, right = c[:-1], c[1:]
    some = (left | right) > 0
    one = c[c > 0] | ONE << 21
    two = (left << 42 | right)[some] | TWO << 21
    three = (left[:-1] << 42 | c[1:-1] << 21 | right[1:])[c[1:-1] > 0]
    at = np.concatenate((one, two, three))
    at.sort()
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def places(vocab: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where in the vocabulary those of the n-grams are that it has."""
    at = np.searchsorted(vocab, s)
    at[at == len(vocab)] = 0
    return at[vocab[at] == s]


def fit(samples: list[tuple[str, str]], landmarks_per_lang: int = 40, most_landmarks: int = 640, ridge: float = 1e-2, seed: int = 7) -> dict | None:
    """The model from (text, lang) rows. Every language has landmarks, fewer where there are many languages."""
    samples = [(t, y) for t, y in samples if any(map(str.isalpha, t))]
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for t, y in samples:
        texts.append(t)
        labels.append(y)
        for n in (24, 60, 160):
            if len(t) > 2 * n:
                k = int(rng.integers(0, len(t) - n))
                texts.append(t[k : k + n])
                labels.append(y)
    langs = sorted(set(labels))
    number = {x: k for k, x in enumerate(langs)}
    y = np.array([number[x] for x in labels])
    sets = [grams(t) for t in texts]
    keep = [i for i, s in enumerate(sets) if len(s)]
    sets, y = [sets[i] for i in keep], y[keep]
    landmarks_per_lang = max(4, min(landmarks_per_lang, most_landmarks // len(langs)))
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:landmarks_per_lang] for k in range(len(langs))])
    vocab = np.unique(np.concatenate([sets[i] for i in marks]))
    # The landmarks that hold each n-gram of the vocabulary, one list after another.
    held = [places(vocab, sets[i]) for i in marks]
    gram, mark = np.concatenate(held), np.repeat(np.arange(len(marks)), [len(h) for h in held])
    mark = mark[np.argsort(gram, kind="stable")]
    many = np.bincount(gram, minlength=len(vocab))
    begin = np.cumsum(many) - many
    root_size = np.sqrt([len(sets[i]) for i in marks])
    k = np.zeros((len(sets), len(marks)))
    for r, s in enumerate(sets):
        at = places(vocab, s)
        n = many[at]
        lists = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        k[r] = np.bincount(mark[lists], minlength=len(marks)) / (root_size * np.sqrt(len(s)))
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.c_[k @ root, np.ones(len(k))]
    goal = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(langs))[y]  # each language counts alike
    a = phi.T @ (phi * weight[:, None])
    w = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)) * 1e-2, phi.T @ (goal * weight[:, None]))
    weights = np.zeros((len(vocab), len(langs)), dtype=np.float32)
    for at, row in zip(held, (root @ w[:-1]) / root_size[:, None]):
        weights[at] += row.astype(np.float32)
    return {"langs": langs, "vocab": vocab, "weights": weights, "bias": w[-1].astype(np.float32)}


class Predictor:
    def __init__(self, model: dict):
        self.m = model

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        m = self.m
        langs, out, score = m["langs"], [UND] * len(texts), np.zeros(len(texts))
        for r, t in enumerate(texts):
            s = grams(t) if t else ()
            if not len(s):
                continue
            f = m["weights"][places(m["vocab"], s)].sum(axis=0) / np.float32(np.sqrt(len(s))) + m["bias"]
            best = int(f.argmax())
            out[r], score[r] = langs[best], 1 / np.exp(4.0 * (f - f[best]).astype(np.float64)).sum()
        return out, score


def training_rows(labelled: DataFrame, per_lang: int = 300, most_rows: int = 19_200, train_chars: int = 8000) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) rows of labelled (doc_id, text, lang), with rows of every language."""
    counts = labelled.where("lang IS NOT NULL").groupBy("lang").count().collect()  # one row a language
    if not counts:
        return []
    per_lang = max(10, min(per_lang, most_rows // len(counts)))
    # About three times the wanted rows of each language pass a threshold on the hash; only those are ranked.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, 3.0 * per_lang / r[1] + 20 / r[1]))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = labelled.where("lang IS NOT NULL").withColumn("u", unit).where(F.col("u") < F.try_element_at(share, F.col("lang")))
    near = near.select("doc_id", "lang", "u", F.substring("text", 1, train_chars).alias("text"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))).where(F.col("r") <= per_lang)
    return [(r[0] or "", r[1]) for r in ranked.orderBy("lang", "r").select("text", "lang").collect()]  # some most_rows rows of train_chars


_predictor: dict = {}


def predict_language(docs: DataFrame, labelled: DataFrame, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, the columns of ``extra``, lang_pred, score. labelled: rows (doc_id, text, lang) to learn from."""
    return predict_with(learn(labelled, **limits), docs, extra, id_col, text_col)


def learn(labelled: DataFrame, **limits) -> dict | None:
    """The model of labelled rows (doc_id, text, lang); None where they teach nothing."""
    return fit(training_rows(plain(labelled, "doc_id", "text", "lang"), **limits))


def predict_with(model: dict | None, docs: DataFrame, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of ``extra``, lang_pred, score by a model of ``learn``."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: the landmarks' n-grams x languages
    extra = extra or []
    d = plain(docs, id_col, text_col, *extra)
    d = d.toDF("doc_id", "_text", *extra)
    fields = [f for f in d.schema.fields if f.name != "_text"]

    def run(batches):
        if model.value is None:
            predictor = None
        else:
            key = id(model.value)
            if key not in _predictor:
                _predictor.clear()
                _predictor[key] = Predictor(model.value)
            predictor = _predictor[key]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                texts = b.column(1).to_pylist()
                langs, score = predictor.predict(texts) if predictor else ([UND] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in range(2, b.num_columns)), pa.array(langs), pa.array(score)], names=[f.name for f in fields] + ["lang_pred", "score"])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    return d.mapInArrow(run, schema)
