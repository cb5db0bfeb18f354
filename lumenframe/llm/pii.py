"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay. Further candidates are
shapes that the patterns miss: long mixed tokens (keys, passwords), spelled-out
addresses ("name at host dot tld"), phone numbers without "+", and base matches
that failed a test. Labelers of three kinds vote on every candidate, each +1
(personal), -1 (not) or 0 (abstains): regular expressions (shape, checksum,
mix of characters), gazetteers (key words before it, top-level domains) and
context (assignment and quotes around it, prose around it). Expectation
maximisation estimates how reliable each labeler is from the counts of vote
patterns over all documents, of which there are at most kinds x 3 ** labelers.
Its posteriors train the final classifier, a logistic regression on votes and
kind, which adds the candidates it is sure of.

Defined cases: null text counts as empty; spans are [start, end) in code points;
no spans give an empty string; a table without candidates trains nothing and
adds nothing; repeated rows are reported each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "obfuscated_email", "plain_phone", "loose_ip", "loose_card")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MIXED = re.compile(r"[0-9][A-Za-z0-9_]*")
RUN = re.compile(r"[A-Za-z0-9_]*\Z")
SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
BARE = re.compile(r"(?<![\w+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![\w-])")
#: Gazetteers: fixed lists of words that announce personal data, by kind.
WORDS = {
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "bearer", "auth", "credential"),
    "obfuscated_email": ("mail", "email", "e-mail", "contact", "write", "address"),
    "plain_phone": ("tel", "phone", "call", "fax", "mobile", "cell", "contact"),
    "loose_ip": ("ip", "host", "addr", "server"),
    "loose_card": ("card", "visa", "mastercard", "amex", "account", "iban"),
    "email": ("mail", "email", "contact"),
    "ip": ("ip", "host", "addr", "server"),
    "card": ("card", "visa", "account"),
    "phone": ("tel", "phone", "call", "fax"),
}
TLDS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """Spans (kind, start, end) by the fixed patterns, and the matches that failed a test."""
    spans, failed, end = [], [], 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(t, at + 1)):
            spans.append((0, start, m.end()))
            end = m.end()
        at = t.find("@", at + 1)
    for m in IP.finditer(t):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            spans.append((1, m.start(), m.end()))
        else:
            failed.append(("loose_ip", m.start(), m.end()))
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            if luhn(digits):
                spans.append((2, m.start(), m.end()))
            else:
                failed.append(("loose_card", m.start(), m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans, failed


def candidates(t: str, base: list[tuple[int, int, int]], failed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found = list(failed)
    low = 0
    for m in MIXED.finditer(t):
        if m.start() < low:
            continue
        start = m.start()
        while start > low and (t[start - 1].isascii() and (t[start - 1].isalnum() or t[start - 1] == "_")):
            start -= 1
        low = m.end()
        if m.end() - start >= 16 and not t[start : m.end()].isdigit():
            found.append(("secret", start, m.end()))
    if "at" in t and ("(" in t or "[" in t):
        found += [("obfuscated_email", m.start(), m.end()) for m in SPELLED.finditer(t)]
    found += [("plain_phone", m.start(), m.end()) for m in BARE.finditer(t)]
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for k, s, e in found:
        if not any(a < e and s < b for a, b in taken):
            out.append((k, s, e))
    return out


def votes(t: str, kind: str, s: int, e: int) -> tuple[int, ...]:
    """Votes of the six labelers on one span."""
    span, before, after = t[s:e], t[max(0, s - 40) : s], t[e : e + 4]
    near = re.findall(r"[a-z-]+", before.lower())[-3:]
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    shape = {"secret": 1 if len(span) >= 20 and digits >= 4 and letters >= 4 else -1, "loose_ip": -1, "loose_card": -1, "plain_phone": 0, "obfuscated_email": 1}.get(kind, 1)
    variety = 1 if len(set(span)) >= 10 and kind == "secret" else -1 if len(set(span)) < 4 else 0
    gazetteer = 1 if any(w in WORDS[kind] for w in near) else 0
    tld = (1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TLDS else -1) if "email" in kind else 0
    assigned = 1 if re.search(r"[=:]\s*[\"']?\Z", before) else (0 if kind in ("email", "phone") else -1)
    quoted = 1 if before[-1:] in "\"'" and before and after[:1] in "\"'" and after else 0
    return shape, variety, gazetteer, tld, assigned, quoted


def expectation_maximisation(patterns: dict[tuple, int], rounds: int = 40) -> dict[tuple, float]:
    """The posterior of each (kind, votes...) pattern.

    A labeler that votes is right with a probability of its own, whichever way it
    votes, and at least a little better than chance, so the classes cannot change
    places; labelers err independently; kinds differ in how common personal data is.
    """
    if not patterns:
        return {}
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    kind = np.array([(KINDS + MORE).index(k[0]) for k in keys])
    v = np.array([k[1:] for k in keys])
    given = kind < len(KINDS)  # base spans are personal data by definition
    p = np.where(given, 1.0, 1 / (1 + np.exp(-v.sum(axis=1))))  # start from the majority
    for _ in range(rounds):
        prior = (np.bincount(kind, n * p, minlength=9) + 1) / (np.bincount(kind, n, minlength=9) + 2)
        right = (np.where(v > 0, p[:, None], 1 - p[:, None]) * (v != 0) * n[:, None]).sum(axis=0)
        accuracy = np.clip((right + 4) / (((v != 0) * n[:, None]).sum(axis=0) + 5), 0.55, 0.99)
        logit = np.log(prior[kind] / (1 - prior[kind])) + v @ np.log(accuracy / (1 - accuracy))
        p = np.where(given, 1.0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return {k: float(x) for k, x in zip(keys, p)}


def features(key: tuple) -> np.ndarray:
    x = np.zeros(9 + 3 * LABELERS)
    x[(KINDS + MORE).index(key[0])] = 1
    for j, v in enumerate(key[1:]):
        x[9 + 3 * j + v + 1] = 1
    return x


def train_classifier(posterior: dict[tuple, float], patterns: dict[tuple, int], rounds: int = 300) -> np.ndarray:
    """Logistic regression on the posteriors as soft labels."""
    if not patterns:
        return np.full(9 + 3 * LABELERS, -1.0)
    keys = list(patterns)
    x, y = np.stack([features(k) for k in keys]), np.array([posterior[k] for k in keys])
    w = np.log1p([patterns[k] for k in keys])
    w = w / w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (q - y)) + 1e-4 * beta
        hess = (x * (w * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; one row for each input row."""
    spark = docs.sparkSession
    d = keyed(docs, id_col, text_col)

    def count(batches):
        c: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py() or ""
                base, failed = base_spans(t)
                for k, s, e in base:
                    c[(KINDS[k], *votes(t, KINDS[k], s, e))] += 1
                for k, s, e in candidates(t, base, failed):
                    c[(k, *votes(t, k, s, e))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], type=pa.string()), pa.array([list(k[1:]) for k in c], type=pa.list_(pa.int32())), pa.array(list(c.values()), type=pa.int64())], names=["kind", "votes", "n"])

    rows = d.select(text_col).mapInArrow(count, "kind string, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most 9 x 3 ** 6 patterns
    patterns = {(r["kind"], *r["votes"]): r["n"] for r in sorted(rows, key=lambda r: (r["kind"], r["votes"]))}
    beta = train_classifier(expectation_maximisation(patterns), patterns)

    def run(batches):
        known: dict[tuple, bool] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                out: list[list] = [[] for _ in range(7)]
                for t in b.column(1):
                    t = t.as_py() or ""
                    base, failed = base_spans(t)
                    base.sort()
                    n = Counter(k for k, _, _ in base)
                    for k in range(4):
                        out[k].append(n[k])
                    text = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
                    out[4].append(hashlib.sha256(",".join(text).encode()).hexdigest())
                    more = []
                    for k, s, e in candidates(t, base, failed):
                        key = (k, *votes(t, k, s, e))
                        if key not in known:
                            known[key] = 1 / (1 + math.exp(-float(features(key) @ beta))) >= sure
                        if known[key]:
                            more.append((MORE.index(k), s, e))
                    text += [f"{MORE[k]}:{s}:{e}" for k, s, e in sorted(more)]
                    out[5].append(",".join(text))
                    out[6].append(len(more))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, type=pa.int64()) for x in out[:4]), pa.array(out[4], type=pa.string()), pa.array(out[5], type=pa.string()), pa.array(out[6], type=pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return d.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
