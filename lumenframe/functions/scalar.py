"""Scalar semantics as Columns: NaN-aware comparison, truncating division, string and bit functions.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and filters on plain columns still reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def nan_to_null(c: Column, is_float: bool) -> Column:
    return F.when(~F.isnan(c), c) if is_float else c


def compare(op: str, a: Column, b: Column, is_float: bool) -> Column:
    """Comparison in which NaN is neither equal to, below nor above anything; null stays null."""
    raw = {"eq": a == b, "ne": a != b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
    if not is_float:
        return raw
    odd = F.isnan(a) | F.isnan(b)
    guarded = F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(odd, F.lit(op == "ne"))
    return guarded.otherwise(raw)


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Integers truncate toward zero; a zero divisor raises (ANSI mode)."""
    return F.call_function("div", a, b) if whole else a / b


def log(c: Column, fn=F.ln) -> Column:
    c = c.cast("double")
    return F.when(c == 0, F.lit(-INF)).when(c < 0, F.lit(NAN)).otherwise(fn(c))


def log1p(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c == -1, F.lit(-INF)).when(c < -1, F.lit(NAN)).otherwise(F.log1p(c))


def round_dp(c: Column, digits: int) -> Column:
    """round(c * 10**d) / 10**d with halves away from zero."""
    s = F.lit(10.0**digits)
    return F.round(c.cast("double") * s, 0) / s


def round_sig_figs(c: Column, digits: int) -> Column:
    c = c.cast("double")
    s = F.pow(F.lit(10.0), F.lit(float(digits)) - F.ceil(F.log10(F.abs(c))).cast("double"))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * s, 0) / s)


def literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", "$1" + literal(replacement))


def replace_all(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, literal(replacement))


def title(c: Column) -> Column:
    """Upper case after each start of a run of letters and digits, lower case elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def left(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n)) if n >= 0 else F.substr(c, F.lit(1), F.greatest(F.char_length(c) + n, F.lit(0)))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n)) if n >= 0 else F.substr(c, F.lit(1 - n))


def like(c: Column, pattern: str) -> Column:
    """% and _ without escapes; neither matches a newline."""
    return c.rlike("^" + "".join(".*" if p == "%" else "." if p == "_" else re.escape(p) for p in pattern) + r"\z")


def trim(c: Column, side: str = "both") -> Column:
    space = r"[\s\x0B\x85\p{Z}]+"
    if side != "right":
        c = F.regexp_replace(c, f"^{space}", "")
    if side != "left":
        c = F.regexp_replace(c, f"{space}$", "")
    return c


def leading_zeros(c: Column) -> Column:
    return F.when(c == 0, F.lit(64)).otherwise(64 - F.length(F.bin(c))).cast("long")


def trailing_zeros(c: Column) -> Column:
    b = F.bin(c)
    return F.when(c == 0, F.lit(64)).otherwise(F.length(b) - F.length(F.rtrim(b, F.lit("0")))).cast("long")


def finite(c: Column, is_float: bool) -> Column:
    if not is_float:
        return c.isNotNull()
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(INF)), F.lit(False))


def array_quantile(values: Column, q: float) -> Column:
    """Linear interpolation between the sorted values of an array."""
    a = F.array_sort(values)
    at = (F.size(a) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    low, high = F.get(a, lo).cast("double"), F.get(a, F.ceil(at).cast("int")).cast("double")
    return low + (high - low) * (at - lo)
