"""Rewrites queries of the analytic SQL dialect that users write into Spark SQL.

The query is cut into tokens and nested groups, so text in quotes, nested calls and
subqueries are never confused; everything becomes built-in Spark expressions.
Constructs that need the columns of a FROM clause (``* REPLACE``, ``* RENAME``,
``COLUMNS('regex')``) ask the caller for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\$\$.*?\$\$|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_]\w*|->>|->|::|\^@|//|!~|<>|<=>|<=|>=|!=|==|\|\||.", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_WORD = re.compile(r"[A-Za-z_]\w*$|`.*`$", re.S)
#: Words that end an operand; a bracket after them opens a list, not an index.
_KEYWORDS = set(
    "SELECT FROM WHERE GROUP HAVING ORDER BY LIMIT OFFSET UNION EXCEPT INTERSECT ALL DISTINCT AS ON USING JOIN AND OR NOT IN IS LIKE ILIKE BETWEEN CASE WHEN THEN ELSE WITH VALUES ASC DESC NULLS OVER PARTITION QUALIFY".split()
)
_CLAUSES = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "QUALIFY", "WINDOW"}
_ORDER_ENDS = {"LIMIT", "OFFSET", "ROWS", "RANGE", "UNION", "EXCEPT", "INTERSECT"}
#: Type names of the dialect and their Spark forms.
TYPES = {
    "VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "BPCHAR": "STRING", "BOOL": "BOOLEAN", "BLOB": "BINARY", "BYTEA": "BINARY",
    "INT1": "TINYINT", "INT2": "SMALLINT", "INT4": "INT", "INTEGER": "INT", "INT8": "BIGINT", "LONG": "BIGINT", "HUGEINT": "DECIMAL(38,0)",
    "UTINYINT": "SMALLINT", "USMALLINT": "INT", "UINTEGER": "BIGINT", "UBIGINT": "DECIMAL(20,0)", "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE",
    "DECIMAL": "DECIMAL(18,3)", "NUMERIC": "DECIMAL(18,3)", "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP",
}
_INTEGERS = {"TINYINT", "SMALLINT", "INT", "BIGINT"}
#: Strftime codes and the matching datetime pattern letters.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%-m": "M", "%d": "dd", "%-d": "d", "%H": "HH", "%-H": "H", "%I": "hh", "%-I": "h", "%M": "mm", "%-M": "m",
    "%S": "ss", "%-S": "s", "%f": "SSSSSS", "%g": "SSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a",
}
_RENAMED = {"STRPOS": "instr", "STRLEN": "octet_length", "LEN": "length", "ARRAY_TO_STRING": "array_join", "LIST_VALUE": "array", "LIST_CONTAINS": "array_contains", "ARRAY_HAS": "array_contains", "LIST_SORT": "array_sort", "LIST_DISTINCT": "array_distinct", "LIST_CONCAT": "concat", "UNNEST": "explode", "STRUCT_PACK": "struct"}


@dataclass
class Group:
    open: str
    items: list


def _parse(query: str) -> list:
    stack: list[Group] = [Group("", [])]
    for m in _TOKEN.finditer(query):
        t = m[0]
        if t in _CLOSE:
            stack.append(Group(t, []))
        elif t in _CLOSE.values():
            if len(stack) == 1 or _CLOSE[stack[-1].open] != t:
                raise ValueError(f"unbalanced {t} in query")
            g = stack.pop()
            stack[-1].items.append(g)
        elif t.startswith("--") or t.startswith("/*") or t.isspace():
            stack[-1].items.append(" ")
        elif t.startswith("$$"):
            stack[-1].items.append("'" + t[2:-2].replace("'", "''") + "'")
        elif t[0] == '"':
            stack[-1].items.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        else:
            stack[-1].items.append(t)
    if len(stack) > 1:
        raise ValueError(f"unclosed {stack[-1].open} in query")
    return stack[0].items


def _up(item) -> str:
    return item.upper() if isinstance(item, str) else ""


def _split(items: list, at: str) -> list[list]:
    out: list[list] = [[]]
    for x in items:
        if x == at:
            out.append([])
        else:
            out[-1].append(x)
    return out


def _strip(items: list) -> list:
    lo, hi = 0, len(items)
    while lo < hi and items[lo] == " ":
        lo += 1
    while hi > lo and items[hi - 1] == " ":
        hi -= 1
    return items[lo:hi]


def _body(literal: str) -> str:
    """The text of a quoted literal."""
    return literal[1:-1].replace("''", "'")


def _pattern(fmt: str) -> str:
    """A strftime format as a datetime pattern, in quotes."""
    out = ""
    for m in re.finditer(r"%-?[A-Za-z]|[A-Za-z]+|'|[^A-Za-z%']+|%", _body(fmt)):
        t = m[0]
        if t.startswith("%") and len(t) > 1:
            if t not in STRFTIME:
                raise ValueError(f"format code {t} is not supported")
            out += STRFTIME[t]
        else:
            out += "'" + t + "'" if t.isalpha() else "''" if t == "'" else t
    return "'" + out.replace("'", "''") + "'"


def _cast(x: str, kind: str, attempt: bool = False) -> str:
    """CAST; fractions round on the way to integers: doubles half to even, decimals half away from zero."""
    m = re.match(r"\s*([A-Za-z_]\w*(?:\s+PRECISION)?)\s*(\(.*?\))?\s*((?:\[\s*\])*)\s*$", kind, re.I | re.S)
    if not m:
        return f"{'try_cast' if attempt else 'CAST'}({x} AS {kind})"
    name, size, lists = m[1].upper(), m[2] or "", m[3].count("[")
    if name == "DOUBLE PRECISION":
        name = "DOUBLE"
    to = {"DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL"}.get(name) if size else TYPES.get(name)
    to = (to or name) + ("" if to == "STRING" else size)
    fn = "try_cast" if attempt else "CAST"
    if to in _INTEGERS and not lists:
        if re.fullmatch(r"\s*('.*'|-?\d+)\s*", x, re.S):
            return f"{fn}({x} AS {to})"
        return (
            f"CASE WHEN typeof({x}) IN ('double', 'float') THEN {fn}(rint(CAST({x} AS DOUBLE)) AS {to}) "
            f"WHEN startswith(typeof({x}), 'decimal') THEN {fn}(round(CAST({x} AS DOUBLE)) AS {to}) ELSE {fn}({x} AS {to}) END"
        )
    for _ in range(lists):
        to = f"ARRAY<{to}>"
    return f"{fn}({x} AS {to})"


def _epoch(x: str) -> str:
    return f"(unix_micros(CAST({x} AS TIMESTAMP)) / 1000000D)"


def _part(part: str, x: str) -> str:
    p = part.strip().strip("'").upper()
    seconds = f"extract(SECOND FROM CAST({x} AS TIMESTAMP_NTZ))"
    special = {
        "DECADE": f"CAST(floor(year({x}) / 10) AS BIGINT)", "CENTURY": f"CAST(ceil(year({x}) / 100) AS BIGINT)", "MILLENNIUM": f"CAST(ceil(year({x}) / 1000) AS BIGINT)",
        "EPOCH": _epoch(x), "ISODOW": f"CAST(weekday({x}) + 1 AS BIGINT)", "DOW": f"CAST(dayofweek({x}) - 1 AS BIGINT)", "DAYOFWEEK": f"CAST(dayofweek({x}) - 1 AS BIGINT)",
        "ISOYEAR": f"CAST(extract(YEAROFWEEK FROM {x}) AS BIGINT)", "SECOND": f"CAST(floor({seconds}) AS BIGINT)",
        "MILLISECOND": f"CAST(floor({seconds} * 1000) AS BIGINT)", "MICROSECOND": f"CAST({seconds} * 1000000 AS BIGINT)",
    }
    p = p[:-1] if p[:-1] in special else p
    return special.get(p) or f"CAST(extract({p} FROM {x}) AS BIGINT)"


def _left(s: str, n: str) -> str:
    return f"CASE WHEN ({n}) >= 0 THEN left({s}, {n}) ELSE substring({s}, 1, greatest(char_length({s}) + ({n}), 0)) END"


def _right(s: str, n: str) -> str:
    return f"CASE WHEN ({n}) >= 0 THEN right({s}, {n}) ELSE substring({s}, 1 - ({n})) END"


def _full_match(s: str, p: str) -> str:
    return f"regexp_like({s}, concat('\\\\A(?:', {p}, ')\\\\z'))"


def _strftime(a: str, b: str) -> str:
    return f"date_format({b}, {a})" if a.startswith("'") else f"date_format({a}, {b})"


_CALLS: dict[str, Callable[..., str]] = {
    "LEFT": _left,
    "RIGHT": _right,
    "CONCAT": lambda *a: "concat_ws('', " + ", ".join(f"CAST({x} AS STRING)" for x in a) + ")",
    "REGEXP_FULL_MATCH": _full_match,
    "REGEXP_MATCHES": lambda s, p, o=None: f"regexp_like({s}, {p})" if o is None else f"regexp_like({s}, concat('(?', {o}, ')', {p}))",
    "EPOCH": _epoch,
    "DATE_PART": _part,
    "DATEPART": _part,
    "XOR": lambda a, b: f"(({a}) ^ ({b}))",
    "STRFTIME": _strftime,
    "STRPTIME": lambda s, f: f"to_timestamp_ntz({s}, {f})",
    **dict.fromkeys(("STRING_TO_ARRAY", "STRING_SPLIT", "STR_SPLIT", "SPLIT"), lambda s, sep: f"split({s}, concat('\\\\Q', {sep}, '\\\\E'))"),
}


class Translator:
    """columns(from_clause, star) names the columns of ``SELECT star FROM ...``; read(format, path) names a view of a file."""

    def __init__(self, columns: Callable[[str, str], list[str]] | None = None, read: Callable[[str, str], str] | None = None):
        self.columns, self.read, self.ctes = columns, read, ""

    def translate(self, query: str) -> str:
        return self.render(_parse(query.strip().rstrip(";"))).strip()

    # levels of a query ----------------------------------------------------------
    def render(self, items: list) -> str:
        items = list(items)
        if any(_up(x) == "SELECT" for x in items):
            items = self._select_lists(items)
        return self._expressions(self._null_order(items))

    def _null_order(self, items: list) -> list:
        """Sort keys without NULLS FIRST or LAST get NULLS LAST."""
        out, i = [], 0
        while i < len(items):
            out.append(items[i])
            if _up(items[i]) != "ORDER":
                i += 1
                continue
            j = i + 1
            while j < len(items) and _up(items[j]) in (" ", "BY"):
                j += 1
            end = j
            while end < len(items) and _up(items[end]) not in _ORDER_ENDS:
                end += 1
            out += items[i + 1 : j]
            for n, key in enumerate(_split(items[j:end], ",")):
                out += [", "] if n else []
                out += _strip(key)
                if key and not any(_up(x) == "NULLS" for x in key):
                    out += [" ", "NULLS", " ", "LAST"]
            out.append(" ")
            i = end
        return out

    def _select_lists(self, items: list) -> list:
        out, i = [], 0
        while i < len(items):
            if _up(items[i]) == "WITH" and not out:
                start = next((j for j in range(i, len(items)) if _up(items[j]) == "SELECT"), len(items))
                self.ctes = self._expressions(items[i:start])
            out.append(items[i])
            i += 1
            if _up(out[-1]) != "SELECT":
                continue
            end = i
            while end < len(items) and _up(items[end]) not in _CLAUSES | {"FROM"}:
                # EXCEPT directly before a group of names is Spark's own star modifier
                end += 1
            source: list = []
            if end < len(items) and _up(items[end]) == "FROM":
                stop = end + 1
                while stop < len(items) and _up(items[stop]) not in _CLAUSES:
                    stop += 1
                source = items[end + 1 : stop]
            columns = [self._star(_strip(c), source) for c in _split(items[i:end], ",")]
            columns = self._zip([c for cs in columns for c in cs])
            out.append(" ")
            for n, c in enumerate(columns):
                out += ([", "] if n else []) + c
            out.append(" ")
            i = end
        return out

    def _names(self, source: list, star: str) -> list[str]:
        if self.columns is None:
            raise ValueError("this form of * needs the columns of its tables")
        return self.columns(f"{self.ctes} SELECT {star} FROM {self._expressions(source)}", star)

    def _star(self, c: list, source: list) -> list[list]:
        """One item of a SELECT list, with star modifiers expanded."""
        words = [x for x in c if x != " "]
        if words and _up(words[0]) == "DISTINCT":
            inner = self._star(_strip(c[c.index(words[0]) + 1 :]), source)
            return [["DISTINCT", " ", *inner[0]], *inner[1:]]
        if words and _up(words[0]) == "COLUMNS" and len(words) == 2 and isinstance(words[1], Group):
            want = re.compile(_body(_strip(words[1].items)[0]))
            return [[f"`{n}`"] for n in self._names(source, "*") if want.search(n)]
        star = next((k for k, x in enumerate(words) if x == "*"), None)
        if star is None or star not in (0, 2) or star + 1 >= len(words) or (star == 2 and words[1] != "."):
            return [c]
        prefix, drop, rename, replace, k = words[:star], set(), {}, {}, star + 1
        while k < len(words):
            kind, arg = _up(words[k]), words[k + 1] if k + 1 < len(words) else None
            if kind not in ("EXCLUDE", "EXCEPT", "RENAME", "REPLACE") or arg is None:
                return [c]
            if isinstance(arg, Group):
                parts, k = [_strip(p) for p in _split(arg.items, ",")], k + 2
            elif kind in ("EXCLUDE", "EXCEPT"):
                parts, k = [[arg]], k + 2
            else:
                parts, k = [words[k + 1 :]], len(words)
            for p in parts:
                p = [x for x in p if x != " "] if kind != "REPLACE" else p
                last = p[-1].strip("`").lower()
                if kind == "RENAME":
                    rename[p[0].strip("`").lower()] = p[-1]
                elif kind == "REPLACE":
                    replace[last] = _strip(p[: max(n for n, x in enumerate(p) if _up(x) == "AS")]) if any(_up(x) == "AS" for x in p) else p
                else:
                    drop.add(last)
        if not rename and not replace:
            return [[*prefix, "*", " ", "EXCEPT", " ", Group("(", [x for n, d in enumerate(sorted(drop)) for x in ([","] if n else []) + [f"`{d}`"]])]]
        out = []
        for n in self._names(source, "".join(prefix) + "*"):
            key = n.lower()
            if key in drop:
                continue
            out.append([*(replace.get(key) or [*prefix, f"`{n}`"]), " ", "AS", " ", rename.get(key, f"`{n}`")])
        return out

    def _zip(self, columns: list[list]) -> list[list]:
        """Several UNNEST of one SELECT advance together; shorter lists end in nulls."""
        at = [n for n, c in enumerate(columns) if c and _up(c[0]) == "UNNEST"]
        if len(at) < 2:
            return columns
        args, names = [], []
        for n in at:
            words = [x for x in columns[n] if x != " "]
            args.append(words[1])
            names.append(words[-1] if len(words) > 2 else f"unnest_{n}")
        listed = [x for n, g in enumerate(args) for x in ([","] if n else []) + g.items]
        first = ["inline", Group("(", ["arrays_zip", Group("(", listed)]), " ", "AS", " ", Group("(", [x for n, name in enumerate(names) for x in ([","] if n else []) + [name]])]
        return [first if n == at[0] else c for n, c in enumerate(columns) if n not in at[1:]]

    # expressions -------------------------------------------------------------------
    def _expressions(self, items: list) -> str:
        out: list[tuple[str, bool]] = []  # (text, whether it is an operand)
        i = 0
        while i < len(items):
            x = items[i]
            if x in ("~", "!~", "^@") and self._ends_operand(out):
                left = self._pop(out)
                right, i = self._operand(items, i + 1)
                text = f"startswith({left}, {right})" if x == "^@" else _full_match(left, right)
                out.append((f"(NOT {text})" if x == "!~" else text, True))
            elif x == "//":
                out.append((" div ", False))
                i += 1
            elif _up(x) in ("ANY", "ALL", "SOME") and (q := self._quantified(items, i, out)):
                i = q
            elif isinstance(x, Group) or (isinstance(x, str) and (x[0] in "'`" or x[0].isalnum() or x[0] == "_") and _up(x) not in _KEYWORDS):
                text, i = self._operand(items, i)
                out.append((text, True))
            else:
                out.append((x, False))
                i += 1
        return "".join(t for t, _ in out)

    @staticmethod
    def _ends_operand(out: list) -> bool:
        rest = [o for o in out if o[0] != " "]
        return bool(rest) and rest[-1][1]

    @staticmethod
    def _pop(out: list) -> str:
        while out[-1][0] == " ":
            out.pop()
        return out.pop()[0]

    def _quantified(self, items: list, i: int, out: list) -> int | None:
        """``x op ANY (...)`` and ``x op ALL (...)``, as IN or by the extremes; None if it is something else."""
        j = i + 1
        while j < len(items) and items[j] == " ":
            j += 1
        rest = [o for o in out if o[0] != " "]
        if j >= len(items) or not isinstance(items[j], Group) or len(rest) < 2 or rest[-1][0] not in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
            return None
        every = _up(items[i]) == "ALL"
        op = self._pop(out)
        x = self._pop(out)
        inner = _strip(items[j].items)
        if _up(inner[0]) not in ("SELECT", "WITH", "VALUES"):
            held = f"array_contains({self._expressions(inner)}, {x})"
            if every or op not in ("=", "=="):
                raise ValueError("comparison with a list supports = ANY only")
            out.append((held, True))
            return j + 1
        q = self.render(inner)
        if (op in ("=", "==")) and not every:
            text = f"({x} IN ({q}))"
        elif op in ("<>", "!=") and every:
            text = f"({x} NOT IN ({q}))"
        else:
            pick = {"<": "max", "<=": "max", ">": "min", ">=": "min"}
            flip = {"max": "min", "min": "max"}
            if op in pick:
                fn = flip[pick[op]] if every else pick[op]
                test = f"{x} {op} (SELECT {fn}(`c`) FROM ({q}) AS `q`(`c`))"
            else:
                word = "AND" if every else "OR"
                test = f"({x} {op} (SELECT min(`c`) FROM ({q}) AS `q`(`c`)) {word} {x} {op} (SELECT max(`c`) FROM ({q}) AS `q`(`c`)))"
            if every:
                text = f"CASE WHEN (SELECT count(*) FROM ({q}) AS `q`(`c`)) = 0 THEN true WHEN (SELECT count_if(`c` IS NULL) FROM ({q}) AS `q`(`c`)) > 0 AND {test} THEN NULL ELSE {test} END"
            else:
                text = f"({test})"
        out.append((text, True))
        return j + 1

    def _operand(self, items: list, i: int) -> tuple[str, int]:
        """A name, literal, call, group or list with its indexes, fields and casts."""
        while i < len(items) and items[i] == " ":
            i += 1
        if i < len(items) and items[i] in ("-", "+"):
            text, j = self._operand(items, i + 1)
            return items[i] + text, j
        x = items[i]
        i += 1
        if isinstance(x, Group):
            text = self._group(x)
        elif x[0] == "'":
            text = x.replace("\\", "\\\\")
        else:
            text = x
            j = i
            while j < len(items) and items[j] == " ":
                j += 1
            if j < len(items) and isinstance(items[j], Group) and items[j].open == "(" and _WORD.match(x):
                text, i = self._call(x, items[j], spaced=j > i), j + 1
        while i < len(items):
            n = items[i]
            if n == "." and i + 1 < len(items):
                step = items[i + 1]
                text, i = text + "." + (step if isinstance(step, str) else ""), i + 2
            elif isinstance(n, Group) and n.open == "[":
                text, i = self._index(text, n), i + 1
            elif n == "::":
                kind, i = self._type(items, i + 1)
                text = _cast(text, kind)
            elif n in ("->", "->>") or (n == " " and i + 1 < len(items) and items[i + 1] == "->>"):
                key, i = self._operand(items, i + (2 if n == " " else 1))
                if not key.startswith("'") and not key.isdigit():
                    return text + " -> " + key, i  # a lambda
                path = key.strip("'")
                path = path if path.startswith("$") else f"$[{path}]" if path.isdigit() else f"$.{path}"
                text = f"get_json_object({text}, '{path}')"
            else:
                break
        return text, i

    def _type(self, items: list, i: int) -> tuple[str, int]:
        while items[i] == " ":
            i += 1
        kind, i = items[i], i + 1
        if _up(kind) == "DOUBLE" and i + 1 < len(items) and _up(items[i + 1]) == "PRECISION":
            i += 2
        while i < len(items) and isinstance(items[i], Group) and items[i].open in "([":
            g = items[i]
            kind, i = kind + g.open + "".join(x for x in g.items if isinstance(x, str)) + _CLOSE[g.open], i + 1
        return kind, i

    def _group(self, g: Group) -> str:
        if g.open == "(":
            return "(" + self.render(g.items) + ")"
        parts = [p for p in _split(g.items, ",") if _strip(p)]
        if g.open == "[":
            return "array(" + ", ".join(self._expressions(_strip(p)) for p in parts) + ")"
        fields = []
        for p in parts:
            key, value = _split(p, ":")
            k = _strip(key)[0]
            fields += [k if k[0] == "'" else "'" + k.strip("`") + "'", self._expressions(_strip(value))]
        return "named_struct(" + ", ".join(fields) + ")"

    def _index(self, text: str, g: Group) -> str:
        parts = [self._expressions(_strip(p)) for p in _split(g.items, ":")]
        if len(parts) == 2:
            lo = parts[0] or "1"
            return f"slice({text}, {lo}, {f'greatest({parts[1]} - {lo} + 1, 0)' if parts[1] else f'greatest(size({text}) - {lo} + 1, 0)'})"
        return f"{text}[{parts[0]}]" if parts[0].startswith("'") else f"try_element_at({text}, {parts[0]})"

    def _call(self, name: str, g: Group, spaced: bool) -> str:
        up = name.upper()
        items = _strip(g.items)
        if up in ("CAST", "TRY_CAST") and any(_up(x) == "AS" for x in items):
            at = max(n for n, x in enumerate(items) if _up(x) == "AS")
            kind, end = self._type(items, at + 1)
            if not _strip(items[end:]):
                return _cast(self._expressions(_strip(items[:at])), kind, up == "TRY_CAST")
        if up == "EXTRACT" and any(_up(x) == "FROM" for x in items):
            at = next(n for n, x in enumerate(items) if _up(x) == "FROM")
            return _part("".join(items[:at]), self._expressions(_strip(items[at + 1 :])))
        if up in ("ARRAY_AGG", "LIST") and any(_up(x) == "ORDER" for x in items):
            at = next(n for n, x in enumerate(items) if _up(x) == "ORDER")
            keys = [x for x in items[at + 1 :] if _up(x) != "BY"]
            if len(_split(keys, ",")) == 1:
                down = any(_up(x) == "DESC" for x in keys)
                key = self._expressions(_strip([x for x in keys if _up(x) not in ("ASC", "DESC")]))
                return f"sort_array(collect_list(named_struct('k', {key}, 'v', {self._expressions(_strip(items[:at]))})), {str(not down).lower()}).v"
        if up == "LIST":
            name = "array_agg"
        if up in ("READ_CSV", "READ_CSV_AUTO", "READ_PARQUET", "READ_JSON", "READ_JSON_AUTO", "READ_NDJSON") and self.read and items and items[0][0] == "'":
            kind = up.removeprefix("READ_").removesuffix("_AUTO").lower()
            return self.read("json" if kind == "ndjson" else kind, _body(items[0]))
        if up in _CALLS and items:
            raw = [_strip(p) for p in _split(items, ",")]
            args = [self._expressions(p) for p in raw]
            if up in ("STRFTIME", "STRPTIME"):
                args = [_pattern(r[0]) if len(r) == 1 and _up(r[0]).startswith("'") and "%" in r[0] else a for r, a in zip(raw, args)]
            return _CALLS[up](*args)
        return _RENAMED.get(up, name) + (" " if spaced else "") + "(" + self.render(g.items) + ")"
