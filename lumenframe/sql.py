"""SQL over registered frames: Spark SQL with the dialect of ``dialect`` rewritten.

Statements on the context itself are DELETE, TRUNCATE, DROP, SHOW TABLES and EXPLAIN.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import SparkSession

from .dialect import Translator
from .frame import Frame


def translate(query: str) -> str:
    """The query in Spark's dialect, where no table needs to be looked at."""
    return Translator().translate(query)


class SQLContext:
    """Frames by name; each context has its own views, so names do not clash."""

    GLOBALS: dict[str, Frame] = {}

    def __init__(self, spark: SparkSession, frames: dict[str, Frame] | None = None):
        self.spark, self.frames, self.prefix = spark, dict(frames or {}), f"lf_{uuid.uuid4().hex[:8]}_"
        spark.udf.register("normalize", lambda text, form="NFC": None if text is None else unicodedata.normalize(form, text), "string")

    def register(self, name: str, frame: Frame) -> SQLContext:
        self.frames[name] = frame
        return self

    def register_many(self, frames: dict[str, Frame]) -> SQLContext:
        self.frames.update(frames)
        return self

    def register_globals(self) -> SQLContext: return self.register_many(self.GLOBALS)
    def unregister(self, *names: str) -> None:
        for n in names:
            self.frames.pop(n, None)

    def tables(self) -> list[str]: return sorted(self.frames)

    def execute(self, query: str) -> Frame:
        q = query.strip().rstrip(";")
        if re.fullmatch(r"SHOW\s+TABLES", q, re.I):
            return Frame(self.spark.createDataFrame([(t,) for t in self.tables()], "name string"))
        if m := re.fullmatch(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", q, re.I | re.S):
            f = self.frames[m[1]]
            df = f.df.where(f"NOT coalesce({self._translate(m[2])}, false)") if m[2] else f.df.limit(0)
            self.frames[m[1]] = f._new(df)
            return self.frames[m[1]]
        if m := re.fullmatch(r"TRUNCATE\s+(?:TABLE\s+)?(\w+)", q, re.I):
            self.frames[m[1]] = self.frames[m[1]].clear()
            return self.frames[m[1]]
        if m := re.fullmatch(r"DROP\s+TABLE\s+(\w+)", q, re.I):
            self.unregister(m[1])
            return self.execute("SHOW TABLES")
        return Frame(self._run(self._translate(q)))

    def _translate(self, q: str) -> str:
        def read(kind: str, path: str) -> str:
            name = f"{self.prefix}file_{uuid.uuid4().hex[:8]}"
            getattr(io, f"scan_{kind}")(self.spark, path).to_spark().createOrReplaceTempView(name)
            return name

        from .sources import io  # reads frames, which offer SQL themselves

        return Translator(lambda query, star: self._run(query.strip()).columns, read).translate(q)

    def _run(self, q: str):
        """Names become views of this context for the analysis of one query."""
        names = {}
        for n, f in self.frames.items():
            if re.search(rf"\b{re.escape(n)}\b", q):
                f.to_spark().createOrReplaceTempView(self.prefix + n)
                names[n] = self.prefix + n
        ctes = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in names.items())
        if not ctes:
            return self.spark.sql(q)
        if m := re.match(r"(EXPLAIN\s+)(.*)", q, re.I | re.S):
            return self.spark.sql(f"{m[1]} WITH {ctes} {m[2]}")
        if m := re.match(r"WITH\s+(RECURSIVE\s+)?(.*)", q, re.I | re.S):
            return self.spark.sql(f"WITH {m[1] or ''}{ctes}, {m[2]}")
        return self.spark.sql(f"WITH {ctes} {q}")
