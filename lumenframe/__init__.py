"""Lumenframe: an analytics engine on PySpark with frames, series, expressions and SQL."""

from .expr import Expr, all_, col, cols, count, exclude, fold, lit, struct_cols, when
from .frame import Frame, GroupBy, LazyFrame
from .series import Series
from .session import get_session
from .sql import SQLContext

__all__ = ["Expr", "Frame", "GroupBy", "LazyFrame", "SQLContext", "Series", "all_", "col", "cols", "count", "exclude", "fold", "get_session", "lit", "struct_cols", "when"]
