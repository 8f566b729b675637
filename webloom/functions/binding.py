"""Keep long expressions small: evaluate a value once and use it by name.

Catalyst replaces a column by its defining expression when it moves filters or merges
projections; a long text expression used in several places is then repeated, level by level.
``let`` binds a value inside one expression, ``pin`` puts a generator between two steps of a
DataFrame, which neither filters nor projections are moved through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """``let`` with a SQL body over the name ``v``; short to build for long expressions."""
    bound = F.call_function("transform", F.array(value), F.expr(f"v -> {body}"))
    return F.get(bound, F.lit(0))


def sql_text(text: str) -> str:
    """A Python string as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns``, but later steps see the result only."""
    kept = [c for c in df.columns if c not in columns]
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))
