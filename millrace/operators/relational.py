"""Relational helpers: orders with high nulls, set operations by count, ranked frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(name: str) -> Column:
    """Ascending, nulls last: nulls sort high."""
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    """Descending, nulls first."""
    return F.col(name).desc_nulls_first()


def top_k(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """The k rows after the offset; a heap in each task, not a full sort."""
    return df.orderBy(*order).offset(offset).limit(k)


def except_by_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that occur more often on the left than on the right."""
    return left.exceptAll(right).distinct()


def broadcast_if_small(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast only if the optimizer's estimate of its size is under the limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit_bytes else df
