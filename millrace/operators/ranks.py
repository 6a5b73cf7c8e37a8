"""Window functions whose partitions are few: no task holds a partition whole."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task sorts.
ROWS = 1 << 19
#: A table of values is broadcast up to so many rows, else joined by a shuffle.
FEW = 1 << 17


def row_numbers(df: DataFrame, group: Sequence[str], lead: Sequence[str], key: str, orders: Mapping[str, Sequence[Column]]) -> DataFrame:
    """``df`` with a column for each of ``orders``: row_number() OVER (PARTITION BY ``group`` ORDER BY the order, ``key`` ASC NULLS LAST).

    Each order is made of the columns ``lead``, which have few values; ``key`` is a number with many.  Rows are cut
    into ranges of the key, and all orders share one sort of each range: a row's number is its place among the
    range's rows of its group and lead, and the count of all rows in ranges or leads before.  Rows of one key
    value share a task, which spills if they are many.
    """
    columns, cell = df.columns, ["_range", *group, *lead]
    bounds = _bounds(df, key)
    df = _with_range(df, key, bounds)
    counts = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = {name: Window.partitionBy(*group).orderBy(*order, "_range").rowsBetween(Window.unboundedPreceding, -1) for name, order in orders.items()}
    counts = counts.select(*cell, *[F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_{name}") for name, w in before.items()])
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(key).asc_nulls_last()))
    out = join_values(df.repartitionById(len(bounds) + 1, "_range").withColumn("_row", local), counts, cell)
    return out.select(*columns, *[(F.col("_row") + F.col(f"_{name}")).cast("int").alias(name) for name in orders])


def join_values(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its row in ``table``, which has a row for all values of ``keys`` in ``df``; null equals null."""
    got = table.limit(FEW + 1).collect()
    if len(got) <= FEW:
        table = F.broadcast(df.sparkSession.createDataFrame(got, table.schema))
    table = table.select(*[F.col(c).alias(f"_of{c}" if c in keys else c) for c in table.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in keys])
    return df.join(table, same).drop(*[f"_of{c}" for c in keys])


def _bounds(df: DataFrame, key: str) -> list[float]:
    """Bounds of about equal ranges of the key, from a sketch of all rows; they need not be exact."""
    parts = math.ceil(df.count() / ROWS)
    if parts < 2:
        return []
    return sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts))))


def _with_range(df: DataFrame, key: str, bounds: list[float]) -> DataFrame:
    """``_range``: how many bounds lie below the key, found by halving; null keys are in the last range."""
    step = 1 << len(bounds).bit_length()
    table = F.array(*[F.lit(b) for b in bounds + [math.inf] * (step - len(bounds))])
    df = df.withColumn("_range", F.lit(0))
    while step := step // 2:
        df = df.withColumn("_range", F.when(F.get(table, F.col("_range") + (step - 1)) < F.col(key).cast("double"), F.col("_range") + step).otherwise(F.col("_range")))
    last = F.lit(len(bounds))
    return df.withColumn("_range", F.when(F.col(key).isNull(), last).otherwise(F.least("_range", last)))
