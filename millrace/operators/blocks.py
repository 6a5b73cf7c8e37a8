"""Joins on keys with few values: the pairs of a key are dealt out in blocks, so that no task's share grows with the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the left side that a task keeps in memory for one key.
BLOCK = 1 << 12
#: Pairs that a task compares.
PAIRS = 1 << 24
#: Rows of small keys that share a task.
ROWS = 1 << 20
#: Beyond so many tasks, blocks share them evenly.
MAX_TASKS = 20_000


def blocked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], condition: str | Column) -> DataFrame:
    """``left`` JOIN ``right`` USING (``keys``) where ``condition`` holds: a sort-merge join in blocks.

    The number of pairs may grow with the square of the tables; the pairs of one task do not.  A key
    of more pairs is cut into blocks of its left and right rows; each left row goes to all right
    blocks and the other way round, so each pair meets in one task.  Sizes are counted first: the driver
    gets one row for each key that is cut, at most one in ``BLOCK`` rows.  Rows are dealt by ``rand`` with a
    seed, which a rerun repeats only where their order is fixed: take both sides from files, not from a shuffle.
    """
    spark, keys = left.sparkSession, list(keys)
    for k in keys:
        left, right = left.where(F.col(k).isNotNull()), right.where(F.col(k).isNotNull())

    cut, n_cut, few = _plan(left, right, keys)
    n = min(n_cut + few, MAX_TASKS)
    types = [left.schema[k].dataType for k in keys]
    schema = T.StructType([T.StructField(k, t) for k, t in zip(keys, types)] + [T.StructField(c, T.LongType()) for c in ("_lefts", "_rights", "_first")])
    cuts = F.broadcast(spark.createDataFrame(cut, schema))

    def deal(df: DataFrame, own: str, seed: int) -> DataFrame:
        df = df.join(cuts, keys, "left").withColumn("_own", F.floor(F.rand(seed) * F.col(own)))
        if own == "_lefts":
            blocks = F.transform(F.sequence(F.lit(0), F.col("_rights") - 1), lambda i: F.col("_first") + F.col("_own") * F.col("_rights") + i)
        else:
            blocks = F.transform(F.sequence(F.lit(0), F.col("_lefts") - 1), lambda i: F.col("_first") + i * F.col("_rights") + F.col("_own"))
        whole = F.array(n_cut + F.pmod(F.xxhash64(*keys), F.lit(few)))
        df = df.withColumn("_block", F.explode(F.when(F.col("_first").isNull(), whole).otherwise(blocks)))
        df = df.withColumn("_task", F.pmod("_block", F.lit(n)).cast("int")).drop("_lefts", "_rights", "_first", "_own")
        return df.repartitionById(n, "_task")

    # the right side streams, the left side's rows of a key are kept
    both = deal(right, "_rights", 2).join(deal(left, "_lefts", 1).hint("merge"), ["_task", "_block", *keys])
    return both.where(condition).drop("_task", "_block")


def _plan(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[list[tuple], int, int]:
    """Keys that are cut, with the number of their left and right blocks and that of the first; the number of all blocks; that of tasks for the other keys."""
    count = lambda df, l, r: df.select(*keys, F.lit(l).cast("long").alias("l"), F.lit(r).cast("long").alias("r"))
    sizes = count(left, 1, 0).unionAll(count(right, 0, 1)).groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    lefts = F.ceil(F.col("l") / F.when(F.col("r") > 0, BLOCK).otherwise(ROWS))
    rights = F.ceil(F.greatest(F.col("r") * (F.least(F.col("l"), F.lit(BLOCK)) / PAIRS), F.col("r") / ROWS))
    sizes = sizes.select("*", F.greatest(lefts, F.lit(1)).alias("lefts"), F.greatest(rights, F.lit(1)).alias("rights"))
    key = F.when(F.col("lefts") * F.col("rights") > 1, F.struct(*keys)).alias("key")
    parts = sizes.groupBy(key).agg(F.max("lefts"), F.max("rights"), F.sum(F.col("l").cast("double") * F.col("r")), F.sum(F.col("l") + F.col("r"))).collect()
    cut, n_cut, few = [], 0, 1
    for key, lefts, rights, pairs, rows in parts:
        if key is None:
            few = int(max(-(-4 * pairs // PAIRS), -(-rows // ROWS), 1))
        else:
            cut.append((*key, lefts, rights, n_cut))
            n_cut += lefts * rights
    return cut, n_cut, few
