"""Recursive UNION: a fixpoint with duplicates removed, which Spark SQL's WITH RECURSIVE does not offer."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

_dirs: list[str] = []


def _shared(spark) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _dirs:
        _dirs.append(tempfile.mkdtemp(prefix="millrace-"))
    return "file://" + _dirs[0]


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """All rows reachable from ``seed``: each round's new rows (by all columns, null equal to null) feed the next.

    Every round is written to the shared folder, so lineage does not grow; the round's
    new rows are found with a null-safe anti join against what was found before.
    """
    spark = seed.sparkSession
    root = f"{_shared(spark)}/fixpoint-{uuid.uuid4().hex}"
    schema, columns = seed.schema, seed.columns

    def save(df: DataFrame, i: int) -> DataFrame:
        df.write.parquet(f"{root}/{i}")
        return spark.read.schema(schema).parquet(f"{root}/{i}")

    work = save(seed.distinct(), 0)
    parts = [work]
    for i in range(1, max_rounds + 1):
        new = step(work).toDF(*columns)
        new = new.select(*[new[c].cast(schema[c].dataType).alias(c) for c in columns]).distinct().alias("n")
        seen = reduce(DataFrame.unionAll, parts).alias("s")
        same = reduce(lambda a, b: a & b, [new[f"n.{c}"].eqNullSafe(seen[f"s.{c}"]) for c in columns])
        work = save(new.join(seen, same, "left_anti"), i)
        if not work.limit(1).count():
            return reduce(DataFrame.unionAll, parts)
        parts.append(work)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def recursive_sql(spark, name: str, columns: list[str], seed_sql: str, step_sql: str, max_rounds: int = 10_000) -> DataFrame:
    """``WITH RECURSIVE name(columns) AS (seed UNION step)``: the step reads the last new rows under ``name``."""

    def step(work: DataFrame) -> DataFrame:
        work.createOrReplaceTempView(name)
        return spark.sql(step_sql)

    return fixpoint(spark.sql(seed_sql).toDF(*columns), step, max_rounds)
