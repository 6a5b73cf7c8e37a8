"""Set-based constraint checks; each is one job and raises ConstraintError."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError


def check_not_null(df: DataFrame, columns: list[str]) -> None:
    if columns:
        bad = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).limit(1).collect()
        if bad:
            raise ConstraintError(f"NOT NULL: one of {columns} is null in {bad[0]}")


def check_keys(new: DataFrame, key: list[str], what: str, rest: DataFrame | None = None) -> None:
    """No key twice among the new rows, nor in both new rows and the rest; rows with a null in the key are exempt."""
    if not key:
        return
    full = new.select(*key).dropna()
    twice = full.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).collect()
    if not twice and rest is not None:
        twice = full.join(rest.select(*key), key, "left_semi").limit(1).collect()
    if twice:
        raise ConstraintError(f"{what} {tuple(key)}: duplicate {tuple(twice[0])[: len(key)]}")


def check_foreign_keys(session, df: DataFrame, fks: list[dict], own=None) -> None:
    """Every key without nulls has its parent."""
    for f in fks:
        parent = (f["schema"], f["table"])
        if own and parent == own[0]:  # a table that refers to itself
            rows = df if own[1] is None else own[1].unionByName(df)
        else:
            rows = session.frame(parent)
        keys = rows.select(*[F.col(p).alias(c) for p, c in zip(f["parent_columns"], f["columns"])])
        missing = df.select(*f["columns"]).dropna().join(keys, f["columns"], "left_anti").limit(1).collect()
        if missing:
            raise ConstraintError(f"FOREIGN KEY {tuple(f['columns'])}: {tuple(missing[0])} is not in {'.'.join(parent)}")


def check_restrict(session, name: tuple[str, str], gone: DataFrame, stay: DataFrame) -> None:
    """No row elsewhere refers to a key that goes."""
    from .engine import children

    for child, f in children(session.catalog(), name):
        keys = f["parent_columns"]
        lost = gone.select(*keys).dropna().join(stay.select(*keys), keys, "left_anti")
        rows = stay if child == tuple(name) else session.frame(child)
        refs = rows.select(*[F.col(c).alias(p) for p, c in zip(keys, f["columns"])])
        held = lost.join(refs, keys, "left_semi").limit(1).collect()
        if held:
            raise ConstraintError(f"FOREIGN KEY: {'.'.join(child)} refers to {tuple(held[0])}")
