"""DDL type names and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import EngineError

_SIMPLE = {
    "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "REAL": T.FloatType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "NVARCHAR": T.StringType(), "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(),
}
#: TIME has no column type without a flag: milliseconds of the day, tagged in the registry.
TIME = T.IntegerType()


def spark_type(name: str) -> T.DataType:
    """The Spark type of a DDL type such as ``DECIMAL(10, 2)``; lengths of strings are not enforced."""
    base, _, rest = name.upper().partition("(")
    base = " ".join(base.split())
    if base in ("DECIMAL", "NUMERIC"):
        p, _, s = rest.rstrip(") ").partition(",")
        return T.DecimalType(int(p or 10), int(s or 0))
    if base == "TIME":
        return TIME
    if base not in _SIMPLE:
        raise EngineError(f"unsupported column type: {name}")
    return _SIMPLE[base]
