"""Logical types (str, bool, int, float, double) and Spark's."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK = {"str": T.StringType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType()}


def spark_type(logical: str) -> T.DataType:
    if logical not in SPARK:
        raise ValueError(f"no such logical type: {logical!r}; there are {', '.join(SPARK)}")
    return SPARK[logical]


def logical_type(kind: T.DataType) -> str:
    """The logical type of a column; what has none of its own counts as str."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, T.FloatType):
        return "float"
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return "double"
    return "str"
