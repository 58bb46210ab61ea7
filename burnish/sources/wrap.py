"""What clean() accepts, files and tables."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def supports(df: object) -> bool:
    """Whether df is a Spark DataFrame, classic or Connect."""
    if isinstance(df, DataFrame):
        return True
    try:
        from pyspark.sql.connect.dataframe import DataFrame as Connect
    except Exception:  # Connect needs packages that may be missing
        return False
    return isinstance(df, Connect)


def wrap(df: object, spark: SparkSession | None = None) -> DataFrame:
    if supports(df):
        return df
    if isinstance(df, pd.DataFrame):
        session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        plain = df.astype(object).where(df.notna(), None)
        kinds = [T.StructField(str(c), _kind(df[c])) for c in df.columns]
        return session.createDataFrame(plain.values.tolist(), T.StructType(kinds))
    raise TypeError(f"clean() takes Spark and pandas DataFrames, not {type(df).__name__}")


def _kind(series: pd.Series) -> T.DataType:
    if pd.api.types.is_bool_dtype(series):
        return T.BooleanType()
    if pd.api.types.is_integer_dtype(series):
        return T.LongType()
    if pd.api.types.is_float_dtype(series):
        return T.DoubleType()
    if pd.api.types.is_datetime64_any_dtype(series):
        return T.TimestampNTZType()
    return T.StringType()


def without_na(df: DataFrame, tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Texts that stand for a missing value as nulls, in all string columns."""
    held = tuple(tokens)
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*held), F.col(f"`{c}`")) for c in strings})


def read_csv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Columns as strings, missing values as nulls."""
    return without_na(spark.read.csv(path, header=True, quote='"', escape='"', **options))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def target_name(source: str, destination: str) -> str:
    """The destination with * as the source's own table name."""
    return destination.replace("*", source.rsplit(".", 1)[-1])


def clean_table(spark: SparkSession, source: str, destination: str, **options: object) -> str:
    """Clean a catalog table into another; returns its name."""
    from ..plans.clean import clean

    name = target_name(source, destination)
    out = clean(spark.table(source), **options)
    try:
        out.writeTo(name).createOrReplace()
    except Exception as e:  # the session catalog can't replace tables atomically
        if "REPLACE TABLE" not in str(e) and "UNSUPPORTED" not in str(e) and "not support" not in str(e):
            raise
        out.write.mode("overwrite").saveAsTable(name)
    return name
