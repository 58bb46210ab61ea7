"""Cleaners as SQL functions. Catalyst inlines them; no Python runs on the data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import inlined
from ..functions.types import spark_type
from ..operators.base import BaseCleaner
from ..operators.country import CountryCleaner


def register(spark: SparkSession, name: str, cleaner: BaseCleaner) -> str:
    """CREATE TEMPORARY FUNCTION name(v STRING) from a cleaner's single output. SQL text
    can't hold the search for parts of country names, so whole names are looked up."""
    if isinstance(cleaner, CountryCleaner):
        cleaner = replace(cleaner, partial_names=False)
    kind = spark_type(cleaner.components()[0][1]).simpleString()
    if len(cleaner.components()) > 1:
        raise ValueError("only cleaners with a single output can be SQL functions")
    body = _sql(spark, cleaner)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")
    return name


def _sql(spark: SparkSession, cleaner: BaseCleaner) -> str:
    """The expression over v as SQL text, from the analysed plan."""
    with inlined():
        frame = spark.createDataFrame([], "v string").select(cleaner.clean_expr(F.col("v")).alias("out"))
    analysed = frame._jdf.queryExecution().analyzed()
    expression = analysed.projectList().head().child()
    return expression.sql()


def register_all(spark: SparkSession, prefix: str = "clean_") -> list[str]:
    """clean_email(v), clean_text(v), … for the default cleaners."""
    from ..plans.clean import default_cleaners

    return [register(spark, prefix + type(c).__name__.removesuffix("Cleaner").lower(), c) for c in default_cleaners()]
