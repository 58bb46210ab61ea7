"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into the noop sink; the median
counts. `control` has the same work as a row-looped pandas UDF for some of them.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = (
    "text_default", "text_html", "text_digits_punct", "email_default", "email_split", "phone_documents", "num_float", "num_suffix", "bool_truefalse", "gender_full",
    "dt_iso_datetime", "uuid_standard", "country_name", "detect_assignments", "clean_e2e",
)


def control(df: DataFrame, column: str, fn) -> DataFrame:
    @F.pandas_udf("string")
    def looped(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in values])

    return df.select(looped(F.col(column).cast("string")))


def controls(spark: SparkSession) -> dict[str, DataFrame]:
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")

    def text(v: str) -> str:
        for pattern, by in ((r"<[^>]+>", " "), (r"https?://\S+|www\.\S+", ""), (r"\S+@\S+", ""), (r"[\x00-\x1f\x7f-\x9f]", " "), (r"\s+", " ")):
            v = re.sub(pattern, by, v)
        return v.strip().lower()

    def number(v: str) -> str:
        return str(round(float(re.sub(r"[^0-9.e+-]", "", v)), 3))

    return {
        "text_default": control(docs, "text", text),
        "email_default": control(docs, "text", lambda v: m[0].lower() if (m := mail.search(v)) else None),
        "num_float": control(lines, "l_extendedprice", number),
        "bool_truefalse": control(lines, "l_returnflag", lambda v: {"n": "false", "y": "true"}.get(v.lower())),
    }


def timed(make) -> float:
    took = []
    for _ in range(1 + RUNS):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took[1:]), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from burnish.plans.queries import QUERIES

    found = {name: timed(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in NAMES}
    against = {name: timed(lambda df=df: df) for name, df in controls(spark).items()}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "control": against, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
