"""Which cleaner fits which column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import BaseCleaner
from ..operators.text import TextCleaner

#: Rows looked at for all columns at once; a column with too few values among them
#: is looked at once more by itself.
HEAD = 1000


def _own(c: BaseCleaner, column: str, kind: T.DataType) -> float:
    """The score by name. Free text is never written from columns that aren't text."""
    if isinstance(c, TextCleaner) and not isinstance(kind, T.StringType):
        return 0.0
    return min(1.0, max(0.0, c.name_score(column)))


def scores(df: DataFrame, columns: Sequence[str], cleaners: Sequence[BaseCleaner]) -> dict[str, list[float]]:
    """Each cleaner's score for each column: by name, and for cleaners that sample, by
    the first non-null values. One bounded job serves all columns that need it."""
    kinds = {f.name: f.dataType for f in df.schema}
    simple = {c for c in columns if not isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
    found = {c: [_own(k, c, kinds[c]) if c in simple else 0.0 for k in cleaners] for c in columns}
    if df.isStreaming:
        return found
    wanted: dict[str, list[int]] = {}
    for c in columns:
        for k, cleaner in enumerate(cleaners):
            if found[c][k] == 1.0:
                break  # this one is taken, whatever the rest would score
            if cleaner.sample and c in simple:
                wanted.setdefault(c, []).append(k)
    if not wanted:
        return found
    head = df.select(*[F.col(f"`{c}`") for c in wanted]).limit(HEAD).collect()
    values = {c: [r[i] for r in head if r[i] is not None] for i, c in enumerate(wanted)}
    most = {c: max(cleaners[k].sample for k in ks) for c, ks in wanted.items()}
    for c in wanted:
        if len(values[c]) < most[c] and len(head) == HEAD:
            values[c] = [r[0] for r in df.select(F.col(f"`{c}`")).where(F.col(f"`{c}`").isNotNull()).limit(most[c]).collect()]
    # The samples (at most 100 values a column) are judged by the cleaners' own expressions.
    spark = df.sparkSession
    rows = [(i, n, str(v).lower() if isinstance(v, bool) else str(v)) for i, c in enumerate(wanted) for n, v in enumerate(values[c][: most[c]])]
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    used = sorted({k for ks in wanted.values() for k in ks})
    if rows:
        sample = spark.createDataFrame(rows, "i int, n int, v string").coalesce(1)
        # UUIDs are looked for in the first rows, numbers in the first values; both are bounded by `sample`.
        hits = [F.sum(F.when((F.col("n") < cleaners[k].sample) & cleaners[k].recognises(F.col("v")), 1).otherwise(0)).alias(f"h{k}") for k in used]
        counts = [F.sum(F.when(F.col("n") < cleaners[k].sample, 1).otherwise(0)).alias(f"s{k}") for k in used]
        for r in sample.groupBy("i").agg(*hits, *counts).collect():
            for k in used:
                seen[r["i"], k] = (r[f"h{k}"], r[f"s{k}"])
    for i, (c, ks) in enumerate(wanted.items()):
        for k in ks:
            found[c][k] = min(1.0, max(0.0, cleaners[k].value_score(found[c][k], *seen.get((i, k), (0, 0)))))
    return found


def assign(df: DataFrame, columns: Sequence[str], cleaners: Sequence[BaseCleaner]) -> dict[str, tuple[BaseCleaner | None, float]]:
    """The best cleaner of each column and its score: the first with the highest, and
    the first that is sure ends the search. (None, 0) if none fits."""
    out: dict[str, tuple[BaseCleaner | None, float]] = {}
    for c, found in scores(df, columns, cleaners).items():
        best: tuple[BaseCleaner | None, float] = (None, 0.0)
        for cleaner, score in zip(cleaners, found, strict=True):
            if score > best[1]:
                best = (cleaner, score)
            if score == 1.0:
                break
        out[c] = best
    return out
