"""The dataflow primitives under cleaning. All are functions of a DataFrame to a new
one; none runs a job but `profile` and `for_each`."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import logical_type, spark_type


@dataclass(frozen=True)
class DataReader:
    """A function of the values of `read_cols`, called for its effects on the workers."""

    fn: Callable
    read_cols: tuple[str, ...]


@dataclass(frozen=True)
class DataWriter:
    """What writes columns: a literal, a Column, or a Python function of values.

    write_cols: (name, logical type) of each output. A function with several outputs
    returns a tuple, or None for nulls in all of them."""

    expr: Callable | Column | str | bool | int | float | None
    read_cols: tuple[str, ...]
    write_cols: tuple[tuple[str, str], ...]


def cols(df: DataFrame) -> tuple[tuple[str, str], ...]:
    return tuple((f.name, logical_type(f.dataType)) for f in df.schema)


def col_names(df: DataFrame) -> list[str]:
    return df.columns


def rename_cols(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """All at once, by exact name; unknown names are ignored. Two columns of one name
    are an error, since nobody could tell them apart afterwards."""
    new = [names.get(c, c) for c in df.columns]
    twice = sorted({n for n in new if new.count(n) > 1} - {c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise ValueError(f"several columns would be called {', '.join(twice)}")
    return df.toDF(*new)


def write_cols(df: DataFrame, writers: Iterable[DataWriter]) -> DataFrame:
    """In order: a later writer sees what an earlier one wrote. Written columns that
    exist keep their places. Writers that don't read each other share one projection."""
    pending: dict[str, Column] = {}
    for writer in writers:
        if not writer.write_cols:
            continue
        if pending and (_reads(writer) is None or _reads(writer) & set(pending)):
            df, pending = df.withColumns(pending), {}
        pending |= _written(writer)
    return df.withColumns(pending) if pending else df


def _reads(writer: DataWriter) -> set[str] | None:
    """Columns that a writer reads; None if a free expression may read any."""
    return None if isinstance(writer.expr, Column) else set(writer.read_cols) if callable(writer.expr) else set()


def _written(writer: DataWriter) -> dict[str, Column]:
    outs = [(name, spark_type(kind)) for name, kind in writer.write_cols]
    if isinstance(writer.expr, Column):
        if len(outs) == 1:
            return {outs[0][0]: writer.expr.cast(outs[0][1])}
        return {name: writer.expr[k].cast(kind) for k, (name, kind) in enumerate(outs)}
    if not callable(writer.expr):
        return {name: F.lit(writer.expr).cast(kind) for name, kind in outs}
    made = _vectorised(writer.expr, [kind for _, kind in outs])(*[F.col(f"`{c}`") for c in writer.read_cols])
    if len(outs) == 1:
        return {outs[0][0]: made}
    return {name: made[f"c{k}"] for k, (name, _) in enumerate(outs)}


def _vectorised(fn: Callable, kinds: Sequence[T.DataType]) -> Callable:
    """A Python function of values as a pandas UDF; Arrow carries whole batches."""
    if len(kinds) == 1:

        @F.pandas_udf(kinds[0])
        def one(*series: pd.Series) -> pd.Series:
            return pd.Series([fn(*v) for v in zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)], dtype=object)

        return one

    names = [f"c{k}" for k in range(len(kinds))]

    @F.pandas_udf(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    def many(*series: pd.Series) -> pd.DataFrame:
        rows = [fn(*v) for v in zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)]
        return pd.DataFrame([r if r is not None else (None,) * len(names) for r in rows], columns=names, dtype=object)

    return many


def remove_cols(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def cast_cols(df: DataFrame, kinds: Mapping[str, str], safe: bool = False) -> DataFrame:
    """Cast to logical types. safe: what can't be cast becomes null instead of an error."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(spark_type(k)) if safe else F.col(f"`{c}`").cast(spark_type(k)) for c, k in kinds.items()})


def profile(df: DataFrame, names: Sequence[str], rows: int = 100) -> list[Row]:
    """The first rows of some columns; the scan stops there."""
    return df.select(*[F.col(f"`{c}`") for c in names]).limit(rows).collect()


def for_each(df: DataFrame, readers: Iterable[DataReader]) -> None:
    """Call readers on every row, on the workers. Nothing comes back to the driver."""
    for reader in readers:
        if reader.read_cols:
            fn, names = reader.fn, reader.read_cols

            def run(rows, fn=fn) -> None:
                for row in rows:
                    fn(*row)

            df.select(*[F.col(f"`{c}`") for c in names]).foreachPartition(run)
