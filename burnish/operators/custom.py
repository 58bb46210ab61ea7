"""Cleaners from users' Python functions, for what column expressions can't say."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.types import spark_type
from .base import BaseCleaner
from .frame import _vectorised


@dataclass(frozen=True, kw_only=True)
class PythonCleaner(BaseCleaner):
    """fn(value) -> value, or a tuple for several components. Runs as a pandas UDF, so
    it is slower than a column expression; score(name) says how well a column fits."""

    fn: Callable = lambda value: value
    kinds: str | tuple[tuple[str, str], ...] = "str"
    score: Callable = lambda column: 0.0
    label: str = "PythonCleaner"

    def schema(self) -> str | tuple[tuple[str, str], ...]:
        return self.kinds

    def parts(self, c: Column) -> tuple[Column, ...]:
        types = [spark_type(kind) for _, kind in self.components()]
        fn = self.fn
        made = _vectorised(lambda value: None if value is None else fn(value), types)(c)
        return (made,) if len(types) == 1 else tuple(made[f"c{k}"] for k in range(len(types)))

    def name_score(self, column: str) -> float:
        return self.score(column)
