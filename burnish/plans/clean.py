"""clean(): rename, detect, clean."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import blank_to_null
from ..operators.base import BaseCleaner
from ..operators.country import CountryCleaner
from ..operators.frame import rename_cols as renamed
from ..operators.naming import ColRenamer
from ..operators.phone import PhoneCleaner
from ..operators.text import EmailCleaner, TextCleaner
from ..operators.times import DateTimeCleaner
from ..operators.values import BoolCleaner, GenderCleaner, NumericCleaner, UuidCleaner
from ..sources.wrap import wrap
from .detect import assign


def default_cleaners() -> list[BaseCleaner]:
    """All nine, in the order that ties are decided by."""
    return [EmailCleaner(), PhoneCleaner(), GenderCleaner(), BoolCleaner(), DateTimeCleaner(), CountryCleaner(), UuidCleaner(), NumericCleaner(), TextCleaner()]


@dataclass
class CleanConfig:
    """What clean() uses unless told otherwise."""

    col_renamer: ColRenamer = field(default_factory=lambda: ColRenamer("snake"))
    ignore_cols: list[str] = field(default_factory=list)
    cleaners: list[BaseCleaner] = field(default_factory=default_cleaners)
    inplace: bool = False


#: The configuration of the process.
config = CleanConfig()


@dataclass(frozen=True)
class CleanPlan:
    """What a call of clean() is going to do; nothing has run but a bounded sample."""

    names: dict[str, str]
    assigned: dict[str, tuple[BaseCleaner, float]]
    inplace: bool

    def outputs(self, df: DataFrame) -> dict[str, Column]:
        kinds = {f.name: f.dataType for f in df.schema}
        out: dict[str, Column] = {}
        for c, (cleaner, _) in self.assigned.items():
            source = F.col(f"`{c}`")
            if isinstance(kinds[c], T.StringType) or not cleaner.reads_raw():
                text = blank_to_null(source.cast("string"))
                made = cleaner.expressions(text, text=True)
            else:
                made = cleaner.expressions(source)
            for component, expression in made.items():
                stem = f"{c}_{component}" if component else c
                out[stem if self.inplace else f"{stem}_cleaned"] = expression
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        df = renamed(df, self.names)
        out = self.outputs(df)
        taken = sorted(set(out) & set(df.columns) - (set(self.assigned) if self.inplace else set()))
        if taken:
            raise ValueError(f"there are columns called {', '.join(taken)} already")
        df = df.withColumns(out) if out else df
        gone = [c for c in self.assigned if self.inplace and c not in out]
        return df.drop(*gone)


def plan(
    df: DataFrame,
    *,
    rename_cols: bool = True,
    rename_col_map: Mapping[str, str] | None = None,
    clean_cols: bool = True,
    cleaners: Mapping[str, BaseCleaner] | None = None,
    ignore_cols: Iterable[str] | None = None,
    use_global_config: bool = True,
    inplace: bool | None = None,
    col_renamer: ColRenamer | None = None,
    logger: logging.Logger | None = None,
) -> CleanPlan:
    """What clean() would do with these arguments."""
    log = logger or logging.getLogger("burnish")
    settings = config if use_global_config else CleanConfig(cleaners=default_cleaners())
    names: dict[str, str] = {}
    if rename_cols:
        given = dict(rename_col_map or {})
        names = (col_renamer or settings.col_renamer).rename_cols(c for c in df.columns if c not in given)
        names |= {old: new for old, new in given.items() if old in df.columns}
        log.debug("renamed %d of %d columns", len(names), len(df.columns))
    after = renamed(df, names)
    old = dict(zip(after.columns, df.columns, strict=True))
    assigned: dict[str, tuple[BaseCleaner, float]] = {}
    if clean_cols:
        explicit = dict(cleaners or {})
        unknown = sorted(set(explicit) - set(after.columns))
        if unknown:
            raise ValueError(f"no columns called {', '.join(unknown)}")
        ignored = {*(ignore_cols or ()), *settings.ignore_cols}
        searched = [c for c in after.columns if c not in explicit and c not in ignored and old[c] not in ignored]
        found = assign(after, searched, settings.cleaners)
        for c in after.columns:
            if c in explicit:
                assigned[c] = (explicit[c], 1.0)
            elif c in found and found[c][0] is not None:
                assigned[c] = found[c]
            elif c in found:
                log.warning("no cleaner fits column %s; it stays as it is", c)
    return CleanPlan(names, assigned, settings.inplace if inplace is None else inplace)


def clean(df: object, **options: object) -> DataFrame:
    """Rename columns to one convention, find each column's cleaner, append what it
    makes as <column>_cleaned (or <column>_<component>_cleaned).

    df: a Spark DataFrame, batch or streaming, or a pandas one. options: as for plan().
    Names in `cleaners` are names after renaming; `ignore_cols` are not cleaned, by
    either name. inplace=True replaces the columns instead. Values are stripped first,
    and blank ones count as null. Lazy but for one bounded sample.
    """
    frame = wrap(df)
    return plan(frame, **options).apply(frame)
