"""Several cleaning steps as one object, with expressions over several columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import BaseCleaner
from ..operators.frame import rename_cols
from ..operators.naming import ColRenamer
from .detect import assign


class PipelineConfigError(ValueError):
    """Steps that need each other, or columns that nobody makes."""


@dataclass(frozen=True)
class GroupCleaner:
    """m columns from n: roles name the inputs, `make` gives {output: Column}."""

    roles: tuple[str, ...]
    make: Callable[[Mapping[str, Column]], Mapping[str, Column]]
    outputs: tuple[str, ...]


def address(parts: tuple[str, ...], output: str = "address") -> GroupCleaner:
    """One line from address columns; blank parts are left out."""
    return GroupCleaner(parts, lambda c: {output: F.nullif(F.concat_ws(", ", *[F.nullif(F.btrim(c[p]), F.lit("")) for p in parts]), F.lit(""))}, (output,))


@dataclass
class Pipeline:
    """steps: {output: (column, cleaner)}; groups run as soon as their inputs exist.
    Steps are ordered into waves, each one projection; a cycle is an error."""

    steps: Mapping[str, tuple[str, BaseCleaner]] = field(default_factory=dict)
    groups: tuple[GroupCleaner, ...] = ()
    renamer: ColRenamer | None = None
    detect_with: tuple[BaseCleaner, ...] = ()

    def waves(self, columns: list[str]) -> list[list[object]]:
        open_: list[tuple[set[str], set[str], object]] = [({c}, {out}, (out, c, k)) for out, (c, k) in self.steps.items()]
        open_ += [(set(g.roles), set(g.outputs), g) for g in self.groups]
        there, waves = set(columns), []
        while open_:
            ready = [x for x in open_ if x[0] <= there]
            if not ready:
                raise PipelineConfigError(f"nothing makes {', '.join(sorted(set.union(*(x[0] for x in open_)) - there))}")
            waves.append([x[2] for x in ready])
            open_ = [x for x in open_ if x not in ready]
            there = there.union(*(x[1] for x in ready))
        return waves

    def fit_transform(self, df: DataFrame) -> DataFrame:
        if self.renamer:
            df = rename_cols(df, self.renamer.rename_cols(df.columns))
        if self.detect_with:
            free = [c for c in df.columns if c not in {c for c, _ in self.steps.values()}]
            found = {f"{c}_cleaned": (c, k) for c, (k, s) in assign(df, free, self.detect_with).items() if k is not None}
            return Pipeline({**found, **self.steps}, self.groups).fit_transform(df)
        for wave in self.waves(df.columns):
            out: dict[str, Column] = {}
            for step in wave:
                if isinstance(step, GroupCleaner):
                    out |= step.make({r: F.col(f"`{r}`") for r in step.roles})
                else:
                    name, column, cleaner = step
                    made = cleaner.expressions(F.col(f"`{column}`"))
                    out |= {f"{name}_{k}" if k else name: v for k, v in made.items()}
            df = df.withColumns(out)
        return df
