"""What a cleaner is."""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import spark_type

#: Share of an answer's confidence that a name or a value sample can reach.
SURE = 1.0


@dataclass(frozen=True, kw_only=True)
class BaseCleaner:
    """A cleaner is a pure column expression with options.

    Subclasses give `schema` and `parts`; both follow the options. A value that can't
    be cleaned becomes null and never an error.
    """

    inplace: bool = True
    split_components: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value, wanted = getattr(self, f.name), type(f.default)
            if wanted is bool or issubclass(wanted, Enum) and f.name != "in_format":
                if not isinstance(value, wanted):
                    raise TypeError(f"{type(self).__name__}.{f.name} takes {wanted.__name__}, not {value!r}")
        self.check()

    def check(self) -> None:
        """Further checks of the options."""

    @classmethod
    def name(cls) -> str:
        return cls.__name__

    def schema(self) -> str | tuple[tuple[str, str], ...]:
        return "str"


    def output_schema(self) -> str | tuple[tuple[str, str], ...]:
        return self.schema()

    def components(self) -> tuple[tuple[str, str], ...]:
        """(component, type) in order; one without a name for a single output."""
        kind = self.schema()
        return (("", kind),) if isinstance(kind, str) else kind

    def parts(self, c: Column) -> tuple[Column, ...]:
        """One column for each component, from a string column."""
        raise NotImplementedError

    def expressions(self, c: Column, text: bool = False) -> dict[str, Column]:
        """{component: column}, typed. text: c is a string column already."""
        source = c if text or self.reads_raw() else c.cast("string")
        return {k: v.cast(spark_type(t)) for (k, t), v in zip(self.components(), self.parts(source), strict=True)}

    def clean_expr(self, c: Column | str) -> Column:
        """The single output, or a struct of the components."""
        made = self.expressions(F.col(c) if isinstance(c, str) else c)
        return made[""] if "" in made else F.struct(*[v.alias(k) for k, v in made.items()])

    def reads_raw(self) -> bool:
        """Whether the expression is made for the column as it is, not as a string."""
        return False

    def clean_value(self, value: object) -> object:
        """One value, by the same expression. For tests and trials, not for data."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if value is not None and not isinstance(value, str):
            value = None if not self.takes_any() else str(value)
        row = spark.createDataFrame([(value,)], "v string").select(self.clean_expr("v").alias("v")).first()
        return tuple(row.v) if row.v is not None and hasattr(row.v, "__fields__") else row.v

    def takes_any(self) -> bool:
        return True

    def name_score(self, column: str) -> float:
        """How sure the column's name alone makes us, from 0 to 1."""
        return 0.0

    #: Non-null values looked at by value_score; none for cleaners that go by name.
    sample: int = 0

    def value_score(self, name: float, cleaned: int, seen: int) -> float:
        """The score with `cleaned` of `seen` sampled values recognised."""
        return name

    def recognises(self, c: Column) -> Column:
        """Whether a sampled value is one of this kind."""
        return self.clean_expr(c).isNotNull()

    def get_data_type_confidence(self, df: DataFrame, columns: tuple[str, ...]) -> float:
        """The score for one column of df, names first, then a bounded sample."""
        from ..plans.detect import scores

        return scores(df, columns[:1], [self])[columns[0]][0] if columns else 0.0


def named(column: str, words: tuple[str, ...]) -> float:
    return SURE if any(w in column.lower() for w in words) else 0.0
