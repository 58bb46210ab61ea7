"""Countries."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.countries import countries
from .base import BaseCleaner, named


class CountryFormat(str, Enum):
    AUTO = "auto"
    NAME = "name"
    ALPHA2 = "alpha2"
    ALPHA3 = "alpha3"


#: Letters of a partial name, at least.
LEAST = 4
ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _table(pairs: dict[str, str]) -> Column:
    """A literal map; Catalyst folds it into one object."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


@dataclass(frozen=True, kw_only=True)
class CountryCleaner(BaseCleaner):
    """Countries by code or name. in_format: one format, a tuple tried in order, or
    AUTO for alpha-2, alpha-3, then name. A name is looked up whole, then as a part of
    a name, where an earlier place and then the smaller alpha-2 code win."""

    Format: ClassVar = CountryFormat

    in_format: CountryFormat | tuple[CountryFormat, ...] = CountryFormat.AUTO
    out_format: CountryFormat = CountryFormat.NAME
    #: Whether parts of names are looked up too.
    partial_names: bool = True

    def check(self) -> None:
        if self.out_format is CountryFormat.AUTO:
            raise ValueError("AUTO isn't a format of results")
        if not all(isinstance(f, CountryFormat) for f in (self.in_format if isinstance(self.in_format, tuple) else (self.in_format,))):
            raise TypeError("in_format takes a CountryFormat or a tuple of them")

    def steps(self) -> tuple[CountryFormat, ...]:
        every = (CountryFormat.ALPHA2, CountryFormat.ALPHA3, CountryFormat.NAME)
        asked = self.in_format if isinstance(self.in_format, tuple) else (self.in_format,)
        return tuple(dict.fromkeys(s for f in asked for s in (every if f is CountryFormat.AUTO else (f,))))

    def parts(self, c: Column) -> tuple[Column]:
        rows = countries()
        out = {CountryFormat.NAME: 2, CountryFormat.ALPHA2: 0, CountryFormat.ALPHA3: 1}[self.out_format]
        found = []
        for step in self.steps():
            if step is not CountryFormat.NAME:
                at = 0 if step is CountryFormat.ALPHA2 else 1
                found.append(F.try_element_at(_table({r[at]: r[out] for r in rows}), F.upper(c)))
                continue
            name = F.btrim(F.translate(F.lower(c), ACCENTED, PLAIN))
            found.append(F.try_element_at(_table({n: r[out] for r in reversed(rows) for n in r[3]}), name))
            if not self.partial_names:
                continue
            listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r[0]).alias("two"), F.lit(r[out]).alias("out")) for r in rows for n in r[3]])
            places = F.transform(listed, lambda x: F.struct(F.position(name, x["n"]).alias("at"), x["two"].alias("two"), x["out"].alias("out")))  # noqa: B023
            partly = F.array_min(F.filter(places, lambda x: x["at"] > 0))["out"]
            found.append(F.when(F.length(name) >= LEAST, partly))
        return (F.coalesce(*found),)

    def name_score(self, column: str) -> float:
        return named(column, ("country",))
