"""Numbers, truth values, genders and UUIDs."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import WORD, WS, ascii_digits, first_match, looked_up
from .base import BaseCleaner, named


class NumberFormat(str, Enum):
    FLOAT = "float"
    INT = "int"


@dataclass(frozen=True, kw_only=True)
class NumericCleaner(BaseCleaner):
    """A number among currency signs, separators and words. precision: digits after the
    point, rounded half up; None leaves them. parse_suffixes: k, m, b, t multiply."""

    Format: ClassVar = NumberFormat

    out_format: NumberFormat = NumberFormat.FLOAT
    precision: int | None = 3
    parse_suffixes: bool = False
    sample: int = 100

    def check(self) -> None:
        if self.precision is not None and (not isinstance(self.precision, int) or self.precision < 0):
            raise ValueError("precision must be None, 0 or more")

    def schema(self) -> str:
        return self.out_format.value

    def parts(self, c: Column) -> tuple[Column]:
        text = F.lower(ascii_digits(c))
        factor = F.lit(1.0)
        if self.parse_suffixes:
            suffixed = rf"([0-9.\-e+]+){WS}*([kmbt])(?![{WORD}])"
            unit = F.regexp_extract(text, suffixed, 2)
            factor = first_match(*[(unit == u, F.lit(x)) for u, x in (("k", 1e3), ("m", 1e6), ("b", 1e9), ("t", 1e12))]).otherwise(1.0)
            # Separators are purged first where no suffix binds to the digits.
            text = F.when(unit != "", F.regexp_extract(text, suffixed, 1)).otherwise(text)
        digits = F.regexp_replace(text, r"[^0-9.\-e+]", "")
        whole = F.substring_index(digits, ".", 1)
        rest = F.replace(F.substring(digits, F.length(whole) + 2, F.length(digits)), F.lit("."), F.lit(""))
        one_dot = F.when(F.instr(digits, ".") > 0, F.concat(whole, F.lit("."), rest)).otherwise(digits)
        number = one_dot.try_cast("double") * factor
        number = F.when(F.abs(number) < float("inf"), number)  # neither infinite nor NaN
        if self.precision is not None:
            number = F.when(F.abs(number) < 1e22, F.round(number, self.precision)).otherwise(number)
        if self.out_format is NumberFormat.INT:
            number = F.when(F.abs(number) < 9.2e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
        return (number,)

    def name_score(self, column: str) -> float:
        return 0.3 * named(column, ("amount", "price", "count", "quantity", "revenue", "total"))

    def value_score(self, name: float, cleaned: int, seen: int) -> float:
        return min(1.0, name + (0.7 * cleaned / seen if seen else 0.0))


class TruthFormat(str, Enum):
    TRUEFALSE = "truefalse"
    BINARY = "binary"
    YESNO = "yesno"


@dataclass(frozen=True, kw_only=True)
class BoolCleaner(BaseCleaner):
    """Words for yes and no."""

    Format: ClassVar = TruthFormat

    out_format: TruthFormat = TruthFormat.TRUEFALSE

    #: The words of each answer.
    WORDS: ClassVar = {
        "yes": ("true", "1", "yes", "t", "y", "active"),
        "no": ("false", "0", "no", "f", "n", "inactive"),
    }
    ANSWERS: ClassVar = {
        TruthFormat.TRUEFALSE: {"yes": True, "no": False},
        TruthFormat.BINARY: {"yes": "1", "no": "0"},
        TruthFormat.YESNO: {"yes": "Yes", "no": "No"},
    }

    def schema(self) -> str:
        return "bool" if self.out_format is TruthFormat.TRUEFALSE else "str"

    def parts(self, c: Column) -> tuple[Column]:
        return (looked_up(c, self.WORDS, self.ANSWERS[self.out_format]),)

    def name_score(self, column: str) -> float:
        return named(column, ("is_", "has_", "active", "status", "flag"))


class GenderFormat(str, Enum):
    FULL = "full"
    CHAR = "char"
    BINARY = "binary"


@dataclass(frozen=True, kw_only=True)
class GenderCleaner(BaseCleaner):
    """Words for genders."""

    Format: ClassVar = GenderFormat

    out_format: GenderFormat = GenderFormat.FULL

    #: The words of each gender.
    WORDS: ClassVar = {
        "male": ("male", "m", "man", "boy"),
        "female": ("female", "f", "woman", "girl"),
        "other": ("other", "o", "non-binary"),
    }
    ANSWERS: ClassVar = {
        GenderFormat.FULL: {"male": "Male", "female": "Female", "other": "Other"},
        GenderFormat.CHAR: {"male": "M", "female": "F", "other": "O"},
        GenderFormat.BINARY: {"male": "1", "female": "0", "other": "-1"},
    }

    def parts(self, c: Column) -> tuple[Column]:
        return (looked_up(c, self.WORDS, self.ANSWERS[self.out_format]),)

    def name_score(self, column: str) -> float:
        return named(column, ("gender", "sex"))


class UuidFormat(str, Enum):
    STANDARD = "standard"
    COMPACT = "compact"
    URN = "urn"


@dataclass(frozen=True, kw_only=True)
class UuidCleaner(BaseCleaner):
    """UUIDs in any usual wrapping. allowed_versions: others become null."""

    Format: ClassVar = UuidFormat

    out_format: UuidFormat = UuidFormat.STANDARD
    allowed_versions: frozenset[int] | set[int] | None = None
    sample: int = 5

    def parts(self, c: Column) -> tuple[Column]:
        bare = F.regexp_replace(F.btrim(F.lower(c), F.lit("'\"{}()[]")), r"\Aurn:uuid:", "")
        plain = F.regexp_replace(F.regexp_replace(bare, "urn:|uuid:", ""), r"\A[{}]+|[{}]+\z|-", "")
        digits = F.regexp_replace(bare, "[^0-9a-f]", "")
        hex_ = F.when(plain.rlike(r"\A[0-9a-f]{32}\z"), plain).when(F.length(digits) == 32, digits)
        if self.allowed_versions is not None:
            version = F.when(F.substring(hex_, 17, 1).isin("8", "9", "a", "b"), F.conv(F.substring(hex_, 13, 1), 16, 10).cast("int"))
            hex_ = F.when(version.isin(*sorted(self.allowed_versions)), hex_) if self.allowed_versions else F.lit(None).cast("string")
        if self.out_format is UuidFormat.COMPACT:
            return (hex_,)
        dashed = F.regexp_replace(hex_, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
        return (dashed if self.out_format is UuidFormat.STANDARD else F.concat(F.lit("urn:uuid:"), dashed),)

    def name_score(self, column: str) -> float:
        return named(column, ("uuid", "guid", "pk_id", "session_token"))

    def recognises(self, c: Column) -> Column:
        bare = F.replace(F.regexp_replace(c.cast("string"), r"['\"{}()\[\] ]", ""), F.lit("urn:uuid:"), F.lit(""))
        return bare.rlike(r"(?i)\A[0-9a-f]{8}-?(?:[0-9a-f]{4}-?){3}[0-9a-f]{12}\z")

    def value_score(self, name: float, cleaned: int, seen: int) -> float:
        return name or (0.9 if seen and 2 * cleaned >= seen else 0.0)
