"""Telephone numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import DIGITS, WS, WS_CHARS, ascii_digits, let, stripped
from .base import BaseCleaner, named


class PhoneFormat(str, Enum):
    E164 = "e164"
    INTERNATIONAL = "international"
    NATIONAL = "national"
    RAW_DIGITS = "raw_digits"


@dataclass(frozen=True)
class Plan:
    """A numbering plan. kinds: (pattern of the national number, its groups as a
    replacement, the same in national writing or None for trunk + groups)."""

    code: str
    trunk: str
    kinds: tuple[tuple[str, str, str | None], ...]

    def valid(self, national: Column) -> Column:
        return national.rlike(rf"\A(?:{'|'.join(self.bare(k) for k, _, _ in self.kinds)})\z")

    @staticmethod
    def bare(pattern: str) -> str:
        return re.sub(r"\((?!\?)", "(?:", pattern)


NANP = Plan("1", "1", ((r"([2-9](?!11)[0-8]\d)([2-9]\d{2})(\d{4})", "$1-$2-$3", "($1) $2-$3"),))
#: Fixed values of public numbering plans, for each region.
PLANS = {
    "US": NANP,
    "CA": NANP,
    "IN": Plan(
        "91",
        "0",
        (
            (r"(11|2[02]|33|4[04]|79|80)([2-7]\d{3})(\d{4})", "$1 $2 $3", None),
            (r"([6-9]\d{4})(\d{5})", "$1 $2", None),
            (r"([1-5]\d{2})([2-7]\d{2})(\d{4})", "$1 $2 $3", None),
        ),
    ),
    "GB": Plan("44", "0", ((r"(2\d)(\d{4})(\d{4})", "$1 $2 $3", None), (r"([38]\d{2})(\d{3})(\d{4})", "$1 $2 $3", None), (r"(1\d{3})(\d{5,6})", "$1 $2", None), (r"(7[1-57-9]\d{2})(\d{6})", "$1 $2", None))),
    "FR": Plan("33", "0", ((r"([1-9])(\d{2})(\d{2})(\d{2})(\d{2})", "$1 $2 $3 $4 $5", None),)),
    "ES": Plan("34", "", ((r"([5-9]\d{2})(\d{2})(\d{2})(\d{2})", "$1 $2 $3 $4", None),)),
    "AU": Plan("61", "0", ((r"(4\d{2})(\d{3})(\d{3})", "$1 $2 $3", None), (r"([2378])(\d{4})(\d{4})", "$1 $2 $3", "(0$1) $2 $3"))),
    "SG": Plan("65", "", ((r"([3689]\d{3})(\d{4})", "$1 $2", None),)),
    "AE": Plan("971", "0", ((r"(5[024-68])(\d{3})(\d{4})", "$1 $2 $3", None), (r"([2-4679])([2-8]\d{2})(\d{4})", "$1 $2 $3", None))),
    "BE": Plan("32", "0", ((r"(4\d{2})(\d{2})(\d{2})(\d{2})", "$1 $2 $3 $4", None), (r"([2-49])(\d{3})(\d{2})(\d{2})", "$1 $2 $3 $4", None), (r"([15-8]\d)(\d{2})(\d{2})(\d{2})", "$1 $2 $3 $4", None))),
    "BR": Plan("55", "0", ((r"([1-9][1-9])(9\d{4})(\d{4})", "$1 $2-$3", "($1) $2-$3"), (r"([1-9][1-9])([2-5]\d{3})(\d{4})", "$1 $2-$3", "($1) $2-$3"))),
    "CH": Plan("41", "0", ((r"([2-7]\d)(\d{3})(\d{2})(\d{2})", "$1 $2 $3 $4", None),)),
    "CN": Plan("86", "0", ((r"(1[3-9]\d)(\d{4})(\d{4})", "$1 $2 $3", "$1 $2 $3"), (r"(10|2\d)([2-9]\d{3})(\d{4})", "$1 $2 $3", None), (r"([3-9]\d{2})([2-9]\d{2,3})(\d{4})", "$1 $2 $3", None))),
    "DE": Plan("49", "0", ((r"(15\d{2})(\d{7})", "$1 $2", None), (r"(1[67]\d)(\d{7,8})", "$1 $2", None), (r"(30|40|69|89)(\d{5,9})", "$1 $2", None), (r"([2-9]\d{2})(\d{4,8})", "$1 $2", None))),
    "IT": Plan("39", "", ((r"(3\d{2})(\d{3})(\d{3,4})", "$1 $2 $3", None), (r"(0[26])(\d{4})(\d{4})", "$1 $2 $3", None), (r"(0\d{2})(\d{6,7})", "$1 $2", None))),
    "JP": Plan("81", "0", ((r"([7-9]0)(\d{4})(\d{4})", "$1-$2-$3", None), (r"([36])(\d{4})(\d{4})", "$1-$2-$3", None), (r"([124578][1-9])(\d{3})(\d{4})", "$1-$2-$3", None))),
    "KR": Plan("82", "0", ((r"(10)(\d{4})(\d{4})", "$1-$2-$3", None), (r"(2)(\d{3,4})(\d{4})", "$1-$2-$3", None), (r"([3-6][1-5])(\d{3,4})(\d{4})", "$1-$2-$3", None))),
    "MX": Plan("52", "", ((r"(33|5[56]|81)(\d{4})(\d{4})", "$1 $2 $3", None), (r"([2-9]\d{2})(\d{3})(\d{4})", "$1 $2 $3", None))),
    "NL": Plan("31", "0", ((r"(6)([1-58]\d{7})", "$1 $2", None), (r"([1-57]\d)(\d{3})(\d{4})", "$1 $2 $3", None))),
    "NZ": Plan("64", "0", ((r"(2\d)(\d{3})(\d{3,5})", "$1 $2 $3", None), (r"([34679])([2-9]\d{2})(\d{4})", "$1-$2 $3", "(0$1) $2 $3"))),
    "PL": Plan("48", "", ((r"([4-8]\d{2})(\d{3})(\d{3})", "$1 $2 $3", None), (r"([1-3]\d)(\d{3})(\d{2})(\d{2})", "$1 $2 $3 $4", None))),
    "PT": Plan("351", "", ((r"(2[12])(\d{3})(\d{4})", "$1 $2 $3", None), (r"(2[3-9]\d|9[1-36]\d)(\d{3})(\d{3})", "$1 $2 $3", None))),
    "RU": Plan("7", "8", ((r"([3489]\d{2})(\d{3})(\d{2})(\d{2})", "$1 $2-$3-$4", "8 ($1) $2-$3-$4"),)),
    "SA": Plan("966", "0", ((r"(5\d)(\d{3})(\d{4})", "$1 $2 $3", None), (r"(1[1-7])(\d{3})(\d{4})", "$1 $2 $3", None))),
    "ZA": Plan("27", "0", ((r"([1-8]\d)(\d{3})(\d{4})", "$1 $2 $3", None),)),
}


@dataclass(frozen=True, kw_only=True)
class PhoneCleaner(BaseCleaner):
    """The first telephone number in the value, if its numbering plan allows it.
    default_regions: tried in order for numbers without a country code; with none only
    numbers that begin with + are taken."""

    Format: ClassVar = PhoneFormat

    out_format: PhoneFormat = PhoneFormat.E164
    default_regions: tuple[str, ...] = ()

    def check(self) -> None:
        unknown = [r for r in self.default_regions if r not in PLANS]
        if unknown:
            raise ValueError(f"no numbering plan for {', '.join(unknown)}; there are {', '.join(PLANS)}")

    def parts(self, c: Column) -> tuple[Column]:
        # Only what is a number or may hold one is turned into ASCII digits, not whole texts.
        scientific = c.rlike(rf"\A{WS}*[{DIGITS}]+(?:\.[{DIGITS}]+)?[eE][+-]?[{DIGITS}]+{WS}*\z")
        number = stripped(ascii_digits(c)).try_cast("double")
        whole = F.when(number < 1e18, number.cast("decimal(38,0)").cast("string"))
        run = F.regexp_extract(c, rf"\+?\(?[{DIGITS}][{DIGITS}{WS_CHARS}().\-/]{{4,}}[{DIGITS}]", 0)
        return (let(F.when(scientific, F.when(F.length(whole) >= 6, whole)).otherwise(ascii_digits(run)), self.of_run),)

    def of_run(self, run: Column) -> Column:
        """The result from the characters that may be a number."""
        digits = F.regexp_replace(run, r"\D", "")
        abroad = run.startswith("+")
        found = []
        for plan in {p.code: p for p in PLANS.values()}.values():
            national = F.substring(digits, F.lit(len(plan.code) + 1), F.length(digits))
            found.append((abroad & digits.startswith(plan.code) & plan.valid(national), self.written(plan, national)))
        for region in self.default_regions:
            plan = PLANS[region]
            without_trunk = F.substring(digits, F.lit(len(plan.trunk) + 1), F.length(digits))
            without_code = F.substring(digits, F.lit(len(plan.code) + 1), F.length(digits))
            found.append((~abroad & plan.valid(digits), self.written(plan, digits)))
            if plan.trunk:
                found.append((~abroad & digits.startswith(plan.trunk) & plan.valid(without_trunk), self.written(plan, without_trunk)))
            found.append((~abroad & digits.startswith(plan.code) & plan.valid(without_code), self.written(plan, without_code)))
        out = F.when(*found[0])
        for condition, value in found[1:]:
            out = out.when(condition, value)
        return out

    def written(self, plan: Plan, national: Column) -> Column:
        if self.out_format is PhoneFormat.E164:
            return F.concat(F.lit(f"+{plan.code}"), national)
        if self.out_format is PhoneFormat.RAW_DIGITS:
            return F.concat(F.lit(plan.code), national)
        abroad = self.out_format is PhoneFormat.INTERNATIONAL
        trunk = "" if plan.code == "1" else plan.trunk
        out = national
        for pattern, groups, home in reversed(plan.kinds):
            shape = f"+{plan.code} {groups}" if abroad else home or f"{trunk}{groups}"
            out = F.when(national.rlike(rf"\A{pattern}\z"), F.regexp_replace(national, rf"\A{pattern}\z", shape)).otherwise(out)
        return out

    def name_score(self, column: str) -> float:
        return named(column, ("phone", "tel", "mobile", "fax", "contact_no"))
