"""Further cleaners: web addresses, currencies, cards, MAC addresses, languages, tax
numbers, business types, scales and address lines. Not in the default registry."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import WS, first_match
from .base import BaseCleaner, named


def _words(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


@dataclass(frozen=True, kw_only=True)
class UrlCleaner(BaseCleaner):
    """The first web address, with its scheme and host in lower case; or scheme, domain
    (without www.) and path."""

    def schema(self) -> str | tuple[tuple[str, str], ...]:
        return (("scheme", "str"), ("domain", "str"), ("path", "str")) if self.split_components else "str"

    def parts(self, c: Column) -> tuple[Column, ...]:
        pattern = r"(?i)\b(?:(https?|ftp)://)?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(:\d+)?(/[^\s]*)?"
        found = F.regexp_extract(c, pattern, 0) != ""
        scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(c, pattern, 1)), F.lit("")), F.lit("http"))
        host = F.lower(F.regexp_extract(c, pattern, 2))
        path = F.regexp_extract(c, pattern, 4)
        if self.split_components:
            return tuple(F.when(found, x) for x in (scheme, F.regexp_replace(host, r"\Awww\.", ""), F.nullif(path, F.lit(""))))
        return (F.when(found, F.concat(scheme, F.lit("://"), host, F.regexp_extract(c, pattern, 3), path)),)

    def name_score(self, column: str) -> float:
        return named(column, ("url", "website", "domain", "link"))


@dataclass(frozen=True, kw_only=True)
class CurrencyCleaner(BaseCleaner):
    """The ISO 4217 code of a sign, a code or a name."""

    #: Codes with their signs and names.
    CODES: ClassVar = {
        "USD": ("$", "us$", "usd", "dollar", "dollars", "us dollar"), "EUR": ("€", "eur", "euro", "euros"), "GBP": ("£", "gbp", "pound", "pounds", "pound sterling"),
        "INR": ("₹", "rs", "rs.", "inr", "rupee", "rupees"), "JPY": ("¥", "jpy", "yen"), "CNY": ("cny", "rmb", "yuan"), "CHF": ("chf", "franc", "swiss franc"),
        "AUD": ("a$", "aud"), "CAD": ("c$", "cad"), "SGD": ("s$", "sgd"), "AED": ("aed", "dirham"), "KRW": ("₩", "krw", "won"), "BRL": ("r$", "brl", "real"),
    }

    def parts(self, c: Column) -> tuple[Column]:
        value = F.lower(F.btrim(F.regexp_replace(c, rf"[0-9.,]+|{WS}+", " ")))
        return (first_match(*[(value.isin(*names), F.lit(code)) for code, names in self.CODES.items()]),)

    def name_score(self, column: str) -> float:
        return named(column, ("currency",))


@dataclass(frozen=True, kw_only=True)
class CreditCardCleaner(BaseCleaner):
    """Card numbers with all but the last digits masked; a wrong check digit is null."""

    shown: int = 4

    def parts(self, c: Column) -> tuple[Column]:
        digits = F.regexp_replace(F.regexp_extract(c, r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", 0), r"\D", "")
        n = F.length(digits)

        def weighed(d: Column, i: Column) -> Column:
            twice = d.cast("int") * 2
            return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

        total = F.aggregate(F.transform(F.split(digits, ""), weighed), F.lit(0), lambda a, b: a + b)
        masked = F.concat(F.repeat(F.lit("*"), n - self.shown), F.right(digits, F.lit(self.shown)))
        return (F.when(n >= 13, F.when(total % 10 == 0, masked)),)

    def name_score(self, column: str) -> float:
        return named(column, ("credit_card", "card_number", "card_no"))


@dataclass(frozen=True, kw_only=True)
class MacAddressCleaner(BaseCleaner):
    """Six pairs of hexadecimal digits, lower case, with colons."""

    def parts(self, c: Column) -> tuple[Column]:
        hex_ = F.regexp_replace(F.lower(c), r"[:\-. ]", "")
        return (F.when(hex_.rlike(r"\A[0-9a-f]{12}\z"), F.array_join(F.array(*[F.substring(hex_, 1 + 2 * k, 2) for k in range(6)]), ":")),)

    def name_score(self, column: str) -> float:
        return named(column, ("mac_address", "mac_addr"))


@dataclass(frozen=True, kw_only=True)
class LanguageCodeCleaner(BaseCleaner):
    """The ISO 639-1 code of a tag (en-GB), a code of three letters or a name."""

    #: Codes with their other codes and names.
    CODES: ClassVar = {
        "en": ("eng", "english"), "de": ("deu", "ger", "german", "deutsch"), "fr": ("fra", "fre", "french", "français"), "es": ("spa", "spanish", "español"),
        "it": ("ita", "italian", "italiano"), "pt": ("por", "portuguese", "português"), "nl": ("nld", "dut", "dutch"), "ru": ("rus", "russian"), "zh": ("zho", "chi", "chinese"),
        "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "ar": ("ara", "arabic"), "hi": ("hin", "hindi"), "bn": ("ben", "bengali"), "ta": ("tam", "tamil"), "te": ("tel", "telugu"),
        "tr": ("tur", "turkish"), "pl": ("pol", "polish"), "sv": ("swe", "swedish"), "uk": ("ukr", "ukrainian"),
    }

    def parts(self, c: Column) -> tuple[Column]:
        value = F.regexp_replace(F.lower(F.btrim(c)), r"\A([a-z]{2,3})[-_].*\z", "$1")
        return (first_match(*[(value.isin(code, *names), F.lit(code)) for code, names in self.CODES.items()]),)

    def name_score(self, column: str) -> float:
        return named(column, ("language", "lang_code", "locale"))


@dataclass(frozen=True, kw_only=True)
class GstinCleaner(BaseCleaner):
    """Indian tax numbers of 15 characters with a right check character."""

    DIGITS: ClassVar = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def parts(self, c: Column) -> tuple[Column]:
        value = F.regexp_replace(F.upper(c), r"[\s-]", "")

        def weighed(x: Column, i: Column) -> Column:
            product = (F.instr(F.lit(self.DIGITS), x) - 1) * (1 + i % 2)
            return F.floor(product / 36).cast("int") + product % 36

        total = F.aggregate(F.transform(F.split(F.substring(value, 1, 14), ""), weighed), F.lit(0), lambda a, b: a + b)
        check = F.substring(F.lit(self.DIGITS), (36 - total % 36) % 36 + 1, F.lit(1))
        shape = value.rlike(r"\A\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z")
        return (F.when(shape, F.when(check == F.substring(value, 15, 1), value)),)

    def name_score(self, column: str) -> float:
        return named(column, ("gstin", "gst_no"))


@dataclass(frozen=True, kw_only=True)
class BusinessCleaner(BaseCleaner):
    """The legal form of a business."""

    #: Forms with the ways to write them.
    FORMS: ClassVar = {
        "Private Limited": ("private limited", "privatelimited", "pvt ltd", "pvt limited", "private ltd"), "Limited": ("ltd", "limited", "public limited", "plc"),
        "LLC": ("llc", "limited liability company"), "LLP": ("llp", "limited liability partnership"), "Partnership": ("partnership", "partners"),
        "Sole Proprietorship": ("proprietorship", "sole proprietorship", "sole prop", "proprietor"), "Corporation": ("corporation", "corp", "inc", "incorporated"),
    }

    def parts(self, c: Column) -> tuple[Column]:
        return (first_match(*[(_words(c).isin(*names), F.lit(form)) for form, names in self.FORMS.items()]),)

    def name_score(self, column: str) -> float:
        return named(column, ("business_type", "company_type", "legal_form"))


@dataclass(frozen=True, kw_only=True)
class ScaleCleaner(BaseCleaner):
    """A step of an ordered scale, from its names or from numbers: `steps` gives each
    step's names and the least number that belongs to it."""

    steps: tuple[tuple[str, tuple[str, ...], float], ...] = field(default=(("micro", ("micro",), 0), ("small", ("small",), 10), ("medium", ("medium", "mid"), 50), ("large", ("large", "big"), 250)))

    def parts(self, c: Column) -> tuple[Column]:
        number = F.regexp_replace(c, ",", "").try_cast("double")
        by_name = [(_words(c).isin(*names), F.lit(step)) for step, names, _ in self.steps]
        by_number = [(number >= least, F.lit(step)) for step, _, least in reversed(self.steps)]
        return (first_match(*by_name, *by_number),)

    def name_score(self, column: str) -> float:
        return named(column, ("size", "scale", "category"))


@dataclass(frozen=True, kw_only=True)
class AddressLineCleaner(BaseCleaner):
    """One line of an address: spaces and commas in order, usual short forms written out."""

    #: Short forms.
    SHORT: ClassVar = {"rd": "Road", "st": "Street", "ave": "Avenue", "blvd": "Boulevard", "ln": "Lane", "sec": "Sector", "appt": "Apartment", "apt": "Apartment", "no": "Number", "opp": "Opposite", "nr": "Near"}

    def parts(self, c: Column) -> tuple[Column]:
        c = F.regexp_replace(F.regexp_replace(c, rf"{WS}*,[,{WS[1:-1]}]*", ", "), f"{WS}+", " ")
        for short, long in self.SHORT.items():
            c = F.regexp_replace(c, rf"(?i)(?<![\p{{L}}\p{{N}}]){short}\.?(?![\p{{L}}\p{{N}}])", long)
        return (F.nullif(F.regexp_replace(c, r"\A[, ]+|[, ]+\z", ""), F.lit("")),)

    def name_score(self, column: str) -> float:
        return named(column, ("address",))
