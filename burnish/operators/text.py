"""Text and e-mail addresses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import NWS, WORD, WS_CHARS, WS_RUN, let
from .base import BaseCleaner, named

#: A run of white space and control characters that isn't a single space already.
OTHER = r"\x00-\x1f\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_RUN = rf"[{OTHER}][ {OTHER}]*| [ {OTHER}]+"


@dataclass(frozen=True, kw_only=True)
class TextCleaner(BaseCleaner):
    """Free text: markup, addresses, digits, punctuation, line ends, spaces and case,
    in this order. A text with nothing left is null."""

    lowercase: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    remove_emails: bool = True
    remove_punctuation: bool = False
    remove_digits: bool = False
    replace_newlines_with_spaces: bool = True

    def parts(self, c: Column) -> tuple[Column]:
        if self.remove_html:
            c = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]+>", " ")).otherwise(c)
        if self.remove_urls:
            held = F.contains(c, F.lit("://")) | F.contains(c, F.lit("www."))
            c = F.when(held, F.regexp_replace(c, rf"https?://{NWS}+|www\.{NWS}+", "")).otherwise(c)
        if self.remove_emails:  # without an @ the pattern would only cost time
            c = F.when(F.instr(c, "@") > 0, F.regexp_replace(c, rf"(?<!{NWS}){NWS}+@{NWS}+", "")).otherwise(c)
        if self.remove_digits:
            c = F.regexp_replace(c, r"\p{Nd}+", "")
        if self.remove_punctuation:
            c = F.regexp_replace(c, rf"[^{WORD}{WS_CHARS}]+", "")
        if self.replace_newlines_with_spaces:  # one pass for controls and white space
            c = F.regexp_replace(c, BLANK_RUN, " ")
        else:
            c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0a-\x1f\x7f-\x9f]+", ""), WS_RUN, " ")
        c = F.btrim(c)
        if self.lowercase:
            c = F.lower(c)
        return (F.nullif(c, F.lit("")),)

    def takes_any(self) -> bool:
        return False

    def name_score(self, column: str) -> float:
        words = ("text", "description", "comment", "notes", "summary", "review")
        return 0.8 if named(column, words) else 0.1


@dataclass(frozen=True, kw_only=True)
class EmailCleaner(BaseCleaner):
    """The first e-mail address in the value, whole or as local part, tag and domain."""

    lowercase: bool = True
    keep_tags: bool = True
    keep_dots: bool = True

    #: Fixed value: what counts as an address.
    PATTERN = r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"

    def schema(self) -> str | tuple[tuple[str, str], ...]:
        return (("local", "str"), ("tag", "str"), ("domain", "str")) if self.split_components else "str"

    def parts(self, c: Column) -> tuple[Column, ...]:
        hit = F.when(F.contains(c, F.lit("@")), F.nullif(F.regexp_extract(c, self.PATTERN, 0), F.lit("")))
        if self.split_components:
            return tuple(let(hit, self.pick(k)) for k in range(3))
        return (let(hit, self.pick(0)),)

    def pick(self, k: int) -> Callable[[Column], Column]:
        return lambda hit: self.made(hit)[k]

    def made(self, hit: Column) -> tuple[Column, ...]:
        """The outputs from an address."""
        before, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
        local = F.substring_index(before, "+", 1)
        tag = F.when(F.instr(before, "+") > 0, F.substring(before, F.length(local) + 2, F.length(before)))
        if not self.keep_dots:
            local = F.replace(local, F.lit("."), F.lit(""))
        if not self.keep_tags:
            tag = F.lit(None).cast("string")
        if self.lowercase:
            local, tag, domain = F.lower(local), F.nullif(F.lower(tag), F.lit("")), F.lower(domain)
        if self.split_components:
            return local, tag, domain
        return (F.concat(local, F.coalesce(F.concat(F.lit("+"), tag), F.lit("")), F.lit("@"), domain),)

    def name_score(self, column: str) -> float:
        return named(column, ("email",))
