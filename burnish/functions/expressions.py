"""Column expressions that cleaners share. Every pattern is a literal, so that the
JVM compiles it once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (Java's own class is ASCII only).
WS_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NWS = f"[{WS_CHARS}]", f"[^{WS_CHARS}]"
#: A run of white space that isn't a single space already.
WS_RUN = rf"[{WS_CHARS.replace('x20', 'x1f')}]{WS}*| {WS}+"
#: A word character: letters, numbers and the underscore of any script.
WORD = r"\p{L}\p{N}_"

#: Zeros of the scripts whose digits are turned into ASCII before a number is read.
DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xFF10)
#: These digits and the ASCII ones, as the inside of a pattern's class.
DIGITS = "0-9" + "".join(rf"\u{zero:04x}-\u{zero + 9:04x}" for zero in DIGIT_ZEROS)


_inline = False


@contextmanager
def inlined() -> Iterator[None]:
    """Inside, let() repeats the value instead: SQL text has no lambda functions."""
    global _inline
    before, _inline = _inline, True
    try:
        yield
    finally:
        _inline = before


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return use(value) if _inline else F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def ascii_digits(c: Column) -> Column:
    """Decimal digits of other scripts as ASCII digits."""
    digits = "".join(chr(zero + k) for zero in DIGIT_ZEROS for k in range(10))
    return F.translate(c, digits, "0123456789" * len(DIGIT_ZEROS))


def first_match(*cases: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds; null if none does."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def looked_up(c: Column, table: dict[str, tuple[str, ...]], values: dict[str, object]) -> Column:
    """values[k] for the k whose words hold lower(c)."""
    return first_match(*[(F.lower(c).isin(*words), F.lit(values[k])) for k, words in table.items()])
