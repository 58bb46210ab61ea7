"""Column names in one convention."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

#: Words of glued names that are cut apart, e.g. custkey: a small lexicon, to which
#: ColRenamer(lexicon=...) adds.
LEXICON = frozenset(
    "account acct address amount bal balance brand client comment cost count country county created cust customer date day discount email event extended "
    "fax first flag gender id key last line mail middle mkt month name nation number order part partner phone price priority quantity receipt region "
    "retail return segment ship size status supp supplier supply tax tel text time town total type updated user value year zip".split()
)
CASES = ("snake", "upper_snake", "upper", "lower", "pascal", "camel", "kebab", "train", "cobol")


def _segmented(word: str, lexicon: frozenset[str]) -> list[str]:
    """A glued word as the fewest words of the lexicon; as it is if they don't cover it."""
    best: list[list[str] | None] = [[]] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            head = best[begin]
            if head is not None and word[begin:end].lower() in lexicon and (best[end] is None or len(head) + 1 < len(best[end])):
                best[end] = [*head, word[begin:end]]
    return best[-1] or [word]


@dataclass(frozen=True)
class ColRenamer:
    """Renames columns. Words end at separators, at changes of case and at digits that
    follow letters; glued words of the lexicon are cut apart. A name without words stays."""

    case: str = "lower"
    lexicon: frozenset[str] = LEXICON

    def __post_init__(self) -> None:
        if self.case not in CASES:
            raise ValueError(f"no such case: {self.case!r}; there are {', '.join(CASES)}")

    def words(self, name: str) -> list[str]:
        found = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.sub(r"[^A-Za-z0-9]+", " ", name))
        return [part for word in found for part in _segmented(word, self.lexicon)]

    def rename(self, col: str) -> str:
        words = self.words(col)
        low, high, first = [w.lower() for w in words], [w.upper() for w in words], [w.capitalize() for w in words]
        made = {
            "snake": "_".join(low),
            "upper_snake": "_".join(high),
            "upper": "".join(high),
            "lower": "".join(low),
            "pascal": "".join(first),
            "camel": "".join(low[:1] + first[1:]),
            "kebab": "-".join(low),
            "train": "-".join(first),
            "cobol": "-".join(high),
        }[self.case]
        return made or col

    def rename_cols(self, cols: Iterable[str]) -> dict[str, str]:
        """Only the names that change."""
        return {c: new for c in cols if (new := self.rename(c)) != c}
