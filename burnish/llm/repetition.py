"""Quality rules with suffix-array repetition (operator 2).

The words of a text are sorted as suffixes by prefix doubling. Neighbours in that
order have the longest common prefixes of the text; an interval of neighbours that
share at least n words stands for a repeated passage of n words, and is maximal
where no word can be added. Every occurrence of a maximal repeat from `least_repeat`
words on is a span; the rules limit the longest repeat and the share of words inside
the union of the spans.

Defined results: a null or empty text has no words and fails the base rule; repeated
rows are judged each by itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _shared
from .words import Words, sums


@dataclass(frozen=True)
class Rules:
    """least_words, repeat_percent: the base rule. least_repeat: words of the
    shortest repeat that counts. covered_percent: most words inside repeats.
    longest_repeat: words of the longest repeat that is allowed; a text of fewer
    than twice as many words can't break it."""

    least_words: int = 50
    repeat_percent: int = 50
    least_repeat: int = 8
    covered_percent: int = 30
    longest_repeat: int = 100


def suffix_levels(code: np.ndarray, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all texts (suffixes end with their text) and, for every
    power of two, a rank for each place: two places of one text have equal ranks if
    so many words from there on are equal. `last`: end of each place's text."""
    n = len(code)
    order = np.lexsort((code, doc))
    rank = np.empty(n, np.int64)

    def heads(sorted_keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    key = doc[order].astype(np.int64) << 40 | code[order]
    rank[order] = heads(key)
    levels, step = [rank.copy()], 1
    while True:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        ahead = active + step
        follow = np.where(ahead < last[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[active]))
        places, keys = active[by], rank[active][by] * (n + 1) + follow[by]
        top = rank[places]
        at = heads(keys)
        class_at = heads(top)
        rank[places] = top + at - class_at
        levels.append(rank.copy())
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def repeats(code: np.ndarray, doc: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """For each place the length of the longest repeat of its text that starts
    there, if it has `least` words or more, else 0."""
    longest = np.zeros(len(code), np.int64)
    if len(code) < 2:
        return longest
    suffixes, levels = suffix_levels(code, doc, last)
    level = min(int(least).bit_length() - 1, len(levels) - 1)
    if 1 << level > least or 1 << (level + 1) <= least and level == len(levels) - 1:
        return longest
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[level][a] == levels[level][b])
    a, b = a[near], b[near]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x < last[a]) & (y < last[b])
        same = fits & (levels[k][np.minimum(x, len(code) - 1)] == levels[k][np.minimum(y, len(code) - 1)])
        common += same << k
    keep = common >= least
    np.maximum.at(longest, a[keep], common[keep])
    np.maximum.at(longest, b[keep], common[keep])
    return longest


def repeated_windows(code: np.ndarray, last: np.ndarray, doc: np.ndarray, width: int = 3) -> np.ndarray:
    """Places inside a window of `width` words that their text holds twice or more."""
    n = len(code)
    if n < width:
        return np.zeros(n, bool)
    key = code
    for k in range(1, width):  # dense pairs, so that codes stay small and exact
        follow = np.zeros(n, np.int64)
        follow[:-k] = code[k:]
        key = np.unique(key * (n + 2) + follow, return_inverse=True)[1]
    whole = np.arange(n) + width <= last
    _, back, count = np.unique(doc[whole].astype(np.int64) * (n + 2) + key[whole], return_inverse=True, return_counts=True)
    begin = np.flatnonzero(whole)[count[back] > 1]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + width, -1)
    return np.cumsum(mark[:-1]) > 0


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered long, longest_repeat long, kept boolean"
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("n_covered", pa.int64()), ("longest_repeat", pa.int64()), ("kept", pa.bool_())])

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: pa.LargeStringArray, rules: Rules) -> list[np.ndarray]:
    """All columns of the result but doc_id, for one slice of texts."""
    data, ends = _shared.raw(texts)
    words = Words(data, ends)
    code = words.codes()
    longest = repeats(code, words.doc, words.last, rules.least_repeat)
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(longest)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + longest[at], -1)
    covered = sums(np.cumsum(mark[:-1]) > 0, words.first)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, words.doc, longest)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = sums(letters[words.stop] - letters[words.start], words.first)
    symbols = sums(SYMBOL[data], ends)
    lines = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        held = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        lines[k] = len(held) - len(set(held))
    repeated = sums(repeated_windows(code, words.last, words.doc), words.first)
    n = words.count
    failed = (n < rules.least_words) | (100 * repeated > rules.repeat_percent * n)
    kept = ~failed & (100 * covered <= rules.covered_percent * n) & (top <= rules.longest_repeat)
    return [n, chars, symbols, lines, repeated, failed, covered, top, kept]


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each document with what was counted and whether it is kept."""
    _shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _shared.texts(batch)
            for first, last in _shared.slices(column):
                ids = batch.column("doc_id").slice(first, last - first)
                yield _shared.arrow_out(ARROW, [ids, *measure(column.slice(first, last - first), rules)])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(run, SCHEMA)


#: A word is inside a repeat of eight words or more if it is inside an eight-word window
#: that its text holds twice, and a repeat of over 100 words is a 101-word window held twice.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, k, s, md5(array_to_string(w[s + 1:s + k], ' ')) AS win
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM d, (VALUES (3), (8), (101)) v(k) WHERE len(w) >= k)),
r AS (SELECT doc_id, k, win FROM p GROUP BY doc_id, k, win HAVING count(*) > 1),
c AS (
  SELECT doc_id, count(DISTINCT pos) FILTER (k = 3) AS repeated, count(DISTINCT pos) FILTER (k = 8) AS covered, count(*) FILTER (k = 101) AS long
  FROM (SELECT doc_id, k, unnest(range(s, s + k)) AS pos FROM p JOIN r USING (doc_id, k, win)) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words, coalesce(covered, 0)::BIGINT AS n_covered, coalesce(long, 0) AS long
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_covered,
  NOT base_failed AND 100 * n_covered <= 30 * n_words AND long = 0 AS kept
FROM b
"""
