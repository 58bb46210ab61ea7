"""Removal of repeated passages through suffix automata (operator 3).

A window is 35 consecutive words of one document; a word inside a window that also
starts anywhere else is removed, everywhere.

1. Anchors. Every window has one anchor, the least hash among its runs of 12 words, so
   equal windows have equal anchors. Anchors are counted over all documents; a window
   whose anchor occurs once cannot repeat.
2. Contexts. Around each anchor that repeats, the words of the windows that have it as
   theirs form its context. Each window lies in exactly one context. Equal contexts
   are counted as one with a weight before they move.
3. Shards. Contexts meet by their anchor. A shard's task builds the suffix automaton of
   its distinct contexts (with the weights of ends) and streams the contexts through it:
   after each word the state is followed up its suffix links to the longest matching
   statistics of at least 35, whose weight says in how many places the window starts.
4. Hot anchors, with more than GROUP distinct contexts, are split: the windows are
   halved by the place of the anchor in them, and each half meets by the longer run of
   words that all its windows share, down to single windows, where equal contexts are
   one row. Nothing is dropped.
5. The verdicts go back to the documents, and maximal spans of such windows are removed.

Streaming every document past the automaton of every shard, in broadcasts, would take
work with the square of the corpus; routing by anchors finds the same windows.

Defined results: a null or empty text has no words, and the hash of the empty string;
repeated rows count as places of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from .words import Words, mixed

WINDOW = 35
RUN = 12
#: Places that an anchor can have in a window.
PLACES = WINDOW - RUN + 1
#: Distinct contexts that share one automaton's anchor at most, and words of an automaton.
GROUP, AUTOMATON = 1000, 60_000
#: How the places are divided, step by step.
STEPS = (24, 12, 6, 3, 1)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, hash, first and last window start of each anchor of a slice."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none
    h = words.hashes()
    grams = np.zeros(n - RUN + 1, np.uint64)
    for k in range(RUN):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(grams)]
    grams = mixed(grams)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= words.last)
    if not len(starts):
        return none, none, none, none
    view = np.lib.stride_tricks.sliding_window_view(grams, PLACES)
    place = starts + np.argmin(view[starts], axis=1)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(starts) != 1) | (words.doc[starts[1:]] != words.doc[starts[:-1]])]))
    final = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return place[new], grams[place[new]].view(np.int64), starts[new], starts[final]


class SuffixAutomaton:
    """The substrings of several sequences; count[state] is the weight of the places
    where the state's substrings end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the shorter substrings of q that p leads to."""
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Ends of longer substrings are ends of their suffixes too."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def places(self, sequence: list[int], window: int) -> list[int]:
        """For each window of a sequence, in order, the weight of its places. A window
        that no sequence of the automaton holds has none."""
        out, state, matched = [], 0, 0
        for k, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if k >= window - 1:
                out.append(self.count[state] if matched >= window else 0)
        return out


def verdicts(groups: list[list[tuple[int, int, int, int, bytes, int]]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(core, sub, mask) for groups of rows (core, sub, lo, hi, context, weight): bit o
    of the mask is set if the window with the anchor at place o is found twice."""
    out, automaton, codes, asked = [], SuffixAutomaton(), {}, []
    for rows in groups:
        if sum(r[5] for r in rows) < 2:
            continue
        for core, sub, lo, hi, context, weight in rows:
            sequence = [codes.setdefault(w, len(codes)) for w in context.split(b" ")]
            automaton.add(sequence, weight)
            asked.append((core, sub, lo, hi, sequence))
    automaton.close()
    for core, sub, _, hi, sequence in asked:
        mask = 0
        for k, n in enumerate(automaton.places(sequence, window)):
            if n > 1:
                mask |= 1 << (hi - 1 - k)
        if mask:
            out.append((core, sub, mask))
    return out


ROWS = pa.schema([("core", pa.int64()), ("sub", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("context", pa.binary()), ("n", pa.int64())])
ROWS_SQL = "core long, sub long, lo int, hi int, context binary, n long"


def _signed(data: bytes, seed: int) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def _judged(rows: DataFrame) -> DataFrame:
    """core, sub, mask of rows that meet by core."""
    schema = pa.schema([("core", pa.int64()), ("sub", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, core = [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            found = verdicts(groups)
            if found:
                yield _shared.arrow_out(schema, zip(*found, strict=True))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ROWS.names), strict=True):
                if row[0] != core:
                    if size > AUTOMATON:
                        yield from out()
                        groups, size = [], 0
                    groups.append([])
                    core = row[0]
                groups[-1].append(row)
                size += row[3] - row[2] + WINDOW
        yield from out()

    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(run, "core long, sub long, mask long")


def _halved(rows: DataFrame, step: int) -> DataFrame:
    """Rows with their places divided into ranges of `step`: old_core, old_sub and the
    new row. A range's core is what all its windows share."""
    schema = pa.schema([("old_core", pa.int64()), ("old_sub", pa.int64()), *ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for core, sub, lo, hi, context, n in zip(*(batch.column(c).to_pylist() for c in ROWS.names), strict=True):
                words, at = context.split(b" "), hi - 1
                for low in range(lo // step * step, hi, step):
                    high = low + step
                    first, last = max(lo, low), min(hi, high)
                    shared = b" ".join(words[at - low : at + WINDOW - high + 1])
                    part = b" ".join(words[at - last + 1 : at + WINDOW - first])
                    out.append((core, sub, _signed(shared, 1 + low * 32 + step), _signed(part, first * 32 + last), first, last, part, n))
            if out:
                yield _shared.arrow_out(schema, zip(*out, strict=True))

    return rows.select(*ROWS.names).mapInArrow(run, f"old_core long, old_sub long, {ROWS_SQL}")


def _masks(rows: DataFrame, level: int = 0) -> DataFrame:
    """core, sub, mask for distinct weighted rows, hot groups split."""
    sizes = rows.groupBy("core").agg(F.count("*").alias("contexts"), F.sum("n").alias("places")).where("places > 1")
    sizes = _shared.written(sizes, "groups")
    hot = sizes.where(F.col("contexts") > GROUP).select("core")
    if level + 1 == len(STEPS) or hot.isEmpty():
        return _judged(rows.join(sizes.select("core"), "core", "left_semi").select(*ROWS.names))
    calm = _judged(rows.join(sizes.where(F.col("contexts") <= GROUP).select("core"), "core", "left_semi").select(*ROWS.names))
    halves = _shared.written(_halved(rows.join(hot, "core", "left_semi"), STEPS[level + 1]), "halves")
    deeper = _shared.written(halves.groupBy("core", "sub", "lo", "hi", "context").agg(F.sum("n").alias("n")).select(*ROWS.names), "contexts")
    found = halves.select("old_core", "old_sub", "core", "sub").join(_masks(deeper, level + 1), ["core", "sub"])
    return calm.union(found.groupBy(F.col("old_core").alias("core"), F.col("old_sub").alias("sub")).agg(F.bit_or("mask").alias("mask")))


def repeated_places(docs: DataFrame) -> DataFrame:
    """doc, th (the key of a row) and anchor places whose hash is found twice or more."""
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _shared.texts(batch)
            keys = [batch.column(c).to_numpy() for c in ("doc", "th")]
            for first, last in _shared.slices(column):
                words = Words(*_shared.raw(column.slice(first, last - first)))
                place, h, _, _ = anchors(words)
                if len(place):
                    of = words.doc[place]
                    yield _shared.arrow_out(schema, [*(k[first:last][of] for k in keys), h, place - words.first[of]])

    found = _shared.written(docs.select("doc", "th", "text").mapInArrow(run, "doc long, th long, h long, place int"), "anchors")
    # Written first, so that the join stands alone and a hot anchor's rows can be split.
    often = _shared.written(found.groupBy("h").count().where("count > 1").select("h"), "often")
    places = found.join(often, "h", "left_semi").groupBy("doc", "th").agg(F.collect_set("place").alias("places"))
    out = _shared.written(places, "repeated")
    for done in (found, often):
        _shared.discard(done)
    return out


STAGE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string()), ("place", pa.int32()), *ROWS][:-1])
STAGE_SQL = "kind int, doc_id long, doc long, th long, n_words long, sha string, text string, place int, core long, sub long, lo int, hi int, context binary"


def _staged(docs: DataFrame) -> DataFrame:
    """Documents with no candidate, finished (kind 0); the others (1); contexts (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _shared.texts(batch)
            ids, doc, th, places = (batch.column(c).to_pylist() for c in ("doc_id", "doc", "th", "places"))
            for first, last in _shared.slices(column):
                part = column.slice(first, last - first)
                words = Words(*_shared.raw(part))
                place, h, begin, final = anchors(words)
                bounds = np.searchsorted(place, words.first)
                out = []
                for k in range(last - first):
                    row, text = first + k, part[k].as_py()
                    held = text.encode().split()
                    if not places[row]:
                        sha = hashlib.sha256(b" ".join(held)).hexdigest()
                        out.append((0, ids[row], doc[row], th[row], len(held), sha, *[None] * 7))
                        continue
                    out.append((1, ids[row], doc[row], th[row], len(held), None, text, *[None] * 6))
                    wanted, base = set(places[row]), int(words.first[k])
                    for a in range(int(bounds[k]), int(bounds[k + 1])):
                        at = int(place[a]) - base
                        if at in wanted:
                            lo, hi = int(place[a] - final[a]), int(place[a] - begin[a]) + 1
                            context = b" ".join(held[int(begin[a]) - base : int(final[a]) - base + WINDOW])
                            out.append((2, None, doc[row], th[row], None, None, None, at, int(h[a]), _signed(context, lo * 32 + hi), lo, hi, context))
                yield _shared.arrow_out(STAGE, zip(*out, strict=True))

    return docs.mapInArrow(run, STAGE_SQL)


def _finished(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for span in spans or ():
                    mask = span["mask"]
                    while mask:
                        start = span["place"] - (mask.bit_length() - 1)
                        gone[start] += 1
                        gone[start + WINDOW] -= 1
                        mask &= (1 << (mask.bit_length() - 1)) - 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            if out:
                yield _shared.arrow_out(schema, zip(*out, strict=True))

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null: nothing was removed or
    looked at, the words of the text as they are) for each document."""
    _shared.prepare(docs.sparkSession)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # Rows that are alike in both columns have one key and the same fate.
    keyed = plain.withColumn("doc", F.coalesce("doc_id", F.lit(-1))).withColumn("th", F.xxhash64("text"))
    places = repeated_places(keyed)
    stage = _shared.written(_staged(keyed.join(places, ["doc", "th"], "left").select("doc_id", "doc", "th", "text", "places")), "contexts")
    _shared.discard(places)
    contexts = stage.where("kind = 2")
    distinct = contexts.groupBy("core", "sub", "lo", "hi", "context").agg(F.count("*").alias("n")).select(*ROWS.names)
    masks = _masks(_shared.written(distinct, "distinct"))
    spans = contexts.select("doc", "th", "place", "core", "sub").join(masks, ["core", "sub"]).groupBy("doc", "th").agg(F.collect_set(F.struct("place", "mask")).alias("spans"))
    looked = stage.where("kind = 1").select("doc_id", "doc", "th", "text").join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")
    done = stage.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return done.union(_finished(looked))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 35], ' ') AS win FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
r AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(s, s + 35)) AS pos FROM p WHERE win IN (SELECT win FROM r))),
w AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
