"""Language model scores: interpolated modified Kneser-Ney (operator 8).

The model has words and word pairs and is counted in Spark:

1. Tasks count the tokens of their training texts by 64-bit hash and send sorted
   blocks, cut by ranges of the hash, to one task for each range, which adds them up
   and writes a sorted array of hashes and one of counts. A token's id is its place in
   the order of all hashes.
2. Tasks map the vocabulary into memory, turn their texts into ids, and count pairs by
   the exact key (id of the word before) * 2**32 + (id of the word); blocks cut by
   ranges of the first word are added up and written as sorted arrays again. The same
   tasks write, for each first word, how often it is followed, and by how many words
   once, twice, and three times or more. They send on how many different words each
   word follows, the counts of the lower order, which are added up by ranges too.
3. Discounts come from the numbers of counts of one to four.

Files are in the shared folder. Workers map them into memory and look keys up by
binary search, a slice of sorted distinct keys at a time; nothing is broadcast but the
names of the files. A first word's pairs are at most as many as there are words.

Defined results: a null or empty text is the end token alone; a null doc_id counts as
an empty string for the choice of held-out texts; repeated rows are counted and scored
once each; without training texts every token is unknown (one word in V + 1 = 1); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from .words import Words, sums

#: Pairs that a task holds before it sends them on.
HELD = 4_000_000
#: The hash of the end token. A word's hash is made to differ from it.
END = np.uint64(0xE4D0E4D0E4D0E4D0)
LOW = np.uint64(0xFFFFFFFF)
BLOCK = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def squeezed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys (as differences) and counts, bytes of equal weight together."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    more = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.concatenate([steps, more])).tobytes())


def spread(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(16, -1)
    keys = np.cumsum(np.ascontiguousarray(flat[:8].T).view("<u8")[:, 0], dtype=np.uint64)
    return keys, np.ascontiguousarray(flat[8:].T).view("<u8")[:, 0].astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rising keys with the sums of their counts (one each if not given)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def sent(keys: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """A row for each part, which rises with the keys."""
    held, first = np.unique(parts, return_index=True)
    cuts = [*first.tolist(), len(keys)]
    return _shared.arrow_out(BLOCK, [held, [squeezed(keys[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each part's keys with the sums of their counts."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
            held.setdefault(part, []).append(block)
    for part in sorted(held):
        blocks = [spread(b) for b in held.pop(part)]
        yield part, *summed(np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]))


class Tokens:
    """Hashes of a slice's tokens (words, then one end for each text), text by text."""

    def __init__(self, column: pa.LargeStringArray):
        data, ends = _shared.raw(column)
        words = Words(data, ends, lower=True)
        self.count = words.count + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = np.full(int(self.first[-1]), END)
        self.is_end = np.zeros(len(self.hash), bool)
        self.is_end[self.first[1:] - 1] = True
        h = words.hashes() if len(words) else np.zeros(0, np.uint64)
        h[h == END] ^= np.uint64(1)
        self.hash[~self.is_end] = h

    def __len__(self) -> int:
        return len(self.hash)


@dataclass
class Model:
    """Where the parts of the model are, and its totals."""

    folder: str
    parts: int
    sizes: list[int]  # words of each part of the vocabulary
    tokens: int
    pair_sizes: list[int]
    of_counts: tuple  # pairs with counts 1 to 4
    word_of_counts: tuple  # words with 1 to 4 words before them

    def uri(self, kind: str, part: int) -> str:
        return f"{self.folder}/{kind}-{part:06d}"

    @property
    def words(self) -> int:
        return sum(self.sizes)


def discounts(n: tuple) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more. Small corpora that lack one of
    the numbers get fixed discounts."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        if all(0 < x < k + 1 for k, x in enumerate(d)):
            return np.array([0.0, *d])
    return np.array([0.0, 0.5, 1.0, 1.5])


class Loaded:
    """A worker's view of a model; arrays are mapped, not read."""

    def __init__(self, model: Model):
        self.model = model
        self.base = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.files: dict[tuple[str, int], np.ndarray] = {}

    def file(self, kind: str, part: int, dtype: str) -> np.ndarray:
        at = (kind, part)
        if at not in self.files:
            self.files[at] = _shared.mapped(self.model.uri(kind, part), dtype)
        return self.files[at]

    def _find(self, wanted: np.ndarray, parts: np.ndarray, kind: str, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of rising distinct keys in their parts, and whether they are there."""
        place, there = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        held, first = np.unique(parts, return_index=True)
        for part, a, b in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(wanted)], strict=True):
            if sizes[part]:
                keys = self.file(kind, part, "<u8")
                at = np.searchsorted(keys, wanted[a:b])
                place[a:b] = at
                there[a:b] = keys[np.minimum(at, len(keys) - 1)] == wanted[a:b]
        return place, there

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of tokens; -1 for those that training text doesn't have."""
        wanted, back = np.unique(hashes, return_inverse=True)
        parts = hash_part(wanted, self.model.parts)
        place, there = self._find(wanted, parts, "hash", self.model.sizes)
        return np.where(there, self.base[parts] + place, -1)[back]

    def by_id(self, ids: np.ndarray, kind: str, dtype: str, width: int = 1) -> np.ndarray:
        """Values that are kept by id, in the parts of the vocabulary."""
        out = np.zeros((len(ids), width), np.int64)
        wanted, back = np.unique(ids, return_inverse=True)
        parts = np.searchsorted(self.base, wanted, "right") - 1
        for part in np.unique(parts[wanted >= 0]).tolist():
            here = np.flatnonzero((parts == part) & (wanted >= 0))
            values = self.file(kind, part, dtype).reshape(-1, width)
            out[here] = values[wanted[here] - self.base[part]]
        return out[back] if width > 1 else out[back, 0]

    def pair_counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero((before >= 0) & (ids >= 0))
        wanted, back = np.unique(before[known].astype(np.uint64) << np.uint64(32) | ids[known].astype(np.uint64), return_inverse=True)
        parts = np.minimum(np.searchsorted(self.base, (wanted >> np.uint64(32)).astype(np.int64), "right") - 1, self.model.parts - 1)
        place, there = self._find(wanted, parts, "pair", self.model.pair_sizes)
        counts = np.zeros(len(wanted), np.int64)
        for part in np.unique(parts[there]).tolist():
            here = np.flatnonzero(there & (parts == part))
            counts[here] = self.file("pair_count", part, "<u4")[place[here]]
        out[known] = counts[back]
        return out


_loaded: dict[tuple[str, bool], Loaded] = {}


def loaded(model: Model) -> Loaded:
    """The worker's view of a model; half-built models are told from whole ones."""
    at = (model.folder, any(model.pair_sizes))
    if at not in _loaded:
        _loaded.clear()
        _loaded[at] = Loaded(model)
    return _loaded[at]


def hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash: the part rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def before(tokens: Tokens, ids: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; `start` at the start of a text."""
    out = np.concatenate([[start], ids[:-1]])
    out[tokens.first[:-1]] = start
    return out


def train(docs: DataFrame) -> Model:
    """Count the model over docs (column text) and write its files."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    folder = _shared.fresh_path(spark, "model")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = "part int, block binary"

    def token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            column = _shared.texts(batch)
            for first, last in _shared.slices(column):
                k, c = summed(Tokens(column.slice(first, last - first)).hash)
                keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
                if len(keys) > HELD:
                    keys, counts = summed(keys, counts)
                    if len(keys) > HELD // 2:
                        yield sent(keys, counts, hash_part(keys, parts))
                        keys, counts = keys[:0], counts[:0]
        if len(keys):
            keys, counts = summed(keys, counts)
            yield sent(keys, counts, hash_part(keys, parts))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("tokens", pa.int64())])
        for part, keys, counts in gathered(batches):
            _shared.put_file(f"{folder}/hash-{part:06d}", keys.astype("<u8").tobytes())
            _shared.put_file(f"{folder}/count-{part:06d}", counts.astype("<u8").tobytes())
            yield _shared.arrow_out(schema, [[part], [len(keys)], [int(counts.sum())]])

    rows = docs.mapInArrow(token_blocks, block).repartition(parts, "part").mapInArrow(write_words, "part long, n long, tokens long").collect()
    model = Model(folder, parts, [0] * parts, 0, [0] * parts, (0,) * 4, (0,) * 4)
    for part, n, tokens in rows:  # one for each part
        model.sizes[part] = n
        model.tokens += tokens
    if model.words >= 1 << 32:
        raise ValueError("ids have 32 bits")
    start = model.words  # the id of the start of a text, in the last part

    def pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = loaded(model)

        def out(keys: np.ndarray) -> pa.RecordBatch:
            keys, counts = summed(keys)
            owner = np.searchsorted(view.base, (keys >> np.uint64(32)).astype(np.int64), "right") - 1
            return sent(keys, counts, np.minimum(owner, parts - 1))

        held, n = [], 0
        for batch in batches:
            column = _shared.texts(batch)
            for first, last in _shared.slices(column):
                tokens = Tokens(column.slice(first, last - first))
                ids = view.ids(tokens.hash)
                held.append(before(tokens, ids, start).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
                n += len(ids)
                if n > HELD:
                    yield out(np.concatenate(held))
                    held, n = [], 0
        if held:
            yield out(np.concatenate(held))

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        for part, keys, counts in gathered(batches):
            _shared.put_file(f"{folder}/pair-{part:06d}", keys.astype("<u8").tobytes())
            _shared.put_file(f"{folder}/pair_count-{part:06d}", np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes())
            # For each first word: times followed, words that follow once, twice, more.
            size = model.sizes[part] + (part == parts - 1)
            first = (keys >> np.uint64(32)).astype(np.int64) - base[part]
            table = np.zeros((size, 4), np.int64)
            table[:, 0] = np.bincount(first, counts, size)
            for k in range(3):
                table[:, k + 1] = np.bincount(first[np.minimum(counts, 3) == k + 1], minlength=size)
            _shared.put_file(f"{folder}/follow-{part:06d}", table.astype("<u8").tobytes())
            tally = [len(keys), *(int((counts == k).sum()) for k in range(1, 5))]
            word, times = np.unique(keys & LOW, return_counts=True)
            yield sent(word, times, np.searchsorted(base, word.astype(np.int64), "right") - 1)
            yield _shared.arrow_out(BLOCK, [[-1], [json.dumps([part, *tally]).encode()]])

    lower = _shared.written(docs.mapInArrow(pair_blocks, block).repartition(parts, "part").mapInArrow(write_pairs, block), "lower-order")
    of_counts = np.zeros(4, np.int64)
    for (row,) in lower.where("part < 0").select("block").collect():  # one for each part
        part, n, *tally = json.loads(bytes(row))
        model.pair_sizes[part] = n
        of_counts += tally

    def write_lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f"n{k}", pa.int64()) for k in range(1, 5)])
        base = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        for part, word, times in gathered(batches):
            whole = np.zeros(model.sizes[part], np.int64)
            whole[word.astype(np.int64) - base[part]] = times
            _shared.put_file(f"{folder}/lower-{part:06d}", whole.astype("<u8").tobytes())
            yield _shared.arrow_out(schema, [[int((times == k).sum())] for k in range(1, 5)])

    tallies = lower.where("part >= 0").repartition(parts, "part").mapInArrow(write_lower, "n1 long, n2 long, n3 long, n4 long").collect()
    model.of_counts = tuple(int(x) for x in of_counts)
    model.word_of_counts = tuple(sum(r[k] for r in tallies) for k in range(4))
    return model


def log_probabilities(view: Loaded, before_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability of each token after the one before it."""
    model = view.model
    pairs = sum(model.pair_sizes)
    off, low_off = discounts(model.of_counts), discounts(model.word_of_counts)
    lower = view.by_id(ids, "lower", "<u8") if pairs else np.zeros(len(ids), np.int64)
    n = model.word_of_counts
    taken = low_off[1] * n[0] + low_off[2] * n[1] + low_off[3] * (model.words - n[0] - n[1]) if pairs else 0.0
    uniform = 1.0 / (model.words + 1)
    p = (lower - low_off[np.minimum(lower, 3)] + taken * uniform) / pairs if pairs else np.full(len(ids), uniform)
    if pairs:
        # A first word at the start of a text has the id after all words, in the last part.
        follow = np.zeros((len(ids), 4), np.int64)
        is_start = before_ == model.words
        follow[~is_start] = view.by_id(before_[~is_start], "follow", "<u8", 4)
        if is_start.any():
            follow[is_start] = view.file("follow", model.parts - 1, "<u8")[-4:]
        seen = follow[:, 0] > 0
        count = view.pair_counts(before_, ids)
        total = np.maximum(follow[:, 0], 1)
        p = np.where(seen, (count - off[np.minimum(count, 3)] + (follow[:, 1:] @ off[1:]) * p) / total, p)
    return np.log10(p)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs
    (columns doc_id, text, held_out)."""

    def total(values: np.ndarray, tokens: Tokens) -> np.ndarray:
        return np.add.reduceat(values, tokens.first[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from burnish.llm import kneser_ney

        view = kneser_ney.loaded(model)
        for batch in batches:
            column = _shared.texts(batch)
            for first, last in _shared.slices(column):
                tokens = Tokens(column.slice(first, last - first))
                ids = view.ids(tokens.hash)
                counts = view.by_id(ids, "count", "<u8")
                base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                p = log_probabilities(view, before(tokens, ids, model.words), ids)
                rest = [batch.column(c).slice(first, last - first) for c in ("doc_id", "held_out")]
                known = sums(counts > 0, tokens.first)
                yield _shared.arrow_out(SCORES, [*rest, tokens.count, known, [model.tokens] * len(tokens.count), total(base, tokens), total(p, tokens)])

    return docs.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, every: int = 10) -> DataFrame:
    """Train on the documents whose crc32(doc_id as text) mod `every` isn't 0; score all."""
    _shared.prepare(docs.sparkSession)
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), (F.crc32(F.encode(key, "UTF-8")) % every == 0).alias("held_out"))
    model = train(plain.where("not held_out").select("text"))
    return scores(plain, model)
