"""Quality classifier by importance resampling (operator 5).

Two generative models of hashed n-grams (words, word pairs, and the beginnings of longer
words, lower-case A-Z) are counted: one of target text, labelled good and not toxic, and
one of the raw text, which is all documents. An n-gram has two hashed buckets; the ratio
nearer to one counts, so that a bucket shared with a frequent n-gram does no harm. The
log ratio of a bucket is log((t + k) / (r T / R + k)): t and r are its counts, T and R
all counts, and k keeps n-grams that are too rare to tell anything near zero. Beginnings
catch what is rare in each of its forms.

log_weight is the importance weight of a text, that of its least likely `window` words in
a row (of all words of a shorter text), so that a text isn't rejected for its length,
and a bad passage isn't thinned out by a long text around it. Ratios are truncated: what
is less than a margin below one, or above one, counts as one, since target text that
was drawn from the raw text differs from it by chance.

Sampling is Gumbel top-k: noise keyed by doc_id and text is added to log_weight /
temperature and the k documents with the largest keys are kept, a sample without
replacement in proportion to weight ** (1 / temperature). With `share` k is that part of
all documents. Without it k is told by the labelled sample: it is the number of documents
whose keys reach the key that best parts good labels from bad ones.

Bounds: at most `sample` labelled documents of each kind (those with the smallest
hashes of their ids) train the target model and set k; all documents count for the raw
model. A table of TABLES * 2**18 numbers is broadcast.

Defined results: a null or empty text has no n-grams and log_weight 0, the largest there
is; a null doc_id is never labelled; repeated rows have equal keys and fare alike; equal
keys at the border of the top k stay together; no labels or no documents: all weights
are 0 and nothing is rejected; texts of any length are scored whole, in slices of texts;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared
from .words import Words, mixed

BUCKETS = 1 << 18
#: Two hash functions of words, of word pairs and of beginnings.
TABLES = 6
#: A table of counts is sent to be added up in so many blocks.
BLOCKS = 1024
#: Bytes of the beginning of a word.
BEGINNING = 5


@dataclass(frozen=True)
class Resampling:
    sample: int = 50_000
    smoothing: float = 1.0
    #: Of words, word pairs and beginnings; there are many rare pairs, so they weigh less.
    margins: tuple = (1.5, 1.0, 1.5)
    weights: tuple = (1.0, 0.25, 1.0)
    #: Words that a weight is summed over.
    window: int = 50
    temperature: float = 0.25
    #: The part of the documents that is kept; None: what the labels tell.
    share: float | None = None
    seed: int = 42
    #: How much a rejected good text counts against a kept bad one.
    caution: float = 3.0


def buckets(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """TABLES rows of buckets, and which words have such an n-gram."""
    h = words.hashes()
    pair = mixed(h * np.uint64(3) + np.roll(h, -1))
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    first = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))[words.start]
    begin = mixed((first & np.uint64((1 << 8 * BEGINNING) - 1)) + np.uint64(1))
    use = (np.ones(len(h), bool), np.arange(len(h)) + 1 < words.last, words.stop - words.start > BEGINNING)
    low = np.uint64(BUCKETS - 1)
    return [(((x >> np.uint64(s)) & low).astype(np.int64), u) for x, u in zip((h, pair, begin), use, strict=True) for s in (46, 20)]


def parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, Words]]:
    column = _shared.texts(batch, column)
    for first, last in _shared.slices(column):
        data, ends = _shared.raw(column.slice(first, last - first))
        yield first, last, Words(data, ends, lower=True)


def counted(docs: DataFrame) -> np.ndarray:
    """Counts of the raw and the target text, [2, TABLES, BUCKETS]. `docs` has text
    and a boolean column target. Tasks add up their own texts first and send their
    sums, compressed, in blocks of fixed size, which meet in as many tasks as there
    are shuffle partitions (BLOCKS at most)."""
    size = 2 * TABLES * BUCKETS // BLOCKS
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def packed(counts: np.ndarray) -> bytes:
        """Bytes of equal weight together."""
        return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())

    def unpacked(block: bytes) -> np.ndarray:
        whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
        return np.ascontiguousarray(whole.reshape(8, -1).T).view("<i8")[:, 0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for first, last, words in parts(batch):
                if not len(words):
                    continue
                total = np.zeros((2, TABLES, BUCKETS), np.int64) if total is None else total
                good = target[first:last][words.doc]
                for k, (row, use) in enumerate(buckets(words)):
                    total[0, k] += np.bincount(row[use], minlength=BUCKETS)
                    total[1, k] += np.bincount(row[use & good], minlength=BUCKETS)
        if total is not None:
            flat = total.reshape(BLOCKS, size)
            yield _shared.arrow_out(schema, [range(BLOCKS), [packed(x) for x in flat]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[block] = held.get(block, 0) + unpacked(counts)
        if held:
            yield _shared.arrow_out(schema, [list(held), [packed(x) for x in held.values()]])

    kind = "block int, counts binary"
    dealt = docs.select("text", "target").mapInArrow(count, kind).repartition(F.col("block"))
    rows = dealt.mapInArrow(add, kind).collect()
    out = np.zeros((BLOCKS, size), np.int64)
    for block, counts in rows:  # BLOCKS rows at most
        out[block] = unpacked(counts)
    return out.reshape(2, TABLES, BUCKETS)


def log_ratios(counts: np.ndarray, smoothing: float) -> np.ndarray:
    raw, target = counts.astype(float)
    scale = target.sum(1, keepdims=True) / np.maximum(raw.sum(1, keepdims=True), 1)
    return np.log((target + smoothing) / (raw * scale + smoothing)).astype(np.float32)


def log_weights(words: Words, ratios: np.ndarray, how: Resampling) -> np.ndarray:
    """log_weight of each text."""
    out, held = np.zeros(len(words.count)), np.flatnonzero(words.count)
    if not len(words):
        return out
    found, terms = buckets(words), np.zeros(len(words))
    for k, (margin, weight) in enumerate(zip(how.margins, how.weights, strict=True)):
        a, b = (ratios[j][found[j][0]].astype(float) for j in (2 * k, 2 * k + 1))
        nearer = np.where(found[2 * k][1], np.where(np.abs(a) < np.abs(b), a, b), 0)
        terms += weight * np.minimum(nearer + margin, 0)
    total = np.concatenate([np.zeros(1), np.cumsum(terms)])
    # No term is above zero, so the shorter windows at a text's end are never the least.
    at = np.arange(len(terms))
    sums = total[np.minimum(at + how.window, words.last)] - total[at]
    out[held] = np.minimum.reduceat(sums, words.first[held])
    return np.round(out, 9)


def threshold(keys: np.ndarray, bad: np.ndarray, caution: float) -> float:
    """The least key that is kept: of the cuts with the least cost on labelled texts the
    lowest, in the middle between the keys beside it. Without both kinds nothing is
    rejected."""
    if bad.all() or not bad.any():
        return -np.inf
    cuts = np.unique(keys)
    lost = np.searchsorted(np.sort(keys[~bad]), cuts) / (~bad).sum()
    missed = 1 - np.searchsorted(np.sort(keys[bad]), cuts) / bad.sum()
    best = int(np.argmin(caution * lost + missed))
    return float(cuts[best - 1] + cuts[best]) / 2 if best else -np.inf


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting in ever narrower ranges (1024 counts each)."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / 1024
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        where = F.least(F.lit(1023), F.floor((F.col(column) - low) / width).cast("int"))
        seen, above = 0, df.where(F.col(column) > high).count()
        ranges = inside.groupBy(where.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("x"), F.max(column).alias("y")).orderBy(F.desc("b")).collect()
        for r in ranges:
            seen += r["n"]
            if above + seen >= k:
                low, high = (r["x"], r["y"]) if (r["x"], r["y"]) != (low, high) else (r["y"], r["y"])
                break
    return high


def noise(doc_id: Column, text: Column, seed: int) -> Column:
    """Gumbel noise that equal rows share."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


@dataclass
class Classifier:
    """A fitted classifier: the table of log ratios (broadcast) and the least key that is
    among the top k."""

    ratios: object
    cut: float
    how: Resampling

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id, log_weight, gumbel_key for each row of docs."""
        table, how = self.ratios, self.how
        schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("noise", pa.float64())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, words in parts(batch):
                    given = (batch.column(c).slice(first, last - first) for c in ("doc_id", "noise"))
                    yield _shared.arrow_out(schema, [next(given), log_weights(words, table.value, how), next(given)])

        plain = _shared.documents(docs)
        scored = plain.withColumn("noise", noise(plain["doc_id"], plain["text"], how.seed + 2)).mapInArrow(score, "doc_id long, log_weight double, noise double")
        return scored.select("doc_id", "log_weight", (F.col("log_weight") / how.temperature + F.col("noise")).alias("gumbel_key"))

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are kept, whole and in place: no shuffle."""
        table, how, cut, names = self.ratios, self.how, self.cut, docs.columns
        text, id_ = (f"c{_shared.place(names, n)}" for n in ("text", "doc_id"))
        inner = _shared.numbered(docs)
        noisy = inner.withColumn("noise", noise(F.col(id_).cast("long"), F.col(text).cast("string"), how.seed + 2))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [log_weights(words, table.value, how) for _, _, words in parts(batch, text)]
                if found:
                    good = np.concatenate(found) / how.temperature + batch.column("noise").to_numpy() >= cut
                    yield batch.drop_columns(["noise"]).filter(pa.array(good))

        return noisy.mapInArrow(keep, inner.schema).toDF(*names)


def fit(docs: DataFrame, labels: DataFrame, how: Resampling = Resampling()) -> Classifier:
    """Count both models over docs and set k."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    marked = _shared.only(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    order = F.xxhash64(F.col("doc_id"), F.lit(how.seed))
    chosen = [marked.where(F.col("bad") == bad).orderBy(order, "doc_id").limit(how.sample) for bad in (False, True)]
    # Half of the good sample trains; the rest and the bad sample tell k.
    sample = chosen[0].union(chosen[1]).withColumn("train", ~F.col("bad") & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(how.seed + 1)), F.lit(2)) == 0))
    sample = F.broadcast(_shared.written(sample, "labelled"))  # 2 * how.sample rows at most
    plain = _shared.documents(docs)
    counts = counted(plain.join(sample, "doc_id", "left").select("text", F.coalesce("train", F.lit(False)).alias("target")))
    ratios = log_ratios(counts, how.smoothing) if counts[1].any() else np.zeros((TABLES, BUCKETS), np.float32)
    out = Classifier(spark.sparkContext.broadcast(ratios), -np.inf, how)
    if how.share is not None:
        keys = _shared.written(out.scores(docs), "keys")
        k = int(np.ceil(how.share * keys.count()))
        out.cut = kth_largest(keys, "gumbel_key", k) if k else np.inf
        return out
    held = sample.where("not train")
    found = out.scores(plain.join(held, "doc_id", "left_semi")).join(held, "doc_id").select("gumbel_key", "bad").distinct()
    rows = found.collect()  # equal texts of one doc_id count once
    if rows:
        keys, bad = (np.array(x) for x in zip(*rows, strict=True))
        out.cut = threshold(keys, bad.astype(bool), how.caution)
    return out


def resample(docs: DataFrame, labels: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept: a row for each document."""
    fitted = fit(docs, labels, how)
    return fitted.scores(docs).withColumn("kept", F.col("gumbel_key") >= F.lit(float(fitted.cut)))
