"""SimHash near-duplicates through BK-trees (operator 1).

1. Every text gets a 64-bit fingerprint: bit b is set if it is set in over half of
   the XXH64 values of its shingles.
2. Equal fingerprints meet first, so copies cost no comparison.
3. Two fingerprints that differ in at most `radius` bits agree on all but `radius`
   of any blocks they are cut into. With six blocks and radius 2 they agree on four,
   so each fingerprint goes to the 15 shards named by its choices of four blocks.
   A shard fixes at least 42 bits: it holds 2**22 fingerprints at the very most,
   32 MB, however many documents there are.
4. A shard's task builds the shard's BK-tree (children keyed by their integer
   distance to the parent) and sends its members down it as one stream that follows
   only edges within the radius. It returns a spanning link to the smallest member
   of each linked set, never all pairs.
5. Linked sets of different shards are joined by alternating large-star and
   small-star steps, each a written table, until nothing changes.

Broadcasting the tree of every shard to every worker would compare each
fingerprint with N / (shard size) trees; sending fingerprints to the few shards
that can hold a neighbour finds the same links with work in proportion to N.

Defined results: a null or empty text has fingerprint zero and links like any
other; a null doc_id never is the smallest of a component unless all are null;
repeated rows appear once each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

RADIUS = 2
SEED = 42
#: Where the six blocks of a fingerprint begin and end.
BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
#: Groups of up to so many fingerprints use the plain tree.
SMALL = 48

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints (unsigned) of UTF-8 texts; no word gives zero."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(xxhash.xxh64_intdigest(joined, SEED))
            sizes[k] = 1
            continue
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        start = stop - np.diff(stop, prepend=0)
        parts = [joined[a:b] for a, b in zip(start[: 1 - shingle].tolist(), (stop[shingle - 1 :] - 1).tolist(), strict=True)]
        hashes.extend(map(xxhash.xxh64_intdigest, parts, repeat(SEED)))
        sizes[k] = len(parts)
    out = np.zeros(len(texts), np.uint64)
    held = np.flatnonzero(sizes)
    if not len(held):
        return out
    n = sizes[held]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
    out[held] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


class BKTree:
    """A node is its value and its children, keyed by distance."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if not d:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            at, children = open_.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children.items():
                if abs(edge - d) <= radius:
                    open_.append(child)
        return found


def linked(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct rising values the position of the smallest that it
    is linked with, directly or through others."""
    parent = list(range(len(values)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if len(values) <= SMALL:
        tree, where = BKTree(), {}
        for k, value in enumerate(values.tolist()):
            for near in tree.within(value, radius):
                union(k, where[near])
            tree.add(value)
            where[value] = k
    else:
        # The same tree, each node reached once with all values that come that far.
        every = np.arange(len(values))
        open_ = [(every, every)]
        while open_:
            members, asking = open_.pop()
            root, rest = members[0], members[1:]
            d = np.bitwise_count(values[asking] ^ values[root])
            for k in asking[d <= radius].tolist():
                union(k, int(root))
            if len(rest):
                edges = np.bitwise_count(values[rest] ^ values[root])
                for edge in np.unique(edges).tolist():
                    follow = asking[np.abs(d.astype(np.int16) - edge) <= radius]
                    if len(follow):
                        open_.append((rest[edges == edge], follow))
    return np.array([find(k) for k in range(len(values))], np.int64)


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long with the bits of the unsigned value)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _shared.texts(batch)
            for first, last in _shared.slices(column):
                data, ends = _shared.raw(column.slice(first, last - first))
                whole, cut = data.tobytes(), ends.tolist()
                found = fingerprints([whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], shingle)
                yield _shared.arrow_out(schema, [batch.column("doc_id").slice(first, last - first), found.view(np.int64)])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


def shard_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (u, v), u > v, between the distinct fingerprints of column fp."""
    choices = list(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))
    masks = [sum(((1 << b) - (1 << a)) for a, b in (BLOCKS[i] for i in c)) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    dealt = prints.select("fp", F.explode(keys).alias("x")).select("x.t", "x.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in _with_end(batches):
            if batch is not None:
                rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "fp")])
                kept = rows if kept is None else np.concatenate([kept, rows], axis=1)
            if kept is None or not kept.shape[1]:
                continue
            t, key, fp = kept
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(t)]])
            if batch is not None:  # the last group may go on
                bounds = bounds[:-1]
                kept = kept[:, bounds[-1] :]
            u, v = [], []
            large = np.flatnonzero(np.diff(bounds) > 1)
            for a, b in zip(bounds[large].tolist(), bounds[large + 1].tolist(), strict=True):
                values = fp[a:b]
                roots = linked(values.view(np.uint64), radius)
                other = np.flatnonzero(roots != np.arange(b - a))
                u.append(values[other])
                v.append(values[roots[other]])
            if u:
                yield _shared.arrow_out(schema, [np.concatenate(u), np.concatenate(v)])

    return dealt.mapInArrow(run, "u long, v long").where("u != v").distinct()


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): rows (u, v) with v the least of u's
    component, for every u but the least. Alternating stars; every step is written."""

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()

    edges = _shared.written(turned(links), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _shared.written(turned(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = _shared.written(turned(small), "small")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            return edges


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    _shared.prepare(docs.sparkSession)
    prints = _shared.written(with_fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(shard_links(distinct, radius))
    named = distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id
    (of rows that repeat it the first by text). Rows without a doc_id stay."""
    from pyspark.sql.window import Window

    found = near_duplicates(docs, shingle, radius)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    first = docs.join(kept, docs["doc_id"].cast("long") == kept["__kept"], "left_semi")
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__n = 1").drop("__n")
    return first.unionByName(docs.where(docs["doc_id"].isNull()))
