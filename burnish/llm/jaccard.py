"""Near-duplicates of Jaccard similarity 0.8 or more through SimHash, for the pipeline's stage.

Operator 1's radius of 2 bits can't serve here: two texts whose sets of shingles have a
Jaccard similarity of 0.8 differ in about ten of 64 bits. With a radius that holds them
all, blocks of bits tell no shards apart, so shards are named by shingles instead:

1. Every text becomes the set of XXH64 values of its shingles and the set's 64-bit
   fingerprint. Texts with equal sets meet first, so copies cost no comparison.
2. All sets are put in one order: shingles that are frequent in a sample come last.
   Two similar sets share a shingle among the first n - ceil(s n) + 1 of each, so a
   fingerprint is sent only to the shards of those shingles. The order decides the cost,
   never the result.
3. A shard is a BK-tree of fingerprints, asked for all within RADIUS bits. Each bit of two
   similar sets differs with a probability of 0.19 at most (sets of four and five), 0.15 if
   they are large, so a pair lies outside with one of about 1e-6, or 1e-8. Places that find
   nothing in their shard go no further, the others take 1024 parities of their set along.
   Only pairs that sizes, positions and parities don't rule out leave a shard; they are
   counted exactly.
4. First each set asks a tree of a fixed number of its shard. Linked sets are joined by the
   alternating stars of operator 1, so that a large group of near copies is one component
   after work in proportion to its size.
5. Where sets of different components meet, each set outside the largest component there
   asks the tree of all others. Those found go to the exact count in rounds, the nearest by
   parities first, and a set goes on to farther ones only while they are of another
   component than its own has become, until none are left. So a set among many near
   copies makes few pairs and no link is lost. Pairs within a component are never made.

Defined results: texts are lower-cased (A-Z) and cut at ASCII blanks; a text of fewer
words than a shingle is one shingle; null and empty texts are equal; of each group the
row with the smallest doc_id stays (of equals the smallest hash of the text, nulls last),
and rows that repeat both appear once. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared
from .simhash import LOWER, SEED, _with_end, components

SHINGLE = 5
#: The least similarity of near-duplicates, as a fraction.
SIMILAR = (4, 5)
#: So many texts tell which shingles are frequent, and so many shingles are held so.
SAMPLE, FREQUENT = 20_000, 1 << 18
#: Fingerprints of similar sets differ in so many bits at most.
RADIUS = 28
#: Words of 64 bits of a set's parities; a member falls to a bit by its first 10 bits.
WORDS = 16
#: So many members of a shingle's group are compared with all others first.
LEADERS = 4
#: Pairs of one shingle are looked at in pieces of about this many.
PAIRS = 1 << 20
#: Parities are compared for so many pairs at once (8 MB a side).
COMPARED = 1 << 16
#: A set's pairs go to the exact count up to this rank in the first round, in each further
#: round up to so many times the rank before.
NEAREST, FARTHER = 8, 16
#: Names of the texts to compare are broadcast up to this size of their files (16 bytes
#: a text, some 50 in memory); beyond it the texts are shuffled.
BROADCAST_BYTES = 32 << 20


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The rising distinct hashes of a text's shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = stop - np.diff(stop, prepend=0)
    parts = [joined[a:b] for a, b in zip(start[: 1 - shingle].tolist(), (stop[shingle - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit name of a set; the empty set is 0."""
    whole = xxhash.xxh64_intdigest(values.tobytes(), SEED + 1) if len(values) else 0
    return whole - (1 << 64) if whole >> 63 else whole


def prefix(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set by which it meets all sets similar to it."""
    p, q = SIMILAR
    many = len(values) + (-p * len(values)) // q + 1
    if len(frequent):
        at = np.searchsorted(frequent, values)
        late = frequent[np.minimum(at, len(frequent) - 1)] == values
        values = np.concatenate([values[~late], values[late]])
    return values[:many]


def fingerprint(values: np.ndarray) -> int:
    """The SimHash of a set, signed: a bit is set if it is in over half of the members."""
    ones = np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def parities(values: np.ndarray) -> bytes:
    """WORDS * 64 bits, each the parity of the number of members that fall to it."""
    return np.packbits((np.bincount((values >> np.uint64(64 - 10)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).tobytes()


def close(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members with so many in common are similar."""
    p, q = SIMILAR
    return (p + q) * common >= p * (n + m)


def _each(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    column = _shared.texts(batch)
    for first, last in _shared.slices(column):
        data, ends = _shared.raw(column.slice(first, last - first))
        whole, cut = data.tobytes(), ends.tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield shingles(whole[a:b], shingle)


def frequent_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a sample, rising."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in _each(batch, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["s"])

    hashed = texts.select(F.xxhash64(F.lit(SEED), "text").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select("text")
    counts = some.mapInArrow(run, "s long").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT)
    held = _shared.written(counts, "frequent")
    out = [r.s for r in held.collect()]
    _shared.discard(held)
    return np.unique(np.array(out, np.int64).view(np.uint64))  # FREQUENT rows at most


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by s, in whole groups, and where the groups begin and end."""
    kept = None
    for batch in _with_end(batches):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
        if kept is None or not kept.num_rows:
            continue
        s = kept.column("s").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
        whole = kept
        if batch is not None:  # the last group may go on
            bounds = bounds[:-1]
            kept = kept.slice(bounds[-1]).combine_chunks()
        if len(bounds) > 1:
            yield whole.slice(0, bounds[-1]), bounds


class Forest:
    """A BK-tree of each group's fingerprints, all built and asked at once, level by level.
    A node is a distinct fingerprint of its group, its children are keyed by distance."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.members = np.lexsort((value, group))
        group, value = group[self.members], value[self.members]
        self.first = np.flatnonzero(_starts(group) | _starts(value))
        self.many = np.diff(np.append(self.first, len(group)))
        group, self.value = group[self.first], value[self.first]
        self.groups, self.roots = group[_starts(group)], np.flatnonzero(_starts(group))
        self.edge, parent = np.zeros(len(group), np.int64), np.full(len(group), -1)
        nodes, subtree = np.arange(len(group)), group
        while len(nodes):
            top = _starts(subtree)
            above = nodes[top][np.cumsum(top) - 1][~top]
            nodes = nodes[~top]
            subtree = above * 65 + np.bitwise_count(self.value[nodes] ^ self.value[above])
            order = np.argsort(subtree, kind="stable")
            nodes, subtree = nodes[order], subtree[order]
            new = _starts(subtree)
            parent[nodes[new]], self.edge[nodes[new]] = np.divmod(subtree[new], 65)
        self.children = np.argsort(parent, kind="stable")
        self.begin = np.searchsorted(parent[self.children], np.arange(len(group)))
        self.end = np.searchsorted(parent[self.children], np.arange(len(group)), "right")

    def within(self, group: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of those who ask and of the members of their group within the radius."""
        who, node = np.arange(len(value)), self.roots[np.searchsorted(self.groups, group)]
        asking, found = [who[:0]], [who[:0]]
        while len(who):
            apart = np.bitwise_count(value[who] ^ self.value[node]).astype(np.int64)
            near = apart <= radius
            at, every = _ranges(self.first[node[near]], self.many[node[near]])
            asking.append(who[near][every])
            found.append(self.members[at])
            at, every = _ranges(self.begin[node], (self.end - self.begin)[node])
            node, who, apart = self.children[at], who[every], apart[every]
            follow = np.abs(self.edge[node] - apart) <= radius
            node, who = node[follow], who[follow]
        return np.concatenate(asking), np.concatenate(found)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


def _ranges(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin, begin + 1, ... of all ranges, and which range each is of."""
    which = np.repeat(np.arange(len(many)), many)
    return np.arange(len(which)) + np.repeat(begin - (np.cumsum(many) - many), many), which


class Shards:
    """The places of whole shards, their bounds known; s, key, n, pos, fp, perhaps bits and component."""

    def __init__(self, rows: pa.Table, bounds: np.ndarray, radius: int):
        self.key, self.n, self.pos, fp = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "pos", "fp"))
        self.fp = fp.view(np.uint64)
        self.component = rows.column("component").to_numpy() if "component" in rows.column_names else self.key
        self.bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, WORDS) if "bits" in rows.column_names else None
        self.bounds, self.radius = bounds, radius
        self.shard = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def leaders(self) -> np.ndarray:
        """Of each shard LEADERS members spread over its sizes."""
        return np.unique([self.bounds[:-1] + np.diff(self.bounds) * (2 * k + 1) // (2 * LEADERS) for k in range(LEADERS)])

    def large(self) -> np.ndarray:
        """Which places are of their shard's largest component."""
        order = np.lexsort((self.component, self.shard))
        run = np.cumsum(_starts(self.shard[order]) | _starts(self.component[order])) - 1
        many = np.bincount(run)
        largest = np.maximum.reduceat(many[run], self.bounds[:-1])
        where = np.flatnonzero(many[run] == largest[self.shard])
        first = np.minimum.reduceat(np.where(many[run] == largest[self.shard], run, len(run)), self.bounds[:-1])
        out = np.zeros(len(run), bool)
        out[order[where[run[where] == first[self.shard[where]]]]] = True
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the parities of places differ; none where there are no parities.
        Sets differ in as many members at least."""
        if self.bits is None:
            return np.zeros(len(a), np.int64)
        parts = [np.bitwise_count(self.bits[a[k : k + COMPARED]] ^ self.bits[b[k : k + COMPARED]]).sum(1, dtype=np.int64) for k in range(0, len(a), COMPARED)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def near(self, members: np.ndarray, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of those who ask and of members of their shard, of different components,
        within the radius, and that sizes, positions and parities don't rule out; and the
        share of members that parities tell apart. All of one who asks come at once."""
        if not len(members) or not len(asking):
            return
        trees = Forest(self.shard[members], self.fp[members])
        work = np.cumsum(np.bincount(self.shard[members], minlength=len(self.bounds))[self.shard[asking]]) // PAIRS
        for some in np.split(asking, np.flatnonzero(np.diff(work)) + 1):
            a, b = trees.within(self.shard[some], self.fp[some], self.radius)
            a, b = some[a], members[b]
            use = np.flatnonzero((self.component[a] != self.component[b]) & close(self.n[a], self.n[b], np.minimum(self.n[a] - self.pos[a], self.n[b] - self.pos[b])))
            a, b = a[use], b[use]
            both, apart = self.n[a] + self.n[b], self.apart(a, b)
            use = np.flatnonzero(close(self.n[a], self.n[b], (both - apart) // 2))
            yield a[use], b[use], apart[use] / np.maximum(both[use], 1)


def shared(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """s, key, n, pos, fp: the places in prefixes of shingles where a set finds another that
    may be similar. sets: key, n, fp, prefix, keys distinct."""
    dealt = sets.select("key", "n", "fp", F.posexplode("prefix").alias("pos", "s")).select("s", "key", "n", "pos", "fp").repartition("s").sortWithinPartitions("s", "n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in groups(batches):
            size = np.diff(bounds)
            rows = rows.filter(pa.array(np.repeat(size > 1, size)))
            if not rows.num_rows:
                continue
            held = Shards(rows, np.concatenate([[0], np.cumsum(size[size > 1])]), radius)
            every, kept = np.arange(rows.num_rows), np.zeros(rows.num_rows, bool)
            # Who finds a leader needn't ask the others.
            for members, asking in ((held.leaders, lambda: every), (lambda: every, lambda: np.flatnonzero(~kept))):
                for a, b, _ in held.near(members(), asking()):
                    kept[a] = kept[b] = True
            yield from rows.filter(pa.array(kept)).to_batches()

    return dealt.mapInArrow(run, "s long, key long, n int, pos int, fp long")


def _by_shard(places: DataFrame, *more: str) -> DataFrame:
    return places.select("s", "key", "n", "pos", "fp", "bits", *more).repartition("s").sortWithinPartitions("s", "n", "key")


def starred(places: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct pairs (u, v), u > v, that may be similar: of each set with LEADERS of its
    shard. places: s, key, n, pos, fp, bits."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in groups(batches):
            held = Shards(rows, bounds, radius)
            for a, b, _ in held.near(held.leaders(), np.arange(rows.num_rows)):
                x, y = held.key[a], held.key[b]
                if len(x):
                    yield _shared.arrow_out(schema, [np.maximum(x, y), np.minimum(x, y)])

    return _by_shard(places).mapInArrow(run, "u long, v long").distinct()


def nearest(places: DataFrame, first: int, last: int, radius: int = RADIUS) -> DataFrame:
    """Distinct rows (0, u, v), u > v: pairs that may be similar and are of different
    components now. Each set outside its shard's largest component asks all there. Of those
    it finds the ones from rank first up to last come, the nearest having rank 0; if
    there are farther ones, a row (s, u, u) says so. places: s, key, n, pos, fp, bits, now and
    component, on which ranks depend and which is the same in each round."""
    schema = pa.schema([("s", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in groups(batches):
            held, now, s = Shards(rows, bounds, radius), rows.column("now").to_numpy(), rows.column("s").to_numpy()
            large = held.large()
            asking = np.flatnonzero(~large)
            members = np.flatnonzero(np.isin(held.shard, held.shard[asking]))
            for a, b, apart in held.near(members, asking):
                once = np.flatnonzero(large[b] | (b > a))
                once = once[np.lexsort((b[once], apart[once], a[once]))]
                a, b = a[once], b[once]
                begin = np.flatnonzero(_starts(a))
                rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
                other = now[a] != now[b]
                use, far = other & (rank >= first) & (rank < last), np.unique(a[other & (rank >= last)])
                x, y = held.key[a[use]], held.key[b[use]]
                if len(x) or len(far):
                    yield _shared.arrow_out(schema, [np.concatenate(z) for z in ((np.zeros(len(x), np.int64), s[far]), (np.maximum(x, y), held.key[far]), (np.minimum(x, y), held.key[far]))])

    return _by_shard(places, "component", "now").mapInArrow(run, "s long, u long, v long").distinct()


def similar(pairs: DataFrame, texts: DataFrame, names: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar, written. pairs: written; texts: hash, text;
    names: key and the hash of one of its texts, keys distinct."""
    ends = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    schema = pa.schema([("key", pa.int64()), ("members", pa.binary())])
    links = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _shared.arrow_out(schema, [batch.column("key"), [x.tobytes() for x in _each(batch, shingle)]])

    # Written, so that their size is known before any text moves.
    named = _shared.written(names.join(ends, "key", "left_semi"), "similar_names")
    small = _shared.bytes_written(named) <= BROADCAST_BYTES
    wanted = texts.join(F.broadcast(named) if small else named, "hash").select("key", "text").dropDuplicates(["key"])
    held = _shared.written(wanted.mapInArrow(members, "key long, members binary"), "similar_sets")
    _shared.discard(named)
    one, two = (held.select(F.col("key").alias(c), F.col("members").alias(t)) for c, t in (("u", "a"), ("v", "b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                good.append(bool(close(len(left), len(right), len(np.intersect1d(left, right, assume_unique=True)))))
            yield _shared.arrow_out(links, [batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("u", "v")])

    found = _shared.written(pairs.join(one, "u").join(two, "v").mapInArrow(run, "u long, v long"), "links")
    _shared.discard(held)
    return found


def _labelled(places: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """places with the component of each key, where roots (u, v) names one, else the key."""
    known = roots.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return places.join(known, "key", "left").withColumn(name, F.coalesce("root", "key")).drop("root")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, hash (of the text) and root (the same for all of a group), for each row."""
    _shared.prepare(docs.sparkSession)
    plain = _shared.documents(docs).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(plain, shingle))
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_key(v), len(v), fingerprint(v), parities(v), prefix(v, frequent.value).view(np.int64)) for v in _each(batch, shingle)]
            if found:
                yield _shared.arrow_out(schema, [batch.column("doc_id"), batch.column("hash"), *zip(*found, strict=True)])

    sets = _shared.written(plain.mapInArrow(run, "doc_id long, hash long, key long, n int, fp long, bits binary, prefix array<long>"), "sets")
    texts, names = plain.select("hash", "text"), sets.select("key", "hash").dropDuplicates(["key"])
    distinct, bits = sets.select("key", "n", "fp", "prefix").dropDuplicates(["key"]), sets.select("key", "bits").dropDuplicates(["key"])
    places = _shared.written(shared(distinct, radius).join(bits, "key"), "places")
    stars = _shared.written(starred(places, radius), "stars")
    roots = now = components(similar(stars, texts, names, shingle))
    _shared.discard(stars)
    first, last, left, pairs = 0, NEAREST, places, None
    while True:
        told = _labelled(_labelled(left, roots, "component"), now, "now")
        before, pairs = pairs, _shared.written(nearest(told, first, last, radius), "pairs")
        if before is not None:
            _shared.discard(before)
        now = components(now.union(similar(pairs.where("u != v").select("u", "v"), texts, names, shingle)))
        farther = pairs.where("u = v").select("s").distinct()
        if farther.isEmpty():
            break
        first, last, left = last, last * FARTHER, places.join(farther, "s", "left_semi")
    _shared.discard(pairs)
    _shared.discard(places)
    named = _labelled(sets.select("doc_id", "hash", "key"), now, "root_")
    return named.select("doc_id", "hash", F.col("root_").alias("root"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near-duplicates."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    kept = classes(docs, shingle, radius).groupBy("root").agg(F.min(order).alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("kept_id"), F.col("x.hash").alias("kept_hash")).distinct()
    inner, names = _shared.numbered(docs), docs.columns
    id_, text = F.col(f"c{_shared.place(names, 'doc_id')}"), F.col(f"c{_shared.place(names, 'text')}")
    # Plain equality on three columns, so that the window finds the join's partitioning.
    by = [F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "hash"]
    kept = kept.toDF("id", "hash").select(*by)
    hashed = inner.withColumn("id", id_.cast("long")).withColumn("hash", F.xxhash64(text.cast("string"))).select(*inner.columns, *by)
    first = hashed.join(kept, ["id", "none", "hash"], "left_semi")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("id", "none", "hash").orderBy(text)))
    return ranked.where("n = 1").select(*inner.columns).toDF(*names)
