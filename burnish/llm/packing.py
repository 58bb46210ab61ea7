"""Best-fit packing of documents into sequences (operator 9).

Every document becomes its ids and an end id; a longer one than a sequence is cut
into full pieces and a rest. Pieces are packed by bin completion: around the
largest piece left, the undominated fillings of the rest of the sequence are
enumerated, branches whose waste exceeds what the incumbent allows are pruned, and
best-fit-decreasing gives the first incumbent.

The number of distinct lengths is at most the length of a sequence, so the problem
that the driver solves is a histogram of bounded size, whatever the number of
documents, and its answer is a list of patterns with multiplicities. The pieces
take their places by rank among the pieces of their length.

Defined results: a null text counts as empty (the end id alone); rows that repeat a
doc_id are packed each by itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared, units

SEQUENCE = 4096
#: Pieces of one length are ranked in so many groups.
SALTS = 64
#: Fillings looked at for one largest piece, and nodes of the whole search.
FILLINGS, NODES = 500, 4000

PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def fillings(room: int, sizes: list[int], left: Counter, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of `room`, least waste first. `sizes` falls.

    A filling is dominated if a piece that is left fits beside it, or could take
    the place of one of its pieces; only maximal ones that use the larger pieces
    first are made. `most` bounds the enumeration; greedy filling comes first.
    """
    found: dict[tuple[int, ...], int] = {}
    looked = 0

    def go(at: int, rest: int, chosen: list[int], used: Counter) -> bool:
        nonlocal looked
        looked += 1
        grown = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s <= rest and used[s] < left[s]:
                grown = True
                used[s] += 1
                chosen.append(s)
                exact = go(i, rest - s, chosen, used)
                chosen.pop()
                used[s] -= 1
                if exact or looked >= most:
                    return exact
        if not grown and not any(s <= rest and used[s] < left[s] for s in sizes[:at]):
            found[tuple(chosen)] = rest
            return rest == 0  # no filling beats a full sequence
        return False

    go(0, room, [], Counter())
    if not found:
        found[()] = room
    # One filling dominates another of the same number of pieces if it is as large piece by piece.
    best = sorted(found.items(), key=lambda x: (x[1], len(x[0])))
    kept: list[tuple[int, ...]] = []
    for filling, _ in best[:64]:
        if not any(len(k) == len(filling) and all(a >= b for a, b in zip(k, filling, strict=True)) for k in kept):
            kept.append(filling)
    return kept


def best_fit_decreasing(counts: dict[int, int], size: int) -> Counter:
    """Patterns (falling tuples of lengths) and how many sequences have each.

    Works on groups of equal pieces and equal sequences, so its cost depends on the
    number of lengths and patterns, not of pieces.
    """
    by_rest: dict[int, Counter] = {}
    rests: list[int] = []  # the keys of by_rest, rising

    def opened(rest: int, pattern: tuple[int, ...], times: int) -> None:
        if rest not in by_rest:
            by_rest[rest] = Counter()
            insort(rests, rest)
        by_rest[rest][pattern] += times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rests, length)
            rest = rests[at] if at < len(rests) else None
            if rest is None:
                fit = size // length
                whole, more = divmod(n, fit)
                for k, times in ((fit, whole), (more, 1)):
                    if k and times:
                        opened(size - k * length, (length,) * k, times)
                n = 0
                continue
            open_ = by_rest[rest]
            pattern, times = next(iter(open_.items()))
            fit = rest // length
            take = min(times, n // fit)
            if take:
                k = fit
            else:
                take, k = 1, n
            open_[pattern] -= take
            if not open_[pattern]:
                del open_[pattern]
            if not open_:
                del by_rest[rest], rests[at]
            opened(rest - k * length, pattern + (length,) * k, take)
            n -= take * k
    return sum(by_rest.values(), Counter())


def least_sequences(counts: dict[int, int], size: int) -> int:
    """A lower bound: total length, and Martello and Toth's bound over thresholds."""
    n = np.zeros(size + 1, np.int64)
    n[list(counts)] = list(counts.values())
    pieces_to, length_to = np.cumsum(n), np.cumsum(n * np.arange(size + 1))
    half = size // 2
    k = np.arange(half + 1)  # pieces shorter than k are left out
    large = pieces_to[size] - pieces_to[size - k]
    middle = pieces_to[size - k] - pieces_to[half]
    room = middle * size - (length_to[size - k] - length_to[half])
    small = length_to[half] - length_to[np.maximum(k - 1, 0)]
    return int(max((large + middle + np.maximum(0, -(-(small - room) // size))).max(), -(-length_to[size] // size)))


def pack(counts: dict[int, int], size: int = SEQUENCE, nodes: int = NODES) -> Counter:
    """Bin completion over a histogram of lengths.

    Sequences with the same filling are made together, as often as the pieces
    allow. The search stops at the lower bound, or after `nodes` nodes with the best
    packing so far, which is never worse than best-fit-decreasing.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return Counter()
    incumbent = best_fit_decreasing(counts, size)
    least, best = least_sequences(counts, size), sum(incumbent.values())
    total = sum(k * v for k, v in counts.items())
    seen = 0

    def completions(left: Counter) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
        largest = max(left)
        left[largest] -= 1
        out = fillings(size - largest, sorted((s for s in left if left[s]), reverse=True), left)
        left[largest] += 1
        return largest, [(f, size - largest - sum(f)) for f in out]

    # Depth first without recursion: each level has the untried completions of its largest piece.
    left, chosen, waste, used = Counter(counts), [], 0, 0
    stack: list[list[tuple[tuple[int, ...], int]]] = []

    def allowed() -> int:
        return (best - 1) * size - total  # waste of a packing that beats the incumbent

    while best > least and seen < nodes:
        if any(left.values()):
            left = +left
            largest, options = completions(left)
            seen += 1
            stack.append([((largest, *f), w) for f, w in reversed(options)])
        elif used < best:
            incumbent, best = Counter(), used
            for pattern, times in chosen:
                incumbent[pattern] += times
        placed = False
        while stack and not placed:
            if len(chosen) == len(stack):
                pattern, times = chosen.pop()
                for s in pattern:
                    left[s] += times
                waste -= (size - sum(pattern)) * times
                used -= times
            while stack[-1]:
                pattern, w = stack[-1].pop()
                need = Counter(pattern)
                times = min(left[s] // k for s, k in need.items())
                if waste + w * times > allowed():
                    continue
                for s, k in need.items():
                    left[s] -= k * times
                chosen.append((pattern, times))
                waste, used, placed = waste + w * times, used + times, True
                break
            if not placed:
                stack.pop()
        if not placed:
            break
    return incumbent


def slots(patterns: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on a slot applies, its first sequence, how
    many pieces of that length each of its sequences takes, and the first's offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for pattern in sorted(patterns, reverse=True):
        times, offset = patterns[pattern], 0
        for length, k in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((rank[length], sequence, k, offset))
            rank[length] += k * times
            offset += k * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in out.items()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32."""
    _shared.prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = units.encoder(tokenizer, keeps_space=False), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for row, doc_id, whole in zip(batch.column("__row").to_pylist(), batch.column("doc_id").to_pylist(), encoder.each(_shared.texts(batch)), strict=True):
                ids = memoryview(bytes(whole) + end)
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((row, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield _shared.arrow_out(PIECES, zip(*rows, strict=True))

    plain = _shared.row_key(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    return plain.mapInArrow(cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    cut = _shared.written(pieces(docs, tokenizer, end_id, size), "pieces")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "salt").count()
    # At most `size` lengths x SALTS rows, whatever the number of documents.
    held = np.array([tuple(r) for r in groups.collect()], np.int64).reshape(-1, 3)
    held = held[np.lexsort((held[:, 1], held[:, 0]))]
    lengths, first = np.unique(held[:, 0], return_index=True)
    counts = dict(zip(lengths.tolist(), np.add.reduceat(held[:, 2], first).tolist() if len(held) else [], strict=True))
    before = np.cumsum(held[:, 2]) - held[:, 2]
    base = np.zeros((size + 1, SALTS), np.int64)
    base[held[:, 0], held[:, 1]] = before - before[first][np.searchsorted(lengths, held[:, 0])] if len(held) else 0
    table = spark.sparkContext.broadcast((base, slots(pack(counts, size))))

    schema = pa.schema([*PIECES][1:] + [pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, where = table.value
        for batch in batches:
            n = batch.num_rows
            length, salt = batch.column("length").to_numpy(), batch.column("salt").to_numpy()
            rank = base[length, salt] + batch.column("rank").to_numpy() - 1
            sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if n else []:
                begins, first, each, shift = where[int(length[part[0]])]
                at = np.searchsorted(begins, rank[part], "right") - 1
                inside = rank[part] - begins[at]
                sequence[part] = first[at] + inside // each[at]
                offset[part] = shift[at] + inside % each[at] * length[part]
            yield _shared.arrow_out(schema, [*(batch.column(c) for c in schema.names[:5]), sequence, offset])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
