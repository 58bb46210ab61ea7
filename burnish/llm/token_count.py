"""Token counts by a compiled finite-state transducer (operator 7).

A BPE vocabulary is compiled, on demand, into a deterministic transducer over
characters. A state holds what decides the future of a text: its longest end that
begins some piece, and for every place inside that end the last token of the text up
to there (with the token count there, relative to now). A transition is annotated
with the tokens it emits: by how many the count of the text so far changes, which may
be negative where pieces grow together. The next token is the one that ends here and
may follow the last token before it; two tokens may follow each other if the merges
leave their concatenation in these two.

Texts are cut into chunks that all run at once. A chunk's map from entry state to exit
state and count is tabulated at the entry state that a short run-up gives; maps are
composed from left to right as a prefix scan, and where a chunk was entered in another
state than assumed, its map is tabulated there too. The counts are thereby exact.

Memory is bounded: the table has a column for each class of characters met, and starts
anew beyond CELLS cells. A model has a class for each character of its longer pieces and
a few for all others, so texts of any mixture of characters take the same path.

Defined results: a null text counts as empty (no bytes, no tokens); rows that repeat a
doc_id have a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _shared

CHUNK, RUN_UP = 256, 24
#: Cells of the table kept at once (five bytes each), and the columns it begins with.
CELLS, COLUMNS = 32_000_000, 128
SPACE = "▁"
#: Ends a text; no valid text holds it.
END = "\ud800"


class Transducer:
    """Counts tokens of a sentencepiece BPE model with byte fallback, whose pieces hold
    the space mark at their start only, or nothing but space marks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(model.vocab_size())]
        self.score = {model.id_to_piece(i): model.get_score(i) for i, other in enumerate(kinds) if not other}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.score):
            raise ValueError("pieces with a space mark inside aren't supported")
        if model.encode("a  ﬁ", out_type=str)[-1] != "ﬁ" or model.encode("", out_type=str):
            raise ValueError("only models without normalization are supported")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.joint = {c for p in self.score if len(p) > 1 for c in p}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.classes = np.zeros(0x110000, np.uint16)  # 0: not seen yet
        self.members: list[str | None] = [None]
        self.of_char: dict[str, int] = {}
        self.lone: dict[int, int] = {}
        self.index: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, COLUMNS), -1, np.int32)
        self.emits = np.zeros((1024, COLUMNS), np.int8)
        self.empty = self.state(("", (None,), (0,)))

    def state(self, key: tuple) -> int:
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.states)
            self.states.append(key)
            if at >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        return at

    def merged(self, text: str) -> list[str]:
        """Merges in order of score, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(range(len(scores)), key=scores.__getitem__)
            if scores[best] == -np.inf:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, last: str | None, token: str) -> bool:
        pair = (last or "", token)
        fits = self.fits.get(pair)
        if fits is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            fits = self.fits[pair] = self.merged(pair[0] + token) == [p for p in pair if p]
        return fits

    def classify(self, points: np.ndarray) -> None:
        """Classes for characters not seen before: one for each that occurs in longer
        pieces, and one for each number of tokens of those that stand alone."""
        for point in np.unique(points).tolist():
            char = chr(point)
            if char in (" ", SPACE):
                held = self.member(SPACE)
            elif char in self.joint:
                held = self.member(char)
            else:
                emits = 0 if char == END else 1 if char in self.score else len(char.encode())
                held = self.lone.get(emits)
                if held is None:
                    held = self.lone[emits] = self.member(None)
            self.classes[point] = held

    def member(self, char: str | None) -> int:
        if char is not None and char in self.of_char:
            return self.of_char[char]
        held = len(self.members)
        self.members.append(char)
        if char is not None:
            self.of_char[char] = held
        if held == self.next.shape[1]:
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
            self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)], axis=1)
        return held

    def compile(self, state: int, held: int) -> None:
        """The transition of one state under one class."""
        char = self.members[held]
        if char is None:
            self.next[state, held] = self.empty
            self.emits[state, held] = next(n for n, c in self.lone.items() if c == held)
            return
        end, last, count = self.states[state]
        if char == SPACE and not end.endswith(SPACE):
            end, last, count = self.states[self.empty]
        grown = end + char
        for k in range(len(grown)):  # the longest token first
            if grown[k:] in self.score and self.may_follow(last[k], grown[k:]):
                break
        else:
            raise AssertionError(f"no token ends {grown!r}")
        emits = count[k] + 1
        keep = next(j for j in range(len(grown) + 1) if grown[j:] in self.begins or j == len(grown))
        # Places from which no piece can reach beyond here don't matter any more.
        open_ = [j == len(grown) or grown[j:] in self.begins for j in range(keep, len(grown) + 1)]
        tokens, counts = (*last, grown[k:])[keep:], (*count, emits)[keep:]
        key = (grown[keep:], tuple(t if o else "" for t, o in zip(tokens, open_, strict=True)), tuple(c - emits if o else 0 for c, o in zip(counts, open_, strict=True)))
        after = self.state(key)  # may replace the tables by longer ones
        self.next[state, held] = after
        self.emits[state, held] = emits

    def step(self, state: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self.next[state, held]
        if (after < 0).any():
            gone = after < 0
            for s, c in {*zip(state[gone].tolist(), held[gone].tolist(), strict=True)}:
                self.compile(s, c)
            after = self.next[state, held]
        return after, self.emits[state, held]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        sizes = np.array([len(t) + 2 if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join([f"{SPACE}{t}{END}" for t in texts if t]).encode("utf-32-le", "surrogatepass"), "<u4")
        total = np.zeros(len(texts), np.int64)
        if not len(points):
            return total
        if len(self.states) * self.next.shape[1] > CELLS:
            self.reset()
        emitted = self.emissions(points)
        sums = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])
        stops = np.cumsum(sizes)
        return sums[stops] - sums[stops - sizes]

    def emissions(self, points: np.ndarray) -> np.ndarray:
        held = self.classes[points]
        if not held.all():
            self.classify(points[held == 0])
            held = self.classes[points]
        n = len(points)
        chunks = -(-n // CHUNK)
        end = next((c for e, c in self.lone.items() if e == 0))
        padded = np.full(RUN_UP + chunks * CHUNK, end, np.uint16)
        padded[RUN_UP : RUN_UP + n] = held
        rows = padded[RUN_UP:].reshape(chunks, CHUNK)
        runs = np.lib.stride_tricks.sliding_window_view(padded, RUN_UP)[::CHUNK][:chunks]
        state = np.full(chunks, self.empty, np.int32)
        for k in range(RUN_UP):
            state, _ = self.step(state, runs[:, k])
        enter = state.copy()
        out = np.zeros((CHUNK, chunks), np.int8)
        for k in range(CHUNK):
            state, out[k] = self.step(state, rows[:, k])
        leave = state
        while True:  # compose: each chunk must have been entered as its predecessor was left
            wrong = np.flatnonzero(enter[1:] != leave[:-1]) + 1
            if not len(wrong):
                break
            # the first of each run of wrong ones has a predecessor that stands
            first = wrong[np.concatenate([[True], np.diff(wrong) > 1])]
            state = enter[first] = leave[first - 1]
            for k in range(CHUNK):
                state, out[k, first] = self.step(state, rows[first, k])
            leave[first] = state
        return out.T.reshape(-1)[:n]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

_loaded: dict[str, Transducer] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit)."""
    _shared.prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from burnish.llm import token_count

        for batch in batches:
            held = token_count._loaded  # a worker keeps its table from task to task
            if model not in held:
                held[model] = token_count.Transducer(model)
            column = _shared.texts(batch)
            for first, last in _shared.slices(column):
                part = column.slice(first, last - first)
                n = held[model].counts(part.to_pylist())
                size = np.diff(_shared.raw(part)[1])
                yield _shared.arrow_out(SCHEMA, [batch.column("doc_id").slice(first, last - first), size, n, n > limit])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
