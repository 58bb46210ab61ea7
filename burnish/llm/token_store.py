"""Token ids in independent zstandard frames (operator 6).

A file is a sequence of zstandard frames that any zstandard reader accepts:

* a skippable frame with a JSON header (format version, bytes of an id, end id);
* one frame for each document, ids little-endian, with zstandard's own checksum;
* a skippable frame with the document ids (int64 each) and a null flag for each;
* a trailing skippable frame, the seek table of the public seekable format:
  compressed size, content size and the low 32 bits of the content's XXH64 for
  every frame before it, then the number of frames, a flag byte and a magic number.

A reader takes the tail of the file, finds a document's frame by the running sum
of compressed sizes, and decompresses that frame alone.

Texts are encoded before they are dealt out, so that only ids, in the bytes that the
files hold, are shuffled. Rows go to files by doc_id, hash of the text and a number of
the row, so that neither a repeated doc_id nor a repeated row has to fit in one file.

Defined results: a null text counts as empty and is stored as the end id alone; a
null doc_id sorts first; repeated doc_ids are stored once for each row, ordered by a
hash of the text, so the order depends on nothing but the rows (equal rows are stored
alike); a text of any length is one frame, encoded in slices; an id that needs more
bytes than `width` is an error; an empty table makes no files; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, units

SKIPPABLE_HEADER, SKIPPABLE_INDEX, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A51, 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class TokenFileWriter:
    """Writes one file; documents in the order given."""

    def __init__(self, out, width: int, end_id: int, level: int = 3):
        self.out, self.width = out, width
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.sizes: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.n_ids = 0
        head = _skippable(SKIPPABLE_HEADER, json.dumps({"version": 1, "width": width, "end_id": end_id}).encode())
        self.out.write(head)
        self.sizes.append((len(head), 0, 0))

    def add(self, doc_id: int | None, content: bytes) -> None:
        """content: ids, little-endian, of `width` bytes each."""
        frame = self.compressor.compress(content)
        self.out.write(frame)
        # A frame ends with the low 32 bits of its content's XXH64.
        self.sizes.append((len(frame), len(content), int.from_bytes(frame[-4:], "little")))
        self.doc_ids.append(doc_id)
        self.n_ids += len(content) // self.width

    def close(self) -> None:
        known = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + bytes(d is None for d in self.doc_ids)
        index = _skippable(SKIPPABLE_INDEX, known)
        self.out.write(index)
        self.sizes.append((len(index), 0, 0))
        table = np.array(self.sizes, "<u4").tobytes()
        self.out.write(_skippable(SKIPPABLE_SEEK, table + struct.pack("<IBI", len(self.sizes), CHECKSUM_FLAG, SEEK_MAGIC)))


class TokenFileReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3)
        ends = np.cumsum(self.table[:, 0].astype(np.int64))
        self.starts = np.concatenate([[0], ends[:-1]])
        if ends[-1] + 8 + 12 * frames + 9 != size:
            raise ValueError("the seek table doesn't fit the file")
        self.header = json.loads(self._read(0)[8:])
        self.docs = frames - 2
        known = self._read(frames - 1)[8:]
        ids = np.frombuffer(known[: 8 * self.docs], "<i8")
        self.doc_ids = [None if gone else int(d) for d, gone in zip(ids, known[8 * self.docs :], strict=True)]
        self.decompressor = zstandard.ZstdDecompressor()

    def _read(self, frame: int) -> bytes:
        self.source.seek(int(self.starts[frame]))
        return self.source.read(int(self.table[frame, 0]))

    def lengths(self) -> np.ndarray:
        return self.table[1:-1, 1].astype(np.int64) // self.header["width"]

    def document(self, k: int) -> np.ndarray:
        """ids of the k-th document; only its frame is read and decompressed."""
        _, size, checksum = (int(x) for x in self.table[k + 1])
        content = self.decompressor.decompress(self._read(k + 1), max_output_size=size) if size else b""
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"document {k}: checksum differs")
        return np.frombuffer(content, f"<u{self.header['width']}")


MANIFEST = pa.schema([("file", pa.int64()), ("uri", pa.string()), ("docs", pa.int64()), ("n_ids", pa.int64())])
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.int64()), ("frame", pa.int64())])


def narrow(ids: bytes | memoryview, end_id: int, width: int) -> bytes:
    """ids of 32 bits and the end id in `width` bytes each."""
    out = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
    if width < 4 and int(out.max()) >> 8 * width:
        raise ValueError(f"an id doesn't fit in {width} bytes")
    return out.astype(f"<u{width}").tobytes()


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """doc_id, hash (of the text), row (a number) and ids of each row, as the files hold them."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = units.encoder(tokenizer, keeps_space=True)
        for batch in batches:
            # A batch may hold long texts, so ids are sent on in parts.
            at, held, size = 0, [], 0
            for ids in encoder.each(_shared.texts(batch)):
                held.append(narrow(ids, end_id, width))
                size += len(held[-1])
                if size > _shared.SLICE_BYTES:
                    yield _shared.arrow_out(schema, [*(batch.column(c).slice(at, len(held)) for c in schema.names[:3]), held])
                    at, held, size = at + len(held), [], 0
            if held:
                yield _shared.arrow_out(schema, [*(batch.column(c).slice(at, len(held)) for c in schema.names[:3]), held])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    return plain.mapInArrow(encode, "doc_id long, hash long, row long, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, files: int | None = None, width: int = 2) -> list[dict]:
    """Encode whole texts and write them in ascending doc_id order.

    File k holds smaller ids than file k + 1; every task writes one file under a name
    of its own and then renames it, so a repeated task changes nothing. Returns the
    manifest, a row for each file, in order.
    """
    spark = docs.sparkSession
    _shared.prepare(spark)
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, path = pafs.FileSystem.from_uri(folder)
        target, writer = f"{path}/part-{part:06d}.ids.zst", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{target}.{attempt}")
                writer = TokenFileWriter(out, width, end_id)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                writer.add(doc_id, ids.as_py())
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{target}.{attempt}", target)
            yield _shared.arrow_out(MANIFEST, [[part], [f"{folder}/part-{part:06d}.ids.zst"], [len(writer.doc_ids)], [writer.n_ids]])

    # Written first: the ranges are found by reading twice.
    held = _shared.written(encoded(docs, tokenizer, end_id, width), "encoded")
    order = ("doc_id", "hash", "row")
    dealt = held.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    rows = dealt.mapInArrow(write, "file long, uri string, docs long, n_ids long").collect()  # a row for each file
    _shared.discard(held)
    return sorted((r.asDict() for r in rows), key=lambda r: r["file"])


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """A row for each stored document, decompressed frame by frame."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file long, frame long"
    rows, before = [], 0
    for r in manifest:
        rows.append((r["file"], r["uri"], before))
        before += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, uri, start in zip(*(batch.column(c).to_pylist() for c in ("file", "uri", "start")), strict=True):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as source:
                    reader = TokenFileReader(source)
                    for first in range(0, reader.docs, 5000):
                        count, crc = [], []
                        for k in range(first, min(first + 5000, reader.docs)):
                            ids = reader.document(k)
                            count.append(len(ids))
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        begins = start + np.concatenate([[0], np.cumsum(count)])
                        start = int(begins[-1])
                        n = len(count)
                        yield _shared.arrow_out(DOCUMENTS, [reader.doc_ids[first : first + n], begins[:-1], count, crc, [file] * n, range(first, first + n)])

    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "file long, uri string, start long").repartition(len(rows))
    return files.mapInArrow(read, schema)


def token_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Write the token files and return what reading them back gives."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, tokenizer, folder or _shared.fresh_path(spark, "tokens"), end_id, files)
    return read_tokens(spark, manifest)
