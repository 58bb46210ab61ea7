"""What the operators of this subpackage share: the folder that driver and
executors both see, written intermediate tables, and Arrow text access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir (tests, one machine).
LOCAL_SHARED = "/tmp/checkpoints"

#: With this Spark removes a query's shuffle files as soon as it ends, not when the
#: driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Texts are handed to numpy in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir. Only a session on one
    machine may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return f"file://{LOCAL_SHARED}"
    return folder.rstrip("/") if "://" in folder else f"file://{os.path.abspath(folder)}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends
    there, and a lost executor costs no recomputation of what came before. The
    shuffle files behind it go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> Iterator[tuple]:
    """A written table's folders and their file system."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        yield path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), path


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing needs any more."""
    for store, path in _folders(df):
        store.delete(path, True)


def bytes_written(df: DataFrame) -> int:
    """The size of a written table's files."""
    return sum(store.getContentSummary(path).getLength() for store, path in _folders(df))


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, since one text may be very long, and this package on
    the workers' path (once for each Spark context)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if getattr(context, "_burnish_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="burnish-"), "burnish_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(archive)
    context._burnish_shipped = True


def place(columns: list[str], name: str) -> int:
    """Which column is meant: the one of that very name, else the first that differs in case only."""
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ..., among which no further name can clash."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever further columns there are."""
    return numbered(docs).select(*[F.col(f"c{place(docs.columns, n)}").alias(n) for n in names])


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string."""
    held = only(docs, "doc_id", "text")
    return held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.LargeStringArray:
    """A text column with nulls as empty strings."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def slices(column: pa.LargeStringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text starts and ends in them."""
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[ends[0] : ends[-1]], ends - ends[0]


def arrow_out(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def row_key(docs: DataFrame) -> DataFrame:
    """docs with a column __row that tells rows apart even where ids repeat."""
    return docs.withColumn("__row", F.monotonically_increasing_id())


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file in the shared folder, at once or not at all."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def mapped(uri: str, kind: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array. Where the folder isn't
    mounted, the worker first takes a copy to its own disk."""
    store, path = pafs.FileSystem.from_uri(uri)
    if not isinstance(store, pafs.LocalFileSystem):
        local = os.path.join(tempfile.mkdtemp(prefix="burnish-"), os.path.basename(path))
        with store.open_input_stream(path) as source, open(local, "wb") as out:
            while block := source.read(1 << 24):
                out.write(block)
        path = local
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
