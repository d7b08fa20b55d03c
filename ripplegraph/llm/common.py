"""Helpers shared by the text operators: byte views of Arrow columns, word names, checkpoints.

Work is done on whole Arrow batches with numpy and Arrow kernels, so a batch of documents costs a few
vector passes and a loop over its different words instead of a Python loop over all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lineage
from ..functions.workers import importable

#: White space of the word rule: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Of the text that a kept table is made of, to a file.
FILE_BYTES = 4 << 20


def prepare(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that the JVM sends (operators cut them further where they need to) and make sure that a checkpoint folder is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    importable(spark)
    lineage.checkpoint_folder(spark)


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Materialise a table that later steps read more than once (reliable checkpoint), as `files` files at most."""
    prepare(df.sparkSession)
    return lineage.cut(df, files)


def files_of(spark: SparkSession, size: int) -> int:
    """In how many files a table that is made of `size` bytes of text is kept at most: six for each core, more where they would hold over FILE_BYTES of it.

    Shuffles can have many more partitions, most of them small or empty. On a local disk a JVM starts two processes for
    each file that it makes, which share its memory until they run.
    """
    return max(6 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(col) -> object:
    """crc32 of an id's text, modulo 4: 2 marks the held-out rows."""
    return F.crc32(col.cast("string").cast("binary")) % 4


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The byte spans data[start:end] (in order, not overlapping) as a dictionary of the different ones; Arrow compares the bytes."""
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    compact = np.ascontiguousarray(data[np.cumsum(mask[:-1], dtype=np.int8) > 0])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(compact)]).dictionary_encode()


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit name of each word; every different word of the batch is hashed once, by its bytes."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    words = distinct_spans(data, starts, ends)
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(words.dictionary))
    return names[np.asarray(words.indices)]


def slices(batch: pa.RecordBatch, text_col: str, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most `size` bytes of text (a longer text stands alone), whatever limits the session has for batches."""
    _, offsets = bytes_of(column(batch, text_col))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), at + rows, len(batch))
        yield batch.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs without bytes of `space`) of a batch."""
    if len(data) == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values and one count per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose rows are the raw little-endian bytes of runs of a flat array."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=offsets[1:])
    raw = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), raw]).cast(pa.binary())


def ragged_index(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the elements of runs that begin at first[i] and have sizes[i] elements."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def write_batch(batch: pa.RecordBatch) -> bytes:
    """A record batch as bytes, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_batch(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False)) as source:
        return source.read_next_batch()


def row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two long columns that name a row, and their names: its id (0 if null) and a hash of all its columns.

    Rows of one name are equal in every column, so one of them can stand for the others.
    """
    names = []
    for stem in ("row_id", "row_tag"):
        while stem in docs.columns:
            stem += "_"
        names.append(stem)
    keyed = docs.withColumn(names[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(names[1], F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return keyed, names


def squeeze(values: np.ndarray, low: int = 0) -> bytes:
    """64-bit numbers as bytes; of their parts above the `low` bits, which mostly rise, the differences are kept.

    First bytes, second bytes and so on are compressed apart, as each have frequencies of their own; those that are all 0, or gain nothing, are left as they are.
    """
    step = np.diff(values >> np.uint64(low), prepend=np.uint64(0)) << np.uint64(low)  # differences are modulo 2**(64 - low)
    held = step | (values & np.uint64((1 << low) - 1))
    codec, n, out = pa.Codec("zstd", compression_level=1), len(values), []
    for plane in np.ascontiguousarray(held.view(np.uint8).reshape(-1, 8).T):
        small = codec.compress(plane, asbytes=True) if plane.any() else b""
        out.append(small if len(small) < n else plane.tobytes())
    return np.array([n, *map(len, out)], np.uint32).tobytes() + b"".join(out)


def stretch(data: bytes, low: int = 0) -> np.ndarray:
    n, *sizes = np.frombuffer(data, np.uint32, 9).tolist()
    codec, at, planes = pa.Codec("zstd"), 36, np.zeros((8, n), np.uint8)
    for plane, size in zip(planes, sizes, strict=True):
        if size:
            some = data[at : at + size]
            plane[:] = np.frombuffer(codec.decompress(some, n, asbytes=True) if size < n else some, np.uint8)
        at += size
    held = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return (np.cumsum(held >> np.uint64(low), dtype=np.uint64) << np.uint64(low)) | (held & np.uint64((1 << low) - 1))


def ordered(rows: DataFrame, keys: list, weight, place: str = "place", run: str = "run") -> DataFrame:
    """rows with their number in the order of `keys` (from 0, without gaps) and the sum of `weight` over the rows before them.

    Rows are dealt out by range; rows of equal keys are told apart by where they were read, so that many of them are
    not one task's. What the driver sees is one line a partition: its number of rows and its weight.
    """
    prepare(rows.sparkSession)
    salt, pid, own = "_salt", "_pid", "_weight"
    dealt = rows.withColumn(own, weight.cast("long")).withColumn(salt, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, salt).sortWithinPartitions(*keys, salt).drop(salt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            w = column(batch, own).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(w)
            new = [np.full(len(w), part, np.int32), np.arange(at, at + len(w)), total + sums - w]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*batch.schema.names, pid, place, run])
            at, total = at + len(w), total + int(sums[-1]) if len(w) else total

    found = cut(dealt.mapInArrow(number, f"{schema}, {pid} int, {place} long, {run} long"))
    bases, n, total = [], 0, 0
    for r in sorted(found.groupBy(pid).agg(F.count("*").alias("n"), F.sum(own).alias("w")).collect()):
        bases.append((r[pid], n, total))
        n, total = n + r["n"], total + r["w"]
    base = rows.sparkSession.createDataFrame(bases, f"{pid} int, _n long, _w long")
    out = found.join(F.broadcast(base), pid)
    return out.withColumn(place, F.col(place) + F.col("_n")).withColumn(run, F.col(run) + F.col("_w")).drop(pid, own, "_n", "_w")
