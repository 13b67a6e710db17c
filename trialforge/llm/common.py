"""Shared pieces of the training-data operators: Arrow buffers, hashed words, shared folders.

All hashing is done with numpy over the bytes of a whole slice of documents, so no Python
object is made for a word. Slices are cut by bytes, which bounds the temporaries.
"""

from __future__ import annotations

import ctypes
import math
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text handled at once by the numpy kernels; one longer document is a slice of its own.
SLICE_BYTES = 1 << 18

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """Each row whole in one column `row`, whatever its columns are called, with row_id and row_hash.

    These two tell rows apart where verdicts join back: doc_id (the greatest number for null) and a
    hash of the text.
    """
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select(whole_row(docs), row_id.alias("row_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_hash"))


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[column(c) for c in docs.columns]).alias("row")


def column(name: str) -> Column:
    """A column by its name, with any characters in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str]) -> DataFrame:
    """mapInArrow over rows by the places of their columns, whatever their names; the first len(names) columns remain."""
    short = [f"c{k}" for k in range(len(rows.columns))]
    fields = [StructField(c, f.dataType) for c, f in zip(short, rows.schema.fields[: len(names)])]
    return rows.toDF(*short).mapInArrow(run, StructType(fields)).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one is set only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else ""
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="trialforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of texts for Python workers of this many rows, where the session has Spark's own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give what numpy and Arrow have freed back to the system; a worker process stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def keeping_units(run: Batches) -> Batches:
    """The same function of batches, which releases memory at the end of a task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy(run: Batches) -> Batches:
    """The same, for functions that do not use the tokenizer: what it has remembered in this process goes."""
    keeping = keeping_units(run)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = sys.modules.get("trialforge.llm.tokens")
        if loaded:
            loaded.forget()
        yield from keeping(batches)

    return tidied


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the documents: shuffled and merged, whatever their sizes now.

    Without the hint each side below the broadcast threshold is built in the driver, several at once.
    """
    return left.join(right.hint("merge"), on, how)


def discard(df: DataFrame) -> None:
    """Remove a table of `written` that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (file sizes for a Parquet scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def n_parts(df: DataFrame, each: int) -> int:
    """Partitions so that one gets about `each` bytes of input, and the session's count at least.

    Where the plan does not know its size, the bytes of the texts are counted.
    """
    floor, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    # a plan over rows of unknown size says the greatest number there is
    if size >= 1 << 50:
        size = (df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).head()[0] or 0) // 2 + 1
    return max(floor, math.ceil(size / each))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents with at most `limit` bytes, or one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants made from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Hashes of byte ranges are polynomials modulo this prime; modulo 2**64 there are texts that no base tells apart.
PRIME = np.uint64((1 << 31) - 1)
_LANES = [int(x % (PRIME - np.uint64(1 << 20))) + (1 << 19) for x in constants(4, 29)]
_POWERS: dict[int, np.ndarray] = {}
_COEFFICIENTS = np.arange(1, 257, dtype=np.uint64)
_LOWER_COEFFICIENTS = _COEFFICIENTS.copy()
_LOWER_COEFFICIENTS[65:91] += np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n, kept between calls up to the size of a slice."""
    found = _POWERS.get(base, np.ones(1, np.uint32))
    if len(found) < n:
        size = max(n, SLICE_BYTES + 1)
        while len(found) < size:
            step = np.uint64(pow(base, len(found), int(PRIME)))
            found = np.concatenate([found, (found[: size - len(found)] * step % PRIME).astype(np.uint32)])
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = found
    return found[:n]


class Ranges:
    """Hashes of byte ranges of one text: 62 bits from two bases, 124 from four.

    Two different ranges of n bytes have one hash with a chance of about (n / 2**31) ** lanes, whatever
    their contents (for bases that were not chosen against them).
    """

    def __init__(self, data: np.ndarray, lanes: int = 2, lower: bool = False):
        n = len(data)
        values = (_LOWER_COEFFICIENTS if lower else _COEFFICIENTS)[data]
        self.inverse, self.totals = [], []
        for base in _LANES[:lanes]:
            terms = values * _powers(base, n)
            if n >= 1 << 24:
                terms %= PRIME
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=total[1:])
            self.totals.append(total)
            self.inverse.append(_powers(pow(base, -1, int(PRIME)), n + 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Mixed 64-bit numbers of the ranges, one for each two lanes."""
        lanes = [(total[end] - total[start]) % PRIME * inverse[start] % PRIME for total, inverse in zip(self.totals, self.inverse)]
        return [mix(lanes[k] << np.uint64(31) | lanes[k + 1]) for k in range(0, len(lanes), 2)]


_ROLL = np.uint64(0xD6E8FEB86659FD93)


def rolling(values: np.ndarray, gram: int) -> np.ndarray:
    """A number for each run of `gram` bytes by their values, modulo 2**64: equal runs, equal numbers, and no more."""
    n = len(values) - gram + 1
    out = np.zeros(max(0, n), np.uint64)
    # doubling: runs of 2**k bytes, joined by the bits of gram
    piece, width, done = values, 1, 0
    while n > 0:
        if gram & width:
            out = out * _power(width) + piece[done : done + n]
            done += width
        if 2 * width > gram:
            break
        piece = piece[:-width] * _power(width) + piece[width:]
        width *= 2
    return out


def _power(width: int) -> np.uint64:
    return np.uint64(pow(int(_ROLL), width, 1 << 64))


class Words:
    """Words (maximal runs without ASCII white space) of documents given as bytes and offsets.

    first[d]..first[d + 1] are document d's words; start and end are byte positions.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            word = ~_WS[data]
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            before = np.empty(n, bool)
            before[0] = True
            np.logical_not(word[:-1], out=before[1:])
            before |= edge[:n]
            after = np.empty(n, bool)
            after[-1] = True
            np.logical_not(word[1:], out=after[:-1])
            after |= edge[1:]
            self.start = np.flatnonzero(word & before)
            self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 62-bit hash of each word's bytes (A-Z lower-cased on request), spread over 64 bits."""
        return self.wide(lower, 2)[0]

    def wide(self, lower: bool = False, lanes: int = 4) -> list[np.ndarray]:
        if len(self.start) == 0:
            return [np.zeros(0, np.uint64)] * (lanes // 2)
        return Ranges(self.data, lanes, lower).of(self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int, salt: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-word windows at every word position, and whether the window lies in its document."""
        m = len(hashes)
        out, ok = np.zeros(m, np.uint64), np.zeros(m, bool)
        if m >= n:
            c = constants(n, salt + n)
            acc = hashes[: m - n + 1] * c[0]
            for j in range(1, n):
                acc += hashes[j : m - n + 1 + j] * c[j]
            out[: m - n + 1] = mix(acc)
            last = np.repeat(self.first[1:], np.diff(self.first))
            ok = np.arange(m) + n <= last
        return out, ok


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables made of whole runs of equal `key`, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            cut = 0 if keys[0] != last else (int(change[0]) if len(change) else None)
        else:
            cut = None
        if cut is not None:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held, batch, keys = [], batch.slice(cut), keys[cut:]
            change = change[change > cut] - cut
        if len(change):
            at = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def ranges_union(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [s, s + length) for sorted starts."""
    if len(starts) == 0:
        return starts, starts
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = starts[1:] > starts[:-1] + length
    a = starts[new]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return a, starts[last] + length


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_env() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
