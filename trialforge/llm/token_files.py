"""Token-id shards under one canonical length-limited Huffman code, and their reader.

A shard is one byte string, in ascending document order:

    8 bytes   "TFHUFF01"
    u32       documents, u32 tokens per block, u64 tokens, u64 first token's number among all,
    u32       bytes of the code table, u64 bytes of the bit stream
    ...       code table: zlib of one length byte per id (0: no code), ids from 0
    i64[]     document ids, u8[] whether the id is null, u32[] tokens of each document
    u64[]     bit offset of each block (a checkpoint: blocks decode independently)
    ...       bit stream, most significant bit first, padded by 8 bytes 0

The code is made from the counts of all ids (package-merge, at most 16 bits), so a table of
2**16 entries decodes it. Decoding runs all blocks of a shard side by side, one symbol a step.
Shards are stored as rows of a Parquet table in the shared folder: Spark commits each task's
output once, so a lost executor leaves no half-written shard, and any store Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.llm.common import keeping_units, n_parts, tidy, tokenizer_path, written
from trialforge.llm.tokens import tokenizer

MAGIC = b"TFHUFF01"
HEAD = struct.Struct("<8sIIQQIQ")
MAX_BITS = 16
BLOCK = 1024


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths (0 for ids without a count) of at most `limit` bits, by package-merge."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) == 1:
        out[ids] = 1
    if len(ids) < 2:
        return out
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[ids].astype(np.float64)
    levels, weight = [], leaf
    for _ in range(limit):
        order = np.argsort(weight, kind="stable")
        levels.append(order < len(leaf))
        weight = weight[order]
        packages = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        weight = np.concatenate([leaf, packages])
    take, lengths = 2 * (len(ids) - 1), np.zeros(len(ids), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[ids] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in range(1, int(lengths.max(initial=0)) + 1):
        at = order[lengths[order] == n]
        code <<= n - last
        codes[at] = code + np.arange(len(at))
        code, last = code + len(at), n
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
    """Bit stream of the ids and the bit offset of each block.

    Codes are joined in pairs of at most 32 bits and summed into 32-bit words (no two share a
    bit), in runs that stay in the processor's cache.
    """
    size = lengths.astype(np.uint8)
    code = codes.astype(np.uint64)
    total = int(np.bincount(ids, minlength=len(size)) @ size.astype(np.int64))
    out, checkpoints, begin = np.zeros((total >> 5) + 4, np.float64), [], 0
    run = 64 * block
    for k in range(0, len(ids), run):
        part = ids[k : k + run]
        n = size[part].astype(np.int64)
        c = code[part]
        checkpoints.append(begin + (np.cumsum(n) - n)[::block])
        if len(part) & 1:
            n, c = np.append(n, 0), np.append(c, np.uint64(0))
        c = (c[::2] << n[1::2].astype(np.uint64)) | c[1::2]
        n = n[::2] + n[1::2]
        at = begin + np.cumsum(n) - n
        window = c << (64 - n - (at & 31)).astype(np.uint64)
        first = int(at[0]) >> 5
        word = (at >> 5) - first
        high, low = np.bincount(word, weights=window >> np.uint64(32)), np.bincount(word, weights=window & np.uint64(0xFFFFFFFF))
        out[first : first + len(high)] += high
        out[first + 1 : first + 1 + len(low)] += low
        begin = int(at[-1] + n[-1])
    stream = out.astype(">u4").tobytes()[: total // 8 + 9]
    return stream, np.concatenate(checkpoints or [np.zeros(0)]).astype("<u8")


def unpack_bits(stream: bytes, checkpoints: np.ndarray, n_tokens: int, lengths: np.ndarray, block: int) -> np.ndarray:
    """The ids: all blocks in step, by a table over the next 16 bits."""
    table = np.ones(1 << MAX_BITS, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    spans = 1 << (MAX_BITS - size)
    table[: int(spans.sum())] = np.repeat((order << 5 | size).astype(np.uint32), spans)
    b = np.frombuffer(stream, np.uint8).astype(np.uint32)
    words = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    whole, rest = divmod(n_tokens, block)
    out, at = np.zeros((block, len(checkpoints)), np.int32), checkpoints.astype(np.int64)
    for step in range(block):
        if step == rest:
            at = at[:whole]
        if len(at) == 0:
            break
        found = table[(words[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
        out[step, : len(at)] = found >> np.uint32(5)
        at = at + (found & np.uint32(31))
    return np.ascontiguousarray(out.T).reshape(-1)[:n_tokens]


def write_shard(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: int, lengths: np.ndarray, table: bytes) -> bytes:
    stream, checkpoints = pack_bits(ids, canonical(lengths), lengths, BLOCK)
    return b"".join([HEAD.pack(MAGIC, len(counts), BLOCK, len(ids), first, len(table), len(stream)), table, doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), counts.astype("<u4").tobytes(), checkpoints.tobytes(), stream])


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, whether each is null, tokens of each, all ids, and the first token's number."""
    magic, docs, block, tokens, first, n_table, n_stream = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("no token shard")
    at = HEAD.size
    lengths = np.frombuffer(zlib.decompress(raw[at : at + n_table]), np.uint8)
    at += n_table
    parts = []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", -(-tokens // block))):
        parts.append(np.frombuffer(raw, kind, n, at))
        at += parts[-1].nbytes
    ids = unpack_bits(raw[at : at + n_stream], parts[3], tokens, lengths, block)
    return parts[0], parts[1] > 0, parts[2].astype(np.int64), ids, first


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, part_bytes: int = 4 << 20) -> DataFrame:
    """Write all documents' ids (null text: empty; end_id after each) and return the table of shards.

    Shards (shard, first_token, n_docs, data) follow ascending doc_id, null ids last; rows that
    share a doc_id stay side by side. No documents, no shards. Other columns are ignored.
    """
    path = path or tokenizer_path()
    parts = n_parts(docs, part_bytes)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # equal shares of rows by doc_id: `parts` numbers at most
    edges = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 20 * parts)).head()[0] or [] if parts > 1 else []
    edges = np.unique(np.array(edges, np.int64))

    @keeping_units
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, squeeze = tokenizer(path), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            key = batch.column(0).fill_null(LAST).to_numpy()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, offsets = tok.encode_column(batch.column(1), end_id)
            kind = ids.dtype
            part = np.searchsorted(edges, key, side="right")
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = order[a:b]
                flat = ids[offsets[at[0]] : offsets[at[-1] + 1]] if at[-1] - at[0] + 1 == len(at) else np.concatenate([ids[offsets[k] : offsets[k + 1]] for k in at])
                row = {"part": int(part[at[0]]), "keys": squeeze(key[at].astype("<i8").tobytes()), "nulls": squeeze(null[at].astype("u1").tobytes()), "counts": squeeze(np.diff(offsets)[at].astype("<u4").tobytes()), "ids": squeeze(flat.astype(kind).tobytes()), "width": kind.itemsize, "n": len(flat)}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOBS)

    blobs = written(docs.mapInArrow(encode, "part int, keys binary, nulls binary, counts binary, ids binary, width int, n long"), "token-blobs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, width in zip(batch.column(0), batch.column(1)):
                found = np.bincount(_ids(raw, width))
                total = np.concatenate([total, np.zeros(max(0, len(found) - len(total)), np.int64)])
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    # at most one row for each id of the vocabulary
    found = blobs.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    table = zlib.compress(lengths.tobytes())

    def shard(rows: pa.Table) -> pa.Table:
        keys, null, sizes, ids = [], [], [], []
        for r in rows.to_pylist():
            keys.append(np.frombuffer(_raw(r["keys"]), "<i8"))
            null.append(np.frombuffer(_raw(r["nulls"]), "u1"))
            sizes.append(np.frombuffer(_raw(r["counts"]), "<u4"))
            ids.append(np.frombuffer(_raw(r["ids"]), f"<u{r['width']}"))
        keys, null, sizes, ids = (np.concatenate(x) for x in (keys, null, sizes, ids))
        sizes = sizes.astype(np.int64)
        if np.any((keys[1:] < keys[:-1]) | (null[1:] < null[:-1])):
            order = np.lexsort((keys, null))
            begin = np.cumsum(sizes) - sizes
            upto = np.cumsum(sizes[order])
            ids = ids[np.repeat(begin[order] - upto + sizes[order], sizes[order]) + np.arange(len(ids))]
            keys, null, sizes = keys[order], null[order], sizes[order]
        first = rows.column("first_token")[0].as_py()
        data = write_shard(keys, null, sizes, ids.astype(np.int64), first, lengths, table)
        return pa.table({"shard": rows.column("part")[:1].cast(pa.int32()), "first_token": pa.array([first], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "data": pa.array([data], pa.binary())})

    # a row for each shard: n_parts bounds it
    sizes = blobs.groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first_token"))
    shards = blobs.join(before, "part").groupBy("part").applyInArrow(shard, "shard int, first_token long, n_docs long, data binary")
    return written(shards, "token-shards")


LAST = np.iinfo(np.int64).max
_BLOBS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("nulls", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("width", pa.int32()), ("n", pa.int64())])


def _raw(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _ids(blob: pa.Scalar, width: pa.Scalar) -> np.ndarray:
    return np.frombuffer(_raw(blob.as_py()), f"<u{width.as_py()}")


def token_digests(shards: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens and crc32 of the ids as little-endian u32."""

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                keys, null, sizes, ids, first = read_shard(data.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                end = np.cumsum(sizes)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(((end - sizes) * 4).tolist(), (end * 4).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(first + end - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Read the shards back: doc_id and its ids."""

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                keys, null, sizes, ids, _ = read_shard(data.as_py())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), lists], names=["doc_id", "ids"])

    return shards.select("data").mapInArrow(read, "doc_id long, ids array<int>")
