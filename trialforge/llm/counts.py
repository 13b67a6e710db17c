"""Token counts: each distinct pre-token is counted once, and documents sum what their pre-tokens have.

Documents are taken in chunks (batches of Arrow). A chunk has one row with, for each document, the
places of its distinct pre-tokens among the chunk's and how often each occurs, and one row for each
bucket of pre-tokens (by hash) with their bytes. A bucket's task encodes each distinct pre-token that
any chunk sends once, remembers its number of pieces, and answers every chunk with one number for each
of its pre-tokens. The answers join the chunk's frequencies, which are summed. A very common pre-token
is sent once by each chunk, however many documents hold it; buckets grow in number with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import Ranges, buffers, grouped_rows, n_parts, slices, tidy, tokenizer_path, written
from trialforge.llm.pieces import counter

#: Bytes of input for each bucket of pre-tokens.
BUCKET_BYTES = 32 << 20
_CHUNK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_CHUNK_TYPE = "chunk long, bucket int, data binary"


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def widen(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def differences(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Steps between sorted values, anew at each of the places `first`: small numbers, which compress well."""
    out = np.diff(values, prepend=values[:1] * 0)
    out[first] = values[first]
    return out.astype("<u4")


def summed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values behind `differences` in runs of these sizes."""
    total = np.cumsum(steps.astype(np.int64))
    begin = np.cumsum(sizes) - sizes
    before = np.where(begin > 0, total[begin - 1] if len(total) else 0, 0)
    return total - np.repeat(before, sizes)


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct pair of hashes, and for every pair its number among these."""
    _, first, back = np.unique(h1, return_index=True, return_inverse=True)
    if np.any(h2 != h2[first][back]):
        _, first, back = np.unique(np.stack([h1, h2], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, back.reshape(-1)


def joined(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


def parted(raw: bytes, n: int) -> list[bytes]:
    """The n byte strings of `joined`."""
    ends = n * 8 + np.cumsum(np.frombuffer(raw, "<u8", n).astype(np.int64))
    return [raw[x:y] for x, y in zip([n * 8, *ends[:-1].tolist()], ends.tolist())]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal `key`, from batches sorted by it."""
    for table in grouped_rows(batches, key):
        keys = table.column(key).to_numpy()
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            yield table.slice(a, b - a)


class Remembered:
    """Small numbers by 64-bit hashes, with 32 further bits as a check: an open table of numpy arrays that grows."""

    def __init__(self, bits: int = 16):
        self.keys, self.checks, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int64)
        self.held = 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its number."""
        mask = np.uint64(len(self.keys) - 1)
        known, values, left, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.arange(len(keys)), keys & mask
        while len(left):
            there = self.keys[at]
            hit = (there == keys[left]) & (self.checks[at] == checks[left])
            known[left[hit]], values[left[hit]] = True, self.values[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return known, values

    def add(self, keys: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old = self.keys, self.checks, self.values
            self.__init__((2 * (self.held + len(keys))).bit_length() + 1)
            on = old[0] != 0
            self.add(*(x[on] for x in old))
        mask, at = np.uint64(len(self.keys) - 1), keys & np.uint64(len(self.keys) - 1)
        self.held += len(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == 0]
            self.keys[at[first]], self.checks[at[first]], self.values[at[first]] = keys[first], checks[first], values[first]
            on = np.ones(len(keys), bool)
            on[first] = False
            keys, checks, values, at = keys[on], checks[on], values[on], (at[on] + np.uint64(1)) & mask


def _chunks(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows (chunk, bucket, data): bucket -1 has the chunk's documents, others the bytes of its pre-tokens."""

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, count = TaskContext.get().partitionId() << 32, counter(path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False)
            data, offsets = buffers(count.prepared(batch.column(1)))
            starts, h1, h2, doc, ends = [], [], [], [], []
            for a, b in slices(offsets):
                lo, hi = offsets[a], offsets[b]
                part = data[lo:hi]
                edge = np.unique(np.concatenate([offsets[a:b] - lo, count.cuts(part)])) if hi > lo else np.zeros(0, np.int64)
                edge = edge[edge < len(part)]
                stop = np.append(edge[1:], len(part))
                one, two = Ranges(part, 4).of(edge, stop) if len(edge) else (np.zeros(0, np.uint64),) * 2
                starts.append(edge + lo)
                ends.append(stop + lo)
                h1.append(one)
                h2.append(two)
                doc.append(np.searchsorted(offsets[a + 1 : b + 1], edge + lo, side="right") + a)
            starts, ends, h1, h2, doc = (np.concatenate(x) for x in (starts, ends, h1, h2, doc))
            first, back = distinct(h1, h2)
            # pre-tokens by bucket and first place: a document's new ones have neighbouring numbers
            bucket = (h1[first] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((first, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            first, bucket = first[order], bucket[order]
            pair, times = np.unique(doc * max(1, len(first)) + place[back], return_counts=True)
            held = np.bincount(pair // max(1, len(first)), minlength=batch.num_rows)
            slots = differences(pair % max(1, len(first)), (np.cumsum(held) - held)[held > 0])
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            rows = [(-1, joined([squeeze(x) for x in (ids, null.astype("u1"), sizes.astype("<i8"), held.astype("<u4"), slots, times.astype("<u4"))]))]
            size = (ends - starts)[first]
            upto = np.append(0, np.cumsum(size))
            flat = data[np.repeat(starts[first] - upto[:-1], size) + np.arange(upto[-1])]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                rows.append((int(bucket[a]), joined([squeeze(size[a:b].astype("<u4")), squeeze(flat[upto[a] : upto[b]])])))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_CHUNK)
            number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, _CHUNK_TYPE)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of each document's whole text, and whether it has more than `limit` tokens.

    One row for each row of `docs` (doc_id, n_bytes, n_tokens, over_limit); a null text counts as empty,
    an empty one has no tokens, null and repeated ids keep their rows, other columns are ignored. `path`
    is a sentencepiece model or a file of the tokenizers library, used without added special tokens.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    parts = n_parts(docs, BUCKET_BYTES)
    chunks = written(_chunks(docs, path, parts), "pre-tokens")

    @tidy
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, at, seen = counter(path), None, Remembered()
        for batch in batches:
            chunk, bucket, data = (c.to_pylist() for c in batch.columns)
            for k, raw in enumerate(data):
                if bucket[k] != at:
                    at, seen = bucket[k], Remembered()
                size, flat = parted(raw, 2)
                end, flat = np.cumsum(widen(size, "<u4").astype(np.int64)), widen(flat, "u1")
                keys, checks = Ranges(flat, 4).of(np.append(0, end[:-1]), end)
                keys, checks = np.maximum(keys, np.uint64(1)), checks.astype(np.uint32)
                known, found = seen.find(keys, checks)
                new, text = np.flatnonzero(~known), flat.tobytes()
                found[new] = count.count([text[a:b] for a, b in zip((np.append(0, end[:-1])[new]).tolist(), end[new].tolist())])
                _, once = np.unique(keys[new], return_index=True)
                seen.add(keys[new[once]], checks[new[once]], found[new[once]])
                yield pa.RecordBatch.from_arrays([pa.array([chunk[k]], pa.int64()), pa.array([at], pa.int32()), pa.array([squeeze(found.astype("<u4"))], pa.binary())], schema=_CHUNK)

    asked = chunks.where("bucket >= 0").repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = asked.mapInArrow(answer, _CHUNK_TYPE)
    meeting = chunks.where("bucket < 0").unionByName(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "chunk"):
            first, *found = table.column("data").to_pylist()
            ids, null, sizes, held, slots, times = (widen(x, kind) for x, kind in zip(parted(first, 6), ("<i8", "u1", "<i8", "<u4", "<u4", "<u4")))
            held = held.astype(np.int64)
            each = np.concatenate([np.zeros(0, np.int64), *(widen(x, "<u4").astype(np.int64) for x in found)])
            total = np.append(0, np.cumsum(each[summed(slots, held)] * times.astype(np.int64)))
            upto = np.cumsum(held)
            n = total[upto] - total[upto - held]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null > 0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return meeting.mapInArrow(add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
