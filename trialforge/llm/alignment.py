"""Links between the tokens of two tokenizers, with counts of id pairs in id-striped dense matrices.

Both tokenizers read the same bytes (a space, then the text), so tokens of one side overlap tokens of
the other in runs of bytes between neighbouring token ends, one run for each link. Documents are taken
in chunks. A chunk has one row for its documents' links, and one for each stripe (a run of ids of side
A) with the id pairs it holds and how many of its documents hold each. Rows of a stripe are added up in
a dense block of counts (ids of the stripe by ids of side B), in groups of chunks first and then by
levels, until one block for each stripe is left, whose row maxima mark the best partners. The blocks
meet the same rows, partitioned alike, and give each chunk its pairs' counts; the chunk's documents then
sum over their links. A stripe's task holds one block, whatever the number of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import buffers, keeping_units, n_parts, slices, tidy, tokenizer_path, written
from trialforge.llm.counts import differences, joined, parted, runs, squeeze, summed, widen
from trialforge.llm.pieces import exact_tokenizer, spaced

#: Cells of one dense block.
CELLS = 1 << 23
#: Chunks whose counts one task adds up.
FAN = 256

_ROW = pa.schema([("chunk", pa.int64()), ("stripe", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
_ROW_TYPE = "chunk long, stripe int, codes binary, counts binary, docs binary"
_SCALARS = [("doc_id", "<i8"), ("null", "u1"), ("n_a", "<i8"), ("n_b", "<i8"), ("n_groups", "<i8"), ("n_links", "<i8"), ("groups", "S64")]
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """Bytes of every id as flat arrays, and its decimal digits."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.flat = np.frombuffer(b"".join(values), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        names = [str(i).encode() for i in range(len(values))]
        self.n_digits = np.array([len(n) for n in names], np.int64)
        width = int(self.n_digits.max(initial=1)) + 1
        self.digits = np.zeros((len(names), width), np.uint8)
        for k in range(width - 1):
            has = self.n_digits > k
            self.digits[has, k] = np.array([n[k] for n, h in zip(names, has) if h], np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def _agree(voc: Vocabulary, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the tokens of each document spell its bytes."""
    sizes = np.append(0, np.cumsum(voc.size[ids]))[first]
    good = np.diff(sizes) == np.diff(offsets)
    kept = np.repeat(good, np.diff(first))
    mine, theirs = voc.spelled(ids[kept]), data[np.repeat(good, np.diff(offsets))]
    doc = np.repeat(np.flatnonzero(good), np.diff(offsets)[good])
    good[doc[mine != theirs]] = False
    return good


def _written_groups(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, va: Vocabulary, vb: Vocabulary, last: np.ndarray, da: np.ndarray, db: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document; last: number of groups before the end of each, da, db: tokens likewise."""
    n_groups = int(last[-1])
    na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    at_a = np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]
    at_b = np.arange(len(b)) + np.cumsum(na)[gb]
    width = max(va.digits.shape[1], vb.digits.shape[1])
    text, size = np.zeros((len(a) + len(b), width), np.uint8), np.zeros(len(a) + len(b), np.int64)
    for at, ids, group, voc, end in ((at_a, a, ga, va, b"|"), (at_b, b, gb, vb, b";")):
        text[at, : voc.digits.shape[1]] = voc.digits[ids]
        size[at] = voc.n_digits[ids]
        closes = np.append(group[1:] != group[:-1], True)
        text[at, size[at]] = np.where(closes, end[0], ord(","))
    flat = text[np.arange(width) <= size[:, None]].tobytes()
    upto = np.append(0, np.cumsum(size + 1))[da + db]
    # the last separator of a document goes
    return [flat[x : y - 1] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())]


def _links(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray, va: Vocabulary, vb: Vocabulary) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What a slice of documents has: numbers by document, and (document, id pair, times) of its links."""
    docs = len(offsets) - 1
    good = (np.diff(offsets) > 0) & _agree(va, a, fa, data, offsets) & _agree(vb, b, fb, data, offsets)
    found = {name: np.zeros(docs, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": np.zeros(docs, "S64")}
    if not good.any():
        return found, *(np.zeros(0, np.int64),) * 3
    a, b = a[np.repeat(good, np.diff(fa))].astype(np.int64), b[np.repeat(good, np.diff(fb))].astype(np.int64)
    fa, fb, width = np.append(0, np.cumsum(np.diff(fa)[good])), np.append(0, np.cumsum(np.diff(fb)[good])), np.diff(offsets)[good]
    edge = np.append(0, np.cumsum(width))
    ends_a, ends_b = np.cumsum(va.size[a]) - 1, np.cumsum(vb.size[b]) - 1
    mark = np.zeros(int(edge[-1]), np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    run = np.flatnonzero(mark)
    kind = mark[run]
    left, right = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
    shut = np.flatnonzero(mark == 3)
    ga, gb = np.searchsorted(shut, ends_a), np.searchsorted(shut, ends_b)
    doc = np.searchsorted(edge[1:], run, side="right")
    closed = np.searchsorted(shut, edge)
    found["n_a"][good], found["n_b"][good] = np.diff(fa), np.diff(fb)
    found["n_groups"][good], found["n_links"][good] = np.diff(closed), np.bincount(doc, minlength=len(width))
    found["groups"][good] = [hashlib.sha256(t).hexdigest().encode() for t in _written_groups(a, b, ga, gb, va, vb, closed, fa, fb)]
    pair, times = np.unique(doc << 40 | (a[left] * len(vb.size) + b[right]), return_counts=True)
    return found, np.flatnonzero(good)[pair >> 40], pair & ((1 << 40) - 1), times


def _chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (chunk, stripe, codes, counts), and one with stripe -1 for the documents of each chunk."""

    @keeping_units
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        tok_a, tok_b = exact_tokenizer(path_a), exact_tokenizer(path_b)
        va, vb = Vocabulary(tok_a.bytes_of_ids()), Vocabulary(tok_b.bytes_of_ids())
        wide = len(vb.size)
        for batch in batches:
            texts = spaced(batch.column(1))
            data, offsets = buffers(texts)
            (a, fa), (b, fb) = tok_a.encode_column(texts, None), tok_b.encode_column(texts, None)
            parts = []
            for x, y in slices(offsets):
                found, doc, code, times = _links(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], a[fa[x] : fa[y]], fa[x : y + 1] - fa[x], b[fb[x] : fb[y]], fb[x : y + 1] - fb[x], va, vb)
                parts.append((found, doc + x, code, times))
            doc, code, times = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            codes, slots, held = np.unique(code, return_inverse=True, return_counts=True)
            scalars = {k: np.concatenate([p[0][k] for p in parts]) for k in parts[0][0]}
            scalars |= {"doc_id": batch.column(0).fill_null(0).to_numpy(), "null": batch.column(0).is_null().to_numpy(zero_copy_only=False)}
            per = np.bincount(doc, minlength=batch.num_rows)
            steps = differences(slots.reshape(-1), (np.cumsum(per) - per)[per > 0])
            packed = [squeeze(scalars[k].astype(kind)) for k, kind in _SCALARS] + [squeeze(per.astype("<u4")), squeeze(steps), squeeze(times.astype("<u4"))]
            rows = [(-1, None, None, joined(packed))]
            block = (CELLS // wide or 1) * wide
            cut = np.flatnonzero(np.diff(codes // block, prepend=-1, append=-1))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                stripe = int(codes[x] // block)
                rows.append((stripe, squeeze(differences(codes[x:y] - stripe * block, np.zeros(1, int))), squeeze(held[x:y].astype("<u4")), None))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], _ROW.field(k + 1).type) for k in range(4))], schema=_ROW)
            number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(link, _ROW_TYPE)


def _codes(raw: bytes) -> np.ndarray:
    return np.cumsum(widen(raw, "<u4").astype(np.int64))


def _add_up(rows: DataFrame, parts: int, wide: int, kind: str, last: bool) -> DataFrame:
    """Sums of the rows of each (stripe, gang) in a dense block; the last level marks each row's greatest counts."""
    cells = (CELLS // wide or 1) * wide

    def write(stripe: int, gang: int, block: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(block)
        counts = block[at]
        best = counts == block.reshape(-1, wide).max(axis=1)[at // wide] if last else np.zeros(0, bool)
        row = [stripe, gang, squeeze(differences(at, np.zeros(1, int))), squeeze(counts.astype("<i8")), squeeze(best.astype("u1"))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["stripe", "gang", "codes", "counts", "best"])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = np.zeros(cells, np.int64), None
        for batch in batches:
            for stripe, gang, codes, counts in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if at is not None and at != (stripe, gang):
                    yield write(*at, block)
                    block[:] = 0
                at = stripe, gang
                np.add.at(block, _codes(codes), widen(counts, kind).astype(np.int64))
        if at is not None:
            yield write(*at, block)

    dealt = rows.select("stripe", "gang", "codes", "counts").repartition(parts, "stripe", "gang").sortWithinPartitions("stripe", "gang")
    return dealt.mapInArrow(add, "stripe int, gang long, codes binary, counts binary, best binary")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Links of each document between two tokenizers, and how common their id pairs are.

    One row for each row of `docs`: n_a and n_b tokens, n_groups runs of tokens between common ends,
    n_links overlapping pairs of tokens, n_best of them whose id pair is in as many documents as any pair
    of its A id, count_sum of the numbers of documents, and the SHA-256 of the groups' ids. A text that
    is null, empty, or that either side does not give back byte for byte has zeros and ''. Repeated rows
    count as documents of their own, null and repeated ids keep their rows, other columns are ignored.
    """
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    wide = len(exact_tokenizer(path_b).bytes_of_ids())
    cells = (CELLS // wide or 1) * wide
    parts = n_parts(docs, 16 << 20)
    rows = written(_chunks(docs, path_a, path_b), "links")
    pairs = rows.where("stripe >= 0").drop("docs")
    n_chunks = rows.where("stripe < 0").count()

    # chunks of a partition follow each other: a spread number of each deals them into gangs
    gangs = -(-n_chunks // FAN) or 1
    dealt = pairs.withColumn("gang", F.pmod(F.xxhash64("chunk"), F.lit(gangs)))
    level, kind, n = dealt, "<u4", gangs
    while n > 1:
        level, kind, n = _add_up(level, parts, wide, kind, False), "<i8", -(-n // FAN)
        level = level.withColumn("gang", F.pmod("gang", F.lit(n)))
    blocks = written(_add_up(level, parts, wide, kind, True), "blocks")

    # each gang of a stripe's rows meets its block, which stands first
    first = blocks.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gangs - 1).cast("long"))).alias("gang"), F.lit(-1).cast("long").alias("chunk"), "codes", "counts", "best")
    asked = dealt.select("stripe", "gang", "chunk", "codes", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    meeting = first.unionByName(asked).repartition(parts, "stripe", "gang").sortWithinPartitions("stripe", "gang", "chunk")

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = np.zeros(cells, np.int64), np.zeros(cells, bool)
        for batch in batches:
            out = []
            for stripe, _, chunk, codes, counts, best in zip(*(c.to_pylist() for c in batch.columns)):
                at = _codes(codes)
                if chunk < 0:
                    count[:], top[:] = 0, False
                    count[at], top[at] = widen(counts, "<i8"), widen(best, "u1") > 0
                else:
                    out.append((chunk, stripe, squeeze(count[at].astype("<i8")), squeeze(top[at].astype("u1"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "stripe", "counts", "best"])

    scored = meeting.mapInArrow(score, "chunk long, stripe int, counts binary, best binary").withColumn("docs", F.lit(None).cast("binary"))
    whole = rows.where("stripe < 0").select("chunk", "stripe", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"), "docs")
    back = whole.unionByName(scored).repartition(parts, "chunk").sortWithinPartitions("chunk", "stripe")

    @tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "chunk"):
            *scalars, per, steps, times = parted(table.column("docs")[0].as_py(), len(_SCALARS) + 3)
            held = {k: widen(raw, kind) for raw, (k, kind) in zip(scalars, _SCALARS)}
            per, times = widen(per, "<u4").astype(np.int64), widen(times, "<u4").astype(np.int64)
            slots = summed(widen(steps, "<u4"), per)
            empty = [np.zeros(0, np.int64)]
            counts = np.concatenate([*empty, *(widen(x, "<i8") for x in table.column("counts").to_pylist()[1:])])
            best = np.concatenate([*empty, *(widen(x, "u1") for x in table.column("best").to_pylist()[1:])])
            upto = np.cumsum(per)
            sums = [np.append(0, np.cumsum(v[slots] * times)) for v in (best, counts)]
            n_best, count_sum = (s[upto] - s[upto - per] for s in sums)
            numbers = [held[k] for k in ("n_a", "n_b", "n_groups", "n_links")] + [n_best, count_sum]
            arrays = [pa.array(held["doc_id"], pa.int64(), mask=held["null"] > 0), *(pa.array(v, pa.int64()) for v in numbers), pa.array(held["groups"].astype(str), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _OUT.split(", ")])

    return back.mapInArrow(total, _OUT)
