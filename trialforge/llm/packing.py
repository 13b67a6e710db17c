"""Best-fit packing of tokenized documents into sequences of at most seq_len tokens.

Documents longer than a sequence are cut (the short piece first, then whole sequences). Pieces are
placed in bulk-synchronous rounds, longest first. A round takes the pieces of one band of lengths:

1. Pieces and the gaps of open sequences are sorted by size over range partitions, longest first,
   gaps before pieces of their size. A gap that holds several pieces of the band stands there as
   often.
2. Each partition sweeps its part: the successor of a piece is the smallest gap seen and not yet
   taken, the top of a stack. Pieces that find no gap in their partition and gaps that find no piece
   are ranked. From the counts of partitions alone (the driver sees two numbers for each) follows
   which ranks of pieces meet which ranks of gaps in earlier partitions, so that no two pieces get
   one gap; a join by rank makes those matches.
3. Gaps shrink by what they got, and the round is repeated until no piece finds a gap. Only then the
   rest of the band opens new sequences, as many pieces in each as the longest of the band allows;
   small pieces open as many empty sequences as they fill, and the rounds go on.

Bands end at seq_len / k for k = 1, 2, 3, 4, 6, 8, and at quarters from there, so there are seven or
eight bands and about two rounds for each, whatever the input. All state is in tables in the shared
folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.llm.common import discard, keeping_units, tokenizer_path, written
from trialforge.llm.tokens import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, seq_len: int, end_id: int) -> DataFrame:
    """One row per piece of each document (null or empty text: the end id alone)."""

    @keeping_units
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            ids, offsets = tok.encode_column(batch.column(1), end_id)
            n = np.diff(offsets)
            count = np.maximum(1, -(-n // seq_len))
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = n - (count - 1) * seq_len
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * seq_len)
            length = np.where(piece == 0, short[doc], seq_len)
            at = offsets[doc] + start
            crc = [zlib.crc32(ids[a : a + b].astype("<u4")) for a, b in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def bands(seq_len: int) -> list[tuple[int, int]]:
    """(highest, below the lowest) lengths of each band, longest first; whole sequences apart."""
    edges = [seq_len - 1] + [seq_len // k for k in (2, 3, 4, 6, 8)]
    while edges[-1] > 0:
        edges.append(edges[-1] // 4 if edges[-1] > 32 else 0)
    edges = sorted(set(edges), reverse=True)
    return [(hi, lo) for hi, lo in zip(edges, edges[1:]) if hi > lo]


#: From this many pieces in a sequence on, new sequences are opened empty and filled by rounds.
SMALL = 6
SWEPT = "found int, part int, rank long, pid long, length long, seq long, nth int, gap long"
MATCHED, PIECE, GAP = 0, 1, 2


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of one range partition, and what is left of it, ranked in order.

    Rows are sorted by size from high to low: gaps (pid null) and pieces. The stack holds gaps, the
    smallest on top.
    """
    part = TaskContext.get().partitionId()
    stack: list[tuple[int, int, int]] = []
    n_left = 0
    for batch in batches:
        rows: list[tuple] = []
        pids, sizes, seqs, nths, gaps = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pid", "size", "seq", "nth", "gap"))
        for pid, size, seq, nth, gap in zip(pids, sizes, seqs, nths, gaps):
            if pid is None:
                stack.append((seq, nth, gap))
            elif stack:
                rows.append((MATCHED, part, 0, pid, size, *stack.pop()))
            else:
                rows.append((PIECE, part, n_left, pid, size, 0, 0, 0))
                n_left += 1
        yield _swept(rows)
    for k in range(0, len(stack), 1 << 16):
        yield _swept([(GAP, part, k + i, 0, 0, *g) for i, g in enumerate(stack[k : k + (1 << 16)])])


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 8
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["found", "part", "rank", "pid", "length", "seq", "nth", "gap"])


def carried(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """What partitions with (part, pieces left, gaps left) leave to each other.

    Runs (part, rank_from, rank_to, gap_part, last_rank): the piece of rank r gets the gap of rank
    last_rank - (r - rank_from). And the number of pieces without any gap.
    """
    stack: list[list[int]] = []
    runs, without = [], 0
    for part, pieces_left, gaps_left in sorted(counts):
        at = 0
        while at < pieces_left and stack:
            top = stack[-1]
            n = min(pieces_left - at, top[1])
            runs.append((part, at, at + n, top[0], top[1] - 1))
            at, top[1] = at + n, top[1] - n
            if not top[1]:
                stack.pop()
        without += pieces_left - at
        if gaps_left:
            stack.append([part, gaps_left])
    return runs, without


def _located(placed: DataFrame, seq_len: int) -> DataFrame:
    """pid, seq and offset of matched pieces: those of one gap one after another."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy("seq").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select("pid", "seq", (F.lit(seq_len) - F.col("gap") + before).cast("long").alias("offset"), "length")


class Rounds:
    """Open gaps (seq, gap), placements (pid, seq, offset, length) and the pieces (pid, length) of each band."""

    def __init__(self, rows: DataFrame, seq_len: int, part_rows: int):
        self.spark, self.seq_len, self.part_rows = rows.sparkSession, seq_len, part_rows
        self.rows = rows
        self.placed: list[DataFrame] = []
        self.gaps: DataFrame | None = None
        self.opened = 0

    def places(self, hi: int, lo: int, n: int) -> tuple[int, int]:
        """Up to which gap, and how often each of these, the round needs gaps for n pieces: the tightest are enough."""
        # a number for each size of gaps, seq_len at most
        sizes = sorted((r["gap"], r["n"]) for r in self.gaps.where(F.col("gap") > lo).groupBy("gap").agg(F.count("*").alias("n")).collect())
        need = n
        for gap, count in sizes:
            if gap >= hi and need > 0:
                if count * (gap // hi) >= need:
                    return gap, -(-need // count)
                need -= count * (gap // hi)
        return (sizes[-1][0], sizes[-1][0] // hi) if sizes else (0, 0)

    def match(self, docs: DataFrame, hi: int, lo: int, n: int, most: int, last_copies: int) -> tuple[DataFrame, int]:
        """One round; the pieces that are left and their number."""
        copies = F.when(F.col("gap") == most, F.lit(max(1, last_copies))).otherwise(F.greatest(F.lit(1), F.floor(F.col("gap") / hi))).cast("int")
        slots = self.gaps.where((F.col("gap") > lo) & (F.col("gap") <= most)).select(F.lit(None).cast("long").alias("pid"), F.least(F.col("gap"), F.lit(hi)).cast("long").alias("size"), "seq", F.explode(F.sequence(F.lit(0), copies - 1)).alias("nth"), "gap")
        events = docs.select("pid", F.col("length").alias("size"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("gap")).unionByName(slots)
        order = [F.desc("size"), F.asc_nulls_first(F.col("pid").isNotNull()), F.desc("gap"), F.desc("seq"), F.desc("nth"), F.asc("pid")]
        swept = written(events.repartitionByRange(max(1, -(-2 * n // self.part_rows)), *order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT), "swept")
        counts = swept.groupBy("part").agg(F.count_if(F.col("found") == PIECE).alias("pieces"), F.count_if(F.col("found") == GAP).alias("gaps"), F.count_if(F.col("found") == MATCHED).alias("matched")).collect()
        runs, without = carried([(r["part"], r["pieces"], r["gaps"]) for r in counts])
        if without == n:
            discard(swept)
            return docs, n
        of_gap = swept.where(F.col("found") == GAP).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "seq", "nth", "gap")
        # a run for each pair of neighbouring partitions at most
        table = F.broadcast(self.spark.createDataFrame(runs, "part int, rank_from long, rank_to long, gap_part int, last_rank long"))
        left = swept.where(F.col("found") == PIECE).select("part", "rank", "pid", "length").join(table.withColumnRenamed("part", "of_part"), (F.col("part") == F.col("of_part")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")), "left")
        left = left.withColumn("gap_rank", F.col("last_rank") - F.col("rank") + F.col("rank_from"))
        met = left.where("gap_part is not null").join(of_gap, ["gap_part", "gap_rank"]).select("pid", "length", "seq", "nth", "gap")
        matched = swept.where(F.col("found") == MATCHED).select("pid", "length", "seq", "nth", "gap")
        placed = written(_located(matched.unionByName(met) if runs else matched, self.seq_len), "placed")
        self.placed.append(placed)
        taken = placed.groupBy("seq").agg(F.sum("length").alias("taken"))
        gaps = self.gaps.join(taken, "seq", "left").select("seq", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0")
        last, self.gaps = self.gaps, written(gaps, "gaps")
        discard(last)
        rest = docs.limit(0)
        if without:
            rest = written(left.where("gap_part is null").select("pid", "length"), "left")
        discard(swept)
        return rest, without

    def open(self, docs: DataFrame, each: int, n: int) -> None:
        """New sequences for n pieces, `each` in one by rank of length."""
        chunks = max(1, -(-n // self.part_rows))
        dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("pid"), F.lit(chunks)))
        # within chunks of bounded size, longest first; a chunk's last sequence may have room for more
        rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("length"), "pid")) - 1
        ranked = dealt.withColumn("rank", rank).select("pid", "length", "chunk", F.floor(F.col("rank") / each).alias("row"), (F.col("rank") % each).cast("int").alias("nth"))
        # numbers of sequences: chunk, chunk + chunks, chunk + 2 * chunks, ...
        named = ranked.select("pid", "length", (F.lit(self.opened) + F.col("row") * chunks + F.col("chunk")).cast("long").alias("seq"), "nth", F.lit(self.seq_len).cast("long").alias("gap"))
        placed = written(_located(named, self.seq_len), "placed")
        self.placed.append(placed)
        fresh = placed.groupBy("seq").agg((F.lit(self.seq_len) - F.sum("length")).alias("gap")).where("gap > 0")
        last, self.gaps = self.gaps, written(fresh if self.gaps is None else self.gaps.unionByName(fresh), "gaps")
        if last is not None:
            discard(last)
        self.opened = (placed.agg(F.max("seq")).head()[0] or 0) + 1

    def empty(self, docs: DataFrame) -> None:
        """As many empty sequences as the pieces' lengths fill."""
        n = -(-docs.agg(F.sum("length")).head()[0] // self.seq_len)
        fresh = self.spark.range(self.opened, self.opened + n).select(F.col("id").alias("seq"), F.lit(self.seq_len).cast("long").alias("gap"))
        last, self.gaps = self.gaps, written(fresh if self.gaps is None else self.gaps.unionByName(fresh), "gaps")
        if last is not None:
            discard(last)
        self.opened += n

    def run(self) -> DataFrame:
        cuts = [(self.seq_len, self.seq_len - 1), *bands(self.seq_len)]
        band = F.lit(0)
        for k, (hi, _) in enumerate(cuts):
            band = F.when(F.col("length") <= hi, F.lit(k)).otherwise(band)
        # a number for each band
        sizes = {r["band"]: r["n"] for r in self.rows.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
        for k, (hi, lo) in enumerate(cuts):
            docs, n = self.rows.where((F.col("length") <= hi) & (F.col("length") > lo)).select("pid", "length"), sizes.get(k, 0)
            while n:
                most, last_copies = self.places(hi, lo, n) if self.gaps is not None else (0, 0)
                docs, left = self.match(docs, hi, lo, n, most, last_copies) if most else (docs, n)
                if left == n and SMALL * hi > self.seq_len:
                    self.open(docs, self.seq_len // hi, n)
                    left = 0
                elif left == n:
                    self.empty(docs)
                n = left
        out = self.placed[0] if self.placed else self.rows.limit(0).select("pid", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset"), "length")
        for more in self.placed[1:]:
            out = out.unionByName(more)
        return out


def pack(docs: DataFrame, path: str | None = None, seq_len: int = 1024, end_id: int = 2, part_rows: int = 100_000) -> DataFrame:
    """Piece rows with sequence_id and offset, gapless from 0 in each sequence.

    A null or empty text is one piece with the end id. Rows with a null or repeated doc_id are
    packed as documents of their own. No documents, no rows. Other columns are ignored.
    """
    rows = written(pieces(docs, path or tokenizer_path(), seq_len, end_id).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed = Rounds(rows, seq_len, part_rows).run().select("pid", F.col("seq").alias("sequence_id"), "offset")
    return rows.join(placed, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
