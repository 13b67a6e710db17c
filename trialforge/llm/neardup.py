"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each row gets its set of distinct word shingles (64-bit hashes), a digest of the set, a
   signature of 8-bit minima and its band keys. Rows with equal sets are one node.
2. Nodes that share a band key are candidates. Buckets with equal members are one bucket. A
   bucket is dealt in chunks; first each chunk meets itself and chunk 0 only.
3. Candidates are compared signature batch by batch. With a uniform prior on the similarity, a
   pair goes as soon as the posterior chance that it reaches the threshold is below `miss`. Of
   what is left, pairs that join a chunk's nodes are verified on full sets.
4. Verified links are closed to components. Then every node outside the largest component of its
   bucket meets all other members, in blocks that verify what is left of those pairs.

So links inside a component that is already joined are never made, a bucket of n copies costs
about n pairs, and no candidate between different components is passed over. A pair is missed
only if no band agrees, (1 - J**band_rows) ** bands, or by pruning, `miss` for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import Words, buffers, constants, discard, grouped_rows, meet, mix, slices, tidy, written

BANDS, BAND_ROWS, SIGNATURE, BATCH = 25, 5, 128, 32
CHUNK = 256
LAST = np.iinfo(np.int64).max


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and offsets into them.

    Words are lower-cased in A-Z. A document of fewer than n words has its whole sequence.
    """
    w = Words(data, offsets)
    h = w.hashes(lower=True)
    g, _ = w.grams(h, n)
    out, sizes = [], []
    salt = constants(n, 77)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            s = s[new]
        elif b > a:
            s = mix(np.array([(h[a:b] * salt[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            s = g[:0]
        out.append(s)
        sizes.append(len(s))
    return np.concatenate([g[:0], *out]), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, digest, signature, bands; empty sets have neither of the last three."""
    a, b = constants(SIGNATURE, 5), constants(SIGNATURE, 6)
    salt = constants(BANDS * BAND_ROWS, 7).reshape(BANDS, BAND_ROWS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for x, y in slices(offsets):
                values, at = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], n)
                size = np.diff(at)
                full = np.flatnonzero(size)
                minima = np.zeros((SIGNATURE, len(full)), np.uint64)
                if len(full):
                    for k in range(SIGNATURE):
                        minima[k] = np.minimum.reduceat(values * a[k] + b[k], at[full])
                minima = mix(minima).T
                bands = mix((minima[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS) * salt).sum(axis=2, dtype=np.uint64)).astype(np.int64)
                short = np.ascontiguousarray((minima & np.uint64(255)).astype(np.uint8))
                digests: list[bytes | None] = [None] * (y - x)
                signatures: list[bytes | None] = [None] * (y - x)
                lists: list[np.ndarray | None] = [None] * (y - x)
                for j, k in enumerate(full.tolist()):
                    digests[k] = hashlib.blake2b(values[at[k] : at[k + 1]].tobytes(), digest_size=16).digest()
                    signatures[k] = short[j].tobytes()
                    lists[k] = bands[j]
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], batch.column(1)[x:y], pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "digest", "signature", "bands"])

    return _rows(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, digest binary, signature binary, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch of hashes, the fewest matches that keep a pair.

    8-bit minima match with chance s = J + (1 - J) / 256. With a uniform prior on J, a pair stays
    while P(J >= threshold | matches) >= miss.
    """
    j = (np.arange(4096) + 0.5) / 4096
    s = j + (1 - j) / 256
    above = j >= threshold
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            like = m * np.log(s) + (n - m) * np.log1p(-s)
            like = np.exp(like - like.max())
            if like[above].sum() >= miss * like.sum():
                break
        out.append(m)
    return tuple(out)


def prune(signature: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: tuple[int, ...], share: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that survive, and their matches. Sets whose sizes rule the threshold out go first."""
    lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    on = lo * share.denominator >= hi * share.numerator
    i, j = i[on], j[on]
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(bounds):
        matches += (signature[i, k * BATCH : (k + 1) * BATCH] == signature[j, k * BATCH : (k + 1) * BATCH]).sum(axis=1)
        on = matches >= least
        i, j, matches = i[on], j[on], matches[on]
    return i, j, matches


def _pairs_of(begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j within runs of rows, the runs of one small size at once and large runs one by one."""
    for m in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(m, 1)
        at = begin[sizes == m][:, None]
        each = max(1, CHUNK * CHUNK // len(a))
        for k in range(0, len(at), each):
            yield (at[k : k + each] + a).reshape(-1), (at[k : k + each] + b).reshape(-1)


def _forest(a: np.ndarray, b: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """Pairs of a spanning forest: sure ones first, then by least node, so that buckets which share
    members choose the same pairs."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, unsure))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for k, x, y in zip(order.tolist(), low[order].tolist(), high[order].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def sure_matches(threshold: float) -> int:
    """Matches of whole signatures from which the threshold is reached with a chance of 0.99."""
    j = (np.arange(4096) + 0.5) / 4096
    s = j + (1 - j) / 256
    for m in range(SIGNATURE + 1):
        like = m * np.log(s) + (SIGNATURE - m) * np.log1p(-s)
        like = np.exp(like - like.max())
        if like[j >= threshold].sum() >= 0.99 * like.sum():
            return m
    return SIGNATURE


def _table(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def first_pairs(rows: DataFrame, share: Fraction, miss: float) -> DataFrame:
    """Pairs (a, b) to verify, from rows sorted by group with node, side, n_shingles, signature.

    Side 0 is chunk 0, which meets the group's side 1, and side 1 itself; of the pairs that
    survive in a group, a spanning forest is kept.
    """
    bounds, sure = least_matches(float(share), miss), sure_matches(float(share))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_rows(batches, "group"):
            group, node, side, size = _table(table, "group", "node", "side", "n_shingles")
            signature = _signatures(table)
            cuts = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1))
            which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            found = [np.zeros((2, 0), np.int64)]
            for i, j in _pairs_of(cuts[:-1], np.diff(cuts)):
                on = ((side[i] == 1) | (side[j] == 1)) & (node[i] != node[j])
                i, j, matches = prune(signature, size, i[on], j[on], bounds, share)
                # runs of one group; a single pair is its own forest
                order = np.argsort(which[i], kind="stable")
                i, j, matches = i[order], j[order], matches[order]
                ends = np.flatnonzero(np.diff(which[i], append=-1)) + 1
                starts = np.concatenate([[0], ends[:-1]])
                single = starts[ends - starts == 1]
                found.append(np.stack([node[i[single]], node[j[single]]]))
                for x, y in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                    at = x + _forest(node[i[x:y]], node[j[x:y]], matches[x:y] < sure)
                    found.append(np.stack([node[i[at]], node[j[at]]]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def residual_links(rows: DataFrame, share: Fraction, miss: float) -> DataFrame:
    """Verified links (a, b) between components, from rows sorted by group that also have band, bands, comp and shingles.

    Side 0 meets side 1 in other components. A pair belongs to its first common band alone. What
    survives pruning is verified on the full sets here, so that a block sends each set once and
    returns a spanning forest of its links, not its pairs.
    """
    bounds = least_matches(float(share), miss)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_rows(batches, "group"):
            group, node, comp, side, size, band = _table(table, "group", "node", "comp", "side", "n_shingles", "band")
            signature = _signatures(table)
            bands = np.stack(table.column("bands").to_numpy()) if table.num_rows else np.zeros((0, BANDS))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            cuts = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1))
            found = [np.zeros((2, 0), np.int64)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                left, right = x + np.flatnonzero(side[x:y] == 0), x + np.flatnonzero(side[x:y] == 1)
                i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                on = comp[i] != comp[j]
                i, j, _ = prune(signature, size, i[on], j[on], bounds, share)
                on = ~((bands[i] == bands[j]) & (np.arange(BANDS) < band[x])).any(axis=1)
                i, j = i[on], j[on]
                links = np.zeros(len(i), bool)
                for k in np.unique(i):
                    at = np.flatnonzero(i == k)
                    others = [sets[q] for q in j[at]]
                    lengths = np.array([len(o) for o in others])
                    flat = np.concatenate(others)
                    place = np.searchsorted(sets[k], flat)
                    place[place == len(sets[k])] = 0
                    both = np.add.reduceat((sets[k][place] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
                    links[at] = both * share.denominator >= (len(sets[k]) + lengths - both) * share.numerator
                i, j = i[links], j[links]
                at = _forest(comp[i], comp[j], np.zeros(len(i)))
                found.append(np.stack([node[i[at]], node[j[at]]]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                on[k] = both * share.denominator >= (len(x) + len(y) - both) * share.numerator
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(on)) for c in batch.columns[:2]], names=["a", "b"])

    return meet(meet(pairs, left, "a"), right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, comp): comp is the least node of its component. Alternating large-star and small-star."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = meet(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select("v").distinct()
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("comp"))), "components")
    discard(edges)
    return out


def _group(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: str = "0.8", miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    component_id is the least doc_id that links reach; kept is doc_id = component_id. Rows with
    equal sets are linked; empty sets are linked with nothing and stay. Rows that share a doc_id
    share its verdict within a component; rows without a doc_id link like others and stay only
    where no row of their component has one. key_id and text_hash tell rows apart; first holds for
    the rows of one of them in each component. No rows, no result. Other columns are ignored.
    """
    share = Fraction(threshold)
    sketches = written(sketch(docs, shingle), "sketches")
    own = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("th").alias("th"))
    nodes = sketches.where("digest is not null").groupBy("digest").agg(F.min(own).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # buckets with two nodes or more; of buckets with the same members, one
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", _group("band", "value").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("band").alias("band"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod("node", F.lit(1000003))).alias("s")).where("n > 1")
    # of equal buckets the first band's, so a pair's first common band always has its bucket
    buckets = buckets.groupBy("n", "least", "x", "s").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    # chunk 0 holds the least hashes, whatever the number of chunks, so that buckets share it
    share_of = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    members = written(meet(rows, buckets, "bucket").withColumn("chunk", F.floor(share_of * F.col("chunks") / (1 << 20)).cast("int")), "members")
    light = nodes.select("node", "n_shingles", "signature")

    # full sets of the nodes in buckets
    involved = meet(members.select("node").distinct(), nodes.select("node", "rep"), "node").select("node", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
    source = _rows(docs).withColumn("id", F.coalesce("doc_id", F.lit(LAST))).select("id", "th", "text")

    @tidy
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for x, y in slices(offsets):
                values, at = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], pa.array([values[p:q].tobytes() for p, q in zip(at[:-1], at[1:])], pa.binary())], names=["node", "shingles"])

    found = meet(source, involved, ["id", "th"]).select("node", "text").mapInArrow(extract, "node long, shingles binary")
    sets = written(found, "sets")

    # first round: each chunk with itself and with chunk 0
    each = members.select("bucket", "node", F.col("chunk").alias("q"), F.lit(1).alias("side"))
    hub = members.where("chunk = 0 and chunks > 1").select("bucket", "node", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("q"), F.lit(0).alias("side"))
    grouped = meet(each.unionByName(hub), light, "node").select(_group("bucket", "q").alias("group"), "node", "side", "n_shingles", "signature")
    pairs = written(first_pairs(grouped.repartition("group").sortWithinPartitions("group"), share, miss), "pairs")
    links = written(verify(pairs, sets, share), "verified")
    comps = components(links)

    # residual round: nodes outside the largest component of their bucket, against all members
    placed = meet(members, comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("bucket", F.col("top.comp").alias("top"))
    open_ = written(meet(placed, largest, "bucket"), "open")
    rest = open_.where("comp <> top")
    blocks = rest.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    rest = meet(rest, blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    left = rest.select("bucket", "band", "node", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("q"), F.lit(0).alias("side"))
    right = meet(open_, blocks, "bucket").select("bucket", "band", "node", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("chunk").alias("q"), F.lit(1).alias("side"))
    whole = meet(nodes.select("node", "n_shingles", "signature", "bands"), sets, "node")
    grouped = meet(left.unionByName(right), whole, "node").select(_group("bucket", "block", "q").alias("group"), "band", "node", "comp", "side", "n_shingles", "signature", "bands", "shingles")
    more = written(residual_links(grouped.repartition("group").sortWithinPartitions("group"), share, miss), "more-links")
    if not more.isEmpty():
        comps = components(comps.where("node > comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))

    joined = meet(nodes.select("node", "digest", "rep"), comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("least"))
    known = meet(joined, least, "comp").select("digest", "least")
    out = meet(sketches.select("doc_id", "n_shingles", "digest", "th", own.alias("own")), known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("least.id"), F.lit(LAST)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), F.col("own.id").alias("key_id"), F.col("th").alias("text_hash"), F.coalesce(F.col("own") == F.col("least"), F.lit(True)).alias("first"))
