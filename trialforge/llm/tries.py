"""Conversation prefix trie: rebuilt conversations, their distinct prefixes, and rollups over subtrees.

A prefix is named by a 124-bit hash, a polynomial over its turns' hashes, so names come from running
sums and no conversation has to lie in one task: turns are range-sorted by (conv_id, turn) and each
partition's last conversation hands its sum on to the next partition. Nodes are prefixes with their
numbers of members. A node with one member needs no trie: it has one leaf and saves nothing. The nodes
with many members (more than the square root of all nodes, and the root) are the upper levels. Below
them hang subtrees of fewer members, which are dealt into shards of prefixes. A shard is one level-order
trie: numpy builds its LOUDS bits and label arrays, reads parents off the bits, and adds rollups to
parents from the lowest level up. What the subtrees' tops and lone nodes hand to the upper levels is
summed by parent, and the upper levels, at most the square root of all nodes, are a trie of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm.common import PRIME, Ranges, buffers, mix, slices, tidy, written

LANES = 4
_P = int(PRIME)
#: Bases of the polynomial over turns, one for each lane.
_BASES = [1_103_515_245, 914_237_861, 1_664_525_173, 634_522_317]
#: Nodes of one shard of prefixes, about.
SHARD = 50_000


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent modulo PRIME for each exponent, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % PRIME, out)
        square, left = square * square % PRIME, left >> np.uint64(1)
    return out


def _text_hashes(column: pa.Array) -> list[np.ndarray]:
    data, offsets = buffers(column)
    parts = [Ranges(data[offsets[a] : offsets[b]], LANES).of(offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]) for a, b in slices(offsets)]
    return [np.concatenate([p[k] for p in parts] or [np.zeros(0, np.uint64)]) for k in range(LANES // 2)]


def _turn_lanes(roles: pa.Array, texts: pa.Array) -> list[np.ndarray]:
    """Four numbers below PRIME for each turn, none of them 0."""
    out = []
    # a length tells "" with a text from a role with none, and words of the hash mix both
    for k, (r, t) in enumerate(zip(_text_hashes(roles), _text_hashes(texts))):
        both = mix(r * np.uint64(0x9E3779B97F4A7C15) + mix(t + np.uint64(k + 1)))
        out += [both % (PRIME - np.uint64(1)) + np.uint64(1), (both >> np.uint64(32)) * np.uint64(0x2545F491) % (PRIME - np.uint64(1)) + np.uint64(1)]
    return out


def _turns(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, size, s0..s3, e0..e3): each turn's place, bytes of text, and sums over the turns up to it and before it.

    A sum is that of hash * base ** place modulo PRIME over the conversation's turns.
    """
    rows = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", "pos", "size", *(f"s{k}" for k in range(LANES)), *(f"e{k}" for k in range(LANES))]

    @tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, next_pos, sums = None, 0, [0] * LANES
        for batch in batches:
            if batch.num_rows == 0:
                continue
            conv = batch.column(0).to_numpy()
            n = len(conv)
            new = np.append(conv[0] != held, conv[1:] != conv[:-1])
            run = np.cumsum(new) - 1 + (not new[0])
            begin = np.flatnonzero(new) if new[0] else np.append(0, np.flatnonzero(new))
            pos = np.arange(n) - begin[run] + np.where((run == 0) & (not new[0]), next_pos, 0)
            data = [pa.array(pos, pa.int64()), pa.array(pa.compute.binary_length(batch.column(3)), pa.int64())]
            upto, before = [], []
            for k, lane in enumerate(_turn_lanes(batch.column(2), batch.column(3))):
                term = lane * _power(_BASES[k], pos) % PRIME
                # terms are below 2**31 and batches hold few rows: sums fit in 64 bits
                total = np.cumsum(term)
                start = (total - term)[begin]
                carried = np.zeros(len(begin), np.uint64)
                if not new[0]:
                    carried[0] = sums[k]
                one = (total - start[run] + carried[run]) % PRIME
                upto.append(one)
                before.append((one + PRIME - term) % PRIME)
            held, next_pos, sums = conv[-1], int(pos[-1]) + 1, [int(u[-1]) for u in upto]
            yield pa.RecordBatch.from_arrays([batch.column(0), *data, *(pa.array(x.astype(np.int64)) for x in (*upto, *before))], names=names)

    within = written(ranged.mapInArrow(number, ", ".join(f"{n} long" for n in names)).withColumn("part", F.spark_partition_id()), "turns")
    # where each partition begins and ends: a row for each partition
    edges = within.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"), *[F.max_by(c, F.struct("conv_id", "pos")).alias(f"last_{c}") for c in ("pos", *names[3 : 3 + LANES])]).orderBy("part").collect()
    starts, held, at, sums = [], None, 0, [0] * LANES
    for e in edges:
        if e["low"] != held:
            held, at, sums = None, 0, [0] * LANES
        starts.append((e["part"], e["low"], at, *sums, *(pow(b, at, _P) for b in _BASES)))
        goes_on = e["high"] == e["low"]
        sums = [((sums[k] if goes_on else 0) + (pow(_BASES[k], at, _P) if goes_on else 1) * e[f"last_s{k}"]) % _P for k in range(LANES)]
        held, at = e["high"], (at if goes_on else 0) + e["last_pos"] + 1
    known = convs.sparkSession.createDataFrame(starts, "part int, low long, at long, " + ", ".join([f"c{k} long" for k in range(LANES)] + [f"b{k} long" for k in range(LANES)]))
    joined = within.join(F.broadcast(known), "part")
    first = F.col("conv_id") == F.col("low")
    shifted = [F.when(first, (F.col(f"c{k}") + F.col(f"b{k}") * F.col(f"{s}{k}")) % _P).otherwise(F.col(f"{s}{k}")).alias(f"{s}{k}") for s in "se" for k in range(LANES)]
    return joined.select("conv_id", (F.col("pos") + F.when(first, F.col("at")).otherwise(0)).alias("pos"), "size", *shifted)


def _names(sums: list[Column], out: tuple[str, str]) -> list[Column]:
    """Two longs from four numbers of 31 bits."""
    return [(F.shiftleft(sums[2 * k], 31).bitwiseOR(sums[2 * k + 1])).alias(out[k]) for k in range(2)]


def _paths(convs: DataFrame, share: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, p1, p2, size, ends) for each turn of each rebuilt conversation, and (conv_id, length)."""
    own = written(_turns(convs), "own-turns")
    heads = own.where((F.col("conv_id") % share == 0) & (F.col("pos") < most - 1))
    base = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "size", *[f"{s}{k}" for s in "se" for k in range(LANES)]))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    # what a conversation's first h turns sum up to
    taken = [F.max(F.when(F.col("pos") == F.crc32(F.col("conv_id").cast("string")) % most - 1, F.col(f"s{k}"))).alias(f"t{k}") for k in range(LANES)]
    per = own.groupBy("conv_id").agg(F.count("*").alias("n_own"), *taken).withColumn("h", h)
    known = per.withColumn("base", F.col("conv_id") - F.col("conv_id") % share).join(base, "base", "left")
    n_head = F.least("h", F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0))).cast("long")
    known = known.withColumn("n_head", n_head).withColumn("length", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    last = [F.when(F.col("n_head") > 0, F.element_at("head", F.col("n_head").cast("int"))[f"s{k}"]).otherwise(0).alias(f"g{k}") for k in range(LANES)]
    known = written(known.select("conv_id", "h", "n_head", "length", F.slice("head", 1, F.col("n_head").cast("int")).alias("head"), *[F.coalesce(f"t{k}", F.lit(0)).alias(f"t{k}") for k in range(LANES)], *last), "rebuilt")
    ends = (F.col("depth") == F.col("length")).alias("ends")
    front = known.where("n_head > 0").select("conv_id", "length", F.explode("head").alias("e")).withColumn("depth", F.col("e.pos") + 1)
    front = front.select("conv_id", "depth", *_names([F.col(f"e.s{k}") for k in range(LANES)], ("k1", "k2")), *_names([F.col(f"e.e{k}") for k in range(LANES)], ("p1", "p2")), F.col("e.size").alias("size"), ends)
    # a turn moves up by h - n_head places: its sums lose those places' powers of the base
    tail = own.join(known.drop("head"), "conv_id").where("pos >= h").withColumn("depth", F.col("pos") - F.col("h") + F.col("n_head") + 1)
    back = [F.element_at(F.array(*[F.lit(pow(b, -d, _P)) for d in range(most)]), (F.col("h") - F.col("n_head") + 1).cast("int")) for b in _BASES]
    moved = {s: [(F.col(f"g{k}") + (F.col(f"{s}{k}") - F.col(f"t{k}") + _P) % _P * back[k]) % _P for k in range(LANES)] for s in "se"}
    tail = tail.select("conv_id", "depth", *_names(moved["s"], ("k1", "k2")), *_names(moved["e"], ("p1", "p2")), "size", ends)
    return written(front.unionByName(tail), "paths"), known.select("conv_id", "length")


def louds(parents: np.ndarray) -> np.ndarray:
    """LOUDS bits of nodes in level order (parent of node i + 1 at i, node 0 is the root): a 1 for each child, then a 0."""
    n = len(parents) + 1
    bits = np.ones(2 * n - 1, bool)
    bits[np.cumsum(np.bincount(parents, minlength=n)) + np.arange(n)] = False
    return bits


def parents_of(bits: np.ndarray) -> np.ndarray:
    """The parent of each node but the root: as many 0s as stand before its 1."""
    return np.cumsum(~bits)[bits]


def _level_order(names: np.ndarray, above: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in level order under one root, and the place (0: the root) of each one's parent.

    A row whose parent is not among the rows hangs from the root.
    """
    by_name = np.argsort(names)
    at = np.searchsorted(names[by_name], above)
    at[at == len(names)] = 0
    parent = np.where(names[by_name][at] == above, by_name[at], -1) if len(names) else at
    # a top has level 1, whatever its depth; parents lie one depth above their children
    level = np.ones(len(names) + 1, np.int64)
    level[-1] = 0
    order, place = [], np.zeros(len(names) + 1, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    for rows in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        level[rows] = level[parent[rows]] + 1
    level = level[:-1]
    done = 1
    by_level = np.argsort(level, kind="stable")
    for rows in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        rows = rows[np.argsort(place[parent[rows]], kind="stable")]
        place[rows] = done + np.arange(len(rows))
        done += len(rows)
        order.append(rows)
    flat = np.concatenate(order) if order else by_level
    return flat, place[parent[flat]]


def _roll_up(parents: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees, the root's first: each level is added to its parents, from the lowest up."""
    out = np.append(0, values)
    edge, ends = 0, [0]
    while edge < len(parents):
        # a level's parents lie in the level before it
        edge = int(np.searchsorted(parents, ends[-1], side="right")) if len(ends) > 1 else int(np.searchsorted(parents, 0, side="right"))
        ends.append(edge)
    for a, b in zip(ends[-2::-1], ends[:0:-1]):
        np.add.at(out, parents[a:b], out[a + 1 : b + 1])
    return out


def _trie(rows: pa.Table) -> pa.Table:
    """One shard: rows (k1, k2, p1, p2, depth, weight, leaves, below, apart) with their numbers of children and rollups.

    weight is what a node saves itself; of its children outside the shard, apart is their number, leaves their
    leaves, below what they save.
    """
    column = lambda name: rows.column(name).to_numpy()
    names = np.stack([column("k1"), column("k2")], axis=1).astype("<i8").view("V16").reshape(-1)
    above = np.stack([column("p1"), column("p2")], axis=1).astype("<i8").view("V16").reshape(-1)
    number = np.unique(np.concatenate([names, above]), return_inverse=True)[1].reshape(-1)
    order, parent = _level_order(number[: len(names)], number[len(names) :], column("depth"))
    bits = louds(parent)
    parent = parents_of(bits)
    labels = {name: column(name)[order] for name in ("k1", "k2", "weight", "leaves", "below", "apart")}
    inside = np.diff(np.flatnonzero(np.append(True, ~bits)))[1:] - 1 if len(order) else order
    children = inside + labels["apart"]
    # a node without children is a leaf itself
    n_leaves = _roll_up(parent, labels["leaves"] + (children == 0))[1:]
    saved = _roll_up(parent, labels["weight"] + labels["below"])[1:]
    return pa.table({"k1": labels["k1"], "k2": labels["k2"], "n_children": children, "n_leaves": n_leaves, "saved_tokens": saved})


_ROLLED = "k1 long, k2 long, n_children long, n_leaves long, saved_tokens long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the SHA-256 of each node's ids, fed in ascending order; a node's ids are never held together."""
    sorted_ids = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, int)
            ids = batch.column(2).to_pylist()
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                part = ",".join(map(str, ids[a:b])).encode()
                if at == (k1[a], k2[a]):
                    state.update(b"," + part)
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (int(k1[a]), int(k2[a])), hashlib.sha256(part)
            yield _digest_rows(out)
        if at is not None:
            yield _digest_rows([(*at, state.hexdigest())])

    return sorted_ids.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _digest_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])


def prefix_trie(convs: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """One row for each distinct prefix (node) of the rebuilt conversations, the empty one (the root) included.

    A conversation's turns are ordered by turn (null first), then role and text where turns tie; null role
    or text is empty. It takes its first h = crc32(id) % `most` turns from conversation id - id % `share`
    (the remainder has the id's sign) and keeps its own after its first h. Rows without a conv_id belong to
    no conversation. Repeated rows are turns of their own. Without conversations there is no node. Other
    columns are ignored. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    paths, lengths = _paths(convs, share, most)
    zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2")]
    sums = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("ends").cast("long")).alias("n_ends")]
    plain = paths.groupBy("k1", "k2", "depth", "p1", "p2", "size").agg(*sums)
    root = lengths.groupBy(*zero).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum((F.col("length") == 0).cast("long")).alias("n_ends"))
    root = root.select("k1", "k2", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("size"), "n_convs", "conv_id", "n_ends")
    nodes = written(plain.unionByName(root), "nodes")
    total = nodes.count()
    many = max(1, math.isqrt(total))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_convs").alias("parent_n"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    nodes = written(nodes.join(parents, ["p1", "p2", "depth"], "left"), "nodes-with-parents").select("k1", "k2", "p1", "p2", "depth", "size", "n_convs", "conv_id", "n_ends", "parent_n", "parent_conv_id")
    upper = (F.col("n_convs") > many) | (F.col("depth") == 0)
    top_parent = (F.col("parent_n") > many) | (F.col("depth") == 1)

    # subtrees: who belongs under which top, by the members of the tops
    light = nodes.where(~upper)
    tops = light.where(top_parent & (F.col("n_convs") > 1)).select("k1", "k2")
    members = paths.join(tops, ["k1", "k2"]).select("conv_id", F.col("k1").alias("top"))
    shards = max(1, total // SHARD)
    inner = light.where((F.col("n_convs") > 1) | ((F.col("parent_n") > 1) & ~top_parent)).join(members, "conv_id").withColumn("shard", F.pmod(F.hash("top"), F.lit(shards)))
    weight = ((F.col("n_convs") - 1) * F.col("size")).alias("weight")
    # a lone node's descendants are outside: they have its one leaf, and count as one child
    lone = (F.col("n_convs") == 1) & (F.col("n_ends") == 0)
    outside = [F.when(lone, 1).otherwise(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below"), F.when(lone, 1).otherwise(0).cast("long").alias("apart")]
    rolled = written(inner.select("shard", "k1", "k2", "p1", "p2", "depth", weight, *outside).groupBy("shard").applyInArrow(_trie, _ROLLED), "rolled")
    singles = light.where((F.col("n_convs") == 1) & (top_parent | (F.col("parent_n") == 1)))
    singles = singles.select("k1", "k2", (F.col("n_ends") == 0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "p1", "p2", top_parent.alias("on_top"))

    # the upper levels: what hangs from each, and a trie of at most the root of all nodes
    on_top = light.where(top_parent & (F.col("n_convs") > 1)).select("k1", "k2", "p1", "p2").join(rolled, ["k1", "k2"])
    hung = on_top.select("p1", "p2", "n_leaves", "saved_tokens").unionByName(singles.where("on_top").select("p1", "p2", "n_leaves", "saved_tokens"))
    hung = hung.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"), F.count("*").alias("apart"))
    heavy = nodes.where(upper).select("k1", "k2", F.coalesce("p1", F.lit(-1)).alias("p1"), F.coalesce("p2", F.lit(-1)).alias("p2"), "depth", weight)
    heavy = heavy.join(hung, ["k1", "k2"], "left").fillna(0, ["leaves", "below", "apart"])
    above = heavy.groupBy(F.lit(0).alias("shard")).applyInArrow(_trie, _ROLLED)

    everything = rolled.unionByName(above).unionByName(singles.select(*rolled.columns))
    rootless = lengths.where("length = 0").select(*zero, "conv_id")
    digests = _end_digests(paths.where("ends").select("k1", "k2", "conv_id").unionByName(rootless))
    known = nodes.join(everything, ["k1", "k2"]).join(digests, ["k1", "k2"], "left")
    return known.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


#: CRC-32 of a decimal id, bit by bit: the polynomial's reversed form and the all-ones start are fixed values.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))), lambda r, b: xor(r >> 1, CASE WHEN xor(r & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

ORACLE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, o.role, o.text, o.pos AS place FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, o.role, o.text, 9 + o.pos FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
steps AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, strlen(text) AS size,
         sha256(length(role) || ':' || role || text) AS turn_name
  FROM (SELECT * FROM rebuilt)),
named AS (SELECT conv_id, depth, size, sha256(string_agg(turn_name, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM steps),
paths AS (
  SELECT conv_id, depth, size, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM named
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(size) AS size, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.n) AS ends
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
rolled AS (
  SELECT a.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.size) AS saved
  FROM nodes d LEFT JOIN children c ON c.node = d.node JOIN paths a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, r.n_leaves::BIGINT AS n_leaves,
       r.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN rolled r ON r.node = n.node
"""
