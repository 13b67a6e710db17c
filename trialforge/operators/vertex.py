"""Graph properties as vertex programs over edge tables of many graphs at once.

Edges are (g, u, v), each once, u < v. A program keeps a row of state for each vertex, sends it along the
edges, sums what arrives by vertex, and stops when nothing changes; each round is a written table, so
plans stay short and a lost executor costs one round. Searches from all vertices hold a graph of at most
SMALL edges as one row for each word of sources; nothing of a larger graph is held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialforge.operators import graphs, order
from trialforge.sources.shared import cut

#: Sources in one word of bits.
WORD = 63
#: Graphs of at most so many edges are searched as rows.
SMALL = 512


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("g", "u", "v").unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select("g", F.col("u").alias("node")).distinct()


def core_numbers(edges: DataFrame) -> DataFrame:
    """(g, node, core): the greatest k such that the node is left when nodes of fewer than k neighbours are peeled off.

    A node's estimate starts at its degree and becomes the greatest k that k neighbours' estimates reach;
    the fixed point is the core number.
    """
    ways = cut(both_ways(edges), "edges")
    state = cut(ways.groupBy("g", F.col("u").alias("node")).agg(F.count("*").alias("core")), "cores")
    while True:
        heard = ways.join(state.withColumnRenamed("node", "u"), ["g", "u"]).groupBy("g", F.col("v").alias("node"), F.col("core").alias("k")).agg(F.count("*").alias("n"))
        # a row for each distinct estimate around a node
        upper = Window.partitionBy("g", "node").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
        reached = heard.withColumn("reach", F.least("k", F.sum("n").over(upper))).groupBy("g", "node").agg(F.max("reach").alias("next"))
        after = cut(state.join(reached, ["g", "node"]).select("g", "node", F.least("core", "next").alias("core"), (F.col("next") < F.col("core")).alias("fell")), "cores")
        if not after.where("fell").limit(1).count():
            return after.drop("fell")
        state = after.drop("fell")


def two_colouring(edges: DataFrame) -> DataFrame:
    """(g, node, root, parity): each component's least node, and the parity of the way by which it was heard of.

    Where a component has an edge between equal parities, it is not bipartite; else parities are its two sides.
    """
    ways = cut(both_ways(edges), "edges")
    state = vertices(edges).select("g", "node", F.struct(F.col("node").alias("root"), F.lit(0).alias("parity")).alias("known"))
    while True:
        heard = ways.join(state.withColumnRenamed("node", "u"), ["g", "u"]).groupBy("g", F.col("v").alias("node")).agg(F.min(F.struct(F.col("known.root").alias("root"), (1 - F.col("known.parity")).alias("parity"))).alias("said"))
        closer = F.col("said.root") < F.col("known.root")
        after = cut(state.join(heard, ["g", "node"]).select("g", "node", F.when(closer, F.col("said")).otherwise(F.col("known")).alias("known"), closer.alias("moved")), "colours")
        if not after.where("moved").limit(1).count():
            return after.select("g", "node", "known.root", "known.parity")
        state = after.drop("moved")


def levels_by_rounds(edges: DataFrame) -> DataFrame:
    """The levels of `searched` for graphs of any size: a written table for each level."""
    ways = cut(both_ways(edges), "edges")
    placed = order.running(vertices(edges).withColumn("one", F.lit(1).cast("long")), ["g"], ["node"], "one", "place").withColumn("place", F.coalesce("place", F.lit(0).cast("long")))
    bit = F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")
    state = cut(placed.select("g", F.expr(f"place div {WORD}").alias("word"), "node", bit.alias("seen"), bit.alias("front")), "reached")
    levels, level = [], 0
    while True:
        level += 1
        sent = ways.join(state.where("front <> 0").select("g", F.col("node").alias("u"), "word", F.col("front").alias("bits")), ["g", "u"]).select("g", "word", F.col("v").alias("node"), "bits")
        met = sent.join(state, ["g", "word", "node"], "left")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        heard = met.groupBy("g", "word", "node").agg(F.bit_or(fresh).alias("new"), F.sum(F.bit_count(fresh)).alias("n"), F.max(F.col("bits").bitwiseAND(F.coalesce("front", F.lit(0).cast("long"))) != 0).alias("odd"))
        zero = F.lit(0).cast("long")
        told = state.select("g", "word", "node", "seen").join(heard, ["g", "word", "node"], "full")
        new = F.coalesce("new", zero)
        after = cut(
            told.select("g", "word", "node", F.coalesce("seen", zero).bitwiseOR(new).alias("seen"), new.alias("front"), F.coalesce("odd", F.lit(False)).alias("odd"), (F.coalesce("n", zero) > F.bit_count(new)).alias("twice")),
            "reached",
        )
        found = cut(after.groupBy("g").agg(F.lit(level).cast("long").alias("level"), F.sum(F.bit_count("front")).cast("long").alias("pairs"), F.max("odd").alias("odd"), F.max("twice").alias("twice")), "levels")
        levels.append(found.where("pairs > 0 or odd"))
        if not found.where("pairs > 0").limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        state = after.drop("odd", "twice")


def _of_batch(count: np.ndarray, u: np.ndarray, v: np.ndarray, word: int) -> list[tuple[np.ndarray, ...]]:
    """Of graphs that lie one after another, `count` edges each: (graph, level, pairs, odd, twice, components, largest, degeneracy)."""
    k, names, m = np.tile(np.repeat(np.arange(len(count)), count), 2), np.concatenate([u, v]), len(u)
    order = np.lexsort((names, k))  # ways by graph and end
    k, names = k[order], names[order]
    first = np.append(True, (k[1:] != k[:-1]) | (names[1:] != names[:-1]))
    node = np.cumsum(first) - 1
    of_end = np.empty_like(node)
    of_end[order] = node
    near = of_end[(order + m) % (2 * m)]
    begin = np.flatnonzero(first)
    graph = k[begin]
    start = np.flatnonzero(np.diff(graph, prepend=-1))
    place = np.arange(len(begin)) - start[graph]
    higher, size = np.zeros(len(begin), bool), np.zeros(len(begin), np.int64)
    levels: list[list[np.ndarray]] = []
    for w in range(int(place.max()) // word + 1):
        own = np.where(place // word == w, np.uint64(1) << (place % word).astype(np.uint64), np.uint64(0))
        seen = front = own
        level = 0
        while front.any():
            bits = front[near]
            once = np.bitwise_or.reduceat(bits, begin)
            new = once & ~seen
            times = np.add.reduceat(np.bitwise_count(bits & ~seen[node]), begin, dtype=np.int64)
            told = [np.add.reduceat(np.bitwise_count(new), start, dtype=np.int64), np.logical_or.reduceat(once & front != 0, start), np.logical_or.reduceat(times > np.bitwise_count(new), start)]
            if level < len(levels):
                told = [levels[level][0] + told[0], levels[level][1] | told[1], levels[level][2] | told[2]]
                levels[level] = told
            else:
                levels.append(told)
            seen, front, level = seen | new, new, level + 1
        size += np.bitwise_count(seen)
        lower = np.where(place // word > w, seen, np.where(own > 0, seen & (own - (own > 0)), 0))
        higher |= lower != 0
    parts, largest = np.add.reduceat(~higher, start, dtype=np.int64), np.maximum.reduceat(size, start)
    # peeling: a graph goes on to the next core where no vertex falls
    left, core = np.ones(len(begin), bool), np.zeros(len(count), np.int64)
    while left.any():
        falls = left & (np.add.reduceat(left[near], begin, dtype=np.int64) <= core[graph])
        core += np.logical_or.reduceat(left, start) & ~np.logical_or.reduceat(falls, start)
        left &= ~falls
    out = []
    for level, (pairs, odd, twice) in enumerate(levels, 1):
        g = np.flatnonzero((pairs > 0) | odd)
        out.append((g, np.full(len(g), level), pairs[g], odd[g], twice[g], parts[g], largest[g], core[g]))
    return out


def rows_searched(edges: DataFrame) -> DataFrame:
    """(g, level, pairs, odd, twice, n_components, largest, degeneracy) for graphs of bounded size, each a row of its edges; see `searched`."""
    word = WORD

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ends = part.column(1).flatten()
                u, v = (x.to_numpy(zero_copy_only=False) for x in ends.flatten())
                names = part.column(0).to_numpy(zero_copy_only=False)
                for g, *told in _of_batch(pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False), u, v, word):
                    yield pa.RecordBatch.from_arrays([pa.array(names[g], pa.int64()), *map(pa.array, told)], names=["g", "level", "pairs", "odd", "twice", "n_components", "largest", "degeneracy"])

    listed = edges.groupBy("g").agg(F.collect_list(F.struct("u", "v")).alias("ends"))
    return listed.mapInArrow(search, "g long, level long, pairs long, odd boolean, twice boolean, n_components long, largest long, degeneracy long")


def searched(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Searches from all vertices, WORD sources to a word of bits: (g, level, pairs, odd, twice) of all graphs, (g, n_components,
    largest, degeneracy) of those of at most SMALL edges, which are rows, and the edges of the others, which took rounds.

    pairs: ordered pairs at distance `level`. odd: an edge lies between two vertices of the level before, as seen from
    some source. twice: some vertex of the level has two neighbours in the level before. largest: vertices of the largest component.
    """
    counts = edges.groupBy("g").agg((F.count("*") <= SMALL).alias("small"))
    sized = cut(edges.select("g", "u", "v").join(counts, "g"), "sized")
    rows = cut(rows_searched(sized.where("small")), "searched")
    levels, parts = rows.select("g", "level", "pairs", "odd", "twice"), rows.where("level = 1").select("g", "n_components", "largest", "degeneracy")
    big = sized.where("not small").drop("small")
    if not big.limit(1).count():
        return levels, parts, None
    return levels.unionByName(levels_by_rounds(big)), parts, big


def distance_levels(edges: DataFrame) -> DataFrame:
    return searched(edges)[0]


def path_properties(edges: DataFrame) -> DataFrame:
    """(g, n_pairs, avg_path, diameter, girth): over ordered pairs that are joined by a path; girth null without a cycle."""
    return of_levels(distance_levels(edges))


def of_levels(levels: DataFrame) -> DataFrame:
    cycle = F.least(F.when(F.col("odd"), 2 * F.col("level") - 1), F.when(F.col("twice"), 2 * F.col("level")))
    return levels.groupBy("g").agg(F.sum("pairs").alias("n_pairs"), (F.sum(F.col("pairs") * F.col("level")) / F.sum("pairs")).alias("avg_path"), F.max(F.when(F.col("pairs") > 0, F.col("level"))).alias("diameter"), F.min(cycle).alias("girth"))


def families(edges: DataFrame) -> DataFrame:
    """(g, n, m, n_components, bipartite, family): what each graph is, by counts, degrees and its two-colouring.

    The first that holds of complete, star, path, tree, forest, cycle, complete_bipartite, regular, bipartite, other.
    """
    colours = cut(two_colouring(edges), "coloured")
    degrees = both_ways(edges).groupBy("g", F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    shape = degrees.groupBy("g").agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.min("degree").alias("low"), F.max("degree").alias("high"))
    parts = colours.groupBy("g").agg(F.count_if(F.col("node") == F.col("root")).alias("n_components"), F.sum("parity").cast("long").alias("ones"))
    side = colours.select("g", "node", "parity")
    clash = edges.join(side.select("g", F.col("node").alias("u"), F.col("parity").alias("a")), ["g", "u"]).join(side.select("g", F.col("node").alias("v"), F.col("parity").alias("b")), ["g", "v"])
    clash = clash.groupBy("g").agg(F.max(F.col("a") == F.col("b")).alias("clashes"))
    known = shape.join(parts, "g").join(clash, "g").withColumn("bipartite", ~F.col("clashes"))
    ones = F.col("ones")
    return known.select("g", "n", "m", "n_components", "bipartite", family(F.col("n"), F.col("m"), F.col("low"), F.col("high"), F.col("n_components"), F.col("bipartite"), F.col("m") == ones * (F.col("n") - ones)).alias("family"))


def family(n: Column, m: Column, low: Column, high: Column, parts: Column, bipartite: Column, all_across: Column) -> Column:
    """Name of the family; all_across: a connected two-coloured graph has every edge between its sides."""
    one = parts == 1
    tree = one & (m == n - 1)
    return (
        F.when(2 * m == n * (n - 1), "complete").when(tree & (high == n - 1), "star").when(tree & (high <= 2), "path").when(tree, "tree").when(m == n - parts, "forest")
        .when(one & (low == 2) & (high == 2), "cycle").when(one & bipartite & all_across, "complete_bipartite")
        .when(low == high, "regular").when(bipartite, "bipartite").otherwise("other")
    )


def colour_classes(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(g, n_colours, same_as): colour refinement by hashes; graphs of equal colour counts share the least g among them.

    A colour is a hash of the own one and two sums over the neighbours' (upper and lower halves), so it needs no list of them.
    """
    ways = cut(both_ways(edges), "edges")
    halves = lambda c: [F.sum(F.shiftrightunsigned(c, 32)), F.sum(c.bitwiseAND(F.lit((1 << 32) - 1)))]
    state = vertices(edges).withColumn("colour", F.xxhash64(F.lit(1)))
    for _ in range(rounds):
        high, low = halves(F.col("colour"))
        heard = ways.join(state.withColumnRenamed("node", "u"), ["g", "u"]).groupBy("g", F.col("v").alias("node")).agg(high.alias("high"), low.alias("low"))
        state = cut(state.join(heard, ["g", "node"]).select("g", "node", F.xxhash64("colour", "high", "low").alias("colour")), "refined")
    counted = state.groupBy("g", "colour").agg(F.count("*").alias("n"))
    high, low = halves(F.xxhash64("colour", "n"))
    named = cut(counted.groupBy("g").agg(F.count("*").alias("n_colours"), high.alias("high"), low.alias("low")), "named")
    first = named.groupBy("n_colours", "high", "low").agg(F.min("g").alias("same_as"))
    return named.join(first, ["n_colours", "high", "low"]).select("g", "n_colours", "same_as")


def graph_properties(edges: DataFrame) -> DataFrame:
    """One row for each graph: counts, degrees, components, two-colouring, paths, girth, triangles, clustering, assortativity, degeneracy.

    Each part is a program or a join of its own over the same edges; rows meet by graph only at the end. The levels of
    the searches also tell the two-colouring: no edge within a level, and 2 m pairs at odd distances where all are edges.
    Triangles are sought where the girth is three.
    """
    edges = cut(edges, "graphs")
    levels, parts, big = searched(edges)
    if big is not None:
        sizes = two_colouring(big).groupBy("g", "root").agg(F.count("*").alias("size")).groupBy("g").agg(F.count("*").alias("n_components"), F.max("size").alias("largest"))
        parts = parts.unionByName(sizes.join(core_numbers(big).groupBy("g").agg(F.max("core").alias("degeneracy")), "g"))
    sides = levels.groupBy("g").agg((~F.max("odd")).alias("bipartite"), F.sum(F.when(F.col("level") % 2 == 1, F.col("pairs")).otherwise(0)).alias("across"))
    whole = graphs.degree_properties(edges, ["g"]).join(parts, "g").join(sides, "g").join(of_levels(levels), "g")
    n, m = F.col("n_vertices"), F.col("n_edges")
    named = family(n, m, F.col("min_degree"), F.col("max_degree"), F.col("n_components"), F.col("bipartite"), F.col("across") == 2 * m)
    whole = cut(whole.withColumn("family", named).withColumn("largest_fraction", F.col("largest") / n).drop("across", "largest"), "whole")
    closed = cut(edges.join(whole.where("girth = 3").select("g"), "g", "left_semi"), "closed")
    whole = whole.join(graphs.assortativity(edges, ["g"]), "g").join(graphs.clustering(closed, ["g"]), "g", "left")
    return whole.fillna(0, ["triangles", "clustering_global", "clustering_avg"]).withColumn("is_connected", F.col("n_components") == 1)
