"""Many id selections at once: presets resolved by a join, parts made disjoint spans, spans met by places of ids.

The parts of a selection become spans that do not overlap, so an id is met once and no pair has to be told
from its copies. Ends of spans and ids are sorted together; the number of ids before an end is its place. A
selection's size is a sum over places; its ids are runs of blocks of sorted ids, cut at the ends of the span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialforge.operators import order
from trialforge.sources.shared import cut

#: All ids are below 2 to this.
WHOLE = 62

#: Ids of one block. A run is shuffled as a row for each block that it meets; files hold a block's ids as small numbers.
BLOCK = 1 << 11

#: Partitions of the blocks. Fewer blocks are copied, and the runs dealt over the copies.
SHARES = 256


def resolved(selections: DataFrame, presets: DataFrame) -> DataFrame:
    """(selection_id, spec) with preset names replaced by their text."""
    named = presets.select(F.trim("name").alias("_name"), "selection")
    joined = selections.withColumn("_name", F.trim("spec")).join(named, "_name", "left")
    return joined.select("selection_id", F.coalesce("selection", "spec").alias("spec"))


def ranges(selections: DataFrame) -> DataFrame:
    """(selection_id, part, excluded, low, high) of each part: ids and ranges by commas or &, ! leaves out, * is all.

    Dashes may be typographic. low is null for a part that is none of these.
    """
    text = F.regexp_replace("spec", "[–—]", "-")
    parts = selections.select("selection_id", F.explode(F.split(text, "[,&]")).alias("part")).withColumn("part", F.trim("part")).where("part <> ''")
    body = F.trim(F.regexp_replace("part", "^!", ""))
    low, high = F.regexp_extract(body, r"^(\d+)(?:\s*-\s*(\d+))?$", 1), F.regexp_extract(body, r"^(\d+)(?:\s*-\s*(\d+))?$", 2)
    start = F.when(F.col("part") == "*", F.lit(0)).when(low != "", low.cast("long"))
    end = F.when(F.col("part") == "*", F.lit((1 << WHOLE) - 1)).when(high != "", high.cast("long")).when(low != "", low.cast("long"))
    return parts.select("selection_id", "part", F.col("part").startswith("!").alias("excluded"), start.alias("low"), end.alias("high"))


def spans(selections: DataFrame, presets: DataFrame) -> DataFrame:
    """(selection_id, low, end): disjoint spans of what a selection includes and does not leave out, without `end`.

    A part that cannot be read is an error.
    """
    parts = ranges(resolved(selections, presets))
    wrong = F.raise_error(F.concat(F.lit("not an id or a range: "), F.col("part")))
    parts = parts.withColumn("low", F.when(F.col("low").isNull(), wrong.cast("long")).otherwise(F.col("low"))).where("low <= high")
    ends = F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("step")), F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = parts.select("selection_id", "excluded", F.inline(ends)).groupBy("selection_id", "at").agg(F.sum(F.when(~F.col("excluded"), F.col("step")).otherwise(0)).alias("more"), F.sum(F.when(F.col("excluded"), F.col("step")).otherwise(0)).alias("less"))
    # a row for each end of a part of one selection
    along = Window.partitionBy("selection_id").orderBy("at")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select("selection_id", F.col("at").alias("low"), F.lead("at").over(along).alias("end"), F.sum("more").over(upto).alias("inside"), F.sum("less").over(upto).alias("outside"))
    return swept.where("inside > 0 and outside = 0").select("selection_id", "low", "end")


def _placed(ids: DataFrame, of: DataFrame) -> DataFrame:
    """(kind, which, at, selection_id, low, place) of each (which, id), kind 1, and of both ends of each (which, span), kind 0.

    place: the ids of the same `which` before it.
    """
    ends = of.select("which", "selection_id", "low", F.explode(F.array("low", "end")).alias("at"))
    rows = ends.select(F.lit(0).alias("kind"), "which", "at", "selection_id", "low", F.lit(0).cast("long").alias("one")).unionByName(ids.where("id is not null").distinct().select(F.lit(1).alias("kind"), "which", F.col("id").cast("long").alias("at"), F.lit(1).cast("long").alias("one")), allowMissingColumns=True)
    return order.running(rows, ["which"], ["at", "kind"], "one", "place").withColumn("place", F.coalesce("place", F.lit(0).cast("long"))).drop("one")


def selected(selections: DataFrame, ids: DataFrame, presets: DataFrame) -> DataFrame:
    """(selection_id, id): ids that a selection includes and does not leave out. A part that cannot be read is an error."""
    zero = F.lit(0).alias("which")
    placed = cut(_placed(ids.select(zero, "id"), spans(selections, presets).select(zero, "*")), "placed")
    copies = -(-SHARES // max(1, -(-placed.where("kind = 1").count() // BLOCK)))
    block = F.expr(f"place div {BLOCK}")
    blocks = placed.where("kind = 1").groupBy(block.alias("block")).agg(F.array_sort(F.collect_list("at")).alias("ids"))
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    runs = placed.where("kind = 0").groupBy("selection_id", "low").agg(F.min("place").alias("first"), F.max("place").alias("stop")).where("first < stop")
    dealt = F.pmod(F.xxhash64("selection_id", "low"), F.lit(copies)).cast("int").alias("copy")
    runs = runs.select("selection_id", "first", "stop", dealt, F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(stop - 1) div {BLOCK}"))).alias("block"))
    # partitions by number, as their few bytes become many rows; merged, so that ids leave block by block
    met = runs.repartition(SHARES, "block", "copy").join(blocks.hint("merge"), ["block", "copy"])
    start = F.greatest(F.col("first") - F.col("block") * BLOCK, F.lit(0))
    stop = F.least(F.col("stop") - F.col("block") * BLOCK, F.lit(BLOCK))
    return met.select("selection_id", F.explode(F.slice("ids", (start + 1).cast("int"), (stop - start).cast("int"))).alias("id"))


def counted(selections: DataFrame, ids: DataFrame, installed: DataFrame, presets: DataFrame) -> DataFrame:
    """still_to_install of `selected`, from places of spans alone: no pair of selection and id is made."""
    known = ids.select(F.lit(0).alias("which"), "id").unionByName(ids.join(installed.select("id"), "id", "left_semi").select(F.lit(1).alias("which"), "id"))
    of = spans(selections, presets).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("which"), "*")
    ends = _placed(known, of).where("kind = 0").withColumn("n", F.when(F.col("at") > F.col("low"), F.col("place")).otherwise(-F.col("place")))
    n, there = (F.sum(F.when(F.col("which") == k, F.col("n")).otherwise(0)) for k in (0, 1))
    return ends.groupBy("selection_id").agg(n.alias("n_selected"), there.alias("n_installed"), (n - there).alias("n_missing")).where("n_selected > 0")


def still_to_install(chosen: DataFrame, installed: DataFrame) -> DataFrame:
    """(selection_id, n_selected, n_installed, n_missing) of each selection against the ids that are there."""
    known = chosen.join(installed.select("id", F.lit(1).alias("there")), "id", "left")
    n, there = F.count("*"), F.count("there")
    return known.groupBy("selection_id").agg(n.alias("n_selected"), there.alias("n_installed"), (n - there).alias("n_missing"))
