"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key whose rate is its quality weight; the smallest keys come
first. A source's target is cut into complete epochs, which take every document, and a rest, for
which documents are taken in key order up to the token budget. Running sums need no sort of a
whole source: keys fall into buckets of about equal numbers of documents, bucket sums give the
words before each bucket, and rows are ranked within buckets only. All of it is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.llm.common import meet, whole_row, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: Quality weight of a document with many symbols; one without has 1.
LEAST_WEIGHT = 0.25
#: Rows in a bucket of one source, about.
BUCKET_ROWS = 5_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _draw(seed: int, text: Column) -> Column:
    """A number in (0, 1) from 48 bits of md5(seed:doc_id:md5(text)), so rows that share an id draw apart."""
    hex48 = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))), 1, 12)
    return (F.conv(hex48, 16, 10).cast("double") + 0.5) / float(1 << 48)


def sized(docs: DataFrame, seed: int = 17, whole: bool = False) -> DataFrame:
    """doc_id, source, size in words, and the exponential key of each row; on request the row itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), symbols.cast("long").alias("symbols"), F.xxhash64(text).alias("text_hash"), _draw(seed, text).alias("draw"), *([whole_row(docs)] if whole else []))
    # down to the least weight for two symbols a word or more
    weight = F.greatest(F.lit(LEAST_WEIGHT), 1 - F.col("symbols") * 0.375 / F.greatest(F.col("size"), F.lit(1)))
    return d.withColumn("key", -F.ln("draw") / weight).drop("symbols", "draw")


def source_targets(rows: DataFrame) -> DataFrame:
    """source, source_size and target: shares 1, 2, 3, 1, ... of all sizes in order of source.

    A target stops at MOST_EPOCHS times its source's size. The excess goes to the others by
    weight: in order of cap over weight, sources are capped as long as the level that the rest
    would get is above their cap.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    ratio = F.col("cap") / F.col("weight")
    rising = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rising), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), zero))
    by = by.withColumn("ratio", ratio).withColumn("level", level)
    # the level of the first source that isn't capped holds for all
    final = F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"], F.lit(float("inf")))
    return by.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * final).alias("target"))


def mix(docs: DataFrame, seed: int = 17, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken words, whole epochs and words of the last, partial taking.

    The document at the end of a budget is taken in part, so a source's taken words are its target
    rounded down. A null text or doc_id is a row like others (size 0 for a null text; rows of one id draw
    by their texts, and only rows of one id and text share a key); rows without a source are a source of
    their own, the last. Repeated rows are rows of their own. No rows, no result. Other columns are
    ignored; with `whole`, the column `row` has each row as it came.
    """
    rows = written(sized(docs, seed, whole), "sized")
    # key * LEAST_WEIGHT: no bucket has more than 1 / LEAST_WEIGHT times its share of a source
    buckets = max(1024, rows.count() // BUCKET_ROWS)
    place = F.least(F.lit(buckets - 1), F.floor(buckets * (1 - F.exp(-F.col("key") * LEAST_WEIGHT))).cast("int"))
    # one key for rows without a source, so that the window and the join share one exchange
    rows = rows.withColumn("bucket", place).withColumn("mix_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    targets = source_targets(rows)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.least(F.lit(MOST_EPOCHS), F.floor(F.col("target") / size)).cast("long")).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * size).cast("long")).withColumnRenamed("source", "of_source")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    sums = sums.select(F.col("source").alias("summed"), "bucket", before.alias("before"))
    plan = sums.join(targets, F.col("summed").eqNullSafe(F.col("of_source"))).select(F.coalesce(F.concat(F.lit("="), "summed"), F.lit("")).alias("mix_key"), "bucket", "before", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("mix_key", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    joined = meet(rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))), plan, ["mix_key", "bucket"])
    upto = F.col("before") + F.col("within")
    partly = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - upto))
    joined = joined.withColumn("last_words", partly)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last_words")).alias("taken"), "epochs", "last_words", *(["row"] if whole else []))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows with their own columns, each as often as its source's mix takes it.

    A document that ends a source's budget is cut to the words that fit; n_chars follows the text.
    """
    plan = mix(docs, seed, whole=True).where("taken > 0")
    copies = F.col("epochs") + (F.col("last_words") > 0).cast("long")
    plan = plan.select("row", "epochs", "last_words", "size", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("last_words") < F.col("size"))
    whole = F.col("row")["text"].cast("string")
    text = F.when(cut, F.array_join(F.slice(words_of(whole), F.lit(1), F.col("last_words").cast("int")), " ")).otherwise(whole)
    rows = plan.select("row", cut.alias("cut"), text.alias("new_text"))
    out = {c: F.col("row")[c] for c in docs.columns}
    out["text"] = F.col("new_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("cut"), F.length("new_text")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[e.alias(c) for c, e in out.items()])


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), z AS (
    SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS symbols,
           (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(text)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS draw
    FROM d
), k AS (
    SELECT doc_id, source, size, -ln(draw) / greatest(0.25::DOUBLE, 1 - symbols * 0.375::DOUBLE / greatest(size, 1)) AS key FROM z
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM k GROUP BY source
), r AS (
    SELECT *, cap / weight AS ratio,
           (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
    FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM r WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1), 'inf'::DOUBLE)) AS target FROM r
), e AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM t
), o AS (
    SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::BIGINT AS rest,
           coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, epochs * size + least(size, greatest(0, rest - upto)) AS taken,
       epochs, least(size, greatest(0, rest - upto)) AS last_words
FROM o
"""
