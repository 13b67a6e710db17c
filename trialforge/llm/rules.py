"""Host-level quality rules with DataFrame functions only.

Each document gets counts, a verdict by each of four rules and a base verdict. Failures of each rule
are summed by host (with partial sums, so one host with a third of all rows is no hot task), the
hosts' rates are shrunk by a beta prior for each rule, fitted to all hosts by moments, and the
verdict on the host joins back to its documents. A host fails where its shrunk rate of any rule is
more than `ratio` times the prior's mean, that is the mean of the hosts' rates, and above `least`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What a document fails by, from its counts.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "2 * n_symbols > n_words AND n_words > 0",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts of each row and base_failed; a null text has no words. The host may be null."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    d = d.withColumn("lines", lines).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("hashes"), i, F.lit(WINDOW))))).alias("windows"),
    )
    d = d.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # windows in order of (hash, place): equal ones are neighbours
    d = d.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform(
        "sorted",
        lambda x, k: F.when((F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"]), x["i"]),
    )
    d = d.withColumn("places", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    steps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + s), F.lit(0).cast("long"))
    d = d.withColumn("n_repeat_words", covered).drop("windows", "repeats", "sorted", "places")
    return d.withColumn("base_failed", F.expr(f"({RULES['short']}) OR ({RULES['repeats']})"))


def host_verdicts(rows: DataFrame, least: float = 0.25, ratio: float = 2.0) -> DataFrame:
    """Failure rates of each host by rule, shrunk to the beta prior that the hosts' rates have by moments."""
    failures = [F.sum(F.expr(f"cast({rule} AS long)")).alias(f"failed_{name}") for name, rule in RULES.items()]
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), *failures)
    moments = []
    for name in RULES:
        failed = F.col(f"failed_{name}")
        moments += [F.avg(failed / F.col("n")).alias(f"mean_{name}"), F.var_pop(failed / F.col("n")).alias(f"spread_{name}")]
    # one row, a pair of numbers for each rule
    found = hosts.agg(*moments).head()
    rates, outlying = [], []
    for name in RULES:
        mean, spread = found[f"mean_{name}"] or 0.0, found[f"spread_{name}"] or 0.0
        # prior documents, between 1 and 1000
        strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread else 1000.0
        rates.append(((F.col(f"failed_{name}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{name}"))
        outlying.append(F.col(f"rate_{name}") > max(least, ratio * mean))
    return hosts.select("host", "n", *rates).withColumn("host_failed", reduce(or_, outlying))


def quality_rules(docs: DataFrame, host: str = "source", least: float = 0.25, ratio: float = 2.0) -> DataFrame:
    """Counts, base_failed, the host's shrunk failure rate by each rule, and kept.

    Every row gives a row. Rows without a host are one host of their own. A null text has no
    words and fails. Other columns are ignored.
    """
    rows = written(document_rules(docs, host), "rules")
    verdicts = host_verdicts(rows, least, ratio).withColumnRenamed("host", "of_host")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *[f"rate_{name}" for name in RULES])


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), g AS (
    SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), r AS (
    SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), c AS (
    SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n_repeat_words
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM r) GROUP BY doc_id
), l AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
    SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
), f AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), r4 AS (
    SELECT source, (n_words < 20)::INT AS f1, (100 * n_repeat_words > 30 * n_words)::INT AS f2,
           (2 * n_symbols > n_words AND n_words > 0)::INT AS f3, (10 * n_dup_lines > 3 * n_lines)::INT AS f4
    FROM f
), long AS (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([f1, f2, f3, f4]) AS failed FROM r4
), h AS (
    SELECT source, rule, count(*) AS n, sum(failed)::BIGINT AS failures FROM long GROUP BY source, rule
), p AS (
    SELECT rule, avg(failures / n) AS mean, var_pop(failures / n) AS spread FROM h GROUP BY rule
), s AS (
    SELECT rule, mean, CASE WHEN spread = 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) END AS strength FROM p
), v AS (
    SELECT source, max((failures + mean * strength) / (n + strength)) FILTER (rule = 'short') AS rate_short,
           max((failures + mean * strength) / (n + strength)) FILTER (rule = 'repeats') AS rate_repeats,
           max((failures + mean * strength) / (n + strength)) FILTER (rule = 'symbols') AS rate_symbols,
           max((failures + mean * strength) / (n + strength)) FILTER (rule = 'lines') AS rate_lines,
           bool_or((failures + mean * strength) / (n + strength) > greatest(0.25, 2 * mean)) AS host_failed
    FROM h JOIN s USING (rule) GROUP BY source
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept,
       round(rate_short, 9) AS rate_short, round(rate_repeats, 9) AS rate_repeats,
       round(rate_symbols, 9) AS rate_symbols, round(rate_lines, 9) AS rate_lines
FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
