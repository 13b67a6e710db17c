"""Near-dedup as the pipeline sets it (five words, 0.8, the default), against brute force."""

from __future__ import annotations

import importlib.util
from collections import Counter
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from trialforge.llm import mixing, neardup, quality
from trialforge.llm.common import tokenizer_path

_spec = importlib.util.spec_from_file_location("operator_tests", Path(__file__).with_name("test_llm.py"))
cases = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(cases)


def test_near_duplicates_of_the_pipeline(spark):
    docs = spark.createDataFrame(cases.ROWS, cases.SCHEMA).repartition(3)
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == cases.links(cases.ROWS, 5, 4, 5)


NAMES = ["spans", "size", "_id", "_hash", "row", "row_id", "row_hash", "found", "epochs", "copy", "a.b", "it's `odd`", "digest", "node", "first", "sequence_id", "taken"]


def awkward(spark):
    """All rows of the operator tests, rows twice, and columns of every name that a stage may use."""
    rows = [(r[0], r[1], r[2], r[3], r[4], *(f"{k}:{n}" for n in NAMES)) for k, r in enumerate(cases.ROWS)]
    fields = ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *("`" + n.replace("`", "``") + "` string" for n in NAMES)]
    return spark.createDataFrame(rows + rows[:5], ", ".join(fields)).repartition(3)


def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def kept_whole(before, after):
    """Extra columns of each row stay together."""
    assert after.columns == before.columns and after.dtypes == before.dtypes
    known = {tuple(r[5:]) for r in before.collect()}
    got = [tuple(r[5:]) for r in after.collect()]
    assert set(got) <= known
    return got


def labelled(tmp_path, spark):
    rows = [(r[0], k % 2, 0) for k, r in enumerate(cases.ROWS) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_classifier_stage(spark, tmp_path):
    docs, where = awkward(spark), labelled(tmp_path, spark)
    got = kept_whole(docs, stages()["quality_classifier"](spark, docs, where))
    scores = quality.classify(docs, spark.read.parquet(f"{where}/labels.parquet")).collect()
    assert len(got) == sum(r["predicted"] for r in scores)


def test_near_dedup_stage(spark):
    docs = awkward(spark)
    after = stages()["minhash_near_dedup"](spark, docs, "")
    kept_whole(docs, after)
    links = cases.links(cases.ROWS, 5, 4, 5)
    shingled = {(r[0], r[1]) for r in cases.ROWS if (r[1] or "").encode().split()}
    components = {c for (_, n, c), _ in links.items() if n}
    got = after.collect()
    assert {r["doc_id"] for r in got if (r["doc_id"], r["text"]) in shingled and r["doc_id"] is not None} == components - {None}
    assert len(got) == len({(r["doc_id"], r["text"]) for r in got})


def test_personal_data_stage(spark):
    docs = awkward(spark)
    after = stages()["contextual_pii"](spark, docs, "")
    assert len(kept_whole(docs, after)) == docs.count()
    assert not any("@mail.example.com" in (r["text"] or "") for r in after.collect())


def test_mixing_stage(spark):
    docs = awkward(spark)
    got = Counter(kept_whole(docs, stages()["source_mixing"](spark, docs, "")))
    plan = mixing.mix(docs, whole=True).collect()
    want = Counter()
    for r in plan:
        want[tuple(r["row"])[5:]] += r["epochs"] + (r["last_words"] > 0) if r["taken"] else 0
    assert got == +want and len(plan) == docs.count()


def test_packing_stage(spark):
    docs = awkward(spark)
    got = stages()["best_fit_packing"](spark, docs, "").collect()
    assert sum(r["piece"] == 0 for r in got) == docs.count()


@pytest.mark.parametrize("name", ["quality_classifier", "minhash_near_dedup", "contextual_pii", "source_mixing", "best_fit_packing"])
def test_stages_of_nothing(spark, tmp_path, name):
    docs = awkward(spark).limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stages()[name](spark, docs, str(tmp_path)).count() == 0


def test_run(spark, tmp_path):
    """All five stages: what is left of each is what the stage's own rules leave, and the packing is gapless."""
    where = labelled(tmp_path, spark)
    awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{where}/documents.parquet")
    pipeline = pytest.importorskip("corpus_pipeline")
    got = pipeline.run(spark, where).collect()
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, where).collect(), docs.schema)
    ids = {}
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in docs.collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want[r["doc_id"]] += n
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
        ids.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for places in ids.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
