import os
import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline as p
from tests.compare import duck
from tests.llm.test_minhash_dedup import brute
from voltlane.llm import bpe, minhash_dedup, mixing, toxicity
from voltlane.llm.common import BATCH_ROWS, SQL, Stages, remainder

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_against_its_parts(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i for i, k in duck(SF).execute(f"SELECT doc_id, kept FROM ({SQL['op1_quality_rules']})").fetchall() if k}
    lexicon = toxicity.learned(spark, SF)
    matcher = toxicity.Matcher(lexicon)
    kept = {i for i in kept if toxicity.score_of(rows[i].text, matcher, lexicon) < p.TOXIC}
    kept = {c for _, c in brute([(i, rows[i].text) for i in sorted(kept)])}
    got = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert set(got) == kept and len(kept) < len(rows)
    own = bpe.codec(bpe.VOCABULARY)
    assert all(got[i].n_tokens == len(own.encode(rows[i].text)) for i in kept)


def test_stages_keep_columns_and_take_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for _, stage in p.STAGES[:-1]:
        if stage is not p.clean:
            assert stage(spark, spark.createDataFrame([], schema), SF).schema.names == list(p.DOCUMENT_COLUMNS)
    docs = spark.createDataFrame([(1, "the cat and the dog went to the house of a man on the hill", "en", None, 3)] * 3 + [(2, None, None, None, None)], schema)
    for name, stage in p.STAGES:
        docs = stage(spark, docs.withColumn("kept", remainder(docs.doc_id, 2)) if name == "quality_rules" else docs, SF)
    assert [r.doc_id for r in docs.collect()] == [1]


def test_last_stage_gives_every_document_its_position_in_the_mix(spark):
    texts = {7: "word " * 20_000, 8: None}
    rows = [(i, texts.get(i, f"text {i}" * (1 + i % 50)), "en", f"src{i % 3}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    placed, names = mixing.mix_sources(docs)
    expected = {r.doc_id: r[names["position"]] for r in placed.collect()}
    assert sorted(expected.values()) == list(range(400))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = Stages(spark, "test")(p.mixed(spark, docs, ""), "mix_sources")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(written.inputFiles()) > 1
    for mix in (written, p.mixed(spark, docs, "")):
        assert {r.doc_id: r.position for r in p.tokens(spark, mix, "").collect()} == expected


@pytest.mark.parametrize(("given", "held"), [("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("50", 50)])
def test_stages_with_python_get_small_batches(spark, given, held):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"text {i}", "en", "src", i) for i in range(5_000)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.conf.set(setting, given)
    try:
        p.distinct(spark, docs, "")
        counts = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r.n for r in counts.collect()) == held
    finally:
        spark.conf.unset(setting)


def test_signing_and_its_buffers_are_small_beside_the_batch():
    rows = 2_000
    text = " ".join(f"w{i}" for i in range(400))
    batch = pa.RecordBatch.from_pydict({"id": list(range(rows)), "h": [0] * rows, "g": [0] * rows, "text": [f"{i} {text}" for i in range(rows)]})
    list(minhash_dedup.sign([batch.slice(0, 2)]))
    tracemalloc.start()
    try:
        signed = sum(b.num_rows for b in minhash_dedup.sign([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert signed == rows and peak < 50_000_000
