import os
import random

import numpy as np
import pytest

import voltlane.llm.token_counts as m
from voltlane.llm.bpe import VOCABULARY, codec

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_documents(spark):
    own = codec(VOCABULARY)
    want = {r.doc_id: len(own.encode_ordinary(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in m.op9_token_counts(spark, SF).collect()} == want


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
@pytest.mark.parametrize("tail", [[], [5, 5]])
def test_scan_stitches_blocks(spark, tmp_path, monkeypatch, block, tail):
    monkeypatch.setattr(m, "SCAN", 4)
    rng = random.Random(3)
    ids = [0 if rng.random() < 0.2 else 5 for _ in range(120)] + [5] * 200 + [0, 0, *tail]
    np.array(ids, dtype="<u2").tofile(tmp_path / "x.bin")
    np.zeros(0, dtype="<u2").tofile(tmp_path / "empty.bin")
    files = spark.createDataFrame([(f"{tmp_path}/x.bin",), (f"{tmp_path}/empty.bin",), (f"{tmp_path}/x.bin",)], "file string")
    got = m.scan_token_files(files, str(tmp_path), 0, 2, block).orderBy("ordinal").collect()
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 0:
            want.append((len(want), start, i - start, True))
            start = i + 1
    want += [(len(want), start, len(tail), False)] if tail else []
    assert [(r.ordinal, r.start, r.n_tokens, r.complete) for r in got] == want


def test_odd_texts(spark):
    own = codec(VOCABULARY)
    rows = [(1, None), (2, ""), (2, ""), (3, "<|endoftext|> a"), (4, "b " * 50_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", m.col("text"))
    got = sorted(((r.doc_id, r.n_tokens) for r in m.document_token_counts(df).collect()), key=str)
    assert got == sorted(((i, len(own.encode_ordinary(t)) if t else 0) for i, t in rows), key=str)
    assert m.document_token_counts(df.limit(0)).count() == 0
