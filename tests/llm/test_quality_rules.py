import os

import pytest

from tests.compare import compare, duck
from voltlane.llm.common import SQL
from voltlane.llm.quality_rules import Rule, keep_quality, op1_quality_rules, with_quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_matches_sql(spark):
    assert compare(duck(SF), op1_quality_rules(spark, SF), SQL["op1_quality_rules"]) is None


def test_sql_agrees_on_odd_texts(spark, tmp_path):
    clean = "the quick brown fox jumps over a lazy dog and then it goes home"
    texts = [
        None, "", " \t\n\x0b\x0c\r ", clean, clean + "\n" + clean, "a\n a\na", "... x\n- y", "#*$%&|<> " * 12, "é ß x " * 8,
        "one two three four five " * 2, "x" * 100_000, "the " * 30_000, "\n".join([clean] * 5), "a!! " * 20, "Ünï the çode " * 6,
    ]
    rows = [(i, t, True, "own") for i, t in enumerate(texts)] + [(99, clean, True, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, _words string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    judged, names = with_quality(df)
    assert names["kept"] == "kept_" and judged.columns[:4] == df.columns
    assert compare(con, judged.drop("kept", "_words", "text").withColumnRenamed("kept_", "kept"), SQL["op1_quality_rules"]) is None


def test_rules_bound_and_empty(spark):
    df = spark.createDataFrame([(1, "w " * 5 + "the a b c d e f g h i j")], "doc_id long, text string")
    assert keep_quality(df, (Rule("mean_word_length", 1.0, 1.5),)).columns == df.columns
    assert keep_quality(df, (Rule("mean_word_length", 5.0, None),)).count() == 0
    assert keep_quality(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = with_quality(df)[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_are_judged_alike(spark):
    text = "one two three four five one two three four five and so on for a while it is the end"
    df = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string")
    rows = with_quality(df)[0].collect()
    assert len(rows) == 3 and len(set(rows)) == 1 and rows[0].n_repeat_words == 10 and rows[0].base_failed
