import os
import random

import pytest

import voltlane.llm.toxicity as m

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms = {word(2, 11): 0.9 for _ in range(25)} | {word(4, 5) + "*": 0.95 for _ in range(4)}
    matcher = m.Matcher(m.Lexicon(terms, {}, 0.3))
    for _ in range(3000):
        w = word(0, 12)
        hit = matcher.match(w)
        best = [0.9 * (m.PRIOR[d] if (d := distance(w, t)) else 1.0) for t in terms if not t.endswith("*") and distance(w, t) <= (len(t) >= m.ONE_EDIT) + (len(t) >= m.TWO_EDITS)]
        best += [0.95 for t in terms if t.endswith("*") and w.startswith(t[:-1])]
        assert (hit.chance if hit else 0.0) == pytest.approx(max(best, default=0.0))


def test_quotation_counts_less_than_abuse():
    lexicon = m.Lexicon({"idiot": 0.99, "worthless": 0.99}, {}, 0.3)
    matcher = m.Matcher(lexicon)
    score = lambda t: m.score_of(t, matcher, lexicon)
    assert score("you idiot") > 0.9 > 0.7 > score('the word "idiot" was called an insult') > score("nothing here")
    assert score("so worthles") > 0.5 and score("so wxrthlexx") < 0.7
    assert score(None) == score("") == score("word " * 50_000) == pytest.approx(m.NO_HIT)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    scored = m.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored[scored.toxic == 0].predicted == 0).mean() > 0.97
    assert (scored[scored.toxic == 1].predicted == 1).mean() > 0.7


def test_odd_rows_and_labels(spark):
    rows = [(i, f"plain text {i} and the fool" if i % 2 else f"calm words {i}", "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (1, "FOOL", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 0), (7, None), (500, 1)], "doc_id long, toxic int")
    lexicon = m.learn_lexicon(m.labelled_sample(df, labels, "toxic"), 0.5)
    assert "fool" in lexicon.terms
    scored, name = m.score_toxicity(df, lexicon)
    got = [(r.text, r[name]) for r in scored.collect()]
    assert name == "score_" and len(got) == 63
    assert all((s >= 0.7) == bool(t and "fool" in t.lower()) for t, s in got)
    assert m.score_toxicity(df.limit(0), lexicon)[0].count() == 0
    assert m.learn_lexicon(m.labelled_sample(df, labels.limit(0), "toxic"), 0.0).terms == {}


def test_copies_of_one_toxic_text_teach_its_insult_only(spark):
    rng = random.Random(3)
    common = [f"common{i:03d}" for i in range(40)]
    copied = "yesterday the gardener planted lovely tulips beside our wooden fence you dumbhead"
    rows = [(i, copied, 1) for i in range(300)]
    for i in range(300, 900):
        toxic = i % 3 == 0
        words = rng.sample(common, 8) + ["dumbhead" if i % 2 else "wormface"] * toxic
        rows.append((i, " ".join([*words, str(i)]), int(toxic)))
    clean = [(1000 + i, f"{w} {' '.join(rng.sample(common, 5))}", None) for i, w in enumerate("yesterday gardener planted lovely tulips beside wooden fence".split())]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string, toxic int")
    lexicon = m.learn_lexicon(m.labelled_sample(df, df, "toxic"), 0.5)
    got = {r.doc_id: r.score for r in m.score_toxicity(df, lexicon)[0].collect()}
    assert all(got[i] < 0.7 for i, _, y in rows + clean if y != 1)
    assert all(got[i] >= 0.7 for i, _, y in rows if y == 1)
    texts = m.labelled_texts(df, df, "toxic")
    assert texts.count() == 601 and texts.where("y = 1").count() == 201
