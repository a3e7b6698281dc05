import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

import voltlane.llm.ngram_model as m

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def brute(training, texts):
    """(n_tokens, n_known, base_score, score) of every text."""
    words, pairs = Counter(), Counter()
    for t in map(tokens, training):
        words.update(t)
        pairs.update(zip(["<s>", *t], t, strict=False))
    context, types = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, v), c in pairs.items():
        context["<s>" if u == "<s>" else (u,)][0] += c
        context["<s>" if u == "<s>" else (u,)][min(c, 3)] += 1
        types[v] += 1
    high, low = (m.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]) for counts in (pairs, types))
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    total, size = sum(words.values()), len(words)
    rest = sum(low[min(c, 3) - 1] for c in types.values()) / len(pairs) if pairs else 1.0
    out = []
    for text in texts:
        t, base, score = tokens(text), 0.0, 0.0
        for u, v in zip(["<s>", *t], t, strict=False):
            base += math.log10((words[v] + 0.5) / (total + 0.5 * (size + 1)))
            p = (cut(types[v], low) / len(pairs) if pairs else 0) + rest / (size + 1)
            seen = context.get("<s>" if u == "<s>" else (u,))
            if seen:
                p = cut(pairs[(u, v)], high) / seen[0] + sum(d * n for d, n in zip(high, seen[1:], strict=True)) / seen[0] * p
            score += math.log10(p)
        out.append((len(t), sum(v in words for v in t), base, score))
    return out


def check(got, want):
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("part", [m.PART_BYTES, 20_000])
def test_documents_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(m, "PART_BYTES", part)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute([t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1], [t for _, t in docs])
    rows = sorted(m.op8_ngram_model(spark, SF).collect())
    check([(r.n_tokens, r.n_known, r.base_score, r.score) for r in rows], want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)


def test_odd_rows(spark):
    texts = [None, "", "A a B", "a b a", "a b a", " \n", "b " * 40_000, "çÇ x"]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for training in (texts, texts[2:4], []):
        model = m.train(spark.createDataFrame([(t,) for t in training], "text string"))
        scored, names = m.score(df, model)
        assert names["score"] == "score_"
        check([(r.n_tokens, r.n_known, r.base_score, r.score_) for r in sorted(scored.collect())], brute(training, texts))
        assert m.score(df.limit(0), model)[0].count() == 0
