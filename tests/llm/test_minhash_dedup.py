import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import voltlane.llm.minhash_dedup as m
from voltlane.llm.words import mix

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Smallest id of each row's class, by all pairs that share a run of five words."""
    bags = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (WORD.findall(t or "") for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unite(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    first = {}
    for k, (i, t) in enumerate(rows):
        unite(k, first.setdefault(("id", i), k))
        if t is not None:
            unite(k, first.setdefault(("text", t), k))
    where = defaultdict(list)
    for k, bag in enumerate(bags):
        for s in bag:
            where[s].append(k)
    for x, y in {(x, y) for ks in where.values() for x in ks for y in ks if x < y}:
        if sum((bags[x] & bags[y]).values()) >= 0.8 * sum((bags[x] | bags[y]).values()):
            unite(x, y)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, low[find(k)]) for k, (i, _) in enumerate(rows))


def result(df):
    return sorted((r.doc_id, r.class_id) for r in df.collect())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = Counter(rng.integers(0, 400, 600).tolist())
    b = a + Counter(rng.integers(0, 400, 120).tolist())
    for x in list(a)[:40]:
        del b[x]
    b[3] += 40
    want, seen = sum((a & b).values()) / sum((a | b).values()), []
    for run in range(40):
        hashes = mix(np.arange(401, dtype=np.uint64) + np.uint64(run * 1000))
        s = m.signatures(np.concatenate([hashes[list(a)], hashes[list(b)]]), np.repeat([0, 1], [len(a), len(b)]), np.array([*a.values(), *b.values()]), 2)
        d = m.digests(s)
        seen.append((d[0] == d[1]).mean())
    assert abs(np.mean(seen) - want) < 4 * np.std(seen) / np.sqrt(len(seen)) + 0.003


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(m.op10_minhash_dedup(spark, SF)) == brute(rows)


@pytest.mark.parametrize("block", [1_000, 4])
def test_groups_beyond_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for g in range(3):
        for i in range(14):
            words = [f"{w}.{g}" for w in base]
            for at in rng.integers(0, 80, rng.integers(0, 3)):
                words[at] = f"new{i}"
            rows.append((int(g * 100 + i), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(m.near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    other = "quite another text with some words here"
    rows = [
        (1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (6, "a b"), (7, "a  b"), (8, base), (9, base + "x"), (9, base), (9, other), (10, other), (10, other),
        (11, base.replace(" ", "\n")), (12, "w " * 50_000), (13, "w " * 49_000), (14, "w " * 30_000), (15, "w w w w w"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    assert result(m.near_duplicates(df)) == brute(rows)
    kept = m.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})
    assert m.near_duplicates(df.limit(0)).count() == 0 and m.keep_one(df.limit(0)).count() == 0
