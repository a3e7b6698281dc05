import random
import re
from collections import Counter, defaultdict

import pytest

from tests.compare import compare, duck
from voltlane.llm import divergence as m

TERM = re.compile(m.TERM)


def terms(text):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least, top):
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    n, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        groups = sorted(s for g, s in n if g == lang)

        def weights(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: weights(n[lang, s]) for s in groups}
        q = weights(sum((n[lang, s] for s in groups), Counter()))
        for s in groups:
            parts = {
                "pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s],
                "term": [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, chunks int, term string").repartition(3)
    out = m.audit(df, **kw)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["rank"] == "int"
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = ["the", "The,", "THE-the", "a", "b.", "naïve", "Ünïx", "字", "字。", "x y", "''", "42", "don't", "É", "é", "a\0b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    text = lambda: "".join(r.choice(words) + r.choice([" ", "\n", "\t ", " "]) for _ in range(r.randint(0, 30)))
    out = [(text(), r.choice(["en", "de", None]), r.choice(["hot"] * 6 + [f"s{i}" for i in range(7)] + [None, ""])) for _ in range(500)]
    out += [("copied words here", "en", "s1")] * 40 + [(None, "fr", "s1"), ("", "fr", "s2"), ("42 !!", "en", "silent"), (None, None, None), ("q " * 20_000 + "r" * 50_000, "en", "s2")]
    return out


@pytest.mark.parametrize(("block", "sources", "per_bucket"), [(m.BLOCK, m.SOURCES, m.TERMS), (300, 3, 7)])
def test_equals_brute_force(spark, rows, block, sources, per_bucket):
    assert run(spark, rows, least=5, top=4, block=block, sources=sources, terms=per_bucket) == brute(rows, 5, 4)


def test_nothing_kept_and_empty_table(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, "de", "z")]
    assert run(spark, rows) == brute(rows, 30, 50) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert m.audit(empty).count() == 0


def test_counts_beyond_64_bits(spark):
    got = spark.range(1).select(m._weight("9000000000000000000L", "9100000000000000000L", "3")).first()[0]
    assert got == 1 + 10**9 * (9 * 10**18 + 5) // (91 * 10**17 + 15)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(duck(sf), m.op13_source_divergence(spark, sf), m.SQL) is None
