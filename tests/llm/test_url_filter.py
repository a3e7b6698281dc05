import os
import random
import re

import pytest

import voltlane.llm.url_filter as m
from tests.compare import compare, duck
from voltlane.llm.common import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("rows", [50_000, 7])
def test_matches_sql(spark, monkeypatch, rows):
    monkeypatch.setattr(m, "RANGE_ROWS", rows)
    assert compare(duck(SF), m.op4_url_filter(spark, SF), SQL["op4_url_filter"]) is None


def brute(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.match(r"[^/?#]*", rest).end()
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = re.match(r"[^?#]*", rest[cut:]).group()
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("ranges", [1, 20])
def test_against_brute_force(spark, ranges):
    r = random.Random(2)
    name = lambda least, most: ".".join(r.choice(["a", "b", "ab", "example", "org", "com"]) for _ in range(r.randint(least, most)))
    rules = list({(name(1, 3), r.choice(["/", "/en", "/1", "/en/1", ""]), r.choice(["allow", "block"])) for _ in range(40)})
    path = lambda: "".join(r.choice(["/", "/en", "/1", "x"]) for _ in range(r.randint(0, 4)))
    rows = [(i, r.choice(["http://", "", "://"]) + name(0, 4).title() + path() + r.choice(["", "?q=/", "#://z"]), "H") for i in range(400)]
    rows += [(1000 + i, "http://hot.org/x", "H") for i in range(200)] + [(2000, None, None), (2001, "", ""), (2002, "http://" + "a." * 3000 + "org/en", ""), (5, "http://a/", "H")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    out, names = m.filter_urls(df, given, ranges=ranges)
    assert names["host"] == "host_" and out.columns[:3] == df.columns
    got = sorted(((x.page_id, x[names["host"]], x.path, x.rule, x.verdict) for x in out.collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u, _ in rows), key=str)


def test_empty_tables_and_root_rule(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("", "", "block")], "host string, path string, verdict string")
    assert m.filter_urls(df.limit(0), rules)[0].count() == 0
    assert [r.verdict for r in m.filter_urls(df, rules.limit(0))[0].collect()] == ["allow", "allow"]
    assert [r.verdict for r in m.filter_urls(df, rules)[0].collect()] == ["block", "block"]
