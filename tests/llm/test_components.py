import random

from voltlane.llm.common import Stages
from voltlane.llm.components import connected_components


def test_path_star_and_random(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    edges += [(None, 3), (4, None), (7, 7), (160, 100)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "test")).collect()}
    assert got == {n: find(n) for n in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Stages(spark, "test")).count() == 0
