import hashlib
import math

import numpy as np
import pytest

from tests.compare import compare, duck
from voltlane.llm import centroids as m


def brute(rows, clusters=8, width=64, rounds=10):
    """Every row's cluster and squared distance, and the final centroids, in Python's whole numbers."""
    kept = [(k, tuple(math.floor(1024 * float(x)) if abs(x) < 2**40 else 1024 * int(x) for x in v)) for k, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)
    centres = [v for _, v in order[:clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for last in [False] * rounds + [True]:
        found = [min((gap(v, c), i) for i, c in enumerate(centres)) for _, v in kept]
        if not last:
            for i in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == i]
                if own:
                    centres[i] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    return sorted(((k, i, min(d, 2**63 - 1)) for (k, _), (d, i) in zip(kept, found, strict=True)), key=str), centres


def run(spark, rows, kind="double", width=64):
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], f"vec_id long, embedding array<{kind}>, cluster string")
    found = m.Clustering(df, "vec_id", "embedding", components=width).run()
    out, names = m.with_inertia(found)
    assert found.cluster == "cluster_" and out.columns.count("cluster") == 1
    return out, names, found


def test_nulls_ties_repeats_and_other_lengths(spark):
    r = np.random.default_rng(5)
    near = [(i, (np.eye(4)[i % 4] * 3 + r.normal(0, 0.3, 4)).tolist()) for i in range(300)]
    ties = [(1000 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(60)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0]), (2003, [math.nan] * 4), (2004, [math.inf] * 4), (2005, [1.0] * 5), (None, [1.0, 2.0, 3.0, 4.0])]
    rows = near + ties + odd + [(5, near[5][1])] * 3 + [(5, [9.0, 9.0, 9.0, 9.0])]
    out, names, found = run(spark, rows, width=4)
    want, centres = brute(rows, width=4)
    got = out.collect()
    assert sorted(((x.vec_id, x.cluster_, x.distance) for x in got), key=str) == want
    for x in got:
        assert x[names[0]] == sum(d for _, c, d in want if c == x.cluster_) and x[names[1]] == sum(d for *_, d in want)
        assert x[names[2]] == hashlib.sha256(",".join(map(str, centres[x.cluster_])).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i), 1.0]) for i in range(n)]
    out, *_ = run(spark, rows, width=2)
    assert sorted((x.vec_id, x.cluster_, x.distance) for x in out.collect()) == brute(rows, width=2)[0]


def test_numbers_beyond_64_bits(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(0, 1, 3) * 10.0 ** r.integers(-2, 38)).tolist()) for i in range(80)]
    out, *_ = run(spark, rows, width=3)
    assert sorted((x.vec_id, x.cluster_, x.distance) for x in out.collect()) == sorted(brute(rows, width=3)[0])


def test_bounds_hold_and_put_centres_aside():
    r = np.random.default_rng(3)
    middle = r.normal(0, 1, (8, 64))
    vectors = m.whole_numbers(np.repeat(middle, 200, axis=0) + r.normal(0, 0.05, (1600, 64)), 1024)
    pivots = m.Pivots.of(m.whole_numbers(middle, 1024))
    cached = pivots.distances(vectors)
    centres = m.whole_numbers(middle + r.normal(0, 0.01, (8, 64)), 1024)
    exact = np.stack([m.squared(vectors, c) for c in centres], axis=1)
    for c in range(8):
        assert (pivots.lower_bounds(cached, centres[c]) <= np.sqrt(exact[:, c])).all()
    found = m.nearest(vectors, cached, centres, pivots)
    assert (found.cluster == exact.argmin(axis=1)).all() and (found.distance == exact.min(axis=1)).all()
    assert found.measured < 1.2 * len(vectors)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(duck(sf), m.op11_centroid_clusters(spark, sf), m.oracle()) is None
