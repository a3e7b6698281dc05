import numpy as np

import voltlane.llm.embedding_dedup as m


def brute(rows, threshold=m.THRESHOLD):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (m.units(np.array([rows[k][1]], dtype=np.float64))[0] for k in (a, b))
                if x @ y >= threshold:
                    links[a] += 1
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, links[k], low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def result(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_against_brute_force_with_copies_and_chains(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = [(c + rng.normal(size=16) * s).tolist() for c in centres for s in (0.1, 0.2, 0.3, 0.4)] + [centres[0].tolist()] * 60 + rng.normal(size=(120, 16)).tolist()
    order = rng.permutation(len(vectors))
    rows = [(int(i) * 3, vectors[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert result(m.near_duplicates(df)) == brute(rows)


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]),
        (9, [0.0, 1e-300]), (10, [1e-4, 1e300]), (11, [1.0, 1.0, 1.0]), (12, [1.0, -0.0]), (13, [float("inf"), 1.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component_id string")
    assert result(m.near_duplicates(df)) == brute(rows)
    assert m.near_duplicates(df.limit(0)).count() == 0
    assert result(m.near_duplicates(df.where("vec_id < 3"))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_finds_all_links_of_tight_groups():
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(1, 32)) + rng.normal(size=(300, 32)) * 0.02
    unit = m.units(np.concatenate([rng.normal(size=(1500, 32)), tight])[rng.permutation(1800)])
    graph = m.Graph.build(unit.astype(np.float32))
    beam = m.audited_beam(graph, unit, 0.9)
    q, at = graph.linked(unit.astype(np.float32), 0.9, beam)
    want = (unit @ unit.T) >= 0.9
    got = np.zeros_like(want)
    got[q, at] = True
    assert (want & got).sum() >= 0.999 * want.sum()


def test_forest_keeps_what_links_join():
    a, b = np.array([5, 7, 9, 20]), np.array([7, 9, 5, 21])
    assert sorted(zip(*m.forest(a, b), strict=True)) == [(7, 5), (9, 5), (21, 20)]
