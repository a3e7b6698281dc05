"""Operator 3: near-duplicate vectors by navigable small-world graphs, one per shard, audited and verified.

Equal vectors are taken together first: one of them stands for all and carries their number, so a vector copied any
number of times is searched once and links its copies by counting. The distinct vectors are dealt over shards by a
hash; each shard is a hierarchical graph built by one task and written to the shared folder. Queries are dealt in
blocks over all shards, so no task sees all queries of a shard. A query's beam is widened until its worst kept vector
lies below the threshold by a margin, so no linked vector lies beyond the beam's edge; a shard is audited by comparing
some queries with all its vectors, and its beams are widened for all queries until the audit finds nothing missing.
What the graphs propose is verified by cosines in double precision.

A task returns the number of links of each query and a forest of its links, at most one edge a vector, which joins what
the links join. Forests are united by contraction.

Vectors that are null, zero, or hold null or non-finite components link with nothing and stay alone. Vectors of
different lengths never link. Rows that repeat an id are rows of their own with that id. An empty table gives an empty table. Extra columns are dropped.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import Stages, col, register, table
from voltlane.llm.components import connected_components
from voltlane.llm.ngram_model import load, save

THRESHOLD = 0.9
#: At least so many shards, for parallel work, and at most so many vectors in one, for memory.
LEAST_SHARDS, SHARD_VECTORS = 8, 500_000
#: Neighbours kept in upper layers (twice as many in the lowest), first beam, queries searched at once, queries of a task.
DEGREE, BEAM, BATCH, BLOCK = 16, 32, 256, 2_000
#: Entries that upper layers give to the layer below, at least.
ENTRIES = 16
#: Share of the shard's own vectors that audit it, between these numbers, and the recall asked of them.
AUDIT_SHARE, AUDIT_LEAST, AUDIT_MOST, RECALL = 0.02, 64, 1_000, 1.0
#: A beam is wide enough when its worst vector lies so far below the threshold.
MARGIN = 0.02
#: A vector is verified where single precision gives at least the threshold less this.
SLACK = 1e-4


class Graph:
    """Hierarchical navigable small world over unit vectors: neighbour table of each layer, nodes in random order."""

    def __init__(self, unit: np.ndarray, neighbours: list[np.ndarray]):
        self.unit, self.neighbours = unit, neighbours

    @staticmethod
    def build(unit: np.ndarray, degree: int = DEGREE, beam: int = 2 * DEGREE) -> Graph:
        """Layers are prefixes of a fixed random order, each `degree` times smaller than the one below.

        A layer grows by batches of at most its own size: each batch is searched in the layer so far and compared with
        itself; every new node links to its nearest ones that are nearer to it than to each other, and they back.
        """
        sizes = [len(unit)]
        while sizes[-1] > 4 * degree:
            sizes.append(sizes[-1] // degree)
        graph = Graph(unit, [])
        for layer, size in reversed(list(enumerate(sizes))):
            width = 2 * degree if layer == 0 else degree
            table_ = np.full((size, width), -1, dtype=np.int32)
            graph.neighbours.append(table_)
            done = 0
            while done < size:
                step = min(max(done, 4 * degree), 1_000, size - done)
                new = np.arange(done, done + step)
                near = graph._candidates(new, done, max(beam, width))
                for node, (ids, cosines) in zip(new, near, strict=True):
                    table_[node] = _spread(unit, node, ids, cosines, width)
                _link_back(unit, table_, new, width)
                done += step
        return graph

    def _candidates(self, new: np.ndarray, done: int, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [np.zeros((len(new), 0), np.int64)]
        scores = [np.zeros((len(new), 0), np.float32)]
        if done:
            ids, cosines = self.search(self.unit[new], beam, upto=done)
            found.append(ids)
            scores.append(cosines)
        own = self.unit[new] @ self.unit[new].T
        np.fill_diagonal(own, -2)
        k = min(beam, len(new) - 1)
        if k:
            order = np.argpartition(-own, k - 1, axis=1)[:, :k]
            found.append(new[order])
            scores.append(np.take_along_axis(own, order, axis=1))
        ids, cosines = np.concatenate(found, axis=1), np.concatenate(scores, axis=1)
        order = np.argsort(-cosines, axis=1, kind="stable")
        return list(zip(np.take_along_axis(ids, order, axis=1), np.take_along_axis(cosines, order, axis=1), strict=True))

    def search(self, queries: np.ndarray, beam: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the `beam` best met for each query, best first; unused places have id -1 and cosine -2."""
        upto = len(self.unit) if upto is None else upto
        # The top layer is compared whole; the best of each layer are the entries of the next.
        top = min(upto, len(self.neighbours[0]))
        k = min(beam, top)
        entry = np.argpartition(-(queries @ self.unit[:top].T), k - 1, axis=1)[:, :k]
        for layer in self.neighbours[1:-1]:
            entry = self._descend(queries, layer, entry, min(upto, len(layer)))
        return self._beam(queries, self.neighbours[-1], entry, beam, upto)

    def _descend(self, queries, layer, entry, upto):
        ids, _ = self._beam(queries, layer, entry, max(ENTRIES, entry.shape[1]), upto)
        return np.where(ids >= 0, ids, ids[:, :1])

    def _beam(self, queries, layer, entry, beam, upto):
        n, width = len(queries), layer.shape[1]
        ids = np.full((n, beam), -1, dtype=np.int64)
        cosines = np.full((n, beam), -2, dtype=np.float32)
        opened = np.ones((n, beam), dtype=bool)
        seen = np.zeros((n, upto), dtype=bool)
        k = min(beam, entry.shape[1])
        first = entry[:, :k]
        order = np.argsort(first, axis=1, kind="stable")
        first = np.take_along_axis(first, order, axis=1)
        repeats = np.zeros((n, k), dtype=bool)
        repeats[:, 1:] = first[:, 1:] == first[:, :-1]
        value = np.einsum("qkd,qd->qk", self.unit[first], queries)
        value[repeats] = -2
        ids[:, :k], cosines[:, :k], opened[:, :k] = np.where(repeats, -1, first), value, repeats
        seen[np.arange(n)[:, None], first] = True
        active = np.arange(n)
        while len(active):
            # Open the best few unopened nodes of every beam at once.
            score = np.where(opened[active], -3.0, cosines[active])
            take = min(4, beam)
            best = np.argpartition(-score, take - 1, axis=1)[:, :take]
            good = np.take_along_axis(score, best, axis=1) > -2
            alive = good.any(axis=1)
            active, best, good = active[alive], best[alive], good[alive]
            if not len(active):
                break
            rows = np.arange(len(active))[:, None]
            opened[active[:, None], best] |= good
            nodes = np.where(good, ids[active[:, None], best], 0)
            near = layer[nodes].reshape(len(active), take * width).astype(np.int64)
            valid = (near >= 0) & (near < upto) & np.repeat(good, width, axis=1)
            near = np.where(valid, near, 0)
            valid &= ~seen[active[:, None], near]
            order = np.argsort(np.where(valid, near, -1), axis=1, kind="stable")  # a node met twice in one step counts once
            near, valid = near[rows, order], valid[rows, order]
            valid[:, 1:] &= ~(valid[:, :-1] & (near[:, 1:] == near[:, :-1]))
            r, c = np.nonzero(valid)
            seen[active[r], near[r, c]] = True
            value = np.full(near.shape, -2, dtype=np.float32)
            value[r, c] = np.einsum("ij,ij->i", self.unit[near[r, c]], queries[active[r]])
            all_ids = np.concatenate([ids[active], np.where(valid, near, -1)], axis=1)
            all_cos = np.concatenate([cosines[active], value], axis=1)
            all_open = np.concatenate([opened[active], ~valid], axis=1)
            keep = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            ids[active], cosines[active], opened[active] = all_ids[rows, keep], all_cos[rows, keep], all_open[rows, keep]
        order = np.argsort(-cosines, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(cosines, order, axis=1)

    def linked(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, id) of all vectors met with a cosine of the threshold or more, less SLACK; beams widen as they fill."""
        todo, out = np.arange(len(queries)), []
        while len(todo):
            beam = min(beam, len(self.unit))
            wider = []
            step = max(1, min(BATCH, 40_000_000 // max(len(self.unit), beam * 16)))
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                ids, cosines = self.search(queries[part], beam)
                full = (cosines[:, -1] >= threshold - MARGIN) & (beam < len(self.unit))
                wider.append(part[full])
                r, c = np.nonzero((cosines >= threshold - SLACK) & ~full[:, None])
                out.append((part[r], ids[r, c]))
            todo, beam = np.concatenate(wider), beam * 4
        return (np.concatenate([q for q, _ in out]), np.concatenate([i for _, i in out])) if out else (np.zeros(0, np.int64),) * 2


def _spread(unit: np.ndarray, node: int, ids: np.ndarray, cosines: np.ndarray, width: int) -> np.ndarray:
    """Up to `width` of the candidates, best first, that are nearer to the node than to one already taken; then the best of the rest."""
    usable = (ids >= 0) & (ids != node) & (cosines > -2)
    ids, cosines = ids[usable], cosines[usable]
    between = unit[ids] @ unit[ids].T
    taken, rest = [], []
    for j in range(len(ids)):
        if len(taken) == width:
            break
        (rest if taken and between[j, taken].max() > cosines[j] else taken).append(j)
    taken = (taken + rest)[:width]
    out = np.full(width, -1, dtype=np.int32)
    out[: len(taken)] = ids[taken]
    return out


def _link_back(unit: np.ndarray, layer: np.ndarray, new: np.ndarray, width: int) -> None:
    sources = np.repeat(new, width)
    targets = layer[new].ravel()
    sources, targets = sources[targets >= 0], targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    cuts = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1], [True]])) if len(targets) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        node = targets[a]
        have = layer[node][layer[node] >= 0]
        ids = np.unique(np.concatenate([have, sources[a:b]]))
        if len(ids) <= width:
            layer[node] = -1
            layer[node, : len(ids)] = ids
        else:
            cosines = unit[ids] @ unit[node]
            best = np.argsort(-cosines, kind="stable")
            layer[node] = _spread(unit, node, ids[best], cosines[best], width)


def as_matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension).astype(np.float64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest part first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@functools.lru_cache(maxsize=2)
def shard_graph(folder: str, shard: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, int]:
    meta = load(folder, f"meta-{shard}")
    layers = [load(folder, f"layer-{shard}-{i}").reshape(-1, meta[1 + i]) for i in range(len(meta) - 1)]
    exact = load(folder, f"unit-{shard}")
    exact = exact.reshape(len(load(folder, f"id-{shard}")), -1)
    return Graph(exact.astype(np.float32), layers), exact, load(folder, f"id-{shard}")[:], load(folder, f"copies-{shard}")[:], int(meta[0])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, stages: Stages | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    stages = stages or Stages(spark, "vectors")
    v = col("v")
    rows = df.select(col(key).alias("id"), col(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(
        (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False),
    )
    rows = stages(rows.withColumn("v", F.when(usable, F.transform(v, lambda x: x + F.lit(0.0)))), "rows")  # -0.0 becomes 0.0
    classes = stages(
        rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("dimension", F.size("v")), "classes",
    )
    sizes = {r.dimension: r.n for r in classes.groupBy("dimension").agg(F.count("*").alias("n")).collect()}  # a row for each length
    found = None
    for dimension, n in sorted(sizes.items()):
        part = _links_of_length(classes.where(col("dimension") == dimension).select("id", "copies", "v"), dimension, n, threshold, stages)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.where("b is null").groupBy(col("a").alias("class")).agg(F.sum("n").alias("near"))
    components = connected_components(found.where("b is not null").select("a", "b"), stages)
    facts = classes.select("v", col("id").alias("class"), "copies").join(links, "class", "left").join(components.withColumnRenamed("node", "class"), "class", "left")
    facts = facts.select("v", (F.coalesce("near", F.lit(0)) + col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    linked = rows.where("v is not null").join(facts, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("bigint").alias("n_links"), col("id").alias("component_id"))
    return linked.unionByName(alone).select(col("id").alias(key), "n_links", "component_id", (col("id") == col("component_id")).alias("kept"))


def _links_of_length(classes: DataFrame, dimension: int, n: int, threshold: float, stages: Stages) -> DataFrame:
    """Written rows (a, b, n): with b null, n other rows linked to a's class in one shard; else an edge of a forest of links."""
    shards = max(LEAST_SHARDS, -(-n // SHARD_VECTORS))
    folder = stages.folder(f"graphs-{dimension}")
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int"))

    def build(batches):
        def write(shard, ids, copies, vectors):
            # The order of a seeded shuffle decides the layers; sorted first, so that a repeated task builds the same graph.
            order = np.argsort(ids, kind="stable")[np.random.default_rng(shard).permutation(len(ids))]
            exact = units(vectors[order])
            graph = Graph.build(exact.astype(np.float32))
            beam = audited_beam(graph, exact, threshold)
            save(folder, f"id-{shard}", ids[order])
            save(folder, f"copies-{shard}", copies[order])
            save(folder, f"unit-{shard}", exact.ravel())
            for i, layer in enumerate(graph.neighbours):
                save(folder, f"layer-{shard}-{i}", layer.ravel())
            save(folder, f"meta-{shard}", np.array([beam, *(layer.shape[1] for layer in graph.neighbours)]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([beam], pa.int64())], names=["shard", "beam"])

        now, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if numbers[a] != now and held:
                    yield write(int(now), *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                now = numbers[a]
                rows = batch.slice(a, b - a)
                held.append((rows.column(1).to_numpy(), rows.column(2).to_numpy(), as_matrix(rows.column(3), dimension)))
        if held:
            yield write(int(now), *map(np.concatenate, zip(*held, strict=True)))

    built = dealt.select("shard", "id", "copies", "v").repartitionById(shards, col("shard")).sortWithinPartitions("shard").mapInArrow(build, "shard int, beam bigint")
    present = sorted(r.shard for r in stages(built, "built").select("shard").collect())  # a row for each shard
    blocks = max(1, -(-n // BLOCK))
    queries = classes.withColumn("block", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(blocks)))
    # Every query goes to every shard once, in blocks: shards are few and sized by memory.
    pairs = queries.withColumn("shard", F.explode(F.array(*[F.lit(p) for p in present])))
    pairs = pairs.repartition(max(shards, min(blocks, 4) * shards), "shard", "block").sortWithinPartitions("shard", "block")

    def search(batches):
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield from links_in_shard(folder, int(numbers[a]), part.column("id").to_numpy(), as_matrix(part.column("v"), dimension), threshold)

    return stages(pairs.select("shard", "block", "id", "v").mapInArrow(search, "a bigint, b bigint, n bigint"), "found")


def links_in_shard(folder: str, shard: int, ids: np.ndarray, vectors: np.ndarray, threshold: float):
    graph, exact, own, copies, beam = shard_graph(folder, shard)
    unit = units(vectors)
    q, at = graph.linked(unit.astype(np.float32), threshold, beam)
    cosines = np.einsum("ij,ij->i", unit[q], exact[at])
    good = (cosines >= threshold) & (ids[q] != own[at])
    q, at = q[good], at[good]
    counts = np.bincount(q, weights=copies[at].astype(np.float64), minlength=len(ids)).astype(np.int64)
    some = np.flatnonzero(counts)
    a, b = forest(ids[q], own[at])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids[some], a]), pa.int64()), pa.array([None] * len(some) + b.tolist(), pa.int64()), pa.array(counts[some].tolist() + [None] * len(a), pa.int64())],
        names=["a", "b", "n"],
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the given edges join, one fewer than the nodes of each component: each node to its smallest."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def audited_beam(graph: Graph, exact: np.ndarray, threshold: float) -> int:
    """The beam from which the shard's own audit vectors find all that a comparison with every vector finds."""
    n = len(exact)
    size = min(n, max(AUDIT_LEAST, min(AUDIT_MOST, int(n * AUDIT_SHARE))))
    sample = np.unique(np.linspace(0, n - 1, size).astype(np.int64))
    cosines = exact[sample] @ exact.T
    wanted = int((cosines >= threshold).sum())
    beam = BEAM
    while beam < n:
        q, at = graph.linked(exact[sample].astype(np.float32), threshold, beam)
        got = int((cosines[q, at] >= threshold).sum())
        if got >= RECALL * wanted:
            break
        beam *= 2
    return min(beam, n)


@register("op3_embedding_dedup")
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
