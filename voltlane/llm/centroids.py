"""Operator 11: centroid clustering (Lloyd's rounds on integers), with lower bounds by Ptolemy's inequality.

For a vector x, a centroid c and two pivots p and s, Ptolemy's inequality gives

    d(x, c) * d(p, s) >= | d(x, p) * d(c, s) - d(x, s) * d(c, p) |.

Pivots are fixed: the centroids of the start. Distances of vectors to pivots are computed once and written beside the
vectors; every round adds the few distances of centroids to pivots. In a round a vector is measured exactly against
the centroid of its smallest bound, every centroid whose bound lies beyond that distance is put aside, and the others
are measured exactly. Bounds are doubles lowered by more than their rounding errors, and only a strictly larger bound
puts a centroid aside, so ties and results are those of exact arithmetic.

Vectors count if they have the wanted number of components, none of them null or non-finite; a component x becomes
floor(scale * x). Sums and distances are whole numbers of any size; a distance or inertia beyond 64 bits is returned as
the largest 64-bit number. The start takes the vectors with the smallest hashes of their ids (equal ids: the smaller
components first); repeated rows are vectors of their own. Rows without id never start a cluster. With fewer vectors
than centroids there are as many centroids as vectors; an empty table gives an empty result. Rounds after one that moves
no centroid would change nothing and are left out.

Each task sends one sum a cluster, in limbs of 30 bits, to Spark's aggregation; only the sums of all tasks, whose number
depends on centroids and components alone, reach the driver.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import Stages, col, fresh, register, table, with_fields

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: Up to here squared distances of 64 components fit 64 bits with room to spare.
_SMALL = 1 << 27
_LARGEST = (1 << 63) - 1
_LIMB = 30
#: Relative rounding error allowed for in a bound; a handful of operations in doubles make less than 2e-15.
_SLACK = 1e-12
_ROWS = 8_192


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit numbers, or Python's own where some are large."""
    if not values.size or np.abs(values).max() * scale < _SMALL:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else scale * int(v) + math.floor(scale * (v - int(v))) for v in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _fitting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centre."""
    a, b = _fitting(vectors, centre)
    d = a - b
    return np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(axis=1)


def roots(numbers: np.ndarray) -> np.ndarray:
    """Square roots as doubles; not a number where a double cannot hold it (bounds made of it put nothing aside)."""
    if numbers.dtype != object:
        return np.sqrt(numbers.astype(np.float64))
    return np.array([math.sqrt(n) if n < 10**300 else math.nan for n in numbers.tolist()], np.float64)


class Pivots(NamedTuple):
    points: np.ndarray
    pairs: list[tuple[int, int, float]]
    """Pivots i < j that differ, and their distance."""

    @classmethod
    def of(cls, points: np.ndarray) -> Pivots:
        pairs = []
        for i, j in itertools.combinations(range(len(points)), 2):
            d = float(roots(squared(points[i : i + 1], points[j]))[0])
            if d > 0:
                pairs.append((i, j, d))
        return cls(points, pairs)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([roots(squared(vectors, p)) for p in self.points], axis=1) if len(self.points) else np.zeros((len(vectors), 0))

    def lower_bounds(self, cached: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of vectors, known by their distances to pivots, to one centre."""
        own = self.distances(centre[None, :])[0]
        bound = np.zeros(len(cached))
        for i, j, apart in self.pairs:
            a, b = cached[:, i] * own[j], cached[:, j] * own[i]
            with np.errstate(invalid="ignore", over="ignore"):
                least = (np.abs(a - b) - _SLACK * (a + b)) / apart * (1 - _SLACK)
            np.fmax(bound, least, out=bound)
        return bound


class Assignment(NamedTuple):
    cluster: np.ndarray
    distance: np.ndarray
    """Squared, exact."""
    measured: int
    """Distances that were computed exactly."""


def nearest(vectors: np.ndarray, cached: np.ndarray, centres: np.ndarray, pivots: Pivots) -> Assignment:
    """The nearest centre of every vector, the one of smaller number among equals."""
    rows = np.arange(len(vectors))
    bounds = np.stack([pivots.lower_bounds(cached, c) for c in centres], axis=1)
    cluster = bounds.argmin(axis=1)
    wide = vectors.dtype == object or centres.dtype == object
    distance = np.zeros(len(vectors), dtype=object if wide else np.int64)
    for c in range(len(centres)):
        at = rows[cluster == c]
        distance[at] = squared(vectors[at], centres[c])
    limit = roots(distance) * (1 + _SLACK)
    measured = len(vectors)
    first = cluster.copy()
    for c in range(len(centres)):
        at = rows[(first != c) & ~(bounds[:, c] > limit)]
        if not len(at):
            continue
        measured += len(at)
        d = squared(vectors[at], centres[c])
        better = (d < distance[at]) | ((d == distance[at]) & (c < cluster[at]))
        at, d = at[better], d[better]
        cluster[at], distance[at] = c, d
        limit[at] = roots(d) * (1 + _SLACK)
    return Assignment(cluster, distance, measured)


def _doubles(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _limbs(number: int) -> list[int]:
    out = []
    while not -(1 << _LIMB) < number < 1 << _LIMB:
        out.append(number & ((1 << _LIMB) - 1))
        number >>= _LIMB
    return [*out, number]


class Clusters(NamedTuple):
    rows: DataFrame
    """The vectors' columns with cluster number and squared distance."""
    cluster: str
    distance: str
    centres: np.ndarray


class Space(NamedTuple):
    """What a task needs to know of the vectors."""

    embedding: str
    far: str
    """Column of the distances to the pivots."""
    width: int
    scale: int
    pivots: Pivots

    def numbers(self, batch: pa.RecordBatch) -> np.ndarray:
        return whole_numbers(_doubles(batch.column(self.embedding), self.width), self.scale)

    def measured(self, batches):
        for batch in _pieces(batches):
            far = self.pivots.distances(self.numbers(batch))
            offsets = np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, far.ravel())], names=[*batch.schema.names, self.far])

    def assigned(self, batches, centres: np.ndarray):
        for batch in _pieces(batches):
            vectors = self.numbers(batch)
            cached = _doubles(batch.column(self.far), len(self.pivots.points))
            yield batch, vectors, nearest(vectors, cached, centres, self.pivots)

    def sums(self, batches, centres: np.ndarray):
        """One row a cluster, component and limb: the sum over the task's vectors. The last component is their number."""
        total = [[0] * (self.width + 1) for _ in centres]
        for _, vectors, found in self.assigned(batches, centres):
            for c in np.unique(found.cluster).tolist():
                own = vectors[found.cluster == c]
                total[c] = [a + b for a, b in zip(total[c], [*own.sum(axis=0).tolist(), len(own)], strict=True)]
        rows = [
            (c, place, limb, value)
            for c, numbers in enumerate(total) if numbers[-1]
            for place, number in enumerate(numbers)
            for limb, value in enumerate(_limbs(number)) if value or not limb
        ]
        for columns in [list(zip(*rows, strict=True))] if rows else []:
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in columns[:3]), pa.array(columns[3], pa.int64())], names=["c", "place", "limb", "value"])


class Clustering:
    """Rounds over one written table of vectors and their distances to the pivots."""

    def __init__(self, df: DataFrame, vec_id: str, embedding: str, clusters: int = CLUSTERS, components: int = COMPONENTS, scale: int = SCALE, seed: str = "3:"):
        self.stages = Stages(df.sparkSession, "centroids")
        self.kept = df.columns
        far, self.cluster, self.distance = fresh(df.columns, "_far", "cluster", "distance")
        vector = F.transform(col(embedding), lambda x: x.cast("double"))
        usable = (F.size(vector) == components) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        good = df.where(F.coalesce(usable, F.lit(False)))
        digest = F.sha2(F.concat(F.lit(seed), col(vec_id).cast("string")), 256)
        chosen = good.where(col(vec_id).isNotNull()).select(digest.alias("h"), vector.alias("v")).orderBy("h", "v").limit(clusters).collect()
        self.start = whole_numbers(np.array([r.v for r in chosen], np.float64).reshape(-1, components), scale)
        self.space = space = Space(embedding, far, components, scale, Pivots.of(self.start))
        self.table = self.stages(good.mapInArrow(lambda batches: space.measured(batches), with_fields(good, good.columns, **{far: "array<double>"})), "vectors")

    def move(self, centres: np.ndarray) -> np.ndarray:
        """The floor of the mean of every centre's vectors; a centre without vectors stays."""
        space = self.space
        parts = self.table.select(col(space.embedding), col(space.far)).mapInArrow(lambda batches: space.sums(batches, centres), "c int, place int, limb int, value bigint")
        numbers: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("c", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            numbers[r.c, r.place] = numbers.get((r.c, r.place), 0) + (int(r.value) << (_LIMB * r.limb))
        moved = [
            [numbers[c, p] // numbers[c, space.width] for p in range(space.width)] if (c, space.width) in numbers else centre
            for c, centre in enumerate(centres.tolist())
        ]
        large = any(abs(x) >= _SMALL for row in moved for x in row)
        return np.array(moved, dtype=object if large else np.int64)

    def run(self, rounds: int = ROUNDS) -> Clusters:
        centres = self.start
        for _ in range(rounds if len(centres) else 0):
            moved = self.move(centres)
            if (moved == centres).all():
                break
            centres = moved

        space, kept, names = self.space, self.kept, [*self.kept, self.cluster, self.distance]

        def assign(batches):
            for batch, _, found in space.assigned(batches, centres):
                capped = found.distance if found.distance.dtype != object else np.minimum(found.distance, _LARGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found.cluster.astype(np.int32)), pa.array(capped)], names=names)

        schema = with_fields(self.table, kept, **{self.cluster: "int", self.distance: "bigint"})
        rows = self.table.mapInArrow(assign, schema) if len(centres) else self.table.sparkSession.createDataFrame([], schema)
        return Clusters(self.stages(rows, "assigned"), self.cluster, self.distance, centres)


def _pieces(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            yield batch.slice(first, _ROWS)


def with_inertia(found: Clusters) -> tuple[DataFrame, list[str]]:
    """Rows with the inertia of their cluster, of all clusters, and the digest of the final centroid, and those columns' names."""
    names = fresh(found.rows.columns, "cluster_inertia", "inertia", "centroid_sha256")
    spark = found.rows.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(found.centres.tolist())]
    own = F.sum(col(found.distance).cast("decimal(38,0)"))
    sums = {r.c: int(r.s) for r in found.rows.groupBy(col(found.cluster).alias("c")).agg(own.alias("s")).collect()}
    total = min(sum(sums.values()), _LARGEST)
    facts = [(c, min(sums.get(c, 0), _LARGEST), total, digest) for c, digest in digests]
    kinds = f"`{found.cluster}` int, {names[0]} bigint, {names[1]} bigint, {names[2]} string"
    # one row a centroid
    return found.rows.join(F.broadcast(spark.createDataFrame(facts, kinds)), found.cluster), names


def oracle(rounds: int = ROUNDS) -> str:
    """The rounds as DuckDB SQL over `embeddings`."""
    usable = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    parts = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings where {usable})",
        "c0 as materialized (select row_number() over (order by h, x) - 1 as c, x from (select sha256('3:' || vec_id) as h, x from v where vec_id is not null order by h, x limit 8))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"n{i} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from (select v.r, c.c, "
            f"list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{i} c) group by r)"
        )
        if i < rounds:
            parts.append(
                f"m{i} as materialized (select c, i, cast(floor_div as bigint) as x from (select c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as floor_div "
                f"from (select n.c, unnest(range(1, 65)) as i, unnest(v.x) as x from v join n{i} n using (r)) group by c, i))"
            )
            parts.append(
                f"c{i + 1} as materialized (select c.c, coalesce(m.x, c.x) as x from c{i} c left join (select c, list(x order by i) as x from m{i} group by c) m using (c))"
            )
    return (
        "with " + ",\n".join(parts) + f"\nselect v.vec_id, cast(n.c as int) as cluster, cast(n.d as bigint) as distance, cast(sum(n.d) over (partition by n.c) as bigint) as cluster_inertia, "
        f"cast(sum(n.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from n{rounds} n join v using (r) join c{rounds} c on c.c = n.c"
    )


@register("op11_centroid_clusters", oracle())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = Clustering(vectors, "vec_id", "embedding").run()
    rows, names = with_inertia(found)
    return rows.select("vec_id", found.cluster, found.distance, *names)
