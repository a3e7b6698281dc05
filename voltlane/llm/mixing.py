"""Operator 2: mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of `block` documents. Its j-th block is released at slot floor(j / w) and due at slot
ceil((j + 1) / w), w being the share of the source among the sources that still have blocks. In each slot the released
block with the earliest deadline is taken, so every source is always less than one block away from its target.

Targets are whole shares. The schedule of sources with shares a, b, ... repeats after a + b + ... slots, so one round is
planned per phase and any block's slot follows by arithmetic. A phase ends when a source has no blocks left; the others
go on, with their shares as before, from a fresh round. Only targets and one count per target source reach the driver:
both are bounded by the table of targets, as sources without a target, and null, form one stream of their own.

No document is dropped or repeated. The order inside a source is that of a seeded hash, ties by id and then by all
other columns. Repeated rows keep their number. An empty table gives an empty table. Extra columns pass through.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.llm.common import Stages, col, fresh, register, table

#: Production targets: shares out of 100. `None` is the stream of all other sources.
TARGETS: dict[str | None, int] = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, None: 4}
BLOCK = 64
SEED = 17
#: Rows of one numbering task, about.
NUMBERED_ROWS = 2_000
#: Largest number of streams and of slots in a round; beyond it the targets are refused.
MOST_STREAMS, MOST_SLOTS = 1_000, 10_000


def one_round(shares: Mapping[int, int]) -> list[int]:
    """Streams in the order of one round of earliest-deadline-first over release times and deadlines."""
    total = sum(shares.values())
    waiting = [(0, s, 0) for s in sorted(shares)]  # release, stream, block
    ready: list[tuple[int, int, int]] = []  # deadline, stream, block
    heapq.heapify(waiting)
    order = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[s]), s, j))
        _, s, j = heapq.heappop(ready)
        order.append(s)
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * total // shares[s], s, j + 1))
    return order


def plan_phases(shares: Mapping[int, int], blocks: Mapping[int, int]) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """Rows (stream, first block, past last block, first slot, slots a round, share, slots of the stream in a round)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, slot, out = dict.fromkeys(left, 0), 0, []
    while left:
        order = one_round({s: shares[s] for s in left})
        at: dict[int, list[int]] = {s: [] for s in left}
        for i, s in enumerate(order):
            at[s].append(i)
        last = {s: (n - 1) // shares[s] * len(order) + at[s][(n - 1) % shares[s]] for s, n in left.items()}
        length = min(last.values()) + 1
        rounds, rest = divmod(length, len(order))
        for s in sorted(left):
            taken = rounds * shares[s] + sum(i < rest for i in at[s])
            if taken:
                out.append((s, done[s], done[s] + taken, slot, len(order), shares[s], at[s]))
            done[s] += taken
            left[s] -= taken
        left = {s: n for s, n in left.items() if n}
        slot += length
    return out


def mix_sources(
    df: DataFrame, targets: Mapping[str | None, int] = TARGETS, block: int = BLOCK, seed: int = SEED, key: str = "doc_id", source: str = "source",
    stages: Stages | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """`df` with stream, block, release, deadline, slot and position (dense, from 0) of every row, and those columns' names."""
    if len(targets) > MOST_STREAMS or sum(targets.values()) > MOST_SLOTS or any(v < 1 for v in targets.values()):
        raise ValueError(f"targets are whole shares from 1, at most {MOST_STREAMS} of them and {MOST_SLOTS} in sum")
    spark = df.sparkSession
    stages = stages or Stages(spark, "mixing")
    names = ("stream", "block", "release", "deadline", "slot", "position")
    result = dict(zip(names, fresh(df.columns, *names), strict=True))
    hashed, bucket, before, number, rows_of, at = fresh([*df.columns, *result.values()], "_hash", "_bucket", "_before", "_number", "_rows", "_slots")
    named = [s for s in targets if s is not None]
    ids = {s: i for i, s in enumerate(named)} | {None: len(named)}
    shares = {ids[s]: n for s, n in targets.items()} | ({ids[None]: 1} if None not in targets else {})

    stream = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s in named for x in (s, ids[s])]), col(source)), F.lit(ids[None])) if named else F.lit(0)
    tagged = df.withColumn(result["stream"], stream).withColumn(hashed, F.xxhash64(col(key), F.lit(seed)))
    totals = {r[0]: r[1] for r in tagged.groupBy(result["stream"]).count().collect()}
    blocks = {s: -(-n // block) for s, n in totals.items()}
    phases = plan_phases({s: shares[s] for s in blocks}, blocks)

    # Number the rows of a stream: hash ranges of about NUMBERED_ROWS rows each, counted first, then ordered inside.
    ranges = {s: max(1, n // NUMBERED_ROWS) for s, n in totals.items()}
    width = F.element_at(F.create_map(*[F.lit(x) for s in sorted(ranges) for x in (s, ranges[s])]), col(result["stream"])) if ranges else F.lit(1)
    # Monotone in the hash: the top 31 bits scaled to the number of ranges.
    spread = (F.shiftrightunsigned(col(hashed).bitwiseXOR(F.lit(-(1 << 63))), 33) * width).cast("bigint")
    tagged = tagged.withColumn(bucket, F.shiftright(spread, 31))
    earlier = Window.partitionBy(result["stream"]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(result["stream"], bucket).count()
    offsets = counts.select(result["stream"], bucket, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(result["stream"], bucket).orderBy(hashed, col(key), *[col(c) for c in df.columns if c != key])
    numbered = tagged.withColumn(number, F.row_number().over(inside) - 1).join(offsets, [result["stream"], bucket])
    numbered = numbered.withColumn(number, col(number) + col(before))

    # One row per stream with its phases: at most MOST_STREAMS rows, a round of at most MOST_SLOTS slots in each phase.
    per_stream: dict[int, list] = {s: [] for s in totals}
    for s, first, past, slot, period, share, slots in phases:
        per_stream[s].append((first, past, slot, period, share, slots))
    plan = spark.createDataFrame(
        [(s, p) for s, p in sorted(per_stream.items())],
        f"{result['stream']} int, {at} array<struct<first:bigint,past:bigint,slot:bigint,period:bigint,share:bigint,slots:array<bigint>>>",
    )
    b = F.floor(col(number) / block)
    placed = numbered.withColumn(result["block"], b).join(F.broadcast(plan), result["stream"])
    here = F.filter(col(at), lambda p: (p["first"] <= col(result["block"])) & (col(result["block"]) < p["past"]))[0]
    placed = placed.withColumn(at, here)
    p, own = col(at), col(result["block"]) - col(at)["first"]
    placed = placed.withColumns({
        result["release"]: p["slot"] + F.floor(own * p["period"] / p["share"]),
        result["deadline"]: p["slot"] + F.ceil((own + 1) * p["period"] / p["share"]),
        result["slot"]: p["slot"] + F.floor(own / p["share"]) * p["period"] + F.get(p["slots"], own % p["share"]),
    })
    # All blocks are full but the last of each stream, so a position is slot times block less what those lack before it.
    short = sorted((_slot_of(phases, s, blocks[s] - 1), blocks[s] * block - n) for s, n in totals.items() if n % block)
    lack = F.lit(0)
    for slot, missing in short:
        lack = lack + F.when(col(result["slot"]) > slot, missing).otherwise(0)
    placed = placed.withColumn(result["position"], col(result["slot"]) * block - lack + col(number) % block)
    return placed.select(*[col(c) for c in df.columns], *[col(result[n]).cast("bigint").alias(result[n]) for n in names]), result


def _slot_of(phases: list, stream: int, block: int) -> int:
    for s, first, past, slot, period, share, slots in phases:
        if s == stream and first <= block < past:
            own = block - first
            return slot + own // share * period + slots[own % share]
    raise AssertionError("every block is planned")


def in_mixed_order(df: DataFrame, **options) -> DataFrame:
    """The rows of `df`, with its columns only, laid out over partitions in their order of training."""
    placed, names = mix_sources(df, **options)
    return placed.repartitionByRange(col(names["position"])).sortWithinPartitions(col(names["position"])).select(*[col(c) for c in df.columns])


def with_written_position(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with the position (dense, from 0) of every row in the written files, taken by their numbers, and that column's name.

    A frame that is more than a plain read of files is written first. One count per file reaches the driver.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = Stages(df.sparkSession, "mixing")(df, "order")
    position, file, before = fresh(df.columns, "position", "_file", "_before")
    counts = {r[0]: r[1] for r in df.groupBy(F.col("_metadata.file_name").alias(file)).count().collect()}
    offsets, rows = [], 0
    # part-<task>-<id>-c<file of the task>
    for name in sorted(counts, key=lambda x: [int(n) for n in re.match(r"part-(\d+)-.*-c(\d+)\.", x).groups()]):
        offsets.append((name, rows))
        rows += counts[name]
    starts = df.sparkSession.createDataFrame(offsets, f"{file} string, {before} bigint")
    placed = df.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(position)).join(F.broadcast(starts), file)
    return placed.withColumn(position, col(position) + col(before)).drop(file, before), position


@register("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))[0]
