"""Order statistics and running totals that do not put one key into one task.

A vehicle, cohort or day may hold a large share of all rows. A plain window or
``median`` per key would send that share to a single task. The functions here split a
key by a *bucket* that is monotone in the sort order: counts per bucket are small and
are combined first, the detail work then runs per (key, bucket). Results are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from ..functions.sizes import broadcast_if_small
from ..session import Stage, hadoop_folder, table_stage, work_folder
from .skew import join_counted

# Buckets per e-fold of magnitude. Values up to 1e6 give about 57,000 buckets per key.
RESOLUTION = 4096


def value_bucket(c: Column, resolution: int = RESOLUTION) -> Column:
    """Bucket number that never decreases when ``c`` grows (finite values)."""
    return (F.signum(c) * F.floor(F.log1p(F.abs(c)) * F.lit(resolution))).cast("bigint")


def order_bits(c: Column) -> Column:
    """The bits of a finite double as a whole number that grows with it; 0.0 and -0.0 are equal.

    Exponent and fraction come from exact operations only (scaling by powers of two).
    """
    size = F.abs(c)
    # never below the exponent of the smallest normal number, so subnormal ones follow the same rule
    guess = F.greatest(F.floor(F.log2(F.when(size > 0.0, size).otherwise(1.0))).cast("int"), F.lit(-1022))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    low = F.when((size < power(guess)) & (guess > -1022), guess - 1).when((guess < 1023) & (size / power(guess) >= 2.0), guess + 1).otherwise(guess)
    exponent = F.when(size < power(F.lit(-1022)), F.lit(-1022)).otherwise(low)
    bits = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + (size / power(exponent) * float(1 << 52)).cast("bigint")
    return F.when(c < 0.0, -bits).otherwise(bits)


# Bits left below the first and the second digit of a value. The last digit has a fixed number of
# values, so what one task sorts is bounded whatever the data.
DIGITS = (40, 20)


#: Values of one key up to which the middle is taken from the sorted values; those of a larger key never meet in one task.
LARGE_GROUP = 100_000


def exact_median(
    points: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    labels: str | None = None,
    label_name: str = "timeframe",
    digits: Sequence[int] = DIGITS,
    stage: Stage | None = None,
    large: int = LARGE_GROUP,
) -> DataFrame:
    """Exact median and count per key: (keys..., [label_name], median, n).

    ``labels`` may name an array column: a point then counts for each of its labels
    (for example the timeframes it falls into) without being copied before the shuffle.
    Non-finite values and rows with a null key are left out. Values are written once by ``stage``
    (default: :func:`table_stage`) and counted per key. Keys of up to ``large`` values are dealt by
    key and sorted there, in one shuffle; the few larger ones go digit by digit
    (:func:`_median_by_digits`), so that none is a task.
    """
    keys = list(keys)
    span = [labels] if labels else []
    stage = stage or table_stage(points.sparkSession)
    whole = is_finite(F.col(value))
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    kept = stage(points.where(whole).select(*keys, value, *span), f"values-{uuid.uuid4().hex}")
    crowded = stage(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*keys), f"large-{uuid.uuid4().hex}")
    if crowded.isEmpty():
        return _median_by_sort(kept, keys, value, labels, label_name)
    crowded = broadcast_if_small(crowded)
    return _median_by_sort(kept.join(crowded, keys, "left_anti"), keys, value, labels, label_name).unionByName(
        _median_by_digits(kept.join(crowded, keys, "left_semi"), keys, value, labels, label_name, digits, stage)
    )


def _median_by_sort(points: DataFrame, keys: list[str], value: str, labels: str | None, label_name: str) -> DataFrame:
    """Medians of keys whose values may meet in one task. Points are dealt by key before they are copied for their labels."""
    group = [*keys, label_name] if labels else keys
    dealt = points.repartition(*keys)
    if labels:
        dealt = dealt.withColumn(label_name, F.explode(labels)).drop(labels)
    whole = Window.partitionBy(*group)
    ranked = dealt.withColumn("_i", F.row_number().over(whole.orderBy(value))).withColumn("_all", F.count(F.lit(1)).over(whole))
    middle = ranked.where((F.col("_i") == F.floor((F.col("_all") + 1) / 2)) | (F.col("_i") == F.floor(F.col("_all") / 2) + 1))
    return middle.groupBy(*group).agg(
        # 0.0 is added so that -0.0 shows as 0.0
        ((F.min(value) + F.max(value)) / 2.0 + 0.0).alias("median"), F.max("_all").alias("n")
    )


def _median_by_digits(
    points: DataFrame, keys: list[str], value: str, labels: str | None, label_name: str, digits: Sequence[int], stage: Stage
) -> DataFrame:
    """Medians of keys that no task could hold.

    Equal values are collapsed to counts map-side. Then
    the middle is found digit by digit in the order-preserving bits of the values: a
    histogram of a digit tells where the middle lies, and only values with that digit go
    on. What remains after the last digit is sorted; however close values lie together,
    that is at most ``2 ** digits[-1]`` distinct ones a group. The collapsed values are
    written once by ``stage``, as every digit reads them again.
    """
    group = [*keys, label_name] if labels else keys
    span = [labels] if labels else []
    bits = order_bits(F.col(value))
    named = [f"_b{i}" for i in range(len(digits))]
    counted = points.groupBy(*keys, value, *span).agg(F.count(F.lit(1)).alias("_n"))
    rest = stage(counted.withColumns({b: F.shiftright(bits, d) for b, d in zip(named, digits, strict=True)}), f"counted-{uuid.uuid4().hex}")
    first = rest.groupBy(*keys, named[0], *span).agg(F.sum("_n").alias("_n"))
    if labels:
        first = first.withColumn(label_name, F.explode(labels)).groupBy(*group, named[0]).agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*group)
    middle = _digit_of_middle(
        first.withColumn("_all", F.sum("_n").over(whole)).withColumns({"_before": F.lit(0), "_lo": F.floor((F.col("_all") + 1) / 2), "_hi": F.floor(F.col("_all") / 2) + 1}),
        group, [named[0]],
    )
    rest = rest.join(middle, [*keys, named[0]])
    if labels:
        rest = rest.where(F.array_contains(F.col(labels), F.col(label_name))).drop(labels)
    for i in range(1, len(digits)):
        path = named[: i + 1]
        # the ranks are part of the key, so that a group whose two middles part goes on with both
        histogram = rest.groupBy(*group, *path, "_before", "_all", "_lo", "_hi").agg(F.sum("_n").alias("_n"))
        rest = rest.drop("_before", "_all", "_lo", "_hi").join(_digit_of_middle(histogram, group, path), [*group, *path])
    by_value = Window.partitionBy(*group, *named).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    picked = rest.withColumn("_upto", F.col("_before") + F.sum("_n").over(by_value)).where(_holds_rank("_upto", "_n"))
    return picked.groupBy(*group).agg(
        ((F.min(value) + F.max(value)) / 2.0).alias("median"), F.max("_all").alias("n")
    )


def _digit_of_middle(histogram: DataFrame, group: list[str], path: list[str]) -> DataFrame:
    """Digits that hold a middle rank, and the number of values before them.

    ``_before`` counts the values before all that share the digits above the last one of ``path``.
    """
    by_digit = Window.partitionBy(*group, *path[:-1]).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, 0)
    upto = histogram.withColumn("_upto", F.col("_before") + F.sum("_n").over(by_digit)).where(_holds_rank("_upto", "_n"))
    return upto.select(*group, *path, (F.col("_upto") - F.col("_n")).alias("_before"), "_all", "_lo", "_hi")


def _holds_rank(upto: str, n: str) -> Column:
    before = F.col(upto) - F.col(n)
    holds = lambda rank: (F.col(upto) >= F.col(rank)) & (before < F.col(rank))
    return holds("_lo") | holds("_hi")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    amounts: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per key in ``order``; ``bucket`` must be monotone in that order."""
    keys = list(keys)
    marked = df.withColumn("_b", bucket)
    for name, amount in amounts.items():
        marked = marked.withColumn(name, amount)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_b")
        .agg(*[F.sum(name).alias(f"_t_{name}") for name in amounts])
        .select(
            *keys, "_b",
            *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in amounts],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = marked.select(
        *[c for c in marked.columns if c not in amounts],
        *[F.sum(n).over(inside).alias(n) for n in amounts],
    )
    joined = running.join(offsets, [*keys, "_b"])
    for name in amounts:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    return joined.drop("_b", *[f"_o_{n}" for n in amounts])


def distributed_rank(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    tiebreak: str,
    rank_name: str = "rank_position",
    size_name: str = "cohort_size",
    stage: Stage | None = None,
) -> DataFrame:
    """Position 1..n per key by (score descending, tiebreak ascending), and n.

    Equal to ``row_number`` over the key. Rows are dealt by ranges of (key, score,
    tiebreak), whose cut points Spark takes from the data, so neither a large cohort nor
    many equal scores end up in one task; counts per range give the offsets. The dealt
    rows are written once by ``stage`` (default: :func:`table_stage`), as everything
    after reads them again.
    """
    keys = list(keys)
    stage = stage or table_stage(df.sparkSession)
    ranges = df.repartitionByRange(*keys, F.desc(score), F.asc(tiebreak)).withColumn("_range", F.spark_partition_id())
    dealt = stage(ranges, "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(size_name),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(score), F.asc(tiebreak))
    return (
        dealt.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_range"])
        .withColumn(rank_name, (F.col("_offset") + F.col("_r")).cast("bigint"))
        .drop("_range", "_r", "_offset")
    )


class PageIndex:
    """Rows in a total order, in ranges whose sizes are known: a page is read from the ranges it lies in.

    Ranges are folders (``_range=<n>``), cut by Spark from a sample of the order, and hold about one shuffle
    partition each; next to them stands how many rows come before each. A page of ``limit`` rows touches
    at most ``limit`` ranges, nearly always one, at any offset, and sorts nothing else. Equal rows of the order
    may lie on both sides of a cut, so end ``order`` with a unique column. Nulls of the order come first.
    """

    def __init__(self, spark: SparkSession, folder: str, order: Sequence[str]):
        self.spark, self.folder, self.order = spark, folder, list(order)

    @classmethod
    def write(cls, df: DataFrame, order: Sequence[str], folder: str | None = None) -> PageIndex:
        """Deal ``df`` into ranges under ``folder`` (default: a new one in the shared folder)."""
        index = cls(df.sparkSession, folder or work_folder(df.sparkSession, "pages"), order)
        ranges = df.repartitionByRange(*index.order).withColumn("_range", F.spark_partition_id())
        ranges.write.mode("overwrite").partitionBy("_range").parquet(f"{index.folder}/rows")
        if index._empty():
            df.limit(0).withColumn("_range", F.lit(0)).write.mode("overwrite").parquet(f"{index.folder}/rows")
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        sizes = index._rows().groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).write.mode("overwrite").parquet(f"{index.folder}/sizes")
        return index

    def _empty(self) -> bool:
        """No row, so no range folder and no schema that a reader could take from one."""
        files, at = hadoop_folder(self.spark, f"{self.folder}/rows")
        return not any(s.isDirectory() for s in files.listStatus(at))

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def size(self) -> int:
        """Number of rows in all."""
        return self.spark.read.parquet(f"{self.folder}/sizes").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, none beyond its end."""
        sizes = self.spark.read.parquet(f"{self.folder}/sizes")
        last = F.col("before") + F.col("n")
        held = sizes.where((F.col("before") < offset + limit) & (last > offset)).orderBy("_range").collect()  # at most ``limit`` ranges
        if not held:
            return self._rows().where(F.lit(False)).drop("_range")
        rows = self._rows().where(F.col("_range").between(held[0]["_range"], held[-1]["_range"]))
        return rows.drop("_range").orderBy(*self.order).offset(offset - held[0]["before"]).limit(limit)


def at_or_below(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per distinct (keys, value): rows of the key that are <=, < and = value, and in all."""
    keys = list(keys)
    fine = (
        df.withColumn("_b", value_bucket(F.col(value)))
        .groupBy(*keys, "_b", value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    coarse = (
        fine.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_c"))
        .select(
            *keys, "_b",
            F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_under"),
            F.sum("_c").over(Window.partitionBy(*keys)).alias("n_all"),
        )
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        fine.withColumn("_in", F.sum("_n").over(inside))
        .join(coarse, [*keys, "_b"])
        .select(
            *keys, value,
            (F.col("_under") + F.col("_in")).alias("n_at_or_below"),
            (F.col("_under") + F.col("_in") - F.col("_n")).alias("n_below"),
            F.col("_n").alias("n_equal"), "n_all",
        )
    )


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, direction: str, stage: Stage | None = None) -> DataFrame:
    """Adds ``percentile`` (0-100, rounded half up) and ``cohort_values`` (size) per row.

    Share of the key's values at or below this one, or at or above it where
    ``direction`` is ``lower_is_better``. A row without a value, or with a null key, has no
    rank: both columns are null, and it counts for no other row.
    """
    ranked = F.lit(True)
    for name in (*keys, value):
        ranked = ranked & F.col(name).isNotNull()
    unranked = df.where(~ranked).withColumns({"percentile": F.lit(None).cast("bigint"), "cohort_values": F.lit(None).cast("bigint")})
    df = df.where(ranked)
    stage = stage or table_stage(df.sparkSession)
    counts = stage(at_or_below(df, keys, value), "counts")  # read three times by the join
    share = F.when(F.col(direction) == "higher_is_better", F.col("n_at_or_below")).otherwise(
        F.col("n_all") - F.col("n_below")
    )
    return (
        join_counted(df, counts, [*keys, value], "n_equal")
        .withColumn("percentile", F.round(share / F.col("n_all") * 100.0).cast("bigint"))
        .withColumnRenamed("n_all", "cohort_values")
        .drop("n_at_or_below", "n_below", "n_equal")
        .unionByName(unranked)
    )
