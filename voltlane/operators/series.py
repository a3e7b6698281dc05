"""Driving series: snapshots per instant, carried-forward state, deltas, points.

Timeframes are never multiplied into the rows. State carried to an instant remembers
*when* each value was read; a state is valid in a timeframe exactly when all its
values were read at or after that timeframe's cutoff. So one pass over the longest
timeframe gives the result of a separate pass per timeframe, each started empty.

A vehicle's series is split into time buckets (one hour by default): the window runs
per (vehicle, bucket) and the state at the end of earlier buckets is joined in, so a
vehicle with very many rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import (
    Timeframe,
    instant,
    is_finite,
    matching_timeframes,
    wh_per_km,
    whole_seconds,
)

BUCKET_SECONDS = 3600
SLOT = ["vehicle_uid", "bucket"]
DRIVE_SIGNALS = {
    "odo": C.ODOMETER,
    "soc": C.SOC,
    "speed": C.SPEED,
    "temp": C.AMBIENT,
    "regen": C.REGEN,
    "traction": C.TRACTION,
}
DRIVE_STATE = ["odo", "soc", "speed", "temp", "power"]


def time_bucket(ts: Column, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(whole_seconds(ts) / F.lit(seconds)).cast("bigint")


def select_signals(obs: DataFrame, keys, tf: list[Timeframe]) -> DataFrame:
    """Readings of ``keys`` inside the longest timeframe, labelled with their timeframes.

    Both filters are plain comparisons on source columns and reach the scan.
    """
    earliest = min(t.cutoff for t in tf)
    ts = F.col("observed_at")
    return obs.where(
        F.col("signal_key").isin(list(keys)) & (ts >= instant(earliest, obs, "observed_at"))
    ).withColumn("timeframes", matching_timeframes(ts, obs, "observed_at", tf))


def pivot_snapshots(
    obs: DataFrame, signals: dict[str, str] = DRIVE_SIGNALS, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """One row per (vehicle, instant) with one column per signal; the last ingested value wins.

    Null values never replace a value. Readings are dealt by (vehicle, time bucket) before they
    are aggregated: the aggregate and all windows per (vehicle, bucket) then share this one
    shuffle and its order.
    """
    age = F.struct("ingested_at", "observation_id")
    picks = []
    for name, key in signals.items():
        mine = (F.col("signal_key") == key) & F.col("value_number").isNotNull()
        picks.append(F.max_by(F.when(mine, F.col("value_number")), F.when(mine, age)).alias(name))
    return (
        obs.where(F.col("signal_key").isin(list(signals.values())))
        .select(
            "vehicle_uid", time_bucket(F.col("observed_at"), bucket_seconds).alias("bucket"), "observed_at", "signal_key",
            "value_number", "ingested_at", "observation_id",
        )
        .repartition(*SLOT)
        .groupBy(*SLOT, "observed_at")
        .agg(*picks)
    )


def _known(cols) -> dict[str, Column]:
    return {c: F.when(F.col(c).isNotNull(), F.struct(F.col("observed_at").alias("at"), F.col(c).alias("v"))) for c in cols}


def bucket_ends(snaps: DataFrame, cols) -> DataFrame:
    """Last known value of each column in a bucket, as struct(at, v)."""
    known = _known(cols)
    return snaps.groupBy(*SLOT).agg(*[F.max_by(known[c], F.when(F.col(c).isNotNull(), F.col("observed_at"))).alias(c) for c in cols])


def carried_in(ends: DataFrame, cols) -> DataFrame:
    """State that enters each bucket: ``_in_<c>``, from the ends of all earlier ones."""
    earlier = Window.partitionBy("vehicle_uid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*SLOT, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in cols])


def fill(snaps: DataFrame, carried: DataFrame, cols) -> DataFrame:
    """Snapshots with the state up to and strictly before each instant, given what enters their buckets."""
    known = _known(cols)
    inside = Window.partitionBy(*SLOT).orderBy("observed_at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    others = [c for c in snaps.columns if c not in cols]
    local = snaps.select(*others, *[known[c].alias(c) for c in cols]).select(
        *others,
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_cur_{c}") for c in cols],
        *[F.last(c, ignorenulls=True).over(before).alias(f"_pre_{c}") for c in cols],
    )
    joined = local.join(carried, SLOT)
    out = []
    for c in cols:
        cur = F.coalesce(f"_cur_{c}", f"_in_{c}")
        pre = F.coalesce(f"_pre_{c}", f"_in_{c}")
        out += [
            cur["v"].alias(c), cur["at"].alias(f"{c}_at"),
            pre["v"].alias(f"prev_{c}"), pre["at"].alias(f"prev_{c}_at"),
        ]
    return joined.select(*others, *out)


def carry_forward(snaps: DataFrame, cols) -> DataFrame:
    """Last known value of each column up to an instant, and strictly before it.

    Adds for every ``c``: ``c`` (filled), ``c_at`` (its instant), ``prev_c``, ``prev_c_at``.
    """
    cols = list(cols)
    # The join would drop these rows, but ask for it on one of its sides only: both sides are to be the same plan, made and dealt once.
    snaps = snaps.where(F.col("vehicle_uid").isNotNull() & F.col("bucket").isNotNull())
    return fill(snaps, carried_in(bucket_ends(snaps, cols), cols), cols)


def earliest_of(*instants: Column) -> Column:
    """Smallest of several instants; null as soon as one is missing."""
    present = instants[0].isNotNull()
    for i in instants[1:]:
        present = present & i.isNotNull()
    return F.when(present, instants[0] if len(instants) == 1 else F.least(*instants))


def complete_deltas(filled: DataFrame, required=("odo", "soc")) -> DataFrame:
    """Change against the previous complete snapshot, accepted or not.

    Once complete, a series stays complete, so the previous complete state is the state
    strictly before the instant. ``since`` is the oldest reading of that previous state:
    the delta exists in every timeframe whose cutoff is not later.
    """
    return filled.select(
        "*",
        (F.col("odo") - F.col("prev_odo")).alias("delta_km"),
        (F.col("prev_soc") - F.col("soc")).alias("delta_soc"),
        earliest_of(*[F.col(f"prev_{c}_at") for c in required]).alias("since"),
    ).where(F.col("since").isNotNull())


def delta_accepted(km: Column, soc: Column) -> Column:
    return (km > 0.05) & (soc > 0.05) & (soc < 30.0)


def gate_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.where(delta_accepted(F.col("delta_km"), F.col("delta_soc")))


def km_per_soc_of(km: Column, soc: Column) -> Column:
    ratio = F.try_divide(km, soc)
    return F.when(is_finite(ratio) & (ratio > 0.0) & (ratio < 50.0), ratio)


def km_per_soc(gated: DataFrame) -> DataFrame:
    """Adds ``km_per_soc``; null where the ratio is outside (0, 50)."""
    return gated.withColumn("km_per_soc", km_per_soc_of(F.col("delta_km"), F.col("delta_soc")))


def speed_segment_of(speed: Column) -> Column:
    return F.when(speed < 45.0, "urban").when(speed >= 80.0, "highway")


def speed_segment(gated: DataFrame) -> DataFrame:
    """Adds ``segment``: urban, highway or null (in between or speed unknown)."""
    return gated.withColumn("segment", speed_segment_of(F.col("speed")))


def latest_value(obs: DataFrame, key: str, tf: list[Timeframe]) -> DataFrame:
    """Newest non-null value of a signal per vehicle and timeframe."""
    newest = (
        select_signals(obs, [key], tf)
        .where(F.col("value_number").isNotNull())
        .groupBy("vehicle_uid")
        .agg(F.max(F.struct("observed_at", "ingested_at", "observation_id", "value_number")).alias("last"))
    )
    labels = matching_timeframes(F.col("last.observed_at"), obs, "observed_at", tf)
    return newest.select(
        "vehicle_uid", F.explode(labels).alias("timeframe"),
        F.col("last.value_number").alias("value"), F.col("last.observed_at").alias("observed_at"),
    )


def power_windows(filled: DataFrame) -> DataFrame:
    """Energy held from one power snapshot to the next, for gaps of 1 to 300 whole seconds.

    Needs the carried column ``power`` = struct(regen, traction), null where neither is read.
    """
    gap = whole_seconds(F.col("observed_at")) - whole_seconds(F.col("prev_power_at"))
    hours = F.col("gap_seconds") / 3600.0

    def energy(kw: Column) -> Column:
        return F.when(is_finite(kw) & (kw > 0.0), kw * hours * 1000.0)

    return (
        filled.where((F.col("power_at") == F.col("observed_at")) & F.col("prev_power_at").isNotNull())
        .withColumn("gap_seconds", gap)
        .where(F.col("gap_seconds").between(1, 300))
        .select(
            "vehicle_uid", "observed_at", "gap_seconds",
            F.col("prev_power_at").alias("since"),
            energy(F.col("prev_power.regen")).alias("regen_wh"),
            energy(F.col("prev_power.traction")).alias("traction_wh"),
        )
    )


def with_power(snaps: DataFrame) -> DataFrame:
    """Replace regen and traction by one nullable struct column ``power``."""
    either = F.col("regen").isNotNull() | F.col("traction").isNotNull()
    return snaps.withColumn("power", F.when(either, F.struct("regen", "traction"))).drop("regen", "traction")


def per_timeframe(df: DataFrame, keys, since: str, tf: list[Timeframe], build) -> DataFrame:
    """Aggregate once and return one row per (keys, timeframe) that has any row.

    ``build(inside)`` returns aggregate columns; ``inside(c)`` is ``c`` where the row falls
    into the timeframe and null elsewhere.
    """
    packs = []
    for t in tf:
        hit = F.col(since) >= instant(t.cutoff, df, since)
        inside = lambda c, hit=hit: F.when(hit, c)
        packs.append(
            F.struct(
                F.lit(t.token).alias("timeframe"), F.count_if(hit).alias("_rows"), *build(inside)
            )
        )
    return (
        df.groupBy(*keys)
        .agg(F.array(*packs).alias("_p"))
        .select(*keys, F.explode("_p").alias("_p"))
        .select(*keys, "_p.*")
        .where(F.col("_rows") > 0)
        .drop("_rows")
    )


def integrate_power(obs: DataFrame, tf: list[Timeframe], bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Regenerated and traction energy (Wh) per vehicle and timeframe, and window count."""
    rows = select_signals(obs, [C.REGEN, C.TRACTION], tf)
    snaps = with_power(pivot_snapshots(rows, {"regen": C.REGEN, "traction": C.TRACTION}, bucket_seconds))
    return sum_power(power_windows(carry_forward(snaps, ["power"])), tf)


def sum_power(windows: DataFrame, tf: list[Timeframe]) -> DataFrame:
    used = F.col("regen_wh").isNotNull() | F.col("traction_wh").isNotNull()
    return per_timeframe(
        windows, ["vehicle_uid"], "since", tf,
        lambda inside: [
            F.coalesce(F.sum(inside(F.col("regen_wh"))), F.lit(0.0)).alias("regen_wh"),
            F.coalesce(F.sum(inside(F.col("traction_wh"))), F.lit(0.0)).alias("traction_wh"),
            F.count(inside(F.when(used, F.lit(1)))).alias("power_windows"),
        ],
    )


def drive_steps(obs: DataFrame, tf: list[Timeframe], bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """All drive signals pivoted and carried forward once; feeds every drive KPI."""
    rows = select_signals(obs, DRIVE_SIGNALS.values(), tf)
    return carry_forward(drive_snapshots(rows, bucket_seconds), DRIVE_STATE)


def drive_snapshots(rows: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    return with_power(pivot_snapshots(rows, DRIVE_SIGNALS, bucket_seconds))


def temperature_points(filled: DataFrame) -> DataFrame:
    """(vehicle, observed_at, since, temp, km_per_soc, delta_km) for accepted, gated deltas."""
    deltas = gate_deltas(complete_deltas(filled, ("odo", "soc", "temp")))
    return (
        km_per_soc(deltas)
        .where(F.col("km_per_soc").isNotNull())
        .select("vehicle_uid", "observed_at", "since", "temp", "km_per_soc", "delta_km")
    )


def temperature_bucket_of(temp: Column) -> Column:
    return F.when(temp <= 5.0, "cold").when((temp > 15.0) & (temp <= 25.0), "mild")


def temperature_buckets(points: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Distance and point count per temperature group, and least-squares terms, per timeframe."""
    group = temperature_bucket_of(F.col("temp"))

    def build(inside):
        part = lambda name, c: inside(F.when(group == name, c))
        y, x = inside(F.col("km_per_soc")), inside(F.col("temp"))
        return [
            F.coalesce(F.sum(part("cold", F.col("delta_km"))), F.lit(0.0)).alias("cold_km"),
            F.coalesce(F.sum(part("mild", F.col("delta_km"))), F.lit(0.0)).alias("mild_km"),
            F.count(part("cold", F.lit(1))).alias("cold_points"),
            F.count(part("mild", F.lit(1))).alias("mild_points"),
            F.count(y).alias("points"),
            slope(y, x).alias("slope"),
        ]

    return per_timeframe(points, ["vehicle_uid"], "since", tf, build)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; null for fewer than two points or (almost) no spread in x."""
    spread = F.regr_sxx(y, x)
    return F.when((F.regr_count(y, x) >= 2) & (spread > 2.220446049250313e-16), F.regr_slope(y, x))


def mean(c: Column) -> Column:
    return F.avg(c)


def max_value(c: Column) -> Column:
    return F.max(F.when(is_finite(c), c))


def drive_points(filled: DataFrame, kwh: float) -> DataFrame:
    """Long table of every value that a drive KPI takes the median of, with the instant its timeframes must reach.

    (vehicle_uid, bucket, series, value, since) with series km, wh, urban, highway, cold, mild.
    """
    km, soc = F.col("delta_km"), F.col("delta_soc")
    ratio, wh = km_per_soc_of(km, soc), wh_per_km(soc, km, kwh)
    segment = speed_segment_of(F.col("speed"))
    group = temperature_bucket_of(F.col("temp"))
    with_speed = earliest_of(F.col("since"), F.col("speed_at"))
    with_temp = earliest_of(F.col("since"), F.col("prev_temp_at"))

    def point(series: Column, value: Column, since: Column) -> Column:
        whole = series.isNotNull() & value.isNotNull() & since.isNotNull()
        return F.when(whole, F.struct(series.alias("series"), value.alias("value"), since.alias("since")))

    gated = gate_deltas(complete_deltas(filled))
    points = F.array_compact(
        F.array(
            point(F.lit("km"), ratio, F.col("since")),
            point(F.lit("wh"), wh, F.col("since")),
            point(segment, wh, with_speed),
            point(group, ratio, with_temp),
        )
    )
    return gated.select(*SLOT, F.explode(points).alias("p")).select(*SLOT, "p.series", "p.value", "p.since")


def series_points(filled: DataFrame, tf: list[Timeframe], kwh: float) -> DataFrame:
    """The same with the timeframes of each value: (vehicle_uid, series, value, timeframes)."""
    return labelled_points(drive_points(filled, kwh), tf)


def labelled_points(points: DataFrame, tf: list[Timeframe]) -> DataFrame:
    return points.select(
        "vehicle_uid", "series", "value", matching_timeframes(F.col("since"), points, "since", tf).alias("timeframes")
    ).where(F.size("timeframes") > 0)
