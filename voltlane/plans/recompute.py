"""Full recompute: sessions, four KPI families, rankings, run summary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..config import TemperatureGates
from ..functions.scalars import timeframes
from ..operators import kpis as K
from ..operators import rankings as R
from ..operators.series import drive_steps
from ..operators.sessions import charging_sessions, upsert_sessions
from ..session import Stage
from ..sources.sinks import check_kpi_rows, ranking_parts
from ..sources.snapshots import Snapshots


@dataclass
class Tables:
    """Inputs of a recompute."""

    vehicle: DataFrame
    observations: DataFrame
    session_events: DataFrame
    diagnostics: DataFrame


@dataclass
class Results:
    sessions: DataFrame
    kpis: DataFrame
    rankings: DataFrame
    vehicle: DataFrame

    def summary(self) -> DataFrame:
        return run_summary(self.sessions, self.kpis, self.rankings, self.vehicle)


def recompute(
    tables: Tables,
    as_of: datetime,
    tokens=C.LOCKED_TIMEFRAMES,
    kwh: float = C.USABLE_BATTERY_KWH,
    gates: TemperatureGates = TemperatureGates(),
    gate: int = C.COHORT_GATE,
    real_storage: bool = False,
    stage: Stage | None = None,
    stored_sessions: DataFrame | None = None,
) -> Results:
    """All derived tables for all vehicles and timeframes at once.

    With ``stage`` (see :func:`voltlane.session.table_stage`) shared intermediate results are written
    once; without it everything stays one lazy plan and Spark reuses equal exchanges.
    Sessions of an earlier run (``stored_sessions``) keep their id, vehicle and creation instant, and stay if the
    events no longer name them.
    """
    keep = stage or (lambda df, name: df)
    tf = timeframes(as_of, tokens)

    sess = charging_sessions(tables.observations, tables.session_events, as_of, real_storage, stage=stage)
    sess = keep(sess if stored_sessions is None else upsert_sessions(stored_sessions, sess), "sessions")
    filled = drive_steps(tables.observations, tf)
    if stage:
        filled = keep(filled, "drive_steps")
    medians = keep(K.drive_medians(filled, tf, kwh, stage), "drive_medians")
    facts = keep(K.drive_facts(filled, tf), "drive_facts")
    buckets = keep(K.charge_power_buckets(sess, tf, stage), "charge_buckets")

    base = keep(
        K.to_kpi_rows(K.charging_wide(buckets, gates), C.CHARGING, K.CHARGING_KEYS, as_of, real_storage)
        .unionByName(K.to_kpi_rows(K.range_wide(medians, facts, kwh), C.RANGE, K.RANGE_KEYS, as_of, real_storage))
        .unionByName(
            K.to_kpi_rows(
                K.temperature_wide(medians, facts, buckets, gates), C.TEMPERATURE, K.TEMPERATURE_KEYS, as_of, real_storage
            )
        ),
        "kpi_base",
    )
    composite = keep(K.composite_kpis(base, tables.vehicle, tables.diagnostics, as_of, tf, real_storage), "kpi_composite")
    kpis = base.unionByName(composite)

    rankings = R.rank_cohorts(R.score_vehicles(kpis, tables.vehicle), as_of, gate, real_storage).unionByName(
        R.rank_temperature(R.temperature_seeds(tables.vehicle, kpis), as_of, gate, real_storage)
    )
    return Results(sess, kpis, keep(rankings, "rankings"), tables.vehicle)


RANKED_FAMILIES = (C.RANGE, C.CHARGING, C.TEMPERATURE, C.COMPOSITE)


def recompute_and_publish(tables: Tables, as_of: datetime, store: Snapshots, stage: Stage, **options) -> DataFrame:
    """A full run whose results are stored: sessions merged with the stored ones, KPIs and rankings replaced by family.

    Everything becomes visible at once, with the summary of the run, which is returned. A failed run changes nothing.
    """
    results = recompute(tables, as_of, stage=stage, stored_sessions=store.read("sessions"), **options)
    kpis, rankings = stage(results.kpis, "published_kpis"), results.rankings
    summary = Results(results.sessions, kpis, rankings, tables.vehicle).summary()
    of = lambda rows, family: rows.where(F.col("ranking_type") == family)
    store.publish({
        "sessions": {"all": results.sessions},
        "kpis": {family: check_kpi_rows(of(kpis, family), family) for family in RANKED_FAMILIES},
        "rankings": ranking_parts(rankings, RANKED_FAMILIES, options.get("tokens", C.LOCKED_TIMEFRAMES)),
        "runs": {as_of.strftime("%Y%m%dT%H%M%S"): summary.withColumn("as_of", F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz"))},
    })
    return store.read("runs", [as_of.strftime("%Y%m%dT%H%M%S")])


def run_summary(sess: DataFrame, kpis: DataFrame, ranks: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Row counts of a run in one row; each input is reduced to its count first."""
    parts = {
        "charging_sessions_upserted": sess,
        "kpi_rows_upserted": kpis,
        "ranking_rows_upserted": ranks,
        "recomputed_vehicles": vehicle,
    }
    counts = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts])
