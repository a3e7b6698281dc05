"""End to end on two recorded uploads of one vehicle, against recorded results."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlane.operators import ingest as I
from voltlane.operators import reads as Q
from voltlane.functions.scalars import timeframes, to_real
from voltlane.plans.recompute import Tables, recompute
from voltlane.session import table_stage
from voltlane.sources import batches as B
from voltlane.sources.sinks import check_kpi_rows

AS_OF = datetime(2026, 2, 20, 23, 16, 5)
VEHICLE = "vehicle-1"
UNITS = {"distance.odometer": "km", "ev.soc_pct": "%"}

# fixed values: the recorded readings (time, signal, number or text)
COLD = [
    ("09:00:00", "distance.odometer", 12000.0), ("09:00:00", "ev.soc_pct", 82.0), ("09:00:00", "speed.vehicle", 56.0),
    ("09:00:00", "environment.ambient_temp_c", -6.0), ("09:20:00", "distance.odometer", 12028.0), ("09:20:00", "ev.soc_pct", 72.0),
    ("09:20:00", "speed.vehicle", 62.0), ("09:20:00", "environment.ambient_temp_c", -4.0), ("10:00:05", "ev.soc_pct", 28.0),
    ("10:00:10", "ev.charge_power_kw", 42.0), ("10:00:15", "environment.ambient_temp_c", -3.0), ("10:29:50", "ev.soc_pct", 54.0),
    ("10:29:45", "ev.charge_power_kw", 48.0), ("10:29:40", "ev.battery_temp_c", 6.0), ("10:00:20", "ev.charger_type", "dc_fast"),
]
MILD = [
    ("09:00:00", "distance.odometer", 12100.0), ("09:00:00", "ev.soc_pct", 78.0), ("09:00:00", "speed.vehicle", 52.0),
    ("09:00:00", "environment.ambient_temp_c", 18.0), ("09:25:00", "distance.odometer", 12134.0), ("09:25:00", "ev.soc_pct", 66.0),
    ("09:25:00", "speed.vehicle", 58.0), ("09:25:00", "environment.ambient_temp_c", 20.0), ("10:00:05", "ev.soc_pct", 24.0),
    ("10:00:10", "ev.charge_power_kw", 72.0), ("10:00:15", "environment.ambient_temp_c", 19.0), ("10:29:50", "ev.soc_pct", 58.0),
    ("10:29:45", "ev.charge_power_kw", 76.0), ("10:29:40", "ev.battery_temp_c", 22.0), ("10:00:20", "ev.charger_type", "dc_fast"),
]


def upload(name, day, readings):
    record = lambda t, key, v: {
        "observed_at": f"{day}T{t}Z", "signal_key": key, "value_number": v if isinstance(v, float) else None,
        "value_string": None if isinstance(v, float) else v, "status": "ok", "confidence": 0.9}
    events = [{"event_type": f"charging_session_{e}", "observed_at": f"{day}T{t}Z", "session_id": f"session-{name}"}
              for e, t in (("start", "10:00:00"), ("stop", "10:30:00"))]
    return {"batch_id": name, "schema_version": "0.2", "vehicle_uid": VEHICLE, "source": "OBD",
            "capture_window": {"started_at": f"{day}T08:50:00Z", "ended_at": f"{day}T10:40:00Z", "sample_interval_seconds": 60},
            "records": [record(*r) for r in readings], "session_events": events}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("uploads")
    for name, day, readings in (("cold", "2026-02-19", COLD), ("mild", "2026-02-20", MILD)):
        (folder / f"{name}.json").write_text(json.dumps(upload(name, day, readings)))
    batches = B.read_batches(spark, str(folder)).withColumn("user_id", F.lit("user-1")).withColumn(
        "received_at", F.col("capture_window.ended_at"))
    checked = I.validate_batches(batches)
    assert checked.where(F.col("rejection").isNotNull()).count() == 0
    records = I.validate_records(I.explode_records(batches), B.registry(spark))
    receipts = I.batch_receipts(batches.withColumn("outcome", F.lit("fresh")), records).collect()
    assert [(r.records_received, r.records_accepted, r.next_upload_after_seconds) for r in receipts] == [(15, 15, 60)] * 2
    obs = I.to_observations(records).withColumn("value_number", to_real(F.col("value_number")))
    none = spark.createDataFrame([], "vehicle_uid string, source_account_id string, make string, model string, trim string, "
                                     "model_year bigint, powertrain_class string, created_at timestamp, updated_at timestamp")
    return Tables(I.ensure_vehicles(none, batches), obs, I.explode_session_events(batches), I.explode_diagnostics(batches))


@pytest.fixture(scope="module")
def results(spark, tables):
    return recompute(tables, AS_OF, real_storage=True, stage=table_stage(spark))


def values(rows, timeframe="90d"):
    return {r.kpi_key: (r.value, r.sample_count) for r in rows.collect()}


def test_row_counts(results):
    row = results.summary().first()
    assert tuple(row) == (2, 42, 15, 1)


def test_range(results):
    assert values(Q.kpis_range(results.kpis, timeframe="90d")) == {
        "ev_estimated_practical_range": (163.36666870117188, 2), "ev_net_energy_efficiency": (266.2815246582031, 2),
        "ev_range_efficiency_score": (21.600255966186523, 2), "soc_depletion_rate_per_100km": (35.502960205078125, 2)}


def test_charging(results):
    assert values(Q.kpis_charging(results.kpis, timeframe="90d")) == {
        "charging_performance_score": (72.56756591796875, 2), "cold_weather_charge_speed_retention": (60.81081008911133, 1),
        "temp_adjusted_charge_acceptance_score": (80.40540313720703, 2)}


def test_temperature(results, tables):
    rows = Q.kpis_temperature_impact(results.kpis, tables.vehicle).collect()
    assert {r.kpi_key: (r.value, r.percentile, r.cohort_size) for r in rows} == {
        "cold_weather_charge_speed_retention": (60.81081008911133, 100, 1), "cold_weather_range_retention": (98.82353210449219, 100, 1)}


def test_rankings(results):
    got = {(r.ranking_type, r.temperature_bin): (r.score, r.confidence_level, r.cohort_key, r.rank_position)
           for r in results.rankings.where(F.col("timeframe") == "90d").collect()}
    cohort = "bev|unknown|unknown|unknown|unknown"
    assert got[("ev_range_efficiency", "all")] == (21.600255966186523, "preview", cohort, 1)
    assert got[("ev_charging_performance", "all")] == (72.56756591796875, "preview", cohort, 1)
    assert got[("ev_composite", "all")] == (41.987178802490234, "preview", cohort, 1)
    assert got[("ev_temperature_impact", "cold")] == (65.7543716430664, "medium", cohort, 1)


def test_readiness(results, tables):
    tf = timeframes(AS_OF, ["90d"])
    evidence = Q.gate_evidence(tables.observations, results.sessions, tf)
    rows = {r.ranking_type: r for r in Q.readiness(results.kpis, tables.vehicle, evidence, tf).collect()}
    assert [rows[f].status for f in ("ev_range_efficiency", "ev_charging_performance", "ev_composite")] == ["preview"] * 3
    temp = rows["ev_temperature_impact"]
    assert (temp.status, temp.confidence_level, temp.sample_count) == ("not_ready", "preview", 1)
    assert temp.missing_requirements == ["cold_distance_km<20.0", "mild_distance_km<20.0"]


def test_charging_reads_reject_other_bins(results):
    assert Q.kpis_charging(results.kpis, timeframe="90d", temperature_bin="cold").count() == 0
    with pytest.raises(ValueError):
        Q.kpis_charging(results.kpis, temperature_bin="hot")
    with pytest.raises(ValueError):
        Q.kpis_range(results.kpis, temperature_bin="cold")


def test_unlocked_key_fails_the_write(results):
    bad = results.kpis.where(F.col("ranking_type") == "ev_composite").withColumn("kpi_key", F.lit("made_up"))
    with pytest.raises(Exception, match="has no key"):
        check_kpi_rows(bad, "ev_composite").collect()
