"""Cases outside the registered queries' data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import T0, batch, frame, outcomes
from voltlane.functions.scalars import parse_ts
from voltlane.operators import ingest as I
from voltlane.operators.design import source_precedence
from voltlane.operators.ordering import distributed_rank, percentile_rank
from voltlane.operators.sessions import upsert_sessions
from voltlane.session import table_stage, work_folder
from voltlane.sources.sinks import check_kpi_rows, write_observations


def test_each_required_field_is_required(spark):
    record = batch("b", "v", "u", 0, "a")["records"][0]
    event = dict(event_type="start", observed_at=T0, session_id=None, raw_payload_ref=None)
    diagnostic = dict(observed_at=T0, mil_on=True, dtcs_active=None)
    window = (T0, T0 + timedelta(hours=1), None)
    bad = [{k: None} for k in ("batch_id", "vehicle_uid", "schema_version", "source", "capture_window")]
    bad += [{"capture_window": (None, *window[1:])}, {"capture_window": (T0, None, None)}, {"records": [record, None]}]
    bad += [{"records": [record, record | {k: None}]} for k in ("observed_at", "signal_key", "status")]
    bad += [{"session_events": [event | {k: None}]} for k in ("event_type", "observed_at")] + [{"diagnostics": [diagnostic | {"observed_at": None}]}]
    good = [{}, {"client": None}, {"diagnostics": [diagnostic]}, {"session_events": None}, {"diagnostics": None}]
    rows = [batch("b", "v", "u", 0, f"{kind}{i}") | over for kind, overs in (("bad", bad), ("good", good)) for i, over in enumerate(overs)]
    got = {r.arrival_id: r.rejection for r in I.validate_batches(frame(spark, rows)).collect()}
    assert got == {a: "malformed" if a.startswith("bad") else None for a in got}


def test_forbidden_uploads_claim_no_ids_along_chains(spark):
    access = [("x", "w", "owner", T0, T0)]
    rows = [batch("b1", "w", "y", 0, "a0"), batch("b1", "v", "z", 1, "a1"), batch("b2", "v", "q", 2, "a2"), batch("b2", "t", "r", 3, "a3"), batch("b3", "t", "s", 4, "a4"), batch("b3", "p", "s", 5, "a5")]
    assert outcomes(spark, rows, access=access) == {"a0": "forbidden", "a1": "fresh", "a2": "forbidden", "a3": "fresh", "a4": "forbidden", "a5": "fresh"}


def test_decisions_equal_a_sequential_fold(spark):
    rng = random.Random(11)
    rows = [batch(f"b{rng.randint(0, 9)}", f"v{rng.randint(0, 4)}", f"u{rng.randint(0, 2)}", i, f"a{i:02d}", end_hours=rng.choice([1, 1, 2])) for i in range(40)]
    access = [("u0", "v0", "owner", T0, T0)]
    owner, held, want = {"v0": "u0"}, {}, {}
    for r in rows:
        key = (r["vehicle_uid"], r["capture_window"])
        if r["batch_id"] in held:
            want[r["arrival_id"]] = "duplicate" if held[r["batch_id"]] == key else "conflict"
        elif owner.get(r["vehicle_uid"], r["user_id"]) != r["user_id"]:
            want[r["arrival_id"]] = "forbidden"
        else:
            want[r["arrival_id"]] = "fresh"
            owner[r["vehicle_uid"]], held[r["batch_id"]] = r["user_id"], key
    assert outcomes(spark, rows, access=access) == want


def test_rows_without_value_or_key_have_no_rank(spark):
    df = spark.createDataFrame([("k", 1.0, "higher_is_better"), ("k", None, "higher_is_better"), (None, 2.0, "higher_is_better")], "k string, v double, d string")
    got = {(r.k, r.v): (r.percentile, r.cohort_values) for r in percentile_rank(df, ["k"], "v", "d").collect()}
    assert got == {("k", 1.0): (100, 1), ("k", None): (None, None), (None, 2.0): (None, None)}


def test_readings_without_key_are_kept(spark):
    rows = [("v", "s", "obd", T0, None, "o1"), ("v", None, "obd", T0, 1.0, "o2"), (None, "s", "obd", T0, 1.0, "o3")]
    df = spark.createDataFrame(rows, "vehicle_uid string, signal_key string, source string, observed_at timestamp, confidence double, observation_id string")
    assert {r.observation_id: r.is_winner for r in source_precedence(df).collect()} == {"o1": True, "o2": None, "o3": None}


def test_one_row_per_session_id(spark):
    schema = "charging_session_id string, session_id string, vehicle_uid string, started_at timestamp, status string, created_at timestamp"
    new = [("c1", "s", "v1", T0, "x", T0), ("c2", "s", "v2", T0 + timedelta(1), "y", T0)]
    got = upsert_sessions(spark.createDataFrame([], schema), spark.createDataFrame(new, schema)).collect()
    assert [(r.session_id, r.status) for r in got] == [("s", "y")]


def test_rows_of_another_family_fail_the_write(spark):
    df = spark.createDataFrame([("ev_composite", "k", 1)], "ranking_type string, kpi_key string, sample_count bigint")
    with pytest.raises(Exception, match="another family"):
        check_kpi_rows(df, "ev_range_efficiency").collect()


def test_instants_with_blanks_are_refused(spark):
    rows = [("2024-01-01T00:00:00Z",), (" 2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00Z ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(parse_ts(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 1), None, None]


def test_no_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        work_folder(Cluster, "x")


def test_equal_scores_with_one_prefix_spread_over_ranges(spark):
    seen = []

    def stage(df, name):
        seen.append(table_stage(spark)(df, name))
        return seen[-1]

    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(100_000).select(F.lit("k").alias("k"), F.lit(100.0).alias("s"), F.format_string("veh-%08d", "id").alias("id"))
        ranked = distributed_rank(rows, ["k"], "s", "id", stage=stage)
        assert ranked.where(F.col("rank_position") != F.substring("id", 5, 8).cast("bigint") + 1).isEmpty() and ranked.count() == 100_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 30_000


def test_files_of_a_day_follow_its_volume(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 5 * 86400).alias("observed_at"), F.col("id").cast("double").alias("value_number"), F.lit(0.5).alias("confidence"))
    write_observations(rows, f"{tmp_path}/obs")
    days = [d for d in (tmp_path / "obs").iterdir() if d.is_dir()]
    assert len(days) == 5 and all(len(list(d.glob("part-*"))) == 1 for d in days)
    assert spark.read.parquet(f"{tmp_path}/obs").count() == 4000
