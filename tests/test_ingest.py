from datetime import datetime, timedelta

from pyspark.sql import functions as F

from voltlane import schemas
from voltlane.operators import ingest as I
from voltlane.sources import batches as B
from voltlane.streaming.ingest import ACCESS, LEDGER

T0 = datetime(2024, 1, 1)
COLUMNS = f"{schemas.BATCH}, user_id string, received_at timestamp, arrival_id string"


def batch(batch_id, vehicle, user, minute, arrival, end_hours=1, records=1, **over):
    record = dict(observed_at=T0, signal_key="ev.soc_pct", value_number=50.0, value_string=None, value_bool=None, value_json=None,
                  unit=None, status="ok", confidence=None, source_signal=None, freshness_ttl_seconds=None, temperature_bin=None,
                  is_temperature_estimated=None, session_id=None, raw_payload_ref=None)
    row = dict(batch_id=batch_id, schema_version="0.2", vehicle_uid=vehicle, source="OBD", client=None,
               capture_window=(T0, T0 + timedelta(hours=end_hours), None), records=[record] * records, session_events=[], diagnostics=[],
               user_id=user, received_at=T0 + timedelta(minutes=minute), arrival_id=arrival)
    row.update(over)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


def outcomes(spark, rows, ledger=(), access=()):
    got = I.accept_batches(frame(spark, rows), spark.createDataFrame(list(ledger), LEDGER), spark.createDataFrame(list(access), ACCESS))
    return {r.arrival_id: r.outcome for r in got.collect()}


def test_three_way_idempotency_and_ownership(spark):
    got = outcomes(spark, [
        batch("b1", "v1", "u1", 0, "a0"), batch("b1", "v1", "u1", 0, "a1"), batch("b1", "v1", "u1", 5, "a2", end_hours=2),
        batch("b2", "v1", "u2", 1, "a3"), batch("b1", "v1", "u2", 6, "a4"), batch("b2", "v1", "u1", 7, "a5"),
        batch("b3", "v2", "u2", 2, "a6", source="SMARTCAR"), batch("b3", "v2", "u3", 9, "a7"),
    ])
    assert got == {"a0": "fresh", "a1": "duplicate", "a2": "conflict", "a3": "forbidden", "a4": "duplicate", "a5": "fresh",
                   "a6": "rejected", "a7": "fresh"}


def test_ledger_and_known_owner(spark):
    ledger = [("b1", "v1", "0.2", "obd", T0, T0 + timedelta(hours=1), T0)]
    access = [("u1", "v1", "owner", T0, T0)]
    got = outcomes(spark, [batch("b1", "v1", "u1", 0, "a0"), batch("b1", "v1", "u2", 1, "a1", end_hours=3), batch("b9", "v1", "u2", 2, "a2")],
                   ledger, access)
    assert got == {"a0": "duplicate", "a1": "conflict", "a2": "forbidden"}


def test_many_replays_of_one_batch(spark):
    got = outcomes(spark, [batch("b1", "v1", "u1", i % 7, f"a{i:03d}") for i in range(300)])
    assert sorted(got.values()) == ["duplicate"] * 299 + ["fresh"] and got["a000"] == "fresh"


def test_first_rule_wins(spark):
    rows = [batch("b", "v", "u", 0, "a0", schema_version="9", source="x"), batch("b", "v", "u", 0, "a1", schema_version="9", records=0),
            batch("b", "v", "u", 0, "a2", records=0), batch("b", "v", "u", 0, "a3", records=5001), batch("b", "v", "u", 0, "a4", end_hours=25),
            batch("b", "v", "u", 0, "a5", records=5000)]
    got = {r.arrival_id: r.rejection for r in I.validate_batches(frame(spark, rows)).collect()}
    assert got == {"a0": "source", "a1": "schema_version", "a2": "empty_batch", "a3": "too_many_records", "a4": "window_length", "a5": None}


def raw(spark, n):
    return spark.range(n).select(
        F.format_string("o%06d", "id").alias("observation_id"), F.lit("v").alias("vehicle_uid"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("b")).alias("batch_id"), F.lit(None).cast("string").alias("session_id"),
        F.timestamp_seconds(F.col("id") * 7).alias("observed_at"), F.lit("ev.soc_pct").alias("signal_key"), F.lit(None).cast("string").alias("source_signal"),
        F.lit("ok").alias("status"), F.col("id").cast("double").alias("value_number"), F.lit(None).cast("string").alias("value_string"),
        F.lit(None).cast("boolean").alias("value_bool"), F.lit(None).cast("string").alias("value_json"), F.lit("r").alias("raw_payload_ref"))


def test_rebuilt_batches_are_the_same_in_parts_of_any_size(spark):
    rows = raw(spark, 3_000)

    def joined(most):
        parts = I.raw_rows_to_batches(rows, max_records=most).collect()
        assert max(len(r.records) for r in parts) <= most
        whole = {}
        for r in sorted(parts, key=lambda r: r.part):
            assert r.part == len(whole.get(r.batch_id, [])) // most
            whole.setdefault(r.batch_id, []).extend((x.observed_at, x.value_number) for x in r.records)
        return whole, {(r.batch_id, r.capture_window) for r in parts}

    assert joined(70) == joined(5_000)
    assert {k: len(v) for k, v in joined(5_000)[0].items()} == {"b": 2_000, I.NO_BATCH: 1_000}


def test_json_round_trip(spark):
    built = I.raw_rows_to_batches(raw(spark, 20))
    back = B.parse_batches(I.batches_to_json(built))
    pick = lambda df: sorted((r.batch_id, r.n, r.first) for r in df.select(
        "batch_id", F.size("records").alias("n"), F.col("records")[0]["observed_at"].cast("string").alias("first")).collect())
    assert pick(back) == pick(built)
