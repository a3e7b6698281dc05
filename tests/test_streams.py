"""Keyed state of the ingest, and the incremental refresh."""

import os
import re
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from coverage_queries import streams as QS
from tests.test_ingest import T0, batch, frame
from voltlane import constants as C
from voltlane.operators import kpis as K
from voltlane.operators import rankings as R
from voltlane.operators.kpis import drive_facts, drive_medians, facts_of, medians_of
from voltlane.operators.series import BUCKET_SECONDS, SLOT, drive_steps, labelled_points
from voltlane.functions.scalars import timeframes
from voltlane.operators.sessions import charging_sessions
from voltlane.session import SHUFFLE_CLEANUP, shuffles_end
from voltlane.sources import batches as B
from voltlane.streaming import ingest as TI
from voltlane.streaming import refresh as TR
from voltlane.streaming import state as S

EVENT = ("charging_session_start", T0, "s1", None)


def send(spark, root, wave, rows):
    frame(spark, rows).drop("arrival_id").coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/uploads/w{wave}")


def start(spark, root):
    os.makedirs(f"{root}/uploads", exist_ok=True)
    return TI.Ingest(B.stream_batches(spark, f"{root}/uploads/*"), f"{root}/tables", B.registry(spark), f"{root}/checkpoint")


def test_claims_outlive_micro_batches_and_restarts(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/tables")
    TI.seed(
        f"{root}/tables", ledger=spark.createDataFrame([("old", "v9", "0.2", "OBD", T0, T0 + timedelta(hours=1), T0)], TI.LEDGER),
        access=spark.createDataFrame([("u9", "v9", "owner", T0, T0)], TI.ACCESS), vehicle=spark.createDataFrame([("v9", "x", None, None, None, None, "bev", T0, T0)], TI.VEHICLE),
    )
    job = start(spark, root)
    send(spark, root, 1, [
        batch("b1", "v1", "u1", 0, "", session_events=[EVENT]), batch("b2", "v2", "u2", 0, "", session_events=[EVENT, EVENT]),
        batch("old", "v9", "u9", 0, ""), batch("new", "v9", "u1", 1, ""),
    ])
    job.drain().stop()
    job = start(spark, root)  # the state comes back from the checkpoint
    send(spark, root, 2, [
        batch("b1", "v1", "u1", 60, ""), batch("b2", "v2", "u2", 60, "", end_hours=2), batch("b3", "v1", "u2", 60, ""),
        batch("b4", "v1", "u1", 60, "", session_events=[EVENT]), batch("b5", "v9", "u9", 60, ""),
    ])
    job.drain().stop()

    receipts = sorted((r.batch_id, r.duplicate) for r in job.table("receipts").collect())
    assert receipts == [("b1", False), ("b1", True), ("b2", False), ("b4", False), ("b5", False), ("old", True)]
    assert sorted((r.batch_id, r.outcome) for r in job.table("refused").collect()) == [("b2", "conflict"), ("b3", "forbidden"), ("new", "forbidden")]
    events = job.table("session_events").collect()
    assert sorted((r.vehicle_uid, r.session_id, r.ingested_at) for r in events) == [("v1", "s1", T0), ("v2", "s1", T0)]
    assert sorted(r.vehicle_uid for r in job.table("vehicle").collect()) == ["v1", "v2", "v9"]
    assert sorted((r.vehicle_uid, r.user_id) for r in job.table("access").collect()) == [("v1", "u1"), ("v2", "u2"), ("v9", "u9")]
    assert not os.listdir(f"{root}/tables/_work")


def test_state_without_lifetime_tells_the_first_row_and_runs_no_processor(spark, tmp_path):
    """Of a key the earliest row of the first trigger counts, also after a restart; only a lifetime needs the processor."""
    root = str(tmp_path)
    told = "kind string, id string, at bigint, value string"
    os.makedirs(f"{root}/in")

    def run(announce):
        def write(df, epoch):
            df.write.mode("overwrite").parquet(f"{root}/{announce}/epoch={epoch}")

        with S.keyed_state(spark):
            rows = spark.readStream.schema(told).parquet(f"{root}/in/*")
            found = S.first_told(rows, announce)
            assert "TransformWithState" not in found._jdf.queryExecution().analyzed().toString()
            found.writeStream.foreachBatch(write).outputMode(S.output_mode(None)).option("checkpointLocation", f"{root}/c{announce}").trigger(
                availableNow=True).start().awaitTermination()
        return sorted((r.epoch, r.kind, r.value) for r in spark.read.parquet(f"{root}/{announce}").collect())

    waves = [
        [("k", "a", 5, "late"), ("k", "a", 3, "z"), ("k", "a", 3, "y"), ("k", "b", None, None)],
        [("k", "a", 1, "too late"), ("k", "b", 9, "b"), ("k", None, 1, "n")],
        [("k", "a", None, None), ("k", "b", 1, "no")],
    ]
    for i, wave in enumerate(waves):
        spark.createDataFrame(wave, told).coalesce(1).write.parquet(f"{root}/in/w{i}")
        once, known = run(True), run(False)
    assert once == [(0, "k", "y"), (1, "k", "b"), (1, "k", "n")]
    assert known == [(0, "k", "y"), (1, "k", "b"), (1, "k", "n"), (1, "k", "y"), (2, "k", "b"), (2, "k", "y")]


def test_uploads_are_sent_by_as_many_tasks_as_they_have_partitions(spark, tmp_path):
    ups = spark.range(400).select(F.concat(F.lit("v"), "id").alias("vehicle_uid"), F.lit("b").alias("batch_id")).repartition(7)
    sent = QS._upload_folder(None, ups, f"{tmp_path}/a")
    QS._send(ups, str(tmp_path), 1)
    for path in (sent, f"{tmp_path}/uploads/wave1"):
        assert sum(f.endswith(".json") for f in os.listdir(path)) == 7 and spark.read.json(path).count() == 400


def test_only_hours_that_change_are_read_again(spark, tmp_path):
    """Late readings change their own hour and those that the carried state reaches; summaries equal a full pass at any time."""
    root, as_of = str(tmp_path), datetime(2024, 3, 1)
    base = as_of - timedelta(days=20)

    def reading(i, hour, minute, key, value):
        at = base + timedelta(hours=hour, minutes=minute)
        return (f"o{i}", "v", key, float(value), at, at + timedelta(minutes=i % 3), "OBD")

    rows, i = [], 0
    for hour in range(0, 60, 2):
        for minute in range(0, 60, 10):
            i += 1
            rows += [reading(10 * i, hour, minute, "distance.odometer", 1000 + 3 * i), reading(10 * i + 1, hour, minute, "ev.soc_pct", 95 - 0.4 * i)]
        rows += [reading(10 * i + 2, hour, 5, "environment.ambient_temp_c", hour % 30 - 5), reading(10 * i + 3, hour, 6, "speed.vehicle", hour * 3 % 120)] if hour % 8 == 0 else []
    schema = "observation_id string, vehicle_uid string, signal_key string, value_number double, observed_at timestamp, ingested_at timestamp, source string"
    late = [reading(99_001, 17, 30, "environment.ambient_temp_c", 2.0), reading(99_002, 20, 1, "ev.soc_pct", 60.0)]
    waves = [rows[40:], rows[:40], late]
    tf = timeframes(as_of)
    read_again = []
    for epoch, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).write.parquet(f"{root}/obs/epoch={epoch}")
        arrived = spark.read.schema(schema).parquet(f"{root}/obs/epoch={epoch}")
        obs = lambda: spark.read.schema(schema).parquet(f"{root}/obs")
        TR.update_summaries(arrived, epoch, root, obs)
        read_again.append(spark.read.parquet(f"{root}/ends/epoch={epoch}").count())
        found = TR._summaries(spark, root, arrived.select("vehicle_uid").distinct())
        filled = drive_steps(obs(), tf)
        as_rows = lambda df: sorted((tuple(x) for x in df.select(*sorted(df.columns)).collect()), key=str)
        assert as_rows(medians_of(labelled_points(found["points"], tf))) == as_rows(drive_medians(filled, tf))
        soc = found["ends"].where("soc is not null").select(*SLOT, F.col("soc.v").alias("soc"), F.col("soc.at").alias("soc_at"))
        got = as_rows(facts_of(found["facts"].drop("soc", "soc_at").unionByName(soc, allowMissingColumns=True), tf))
        want = as_rows(drive_facts(filled, tf))
        for a, b in zip(got, want, strict=True):
            assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    # the temperature of hour 17 enters hours 18 to 24; the SOC of hour 20 is not its last
    assert read_again[-1] == 2 + 4 - 1 and BUCKET_SECONDS == 3600


def test_sessions_come_from_kept_windows_and_few_days(spark, tmp_path):
    """Events in three micro-batches, stops before starts among them; later ones read the days of their windows only."""
    root, as_of = str(tmp_path), datetime(2024, 3, 1)
    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    waves = [
        [("v1", "s1", "start", day(1)), ("v1", "s2", "stop", day(20, 3)), ("v2", "s3", "start", day(50)), ("v1", None, "start", day(3))],
        [("v1", "s1", "stop", day(1, 2)), ("v1", "s2", "start", day(20)), ("v2", "s3", "start", day(49, 20)), ("v2", "s4", "stop", day(2))],
        [("v1", "s1", "start", day(1))] * 50 + [("v1", "s1", "stop", day(1, 5)), ("v2", "s3", "start", day(55))],
    ]
    schema = "vehicle_uid string, session_id string, event_type string, observed_at timestamp, session_type string"
    rows = [[(*r, "charging") for r in wave] for wave in waves]
    obs = spark.range(2 * 60 * 24).select(
        F.concat(F.lit("v"), (F.col("id") % 2 + 1).cast("string")).alias("vehicle_uid"), F.concat(F.lit("o"), "id").alias("observation_id"),
        F.when(F.col("id") % 4 < 2, C.CHARGE_POWER).otherwise(C.SOC).alias("signal_key"), (F.col("id") % 97).cast("double").alias("value_number"),
        F.lit(None).cast("string").alias("value_string"), F.timestamp_seconds(F.lit(int((T0 - datetime(1970, 1, 1)).total_seconds())) + F.floor(F.col("id") / 2) * 3600).alias("observed_at"),
    ).withColumn("ingested_at", F.col("observed_at"))
    obs.write.parquet(f"{root}/obs")
    seen = []

    def readings():
        seen.append(spark.read.parquet(f"{root}/obs"))
        return seen[-1]

    for i, wave in enumerate(rows):
        spark.createDataFrame(wave, schema).coalesce(1).write.parquet(f"{root}/events/w{i}")
        stream = spark.readStream.schema(schema).parquet(f"{root}/events/*")
        TR.sessions_stream(stream, root, readings, as_of, f"{root}/checkpoint").awaitTermination()
        so_far = spark.createDataFrame(sum(rows[: i + 1], []), schema)
        batch_twin = charging_sessions(spark.read.parquet(f"{root}/obs"), so_far, as_of).where("session_id IS NOT NULL")
        got, want = (sorted(map(str, df.select(*batch_twin.columns).collect())) for df in (TR.read_sessions(spark, root), batch_twin))
        assert got == want and len(want) == (2, 3, 3)[i]
    assert not os.listdir(f"{root}/_work")
    windows = spark.createDataFrame([(day(1), day(1, 5)), (day(9), day(10)), (day(11), None), (day(5), day(4))], "started_at timestamp, ended_at timestamp")
    d = lambda n: day(n).date()
    assert TR.days_of(windows, day(12)) == [(d(1), d(1)), (d(9), d(12))]
    assert TR.days_of(windows, day(12), most=1) == [(d(1), d(12))] and TR.days_of(windows.limit(0), day(12)) == []


def test_vehicles_of_cohorts_are_never_broadcast_uncounted(spark, tmp_path, monkeypatch):
    """Written catalogs and keys are small files with many rows, so a join of theirs is broadcast by count only."""
    as_of, root, plans = datetime(2024, 3, 1), str(tmp_path), {}
    vehicles = spark.createDataFrame(
        [(f"v{i}", "a" if i % 2 else "b", None, None, 2022) for i in range(6)], "vehicle_uid string, make string, model string, trim string, model_year bigint")
    cell = lambda v, key, value, bin_: (v, "30d", key, value, "score", "higher_is_better", 60, bin_, None, None)
    schema = "vehicle_uid string, timeframe string, kpi_key string, kpi_value double, kpi_unit string, direction string, sample_count bigint, temperature_bin string, baseline_temperature_bin string, compare_temperature_bin string"
    uids = [f"v{i}" for i in range(6)]
    scores = [cell(v, "charging_performance_score", 10.0 * i, "all") for i, v in enumerate(uids)]
    kept = [cell(v, key, 50.0 + i, "cold") for i, v in enumerate(uids) for key in ("cold_weather_range_retention", "cold_weather_charge_speed_retention")]
    K.stamp_kpi_rows(spark.createDataFrame(scores, schema), C.CHARGING, as_of).unionByName(
        K.stamp_kpi_rows(spark.createDataFrame(kept, schema), C.TEMPERATURE, as_of)).write.parquet(f"{root}/kpis/epoch=0")
    vehicles.select("vehicle_uid").write.parquet(f"{root}/refreshed/epoch=0")
    vehicles.write.parquet(f"{root}/catalog")
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def stage(df, name):
        plans[name] = plan_of(df)
        df.write.parquet(f"{root}/work/{name}")
        return spark.read.parquet(f"{root}/work/{name}")

    counted = TR.broadcast_if_small
    monkeypatch.setattr(TR, "broadcast_if_small", lambda df: counted(df, 0))
    catalog = spark.read.parquet(f"{root}/catalog")
    TR._rank_cohorts_of(catalog.where(F.col("make") == "a"), 0, root, catalog, as_of, 1, False, stage)
    assert set(plans) == {"cohorts", "members", "member_kpis"} and not any("BroadcastHashJoin" in p for p in plans.values())
    got = sorted((r.ranking_type, r.temperature_bin, r.vehicle_uid, r.rank_position) for r in TR.read_rankings(spark, root).collect())
    order = [("v1", 3), ("v3", 2), ("v5", 1)]
    assert got == [(C.CHARGING, "all", v, n) for v, n in order] + [(C.TEMPERATURE, b, v, n) for b in ("all", "cold") for v, n in order]
    kpis = spark.read.parquet(f"{root}/work/member_kpis")
    for scored in (R.score_vehicles(kpis, catalog), R.temperature_seeds(catalog, kpis)):
        assert re.search(r"SortMergeJoin \[vehicle_uid#\d+\]", plan_of(scored))


def test_stored_waves_leave_no_text(spark, tmp_path):
    """Disk holds the text of one wave at a time."""
    root = str(tmp_path)
    job = TI.Ingest(QS._wave_stream(SimpleNamespace(spark=spark), root), f"{root}/tables", B.registry(spark), f"{root}/checkpoint")
    rows = [batch(f"b{i}", f"v{i}", f"u{i}", 0, "", session_events=[EVENT]) for i in range(20)]
    QS._send(frame(spark, rows).withColumn("m", F.lit(0)), root, 1)
    left = lambda: [f for f in os.listdir(f"{root}/uploads/wave1") if f.endswith(".json")]
    assert left()
    job.drain()
    for _ in range(100):  # the files go in a thread of the stream's own
        if not left():
            break
        time.sleep(0.2)
    job.stop()
    assert not left() and job.table("receipts").where(~F.col("duplicate")).count() == 20


def test_shuffles_end_with_what_was_written(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for top in disk.localDirsString() for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, kept = files(), spark.conf.get(SHUFFLE_CLEANUP)
    with shuffles_end(spark):
        spark.range(1_000).repartition(5, "id").write.parquet(f"{tmp_path}/rows")
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP) == kept
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 1_000
