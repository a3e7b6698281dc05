"""Split operators against plain sequential code, with one key holding most rows."""

import random
from bisect import bisect_right
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from coverage_queries import kpis  # noqa: F401
from coverage_queries.base import QUERIES
from voltlane import constants as C
from voltlane.functions.scalars import timeframes
from voltlane.operators import series as S
from voltlane.operators.kpis import drive_facts, drive_medians
from voltlane.operators.ordering import DIGITS, PageIndex, distributed_rank, exact_median, order_bits, percentile_rank, running_totals
from voltlane.operators.series import drive_steps
from voltlane.operators.sessions import covering_blocks, observations_in_windows

START = datetime(2024, 1, 1)
AS_OF = datetime(2024, 2, 3)
TOKENS = ("7d", "30d", "90d")


def hot(rng, n):
    """Keys of which one holds about a third of all rows."""
    return ["hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}" for _ in range(n)]


def test_exact_median(spark):
    rng = random.Random(1)
    kinds = (lambda: rng.gauss(0, 50), lambda: rng.choice([0.0, 1.0, 7.5]), lambda: rng.uniform(9.999, 10.0), lambda: rng.expovariate(1e-4))
    rows = [(k, rng.choice(kinds)()) for k in hot(rng, 4000)] + [("nan", float("nan")), ("k1", float("inf")), ("one", 3.25)]
    got = {r.k: (r.median, r.n) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if abs(v) < 1e300:
            groups[k].append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k][0] == pytest.approx(median(vs), rel=1e-12) and got[k][1] == len(vs)


def test_exact_median_with_labels(spark):
    rng = random.Random(2)
    rows = [(k, rng.gauss(10, 3), [t for t in ("a", "b", "c") if rng.random() < 0.6]) for k in hot(rng, 1500)]
    df = spark.createDataFrame(rows, "k string, v double, l array<string>")
    got = {(r.k, r.timeframe): (r.median, r.n) for r in exact_median(df, ["k"], "v", labels="l").collect()}
    groups = defaultdict(list)
    for k, v, labels in rows:
        for t in labels:
            groups[(k, t)].append(v)
    assert got.keys() == groups.keys()
    assert all(got[g] == (pytest.approx(median(v)), len(v)) for g, v in groups.items())


def test_distributed_rank_with_many_ties(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([100.0, 0.0, round(rng.uniform(0, 100), 1), rng.uniform(0, 100)]), f"{i * 7919 % 100003:05d}")
            for i, k in enumerate(hot(rng, 3000))]
    got = {r.id: (r.rank_position, r.cohort_size) for r in distributed_rank(
        spark.createDataFrame(rows, "k string, s double, id string"), ["k"], "s", "id").collect()}
    groups = defaultdict(list)
    for k, s, i in rows:
        groups[k].append((-s, i))
    want = {i: (p, len(g)) for g in groups.values() for p, (_, i) in enumerate(sorted(g), 1)}
    assert got == want


def test_percentile_rank(spark):
    rng = random.Random(4)
    rows = [(i, k, rng.choice([1.0, 2.0, rng.uniform(0, 5)]), rng.choice(["higher_is_better", "lower_is_better"]))
            for i, k in enumerate(hot(rng, 2000))]
    groups = defaultdict(list)
    for _, k, v, _d in rows:
        groups[k].append(v)
    ordered = {k: sorted(v) for k, v in groups.items()}
    got = {r.i: r.percentile for r in percentile_rank(
        spark.createDataFrame(rows, "i int, k string, v double, d string"), ["k"], "v", "d").collect()}
    for i, k, v, d in rows:
        n = len(ordered[k])
        hits = bisect_right(ordered[k], v) if d == "higher_is_better" else sum(x >= v for x in ordered[k])
        assert got[i] == int(hits / n * 100.0 + 0.5)


def test_running_totals(spark):
    rng = random.Random(5)
    rows = [(k, START + timedelta(seconds=rng.randrange(10**6)), i, rng.randrange(100)) for i, k in enumerate(hot(rng, 2000))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, a int")
    got = {r.i: r.total for r in running_totals(df, ["k"], S.time_bucket(F.col("ts")), ["ts", "i"], {"total": F.col("a")}).collect()}
    sums, want = defaultdict(int), {}
    for k, _ts, i, a in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] += a
        want[i] = sums[k]
    assert got == want


def readings(rng, n):
    keys = [C.ODOMETER, C.SOC, C.SPEED, C.AMBIENT, C.REGEN, C.TRACTION]
    rows, odo, soc = [], defaultdict(lambda: 1000.0), defaultdict(lambda: 80.0)
    clock = defaultdict(lambda: START)
    for i, v in enumerate(hot(rng, n)):
        clock[v] += timedelta(seconds=rng.choice([20, 250, 400, 5000, 40000 if v != "hot" else 900]), microseconds=rng.randrange(10**6))
        for key in rng.sample(keys, rng.randrange(1, 4)):
            odo[v] += rng.uniform(0, 12)
            soc[v] = soc[v] - rng.uniform(0, 1.4) if soc[v] > 10 else 90.0
            value = {C.ODOMETER: odo[v], C.SOC: soc[v], C.SPEED: rng.uniform(0, 120), C.AMBIENT: rng.uniform(-15, 30),
                     C.REGEN: rng.uniform(-2, 40), C.TRACTION: rng.uniform(-2, 60)}[key]
            value = None if rng.random() < 0.05 else value
            for copy in range(2 if rng.random() < 0.1 else 1):
                rows.append((f"o{i}-{key}-{copy}", v, key, None if value is None else value + copy, clock[v],
                             clock[v] + timedelta(minutes=copy)))
    rng.shuffle(rows)
    return rows


def fold(rows, cutoff):
    """The drive KPIs' inputs of one vehicle by a plain sequential pass."""
    snaps = {}
    for _id, _v, key, value, ts, at in sorted(rows, key=lambda r: (r[5], r[0])):
        if ts >= cutoff:
            snap = snaps.setdefault(ts, {})
            if value is not None:
                snap[key] = value
    state, prev, tprev, power = {}, None, None, []
    out = {"km": [], "wh": [], "urban": [], "highway": [], "cold": [], "mild": [], "cold_km": 0.0, "points": 0, "regen": 0.0, "traction": 0.0}
    for ts in sorted(snaps):
        snap = snaps[ts]
        state.update({k: v for k, v in snap.items() if k in (C.ODOMETER, C.SOC, C.SPEED, C.AMBIENT)})
        if C.REGEN in snap or C.TRACTION in snap:
            power.append((int((ts - START).total_seconds()), snap.get(C.REGEN), snap.get(C.TRACTION)))
        odo, soc = state.get(C.ODOMETER), state.get(C.SOC)
        if odo is None or soc is None:
            continue
        if prev:
            km, used = odo - prev[0], prev[1] - soc
            if km > 0.05 and 0.05 < used < 30:
                wh = used / 100 * 75 * 1000 / km
                out["wh"].append(wh)
                if km / used < 50:
                    out["km"].append(km / used)
                speed = state.get(C.SPEED)
                if speed is not None and speed < 45:
                    out["urban"].append(wh)
                if speed is not None and speed >= 80:
                    out["highway"].append(wh)
        prev = (odo, soc)
        temp = state.get(C.AMBIENT)
        if temp is None:
            continue
        if tprev:
            km, used = odo - tprev[0], tprev[1] - soc
            if km > 0.05 and 0.05 < used < 30 and km / used < 50:
                out["points"] += 1
                if temp <= 5:
                    out["cold"].append(km / used)
                    out["cold_km"] += km
                if 15 < temp <= 25:
                    out["mild"].append(km / used)
        tprev = (odo, soc)
    for (t0, regen, traction), (t1, _r, _t) in zip(power, power[1:]):
        if 1 <= t1 - t0 <= 300:
            out["regen"] += max(regen or 0, 0) * (t1 - t0) / 3600 * 1000
            out["traction"] += max(traction or 0, 0) * (t1 - t0) / 3600 * 1000
    out["latest_soc"] = state.get(C.SOC)
    return out


def test_drive_series_equals_a_sequential_pass_per_timeframe(spark):
    rows = readings(random.Random(6), 2500)
    obs = spark.createDataFrame(rows, "observation_id string, vehicle_uid string, signal_key string, value_number double, "
                                      "observed_at timestamp, ingested_at timestamp")
    tf = timeframes(AS_OF, TOKENS)
    filled = S.drive_steps(obs, tf)
    medians = {(r.vehicle_uid, r.timeframe): r for r in drive_medians(filled, tf).collect()}
    facts = {(r.vehicle_uid, r.timeframe): r for r in drive_facts(filled, tf).collect()}
    by_vehicle = defaultdict(list)
    for r in rows:
        by_vehicle[r[1]].append(r)
    checked = 0
    for v, mine in by_vehicle.items():
        for t in tf:
            want = fold(mine, t.cutoff)
            m, f = medians.get((v, t.token)), facts[(v, t.token)]
            for s in ("km", "wh", "urban", "highway", "cold", "mild"):
                n = m[f"{s}_n"] if m else 0
                assert n == len(want[s]), (v, t.token, s)
                if n:
                    assert m[f"{s}_median"] == pytest.approx(median(want[s]))
                    checked += 1
            assert f.cold_km == pytest.approx(want["cold_km"]) and f.temp_points == want["points"]
            assert f.regen_wh == pytest.approx(want["regen"]) and f.traction_wh == pytest.approx(want["traction"])
            assert f.latest_soc == (pytest.approx(want["latest_soc"]) if want["latest_soc"] is not None else None)
    assert checked > 200


@pytest.mark.parametrize("share", [3, 100, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_counted_join_equals_a_plain_join(spark, monkeypatch, share, how):
    from voltlane.operators import skew

    monkeypatch.setattr(skew, "HOT_SHARE", share)
    big = spark.createDataFrame([(k, i) for i, k in enumerate(hot(random.Random(7), 900))], "k string, i int")
    facts = big.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m")).where(F.col("k") != "k3")
    rows = lambda df: sorted(map(str, df.select("k", "i", "n", "m").collect()))
    assert rows(skew.join_counted(big, facts, ["k"], "n", how)) == rows(big.join(facts, "k", how))


def test_pushdown_reaches_the_scan(spark, tmp_path):
    rows = readings(random.Random(8), 50)
    obs = spark.createDataFrame(rows, "observation_id string, vehicle_uid string, signal_key string, value_number double, "
                                      "observed_at timestamp, ingested_at timestamp").withColumn("unused", F.lit("x"))
    obs.write.parquet(str(tmp_path / "obs"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = S.drive_steps(spark.read.parquet(str(tmp_path / "obs")), timeframes(AS_OF))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans
    for scan in scans:
        assert "GreaterThanOrEqual(observed_at" in scan and "In(signal_key" in scan and "unused" not in scan


def test_order_bits(spark):
    import struct

    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0, 3.999999999, 4.0, 1e300, 1.7976931348623157e308, 100.0, 100.001, 1 / 3, 0.1, 8.0 - 2**-50]
    values += [-v for v in values]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", order_bits(F.col("v")).alias("b")).collect()}
    for v in values:
        assert abs(got[v]) == struct.unpack(">q", struct.pack(">d", abs(v)))[0] and (got[v] < 0) == (v < 0)


def test_median_of_values_that_lie_close_together(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("k").alias("k"), (100.0 + F.pmod(F.col("id") * 7919, F.lit(n)) / 1e8).alias("v"))
    spread = df.select(F.shiftright(order_bits(F.col("v")), DIGITS[1]).alias("b")).groupBy("b").count()
    assert spread.agg(F.max("count")).first()[0] < 100 and spread.count() > 1_000
    values = sorted(100.0 + i / 1e8 for i in range(n))
    got = exact_median(df, ["k"], "v").first()
    assert got.median == (values[n // 2 - 1] + values[n // 2]) / 2 and got.n == n


def test_median_whose_middles_part_at_every_digit(spark):
    rows = [("a", 1.0), ("a", 1e9), ("b", 100.0), ("b", 100.0000001), ("c", 1.0), ("c", 1.0), ("c", 2.0), ("c", 2.0), ("d", -1e-9), ("d", 1e-9), ("e", 7.0)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", digits=(60, 50, 40, 30, 20, 10)).collect()}
    assert got == {"a": (1.0 + 1e9) / 2, "b": (100.0 + 100.0000001) / 2, "c": 1.5, "d": 0.0, "e": 7.0}


def test_blocks_cover_a_window_once(spark):
    import random

    r = random.Random(4)
    pairs = [(a, a + r.choice([0, 1, 5, 30, 200, 8760, 90_000])) for a in (r.randint(0, 500_000) for _ in range(60))] + [(3, 4), (0, 15), (4, 7), (1, 14)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", covering_blocks(F.col("a"), F.col("b")).alias("c")).collect()
    for x in rows:
        covered = []
        for c in x.c:
            size = 4**c.level
            covered += [(c.block * size, (c.block + 1) * size - 1)]
        covered.sort()
        assert covered[0][0] == x.a and covered[-1][1] == x.b and all(p[1] + 1 == q[0] for p, q in zip(covered, covered[1:]))
        assert len(x.c) <= 45


def test_a_session_that_stays_open_meets_its_readings(spark):
    start = datetime(2024, 1, 1)
    windows = spark.createDataFrame(
        [("v", "open", start, None), ("v", "short", start + timedelta(hours=5), start + timedelta(hours=5, minutes=30)), ("w", "day", start, start + timedelta(days=1))],
        "vehicle_uid string, session_id string, started_at timestamp_ntz, ended_at timestamp_ntz")
    obs = spark.range(-50, 2_000).select(
        F.when(F.col("id") % 2 == 0, "v").otherwise("w").alias("vehicle_uid"), F.col("id").cast("string").alias("observation_id"), F.lit("ev.soc_pct").alias("signal_key"),
        F.lit(1.0).alias("value_number"), F.lit(None).cast("string").alias("value_string"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int") * 5)).alias("observed_at")).withColumn("ingested_at", F.col("observed_at"))
    got = observations_in_windows(obs, windows, datetime(2025, 1, 1))
    n = {r.session_id: r["count"] for r in got.groupBy("session_id").count().collect()}
    assert n == {"open": sum(1 for i in range(0, 2_000, 2) if i * 5 <= 366 * 24), "day": sum(1 for i in range(1, 2_000, 2) if i * 5 <= 24)}
    assert got.select("session_id", "observation_id").distinct().count() == got.count()


def test_drive_steps_shuffle_readings_once(spark):
    obs = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").cast("string").alias("vehicle_uid"), F.lit("ev.soc_pct").alias("signal_key"), F.col("value").alias("value_number"),
        F.col("ts").alias("observed_at"), F.col("ts").alias("ingested_at"), F.col("event_id").cast("string").alias("observation_id"))
    plan = drive_steps(obs, timeframes(datetime(2024, 3, 1)))._jdf.queryExecution().executedPlan().toString()
    # readings are dealt once for the steps and, the same way, once for what enters each hour; the rest are hour ends
    big = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_COL" in line]
    assert len(big) == 2 and len({line[line.index("Exchange"):].split(", [plan_id")[0].split("#")[0] for line in big}) == 1
    assert "observed_at" not in "".join(line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_pages_of_an_order_are_read_from_their_ranges(spark):
    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.34 else rng.randrange(2, 900), f"c{rng.randrange(9)}", f"v{i:05d}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "rank_position long, cohort_key string, vehicle_uid string").withColumn("_n", F.lit(1))
    index = PageIndex.write(df, ["rank_position", "cohort_key", "vehicle_uid"])
    ordered, sizes = sorted(rows), spark.read.parquet(f"{index.folder}/sizes").orderBy("_range").collect()
    assert index.size() == len(rows) and len(sizes) > 1 and max(r.n for r in sizes) < len(rows) / 2
    cut = sizes[1].before
    for offset, limit in ((0, 5), (cut - 3, 6), (cut, 1), (12_345, 100), (19_990, 100), (20_000, 5), (10**9, 5)):
        page = index.page(offset, limit)
        assert page.columns == df.columns and sorted(tuple(r)[:3] for r in page.collect()) == ordered[offset : offset + limit]
    plan = index.page(12_345, 100)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan
    again = PageIndex(spark, index.folder, index.order)  # as a later request opens it
    assert [tuple(r)[:3] for r in again.page(cut - 3, 6).collect()] == ordered[cut - 3 : cut + 3]


def test_pages_of_no_rows(spark):
    index = PageIndex.write(spark.createDataFrame([], "a long, b string"), ["a", "b"])
    assert index.size() == 0 and index.page(0, 10).collect() == [] and index.page(0, 10).columns == ["a", "b"]


def _median_rows():
    rng = random.Random(6)
    rows = [(k, rng.choice([rng.gauss(0, 50), 7.5, -0.0]), [t for t in ("a", "b") if rng.random() < 0.7]) for k in hot(rng, 1200)]
    return [*rows, (None, 1.0, ["a"]), ("z", -0.0, ["a"]), ("z", 0.0, ["b"]), ("nan", float("nan"), ["a"])]


@pytest.mark.parametrize("labels", [None, "l"])
def test_median_is_the_same_by_sort_and_by_digits(spark, labels):
    df = spark.createDataFrame(_median_rows(), "k string, v double, l array<string>")
    cells = lambda large: sorted(map(str, exact_median(df, ["k"], "v", labels=labels, large=large).collect()))
    by_digits = cells(0)
    assert by_digits and by_digits == cells(100) == cells(10_000) and not any("None" in c or "nan" in c for c in by_digits)


def test_median_of_small_keys_takes_one_shuffle_of_the_values(spark):
    df = spark.createDataFrame(_median_rows(), "k string, v double, l array<string>")
    plan = exact_median(df, ["k"], "v", labels="l")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_blocks_of_windows_are_computed_once(spark):
    windows = spark.createDataFrame([("v1", "s1", START, START + timedelta(days=40))], "vehicle_uid string, session_id string, started_at timestamp, ended_at timestamp")
    obs = spark.createDataFrame(
        [("v1", f"o{i}", C.SOC, 50.0, None, START + timedelta(days=i), START) for i in range(45)],
        "vehicle_uid string, observation_id string, signal_key string, value_number double, value_string string, observed_at timestamp, ingested_at timestamp",
    )
    got = observations_in_windows(obs, windows, AS_OF)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 41


def test_readings_of_drive_steps_are_scanned_and_dealt_once(spark, tmp_path):
    """The state of earlier buckets and the steps inside them come from one exchange; rows without a vehicle or instant have no steps."""
    at = datetime(2024, 1, 1)
    rows = [(f"v{i % 3}", at + timedelta(minutes=7 * i), key, float(i), at, f"{i}-{key}") for i in range(60) for key in (C.ODOMETER, C.SOC)]
    rows += [(None, at, C.SOC, 1.0, at, "a"), ("v0", None, C.SOC, 1.0, at, "b")]
    spark.createDataFrame(rows, "vehicle_uid string, observed_at timestamp_ntz, signal_key string, value_number double, ingested_at timestamp_ntz, observation_id string").write.parquet(f"{tmp_path}/obs")
    steps = S.carry_forward(S.pivot_snapshots(spark.read.parquet(f"{tmp_path}/obs"), {"odo": C.ODOMETER, "soc": C.SOC}), ["odo", "soc"])
    found = steps.collect()
    assert len(found) == 60 and sum(r.prev_odo is None for r in found) == 3
    final = steps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_scoring_reads_written_kpis(spark, tmp_path):
    """Neither medians nor readings are worked out again for the newest instants of the KPIs and for the rows that carry them."""
    events = [(i, START + timedelta(hours=i), i % 2, ("view", "error", "click", "purchase")[i // 2 % 4], 5.0 + i, f'{{"k": {i % 7}}}') for i in range(160)]
    tables = {
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "customer": ([(i, f"c{i}", 1, 0.0, "BUILDING") for i in range(2)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(1, "n", 2)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(2, "r")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    scored = QUERIES["g03_score_vehicles"](spark, str(tmp_path))
    assert {r.vehicle_uid for r in scored.collect()} == {"veh-0", "veh-1"}
    # medians are taken of ranks in a window; where the KPIs are written, none is left in the plan
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
