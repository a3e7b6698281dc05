"""Sessions, KPIs, rankings, sinks."""

from datetime import timedelta

from pyspark.sql import functions as F

from voltlane import constants as C
from voltlane.functions.scalars import timeframes
from voltlane.operators import kpis as K
from voltlane.operators import rankings as R
from voltlane.operators import sessions as X
from voltlane.plans import recompute as P
from voltlane.session import table_stage, work_folder
from voltlane.sources import sinks
from voltlane.sources.snapshots import Snapshots

from .base import ALL_TOKENS, AS_OF, clamp_sql, confidence_sql, register, rounded

KPI_COLUMNS = [
    "vehicle_uid", "ranking_type", "timeframe", "kpi_key", "kpi_value", "kpi_unit", "direction", "confidence_level",
    "sample_count", "temperature_bin", "baseline_temperature_bin", "compare_temperature_bin",
]
KPI_SQL = ", ".join("round(kpi_value, 6) AS kpi_value" if c == "kpi_value" else c for c in KPI_COLUMNS)
RANK_COLUMNS = [
    "ranking_type", "timeframe", "temperature_bin", "cohort_key", "cohort_size", "sample_gate_passed", "vehicle_uid",
    "rank_position", "score", "confidence_level",
]
RANK_SQL = ", ".join("round(score, 6) AS score" if c == "score" else c for c in RANK_COLUMNS)


# ---- sessions -------------------------------------------------------------------------------
@register("c01_session_windows", "SELECT * FROM win")
def session_windows(s):
    return X.session_windows(s.session_events())


@register("c02_observations_in_windows", """
SELECT session_id, vehicle_uid, observation_id, signal_key, observed_at, round(value_number, 6) AS value_number FROM inwin""")
def observations_in_windows(s):
    rows = X.observations_in_windows(s.obs(), X.session_windows(s.session_events()), AS_OF)
    return rounded(rows.select("session_id", "vehicle_uid", "observation_id", "signal_key", "observed_at", "value_number"))


def _sessions(name, cols):
    sql = ", ".join(f"round({c}, 6) AS {c}" if c.endswith(("_pct", "_kw", "_kwh", "_c")) else c for c in cols)

    @register(name, f"SELECT session_id, vehicle_uid, {sql} FROM sess")
    def query(s):
        return rounded(s.sessions().select("session_id", "vehicle_uid", *cols))


_sessions("c03_session_soc", ["soc_start_pct", "soc_end_pct", "soc_delta_pct"])
_sessions("c04_session_power", ["avg_charge_power_kw", "peak_charge_power_kw", "sample_count"])
_sessions("c05_session_temperature", ["ambient_temp_avg_c", "battery_temp_avg_c", "temperature_bin"])
_sessions("c06_session_charger_type", ["charger_type"])
_sessions("c07_session_energy_status", ["started_at", "ended_at", "status", "energy_added_kwh"])


@register("c08_charge_power_buckets", """
SELECT vehicle_uid, timeframe, round(all_kw, 6) AS all_kw, all_n, round(cold_kw, 6) AS cold_kw, cold_n, round(mild_kw, 6) AS mild_kw, mild_n FROM cbuck""")
def charge_power_buckets(s):
    return rounded(K.charge_power_buckets(s.sessions(), s.tf()))


# ---- KPI families -----------------------------------------------------------------------------
def _range_key(name, keys, src="kpi_range4", divisor=1):
    listed = ", ".join(f"'{k}'" for k in keys)
    tokens = ALL_TOKENS if src == "kpi_range4" else None

    @register(name, f"SELECT {KPI_SQL} FROM {src} WHERE kpi_key IN ({listed})")
    def query(s):
        rows = K.range_kpis(s.steps(tokens, divisor), AS_OF, s.tf(tokens), real_storage=True)
        return rounded(rows.where(F.col("kpi_key").isin(*keys)).select(*KPI_COLUMNS))


_range_key("k01_net_energy_efficiency", ["ev_net_energy_efficiency"])
_range_key("k02_estimated_practical_range", ["ev_estimated_practical_range"])
_range_key("k03_soc_depletion", ["soc_depletion_rate_per_100km"])
_range_key("k04_range_efficiency_score", ["ev_range_efficiency_score"])
_range_key("k05_urban_efficiency", ["ev_urban_efficiency"])
_range_key("k06_highway_efficiency", ["ev_highway_efficiency"])
_range_key("k07_regeneration_ratio", ["regeneration_recovery_ratio"], "kpi_rangec", 300)


@register("k08_range_kpi_rows", f"SELECT {KPI_SQL} FROM kpi_range")
def range_rows(s):
    return rounded(K.range_kpis(s.steps(), AS_OF, s.tf(), real_storage=True).select(*KPI_COLUMNS))


@register("k09_k10_k11_charging_kpis", f"SELECT {KPI_SQL} FROM kpi_charge")
def charging_rows(s):
    return rounded(K.charging_kpis(s.sessions(), AS_OF, s.tf(), real_storage=True).select(*KPI_COLUMNS))


@register("k12_range_gate", """
SELECT vehicle_uid, timeframe, cold_km >= 20 AND mild_km >= 20 AS passed FROM tbuck""")
def range_gate(s):
    passed = (F.col("cold_km") >= 20.0) & (F.col("mild_km") >= 20.0)
    return s.facts().where(F.col("temp_points") > 0).select("vehicle_uid", "timeframe", passed.alias("passed"))


@register("k13_k16_temperature_kpis", f"SELECT {KPI_SQL} FROM kpi_temp")
def temperature_rows(s):
    return rounded(K.temperature_kpis(s.steps(), s.sessions(), AS_OF, s.tf(), real_storage=True).select(*KPI_COLUMNS))


@register("h01_dtc_count", """
SELECT vehicle_uid, timeframe, count(DISTINCT code) AS dtc_count FROM diag JOIN tf4 ON observed_at >= cutoff
WHERE event_type = 'DTC_ACTIVE' GROUP BY ALL""")
def dtc_count(s):
    return K.dtc_count(s.diagnostics(), s.tf(ALL_TOKENS))


@register("h02_latest_mil", """
SELECT vehicle_uid, timeframe, arg_max(event_type, observed_at) AS mil FROM diag JOIN tf4 ON observed_at >= cutoff
WHERE event_type LIKE 'MIL%' GROUP BY ALL""")
def latest_mil(s):
    return K.latest_mil(s.diagnostics(), s.tf(ALL_TOKENS))


@register("h03_health_penalty", """
SELECT vehicle_uid, timeframe, CAST(penalty AS DOUBLE) AS ev_health_modifier_penalty, health_n FROM pen""")
def health_penalty(s):
    return K.health_penalty(s.vehicles(), s.diagnostics(), s.tf())


@register("h04_latest_kpi", """
SELECT vehicle_uid, timeframe, round(CAST(score AS FLOAT)::DOUBLE, 6) AS value, n AS samples FROM rngk""")
def latest_kpi(s):
    rows = K.range_kpis(s.steps(), AS_OF, s.tf(), real_storage=True)
    return rounded(K.latest_kpi(rows, C.RANGE, "ev_range_efficiency_score"))


def _base_kpis(s):
    return K.range_kpis(s.steps(), AS_OF, s.tf(), real_storage=True).unionByName(K.charging_kpis(s.sessions(), AS_OF, s.tf(), real_storage=True))


@register("k17_k19_composite_kpis", f"SELECT {KPI_SQL} FROM kpi_comp")
def composite_rows(s):
    rows = K.composite_kpis(_base_kpis(s), s.vehicles(), s.diagnostics(), AS_OF, s.tf(), real_storage=True)
    return rounded(rows.select(*KPI_COLUMNS))


# ---- rankings -------------------------------------------------------------------------------------
@register("g01_vehicle_catalog", "SELECT * FROM cat_veh")
def vehicle_catalog(s):
    return R.vehicle_catalog(s.vehicles())


def _history(s):
    """Charging KPI snapshots of two runs: an older one with shifted values, and the current one."""
    now = K.charging_kpis(s.sessions(), AS_OF, s.tf(), real_storage=True)
    older = now.where(F.col("kpi_key") != "charging_performance_score").withColumn(
        "computed_at", F.col("computed_at") - F.expr("INTERVAL 1 DAY")).withColumn("kpi_value", F.col("kpi_value") + 1.0)
    only_old = now.where((F.col("kpi_key") == "charging_performance_score") & (F.col("sample_count") < 2)).withColumn(
        "computed_at", F.col("computed_at") - F.expr("INTERVAL 1 DAY"))
    kept = now.where(~((F.col("kpi_key") == "charging_performance_score") & (F.col("sample_count") < 2)))
    return kept.unionByName(older).unionByName(only_old)


@register("g02_latest_kpis", f"""
SELECT vehicle_uid, timeframe, kpi_key, round(kpi_value, 6) AS kpi_value,
  CASE WHEN kpi_key = 'charging_performance_score' AND sample_count < 2 THEN TIMESTAMP '{AS_OF:%Y-%m-%d}' - INTERVAL 1 DAY
       ELSE TIMESTAMP '{AS_OF:%Y-%m-%d}' END AS computed_at FROM kpi_charge""")
def latest_kpis(s):
    return rounded(R.latest_kpis(_history(s)).select("vehicle_uid", "timeframe", "kpi_key", "kpi_value", "computed_at"))


def _written(s, kpi):
    """KPI rows written once: scoring reads them twice, for the newest instants and for the rows that carry them."""
    return table_stage(s.spark)(kpi, "scored_kpis")


@register("g03_score_vehicles", """
SELECT ranking_type, timeframe, cohort_key, vehicle_uid, round(score, 6) AS score, confidence_level FROM scored
WHERE ranking_type <> 'ev_composite'""")
def score_vehicles(s):
    return rounded(R.score_vehicles(_written(s, _base_kpis(s)), s.vehicles()).drop("temperature_bin"))


@register("g04_rank_cohorts", f"SELECT {RANK_SQL} FROM rank_plain WHERE ranking_type = 'ev_range_efficiency'")
def rank_cohorts(s):
    scored = R.score_vehicles(_written(s, K.range_kpis(s.steps(), AS_OF, s.tf(), real_storage=True)), s.vehicles())
    return rounded(R.rank_cohorts(scored, AS_OF, real_storage=True).select(*RANK_COLUMNS))


@register("g04_rank_orders_by_status", """
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS rank_position,
       count(*) OVER (PARTITION BY o_orderstatus) AS cohort_size FROM orders""")
def rank_orders(s):
    from voltlane.operators.ordering import distributed_rank

    rows = s.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderkey").cast("string").alias("id"))
    ranked = distributed_rank(rows, ["o_orderstatus"], "o_totalprice", "id")
    return ranked.select("o_orderkey", "o_orderstatus", "rank_position", "cohort_size")


def _temperature(s):
    return K.temperature_kpis(s.steps(), s.sessions(), AS_OF, s.tf(), real_storage=True)


@register("g05_temperature_seeds", """
SELECT vehicle_uid, timeframe, cohort_key, round(range_retention, 6) AS range_retention, round(sensitivity, 6) AS sensitivity,
       round(charge_retention, 6) AS charge_retention, round(score, 6) AS score, confidence_level FROM seeds""")
def temperature_seeds(s):
    return rounded(R.temperature_seeds(s.vehicles(), _temperature(s)))


@register("g06_rank_temperature", f"SELECT {RANK_SQL} FROM rank_temp")
def rank_temperature(s):
    return rounded(R.rank_temperature(R.temperature_seeds(s.vehicles(), _temperature(s)), AS_OF, real_storage=True).select(*RANK_COLUMNS))


def _staged(s):
    return P.recompute(s.tables(), AS_OF, real_storage=True, stage=table_stage(s.spark))


@register("g07_recompute_rankings", f"SELECT {RANK_SQL} FROM ranks")
def recompute_rankings(s):
    return rounded(_staged(s).rankings.select(*RANK_COLUMNS))


@register("g07_recompute_kpis", f"SELECT {KPI_SQL} FROM kpi")
def recompute_kpis(s):
    return rounded(_staged(s).kpis.select(*KPI_COLUMNS))


# ---- sinks ----------------------------------------------------------------------------------------------
@register("s08_upsert_sessions", f"""
SELECT session_id, vehicle_uid, status, round(avg_charge_power_kw, 6) AS avg_charge_power_kw,
  TIMESTAMP '{AS_OF:%Y-%m-%d}' - CASE WHEN started_at < TIMESTAMP '2024-01-16' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS created_at,
  TIMESTAMP '{AS_OF:%Y-%m-%d}' AS updated_at FROM sess""")
def upsert_sessions(s):
    new = s.sessions()
    day = F.expr("INTERVAL 1 DAY")
    old = new.where(F.col("started_at") < F.lit("2024-01-16").cast("timestamp_ntz")).withColumn(
        "created_at", F.col("created_at") - day).withColumn("updated_at", F.col("updated_at") - day).withColumn(
        "avg_charge_power_kw", F.lit(0.0)).withColumn("status", F.lit("partial"))
    return rounded(X.upsert_sessions(old, new).select(
        "session_id", "vehicle_uid", "status", "avg_charge_power_kw", "created_at", "updated_at"))


@register("s09_replace_kpis", f"""
SELECT {KPI_SQL} FROM kpi_charge UNION ALL
SELECT {KPI_SQL} FROM (SELECT * REPLACE (kpi_value + 1 AS kpi_value) FROM kpi_range)""")
def replace_kpis(s):
    """Charging rows written twice (second run wins), range rows of the first run stay."""
    store = Snapshots(s.spark, work_folder(s.spark, "kpis"))
    rng, chg = K.range_kpis(s.steps(), AS_OF, s.tf(), real_storage=True), K.charging_kpis(s.sessions(), AS_OF, s.tf(), real_storage=True)
    shifted = rng.unionByName(chg).withColumn("kpi_value", F.col("kpi_value") + 1.0)
    for family in (C.RANGE, C.CHARGING):
        sinks.replace_kpis(shifted.where(F.col("ranking_type") == family), family, store)
    sinks.replace_kpis(chg, C.CHARGING, store)
    return rounded(sinks.read_kpis(store).select(*KPI_COLUMNS))


@register("s10_replace_rankings", f"""
SELECT {RANK_SQL} FROM (SELECT * REPLACE (CASE WHEN timeframe = '180d' THEN score + 1 ELSE score END AS score) FROM rank_plain
WHERE ranking_type = 'ev_charging_performance' AND timeframe <> '30d')""")
def replace_rankings(s):
    """All timeframes written shifted, then all but 180d replaced, then 30d emptied; 180d stays from the first write."""
    store = Snapshots(s.spark, work_folder(s.spark, "rankings"))
    kpi = _written(s, K.charging_kpis(s.sessions(), AS_OF, s.tf(), real_storage=True))
    ranked = R.rank_cohorts(R.score_vehicles(kpi, s.vehicles()), AS_OF, real_storage=True)
    sinks.replace_rankings(ranked.withColumn("score", F.col("score") + 1.0), store)
    sinks.replace_rankings(ranked.where(F.col("timeframe") != "180d"), store)
    sinks.replace_rankings(ranked.where(F.lit(False)), store, [C.CHARGING], ["30d"])
    return rounded(sinks.read_rankings(store).select(*RANK_COLUMNS))


@register("s12_run_summary", """
SELECT (SELECT count(*) FROM sess) AS charging_sessions_upserted, (SELECT count(*) FROM kpi) AS kpi_rows_upserted,
       (SELECT count(*) FROM ranks) AS ranking_rows_upserted, (SELECT count(*) FROM veh) AS recomputed_vehicles""")
def run_summary(s):
    return _staged(s).summary()


@register("g07_published_runs", f"""
SELECT session_id, vehicle_uid, status, round(avg_charge_power_kw, 6) AS avg_charge_power_kw,
  TIMESTAMP '{AS_OF:%Y-%m-%d}' - CASE WHEN CAST(replace(vehicle_uid, 'veh-', '') AS BIGINT) % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS created_at,
  TIMESTAMP '{AS_OF:%Y-%m-%d}' AS updated_at, NULL AS kpi_key, NULL AS timeframe, NULL AS value FROM sess
UNION ALL SELECT NULL, vehicle_uid, NULL, NULL, NULL, NULL, kpi_key || ' ' || temperature_bin, timeframe, round(kpi_value, 6) FROM kpi
UNION ALL SELECT NULL, vehicle_uid, ranking_type, NULL, NULL, NULL, cohort_key || ' ' || temperature_bin, timeframe, CAST(rank_position AS DOUBLE) FROM ranks""")
def published_runs(s):
    """Two stored runs: the first, a day earlier, knows every second vehicle only; the second keeps its sessions' creation instants."""
    store = Snapshots(s.spark, work_folder(s.spark, "published"))
    number = F.regexp_extract("vehicle_uid", r"(\d+)$", 1).cast("bigint")
    even = P.Tables(*[df.where(number % 2 == 0) for df in (s.vehicles(), s.obs(), s.session_events(), s.diagnostics())])
    P.recompute_and_publish(even, AS_OF - timedelta(days=1), store, table_stage(s.spark), real_storage=True)
    P.recompute_and_publish(s.tables(), AS_OF, store, table_stage(s.spark), real_storage=True)
    none = lambda kind: F.lit(None).cast(kind)
    cells = ("session_id", "string"), ("vehicle_uid", "string"), ("status", "string"), ("avg_charge_power_kw", "double"), ("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"), ("kpi_key", "string"), ("timeframe", "string"), ("value", "double")
    rows = lambda df, **own: df.select(*[own.get(c, none(kind)).cast(kind).alias(c) for c, kind in cells])
    col = F.col
    return rounded(
        rows(store.read("sessions"), **{c: col(c) for c, _ in cells[:6]})
        .unionByName(rows(sinks.read_kpis(store), vehicle_uid=col("vehicle_uid"), kpi_key=F.concat_ws(" ", "kpi_key", "temperature_bin"), timeframe=col("timeframe"), value=col("kpi_value")))
        .unionByName(rows(sinks.read_rankings(store), vehicle_uid=col("vehicle_uid"), status=col("ranking_type"), kpi_key=F.concat_ws(" ", "cohort_key", "temperature_bin"), timeframe=col("timeframe"), value=col("rank_position"))))
