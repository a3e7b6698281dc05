"""Reads, quality checks and documented extras."""

from datetime import timedelta

from pyspark.sql import functions as F

from voltlane import constants as C
from voltlane.config import TemperatureGates
from voltlane.operators import design as D
from voltlane.operators import quality as V
from voltlane.operators import reads as Q
from voltlane.plans import recompute as P
from voltlane.session import table_stage, work_folder
from voltlane.sources import sinks

from .base import AS_OF, CTES, clamp_sql, register, rounded
from .ingest import uploads
from .kpis import RANK_COLUMNS, RANK_SQL

_SNAPSHOTS: dict = {}


def snapshots(s):
    """Derived tables of one recompute, written once per session and folder, then read back."""
    key = (s.spark.sparkContext.applicationId, s.sf_dir)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = P.recompute(s.tables(), AS_OF, real_storage=True, stage=table_stage(s.spark))
    return _SNAPSHOTS[key]


READ_SQL = "vehicle_uid, kpi_key, round(kpi_value, 6) AS value, kpi_unit AS unit, direction, confidence_level, sample_count"


@register("q01_kpis_range", f"SELECT {READ_SQL} FROM kpi_range WHERE timeframe = '90d'")
def kpis_range(s):
    return rounded(Q.kpis_range(snapshots(s).kpis, timeframe="90d"))


@register("q02_kpis_charging", f"SELECT {READ_SQL} FROM kpi_charge WHERE timeframe = '30d'")
def kpis_charging(s):
    return rounded(Q.kpis_charging(snapshots(s).kpis))


CTES["tcohort"] = """
SELECT k.*, coalesce(make, 'unknown') AS make2, coalesce(model, 'unknown') AS model2 FROM kpi_temp k JOIN veh v USING (vehicle_uid)
WHERE timeframe = '90d' AND temperature_bin = 'cold'"""


@register("q03_kpis_temperature_impact", f"""
SELECT vehicle_uid, kpi_key, value, unit, direction, confidence_level, sample_count, percentile, max(n) OVER (PARTITION BY vehicle_uid) AS cohort_size FROM (
  SELECT {READ_SQL}, count(*) OVER c AS n,
    CAST(floor(100.0::DOUBLE * CASE WHEN direction = 'higher_is_better' THEN count(*) OVER (PARTITION BY make2, model2, kpi_key ORDER BY kpi_value RANGE UNBOUNDED PRECEDING)
      ELSE count(*) OVER (PARTITION BY make2, model2, kpi_key ORDER BY kpi_value DESC RANGE UNBOUNDED PRECEDING) END / count(*) OVER c + 0.5) AS BIGINT) AS percentile
  FROM tcohort WINDOW c AS (PARTITION BY make2, model2, kpi_key))""")
def kpis_temperature_impact(s):
    return rounded(Q.kpis_temperature_impact(snapshots(s).kpis, s.vehicles()))


CTES["evid"] = """
SELECT vehicle_uid, timeframe, coalesce(cold_km, 0) AS cold_distance_km, coalesce(mild_km, 0) AS mild_distance_km,
  coalesce(cold_n, 0) AS cold_charge_sessions, coalesce(mild_n, 0) AS mild_charge_sessions
FROM (SELECT vehicle_uid, timeframe,
        max(value_number) FILTER (WHERE temperature_bin <> 'mild') - min(value_number) FILTER (WHERE temperature_bin <> 'mild') AS cold_km,
        max(value_number) FILTER (WHERE temperature_bin = 'mild') - min(value_number) FILTER (WHERE temperature_bin = 'mild') AS mild_km
      FROM obs JOIN tf ON observed_at >= cutoff WHERE signal_key = 'distance.odometer' AND temperature_bin IN ('cold', 'very_cold', 'mild') GROUP BY ALL) d
FULL JOIN (SELECT vehicle_uid, timeframe, count(*) FILTER (WHERE temperature_bin IN ('cold', 'very_cold')) AS cold_n,
        count(*) FILTER (WHERE temperature_bin = 'mild') AS mild_n FROM sess JOIN tf ON started_at >= cutoff GROUP BY ALL) c USING (vehicle_uid, timeframe)"""
GATES = TemperatureGates(cold_km=150.0, mild_km=150.0)
CTES["miss"] = """
SELECT v.vehicle_uid, t.timeframe, concat_ws(';', CASE WHEN coalesce(cold_distance_km, 0) < 150 THEN 'cold_distance_km<150.0' END,
  CASE WHEN coalesce(mild_distance_km, 0) < 150 THEN 'mild_distance_km<150.0' END,
  CASE WHEN coalesce(cold_charge_sessions, 0) < 1 THEN 'cold_charging_sessions<1' END,
  CASE WHEN coalesce(mild_charge_sessions, 0) < 1 THEN 'mild_charging_sessions<1' END) AS missing
FROM veh v CROSS JOIN tf t LEFT JOIN evid e ON e.vehicle_uid = v.vehicle_uid AND e.timeframe = t.timeframe"""


@register("q04_readiness", """
SELECT *, CASE WHEN missing_requirements <> '' OR confidence_level = 'none' THEN 'not_ready' WHEN confidence_level = 'preview' THEN 'preview' ELSE 'ready' END AS status FROM (
  SELECT m.vehicle_uid, m.timeframe, f.ranking_type, coalesce(level, 'none') AS confidence_level, coalesce(samples, 0) AS sample_count,
    CASE WHEN f.ranking_type = 'ev_temperature_impact' THEN concat_ws(';', nullif(missing, ''), CASE WHEN level IS NULL THEN 'temperature_kpis_missing' END)
         WHEN level IS NULL THEN 'kpi_snapshots_missing' ELSE '' END AS missing_requirements
  FROM miss m CROSS JOIN (VALUES ('ev_range_efficiency'), ('ev_charging_performance'), ('ev_composite'), ('ev_temperature_impact')) AS f(ranking_type)
  LEFT JOIN (SELECT vehicle_uid, timeframe, ranking_type, max(sample_count) AS samples,
      CASE WHEN bool_or(confidence_level = 'preview') THEN 'preview' WHEN bool_or(confidence_level = 'medium') THEN 'medium' ELSE 'stable' END AS level
    FROM kpi WHERE temperature_bin = CASE WHEN ranking_type = 'ev_temperature_impact' THEN 'cold' ELSE 'all' END GROUP BY ALL) k
  ON k.vehicle_uid = m.vehicle_uid AND k.timeframe = m.timeframe AND k.ranking_type = f.ranking_type)""")
def readiness(s):
    snap = snapshots(s)
    evidence = Q.gate_evidence(s.obs(), snap.sessions, s.tf())
    rows = Q.readiness(snap.kpis, s.vehicles(), evidence, s.tf(), GATES)
    return rows.withColumn("missing_requirements", F.array_join("missing_requirements", ";"))


@register("q05_gate_evidence", """
SELECT vehicle_uid, timeframe, round(cold_distance_km, 6) AS cold_distance_km, round(mild_distance_km, 6) AS mild_distance_km,
  cold_charge_sessions, mild_charge_sessions FROM evid""")
def gate_evidence(s):
    return rounded(Q.gate_evidence(s.obs(), s.sessions(), s.tf()))


@register("q06_missing_requirements", """
SELECT e.vehicle_uid, e.timeframe, missing FROM evid e JOIN miss m ON e.vehicle_uid = m.vehicle_uid AND e.timeframe = m.timeframe""")
def missing_requirements(s):
    rows = Q.gate_evidence(s.obs(), s.sessions(), s.tf())
    return rows.select("vehicle_uid", "timeframe", F.array_join(Q.missing_requirements(GATES), ";").alias("missing"))


def _page_sql(limit, offset):
    return f"""
SELECT {RANK_SQL}, count(*) OVER () >= {limit} AS has_more FROM (
  SELECT r.* FROM rank_plain r JOIN veh v USING (vehicle_uid)
  WHERE r.ranking_type = 'ev_range_efficiency' AND r.timeframe = '90d' AND vehicle_uid IN (SELECT vehicle_uid FROM acc WHERE user_id = 'user-3')
  ORDER BY rank_position, cohort_key, vehicle_uid LIMIT {limit} OFFSET {offset})"""


def _page(s, limit, offset):
    page = Q.ranking_page(snapshots(s).rankings, s.vehicles(), s.access(), "user-3", C.RANGE, "90d", limit=limit, offset=offset)
    return rounded(page.select(*RANK_COLUMNS, "has_more"))


@register("q07_ranking_page", _page_sql(5, 1))
def ranking_page(s):
    return _page(s, 5, 1)


@register("q07_last_page", _page_sql(100, 2))
def last_page(s):
    return _page(s, 100, 2)


def _deep_page_sql(page):
    return f"""
SELECT {RANK_SQL}, count(*) OVER () >= 20 AS has_more FROM (
  SELECT * FROM (SELECT r.*, row_number() OVER (ORDER BY rank_position, cohort_key, vehicle_uid) AS i, count(*) OVER () AS n
    FROM rank_plain r JOIN veh v USING (vehicle_uid) WHERE r.ranking_type = 'ev_range_efficiency' AND r.timeframe = '90d')
  WHERE i > {page} AND i <= {page} + 20)"""


def _deep_page(s, offset):
    """A page at an offset in the ranking of a user who may see every vehicle, through the index of its positions."""
    everyone = s.vehicles().select(F.lit("fleet").alias("user_id"), "vehicle_uid")
    asked = (snapshots(s).rankings, s.vehicles(), everyone, "fleet", C.RANGE, "90d")
    index = Q.index_ranking(Q.ranking_rows(*asked), work_folder(s.spark, "q07"))
    page = Q.ranking_page(*asked, limit=20, offset=offset(index), index=index)
    return rounded(page.select(*RANK_COLUMNS, "has_more"))


@register("q07_deep_page", _deep_page_sql("n // 2"))
def deep_page(s):
    return _deep_page(s, lambda index: index.size() // 2)


@register("q07_page_at_the_end", _deep_page_sql("n - 7"))
def page_at_the_end(s):
    return _deep_page(s, lambda index: index.size() - 7)


@register("q08_with_kpi_map", """
SELECT r.vehicle_uid, r.rank_position, string_agg(kpi_key || '=' || CAST(CAST(round(kpi_value * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY kpi_key) AS kpis
FROM rank_plain r JOIN kpi k ON k.vehicle_uid = r.vehicle_uid AND k.ranking_type = r.ranking_type AND k.timeframe = r.timeframe AND k.temperature_bin = r.temperature_bin
WHERE r.timeframe = '90d' AND r.ranking_type = 'ev_charging_performance' GROUP BY ALL""")
def with_kpi_map(s):
    snap = snapshots(s)
    rows = snap.rankings.where((F.col("timeframe") == "90d") & (F.col("ranking_type") == C.CHARGING))
    mapped = Q.with_kpi_map(rows, snap.kpis)
    cell = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("bigint").cast("string"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("kpis"), cell)), ",")
    return mapped.select("vehicle_uid", "rank_position", text.alias("kpis"))


@register("q10_accessible", """
SELECT signal_key, count(*) AS readings, count(DISTINCT vehicle_uid) AS vehicles FROM obs
WHERE vehicle_uid IN (SELECT vehicle_uid FROM acc WHERE user_id = 'user-7') GROUP BY ALL""")
def accessible(s):
    return Q.accessible(s.obs(), s.access(), "user-7").groupBy("signal_key").agg(
        F.count("*").alias("readings"), F.countDistinct("vehicle_uid").alias("vehicles"))


RAW = "observation_id, vehicle_uid, observed_at, signal_key, status, round(value_number, 6) AS value_number, raw_payload_ref"
RAW_COLUMNS = ["observation_id", "vehicle_uid", "observed_at", "signal_key", "status", "value_number", "raw_payload_ref"]


@register("q11_raw_telemetry", f"""
SELECT {RAW} FROM obs WHERE raw_payload_ref IS NOT NULL ORDER BY observed_at DESC, observation_id DESC LIMIT 500""")
def raw_telemetry(s):
    return rounded(Q.raw_telemetry(s.obs(), limit=900).select(*RAW_COLUMNS))


@register("q12_raw_with_events", f"""
SELECT {RAW} FROM (SELECT observation_id, vehicle_uid, observed_at, signal_key, status, value_number, raw_payload_ref FROM obs WHERE raw_payload_ref IS NOT NULL
  UNION ALL SELECT session_event_id, vehicle_uid, observed_at, 'session.' || session_type || '.' || event_type, event_type, NULL, raw_payload_ref FROM sev)
ORDER BY observed_at DESC, observation_id DESC LIMIT 120""")
def raw_with_events(s):
    return rounded(Q.raw_with_events(s.obs(), s.session_events()).select(*RAW_COLUMNS))


@register("q13_after_cursor", f"""
SELECT {RAW} FROM obs WHERE raw_payload_ref IS NOT NULL AND (observed_at < TIMESTAMP '2024-01-15 12:00:00'
  OR (observed_at = TIMESTAMP '2024-01-15 12:00:00' AND observation_id < 'obs-5')) ORDER BY observed_at DESC, observation_id DESC LIMIT 120""")
def after_cursor(s):
    cursor = (AS_OF - timedelta(days=18, hours=12), "obs-5")
    return rounded(Q.raw_telemetry(s.obs(), cursor=cursor).select(*RAW_COLUMNS))


@register("q13_next_cursor", """
SELECT min(observed_at) AS observed_at, arg_min(observation_id, (observed_at, observation_id)) AS observation_id FROM (
  SELECT * FROM obs WHERE raw_payload_ref IS NOT NULL ORDER BY observed_at DESC, observation_id DESC LIMIT 120)""")
def next_cursor(s):
    return Q.next_cursor(Q.raw_telemetry(s.obs()))


# ---- quality -----------------------------------------------------------------------------------------
@register("v01_check_violations", """
SELECT rule, violations FROM (VALUES ('kpi_ranking_type', 0), ('kpi_timeframe', 0), ('kpi_direction', 0), ('kpi_confidence', 0), ('kpi_sample_count', 0),
  ('kpi_temperature_bin', 0), ('kpi_baseline_bin', 0), ('kpi_compare_bin', 0), ('kpi_bins_paired', 0), ('kpi_bins_distinct', 0),
  ('ranking_ranking_type', 0), ('ranking_timeframe', 0), ('ranking_temperature_bin', 0), ('ranking_cohort_size', 0), ('ranking_position', 0),
  ('ranking_confidence', 0), ('observation_source', 0), ('observation_temperature_bin', 0), ('session_status', 0), ('session_charger_type', 0),
  ('session_temperature_bin', 0), ('session_sample_count', 0)) AS t(rule, violations)
UNION ALL SELECT 'observation_status', count(*) FILTER (WHERE event_id % 10 = 3) FROM obs
UNION ALL SELECT 'observation_confidence', count(*) FILTER (WHERE k > 90) FROM obs
UNION ALL SELECT 'observation_freshness', count(*) FILTER (WHERE k < 7) FROM obs
UNION ALL SELECT 'session_soc_start', count(*) FILTER (WHERE soc_start_pct + 20 > 100 OR soc_start_pct + 20 < 0) FROM sess
UNION ALL SELECT 'session_soc_end', count(*) FILTER (WHERE soc_end_pct > 100 OR soc_end_pct < 0) FROM sess
UNION ALL SELECT 'session_end_before_start', count(*) FILTER (WHERE ended_at < started_at) FROM sess""")
def check_violations(s):
    """Readings and sessions shifted so that some of them break a rule."""
    number = F.regexp_extract("observation_id", r"obs-(\d+)-", 1).cast("bigint")
    k = F.round(F.col("confidence") * 100)
    obs = s.obs().withColumns({
        "status": F.when(number % 10 == 3, "great").otherwise(F.col("status")),
        "confidence": F.when(k > 90, F.col("confidence") + 0.2).otherwise(F.col("confidence")),
        "freshness_ttl_seconds": F.when(k < 7, -1).otherwise(F.col("freshness_ttl_seconds")),
    })
    snap = snapshots(s)
    sess = snap.sessions.withColumn("soc_start_pct", F.col("soc_start_pct") + 20.0)
    return V.check_violations(obs, sess, snap.kpis, snap.rankings)


@register("v02_check_unique", """
SELECT 'kpi_unique' AS rule, count(*) AS violations FROM kpi WHERE sample_count > 20
UNION ALL SELECT 'ranking_unique', count(*) FROM ranks WHERE rank_position = 1""")
def check_unique(s):
    """Some snapshot rows written a second time."""
    snap = snapshots(s)
    kpi = snap.kpis.unionByName(snap.kpis.where(F.col("sample_count") > 20))
    return V.check_unique(kpi, snap.rankings.unionByName(snap.rankings.where(F.col("rank_position") == 1)))


# ---- documented extras -----------------------------------------------------------------------------------
CTES["levels"] = """
SELECT vehicle_uid, 'bev|' || coalesce(make, 'unknown') || '|' || coalesce(model, 'unknown') || '|' || coalesce(trim, 'unknown') || '|' || band AS k1,
  'bev|' || coalesce(make, 'unknown') || '|' || coalesce(model, 'unknown') || '|' || band AS k2,
  'bev|' || coalesce(make, 'unknown') || '|' || coalesce(model, 'unknown') AS k3, 'bev' AS k4
FROM (SELECT *, CASE WHEN model_year IS NULL THEN 'unknown' ELSE CAST(model_year AS VARCHAR) || '-' || CAST(model_year + 2 AS VARCHAR) END AS band FROM veh)"""


@register("e01_cohort_fallback", """
SELECT vehicle_uid, lvl AS level, CASE lvl WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE k4 END AS cohort_key,
  CASE lvl WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END AS cohort_size,
  CASE lvl WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END < 30 AS low_confidence
FROM (SELECT *, CAST(CASE WHEN n1 >= 10 THEN 1 WHEN n2 >= 10 THEN 2 WHEN n3 >= 10 THEN 3 ELSE 4 END AS BIGINT) AS lvl FROM (
  SELECT *, count(*) OVER (PARTITION BY k1) AS n1, count(*) OVER (PARTITION BY k2) AS n2, count(*) OVER (PARTITION BY k3) AS n3,
    count(*) OVER (PARTITION BY k4) AS n4 FROM levels))""")
def cohort_fallback(s):
    return D.cohort_fallback(s.vehicles())


@register("e02_source_precedence", """
SELECT observation_id, source2 AS source, row_number() OVER (PARTITION BY vehicle_uid, signal_key
  ORDER BY (source2 = 'OBD')::INT DESC, observed_at DESC, confidence DESC, observation_id DESC) = 1 AS is_winner
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'SMARTCAR' ELSE 'OBD' END AS source2 FROM obs)""")
def source_precedence(s):
    k = F.round(F.col("confidence") * 100).cast("bigint")
    obs = s.obs().withColumn("source", F.when(k % 2 == 0, "SMARTCAR").otherwise("OBD"))
    return D.source_precedence(obs).select("observation_id", "source", "is_winner")


@register("e03_freshness", """
SELECT observation_id, CASE WHEN status = 'ok' AND observed_at + INTERVAL 300 SECOND < TIMESTAMP '2024-01-20' THEN 'stale' ELSE status END AS effective_status FROM obs""")
def freshness(s):
    return D.with_freshness(s.obs(), AS_OF - timedelta(days=14)).select("observation_id", "effective_status")


@register("e04_cohort_temperature_metrics", """
SELECT cohort_key, timeframe, kpi_key, round(median(kpi_value), 6) AS metric_value, count(*) AS vehicles, CAST(sum(sample_count) AS BIGINT) AS compare_sample_count,
  CASE WHEN sum(sample_count) >= 60 THEN 'stable' WHEN sum(sample_count) >= 20 THEN 'medium' ELSE 'preview' END AS confidence_level
FROM kpi_temp JOIN cat_veh USING (vehicle_uid) WHERE temperature_bin = 'cold' GROUP BY ALL""")
def cohort_temperature(s):
    return rounded(D.cohort_temperature_metrics(snapshots(s).kpis, s.vehicles()))


@register("e05_charge_acceptance", f"""
SELECT vehicle_uid, round({clamp_sql('100 * median(avg_charge_power_kw / expected)', 0, 100)}, 6) AS acceptance_score, count(*) AS sessions
FROM (SELECT *, floor(soc_start_pct / 10) AS band, median(avg_charge_power_kw) OVER (PARTITION BY floor(soc_start_pct / 10), temperature_bin, charger_type) AS expected
      FROM sess WHERE avg_charge_power_kw > 0 AND soc_start_pct IS NOT NULL AND temperature_bin IS NOT NULL) GROUP BY vehicle_uid""")
def charge_acceptance(s):
    return rounded(D.charge_acceptance(s.sessions()))


@register("e06_raw_archive", """
SELECT CAST(ended_at AS DATE) AS received_date, count(*) AS batches, CAST(sum(n_records) AS BIGINT) AS records FROM ups GROUP BY ALL""")
def raw_archive(s):
    path = work_folder(s.spark, "archive") + "/raw"
    sinks.write_raw_archive(uploads(s), path, shards=4)
    return s.spark.read.parquet(path).groupBy("received_date").agg(
        F.count("*").alias("batches"), F.sum(F.size("records")).alias("records"))
