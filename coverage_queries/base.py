"""Registry of (Spark query, SQL) pairs and the SQL twin of the events adapter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.functions.scalars import timeframes
from voltlane.operators.kpis import drive_facts, drive_medians
from voltlane.operators.series import drive_steps
from voltlane.operators.sessions import charging_sessions
from voltlane.plans.recompute import Tables, recompute
from voltlane.session import table_stage, work_folder
from voltlane.sources import events_adapter as A

AS_OF = A.AS_OF
ALL_TOKENS = ("7d", "30d", "90d", "180d")
QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: Spark query ``name`` with its SQL body (CTEs are added by name)."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show; timestamps without zone."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


OBJECTS_PER_FILE = 500


def json_files(s: Source, text: DataFrame, name: str, torn: str) -> str:
    """JSON objects (column ``value``) as files of lists in the shared folder, beside one torn file."""
    path = f"{work_folder(s.spark, name)}/files"
    files = text.count() // OBJECTS_PER_FILE + 1
    lists = text.groupBy(F.pmod(F.xxhash64("value"), F.lit(files)).alias("f")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("f").text(path)
    s.spark.range(1).select(F.lit(torn).alias("value")).write.mode("append").text(path)
    return path


class Source:
    """Lazily built telemetry tables of one data folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self._written = {}

    def written(self, name, make):
        """The table that ``make`` derives, written at the first call and read back at all."""
        if name not in self._written:
            self._written[name] = table_stage(self.spark)(make(), name)
        return self._written[name]

    def raw(self, name):
        return A.table(self.spark, self.sf_dir, name)

    def events(self):
        return A.base_events(self.spark, self.sf_dir)

    def obs(self, divisor=1):
        return A.observations(self.spark, self.sf_dir, divisor)

    def session_events(self):
        return A.session_events(self.spark, self.sf_dir)

    def diagnostics(self):
        return A.diagnostics(self.spark, self.sf_dir)

    def vehicles(self):
        return A.vehicles(self.spark, self.sf_dir)

    def access(self):
        return A.access(self.spark, self.sf_dir)

    def tf(self, tokens=None):
        return timeframes(AS_OF, tokens) if tokens else timeframes(AS_OF)

    def filled(self, tokens=None, divisor=1):
        return drive_steps(self.obs(divisor), self.tf(tokens))

    def steps(self, tokens=None, divisor=1):
        """Drive steps written once: both the medians and the totals of a KPI read them."""
        return table_stage(self.spark)(self.filled(tokens, divisor), "drive_steps")

    def medians(self, tokens=None, divisor=1):
        return drive_medians(self.filled(tokens, divisor), self.tf(tokens))

    def facts(self, tokens=None, divisor=1):
        return drive_facts(self.filled(tokens, divisor), self.tf(tokens))

    def sessions(self):
        return charging_sessions(self.obs(), self.session_events(), AS_OF, True)

    def tables(self):
        return Tables(self.vehicles(), self.obs(), self.session_events(), self.diagnostics())

    def results(self):
        return recompute(self.tables(), AS_OF, real_storage=True)


# ---- SQL: adapter ---------------------------------------------------------------------------
def bin_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} <= -5 THEN 'very_cold' WHEN {x} <= 5 THEN 'cold' WHEN {x} <= 15 THEN 'cool' "
        f"WHEN {x} <= 25 THEN 'mild' WHEN {x} IS NOT NULL THEN 'hot' END"
    )


def charger_sql(x: str) -> str:
    return (
        f"CASE WHEN lower({x}) LIKE '%dc%' OR lower({x}) LIKE '%fast%' THEN 'dc' "
        f"WHEN lower({x}) LIKE '%ac%' OR lower({x}) LIKE '%level%' THEN 'ac' ELSE 'unknown' END"
    )


def confidence_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 60 THEN 'stable' WHEN {n} >= 20 THEN 'medium' ELSE 'preview' END"


def clamp_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {float(lo)}::DOUBLE), {float(hi)}::DOUBLE) END"


def real_sql(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


CTES: dict[str, str] = {}


def _events_cte(ts: str) -> str:
    return f"""
SELECT event_id, user_id, {ts} AS ts, event_type, value, CAST(round(value * 100) AS BIGINT) AS c,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'veh-' || CAST(user_id AS VARCHAR) AS vehicle_uid
FROM events"""


RAW_RESPONSE = """CASE k % 7
  WHEN 1 THEN '410D' || printf('%02X', k) WHEN 2 THEN 'SEARCHING... 41 0D ' || printf('%02X', k)
  WHEN 3 THEN 'NO DATA' WHEN 4 THEN '41 0D' WHEN 5 THEN '41 0D 00 41 0D ' || printf('%02X', k)
  WHEN 6 THEN '410 D' || printf('%02X', k) ELSE '41 0D ' || printf('%02X', k) END"""


def _obs_cte(e: str) -> str:
    amb = "CAST(k % 45 - 12 AS DOUBLE)"
    rows = [
        ("odo", f"drv_{e}", "TRUE", "'distance.odometer'", "(1000000 + run_c) / 100.0", "NULL", "'km'",
         f"CASE WHEN k % 3 = 0 THEN {bin_sql(amb)} END", "NULL"),
        ("soc", f"drv_{e}", "TRUE", "'ev.soc_pct'", "95 - ((run_s // 1000) % 7000) / 100.0", "NULL", "'%'", "NULL", "NULL"),
        ("odo2", f"drv_{e}", "k % 19 = 0", "'distance.odometer'", "(1000000 + run_c) / 100.0 + 0.25", "NULL", "'km'", "NULL", "NULL"),
        ("amb", e, "event_type = 'error'", "'environment.ambient_temp_c'", amb, "NULL", "'C'", bin_sql(amb), "NULL"),
        ("chg", e, "event_type = 'error'", "'ev.charge_power_kw'", "value", "NULL", "'kW'", "NULL", "NULL"),
        ("spd", e, "event_type = 'click'", "'speed.vehicle'", "k", "NULL", "'km/h'", "NULL", f"'cmd=010D resp=' || {RAW_RESPONSE}"),
        ("pwr", e, "event_type = 'click'", "CASE WHEN k % 2 = 0 THEN 'ev.regen_power_kw' ELSE 'ev.traction_power_kw' END",
         "value", "NULL", "'kW'", "NULL", "NULL"),
        ("typ", e, "event_type = 'click'", "'ev.charger_type'", "NULL",
         "CASE k % 3 WHEN 0 THEN 'dc_fast' WHEN 1 THEN 'ac_level2' ELSE 'other' END", "NULL", "NULL", "NULL"),
    ]
    parts = []
    for tag, src, cond, key, num, text, unit, tbin, ref in rows:
        parts.append(f"""
SELECT 'obs-' || CAST(event_id AS VARCHAR) || '-{tag}' AS observation_id, vehicle_uid,
  'bat-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS batch_id, CAST(NULL AS VARCHAR) AS session_id,
  {key} AS signal_key, CAST({num} AS DOUBLE) AS value_number, CAST({text} AS VARCHAR) AS value_string,
  CAST(NULL AS BOOLEAN) AS value_bool, CAST(NULL AS VARCHAR) AS value_json, CAST({unit} AS VARCHAR) AS unit,
  ts AS observed_at, ts + INTERVAL {9 if tag == 'odo2' else 5} MINUTE AS ingested_at, 'OBD' AS source, '{tag}' AS source_signal,
  CASE WHEN k % 11 = 0 THEN 'stale' WHEN k % 13 = 0 THEN 'error' WHEN k % 17 = 0 THEN 'unavailable' ELSE 'ok' END AS status,
  CAST((k % 101) / 100.0 AS DOUBLE) AS confidence, CAST(300 AS BIGINT) AS freshness_ttl_seconds,
  CAST({tbin} AS VARCHAR) AS temperature_bin, FALSE AS is_temperature_estimated, CAST({ref} AS VARCHAR) AS raw_payload_ref,
  event_id, k
FROM {src} WHERE {cond}""")
    return "\nUNION ALL".join(parts)


def _drive_cte(e: str) -> str:
    return f"""
SELECT *, CAST(sum(c) OVER w AS BIGINT) AS run_c, CAST(sum(c * (50 + k)) OVER w AS BIGINT) AS run_s
FROM {e} WHERE event_type IN ('view', 'signup')
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


CTES["e1"] = _events_cte("ts")
CTES["e300"] = _events_cte(
    "TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 300)"
)
CTES["drv_e1"] = _drive_cte("e1")
CTES["drv_e300"] = _drive_cte("e300")
CTES["obs"] = _obs_cte("e1")
CTES["obs300"] = _obs_cte("e300")
CTES["bought"] = """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e1 WHERE event_type = 'purchase'"""
CTES["sev"] = """
SELECT 'sev-' || CAST(event_id AS VARCHAR) AS session_event_id, vehicle_uid, session_id, session_type, event_type,
       ts AS observed_at, ts + INTERVAL 5 MINUTE AS ingested_at, 'OBD' AS source, 'evt=' || CAST(event_id AS VARCHAR) AS raw_payload_ref,
       event_id
FROM (
  SELECT event_id, vehicle_uid, ts, 'ses-' || CAST(user_id AS VARCHAR) || '-' || CAST((nth + 1) // 2 AS VARCHAR) AS session_id,
         'charging' AS session_type, CASE WHEN nth % 2 = 1 THEN 'start' ELSE 'stop' END AS event_type FROM bought
  UNION ALL
  SELECT event_id, vehicle_uid, ts, 'drv-' || CAST(user_id AS VARCHAR), 'drive', CASE WHEN k % 4 = 0 THEN 'start' ELSE 'stop' END
  FROM e1 WHERE event_type = 'signup' AND k % 4 < 2)"""
CTES["diag"] = """
SELECT 'mil-' || CAST(event_id AS VARCHAR) AS event_id, vehicle_uid,
       'bat-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS batch_id,
       CASE WHEN value > 50 THEN 'MIL_ON' ELSE 'MIL_OFF' END AS event_type, CAST(NULL AS VARCHAR) AS code, ts AS observed_at
FROM e1 WHERE event_type = 'error'
UNION ALL
SELECT 'dtc-' || CAST(event_id AS VARCHAR), vehicle_uid, 'bat-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d'),
       'DTC_ACTIVE', 'P0' || lpad(CAST(k AS VARCHAR), 3, '0'), ts
FROM e1 WHERE event_type = 'error'"""
CTES["veh"] = """
SELECT 'veh-' || CAST(c_custkey AS VARCHAR) AS vehicle_uid, r_name AS make,
       CASE WHEN c_custkey % 50 <> 7 THEN c_mktsegment END AS model, CAST(NULL AS VARCHAR) AS trim,
       CAST(CASE WHEN c_custkey % 97 <> 0 THEN 2022 END AS BIGINT) AS model_year, 'bev' AS powertrain_class
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTES["acc"] = """
SELECT 'user-' || CAST(c_custkey % 20 AS VARCHAR) AS user_id, 'veh-' || CAST(c_custkey AS VARCHAR) AS vehicle_uid FROM customer"""
CTES["cat_veh"] = """
SELECT vehicle_uid, coalesce(make, 'unknown') AS make, coalesce(model, 'unknown') AS model, coalesce(trim, 'unknown') AS trim, model_year,
  'bev|' || coalesce(make, 'unknown') || '|' || coalesce(model, 'unknown') || '|' || coalesce(trim, 'unknown') || '|' ||
  CASE WHEN model_year IS NULL THEN 'unknown' ELSE CAST(model_year AS VARCHAR) || '-' || CAST(model_year + 2 AS VARCHAR) END AS cohort_key
FROM veh"""


# ---- SQL: timeframes and drive series, one sequential pass per timeframe ------------------------
def _tf(days) -> str:
    rows = ", ".join(f"('{d}d', TIMESTAMP '{AS_OF:%Y-%m-%d}' - INTERVAL {d} DAY)" for d in days)
    return f"SELECT * FROM (VALUES {rows}) AS t(timeframe, cutoff)"


CTES["tf"] = _tf((30, 90, 180))
CTES["tf4"] = _tf((7, 30, 90, 180))


def _series(suffix: str, obs: str, tf: str) -> None:
    """CTEs sig/one/snap/fill/steps/gated/tgated for one reading table and timeframe set."""
    s = suffix
    CTES[f"one{s}"] = f"""
SELECT vehicle_uid, timeframe, observed_at, signal_key, value_number FROM (
  SELECT o.*, t.timeframe, row_number() OVER (
    PARTITION BY vehicle_uid, timeframe, observed_at, signal_key ORDER BY ingested_at DESC, observation_id DESC) AS rn
  FROM {obs} o JOIN {tf} t ON o.observed_at >= t.cutoff WHERE o.value_number IS NOT NULL)
WHERE rn = 1"""
    CTES[f"snap{s}"] = f"""
SELECT vehicle_uid, timeframe, observed_at,
  max(CASE WHEN signal_key = 'distance.odometer' THEN value_number END) AS odo,
  max(CASE WHEN signal_key = 'ev.soc_pct' THEN value_number END) AS soc,
  max(CASE WHEN signal_key = 'speed.vehicle' THEN value_number END) AS speed,
  max(CASE WHEN signal_key = 'environment.ambient_temp_c' THEN value_number END) AS temp,
  max(CASE WHEN signal_key = 'ev.regen_power_kw' THEN value_number END) AS regen,
  max(CASE WHEN signal_key = 'ev.traction_power_kw' THEN value_number END) AS traction
FROM one{s} WHERE signal_key IN ('distance.odometer', 'ev.soc_pct', 'speed.vehicle', 'environment.ambient_temp_c',
  'ev.regen_power_kw', 'ev.traction_power_kw')
GROUP BY ALL"""
    CTES[f"fill{s}"] = f"""
SELECT vehicle_uid, timeframe, observed_at, regen, traction,
  last_value(odo IGNORE NULLS) OVER w AS odo, last_value(soc IGNORE NULLS) OVER w AS soc,
  last_value(speed IGNORE NULLS) OVER w AS speed, last_value(temp IGNORE NULLS) OVER w AS temp
FROM snap{s} WINDOW w AS (PARTITION BY vehicle_uid, timeframe ORDER BY observed_at ROWS UNBOUNDED PRECEDING)"""
    CTES[f"delta{s}"] = f"""
SELECT * FROM (
  SELECT *, odo - lag(odo) OVER w AS delta_km, lag(soc) OVER w - soc AS delta_soc, lag(odo) OVER w AS prev_odo
  FROM fill{s} WHERE odo IS NOT NULL AND soc IS NOT NULL
  WINDOW w AS (PARTITION BY vehicle_uid, timeframe ORDER BY observed_at)) WHERE prev_odo IS NOT NULL"""
    CTES[f"gated{s}"] = f"""
SELECT *, CASE WHEN isfinite(delta_km / delta_soc) AND delta_km / delta_soc > 0 AND delta_km / delta_soc < 50
               THEN delta_km / delta_soc END AS km_per_soc,
       delta_soc / 100.0 * 75.0 * 1000.0 / delta_km AS wh_per_km
FROM delta{s} WHERE delta_km > 0.05 AND delta_soc > 0.05 AND delta_soc < 30"""
    CTES[f"tpoint{s}"] = f"""
SELECT * FROM (
  SELECT vehicle_uid, timeframe, observed_at, temp, delta_km, delta_km / delta_soc AS km_per_soc FROM (
    SELECT *, odo - lag(odo) OVER w AS delta_km, lag(soc) OVER w - soc AS delta_soc
    FROM fill{s} WHERE odo IS NOT NULL AND soc IS NOT NULL AND temp IS NOT NULL
    WINDOW w AS (PARTITION BY vehicle_uid, timeframe ORDER BY observed_at))
  WHERE delta_km > 0.05 AND delta_soc > 0.05 AND delta_soc < 30)
WHERE km_per_soc > 0 AND km_per_soc < 50"""
    CTES[f"pwin{s}"] = f"""
SELECT *, CASE WHEN regen > 0 THEN regen * (gap / 3600.0) * 1000.0 END AS regen_wh,
          CASE WHEN traction > 0 THEN traction * (gap / 3600.0) * 1000.0 END AS traction_wh FROM (
  SELECT vehicle_uid, timeframe, observed_at, regen, traction,
         CAST(floor(epoch(lead(observed_at) OVER w)) - floor(epoch(observed_at)) AS BIGINT) AS gap
  FROM snap{s} WHERE regen IS NOT NULL OR traction IS NOT NULL
  WINDOW w AS (PARTITION BY vehicle_uid, timeframe ORDER BY observed_at))
WHERE gap BETWEEN 1 AND 300"""
    CTES[f"power{s}"] = f"""
SELECT vehicle_uid, timeframe, coalesce(sum(regen_wh), 0) AS regen_wh, coalesce(sum(traction_wh), 0) AS traction_wh,
       count(*) FILTER (WHERE regen_wh IS NOT NULL OR traction_wh IS NOT NULL) AS power_windows
FROM pwin{s} GROUP BY ALL"""
    CTES[f"lsoc{s}"] = f"""
SELECT vehicle_uid, timeframe, arg_max(value_number, observed_at) AS latest_soc, max(observed_at) AS observed_at
FROM one{s} WHERE signal_key = 'ev.soc_pct' GROUP BY ALL"""
    CTES[f"rngk{s}"] = f"""
SELECT b.*, p.regen_wh, p.power_windows,
  CASE WHEN p.regen_wh > 0 THEN {clamp_sql('100.0 * p.regen_wh / (p.regen_wh + p.traction_wh)', 0, 100)} END AS regen_ratio,
  {clamp_sql(f"0.65 * ({clamp_sql('100 - wh / 3.0', 0, 100)}) + 0.35 * ({clamp_sql('km_range / 4.0', 0, 100)})", 0, 100)} AS score
FROM (
  SELECT m.*, 100.0 / med AS depletion,
    greatest(({clamp_sql('coalesce(latest_soc, 50)', 0, 100)}) * med, 0) AS km_range,
    coalesce(med_wh, 100.0 / med * 75.0 / 10.0) AS wh
  FROM (SELECT vehicle_uid, timeframe, median(km_per_soc) AS med, count(km_per_soc) AS n, median(wh_per_km) AS med_wh,
               median(wh_per_km) FILTER (WHERE speed < 45) AS urban, count(*) FILTER (WHERE speed < 45) AS urban_n,
               median(wh_per_km) FILTER (WHERE speed >= 80) AS highway, count(*) FILTER (WHERE speed >= 80) AS highway_n
        FROM gated{s} GROUP BY ALL HAVING count(km_per_soc) > 0) m
  LEFT JOIN lsoc{s} l USING (vehicle_uid, timeframe)) b
LEFT JOIN power{s} p USING (vehicle_uid, timeframe)"""
    CTES[f"tbuck{s}"] = f"""
SELECT vehicle_uid, timeframe, coalesce(sum(delta_km) FILTER (WHERE temp <= 5), 0) AS cold_km,
  coalesce(sum(delta_km) FILTER (WHERE temp > 15 AND temp <= 25), 0) AS mild_km,
  count(*) FILTER (WHERE temp <= 5) AS cold_points, count(*) FILTER (WHERE temp > 15 AND temp <= 25) AS mild_points,
  median(km_per_soc) FILTER (WHERE temp <= 5) AS cold_med, median(km_per_soc) FILTER (WHERE temp > 15 AND temp <= 25) AS mild_med,
  count(*) AS points,
  CASE WHEN count(*) >= 2 AND regr_sxx(km_per_soc, temp) > 2.220446049250313e-16 THEN regr_slope(km_per_soc, temp) END AS slope
FROM tpoint{s} GROUP BY ALL"""


_series("", "obs", "tf")
_series("4", "obs", "tf4")
_series("c", "obs300", "tf")

# ---- SQL: sessions, charging, temperature, composite -----------------------------------------------
CTES["win"] = """
SELECT * FROM (
  SELECT vehicle_uid, session_id, min(observed_at) FILTER (WHERE event_type = 'start') AS started_at,
         max(observed_at) FILTER (WHERE event_type = 'stop') AS ended_at
  FROM sev WHERE session_type = 'charging' GROUP BY ALL) WHERE started_at IS NOT NULL"""
CTES["inwin"] = f"""
SELECT w.session_id, o.* FROM (SELECT * EXCLUDE (session_id, batch_id) FROM obs) o JOIN win w ON o.vehicle_uid = w.vehicle_uid
  AND o.observed_at >= w.started_at AND o.observed_at <= coalesce(w.ended_at, TIMESTAMP '{AS_OF:%Y-%m-%d}')
WHERE signal_key IN ('ev.soc_pct', 'ev.charge_power_kw', 'power.battery_power_kw', 'environment.ambient_temp_c',
  'ev.battery_temp_c', 'ev.charger_type')"""
CTES["sess"] = f"""
SELECT w.vehicle_uid, w.session_id, started_at, ended_at, CASE WHEN ended_at IS NULL THEN 'partial' ELSE 'complete' END AS status,
  {charger_sql("coalesce(label, 'unknown')")} AS charger_type, {real_sql('soc_start')} AS soc_start_pct, {real_sql('soc_end')} AS soc_end_pct,
  {real_sql('soc_end - soc_start')} AS soc_delta_pct,
  {real_sql("avg_kw * CASE WHEN ended_at > started_at THEN floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0) / 3600.0 ELSE 0 END")} AS energy_added_kwh,
  {real_sql('avg_kw')} AS avg_charge_power_kw, {real_sql('peak_kw')} AS peak_charge_power_kw, {real_sql('amb')} AS ambient_temp_avg_c,
  {real_sql('bat')} AS battery_temp_avg_c, {bin_sql('coalesce(amb, bat)')} AS temperature_bin, coalesce(n, 0) AS sample_count
FROM win w LEFT JOIN (
  SELECT session_id, arg_min(value_number, observed_at) FILTER (WHERE signal_key = 'ev.soc_pct') AS soc_start,
    arg_max(value_number, observed_at) FILTER (WHERE signal_key = 'ev.soc_pct') AS soc_end,
    avg(abs(value_number)) FILTER (WHERE signal_key IN ('ev.charge_power_kw', 'power.battery_power_kw')) AS avg_kw,
    max(abs(value_number)) FILTER (WHERE signal_key IN ('ev.charge_power_kw', 'power.battery_power_kw')) AS peak_kw,
    count(value_number) FILTER (WHERE signal_key IN ('ev.charge_power_kw', 'power.battery_power_kw')) AS n,
    avg(value_number) FILTER (WHERE signal_key = 'environment.ambient_temp_c') AS amb,
    avg(value_number) FILTER (WHERE signal_key = 'ev.battery_temp_c') AS bat,
    arg_max(value_string, observed_at) FILTER (WHERE signal_key = 'ev.charger_type') AS label
  FROM inwin GROUP BY ALL) f USING (session_id)"""
CTES["cbuck"] = """
SELECT vehicle_uid, timeframe, median(kw) AS all_kw, count(*) AS all_n,
  median(kw) FILTER (WHERE temperature_bin IN ('cold', 'very_cold')) AS cold_kw, count(*) FILTER (WHERE temperature_bin IN ('cold', 'very_cold')) AS cold_n,
  median(kw) FILTER (WHERE temperature_bin = 'mild') AS mild_kw, count(*) FILTER (WHERE temperature_bin = 'mild') AS mild_n
FROM (SELECT s.*, avg_charge_power_kw AS kw, t.timeframe FROM sess s JOIN tf t ON s.started_at >= t.cutoff
      WHERE avg_charge_power_kw > 0 AND temperature_bin IS NOT NULL) GROUP BY ALL"""
CTES["chargek"] = f"""
SELECT *, {clamp_sql('coalesce(0.6 * acceptance + 0.4 * retention, acceptance)', 0, 100)} AS score FROM (
  SELECT *, {clamp_sql('100.0 * all_kw / coalesce(mild_kw, greatest(all_kw, 1e-6))', 0, 120)} AS acceptance,
    CASE WHEN cold_n >= 1 AND mild_n >= 1 AND mild_kw > 0 THEN {clamp_sql('100.0 * cold_kw / mild_kw', 0, 200)} END AS retention,
    least(cold_n, mild_n) AS retention_n FROM cbuck)"""
CTES["tempk"] = f"""
SELECT coalesce(d.vehicle_uid, c.vehicle_uid) AS vehicle_uid, coalesce(d.timeframe, c.timeframe) AS timeframe, kept, range_n,
  CASE WHEN kept IS NOT NULL AND points >= 6 AND slope IS NOT NULL
       THEN {clamp_sql('CASE WHEN slope < 0 THEN -slope * 10.0 / mild_med * 100.0 ELSE 0 END', 0, 100)} END AS sensitivity,
  points, retention, retention_n
FROM (SELECT *, least(cold_points, mild_points) AS range_n,
        CASE WHEN cold_km >= 20 AND mild_km >= 20 AND mild_med > 0 THEN {clamp_sql('100.0 * cold_med / mild_med', 0, 200)} END AS kept FROM tbuck) d
FULL JOIN (SELECT vehicle_uid, timeframe, retention, retention_n FROM chargek) c
  ON d.vehicle_uid = c.vehicle_uid AND d.timeframe = c.timeframe"""
CTES["pen"] = """
SELECT v.vehicle_uid, t.timeframe,
  least(CASE WHEN mil = 'MIL_ON' THEN 6.0 ELSE 0.0 END + least(coalesce(dtc, 0) * 0.5, 4.0), 10.0) AS penalty,
  greatest(coalesce(dtc, 0) + CASE WHEN mil IS NULL THEN 0 ELSE 1 END, 1) AS health_n
FROM veh v CROSS JOIN tf t
LEFT JOIN (SELECT vehicle_uid, timeframe, count(DISTINCT code) AS dtc FROM diag JOIN tf ON observed_at >= cutoff
           WHERE event_type = 'DTC_ACTIVE' GROUP BY ALL) d ON v.vehicle_uid = d.vehicle_uid AND t.timeframe = d.timeframe
LEFT JOIN (SELECT vehicle_uid, timeframe, arg_max(event_type, observed_at) AS mil FROM diag JOIN tf ON observed_at >= cutoff
           WHERE event_type LIKE 'MIL%' GROUP BY ALL) m ON v.vehicle_uid = m.vehicle_uid AND t.timeframe = m.timeframe"""
CTES["compk"] = f"""
SELECT *, {clamp_sql('base - penalty', 0, 100)} AS score FROM (
  SELECT vehicle_uid, timeframe, {clamp_sql('coalesce(0.6 * rs + 0.4 * cs, rs, cs)', 0, 100)} AS base,
    penalty, health_n, greatest(coalesce(r.n, 0), coalesce(c.all_n, 0), health_n) AS samples
  FROM (SELECT *, {real_sql('score')} AS rs FROM rngk) r
  FULL JOIN (SELECT *, {real_sql('score')} AS cs FROM chargek) c USING (vehicle_uid, timeframe) JOIN pen USING (vehicle_uid, timeframe))"""


def _kpi_sql(src: str, family: str, cells) -> str:
    parts = []
    bins = ["all", "cold"] if family == "ev_temperature_impact" else ["all"]
    base, comp = ("'mild'", "'cold'") if len(bins) == 2 else ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")
    for key, value, n, unit, direction in cells:
        for b in bins:
            parts.append(
                f"SELECT vehicle_uid, '{family}' AS ranking_type, timeframe, '{key}' AS kpi_key, {real_sql(value)} AS kpi_value, "
                f"'{unit}' AS kpi_unit, '{direction}' AS direction, {confidence_sql(n)} AS confidence_level, "
                f"CAST({n} AS BIGINT) AS sample_count, '{b}' AS temperature_bin, {base} AS baseline_temperature_bin, "
                f"{comp} AS compare_temperature_bin FROM {src} WHERE {value} IS NOT NULL"
            )
    return "\nUNION ALL\n".join(parts)


H, L = "higher_is_better", "lower_is_better"


def range_cells():
    return [
        ("ev_net_energy_efficiency", "wh", "n", "Wh_per_km", L),
        ("ev_estimated_practical_range", "km_range", "n", "km", H),
        ("soc_depletion_rate_per_100km", "depletion", "n", "%_per_100km", L),
        ("ev_range_efficiency_score", "score", "n", "score", H),
        ("ev_urban_efficiency", "urban", "urban_n", "Wh_per_km", L),
        ("ev_highway_efficiency", "highway", "highway_n", "Wh_per_km", L),
        ("regeneration_recovery_ratio", "regen_ratio", "greatest(power_windows, 1)", "%", H),
    ]


CTES["kpi_range"] = _kpi_sql("rngk", "ev_range_efficiency", range_cells())
CTES["kpi_range4"] = _kpi_sql("rngk4", "ev_range_efficiency", range_cells())
CTES["kpi_rangec"] = _kpi_sql("rngkc", "ev_range_efficiency", range_cells())
CTES["kpi_charge"] = _kpi_sql("chargek", "ev_charging_performance", [
    ("temp_adjusted_charge_acceptance_score", "acceptance", "all_n", "score", H),
    ("cold_weather_charge_speed_retention", "retention", "retention_n", "%", H),
    ("charging_performance_score", "score", "all_n", "score", H)])
CTES["kpi_temp"] = _kpi_sql("tempk", "ev_temperature_impact", [
    ("cold_weather_range_retention", "kept", "range_n", "%", H),
    ("range_temperature_sensitivity_index", "sensitivity", "points", "%_loss_per_10C_drop", L),
    ("cold_weather_charge_speed_retention", "retention", "retention_n", "%", H)])
CTES["kpi_comp"] = _kpi_sql("compk", "ev_composite", [
    ("ev_composite_base_score", "base", "samples", "score", H),
    ("ev_health_modifier_penalty", "penalty", "health_n", "score_points", L),
    ("ev_composite_score", "score", "samples", "score", H)])
CTES["kpi"] = "SELECT * FROM kpi_range UNION ALL SELECT * FROM kpi_charge UNION ALL SELECT * FROM kpi_temp UNION ALL SELECT * FROM kpi_comp"
CTES["scored"] = """
SELECT k.ranking_type, k.timeframe, v.cohort_key, k.vehicle_uid,
  max(CASE WHEN (ranking_type, kpi_key) IN (('ev_range_efficiency', 'ev_range_efficiency_score'),
      ('ev_charging_performance', 'charging_performance_score'), ('ev_composite', 'ev_composite_score')) THEN kpi_value END) AS score,
  CASE WHEN bool_or(confidence_level = 'preview') THEN 'preview' WHEN bool_or(confidence_level = 'medium') THEN 'medium' ELSE 'stable' END AS confidence_level
FROM kpi k JOIN cat_veh v USING (vehicle_uid) WHERE ranking_type <> 'ev_temperature_impact' GROUP BY ALL"""
_SENSITIVITY = clamp_sql("coalesce(sensitivity, 50)", 0, 100)
_SEED_SCORE = clamp_sql(
    f"0.45 * ({clamp_sql('range_retention', 0, 200)}) + 0.35 * ({clamp_sql('charge_retention', 0, 200)})"
    f" + 0.20 * (100 - ({clamp_sql(f'2 * ({_SENSITIVITY})', 0, 100)}))", 0, 100,
)
CTES["seeds"] = f"""
SELECT *, {_SEED_SCORE} AS score, CASE WHEN sensitivity IS NULL THEN 'medium' ELSE 'stable' END AS confidence_level
FROM (SELECT v.vehicle_uid, v.cohort_key, t.timeframe, {real_sql('t.kept')} AS range_retention, {real_sql('t.sensitivity')} AS sensitivity, {real_sql('t.retention')} AS charge_retention
      FROM cat_veh v JOIN tempk t USING (vehicle_uid) WHERE t.kept IS NOT NULL AND t.retention IS NOT NULL)"""
CTES["rank_plain"] = """
SELECT ranking_type, timeframe, 'all' AS temperature_bin, cohort_key, count(*) OVER c AS cohort_size, count(*) OVER c >= 10 AS sample_gate_passed,
  vehicle_uid, row_number() OVER (PARTITION BY ranking_type, timeframe, cohort_key ORDER BY score DESC, vehicle_uid) AS rank_position,
  CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, confidence_level FROM scored WINDOW c AS (PARTITION BY ranking_type, timeframe, cohort_key)"""
CTES["rank_temp"] = """
SELECT 'ev_temperature_impact' AS ranking_type, timeframe, b.bin AS temperature_bin, cohort_key, count(*) OVER c AS cohort_size, count(*) OVER c >= 10 AS sample_gate_passed,
  vehicle_uid, row_number() OVER (PARTITION BY b.bin, timeframe, cohort_key ORDER BY score DESC, vehicle_uid) AS rank_position,
  CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, confidence_level FROM seeds CROSS JOIN (VALUES ('all'), ('cold')) AS b(bin) WINDOW c AS (PARTITION BY b.bin, timeframe, cohort_key)"""
CTES["ranks"] = "SELECT * FROM rank_plain UNION ALL SELECT * FROM rank_temp"


def with_ctes(body: str) -> str:
    """Prefix ``body`` with exactly the CTEs it refers to, dependencies first."""
    order: list[str] = []

    def visit(text: str, path: tuple):
        for name in CTES:
            if name not in path and re.search(rf"\b(?:FROM|JOIN)\s+{re.escape(name)}\b(?!\s*\()", text):
                if name not in order:
                    visit(CTES[name], (*path, name))
                    if name not in order:
                        order.append(name)

    visit(body, ())
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body
