"""Capture decoding and reports."""

from pyspark.sql import functions as F

from voltlane.functions import hexframes as H
from voltlane.operators import decode as X
from voltlane.operators.ordering import running_totals
from voltlane.operators.series import time_bucket
from voltlane.sources import batches as B
from voltlane.sources.events_adapter import RUN_BUCKET_SECONDS, raw_response

from .base import CTES, RAW_RESPONSE, json_files, register, rounded
from .ingest import raw_rows

PACK = 1000  # exchanges per run pack
COMMANDS = ["010D", "0142", "ATRV", "0146", "0101", "03", "0100", "0140", "010D", "010D"]


def exchange_rows(s):
    """Clicks as command exchanges, ten commands in turn per user, split into packs."""
    e = running_totals(
        s.events().where(F.col("event_type") == "click"), ["user_id"], time_bucket(F.col("ts"), RUN_BUCKET_SECONDS), ["ts", "event_id"], {"nth": F.lit(1)})
    k = F.col("k")
    index = (F.col("nth") - 1) % PACK
    turn = index % 10
    hh = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    volts = F.when(k % 5 == 0, F.lit("ATRV\r99.9V\r>")).otherwise(
        text("ATRV\r1", (k % 10).cast("string"), ".", (k % 7).cast("string"), "V\r>"))
    response = (
        F.when(turn == 0, text(raw_response(k), "\r\r>"))
        .when(turn == 1, F.when(k % 2 == 0, text("41 42 ", hh(k), " ", hh(99 - k))).otherwise(F.lit("NO DATA")))
        .when(turn == 2, volts)
        .when(turn == 3, text("41 46 ", hh(k), " 41 46"))
        .when(turn == 4, text("SEARCHING...\r41 01 ", hh((k % 2) * 128 + k % 4), " 00 00 00\r>"))
        .when(turn == 5, text("43 ", hh(k), " ", hh(99 - k), " 00 00 0A C1 0A C1 0"))
        .when(turn == 6, text("41 00 ", hh(k), " 00 00 00 41 00 00 00 00 ", hh(k)))
        .when(turn == 7, text("4140", hh(k), "0000", hh(99 - k)))
    )
    user = F.col("user_id").cast("string")
    return e.select(
        text("pack-", user, "-", F.floor((F.col("nth") - 1) / PACK).cast("string")).alias("pack_id"),
        text("cap-", user).alias("session_id"), "vehicle_uid", F.col("user_id").cast("string").alias("user_id"),
        index.cast("int").alias("exchange_index"), F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("ended_at"),
        F.get(F.array(*[F.lit(c) for c in COMMANDS]), turn.cast("int")).alias("command"), response.alias("raw_response"),
        F.when(turn == 8, "timeout").alias("error_message"),
        F.when(turn == 8, "error").when(turn == 9, "not_supported").otherwise("ok").alias("parse_outcome"),
        F.lit(None).cast("string").alias("signal_key"), F.lit(None).cast("string").alias("source_signal"))


CTES["exch"] = f"""
SELECT *, 'pack-' || CAST(user_id AS VARCHAR) || '-' || CAST((nth - 1) // {PACK} AS VARCHAR) AS pack_id, 'cap-' || CAST(user_id AS VARCHAR) AS session_id,
  (nth - 1) % {PACK} AS exchange_index, (nth - 1) % 10 AS turn,
  lead(k) OVER (PARTITION BY user_id ORDER BY nth) AS k2
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e1 WHERE event_type = 'click')"""


@register("s13_run_packs", """
SELECT pack_id, session_id, exchange_index, CAST(event_id AS VARCHAR) AS id, ts AS started_at, parse_outcome FROM (
  SELECT *, CASE turn WHEN 8 THEN 'error' WHEN 9 THEN 'not_supported' ELSE 'ok' END AS parse_outcome FROM exch)
UNION ALL SELECT '{"id": "torn', NULL, NULL, NULL, NULL, 'damaged'""")
def run_packs(s):
    """Exchanges packed to run-pack files (at most 1,000 each), one of them torn, read and exploded again."""
    fields = ["id", "started_at", "ended_at", "command", "raw_response", "error_message", "parse_outcome", "signal_key", "source_signal"]
    item = F.struct("exchange_index", F.struct(*fields).alias("x"))
    packs = exchange_rows(s).groupBy(F.col("pack_id").alias("id"), "session_id", "vehicle_uid", "user_id").agg(
        F.array_sort(F.collect_list(item)).alias("c")).withColumn("command_exchanges", F.col("c.x")).drop("c")
    text = packs.select(F.to_json(F.struct(*packs.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))
    path = json_files(s, text, "packs", '{"id": "torn')
    rows, damaged = B.read_run_packs(s.spark, path)
    none = lambda kind: F.lit(None).cast(kind)
    return rounded(rows.select("pack_id", "session_id", "exchange_index", "id", "started_at", "parse_outcome").unionByName(damaged.select(
        F.col("content").alias("pack_id"), none("string").alias("session_id"), none("int").alias("exchange_index"), none("string").alias("id"),
        none("timestamp").alias("started_at"), F.lit("damaged").alias("parse_outcome"))))


@register("x01_parse_payload_ref", f"""
SELECT 'obs-' || CAST(event_id AS VARCHAR) || '-spd' AS observation_id, '010D' AS command, {RAW_RESPONSE} AS response FROM e1 WHERE event_type = 'click'""")
def parse_payload(s):
    return X.parse_payload_ref(s.obs().where(F.col("raw_payload_ref").isNotNull())).select("observation_id", "command", "response")


@register("x02_hex_bytes", """
SELECT event_id, CASE k % 7 WHEN 3 THEN '' WHEN 4 THEN '65,13' WHEN 5 THEN '65,13,0,65,13,' || CAST(k AS VARCHAR) ELSE '65,13,' || CAST(k AS VARCHAR) END AS bytes
FROM e1 WHERE event_type = 'click'""")
def hex_bytes(s):
    e = s.events().where(F.col("event_type") == "click")
    return e.select("event_id", F.array_join(F.transform(H.hex_bytes(raw_response(F.col("k"))), lambda b: b.cast("string")), ",").alias("bytes"))


@register("x03_pid_payload", """
SELECT event_id, CASE WHEN k % 7 IN (3, 4) THEN NULL ELSE k END AS a, CASE k % 7 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS frames
FROM e1 WHERE event_type = 'click'""")
def pid_payload(s):
    data = H.hex_bytes(raw_response(F.col("k")))
    return rounded(s.events().where(F.col("event_type") == "click").select(
        "event_id", F.get(H.pid_payload(data, 1, 0x0D, 1), F.lit(0)).alias("a"), F.size(H.pid_frames(data, 1, 0x0D, 1)).alias("frames")))


def _signal(name, turn, value):
    @register(name, f"SELECT pack_id, exchange_index, round(CAST({value} AS DOUBLE), 6) AS value_number FROM exch WHERE turn = {turn}")
    def query(s):
        rows = X.decode_signals(exchange_rows(s)).where(F.col("exchange_index") % 10 == turn)
        return rounded(rows.select("pack_id", "exchange_index", "value_number"))


_signal("x04_speed", 0, "CASE WHEN k % 7 IN (3, 4) THEN NULL ELSE k END")
_signal("x05_module_voltage", 1, "CASE WHEN k % 2 = 0 THEN (256 * k + 99 - k) / 1000.0 END")
_signal("x06_ambient", 3, "k - 40")


@register("x07_adapter_voltage", """
SELECT pack_id, exchange_index, CASE WHEN k % 5 = 0 THEN NULL ELSE round(CAST(10 + k % 10 + (k % 7) / 10.0 AS DOUBLE), 6) END AS volts FROM exch WHERE turn = 2""")
def adapter_voltage(s):
    return rounded(exchange_rows(s).where(F.col("command") == "ATRV").select(
        "pack_id", "exchange_index", H.adapter_voltage(F.col("raw_response")).alias("volts")))


@register("x08_readiness", """
SELECT pack_id, exchange_index, k % 2 = 1 AS mil_on, k % 4 AS stored_dtc_count FROM exch WHERE turn = 4""")
def readiness(s):
    return rounded(X.decode_readiness(exchange_rows(s)).select("pack_id", "exchange_index", "mil_on", "stored_dtc_count"))


@register("x09_supported_pids", """
SELECT DISTINCT pack_id, pid FROM (
  SELECT pack_id, b + 1 AS pid FROM exch, range(0, 8) t(b) WHERE turn = 6 AND (k >> (7 - b)) & 1 = 1
  UNION ALL SELECT pack_id, 24 + b + 1 FROM exch, range(0, 8) t(b) WHERE turn = 6 AND (k >> (7 - b)) & 1 = 1
  -- 0x41 0x00 inside the mask reads as one more frame
  UNION ALL SELECT pack_id, p.pid FROM exch, (VALUES (18), (24)) AS p(pid) WHERE turn = 6 AND k = 65
  UNION ALL SELECT pack_id, 64 + b + 1 FROM exch, range(0, 8) t(b) WHERE turn = 7 AND (k >> (7 - b)) & 1 = 1
  UNION ALL SELECT pack_id, 64 + 24 + b + 1 FROM exch, range(0, 8) t(b) WHERE turn = 7 AND ((99 - k) >> (7 - b)) & 1 = 1)""")
def supported(s):
    return X.decode_supported_pids(exchange_rows(s))


CODE = "CASE WHEN {k} >= 64 THEN 'C' ELSE 'P' END || CAST(({k} & 48) >> 4 AS VARCHAR) || printf('%X', {k} & 15) || printf('%02X', 99 - {k})"


@register("x10_trouble_codes", f"""
SELECT pack_id, exchange_index, {CODE.format(k='k')} || ',P0AC1' AS codes FROM exch WHERE turn = 5""")
def trouble_codes(s):
    return rounded(X.decode_dtcs(exchange_rows(s)).select("pack_id", "exchange_index", F.array_join("codes", ",").alias("codes")))


CTES["dsnap"] = f"""
SELECT session_id, pack_id, ts AS observed_at, k % 2 = 1 AS mil_on,
  CASE WHEN k % 4 = 0 THEN '' WHEN k2 IS NULL THEN '' WHEN k % 4 = 1 THEN {CODE.format(k='k2')} ELSE {CODE.format(k='k2')} || ',P0AC1' END AS codes
FROM exch WHERE turn = 4"""


@register("x10_diagnostic_snapshots", "SELECT session_id, observed_at, mil_on, codes FROM dsnap")
def diagnostic_snapshots(s):
    return rounded(X.decode_diagnostics(exchange_rows(s)).select(
        "session_id", "observed_at", "mil_on", F.array_join("dtcs_active", ",").alias("codes")))


@register("x11_to_observations", f"""
SELECT pack_id, exchange_index, CASE turn WHEN 1 THEN 'power.battery_voltage' WHEN 3 THEN 'environment.ambient_temp_c' ELSE 'speed.vehicle' END AS signal_key,
  round(val, 6) AS value_number, CASE WHEN val IS NOT NULL THEN 'ok' WHEN turn = 8 THEN 'error' WHEN turn = 9 THEN 'not_supported' ELSE 'unavailable' END AS status,
  CASE WHEN val IS NULL THEN NULL WHEN turn = 0 THEN 0.99::DOUBLE WHEN turn = 3 THEN 0.8::DOUBLE WHEN k % 2 = 0 THEN 0.88::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
  CASE WHEN turn = 1 AND k % 2 = 1 AND val IS NOT NULL THEN 'AT_RV' WHEN turn = 1 THEN '01_42' WHEN turn = 3 THEN '01_46' ELSE '01_0D' END AS source_signal,
  CASE turn WHEN 8 THEN 'cmd=010D error=timeout' WHEN 9 THEN 'cmd=010D skipped=unsupported_pid (pid=0x0D block=0x00)'
    WHEN 0 THEN 'cmd=010D resp=' || {RAW_RESPONSE} WHEN 3 THEN 'cmd=0146 resp=41 46 ' || printf('%02X', k) || ' 41 46'
    ELSE 'cmd=0142 resp=' || CASE WHEN k % 2 = 0 THEN '41 42 ' || printf('%02X %02X', k, 99 - k) ELSE 'NO DATA' END ||
      CASE WHEN k % 2 = 1 AND val IS NOT NULL THEN ' | fallback=ATRV resp=ATRV 1' || CAST(k2 % 10 AS VARCHAR) || '.' || CAST(k2 % 7 AS VARCHAR) || 'V' ELSE '' END
  END AS raw_payload_ref
FROM (SELECT *, CAST(CASE turn WHEN 0 THEN CASE WHEN k % 7 IN (3, 4) THEN NULL ELSE k END
    WHEN 1 THEN CASE WHEN k % 2 = 0 THEN (256 * k + 99 - k) / 1000.0 WHEN k2 % 5 <> 0 THEN 10 + k2 % 10 + (k2 % 7) / 10.0 END
    WHEN 3 THEN k - 40 END AS DOUBLE) AS val FROM exch WHERE turn IN (0, 1, 3, 8, 9))""")
def to_observations(s):
    return rounded(X.to_observations(exchange_rows(s)).select(
        "pack_id", "exchange_index", "signal_key", "value_number", "status", "confidence", "source_signal", "raw_payload_ref"))


@register("x12_diagnostic_changes", """
SELECT session_id, observed_at, mil_on, codes FROM (
  SELECT *, lag(mil_on) OVER w AS pm, lag(codes) OVER w AS pc FROM dsnap WINDOW w AS (PARTITION BY session_id ORDER BY observed_at))
WHERE pm IS NULL OR pm <> mil_on OR pc <> codes""")
def diagnostic_changes(s):
    messy = X.decode_diagnostics(exchange_rows(s)).withColumn(
        "dtcs_active", F.concat(F.transform("dtcs_active", lambda c: F.concat(F.lit(" "), F.lower(c))), F.col("dtcs_active"), F.array(F.lit(" "))))
    return rounded(X.diagnostic_changes(messy).select(
        "session_id", "observed_at", "mil_on", F.array_join("dtcs_active", ",").alias("codes")))


@register("x13_signal_summary", """
SELECT vehicle_uid, *, coalesce(round(ok_rows * 100.0::DOUBLE / nullif(signal_rows, 0), 2), 0) AS availability_pct, round(no_data_rows * 100.0::DOUBLE / total_rows, 2) AS no_data_pct
FROM (SELECT count(*) AS total_rows, count(*) FILTER (WHERE signal_key NOT LIKE 'session.%') AS signal_rows, count(*) FILTER (WHERE signal_key LIKE 'session.%') AS session_rows,
  count(*) FILTER (WHERE signal_key NOT LIKE 'session.%' AND status = 'ok') AS ok_rows,
  count(*) FILTER (WHERE upper(coalesce(raw_payload_ref, '')) LIKE '%NO DATA%' OR status = 'unavailable') AS no_data_rows,
  count(*) FILTER (WHERE status = 'error') AS error_rows, vehicle_uid FROM raws GROUP BY vehicle_uid)""".replace("SELECT vehicle_uid, *,", "SELECT *,"))
def signal_summary(s):
    return rounded(X.signal_summary(raw_rows(s), ["vehicle_uid"]))


@register("x14_top_clusters", """
SELECT report, name, n, position FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, name) AS position FROM (
  SELECT report, name, count(*) AS n FROM (
    SELECT 'signal_key' AS report, signal_key AS name FROM raws
    UNION ALL SELECT 'command', regexp_extract(raw_payload_ref, 'cmd=([^ ]+)', 1) FROM raws WHERE raw_payload_ref LIKE '%cmd=%'
    UNION ALL SELECT 'no_data_command', regexp_extract(raw_payload_ref, 'cmd=([^ ]+)', 1) FROM raws WHERE raw_payload_ref LIKE '%cmd=%'
      AND (upper(raw_payload_ref) LIKE '%NO DATA%' OR status = 'unavailable')
    UNION ALL SELECT 'error_command', regexp_extract(raw_payload_ref, 'cmd=([^ ]+)', 1) FROM raws WHERE raw_payload_ref LIKE '%cmd=%' AND status = 'error') GROUP BY ALL))
WHERE position <= 3""")
def top_clusters(s):
    return rounded(X.top_clusters(raw_rows(s), 3))
