"""Uploads and scalar functions."""

from pyspark.sql import functions as F

from voltlane import constants as C
from voltlane.config import IngestLimits
from voltlane.functions import scalars as P
from voltlane.operators import ingest as I
from voltlane.operators.ordering import percentile_rank
from voltlane.session import table_stage
from voltlane.session import work_folder
from voltlane.sources import batches as B
from voltlane.sources import sinks

from .base import AS_OF, CTES, bin_sql, charger_sql, confidence_sql, json_files, register, rounded

# One upload per user and day, assembled from the telemetry of that day. A number
# ``m`` (0-29) per upload decides which rule it is made to break; 15 and above are valid.
FAULTS = {
    0: "source", 1: "schema_version", 2: "window_order", 3: "sample_interval", 4: "window_length",
    5: "too_many_records", 6: "empty_batch", 7: "client_platform", 8: "session_event_type",
    9: "session_event_window", 10: "diagnostic_window", 11: "record_window", 12: "record_temperature_bin",
}


LIMITS = IngestLimits(max_records=200)


def raw_rows(s):
    """Raw telemetry rows (signals and session events) with the day's batch id."""
    day = F.date_format("observed_at", "yyyyMMdd")
    user = F.regexp_replace("vehicle_uid", "^veh-", "")
    none = F.lit(None)
    signals = s.obs().select(
        "observation_id", "vehicle_uid", "batch_id", "session_id", "observed_at", "signal_key", "source_signal", "status",
        "value_number", "value_string", "value_bool", "value_json", "raw_payload_ref")
    events = s.session_events().select(
        F.col("session_event_id").alias("observation_id"), "vehicle_uid", F.concat(F.lit("bat-"), user, F.lit("-"), day).alias("batch_id"),
        "session_id", "observed_at", P.session_signal_key(F.col("session_type"), F.col("event_type")).alias("signal_key"),
        none.cast("string").alias("source_signal"), F.concat("session_type", F.lit("_session_"), "event_type").alias("status"),
        none.cast("double").alias("value_number"), none.cast("string").alias("value_string"), none.cast("boolean").alias("value_bool"),
        none.cast("string").alias("value_json"), "raw_payload_ref")
    return signals.unionByName(events).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def written_raw_rows(s):
    """The raw rows, derived and written once a query: batches are rebuilt from rows that are read twice."""
    return s.written("raw_rows", lambda: raw_rows(s))


def uploads(s):
    """Rebuilt uploads parsed from JSON, with user, receipt instant and arrival id."""
    text = I.batches_to_json(I.raw_rows_to_batches(written_raw_rows(s)))
    parsed = B.parse_batches(text)
    number = F.regexp_extract("vehicle_uid", r"(\d+)$", 1).cast("bigint")
    day = F.regexp_extract("batch_id", r"-(\d{8})$", 1).cast("bigint")
    return parsed.select(
        "*", F.concat(F.lit("user-"), (number % 20).cast("string")).alias("user_id"),
        F.col("capture_window.ended_at").alias("received_at"), F.col("batch_id").alias("arrival_id"),
        ((number * 31 + day) % 30).alias("m"))


CTES["raws"] = """
SELECT observation_id, vehicle_uid, batch_id, session_id, observed_at, signal_key, status, value_number, value_string, raw_payload_ref FROM obs
UNION ALL
SELECT session_event_id, vehicle_uid, 'bat-' || replace(vehicle_uid, 'veh-', '') || '-' || strftime(observed_at, '%Y%m%d'), session_id, observed_at,
  'session.' || session_type || '.' || event_type, session_type || '_session_' || event_type, NULL, NULL, raw_payload_ref FROM sev"""
CTES["ups"] = """
SELECT batch_id, vehicle_uid, min(observed_at) AS started_at, max(observed_at) AS ended_at,
  count(*) FILTER (WHERE NOT signal_key LIKE 'session.%') AS n_records, count(*) FILTER (WHERE signal_key LIKE 'session.%') AS n_events,
  (CAST(replace(vehicle_uid, 'veh-', '') AS BIGINT) * 31 + CAST(right(batch_id, 8) AS BIGINT)) % 30 AS m,
  'user-' || CAST(CAST(replace(vehicle_uid, 'veh-', '') AS BIGINT) % 20 AS VARCHAR) AS user_id
FROM raws GROUP BY batch_id, vehicle_uid"""


def written_uploads(s):
    """The uploads, written once a query: for those that read them again."""
    return s.written("uploads", lambda: uploads(s))


def faulty_uploads(s, ups=None):
    """Valid uploads (window one second longer), each broken by the rule of its ``m``."""
    ups = uploads(s) if ups is None else ups
    start, end = F.col("capture_window.started_at"), F.col("capture_window.ended_at") + F.expr("INTERVAL 1 SECOND")
    late = end + F.expr("INTERVAL 1 SECOND")
    m = F.col("m")
    window = F.struct(
        start.alias("started_at"),
        F.when(m == 2, start).when(m == 4, start + F.expr("INTERVAL 49 HOURS")).otherwise(end).alias("ended_at"),
        F.when(m == 3, F.lit(30)).when(m == 13, F.lit(None)).otherwise(F.lit(60)).cast("bigint").alias("sample_interval_seconds"))
    rec_type, ev_type = ups.schema["records"].dataType.elementType, ups.schema["session_events"].dataType.elementType

    def made(kind, **values):
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    record = made(rec_type, observed_at=F.when(m == 11, late).otherwise(start), signal_key=F.lit(C.SOC), value_number=F.lit(50.0),
                  status=F.lit("ok"), temperature_bin=F.when(m == 12, F.lit("freezing")))
    event = made(ev_type, event_type=F.when(m == 8, F.lit("nap_start")).otherwise(F.lit("drive_session_start")),
                 observed_at=F.when(m == 9, late).otherwise(start), session_id=F.lit("extra"))
    diag = F.struct(F.when(m == 10, late).otherwise(start).alias("observed_at"), (m % 2 == 0).alias("mil_on"),
                    F.array(F.lit("P0420"), F.lit("U0123")).alias("dtcs_active"))
    many = F.array_repeat(record, LIMITS.max_records + 1)
    empty = lambda c: F.array().cast(ups.schema[c].dataType)
    return ups.select(
        "batch_id", F.when(m == 1, "0.1").otherwise("0.2").alias("schema_version"), "vehicle_uid",
        F.when(m == 0, "SMARTCAR").when(m == 14, "obd").otherwise("OBD").alias("source"),
        F.struct(F.when(m == 7, "android").when(m == 15, F.lit(None)).otherwise("iOS").alias("platform"), F.col("client.app_version").alias("app_version"),
                 F.when(m % 2 == 0, F.concat(F.lit("fp-"), "user_id")).alias("adapter_fingerprint")).alias("client"),
        window.alias("capture_window"),
        F.when(m == 5, many).when(m == 6, empty("records")).when(m.isin(11, 12), F.concat("records", F.array(record))).otherwise(F.col("records")).alias("records"),
        F.when(m == 6, empty("session_events")).when(m.isin(8, 9), F.concat("session_events", F.array(event))).otherwise(F.col("session_events")).alias("session_events"),
        F.when(m.isin(10, 16, 17), F.array(diag)).otherwise(F.col("diagnostics")).alias("diagnostics"),
        "user_id", "received_at", "arrival_id", "m")


FAULT_SQL = "CASE m " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items()) + " END"


# ---- S1, S14, S2, X15 ------------------------------------------------------------------------------
@register("s01_read_batches", """
SELECT batch_id, vehicle_uid, '0.2' AS schema_version, 'OBD' AS source, 'ios' AS platform, started_at, ended_at, n_records, n_events FROM ups
UNION ALL SELECT '{"batch_id": "torn", "records": [', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def read_batches(s):
    """Uploads written as files to the shared folder, one file of them torn, and read from there."""
    text = I.batches_to_json(I.raw_rows_to_batches(written_raw_rows(s))).select(F.col("payload").alias("value"))
    batches, damaged = B.read_batches_and_damage(s.spark, json_files(s, text, "uploads", '{"batch_id": "torn", "records": ['))
    rows = rounded(batches.select(
        "batch_id", "vehicle_uid", "schema_version", "source", F.col("client.platform").alias("platform"),
        F.col("capture_window.started_at").alias("started_at"), F.col("capture_window.ended_at").alias("ended_at"),
        F.size("records").cast("bigint").alias("n_records"), F.size("session_events").cast("bigint").alias("n_events")))
    return rows.unionByName(damaged.select(F.col("content").alias("batch_id")), allowMissingColumns=True)


@register("s02_explode_records", """
SELECT batch_id, vehicle_uid, row_number() OVER (PARTITION BY batch_id ORDER BY observed_at DESC, observation_id DESC) - 1 AS record_index,
  signal_key, observed_at, round(value_number, 6) AS value_number, value_string, raw_payload_ref
FROM raws WHERE NOT signal_key LIKE 'session.%'""")
def explode_records(s):
    return rounded(I.explode_records(uploads(s)).select(
        "batch_id", "vehicle_uid", "record_index", "signal_key", "observed_at", "value_number", "value_string", "raw_payload_ref"))


@register("s03_explode_session_events", """
SELECT vehicle_uid, session_id, session_type, event_type, observed_at, raw_payload_ref FROM sev""")
def explode_session_events(s):
    ups = uploads(s)
    copies = ups.unionByName(ups.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 HOUR")))
    return rounded(I.explode_session_events(copies).select(
        "vehicle_uid", "session_id", "session_type", "event_type", "observed_at", "raw_payload_ref"))


@register("s04_explode_diagnostics", """
SELECT batch_id, vehicle_uid, t.event_type, t.code, started_at AS observed_at FROM ups CROSS JOIN
  (VALUES ('MIL', CAST(NULL AS VARCHAR)), ('DTC_ACTIVE', 'P0420'), ('DTC_ACTIVE', 'U0123')) AS t(event_type, code)
WHERE m IN (16, 17) AND t.event_type <> 'MIL'
UNION ALL SELECT batch_id, vehicle_uid, CASE WHEN m = 16 THEN 'MIL_ON' ELSE 'MIL_OFF' END, NULL, started_at FROM ups WHERE m IN (16, 17)""")
def explode_diagnostics(s):
    ok = I.validate_batches(faulty_uploads(s), LIMITS).where(F.col("rejection").isNull())
    return rounded(I.explode_diagnostics(ok).select("batch_id", "vehicle_uid", "event_type", "code", "observed_at"))


@register("s05_ensure_vehicles", """
SELECT vehicle_uid, make, powertrain_class FROM veh
UNION ALL SELECT DISTINCT 'veh-new-' || CAST(user_id AS VARCHAR), NULL, 'bev' FROM events WHERE user_id % 2 = 0""")
def ensure_vehicles(s):
    """Every second user's uploads come from a vehicle that is not known yet."""
    number = F.regexp_extract("vehicle_uid", r"(\d+)$", 1).cast("bigint")
    renamed = uploads(s).withColumn(
        "vehicle_uid", F.when(number % 2 == 0, F.concat(F.lit("veh-new-"), number.cast("string"))).otherwise(F.col("vehicle_uid")))
    return I.ensure_vehicles(s.vehicles(), renamed).select("vehicle_uid", "make", "powertrain_class")


@register("s06_append_batches", """
SELECT batch_id, vehicle_uid, 'OBD' AS source, started_at AS capture_started_at, ended_at AS capture_ended_at FROM ups""")
def append_batches(s):
    rows = I.ledger_rows(uploads(s))
    early = F.col("capture_started_at") < F.lit("2024-01-10").cast("timestamp")
    ledger, rest = rows.where(early), uploads(s).where(F.col("capture_window.started_at") >= F.lit("2024-01-10").cast("timestamp"))
    return rounded(I.append_batches(ledger, rest).drop("schema_version", "received_at"))


@register("s07_write_observations", """
SELECT CAST(observed_at AS DATE) AS observed_date, signal_key, count(*) AS n, round(sum(value_number), 2) AS total
FROM (SELECT * FROM obs WHERE status IN ('ok', 'stale') OR value_number IS NOT NULL OR value_string IS NOT NULL) GROUP BY ALL""")
def write_observations(s):
    records = I.validate_records(I.explode_records(uploads(s)), B.registry(s.spark))
    path = work_folder(s.spark, "observations") + "/obs"
    sinks.write_observations(I.to_observations(records), path)
    return rounded(s.spark.read.parquet(path).groupBy("observed_date", "signal_key").agg(
        F.count("*").alias("n"), F.round(F.sum("value_number"), 2).alias("total")), 2)


@register("s11_registry", """
SELECT signal_key, count(*) AS readings FROM obs GROUP BY ALL UNION ALL SELECT '{"signals": 1', 0""")
def registry(s):
    """A registry file beside a torn one, read and joined with the readings."""
    from voltlane.functions.sizes import broadcast_if_small

    known = B.registry(s.spark)
    text = known.agg(F.to_json(F.struct(F.lit("0.2").alias("schema_version"), F.collect_list(F.struct(*known.columns)).alias("signals"))).alias("value"))
    rows, damaged = B.read_registry(s.spark, json_files(s, text, "registry", '{"signals": 1'))
    counts = s.obs().join(broadcast_if_small(rows.select("signal_key", "category")), "signal_key").groupBy("signal_key").agg(F.count("*").alias("readings"))
    return counts.unionByName(damaged.select(F.col("content").alias("signal_key"), F.lit(0).cast("bigint").alias("readings")))


@register("s14_raw_rows_to_batches", """
SELECT batch_id, part, ups.vehicle_uid, started_at, ended_at, p.n_records, p.n_events, signal_order
FROM ups JOIN (
  SELECT batch_id, vehicle_uid, part, count(*) FILTER (WHERE NOT is_event) AS n_records, count(*) FILTER (WHERE is_event) AS n_events,
    string_agg(CASE WHEN NOT is_event THEN signal_key END, ',' ORDER BY n) AS signal_order
  FROM (SELECT batch_id, vehicle_uid, signal_key, signal_key LIKE 'session.%' AS is_event,
      row_number() OVER (PARTITION BY batch_id, vehicle_uid ORDER BY observed_at DESC, observation_id DESC) AS n, (n - 1) // 3 AS part FROM raws)
  GROUP BY ALL) AS p USING (batch_id, vehicle_uid)""")
def rebuild(s):
    """Parts of three rows, so that most batches come in several."""
    ups = I.raw_rows_to_batches(written_raw_rows(s), max_records=3)
    order = F.when(F.size("records") > 0, F.array_join(F.col("records.signal_key"), ","))
    return rounded(ups.select(
        "batch_id", F.col("part").cast("bigint").alias("part"), "vehicle_uid", F.col("capture_window.started_at").alias("started_at"), F.col("capture_window.ended_at").alias("ended_at"),
        F.size("records").cast("bigint").alias("n_records"), F.size("session_events").cast("bigint").alias("n_events"), order.alias("signal_order")))


@register("x15_batch_contents", """
SELECT batch_id, n_records AS signal_records, CAST(0 AS BIGINT) AS diagnostic_events, n_events AS session_events FROM ups""")
def batch_contents(s):
    return I.batch_contents(uploads(s))


# ---- I1-I13 -----------------------------------------------------------------------------------------------
@register("i01_i13_validate_batches", f"SELECT batch_id, {FAULT_SQL} AS rejection FROM ups")
def validate_batches(s):
    return I.validate_batches(faulty_uploads(s), LIMITS).select("batch_id", "rejection")


def broken(s):
    """Valid uploads of which each lacks a required field, chosen by its ``m``; every thirteenth and the rest are whole."""
    ups, window = uploads(s), F.col("capture_window")
    lose = lambda n, whole: F.when(F.col("m") % 13 == n, F.lit(None)).otherwise(whole)
    without = lambda name, n, f: F.when(
        (F.col("m") % 13 == n) & (F.size(name) > 0), F.transform(name, lambda x: x.withField(f, F.lit(None).cast("string" if f != "observed_at" else "timestamp")))
    ).otherwise(F.col(name))
    ups = ups.withColumn("records", without("records", 5, "observed_at")).withColumn("records", without("records", 6, "signal_key"))
    ups = ups.withColumn("records", without("records", 7, "status")).withColumn("session_events", without("session_events", 8, "event_type"))
    ups = ups.withColumn("session_events", without("session_events", 9, "observed_at"))
    return ups.withColumns({
        "schema_version": lose(1, F.col("schema_version")), "source": lose(2, F.col("source")),
        "capture_window": F.struct(
            lose(3, window["started_at"]).alias("started_at"), lose(4, window["ended_at"]).alias("ended_at"), window["sample_interval_seconds"].alias("sample_interval_seconds"),
        ),
    })


@register("i00_malformed", """
SELECT batch_id, ups.vehicle_uid, m % 13 IN (1, 2, 3, 4) OR m % 13 IN (5, 6, 7) AND n_records > 0 OR m % 13 IN (8, 9) AND n_events > 0 AS malformed FROM ups""")
def malformed(s):
    judged = I.validate_batches(broken(s), LIMITS)
    return judged.select("batch_id", "vehicle_uid", F.coalesce(F.col("rejection") == "malformed", F.lit(False)).alias("malformed"))


def _rule(name, code):
    number = {v: k for k, v in FAULTS.items()}[code]

    @register(name, f"SELECT batch_id, vehicle_uid FROM ups WHERE m = {number}")
    def query(s):
        return I.validate_batches(faulty_uploads(s), LIMITS).where(F.col("rejection") == code).select("batch_id", "vehicle_uid")


for i, code in enumerate(FAULTS.values(), 1):
    _rule(f"i{i:02d}_rule_{code}", code)


@register("i14_classify_batches", """
SELECT batch_id, t.try, CASE t.try WHEN 0 THEN CASE WHEN m % 3 = 0 THEN 'duplicate' ELSE 'fresh' END
  WHEN 1 THEN 'duplicate' ELSE CASE WHEN m % 2 = 0 THEN 'conflict' ELSE 'duplicate' END END AS outcome
FROM ups CROSS JOIN (VALUES (0), (1), (2)) AS t(try)""")
def classify_batches(s):
    """Every upload sent three times; the third changes its window for even ``m``; a third is in the ledger."""
    ups = uploads(s)
    tries = ups.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("try"))
    changed = F.struct(
        "capture_window.started_at",
        F.when((F.col("try") == 2) & (F.col("m") % 2 == 0), F.col("capture_window.ended_at") + F.expr("INTERVAL 1 HOUR"))
        .otherwise(F.col("capture_window.ended_at")).alias("ended_at"), "capture_window.sample_interval_seconds")
    tries = tries.withColumn("capture_window", changed).withColumn(
        "arrival_id", F.concat("batch_id", F.lit("/"), F.col("try").cast("string")))
    ledger = I.ledger_rows(ups.where(F.col("m") % 3 == 0))
    return I.classify_batches(tries, ledger).select("batch_id", F.col("try").cast("bigint").alias("try"), "outcome")


@register("i15_classify_ownership", """
SELECT batch_id, t.who, CASE WHEN vehicle_uid IN (SELECT vehicle_uid FROM acc WHERE user_id <> 'user-0') THEN t.who = 0
  ELSE t.who = 1 END AS owned FROM ups CROSS JOIN (VALUES (0), (1)) AS t(who)""")
def classify_ownership(s):
    """A stranger uploads everything one hour earlier; vehicles of user-0 have no owner yet."""
    who = F.explode(F.array(F.lit(0), F.lit(1))).alias("who")
    both = uploads(s).select("*", who).select(
        "*").withColumn("user_id", F.when(F.col("who") == 1, F.lit("stranger")).otherwise(F.col("user_id"))).withColumn(
        "received_at", F.when(F.col("who") == 1, F.col("received_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("received_at")))
    known = s.access().where(F.col("user_id") != "user-0")
    return I.classify_ownership(both, known).select("batch_id", F.col("who").cast("bigint").alias("who"), "owned")


@register("i14_i15_accept_batches", f"""
SELECT batch_id, t.who, CASE WHEN {FAULT_SQL} IS NOT NULL THEN 'rejected' WHEN t.who = 0 THEN 'fresh' ELSE 'duplicate' END AS outcome
FROM ups CROSS JOIN (VALUES (0), (1)) AS t(who)""")
def accept_batches(s):
    """A stranger replays every upload later: an equal envelope is reported as a duplicate, not as forbidden."""
    ups = written_uploads(s)
    both = faulty_uploads(s, ups).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("who"))
    stranger = F.col("who") == 1
    both = both.withColumn("user_id", F.when(stranger, F.lit("stranger")).otherwise(F.col("user_id"))).withColumn(
        "received_at", F.when(stranger, F.col("received_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("received_at"))).withColumn(
        "arrival_id", F.concat("arrival_id", F.lit("/"), F.col("who").cast("string")))
    ledger = I.ledger_rows(ups).where(F.lit(False))
    return I.accept_batches(both, ledger, s.access(), LIMITS, table_stage(s.spark)).select("batch_id", F.col("who").cast("bigint").alias("who"), "outcome")


@register("i16_source_account", """
SELECT batch_id, CASE WHEN m % 2 = 0 THEN 'fp-' || user_id ELSE 'unknown' END AS source_account_id FROM ups""")
def source_account(s):
    return I.with_source_account(faulty_uploads(s)).select("batch_id", "source_account_id")


# ---- R1-R7 ----------------------------------------------------------------------------------------------------
CTES["recs"] = f"""
SELECT o.*, b.batch_id AS bid, event_id % 9 AS f,
  row_number() OVER (PARTITION BY o.batch_id ORDER BY o.observed_at DESC, o.observation_id DESC) - 1 AS record_index
FROM obs o JOIN ups b ON o.batch_id = b.batch_id"""
RECORD_CODE = """CASE WHEN f = 1 THEN 'unknown_signal_key' WHEN f = 2 THEN 'invalid_status' WHEN f = 3 THEN 'invalid_confidence'
  WHEN f = 4 AND value_number IS NOT NULL THEN 'invalid_value_fields' WHEN f = 5 AND status IN ('ok', 'stale') THEN 'missing_value' END"""


def faulty_records(s, ups=None):
    """Records broken by the event number modulo 9 (1-5)."""
    rows = I.explode_records(uploads(s) if ups is None else ups)
    # the signals among the raw rows, which are written; session events have no source signal
    obs = written_raw_rows(s).where(F.col("source_signal").isNotNull()).select(
        "batch_id", "observed_at", "signal_key", F.col("source_signal").alias("source_signal"),
        (F.regexp_extract("observation_id", r"obs-(\d+)-", 1).cast("bigint") % 9).alias("f"))
    f = F.col("f")
    joined = rows.join(obs, ["batch_id", "observed_at", "signal_key", "source_signal"])
    return joined.withColumns({
        "signal_key": F.when(f == 1, F.concat(F.lit("x."), "signal_key")).otherwise(F.col("signal_key")),
        "status": F.when(f == 2, F.lit("great")).otherwise(F.col("status")),
        "confidence": F.when(f == 3, F.lit(1.5)).otherwise(F.lit(0.5)),
        "value_string": F.when(f == 4, F.lit("also")).when(f == 5, F.lit(None)).otherwise(F.col("value_string")),
        "value_number": F.when(f != 5, F.col("value_number")),
    })


@register("r01_r05_validate_records", f"SELECT batch_id, record_index, {RECORD_CODE} AS error_code FROM recs")
def validate_records(s):
    return I.validate_records(faulty_records(s), B.registry(s.spark)).select(
        "batch_id", F.col("record_index").cast("bigint").alias("record_index"), "error_code")


def _record_rule(name, code):
    @register(name, f"SELECT batch_id, record_index FROM recs WHERE {RECORD_CODE} = '{code}'")
    def query(s):
        rows = I.validate_records(faulty_records(s), B.registry(s.spark)).where(F.col("error_code") == code)
        return rows.select("batch_id", F.col("record_index").cast("bigint").alias("record_index"))


for i, code in enumerate(
    ("unknown_signal_key", "invalid_status", "invalid_confidence", "invalid_value_fields", "missing_value"), 1
):
    _record_rule(f"r{i:02d}_{code}", code)


@register("r06_temperature_bin", f"""
SELECT batch_id, record_index, {bin_sql("CASE WHEN signal_key = 'environment.ambient_temp_c' THEN value_number END")} AS temperature_bin FROM recs""")
def derived_bin(s):
    return I.with_temperature_bin(I.explode_records(uploads(s))).select(
        "batch_id", F.col("record_index").cast("bigint").alias("record_index"), "temperature_bin")


@register("r07_batch_receipts", f"""
SELECT batch_id, FALSE AS duplicate, count(*) AS records_received, count(*) FILTER (WHERE code IS NULL) AS records_accepted,
  count(*) FILTER (WHERE code IS NOT NULL) AS records_rejected,
  coalesce(string_agg(CAST(record_index AS VARCHAR) || ':' || code, ',' ORDER BY record_index) FILTER (WHERE code IS NOT NULL), '') AS errors,
  CAST(60 AS BIGINT) AS next_upload_after_seconds
FROM (SELECT *, {RECORD_CODE} AS code FROM recs) GROUP BY batch_id""")
def receipts(s):
    ups = written_uploads(s)
    records = I.validate_records(faulty_records(s, ups), B.registry(s.spark))
    fresh = ups.where(F.size("records") > 0).withColumn("outcome", F.lit("fresh"))
    errors = F.transform("errors", lambda e: F.concat(e["record_index"].cast("string"), F.lit(":"), e["code"]))
    return I.batch_receipts(fresh, records).select(
        "batch_id", "duplicate", "records_received", "records_accepted", "records_rejected",
        F.array_join(errors, ",").alias("errors"), "next_upload_after_seconds")


# ---- P1-P16 over the tables -----------------------------------------------------------------------------------------
@register("p01_temperature_bin", f"SELECT event_id, {bin_sql('(k % 45 - 12 + value / 100.0)')} AS bin FROM e1")
def p01(s):
    return s.events().select("event_id", P.temperature_bin(F.col("k") % 45 - 12 + F.col("value") / 100.0).alias("bin"))


@register("p02_charger_type", f"SELECT l_orderkey, l_linenumber, {charger_sql('p_type')} AS charger FROM lineitem JOIN part ON l_partkey = p_partkey")
def p02(s):
    rows = s.raw("lineitem").join(s.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(rows.select("l_orderkey", "l_linenumber", P.charger_type(F.col("p_type")).alias("charger")))


@register("p03_parse_ts", """
SELECT event_id, CASE WHEN k % 5 = 4 THEN NULL ELSE date_trunc('second', ts) - CASE WHEN k % 5 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS parsed FROM e1""")
def p03(s):
    k = F.col("k")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 5 == 0, F.concat(text, F.lit("Z"))).when(k % 5 == 1, F.concat(text, F.lit("+02:00"))).when(
        k % 5 == 2, F.concat(text, F.lit(".000+00:00"))).when(k % 5 == 3, F.concat(F.lower(text), F.lit("z"))).otherwise(text)
    return rounded(s.events().select("event_id", P.parse_ts(text).alias("parsed")))


@register("p04_timeframes", "SELECT timeframe, cutoff, count(*) AS events FROM e1 JOIN tf4 ON ts >= cutoff GROUP BY ALL")
def p04(s):
    from voltlane.functions.sizes import broadcast_if_small

    tf = broadcast_if_small(P.timeframe_table(s.spark, AS_OF, ("7d", "30d", "90d", "180d")))
    return s.events().join(tf, F.col("ts") >= F.col("cutoff")).groupBy("timeframe", "cutoff").agg(F.count("*").alias("events"))


@register("p05_year_band", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 2 AS VARCHAR) END AS band FROM orders""")
def p05(s):
    year = F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate"))
    return s.raw("orders").select("o_orderkey", P.year_band(year).alias("band"))


@register("p06_cohort_key", "SELECT vehicle_uid, cohort_key FROM cat_veh")
def p06(s):
    return s.vehicles().select("vehicle_uid", P.cohort_key(F.col("make"), F.col("model"), F.col("trim"), F.col("model_year")).alias("cohort_key"))


@register("p07_wh_per_km", """
SELECT event_id, CASE WHEN k > 50 AND value > 0 THEN round((k - 50) / 100.0 * 75.0 * 1000.0 / value, 6) END AS wh FROM e1""")
def p07(s):
    return rounded(s.events().select("event_id", P.wh_per_km((F.col("k") - 50).cast("double"), F.col("value"), 75.0).alias("wh")))


@register("p08_confidence", f"SELECT event_id, {confidence_sql('k')} AS confidence FROM e1")
def p08(s):
    return s.events().select("event_id", P.confidence(F.col("k")).alias("confidence"))


@register("p09_temperature_score", """
SELECT event_id, round(least(greatest(0.45 * least(value * 2, 200) + 0.35 * least(k * 3.0, 200) + 0.20 * (100 - least(greatest(2 * CASE WHEN k % 3 = 0 THEN 50 ELSE k * 1.0 END, 0), 100)), 0), 100), 6) AS score FROM e1""")
def p09(s):
    k = F.col("k").cast("double")
    return rounded(s.events().select("event_id", P.temperature_score(F.col("value") * 2, k * 3, F.when(F.col("k") % 3 != 0, k)).alias("score")))


@register("p10_family_score", """
SELECT user_id, 'ev_range_efficiency' AS family, CASE WHEN est IS NULL THEN 0 ELSE round(0.65 * CASE WHEN net IS NOT NULL
    THEN least(greatest(100 - net / 3.0, 0), 100) ELSE least(greatest(100 - coalesce(dep, 50), 0), 100) END
  + 0.35 * least(greatest(est / 4.0, 0), 100), 6) END AS score
FROM (SELECT user_id, max(value) FILTER (WHERE event_type = 'view' AND k % 4 = 0) AS est, max(value) FILTER (WHERE event_type = 'click' AND k % 8 = 0) AS net,
  max(value) FILTER (WHERE event_type = 'error' AND k % 16 = 0) AS dep FROM e1 GROUP BY ALL)""")
def p10(s):
    pick = lambda t, n: F.max(F.when((F.col("event_type") == t) & (F.col("k") % n == 0), F.col("value")))
    wide = s.events().groupBy("user_id").agg(pick("view", 4).alias("est"), pick("click", 8).alias("net"), pick("error", 16).alias("dep"))
    cols = {"ev_estimated_practical_range": "est", "ev_net_energy_efficiency": "net", "soc_depletion_rate_per_100km": "dep"}
    kpi = lambda key: F.col(cols[key]) if key in cols else F.lit(None).cast("double")
    return rounded(wide.select("user_id", F.lit(C.RANGE).alias("family"), P.family_score(F.lit(C.RANGE), kpi).alias("score")))


@register("p11_map_session_event", """
SELECT event_id, CASE k % 5 WHEN 4 THEN NULL WHEN 0 THEN 'drive' WHEN 1 THEN 'drive' ELSE 'charging' END AS session_type,
  CASE k % 5 WHEN 4 THEN NULL WHEN 0 THEN 'start' WHEN 2 THEN 'start' ELSE 'stop' END AS kind FROM e1""")
def p11(s):
    names = [*C.SESSION_EVENTS, "something_else"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") % 5 + 1)
    m = P.map_session_event(name)
    return s.events().select("event_id", m["session_type"].alias("session_type"), m["event_type"].alias("kind"))


@register("p12_percentile_rank", """
SELECT event_id, CAST(floor(CASE WHEN event_type = 'error' THEN
    count(*) OVER (PARTITION BY event_type ORDER BY value DESC RANGE UNBOUNDED PRECEDING)
  ELSE count(*) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) END
  * 1.0::DOUBLE / count(*) OVER (PARTITION BY event_type) * 100 + 0.5) AS BIGINT) AS percentile FROM events""")
def p12(s):
    direction = F.when(F.col("event_type") == "error", "lower_is_better").otherwise("higher_is_better")
    rows = s.raw("events").select("event_id", "event_type", "value", direction.alias("direction"))
    return percentile_rank(rows, ["event_type"], "value", "direction").select("event_id", "percentile")


@register("p13_session_signal_key", "SELECT session_event_id, 'session.' || session_type || '.' || event_type AS signal_key FROM sev")
def p13(s):
    return s.session_events().select("session_event_id", P.session_signal_key(F.col("session_type"), F.col("event_type")).alias("signal_key"))


@register("p14_to_real", "SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS stored FROM events")
def p14(s):
    return s.raw("events").select("event_id", P.to_real(F.col("value")).alias("stored"))


@register("p16_kpi_catalog", """
SELECT ranking_type, kpi_key, kpi_unit, direction, count(*) AS snapshots FROM kpi_charge GROUP BY ALL""")
def p16(s):
    from voltlane.functions.sizes import broadcast_if_small
    from voltlane.operators import kpis as K

    rows = K.charging_kpis(s.sessions(), AS_OF, s.tf()).select("ranking_type", "kpi_key")
    catalog = broadcast_if_small(B.kpi_catalog(s.spark).select("ranking_type", "kpi_key", "kpi_unit", "direction"))
    return rows.join(catalog, ["ranking_type", "kpi_key"]).groupBy("ranking_type", "kpi_key", "kpi_unit", "direction").agg(
        F.count("*").alias("snapshots"))
