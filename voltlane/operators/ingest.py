"""Upload batches: envelope rules, idempotency, ownership, record rules, row tables.

Envelope rules read the nested lists in place, so they need no shuffle. Only lookups
against earlier state (ledger, owners) join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..config import IngestLimits
from ..functions.scalars import map_session_event, temperature_bin, whole_seconds_between
from ..functions.sizes import broadcast_if_small, shuffled
from ..session import table_stage
from .claims import CLAIM, claiming
from .ordering import running_totals


def _any_null(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


# ---- batch rules (first failing rule names the rejection) ------------------------------------
def batch_rule_codes(limits: IngestLimits = IngestLimits()) -> list[tuple[str, Column]]:
    """(code, "rule is violated") in the order the rules are checked."""
    start, end = F.col("capture_window.started_at"), F.col("capture_window.ended_at")
    interval = F.col("capture_window.sample_interval_seconds")
    outside = lambda at: ~at.between(start, end)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    known_events = list(C.SESSION_EVENTS)

    def event_code(e: Column) -> Column:
        return F.when(~e["event_type"].isin(known_events), "session_event_type").when(
            outside(e["observed_at"]), "session_event_window"
        )

    def record_code(r: Column) -> Column:
        return F.when(outside(r["observed_at"]), "record_window").when(
            r["temperature_bin"].isNotNull() & ~r["temperature_bin"].isin(list(C.TEMPERATURE_BINS)),
            "record_temperature_bin",
        )

    # within a list the first bad element decides, as the elements are checked in order
    first_event = F.get(F.filter(F.transform("session_events", event_code), lambda c: c.isNotNull()), F.lit(0))
    first_record = F.get(F.filter(F.transform("records", record_code), lambda c: c.isNotNull()), F.lit(0))
    lacks = lambda item, *fields: F.coalesce(item.isNull() | _any_null([item[f] for f in fields]), F.lit(True))
    listed = lambda name, *fields: F.exists(name, lambda x: lacks(x, *fields))
    malformed = _any_null([F.col(c) for c in ("batch_id", "vehicle_uid", "schema_version", "source")] + [start, end])
    for bad in (
        listed("records", "observed_at", "signal_key", "status"), listed("session_events", "event_type", "observed_at"),
        listed("diagnostics", "observed_at"),
    ):
        malformed = malformed | F.coalesce(bad, F.lit(False))
    return [
        ("malformed", malformed),
        ("source", F.upper("source") != "OBD"),
        ("schema_version", F.col("schema_version") != C.SCHEMA_VERSION),
        ("window_order", end <= start),
        ("sample_interval", ~interval.between(limits.min_interval_seconds, limits.upper_interval_seconds)),
        ("window_length", whole_seconds_between(start, end) > limits.upper_interval_seconds),
        ("too_many_records", size("records") > limits.max_records),
        ("empty_batch", (size("records") == 0) & (size("session_events") == 0) & (size("diagnostics") == 0)),
        ("client_platform", F.lower("client.platform") != "ios"),
        ("session_event_type", first_event == "session_event_type"),
        ("session_event_window", first_event == "session_event_window"),
        ("diagnostic_window", F.exists("diagnostics", lambda d: outside(d["observed_at"]))),
        ("record_window", first_record == "record_window"),
        ("record_temperature_bin", first_record == "record_temperature_bin"),
    ]


def validate_batches(batches: DataFrame, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """Adds ``rejection``: the first violated rule, null for a valid batch."""
    codes = [F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in batch_rule_codes(limits)]
    return batches.withColumn("rejection", F.coalesce(*codes))


def with_source_account(batches: DataFrame) -> DataFrame:
    return batches.withColumn("source_account_id", F.coalesce("client.adapter_fingerprint", F.lit("unknown")))


# ---- idempotency and ownership --------------------------------------------------------------------
def _envelope(vehicle, version, source, start, end) -> Column:
    return F.struct(
        vehicle.alias("vehicle_uid"), version.alias("schema_version"), F.upper(source).alias("source"),
        start.cast("timestamp").alias("started"), end.cast("timestamp").alias("ended"),
    )


def _batch_envelope() -> Column:
    return _envelope(
        F.col("vehicle_uid"), F.col("schema_version"), F.col("source"),
        F.col("capture_window.started_at"), F.col("capture_window.ended_at"),
    )


def _arrival() -> Column:
    """Order of arrival. ``arrival_id`` is unique per upload, so the order is total."""
    return F.struct("received_at", "arrival_id", "user_id", _batch_envelope().alias("envelope"))


def _first_per_batch(batches: DataFrame, name: str) -> DataFrame:
    return batches.groupBy("batch_id").agg(F.min(_arrival()).alias(name))


def _ledger_envelopes(ledger: DataFrame) -> DataFrame:
    known = _envelope(
        F.col("vehicle_uid"), F.col("schema_version"), F.col("source"),
        F.col("capture_started_at"), F.col("capture_ended_at"),
    )
    return ledger.groupBy("batch_id").agg(F.min(known).alias("_known"))


def classify_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds ``outcome``: fresh, duplicate (same five envelope fields) or conflict.

    The first arrival of an id that is not in the ledger is fresh; later ones are compared
    with it. The first arrival comes from a partial aggregate; id facts are brought
    together first, so the uploads take a single join, which Spark splits for skew. There
    is one fact an id, so no side is ever broadcast.
    Needs ``received_at`` and ``arrival_id`` (unique per upload, set by the reader).
    """
    facts = _first_per_batch(batches, "_first").join(shuffled(_ledger_envelopes(ledger)), "batch_id", "left")
    joined = batches.join(shuffled(facts), "batch_id")
    same = _batch_envelope() == F.coalesce("_known", "_first.envelope")
    outcome = (
        F.when(F.col("_known").isNull() & (F.col("arrival_id") == F.col("_first.arrival_id")), "fresh")
        .when(same, "duplicate")
        .otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("_first", "_known")


def classify_ownership(batches: DataFrame, access: DataFrame) -> DataFrame:
    """Adds ``owner`` and ``owned``: the known owner, else the first user to upload."""
    joined = batches.join(shuffled(_owners(batches, access)), "vehicle_uid")
    return joined.withColumn("owned", F.col("owner") == F.col("user_id"))


def _owners(claims: DataFrame, access: DataFrame) -> DataFrame:
    """(vehicle_uid, owner): the known owner, else the user of the first claim."""
    first = claims.groupBy("vehicle_uid").agg(F.min(F.struct("received_at", "arrival_id", "user_id")).alias("_u"))
    known = access.groupBy("vehicle_uid").agg(F.min("user_id").alias("_owner"))
    return first.join(known, "vehicle_uid", "full").select(
        "vehicle_uid", F.coalesce("_owner", "_u.user_id").alias("owner")
    )


def accept_batches(
    batches: DataFrame, ledger: DataFrame, access: DataFrame, limits: IngestLimits = IngestLimits(), stage=None
) -> DataFrame:
    """Full decision per batch: ``outcome`` in rejected, forbidden, fresh, duplicate, conflict.

    Order: rules, then batch id, then owner. A forbidden upload stores nothing, so it
    neither claims its batch id nor the vehicle. Decisions are made on the few envelope
    columns; the nested lists are joined once at the end, by arrival. Each step is written
    by ``stage`` (default: :func:`table_stage`), so no rule or join is evaluated twice and
    the skewed joins stand alone.
    """
    stage = stage or table_stage(batches.sparkSession)
    envelope = ["batch_id", "arrival_id", "received_at", "user_id", "vehicle_uid", "schema_version", "source", "capture_window"]
    checked = stage(validate_batches(batches, limits).select(*envelope, "rejection"), "checked_envelopes")
    valid = checked.where(F.col("rejection").isNull())
    mine = F.coalesce(F.col("user_id") == F.col("owner"), F.lit(False))
    # A forbidden upload claims nothing, and who may upload depends on the claims: both are decided together.
    known = valid.join(shuffled(access.groupBy("vehicle_uid").agg(F.min("user_id").alias("owner"))), "vehicle_uid", "left")
    able = stage(known.where(mine | F.col("owner").isNull()).select(*CLAIM), "able")
    claims = claiming(able.join(shuffled(ledger.select("batch_id")), "batch_id", "left_anti"), stage)
    owned = stage(valid.join(shuffled(_owners(claims, access)), "vehicle_uid", "left").select(*envelope, mine.alias("mine")), "owned_envelopes")
    accepted = stage(classify_batches(owned.where("mine"), ledger).select(*envelope, "outcome"), "classified_envelopes")

    others = owned.where(~F.col("mine"))
    facts = _first_per_batch(accepted, "_held").join(_ledger_envelopes(ledger), "batch_id", "full")
    earlier = F.struct("_held.received_at", "_held.arrival_id") < F.struct("received_at", "arrival_id")
    reference = F.coalesce("_known", F.when(earlier, F.col("_held.envelope")))
    held = others.join(shuffled(facts), "batch_id", "left").withColumn(
        "outcome",
        F.when(reference.isNull(), "forbidden").when(_batch_envelope() == reference, "duplicate").otherwise("conflict"),
    )
    rejected = checked.where(F.col("rejection").isNotNull())
    none = F.lit(None).cast("string").alias("rejection")
    decisions = (
        accepted.select("arrival_id", none, "outcome")
        .unionByName(held.select("arrival_id", none, "outcome"))
        .unionByName(rejected.select("arrival_id", "rejection", F.lit("rejected").alias("outcome")))
    )
    return batches.join(shuffled(decisions), "arrival_id")


# ---- row tables --------------------------------------------------------------------------------------
def explode_records(batches: DataFrame) -> DataFrame:
    """One row per record with its position in the batch."""
    return batches.select(
        "batch_id", "vehicle_uid", "user_id", "received_at", F.posexplode("records").alias("record_index", "r")
    ).select("batch_id", "vehicle_uid", "user_id", "received_at", "record_index", "r.*")


def validate_records(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``error_code`` and ``error_message`` of the first violated record rule.

    The registry is broadcast when its counted size allows, so readings are not shuffled
    by signal key; otherwise an ordinary join by key is used.
    """
    keys = registry.select(F.col("signal_key"), F.lit(True).alias("_known")).dropDuplicates(["signal_key"])
    values = sum(
        (F.col(c).isNotNull().cast("int") for c in ("value_string", "value_bool", "value_json")),
        F.col("value_number").isNotNull().cast("int"),
    )
    status, confidence = F.col("status"), F.col("confidence")
    rules = [
        ("unknown_signal_key", F.col("_known").isNull(), C.RECEIPT_MESSAGES["unknown_signal_key"]),
        ("invalid_status", ~F.coalesce(status.isin(list(C.STATUSES)), F.lit(False)), C.RECEIPT_MESSAGES["invalid_status"]),
        ("invalid_confidence", confidence.isNotNull() & ~confidence.between(0.0, 1.0), C.RECEIPT_MESSAGES["invalid_confidence"]),
        ("invalid_value_fields", values > 1, C.RECEIPT_MESSAGES["invalid_value_fields"]),
        ("missing_value", status.isin(list(C.STATUSES_WITH_VALUE)) & (values == 0), C.RECEIPT_MESSAGES["missing_value"]),
    ]
    code = F.coalesce(*[F.when(bad, F.lit(c)) for c, bad, _ in rules])
    message = F.coalesce(*[F.when(F.col("error_code") == c, F.lit(m)) for c, _, m in rules])
    return (
        records.join(broadcast_if_small(keys), "signal_key", "left")
        .withColumn("error_code", code)
        .withColumn("error_message", message)
        .drop("_known")
    )


def with_temperature_bin(records: DataFrame) -> DataFrame:
    """Given bin, else the bin of an ambient-temperature reading."""
    derived = F.when(F.col("signal_key") == C.AMBIENT, temperature_bin(F.col("value_number")))
    return records.withColumn("temperature_bin", F.coalesce("temperature_bin", derived))


def to_observations(records: DataFrame) -> DataFrame:
    """Accepted records as observation rows; ids are derived from batch and position."""
    return with_temperature_bin(records.where(F.col("error_code").isNull())).select(
        F.sha2(F.concat_ws("|", F.lit("observation"), "batch_id", "record_index"), 256).alias("observation_id"),
        "vehicle_uid", "batch_id", "session_id", "signal_key", "value_number", "value_string", "value_bool",
        "value_json", "unit", "observed_at", F.col("received_at").alias("ingested_at"), F.lit("OBD").alias("source"),
        "source_signal", "status", "confidence", "freshness_ttl_seconds", "temperature_bin",
        F.coalesce("is_temperature_estimated", F.lit(False)).alias("is_temperature_estimated"), "raw_payload_ref",
    )


SESSION_EVENT_KEY = ["vehicle_uid", "session_id", "session_type", "event_type", "observed_at"]


def session_event_rows(batches: DataFrame) -> DataFrame:
    """Session events in storage form, copies included."""
    return (
        batches.select("vehicle_uid", "received_at", F.explode("session_events").alias("e"))
        .withColumn("m", map_session_event(F.col("e.event_type")))
        .where(F.col("m").isNotNull())
        .select(
            F.sha2(
                F.concat_ws("|", F.lit("session"), "vehicle_uid", "e.session_id", "m.session_type", "m.event_type",
                            F.unix_micros(F.col("e.observed_at")).cast("string")), 256,
            ).alias("session_event_id"),
            "vehicle_uid", F.col("e.session_id").alias("session_id"), "m.session_type", "m.event_type",
            F.col("e.observed_at").alias("observed_at"), F.col("received_at").alias("ingested_at"),
            F.lit("OBD").alias("source"), F.col("e.raw_payload_ref").alias("raw_payload_ref"),
        )
    )


def explode_session_events(batches: DataFrame) -> DataFrame:
    """Session events, one row per (vehicle, session, type, event, instant); earliest copy kept."""
    rows = session_event_rows(batches)
    rest = [c for c in rows.columns if c not in SESSION_EVENT_KEY]
    age = F.struct("ingested_at", *[c for c in rest if c != "ingested_at"])
    return rows.groupBy(*SESSION_EVENT_KEY).agg(F.min(age).alias("r")).select(
        "r.session_event_id", *SESSION_EVENT_KEY, "r.ingested_at", "r.source", "r.raw_payload_ref"
    )


def explode_diagnostics(batches: DataFrame) -> DataFrame:
    """MIL_ON or MIL_OFF where the lamp state is given, and DTC_ACTIVE per code."""
    lamp = F.when(F.col("d.mil_on"), "MIL_ON").when(~F.col("d.mil_on"), "MIL_OFF")
    cell = lambda kind, code: F.struct(kind.alias("event_type"), code.alias("code"))
    none = F.lit(None).cast("string")
    codes = F.transform(F.coalesce("d.dtcs_active", F.array().cast("array<string>")), lambda c: cell(F.lit("DTC_ACTIVE"), c))
    events = F.concat(F.array_compact(F.array(F.when(lamp.isNotNull(), cell(lamp, none)))), codes)
    return (
        batches.select("batch_id", "vehicle_uid", "received_at", F.posexplode("diagnostics").alias("n", "d"))
        .select("batch_id", "vehicle_uid", "received_at", "n", "d.observed_at", F.posexplode(events).alias("i", "v"))
        .select(
            F.sha2(F.concat_ws("|", F.lit("diagnostic"), "batch_id", "n", "i"), 256).alias("event_id"),
            "vehicle_uid", "batch_id", F.col("v.event_type").alias("event_type"), F.col("v.code").alias("code"),
            "observed_at", F.col("received_at").alias("ingested_at"), F.lit("OBD").alias("source"),
        )
    )


def ensure_vehicles(vehicle: DataFrame, batches: DataFrame) -> DataFrame:
    """Known vehicles plus the unseen ones of ``batches`` (class bev), first upload deciding."""
    fresh = (
        with_source_account(batches)
        .groupBy("vehicle_uid")
        .agg(F.min(F.struct("received_at", "source_account_id")).alias("f"))
        .join(shuffled(vehicle), "vehicle_uid", "left_anti")
    )
    at = F.col("f.received_at").cast(vehicle.schema["created_at"].dataType)
    known = {
        "vehicle_uid": F.col("vehicle_uid"), "source_account_id": F.col("f.source_account_id"),
        "powertrain_class": F.lit("bev"), "created_at": at, "updated_at": at,
    }
    added = fresh.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in vehicle.schema.fields]
    )
    return vehicle.unionByName(added)


def append_batches(ledger: DataFrame, batches: DataFrame) -> DataFrame:
    """Ledger with one row per accepted batch added."""
    return ledger.unionByName(ledger_rows(batches))


def ledger_rows(batches: DataFrame) -> DataFrame:
    return batches.select(
        "batch_id", "vehicle_uid", "schema_version", F.upper("source").alias("source"),
        F.col("capture_window.started_at").alias("capture_started_at"),
        F.col("capture_window.ended_at").alias("capture_ended_at"), "received_at",
    )


def batch_receipts(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Receipt per accepted batch: counts, error list, seconds to the next upload.

    ``batches`` carries ``outcome``; duplicates report their size and store nothing. The
    error list is bounded by the record limit of a batch.
    """
    failed = F.col("error_code").isNotNull()
    entry = F.struct("record_index", F.col("error_code").alias("code"), F.col("error_message").alias("message"))
    counts = records.groupBy("batch_id").agg(
        F.count_if(~failed).alias("_accepted"), F.array_sort(F.collect_list(F.when(failed, entry))).alias("_errors")
    )
    fresh = F.col("outcome") == "fresh"
    none = F.array().cast("array<struct<record_index:int,code:string,message:string>>")
    size = F.size("records").cast("bigint")
    accepted = F.when(fresh, F.coalesce("_accepted", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return (
        batches.where(F.col("outcome").isin("fresh", "duplicate"))
        .join(shuffled(counts), "batch_id", "left")
        .select(
            "batch_id", "vehicle_uid", F.lit(True).alias("accepted"), (~fresh).alias("duplicate"),
            size.alias("records_received"), accepted.alias("records_accepted"),
            F.when(fresh, size - accepted).otherwise(F.lit(0)).cast("bigint").alias("records_rejected"),
            F.when(fresh, F.coalesce("_errors", none)).otherwise(none).alias("errors"),
            F.coalesce("capture_window.sample_interval_seconds", F.lit(60)).cast("bigint").alias("next_upload_after_seconds"),
        )
    )


def batch_contents(batches: DataFrame) -> DataFrame:
    """Number of signals, diagnostics and session events per batch."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return batches.select(
        "batch_id", size("records").alias("signal_records"), size("diagnostics").alias("diagnostic_events"),
        size("session_events").alias("session_events"),
    )


# ---- raw rows back to batches --------------------------------------------------------------------------
NO_BATCH = "00000000-0000-0000-0000-000000000000"  # fixed value: id of rows without a batch


def raw_rows_to_batches(rows: DataFrame, max_records: int = 5_000, app: str = "fixture-export") -> DataFrame:
    """Upload batches rebuilt from raw telemetry rows (signals and ``session.*`` rows).

    One batch per ``batch_id``; rows are newest first, the window spans their instants. A
    batch comes in parts of ``max_records`` rows, at any size: ``part`` counts them from
    the newest, so the lists of the parts, in order, are those of the batch. Ids and
    windows are the same in all parts, and no list grows without bound. Rows without a
    vehicle or an instant are in no list; the latter are numbered before all others.

    Batches that fit one part are put together in one shuffle; only the rows of larger
    ones are numbered. ``rows`` are counted first, so they are read more than once: give
    rows that are written.
    """
    keys = ["batch_id", "vehicle_uid"]
    rows = rows.withColumn("batch_id", F.coalesce("batch_id", F.lit(NO_BATCH))).where(F.col("vehicle_uid").isNotNull())
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = table_stage(rows.sparkSession)(counts.where(F.col("_n") > max_records).select(*keys), "large_batches")
    if large.isEmpty():
        grouped = _whole_batches(rows, keys)
    else:
        large = broadcast_if_small(large)
        grouped = _whole_batches(rows.join(large, keys, "left_anti"), keys).unionByName(
            _batch_parts(rows.join(large, keys, "left_semi"), keys, max_records)
        )
    return grouped.select(
        "batch_id", "part", F.lit(C.SCHEMA_VERSION).alias("schema_version"), "vehicle_uid", F.lit("OBD").alias("source"),
        F.struct(F.lit("ios").alias("platform"), F.lit(app).alias("app_version"), F.lit(app).alias("adapter_fingerprint")).alias("client"),
        F.struct("started_at", "ended_at", F.lit(60).cast("bigint").alias("sample_interval_seconds")).alias("capture_window"),
        F.col("_records.item").alias("records"), F.col("_events.item").alias("session_events"),
        F.array().cast("array<struct<observed_at:timestamp,mil_on:boolean,dtcs_active:array<string>>>").alias("diagnostics"),
    )


def _lists() -> list[Column]:
    """Aggregates of raw rows: the records and the session events, newest first."""
    is_event = F.col("signal_key").startswith("session.")
    null = lambda kind: F.lit(None).cast(kind)
    record = F.struct(
        "observed_at", "signal_key", "value_number", "value_string", "value_bool", "value_json", null("string").alias("unit"),
        "status", null("double").alias("confidence"), "source_signal", null("bigint").alias("freshness_ttl_seconds"),
        null("string").alias("temperature_bin"), null("boolean").alias("is_temperature_estimated"), "session_id", "raw_payload_ref",
    )
    event = F.struct(F.col("status").alias("event_type"), "observed_at", "session_id", "raw_payload_ref")
    newest = lambda item: F.struct("observed_at", "observation_id", item.alias("item"))
    return [
        F.sort_array(F.collect_list(F.when(~is_event, newest(record))), asc=False).alias("_records"),
        F.sort_array(F.collect_list(F.when(is_event, newest(event))), asc=False).alias("_events"),
    ]


def _window() -> list[Column]:
    return [F.min("observed_at").alias("started_at"), F.max("observed_at").alias("ended_at")]


def _whole_batches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Batches of a single part."""
    return rows.where(F.col("observed_at").isNotNull()).repartition(*keys).groupBy(*keys).agg(*_lists(), *_window()).withColumn("part", F.lit(0))


def _batch_parts(rows: DataFrame, keys: list[str], max_records: int) -> DataFrame:
    """Batches that no list should hold, in parts."""
    order = [F.desc("observed_at"), F.desc("observation_id")]
    hour = -F.floor(F.unix_timestamp(F.col("observed_at").cast("timestamp")) / 3600)
    numbered = running_totals(rows, keys, hour, order, {"_position": F.lit(1)})
    parts = (
        numbered.withColumn("part", F.floor((F.col("_position") - 1) / max_records).cast("int"))
        # own shuffle by part, so that a large batch is spread over tasks
        .repartition(*keys, "part")
        .groupBy(*keys, "part")
        .agg(*_lists())
    )
    return parts.join(shuffled(rows.groupBy(*keys).agg(*_window())), keys)


def batches_to_json(batches: DataFrame) -> DataFrame:
    """Envelopes as JSON text, the inverse of ``parse_batches``."""
    fields = ["batch_id", "schema_version", "vehicle_uid", "source", "client", "capture_window", "records", "session_events", "diagnostics"]
    rest = [c for c in batches.columns if c not in fields]
    return batches.select(*rest, F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("payload"))
