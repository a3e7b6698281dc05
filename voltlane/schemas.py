"""Spark types of the upload envelope and of the relational tables."""

from __future__ import annotations

RECORD = (
    "struct<observed_at: timestamp, signal_key: string, value_number: double, value_string: string, "
    "value_bool: boolean, value_json: string, unit: string, status: string, confidence: double, "
    "source_signal: string, freshness_ttl_seconds: bigint, temperature_bin: string, "
    "is_temperature_estimated: boolean, session_id: string, raw_payload_ref: string>"
)
SESSION_EVENT = "struct<event_type: string, observed_at: timestamp, session_id: string, raw_payload_ref: string>"
DIAGNOSTIC = "struct<observed_at: timestamp, mil_on: boolean, dtcs_active: array<string>>"

BATCH = (
    "batch_id string, schema_version string, vehicle_uid string, source string, "
    "client struct<platform: string, app_version: string, adapter_fingerprint: string>, "
    "capture_window struct<started_at: timestamp, ended_at: timestamp, sample_interval_seconds: bigint>, "
    f"records array<{RECORD}>, session_events array<{SESSION_EVENT}>, diagnostics array<{DIAGNOSTIC}>"
)

RUN_PACK = (
    "id string, session_id string, user_id string, vehicle_uid string, app_version string, "
    "adapter_fingerprint string, adapter_identity_summary string, "
    "initialization_profile_summary string, capture_window_started_at timestamp, "
    "capture_window_ended_at timestamp, sample_interval_seconds bigint, generated_at timestamp, "
    "upload_receipt struct<batch_id: string, ingest_id: string, accepted: boolean, "
    "uploaded_at: timestamp, message: string>, "
    "command_exchanges array<struct<id: string, started_at: timestamp, ended_at: timestamp, "
    "command: string, raw_response: string, error_message: string, parse_outcome: string, "
    "signal_key: string, source_signal: string>>"
)

REGISTRY_FILE = (
    "schema_version string, signals array<struct<signal_key: string, category: string, "
    "value_type: string, canonical_unit: string, priority: string, freshness_ttl_seconds: bigint, "
    "mvp_required: boolean>>"
)

OBSERVATION_COLUMNS = (
    "observation_id", "vehicle_uid", "batch_id", "session_id", "signal_key", "value_number",
    "value_string", "value_bool", "value_json", "unit", "observed_at", "ingested_at", "source",
    "source_signal", "status", "confidence", "freshness_ttl_seconds", "temperature_bin",
    "is_temperature_estimated", "raw_payload_ref",
)

KPI_SNAPSHOT = (
    "snapshot_id string, vehicle_uid string, kpi_key string, kpi_value double, kpi_unit string, "
    "direction string, confidence_level string, sample_count bigint, temperature_bin string, "
    "baseline_temperature_bin string, compare_temperature_bin string, computed_at timestamp_ntz, "
    "valid_from timestamp_ntz, valid_to timestamp_ntz, source_job_id string, "
    "ranking_type string, timeframe string"
)
RANKING_SNAPSHOT = (
    "ranking_snapshot_id string, temperature_bin string, cohort_key string, cohort_size bigint, "
    "sample_gate_passed boolean, vehicle_uid string, rank_position bigint, score double, "
    "confidence_level string, computed_at timestamp_ntz, ranking_type string, timeframe string"
)
