"""Decoding of captured command exchanges, and capture reports.

Input rows: pack_id, session_id, vehicle_uid, exchange_index, started_at, command,
raw_response, error_message, parse_outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.hexframes import adapter_voltage, hex_bytes, pid_frames, pid_payload, supported_pids, trouble_codes
from .series import carry_forward, time_bucket


def parse_payload_ref(df: DataFrame) -> DataFrame:
    """Adds ``command`` and ``response`` read from ``raw_payload_ref``; null where absent."""
    ref = F.coalesce("raw_payload_ref", F.lit(""))
    return df.withColumns(
        {
            "command": F.when(ref.rlike("cmd=[^ ]+"), F.regexp_extract(ref, "cmd=([^ ]+)", 1)),
            "response": F.when(ref.rlike("resp="), F.regexp_extract(ref, "resp=(.*)$", 1)),
        }
    )


def signal_value(command: Column, response: Column) -> Column:
    """Decoded value of a polled standard signal."""
    data = hex_bytes(response)
    a = lambda p: F.get(p, F.lit(0))
    speed = pid_payload(data, 0x01, 0x0D, 1)
    volts = pid_payload(data, 0x01, 0x42, 2)
    ambient = pid_payload(data, 0x01, 0x46, 1)
    return (
        F.when(command == "010D", a(speed).cast("double"))
        .when(command == "0142", (a(volts) * 256 + F.get(volts, F.lit(1))) / 1000.0)
        .when(command == "0146", (a(ambient) - 40).cast("double"))
    )


def decode_signals(exchanges: DataFrame) -> DataFrame:
    """Adds ``value_number`` for standard-signal exchanges."""
    return exchanges.withColumn("value_number", signal_value(F.col("command"), F.col("raw_response")))


def _with_next(exchanges: DataFrame, command: str) -> DataFrame:
    """Response of the directly following exchange of the pack, when it has ``command``."""
    following = exchanges.where(F.col("command") == command).select(
        "pack_id", (F.col("exchange_index") - 1).alias("exchange_index"), F.col("raw_response").alias("next_response")
    )
    return exchanges.join(following, ["pack_id", "exchange_index"], "left")


#: Fixed value: longest payload reference; longer ones end in three dots.
MAX_PAYLOAD_REF = 240


def one_line(response: Column) -> Column:
    """A response without prompts and line breaks."""
    lines = F.split(F.replace(F.coalesce(response, F.lit("")), F.lit(">"), F.lit(" ")), r"[\n\x0B\f\r\u0085\u2028\u2029]+")
    return F.array_join(F.filter(F.transform(lines, _trimmed), lambda x: x != ""), " ")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def payload_ref(text: Column) -> Column:
    """A payload reference, trimmed and cut to its longest size."""
    whole = _trimmed(text)
    return F.when(F.char_length(whole) > MAX_PAYLOAD_REF, F.concat(F.substring(whole, 1, MAX_PAYLOAD_REF - 3), F.lit("..."))).otherwise(whole)


def to_observations(exchanges: DataFrame) -> DataFrame:
    """One reading per polled signal with its status, and what was sent and received as ``raw_payload_ref``.

    A module-voltage poll without a value takes the adapter voltage of the ATRV exchange
    that follows it, with lower confidence.
    """
    commands = [s[0] for s in C.STANDARD_SIGNALS]
    polls = _with_next(exchanges, C.ADAPTER_VOLTAGE[0]).where(F.col("command").isin(commands))

    def lookup(index: int) -> Column:
        out = None
        for s in C.STANDARD_SIGNALS:
            hit = F.col("command") == s[0]
            out = F.when(hit, F.lit(s[index])) if out is None else out.when(hit, F.lit(s[index]))
        return out

    primary = F.when(
        F.col("error_message").isNull() & (F.coalesce("parse_outcome", F.lit("")) != "not_supported"),
        signal_value(F.col("command"), F.col("raw_response")),
    )
    backup = F.when(
        (F.col("command") == "0142") & F.col("error_message").isNull() & F.col("_primary").isNull(),
        adapter_voltage(F.col("next_response")),
    )
    value = F.coalesce("_primary", "_backup")
    pid, command = lookup(2), F.concat(F.lit("cmd="), "command")
    hex2 = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    answered = F.concat(command, F.lit(" resp="), one_line(F.col("raw_response")))
    sent = (
        F.when(F.col("error_message").isNotNull(), F.concat(command, F.lit(" error="), "error_message"))
        # 32 PIDs share a block of the support mask
        .when(F.col("parse_outcome") == "not_supported", F.concat(
            command, F.lit(" skipped=unsupported_pid (pid=0x"), hex2(pid), F.lit(" block=0x"), hex2(F.floor((pid - 1) / 32) * 32), F.lit(")")))
        .when(F.col("_backup").isNotNull(), F.concat(answered, F.lit(f" | fallback={C.ADAPTER_VOLTAGE[0]} resp="), one_line(F.col("next_response"))))
        .otherwise(answered)
    )
    return (
        polls.withColumn("_primary", primary)
        .withColumn("_backup", backup)
        .select(
            "pack_id", "session_id", "vehicle_uid", "exchange_index", F.col("started_at").alias("observed_at"),
            lookup(4).alias("signal_key"), value.alias("value_number"), lookup(5).alias("unit"),
            F.when(value.isNotNull(), "ok")
            .when(F.col("error_message").isNotNull(), "error")
            .when(F.col("parse_outcome") == "not_supported", "not_supported")
            .otherwise("unavailable")
            .alias("status"),
            F.when(F.col("_primary").isNotNull(), lookup(7)).when(F.col("_backup").isNotNull(), C.ADAPTER_VOLTAGE[4]).alias("confidence"),
            F.when(F.col("_backup").isNotNull(), C.ADAPTER_VOLTAGE[3]).otherwise(lookup(6)).alias("source_signal"),
            payload_ref(sent).alias("raw_payload_ref"),
        )
    )


def decode_readiness(exchanges: DataFrame) -> DataFrame:
    """Lamp state and stored-code count of readiness responses (command 0101)."""
    first = F.get(pid_payload(hex_bytes(F.col("raw_response")), 0x01, 0x01, 4), F.lit(0))
    return (
        exchanges.where(F.col("command") == "0101")
        .withColumn("_a", first)
        .where(F.col("_a").isNotNull())
        .select(
            "pack_id", "session_id", "vehicle_uid", "exchange_index", "started_at",
            (F.col("_a").bitwiseAND(F.lit(0x80)) != 0).alias("mil_on"),
            F.col("_a").bitwiseAND(F.lit(0x7F)).cast("bigint").alias("stored_dtc_count"),
        )
    )


def decode_supported_pids(exchanges: DataFrame) -> DataFrame:
    """Supported PIDs per pack, from the bitmask blocks 0100, 0120, 0140, ..."""
    base = F.conv(F.substring("command", 3, 2), 16, 10).cast("int")
    blocks = exchanges.where(F.col("command").rlike("^01[02468ACE]0$")).withColumn("_base", base)
    frames = pid_frames(hex_bytes(F.col("raw_response")), 0x01, F.col("_base"), 4)
    return (
        blocks.select("pack_id", F.explode(supported_pids(frames, F.col("_base"))).alias("pid"))
        .select("pack_id", F.col("pid").cast("bigint").alias("pid"))
        .distinct()
    )


def decode_dtcs(exchanges: DataFrame) -> DataFrame:
    """Adds ``codes`` to the stored-code responses (command 03)."""
    return exchanges.where(F.col("command") == "03").withColumn("codes", trouble_codes(hex_bytes(F.col("raw_response"))))


def decode_diagnostics(exchanges: DataFrame) -> DataFrame:
    """Diagnostic snapshots: readiness with the codes of the 03 exchange that follows it.

    At most as many codes as the readiness response counts; none when it counts zero.
    """
    with_codes = _with_next(exchanges, "03").where(F.col("command") == "0101").select(
        "pack_id", "exchange_index", trouble_codes(hex_bytes(F.col("next_response"))).alias("_codes")
    )
    none = F.array().cast("array<string>")
    codes = F.coalesce("_codes", none)
    kept = F.when(F.col("stored_dtc_count") > 0, F.slice(codes, 1, F.greatest(F.col("stored_dtc_count"), F.lit(1)).cast("int")))
    return decode_readiness(exchanges).join(with_codes, ["pack_id", "exchange_index"]).select(
        "pack_id", "session_id", "vehicle_uid", F.col("started_at").alias("observed_at"), "mil_on",
        F.coalesce(kept, none).alias("dtcs_active"),
    )


def decode_exchanges(exchanges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(readings, diagnostic snapshots, supported PIDs) of captured exchanges."""
    return to_observations(exchanges), decode_diagnostics(exchanges), decode_supported_pids(exchanges)


def normalise_codes(codes: Column) -> Column:
    trimmed = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.upper(F.trim(c)))
    return F.array_distinct(F.filter(trimmed, lambda c: c.isNotNull() & (c != "")))


def diagnostic_changes(diag: DataFrame) -> DataFrame:
    """Snapshots whose state (lamp and codes) differs from the session's previous one.

    The previous state is carried across time buckets, so a long session is spread out.
    """
    codes = normalise_codes(F.col("dtcs_active"))
    state = F.concat(F.when(F.col("mil_on"), "1|").otherwise("0|"), F.array_join("dtcs_active", ","))
    rows = (
        diag.withColumn("dtcs_active", codes)
        .withColumn("state", state)
        .withColumn("_vehicle", F.col("vehicle_uid"))
        .withColumn("vehicle_uid", F.col("session_id"))
        .withColumn("bucket", time_bucket(F.col("observed_at")))
    )
    filled = carry_forward(rows, ["state"])
    changed = F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state"))
    return filled.where(changed).withColumn("vehicle_uid", F.col("_vehicle")).drop(
        "_vehicle", "bucket", "state_at", "prev_state", "prev_state_at"
    )


# ---- capture reports ---------------------------------------------------------------------------------
def _no_data() -> Column:
    text = F.upper(F.coalesce("raw_payload_ref", F.lit("")))
    return text.contains("NO DATA") | (F.col("status") == "unavailable")


def signal_summary(raw: DataFrame, keys=()) -> DataFrame:
    """Totals, availability and NO DATA shares (percent, two digits) of raw rows."""
    signal = ~F.col("signal_key").startswith("session.")
    pct = lambda n, d: F.coalesce(F.round(F.try_divide(F.col(n) * 100.0, F.col(d)), 2), F.lit(0.0))
    return (
        raw.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_rows"), F.count_if(signal).alias("signal_rows"),
            F.count_if(~signal).alias("session_rows"), F.count_if(signal & (F.col("status") == "ok")).alias("ok_rows"),
            F.count_if(_no_data()).alias("no_data_rows"), F.count_if(F.col("status") == "error").alias("error_rows"),
        )
        .withColumn("availability_pct", pct("ok_rows", "signal_rows"))
        .withColumn("no_data_pct", pct("no_data_rows", "total_rows"))
    )


def top_clusters(raw: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent signal keys, commands, NO DATA commands and error commands.

    Rows without a command are not counted in the command reports.
    """
    rows = parse_payload_ref(raw)
    cmd = F.col("command")
    entry = lambda kind, name: F.struct(F.lit(kind).alias("report"), name.alias("name"))
    entries = F.array_compact(
        F.array(
            entry("signal_key", F.col("signal_key")),
            F.when(cmd.isNotNull(), entry("command", cmd)),
            F.when(cmd.isNotNull() & _no_data(), entry("no_data_command", cmd)),
            F.when(cmd.isNotNull() & (F.col("status") == "error"), entry("error_command", cmd)),
        )
    )
    counts = rows.select(F.explode(entries).alias("e")).groupBy("e.report", "e.name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("report").orderBy(F.desc("n"), F.asc("name"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
