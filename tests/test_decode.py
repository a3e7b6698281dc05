import pytest
from pyspark.sql import functions as F

from voltlane.functions import hexframes as H
from voltlane.operators.decode import signal_value, to_observations


def one(spark, raw, build):
    return spark.createDataFrame([(raw,)], "r string").select(build(F.col("r")).alias("x")).first().x


@pytest.mark.parametrize("command, raw, want", [
    ("010D", "41 0D 28\r>", 40.0),
    ("010D", "410D14\r>", 20.0),
    ("010D", "SEARCHING...\r41 0D 2A\r>\r>\r", 42.0),
    ("010D", "NO DATA\r>", None),
    ("010D", "41 0D\r>", None),
    ("0142", "41 42 0D 9A\r>", 3.482),
    ("0142", "41 42 0D 9A 41 42 0D A0\r>", 3.488),
    ("0146", "41 46 22\r>", -6.0),
])
def test_signals(spark, command, raw, want):
    got = one(spark, raw, lambda r: signal_value(F.lit(command), r))
    assert got == pytest.approx(want) if want is not None else got is None


def test_adapter_voltage(spark):
    assert one(spark, "ATRV\r12.6V\r>", H.adapter_voltage) == pytest.approx(12.6)
    assert one(spark, "ATRV 12.6d\r>", H.adapter_voltage) is None
    assert one(spark, "ATRV 99.9V", H.adapter_voltage) is None


def test_trouble_codes(spark):
    codes = lambda r: H.trouble_codes(H.hex_bytes(r))
    assert one(spark, "43 01 0A C1 23 00 00\r>", codes) == ["P010A", "U0123"]
    assert one(spark, "NO DATA\r>", codes) == []
    assert one(spark, "43", codes) == []
    assert one(spark, "43 01 0A 01 0A", codes) == ["P010A"]


@pytest.mark.parametrize("base, raw, wanted, absent", [
    (0x00, "41 00 00 08 00 00\r>", {0x0D}, {0x42}),
    (0x40, "41 40 44 00 00 00\r>", {0x42, 0x46}, set()),
    (0x40, "414044000000\r>", {0x42, 0x46}, set()),
    (0x00, "SEARCHING... 41000 008000 0\r>", {0x0D}, set()),
    (0x40, "41 40 44 00 00 00 41 40 00 00 00 21\r>", {0x42, 0x46, 0x5B, 0x60}, set()),
    (0x00, "SEARCHING... HIHI 410000080000 NO DATA\r>", {0x0D}, set()),
    (0x40, "NO DATA\r>", set(), {0x42}),
])
def test_supported_pids(spark, base, raw, wanted, absent):
    pids = set(one(spark, raw, lambda r: H.supported_pids(H.pid_frames(H.hex_bytes(r), 1, base, 4), F.lit(base))))
    assert wanted <= pids and not (absent & pids)


def test_voltage_poll_falls_back_to_the_adapter(spark):
    schema = ("pack_id string, session_id string, vehicle_uid string, exchange_index int, started_at timestamp, "
              "command string, raw_response string, error_message string, parse_outcome string")
    rows = [("p", "s", "v", 0, None, "0142", "NO DATA", None, "unavailable"), ("p", "s", "v", 1, None, "ATRV", "12.4V", None, "ok"),
            ("p", "s", "v", 2, None, "0142", None, "timeout", "error"), ("p", "s", "v", 3, None, "ATRV", "12.4V", None, "ok")]
    got = {r.exchange_index: r for r in to_observations(spark.createDataFrame(rows, schema)).collect()}
    assert (got[0].value_number, got[0].status, got[0].source_signal, got[0].confidence) == (12.4, "ok", "AT_RV", 0.75)
    assert (got[2].value_number, got[2].status, got[2].source_signal) == (None, "error", "01_42")
