"""Column expressions that read diagnostic adapter responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def response_tokens(c: Column) -> Column:
    """Upper-case tokens without separators and without leading or trailing dots and colons."""
    parts = F.split(F.upper(c), r"[\s>,;|]+")
    trimmed = F.transform(parts, lambda t: F.regexp_replace(t, r"^[.:]+|[.:]+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def hex_bytes(c: Column) -> Column:
    """Byte values of a noisy response.

    Neighbouring all-hex tokens are stitched to one run, any other token ends the run; a
    run is read in pairs and an odd last digit is dropped.
    """
    marked = F.transform(response_tokens(c), lambda t: F.when(t.rlike("^[0-9A-F]+$"), t).otherwise(F.lit("!")))
    runs = F.split(F.array_join(marked, ""), "!")
    pairs = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("([0-9A-F]{2})"), F.lit(1))))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def pid_frames(data: Column, mode: int, pid: Column | int, n: int) -> Column:
    """Payloads (n bytes each) of every complete frame answering (mode, pid)."""
    pid = F.lit(pid) if isinstance(pid, int) else pid
    starts = F.sequence(F.lit(0), F.size(data) - F.lit(n + 2))
    hits = F.filter(starts, lambda i: (F.get(data, i) == mode + 0x40) & (F.get(data, i + 1) == pid))
    frames = F.transform(hits, lambda i: F.slice(data, i + 3, n))
    return F.when(F.size(data) >= n + 2, frames).otherwise(F.array().cast("array<array<int>>"))


def pid_payload(data: Column, mode: int, pid: int, n: int) -> Column:
    """The last complete frame, null when there is none."""
    return F.try_element_at(pid_frames(data, mode, pid, n), F.lit(-1))


def adapter_voltage(c: Column) -> Column:
    """Last numeric token (a trailing V allowed) between 6 and 30 volts."""
    numbers = F.transform(response_tokens(c), lambda t: F.regexp_replace(t, "^V+|V+$", ""))
    plain = F.filter(numbers, lambda t: t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?$"))
    volts = F.filter(F.transform(plain, lambda t: t.try_cast("double")), lambda v: (v >= 6.0) & (v <= 30.0))
    return F.try_element_at(volts, F.lit(-1))


def supported_pids(frames: Column, base: Column) -> Column:
    """PID numbers whose bit is set in any of the four-byte masks, ascending and distinct."""

    def of_frame(frame: Column) -> Column:
        bits = F.filter(
            F.sequence(F.lit(0), F.lit(31)),
            lambda b: F.expr("1") == F.getbit(F.get(frame, F.floor(b / 8).cast("int")), F.lit(7) - b % 8),
        )
        return F.transform(bits, lambda b: base + b + 1)

    pids = F.array_sort(F.array_distinct(F.flatten(F.transform(frames, of_frame))))
    return F.filter(pids, lambda p: p.between(1, 255))


def trouble_codes(data: Column) -> Column:
    """Codes after the first 0x43, in order, distinct, padding (0000) skipped."""
    start = F.array_position(data, F.lit(0x43))
    tail = F.slice(data, (start + 1).cast("int"), F.size(data))
    count = F.floor(F.size(tail) / 2).cast("int")

    def code(i: Column) -> Column:
        hi, lo = F.get(tail, i * 2), F.get(tail, i * 2 + 1)
        letter = F.get(F.array(*[F.lit(x) for x in "PCBU"]), F.shiftright(hi, 6))
        text = F.concat(
            letter, F.shiftright(hi.bitwiseAND(F.lit(0x30)), 4).cast("string"), F.hex(hi.bitwiseAND(F.lit(0x0F)).cast("bigint")),
            F.lpad(F.hex(lo.cast("bigint")), 2, "0"),
        )
        return F.when((hi != 0) | (lo != 0), text)

    found = F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(0), count - 1), code)))
    return F.when((start > 0) & (count > 0), found).otherwise(F.array().cast("array<string>"))
