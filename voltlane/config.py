"""Tunable settings, passed to the operators as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TemperatureGates:
    """Evidence a vehicle needs before temperature KPIs are emitted."""

    cold_km: float = 20.0
    mild_km: float = 20.0
    cold_sessions: int = 1
    mild_sessions: int = 1
    sensitivity_points: int = 6


@dataclass(frozen=True)
class IngestLimits:
    """Bounds of an upload batch."""

    min_interval_seconds: int = 60
    max_interval_seconds: int = 86_400
    max_records: int = 5_000

    @property
    def upper_interval_seconds(self) -> int:
        return max(self.max_interval_seconds, self.min_interval_seconds)
