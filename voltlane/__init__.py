"""voltlane: EV telemetry KPIs, rankings and reads as PySpark DataFrame jobs."""
