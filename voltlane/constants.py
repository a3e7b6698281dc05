"""Fixed values of the telemetry contract.

Every literal in this file must equal the contract's value for results to be right:
names, enums, gates and units are stated plainly and in their natural order.
"""

from __future__ import annotations

# -- fixed values: ranking families --------------------------------------------------
RANGE = "ev_range_efficiency"
CHARGING = "ev_charging_performance"
COMPOSITE = "ev_composite"
TEMPERATURE = "ev_temperature_impact"
FAMILIES = (RANGE, CHARGING, COMPOSITE, TEMPERATURE)

# -- fixed values: timeframe tokens and their length in days --------------------------
TIMEFRAME_DAYS = {"7d": 7, "30d": 30, "90d": 90, "180d": 180}
LOCKED_TIMEFRAMES = ("30d", "90d", "180d")

# -- fixed values: enums ----------------------------------------------------------------
TEMPERATURE_BINS = ("very_cold", "cold", "cool", "mild", "hot")
COLD_BINS = ("cold", "very_cold")
STATUSES = ("ok", "stale", "unavailable", "not_supported", "permission_denied", "error")
STATUSES_WITH_VALUE = ("ok", "stale")
SESSION_EVENTS = {
    "drive_session_start": ("drive", "start"),
    "drive_session_stop": ("drive", "stop"),
    "charging_session_start": ("charging", "start"),
    "charging_session_stop": ("charging", "stop"),
}
CONFIDENCE_LEVELS = ("preview", "medium", "stable")
DIRECTIONS = ("higher_is_better", "lower_is_better")

# -- fixed values: signal keys used by the analytics -----------------------------------
ODOMETER = "distance.odometer"
SOC = "ev.soc_pct"
SPEED = "speed.vehicle"
REGEN = "ev.regen_power_kw"
TRACTION = "ev.traction_power_kw"
AMBIENT = "environment.ambient_temp_c"
CHARGE_POWER = "ev.charge_power_kw"
BATTERY_POWER = "power.battery_power_kw"
BATTERY_TEMP = "ev.battery_temp_c"
CHARGER_TYPE = "ev.charger_type"

# -- fixed values: signal registry 0.2 --------------------------------------------------
# (signal_key, category, value_type, canonical_unit, freshness_ttl_seconds)
SIGNAL_REGISTRY = [
    ("vehicle.vin_hash", "identity", "string", None, 86400),
    ("vehicle.make", "identity", "string", None, 86400),
    ("vehicle.model", "identity", "string", None, 86400),
    ("vehicle.trim", "identity", "string", None, 86400),
    ("vehicle.model_year", "identity", "integer", "year", 86400),
    ("distance.odometer", "telemetry", "number", "km", 30),
    ("speed.vehicle", "telemetry", "number", "km/h", 5),
    ("ev.soc_pct", "ev", "number", "%", 30),
    ("ev.charging_state", "ev", "enum", None, 15),
    ("ev.charger_type", "ev", "enum", None, 60),
    ("power.battery_voltage", "telemetry", "number", "V", 5),
    ("power.battery_current", "telemetry", "number", "A", 5),
    ("power.battery_power_kw", "derived", "number", "kW", 5),
    ("ev.charge_power_kw", "ev", "number", "kW", 10),
    ("ev.battery_temp_c", "ev", "number", "C", 30),
    ("environment.ambient_temp_c", "environment", "number", "C", 300),
    ("ev.regen_power_kw", "ev", "number", "kW", 5),
    ("ev.traction_power_kw", "ev", "number", "kW", 5),
    ("diag.mil_on", "diagnostics", "boolean", None, 86400),
    ("diag.readiness_summary", "diagnostics", "json", None, 86400),
    ("diag.dtcs_active", "diagnostics", "array<string>", None, 86400),
    ("engine.rpm", "telemetry", "number", "rpm", 5),
    ("fuel.level_pct", "telemetry", "number", "%", 86400),
    ("tires.pressure", "telemetry", "json", "kPa", 86400),
]

# -- fixed values: sources preferred per registry priority -------------------------------
SOURCE_PRIORITY = {"obd_over_smartcar": ("OBD", "SMARTCAR"), "smartcar_over_obd": ("SMARTCAR", "OBD")}
SMARTCAR_FIRST_SIGNALS = (
    "vehicle.make",
    "vehicle.model",
    "vehicle.trim",
    "vehicle.model_year",
    "fuel.level_pct",
    "tires.pressure",
)

# -- fixed values: locked KPI catalog -----------------------------------------------------
# (family, key, unit, direction, formula, required signals, optional signals)
KPI_CATALOG = [
    (RANGE, "ev_net_energy_efficiency", "Wh_per_km", "lower_is_better",
     "median(((delta_soc_pct/100) * DEFAULT_USABLE_BATTERY_KWH * 1000) / delta_km)",
     [ODOMETER, SOC], [BATTERY_POWER, AMBIENT]),
    (RANGE, "ev_estimated_practical_range", "km", "higher_is_better",
     "latest_soc_pct * median(delta_km / delta_soc_pct)",
     [ODOMETER, SOC], [AMBIENT]),
    (RANGE, "ev_urban_efficiency", "Wh_per_km", "lower_is_better",
     "median(ev_net_energy_efficiency for segments where speed.vehicle < 45 km/h)",
     [ODOMETER, SOC, SPEED], []),
    (RANGE, "ev_highway_efficiency", "Wh_per_km", "lower_is_better",
     "median(ev_net_energy_efficiency for segments where speed.vehicle >= 80 km/h)",
     [ODOMETER, SOC, SPEED], []),
    (RANGE, "regeneration_recovery_ratio", "%", "higher_is_better",
     "100 * regen_energy_wh / (regen_energy_wh + traction_energy_wh) over integrated power windows",
     [REGEN, TRACTION], []),
    (RANGE, "soc_depletion_rate_per_100km", "%_per_100km", "lower_is_better",
     "100 / median(delta_km / delta_soc_pct)",
     [ODOMETER, SOC], []),
    (RANGE, "ev_range_efficiency_score", "score", "higher_is_better",
     "0.65 * normalized_efficiency_component + 0.35 * normalized_estimated_range_component",
     [ODOMETER, SOC], [SPEED, AMBIENT]),
    (CHARGING, "temp_adjusted_charge_acceptance_score", "score", "higher_is_better",
     "clamp(100 * median(all_charge_kw) / median(mild_charge_kw), 0, 120)",
     ["ev.charging_state", CHARGE_POWER, SOC], [BATTERY_TEMP, AMBIENT, CHARGER_TYPE]),
    (CHARGING, "cold_weather_charge_speed_retention", "%", "higher_is_better",
     "100 * median(cold_charge_kw) / median(mild_charge_kw)",
     ["ev.charging_state", CHARGE_POWER, SOC], [BATTERY_TEMP, AMBIENT, CHARGER_TYPE]),
    (CHARGING, "charging_performance_score", "score", "higher_is_better",
     "0.6 * temp_adjusted_charge_acceptance_score + 0.4 * cold_weather_charge_speed_retention",
     ["ev.charging_state", CHARGE_POWER, SOC], [BATTERY_TEMP, AMBIENT]),
    (TEMPERATURE, "cold_weather_range_retention", "%", "higher_is_better",
     "100 * median(cold_km_per_soc) / median(mild_km_per_soc)",
     [ODOMETER, SOC, AMBIENT], [BATTERY_TEMP]),
    (TEMPERATURE, "range_temperature_sensitivity_index", "%_loss_per_10C_drop", "lower_is_better",
     "max(0, -slope(km_per_soc vs temp_c) * 10 / mild_km_per_soc * 100)",
     [ODOMETER, SOC, AMBIENT], [BATTERY_TEMP]),
    (TEMPERATURE, "cold_weather_charge_speed_retention", "%", "higher_is_better",
     "100 * median(cold_charge_kw) / median(mild_charge_kw)",
     ["ev.charging_state", CHARGE_POWER, SOC], [BATTERY_TEMP, AMBIENT]),
    (COMPOSITE, "ev_composite_base_score", "score", "higher_is_better",
     "0.6 * ev_range_efficiency_score + 0.4 * charging_performance_score", [], []),
    (COMPOSITE, "ev_health_modifier_penalty", "score_points", "lower_is_better",
     "min(10, (MIL_ON ? 6 : 0) + min(4, 0.5 * distinct_active_dtc_count))",
     ["diag.mil_on", "diag.dtcs_active"], []),
    (COMPOSITE, "ev_composite_score", "score", "higher_is_better",
     "clamp(ev_composite_base_score - ev_health_modifier_penalty, 0, 100)", [], []),
]

# -- fixed values: polled mode-01 signals -------------------------------------------------
# (command, mode, pid, payload bytes, signal key, unit, source signal, confidence)
STANDARD_SIGNALS = [
    ("010D", 0x01, 0x0D, 1, SPEED, "km/h", "01_0D", 0.99),
    ("0142", 0x01, 0x42, 2, "power.battery_voltage", "V", "01_42", 0.88),
    ("0146", 0x01, 0x46, 1, AMBIENT, "C", "01_46", 0.80),
]
ADAPTER_VOLTAGE = ("ATRV", "power.battery_voltage", "V", "AT_RV", 0.75)

# -- fixed values: gates and defaults --------------------------------------------------------
USABLE_BATTERY_KWH = 75.0
SCHEMA_VERSION = "0.2"
COHORT_GATE = 10
COHORT_PREFERRED = 30
SOURCE_JOB = "internal_recompute"

# Messages of record receipts, part of the output.
RECEIPT_MESSAGES = {
    "unknown_signal_key": "signal_key not present in active v0.2 registry",
    "invalid_status": "invalid status enum",
    "invalid_confidence": "confidence must be between 0 and 1",
    "invalid_value_fields": "only one of value_number/value_string/value_bool/value_json is allowed",
    "missing_value": "status ok/stale requires one value field",
}
