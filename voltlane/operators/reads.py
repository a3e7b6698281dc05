"""Read-side queries over KPI, ranking and observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..config import TemperatureGates
from ..functions.scalars import Timeframe, family_confidence, session_signal_key
from .ordering import PageIndex, percentile_rank
from .rankings import latest_kpis
from .series import per_timeframe

KPI_FIELDS = ["vehicle_uid", "kpi_key", "value", "unit", "direction", "confidence_level", "sample_count"]


def accessible(df: DataFrame, access: DataFrame, user: str) -> DataFrame:
    """Rows of vehicles the user may see."""
    return df.join(access.where(F.col("user_id") == user).select("vehicle_uid"), "vehicle_uid", "left_semi")


def _only(df: DataFrame, vehicles) -> DataFrame:
    if vehicles is None:
        return df
    if isinstance(vehicles, DataFrame):
        return df.join(vehicles.select("vehicle_uid"), "vehicle_uid", "left_semi")
    return df.where(F.col("vehicle_uid").isin(list(vehicles)))


def _family_kpis(kpi: DataFrame, family: str, timeframe: str, temperature_bin: str, vehicles) -> DataFrame:
    mine = kpi.where(
        (F.col("ranking_type") == family)
        & (F.col("timeframe") == timeframe)
        & (F.col("temperature_bin") == temperature_bin)
    )
    return latest_kpis(_only(mine, vehicles)).select(
        "vehicle_uid", "kpi_key", F.col("kpi_value").alias("value"), F.coalesce("kpi_unit", F.lit("score")).alias("unit"),
        "direction", "confidence_level", "sample_count",
    )


def kpis_range(kpi: DataFrame, vehicles=None, timeframe: str = "30d", temperature_bin: str = "all") -> DataFrame:
    """Newest range KPIs of the given vehicles (all when None)."""
    if temperature_bin != "all":
        raise ValueError("temperature_bin filter is only supported for temperature-impact KPIs")
    return _family_kpis(kpi, C.RANGE, timeframe, temperature_bin, vehicles)


def kpis_charging(kpi: DataFrame, vehicles=None, timeframe: str = "30d", temperature_bin: str = "all") -> DataFrame:
    """Newest charging KPIs. Bin "cold" is accepted but never written, so it is empty."""
    if temperature_bin not in ("all", "cold"):
        raise ValueError("charging KPIs have the bins all and cold only")
    return _family_kpis(kpi, C.CHARGING, timeframe, temperature_bin, vehicles)


def kpis_temperature_impact(
    kpi: DataFrame, vehicle: DataFrame, vehicles=None, timeframe: str = "90d", baseline: str = "mild", compare: str = "cold"
) -> DataFrame:
    """Newest temperature KPIs with the percentile inside make and model, and cohort size."""
    rows = latest_kpis(
        kpi.where(
            (F.col("ranking_type") == C.TEMPERATURE) & (F.col("timeframe") == timeframe)
            & (F.col("temperature_bin") == "cold")
            & (F.col("baseline_temperature_bin") == baseline) & (F.col("compare_temperature_bin") == compare)
        ),
        ("baseline_temperature_bin", "compare_temperature_bin"),
    )
    named = vehicle.select(
        "vehicle_uid", F.coalesce("make", F.lit("unknown")).alias("make"), F.coalesce("model", F.lit("unknown")).alias("model")
    )
    ranked = percentile_rank(rows.join(named, "vehicle_uid"), ["make", "model", "kpi_key"], "kpi_value", "direction")
    sizes = ranked.groupBy("vehicle_uid").agg(F.max("cohort_values").alias("cohort_size"))
    return _only(ranked.join(sizes, "vehicle_uid"), vehicles).select(
        "vehicle_uid", "kpi_key", F.col("kpi_value").alias("value"), F.coalesce("kpi_unit", F.lit("score")).alias("unit"),
        "direction", "confidence_level", "sample_count", "percentile", "cohort_size",
    )


# ---- readiness ---------------------------------------------------------------------------------
def gate_evidence(obs: DataFrame, sess: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Odometer span per stored temperature group and number of cold and mild sessions."""
    cold, mild = F.col("temperature_bin").isin(*C.COLD_BINS), F.col("temperature_bin") == "mild"
    odo = obs.where(
        (F.col("signal_key") == C.ODOMETER) & F.col("value_number").isNotNull()
        & F.col("temperature_bin").isin(*C.COLD_BINS, "mild")
    )

    def span(inside, group) -> Column:
        v = inside(F.when(group, F.col("value_number")))
        return F.coalesce(F.max(v) - F.min(v), F.lit(0.0))

    distance = per_timeframe(
        odo, ["vehicle_uid"], "observed_at", tf,
        lambda inside: [span(inside, cold).alias("cold_distance_km"), span(inside, mild).alias("mild_distance_km")],
    )
    sessions = per_timeframe(
        sess, ["vehicle_uid"], "started_at", tf,
        lambda inside: [
            F.count(inside(F.when(cold, F.lit(1)))).alias("cold_charge_sessions"),
            F.count(inside(F.when(mild, F.lit(1)))).alias("mild_charge_sessions"),
        ],
    )
    keys = ["vehicle_uid", "timeframe"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return distance.join(sessions, keys, "full").select(
        *keys, *[zero(c) for c in ("cold_distance_km", "mild_distance_km", "cold_charge_sessions", "mild_charge_sessions")]
    )


def missing_requirements(gates: TemperatureGates = TemperatureGates()) -> Column:
    """Messages for evidence columns below their gate; absent evidence counts as zero."""
    below = lambda c, least: F.coalesce(F.col(c), F.lit(0)) < least
    checks = [
        (below("cold_distance_km", gates.cold_km), f"cold_distance_km<{gates.cold_km:.1f}"),
        (below("mild_distance_km", gates.mild_km), f"mild_distance_km<{gates.mild_km:.1f}"),
        (below("cold_charge_sessions", gates.cold_sessions), f"cold_charging_sessions<{gates.cold_sessions}"),
        (below("mild_charge_sessions", gates.mild_sessions), f"mild_charging_sessions<{gates.mild_sessions}"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def readiness(
    kpi: DataFrame, vehicle: DataFrame, evidence: DataFrame, tf: list[Timeframe], gates: TemperatureGates = TemperatureGates()
) -> DataFrame:
    """Status of every family for every vehicle and timeframe."""
    read_bin = F.when(F.col("ranking_type") == C.TEMPERATURE, "cold").otherwise("all")
    have = (
        latest_kpis(kpi.where(F.col("temperature_bin") == read_bin))
        .groupBy("vehicle_uid", "timeframe", "ranking_type")
        .agg(F.max("sample_count").alias("_samples"), family_confidence(F.col("confidence_level")).alias("_level"))
    )
    grid = (
        vehicle.select("vehicle_uid", F.explode(F.array(*[F.lit(t.token) for t in tf])).alias("timeframe"))
        .join(evidence, ["vehicle_uid", "timeframe"], "left")
        .select("*", F.explode(F.array(*[F.lit(f) for f in C.FAMILIES])).alias("ranking_type"))
        .join(have, ["vehicle_uid", "timeframe", "ranking_type"], "left")
    )
    none = F.col("_level").isNull()
    temp = F.col("ranking_type") == C.TEMPERATURE
    empty = F.array().cast("array<string>")
    gap = lambda text: F.when(none, F.array(F.lit(text))).otherwise(empty)
    missing = F.when(temp, F.concat(missing_requirements(gates), gap("temperature_kpis_missing"))).otherwise(
        gap("kpi_snapshots_missing")
    )
    level = F.coalesce("_level", F.lit("none"))
    return grid.select(
        "vehicle_uid", "timeframe", "ranking_type", level.alias("confidence_level"),
        F.coalesce("_samples", F.lit(0)).cast("bigint").alias("sample_count"), missing.alias("missing_requirements"),
    ).withColumn(
        "status",
        F.when((F.size("missing_requirements") > 0) | (F.col("confidence_level") == "none"), "not_ready")
        .when(F.col("confidence_level") == "preview", "preview")
        .otherwise("ready"),
    )


# ---- rankings -----------------------------------------------------------------------------------
#: Position up to which a page is taken from the first rows of every task; pages beyond it are read through an index.
FIRST_ROWS = 10_000
PAGE_ORDER = ["rank_position", "cohort_key", "vehicle_uid"]


def ranking_rows(
    rank: DataFrame, vehicle: DataFrame, access: DataFrame, user: str, family: str, timeframe: str = "30d",
    temperature_bin: str = "all", make=None, model=None, trim=None, powertrain_class=None,
) -> DataFrame:
    """The newest ranking among the user's vehicles, all rows of it."""
    if family not in C.FAMILIES:
        raise ValueError("no such family of rankings")
    if family != C.TEMPERATURE and temperature_bin != "all":
        raise ValueError("only the temperature family is ranked by temperature bin")
    mine = accessible(
        rank.where(
            (F.col("ranking_type") == family) & (F.col("timeframe") == timeframe) & (F.col("temperature_bin") == temperature_bin)
        ),
        access, user,
    )
    newest = F.broadcast(mine.agg(F.max("computed_at").alias("computed_at")))  # one row
    wanted = vehicle
    for name, value in (("make", make), ("model", model), ("trim", trim), ("powertrain_class", powertrain_class)):
        if value is not None:
            wanted = wanted.where(F.coalesce(F.col(name), F.lit("unknown")) == value)
    return mine.join(newest, "computed_at").join(wanted.select("vehicle_uid"), "vehicle_uid")


def index_ranking(rows: DataFrame, folder: str | None = None) -> PageIndex:
    """An index of :func:`ranking_rows` for pages at any offset, written once and used for all of them."""
    return PageIndex.write(rows, PAGE_ORDER, folder)


def ranking_page(
    rank: DataFrame, vehicle: DataFrame, access: DataFrame, user: str, family: str, timeframe: str = "30d",
    temperature_bin: str = "all", make=None, model=None, trim=None, powertrain_class=None, limit: int = 25, offset: int = 0,
    index: PageIndex | None = None,
) -> DataFrame:
    """A page of the newest ranking among the user's vehicles, by position.

    ``has_more`` is true when the page is full. Limit is held to 1-100. Pages that end beyond ``FIRST_ROWS`` are read
    through ``index``, or through one written for them; an index that is given serves all pages.
    """
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    rows = ranking_rows(rank, vehicle, access, user, family, timeframe, temperature_bin, make, model, trim, powertrain_class)
    if index is None and offset + limit <= FIRST_ROWS:
        page = rows.orderBy(*PAGE_ORDER).offset(offset).limit(limit)
    else:
        page = (index or index_ranking(rows)).page(offset, limit)
    full = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) >= limit  # at most 100 rows here
    return page.withColumn("has_more", full)


def with_kpi_map(page: DataFrame, kpi: DataFrame) -> DataFrame:
    """Adds ``kpis`` (key to value) to ranking rows in one join."""
    keys = ["vehicle_uid", "ranking_type", "timeframe", "temperature_bin"]
    wanted = kpi.join(page.select(*keys).distinct(), keys, "left_semi")
    cells = (
        latest_kpis(wanted)
        .groupBy(*keys, "kpi_key")
        .agg(F.max("kpi_value").alias("kpi_value"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kpi_key", "kpi_value")))).alias("kpis"))
    )
    return page.join(cells, keys, "left")


# ---- raw telemetry ---------------------------------------------------------------------------------
RAW_FIELDS = [
    "observation_id", "vehicle_uid", "batch_id", "session_id", "observed_at", "signal_key", "source_signal", "status",
    "value_number", "value_string", "value_bool", "value_json", "raw_payload_ref",
]


def after_cursor(df: DataFrame, observed_at=None, observation_id: str | None = None) -> DataFrame:
    """Rows strictly after a (instant, id) cursor in newest-first order; both parts or none."""
    if observed_at is None and observation_id is None:
        return df
    if observed_at is None or observation_id is None:
        raise ValueError("a cursor needs both its instant and its id")
    if not str(observed_at).strip() or not observation_id.strip():
        raise ValueError("neither part of a cursor may be blank")
    kind = df.schema["observed_at"].dataType
    at = F.lit(observed_at.isoformat(sep=" ") if hasattr(observed_at, "isoformat") else str(observed_at).strip()).cast(kind)
    here = F.col("observed_at")
    return df.where((here < at) | ((here == at) & (F.col("observation_id") < observation_id.strip())))


def _raw_filter(df: DataFrame, vehicles, signal_key, session_id, cursor) -> DataFrame:
    rows = _only(df.where(F.col("raw_payload_ref").isNotNull()), vehicles)
    if signal_key and signal_key.strip():
        rows = rows.where(F.col("signal_key") == signal_key.strip())
    if session_id:
        rows = rows.where(F.col("session_id") == session_id)
    return after_cursor(rows, *(cursor or (None, None)))


def _newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("observed_at"), F.desc("observation_id")).limit(min(max(limit, 1), 500))


def raw_telemetry(
    obs: DataFrame, vehicles: Sequence[str] | None = None, signal_key=None, batch_id=None, session_id=None, cursor=None, limit: int = 120
) -> DataFrame:
    """Newest readings that carry a raw payload. The page is held to 1-500 rows."""
    rows = _raw_filter(obs, vehicles, signal_key, session_id, cursor)
    if batch_id:
        rows = rows.where(F.col("batch_id") == batch_id)
    return _newest(rows.select(*RAW_FIELDS), limit)


def events_as_readings(events: DataFrame) -> DataFrame:
    """Session events in the columns of raw readings, as ``session.<type>.<event>``."""
    none = lambda kind: F.lit(None).cast(kind)
    return events.select(
        F.col("session_event_id").alias("observation_id"), "vehicle_uid", none("string").alias("batch_id"), "session_id",
        "observed_at", session_signal_key(F.col("session_type"), F.col("event_type")).alias("signal_key"),
        none("string").alias("source_signal"), F.col("event_type").alias("status"), none("double").alias("value_number"),
        none("string").alias("value_string"), none("boolean").alias("value_bool"), none("string").alias("value_json"),
        "raw_payload_ref",
    )


def raw_with_events(
    obs: DataFrame, events: DataFrame, vehicles=None, signal_key=None, batch_id=None, session_id=None, cursor=None, limit: int = 120
) -> DataFrame:
    """Raw readings and session events in one newest-first page; a batch filter leaves events out."""
    readings = raw_telemetry(obs, vehicles, signal_key, batch_id, session_id, cursor, limit)
    if batch_id:
        return readings
    extra = _newest(_raw_filter(events_as_readings(events), vehicles, signal_key, session_id, cursor), limit)
    return _newest(readings.unionByName(extra), limit)


def next_cursor(page: DataFrame, limit: int = 120) -> DataFrame:
    """(observed_at, observation_id) of the last row when the page is full, else no row."""
    limit = min(max(limit, 1), 500)
    return (
        page.agg(F.min(F.struct("observed_at", "observation_id")).alias("c"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == limit)
        .select("c.observed_at", "c.observation_id")
    )
