import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlane import constants as C
from voltlane.functions import scalars as P
from voltlane.operators.kpis import catalog_entry
from voltlane.operators.ordering import percentile_rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_temperature_bin_boundaries(spark):
    rows = [(-10.0, "very_cold"), (-5.0, "very_cold"), (-4.9, "cold"), (5.0, "cold"), (10.0, "cool"), (15.0, "cool"),
            (20.0, "mild"), (25.0, "mild"), (30.0, "hot"), (None, None)]
    df = spark.createDataFrame(rows, "t double, want string").withColumn("got", P.temperature_bin(F.col("t")))
    assert all(r.want == r.got for r in df.collect())


def test_percentiles_in_both_directions(spark):
    for values, direction, want in (
        ([50.0, 60.0, 70.0, 80.0], "higher_is_better", {70.0: 75, 50.0: 25}),
        ([10.0, 20.0, 30.0, 40.0], "lower_is_better", {20.0: 75, 40.0: 25}),
    ):
        df = spark.createDataFrame([("g", v, direction) for v in values], "g string, v double, d string")
        got = {r.v: r.percentile for r in percentile_rank(df, ["g"], "v", "d").collect()}
        assert {k: got[k] for k in want} == want


def test_catalog():
    assert len(C.KPI_CATALOG) == 16 and len(C.SIGNAL_REGISTRY) == len({r[0] for r in C.SIGNAL_REGISTRY}) == 24
    assert catalog_entry("ev_composite", "ev_composite_score")
    with pytest.raises(ValueError):
        catalog_entry("ev_composite", "ev_urban_efficiency")


def test_wh_per_km(spark):
    assert one(spark, P.wh_per_km(F.lit(5.0), F.lit(20.0), 60.0)) == pytest.approx(150.0)
    for soc, km in ((0.0, 20.0), (5.0, 0.0), (float("nan"), 20.0), (5.0, float("inf"))):
        assert one(spark, P.wh_per_km(F.lit(soc), F.lit(km), 60.0)) is None


def test_range_score_falls_back_to_efficiency(spark):
    have = {"ev_estimated_practical_range": F.lit(280.0), "ev_net_energy_efficiency": F.lit(160.0)}
    kpi = lambda k: have.get(k, F.lit(None).cast("double"))
    assert one(spark, P.family_score(F.lit(C.RANGE), kpi)) == pytest.approx(0.65 * (100 - 160 / 3) + 0.35 * 70)
    assert one(spark, P.family_score(F.lit(C.CHARGING), kpi)) == 0.0


def test_temperature_score_default_sensitivity(spark):
    score = P.temperature_score(F.lit(100.0), F.lit(100.0), F.lit(None).cast("double"))
    assert one(spark, score) == pytest.approx(80.0)


def test_parse_ts(spark):
    assert one(spark, P.parse_ts(F.lit("2026-02-19T09:00:00+02:00"))) == datetime(2026, 2, 19, 7)
    for bad in ("2026-02-19", "2026-02-19T09:00:00", "nonsense", "2026-13-19T09:00:00Z"):
        assert one(spark, P.parse_ts(F.lit(bad))) is None


def test_unknown_timeframe_is_an_error():
    with pytest.raises(ValueError, match="no timeframe"):
        P.timeframes(datetime(2024, 1, 1), ["14d"])


def test_confidence_and_year_band(spark):
    assert [one(spark, P.confidence(F.lit(n))) for n in (0, 19, 20, 59, 60)] == ["preview", "preview", "medium", "medium", "stable"]
    assert one(spark, P.year_band(F.lit(2022))) == "2022-2024"
    assert one(spark, P.year_band(F.lit(None).cast("int"))) == "unknown"


def test_clamp_keeps_null(spark):
    assert one(spark, P.clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert math.isclose(one(spark, P.clamp(F.lit(3.0), 0, 1)), 1.0)
