"""Publication: readers see a version whole."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlane.sources.snapshots import ConcurrentPublication, Snapshots, Split


def rows(spark, *values):
    return spark.createDataFrame([(v, v.upper()) for v in values], "k string, part string")


def read(df):
    return sorted(r.k for r in df.collect())


def test_versions_are_switched_whole(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.read("t") is None and store.manifest()["version"] == 0
    assert store.publish({"t": {"a": rows(spark, "x"), "b": rows(spark, "y")}, "u": {"all": rows(spark, "1")}}) == 1
    before = store.read("t")
    assert store.publish({"t": {"a": rows(spark, "z")}}) == 2
    assert read(before) == ["x", "y"]  # resolved before the switch, still whole
    assert read(store.read("t")) == ["y", "z"] and read(store.read("t", ["b"])) == ["y"] and read(store.read("u")) == ["1"]
    assert read(store.read("t", version=1)) == ["x", "y"]
    assert store.read("t").columns == ["k", "part"]


def test_a_failed_publication_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    store.publish({"t": {"a": rows(spark, "x")}, "u": {"a": rows(spark, "x")}})
    bad = rows(spark, "y").withColumn("k", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        store.publish({"t": {"a": rows(spark, "y")}, "u": {"a": bad}})
    assert store.versions() == [1] and read(store.read("t")) == ["x"]


def test_two_writers(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    one.publish({"t": {"a": rows(spark, "x")}})
    stale = one.manifest()
    two.publish({"t": {"a": rows(spark, "y")}})
    with pytest.raises(ConcurrentPublication):
        one._put({**stale, "version": 2})
    assert read(one.read("t")) == ["y"] and not [f for f in os.listdir(tmp_path / "manifests") if "draft" in f]


def test_old_folders_go(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    for i in range(5):
        store.publish({"t": {"a": rows(spark, f"x{i}")}, "fixed": {"a": rows(spark, "f")} if i == 0 else {}}, keep=2)
    assert store.versions() == [4, 5] and read(store.read("t")) == ["x4"] and read(store.read("fixed")) == ["f"]
    assert len(os.listdir(tmp_path / "data" / "fixed")) == 1
    live = [r for r in (tmp_path / "data" / "t").iterdir() if any(r.glob("part=*/part-*"))]
    assert len(live) == 2


def test_split_into_parts_in_one_job(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    df = spark.createDataFrame([("r", "30d", 1), ("r", "90d", 2), ("c", "30d", 3)], "f string, t string, n int")
    store.publish({"ranks": Split(df, ("f", "t"))})
    store.publish({"ranks": Split(df.where("n = 3").withColumn("n", F.lit(4)), ("f", "t"), ["r-30d", "x-1"])})
    got = sorted((r.f, r.t, r.n) for r in store.read("ranks").collect())
    assert got == [("c", "30d", 4), ("r", "90d", 2)]
    assert store.read("ranks", ["r-30d"]).count() == 0 and datetime.now()
