"""Uploads rebuilt from raw rows: small batches in one shuffle, large ones in parts, derived once a query."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from coverage_queries import base, ingest
from voltlane.functions.sizes import broadcast_if_small
from voltlane.operators import ingest as I
from voltlane.sources import batches as B

from .compare import compare
from .test_ingest import raw


def test_batches_of_one_part_take_one_shuffle(spark):
    rows = raw(spark, 300).withColumn("vehicle_uid", F.concat(F.lit("v"), F.col("value_number").cast("string")))
    plan = I.raw_rows_to_batches(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan


def test_large_and_small_batches_together(spark):
    rows = raw(spark, 3_000)
    stray = rows.limit(50)
    odd = stray.withColumn("vehicle_uid", F.lit(None).cast("string")).unionByName(stray.withColumn("observed_at", F.lit(None).cast("timestamp")))
    got = I.raw_rows_to_batches(rows.unionByName(odd), max_records=1_500).collect()
    assert sorted((r.batch_id, r.part, len(r.records)) for r in got) == [(I.NO_BATCH, 0, 1_000), ("b", 0, 1_467), ("b", 1, 533)]  # rows without an instant are numbered first and left out
    for batch, parts in (("b", (0, 1)), (I.NO_BATCH, (0,))):
        mine = {r.part: r for r in got if r.batch_id == batch}
        numbers = [x.value_number for p in parts for x in mine[p].records]
        kept = range(3_000) if batch == "b" else range(0, 3_000, 3)
        assert numbers == [float(i) for i in sorted(kept, reverse=True) if (i % 3 == 0) == (batch != "b")]
        first, last = min(numbers), max(numbers)
        for r in mine.values():
            at = [x.timestamp() for x in (r.capture_window.started_at, r.capture_window.ended_at)]
            assert at == [dt.datetime.fromtimestamp(n * 7).timestamp() for n in (first, last)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """300 events of 12 users on three days, one user with many on a day."""
    d = str(tmp_path_factory.mktemp("tables"))
    n = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ("view", "error", "click", "purchase", "signup")])
    spark.range(300).select(
        n.alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + n * 800).cast("timestamp_ntz").alias("ts"),
        F.when(n % 4 == 0, F.lit(3)).otherwise(n % 12).cast("bigint").alias("user_id"), F.get(kinds, ((n * 7) % 5).cast("int")).alias("event_type"),
        ((n * 37 % 1000) / 10.0).alias("value"), F.concat(F.lit('{"k": '), (n * 13 % 100).cast("string"), F.lit("}")).alias("props"),
    ).write.parquet(f"{d}/events.parquet")
    spark.range(12).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("name", ["i14_i15_accept_batches", "r07_batch_receipts"])
def test_readings_are_derived_once_a_query(spark, tables, name, monkeypatch):
    derived, made = base.A.observations, []
    monkeypatch.setattr(base.A, "observations", lambda *a: made.append(a) or derived(*a))
    got = base.QUERIES[name](spark, tables)
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    assert compare(con, got, base.SQL[name]) is None and got.count() > 20
    assert len(made) == 1


def test_written_tables_are_kept_by_query(spark, tables):
    s = base.Source(spark, tables)
    assert ingest.written_uploads(s) is ingest.written_uploads(s)
    assert ingest.written_uploads(base.Source(spark, tables)) is not ingest.written_uploads(s)


def test_facts_of_batch_ids_are_never_broadcast(spark):
    """Behind a JSON text Spark takes the uploads for far smaller than they are."""
    ups = B.parse_batches(I.batches_to_json(I.raw_rows_to_batches(raw(spark, 100)))).withColumns({
        "user_id": F.lit("u"), "received_at": F.col("capture_window.ended_at"), "arrival_id": F.col("batch_id")})
    again = ups.unionByName(ups.withColumn("arrival_id", F.concat("batch_id", F.lit("/2"))))
    got = I.classify_batches(again, I.ledger_rows(ups.where(F.col("batch_id") == "b")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.arrival_id, r.outcome) for r in got.collect()) == [
        (I.NO_BATCH, "fresh"), (f"{I.NO_BATCH}/2", "duplicate"), ("b", "duplicate"), ("b/2", "duplicate")]


def test_beyond_its_bound_a_counted_table_is_shuffled(spark):
    few, other = spark.range(10), spark.range(20)
    assert "BroadcastHashJoin" in other.join(broadcast_if_small(few, 10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in other.join(broadcast_if_small(few, 9), "id")._jdf.queryExecution().executedPlan().toString()
