"""Claims of batch ids and vehicles against the same uploads read one by one."""

import random
from datetime import timedelta

from voltlane.operators.claims import CLAIM, claiming
from voltlane.session import table_stage

from .test_ingest import T0, batch, outcomes

UPLOAD = "batch_id string, vehicle_uid string, user_id string, received_at timestamp, arrival_id string"


def decided(spark, rows):
    """Arrival ids that claim, and the names of all tables written on the way."""
    write, names = table_stage(spark), []

    def stage(df, name):
        names.append(name)
        return write(df, name)

    got = claiming(spark.createDataFrame(rows, UPLOAD), stage)
    assert got.columns == CLAIM
    return sorted(r.arrival_id for r in got.collect()), names


def one_by_one(rows):
    held, owner, out = set(), {}, []
    for batch_id, vehicle, user, _, arrival in sorted((r for r in rows if None not in r[:3]), key=lambda r: r[3:]):
        if batch_id not in held and owner.get(vehicle, user) == user:
            held.add(batch_id)
            owner[vehicle] = user
            out.append(arrival)
    return sorted(out)


def chain(n):
    """Every upload has one earlier rival, by turns through its batch id and its vehicle."""
    return [(f"b{i // 2}", f"v{(i + 1) // 2}", f"u{i}", T0 + timedelta(minutes=i), f"a{i:05d}") for i in range(n)]


def test_a_long_chain_takes_few_jumps(spark):
    rows = chain(1000)
    got, names = decided(spark, rows)
    assert got == one_by_one(rows) and len(got) == 500
    assert len([n for n in names if n.startswith("links")]) <= 12


def test_chain_that_hangs_on_an_upload_with_two_rivals(spark):
    long = chain(200)
    before = [("x", "y", "z0", T0 - timedelta(minutes=9), "a-0"), ("b0", "y", "z1", T0 - timedelta(minutes=8), "a-1"), ("x", "v0", "z2", T0 - timedelta(minutes=7), "a-2")]
    got, names = decided(spark, before + long)
    assert got == one_by_one(before + long) and len(names) < 30


def test_any_uploads_as_one_by_one(spark):
    for seed in range(2):
        rng = random.Random(seed)
        name = lambda letter, n: None if rng.random() < 0.02 else letter + ("0" if rng.random() < 0.3 else str(rng.randrange(n)))  # noqa: E731, B023
        rows = [(name("b", 60), name("v", 40), name("u", 6), T0 + timedelta(minutes=rng.randrange(200)), f"a{i:04d}") for i in range(400)]
        assert decided(spark, rows)[0] == one_by_one(rows)
    assert decided(spark, [])[0] == []


def test_outcomes_as_one_by_one(spark):
    rng = random.Random(7)
    rows = [batch(f"b{rng.randrange(60)}", f"v{rng.randrange(12)}", f"u{rng.randrange(3)}", rng.randrange(90), f"a{i:03d}", end_hours=rng.choice([1, 1, 2])) for i in range(160)]
    ledger = [("b1", "v1", "0.2", "obd", T0, T0 + timedelta(hours=1), T0)]
    held, owner, want = {"b1": ("v1", 1)}, {"v2": "u1"}, {}
    for r in sorted(rows, key=lambda r: (r["received_at"], r["arrival_id"])):
        envelope = (r["vehicle_uid"], (r["capture_window"][1] - T0).seconds // 3600)
        if r["batch_id"] in held:
            want[r["arrival_id"]] = "duplicate" if held[r["batch_id"]] == envelope else "conflict"
        elif owner.setdefault(r["vehicle_uid"], r["user_id"]) == r["user_id"]:
            held[r["batch_id"]], want[r["arrival_id"]] = envelope, "fresh"
        else:
            want[r["arrival_id"]] = "forbidden"
    assert outcomes(spark, rows, ledger, [("u1", "v2", "owner", T0, T0)]) == want
