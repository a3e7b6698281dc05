import random

import pytest

from voltlane.llm.mixing import in_mixed_order, mix_sources, one_round, plan_phases

TARGETS = {"a": 5, "b": 3, "c": 1, None: 2}


def test_round_is_less_than_one_block_away():
    rng = random.Random(4)
    for _ in range(30):
        shares = {s: rng.randint(1, 40) for s in range(rng.randint(1, 9))}
        order, total = one_round(shares), sum(shares.values())
        assert len(order) == total
        for s, share in shares.items():
            have = 0
            for slot, taken in enumerate(order, 1):
                have += taken == s
                assert abs(have - share * slot / total) < 1
            assert have == share


def test_phases_place_every_block_once():
    shares, blocks = {0: 5, 1: 3, 2: 1}, {0: 7, 1: 40, 2: 11}
    slots = []
    for s, first, past, slot, period, share, own in plan_phases(shares, blocks):
        slots += [slot + (b - first) // share * period + own[(b - first) % share] for b in range(first, past)]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_all_rows_once_in_windows(spark):
    rows = [(i, [None, "a", "b", "c", "other", "a"][i % 6], i) for i in range(1000)] + [(7, "a", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, block long")
    mixed, names = mix_sources(df, TARGETS, block=10)
    assert names["block"] == "block_"
    got = mixed.toPandas().sort_values("position")
    assert list(got.position) == list(range(1003)) and got.slot.is_monotonic_increasing
    assert ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    assert sorted(zip(got.doc_id, got.block, strict=True)) == sorted((i, b) for i, _, b in rows)
    first = got[got.slot < 11]
    assert {s: n // 10 for s, n in first.groupby("stream").size().items()} == {0: 5, 1: 3, 2: 1, 3: 2}


def test_order_of_rows_and_edge_cases(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "t") for i in range(500)], "doc_id long, source string, text string")
    placed = mix_sources(df, TARGETS, block=10)[0].orderBy("position").select("doc_id")
    assert [r.doc_id for r in in_mixed_order(df, targets=TARGETS, block=10).collect()] == [r.doc_id for r in placed.collect()]
    assert in_mixed_order(df.limit(0)).columns == df.columns
    assert in_mixed_order(df.limit(0)).count() == 0
    assert in_mixed_order(df, targets={}).count() == 500
    with pytest.raises(ValueError, match="whole shares"):
        mix_sources(df, {"a": 0})


def test_hot_source_is_numbered_in_pieces(spark, monkeypatch):
    import voltlane.llm.mixing as m

    monkeypatch.setattr(m, "NUMBERED_ROWS", 40)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(900)], "doc_id long, source string")
    got = mix_sources(df, {"a": 1, "b": 1}, block=7)[0].toPandas()
    assert sorted(got.position) == list(range(900))
