"""Readers of files: lists and single objects, damaged files aside."""

import json

from voltlane.sources import batches as B


def test_damaged_files_are_set_aside(spark, tmp_path):
    one = {"batch_id": "b1", "vehicle_uid": "v", "records": [{"signal_key": "x", "value_number": 1.5}]}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "list.json").write_text(json.dumps([{**one, "batch_id": "b2"}, {"batch_id": "b3"}]))
    (tmp_path / "torn.json").write_text('{"batch_id": "b4", "records": [{"signal_key": "x"')
    (tmp_path / "text.json").write_text("not json")
    (tmp_path / "empty.json").write_text("")
    good, damaged = B.read_batches_and_damage(spark, str(tmp_path))
    rows = good.collect()
    assert sorted((r.batch_id, len(r.records), r.session_events) for r in rows) == [("b1", 1, []), ("b2", 1, []), ("b3", 0, [])]
    assert len({r.arrival_id for r in rows}) == 3
    bad = {r.file.rsplit("/", 1)[1]: r.content for r in damaged.collect()}
    assert bad == {"torn.json": '{"batch_id": "b4", "records": [{"signal_key": "x"', "text.json": "not json"}


def test_registry_and_run_packs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "r" / "registry.json").write_text(json.dumps({"schema_version": "0.2", "signals": [{"signal_key": "a", "category": "c"}, {"signal_key": "b"}]}))
    (tmp_path / "p" / "pack.json").write_text(json.dumps({"id": "p1", "command_exchanges": [{"id": "x", "command": "010D"}, {"id": "y", "command": "0142"}]}))
    (tmp_path / "p" / "torn.json").write_text("{")
    signals, damaged = B.read_registry(spark, str(tmp_path / "r"))
    assert [(r.schema_version, r.signal_key, r.category) for r in signals.collect()] == [("0.2", "a", "c"), ("0.2", "b", None)] and damaged.isEmpty()
    packs, damaged = B.read_run_packs(spark, str(tmp_path / "p"))
    assert [(r.pack_id, r.exchange_index, r.command) for r in packs.collect()] == [("p1", 0, "010D"), ("p1", 1, "0142")] and damaged.count() == 1
