"""Records in any form, and examples tagged by a manifest."""

import json

import pytest

from slotmeter.operators import parsing as ps
from slotmeter.sources import readers


def test_records_in_any_form(spark):
    rows = [
        (1, '{"name": "A b", "n": 3, "ok": true, "tags": ["x", "[y"], "no": null, "empty": [], "deep": {"a": 1}}'), (2, "  <LIST>(name: A; B); (x: y)</LIST>"), (3, "(name: A)"), (4, "name: A"), (5, '{"a": '), (6, "{}"), (7, None), (8, ""), (9, "(nothing)"), (None, "(k: v)"), (10, '{"a": 1, "a": 2}'), (11, '["a"]'),
    ]
    got = {}
    for r in ps.any_record(spark.createDataFrame(rows, "id int, mr string"), ["id"]).collect():
        got.setdefault(r["id"], []).append((r["form"], r["pos"], r["slot"], r["vpos"], r["value"], r["error"]))
    wrong, bad = "neither a JSON object nor a record", "not a JSON object"
    assert {i: sorted(x, key=str) for i, x in got.items()} == {
        1: sorted([("json", 0, "name", 1, "A b", None), ("json", 1, "n", 1, "3", None), ("json", 2, "ok", 1, "true", None), ("json", 3, "tags", 1, "x", None), ("json", 3, "tags", 2, "[y", None), ("json", 4, "no", 1, None, None), ("json", 5, "empty", 1, None, None), ("json", 6, "deep", 1, '{"a":1}', None)], key=str),
        2: [("text", 0, "name", 1, "A", None), ("text", 0, "name", 2, "B", None), ("text", 1, "x", 1, "y", None)],
        3: [("text", 0, "name", 1, "A", None)], None: [("text", 0, "k", 1, "v", None)],
        6: [("json", None, None, None, None, None)], 9: [("text", None, None, None, None, None)],
        **{i: [("rejected", None, None, None, None, wrong)] for i in (4, 7, 8, 11)}, **{i: [("json", None, None, None, None, bad)] for i in (5, 10)},
    }


@pytest.fixture
def files(tmp_path):
    def one(name, *texts):
        (tmp_path / name).write_text(json.dumps([{"surface_form": t, "mr": {"dact": "inform", "slots": {"a": [t]}}, "topic": "x"} for t in texts]))

    one("a.json", "a1", "a2")
    one("b c.json", "b1")
    (tmp_path / "folder").mkdir()
    one("folder/1.json", "f1")
    one("folder/2.json", "f2")
    (tmp_path / "files.json").write_text(json.dumps({"train": ["a.json", "folder"], "dev": ["b c.json"], "prompt": [str(tmp_path / "a.json")], "none": []}))
    return tmp_path


def test_a_part_comes_from_the_file_that_holds_a_row(spark, files):
    found = readers.tagged_examples(spark, str(files / "files.json"), str(files))
    got = sorted((r["part"], r["file"].rsplit("/", 1)[-1], r["surface_form"], r["dact"], r["mr"]) for r in found.collect())
    row = lambda part, file, t: (part, file, t, "inform", json.dumps({"a": [t]}, separators=(",", ":")))
    assert got == sorted([row("train", "a.json", "a1"), row("train", "a.json", "a2"), row("prompt", "a.json", "a1"), row("prompt", "a.json", "a2"), row("dev", "b c.json", "b1"), row("train", "folder", "f1"), row("train", "folder", "f2")])
