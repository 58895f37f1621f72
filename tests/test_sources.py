"""Readers and writers on small literal files."""

import json

from slotmeter.sources import readers, writers


def test_examples_and_facts(spark, tmp_path):
    rows = [
        {"surface_form": "a", "mr": {"dact": "inform", "slots": {"name": "X", "food": ["a", "b"], "none": None}}, "topic": "t"},
        {"surface_form": "b", "mr": {"name": "Y"}, "topic": "u"},
    ]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    got = readers.examples(spark, str(tmp_path / "e.json"))
    assert {r["dact"] for r in got.collect()} == {"inform", None}
    facts = {(r["surface_form"], r["slot"], r["value"], r["is_list"]) for r in readers.example_facts(got, ["surface_form"]).collect()}
    assert facts == {("a", "name", "X", False), ("a", "food", "a", True), ("a", "food", "b", True), ("b", "name", "Y", False)}
    (tmp_path / "t.json").write_text(json.dumps({"t": [{"surface_form": "a", "mr": {"name": "X"}}]}))
    assert readers.topic_examples(spark, str(tmp_path / "t.json")).head()["topic"] == "t"


def test_hint_maps_and_manifest(spark, tmp_path):
    for name, text in (("1", "old"), ("2", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"d": {"hint_map_id": "hm_d", "hint_map": {"name": text}}}))
    got = readers.hint_maps(spark, [str(tmp_path / "1.json"), str(tmp_path / "2.json")]).collect()
    assert [(r["hint_map_id"], r["slot"], r["description"]) for r in got] == [("hm_d", "name", "new")]
    (tmp_path / "m.json").write_text(json.dumps({"train": ["a", "b"], "dev": ["c"]}))
    assert readers.manifest(spark, str(tmp_path / "m.json")).count() == 3


def test_csv_scores_and_annotations(spark, tmp_path):
    (tmp_path / "c.csv").write_text('mr,ref\n"name[X], food[a]","X, fine"\n')
    assert readers.corpus_csv(spark, str(tmp_path / "c.csv")).head()["ref"] == "X, fine"
    (tmp_path / "s.json").write_text(json.dumps({"params": {}, "records": [{"ex_idx": 1, "neg_idx": 0, "pred_scores": [0.5, 1.5]}]}))
    assert [(r["idx"], r["score"]) for r in readers.keyed_scores(spark, str(tmp_path / "s.json")).orderBy("idx").collect()] == [(0, 0.5), (1, 1.5)]
    (tmp_path / "a.tsv").write_text("id\thas_error\terror_details\n1\tyes\tD:area\n")
    (tmp_path / "a.txt").write_text("id: 1\nhas_error: yes\nerror_details: D:area\n---\nid: 2\nhas_error: no\nerror_details:\n")
    assert readers.annotations(spark, str(tmp_path / "a.tsv")).head()["error_details"] == "D:area"
    assert [tuple(r) for r in readers.annotations(spark, str(tmp_path / "a.txt")).orderBy("id").collect()] == [("1", "yes", "D:area"), ("2", "no", "")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456, 1), ("b", 2.0, 2)], "method string, acc double, n int")
    writers.metric_tsv(df, str(tmp_path / "m"))
    assert {r["acc"] for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m")).collect()} == {"0.1235", "2.0000"}
    writers.feature_tsv(df, str(tmp_path / "f"), ["method"])
    writers.details_json(df, str(tmp_path / "j"))
    writers.by_part(df, str(tmp_path / "p"), "method")
    assert spark.read.json(str(tmp_path / "p")).count() == 2 and (tmp_path / "p" / "method=a").exists()
