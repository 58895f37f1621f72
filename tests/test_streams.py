"""Totals of a stream that comes in parts, and turns of annotated dialogs."""

from slotmeter.operators import parsing as ps
from slotmeter.streaming import tallies as tl


def test_totals_go_on_where_the_stream_was(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "kind string, more boolean"
    spark.createDataFrame([("M", False), ("S", True), ("D", False)], schema).write.parquet(source)
    stream = lambda: tl.error_kinds(spark.readStream.schema(schema).parquet(source))
    first = {r["kind"]: r["n"] for r in tl.running_totals(stream(), "kind", place).collect()}
    assert first == {"S": 1, "D": 1, "repetition": 1}
    spark.createDataFrame([("S", False), ("I", None), ("M", True)], schema).write.mode("append").parquet(source)
    second = {r["kind"]: r["n"] for r in tl.running_totals(stream(), "kind", place).collect()}
    assert second == {"S": 2, "D": 1, "I": 1, "repetition": 2}
    assert {r["kind"]: r["n"] for r in tl.running_totals(stream(), "kind", place).collect()} == second


def test_turns_of_dialogs(spark):
    note = lambda a, b, text, *names: (a, b, text, [(n,) for n in names])
    turns = [
        ("user", "hi", [note(0, 2, "hi", "trip.hi")]),
        ("ASSISTANT", "to New York at ten", [note(3, 6, "New", "trip.to.city.accept", "other"), note(3, 11, "New York", "trip.to.city"), note(7, 11, "York", "trip.to.city"), note(15, 18, "ten", "trip.time"), note(0, 2, "to")]),
        ("assistant", "nothing", []),
        ("assistant", "one and two", [note(0, 3, "one", "a.b.c.d"), note(8, 11, "two", "a.b.c.d.reject")]),
    ]
    kinds = "conversation_id string, topic string, utterances array<struct<speaker:string,text:string,segments:array<struct<start_index:int,end_index:int,text:string,annotations:array<struct<name:string>>>>>>"
    got = ps.dialog_turns(spark.createDataFrame([("c", "trip", turns)], kinds)).collect()
    assert sorted((r["conversation_id"], r["turn"], r["surface_form"], r["topic"], r["slot"], r["values"]) for r in got) == [
        ("c", 1, "to New York at ten", "trip", "trip.time", ["ten"]),
        ("c", 1, "to New York at ten", "trip", "trip.to.city", ["New", "York"]),
        ("c", 3, "one and two", "trip", "b.c.d", ["one", "two"]),
    ]
