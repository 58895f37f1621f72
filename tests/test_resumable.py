"""A scorer that counts its calls, killed in the middle of a batch and started again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from slotmeter.operators import resumable as rs


def calls(folder):
    return Counter(line for f in folder.iterdir() for line in f.read_text().split())


def scorer(folder, trap=None):
    """Doubles a number, notes each key in a file of its own task, and dies at a key while the trap is set."""

    def run(batches):
        import os
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as log:
            for b in batches:
                for k in b["id"].tolist():
                    if trap is not None and k == 37 and os.path.exists(trap):
                        raise RuntimeError("killed")
                    print(k, file=log, flush=True)
                yield b.assign(score=b["x"] * 2.0)[["id", "score"]]

    return lambda rows: rows.select("id", "x").mapInPandas(run, "id long, score double")


def test_a_killed_batch_is_redone_and_none_is_scored_twice(spark, tmp_path):
    log, trap, path = tmp_path / "log", tmp_path / "trap", str(tmp_path / "table")
    log.mkdir()
    trap.touch()
    todo = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("x"))
    with pytest.raises(Exception, match="killed"):
        rs.score_resumable(todo, ["id"], scorer(log, str(trap)), path, batch_rows=20)
    done = {r["id"] for r in rs.results(spark, path, "id long, score double").collect()}
    finished = rs.ledger(spark, path).count()
    first = calls(log)
    assert 37 not in done and len(done) < 100 and rs.ledger(spark, path).agg(F.sum("rows")).head()[0] in (len(done), None)
    assert all(first[str(i)] == 1 for i in done)
    trap.unlink()
    assert rs.score_resumable(todo, ["id"], scorer(log, str(trap)), path, batch_rows=20) > 0
    second = calls(log)
    found = rs.results(spark, path, "id long, score double").collect()
    assert sorted((r["id"], r["score"]) for r in found) == [(i, i % 7 * 2.0) for i in range(100)]
    assert all(second[str(i)] == first[str(i)] for i in done)  # nothing of a finished batch again
    assert {r["batch"] for r in found if r["id"] in done} == set(range(finished))
    assert rs.score_resumable(todo, ["id"], scorer(log), path, batch_rows=20) == 0 and calls(log) == second


def test_more_rows_later_null_keys_and_a_stop(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "table")
    log.mkdir()
    few = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, 3.0)], "id long, x double")
    score = lambda rows: rows.select("id", (F.col("x") * 2).alias("score"))
    assert rs.score_resumable(few, ["id"], score, path, batch_rows=1, stop_after=2) == 2
    assert rs.score_resumable(few.unionAll(spark.createDataFrame([(4, 4.0)], "id long, x double")), ["id"], score, path, batch_rows=100) == 1
    got = rs.results(spark, path, "id long, score double").collect()
    assert sorted((str(r["id"]), r["score"]) for r in got) == [("1", 2.0), ("3", 6.0), ("4", 8.0), ("None", 4.0)]
    assert {r["run"] for r in got} == {1, 2}
    assert rs.score_resumable(few.limit(0), ["id"], score, path) == 0 and rs.results(spark, str(tmp_path / "no"), "id long").count() == 0
