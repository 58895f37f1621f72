import zlib

import numpy as np

from slotmeter.llm.langid import ByteGru, count_words, fit_languages, identify
from slotmeter.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op3_langid"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.97


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of the"), (4, "the and of the"), (None, "der die und das"), (5, "the and " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as score", "text as lang_pred")
    labelled = spark.createDataFrame([("the and of to in is", "en"), ("der die und das ist", "de"), (None, "fr"), ("le la les", None)] * 20, "text string, lang string")
    model = fit_languages(labelled)
    assert model.classes == ["de", "en"]
    got = identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3))
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    assert fit_languages(labelled.limit(0)) is None
    assert {r["lang_pred"] for r in identify(docs, None).collect()} == {"und"}
    assert identify(docs.limit(0), model).collect() == []


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = ByteGru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])

    def loss():
        both = np.concatenate([net._forward(x, "f")[0], net._forward(x, "b")[0]], axis=2)
        logits = both @ net.p["v"] + net.p["c"]
        return -np.mean([np.log(np.exp(logits[t, k, y[k]]) / np.exp(logits[t, k]).sum()) for t in range(5) for k in range(4)])

    hf, mf = net._forward(x, "f")
    hb, mb = net._forward(x, "b")
    both = np.concatenate([hf, hb], axis=2)
    prob = np.exp(both @ net.p["v"] + net.p["c"])
    prob /= prob.sum(2, keepdims=True)
    prob[:, np.arange(4), y] -= 1
    outer = prob / 20 @ net.p["v"].T
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    net._backward(x, "f", mf, outer[..., :3], grad)
    net._backward(x, "b", mb, outer[..., 3:], grad)
    for name in ("uf", "ub", "bf", "bb"):
        for k in range(net.p[name].size):
            flat = net.p[name].reshape(-1)
            flat[k] += 1e-5
            up = loss()
            flat[k] -= 2e-5
            down = loss()
            flat[k] += 1e-5
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[k]) < 1e-4


def test_every_word_and_every_labelled_text_counts(spark):
    """What tells three languages apart stands at one place of long texts; the threshold is that of all whole texts."""
    own = {"aa": "kuku baba dudu gaga", "bb": "xixi zeze vivi sese", "cc": "mol tor nol por"}
    rows = [(f"{'lorem ' * (3000 + 7 * k)}{words} {'ipsum ' * (2000 - 9 * k)}", lang) for lang, words in own.items() for k in range(60)]
    table = spark.createDataFrame([*rows, ("x" * 300, "cc"), (None, "aa"), ("kuku", None)], "text string, lang string")
    counted = {(r["lang"], bytes(r["word"]).decode()): r["n"] for r in count_words(table.where("text is not null and lang is not null")).collect()}
    assert counted["aa", "kuku"] == 60 and counted["aa", "lorem"] == sum(3000 + 7 * k for k in range(60))
    assert counted["cc", "x" * 128] == 2 and counted["cc", "x" * 44] == 1 and ("aa", "xixi") not in counted
    model = fit_languages(table)
    asked = spark.createDataFrame([(lang, words) for lang, words in own.items()], "doc_id string, text string")
    assert all(r["doc_id"] == r["lang_pred"] for r in identify(asked, model).collect())
    scores = sorted(r["score"] for r in identify(table.where("text is not null and lang is not null").selectExpr("1 as doc_id", "text"), model).collect())
    assert abs(model.least - 0.8 * scores[int(0.005 * len(scores))]) < 1e-4
    again = fit_languages(table.repartition(7), threshold=False)
    assert np.allclose(model.packed(), again.packed(), atol=1e-5)
