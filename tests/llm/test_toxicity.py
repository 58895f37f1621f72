import numpy as np

from slotmeter.llm.queries import QUERIES
from slotmeter.llm.toxicity import DECAY, ORDER, Svm, codes, cuts, fit_toxicity, kernel, plain, runs, score_toxicity


def brute_kernel(a, b):
    from itertools import combinations

    def weights(s):
        out = {}
        for at in combinations(range(len(s)), ORDER):
            key = tuple(s[i] for i in at)
            if all(c.isalnum() for c in key):
                out[key] = out.get(key, 0) + DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_is_the_sum_over_subsequences():
    pairs = [("stupid", "stupid"), ("s t u p i d", "stupid"), ("stuxpid", "stupid"), ("aaaa", "aaa"), ("ab", "abc"), ("été", "étés")]
    got = kernel(codes([a for a, _ in pairs], 12), codes([b for _, b in pairs], 9))
    assert np.allclose(got, [brute_kernel(a, b) for a, b in pairs], rtol=1e-4)


def test_units():
    assert runs("you s t u p i d man, ok") == ["stupid"] and plain("s-t.u_p") == "stup"
    assert all(len(u) <= 32 for u in cuts("x" * 500)) and len(cuts("x" * 500)) > 20


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op7_toxicity"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [(lang[r["doc_id"]], label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]

    def shares(which):
        y, p = np.array([o[1] for o in out if o[0] in which], bool), np.array([o[2] for o in out if o[0] in which], bool)
        return p[y].mean(), p[~y].mean()

    every = {o[0] for o in out}
    print({x: shares([x]) for x in sorted(every)}, shares(every))
    assert shares(["en"])[0] > 0.85 and shares(["en"])[1] < 0.01
    assert shares(every)[0] > 0.75 and shares(every)[1] < 0.03


def test_edge_cases(spark):
    bad = [f"the cat sat here. you {w} thing." for w in ("stupid", "moronic", "worthless")] * 10
    good = [f"the cat sat {w} here. you {w} thing. it was a good {w} day." for w in ("there", "down", "inside", "steep", "more")] * 10
    labelled = spark.createDataFrame([(t, 1) for t in bad] + [(t, 0) for t in good] + [(None, 1), ("x", None)], "text string, toxic int")
    model = fit_toxicity(labelled)
    rows = [(1, "You s-t-u-p-i-d person"), (2, "s t u p i d"), (3, None), (4, ""), (5, "a nice day " * 20_000), (6, "stuupid"), (6, "stuupid"), (None, "worthlesss")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as score", "text as toxic")
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert all(by[i] >= 0.7 for i in (1, 2, 6, None)) and all(by[i] < 0.3 for i in (3, 4, 5)), by
    assert score_toxicity(docs.limit(0), model).collect() == []
    assert isinstance(fit_toxicity(labelled.limit(0)), Svm)
    assert {round(r["score"], 3) for r in score_toxicity(docs, fit_toxicity(labelled.where("toxic = 0"))).collect()} == {0.018}
