import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from slotmeter.llm.bpe import Bpe, Decoder
from slotmeter.llm.langid import fit_languages, held_out, identify
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_same_as_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(table.where(~held_out(F.col("doc_id"), 4, 2)))
    named = {r["doc_id"]: r for r in identify(table, model).collect()}
    assert 0 < model.least < 1
    docs = {i: t for i, t in sorted(docs.items()) if named[i]["lang_pred"] != "und" and named[i]["score"] >= model.least}
    seen, kept = set(), {}
    for i, text in docs.items():
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    root = brute.near_duplicates(list(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if root[i][1] == i}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}

    def clean(t):
        w = words(t)
        return not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))

    kept = {i: t for i, t in kept.items() if clean(t)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept.items()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r["ids"] for i, r in got.items()} == want
    own = Bpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    decoder = Decoder(own)
    assert all(r["decoded"] == decoder.feed(want[i]) + decoder.close() for i, r in got.items())
    assert any("</w>" not in r["decoded"] and len(r["decoded"]) > 100 for r in got.values())


def write(spark, path, rows, extra=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], schema).selectExpr("*", *extra)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q", " ".join(f"word{k}" for k in range(12))), (None, None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages_on_edge_cases(spark, tmp_path):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200 and lang = 'en'").limit(30).collect()]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    long = " ".join(texts) * 20
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !", None), (103, texts[3], None), (103, texts[3], None), (104, long, None), (None, texts[4] + " tail", "en"), (105, " ".join(f"word{k}" for k in range(12)) + " " + texts[5][:80], "en"), (106, "a\nb\nc\n" + texts[6], "en"), (107, "a\nb\nc\n" + texts[7], "en")]
    docs = write(spark, tmp_path, rows, ("text as ids", "doc_id as id", "lang as hit"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    language, lines, near, clean = (stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES[:-1])
    kept = {r["doc_id"] for r in language.collect()}
    assert not kept & {100, 101, 102} and {103, 104, None} <= kept
    assert all(r["lang"] is not None for r in language.collect())
    assert next(r["text"] for r in lines.where("doc_id = 107").collect()) == texts[7] or "\n" in texts[7]
    ids = [r["doc_id"] for r in near.collect()]
    assert ids.count(103) == 0 and {100, 101, None} <= set(ids) and len(ids) == len(set(ids))
    assert 105 not in {r["doc_id"] for r in clean.collect()} and {100, 101, 104} <= {r["doc_id"] for r in clean.collect()}
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(coded) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in coded)
    result = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not result & {100, 101, 102, 105} and 104 in result
