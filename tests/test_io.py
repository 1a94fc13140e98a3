import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import pieces
from weftline.sources import readers, sinks
from weftline.streaming import cleaning


def only_file(path):
    return next(p for p in path.iterdir() if p.name.startswith("part-")).read_bytes()


def test_tsv(spark, tmp_path):
    f = tmp_path / "data" / "en_hi" / "train.tsv"
    f.parent.mkdir(parents=True)
    f.write_bytes(b'a\tb\r\n\n"q\tw\nx\ty')
    got = [(r["ordinal"], r["src"], r["tgt"]) for r in readers.read_tsv(spark, str(f)).orderBy("ordinal").collect()]
    assert [g[1:] for g in got] == [("a", "b"), ('"q', "w"), ("x", "y")] and [g[0] for g in got] == sorted(g[0] for g in got)
    row = readers.read_corpus(spark, str(tmp_path / "data")).orderBy("ordinal").first()
    assert (row["pair"], row["split"], row["lang"]) == ("en_hi", "train", "hi")
    sinks.write_tsv(readers.read_tsv(spark, str(f)), str(tmp_path / "out"))
    assert only_file(tmp_path / "out") == b'a\tb\n"q\tw\nx\ty\n'
    for bad in (b"a\n", b"a\tb\tc\n"):
        f.write_bytes(bad)
        with pytest.raises(Exception, match="expected 2 fields"):
            readers.read_tsv(spark, str(f)).collect()


def test_tagged(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text("<2hi> a b\tc\n<2bn> d\te\n")
    got = [(r["lang"], r["src"]) for r in readers.read_tagged(spark, str(f), ["hi", "bn"]).orderBy("ordinal").collect()]
    assert got == [("hi", "a b"), ("bn", "d")]
    sinks.write_by_language(readers.read_tsv(spark, str(f)), str(tmp_path / "by"), ["hi", "bn"])
    assert spark.read.parquet(str(tmp_path / "by")).where("lang = 'hi'").count() == 1


def test_json(spark, tmp_path):
    v = {"English-Hindi": {"Validation": {"9": {"source": "a"}, "3": {"source": "b"}}}}
    (tmp_path / "v.json").write_text(json.dumps(v))
    assert [(r["id"], r["ordinal"]) for r in readers.read_validation(spark, str(tmp_path / "v.json")).collect()] == [("9", 0), ("3", 1)]
    (tmp_path / "h.json").write_text(json.dumps({"s": {"1": "x"}}))
    assert tuple(readers.read_hypotheses(spark, str(tmp_path / "h.json")).first()) == ("s", "1", "x")
    memory = spark.createDataFrame([("hi", "a\tb", "c"), ("bn", "d", "e")], "lang string, src string, tgt string")
    sinks.write_memory_json(memory, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.read_memory_json(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, memory.collect()))
    assert readers.read_memory_json(spark, None).count() == 0
    (tmp_path / "hist.json").write_text('[{"step": 1, "dev_loss": 2.5}, {"step": 2, "dev_loss": 2.0}]')
    assert readers.read_history(spark, str(tmp_path / "hist.json")).count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2", 'say "hi"', 1), ("1", "", 0)], "id string, text string, o int")
    sinks.write_submission(rows, str(tmp_path / "s"), "o")
    assert only_file(tmp_path / "s") == b'"ID"\t"Translation"\r\n"1"\t""\r\n"2"\t"say ""hi"""\r\n'
    sinks.write_lines(rows.withColumn("text", F.lit("a\nb")), str(tmp_path / "l"), "text", "o")
    assert only_file(tmp_path / "l") == b"a b\na b\n"
    sinks.write_scores(spark.createDataFrame([(0.27491, 0.5381, 0.5014)], "bleu double, rouge_l double, chrf double"), str(tmp_path / "x"))
    assert only_file(tmp_path / "x") == b"bleu: 0.275000\nrouge_l: 0.538000\nchrf: 0.501000\ntotal: 1.314000\n"
    sinks.write_report(spark.createDataFrame([("f", "read", 3)], "file string, counter string, n int"), str(tmp_path / "r"))
    assert json.loads(only_file(tmp_path / "r"))["n"] == 3
    sinks.write_hypotheses(spark.createDataFrame([("s", "1", "x")], "section string, id string, hyp string"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).first()["section"] == "s"


def test_copy_existing(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    assert sinks.copy_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "to")) == [str(tmp_path / "a")]
    assert (tmp_path / "to" / "a").read_text() == "x"


def test_pieces(spark):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    pytest.importorskip("sentencepiece")
    import os

    if not os.path.exists(path):
        pytest.skip("no model")
    df = spark.createDataFrame([("hello world",), ("guten Tag",)], "t string")
    out = df.withColumn("ids", pieces.encoder(path)(F.col("t"))).withColumn("back", pieces.decoder(path)(F.col("ids")))
    assert all(r["back"] == r["t"] and len(r["ids"]) > 1 for r in out.collect())


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("ab", "xy", "en"), ("", "b", "en"), ("cc", "cc", "en"), ("leak", "tt", "en")], "src string, tgt string, lang string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, tgt string, lang string").parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([("leak",)], "src string")
    rows = cleaning.without_leaks(cleaning.cleaned(stream), held, ["src"])
    q = cleaning.counters(rows, "lang").writeStream.outputMode("complete").format("memory").queryName("counters").start()
    try:
        q.processAllAvailable()
        got = {r["counter"]: r["n"] for r in spark.table("counters").collect()}
    finally:
        q.stop()
    assert got == {"read": 3, "kept": 1, "dropped_empty_field": 1, "dropped_src_equals_tgt": 1}


def test_streaming_windows(spark, tmp_path):
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a", None), (at(2), "a", "x"), (at(2), "a", "x"), (at(59), "b", None)], "ts timestamp, k string, reason string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, reason string").parquet(str(tmp_path / "in"))
    for name, df in (("win", cleaning.windowed_counters(stream, "ts", "5 minutes", "10 minutes")), ("uniq", cleaning.distinct_within(stream, ["k"], "ts", "5 minutes"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert {(r["reason"], r["n"]) for r in spark.table("win").collect()} == {("kept", 1), ("x", 2)}
    assert spark.table("uniq").count() == 2


def test_hypotheses_and_scores_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("s", "1", 'a "q"'), ("s", "2", "b\nc"), ("t", "1", "d")], "section string, id string, hyp string")
    sinks.write_hypotheses_json(rows, str(tmp_path / "h"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "h")).collect())
    assert json.loads(text) == {"s": {"1": 'a "q"', "2": "b\nc"}, "t": {"1": "d"}}
    assert {tuple(r) for r in readers.read_hypotheses(spark, str(tmp_path / "h")).collect()} == {tuple(r) for r in rows.collect()}
    sinks.write_hypotheses_json(rows.where("false"), str(tmp_path / "none"))
    assert readers.read_hypotheses(spark, str(tmp_path / "none")).count() == 0
    scores = spark.createDataFrame([("overall", 0.1, 0.2, 0.3, 0.6, 4)], "slice string, bleu double, rouge_l double, chrf double, total double, n long")
    one = json.loads(sinks.scores_json(scores, {"sacrebleu": "unavailable"}).first()["value"])
    assert one == {"overall": {"bleu": 0.1, "rouge_l": 0.2, "chrf": 0.3, "total": 0.6, "n": 4}, "cross_check": {"sacrebleu": "unavailable"}}


def test_indented_json_is_read_whole(spark, tmp_path):
    (tmp_path / "tm.json").write_text(json.dumps({"hi\ta": "x", "bn\tb": "y"}, indent=2))
    assert {tuple(r) for r in readers.read_memory_json(spark, str(tmp_path / "tm.json")).collect()} == {("hi", "a", "x"), ("bn", "b", "y")}


def test_command_lines_end_to_end(spark, tmp_path):
    from weftline.__main__ import main

    text = {"hi": "यह एक छोटा सा वाक्य है", "bn": "এটি একটি ছোট বাক্য এখানে"}
    for lang in ("hi", "bn"):
        for split, sources in (("train", ["this is a short sentence", "this is a short sentence", "one more of these lines"]), ("dev", ["one more of these lines"]), ("test", ["something else to read"])):
            (tmp_path / "raw" / f"en_{lang}").mkdir(parents=True, exist_ok=True)
            (tmp_path / "raw" / f"en_{lang}" / f"{split}.tsv").write_text("".join(f"{s}\t{text[lang]}\n" for s in sources))
    val = {"English-Hindi": {"Validation": {"1": {"source": "one more of these lines"}, "2": {"source": "new"}}}}
    (tmp_path / "val.json").write_text(json.dumps(val, indent=1))
    (tmp_path / "hyps.json").write_text(json.dumps({"English-Hindi": {"1": "a", "2": " b  c "}}))
    at = lambda name: str(tmp_path / name)
    main(["lid", "--raw", at("raw"), "--out", at("lid.json"), "--langs", "en", "hi", "bn", "--limit", "50", "--holdout", "0"])
    main(["lid", "--raw", at("raw"), "--out", at("lid2.json"), "--langs", "en", "hi", "bn", "--holdout", "1"])
    main(["prepare", "--raw", at("raw"), "--out", at("clean"), "--lid", at("lid.json"), "--langs", "en", "hi", "bn", "--validation", at("val.json"), "--section", "English-Hindi=hi"])
    report = json.loads(spark.read.text(at("clean/report.json"), wholetext=True).first()["value"])
    assert report["per_file"]["en_hi/train"] == {"read": 3, "kept": 1, "dropped_duplicate": 1, "dropped_leaked_into_eval": 1}
    assert report["val_tm_coverage"] == {"English-Hindi": {"records": 2, "tm_hits": 1, "pct": 50.0}} and report["config"]["lid_enabled"]
    tagged = readers.read_tagged(spark, at("clean/combined/dev.tsv"), ["hi", "bn"]).orderBy("ordinal").collect()
    assert [(r["lang"], r["src"]) for r in tagged] == [("hi", "one more of these lines"), ("bn", "one more of these lines")]
    (tmp_path / "hyp.txt").write_text("".join(r["tgt"] + "\n" for r in tagged))
    main(["score", "--hyp", at("hyp.txt"), "--ref", at("clean/combined/dev.tsv"), "--out", at("scores.json"), "--langs", "hi", "bn", "--cross-check"])
    scores = {r["slice"]: r["bleu"] for r in readers.read_scores(spark, at("scores.json")).collect()}
    assert scores == {"overall": 1.0, "hi": 1.0, "bn": 1.0}
    main(["submit", "--validation", at("val.json"), "--section", "English-Hindi=hi", "--hyps", at("hyps.json"), "--tm", at("clean/tm_all.json"), "--out", at("answer")])
    assert only_file(tmp_path / "answer").decode() == f'"ID"\t"Translation"\r\n"1"\t"{text["hi"]}"\r\n"2"\t"b c"\r\n'


def test_gate_command_fails_on_leaks(spark, tmp_path):
    from weftline.__main__ import main

    raw = tmp_path / "raw" / "en_fr"
    raw.mkdir(parents=True)
    for split, at in (("train", 0), ("dev", 100), ("test", 200)):
        lines = [f"this sentence says number w{k} x{k * 7}\tce texte dit u{k} v{k * 3} z{k * 5} q{k}\n" for k in range(at, at + 20)]
        (raw / f"{split}.tsv").write_text("".join(lines))
    main(["prepare", "--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "clean"), "--langs", "fr"])
    main(["gate", "--out", str(tmp_path / "clean")])
    leak = next((tmp_path / "clean" / "pairs" / "en_fr" / "dev.tsv").glob("part-*")).read_text().splitlines()[0]
    (tmp_path / "clean" / "pairs" / "en_fr" / "train.tsv" / "part-leak").write_text(leak + "\n")
    with pytest.raises(SystemExit):
        main(["gate", "--out", str(tmp_path / "clean")])
