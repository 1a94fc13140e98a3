"""Plans that must hold on large inputs: what is shuffled, sorted, or sent to Python, and that results don't depend on it."""

import json
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import textops as T
from weftline.operators import corpus, filters, langid, membership, metrics, preparation
from weftline.plans import storage
from weftline.sources import readers, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_counted_without_a_sort(spark, tmp_path):
    """Files of several blocks, part files of one folder, and a file without a last line end."""
    rng = random.Random(1)
    files = {"a.tsv": 300, "b.tsv/part-0": 120, "b.tsv/part-1": 90, "c.tsv": 1}
    want = {}
    for name, n in files.items():
        lines = [f"{name} {i} " + "x" * rng.randrange(200) for i in range(n)]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if n > 1 else ""))
        want.setdefault(name.split("/")[0], []).extend(lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_lines(spark, f"{tmp_path}/*")
        got = {}
        for r in df.collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["ordinal"]] = r["value"]
        assert df.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    assert "rangepartitioning" not in plan(df) and plan(df).count("Exchange") == plan(df).count("BroadcastExchange")


def test_changed_files_are_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n")
    df = readers.read_lines(spark, str(tmp_path))
    (tmp_path / "b.txt").write_text("1\n2\n3\n4\n5\n6\n7\n")
    spark.catalog.refreshByPath(str(tmp_path))
    again = readers.read_lines(spark, str(tmp_path))
    assert again.count() == 9 and df.count() in (2, 9)


def test_layout_is_written_by_one_job(spark, tmp_path):
    rows = [("en_hi", "train", 3, "c", "3"), ("en_hi", "train", 1, "a", "1"), ("en_bn", "a b=c", 2, "b\t", "2"), ("en_hi", "dev", 9, "z", "9")]
    df = spark.createDataFrame(rows, "pair string, split string, ordinal long, src string, tgt string")
    for _ in range(2):
        sinks.write_corpus(df, str(tmp_path / "out"))
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").glob("*/*")) == ["en_bn/a b=c.tsv", "en_hi/dev.tsv", "en_hi/train.tsv"]
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out" / "en_hi" / "train.tsv").glob("part-*")))
    assert lines == "a\t1\nc\t3\n"
    # All of one pair and split: the order holds too.
    df = spark.range(200).select(F.lit("p").alias("pair"), F.lit("s").alias("split"), (F.col("id") * 37 % 200).alias("ordinal"), F.col("id").cast("string").alias("src"), F.lit("t").alias("tgt"))
    sinks.write_corpus(df, str(tmp_path / "one"))
    back = readers.read_tsv(spark, f"{tmp_path}/one/p/s.tsv").orderBy("ordinal").collect()
    assert [int(r["src"]) * 37 % 200 for r in back] == list(range(200))


def test_score_names_are_json_strings(spark):
    scores = spark.createDataFrame([('a"b\\', 0.1, 0.2, 0.3, 0.6, 4), ("overall", 0.1, 0.2, 0.3, 0.6, 4)], "slice string, bleu double, rouge_l double, chrf double, total double, n long")
    assert set(json.loads(sinks.scores_json(scores).first()["value"])) == {'a"b\\', "overall"}


def test_language_check_scores_in_place(spark):
    samples = spark.createDataFrame([("the cat sat on the mat", "en"), ("यह एक अच्छा वाक्य है", "hi")], "text string, lang string")
    model = langid.fit(samples, "text", "lang", ["en", "hi"])
    df = spark.createDataFrame([(i, "x y z of it", "the cat sat on the mat again", "hi") for i in range(4)], "i long, src string, tgt string, lang string")
    done = filters.filtered(filters.clean_pairs(df), Config(min_script_ratio=0.0), lid=model)
    assert {r["reason"] for r in done.collect()} == {"lid_language_mismatch"}
    assert "Exchange" not in plan(done) and plan(done).count("ArrowEvalPython") == 2
    # Ties go to the class named first, as in the other forms.
    texts = spark.createDataFrame([(0, "qqq"), (1, "the mat"), (2, None)], "i int, t string")
    same = {r["i"]: r["predicted"] for r in langid.predict(texts.dropna(), model, "i", "t").collect()}
    got = {r["i"]: r["p"] for r in texts.select("i", langid.predictor(model)(F.col("t")).alias("p")).collect()}
    assert got == {**same, 2: None}


def test_preparation_joins_texts_once(spark):
    long = "a sentence with some words"
    df = spark.createDataFrame([("en", "train", 1, "x", long)], "lang string, split string, ordinal long, src string, tgt string")
    out = preparation.prepared(df)
    assert plan(out).count("Join") == 1


@pytest.mark.parametrize("few, most", [(0, 10**9), (10**6, 10**9), (0, 0)])
def test_leaks_found_through_the_filter(spark, monkeypatch, few, most):
    monkeypatch.setattr(corpus, "FEW_KEYS", few)
    monkeypatch.setattr(corpus, "MOST_KEYS", most)
    train = spark.range(3000).select("id", F.when(F.col("id") % 50 == 3, None).otherwise(F.concat(F.lit("t"), F.col("id") % 1000)).alias("src"))
    held = spark.createDataFrame([(f"t{i}",) for i in range(0, 1000, 7)] + [("other",), (None,)], "src string")
    out = corpus.without_leaks(train, held, ["src"])
    assert out.columns == ["id", "src"]
    got = sorted(r["id"] for r in out.collect())
    assert got == [i for i in range(3000) if i % 50 != 3 and (i % 1000) % 7]
    assert corpus.without_leaks(train, held.where("false"), ["src"]).count() == 3000


def test_filter_never_misses_and_seldom_suspects(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, (6000, 2), dtype=np.int64)
    df = spark.createDataFrame([(int(a), int(b), i < 3000) for i, (a, b) in enumerate(keys)], "a long, b long, held boolean").repartition(40)
    ask = membership.may_hold(df.where("held"), 3000)
    got = df.select("held", ask(F.struct("a", "b")).alias("maybe")).groupBy("held", "maybe").count().collect()
    n = {(r["held"], r["maybe"]): r["count"] for r in got}
    assert n.get((True, True)) == 3000 and n.get((False, True), 0) < 30


def test_only_doubtful_texts_are_composed_in_python(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    rng = random.Random(4)
    marks = [c for c in map(chr, range(0xC0, 0x3100)) if unicodedata.combining(c)] + list("\u1161\u11a8\u09be\u0958\u212b\u1100\uac00")
    texts = ["plain", "é", "e\u0301", "\u0915\u093c", "\u1100\u1161\u11a8", "\u09c7\u09be", None, "", *["".join(rng.choice(["a", "é", "क", "ক", *rng.sample(marks, 3)]) for _ in range(8)) for _ in range(400)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", T.nfc(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    # By the class: every text without its members is composed, whatever its neighbours.
    import re

    members = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.uncomposed()))

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=20))
    def check(x):
        kept = members.sub("", x)
        assert unicodedata.is_normalized("NFC", kept)

    check()


def test_counters_come_with_the_rows(spark):
    rows = [("f", None, ["normalised"]), ("f", "duplicate", []), ("g", "length_ratio", ["normalised", "digit_prefix_stripped"]), ("h", None, [])]
    df = spark.createDataFrame(rows, "file string, reason string, flags array<string>").repartition(3)
    out, counters = filters.observed(df, "file", ["f", "g", "none"])
    assert out.where("reason IS NULL").count() == 2
    want = {(r["file"], r["counter"], r["n"]) for r in filters.report(df.where("file <> 'h'"), "file").collect()}
    assert set(counters()) == want


def brute_sums(rows, orders, cut):
    out = Counter()
    for h, r in rows:
        h, r = cut(h or ""), cut(r or "")
        for n in range(1, orders + 1):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            out[n, "m"] += sum((a & b).values())
            out[n, "h"] += sum(a.values())
            out[n, "r"] += sum(b.values())
    return out


def test_sums_of_clipped_matches(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), *(" ".join(rng.choice("abcé") * rng.randint(1, 2) for _ in range(rng.randrange(9))) for _ in range(2))) for _ in range(150)]
    rows += [("x", None, "a b"), ("y", "a", None), (None, "", "")]
    df = spark.createDataFrame(rows, "s string, hyp string, ref string").repartition(3)
    got = metrics._sums(df, "s", tokens=4, chars=6, words=2, rouge=True)
    assert plan(got).count("Scan") + plan(got).count("LocalTableScan") <= 2
    found = {(r["slice"], r["kind"], r["n"]): (r["matches"], r["hyp_n"], r["ref_n"]) for r in got.collect()}
    for s in ("overall", "x", "y", None):
        own = [(h, r) for k, h, r in rows if s == "overall" or k == s]
        for kind, orders, cut in (("w", 2, str.split), ("c", 6, lambda t: t.replace(" ", ""))):
            want = brute_sums(own, orders, cut)
            for n in range(1, orders + 1):
                assert found[s, kind, n] == (want[n, "m"], want[n, "h"], want[n, "r"]), (s, kind, n)
        assert found[s, "rouge", 0][0] == len(own)


def test_metrics_count_bounded_runs(spark, monkeypatch):
    """A worker counts a run of bounded size at a time, however many rows a batch holds."""
    count = metrics._clipped

    def bounded(tokens, *rest):
        assert len(tokens) <= 1 << 18, "a whole batch is counted at once"
        return count(tokens, *rest)

    monkeypatch.setattr(metrics, "_clipped", bounded)
    text = "some words, and more of them " * 20
    df = spark.range(1500).coalesce(1).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"), F.lit(text).alias("hyp"), F.lit(text + "end").alias("ref"))
    ask = dict(tokens=4, chars=6, words=2, rouge=True)
    one = {(r["kind"], r["n"]): r for r in metrics._sums(df.limit(1), None, **ask).collect()}
    for r in metrics._sums(df, "s", **ask).collect():
        k, want = {"x": 500, "y": 1000, "overall": 1500}[r["slice"]], one[r["kind"], r["n"]]
        assert (r["matches"], r["hyp_n"], r["ref_n"]) == tuple(k * want[c] for c in ("matches", "hyp_n", "ref_n"))
        assert abs(r["value"] - k * want["value"]) < 1e-6


def test_long_rows_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RUN", 10)
    rows = [("x", "a b c d e f g h", "a b c x e f g h"), ("y", "", None), ("x", "q " * 50, "q " * 40), ("y", "z", "z")]
    df = spark.createDataFrame(rows, "s string, hyp string, ref string").coalesce(1)
    got = {(r["kind"], r["n"]): (r["matches"], r["hyp_n"], r["ref_n"]) for r in metrics._sums(df, None, tokens=4, chars=6, words=2, rouge=True).collect()}
    for kind, orders, cut in (("w", 2, str.split), ("t", 4, str.split), ("c", 6, lambda t: t.replace(" ", ""))):
        want = brute_sums([r[1:] for r in rows], orders, cut)
        assert all(got[kind, n] == (want[n, "m"], want[n, "h"], want[n, "r"]) for n in range(1, orders + 1))
    assert got["rouge", 0][0] == 4


def texts_of_languages(n):
    rng = random.Random(7)
    letters = {"en": "abcdefgh ", "fr": "éèàçuvwx ", "hi": "नमसतकखगघ "}
    rows = [(i, lang, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(40)))) for i in range(n) for lang in letters]
    return [*rows, (n, "en", None), (n + 1, "fr", ""), (n + 2, "hi", "न" * 3000 + "\U0001f600")]


def test_languages_in_bounded_runs(spark, monkeypatch):
    """Grams are numbered for a run of bounded size at a time, however many rows a batch holds."""
    numbers = langid._keys

    def bounded(flat, *rest):
        assert len(flat) <= 1 << 20, "a whole batch is numbered at once"
        return numbers(flat, *rest)

    monkeypatch.setattr(langid, "_keys", bounded)
    text = "the cat sat on the mat " * 50
    df = spark.range(1500).coalesce(1).select("id", F.lit(text).alias("text"), F.lit("en").alias("lang"))
    got = {r["gram"]: r["n"] for r in langid.gram_counts(df, "text", "lang").collect()}
    padded = f" {text.strip()} "
    assert got == {g: 1500 * n for g, n in Counter(padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1)).items()}
    model = langid.fit(df.limit(10), "text", "lang", ["en", "hi"])
    assert {r["predicted"] for r in langid.predict(df, model, "id", "text").collect()} == {"en"}
    assert {r["p"] for r in df.select(langid.predictor(model)(F.col("text")).alias("p")).collect()} == {"en"}


@pytest.mark.parametrize("run, held", [(1, 1), (7, 20), (500, 1 << 17)])
def test_runs_leave_languages_as_they_are(spark, monkeypatch, run, held):
    rows = texts_of_languages(60)
    df = spark.createDataFrame(rows, "id int, lang string, text string").repartition(2)
    model = langid.fit(df, "text", "lang", ["en", "fr", "hi"])
    want = {r["id"]: (r["predicted"], round(r["score"], 6)) for r in langid.predict(df.where("text IS NOT NULL"), model, "id", "text").collect()}
    monkeypatch.setattr(langid, "RUN", run)
    monkeypatch.setattr(langid, "HELD", held)
    counts = Counter((lang, p[i : i + k]) for _, lang, t in rows if t is not None for p in [f" {t.strip()} "] for k in (1, 2, 3) for i in range(len(p) - k + 1))
    assert {(r["cls"], r["gram"]): r["n"] for r in langid.gram_counts(df, "text", "lang").collect()} == counts
    assert {r["id"]: (r["predicted"], round(r["score"], 6)) for r in langid.predict(df.where("text IS NOT NULL"), model, "id", "text").collect()} == want
    said = {r["id"]: r["p"] for r in df.where("id >= 60").select("id", langid.predictor(model)(F.col("text")).alias("p")).collect()}
    assert said == {60: None, 61: want[61][0], 62: "hi"}


def test_texts_are_composed_in_bounded_runs(spark, monkeypatch):
    """As Arrow, some texts at a time, and without a module that each worker would load for it."""
    from pyspark.util import PythonEvalType

    assert T._composed.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    compose = T.composed_run

    def bounded(texts):
        assert len(texts) <= 128, "a whole batch is composed at once"
        return compose(texts)

    monkeypatch.setattr(T, "composed_run", bounded)
    texts = [[None, "plain", f"e\u0301 {i}", "", "\u1100\u1161\u11a8"][i % 5] for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for rows, want in ((df, texts), (df.where("i < 2"), texts[:2]), (df.where("i < 0"), [])):
        got = {r["i"]: r["n"] for r in rows.select("i", T.nfc(F.col("t")).alias("n")).collect()}
        assert got == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(want)}


def made_of(monkeypatch):
    """How each table that is made in the driver from now on comes about."""
    made, make = [], SparkSession.createDataFrame

    def seen(self, *args, **kwargs):
        df = make(self, *args, **kwargs)
        made.append(df._jdf.queryExecution().toRdd().toDebugString())
        return df

    monkeypatch.setattr(SparkSession, "createDataFrame", seen)
    return made


def test_class_names_start_no_workers(spark, monkeypatch):
    samples = spark.createDataFrame(texts_of_languages(5), "id int, lang string, text string")
    made = made_of(monkeypatch)
    model = langid.fit(samples, "text", "lang", ["en", "zz", "hi"])
    assert len(made) == 1 and "PythonRDD" not in made[0]
    assert [(r["place"], r["cls"]) for r in model.classes.orderBy("place").collect()] == [(0, "en"), (1, "zz"), (2, "hi")]
    assert dict(model.classes.dtypes)["place"] == "int"
    # What was done before, to show that the test sees it.
    spark.createDataFrame([(0, "en")], "place int, cls string")
    assert "PythonRDD" in made[1]


def test_counters_of_a_report_start_no_workers(spark, small, monkeypatch):
    made = made_of(monkeypatch)
    got = {(r["file"], r["counter"]): r["n"] for r in storage.prepare_report(spark, small).collect()}
    assert made and not any("PythonRDD" in x for x in made)
    read = {f: n for (f, c), n in got.items() if c == "read"}
    assert read and read == {f: sum(n for (g, c), n in got.items() if g == f and (c == "kept" or c.startswith("dropped_"))) for f in read}


@pytest.fixture(scope="module")
def turns(tmp_path_factory, spark):
    """Conversations that make one large batch."""
    path = tmp_path_factory.mktemp("turns")
    text = F.concat_ws(" ", F.col("conv_id"), F.lit("some words, and more of them " * 20))
    df = spark.range(1500).coalesce(1).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("role"), text.alias("text"))
    df.write.parquet(f"{path}/conversations.parquet")
    return str(path)


def counted_in_runs(monkeypatch):
    count = metrics._clipped

    def bounded(tokens, *rest):
        assert len(tokens) <= 1 << 18, "a whole batch is counted at once"
        return count(tokens, *rest)

    monkeypatch.setattr(metrics, "_clipped", bounded)


def test_scores_json_counts_bounded_runs(spark, turns, monkeypatch):
    counted_in_runs(monkeypatch)
    got = {r["slice"]: r["n"] for r in storage.scores_json(spark, turns).collect()}
    assert got == {"overall": 1500, "x": 500, "y": 1000}


def test_scores_lines_counts_bounded_runs(spark, turns, monkeypatch):
    counted_in_runs(monkeypatch)
    got = [r["value"].split(": ") for r in storage.scores_lines(spark, turns).orderBy("ordinal").collect()]
    assert [k for k, _ in got] == ["bleu", "rouge_l", "chrf", "total"] and all(0 < float(v) < 3 for _, v in got)


def test_words_are_encoded_without_python_objects(spark):
    from pyspark.util import PythonEvalType

    from weftline.operators import training

    encode = training.word_encoder(["b", "a", "é"], 6)
    assert encode.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    rows = [(0, ["a", "x", "b"]), (1, None), (2, []), (3, ["é", None]), (4, ["b"])]
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1)
    got = {r["i"]: r["ids"] for r in df.select("i", encode("w").alias("ids")).collect()}
    assert got == {0: [7, 1, 6], 1: None, 2: [], 3: [8, 1], 4: [6]}
    # Slices of an array: what a filter or limit leaves.
    assert [r["ids"] for r in df.where("i >= 2").orderBy("i").select(encode("w").alias("ids")).collect()] == [[], [8, 1], [6]]
