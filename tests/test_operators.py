import math
import random
import sys
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.operators import corpus, filters, gates, langid, metrics, ordering, packing, training

PAIR = "src string, tgt string, lang string"


def reasons(spark, rows, config=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {PAIR}")
    return [r["reason"] for r in filters.filtered(filters.clean_pairs(df), config or Config()).orderBy("i").collect()]


def test_reason_order_and_bounds(spark):
    ten = "abcdefghij"
    deva = "क" * 10
    assert reasons(spark, [
        ("", "क", "hi"), ("abc", "abc", "hi"), ("abc", "xyz", "hi"), ("x", "৳ক" + "ৰ" * 3, "bn"), ("x", "কক" + "ৰ" * 2, "bn"),
        (ten, "क" * 30, "hi"), (ten, "क" * 31, "hi"), ("abcdefghi", "क" * 90, "hi"), ("a", "123", "hi"), (ten, deva, "hi"), (None, "क", "hi"),
    ]) == ["empty_field", "src_equals_tgt", "wrong_script", "assamese_target", None, None, "length_ratio", None, "wrong_script", None, "empty_field"]


def test_flags(spark):
    df = spark.createDataFrame([("3: a", "7: क ", "hi"), ("a", "क", "hi"), ("a  b", "क", "hi")], PAIR)
    got = [tuple(r["flags"]) for r in filters.clean_pairs(df).collect()]
    assert got == [("digit_prefix_stripped", "digit_prefix_stripped_src", "normalised"), (), ("normalised",)]


def test_report_conserves(spark):
    df = spark.createDataFrame([("a", "b", "en")] * 3 + [("", "b", "en"), ("c", "c", "en")], PAIR)
    rows = filters.filtered(filters.clean_pairs(df))
    got = {r["counter"]: r["n"] for r in filters.report(rows, "lang").collect()}
    assert got == {"read": 5, "kept": 3, "dropped_empty_field": 1, "dropped_src_equals_tgt": 1}
    assert gates.conservation_gate(filters.report(rows, "lang")).first()["status"] == "PASS"


def test_language_filter(spark):
    en, hi = "the cat sat on the mat again", "यह एक अच्छा वाक्य है और लंबा"
    samples = spark.createDataFrame([(en, "en"), ("a dog and the house", "en"), (hi, "hi"), ("वह घर जाता है", "hi")], "text string, lang string")
    model = langid.fit(samples, "text", "lang", ["en", "hi", "bn"])
    config = Config(min_script_ratio=0.0)
    df = spark.createDataFrame([("x", en, "hi"), ("y", hi, "hi"), ("z", "short", "hi"), ("w", en * 9, "hi")], PAIR)
    got = {r["src"]: r["reason"] for r in filters.filtered(filters.clean_pairs(df), config, lid=model).collect()}
    assert got == {"x": "lid_language_mismatch", "y": None, "z": None, "w": "lid_language_mismatch"}


def test_langid_matches_counters(spark, tmp_path):
    data = [("aab", "en"), ("abc abc", "en"), ("xyz", "hi"), ("xx y", "hi")]
    model = langid.fit(spark.createDataFrame(data, "t string, l string"), "t", "l", ["en", "hi", "bn"])
    langid.save(model, str(tmp_path / "m"))
    model = langid.load(spark, str(tmp_path / "m"))
    grams = lambda t: [f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)]
    counts = {c: Counter(g for t, l in data if l == c for g in grams(t)) for c in ("en", "hi", "bn")}
    v = len(set().union(*counts.values()))

    def score(t, c):
        denom = sum(counts[c].values()) + 0.1 * v
        docs = max(sum(l == c for _, l in data), 1)
        return math.log(docs / len(data)) + sum(math.log((counts[c][g] + 0.1) / denom) for g in grams(t))

    texts = ["aab", "xy", "q", ""]
    got = langid.scores(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), model, "i", "t").collect()
    assert len(got) == 12
    for r in got:
        assert r["score"] == pytest.approx(score(texts[r["i"]], r["cls"]))
    said = {r["i"]: r["predicted"] for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), model, "i", "t").collect()}
    assert said[0] == "en" and said[1] == "hi"


def test_memory_rules(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 4), ("b", "y", 5)], "src string, tgt string, o int")
    got = {r["src"]: (r["tgt"], r["n"]) for r in corpus.translation_memory(df, ["src"], "tgt", F.col("o")).collect()}
    assert got == {"a": ("x", 1), "b": ("y", 2)}
    items = spark.createDataFrame([(1, "a"), (2, "q"), (3, "r")], "id int, src string")
    memory = corpus.translation_memory(df, ["src"], "tgt", F.col("o"))
    hyps = spark.createDataFrame([(1, "no"), (2, " h  1 ")], "id int, hyp string")
    out = {r["id"]: (r["text"], r["origin"]) for r in corpus.apply_memory(items, memory, hyps, ["src"], "id").collect()}
    assert out == {1: ("x", "memory"), 2: ("h 1", "hypothesis"), 3: ("", "missing")}


def test_leak_scope_and_dedup(spark):
    train = spark.createDataFrame([("hi", "a", 1), ("bn", "a", 2), ("hi", "b", 3)], "pair string, src string, o int")
    held = spark.createDataFrame([("bn", "a")], "pair string, src string")
    assert {r["o"] for r in corpus.without_leaks(train, held, ["pair", "src"]).collect()} == {1, 3}
    twice = train.union(train.withColumn("o", F.col("o") + 9))
    assert {r["o"] for r in corpus.first_of_each(twice, ["pair", "src"], "o", ["pair"]).collect()} == {1, 2, 3}
    assert corpus.reconcile(held, held, "src").count() == 0


def tok(t):
    import re

    out = []
    for w in t.split():
        a, b, c = re.match(r"^([^\w\s]*)(.*?)([^\w\s]*)$", w, re.S).groups()
        out += [*a, *([b] if b else []), *c]
    return out


def py_bleu(pairs):
    num, den, hl, rl = Counter(), Counter(), 0, 0
    for h, r in pairs:
        h, r = tok(h), tok(r)
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            hc, rc = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            num[n] += sum((hc & rc).values())
            den[n] += sum(hc.values())
    if not num[1] or not all(den[n] for n in range(1, 5)):
        return 0.0
    s = sum(0.25 * math.log(num[n] / den[n] if num[n] else sys.float_info.min) for n in range(1, 5))
    return (1.0 if hl > rl else math.exp(1 - rl / hl)) * math.exp(s)


def py_chrf(pairs):
    agg = {}
    for h, r in pairs:
        for kind, a, b, top in (("c", "".join(h.split()), "".join(r.split()), 6), ("w", h.split(), r.split(), 2)):
            for n in range(1, top + 1):
                hc, rc = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, b))
                s = agg.setdefault((kind, n), [0, 0, 0])
                for k, v in enumerate((sum((hc & rc).values()), sum(hc.values()), sum(rc.values()))):
                    s[k] += v
    p, r = (sum(s[0] / s[k] if s[k] else 0 for s in agg.values()) / 8 for k in (1, 2))
    return 5 * p * r / (4 * p + r) if p + r else 0.0


CASES = [
    [("the cat sat on the mat .", "the cat sat on a mat.")],
    [("a b c d e f", "a b c d e f"), ("x y", "x z")],
    [("", "a b c"), ("a b c d", "a b c d e f g")],
    [("a b c", "a b c")],
    [("x", "y")],
]


@pytest.mark.parametrize("pairs", CASES)
def test_metrics_match_counters(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, hyp string, ref string")
    assert metrics.bleu(df).first()["bleu"] == pytest.approx(py_bleu(pairs))
    assert metrics.chrf(df).first()["chrf"] == pytest.approx(py_chrf(pairs))


def test_metric_slices_and_report(spark):
    rows = [(i, random.Random(i).choice(["a", "b"]), "the cat is on the mat now", "the cat was on the mat") for i in range(6)]
    df = spark.createDataFrame(rows, "id int, lang string, hyp string, ref string")
    got = {r["slice"]: r for r in metrics.score_report(df, "lang").collect()}
    assert set(got) == {"a", "b", "overall"} and got["overall"]["n"] == 6
    for r in got.values():
        assert r["total"] == pytest.approx(round(r["bleu"], 3) + round(r["rouge_l"], 3) + round(r["chrf"], 3), abs=2e-3)
    with pytest.raises(ValueError):
        metrics.zipped(df.select(F.col("id").alias("ordinal"), "hyp"), df.limit(2).select(F.col("id").alias("ordinal"), "ref"))


def test_gates_pass_on_sound_texts(spark):
    refs = [(i, i, " ".join(f"w{(i * 37 + k * k) % 101}{k}" for k in range(20))) for i in range(12)]
    rows = spark.createDataFrame(refs, "ordinal int, id int, ref string")
    every = gates.metric_gates(rows).unionByName(gates.skipped(spark, "neural", "no model"))
    assert {r["status"]: r["n"] for r in gates.totals(every).collect()} == {"PASS": 4, "SKIP": 1}
    assert not gates.failed(every).first()["failed"]


def greedy(sizes, most):
    out, n, widest, batch = [], 0, 0, 0
    for s in sorted(sizes):
        if n and max(widest, s) * (n + 1) > most:
            batch, n, widest = batch + 1, 0, 0
        n, widest = n + 1, max(widest, s)
        out.append(batch)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 60))
def test_packing_plan_is_the_greedy_one(sizes, most):
    got, at = [], 0
    for size, before, batch, room, cap in packing.plan_sizes(list(Counter(sizes).items()), most):
        n = sizes.count(size)
        assert before == at
        got += [batch if k < room else batch + 1 + (k - room) // cap for k in range(n)]
        at += n
    assert got == greedy(sizes, most)


def test_packing(spark):
    rows = spark.createDataFrame([(i, [1] * n) for i, n in enumerate([3, 4, 5, 9, 2])], "ordinal int, ids array<int>")
    got = {r["ordinal"]: r["batch"] for r in packing.token_batches(rows, F.size("ids"), "ordinal", 10).collect()}
    assert got == {4: 0, 0: 0, 1: 1, 2: 1, 3: 2}
    padded = packing.collated(packing.length_batches(rows, F.size("ids"), "ordinal", 2), "batch", "ids", "ordinal").orderBy("batch").collect()
    assert [r["width"] for r in padded] == [3, 5, 9] and padded[0]["padded"] == [[1, 1, 1], [1, 1, 0]]
    empty = rows.where("false")
    assert packing.token_batches(empty, F.size("ids"), "ordinal", 10).count() == 0


def test_ordering(spark):
    df = spark.createDataFrame([(i,) for i in random.Random(2).sample(range(1000), 300)], "k int")
    got = [(r["k"], r["rank"]) for r in ordering.global_rank(df, [F.col("k")]).orderBy("k").collect()]
    assert [r for _, r in got] == list(range(300))
    a, b = (sorted(r["k"] for r in ordering.seeded_sample(df, "k", 20, 5).collect()) for _ in range(2))
    assert a == b and len(a) == 20
    held, rest = ordering.holdout_split(df, "k", 50, 1)
    assert held.count() == 50 and rest.count() == 250


def test_training(spark):
    h = spark.createDataFrame([("r", i, x) for i, x in enumerate([5.0, 4.0, 4.5, 4.0, 3.0, 9.0])], "run string, step int, loss double")
    got = [(r["bad"], r["stop"]) for r in training.patience(h, "run", "step", "loss", 2).orderBy("step").collect()]
    assert got == [(0, False), (0, False), (1, False), (2, True), (0, False), (1, False)]
    p = spark.createDataFrame([("w", [1.0, 2.0]), ("w", [3.0, 6.0])], "name string, v array<double>")
    assert training.average_checkpoints(p, "name", "v").first()["v"] == [2.0, 4.0]
    c = spark.createDataFrame([(f"s/step_{n}.pt",) for n in (9, 100, 20)], "path string")
    assert [r["step"] for r in training.latest_checkpoints(c, "path", 2).collect()] == [100, 20]
    out = training.translated(c, lambda it: (b.assign(path=b.path.str.upper()) for b in it), "path string")
    assert {r["path"] for r in out.collect()} == {"S/STEP_9.PT", "S/STEP_100.PT", "S/STEP_20.PT"}


def test_word_vectors(spark):
    rows = spark.createDataFrame([(["a", "b", "c"] * 5,)], "w array<string>")
    assert training.word_vectors(rows, "w", size=4, epochs=1).getVectors().count() == 3


def test_written_tables_can_be_cleared(spark):
    df = ordering.written(spark.range(3))
    assert df.count() == 3
    ordering.clear_written(spark)
    with pytest.raises(Exception):
        df.collect()


def test_gram_counts_match_counters(spark):
    texts = ["aab", None, "", " é\u3000", "x" * 5, "\U0001F600z", "ab ba"]
    rows = [(t, l) for t in texts for l in ("en", None)]
    got = {(r["cls"], r["gram"]): r["n"] for r in langid.gram_counts(spark.createDataFrame(rows, "t string, l string"), "t", "l").collect()}
    want = Counter((l, g[i : i + n]) for t, l in rows if t is not None for g in [f" {t.strip()} "] for n in (1, 2, 3) for i in range(len(g) - n + 1))
    assert got == want
    assert langid.gram_counts(spark.createDataFrame([], "t string, l string"), "t", "l").count() == 0


def test_commonest_grams_with_ties(spark):
    counts = spark.createDataFrame([("a", g, n) for g, n in zip("hgfedcba", [5, 5, 4, 3, 3, 3, 3, 1], strict=True)] + [("b", "x", 1)], "cls string, gram string, n long")
    got = sorted((r["cls"], r["gram"]) for r in langid._commonest(counts, 5).collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "f"), ("a", "g"), ("a", "h"), ("b", "x")]


def test_bounded_samples_do_not_depend_on_the_cut(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b", "t" if i % 3 else "") for i in range(4000)], "k long, l string, t string")
    draw = lambda k: __import__("hashlib").md5(f"5:{k}".encode()).hexdigest()
    want = {k for c in ("a", "b") for k in sorted((i for i in range(4000) if (i % 10 > 0) == (c == "a")), key=draw)[:50] if k % 3}
    assert {r["k"] for r in langid.bounded_samples(rows, "k", "l", "t", 50, 5).collect()} == want


def test_language_model_as_json(spark, tmp_path):
    data = [('a"b', "en"), ("abc \n abc", "en"), ("xyz", "hi")]
    model = langid.fit(spark.createDataFrame(data, "t string, l string"), "t", "l", ["en", "hi"])
    langid.save_json(model, str(tmp_path / "m"))
    back = langid.load_json(spark, str(tmp_path / "m"), ["en", "hi"])
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(back.grams) == rows(model.grams) and rows(back.classes) == rows(model.classes)


def test_pairs_across_partitions(spark):
    roles = ["user", "assistant", "user", "user", "assistant", "assistant", "user"]
    data = [(c, t, r, f"{c}-{t}") for c in (1, 2) for t, r in enumerate(roles)] + [(None, 0, "user", "n"), (None, 1, "assistant", "m")]
    got = {(r["conv_id"], r["turn"], r["src"], r["tgt"]) for r in corpus.pairs_of(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert got == {(c, t, f"{c}-{t}", f"{c}-{t + 1}") for c in (1, 2) for t in (0, 3)} | {(None, 0, "n", "m")}


def test_preparation_keeps_counters_conserved(spark):
    from weftline.operators import preparation

    long = "a sentence with some words"
    data = [("train", 1, "x one", long), ("train", 2, "x one", long), ("train", 3, "seen", long), ("dev", 4, "seen", long), ("dev", 5, "seen", long), ("train", 6, None, long), ("train", 7, "same", "same")]
    rows = preparation.prepared(spark.createDataFrame([("en", *x) for x in data], "lang string, split string, ordinal long, src string, tgt string"))
    assert {r["ordinal"]: r["reason"] for r in rows.collect()} == {1: None, 2: "duplicate", 3: "leaked_into_eval", 4: None, 5: None, 6: "empty_field", 7: "src_equals_tgt"}
    counters = filters.report(rows.withColumn("file", F.col("split")), "file")
    n = {(r["file"], r["counter"]): r["n"] for r in counters.collect()}
    assert n["train", "read"] == sum(v for (f, c), v in n.items() if f == "train" and (c == "kept" or c.startswith("dropped_")))
    coverage = spark.createDataFrame([("s", 4, 1, 25.0)], "section string, records long, hits long, pct double")
    import json

    report = json.loads(preparation.report_json(counters, coverage).first()["value"])
    assert report["per_file"]["train"]["dropped_duplicate"] == 1 and report["val_tm_coverage"] == {"s": {"records": 4, "tm_hits": 1, "pct": 25.0}}
    assert report["config"]["min_script_ratio"] == 0.5
    assert preparation.prepared(spark.createDataFrame([], "lang string, split string, ordinal long, src string, tgt string")).count() == 0


def test_gates_can_fail(spark):
    rows = spark.createDataFrame([("a", "a", [4, 9, 3]), ("b", "c", [4, 1, 5, 3])], "t string, b string, ids array<int>")
    status = lambda df: df.first()["status"]
    assert status(gates.roundtrip_gate(rows, "t", "b")) == "FAIL" and status(gates.roundtrip_gate(rows.limit(1), "t", "b")) == "PASS"
    assert status(gates.ids_gate(rows, "ids", [4, 5], [0, 2], 3)) == "FAIL" and status(gates.ids_gate(rows.where("t = 'a'"), "ids", [4, 5], [0, 2], 3)) == "PASS"
    assert status(gates.unknown_gate(rows, "ids", "u")) == "FAIL" and status(gates.unknown_gate(rows.where("t = 'a'"), "ids", "u")) == "PASS"
    assert status(gates.vocabulary_gate(spark, 5, 6)) == "FAIL"
    assert status(gates.text_gate(spark.createDataFrame([("a",), (" ",)], "t string"), "t")) == "FAIL"


def test_submission_wants_every_id_once(spark):
    items = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, src string")
    memory = spark.createDataFrame([("a", "from memory")], "src string, tgt string")
    hyps = spark.createDataFrame([("2", " from  model ")], "id string, hyp string")
    got = {r["id"]: (r["text"], r["origin"]) for r in corpus.submission(items, memory, hyps, ["src"], "id").collect()}
    assert got == {"1": ("from memory", "memory"), "2": ("from model", "hypothesis"), "3": ("", "missing")}
    with pytest.raises(ValueError, match="extra 2"):
        corpus.submission(items, memory, hyps.union(hyps), ["src"], "id")


def test_word_ids_round_trip(spark):
    rows = spark.createDataFrame([("b a b",), ("c",), (None,)], "t string").withColumn("w", F.split("t", " "))
    known = training.vocabulary(rows, F.col("w"), 2)
    assert known == ["b", "a"]
    ids = rows.select(training.word_encoder(known, 6)("w").alias("ids"))
    assert [r["ids"] for r in ids.collect()] == [[6, 7, 6], [1], None]
    assert [r[0] for r in ids.select(training.word_decoder(known, 6)(F.col("ids"))).collect()] == ["b a b", "<unk>", None]


def test_epochs_differ_and_cover_all(spark):
    rows = spark.range(100).select(F.col("id").alias("o"), (F.col("id") % 7).alias("n"))
    got = [tuple(r) for r in packing.epochs(rows, F.col("n"), "o", 8, seed=3, n_epochs=2, noise=3).select("epoch", "place", "o").collect()]
    by = [sorted((p, o) for e, p, o in got if e == k) for k in (0, 1)]
    assert by[0] != by[1] and all(sorted(o for _, o in x) == list(range(100)) and {p for p, _ in x} == set(range(13)) for x in by)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ordering.shared_dir(Session())
