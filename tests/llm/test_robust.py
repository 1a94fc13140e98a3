"""What every operator must stand: nulls in any column, empty and very long texts, ties, repeats, empty tables, clashing names."""

import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, licenses, lines, minhash, mixing, quality, resampling, simhash, substrings, toxicity, weak

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["a.b", "__id", "__bad", "bad", "row", "mix_note", "k", "t", "h", "n", "x", "at", "node", "root", "own_id", "own_t", "s", "draw", "cuts", "pos", "seed", "ids", "`q`"]
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and a text of 20 MB."""
    rng = random.Random(1)
    plain = "This is a fine text of some words, and it says nothing twice. It was licensed under the MIT License by them."
    long = " ".join(f"w{rng.randrange(200_000)}" + ("\n" if i % 40 == 39 else "") for i in range(2_900_000))
    assert len(long) > 19_000_000
    rows = [
        (1, plain, "en", "a", 5), (1, plain, "en", "a", 5), (2, plain, None, None, None), (None, plain, "en", "a", 1), (3, None, "en", "b", None), (4, "", "en", "b", 0),
        (None, None, None, None, None), (5, " \n\t ", "de", "", 4), (6, "one", "en", "b", 3), ((1 << 63) - 1, "one two\nthree", "en", "c", 13), (7, long, "en", "a", len(long)), (8, long, "en", "d", len(long)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    return wide.cache(), len(rows)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "fine text of some words and it says nothing twice it was licensed under the MIT"), (2, None), (None, "one"), (2, "")], BENCH)


CASES = {
    "simhash_radius": lambda s, d: (simhash.near_duplicates(d), len),
    "simhash_similar": lambda s, d: (simhash.near_duplicates(d, simhash.Similar()), len),
    "mixing": lambda s, d: (mixing.mix_sources(d), len),
    "weak": lambda s, d: (weak.weak_quality(d), len),
    "lines": lambda s, d: (lines.dedup_lines(d), len),
    "toxicity": lambda s, d: (toxicity.toxicity(d, toxicity.toxicity_model(d, labels(s))), len),
    "quality": lambda s, d: (quality.quality_rules(d, quality.quality_model(d, labels(s))), len),
    "substrings": lambda s, d: (substrings.remove_repeats(d), len),
    "minhash": lambda s, d: (minhash.near_duplicates(d), len),
    "resampling": lambda s, d: (resampling.resample(d, benchmark(s)), len),
    "resampling_pairs": lambda s, d: (resampling.resample(d, benchmark(s), resampling.Rule(1, 2)), len),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_a_row_for_each_row(spark, odd, name):
    df, n = odd
    out, _ = CASES[name](spark, df)
    assert out.count() == n
    empty, _ = CASES[name](spark, df.where("false"))
    assert empty.count() == 0 and empty.columns == out.columns


def test_stages_keep_columns(spark, odd):
    df, n = odd
    model = quality.quality_model(df, labels(spark))
    assert quality.keep_good(df, model).columns == df.columns
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # Copies are one, whatever their ids; texts without words are one group too.
    assert sorted(kept.toPandas()["doc_id"].dropna().astype(int)) == [1, 3, 6, 7, (1 << 63) - 1] or kept.count() == 5
    clean = decontaminate.clean_documents(df, benchmark(spark))
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.select("doc_id").collect()} == {3, 4, 5, 6, 7, 8, (1 << 63) - 1}
    cut = lines.dedup_lines(df)
    assert [c for c in cut.columns if c != "lines_removed"] == df.columns
    gone = {r["doc_id"]: (r["lines_removed"], r["m"]) for r in cut.select("doc_id", "lines_removed", F.length("text").alias("m")).collect()}
    assert gone[7][0] == 0 and gone[8][1] <= 1 and gone[8][0] > 70_000
    mixed = mixing.mix_sources(df)
    assert [c for c in mixed.columns if c not in mixing.ADDED] == df.columns
    assert licenses.scan(df, licenses.train(df)).where("family = 'mit'").count() == 4


def test_real_greatest_id_is_not_null(spark, odd):
    out = substrings.remove_repeats(odd[0]).collect()
    assert sum(r["doc_id"] is None for r in out) == 2 and sum(r["doc_id"] == (1 << 63) - 1 for r in out) == 1


# -- scores in plain arithmetic

M = (1 << 32) - 1
TEXTS = ["", "a", "you utter scum of a day", "Schöne Wörter und mehr davon, und mehr davon!", "x y z " * 50, "# $ %% |"]


def plain_bucket(x, bits):
    return (x * 0x9E3779B1 & M) >> (32 - bits)


def plain_probability(model, text):
    words = text.split()
    h = [crc32(w) for w in words]
    word = [plain_bucket(x, 15) for x in h] + [plain_bucket((a * 0x85EBCA6B & M) ^ b, 15) for a, b in zip(h, h[1:], strict=False)]
    three = [a << 16 | b << 8 | c for a, b, c in zip(text, text[1:], text[2:], strict=False)]
    char = [plain_bucket(x + 7 & M, 15) for x in three] + [plain_bucket((x << 8 | d) & M, 15) for x, d in zip(three, text[3:], strict=False)]
    a, s = (float(x) for x in model["scale"])
    for k, at in enumerate((word, char)):
        if at:
            s += a * sum(float(model["w"][(k << 15) + i]) for i in at) / len(at)
    return 1 / (1 + math.exp(-max(-35, min(35, s))))


def plain_toxicity(model, text):
    table = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))
    words = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in text.lower()).split()
    h = [crc32(w) for w in words]
    first = [x * 0x85EBCA6B & M for x in h]
    every = h + [(a ^ b) + 1 & M for a, b in zip(first, h[1:], strict=False)] + [(a ^ b) + 2 & M for a, b in zip(first, h[2:], strict=False)]
    for k in (4, 5):
        every += [(crc32(w[:k]) * 0xC2B2AE35 & M) + k & M for w in words]
    s = float(model["bias"][0]) + sum(table.get(i, 0.0) for i in {plain_bucket(x, 20) for x in every})
    return 1 / (1 + math.exp(-max(-35, min(35, s))))


@pytest.fixture(scope="module")
def models(spark, small):
    docs, given = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    return docs, quality.quality_model(docs, given), toxicity.toxicity_model(docs, given)


def test_quality_scores_in_plain_arithmetic(spark, models):
    docs, model, _ = models
    got = {r["doc_id"]: r["quality"] for r in quality.quality_rules(docs, model).collect()}
    for r in docs.limit(60).collect():
        assert got[r["doc_id"]] == pytest.approx(plain_probability(model, r["text"].encode()), abs=1e-6)
    for t in TEXTS:
        assert quality.probability(model, t.encode()) == pytest.approx(plain_probability(model, t.encode()), abs=1e-6)


def test_toxicity_scores_in_plain_arithmetic(spark, models):
    docs, _, model = models
    df = docs.select("doc_id", "text").limit(60).union(spark.createDataFrame([(-k, t) for k, t in enumerate(TEXTS, 1)], "doc_id long, text string")).cache()
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, model).collect()}
    for r in df.collect():
        want = plain_toxicity(model, r["text"].encode())
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-6) and got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.5)


def plain_em(votes, rounds=200):
    """The same model over single documents, in loops."""
    n, m = len(votes), len(votes[0])
    p = [min(0.95, max(0.05, 0.5 + 0.25 * sum(v))) for v in votes]
    for _ in range(rounds):
        prior = min(1 - 1e-6, max(1e-6, sum(p) / n))
        rate = [[[0.5] * 3 for _ in range(m)] for _ in range(2)]
        for v, q in zip(votes, p, strict=True):
            for k, x in enumerate(v):
                rate[0][k][x + 1] += q
                rate[1][k][x + 1] += 1 - q
        new = []
        for v in votes:
            odds = math.log(prior / (1 - prior))
            for k, x in enumerate(v):
                odds += math.log(rate[0][k][x + 1] / sum(rate[0][k])) - math.log(rate[1][k][x + 1] / sum(rate[1][k]))
            new.append(1 / (1 + math.exp(-max(-35, min(35, odds)))))
        done = max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9
        p = new
        if done:
            break
    return p


def test_weak_labels_in_plain_loops(spark, models):
    docs = models[0]
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain_em([weak.votes(r["text"].encode()) for r in rows]), strict=True))
    got = {r["doc_id"]: r["posterior"] for r in weak.weak_labels(docs).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_votes_of_plain_cases():
    good = "The house was big and it had a garden by the sea. They went down the road and came back in the evening, tired but happy, for it was late. "
    good += "Nobody had seen the old man since spring, so a letter from him was good news. It said that he would come with the next ship and stay."
    v = weak.votes(good.encode())
    assert v[0] == 1 and min(v) >= 0
    assert weak.votes(b"")[0] == -1
    assert weak.votes(b"## $$ %% || ## $$ %% ||")[1] == -1
    assert weak.votes(b"LOUD WORDS ALL THE TIME HERE NOW")[2] == -1
    assert weak.votes(b"a b c " * 40)[3] == -1
    assert weak.votes(b"same line here\n" * 10)[4] == -1


def test_weak_scores_in_plain_arithmetic(spark, models, monkeypatch):
    docs = models[0]
    seen = {}
    train = weak.labelled.train

    def kept(*a):
        seen["model"] = train(*a)
        return seen["model"]

    monkeypatch.setattr(weak.labelled, "train", kept)
    got = {r["doc_id"]: r for r in weak.weak_quality(docs).collect()}
    for r in docs.limit(60).collect():
        want = plain_probability(seen["model"], r["text"].encode())
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-6) and got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] >= 0.5)


# -- plans of large inputs


def test_large_plans_give_the_same(spark, small, monkeypatch):
    """What a big corpus takes: nothing broadcast, hot keys told apart, buckets cut again."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    same = lambda df: sorted(map(str, df.collect()))
    jobs = {
        "mixing": lambda: mixing.mix_sources(docs, carry=["doc_id"]), "substrings": lambda: substrings.remove_repeats(docs),
        "lines": lambda: lines.dedup_lines(docs), "keep_one": lambda: simhash.keep_one(docs),
    }
    before = {k: same(f()) for k, f in jobs.items()}
    for module, name, value in (
        (mixing, "FEW_SOURCES", -1), (mixing, "FEW_ROWS", 2), (mixing, "DIGITS", 1), (substrings, "FEW_IDS", -1), (substrings, "PART_CHARS", 20_000), (lines, "FEW_KEYS", -1), (lines, "HOT", 20), (simhash, "FEW_KEYS", -1),
    ):
        monkeypatch.setattr(module, name, value)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert before == {k: same(f()) for k, f in jobs.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_least_draws_do_not_depend_on_the_cut(spark):
    from weftline.llm.common import draw_key, least_draws

    rows = spark.range(5000).select("id", draw_key(3, F.col("id")).alias("draw"))
    want = sorted(r["draw"] for r in rows.collect())[:40]
    assert sorted(r["draw"] for r in least_draws(rows, 40).collect()) == want
    assert least_draws(rows, 9000).count() == 5000 and least_draws(rows.where("false"), 5).count() == 0


def test_wide_fingerprint_in_plain_bits():
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 1 << 64, 700, dtype=np.uint64))
    got = simhash.wide_fingerprint(s, 3)
    for lane in range(3):
        hashes = [int(simhash._mixed(np.array([int(x) + (lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]) for x in s]
        assert int(got[lane]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(s))


def test_training_and_filter_work_on_few_rows_at_a_time(spark, monkeypatch):
    """Neither features nor kept rows of a whole batch are held at once; the model and the rows stay what they are."""
    from weftline.llm import labelled, quality

    text = F.concat(F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" and some ")), 30), F.when(F.col("id") % 2 == 0, "good prose").otherwise("spam spam"))
    docs = spark.range(600).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    want = quality.quality_model(docs, labels)
    kept = sorted(r["doc_id"] for r in quality.keep_good(docs, want, max_repeat_percent=100).collect())
    read = labelled.texts

    def few(column):
        assert len(column) <= 200, "a whole batch at once"
        return read(column)

    monkeypatch.setattr(labelled, "texts", few)
    monkeypatch.setattr(quality, "texts", few)
    model = quality.quality_model(docs, labels)
    assert all(np.array_equal(model[k], want[k]) for k in want)
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, model, max_repeat_percent=100).collect()) == kept
