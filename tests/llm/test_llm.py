"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import same_rows
from weftline.llm import chat, components, confirm, decontaminate, licenses, lines, mixing, quality, registry, simhash, substrings, toxicity, weak

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in GAP.split(t or "") if w]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(table):
    return sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())


ODD = [None, "", " \n\t ", "a", "a b c", "word " * 400, "x\x1cy  z", "Ünïcode wörds hére", "same text here now", "same text here now"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, small, duck):
    same_rows(registry.QUERIES[name](spark, small), duck, registry.ORACLES[name])


# -- near-duplicates


def fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark, small, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op1_simhash"](spark, small).collect()}
    fps = [fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)}


def test_simhash_edges(spark):
    df = docs_of(spark, ODD + ["nobody"], [None, 5, 4, 3, 3, None, 8, 9, 12, 11, None]).withColumns({"fp": F.lit("x"), "root": F.lit(1)})
    got = [(r["doc_id"], r["node"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    ids = [None, 5, 4, 3, 3, None, 8, 9, 12, 11, None]
    fps = [fingerprint(t) for t in ODD + ["nobody"]]
    want = brute_components(ids, fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert sorted(map(str, got)) == sorted(map(str, zip(ids, signed, want, strict=True)))
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = simhash.keep_one(df, simhash.Radius())
    # Two rows with id 3 are in different groups, as are two with no id.
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["11", "3", "3", "4", "8", "9", "None", "None"]
    twice = simhash.keep_one(df.union(df), simhash.Radius())
    assert twice.count() == 8


def classes(pairs):
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for x, y in pairs:
        root[max(find(x), find(y))] = min(find(x), find(y))
    return {frozenset(k for k in root | {x: 0 for p in pairs for x in p} if find(k) == r) for r in {find(x) for p in pairs for x in p}}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 1500), st.integers(0, 1500))
def test_forest_joins_what_links_join(seed, n, m):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    make = lambda k: np.unique(base[rng.integers(0, 40, k)] ^ (np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)))
    order = lambda x: x[np.lexsort((x, *simhash.quarters(x).T[::-1]))]
    a, b = order(make(n)), order(make(m))
    tile = lambda x: simhash.Tile(x.view(np.int64), np.zeros(len(x), np.int32), x.reshape(-1, 1))
    (u, v, d), (_, _, left) = simhash.forest(tile(a), tile(b), simhash.Radius(), False)
    assert not len(left)
    assert (d == -1).all()
    brute = [(int(x), int(y)) for x in a for y in b[np.bitwise_count(b ^ x) <= 4] if x != y]
    got = [(int(x), int(y)) for x, y in zip(u.view(np.uint64), v.view(np.uint64), strict=True) if x != y]
    assert classes(got) == classes(brute)


def test_lightest_is_a_minimum_spanning_forest():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = rng.integers(1, 30), rng.integers(0, 80)
        u, v, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m).astype(np.int32)
        got = confirm.lightest(np.arange(n), u, v, d)
        root, cost = list(range(n)), 0
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        for w, x, y in sorted(zip(d.tolist(), u.tolist(), v.tolist(), strict=True)):
            if find(x) != find(y):
                root[find(x)] = find(y)
                cost += w
        assert got[2].sum() == cost and len(got[0]) == n - len({find(x) for x in range(n)})


def shingle_set(t):
    w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_copies(n=80, seed=1):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 6) for _ in range(rng.randint(12, 150))] for _ in range(15)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        out.append(rng.choice([" ", "\n"]).join(w))
    return out


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_similar_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "PART", min(tile, simhash.PART))
    texts = [*near_copies(), None, "", " \n", "one two", "One Two"]
    ids = [None if i % 17 == 5 else i for i in range(len(texts))]
    df = docs_of(spark, texts, ids)
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for x, y in pairs:
        root[find(x)] = find(y)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    want = {min(g, key=lambda i: (ids[i] is None, i)) for g in groups.values() if any(ids[i] is not None for i in g)}
    kept = simhash.keep_one(df)
    got = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and got - {None} == want and kept.count() == len(groups) < len(texts)
    assert simhash.keep_one(df.union(df)).count() == len(groups)
    assert simhash.keep_one(df.where("false")).count() == 0


@pytest.mark.parametrize("rule", [simhash.Radius(), simhash.Similar()])
def test_links_do_not_depend_on_tiles(spark, table, rows, monkeypatch, rule):
    before = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table, rule).collect()}
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "PART", 4)
    monkeypatch.setattr(simhash, "FEW_KEYS", -1)
    monkeypatch.setattr(confirm, "FEW_KEYS", -1)
    monkeypatch.setattr(components, "FEW_KEYS", -1)
    assert before == {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table, rule).collect()}
    kept = {r["doc_id"] for r in simhash.keep_one(table, rule).collect()}
    assert kept == set(before.values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(200, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 260)], 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- mixing


def test_mix_edges(spark):
    df = docs_of(spark, ODD * 3, [None, *range(29)]).withColumns({"size": F.lit("x"), "mix_size": F.lit(9), "row": F.lit(1)})
    got = mixing.mix_sources(df)
    out = got.collect()
    assert len(out) == 30 and got.columns.count("mix_size") == 1 and "row" in got.columns
    for r in out:
        assert r["mix_size"] == len(words(r["text"])) and r["mix_taken"] == r["mix_copies"] * r["mix_size"] and 0 <= r["mix_copies"] <= 2
        assert r["mix_target"] <= 2 * r["mix_source_size"]
    targets = {r["source"]: r["mix_target"] for r in out}
    total = sum(r["mix_size"] for r in out)
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert mixing.mix_sources(df.where("false")).count() == 0
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))
    blank = mixing.mix_sources(docs_of(spark, ["", None])).collect()
    assert [r["mix_target"] for r in blank] == [0.0, 0.0]


def test_mix_hot_source_comes_near_its_target(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 90), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(3000)], SCHEMA)
    by = mixing.mix_sources(df, carry=["doc_id", "source"]).groupBy("source").agg(F.sum("mix_taken").alias("t"), F.first("mix_target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 90 for r in by)


# -- quality and toxicity


def brute_counts(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #é\n\t\x1c ", max_size=60))
def test_rule_counts(text):
    assert tuple(quality.rule_counts(text.encode())) == brute_counts(text)


def test_quality_rules_on_table_and_edges(spark, small, rows, duck):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_quality_rules"](spark, small).collect()}
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    right = 0
    for i, t in rows:
        r = got[i]
        want = brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
        right += i in labels and (r["quality"] >= 0.5) == (labels[i] == 1)
    assert right >= 0.9 * len(labels)
    model = quality.quality_model(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int"))
    odd = docs_of(spark, ODD, [None, 1, 1, *range(7)])
    assert quality.quality_rules(odd, model).count() == 10 and quality.quality_rules(odd.where("false"), model).count() == 0
    assert quality.keep_good(odd.withColumn("kept", F.lit("x")), model).count() == 0


def test_platt_is_calibrated():
    rng = np.random.default_rng(1)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * s - 1)))).astype(float)
    a, b = quality.platt(s, y)
    assert a == pytest.approx(2, abs=0.25) and b == pytest.approx(-1, abs=0.2)


def test_toxicity_held_out(spark):
    if not __import__("os").path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    sf = "/root/testdata/sf0.1"
    out = registry.QUERIES["op7_toxicity"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out.merge(labels, on="doc_id").query("held_out")
    assert ((held.score >= 0.5) == held.predicted).all() and out.score.between(0, 1).all()
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.toxic == 0].predicted.mean() < 0.02


def test_toxicity_edges(spark):
    texts = ["you scum of a day"] * 30 + ["a fine day for all"] * 60
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] + [(3, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.toxicity_model(df, labels)
    again = toxicity.toxicity_model(df.repartition(5), labels)
    assert all(np.array_equal(model[k], again[k]) for k in model)
    odd = docs_of(spark, [*ODD, "utter scum", "SCUM!!"], [None, 1, 1, *range(9)])
    got = {r["doc_id"]: r for r in toxicity.toxicity(odd, model).collect()}
    assert got[7]["predicted"] == 1 and got[8]["predicted"] == 1 and got[2]["predicted"] == 0
    assert toxicity.toxicity(odd.where("false"), model).count() == 0
    none = toxicity.toxicity_model(df, labels.where("false"))
    assert toxicity.toxicity(odd, none).where("score <> 0.5").count() == 0


def test_weak_labels(spark, small, rows):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_weak_quality"](spark, small).collect()}
    assert len(got) == len(rows) and sum(got[i]["kept"] == (q == 1) for i, q in labels.items()) >= 0.85 * len(labels)
    assert sum(got[i]["kept"] for i, q in labels.items() if q == 1) >= 0.9 * sum(labels.values())
    odd = docs_of(spark, ODD, [None, 1, 1, *range(7)]).withColumn("pattern", F.lit("x"))
    assert weak.weak_quality(odd).count() == 10 and weak.weak_quality(odd.where("false")).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    v = np.array([[1 if (t if rng.random() < 0.85 else not t) else -1 for _ in range(weak.LABELLERS)] for t in truth[:3000]])
    codes = ((v + 1) * 3 ** np.arange(weak.LABELLERS)).sum(axis=1)
    patterns, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    p = weak.posteriors(patterns, counts)[back]
    assert ((p >= 0.5) == truth[:3000]).mean() > 0.97


# -- lines, substrings, benchmark


def brute_lines(rows, run=3, passage=50):
    seen, out = set(), []
    for _, t in rows:
        all_lines = (t or "").split("\n")
        at = [i for i, x in enumerate(all_lines) if words(x)]
        dead = set()
        for p in range(len(at)):
            for n in range(1, run + 1):
                key = tuple(all_lines[i] for i in at[p : p + n])
                if len(key) < n or (n < run and sum(len(words(x)) for x in key) < passage):
                    continue
                if key in seen:
                    dead |= set(range(at[p], at[p + n - 1] + 1))
                seen.add(key)
        out.append(None if t is None else "\n".join(x for i, x in enumerate(all_lines) if i not in dead))
    return out


def lines_with_words(t):
    return sum(bool(words(x)) for x in (t or "").split("\n"))


@pytest.mark.parametrize("few", [lines.FEW_KEYS, -1])
def test_lines_match_brute_force_on_dense_repeats(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW_KEYS", few)
    monkeypatch.setattr(lines, "HOT", 50)
    rng = random.Random(5)
    long = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((1, 10, 24, 25, 26, 49, 50, 51, 90))]
    texts = [None, "", "\n\n", *("\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randint(0, 25))) for _ in range(60))]
    texts += ["\n".join(rng.choice([*long, "", "z"]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = docs_of(spark, texts).withColumns({"lines_removed": F.lit("x"), "at": F.lit(1), "cuts": F.lit("y"), "a.b": F.lit(2)})
    want = brute_lines(list(enumerate(texts)))
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.dedup_lines(df).collect()}
    assert [got[i][0] for i in range(len(texts))] == want
    assert [got[i][1] for i in range(len(texts))] == [lines_with_words(a) - lines_with_words(b) for a, b in zip(texts, want, strict=True)]
    assert lines.dedup_lines(df.where("false")).count() == 0
    odd = docs_of(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc", "x\na\nb\nc", "a\nb\nc"], [None, 4, 4, 2, (1 << 63) - 1])
    out = sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup_lines(odd).collect())
    assert out == [("2", "x\na\nb\nc"), ("4", ""), ("4", ""), (str((1 << 63) - 1), ""), ("None", "")]


def test_one_long_line_goes(spark):
    line = " ".join(f"w{i}" for i in range(60))
    out = lines.dedup_lines(docs_of(spark, [line, "own\n" + line])).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {0: line, 1: "own"}


def brute_substrings(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        dead = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        kept = [x for k, x in enumerate(w) if k not in dead]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def substrings_of(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect()}


def test_substrings_match_brute_force(spark, table, rows):
    assert substrings_of(table) == brute_substrings(rows)
    rng = random.Random(8)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 80, 130))]
    texts = []
    for _ in range(80):
        w = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.random()) for _ in range(rng.randint(0, 40))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 40)
            w += p[cut:] if rng.random() < 0.4 else p
            w += [str(rng.random())] * rng.randint(0, 2)
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += ["same " * 300, "same " * 120, None, ""]
    data = list(enumerate(texts))
    assert substrings_of(docs_of(spark, texts)) == brute_substrings(data)


def test_substring_edges(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = docs_of(spark, [t, t, t, t + " x", None], [None, 7, 7, 9, None]).withColumns({"k": F.lit(1), "hashes": F.lit("x")})
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [("7", 60, 0), ("7", 60, 0), ("9", 61, 60), ("None", 0, 0), ("None", 60, 60)]
    assert substrings.remove_repeats(df.where("false")).count() == 0


def test_cover_meets_every_shift():
    d = set(substrings.COVER)
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + s) % substrings.PERIOD in d and (j + s) % substrings.PERIOD in d for s in range(substrings.PERIOD))


def test_masks_hit_every_allowed_placement():
    from itertools import combinations

    for size in range(1, decontaminate.STRETCH + 1):
        spots = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.masks_of(size)]
        wrong = size - math.ceil(size * decontaminate.SHARE - 1e-9)
        for bad in combinations(range(size), wrong):
            assert any(not set(bad) & {s + x for x in m} for m in spots for s in range(size - max(m))), (size, bad)


TOKEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_overlap(doc, item, stretch=16):
    """By definition, whatever the seeds."""
    a, b = ([w for w in TOKEN.split((t or "").lower()) if w] for t in (item, doc))
    win = min(stretch, len(a), len(b))
    need = math.ceil(win * decontaminate.SHARE - 1e-9)
    for diag in range(-len(a), len(b)) if win else ():
        eq = [0 <= diag + i < len(b) and a[i] == b[diag + i] for i in range(len(a))]
        for s in range(len(a) - win + 1):
            if 0 <= diag + s and diag + s + win <= len(b) and sum(eq[s : s + win]) >= need:
                return win
    return 0


@pytest.mark.parametrize("few", [decontaminate.FEW_SEEDS, -1])
def test_decontamination_matches_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", few)
    rng = random.Random(4)
    items = [(k, " ".join(f"t{k}x{i}" for i in range(n))) for k, n in enumerate((1, 2, 4, 5, 7, 8, 10, 11, 12, 15, 16, 30, 45))] + [(19, None), (19, ""), (None, "q " * 30)]
    texts = [None, "", "q " * 40, "t0x0"]
    for _ in range(160):
        w = [f"z{rng.random()}" for _ in range(rng.randint(0, 30))]
        _, item = rng.choice(items[:13])
        part = item.split()
        cut = rng.randint(0, len(part) // 2) if rng.random() < 0.3 else 0
        part = [x.upper() if rng.random() < 0.3 else x for x in part[cut:]]
        for _ in range(rng.randint(0, max(1, len(part) // 4))):
            part[rng.randrange(len(part))] = "sub"
        at = rng.randint(0, len(w))
        texts.append(rng.choice([" ", ", "]).join(w[:at] + part + w[at:]))
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 14, 15, 16, 17):
        # Short documents that lie inside an item, whole or with a word or two replaced, or hang over its end.
        for wrong in (0, 1, n // 5):
            part = items[rng.choice([10, 11, 12])][1].split()
            at = rng.randint(0, len(part) - 1)
            short = (part[at : at + n] + ["over"] * n)[:n]
            for _ in range(wrong):
                short[rng.randrange(n)] = "sub"
            texts.append(" ".join(short))
    bench = spark.createDataFrame(items * 2, "item_id long, text string")
    df = docs_of(spark, texts).withColumns({"h": F.lit(1), "item": F.lit("x"), "pos": F.lit(2), "bad": F.lit(3), "a.b": F.lit(4)})
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, x in items if brute_overlap(t, x)}
    assert got == want and len(want) > 60 and (2, None) in want and (3, 0) in want
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(texts) if all(brute_overlap(t, x) < decontaminate.LEAST_TOKENS for _, x in items)}
    assert {(r["item_id"], r["tokens"]) for r in decontaminate.too_short(bench).collect()} == {(0, 1), (1, 2), (2, 4), (3, 5), (4, 7), (19, 0)}
    assert decontaminate.overlaps(df.where("false"), bench).count() == 0 == decontaminate.overlaps(df, bench.where("false")).count()


@pytest.mark.parametrize("few", [decontaminate.FEW_SEEDS, -1])
def test_decontamination_of_long_texts(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", few)
    item = " ".join(f"d{i}" for i in range(19980, 20000))
    df = docs_of(spark, [" ".join(f"d{i}" for i in range(20000)), "q " * 20000])
    bench = spark.createDataFrame([(1, item), (2, "q " * 30)], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.overlaps(df, bench).collect()} == {(0, 1), (1, 2)}


# -- licences and chats


def lic_words(t):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}.]+|\.(?!\p{N})", t.lower()) if w]


def lic_grams(t):
    w = lic_words(t)
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def brute_license(model, weights, text):
    """Family, probability and template share of a line, or None."""
    if not set(lic_words(text)) & set(model.telling):
        return None
    z = np.array(model.intercepts)
    other = 0 if licenses._grants(" ".join(lic_words(text))) else sum(w not in model.known for w in lic_words(text))
    for g in lic_grams(text) | {m for n, m in licenses.OTHERS.items() if other >= n}:
        z = z + weights.get(g, 0)
    z = z / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = model.classes[int(p.argmax())]
    pairs = lambda x: {g for g in lic_grams(x) if " " in g}
    shares = [len(pairs(x) & lic_grams(text)) / len(pairs(x)) for x in licenses.PHRASES.get(family, ()) if pairs(x)]
    if family == "unknown" or p.max() < 0.5 or max(shares, default=0) < 0.6:
        return None
    return family, round(float(p.max()), 5), round(max(shares), 5)


def test_licenses(spark, table):
    model = licenses.train(table)
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nplain line\nAll rights reserved.", None, "", "free shipping to the public", "BSD 3-Clause License", "The mozilla browser"]
    texts += ["The public domain of mathematics is wide", "This library is free software day at school", "Not released under the MIT License, ask us first", "We never licensed it under the GPL"]
    df = docs_of(spark, texts, [0, 1, 2, 3, 4, None, 6, 7, 8, 9, 10]).withColumns({"row": F.lit(1), "gram": F.lit("x"), "family": F.lit("y"), "a.b": F.lit(1)})
    got = {(r["doc_id"], r["line"], r["family"]) for r in licenses.scan(df, model).collect()}
    assert got == {(0, 0, "mit"), (1, 0, "cc-by-nc"), (1, 2, "proprietary"), (None, 0, "bsd")}
    assert licenses.scan(df.union(df), model).count() == 8 and licenses.scan(df.where("false"), model).count() == 0
    weights = {r["gram"]: np.array(r["weights"]) for r in model.weights.collect()}
    # A line without a telling word has the intercepts alone, which say unknown.
    assert model.classes[int(np.argmax(model.intercepts))] == "unknown"
    found = {(r["doc_id"], r["line"]): (r["family"], round(r["probability"], 5), round(r["template_share"], 5)) for r in licenses.scan(table, model).collect()}
    want = {}
    for r in table.collect():
        for k, x in enumerate(r["text"].split("\n")):
            one = brute_license(model, weights, x)
            if one:
                want[r["doc_id"], k] = one
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 2e-5 and abs(found[k][2] - want[k][2]) < 2e-5 for k in want)
    told = re.compile("licen[cs]e|rights reserved", re.I)
    assert set(found) == {(r["doc_id"], k) for r in table.collect() for k, x in enumerate(r["text"].split("\n")) if told.search(x)}


def test_license_recall_and_precision(spark, table):
    """Phrases in notices, and names in sentences about them, that training has not seen."""
    model = licenses.train(table)
    notices, mentions = [], []
    for f, phrases in licenses.PHRASES.items():
        for p in phrases:
            before = ("please see that all of it is ", "copyright 2019 some company; ", "every file of the second edition, as told, is ") if licenses._grants(p) else ("", "license - ", "copyright 2020 acme. ")
            notices += [(f, b + p) for b in before]
            if not licenses._grants(p):
                mentions += [(f, m.format(p)) for m in (
                    "our seminar covered the {} for two hours", "the novel makes fun of the {} on every page", "a podcast explained the {} to its listeners",
                    "the committee rejected the {} as too complex", "the book compares the {} with the newer one",
                )]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices + mentions)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licenses.scan(df, model).collect()}
    for f in licenses.PHRASES:
        own = [i for i, (g, _) in enumerate(notices) if g == f]
        right, said = sum(got.get(i) == f for i in own), sum(g == f for i, g in got.items())
        assert right >= 0.95 * len(own) and right >= 0.95 * said, f


def test_perspectives_round_trip(spark):
    data = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "a\nb"), (1, 3, "cy", None), (1, 3, "cy", None), (2, None, None, "x"), (None, 0, "ann", "<\\|y|>"), (3, 0, "system", "alone"), (4, 1, 'e"<|', "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    for block in (2, 100):
        out = chat.perspectives(df.withColumn("block", F.lit("x")), block=block).orderBy("conv_id", "perspective", "block").collect()
        whole = {}
        for r in out:
            assert sum(x["n"] for x in r["mask"]) == len(r["text"]) and r["n_turns"] <= block
            at = 0
            for x in r["mask"]:
                if x["trained"]:
                    assert r["text"][:at].endswith("<|assistant|>\n") and r["text"][at : at + x["n"]].endswith("<|end|>")
                at += x["n"]
            whole[r["conv_id"], r["perspective"]] = whole.get((r["conv_id"], r["perspective"]), "") + r["text"]
        assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann"), (4, 'e"<|')}
        text = whole[1, "bob"]
        turns = re.findall(r"<\|(\w+)(?: name=\"([^\"]*)\")?\|>\n(.*?)<\|end\|>\n", text, re.S)
        assert [(a, b, re.sub(r"<\\(\\*)\|", r"<\1|", c)) for a, b, c in turns] == [
            ("system", "", "be kind"), ("user", "ann", "hi <|end|>"), ("assistant", "", "a\nb"), ("user", "cy", ""), ("user", "cy", "")
        ]
    assert chat.perspectives(df.where("false")).count() == 0


# -- pipeline


def test_pipeline_stages_match_brute_force(spark, small, table):
    import corpus_pipeline

    docs = table
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
        out = stage(spark, docs, small).cache()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert len(after) == out.count()
        if name != "mixing_sources":
            assert out.columns == table.columns
        if name == "quality_rules":
            failed = {i for i, t, _ in before for n, *_, r in [brute_counts(t)] if n < 50 or 100 * r > 50 * n}
            assert not failed & set(after) and len(after) >= 0.85 * (len(before) - len(failed))
        elif name == "line_dedup":
            assert [after[i] for i, *_ in before] == brute_lines([x[:2] for x in before])
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "simhash_near_dedup":
            ids = [i for i, *_ in before]
            sets = [shingle_set(t) for _, t, _ in before]
            root = list(range(len(ids)))
            find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
            for x in range(len(ids)):
                for y in range(x):
                    if min(len(sets[x]), len(sets[y])) * 5 >= 4 * max(len(sets[x]), len(sets[y])) and alike(sets[x], sets[y]):
                        root[max(find(x), find(y))] = min(find(x), find(y))
            assert set(after) == {ids[find(x)] for x in range(len(ids))}
        elif name == "benchmark_decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            tokens = [set(TOKEN.split(x.lower())) for x in items]
            near = {i for i, t, _ in before for x, s in zip(items, tokens, strict=True) if len(s & set(TOKEN.split(t.lower()))) >= 0.6 * min(16, len(s), len(TOKEN.split(t))) and brute_overlap(t, x) >= decontaminate.LEAST_TOKENS}
            assert set(after) == {i for i, *_ in before} - near
        else:
            size = sum(len(words(t)) for _, t, _ in before)
            longest = max(len(words(t)) for _, t, _ in before)
            by = out.groupBy("source").agg(F.sum("mix_taken").alias("t"), F.first("mix_target").alias("g")).collect()
            assert all(abs(r["t"] - r["g"]) <= longest for r in by) and sum(r["g"] for r in by) <= 1.5 * size + 1e-6
        docs = out
    assert corpus_pipeline.run(spark, small).count() == len(after)


def test_pipeline_leaves_its_result_only(spark, small):
    import glob

    import corpus_pipeline
    from weftline.operators.ordering import scratch

    place = scratch(spark).removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{place}/*"))
    mix = corpus_pipeline.run(spark, small)
    assert mix.count() > 0 and len(set(glob.glob(f"{place}/*")) - before) == 1
