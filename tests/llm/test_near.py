"""Near-duplicates held against all pairs, on families astride the threshold."""

import random
from itertools import combinations

import numpy as np
import pytest

from weftline.llm import confirm, minhash, simhash

SCHEMA = "doc_id long, text string"


def plain_set(text, k):
    """Distinct runs of ``k`` words, or the whole sequence of fewer."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(rows, k, percent=80, empty_linked=False):
    """Smallest id reachable for each row; ``rows`` have distinct ids."""
    sets = {i: plain_set(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (empty_linked and not x and not y) or (x and y and 100 * len(x & y) >= percent * len(x | y)):
            links += 1
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}, {i: len(s) for i, s in sets.items()}, links


def family(rng, n, words, width, vocabulary=10**6):
    """``n`` variants of a text with one run of about ``width`` words replaced in each."""
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        w = rng.randint(width[0], width[1])
        at = rng.randrange(words - w + 1)
        yield " ".join(base[:at] + [f"x{rng.randrange(vocabulary)}" for _ in range(w)] + base[at + w :])


def astride(seed=3):
    """200 texts in 10 families of which a part of the pairs reach the similarity, and tiny ones."""
    rng = random.Random(seed)
    texts = [t for _ in range(10) for t in family(rng, 20, 304, (11, 17))]
    texts += [t for n in (6, 8, 9, 14, 18, 24, 33, 44) for _ in range(6) for t in family(rng, 4, n + 4, (1, max(1, n // 12)))]
    base = [f"t{i}" for i in range(60)]
    # Prefixes differ in single shingles, so many are at exactly 4 of 5, 8 of 10 and so on.
    texts += [" ".join(base[:n]) for n in range(1, 60)] + ["", "  ", "One two", "one TWO", "a"]
    return list(enumerate(texts))


def components_of(df, column="component_id"):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_minhash_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 16)
    rows = astride()
    expected, sizes, _ = plain_components(rows, 4)
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert components_of(found) == expected
    assert components_of(found, "size") == sizes


def test_minhash_on_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected, sizes, _ = plain_components(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op13_minhash(spark, small).collect()}
    assert got == {i: (sizes[i], expected[i], expected[i] == i) for i in expected}


def test_minhash_without_neighbour_rounds(spark, monkeypatch):
    """Whatever the neighbours miss, comparing keys in full finds: here nothing comes from them."""
    monkeypatch.setattr(minhash, "united", lambda docs, *_: docs.sparkSession.createDataFrame([], "node long, root long"))
    monkeypatch.setattr(minhash, "PIECE", 8)
    rows = astride(5)
    assert components_of(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain_components(rows, 4)[0]


def test_minhash_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e"), (None, "A b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "b"), (8, "B"), (None, "q")]
    got = sorted(((r["doc_id"], r["size"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 2, 5), (None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 1, 7), (8, 1, 7), (None, 1, None)], key=str)


def test_estimate_is_corrected_for_chance():
    rule, rng = minhash.Rule(), np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        both = int(round(2000 * share / (1 + share)))
        x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        y = np.concatenate((x[:both], rng.integers(0, 1 << 63, 1000 - both, dtype=np.uint64)))
        a, b = (rule.unpack([rule.signature(rule.minima(s)).tobytes()]) for s in (x, y))
        assert abs(float(rule.estimate(a, b)[0]) - share) < 0.16
    assert rule.hashes == 200 and 0.65 < rule.least < 0.68


def test_overlaps_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(0, 9000, 12)]
    got = confirm.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


@pytest.mark.parametrize("both, x, y, share, yes", [(4, 4, 5, 0.8, True), (8, 9, 9, 0.8, True), (7, 8, 9, 0.8, False), (0, 1, 1, 0.8, False)])
def test_reached_in_whole_numbers(both, x, y, share, yes):
    assert bool(confirm.reached(np.array(both), np.array(x), np.array(y), share)) is yes


@pytest.mark.parametrize("tile, piece, seed", [(32768, 512, 3), (64, 16, 4)])
def test_similar_keeps_every_link_of_families_astride_the_threshold(spark, monkeypatch, tile, piece, seed):
    """Recall 1.0 of single linkage at 0.8, also where a family has more doubtful pairs than links, over several tiles."""
    for k, v in (("TILE", tile), ("PART", min(512, tile // 4)), ("PENDING", 50)):
        monkeypatch.setattr(simhash, k, v)
    monkeypatch.setattr(confirm, "PIECE", piece)
    rows = astride(seed)
    expected, _, links = plain_components(rows, 5, empty_linked=True)
    assert links > 500
    assert components_of(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), simhash.Similar())) == expected


def test_no_link_of_small_sets_is_out_of_reach():
    """Pairs at exactly the threshold, of sizes 4 and 5 and up, by the limits of their own sizes."""
    rule, rng = simhash.Similar(), np.random.default_rng(5)
    for x, y in ((4, 5), (8, 9), (8, 10), (12, 15), (27, 30), (36, 45), (50, 60), (64, 80), (300, 375)):
        both = next(c for c in range(x + 1) if 1000 * c >= 800 * (x + y - c))
        missed = 0
        for _ in range(200):
            s = rng.integers(0, 1 << 63, x + y - both, dtype=np.uint64)
            a, b = (simhash.wide_fingerprint(t, 16)[None] for t in (s[:x], s[x - both :]))
            u, _ = rule.pairs(a, b, np.array([x]), np.array([y]))
            missed += not (len(u) and rule.apart(a, b, np.array([x]), np.array([y]))[1][0])
        assert missed == 0, (x, y, missed)
