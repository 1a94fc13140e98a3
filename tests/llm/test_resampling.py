"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from weftline.llm import resampling

SCHEMA = "doc_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


def grams(text, rule):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % rule.buckets for n in range(rule.first, rule.last + 1) for i in range(len(w) - n + 1)]


def plain(docs, items, rule):
    """``(doc_id, n_features, weight, score, rank)`` of all rows."""
    found = [(i, *grams(t, rule)) for i, t in docs]
    s, t = Counter(b for *_, g in found for b in g), Counter(b for x in items for b in grams(x, rule)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + rule.buckets) / ((s[b] + 1.0) * (n_t + rule.buckets)))) for b in s}
    rows = []
    for i, n, g in found:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= rule.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * rule.percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünder", "ärger", "É", "x1", "A"]
    return [rng.choice([" ", "\n", "-", "_"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 25, 70]))) for _ in range(n)]


@pytest.mark.parametrize("first, last, block", [(1, 1, 65536), (1, 3, 65536), (2, 3, 4), (1, 2, 1), (3, 3, 2)])
def test_resampling_matches_loops(spark, monkeypatch, first, last, block):
    """Also with rows that repeat, and documents cut into blocks of fewer words than a feature may have."""
    monkeypatch.setattr(resampling, "BLOCK", max(block, last - 1))
    rule = resampling.Rule(first=first, last=last, buckets=97, percent=30)
    docs = list(enumerate(texts())) + [(None, "w1 " * 30), (None, None), (7, "w2 w3 " * 20), (7, "w2 w3 " * 20), (8, ""), (9, "...")]
    items = [*texts(5, 9), None, ""]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("key", "pos", "word", "m", "bucket", "a.b", "rank", "score", "w1")})
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = resampling.resample(df, target, rule)
    rows = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    want = plain(docs, items, rule)
    # Ranks of rows that are alike in all else may stand either way.
    assert [r[:4] for r in rows] == [r[:4] for r in want] and sorted(r[4] or 0 for r in rows) == sorted(r[4] or 0 for r in want)
    assert {r for r in rows if r[0] not in (7, None)} == {r for r in want if r[0] not in (7, None)}


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a " * 25), (2, "b " * 30)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    rule = resampling.Rule(percent=50)
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(docs, none, rule).collect()), key=str)
    assert got == plain([(1, "a " * 25), (2, "b " * 30)], [], rule)
    assert resampling.resample(docs.where("false"), none).count() == 0


def test_query_matches_sql(spark, small, duck):
    out = resampling.op12_resampling(spark, small)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    whole = out.withColumn("rank", F.coalesce("rank", F.lit(0)))
    same_rows(whole, duck, f"SELECT doc_id, n_features, weight, score, coalesce(rank, 0) AS rank FROM ({resampling.OP12_SQL})")


def test_order_one_shuffles_no_word(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = resampling.features(resampling.keyed(docs, "doc_id", "text"), resampling.Rule())
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
