"""Whitening against the covariance it never forms, and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, k=8):
    """Exact sums in Python's whole numbers, then the eigenvectors of the covariance."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    off = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    deviation = [sum(a * a for a in r) for r in off]
    centred = np.array(off, dtype=object).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, deviation, centred @ v[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)), e[:k] / e.sum()


def held(df, vectors, ids, k=8):
    n, deviation, white, explained = plain(vectors, k)
    rows = {r["vec_id"]: r for r in df.collect()}
    assert set(rows) == set(ids)
    sign = np.sign([rows[ids[0]]["whitened"][c] * white[0, c] for c in range(len(explained))])
    for i, v in enumerate(ids):
        r = rows[v]
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert np.allclose(np.array(r["whitened"]) * sign, white[i], rtol=1e-6, atol=1e-8)
        assert np.allclose(r["explained"], explained, rtol=1e-9) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("parts, fan, block", [(1, 64, 4096), (7, 2, 8), (40, 3, 1)])
def test_whitening_matches_the_covariance(spark, monkeypatch, parts, fan, block):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(parts)
    vectors = (rng.normal(size=(120, 12)) * np.linspace(0.2, 3, 12) + 5).astype(np.float32).tolist()
    vectors[100:] = [vectors[3]] * 20
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    held(whitening.whiten(df), vectors, list(range(120)))


def test_query_on_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    n, deviation, white, explained = plain([r["embedding"] for r in rows])
    out = whitening.op11_whitening(spark, small).collect()
    assert len(out) == 8 * len(rows) and {r["component"] for r in out} == set(range(1, 9))
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    first = {r["component"]: r["whitened"] for r in out if r["vec_id"] == rows[0]["vec_id"]}
    for r in out:
        i, c = at[r["vec_id"]], r["component"] - 1
        sign = math.copysign(1, first[c + 1] * white[0, c])
        assert r["n"] == n and r["deviation"] == deviation[i] and abs(sign * r["whitened"] - white[i, c]) < 1e-6
        assert abs(r["explained"] - explained[c]) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_odd_rows(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25]]
    rows = [(i, v, 0) for i, v in enumerate(good)]
    rows += [(10, None, 0), (11, [], 0), (12, [1.0, None], 0), (13, [float("nan"), 1.0], 0), (14, [float("inf"), 1.0], 0), (15, [1.0], 0), (16, [1.0, 2.0, 3.0], 0), (17, [3e38, 1.0], 0), (None, good[0], 0), (1, good[1], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n", "v", "a.b", "whitened", "k", "part")})
    got = whitening.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["0", "1", "1", "2", "None"] and {r["n"] for r in got} == {5}
    assert all(len(r["whitened"]) == 2 for r in got)
    for where in ("false", "vec_id = 10", "vec_id = 13"):
        assert whitening.whiten(df.where(where)).count() == 0
    assert whitening.whiten(df.where("false")).columns == whitening.whiten(df).columns


def test_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 0), (2, [2.0, 3.0], 0)], SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, [None, None], [None, None], None)] * 2
    flat = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 0), (2, [4.0, 3.0], 0)], SCHEMA)).collect()
    assert all(abs(abs(r["whitened"][0]) - 1) < 1e-12 and r["whitened"][1] is None and r["explained"] == [1.0, 0.0] and r["identity_error"] < 1e-12 for r in flat)


def test_whole_numbers_beyond_a_long(spark):
    """Sums and deviations are exact where longs overflow, and a deviation that no long holds is null."""
    vectors = [[1e12, 1.0], [-1e12, 2.0], [3e11, 1.5]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    n, deviation, _, explained = plain(vectors)
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert all(d > 1 << 63 and got[i]["deviation"] is None for i, d in enumerate(deviation))
    assert np.allclose(got[0]["explained"][0], explained[0])
    fit = whitening.Fit(3, tuple(sum(math.floor(1024 * float(np.float32(v[d]))) + 100000 for v in vectors) for d in range(2)))
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], np.int64)
    assert fit.off(x).astype(object).tolist() == [[3 * int(a) - s for a, s in zip(r, fit.sums, strict=True)] for r in x.tolist()]
    assert whitening.Fit(1 << 40, (5, 7)).off(np.array([[1 << 30, 3]])).tolist() == [[(1 << 70) - 5, 3 * (1 << 40) - 7]]
