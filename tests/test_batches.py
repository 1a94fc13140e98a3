"""Batches under a token budget, loader shards, checkpoints and candidates, held against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import ordering, packing
from weftline.operators import training as R


def packed(sizes, budget):
    """Batch of each row when rows fill batches in order."""
    out, batch, n, widest = [], 0, 0, 0
    for s in sizes:
        if n and max(widest, s) * (n + 1) > budget:
            batch, n, widest = batch + 1, 0, 0
        n, widest = n + 1, max(widest, s)
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_batch_ends_are_those_of_a_loop(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, rng.integers(2, 60), rng.integers(1, 400))
    budget = int(rng.integers(1, 200))
    ends = packing.batch_ends(sizes, np.full(len(sizes), len(sizes)), budget)
    for i in range(len(sizes)):
        batches = packed(sizes[i:].tolist(), budget)
        assert ends[i] - i == batches.count(0)


@pytest.mark.parametrize("block, budget, n_epochs", [(7, 60, 2), (3, 1000, 2), (64, 40, 3), (1 << 18, 300, 1)])
def test_train_batches_fill_like_a_loop(spark, monkeypatch, block, budget, n_epochs):
    """Also where one batch spans several blocks, an epoch ends inside a block, and a row alone is over the budget."""
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = random.Random(block)
    rows = [(k, rng.choice([1, 2, 3, 5, 8, 13, 30, 90]), "x") for k in range(230)]
    df = spark.createDataFrame(rows, "k long, size int, note string")
    got = packing.train_batches(df, F.col("size"), "k", budget, seed=3, n_epochs=n_epochs, noise=6)
    assert {"k", "size", "note", "epoch", "batch", "place"} == set(got.columns)
    noisy = df.select("k", "size", *[packing.jittered(F.col("size").cast("long"), F.col("k"), 3, F.lit(e).cast("long"), 6).alias(f"e{e}") for e in range(n_epochs)]).collect()
    found = {(r["epoch"], r["k"]): (r["batch"], r["place"]) for r in got.collect()}
    assert len(found) == 230 * n_epochs
    for e in range(n_epochs):
        order = sorted(noisy, key=lambda r: (r[f"e{e}"], r["k"]))
        assert [found[e, r["k"]][0] for r in order] == packed([r["size"] for r in order], budget)
        turns = {found[e, r["k"]] for r in order}
        assert sorted(p for _, p in turns) == list(range(len(turns))) and (len(turns) < 5 or [p for _, p in sorted(turns)] != list(range(len(turns))))
    assert packing.train_batches(df.where("false"), F.col("size"), "k", budget, seed=3).count() == 0


def test_shards_join_to_the_whole_and_resume(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("k"), F.sequence(F.lit(1), (F.col("id") % 9 + 1).cast("int")).alias("ids"))
    batches = packing.collated(packing.epochs(rows, F.size("ids"), "k", 4, seed=1), "place", "ids", "k")
    packing.write_shards(batches, str(tmp_path), 3)
    whole = sorted((r["place"], r["ordinals"]) for r in batches.collect())
    parts = [packing.read_shard(spark, str(tmp_path), w) for w in range(3)]
    assert sorted((r["place"], r["ordinals"]) for p in parts for r in p.collect()) == whole
    tail = packing.read_shard(spark, str(tmp_path), 1, 20)
    assert sorted((r["place"], r["ordinals"]) for r in tail.collect()) == [(p, o) for p, o in whole if p % 3 == 1 and p // 3 >= 20]
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(worker" in plan and "GreaterThanOrEqual(step,20)" in plan


def test_restored_order(spark):
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("k"), F.array_repeat(F.lit(1), (F.col("id") % 5 + 1).cast("int")).alias("ids"))
    done = packing.collated(packing.length_batches(rows, F.size("ids"), "k", 8), "batch", "ids", "k")
    assert [r["ordinal"] for r in packing.restored(done, "ordinals", "padded").orderBy("rank").collect()] == list(range(50))


def test_k_best_cuts_before_the_shuffle(spark):
    """One sentence has nearly all candidates: every task keeps five of them."""
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, 0).otherwise(F.col("id")).alias("s"), (F.col("id") * 37 % 1000).cast("double").alias("x"), "id")
    best = R.k_best(rows, "s", F.col("x"), F.lit(4), 0.6, F.col("id"), 5)
    got = best.where("s = 0").orderBy("place").collect()
    want = sorted(((-(i * 37 % 1000), i) for i in range(4900)))[:5]
    assert [(r["place"], r["id"]) for r in got] == [(k, i) for k, (_, i) in enumerate(want)]
    assert best.count() == 105
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > plan.index("Exchange") and plan.count("WindowGroupLimit") == 2


def test_checkpoints_prune_and_resume(spark, tmp_path):
    folder = str(tmp_path)
    assert R.resume_point(spark, folder) is None and R.prune_checkpoints(spark, folder, 2) == []
    state = spark.createDataFrame([("w", 1.5)], "name string, value double")
    for step in (5, 100, 20, 9):
        R.save_checkpoint(state.withColumn("value", F.lit(float(step))), folder, step)
    (tmp_path / "step900.parquet").mkdir()  # a save that did not finish
    (tmp_path / "notes.txt").write_text("x")
    assert [p.rsplit("/", 1)[1] for p in R.prune_checkpoints(spark, folder, 2)] == ["step5.parquet", "step9.parquet"]
    assert sorted(r["step"] for r in R.checkpoints(spark, folder).collect()) == [20, 100]
    assert [tuple(r) for r in R.resume_point(spark, folder).collect()] == [("w", 100.0, 100)]
    with pytest.raises(ValueError):
        R.prune_checkpoints(spark, folder, 0)


def test_only_the_result_stays(spark):
    import glob

    def work():
        a = ordering.written(spark.range(10))
        b = ordering.only_result(lambda: ordering.written(a.where("id > 2")).where("id > 3"))
        return b.where("id > 4")

    place = ordering.scratch(spark).removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{place}/*"))
    done = ordering.only_result(work)
    assert {r["id"] for r in done.collect()} == set(range(5, 10))
    assert [done.written_to.rsplit("/", 1)[1]] == [p.rsplit("/", 1)[1] for p in set(glob.glob(f"{place}/*")) - before]
    with pytest.raises(ZeroDivisionError):
        ordering.only_result(lambda: (ordering.written(spark.range(3)), 1 / 0)[0])
    assert len(set(glob.glob(f"{place}/*")) - before) == 1
