"""Length-sorted batches and greedy token-budget packing, without a sequential pass over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.operators.ordering import forget, global_rank, written

#: Rows of one epoch order that a task packs at once.
BLOCK = 1 << 18


def length_batches(rows: DataFrame, size: Column, ordinal: str, batch_size: int) -> DataFrame:
    """Adds ``batch``: fixed-size batches in order of size."""
    ranked = global_rank(rows.withColumn("__size", size), [F.col("__size"), F.col(ordinal)], "__rank")
    return ranked.withColumn("batch", F.floor(F.col("__rank") / batch_size).cast("long")).drop("__size", "__rank")


def plan_sizes(histogram: list[tuple[int, int]], max_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """For each size ``(size, before, batch, room, cap)``.

    Rows in order of size close a batch when one more would pass the budget,
    so all that happens within one size follows from how many rows the open
    batch has: ``room`` rows still go to ``batch``, later ones come ``cap`` a batch.
    """
    out, before, batch, held = [], 0, 0, 0
    for size, n in sorted(histogram):
        cap = max(1, max_tokens // size) if size else n + held
        room = max(0, cap - held)
        if held and not room:
            batch, held, room = batch + 1, 0, cap
        out.append((size, before, batch, room, cap))
        if n <= room:
            held += n
        else:
            more = n - room
            batch += -(-more // cap)
            held = more - (-(-more // cap) - 1) * cap
        before += n
    return out


def token_batches(rows: DataFrame, size: Column, ordinal: str, max_tokens: int) -> DataFrame:
    """Adds ``batch``, packed greedily in order of ``(size, ordinal)`` so that rows times the longest stay in budget.

    Only the histogram of sizes, a row for each different size, comes to the driver.
    """
    sized = rows.withColumn("__size", size.cast("long"))
    plan = plan_sizes([tuple(r) for r in sized.groupBy("__size").count().collect()], max_tokens)
    table = rows.sparkSession.createDataFrame(plan, "__size long, __before long, __batch long, __room long, __cap long")
    ranked = global_rank(sized, [F.col("__size"), F.col(ordinal)], "__rank").join(F.broadcast(table), "__size")
    at = F.col("__rank") - F.col("__before")
    batch = F.when(at < F.col("__room"), F.col("__batch")).otherwise(F.col("__batch") + 1 + F.floor((at - F.col("__room")) / F.col("__cap")))
    return ranked.withColumn("batch", batch.cast("long")).drop("__size", "__rank", "__before", "__batch", "__room", "__cap")


def short_items(rows: DataFrame, size: Column, most: int, lang: str | None = None) -> DataFrame:
    """Rows no longer than ``most``, of one language if it is given."""
    fits = rows.where(size <= most)
    return fits if lang is None else fits.where(F.col("lang") == lang)


def _draw(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def jittered(size: Column, key: Column, seed: int, epoch: Column, noise: int) -> Column:
    """Size plus seeded noise from 0 to ``noise``, another for every epoch."""
    return size + F.conv(F.substring(_draw(seed, epoch, key), 1, 8), 16, 10).cast("long") % (noise + 1)


def _in_epochs(rows: DataFrame, size: Column, ordinal: str, seed: int, n_epochs: int, noise: int) -> tuple[DataFrame, list[Column]]:
    """Every epoch's rows with ``__size`` and ``__noisy``, and their order: by noisy size, equal ones in a seeded order."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_epochs - 1).cast("long"))))
    noisy = each.withColumns({"__size": size.cast("long"), "__noisy": jittered(size.cast("long"), F.col(ordinal), seed, F.col("epoch"), noise)})
    return noisy, [F.col("epoch"), F.col("__noisy"), F.col(ordinal)]


def _in_turn(batched: DataFrame, seed: int) -> DataFrame:
    """Adds ``place``, the seeded turn of each ``batch`` in its ``epoch``."""
    turns = batched.select("epoch", "batch").distinct().withColumn("__draw", _draw(seed, F.col("epoch"), F.col("batch")))
    turns = global_rank(turns, [F.col("epoch"), F.col("__draw"), F.col("batch")], "__turn")
    # A row for each epoch.
    start = turns.groupBy(F.col("epoch").alias("__e")).agg(F.min("__turn").alias("__start"))
    places = turns.join(F.broadcast(start), F.col("epoch") == F.col("__e")).select("epoch", "batch", (F.col("__turn") - F.col("__start")).alias("place"))
    return batched.join(places, ["epoch", "batch"])


def epochs(rows: DataFrame, size: Column, ordinal: str, batch_size: int, *, seed: int, n_epochs: int = 1, noise: int = 0) -> DataFrame:
    """What a loader reads: each epoch's rows with ``epoch``, ``batch`` (of like size) and ``place`` (its seeded turn)."""
    noisy, order = _in_epochs(rows, size, ordinal, seed, n_epochs, noise)
    ranked = global_rank(noisy, order, "__rank")
    first = ranked.groupBy(F.col("epoch").alias("__e")).agg(F.min("__rank").alias("__first"))
    batched = ranked.join(F.broadcast(first), F.col("epoch") == F.col("__e"))
    batched = batched.withColumn("batch", F.floor((F.col("__rank") - F.col("__first")) / batch_size).cast("long")).drop("__e", "__first", "__rank", "__noisy", "__size")
    return _in_turn(batched, seed)


def batch_ends(sizes: np.ndarray, limit: np.ndarray, max_tokens: int) -> np.ndarray:
    """Where a batch that begins at each row ends: the most rows whose number times the longest stays in budget, one at least, none past ``limit``.

    A batch grows by halving steps over maxima of runs of 1, 2, 4 ... rows.
    """
    n = len(sizes)
    runs = [sizes]
    while len(runs[-1]) > 1 and 1 << len(runs) <= max_tokens:
        half = 1 << (len(runs) - 1)
        last = runs[-1]
        runs.append(np.maximum(last, np.concatenate((last[half:], np.full(min(half, len(last)), max_tokens + 1)))))
    start = np.arange(n)
    end, widest = start + 1, sizes.copy()
    for k in range(len(runs) - 1, -1, -1):
        inside = np.minimum(end, n - 1)
        wider = np.maximum(widest, runs[k][inside])
        grow = (end + (1 << k) <= limit) & (wider * (end + (1 << k) - start) <= max_tokens)
        end, widest = np.where(grow, end + (1 << k), end), np.where(grow, wider, widest)
    return end


def train_batches(rows: DataFrame, size: Column, ordinal: str, max_tokens: int, *, seed: int, n_epochs: int = 1, noise: int = 8) -> DataFrame:
    """Each epoch's rows with ``epoch``, ``batch`` and ``place``: sizes get seeded noise, batches fill greedily in that order, then take seeded turns.

    True sizes are out of order then, so what a row's batch is depends on all
    before it. Blocks of consecutive ranks are packed for every way in which
    they may begin: a batch left open takes some of the first rows, and there
    are no more such numbers than a batch has rows. One row for each block says
    what follows from each, a pass over these rows finds which came true, and
    the blocks number their batches with it. Sizes below 1 count as 1.
    """
    noisy, order = _in_epochs(rows, size, ordinal, seed, n_epochs, noise)
    ranked = written(global_rank(noisy, order, "__rank").withColumn("__block", F.expr(f"__rank div {BLOCK}")))
    slim = ranked.select("__block", "__rank", "epoch", F.greatest("__size", F.lit(1).cast("long")).alias("__size"))

    def sorted_block(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        block = block.sort_by("__rank")
        epoch, sizes = block["epoch"].to_numpy(), block["__size"].to_numpy()
        cuts = np.append(np.flatnonzero(epoch[1:] != epoch[:-1]) + 1, len(epoch))
        return block["__rank"].to_numpy(), epoch, sizes, batch_ends(sizes, cuts[np.searchsorted(cuts, np.arange(len(epoch)), side="right")], max_tokens)

    def outcomes(block: pa.Table) -> pa.Table:
        rank, epoch, sizes, ends = sorted_block(block)
        n = len(sizes)
        # Sizes so far as an open batch could reach; it has a row at least.
        reach = np.maximum.accumulate(sizes) * (np.arange(n) + 2) <= max_tokens
        same = epoch == epoch[0]
        some = int(np.argmin(reach & same)) if not (reach & same).all() else n
        at, closed = np.arange(min(some + 1, n)), np.zeros(min(some + 1, n), np.int64)
        while (inside := ends[at] < n).any():
            at, closed = np.where(inside, ends[at], at), closed + inside
        widest = [int(sizes[k:].max()) for k in at.tolist()]
        one = {
            "block": [int(block["__block"][0].as_py())], "n": [n], "first": [int(epoch[0])], "last": [int(epoch[-1])], "sizes": [sizes[:some].tolist()],
            "closed": [closed.tolist()], "held": [(n - at).tolist()], "widest": [widest],
        }
        return pa.table(one, schema=pa.schema([(k, pa.list_(pa.int64()) if k in ("sizes", "closed", "held", "widest") else pa.int64()) for k in one]))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, widest, epoch = -1, 0, 0, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                taken, widest_here = 0, widest
                if held and r["first"] == epoch:
                    for x in r["sizes"]:
                        if max(widest_here, x) * (held + taken + 1) > max_tokens:
                            break
                        taken, widest_here = taken + 1, max(widest_here, x)
                out.append((r["block"], taken, batch))
                if taken == r["n"]:
                    held, widest = held + taken, widest_here
                else:
                    batch += 1 + r["closed"][taken]
                    held, widest = r["held"][taken], r["widest"][taken]
                epoch = r["last"]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["__block", "__taken", "__open"])

    def number(block: pa.Table) -> pa.Table:
        rank, _, sizes, ends = sorted_block(block)
        taken, batch = int(block["__taken"][0].as_py()), int(block["__open"][0].as_py())
        starts, at = [], taken
        while at < len(sizes):
            starts.append(at)
            at = int(ends[at])
        new = np.zeros(len(sizes), np.int64)
        new[starts] = 1
        return pa.table({"__rank": rank, "__all": batch + np.cumsum(new)})

    told = slim.groupBy("__block").applyInArrow(
        outcomes, "block long, n long, first long, last long, sizes array<long>, closed array<long>, held array<long>, widest array<long>"
    )
    # A row for each block, in order.
    begun = written(told.coalesce(1).sortWithinPartitions("block").mapInArrow(follow, "__block long, __taken long, __open long"))
    numbered = written(slim.join(F.broadcast(begun), "__block").groupBy("__block").applyInArrow(number, "__rank long, __all long"))
    batched = ranked.join(numbered, "__rank")
    first = batched.groupBy(F.col("epoch").alias("__e")).agg(F.min("__all").alias("__first"))
    batched = batched.join(F.broadcast(first), F.col("epoch") == F.col("__e")).withColumn("batch", F.col("__all") - F.col("__first"))
    forget(begun)
    return _in_turn(batched.drop("__e", "__first", "__all", "__rank", "__noisy", "__size", "__block"), seed)


def collated(rows: DataFrame, batch: str, ids: str, ordinal: str) -> DataFrame:
    """``(batch, width, ordinals, padded)``: a row for each batch, its sequences padded to the longest."""
    grouped = rows.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(ordinal, ids))).alias("__x"), F.max(F.size(ids)).alias("__w"))
    return grouped.select(
        batch, F.col("__w").cast("long").alias("width"), F.transform("__x", lambda x: x[ordinal]).alias("ordinals"),
        F.transform("__x", lambda x: A.pad(x[ids], F.col("__w"))).alias("padded"),
    )


def restored(batches: DataFrame, ordinals: str, values: str) -> DataFrame:
    """``(ordinal, value, rank)``: the rows of collated batches, ranked by their first order again; ``rank`` counts from 0."""
    each = batches.select(F.explode(F.arrays_zip(F.col(ordinals).alias("ordinal"), F.col(values).alias("value"))).alias("x")).select("x.*")
    return global_rank(each, [F.col("ordinal")])


def write_shards(batches: DataFrame, path: str, workers: int, place: str = "place") -> None:
    """Batches as Parquet for ``workers`` readers: worker ``r`` has those whose place is ``r`` modulo their number, in order of ``step``.

    A worker's files are ranges of its steps, so a reader that resumes opens
    none that end before its step.
    """
    dealt = batches.withColumns({"worker": F.col(place) % workers, "step": F.expr(f"{place} div {workers}")})
    dealt.repartitionByRange("worker", "step").sortWithinPartitions("worker", "step").write.mode("overwrite").partitionBy("worker").parquet(path)


def read_shard(spark: SparkSession, path: str, worker: int, step: int = 0) -> DataFrame:
    """What ``worker`` still has to read from ``step`` on: one folder, and of its files only those that reach so far."""
    return spark.read.parquet(path).where((F.col("worker") == worker) & (F.col("step") >= step))
