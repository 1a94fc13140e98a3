"""Near-duplicate detection by b-bit MinHash, with links confirmed on whole sets.

A text's set of word shingles has ``bands * rows`` minima under as many hash
functions. Whole minima make the keys of the bands; of each only ``bits`` low
bits are kept, in bit planes, so that two signatures are compared with
exclusive-or and bit counts. Of unequal minima one in ``2 ** bits`` agrees by
chance, which the estimate corrects: ``(share that agrees - C) / (1 - C)``. A
pair that shares a band is a candidate if its estimate is not more than 4.5
standard errors below ``share``. With the defaults a link at exactly 0.8 has
all 40 bands differ once in 10 million, and too low an estimate three times.

Texts with one set are one node. Links are looked for in two steps:

- nodes are sorted by band key, and by the next band's, so that neighbours
  under one key are likely alike. Neighbours are the first candidates. They
  are thinned to the best ones that still join what all of them join, and
  those are confirmed, which unites most groups at a cost that grows with
  their size, not its square;
- keys that still hold nodes of several groups are compared in full, every
  node outside a key's greatest group with all of it, by blocks of bounded
  size. Of a pair that shares several bands only the first compares it. Blocks
  with candidates are confirmed on the sets.

So every candidate is confirmed or joins what is one group already, and no
pairs of a group are written out.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing; texts of fewer words than a shingle are one shingle; a very long
text's minima are taken in chunks; a null doc_id is no component's least
unless all its ids are null, and is kept only then; repeated rows are one node
and each come back; an empty table gives an empty result; further columns,
whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import col, forget, materialise, table
from weftline.llm.components import components
from weftline.llm.confirm import GOLDEN, PIECE, blocks_of, confirmed, joined, lightest, linked_blocks, mixed, pieces, rooted, set_name, sets_of, shingle_set, with_components
from weftline.llm.textbytes import texts

#: Shingles whose hashes are made at once.
CHUNK = 256
#: Edges thinned at once, and pairs compared at once.
EDGES, PAIRS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Rule:
    share: float = 0.8
    words: int = 4
    bands: int = 40
    rows: int = 5
    bits: int = 4

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        salt = mixed(np.arange(1, self.hashes + 1, dtype=np.uint64) * GOLDEN)
        times = mixed(salt) | np.uint64(1)
        least = np.full(self.hashes, ~np.uint64(0))
        for at in range(0, len(shingles), CHUNK):
            part = shingles[None, at : at + CHUNK] ^ salt[:, None]
            part *= times[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return mixed(least)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * GOLDEN
        for k in range(self.rows):
            key = mixed(key) * GOLDEN + m[:, k]
        return mixed(key).view(np.int64)

    def signature(self, minima: np.ndarray) -> np.ndarray:
        """Low bits of the minima, a plane of whole 64-bit words for each."""
        low = np.zeros(-(-self.hashes // 64) * 64, np.uint64)
        low[: self.hashes] = minima
        planes = low >> np.arange(self.bits, dtype=np.uint64)[:, None] & np.uint64(1)
        return np.packbits(planes.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)

    def estimate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Similarity of signatures of the shape ``(..., bits, words)``, agreement by chance taken out."""
        differ = np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=-2)).sum(axis=-1, dtype=np.int32)
        chance = 2.0**-self.bits
        return (1 - differ / self.hashes - chance) / (1 - chance)

    @property
    def least(self) -> float:
        """Estimate below which a pair is no candidate."""
        chance = 2.0**-self.bits
        p = chance + (1 - chance) * self.share
        return self.share - 4.5 * sqrt(p * (1 - p) / self.hashes) / (1 - chance)

    def unpack(self, signatures: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), self.bits, -1)

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can reach the similarity."""
        return 1000 * np.minimum(x, y) >= round(1000 * self.share) * np.maximum(x, y)


def marked(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_hash, node, size, sig, bands)`` for every row; the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, sig, bands = [], [], [], []
            for x in texts(b.column(1)):
                s = shingle_set(x, rule.words)
                m = rule.minima(s) if len(s) else None
                node.append(set_name(s))
                size.append(len(s))
                sig.append(None if m is None else rule.signature(m).tobytes())
                bands.append(None if m is None else rule.band_keys(m))
            cols = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["doc_id", "text_hash", "node", "size", "sig", "bands"])

    text = col(text_col).cast("string")
    picked = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return picked.mapInArrow(run, "doc_id long, text_hash long, node long, size long, sig binary, bands array<long>")


def neighbours(nodes: DataFrame, rule: Rule) -> DataFrame:
    """``(key, node, before)`` of the nodes that share a band key, with the one before under the key.

    Keys at either end of a partition come whether shared or not, for the next
    partition may go on with them.
    """
    at = F.sequence(F.lit(0), F.lit(rule.bands - 1))
    pairs = F.transform(at, lambda i: F.struct(F.get("bands", i).alias("key"), F.get("bands", (i + 1) % rule.bands).alias("following")))
    rows = nodes.select("node", F.inline(pairs)).repartitionByRange("key", "following", "node").sortWithinPartitions("key", "following", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of a batch waits for the next one: key, node, the node before, and whether that has the same key.
        key, node, before, same = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        edge = True
        for b in batches:
            key, node = (np.concatenate((x, b.column(k).to_numpy(zero_copy_only=False))).astype(np.int64) for k, x in ((1, key), (0, node)))
            start = len(key) - b.num_rows
            if not b.num_rows:
                continue
            like = key[1:] == key[:-1]
            same = np.concatenate((same if start else [False], like))
            before = np.concatenate((before if start else [0], node[:-1]))
            shared = same[:-1] | like
            if edge and len(shared):
                shared[0], edge = True, False
            yield batch(key[:-1], node[:-1], before[:-1], same[:-1], shared)
            key, node, before, same = key[-1:], node[-1:], before[-1:], same[-1:]
        yield batch(key, node, before, same, np.ones(len(key), bool))

    def batch(key: np.ndarray, node: np.ndarray, before: np.ndarray, same: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(key[keep], pa.int64()), pa.array(node[keep], pa.int64()), pa.array(before[keep].astype(np.int64), pa.int64(), mask=~same[keep].astype(bool))]
        return pa.RecordBatch.from_arrays(cols, ["key", "node", "before"])

    return rows.mapInArrow(walk, "key long, node long, before long")


def estimated(edges: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``(a, b, e, lead)``: the pairs of ``edges`` whose sizes and estimate ``e`` make them candidates, with the first band key of ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (rule.unpack(b.column(k).to_pylist()) for k in (2, 3))
            e = rule.estimate(x, y)
            fit = rule.fits(b.column(4).to_numpy(), b.column(5).to_numpy()) & (e >= rule.least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e), b.column(6)], ["a", "b", "e", "lead"]).filter(pa.array(fit))

    both = edges
    for k, s in (("a", "x"), ("b", "y")):
        both = both.join(nodes.select(F.col("node").alias(k), F.col("sig").alias(s), F.col("size").alias(f"n{s}"), F.get("bands", F.lit(0)).alias(f"l{s}")), k)
    return both.select("a", "b", "x", "y", "nx", "ny", "lx").mapInArrow(run, "a long, b long, e double, lead long")


def thinned(edges: DataFrame) -> DataFrame:
    """``(a, b)`` of the closest of ``edges`` (``a, b, e, lead``) that, a million at a time, join what all of these join."""
    # Most edges of a group lie together.
    ranged = edges.select("a", "b", "e", "lead").repartitionByRange("lead", "a", "b").sortWithinPartitions("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= EDGES:
                yield best(held)
                held, n = [], 0
        if n:
            yield best(held)

    def best(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, e = (np.concatenate([x.column(k).to_numpy() for x in some]) for k in range(3))
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        u, v, _ = lightest(np.arange(len(names)), at[: len(a)], at[len(a) :], -e)
        return pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["a", "b"])

    return ranged.mapInArrow(run, "a long, b long")


def united(docs: DataFrame, found: DataFrame, edges: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``(node, root)``, written: what the closest of the candidates ``edges`` (``a, b, e``) join, so far as they are links."""
    asked = materialise(thinned(edges))
    sets = sets_of(docs, found, asked.select(F.col("a").alias("node")).union(asked.select(F.col("b").alias("node"))), rule.words, id_col, text_col)
    known = materialise(components(confirmed(asked, sets, rule.share)))
    forget(asked, sets)
    return known


def compared(members: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``(block, node)`` of candidates between different roots under each key of ``members`` (``key, node, root``, written)."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("m"))
    keys = sizes.groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top"))
    keys = keys.select("key", F.col("top.root").alias("top"), F.ceil(F.col("m") / PIECE).alias("all_parts"), F.ceil((F.col("m") - F.col("top.m")) / PIECE).alias("few_parts")).where("few_parts > 0")
    rows = members.join(keys, "key").join(nodes.select("node", "size", "sig", "bands"), "node")
    part = F.xxhash64("key", "node")
    # Each node outside the greatest group (side 0) meets all nodes (side 1).
    some = rows.where("root <> top").withColumns({"i": F.pmod(part, "few_parts"), "side": F.lit(0)}).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_parts") - 1)))
    every = rows.withColumns({"j": F.pmod(part, "all_parts"), "side": F.lit(1)}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few_parts") - 1)))
    names = ["key", "i", "j", "side", "node", "root", "size", "sig", "bands"]
    order = ["key", "i", "j", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            # The last group may go on in the next batch; groups are bounded.
            both = pa.Table.from_batches([*held, b]).combine_chunks()
            place = [both[c].to_numpy() for c in order[:3]]
            last = len(both) - int(np.argmin(np.append(np.logical_and.reduce([p[::-1] == p[-1] for p in place]), False))) if len(both) else 0
            yield from compare(both.slice(0, last))
            held = both.slice(last).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    def compare(groups: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(groups):
            return
        key, i, j, side, node, root, size = (groups[c].to_numpy() for c in names[:7])
        sig, bands = rule.unpack(groups["sig"].to_pylist()), groups["bands"].combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        group = np.cumsum(new) - 1
        starts = np.append(np.flatnonzero(new), len(key))
        one = np.bincount(group, side).astype(np.int64)
        few_at = np.flatnonzero(side == 0)
        # All pairs of a row of side 0 with those of side 1 in its group, some rows at a time.
        many = one[group[few_at]]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + PAIRS, PAIRS), side="left")
        u, v = [], []
        for s, e in zip(cuts, np.append(cuts[1:], len(few_at)), strict=True):
            n = many[s:e]
            if not n.sum():
                continue
            x = np.repeat(few_at[s:e], n)
            y = starts[group[x] + 1] - np.repeat(n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fit = (root[x] != root[y]) & rule.fits(size[x], size[y])
            x, y = x[fit], y[fit]
            near = rule.estimate(sig[x], sig[y]) >= rule.least
            x, y = x[near], y[near]
            # Only the first band that both share compares them.
            own = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key[x]
            u.append(x[own])
            v.append(y[own])
        u, v = (np.concatenate(k) if k else np.empty(0, np.int64) for k in (u, v))
        p, q, at = blocks_of(u, v, pieces(size), pieces(size))
        name = [f"{key[k]}:{i[k]}:{j[k]}:{s}:{t}" for k, s, t in zip(at.tolist(), p.tolist(), q.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(node[at], pa.int64())], ["block", "node"])

    both = some.select(*names).unionByName(every.select(*names))
    return both.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(run, "block string, node long")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, node, size, component_id)`` for every row; ``size`` is that of its set."""
    found = materialise(marked(docs, rule, id_col, text_col))
    full = found.where("size > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("size", "sig", "bands")])
    nodes = materialise(nodes)
    beside = materialise(neighbours(nodes, rule))
    edges = beside.where("before IS NOT NULL").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct()
    edges = materialise(estimated(edges, nodes, rule))
    known = united(docs, found, edges, rule, id_col, text_col)
    members = materialise(rooted(beside.select("key", "node"), known))
    blocks = materialise(compared(members, nodes, rule))
    forget(members)
    if not blocks.isEmpty():
        left = materialise(rooted(blocks, known))
        sets = sets_of(docs, found, left, rule.words, id_col, text_col)
        known = joined(known, linked_blocks(left, sets, rule.share))
        forget(left, sets)
    named = with_components(full.select("doc_id", "text_hash", "node", "size"), nodes.select("node", "first_id", "m"), known)
    alone = found.where("size = 0").withColumn("component_id", F.col("doc_id"))
    forget(beside, edges, blocks, nodes)
    names = ["doc_id", "text_hash", "node", "size", "component_id"]
    return named.select(*names).unionByName(alone.select(*names))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
