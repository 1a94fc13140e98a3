"""Sets of shingles, and links between texts that are confirmed on whole sets.

Candidates come as pairs (``confirmed``), whose sets meet in two joins, or as
blocks (``linked_blocks``): some hundreds of texts between which any pair may
be a link, compared all at once, so that a group in which very many pairs are
in doubt is not written out pair by pair. Either way what counts is the sets'
intersection, never an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FEW_KEYS, col, few, forget, materialise, met
from weftline.llm.components import components
from weftline.llm.textbytes import texts

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Texts of a piece, two of which make a block, and shingles in it unless one text alone has more.
PIECE = 512
PIECE_SHINGLES = 1 << 21
#: Shingles whose occurrences are multiplied at once.
COLUMNS = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles (ASCII lower case)."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    k = min(words, n)
    x = h[: n - k + 1]
    for j in range(1, k):
        x = mixed(x) * GOLDEN + h[j : n - k + 1 + j]
    return np.unique(mixed(x))


def set_name(shingles: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0


def reached(both: np.ndarray, x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Whether sets of sizes ``x`` and ``y`` with ``both`` in common have the Jaccard similarity, in whole numbers."""
    return 1000 * both >= round(1000 * share) * (x + y - both)


def roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    r = parent[at]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        x, y = roots(parent, a), roots(parent, b)
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def lightest(parent: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the pairs between what ``parent`` joins, by Boruvka's rounds."""
    order = np.lexsort((v, u, d))
    u, v, d = u[order], v[order], d[order]
    parent = parent.copy()
    taken = np.zeros(len(u), bool)
    at = np.arange(len(u))
    while True:
        x, y = roots(parent, u[at]), roots(parent, v[at])
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            return u[taken], v[taken], d[taken]
        best = np.full(len(parent), len(u))
        np.minimum.at(best, x, at)
        np.minimum.at(best, y, at)
        chosen = np.unique(best[best < len(u)])
        taken[chosen] = True
        unite(parent, u[chosen], v[chosen])


def pieces(sizes: np.ndarray) -> np.ndarray:
    """Piece of each text, in order; pieces are bounded in texts and in shingles."""
    return np.cumsum(np.maximum(sizes / PIECE_SHINGLES, 1 / PIECE)).astype(np.int64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections between any two of some sets; the diagonal means nothing."""
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    # Only what two sets share can count.
    place = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    n = int(code[-1]) + 1 if len(code) else 0
    cuts = np.searchsorted(code, np.arange(0, n + COLUMNS, COLUMNS))
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[s:e], code[s:e] - k * COLUMNS] = 1
        out += has @ has.T
    return out.astype(np.int64)


def sets_of(docs: DataFrame, found: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(node, s)``, written: the set of each ``node`` of ``wanted``, from one of the rows that ``found`` has for it."""
    # Any row of a node will do: its set is the same.
    # Aggregated before the join, so that copies of one text do not meet in one task.
    one = found.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).join(wanted.select(F.col("node").alias("n")).distinct(), F.col("node") == F.col("n"), "left_semi")
    one = materialise(one.select("node", F.col("x.doc_id").alias("id"), F.col("x.text_hash").alias("t")))
    small = F.broadcast if one.count() <= FEW_KEYS else (lambda df: df)
    text = col(text_col).cast("string")
    rows = docs.select(col(id_col).cast("long").alias("own_id"), text.alias("text"), F.xxhash64(text).alias("own_t"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_t") == F.col("t"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_set(x, words).tobytes() for x in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["node", "s"])

    out = materialise(rows.join(small(one), same).select("node", "text").mapInArrow(sets, "node long, s binary").dropDuplicates(["node"]))
    forget(one)
    return out


def confirmed(edges: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those of ``edges`` (``a, b``) whose sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(reached(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), share)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = edges.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a long, b long")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their ``node``, itself if the written ``roots`` has none."""
    named = few(roots.select(F.col("node").alias("__n"), F.col("root").alias("__r")), FEW_KEYS)
    return rows.join(named, F.col("node") == F.col("__n"), "left").withColumn("root", F.coalesce("__r", "node")).drop("__n", "__r")


def crossing(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(block, node, root)`` of the blocks that hold more than one root."""
    named = materialise(rooted(members.select("block", "node"), roots))
    mixed_ones = named.groupBy(F.col("block").alias("__k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return named.join(mixed_ones, F.col("block") == F.col("__k"), "left_semi")


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)``, written: the components of ``roots`` with ``edges`` (``a, b``) between their groups."""
    edges = materialise(edges)
    if edges.isEmpty():
        return roots
    # Only the groups that the new edges join need be looked at.
    a = rooted(edges.select(F.col("a").alias("node"), "b"), roots).select(F.col("b").alias("node"), F.col("root").alias("a"))
    over = materialise(components(rooted(a, roots).select("a", F.col("root").alias("b"))))
    moved = few(over.select(F.col("node").alias("__t"), F.col("root").alias("__to")), FEW_KEYS)
    old = roots.join(moved, F.col("root") == F.col("__t"), "left").select("node", F.coalesce("__to", "root").alias("root"))
    new = over.join(roots.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti")
    done = materialise(old.unionByName(new))
    forget(edges, over)
    return done


def linked_blocks(members: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Edges ``(a, b)`` that join the texts of each block as its links between different roots do.

    ``members`` has ``block, node, root``; a block is at most two pieces.
    """

    def check(block: pa.Table) -> pa.Table:
        node, root = (block[c].to_numpy() for c in ("node", "root"))
        some = [np.frombuffer(x, np.uint64) for x in block["s"].to_pylist()]
        n = np.array(list(map(len, some)))
        u, v = np.nonzero(np.triu(reached(overlaps(some), n[:, None], n[None], share) & (root[:, None] != root[None])))
        parent = np.arange(len(node))
        unite(parent, u, v)
        top = roots(parent, np.arange(len(node)))
        linked = np.flatnonzero(top != np.arange(len(node)))
        return pa.table({"a": node[linked], "b": node[top[linked]]})

    with_sets = members.join(sets.select(F.col("node").alias("__n"), "s"), F.col("node") == F.col("__n")).select("block", "node", "root", "s")
    return with_sets.groupBy("block").applyInArrow(check, "a long, b long")


def blocks_of(u: np.ndarray, v: np.ndarray, piece_u: np.ndarray, piece_v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidate pairs ``u, v`` the pieces at both ends and the texts at either, each once."""
    x, y = piece_u[u], piece_v[v]
    rows = np.unique(np.stack((np.concatenate((x, x)), np.concatenate((y, y)), np.concatenate((u, v)))), axis=1)
    return rows[0], rows[1], rows[2]


def with_components(found: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``found`` (with ``node``) and each row's ``component_id`` and ``root``.

    ``nodes`` has ``node``, its least id ``first_id`` and number ``m`` of rows;
    ``roots`` has ``node, root`` of the nodes with links.
    """
    # Most nodes are alone; only those with links have a root to look up.
    grouped = nodes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("node", "m", "first_id", "root")
    least = materialise(grouped.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")))
    small = F.broadcast if least.count() <= FEW_KEYS else (lambda df: df)
    linked = grouped.join(small(least), F.col("root") == F.col("r")).select("node", "m", "component_id", "root")
    alone = nodes.join(roots.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti").select(
        "node", "m", F.col("first_id").alias("component_id"), F.col("node").alias("root")
    )
    named = materialise(linked.unionByName(alone))
    forget(least)
    return met(found, named, ["node"], FEW_KEYS)
