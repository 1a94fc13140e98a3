"""SimHash near-duplicate detection by tiled exact comparison.

A text's fingerprint is the majority of the bits of its shingles' hashes. There
are two kinds of it, and both are compared the same way:

- ``Radius``: 64 bits over all shingles, repeats counted; texts link at
  ``radius`` or fewer differing bits;
- ``Similar``: 1,024 bits over the set of shingles; texts link at a Jaccard
  similarity of ``share`` or more. Pairs whose bits differ so little that they
  surely reach it (4.5 standard errors) are links. Pairs that may reach it
  (within 4 standard errors, and the sets' sizes allow it) are candidates,
  whose sets are then compared exactly. Sets of fewer than ``SMALL`` shingles
  have limits from the very chances of their bits, and no link of theirs is
  taken for sure. A link at exactly ``share`` is missed about three times in
  100,000, a closer one less often.

Distinct fingerprints are sorted by a population count and cut into tiles. For
``Radius`` it is that of the four 16-bit quarters: two fingerprints within the
radius have counts that differ by no more than the radius in all. For
``Similar`` it is that of the set. A pair of tiles whose ranges of counts lie
farther apart is skipped, and of other pairs only the parts of 512
fingerprints are sent and compared that have a near one on the other side;
these are compared in full with exclusive-or and bit counts.

A pair of tiles returns a spanning forest of its links, never all of them, so
a group of m near copies costs m edges for each pair of tiles. Exact copies
share a fingerprint and are one node. Candidates come back twice:

- as a minimum spanning forest between the groups that sure links make, the
  closest pair wherever two groups have candidates. These are confirmed first,
  and unite most groups;
- as blocks: pieces of up to 512 nodes of two tiles between which there are
  candidates. Blocks that still hold nodes of several groups then get their
  nodes' sets, and every pair in them is compared exactly. So no candidate is
  thinned out before it is checked, and none is written out as a pair.

The work grows with the square of the number of distinct fingerprints, less
what is skipped; memory is that of two tiles a task.

Defined cases: null, empty and wordless texts have fingerprint zero and an
empty set, and are one group; texts of fewer words than a shingle are one
shingle; a very long text is hashed in chunks; a null doc_id is kept and is no
component's smallest unless all its ids are null; repeated rows come back as
often from ``near_duplicates``, and once from ``keep_one``; an empty table
gives an empty result; other columns pass ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import FEW_KEYS, col, forget, materialise, nested, table, unnested
from weftline.llm.components import components
from weftline.llm.confirm import GOLDEN, blocks_of, confirmed, crossing, joined, lightest, linked_blocks, mixed, pieces, roots, set_name, sets_of, shingle_set, unite, with_components
from weftline.llm.textbytes import texts

SEED = 42
#: Fingerprints in a tile, and in the parts of a tile that are compared at once.
TILE = 32768
PART = 512
#: Candidates held before the forest keeps only the lightest.
PENDING = 1_000_000
#: Sets of fewer shingles have limits of their own.
SMALL = 64
#: Shingles hashed before their bits are counted, whatever the text's length.
CHUNK = 1 << 17
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text over shingles of ``words`` words, repeats counted."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    k = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros((8, 256), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        lanes = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8) + LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def wide_fingerprint(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of ``lanes`` times 64 bits of a set of hashes."""
    steps = np.arange(1, lanes + 1, dtype=np.uint64) * GOLDEN
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(shingles), 255):
        hashes = mixed(shingles[at : at + 255, None] + steps)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row a fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least sum of count differences between each range of a and each of b."""
    apart = np.maximum(lo_b[None] - hi_a[:, None], lo_a[:, None] - hi_b[None])
    return np.maximum(apart, 0).sum(axis=2)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of 64-bit words that differ in ``radius`` bits or fewer."""
    near = np.bitwise_count(a[:, None] ^ b[None]) <= radius
    return np.divmod(np.flatnonzero(near), len(b))


@dataclass(frozen=True)
class Radius:
    """Texts link if their 64-bit fingerprints differ in ``radius`` bits or fewer."""

    radius: int = 4
    words: int = 4
    lanes = 1

    def mark(self, text: bytes) -> tuple[int, int, bytes]:
        """Node, size of the set and fingerprint; the latter two are not used, the node being the fingerprint."""
        return fingerprint(text, self.words), 0, b""

    def counts(self, fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return quarters(np.ascontiguousarray(fps[:, 0]))

    def near(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        return gap(lo_a, hi_a, lo_b, hi_b) <= self.radius

    def pairs(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return within(a[:, 0], b[:, 0], self.radius)

    def apart(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of pairs, -1 for links that are sure, and which pairs count at all."""
        return np.full(len(a), -1, np.int32), np.ones(len(a), bool)


def bit_differs(x: int, y: int, both: int) -> float:
    """Chance that a SimHash bit differs between sets of sizes ``x`` and ``y`` with ``both`` shingles in common."""

    def over(n: int, common: int) -> np.ndarray:
        """Chance of a majority of ``n`` given 0, 1, ... ones among the ``common``."""
        own = np.array([comb(n - common, k) for k in range(n - common + 1)], float) / 2.0 ** (n - common)
        tail = np.concatenate((np.cumsum(own[::-1])[::-1], np.zeros(common + 1)))
        # More than half: at least n // 2 + 1, of which the common ones have some.
        return np.array([tail[max(0, n // 2 + 1 - s)] if n // 2 + 1 - s < len(tail) else 0.0 for s in range(common + 1)])

    shared = np.array([comb(both, k) for k in range(both + 1)], float) / 2.0**both
    a, b = over(x, both), over(y, both)
    return float((shared * (a * (1 - b) + b * (1 - a))).sum())


@dataclass(frozen=True)
class Similar:
    """Texts link if their sets of shingles have the Jaccard similarity ``share`` or more, as SimHash tells it."""

    share: float = 0.8
    words: int = 5
    lanes: int = 16
    #: Greatest chance of a differing bit by the sizes of two small sets that reach the similarity.
    chances: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        most = int(SMALL / self.share) + 1
        p = np.zeros((most + 1, most + 1))
        for x in range(1, SMALL):
            for y in range(x, int(x / self.share) + 1):
                both = next(c for c in range(x + 1) if 1000 * c >= round(1000 * self.share) * (x + y - c))
                p[x, y] = p[y, x] = bit_differs(x, y, both)
        object.__setattr__(self, "chances", p)

    def mark(self, text: bytes) -> tuple[int, int, bytes]:
        s = shingle_set(text, self.words)
        return set_name(s), len(s), wide_fingerprint(s, self.lanes).tobytes()

    def bits(self, n: int, errors: float, p: np.ndarray | float | None = None) -> np.ndarray:
        """Differing bits of ``n`` that two sets of the similarity have at most, that many standard errors allowed."""
        p = self.plain if p is None else p
        return np.floor(n * p + errors * np.sqrt(n * p * (1 - p)))

    def counts(self, fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return sizes.reshape(-1, 1)

    def near(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        lo_a, hi_a, lo_b, hi_b = (x[:, 0].astype(float) for x in (lo_a, hi_a, lo_b, hi_b))
        return (hi_b[None] >= self.share * lo_a[:, None] - 1e-6) & (hi_a[:, None] >= self.share * lo_b[None] - 1e-6)

    def pairs(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the first 64 bits and the sizes leave."""
        small = min(size_a.min(initial=SMALL), size_b.min(initial=SMALL)) < SMALL
        u, v = within(a[:, 0], b[:, 0], int(self.bits(64, 4.5, max(self.chances.max(), self.plain)) if small else self.bits(64, 4.5)))
        x, y = size_a[u], size_b[v]
        fit = np.minimum(x, y) >= self.share * np.maximum(x, y) - 1e-6
        return u[fit], v[fit]

    @property
    def plain(self) -> float:
        return acos(2 * self.share / (1 + self.share)) / pi

    def apart(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = 64 * self.lanes
        d = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)
        small = np.minimum(size_a, size_b) < SMALL
        at = (np.where(small, size_a, 0), np.where(small, size_b, 0))
        limit = self.bits(n, 4.0, np.where(small, self.chances[at], self.plain))
        return np.where((d <= self.bits(n, -4.5)) & ~small, np.int32(-1), d), d <= limit


Rule = Radius | Similar


def marked(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, node, size, fp)``; texts of one node are copies as far as ``rule`` can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, fp = zip(*map(rule.mark, texts(b.column(1))), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(fp, pa.binary())],
                ["doc_id", "text_hash", "node", "size", "fp"],
            )

    text = col(text_col).cast("string")
    picked = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return picked.mapInArrow(run, "doc_id long, text_hash long, node long, size int, fp binary")


@dataclass
class Tile:
    """Fingerprints in the order of their counts; parts begin at ``cuts``."""

    nodes: np.ndarray
    sizes: np.ndarray
    fps: np.ndarray

    def __post_init__(self):
        self.cuts = np.arange(0, len(self.nodes), PART)

    def ranges(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest counts of each part."""
        q = rule.counts(self.fps, self.sizes)
        return np.minimum.reduceat(q, self.cuts, axis=0), np.maximum.reduceat(q, self.cuts, axis=0)

    def taken(self, keep: np.ndarray) -> Tile:
        return Tile(self.nodes[keep], self.sizes[keep], self.fps[keep])

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return self.nodes.tobytes(), self.sizes.tobytes(), self.fps.tobytes()

    @classmethod
    def unpack(cls, nodes: bytes, sizes: bytes, fps: bytes) -> Tile:
        n = len(nodes) // 8
        return cls(np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(fps, np.uint64).reshape(n, -1))


def forest(a: Tile, b: Tile, rule: Rule, same: bool) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between two sorted tiles, or within one if ``same``.

    First a spanning forest: nodes at both ends, and distance (-1: sure). Then
    all that candidates leave open: pieces at both ends, and nodes.
    """
    nodes = a.nodes if same else np.concatenate((a.nodes, b.nodes))
    shift = 0 if same else len(a.nodes)
    parent = np.arange(len(nodes))
    piece = pieces(a.sizes) if same else np.concatenate((pieces(a.sizes), pieces(b.sizes)))
    maybe = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
    open_ = [np.empty((3, 0), np.int64)]
    near = rule.near(*a.ranges(rule), *b.ranges(rule)) if len(a.nodes) and len(b.nodes) else np.zeros((0, 0), bool)
    for i, j in zip(*np.nonzero(np.triu(near) if same else near), strict=True):
        x, y = (slice(t.cuts[k], t.cuts[k] + PART) for t, k in ((a, i), (b, j)))
        u, v = rule.pairs(a.fps[x], b.fps[y], a.sizes[x], b.sizes[y])
        u, v = u + a.cuts[i], v + b.cuts[j]
        if same and i == j:
            u, v = u[u < v], v[u < v]
        # Of pairs that are linked already nothing more is asked.
        new = roots(parent, u) != roots(parent, v + shift)
        u, v = u[new], v[new]
        if not len(u):
            continue
        d, counts = rule.apart(a.fps[u], b.fps[v], a.sizes[u], b.sizes[v])
        sure = d < 0
        unite(parent, u[sure], v[sure] + shift)
        counts &= ~sure
        if not counts.any():
            continue
        u, v, d = u[counts], v[counts] + shift, d[counts]
        open_.append(np.stack(blocks_of(u, v, piece, piece)))
        maybe = [np.concatenate(z) for z in zip(maybe, (u, v, d), strict=True)]
        if len(maybe[0]) > PENDING:
            maybe = list(lightest(parent, *maybe))
    u, v, d = lightest(parent, *maybe)
    root = roots(parent, np.arange(len(nodes)))
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    left = np.unique(np.concatenate(open_, axis=1), axis=1)
    edges = nodes[np.concatenate((linked, u))], nodes[np.concatenate((root[linked], v))], np.concatenate((np.full(len(linked), -1, np.int32), d))
    return edges, (left[0], left[1], nodes[left[2]])


def tiles_of(nodes: DataFrame, rule: Rule) -> DataFrame:
    """``(tile, lo, hi, nodes, sizes, fps)``: the distinct fingerprints by their counts, ``TILE`` in a row."""
    n = nodes.count()
    if isinstance(rule, Radius):
        order = [F.bit_count(F.shiftrightunsigned("node", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    else:
        order = [F.col("size")]
    ranged = nodes.select("node", "size", "fp").repartitionByRange(max(1, -(-n // TILE)), *order, "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b"".join(b.column(2).to_pylist())) for b in batches]
        if not sum(len(x[0]) for x in got):
            return
        names, sizes = np.concatenate([x[0] for x in got]).astype(np.int64), np.concatenate([x[1] for x in got]).astype(np.int32)
        fps = names.tobytes() if isinstance(rule, Radius) else b"".join(x[2] for x in got)
        every = Tile.unpack(names.tobytes(), sizes.tobytes(), fps)
        q = rule.counts(every.fps, every.sizes)
        every = every.taken(np.lexsort((every.nodes, *q.T[::-1])))
        for k, at in enumerate(range(0, len(every.nodes), TILE)):
            tile = every.taken(np.arange(at, min(at + TILE, len(every.nodes))))
            lo, hi = tile.ranges(rule)
            cols = [(TaskContext.get().partitionId() << 20) + k, lo.min(axis=0).tolist(), hi.max(axis=0).tolist(), *tile.pack()]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], ["tile", "lo", "hi", "nodes", "sizes", "fps"])

    return ranged.mapInArrow(cut, "tile long, lo array<int>, hi array<int>, nodes binary, sizes binary, fps binary")


def links(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Edges ``(a, b, d, block)`` that join the ``node, size, fp`` that ``rule`` links, transitively; where ``d`` is not -1 the link may be.

    Rows with a ``block`` say instead that node ``a`` has candidates in it.
    """
    tiles = materialise(tiles_of(nodes, rule))
    # Names and count ranges of the tiles: one small row for each 32,768 fingerprints.
    known = tiles.select("tile", "lo", "hi").orderBy("tile").collect()
    names = np.array([r[0] for r in known], np.int64)
    lo, hi = (np.array([r[k] for r in known], np.int32).reshape(len(known), 4 if isinstance(rule, Radius) else 1) for k in (1, 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, tile = int(np.searchsorted(names, name)), Tile.unpack(*packed)
                others = np.flatnonzero(rule.near(lo[at : at + 1], hi[at : at + 1], lo, hi)[0])
                ranges = tile.ranges(rule)
                # The parts that may have a partner in each of the other tiles.
                near = rule.near(*ranges, lo[others], hi[others])
                for k, o in enumerate(others):
                    some = tile.taken(np.repeat(near[:, k], PART)[: len(tile.nodes)])
                    cols = [min(at, o), max(at, o), at, *some.pack()]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], ["i", "j", "at", "nodes", "sizes", "fps"])

    def compare(pair: pa.Table) -> pa.Table:
        got = {k: Tile.unpack(*x) for k, *x in zip(*(pair[c].to_pylist() for c in ("at", "nodes", "sizes", "fps")), strict=True)}
        i, j = min(got), max(got)
        (a, b, d), (x, y, node) = forest(got[i], got[j], rule, i == j)
        names = [f"{i}:{j}:{s}:{t}" for s, t in zip(x.tolist(), y.tolist(), strict=True)]
        none = [None] * len(names)
        return pa.table({
            "a": pa.array(np.concatenate((a, node)), pa.int64()), "b": pa.array(b.tolist() + none, pa.int64()),
            "d": pa.array(d.tolist() + none, pa.int32()), "block": pa.array([None] * len(a) + names, pa.string()),
        })

    dealt = tiles.select("tile", "nodes", "sizes", "fps").mapInArrow(deal, "i long, j long, at long, nodes binary, sizes binary, fps binary")
    return dealt.groupBy("i", "j").applyInArrow(compare, "a long, b long, d int, block string")


def _roots_of(docs: DataFrame, found: DataFrame, links: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``(node, root)``, written, of the nodes with links."""
    edges, members = links.where("block IS NULL"), links.where("block IS NOT NULL").select("block", F.col("a").alias("node"))
    known = materialise(components(edges.where("d < 0").select("a", "b")))
    if isinstance(rule, Radius):
        return known
    a, b = (known.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
    asked = edges.where("d >= 0").join(a, "a", "left").join(b, "b", "left")
    asked = materialise(asked.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").distinct())
    if asked.isEmpty():
        return known
    sets = sets_of(docs, found, asked.select(F.col("a").alias("node")).union(asked.select(F.col("b").alias("node"))), rule.words, id_col, text_col)
    known = joined(known, confirmed(asked, sets, rule.share))
    forget(sets)
    # What is still open between groups is compared in full.
    left = materialise(crossing(members, known))
    if left.isEmpty():
        return known
    sets = sets_of(docs, found, left, rule.words, id_col, text_col)
    known = joined(known, linked_blocks(left, sets, rule.share))
    forget(left, sets)
    return known


def near_duplicates(docs: DataFrame, rule: Rule = Radius(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, node, component_id, root)`` for every row of ``docs``; ``root`` is the component's least node.

    With ``Radius`` the node is the fingerprint's bits as a signed long.
    """
    found = materialise(marked(docs, rule, id_col, text_col))
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m"))
    if isinstance(rule, Radius):
        nodes = materialise(nodes.withColumns({"size": F.lit(0), "fp": F.lit(b"")}))
    else:
        nodes = materialise(nodes.join(found.select(F.col("node").alias("n"), "size", "fp").dropDuplicates(["n"]), F.col("node") == F.col("n")).drop("n"))
    pairs = materialise(links(nodes, rule))
    named = with_components(found.select("doc_id", "text_hash", "node"), nodes, _roots_of(docs, found, pairs, rule, id_col, text_col))
    forget(nodes, pairs)
    return named.select("doc_id", "text_hash", "node", "component_id", "root")


def keep_one(docs: DataFrame, rule: Rule = Similar(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest doc_id of each component (null ids last, then by text hash), with all its columns.

    Rows that repeat both id and text are one document; any one of them stays.
    """
    found = near_duplicates(docs, rule, id_col=id_col, text_col=text_col)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    counted = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = counted.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), first).alias("b"))
    best = materialise(best.select(F.col("b.doc_id").alias("id"), F.col("b.text_hash").alias("t"), F.col("b.n").alias("n")))
    n, repeats = best.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    small = F.broadcast if n <= FEW_KEYS else (lambda df: df)
    rows = docs.select(nested(docs), col(id_col).cast("long").alias("own_id"), F.xxhash64(col(text_col).cast("string")).alias("own_t"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_t") == F.col("t"))
    single = rows.join(small(best.where("n = 1").select("id", "t")), same, "left_semi").select(*unnested(docs))
    if not repeats:
        return single
    several = rows.join(small(best.where("n > 1").select("id", "t")), same).dropDuplicates(["id", "t"])
    return single.unionByName(several.select(*unnested(docs)))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
