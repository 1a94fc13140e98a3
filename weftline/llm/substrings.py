"""Exact removal of long repeated passages, found through difference-cover anchors.

A difference cover modulo ``v`` is a set of residues such that for any two
positions some shift below ``v`` takes both onto the set. So if a window of 50
words starts at position i of one document and j of another, some anchor (20
words that start at a covered position) lies at the same place inside both.
Only a fifth of all positions is covered, and only anchors that two documents
share lead any further:

1. anchors of every document are hashed and dealt to parts by hash; those with
   two documents or more go back to their documents;
2. from each such anchor a document extends to the windows of 50 words around
   it; their hashes are dealt out the same way, and each comes back to every
   document but the smallest that has it;
3. a document's words under such windows are removed.

A mapper deals out one row for each hash and Arrow batch, whatever the number
of documents in the batch that share it, and answers those itself, so a
passage that a third of all documents share makes no large part. The number
of parts follows the number of characters. A part's own index comes from other
hash bits than those it stores, so certainty grows with the number of parts.

Defined cases: null, empty and wordless texts have no words; texts shorter
than the window keep all words; a very long text is hashed whole, at some 40
bytes a word; a null doc_id counts as the greatest long; rows that repeat a
doc_id do not remove each other's words, being no smaller; an empty table
gives an empty result; further columns, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import col, materialise, table
from weftline.llm.textbytes import texts

#: A perfect difference set modulo 31.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Characters of text whose anchors make a part.
PART_CHARS = 64_000_000
#: Ids up to this number (8 bytes each) are broadcast to keep texts that they do not name out of a shuffle.
FEW_IDS = 1_000_000
LAST = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    up = np.cumprod(np.full(n, base, np.uint64))
    down = np.cumprod(np.full(n - width + 1, pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
    x = (sums[width:] - sums[:-width]) * down
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors, ``width`` words each, at covered positions."""
    x = rolling(h, width, BASES[0])
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    at = np.flatnonzero(covered[np.arange(len(x)) % PERIOD])
    return at, x[at]


def _packed(key: np.ndarray, doc: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """``(key, docs, hashes)`` for each key, its documents in order."""
    order = np.lexsort((doc, key))
    key, doc, h = key[order], doc[order], h[order]
    cuts = _starts(key).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(key)], strict=True) if cuts else ():
        yield int(key[s]), doc[s:e].tobytes(), h[s:e].tobytes()


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucket(doc: np.ndarray, parts: int) -> np.ndarray:
    return ((doc.view(np.uint64) * np.uint64(BASES[1]) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _shared(group: np.ndarray, doc: np.ndarray, spare_least: bool) -> np.ndarray:
    """Which entries to answer: groups begin at ``group``."""
    sizes = np.diff(np.append(group, len(doc)))
    least = np.repeat(np.minimum.reduceat(doc, group), sizes)
    return doc != least if spare_least else np.repeat(np.maximum.reduceat(doc, group), sizes) != least


def shared(rows: DataFrame, hashes: Callable[..., tuple[np.ndarray, np.ndarray]], parts: int, spare_least: bool) -> DataFrame:
    """``(k, hashes)``: of each document the hashes that another has too, or a smaller one if ``spare_least``.

    ``rows`` has ``k, text`` and more that ``hashes`` takes; it returns hashes
    and the bits that choose their parts. Entries travel packed, a row for
    each batch and part, and so do answers, by buckets of documents.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, hs, ps = [], [], []
            for k, text, *more in zip(b.column(0).to_pylist(), texts(b.column(1)), *(c.to_pylist() for c in b.columns[2:]), strict=True):
                h, p = hashes(text, *more)
                docs.append(np.full(len(h), k, np.int64))
                hs.append(h)
                ps.append((p % np.uint64(parts)).astype(np.int64))
            if not sum(map(len, hs)):
                continue
            doc, h, p = np.concatenate(docs), np.concatenate(hs), np.concatenate(ps)
            order = np.lexsort((doc, h, p))
            doc, h, p = doc[order], h[order], p[order]
            group = _starts(p, h)
            # Answered here: what documents of this batch share. The rest of the
            # corpus needs to hear of its least document only.
            here = _shared(group, doc, spare_least)
            out = [(*x, True) for x in _packed(_bucket(doc[here], parts), doc[here], h[here])]
            out += [(*x, False) for x in _packed(p[group], doc[group], h[group])]
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "docs", "hashes", "done"])

    def answer(part: pa.Table) -> pa.Table:
        out, docs, hs = [], [], []
        for k, d, h, done in zip(*(part[c].to_pylist() for c in ("part", "docs", "hashes", "done")), strict=True):
            if done:
                out.append((k, d, h))
            else:
                docs.append(np.frombuffer(d, np.int64))
                hs.append(np.frombuffer(h, np.uint64))
        if docs:
            doc, h = np.concatenate(docs), np.concatenate(hs)
            order = np.argsort(h, kind="stable")
            doc, h = doc[order], h[order]
            hit = _shared(_starts(h), doc, spare_least)
            out += _packed(_bucket(doc[hit], parts), doc[hit], h[hit])
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "docs", "hashes"), cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)})

    def gather(bucket: pa.Table) -> pa.Table:
        doc = np.frombuffer(b"".join(bucket["docs"].to_pylist()), np.int64)
        h = np.frombuffer(b"".join(bucket["hashes"].to_pylist()), np.uint64)
        ks, _, hs = zip(*_packed(doc, doc, h), strict=True)
        return pa.table({"k": pa.array(ks, pa.int64()), "hashes": pa.array(hs, pa.binary())})

    dealt = rows.mapInArrow(deal, "part long, docs binary, hashes binary, done boolean")
    answered = dealt.groupBy("part").applyInArrow(answer, "bucket long, docs binary, hashes binary")
    return answered.groupBy("bucket").applyInArrow(gather, "k long, hashes binary")


def _named(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` that ``ids`` may name, and the rest (None: all are in the first)."""
    if ids.count() > FEW_IDS:
        return docs, None
    few = F.broadcast(ids.select("k"))
    return docs.join(few, "k", "left_semi"), docs.join(few, "k", "left_anti")


def remove_repeats(
    docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``; with the kept words as ``text`` on request."""
    spark = docs.sparkSession
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"the window must have at least {PERIOD} words")
    id_ = col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(LAST)).alias("k"), col(text_col).cast("string").alias("text"), id_.isNull().alias("none"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))

    def anchor_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if len(words) < window:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        h = word_hashes(words)
        at, x = anchors(h, width)
        return x, rolling(h, width, BASES[1])[at]

    def window_hashes(text: bytes, known: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if len(words) < window:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        h = word_hashes(words)
        at, x = anchors(h, width)
        hit = np.zeros(len(h) + 1, np.int64)
        hit[at[np.isin(x, np.frombuffer(known, np.uint64))] + 1] = 1
        sums = np.cumsum(hit)
        near = np.flatnonzero(sums[PERIOD : len(h) - window + 1 + PERIOD] > sums[: len(h) - window + 1])
        return rolling(h, window, BASES[0])[near], rolling(h, window, BASES[1])[near]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha, kept_text = [], [], [], []
            known = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            for text, gone in zip(texts(b.column(1)), known, strict=True):
                words = text.split()
                n = len(words)
                if gone and n >= window:
                    starts = np.isin(rolling(word_hashes(words), window, BASES[0]), np.frombuffer(gone, np.uint64))
                    edges = np.zeros(n + 1, np.int64)
                    edges[: len(starts)] += starts
                    edges[window : window + len(starts)] -= starts
                    words = [w for w, c in zip(words, np.cumsum(edges[:n]).tolist(), strict=True) if not c]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
            ids = pa.array([None if none else k for k, none in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.int64())
            cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_text, pa.string())] * with_text, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    found = materialise(shared(rows.select("k", "text"), anchor_hashes, parts, False))
    some, _ = _named(rows, found)
    repeated = materialise(shared(some.join(found, "k").select("k", "text", "hashes"), window_hashes, parts, True))
    some, rest = _named(rows, repeated)
    cut = some.join(repeated, "k", "left").select("k", "text", "none", "hashes").mapInArrow(finish, schema)
    return cut if rest is None else cut.unionByName(rest.mapInArrow(finish, schema))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Windows compared as strings.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT doc_id, word, i, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS run FROM u
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT doc_id, word, i, n = 50 AND doc_id > min(doc_id) OVER (PARTITION BY CASE WHEN n = 50 THEN sha256(run) ELSE doc_id || ' ' || i END) AS again FROM v),
c AS (SELECT doc_id, word, i, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
