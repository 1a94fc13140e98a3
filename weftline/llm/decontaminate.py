"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask names the token positions of a short span that count; the others are
ignored, so a substituted word there does not spoil the seed. Seeds of all
benchmark items are joined with those at every position of every document. A
hit aligns an item with a document, and the aligned tokens are compared: there
is an overlap if a stretch of ``STRETCH`` tokens (the whole item or the whole
document if it is shorter) has at least four fifths of its tokens equal.

Masks come by the size of the stretch. Those of a size together hit every way
to place the substitutions that the rule allows in such a stretch, so no
overlap is missed (a test enumerates the ways). A stretch of up to four tokens
may have no substitution and is its own seed. Documents shorter than an item
have seeds of their own, which bear the document's size, so that long texts
never meet the seeds of short ones.

Only hits are joined further, as document, item and alignment: a seed carries
no tokens, and the tokens of a document are fetched once for all its hits. The
seeds are broadcast while there are few of them (their number is checked), so
documents are not shuffled; beyond that both sides are joined by seed.

Tokens are lower-cased runs of anything but ASCII controls, blanks and
punctuation. Defined cases: null and empty texts have no tokens and match
nothing; a document shorter than an item matches it if it lies wholly inside; a
very long text costs a row for each mask and position, of 30 bytes;
null ids are kept as null; repeated rows of either side give one result row; no
overlap, and an empty table on either side, give an empty result; several
items in one document give a row each. ``clean_documents`` keeps all columns,
whatever their names, and documents whose overlaps are all of fewer than
``LEAST_TOKENS`` tokens, which any text may hold by chance; ``too_short`` tells
the items of which that is true everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import col, materialise, nested, table, unnested

STRETCH = 16
SHARE = 0.8
#: Tokens of a stretch for which a document is dropped.
LEAST_TOKENS = 8
#: Masks for items from as many tokens on.
MASKS: dict[int, tuple[str, ...]] = {
    16: ("1111011", "1110111", "111000001011"), 10: ("111011", "11111", "11001011"), 7: ("11011",), 5: ("111", "1101"),
    4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",),
}
#: Seeds up to this number (about 30 bytes each) are broadcast.
FEW_SEEDS = 2_000_000
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), BETWEEN), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(size: int) -> tuple[str, ...]:
    """The masks for an item of ``size`` tokens."""
    return MASKS[max(k for k in MASKS if k <= size)]


def seeds(hashed: DataFrame, kinds: list[tuple[int, int, str]], keep: list[str]) -> DataFrame:
    """``pos, kind, seed`` for every position of the array ``h`` and kind, with the columns ``keep``; the array is left behind.

    A kind is a number, a document size (0: any) and a mask. Where ``hashed``
    has ``m``, kinds with a size are those of rows of that size only.
    """
    at = lambda k: F.get("h", F.col("pos") + F.lit(k))
    sized = ["m"] if "m" in hashed.columns else []
    found = []
    for n, size, mask in kinds:
        fits = F.col("pos") + F.lit(len(mask)) <= F.size("h")
        fits = fits & (F.col("m") == size) if sized and size else fits
        found.append(F.when(fits, F.xxhash64(F.lit(n), *[at(k) for k, c in enumerate(mask) if c == "1"])))
    # Outer, lest a filter on the size of ``h`` be derived that computes it twice.
    each = hashed.select(*keep, *sized, "h", F.posexplode_outer("h").alias("pos", "token"))
    numbers = F.array(*[F.lit(n) for n, *_ in kinds])
    seeded = each.select(*keep, "pos", F.posexplode_outer(F.array(*found)).alias("place", "seed")).where("seed IS NOT NULL")
    return seeded.select(*keep, "pos", F.get(numbers, F.col("place")).alias("kind"), "seed")


def _overlap(pairs: DataFrame, stretch: int) -> DataFrame:
    """Those of ``pairs`` whose aligned tokens ``here`` and ``there`` hold a stretch with enough equal ones, with its length ``tokens``.

    ``size`` is the item's, ``m`` the document's.
    """
    win = F.least(F.lit(stretch), F.col("size"), F.col("m"))
    equal = F.zip_with("here", "there", lambda a, b: (a == b).cast("int"))
    starts = F.sequence(F.lit(0), F.size("equal") - win)
    enough = F.exists(starts, lambda s: F.aggregate(F.slice("equal", s + 1, win), F.lit(0), lambda t, x: t + x) >= F.ceil(win * F.lit(SHARE)))
    held = pairs.withColumns({"equal": equal, "tokens": win}).where((F.size("equal") >= win))
    return held.where((F.aggregate("equal", F.lit(0), lambda t, x: t + x) >= F.ceil(win * F.lit(SHARE))) & enough)


def measured(
    docs: DataFrame, benchmark: DataFrame, *, stretch: int = STRETCH,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, tokens)``: every document and item that overlap, once for each length of the stretch that counts."""
    if not 1 <= stretch <= max(MASKS):
        raise ValueError(f"the masks are made for stretches of up to {max(MASKS)} tokens")
    told = F.col("h").isNotNull() & (F.size("h") > 0)
    items = materialise(
        benchmark.select(col(item_col).alias("item_id"), token_hashes(col(item_text_col).cast("string")).alias("h")).where(told).distinct()
        .withColumn("item", F.monotonically_increasing_id())
    )
    # At most as many sizes as a stretch has tokens.
    size = F.least(F.size("h"), F.lit(stretch))
    sizes = [r[0] for r in items.select(size).distinct().collect()]
    kinds = [(0, m) for m in sorted({m for n in sizes for m in masks_of(n)})] + [(w, m) for w in range(1, max(sizes, default=0)) for m in masks_of(w)]
    kinds = [(n, *k) for n, k in enumerate(kinds)]
    if not kinds:
        return docs.select(col(id_col).alias("doc_id")).join(items.select("item_id", F.lit(0).alias("tokens")), F.lit(False))
    # What an item is found by: the masks of its size, and for each smaller size those of documents that have it.
    own = {n: [k for k, w, m in kinds if (m in masks_of(n) if w == 0 else w < n)] for n in sizes}
    wanted = F.create_map(*[x for n in sizes for x in (F.lit(n), F.array(*[F.lit(k) for k in own[n]]))])
    known = materialise(
        seeds(items.withColumns({"n": F.size("h"), "own": wanted[size]}), kinds, ["item", "n", "own"]).where(F.array_contains("own", F.col("kind")))
        .select("item", "n", F.col("pos").alias("ipos"), F.col("seed").alias("iseed"), F.col("kind").alias("ikind"))
    )
    small = F.broadcast if known.count() <= FEW_SEEDS else (lambda df: df)
    text = col(text_col).cast("string")
    key = [col(id_col).alias("doc_id"), F.xxhash64(text).alias("t")]

    def hits_of(rows: DataFrame, sized: bool) -> DataFrame:
        """Documents' seeds joined with those of the same kinds only: the seeds for short documents are many, and would slow long ones down."""
        some = [k for k in kinds if bool(k[1]) == sized]
        theirs = known.where(F.col("ikind").isin([k[0] for k in some])).drop("ikind")
        return seeds(rows, some, ["doc_id", "t"]).join(small(theirs), F.col("seed") == F.col("iseed"))

    hits = hits_of(docs.select(*key, token_hashes(text).alias("h")), False)
    if any(k[1] for k in kinds):
        # Of a long text only the beginning is looked at to see that it is no short one, which has a blank end at most on either side.
        short = docs.where(F.size(F.split(text, BETWEEN, stretch + 2)) <= stretch + 1)
        hits = hits.unionByName(hits_of(short.select(*key, token_hashes(text).alias("h")).withColumn("m", F.size("h")), True))
    # An alignment begins at the same place of the document whichever seed found it.
    aligned = materialise(hits.select("doc_id", "t", "item", "n", (F.col("pos") - F.col("ipos")).alias("at")).distinct())
    of_doc = aligned.groupBy("doc_id", "t").agg(F.collect_list(F.struct("item", "n", "at")).alias("hits")).select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "hits")
    of_doc = materialise(of_doc)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt"))
    few = F.broadcast(of_doc.select("d", "dt")) if of_doc.count() <= FEW_SEEDS else of_doc.select("d", "dt")
    rows = docs.select(*key, text.alias("text")).join(few, same, "left_semi").dropDuplicates(["doc_id", "t"])
    found = rows.join(of_doc, same).select("doc_id", token_hashes(F.col("text")).alias("h"), "hits")
    # What of the document lies beside the item, from the item's token ``skip`` on.
    first, skip = (lambda x: F.greatest(x["at"], F.lit(0))), (lambda x: F.greatest(-x["at"], F.lit(0)))
    beside = F.transform("hits", lambda x: F.struct(
        x["item"].alias("item"), x["n"].alias("size"), skip(x).alias("skip"), F.slice("h", first(x) + 1, x["n"] - skip(x)).alias("here")
    ))
    each = found.select("doc_id", F.size("h").alias("m"), F.explode(beside).alias("x")).select("doc_id", "m", "x.*")
    pairs = each.join(small(items.select(F.col("item").alias("it"), "item_id", F.col("h").alias("ih"))), F.col("item") == F.col("it"))
    pairs = pairs.withColumn("there", F.slice("ih", F.col("skip") + 1, F.size("here")))
    return _overlap(pairs, stretch).select("doc_id", "item_id", "tokens").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id)``: every document and item that overlap, once; options are those of ``measured``."""
    return measured(docs, benchmark, **options).select("doc_id", "item_id").distinct()


def too_short(benchmark: DataFrame, *, least_tokens: int = LEAST_TOKENS, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, tokens)`` of the items for which no document is dropped, being of fewer tokens."""
    sized = benchmark.select(col(item_col).alias("item_id"), F.greatest(F.size(token_hashes(col(item_text_col).cast("string"))), F.lit(0)).alias("tokens"))
    return sized.where(F.col("tokens") < least_tokens)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, least_tokens: int = LEAST_TOKENS, **options) -> DataFrame:
    """``docs`` without those that overlap a benchmark item in a stretch of ``least_tokens`` or more; rows with a null id are judged together."""
    id_col = options.get("id_col", "doc_id")
    bad = materialise(measured(docs, benchmark, **options).where(F.col("tokens") >= least_tokens).select(F.col("doc_id").alias("bad")).distinct())
    if bad.count() <= FEW_SEEDS:
        bad = F.broadcast(bad)
    rows = docs.select(nested(docs), col(id_col).alias("own_id"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad")), "left_anti").select(*unnested(docs))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Without seeds: every alignment with as many equal tokens as a stretch needs is looked at.
OP8_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM benchmark),
du AS (SELECT doc_id, generate_subscripts(t, 1) AS p, unnest(t) AS w FROM d), bu AS (SELECT item_id, generate_subscripts(t, 1) AS q, unnest(t) AS w FROM b),
h AS (SELECT doc_id, item_id, p - q AS diag, list(q ORDER BY q) AS qs FROM du JOIN bu ON du.w = bu.w GROUP BY ALL),
y AS (SELECT h.*, len(b.t) AS n, len(d.t) AS m, least({STRETCH}, len(b.t), len(d.t)) AS win FROM h JOIN b ON h.item_id = b.item_id JOIN d ON h.doc_id = d.doc_id),
x AS (SELECT *, ceil(win * {SHARE}) AS need FROM y WHERE len(qs) >= ceil(win * {SHARE}))
SELECT DISTINCT doc_id, item_id FROM x WHERE len(list_filter(range(greatest(1, 1 - diag), least(n, m - diag) - win + 2),
  lambda s: len(list_filter(qs, lambda q: q BETWEEN s AND s + win - 1)) >= need)) > 0
"""
