"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A run that repeats goes if it has ``RUN`` lines or ``PASSAGE`` words. Every
window, that is every shortest stretch of lines that is long enough by either
measure, selects its least line hash (the leftmost of equal ones) as its
fingerprint, so a run long enough to go is certain to select the same line in
both places. Then:

1. only the selected positions are sent out, by fingerprint; those whose
   fingerprint stands at one position are done with;
2. a position whose fingerprint repeats is joined with the first position that
   reads the same, extended from the fingerprint to the left and to the right
   as far as the windows go that selected it. Its neighbours select
   fingerprints no farther apart than a window, so these carry a longer match
   on, in both directions, to where it ends;
3. all lines of a match that stands earlier are deleted.

A passage in m documents costs m rows this way, never m squared pairs. A
fingerprint or match that very many positions share is told to every task
(at most ``HOT`` of ``common`` such keys) instead of gathering its positions in one.

Lines are what ``\\n`` parts. Lines without a word do not count, and stay
unless they lie inside a deleted run. "Before" means a smaller doc_id, or an
earlier line of the same document.

Defined cases: a null text has no lines and stays null; an empty one stays
empty; a very long text is a long array of its lines' hashes (about 60 bytes a
line), its words being read once; a null doc_id counts as larger than any
other; rows that repeat a doc_id with other text come in the order of the
texts' hashes, and rows that repeat both are treated alike; an empty table
gives an empty result; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import HOT, col, count_words, materialise, met, table

RUN = 3
#: Words from which a repeated run of fewer lines goes too.
PASSAGE = 50
#: Keys up to this number (16 to 40 bytes each) are broadcast, so that texts and windows are not shuffled.
FEW_KEYS = 200_000


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Order of documents: by id, null last, then by the hash of the text."""
    id_ = col(id_col).cast("long")
    return [F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id")).alias("k"), F.xxhash64(col(text_col).cast("string")).alias("t")]


def _hashed(text: Column) -> Column:
    """Of each line that holds a word: its place among all lines, two hashes (one selects, both identify), and its number of words."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(
        i.alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("h2"), count_words(x).alias("n")
    ))
    return F.filter(every, lambda s: s["n"] > 0)


def _windows(run: int, passage: int) -> tuple[Column, Column]:
    """The column ``spots``, and from it and the arrays ``h``, ``h2`` and ``n`` the windows.

    Each has the position it selects and a hash of what stands left of that, and right of it.

    A window of which every line is long enough alone is left to those lines.
    """
    size = F.size("h")
    spots = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def window(p: Column, length: int) -> Column:
        held = [F.get("n", p + k) for k in range(length)]
        fits = p + length <= size
        if length < run:
            fits &= sum(held[1:], held[0]) >= passage
        if length > 1:
            fits &= ~(F.least(*held) >= passage)
        return F.when(fits, F.struct(F.lit(length).alias("n"), F.array_min(F.slice("spots", p + 1, F.lit(length))).alias("x")))

    def around(p: Column, w: Column) -> Column:
        i = w["x"]["i"]
        return F.struct(
            p.alias("p"), w["n"].alias("n"), w["x"]["h"].alias("fp"), i.alias("at"),
            F.xxhash64(F.slice("h2", p + 1, i - p)).alias("left"), F.xxhash64(F.slice("h2", i + 1, p + w["n"] - i)).alias("right"),
        )

    def starting(p: Column) -> Column:
        fit = F.array_compact(F.array(*[window(p, k) for k in range(1, run + 1)]))
        return F.transform(fit, lambda w: around(p, w))

    return spots, F.flatten(F.transform(F.sequence(F.lit(0), size - 1), starting))


def repeated_runs(docs: DataFrame, run: int = RUN, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k, t, cuts)``: of each text with deletions the stretches ``from, to`` of places to delete, in order, one for each line with a word."""
    lines = docs.select(*_key(docs, id_col, text_col), _hashed(col(text_col).cast("string")).alias("s")).dropDuplicates(["k", "t"])
    split = lines.where(F.size("s") > 0).select("k", "t", *[F.col(f"s.{a}").alias(b) for a, b in (("at", "ats"), ("h", "h"), ("h2", "h2"), ("n", "n"))])
    spots, windows = _windows(run, passage)
    texts = materialise(split.withColumn("spots", spots).select("k", "t", "ats", windows.alias("windows")))

    # Windows in order select in order, but for a few; a position told twice does no harm.
    new = F.filter("windows", lambda w, j: F.coalesce(F.get("windows", j - 1)["at"] != w["at"], F.lit(True)))
    chosen = F.transform(new, lambda w: F.struct(w["fp"].alias("fp"), w["at"].alias("at")))
    positions = texts.select("k", "t", F.explode(chosen).alias("x")).select("k", "t", "x.*")
    spot = F.struct("k", "t", "at")
    # Counted before the shuffle.
    twice = positions.groupBy("fp").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("m")).where("a <> b")
    twice = materialise(twice.select("fp", "m"))
    each = texts.select("k", "t", F.explode("windows").alias("w")).select("k", "t", "w.p", "w.n", "w.fp", "w.left", "w.right")
    followed = materialise(met(each, twice, ["fp"], FEW_KEYS, HOT))

    here = F.struct("k", "t", "p")
    match = ["fp", "left", "right"]
    firsts = materialise(
        followed.groupBy(*match).agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count("*").alias("m")).where("first <> last").drop("last")
    )
    later = met(followed, firsts, match, FEW_KEYS, HOT).where(here > F.col("first"))
    # A line of a match, and whether what stands between it and the next one goes as well.
    gone = F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("i")
    marks = later.select("k", "t", "p", "n", gone).select("k", "t", F.struct("i", (F.col("i") < F.col("p") + F.col("n") - 1).alias("on")).alias("x"))
    marked = marks.groupBy("k", "t").agg(F.sort_array(F.collect_set("x")).alias("x"))
    last_of = F.filter("x", lambda x, j: F.coalesce(F.get("x", j + 1)["i"] != x["i"], F.lit(True)))
    cut = F.transform("x", lambda x: F.struct(
        F.get("ats", x["i"]).alias("from"), F.when(x["on"], F.get("ats", x["i"] + 1) - 1).otherwise(F.get("ats", x["i"])).alias("to")
    ))
    told = marked.select("k", "t", last_of.alias("x"))
    return texts.select("k", "t", "ats").join(told, ["k", "t"]).select("k", "t", cut.alias("cuts"))


def _kept_text(text: Column) -> Column:
    """The text without the lines under ``cuts``: slices between deleted stretches, joined again."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    after = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["to"] + 1))
    before = F.concat(F.transform("cuts", lambda c: c["from"]), F.array(n))
    spans = F.filter(F.zip_with(after, before, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda s: s["n"] > 0)
    return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["n"]))), "\n")


def dedup_lines(docs: DataFrame, *, run: int = RUN, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeated runs cut from the text, and ``lines_removed`` (replaced if it was there)."""
    hits = repeated_runs(docs, run, passage, id_col, text_col).select(F.col("k").alias("hk"), F.col("t").alias("ht"), "cuts")
    hits = materialise(hits)
    names = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(F.struct(*[col(c) for c in names]).alias("row"), *_key(docs, id_col, text_col))
    same = (F.col("k") == F.col("hk")) & (F.col("t") == F.col("ht"))
    text = F.col("row").getField(text_col).cast("string")

    def out(df: DataFrame, new: Column, gone: Column) -> DataFrame:
        cols = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
        return df.select(*cols, gone.cast("long").alias("lines_removed"))

    cut = F.when(F.col("cuts").isNull(), text).otherwise(_kept_text(text))
    gone = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts"))
    if hits.count() > FEW_KEYS:
        return out(rows.join(hits, same, "left"), cut, gone)
    few = F.broadcast(hits.select("hk", "ht"))
    some = rows.join(few, same, "left_semi").join(hits, same)
    return out(some, cut, gone).unionByName(out(rows.join(few, same, "left_anti"), text, F.lit(0)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "lines_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


#: Runs of three lines, and of one or two with 50 words, by content and without fingerprints: what is left must be the same.
OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS at_, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (SELECT doc_id, i, at_, words, line AS l1, lead(line) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(at_) OVER d AS at2, lead(at_, 2) OVER d AS at3, lead(words) OVER d AS words2
      FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, at_, at_ AS end_, l1, NULL AS l2, NULL AS l3 FROM x WHERE words >= 50
      UNION ALL SELECT doc_id, i, at_, at2, l1, l2, NULL FROM x WHERE words + words2 >= 50
      UNION ALL SELECT doc_id, i, at_, at3, l1, l2, l3 FROM x WHERE l3 IS NOT NULL),
f AS (SELECT doc_id, i, at_, end_, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT DISTINCT l.doc_id, l.at_ FROM f JOIN l ON f.doc_id = l.doc_id AND l.at_ BETWEEN f.at_ AND f.end_ WHERE again),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.at_) FILTER (g.at_ IS NULL) AS kept,
        count(*) FILTER (g.at_ IS NOT NULL AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS gone
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.at_ = g.at_ GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(gone, 0)::BIGINT AS lines_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept, '')) END::BIGINT AS kept_chars,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
