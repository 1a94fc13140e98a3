"""Queries on deduplication, de-leaking, translation memories, set operations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import corpus, ordering
from weftline.operators import training as R
from weftline.plans import tables as P


def _docs(spark, sf_dir, split):
    return P.table(spark, sf_dir, "documents").where(P.split_of(F.col("doc_id")) == split)


def dedup_exact(spark, sf_dir):
    return corpus.first_of_each(P.table(spark, sf_dir, "documents"), ["lang", "text"], "doc_id", ["lang"])


def deleak(spark, sf_dir):
    train = _docs(spark, sf_dir, "train").select("doc_id", "lang", "text")
    held = _docs(spark, sf_dir, "dev").select("lang", "text").union(_docs(spark, sf_dir, "test").select("lang", "text"))
    return corpus.without_leaks(train, held, ["lang", "text"]).select("doc_id", "lang")


def tm_build(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("lang"), F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("tgt"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
    )
    return corpus.translation_memory(rows, ["lang", "src"], "tgt", F.col("ordinal"))


def _memory(spark, sf_dir):
    train = P.pairs(spark, sf_dir).where("split = 'train'")
    return corpus.translation_memory(train, ["src"], "tgt", F.col("conv_id") * 1000 + F.col("turn"))


def tm_coverage(spark, sf_dir):
    held = P.pairs(spark, sf_dir).where("split <> 'train'")
    return corpus.coverage(held, _memory(spark, sf_dir), ["src"], "split")


def tm_apply(spark, sf_dir):
    held = P.pairs(spark, sf_dir).where("split <> 'train'").withColumn("id", F.concat_ws("-", "conv_id", "turn")).select("id", "src", "tgt")
    hyps = held.where(F.length("tgt") % 2 == 0).select("id", F.concat(F.lit("> "), "tgt").alias("hyp"))
    return corpus.apply_memory(held.select("id", "src"), _memory(spark, sf_dir), hyps, ["src"], "id")


def tm_diagnostics(spark, sf_dir):
    return corpus.text_diagnostics(tm_apply(spark, sf_dir))


def id_reconcile(spark, sf_dir):
    return corpus.reconcile(P.table(spark, sf_dir, "documents"), P.table(spark, sf_dir, "labels"), "doc_id")


def tag_combined(spark, sf_dir):
    rows = corpus.combined(P.table(spark, sf_dir, "documents"), P.LANGS, "lang", "text", "doc_id")
    return rows.select("block", "doc_id", F.md5("tagged").alias("tagged_md5"))


def spm_lines(spark, sf_dir):
    rows = corpus.alternating_lines(P.pairs(spark, sf_dir).where("split = 'train'"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "line")


def set_operations(spark, sf_dir):
    dev, test, train = (_docs(spark, sf_dir, s) for s in ("dev", "test", "train"))
    bag = dev.unionByName(test)
    one = lambda df, name: df.select(F.lit(name).alias("what"), F.col("n"))
    n = lambda df: df.agg(F.count("*").alias("n"))
    texts = lambda df: df.select("text")
    return (
        one(n(bag), "bag").unionByName(one(n(texts(bag).distinct()), "distinct"))
        .unionByName(one(n(texts(train).subtract(texts(bag))), "subtract"))
        .unionByName(one(n(texts(train).exceptAll(texts(bag))), "except_all"))
        .unionByName(one(n(texts(dev).intersect(texts(train))), "intersect"))
    )


def languages_sorted(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang")


def sample_seeded(spark, sf_dir):
    return ordering.seeded_sample(P.table(spark, sf_dir, "documents"), "doc_id", 100, 7).select("doc_id")


def holdout_split(spark, sf_dir):
    held, rest = ordering.holdout_split(P.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 13)
    return held.withColumn("part", F.lit("holdout")).unionByName(rest.withColumn("part", F.lit("train")))


def head_and_stride(spark, sf_dir):
    docs = ordering.global_rank(P.table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], "ordinal")
    head = ordering.head_by_ordinal(docs, 16).withColumn("how", F.lit("head"))
    return head.unionByName(ordering.stride(docs, docs.count(), 20).withColumn("how", F.lit("stride"))).select("how", "doc_id")


def first_per_language(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select("lang", "doc_id")
    return ordering.top_per_group(docs, ["lang"], [F.col("doc_id")], 32)


def shifted_references(spark, sf_dir):
    rows = P.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), "text")
    return ordering.rotated(rows, "text").select("ordinal", F.md5("shifted").alias("shifted_md5"))


def leaderboard(spark, sf_dir):
    rows = P.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.orderBy(F.desc("total"), "o_orderpriority").limit(3)


def vocabulary_coverage(spark, sf_dir):
    word = lambda t: P.table(spark, sf_dir, t).select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''")
    return R.vocabulary_coverage(word("benchmark"), word("conversations"), "w")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_exact, deleak, tm_build, tm_coverage, tm_apply, tm_diagnostics, id_reconcile, tag_combined, spm_lines, set_operations, languages_sorted,
        sample_seeded, holdout_split, head_and_stride, first_per_language, shifted_references, leaderboard, vocabulary_coverage,
    )
}

DOCS = f"d AS (SELECT *, {P.SPLIT.format('doc_id')} AS split FROM documents)"
MEMORY = f"""{P.PAIRS}, counted AS (SELECT src, tgt, count(*) AS n, min(conv_id * 1000 + turn) AS first FROM pairs WHERE split = 'train' GROUP BY ALL),
  memory AS (SELECT src, tgt, n FROM counted QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, first) = 1)"""

APPLIED = """applied AS (SELECT conv_id || '-' || turn AS id, w.src, """ + P.sql_squeeze("coalesce(m.tgt, CASE WHEN length(w.tgt) % 2 = 0 THEN '> ' || w.tgt END, '')") + """ AS text,
        CASE WHEN m.tgt IS NOT NULL THEN 'memory' WHEN length(w.tgt) % 2 = 0 THEN 'hypothesis' ELSE 'missing' END AS origin
        FROM pairs w LEFT JOIN memory m ON w.src = m.src WHERE split <> 'train')"""

ORACLES = {
    "dedup_exact": "SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, text",
    "deleak": f"""WITH {DOCS} SELECT doc_id, lang FROM d WHERE split = 'train' AND NOT EXISTS (
        SELECT 1 FROM d e WHERE e.split <> 'train' AND e.lang = d.lang AND e.text = d.text)""",
    "tm_build": """WITH c AS (SELECT l_linestatus AS lang, l_partkey AS src, l_returnflag AS tgt, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
        SELECT lang, src, tgt, n FROM c QUALIFY row_number() OVER (PARTITION BY lang, src ORDER BY n DESC, f) = 1""",
    "tm_coverage": f"""WITH {MEMORY} SELECT split, count(*) AS records, count(m.src) AS hits, round(100.0::DOUBLE * count(m.src) / count(*), 2) AS pct
        FROM pairs w LEFT JOIN memory m ON w.src = m.src WHERE split <> 'train' GROUP BY split""",
    "tm_apply": f"WITH {MEMORY}, {APPLIED} SELECT * FROM applied",
    "tm_diagnostics": f"""WITH {MEMORY}, {APPLIED} SELECT count(*) AS rows, count(*) FILTER (origin = 'memory') AS memory_hits,
        count(*) FILTER (origin = 'missing') AS missing, count(*) FILTER (text = '') AS empty FROM applied""",
    "id_reconcile": """SELECT 'missing' AS side, doc_id AS id FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
        UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)""",
    "tag_combined": """SELECT list_position(['en', 'fr', 'de', 'es'], lang)::BIGINT - 1 AS block, doc_id, md5('<2' || lang || '> ' || text) AS tagged_md5
        FROM documents""",
    "spm_lines": f"""WITH {P.PAIRS} SELECT conv_id, turn, 0::BIGINT AS pos, replace(src, chr(10), ' ') AS line FROM pairs WHERE split = 'train'
        UNION ALL SELECT conv_id, turn, 1, replace(tgt, chr(10), ' ') FROM pairs WHERE split = 'train'""",
    "set_operations": f"""WITH {DOCS}, bag AS (SELECT text FROM d WHERE split <> 'train'), tr AS (SELECT text FROM d WHERE split = 'train')
        SELECT 'bag' AS what, count(*) AS n FROM bag UNION ALL SELECT 'distinct', count(DISTINCT text) FROM bag
        UNION ALL SELECT 'subtract', count(*) FROM (SELECT text FROM tr EXCEPT SELECT text FROM bag)
        UNION ALL SELECT 'except_all', count(*) FROM (SELECT text FROM tr EXCEPT ALL SELECT text FROM bag)
        UNION ALL SELECT 'intersect', count(*) FROM (SELECT text FROM d WHERE split = 'dev' INTERSECT SELECT text FROM tr)""",
    "languages_sorted": "SELECT DISTINCT lang FROM documents ORDER BY lang",
    "sample_seeded": "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100",
    "holdout_split": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) <= 100 THEN 'holdout' ELSE 'train' END AS part FROM documents""",
    "head_and_stride": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents)
        SELECT 'head' AS how, doc_id FROM r WHERE o < 16 UNION ALL
        SELECT 'stride', doc_id FROM r WHERE o % greatest(n // 20, 1) = 0 AND o < greatest(n // 20, 1) * 20""",
    "first_per_language": "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 32",
    "shifted_references": """SELECT item_id AS ordinal, md5(coalesce(lead(text) OVER (ORDER BY item_id), first(text) OVER (ORDER BY item_id))) AS shifted_md5 FROM benchmark""",
    "leaderboard": "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, 1 LIMIT 3",
    "vocabulary_coverage": """WITH b AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), c AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM conversations)
        SELECT count(*) AS vocabulary, count(c.w) AS hits FROM b LEFT JOIN c ON b.w = c.w WHERE b.w <> ''""",
}
