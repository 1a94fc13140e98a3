"""Queries on BLEU, ROUGE-L, chrF++ and the quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import textops as T
from weftline.operators import filters, gates, metrics
from weftline.operators import training as R
from weftline.operators.ordering import rotated
from weftline.plans import batching, cleaning
from weftline.plans import tables as P


def _turns(spark, sf_dir):
    rows = P.table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return P.scored(rows.select("id", "role", "text"), "text").drop("text")


def _items(spark, sf_dir):
    rows = P.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id")
    return P.scored(rows, "text").drop("text")


def bleu(spark, sf_dir):
    return metrics.bleu(_turns(spark, sf_dir), "role").select("slice", F.round("bleu", 6).alias("bleu"))


def chrf(spark, sf_dir):
    return metrics.chrf(_turns(spark, sf_dir), "role").select("slice", F.round("chrf", 6).alias("chrf"))


def rouge_l(spark, sf_dir):
    return metrics.rouge_l(_turns(spark, sf_dir), "role").select("slice", F.round("rouge_l", 6).alias("rouge_l"), "n")


def rouge_neighbours(spark, sf_dir):
    """Each item against its neighbour, where common subsequences are no whole texts."""
    items = P.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("ordinal"), F.col("text").alias("ref"))
    rows = rotated(items, "ref").withColumn("hyp", F.col("shifted"))
    return metrics.rouge_rows(rows).select("id", F.round("rouge", 9).alias("rouge"))


def score_report(spark, sf_dir):
    return metrics.score_report(_turns(spark, sf_dir), "role")


def quality_gates(spark, sf_dir):
    items = P.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.col("item_id").alias("id"), F.col("text").alias("ref"))
    counters = filters.report(filters.filtered(filters.clean_pairs(P.pairs(spark, sf_dir))), "split")
    return reduce(DataFrame.unionByName, [gates.metric_gates(items), gates.text_gate(items, "ref"), gates.conservation_gate(counters), tokenizer_gates(spark, sf_dir)])


def tokenizer_gates(spark, sf_dir):
    """Round trip, special ids, size and unknown ids of the vocabulary that the batching queries use."""
    known = batching._vocabulary(spark, sf_dir)
    words = A.words(F.col("text"))
    turns = P.table(spark, sf_dir, "conversations").withColumn("ids", R.word_encoder(known, batching.FIRST)(words))
    back = turns.select(T.squeeze(F.col("text")).alias("text"), R.word_decoder(known, batching.FIRST)(F.col("ids")).alias("back"))
    framed = batching._encoded(spark, sf_dir, 128)
    held = P.split_of(F.col("conv_id")) != "train"
    return reduce(DataFrame.unionByName, [
        gates.roundtrip_gate(back, "text", "back"), gates.ids_gate(framed, "ids", [4, 5], [A.PAD, A.BOS], A.EOS),
        gates.vocabulary_gate(spark, len(known), batching.VOCABULARY),
        gates.unknown_gate(turns.where(~held), "ids", "unknown_train"), gates.unknown_gate(turns.where(held), "ids", "unknown_held"),
    ])


def gate_totals(spark, sf_dir):
    return gates.totals(quality_gates(spark, sf_dir))


QUERIES = {f.__name__: f for f in (bleu, chrf, rouge_l, rouge_neighbours, score_report, quality_gates, tokenizer_gates, gate_totals)}

def _counts(side: str, kind: str, n: int, items: str, sep: str) -> str:
    h = int(side == "h")
    return f"SELECT id, role, '{kind}' AS kind, {n} AS n, unnest({P.sql_grams(items, n, sep)}) AS gram, {h} AS h, {1 - h} AS r FROM x"


def _stats(parts: list[str]) -> str:
    return f"""g AS ({' UNION ALL '.join(parts)}), o AS (SELECT id, role, kind, n, gram, sum(h) AS h, sum(r) AS r FROM g GROUP BY ALL),
  st AS (SELECT coalesce(role, 'overall') AS slice, kind, n, sum(least(h, r))::DOUBLE AS m, sum(h)::DOUBLE AS hn, sum(r)::DOUBLE AS rn
    FROM o GROUP BY GROUPING SETS ((kind, n), (kind, n, role)))"""


BLEU = _stats([_counts(s, "w", n, f"{s}t", " ") for s in "hr" for n in (1, 2, 3, 4)])
CHRF = _stats(
    [_counts(s, "c", n, f"{s}c", "") for s in "hr" for n in range(1, 7)] + [_counts(s, "w", n, f"{s}w", " ") for s in "hr" for n in (1, 2)]
)


def _chars(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '{P.WS}+', '', 'g'), ''), lambda c: c <> '')"


def _words(x: str) -> str:
    return f"list_filter(string_split({P.sql_squeeze(x)}, ' '), lambda c: c <> '')"


def _bleu(rows: str) -> str:
    """``(slice, bleu)`` of ``rows``, a query of ``id, role, hyp, ref``."""
    return f"""(WITH x AS (SELECT id, role, {P.sql_tokens('hyp')} AS ht, {P.sql_tokens('ref')} AS rt FROM ({rows})), {BLEU},
      l AS (SELECT slice, count(*) FILTER (hn > 0) AS orders, max(m) FILTER (n = 1) AS m1, max(hn) FILTER (n = 1) AS hl, max(rn) FILTER (n = 1) AS rl,
        sum(0.25::DOUBLE * ln(CASE WHEN m > 0 THEN m / hn ELSE 2.2250738585072014e-308::DOUBLE END)) AS logs FROM st GROUP BY slice)
      SELECT slice, CASE WHEN m1 = 0 OR orders < 4 THEN 0.0::DOUBLE ELSE CASE WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / hl) END * exp(logs) END AS bleu FROM l)"""


def _chrf(rows: str) -> str:
    return f"""(WITH x AS (SELECT id, role, {_chars('hyp')} AS hc, {_chars('ref')} AS rc, {_words('hyp')} AS hw, {_words('ref')} AS rw FROM ({rows})), {CHRF},
      a AS (SELECT slice, sum(CASE WHEN hn > 0 THEN m / hn ELSE 0 END) / 8 AS p, sum(CASE WHEN rn > 0 THEN m / rn ELSE 0 END) / 8 AS r FROM st GROUP BY slice)
      SELECT slice, coalesce(5 * p * r / nullif(4 * p + r, 0), 0) AS chrf FROM a)"""


def _lcs(rows: str) -> str:
    """``id, role, hn, rn, l``: the dynamic program as a recursion over reference tokens, a row for each position in the hypothesis."""
    return f"""(WITH RECURSIVE x AS (SELECT id, role, {P.sql_tokens('hyp')} AS h, {P.sql_tokens('ref')} AS r FROM ({rows})),
      d AS (SELECT id, role, 0 AS i, unnest(range(0, len(h) + 1)) AS j, 0 AS v, h, r FROM x
        UNION ALL SELECT id, role, i + 1, j, max(t) OVER (PARTITION BY id ORDER BY j), h, r FROM (
          SELECT *, greatest(v, coalesce(lag(v) OVER (PARTITION BY id ORDER BY j) + CASE WHEN h[j] = r[i + 1] THEN 1 ELSE 0 END, 0)) AS t FROM d WHERE i < len(r)))
      SELECT id, role, len(h)::DOUBLE AS hn, len(r)::DOUBLE AS rn, max(v)::DOUBLE AS l FROM d GROUP BY ALL)"""


def _subsequences(rows: str) -> str:
    """The same for texts that lack some words of their references: each is a subsequence, so it is the longest common one."""
    tokens = f"SELECT id, role, len({P.sql_tokens('hyp')})::DOUBLE AS hn, len({P.sql_tokens('ref')})::DOUBLE AS rn FROM ({rows})"
    return f"(SELECT *, hn AS l FROM ({tokens}))"


ROUGE = "CASE WHEN l > 0 THEN (1 + b) * r * p / (r + b * p + 1e-12::DOUBLE) ELSE 0 END"


def _rouge(lcs: str) -> str:
    return f"""(WITH f AS (SELECT role, l / rn AS r, l / hn AS p, power((l / hn) / (l / rn + 1e-12::DOUBLE), 2) AS b, l FROM {lcs})
      SELECT coalesce(role, 'overall') AS slice, avg({ROUGE}) AS rouge_l, count(*) AS n FROM f GROUP BY GROUPING SETS ((), (role)))"""


TURN_ROWS = f"SELECT conv_id * 1000 + turn AS id, role, {P.sql_hyp('text')} AS hyp, text AS ref FROM conversations"
SELF_ROWS = "SELECT item_id AS id, 'x' AS role, text AS hyp, text AS ref FROM benchmark"
SHIFTED_ROWS = "SELECT item_id AS id, 'x' AS role, coalesce(lead(text) OVER (ORDER BY item_id), first(text) OVER (ORDER BY item_id)) AS hyp, text AS ref FROM benchmark"


def _gate(name: str, ok: str, detail: str, rows: str) -> str:
    return f"SELECT '{name}' AS gate, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, ({detail})::VARCHAR AS detail FROM {rows}"


def _all_gates() -> str:
    """Every gate computed from the tables."""
    overall = "s WHERE slice = 'overall'"
    share = "{0}::BIGINT || '/' || {1}::BIGINT"
    code = batching._enc("[1:126]")
    inner = "len(list_filter(ids[2:len(ids) - 1], lambda i: i IN (0, 2, 3, 4, 5))) = 0"
    unknown = "SELECT sum(unknown) AS u, sum(len(ids)) AS n FROM coded JOIN conversations ON coded.ordinal = conv_id * 1000 + turn WHERE conv_id % 10 {0}"
    return " UNION ALL ".join([
        _gate("self_bleu", "abs(bleu - 1) < 1e-6", "round(bleu, 4)", f"{_bleu(SELF_ROWS)} {overall}"),
        _gate("self_rouge_l", "abs(rouge_l - 1) < 1e-3", "round(rouge_l, 4)", f"{_rouge(_lcs(SELF_ROWS))} {overall}"),
        _gate("self_chrf", "abs(chrf - 1) < 1e-6", "round(chrf, 4)", f"{_chrf(SELF_ROWS)} {overall}"),
        _gate("shifted_bleu", "bleu < 0.05", "bleu < 0.05", f"{_bleu(SHIFTED_ROWS)} {overall}"),
        _gate("non_degenerate", "bad = 0", share.format("bad", "n"),
              f"(SELECT count(*) AS n, count(*) FILTER ({P.sql_squeeze('text')} = '' OR len(regexp_extract_all(text, '<unk>')) > 3) AS bad FROM benchmark)"),
        _gate("conservation", "r = o", share.format("r", "o"),
              f"(WITH {cleaning.CLEANED} SELECT count(*) AS r, count(*) FILTER (reason IS NULL) + count(*) FILTER (reason IS NOT NULL) AS o FROM reasons)"),
        _gate("roundtrip", "ok > 0.99 * n", share.format("ok", "n"),
              f"(WITH {batching.VOCAB} SELECT count(*) AS n, count(*) FILTER (coalesce(unknown, 0) = 0) AS ok FROM conversations LEFT JOIN coded ON coded.ordinal = conv_id * 1000 + turn)"),
        _gate("special_ids", "ok = n", share.format("ok", "n"), f"(WITH {code} SELECT count(*) AS n, count(*) FILTER (ids[1] IN (4, 5) AND ids[-1] = 3 AND {inner}) AS ok FROM e)"),
        _gate("vocabulary_size", "n = 4000", share.format("n", "4000"), f"(WITH {batching.VOCAB} SELECT count(*) AS n FROM vocab)"),
        _gate("unknown_train", "u < 0.005 * n", share.format("u", "n"), f"(WITH {batching.VOCAB} {unknown.format('> 1')})"),
        _gate("unknown_held", "u < 0.005 * n", share.format("u", "n"), f"(WITH {batching.VOCAB} {unknown.format('<= 1')})"),
    ])


ORACLES = {
    "bleu": f"SELECT slice, round(bleu, 6) AS bleu FROM {_bleu(TURN_ROWS)} s",
    "chrf": f"SELECT slice, round(chrf, 6) AS chrf FROM {_chrf(TURN_ROWS)} s",
    "rouge_l": f"SELECT slice, round(rouge_l, 6) AS rouge_l, n FROM {_rouge(_subsequences(TURN_ROWS))} s",
    "rouge_neighbours": f"""WITH f AS (SELECT id, l / rn AS r, l / hn AS p, power((l / hn) / (l / rn + 1e-12::DOUBLE), 2) AS b, l FROM {_lcs(SHIFTED_ROWS)})
        SELECT id, round({ROUGE}, 9) AS rouge FROM f""",
    "score_report": f"""SELECT slice, round(bleu, 4) AS bleu, round(rouge_l, 4) AS rouge_l, round(chrf, 4) AS chrf,
        round(round(bleu, 3) + round(rouge_l, 3) + round(chrf, 3), 4) AS total, n
        FROM {_rouge(_subsequences(TURN_ROWS))} a JOIN {_bleu(TURN_ROWS)} b USING (slice) JOIN {_chrf(TURN_ROWS)} c USING (slice)""",
    "quality_gates": _all_gates(),
    "tokenizer_gates": f"SELECT * FROM ({_all_gates()}) g WHERE gate IN ('roundtrip', 'special_ids', 'vocabulary_size', 'unknown_train', 'unknown_held')",
    "gate_totals": f"SELECT status, count(*) AS n FROM ({_all_gates()}) g GROUP BY status",
}
