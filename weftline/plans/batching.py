"""Queries on encoding, padding, packing and training-run aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import textops as T
from weftline.operators import packing
from weftline.operators import training as R
from weftline.operators.ordering import scratch
from weftline.plans import tables as P


#: Words that have an id; ids 0 to 3 are special, 4 and 5 the tags.
VOCABULARY, FIRST = 4000, 6


def _vocabulary(spark, sf_dir):
    return R.vocabulary(P.table(spark, sf_dir, "conversations"), A.words(F.col("text")), VOCABULARY)


def _encoded(spark, sf_dir, max_len=1 << 30):
    """Turns as ids of their words between tag and end mark, whole unless ``max_len`` is given."""
    ids = R.word_encoder(_vocabulary(spark, sf_dir), FIRST)(A.words(F.col("text")))
    rows = P.table(spark, sf_dir, "conversations").withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))
    return rows.select("ordinal", A.frame(ids, F.when(F.col("role") == "user", 4).otherwise(5), max_len).alias("ids"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def encode_frame(spark, sf_dir):
    return _encoded(spark, sf_dir, 128).select("ordinal", _text("ids").alias("ids"), A.item_size(F.col("ids")).cast("long").alias("size"))


def decoder_shift(spark, sf_dir):
    ids = F.col("ids")
    return _encoded(spark, sf_dir, 128).select(
        "ordinal", _text(A.decoder_input(ids)).alias("fed"), _text(A.decoder_target(ids)).alias("wanted"), _text(A.strip_special(ids)).alias("bare")
    )


def length_batches(spark, sf_dir):
    rows = packing.length_batches(_encoded(spark, sf_dir), F.size("ids"), "ordinal", 32)
    return rows.select("ordinal", "batch")


def token_batches(spark, sf_dir):
    return packing.token_batches(_encoded(spark, sf_dir), F.size("ids"), "ordinal", 1000).select("ordinal", "batch")


def pad_batch(spark, sf_dir):
    batches = packing.length_batches(_encoded(spark, sf_dir), F.size("ids"), "ordinal", 32)
    done = packing.collated(batches, "batch", "ids", "ordinal")
    total = F.aggregate(F.flatten("padded"), F.lit(0).cast("long"), lambda s, x: s + x)
    return done.select("batch", "width", F.size("padded").cast("long").alias("n"), (F.size(F.flatten("padded"))).cast("long").alias("cells"), total.alias("total"))


def short_items(spark, sf_dir):
    return packing.short_items(_encoded(spark, sf_dir, 128), F.size("ids"), 24).select("ordinal", F.size("ids").cast("long").alias("size"))


def unknown_rate(spark, sf_dir):
    return R.unknown_rate(_encoded(spark, sf_dir), "ids").select("unknown", "tokens", F.round("rate", 6).alias("rate"))


def roundtrip_rate(spark, sf_dir):
    known = _vocabulary(spark, sf_dir)
    ids = R.word_encoder(known, FIRST)(A.words(F.col("text")))
    rows = P.table(spark, sf_dir, "conversations").select("text", ids.alias("ids"))
    back = R.word_decoder(known, FIRST)(F.col("ids"))
    return R.exact_rate(rows.select(T.squeeze(F.col("text")).alias("text"), back.alias("back")), "text", "back")


def epoch_order(spark, sf_dir):
    """Batches of two epochs: seeded noise on sizes, and a seeded order of batches, both new in each epoch."""
    rows = _encoded(spark, sf_dir, 128)
    return packing.epochs(rows, F.size("ids"), "ordinal", 32, seed=7, n_epochs=2, noise=4).select("epoch", "place", "ordinal")


def loader_batches(spark, sf_dir):
    rows = packing.epochs(_encoded(spark, sf_dir, 128), F.size("ids"), "ordinal", 32, seed=7, n_epochs=1, noise=4)
    done = packing.collated(rows, "place", "ids", "ordinal")
    return done.select("place", "width", F.size("padded").cast("long").alias("n"), F.size(F.flatten("padded")).cast("long").alias("cells"))


def train_batches(spark, sf_dir):
    """Two epochs of batches under a token budget, in noisy order of size, with their seeded turns."""
    rows = packing.train_batches(_encoded(spark, sf_dir), F.size("ids"), "ordinal", 1000, seed=7, n_epochs=2, noise=8)
    return rows.select("epoch", "batch", "place", "ordinal")


def _folder(spark):
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def loader_shards(spark, sf_dir):
    """The batches of ``loader_batches`` as three workers read them from files, the second of them resumed at its step 2."""
    rows = packing.epochs(_encoded(spark, sf_dir, 128), F.size("ids"), "ordinal", 32, seed=7, n_epochs=1, noise=4)
    path = _folder(spark)
    packing.write_shards(packing.collated(rows, "place", "ids", "ordinal"), path, 3)
    read = [packing.read_shard(spark, path, w, 2 if w == 1 else 0) for w in range(3)]
    out = read[0].unionByName(read[1]).unionByName(read[2])
    return out.select(F.col("worker").cast("long").alias("worker"), "step", "place", "width", F.size("padded").cast("long").alias("n"))


def restored_order(spark, sf_dir):
    """Sequences after length-sorted batches, put back into the order of their ordinals."""
    batches = packing.length_batches(_encoded(spark, sf_dir, 128), F.size("ids"), "ordinal", 32)
    done = packing.collated(batches, "batch", "ids", "ordinal")
    return packing.restored(done, "ordinals", "padded").select("ordinal", F.col("rank").alias("place"), _text(A.strip_special(F.col("value"))).alias("bare"))


def attention_masks(spark, sf_dir):
    """How many positions each sequence of a padded batch has, and how many pairs of positions may see each other."""
    batches = packing.length_batches(_encoded(spark, sf_dir, 128), F.size("ids"), "ordinal", 32)
    each = packing.collated(batches, "batch", "ids", "ordinal").select("batch", F.explode(F.arrays_zip("ordinals", "padded")).alias("x"))
    count = lambda mask: F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    ids = F.col("x.padded")
    return each.select(F.col("x.ordinals").alias("ordinal"), count(A.padding_mask(ids)).alias("real"), F.size(ids).cast("long").alias("width"), count(F.flatten(A.causal_mask(ids))).alias("seen"))


def lr_schedule(spark, sf_dir):
    """Learning rate, length penalty and capped perplexity at steps that order keys stand for."""
    rates = R.schedule(P.table(spark, sf_dir, "orders"), "o_orderkey", 512, 400)
    step = F.col("o_orderkey")
    return rates.select(
        step.alias("step"), F.round("rate", 9).alias("rate"), F.round(T.length_penalty(step, 0.6), 6).alias("penalty"), F.round(T.perplexity(step / 100.0), 4).alias("perplexity")
    )


def token_loss(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem")
    return R.token_loss(rows, ["l_returnflag"], "l_tax", "l_quantity").select("l_returnflag", F.round("loss", 9).alias("loss"))


def early_stop(spark, sf_dir):
    months = P.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("run"), F.month("o_orderdate").cast("long").alias("step")).agg(F.round(F.avg("o_totalprice"), 2).alias("loss"))
    return R.patience(months, "run", "step", "loss", 3)


def checkpoint_average(spark, sf_dir):
    mean = R.average_checkpoints(P.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return mean.select("label", F.posexplode("embedding").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 5).alias("v"))


def latest_checkpoints(spark, sf_dir):
    names = P.table(spark, sf_dir, "supplier").select(F.concat(F.lit("ckpt/step_"), (F.col("s_suppkey") * 500).cast("string"), F.lit(".pt")).alias("path"))
    return R.latest_checkpoints(names, "path", 5)


def checkpoint_files(spark, sf_dir):
    """Parameters (means of embeddings by label) saved at five steps, pruned to the last three; what a restart then loads."""
    folder = _folder(spark)
    rows = P.table(spark, sf_dir, "embeddings")
    for step in (500, 1000, 9500, 10000, 20000):
        seen = rows.where(F.col("vec_id") % 20000 < step)
        R.save_checkpoint(R.average_checkpoints(seen, "label", "embedding"), folder, step)
    gone = len(R.prune_checkpoints(spark, folder, 3))
    left = R.checkpoints(spark, folder).agg(F.array_join(F.transform(F.sort_array(F.collect_list("step")), lambda x: x.cast("string")), " ").alias("steps"))
    state = R.resume_point(spark, folder).select("label", "step", F.posexplode("embedding").alias("pos", "v"))
    return state.join(F.broadcast(left)).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 5).alias("v"), "step", "steps", F.lit(gone).cast("long").alias("pruned"))


def beam_candidates(spark, sf_dir):
    """The five best candidates of each sentence; events stand for candidates, users for sentences."""
    rows = P.table(spark, sf_dir, "events")
    best = R.k_best(rows, "user_id", -F.col("value"), F.length("props"), 0.6, F.col("event_id"), 5)
    return best.select("user_id", "event_id", "place", F.round("score", 6).alias("score"))


def best_hypothesis(spark, sf_dir):
    rows = P.table(spark, sf_dir, "events")
    best = R.best_candidate(rows, "user_id", -F.col("value"), F.length("props"), 0.6, F.col("event_id"), "event_id")
    return best.select("user_id", "event_id", F.round("score", 6).alias("score"))


def repeat_blocks(spark, sf_dir):
    """Over all a decoder is fed, so without the end mark, after which nothing follows."""
    fed = _encoded(spark, sf_dir).select("ordinal", A.decoder_input(F.col("ids")).alias("ids"))
    return fed.select("ordinal", _text(F.array_sort(A.banned_next(F.col("ids"), 3))).alias("banned"))


QUERIES = {
    f.__name__: f
    for f in (
        encode_frame, decoder_shift, length_batches, token_batches, pad_batch, short_items, unknown_rate, roundtrip_rate, lr_schedule, token_loss,
        early_stop, checkpoint_average, latest_checkpoints, best_hypothesis, repeat_blocks, epoch_order, loader_batches,
        train_batches, loader_shards, restored_order, attention_masks, checkpoint_files, beam_candidates,
    )
}

WORDS = f"list_filter(string_split({P.sql_squeeze('text')}, ' '), lambda c: c <> '')"
VOCAB = f"""vocab AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 5 AS id FROM (
    SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM conversations) GROUP BY w ORDER BY n DESC, w LIMIT 4000)),
  tok AS (SELECT conv_id * 1000 + turn AS ordinal, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS i FROM conversations),
  coded AS (SELECT ordinal, list(coalesce(id, 1) ORDER BY i) AS ids, count(*) FILTER (id IS NULL) AS unknown FROM tok LEFT JOIN vocab ON tok.w = vocab.w GROUP BY ordinal)"""


def _enc(part: str = "") -> str:
    return f"""{VOCAB}, e AS (SELECT conv_id * 1000 + turn AS ordinal,
      list_concat(list_concat([CASE WHEN role = 'user' THEN 4 ELSE 5 END], coalesce(coded.ids, []){part}), [3]) AS ids
    FROM conversations LEFT JOIN coded ON coded.ordinal = conv_id * 1000 + turn)"""


ENC, CUT = _enc(), _enc("[1:126]")
SORTED = "s AS (SELECT ordinal, ids, len(ids) AS size, row_number() OVER (ORDER BY len(ids), ordinal) AS k FROM e)"
J = "array_to_string({0}, ' ')"
DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
EPOCHS = f"""n AS (SELECT epoch, ordinal, len(ids) AS size, len(ids) + {DRAW.format("'7:' || epoch || ':' || ordinal")} % 5 AS noisy FROM e, range(2) t(epoch)),
  b AS (SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY noisy, ordinal) - 1) // 32 AS batch FROM n),
  p AS (SELECT epoch, batch, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || batch), batch) - 1 AS place FROM (SELECT DISTINCT epoch, batch FROM b)),
  o AS (SELECT epoch, place, ordinal, size FROM b JOIN p USING (epoch, batch))"""

ORACLES = {
    "encode_frame": f"WITH {CUT} SELECT ordinal, {J.format('ids')} AS ids, len(ids)::BIGINT AS size FROM e",
    "decoder_shift": f"""WITH {CUT} SELECT ordinal, {J.format('ids[1:len(ids) - 1]')} AS fed, {J.format('ids[2:]')} AS wanted,
        {J.format('list_filter(ids[1:list_position(ids, 3) - 1], lambda x: x NOT IN (0, 2))')} AS bare FROM e""",
    "length_batches": f"WITH {ENC}, {SORTED} SELECT ordinal, (k - 1) // 32 AS batch FROM s",
    "token_batches": f"""WITH RECURSIVE {ENC}, {SORTED}, p AS (SELECT k, size AS widest, 1 AS n, 0::BIGINT AS batch FROM s WHERE k = 1
        UNION ALL SELECT s.k, CASE WHEN greatest(widest, size) * (n + 1) > 1000 THEN size ELSE greatest(widest, size) END,
          CASE WHEN greatest(widest, size) * (n + 1) > 1000 THEN 1 ELSE n + 1 END, CASE WHEN greatest(widest, size) * (n + 1) > 1000 THEN batch + 1 ELSE batch END
        FROM p JOIN s ON s.k = p.k + 1) SELECT ordinal, batch FROM p JOIN s ON p.k = s.k""",
    "pad_batch": f"""WITH {ENC}, {SORTED}, b AS (SELECT (k - 1) // 32 AS batch, max(size)::BIGINT AS width, count(*) AS n, sum(list_sum(ids))::BIGINT AS total FROM s GROUP BY 1)
        SELECT batch, width, n, n * width AS cells, total FROM b""",
    "short_items": f"WITH {CUT} SELECT ordinal, len(ids)::BIGINT AS size FROM e WHERE len(ids) <= 24",
    "unknown_rate": f"""WITH {ENC}, u AS (SELECT sum(len(list_filter(ids, lambda x: x = 1)))::BIGINT AS unknown, sum(len(ids))::BIGINT AS tokens FROM e)
        SELECT unknown, tokens, round(unknown::DOUBLE / tokens, 6) AS rate FROM u""",
    "roundtrip_rate": f"""WITH {VOCAB} SELECT count(*) AS n, count(*) FILTER (coalesce(unknown, 0) = 0) AS matches
        FROM conversations LEFT JOIN coded ON coded.ordinal = conv_id * 1000 + turn""",
    "train_batches": f"""WITH RECURSIVE {ENC}, n AS (SELECT epoch, ordinal, len(ids) AS size, len(ids) + {DRAW.format("'7:' || epoch || ':' || ordinal")} % 9 AS noisy FROM e, range(2) t(epoch)),
      s AS (SELECT epoch, ordinal, size, row_number() OVER (PARTITION BY epoch ORDER BY noisy, ordinal) AS k FROM n),
      p AS (SELECT epoch, k, size AS widest, 1 AS n, 0::BIGINT AS batch FROM s WHERE k = 1
        UNION ALL SELECT s.epoch, s.k, CASE WHEN greatest(widest, size) * (n + 1) > 1000 THEN size ELSE greatest(widest, size) END,
          CASE WHEN greatest(widest, size) * (n + 1) > 1000 THEN 1 ELSE n + 1 END, CASE WHEN greatest(widest, size) * (n + 1) > 1000 THEN batch + 1 ELSE batch END
        FROM p JOIN s ON s.k = p.k + 1 AND s.epoch = p.epoch),
      b AS (SELECT epoch, batch, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || batch), batch) - 1 AS place FROM (SELECT DISTINCT epoch, batch FROM p))
      SELECT epoch, batch, place, ordinal FROM p JOIN s USING (epoch, k) JOIN b USING (epoch, batch)""",
    "loader_shards": f"""WITH {CUT}, {EPOCHS} SELECT place % 3 AS worker, place // 3 AS step, place, max(size)::BIGINT AS width, count(*) AS n FROM o
      WHERE epoch = 0 AND NOT (place % 3 = 1 AND place // 3 < 2) GROUP BY place""",
    "restored_order": f"""WITH {CUT} SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS place,
        {J.format('list_filter(ids[1:list_position(ids, 3) - 1], lambda x: x NOT IN (0, 2))')} AS bare FROM e""",
    "attention_masks": f"""WITH {CUT}, {SORTED}, b AS (SELECT (k - 1) // 32 AS batch, max(size)::BIGINT AS width FROM s GROUP BY 1)
        SELECT ordinal, size::BIGINT AS real, width, width * (width + 1) // 2 AS seen FROM s JOIN b ON (k - 1) // 32 = batch""",
    "checkpoint_files": """WITH u AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT label, pos, round(avg(v), 5) AS v, 20000::BIGINT AS step, '9500 10000 20000' AS steps, 2::BIGINT AS pruned FROM u GROUP BY label, pos""",
    "beam_candidates": """WITH c AS (SELECT user_id, event_id, -value / power((length(props) + 5) / 6.0::DOUBLE, 0.6) AS score FROM events)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) - 1 AS place, round(score, 6) AS score FROM c
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) <= 5""",
    "lr_schedule": """SELECT o_orderkey AS step, round(power(512.0::DOUBLE, -0.5) * least(power(greatest(o_orderkey, 1)::DOUBLE, -0.5), greatest(o_orderkey, 1) * power(400.0::DOUBLE, -1.5)), 9) AS rate,
        round(power((o_orderkey + 5) / 6.0::DOUBLE, 0.6), 6) AS penalty, round(exp(least(o_orderkey / 100.0::DOUBLE, 20.0)), 4) AS perplexity FROM orders""",
    "token_loss": "SELECT l_returnflag, round(sum(l_tax) / greatest(sum(l_quantity), 1), 9) AS loss FROM lineitem GROUP BY 1",
    "early_stop": """WITH m AS (SELECT year(o_orderdate) AS run, month(o_orderdate) AS step, round(avg(o_totalprice), 2) AS loss FROM orders GROUP BY 1, 2),
        b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m),
        s AS (SELECT *, sum(CASE WHEN best IS NULL OR loss < best THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS streak FROM b),
        r AS (SELECT run, step, loss, best, row_number() OVER (PARTITION BY run, streak ORDER BY step) - 1 AS bad FROM s)
        SELECT run, step, loss, best, bad, bad >= 3 AS stop FROM r""",
    "checkpoint_average": """WITH u AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT label, pos, round(avg(v), 5) AS v FROM u GROUP BY label, pos""",
    "latest_checkpoints": "SELECT 'ckpt/step_' || s_suppkey * 500 || '.pt' AS path, s_suppkey * 500 AS step FROM supplier ORDER BY step DESC LIMIT 5",
    "best_hypothesis": """WITH c AS (SELECT user_id, event_id, -value / power((length(props) + 5) / 6.0::DOUBLE, 0.6) AS score FROM events)
        SELECT user_id, event_id, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1""",
    "repeat_blocks": f"""WITH {ENC}, h AS (SELECT ordinal, ids[1:len(ids) - 1] AS ids FROM e)
        SELECT ordinal, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(ids) - 1), lambda i: ids[i] = ids[len(ids) - 1] AND ids[i + 1] = ids[len(ids)]),
          lambda i: ids[i + 2]))), ' '), '') AS banned FROM h""",
    "epoch_order": f"""WITH {CUT}, {EPOCHS} SELECT epoch, place, ordinal FROM o""",
    "loader_batches": f"""WITH {CUT}, {EPOCHS} SELECT place, max(size)::BIGINT AS width, count(*) AS n, count(*) * max(size)::BIGINT AS cells FROM o WHERE epoch = 0 GROUP BY place""",
}
