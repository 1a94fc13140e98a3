"""Language identification: multinomial naive Bayes over character n-grams.

N-grams are counted, and texts scored, in Arrow batches where the texts are, a
bounded run of texts at a time: a task sends the grams that it holds with their
counts, a bounded number at a time, and texts are never shuffled. A worker
holds an Arrow batch, the model, and some 100 bytes for each character of a run
(some 50 for each of a longer text). Grams are those of code points, order by
order, of the trimmed text between blanks. A null text has no grams; an empty one has those of two blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.config import DEFAULT, Config
# By itself, as it runs in workers.
from weftline.functions.arrays import runs
from weftline.operators.ordering import seeded_key, written

#: Code points, and cells of a table that stands for a search.
POINTS = 0x110000
CELLS = 1 << 22
#: Bytes of text, and positions, that are worked on at a time.
RUN = 1 << 19
#: Grams that a task counts before it sends them.
HELD = 1 << 17


@dataclass(frozen=True)
class Model:
    """``classes``: ``cls, place, log_prior, log_unseen``; ``grams``: ``cls, gram, log_prob`` (a bounded number for each class)."""

    classes: DataFrame
    grams: DataFrame


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all padded texts in a row, and the number of each."""
    padded = ["" if t is None else f" {t.strip()} " for t in texts]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, padded), np.int64, len(padded))


def _keys(flat: np.ndarray, n: int, base: int) -> np.ndarray:
    """A number for the ``n``-gram at each position but the last ``n - 1``."""
    key = flat[: max(0, len(flat) - n + 1)].astype(np.int64)
    for k in range(1, n):
        key = key * base + flat[k : len(flat) - n + 1 + k]
    return key


def _blocks(flat: np.ndarray, lengths: np.ndarray, n: int, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of positions the first one, the number of the ``n``-gram at each, and whether that stays inside its text."""
    ends = np.cumsum(lengths)[lengths > 0]
    for at in range(0, len(flat) - n + 1, RUN):
        key = _keys(flat[at : at + RUN + n - 1], n, base)
        inside = np.ones(len(key), bool)
        for k in range(1, n):
            late = ends - k - at
            inside[late[(late >= 0) & (late < len(key))]] = False
        yield at, key, inside


def _some(texts: pa.Array) -> Iterator[list[str | None]]:
    """``texts`` by runs of bounded size; a longer text is a run by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for at, to in runs(sizes.astype(np.int64) + 2, RUN):
        yield texts.slice(at, to - at).to_pylist()


def _counted(texts: list[str | None], orders: tuple[int, ...]) -> Iterator[tuple[str, int]]:
    """Grams and their counts, those of longer texts in several parts."""
    flat, lengths = _points(texts)
    known = np.unique(flat)
    number = np.zeros(POINTS, np.int32)
    number[known] = np.arange(len(known))
    flat, base = number[flat], max(1, len(known))
    for n in orders:
        if base**n >= 1 << 62:
            raise ValueError(f"{n}-grams over {base} different characters are too many to number")
        for _, key, inside in _blocks(flat, lengths, n, base):
            key = key[inside]
            if base**n <= min(CELLS, 4 * len(key)):
                counts = np.bincount(key)
                ids = np.flatnonzero(counts)
                counts = counts[ids]
            else:
                ids, counts = np.unique(key, return_counts=True)
            parts = np.stack([known[ids // base**k % base] for k in reversed(range(n))], axis=1) if len(ids) else np.empty((0, n), np.uint32)
            grams = parts.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            yield from ((grams[i * n : i * n + n], c) for i, c in enumerate(counts.tolist()))


def gram_counts(samples: DataFrame, text: str, label: str, config: Config = DEFAULT) -> DataFrame:
    """``(cls, gram, n)``; each task sends its own counts, which add up."""
    kind = samples.select(label).schema[0].dataType.simpleString()

    def sent(held: dict, of: pa.DataType) -> pa.RecordBatch:
        labels = pa.array([c for c, own in held.items() for _ in own], of)
        grams = pa.array([g for own in held.values() for g in own], pa.string())
        counts = pa.array([m for own in held.values() for m in own.values()], pa.int64())
        return pa.RecordBatch.from_arrays([labels, grams, counts], ["cls", "gram", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = {}, None
        for b in batches:
            names, of = b.column(0).dictionary_encode(null_encoding="encode"), b.column(0).type
            for k, c in enumerate(names.dictionary.to_pylist()):
                own = held.setdefault(c, {})
                for texts in _some(b.column(1).filter(pc.equal(names.indices, k))):
                    for gram, m in _counted(texts, config.lid_orders):
                        own[gram] = own.get(gram, 0) + m
                    if sum(map(len, held.values())) >= HELD:
                        yield sent(held, of)
                        held = {c: (own := {})}
        if any(held.values()):
            yield sent(held, of)

    picked = samples.select(F.col(label).alias("cls"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"cls {kind}, gram string, m long").groupBy("cls", "gram").agg(F.sum("m").alias("n"))


def bounded_samples(samples: DataFrame, key: str, label: str, text: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` of each class in seeded order, and of these the ones that are not empty.

    A cut on the draw key first leaves each class a few times ``limit`` rows to
    order; keys are evenly spread, and a cut that leaves too few is given up.
    """
    drawn = samples.withColumn("__d", seeded_key(F.col(key), seed))
    counts = samples.groupBy(F.col(label).alias("__c")).agg(F.count("*").alias("__n"))
    share = F.lit(4.0 * limit) / F.col("__n")
    # The first 8 hexadecimal digits as a number; a row for each class.
    cuts = counts.withColumn("__cut", F.when(share >= 1, F.lit(1 << 32)).otherwise(F.ceil(share * (1 << 32)) + 1))
    number = F.conv(F.substring("__d", 1, 8), 16, 10).cast("long")
    same = F.col(label).eqNullSafe(F.col("__c"))
    near = drawn.join(F.broadcast(cuts), same).where(number < F.col("__cut"))
    short = near.groupBy("__c").agg(F.count("*").alias("k"), F.first("__n").alias("n")).where(F.col("k") < F.least(F.lit(limit), F.col("n")))
    some = counts.join(near.select("__c").distinct().withColumnRenamed("__c", "__g"), F.col("__c").eqNullSafe(F.col("__g")), "left_anti")
    rows = near.drop("__c", "__n", "__cut") if short.isEmpty() and some.isEmpty() else drawn
    w = W.partitionBy(label).orderBy("__d")
    return rows.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= limit) & (F.col(text) != "")).drop("__r", "__d")


def accuracy(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("correct"))


def _commonest(counts: DataFrame, limit: int) -> DataFrame:
    """Of each class the ``limit`` grams with the greatest ``n`` (of equals the smaller gram), without sorting a class."""
    out = counts.where("false")
    # A row for each class.
    for r in counts.groupBy("cls").agg(F.count("*").alias("k")).collect():
        own = counts.where(F.col("cls") == r["cls"])
        if r["k"] <= limit:
            out = out.unionByName(own)
            continue
        # How many grams are counted how often: few rows, of which one sum runs down to the limit.
        sizes = own.groupBy("n").agg(F.count("*").alias("k"))
        upto = F.sum("k").over(W.orderBy(F.desc("n")))
        n, upto, k = sizes.withColumn("upto", upto).where(F.col("upto") >= limit).orderBy(F.desc("n")).select("n", "upto", "k").first()
        ties = own.where(F.col("n") == n).orderBy("gram").limit(limit - (upto - k))
        out = out.unionByName(own.where(F.col("n") > n)).unionByName(ties)
    return out


def fit(samples: DataFrame, text: str, label: str, classes: list[str], config: Config = DEFAULT) -> Model:
    """Add-alpha smoothing; each class keeps its commonest grams (of equals the smaller gram).

    A class's total counts what it kept; the vocabulary is that of all classes.
    """
    alpha = F.lit(config.lid_alpha)
    own = samples.where(F.col(label).isin(*classes))
    docs = own.groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("docs"))
    kept = written(_commonest(written(gram_counts(own, text, label, config)), config.lid_max_features))
    v = kept.agg(F.count_distinct("gram").alias("v"))
    total = docs.agg(F.sum("docs").alias("total"))
    # From Arrow: rows of Python objects would start workers of their own for these.
    names = samples.sparkSession.createDataFrame(pa.table({"place": pa.array(range(len(classes)), pa.int32()), "cls": pa.array(classes, pa.string())}))
    sums = kept.groupBy("cls").agg(F.sum("n").alias("s"))
    # Each of these has a row for a class, or one row.
    stats = (
        names.join(docs, "cls", "left").join(sums, "cls", "left").join(F.broadcast(v)).join(F.broadcast(total))
        .withColumn("denom", F.coalesce("s", F.lit(0)) + alpha * F.col("v"))
        .select(
            "cls", "place", "denom",
            F.log(F.greatest(F.coalesce("docs", F.lit(0)), F.lit(1)) / F.col("total")).alias("log_prior"),
            F.log(alpha / F.col("denom")).alias("log_unseen"),
        )
    )
    stats = written(stats)
    grams = kept.join(F.broadcast(stats.select("cls", "denom")), "cls").select("cls", "gram", F.log((F.col("n") + alpha) / F.col("denom")).alias("log_prob"))
    return Model(stats.drop("denom"), grams)


def _rows(grams: pa.Table, letters: np.ndarray, unseen: list[float], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the ``n``-grams of ``(place, gram, log_prob)``, and a row of log probabilities for each after one for any other gram."""
    own = grams.filter(pc.equal(pc.utf8_length(grams["gram"]), n))
    flat = np.frombuffer("".join(own["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    keys, at = np.unique(_keys(np.searchsorted(letters, flat) + 1, n, len(letters) + 1)[::n], return_inverse=True)
    rows = np.tile(np.array(unseen, np.float64), (len(keys) + 1, 1))
    rows[at + 1, own["place"].to_numpy()] = own["log_prob"].to_numpy()
    return keys, rows


class Scorer:
    """A model as arrays: for each order the numbers of its grams, sorted, and a row of log probabilities for each."""

    def __init__(self, letters: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], priors: list[float]):
        self.priors, self.orders = np.array(priors), tuple(tables)
        # Number 0 is any character that no gram has.
        self.number = np.zeros(POINTS, np.int32)
        self.number[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        self.keys, self.rows, self.cells = {}, {}, {}
        for n, (keys, rows) in tables.items():
            self.keys[n], self.rows[n] = keys, rows
            if self.base**n <= CELLS:
                self.cells[n] = np.zeros(self.base**n, np.int32)
                self.cells[n][keys] = np.arange(1, len(keys) + 1)

    def _found(self, n: int, key: np.ndarray) -> np.ndarray:
        """The row of each key, 0 for grams that no class has."""
        if n in self.cells:
            return self.cells[n][key]
        if not len(self.keys[n]):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys[n], key), len(self.keys[n]) - 1)
        return np.where(self.keys[n][at] == key, at + 1, 0)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A row of scores for each text."""
        flat, lengths = _points(texts)
        flat = self.number[flat]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        out = np.tile(self.priors, (len(texts), 1))
        for n in self.orders:
            value = np.zeros((len(self.priors), len(flat) + 1))
            for at, key, inside in _blocks(flat, lengths, n, self.base):
                found = self._found(n, key)
                for c in range(len(value)):
                    value[c, at : at + len(key)] = np.where(inside, self.rows[n][found, c], 0.0)
            for c in range(len(value)):
                out[:, c] += np.where(lengths > 0, np.add.reduceat(value[c], bounds[:-1]), 0.0)
        return out


def _packed(model: Model, config: Config):
    """Classes in their order, and the model as a broadcast: at most the feature limit of each class, a bounded table."""
    names = [tuple(r) for r in model.classes.select("cls", "place", "log_prior", "log_unseen").orderBy("place").collect()]
    at = F.create_map(*[F.lit(x) for k, (c, *_) in enumerate(names) for x in (c, k)]) if names else F.lit(None).cast("map<string,int>")
    grams = model.grams.select(F.try_element_at(at, F.col("cls")).alias("place"), "gram", "log_prob").toArrow()
    letters = np.unique(np.frombuffer("".join(grams["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32))
    for n in config.lid_orders:
        if (len(letters) + 1) ** n >= 1 << 62:
            raise ValueError(f"{n}-grams over {len(letters) + 1} different characters are too many to number")
    tables = {n: _rows(grams, letters, [x[3] for x in names], n) for n in config.lid_orders}
    return names, model.classes.sparkSession.sparkContext.broadcast((letters, tables, [x[2] for x in names]))


def predictor(model: Model, config: Config = DEFAULT):
    """A column function from texts to the class with the best score, null for null; of scores equal to nine places the class named first.

    Texts are scored in Arrow batches where the rows are. Give null for rows
    that need no answer: they cost nothing.
    """
    names, packed = _packed(model, config)
    order = np.argsort([p for _, p, *_ in names], kind="stable")

    @F.arrow_udf("string")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = None
        classes = pa.array([names[k][0] for k in order], pa.string())
        for b in batches:
            best = []
            for texts in _some(b.drop_null()):
                scorer = scorer or Scorer(*packed.value)
                best.append(np.round(scorer(texts)[:, order], 9).argmax(axis=1))
            # Answers go back to the places of the texts that are not null.
            place = np.full(len(b), -1)
            if best:
                place[b.is_valid().to_numpy(zero_copy_only=False)] = np.concatenate(best)
            yield classes.take(pa.array(place, mask=place < 0))

    return predict


def _scored(rows: DataFrame, model: Model, key: str, text: str, config: Config) -> tuple[DataFrame, list[Column]]:
    """``(key, score)`` with an array of scores, and a struct ``cls, place, score`` for each class; rows are scored where they are."""
    names, packed = _packed(model, config)
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in batches:
            at = 0
            for texts in _some(b.column(1)):
                scorer = scorer or Scorer(*packed.value)
                got = scorer(texts)
                ends = pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(got)), pa.ListArray.from_arrays(ends, got.ravel())], ["key", "score"])
                at += len(got)

    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score array<double>")
    each = [(F.lit(c).alias("cls"), F.lit(p).alias("place"), F.get("score", F.lit(k)).alias("score")) for k, (c, p, *_) in enumerate(names)]
    return out, each


def scores(rows: DataFrame, model: Model, key: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """``(key, cls, place, score)`` for each row and class."""
    out, each = _scored(rows, model, key, text, config)
    return out.select(F.col("key").alias(key), F.explode(F.array(*[F.struct(*x) for x in each])).alias("x")).select(key, "x.*")


def predict(rows: DataFrame, model: Model, key: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """``(key, predicted, score)`` for each row; of scores equal to nine places the class named first."""
    out, each = _scored(rows, model, key, text, config)
    best = F.array_max(F.array(*[F.struct(F.round(s, 9).alias("s"), (-p).alias("p"), c) for c, p, s in each]))
    return out.select(F.col("key").alias(key), best.alias("b"), F.array_max("score").alias("score")).select(key, F.col("b.cls").alias("predicted"), "score")


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def save(model: Model, path: str) -> None:
    model.classes.write.mode("overwrite").parquet(f"{path}/classes")
    model.grams.write.mode("overwrite").parquet(f"{path}/grams")


def load(spark, path: str) -> Model:
    return Model(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/grams"))


def save_json(model: Model, path: str, config: Config = DEFAULT) -> None:
    """One JSON object ``alpha, log_prior, log_prob, log_unseen``: the model is of bounded size."""
    prior = model.classes.agg(F.map_from_entries(F.collect_list(F.struct("cls", "log_prior"))).alias("log_prior"), F.map_from_entries(F.collect_list(F.struct("cls", "log_unseen"))).alias("log_unseen"))
    each = model.grams.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("gram", "log_prob"))).alias("m"))
    probs = each.agg(F.map_from_entries(F.collect_list(F.struct("cls", "m"))).alias("log_prob"))
    one = prior.crossJoin(probs).select(F.to_json(F.struct(F.lit(config.lid_alpha).alias("alpha"), "log_prior", "log_prob", "log_unseen")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def load_json(spark, path: str, classes: list[str]) -> Model:
    """A model of ``save_json``'s shape; ``classes`` gives their order."""
    schema = "log_prior map<string,double>, log_prob map<string,map<string,double>>, log_unseen map<string,double>"
    one = written(spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select("j.*"))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cls")).cast("int") - 1
    known = one.select(F.explode("log_prior").alias("cls", "log_prior"), "log_unseen")
    stats = known.select("cls", place.alias("place"), "log_prior", F.try_element_at("log_unseen", F.col("cls")).alias("log_unseen"))
    grams = one.select(F.explode("log_prob").alias("cls", "m")).select("cls", F.explode("m").alias("gram", "log_prob"))
    return Model(stats, grams)
