"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features of a text, each a hashed slot with the square root of its relative
frequency: unigrams and bigrams of words, and of word shapes (letter case,
digits, the symbols at the ends, whether the word repeats an earlier one
nearby).  The learner follows the regularised leader, one update for each
document, in one streaming task over a bounded, documented sample of the
labelled rows (TRAIN_ROWS, chosen by a hash of the id; EPOCHS passes in another
order each).  Only the weights, 2**BITS floats, travel: to the driver and back as
a broadcast.  A score is the sparse dot product through the logistic function; as
label 0 counts REJECTED_WEIGHT times, it ranks documents by how likely label 1 is
but lies below the share of label 1 among documents of that score.

Labels, lang, source and doc_id are never inputs.  Held out: crc32(doc_id as
text) % 4 == 2; labels of such rows are not read.  Defined cases: null and empty
texts get the score of the bias alone; labels with null quality are left out;
several labels of one doc_id: it is used once if they agree, else not, with one of
its texts if there are several; without
any label every score is 0.5; repeated rows are scored alike; an empty table
gives no rows; other columns are ignored (`scores`) or kept (`keep_good`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.llm.common import pieces

BITS = 18
TRAIN_ROWS = 12_000
EPOCHS = 3
THRESHOLD = 0.7
#: A document of label 0 counts so often in training: what is rejected wrongly costs less than what is let through.
REJECTED_WEIGHT = 3.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
NEARBY = 32


def shape_of(word: str) -> str:
    """Case and digits of the middle, and the symbols around it."""
    core = word.strip("".join({c for c in word if not c.isalnum()})) if not word.isalnum() else word
    if not core:
        return "-" + word[:4]
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "l" if core.isalpha() else "d" if core.isdigit() else "x"
    i = word.find(core)
    return f"{word[:i][:3]}{case}{word[i + len(core):][:3]}"


class Features:
    """Slots and values of texts; what a word gives is cached up to a bound."""

    CACHE = 1 << 18

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.cache: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > self.CACHE:
                self.cache.clear()
            shape = xxhash.xxh32_intdigest("s" + shape_of(word)) & 0x7FFFFFFF
            core = xxhash.xxh32_intdigest("w" + word.lower())
            found = self.cache[word] = core << 31 | shape
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.fromiter(map(self._word, words), dtype=np.uint64, count=n)
        core, shape = both >> np.uint64(31), both & np.uint64(0x7FFFFFFF)
        # a word seen among the last NEARBY words has a shape of its own
        order = np.argsort(core, kind="stable")
        near = np.zeros(n, dtype=bool)
        near[order[1:]] = (core[order[1:]] == core[order[:-1]]) & (np.diff(order) <= NEARBY)
        shape = shape * np.uint64(2) + near.astype(np.uint64)
        slots, values = [], []
        for salt, x in ((np.uint64(0x9E3779B97F4A7C15), core), (np.uint64(0xC2B2AE3D27D4EB4F), shape)):
            h = x * salt
            grams = np.concatenate([h, h[:-1] * np.uint64(0x94D049BB133111EB) + h[1:] + np.uint64(1)])
            grams = ((grams ^ (grams >> np.uint64(31))) * salt >> np.uint64(40)) & self.mask
            slot, count = np.unique(grams, return_counts=True)
            slots.append(slot.astype(np.int64))
            values.append(np.sqrt(count / len(grams)))
        return np.concatenate(slots), np.concatenate(values)


class FTRL:
    """Follow-the-regularised-leader for logistic loss; slot 0 of an extra place is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x * weight
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        np.add.at(self.z, at, g - sigma * w)
        np.add.at(self.n, at, g * g)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """At most `most` labelled rows that are not held out: doc_id, label, text; of rows that share a doc_id the text of least hash."""
    own = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~F.coalesce(held_out(), F.lit(False)))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"), F.max("quality").alias("__most"))
        .where("label = __most").select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # the sample's size is bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(own), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, the bias last."""
    rows = training_rows(docs, labels, most)

    def featured(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("slots", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))])
        features = Features()
        for batch in pieces(batches, 512):
            made = [features.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([s for s, _ in made], schema.field(2).type), pa.array([v.astype(np.float32) for _, v in made], schema.field(3).type)],
                schema=schema,
            )

    def fit(batches):
        model = FTRL()
        for batch in batches:
            for label, slots, values in zip(batch.column("label").to_pylist(), batch.column("slots"), batch.column("vals")):
                model.update(slots.values.to_numpy(), values.values.to_numpy().astype(float), int(label > 0), 1.0 if label else REJECTED_WEIGHT)
        w = model.weights(np.arange(len(model.z))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    made = rows.select("doc_id", "label", "text").mapInArrow(featured, "doc_id long, label int, slots array<int>, vals array<float>")
    passes = made.select("*", F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch"))
    one = passes.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "label")
    made_weights = one.mapInArrow(fit, "weights binary").first()
    if made_weights is None:  # no labelled row, so no task ran
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    return np.frombuffer(made_weights.weights, dtype=np.float32)


def _score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, keep, ddl: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        features, w = Features(), shared.value
        bias = float(w[-1])
        for batch in pieces(batches, 512):
            z = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("__text").to_pylist()):
                slots, values = features.of(text or "")
                z[i] = float(w[slots] @ values) + bias
            yield from keep(batch, 1 / (1 + np.exp(-z)))

    return docs.mapInArrow(run, ddl)


def scores(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def keep(batch, score):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("__text")
    )
    return _score(spark, rows, weights, keep, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents with a score of THRESHOLD and more, all columns kept."""
    at = docs.columns.index("text")
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    numbered = numbered.withColumn("__text", F.col(f"c{at}").cast("string"))

    def keep(batch, score):
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(score >= THRESHOLD))

    ddl = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(numbered.schema[:-1]))
    return _score(spark, numbered, weights, keep, ddl).toDF(*docs.columns)
