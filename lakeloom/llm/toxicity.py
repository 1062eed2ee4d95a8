"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features of a text: the set of its hashed words (runs of letters and digits, A-Z lower-cased), neighbouring pairs and
pairs with one word between.  FTRL-proximal keeps a rate for each coordinate and sets weights to zero under its L1
term, so the model that goes to the executors holds a few hundred coordinates.

The classifier is fitted on a bounded sample: at most `PER_CLASS` labelled rows and `PER_CLASS_BYTES` of text of each label,
those of least hash.
Its one task sees that sample only.  Scoring is one pass over all texts with no shuffle; the weights broadcast are
at most 2**BITS, and in fact as few as L1 leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_ALNUM, buffer, crc_mod, least_hashed, map_arrow, mix, slices, word_bounds, word_hashes, written

BITS = 20
PER_CLASS = 4000
#: Bytes of text of each label in the sample, at most.
PER_CLASS_BYTES = 64 << 20
#: These five were chosen by log loss on learnable rows only: fitted where crc32 mod 3 is 0, judged where it is 2.
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 16.0, 1.0
#: A row of the rarer label 1 weighs as many times as the other has more rows, this at most.
MOST_WEIGHT = 2.0
THRESHOLD = 0.7


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, flat (each once in a text), and the text of each."""
    data, off = buffer(texts)
    starts, ends, at = word_bounds(data, off, NOT_ALNUM)
    h = word_hashes(data, starts, ends, lower=True)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    found, owner = [h], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        found.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        owner.append(doc[gap:][same])
    index = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(np.concatenate(owner) << BITS | index)
    return both & ((1 << BITS) - 1), both >> BITS


class Ftrl:
    """FTRL-proximal over binary features; weights follow from z and n."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == 1 << BITS, 0.0, self.l1)  # the last is the intercept
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: int, weight: float = 1.0) -> None:
        w = self.weights(i)
        g = weight * (sigmoid(w.sum()) - y)
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS, per_class_bytes: int = PER_CLASS_BYTES) -> DataFrame:
    """(feature, weight) of the non-zero coordinates; feature 2**BITS is the intercept.

    labels: doc_id, toxic; rows with null in either are left out, of contradicting rows the higher label counts.  Of
    repeated doc_ids the greatest text counts; empty tables give no weights.  The sample is, for each label, per_class
    documents of least hash, and of these the first that have per_class_bytes of text together; longer single texts aren't
    learnt from.  So the fitting task holds a bounded number of features.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    parts = [least_hashed(known.where(F.col("y") == y), F.xxhash64("doc_id"), per_class, "doc_id") for y in (0, 1)]
    chosen = written(parts[0].unionByName(parts[1]), "toxicity-ids")
    texts = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")), "toxicity-texts")
    sized = texts.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).where(F.col("size") <= per_class_bytes)
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # per_class rows at most
    rows = texts.join(F.broadcast(sized.withColumn("so_far", so_far).where(F.col("so_far") <= per_class_bytes).select("doc_id")), "doc_id")

    def listed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                index, owner = features(part.column("text"))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(index, pa.int32()))], names=["doc_id", "y", "x"])

    def fitted(batches):
        ids, ys, xs = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            ys += batch.column("y").to_pylist()
            xs += [np.append(x.values.to_numpy(), np.int32(1 << BITS)) for x in batch.column("x")]
        rare = min(MOST_WEIGHT, max(1.0, ys.count(0) / max(ys.count(1), 1)))
        model, order = Ftrl(), np.argsort(np.array(ids, np.int64), kind="stable")
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(order):
                model.learn(xs[k], ys[k], rare if ys[k] else 1.0)
        index = np.flatnonzero(model.z)
        w = model.weights(index)
        yield pa.RecordBatch.from_arrays([pa.array(index[w != 0], pa.int32()), pa.array(w[w != 0])], names=["feature", "weight"])

    sample = written(map_arrow(rows, listed, "doc_id bigint, y int, x array<int>"), "toxicity-sample")
    return map_arrow(sample.coalesce(1), fitted, "feature int, weight double")


def score(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with toxicity (double, 0 to 1) and toxic_predicted (int) added, each replacing a column of that name.

    Null and empty texts score as a text without features.  Repeated rows score alike.  An empty table gives an empty
    one; without weights all scores are 0.5.
    """
    found = weights.orderBy("feature").toArrow()  # at most 2**BITS + 1 rows
    table = np.zeros((1 << BITS) + 1)
    table[found.column("feature").to_numpy()] = found.column("weight").to_numpy()
    feature = np.flatnonzero(table)
    model = docs.sparkSession.sparkContext.broadcast((feature, table[feature]))
    rows = docs.drop("toxicity", "toxic_predicted")
    schema = T.StructType([*rows.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])

    def run(batches):
        dense = np.zeros((1 << BITS) + 1)
        dense[model.value[0]] = model.value[1]
        for batch in batches:
            for part in slices(batch, "text"):
                index, owner = features(part.column("text"))
                p = sigmoid(np.bincount(owner, weights=dense[index], minlength=part.num_rows) + dense[-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "toxicity", "toxic_predicted"])

    return map_arrow(rows, run, schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, to_score: DataFrame | None = None) -> DataFrame:
    """Scores of to_score (or docs) by a model that learns from labels whose crc32(doc_id as text) mod 3 is not 1."""
    return score(docs if to_score is None else to_score, train(docs, labels.where(crc_mod("doc_id", 3) != 1)))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = fit_and_score(docs, labels)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"))
