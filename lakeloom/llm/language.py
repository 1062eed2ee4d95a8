"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is reduced to lower-case letters, with one blank for any run of other characters.  Each language has counts of
character n-grams up to `ORDER`; the highest order uses counts, lower ones use the number of different left
neighbours, with one absolute discount an order.  A model is kept as sorted arrays of n-gram codes with their
discounted probability and, for contexts, the mass handed down.  The language with the lowest cross-entropy for each
character wins.

Confidence: on documents that the models did not learn from, the gap to the second language and the cross-entropy
itself are fitted to being right by a small logistic regression; its value is the score.  A text whose score is
below `REJECT`, or without any letter, is rejected.

Scale: models learn from a bounded sample: of each language the `PER_LANGUAGE` documents of least hash, of each a piece
of at most `PIECE` characters at a place that the hash gives, so long documents teach as short ones do.  All languages
are learned: from `FULL_SAMPLES` languages on each has a smaller sample, so the whole keeps its bound.  The arrays have
at most as many entries as the sample has characters, for each order; that is what is broadcast.  Scoring is one pass
without shuffle.  Within a batch equal n-grams are looked up once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import below, crc_mod, map_arrow, margin, slices, written

ORDER = 4
PER_LANGUAGE = 400
PIECE = 8000
#: With more languages than these, the sample of each is smaller in proportion, but of LEAST documents at least.
FULL_SAMPLES, LEAST = 64, 12
REJECT = 0.5
SYMBOL_BITS = 15
MASK = np.uint64((1 << SYMBOL_BITS) - 1)


@cache
def _symbols() -> np.ndarray:
    """Code of every code point: 0 for what is not a letter, else 1 and up; letters past the 15 bits share codes."""
    table = np.zeros(0x110000, np.uint64)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    table[letters] = np.uint64(1) + np.arange(len(letters), dtype=np.uint64) % np.uint64((1 << SYMBOL_BITS) - 2)
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, flat, and the text of each: blanks around each text, runs of other characters one blank."""
    lowered = [(t or "").lower() for t in texts]
    flat = _symbols()[np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    doc = np.append(doc, max(len(texts) - 1, 0))
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = (flat > 0) | np.concatenate([[True], flat[:-1] > 0]) | first
    return flat[keep], doc[keep]


def grams(flat: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each letter or blank but the first of a text, as one number (shorter at the start)."""
    code = flat.copy()
    for k in range(1, n):
        earlier = np.zeros(len(flat), np.uint64)
        same = np.zeros(len(flat), bool)
        same[k:] = doc[k:] == doc[:-k]
        earlier[same] = flat[:-k][same[k:]] if k < len(flat) else 0
        code |= earlier << np.uint64(SYMBOL_BITS * k)
    real = np.zeros(len(flat), bool)
    real[1:] = doc[1:] == doc[:-1]
    return code[real], doc[real]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, code, n): counts of the longest n-grams of each language."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, doc = symbols(part.column("text").to_pylist())
                code, doc = grams(flat, doc, ORDER)
                langs = part.column("lang").dictionary_encode()
                which = langs.indices.to_numpy()[doc]
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    found, n = np.unique(code[which == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return map_arrow(docs.select("lang", "text"), run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class KneserNey:
    """Sorted arrays of one language: for each order codes and discounted probabilities, contexts and handed-down mass."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code)
        code, n = code[order].astype(np.uint64), n[order].astype(np.float64)
        self.levels = []
        for k in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            context = code >> np.uint64(SYMBOL_BITS)
            if k == 1:
                context = np.zeros_like(code)
            known, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, weights=n)
            handed = discount * np.bincount(at) / total
            self.levels.append((code, ((n - discount) / total[at]).astype(np.float32), known, handed.astype(np.float32)))
            # the next order counts different left neighbours
            short, n = np.unique(code & ((np.uint64(1) << np.uint64(SYMBOL_BITS * (k - 1))) - np.uint64(1)), return_counts=True)
            code, n = short, n.astype(np.float64)

    def log2(self, code: np.ndarray) -> np.ndarray:
        """Interpolated log probability, to base 2, of each n-gram's last character after the others."""
        p = np.full(len(code), 1.0 / (1 << SYMBOL_BITS))
        for k, (codes, own, known, handed) in enumerate(reversed(self.levels), 1):
            part = code & ((np.uint64(1) << np.uint64(SYMBOL_BITS * k)) - np.uint64(1)) if SYMBOL_BITS * k < 64 else code
            context = part >> np.uint64(SYMBOL_BITS) if k > 1 else np.zeros_like(part)
            i = np.minimum(np.searchsorted(known, context), len(known) - 1)
            mass = np.where(known[i] == context, handed[i], np.float32(1))
            j = np.minimum(np.searchsorted(codes, part), len(codes) - 1)
            p = p * mass + np.where(codes[j] == part, own[j], np.float32(0))
        return np.log2(p)


def entropies(models: list[KneserNey], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character of each text (row) under each model (column), and whether the text has letters."""
    flat, doc = symbols(texts)
    code, owner = grams(flat, doc, ORDER)
    letters = np.bincount(doc, weights=flat > 0, minlength=len(texts)) > 0
    size = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    found, at = np.unique(code, return_inverse=True)
    return np.stack([-np.bincount(owner, weights=m.log2(found)[at], minlength=len(texts)) / size for m in models], axis=1), letters


def _signs(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What confidence is judged by: the gap to the second language, with and without the length, and the bits."""
    best = np.sort(bits, axis=1)[:, :2]
    gap = best[:, 1] - best[:, 0] if bits.shape[1] > 1 else np.ones(len(bits))
    gap = np.minimum(gap, 3.0)
    return np.stack([np.ones(len(bits)), gap, np.minimum(np.sqrt(gap * np.minimum(size, 2000)), 10) / 3, np.minimum(best[:, 0], 16.0) / 4], axis=1)


class LanguageModel:
    """Models of all languages and the calibration of their confidence."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], check: tuple[list[str], list[str]]):
        self.names = sorted(counts)
        self.models = [KneserNey(*counts[x]) for x in self.names]
        self.weights = np.array([0.0, 2.0, 1.0, -0.5])
        texts, langs = check
        if texts:
            bits, letters = entropies(self.models, texts)
            x = _signs(bits, np.array([len(t) for t in texts]))
            y = np.array([self.names[k] == lang for k, lang in zip(bits.argmin(axis=1), langs, strict=True)]) & letters
            # Newton's method on a ridge-penalised logistic loss
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
                h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
                self.weights = self.weights - np.linalg.solve(h, x.T @ (p - y) + self.weights - np.array([0.0, 2.0, 1.0, -0.5]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a character of each text; `und` and 0 without letters or without models."""
        if not self.models:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits, letters = entropies(self.models, texts)
        x = _signs(bits, np.array([len(t or "") for t in texts]))
        p = np.where(letters, 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), 0.0)
        best = bits.argmin(axis=1)
        return [self.names[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], p, bits.min(axis=1)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, piece: int = PIECE) -> LanguageModel:
    """Learns from text and lang of docs (rows with null in either, or empty texts, are left out).

    A sixth of the sample is kept from the counts and calibrates the score.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.length("text") >= 1))
    counts = known.groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in counts.collect()}
    names = sorted(sizes)
    each = max(LEAST, min(per_language, per_language * FULL_SAMPLES // max(len(names), 1)))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(x, margin(each) / sizes[x]) for x in names], "lang string, _share double")
    size, hashed = F.length("text"), F.xxhash64("doc_id", "lang")
    start = F.when(size > piece, F.pmod(F.xxhash64("doc_id", "text"), size - piece + 1)).otherwise(0)
    near = known.withColumn("_hash", hashed).join(F.broadcast(shares), "lang").where(below(F.col("_hash"), F.col("_share")))
    near = near.select("lang", "_hash", F.substring("text", start.cast("int") + 1, F.lit(piece)).alias("text"))
    order = Window.partitionBy("lang").orderBy("_hash", F.xxhash64("text"))
    sample = written(near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each), "language-sample")
    found = count_grams(sample.where("_rank % 6 != 0")).toArrow()  # bounded by the sample's characters
    counts = {}
    for lang in names:
        own = found.filter(pc.equal(found.column("lang"), lang))
        if own.num_rows:
            counts[lang] = (own.column("code").to_numpy(), own.column("n").to_numpy())
    check = sample.where("_rank % 6 = 0").orderBy("lang", "_rank").select("text", "lang").toArrow()
    return LanguageModel(counts, (check.column("text").to_pylist(), check.column("lang").to_pylist()))


def identify(docs: DataFrame, model: LanguageModel, reject: float = REJECT) -> DataFrame:
    """docs with lang_pred, lang_score, lang_bits and lang_rejected added, each replacing a column of that name.

    Null texts and texts without a letter: `und`, score 0, rejected.  Of languages with equal bits the first by name
    wins.  Only text is read.  Repeated rows score alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mine = ["lang_pred", "lang_score", "lang_bits", "lang_rejected"]
    rows = docs.drop(*mine)
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in zip(mine, kinds, strict=True))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lang, p, bits = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(p), pa.array(bits), pa.array(p < reject)], names=[*part.schema.names, *mine])

    return map_arrow(rows, run, schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
