"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1 bits. One binary linear model per bit, over hashed
byte n-grams, predicts that bit; decoding adds up, per language, the logistic losses of its
bits, weighted by how well each bit's model does on that language (out of fold), and takes the
language of least loss. Up to five languages get the exhaustive code (every split into two
sides is a bit), more get the best of many seeded random codes. A text whose two nearest codewords
are almost equally near is flagged ambiguous.

Training takes at most about ``per_language`` labelled rows of each language, chosen by a hash
of doc_id; prediction reads whole texts and nothing but texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .batches import chunks, text_bytes
from .common import DOC_ID, TEXT_HASH, table, text_hash
from .linear import fit_logistic

BUCKETS, PER_LANGUAGE, FOLDS, MARGIN = 1 << 12, 600, 3, 0.2
_TEXTS_AT_ONCE = 1000
_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])


def ngram_features(data: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """(texts, buckets): square roots of the shares of a text's byte 1- to 3-grams per bucket.
    The bytes of all texts follow each other; no n-gram crosses the end of a text."""
    n = len(off) - 1
    out = np.zeros(n * buckets, dtype=np.float64)
    if len(data):
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
        code = data.astype(np.uint32)
        gram = code.copy()
        for size in (1, 2, 3):
            if size > 1:
                if len(data) < size:
                    break
                gram = gram[:-1] * np.uint32(257) + code[size - 1:]
                same = doc[:len(gram)] == doc[size - 1:]
                at, g = doc[:len(gram)][same], gram[same]
            else:
                at, g = doc, gram
            h = (g + np.uint32(size)) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) % np.uint32(buckets)
            out += np.bincount(at * buckets + h, minlength=n * buckets)
    x = out.reshape(n, buckets)
    total = np.maximum(x.sum(axis=1, keepdims=True), 1)
    return np.sqrt(x / total).astype(np.float32)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """(k, bits) of +1 and -1; the first language's bits are all +1 in the exhaustive code."""
    if k <= 1:
        return np.zeros((k, 0), dtype=np.int8)
    if k <= 5:
        cols = [np.array([1] + [1 if i in side else -1 for i in range(1, k)])
                for r in range(k - 1) for side in map(set, combinations(range(1, k), r))]
        return np.array(cols, dtype=np.int8).T
    rng, best = np.random.default_rng(seed), None
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        if (np.abs(m.sum(axis=0)) == k).any():
            continue
        near = min(int((a != b).sum()) for a, b in combinations(m, 2))
        if best is None or near > best[0]:
            best = (near, m)
    return best[1]


@dataclass(frozen=True)
class Codebook:
    """A trained decoder: languages, codewords, bit models and the weights of their losses."""

    languages: tuple[str, ...]
    code: np.ndarray
    models: np.ndarray  # (bits, buckets + 1)
    weight: np.ndarray  # (languages, bits), rows add up to 1

    def likelihoods(self, x: np.ndarray) -> np.ndarray:
        """(texts, languages), rows adding up to 1: softmin of the weighted losses."""
        if self.code.shape[1] == 0:
            return np.ones((len(x), len(self.languages)))
        f = x @ self.models[:, :-1].T + self.models[:, -1]
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None])
        d = (loss * self.weight[None]).sum(axis=2) * self.code.shape[1]
        e = np.exp(d.min(axis=1, keepdims=True) - d)
        return e / e.sum(axis=1, keepdims=True)


def train_codebook(texts: Sequence[str], langs: Sequence[str], folds: int = FOLDS) -> Codebook:
    names = tuple(sorted(set(langs)))
    code = codewords(len(names))
    data, off = text_bytes(pa.array(list(texts), type=pa.string()))
    x = np.vstack([ngram_features(data[off[s]:off[e]], off[s:e + 1] - off[s]) for s, e in _parts(off)] or [np.zeros((0, BUCKETS), np.float32)])
    y = np.searchsorted(np.array(names), np.array(list(langs))) if names else np.zeros(0, int)
    fold = np.arange(len(y)) % folds
    models, right = [], np.ones(code.shape)
    for b in range(code.shape[1]):
        bit = (code[y, b] > 0).astype(np.float32)
        models.append(fit_logistic(x, bit, l2=1e-5, steps=80))
        ok = np.zeros(len(y))
        for f in range(folds):
            out = fold == f
            if out.any() and not out.all():
                w = fit_logistic(x[~out], bit[~out], l2=1e-5, steps=40)
                ok[out] = ((x[out] @ w[:-1] + w[-1]) > 0) == (bit[out] > 0)
        for c in range(len(names)):
            right[c, b] = (ok[y == c].sum() + 1) / ((y == c).sum() + 2)
    weight = right / right.sum(axis=1, keepdims=True) if code.shape[1] else right
    return Codebook(names, code, np.array(models, dtype=np.float32).reshape(-1, BUCKETS + 1), weight)


def _parts(off: np.ndarray) -> Iterator[tuple[int, int]]:
    for s, e in chunks(off):
        for k in range(s, e, _TEXTS_AT_ONCE):
            yield k, min(e, k + _TEXTS_AT_ONCE)


def held_out() -> Column:
    """Documents that never train: crc32 of the doc_id's text is a multiple of 5. Null: no."""
    return F.coalesce(F.crc32(F.col(DOC_ID).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Codebook:
    """Trains on documents not held out, of non-null doc_id, text and lang: about
    ``per_language`` of each language at most, one row per doc_id and text."""
    own = docs.where(~held_out() & F.col(DOC_ID).isNotNull() & F.col("lang").isNotNull()).select(
        F.col(DOC_ID).cast("long").alias("_id"), text_hash().alias(TEXT_HASH), "text", "lang")
    # A row per language, and each language is a class of the model: that many fit a literal.
    rates = [F.lit(x) for r in own.groupBy("lang").count().collect() for x in (r["lang"], min(1.0, per_language / r["count"]))]
    if not rates:
        return train_codebook([], [])
    pick = F.pmod(F.xxhash64("_id", TEXT_HASH), F.lit(1_000_000)) < F.create_map(*rates)[F.col("lang")] * 1_000_000
    rows = own.where(pick & F.col("text").isNotNull()).groupBy("_id", TEXT_HASH).agg(F.min(F.struct("text", "lang")).alias("r")).select(
        "_id", TEXT_HASH, "r.*").orderBy("_id", TEXT_HASH).toPandas()
    return train_codebook(rows["text"].tolist(), rows["lang"].tolist())


def predictions(book: Codebook, margin: float = MARGIN) -> Column:
    """Struct (lang_pred, score, ambiguous) of the column ``text``."""
    @F.arrow_udf(_RESULT)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            data, off = text_bytes(col)
            best, score, close = [], [], []
            for s, e in _parts(off):
                p = book.likelihoods(ngram_features(data[off[s]:off[e]], off[s:e + 1] - off[s]))
                order = np.sort(p, axis=1)
                best.append(p.argmax(axis=1))
                score.append(order[:, -1])
                close.append(order[:, -1] - order[:, -2] < margin if p.shape[1] > 1 else np.zeros(len(p), bool))
            names = np.array(book.languages, dtype=object)
            cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
            yield pa.StructArray.from_arrays([pa.array(names[cat(best, int)], type=pa.string()), pa.array(cat(score, float)),
                                              pa.array(cat(close, bool))], names=["lang_pred", "score", "ambiguous"])
    return run("text")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): one row per row of ``docs``.

    ``und``, score 0 and ambiguous, for null texts, texts without a letter, and when
    nothing can be learned. score is the decoder's share for the language (0 to 1).
    One known language is always predicted, with score 1. Null doc_ids are predicted but never
    train; repeated rows get equal results; other columns of ``docs`` are not used.
    """
    book = train(docs, per_language)
    rows = docs.select(F.col(DOC_ID).cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if not book.languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    got = rows.withColumn("_known", known).withColumn("_p", predictions(book, margin))
    return got.select("doc_id", "held_out", F.when(F.col("_known"), F.col("_p.lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("_known"), F.col("_p.score")).otherwise(0.0).alias("score"),
                      (~F.col("_known") | F.col("_p.ambiguous")).alias("ambiguous"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))
