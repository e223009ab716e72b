"""Toxicity by a classifier chain.

One linear model per category, in a stated order. Each sees the text's features and the
probabilities of all earlier categories. For training, those probabilities come from
out-of-fold models (each labelled document is scored by models that did not see it), so that
later links learn from predictions as good as they will get; scoring uses models of all folds.

Features: words and word prefixes (present or not), hashed to 64 bits. The ``features`` ones that
differ most between the classes of the training sample are kept. Training takes at most about
``sample`` labelled rows, chosen by a hash of doc_id; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .batches import chunks, text_bytes, word_features
from .common import DOC_ID, packed, table, unpacked, written
from .linear import fit_logistic, sigmoid

PREFIXES = (4, 5, 6)
SAMPLE, FEATURES, FOLDS, THRESHOLD = 8000, 600, 3, 0.4


@dataclass(frozen=True)
class Chain:
    """A trained chain: sorted feature hashes and one weight row per category
    (features, earlier probabilities, intercept)."""

    categories: tuple[str, ...]
    vocabulary: np.ndarray
    weights: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = np.zeros((len(x), 0))
        for w in self.weights:
            z = x @ w[:x.shape[1]] + p @ w[x.shape[1]:-1] + w[-1]
            p = np.hstack([p, sigmoid(z)[:, None]])
        return p

    def score(self, col: pa.Array) -> np.ndarray:
        """Category probabilities per text of an Arrow array; whole texts."""
        data, off = text_bytes(col)
        out = np.zeros((len(col), len(self.categories)))
        n = len(self.vocabulary)
        for s, e in chunks(off):
            doc, h = word_features(data[off[s]:off[e]], off[s:e + 1] - off[s], PREFIXES)
            at = np.minimum(np.searchsorted(self.vocabulary, h), max(n - 1, 0))
            hit = self.vocabulary[at] == h if n else np.zeros(len(h), bool)
            for k in range(s, e, 2048):
                x = np.zeros((min(2048, e - k), n))
                own = hit & (doc >= k - s) & (doc < k - s + len(x))
                x[doc[own] - (k - s), at[own]] = 1.0
                out[k:k + len(x)] = self.probabilities(x)
        return out


def fit_chain(at: Sequence[Sequence[int]], labels: np.ndarray, categories: Sequence[str], vocabulary: np.ndarray,
              scale: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fits the chain. at: per row the positions in ``vocabulary`` of its features; labels: (rows,
    categories) of 0 and 1. Without rows, or for a category with one class only, the model
    is its prior."""
    x = np.zeros((len(at), len(vocabulary)), dtype=np.float32)
    for k, on in enumerate(at):
        x[k, on] = scale[on]
    fold = np.arange(len(x)) % folds
    earlier, weights = np.zeros((len(x), 0), dtype=np.float32), []
    for c in range(labels.shape[1]):
        y, z = labels[:, c].astype(float), np.hstack([x, earlier])
        w = _fit(z, y)
        w[:len(vocabulary)] *= scale
        weights.append(w)
        held = np.zeros(len(x), dtype=np.float32)
        for f in range(folds):
            out = fold == f
            w = _fit(z[~out], y[~out])
            held[out] = sigmoid(z[out] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, held[:, None]])
    return Chain(tuple(categories), vocabulary, tuple(weights))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(y) == 0 or y.min() == y.max():
        p = min(max(y.sum() / (len(y) + 1), 1e-6), 1 - 1e-6)
        return np.append(np.zeros(x.shape[1]), np.log(p / (1 - p)))
    return fit_logistic(x, y, l2=max(1e-6, 0.01 / len(y)), steps=300)


def _hashes(rows: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(_id, h): the different features of each text; with a vocabulary, their positions in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(1))
            for s, e in chunks(off):
                doc, h = word_features(data[off[s]:off[e]], off[s:e + 1] - off[s], PREFIXES)
                if vocabulary is not None:
                    at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                    own = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                    doc, h = doc[own], at[own].astype(np.uint64)
                by = np.lexsort((h, doc))
                doc, h = doc[by], h[by]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
                ends = np.searchsorted(doc[new], np.arange(e - s + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.LargeListArray.from_arrays(
                    pa.array(ends, pa.int64()), pa.array(h[new].view(np.int64))).cast(pa.list_(pa.int64()))], names=["_id", "h"])

    return rows.select("_id", "text").mapInArrow(run, "_id long, h array<long>")


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE,
          features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Trains on about ``sample`` labelled rows at most (all, if there are fewer).

    categories: name to boolean Column over ``labels``, in the chain's order. Labels with a
    null in any category, or whose doc_id is null or unknown, do not train. A repeated label
    holds if one of its rows says so, for every text of its doc_id; rows alike in both train once. Features are
    counted and chosen by Spark; the driver gets the sample's chosen features alone.
    """
    c = [f"_c{i}" for i in range(len(categories))]
    flags = labels.select(F.col(DOC_ID).cast("long").alias("_id"), *[v.cast("int").alias(n) for n, v in zip(c, categories.values(), strict=True)])
    flags = flags.dropna().groupBy("_id").agg(*[F.max(x).alias(x) for x in c])
    n = flags.count()
    share = min(1.0, sample / n) if n else 1.0
    pick = flags.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = written(docs.select(F.col(DOC_ID).cast("long").alias("_id"), "text").join(pick, "_id").groupBy(
        F.xxhash64("_id", "text").alias("_id")).agg(F.min("text").alias("text"), *[F.max(x).alias(x) for x in c]), "sample")
    n = rows.count()
    if n > sample:  # a doc_id of many texts
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(sample / n * 1_000_000))
    every = rows.agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in c]).first()
    stats = _hashes(rows).join(rows.drop("text"), "_id").select(F.explode("h").alias("h"), *c).groupBy("h").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(x) for x in c]).where("n >= 3")
    # how many standard errors the feature's shares in the two classes are apart
    spread = (F.col("n") + 1) / (every["n"] + 2)
    apart = [F.abs(F.col(x) / p - (F.col("n") - F.col(x)) / q) / F.sqrt(spread * (1 - spread) * (1 / p + 1 / q))
             for x in c for p, q in [(float(max(every[x] or 0, 1)), float(max(every["n"] - (every[x] or 0), 1)))]]
    best = stats.select("h", F.array_max(F.array(*apart)).alias("z")).where("z >= 3").orderBy(F.desc("z"), "h").limit(features).collect()
    h = np.array([r["h"] for r in best], dtype=np.int64).view(np.uint64)
    z = np.array([r["z"] for r in best], dtype=np.float32)
    by = np.argsort(h)
    vocabulary, scale = h[by], z[by] / z.max() if len(z) else z
    # Scaled by that distance, a sure feature is cheaper to use than a doubtful one.
    kept = _hashes(rows, vocabulary).join(rows.drop("text"), "_id").orderBy("_id").toPandas()
    y = kept[c].to_numpy(dtype=float).reshape(len(kept), len(c))
    return fit_chain([np.asarray(x, dtype=np.int64) for x in kept["h"]], y, list(categories), vocabulary, scale, folds)


def scores(chain: Chain) -> Column:
    """Category probabilities of the column ``text``, in the chain's order."""
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            p = chain.score(col)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
    return run("text")


def label_categories() -> dict[str, Column]:
    """The chain of the given labels: low quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def with_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """``docs`` plus one probability column p_<category> per category and ``rejected``:
    whether the last category's probability reaches ``threshold``.

    Every row is kept and scored on its whole text. Null and empty texts have no feature:
    they get the intercept's probabilities and are never rejected. Repeated rows
    get equal results; an empty table gives no rows; without labels nothing is rejected.
    Input columns named like a result give way to it.
    """
    cats = label_categories()
    chain = train(docs, labels, cats, **kw)
    p = packed(docs, text=F.col("text")).withColumn("p", scores(chain))
    probs = {f"p_{c}": F.get("p", i) for i, c in enumerate(cats)}
    rejected = F.coalesce(F.length("text") > 0, F.lit(False)) & (F.get("p", len(cats) - 1) >= threshold)
    return unpacked(p, docs.columns, **probs, rejected=rejected)


def drop_toxic(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents the chain rejects; columns unchanged."""
    held = packed(docs, doc_id=F.col(DOC_ID), text=F.col("text"))
    return unpacked(with_toxicity(held, labels, **kw).where("not rejected"), docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: probabilities and verdict for every document."""
    out = with_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_low_quality", "p_toxic", "rejected")
