"""Prompt clustering (ML-1): TF-IDF on word 1- and 2-grams, k-means with restarts.

Tokens are runs of two or more word characters (letters, numbers, underscore) of the
lower-cased text, bigrams come from the token sequence; the vocabulary keeps the
most frequent terms (ties: the smaller term), the idf is ``ln((1+n)/(1+df)) + 1``, and
a prompt's weights have length 1. Equal texts are one row with their number, which is its
weight in the counts and in k-means, so a text that is a third of all prompts is one row.
The texts' terms are computed once, dealt by hash to a stated number of partitions
and sorted there, so that k-means starts alike however the input was split. K-means runs ``n_init`` times with
different seeds and keeps the lowest within-cluster cost. Everything is distributed;
only the vocabulary (<= max_features terms) and the k centres live on the driver.
Fewer prompts than clusters -> null labels.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark import StorageLevel

from ..functions.text import null_safe_string
from ..session import written

# Clustering sizes of the reproduced behaviour.
N_CLUSTERS = 15
MAX_FEATURES = 5000
N_INIT = 10
SEED = 42
MAX_ITER = 300
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
#: Setting of the session that says into how many partitions the feature table goes, whatever the input's.
PARTITIONS_KEY = "spark.sql.shuffle.partitions"


def prompt_terms(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``terms``: the 1- and 2-grams of the text's tokens; missing text has none (SCL-12)."""
    tokens = F.regexp_extract_all(F.lower(null_safe_string(F.col(text_col))), F.lit(TOKEN_PATTERN), F.lit(0))
    pairs = F.zip_with(F.slice("_uni", 1, F.greatest(F.size("_uni") - 1, F.lit(0))), F.slice("_uni", 2, F.size("_uni")),
                       lambda a, b: F.concat_ws(" ", a, b))
    return texts.withColumn("_uni", tokens).withColumn("terms", F.concat("_uni", pairs)).drop("_uni")


def vocabulary(terms: DataFrame, max_features: int = MAX_FEATURES, weight: str | None = None) -> DataFrame:
    """(term, total, df, idf): the ``max_features`` most frequent terms, ties by term. ``weight``: column with
    the number of prompts that a row stands for."""
    n_rows = F.col(weight) if weight else F.lit(1)
    # The empty term stands in every row: its df is the number of prompts, and it leads the cut.
    marked = terms.select(F.concat(F.array(F.lit("")), "terms").alias("t"), n_rows.cast("long").alias("_n"))
    each = marked.select(F.explode(F.array_distinct("t")).alias("term"), "_n").groupBy("term").agg(F.sum("_n").alias("df"))
    every = marked.select(F.explode("t").alias("term"), "_n").groupBy("term").agg(F.sum("_n").alias("total"))
    top = every.join(each, "term").orderBy(F.col("term") != "", F.desc("total"), "term").limit(max_features + 1)
    n = F.max(F.when(F.col("term") == "", F.col("df"))).over(Window.partitionBy())  # over the cut vocabulary only
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    return top.withColumn("idf", idf).where("term <> ''").select("term", "total", "df", "idf")


def term_weights(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): tf * idf over the vocabulary, scaled to length 1 per key."""
    tf = terms.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(vocab, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("_w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, key).select(key, "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def tfidf_features(terms: DataFrame, max_features: int = MAX_FEATURES, weight: str | None = None) -> DataFrame:
    """Add ``features`` to rows with ``terms``: the weights of ``term_weights`` as a vector."""
    vocab = vocabulary(terms, max_features, weight).orderBy(F.desc("total"), "term").select("term", "idf").collect()
    if not vocab:
        return terms.withColumn("features", F.lit(None))
    cv = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab], inputCol="terms", outputCol="_tf")
    scale = Vectors.dense([r["idf"] for r in vocab])
    df = ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_tfidf").transform(cv.transform(terms))
    return Normalizer(p=2.0, inputCol="_tfidf", outputCol="features").transform(df).drop("_tf", "_tfidf")


def best_kmeans(feats: DataFrame, n_clusters: int = N_CLUSTERS, n_init: int = N_INIT, seed: int = SEED,
                max_iter: int = MAX_ITER, parallel_restarts: int = N_INIT):
    """Fit k-means ``n_init`` times (seeds ``seed..seed+n_init-1``); return (lowest-cost model, all costs).

    Restarts are independent Spark jobs submitted from a few threads, so the scheduler runs them side
    by side. Ties in cost keep the earlier seed. Sums arrive in task order, so costs agree to rounding. A
    column ``weight`` is the number of prompts of a row.
    """
    weighted = {"weightCol": "weight"} if "weight" in feats.columns else {}

    def fit(i):
        model = KMeans(k=n_clusters, seed=seed + i, maxIter=max_iter, tol=1e-4,
                       featuresCol="features", predictionCol="_cluster", **weighted).fit(feats)
        return model.summary.trainingCost, i, model

    with ThreadPoolExecutor(max_workers=max(1, min(n_init, parallel_restarts))) as pool:
        fits = list(pool.map(fit, range(n_init)))
    best = min(fits, key=lambda f: (f[0], f[1]))
    return best[2], [f[0] for f in fits]


def cluster_prompts(prompts: DataFrame, n_clusters: int = N_CLUSTERS, max_features: int = MAX_FEATURES,
                    n_init: int = N_INIT, seed: int = SEED, max_iter: int = MAX_ITER,
                    parallel_restarts: int = N_INIT, partitions: int | None = None) -> DataFrame:
    """``prompts`` plus an integer ``cluster`` column (null when there are fewer prompts than clusters).

    Equal texts get equal labels, so labels are found per distinct text and joined back by it.
    """
    if prompts.limit(n_clusters).count() < n_clusters:
        return prompts.withColumn("cluster", F.lit(None).cast("long"))
    feats = clustering_features(prompts, max_features, partitions)
    try:
        model, _costs = best_kmeans(feats, n_clusters, n_init, seed, max_iter, parallel_restarts)
        labels = written(model.transform(feats).select(F.col("_text"), F.col("_cluster").cast("long").alias("cluster")), "clusters")
    finally:
        feats.unpersist()
    text = F.xxhash64(null_safe_string(F.col("text")))
    return prompts.withColumn("_text", text).join(labels, "_text").select(*prompts.columns, "cluster")


def clustering_features(prompts: DataFrame, max_features: int = MAX_FEATURES,
                        partitions: int | None = None) -> DataFrame:
    """Persisted TF-IDF features, a row per distinct text: its hash (``_text``), ``weight`` (prompts that have
    it) and ``features``.

    The source is read once: terms are persisted in ``partitions`` partitions (as many as the session shuffles
    to, if not given) by text hash, in the same order however the input was split.
    """
    partitions = partitions or int(prompts.sparkSession.conf.get(PARTITIONS_KEY))
    text = null_safe_string(F.col("text"))
    rows = prompts.groupBy(F.xxhash64(text).alias("_text")).agg(F.min(text).alias("text"), F.count(F.lit(1)).cast("double").alias("weight"))
    terms = prompt_terms(rows).select("_text", "weight", "terms").repartition(
        partitions, "_text").sortWithinPartitions("_text").persist(StorageLevel.MEMORY_AND_DISK)
    feats = tfidf_features(terms, max_features, "weight").select("_text", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
    feats.count()
    terms.unpersist()
    return feats
