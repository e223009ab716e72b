import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatlens.llm.resample import cutoff, op12_importance_resampling, ranked, resample

from conftest import SF0001

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    def features(text):
        w = WORDS.findall(lowered(text))
        return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, fs, n in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in fs)
        out.append([d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[:percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_the_definition(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    target = [r[0] for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("text").collect()]
    assert rows(op12_importance_resampling(spark, SF0001)) == brute([tuple(r) for r in docs], target)


EDGES = [(1, None), (2, ""), (3, "The cat, the CAT"), (4, "x" * 300 + " ÄÖ straße cat"), (5, "a" * 64 + " " + "b" * 65), (6, "cat " * 40),
         (None, "dog cat"), (8, "cat\x00dog_the-cat 12é"), (9, "  "), (10, "the dog the dog")]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_edges_and_longer_runs(spark, longest):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([("the dog",), (None,), ("a dog",)], "text string")
    got = ranked(docs, target, percent=50, least_words=2, longest_run=longest, buckets=97)
    assert rows(got) == brute(EDGES, ["the dog", "", "a dog"], 50, 2, longest, 97)


@pytest.mark.parametrize("percent", [0, 1, 33, 100])
def test_any_share(spark, percent):
    data = [(k, f"w{k % 7} w{k % 3}") for k in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    assert rows(ranked(docs, target, percent, 1)) == brute(data, ["w1 w2"], percent, 1)


def test_repeated_rows_and_clashing_columns(spark):
    data = [(7, "alpha beta", 1, "r")] * 60 + [(k, "beta gamma", 2, None) for k in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, Rank int, weight string").repartition(4)
    target = spark.createDataFrame([("alpha",)], "text string")
    got = resample(docs, target, 20, 1)
    assert got.columns == ["doc_id", "text", "weight", "score", "rank"]
    got = got.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21)) and all(r["score"] >= s["score"] for r, s in zip(got, got[1:]))
    want = brute([(d, t) for d, t, _, _ in data], ["alpha"], 20, 1)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in want if r[4])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ranked(none, some.select("text")).collect() == []
    assert rows(ranked(some, none.select("text"), 100, 1))[0][4] == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_cutoff_is_exact(spark, parts):
    keys = spark.range(3000).select((F.col("id") % 5).alias("k0"), (-F.col("id") % 11).alias("k1"), F.xxhash64("id").alias("k2"), F.col("id").alias("k3"))
    keys = keys.union(keys.limit(0)).repartition(parts)
    path = spark.conf.get("spark.checkpoint.dir") + f"/cutoff-{parts}"
    keys.write.mode("overwrite").parquet(path)
    keys = spark.read.parquet(path)
    order = sorted(tuple(r) for r in keys.collect())
    for k in (1, 2, 777, 2999, 3000):
        assert cutoff(keys, k) == order[k - 1]
    assert cutoff(keys, 0) is None and cutoff(keys, 3001) is None
