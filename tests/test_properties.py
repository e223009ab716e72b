"""Randomised brute-force checks of the row functions on one DataFrame of generated texts."""

import random

from pyspark.sql import functions as F

from chatlens.functions.fixed_values import DEFAULT_TOPIC_RULES, PURPOSE_RULES, QUALITY_MARKER_GROUPS
from chatlens.functions.text import word_count
from chatlens.operators.enrich import tag_texts
from test_text_rules import brute_quality, brute_tag

SPACES = [" ", "  ", "\t", "\n", " ", "　", " ", "\x1c", "\x85", " "]


def generated_texts(n=400, seed=7):
    rnd = random.Random(seed)
    vocab = [k for _, ks in DEFAULT_TOPIC_RULES + PURPOSE_RULES for k in ks]
    vocab += [m for _, _, ms in QUALITY_MARKER_GROUPS for m in ms]
    vocab += ["xin", "chào", "bạn", "ok", "Hello", "DỮ LIỆU", "Đ", "ß", "ǅ"]
    out = []
    for _ in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 4, 5, 14, 15, 40, 59, 60, 210]))]
        text = ""
        for w in words:
            text += rnd.choice(SPACES) + (w.upper() if rnd.random() < 0.1 else w)
        if rnd.random() < 0.3:
            text = text.strip()
        out.append(text)
    return out


def test_row_functions_match_brute_force(spark):
    texts = generated_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r.i: r for r in tag_texts(df).withColumn("wc", word_count(F.col("text"))).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert r.wc == len(t.split()), repr(t)
        assert r.word_count == len(t.split())
        assert r.prompt_quality == brute_quality(t), repr(t)
        assert r.topic == brute_tag(t, DEFAULT_TOPIC_RULES), repr(t)
        assert r.purpose == (brute_tag(t, PURPOSE_RULES) if t else "Khác"), repr(t)
