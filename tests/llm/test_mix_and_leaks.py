"""Mixing and benchmark decontamination against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chatlens.llm import decontaminate, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_rounds(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def mix_rows(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 120)), rng.choice(["b", "a", "A", "é", None] + ["hot"] * 5)) for k in range(900)]
    rows += [(5000 + k, "x y", "tiny") for k in range(3)] + [(6000, None, "none"), (None, "a b c", "hot"), (6001, "", "none")]
    rows += [(7000, "same row here", "hot")] * 400 + [(7000, "same row HERE", "hot")] * 3
    return rows, spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, taken string, size int")


def test_mix(spark):
    rows, df = mix_rows(spark)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = targets_by_rounds(dict(size))
    got = mix.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        rate = want[r["source"]] / size[r["source"]] if size[r["source"]] else 0
        if r["size"]:
            assert int(rate + 1e-9) <= r["copies"] <= int(rate) + 1
    for s in size:
        assert abs(taken[s] - want[s]) <= 3 * longest[s] + 0.01 * want[s]
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(df.repartition(7)).collect()))


def test_mix_texts_agrees_with_the_plan(spark):
    rows, df = mix_rows(spark)
    a = sorted((str(r["doc_id"]), str(r["source"]), r["copies"], r["size"]) for r in mix.mix(df).collect())
    out = mix.mix_texts(df)
    assert a == sorted((str(r["doc_id"]), str(r["source"]), r["copies"], r["size"]) for r in out.collect())
    assert mix.mix(df.limit(0)).count() == 0


def test_long_groups_are_dealt_in_stretches(spark):
    rows = [(1, "a", 5, 23, 30), (None, None, 5, 10, 3), (2, "a", 5, 1, 1), (3, "b", 0, 11, 0)]
    plan = spark.createDataFrame(rows, "doc_id long, source string, size long, rows long, copies long")
    every = sorted((str(r["doc_id"]), r["at"], r["copies"]) for r in mix._dealt(plan).collect())
    assert every == sorted((str(d), at, c) for d, _, _, n, c in rows for at in range(1, n + 1))
    for stretch in (1, 4, 10, 22, 23):
        assert sorted((str(r["doc_id"]), r["at"], r["copies"]) for r in mix._dealt(plan, stretch).collect()) == every


def test_pivotal_rounding_sums_and_marginals(spark):
    p = [0.1, 0.3, 0.45, 0.5, 0.65, 0.9] * 50
    entries = spark.createDataFrame([(k, 1, k % 9 + 1, x) for k, x in enumerate(p)], "k long, grp long, size long, p double")
    hits = [0.0] * len(p)
    for seed in range(12):
        ups = dict(mix.pivotal_round(entries, fan_in=8, seed=seed).collect())
        assert set(ups) == set(range(len(p))) and abs(sum(ups.values()) - sum(p)) < 1
        for k, v in ups.items():
            hits[k] += v
    for x in sorted(set(p)):
        share = [hits[k] / 12 for k in range(len(p)) if p[k] == x]
        assert abs(sum(share) / len(share) - x) < 0.08


def toks(t):
    return [x for x in re.split(r"[^\w]+|_", t.lower()) if x] if t else []


def leaks_brute(docs, items, window=13, similarity=0.8):
    out = set()
    for d, t in docs:
        a = toks(t)
        for i, b in items:
            b = toks(b)
            for shift in range(-len(b) + 1, len(a)) if b else ():
                eq = [int(0 <= j + shift < len(a) and a[j + shift] == b[j]) for j in range(len(b))]
                w = min(window, len(b))
                if max(sum(eq[k:k + w]) for k in range(len(b) - w + 1)) / w >= similarity:
                    out.add((d, i))
    return out


def leak_rows():
    rng = random.Random(8)
    voc = ["w%d" % k for k in range(60)]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(k, text(rng.randint(13, 40))) for k in range(12)] + [(20, "short one here"), (21, None), (22, "!!"), (23, "solo")]
    items += [(30, items[0][1])]
    docs = [(k, text(rng.randint(0, 200))) for k in range(30)]
    for k in range(40):
        b = toks(items[k % 12][1])
        cut = b[:rng.randint(13, len(b))]
        for at in rng.sample(range(len(cut)), rng.randint(0, len(cut) // 7)):
            cut[at] = "zz"
        docs.append((100 + k, text(20) + ", " + " ".join(cut).upper() + ". " + text(15)))
    docs += [(200, "A Short-one, here!"), (201, None), (202, ""), (203, "..."), (None, "solo"), (204, items[1][1]), (204, items[1][1])]
    return docs, items


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_overlaps_against_brute_force(spark, few):
    docs, items = leak_rows()
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, tok string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b, broadcast_seeds=few).collect()}
    want = leaks_brute(docs, [x for x in items if x[0] != 30])
    assert got == want
    clean = decontaminate.decontaminate(d, b, broadcast_seeds=few)
    assert clean.columns == d.columns
    bad = {x for x, _ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    assert decontaminate.overlaps(d.limit(0), b).count() == 0 and decontaminate.overlaps(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_short_items_with_each_permitted_substitution(spark, few):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 13)]
    docs = [(1, "i5w0 i5w1 x x i5w4"), (2, "i9w1 i9w2")]
    for n, text in items:
        most = n // 5
        for r in range(min(most + 2, n)):  # one more than permitted stays clean
            for gone in combinations(range(n), r):
                t = ["zz" if k in gone else x for k, x in enumerate(text.split())]
                docs.append((len(docs) + 10, "before " * (len(docs) % 3) + " ".join(t) + " after" * (len(docs) % 2)))
        docs += [(len(docs) + 10, text.split(" ", most)[-1]), (len(docs) + 11, " ".join(text.split()[:n - most]))]  # cut off at a border
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b, broadcast_seeds=few).collect()} == want and len(want) > 200
    low = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b, masks=((0, 1, 2),), window=4, similarity=0.75, broadcast_seeds=few).collect()}
    assert {x for x in leaks_brute(docs, items, 4, 0.75) if x[1] < 4} == {x for x in low if x[1] < 4}


def test_masks_are_lossless_for_two_of_thirteen():
    for gone in combinations(range(decontaminate.WINDOW), 2):
        assert any(all(s + o not in gone for o in m) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def test_long_items_by_broadcast_and_by_shuffle_agree(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(k if k % 7 else None, " ".join(word() for _ in range(150))) for k in range(40)]
    docs = []
    for k in range(60):
        own = [word() for _ in range(rng.randrange(30))]
        passage = items[k % 40][1].split()[rng.randrange(60):][:rng.randrange(5, 60)]
        passage = [word() if rng.random() < 0.1 else w for w in passage]
        docs.append((k if k % 5 else None, " ".join(own + passage + own)))
    docs += [(1, docs[1][1]), (2, None), (3, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(str, decontaminate.overlaps(d, b, **kw).collect())) for kw in ({}, {"broadcast_seeds": 0}, {"broadcast_bytes": 0})]
    assert got[0] == got[1] == got[2] and len(got[0]) > 30


def test_documents_are_not_shuffled_for_few_leaks(spark):
    docs, items = leak_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.decontaminate(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Exchange hashpartitioning" not in plan


def test_bitmap_lets_every_seed_through_and_little_else(spark):
    seeds = spark.range(30_000).select("id", F.xxhash64("id").alias("key"))
    keyed = spark.range(10_000, 230_000).select("id", F.lit("x").alias("x"), F.xxhash64("id").alias("key"))
    for most, share in ((16 << 20, 0.08), (0, 0.08)):  # 64 KB are 17 bits a seed
        left = {r["id"] for r in decontaminate._possible(keyed, seeds.select("key"), 30_000, most).collect()}
        assert left >= set(range(10_000, 30_000)) and len(left) < 20_000 + share * 200_000
    twice = keyed.unionAll(keyed.where("id < 10010"))
    assert decontaminate._possible(twice, seeds.select("key"), 30_000, 0).where("id < 10010").count() == 20
    assert decontaminate._possible(keyed, seeds.select("key").limit(0), 0, 0).count() == 0


def test_hashes_without_a_seed_do_not_move(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(100_000)}"
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)]
    docs = [(k, " ".join(word() for _ in range(200)) + (" " + items[k][1] if k < 20 else "")) for k in range(300)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    joined = []
    plain = decontaminate.written

    def seen(df, name):
        if name == "diagonals":  # the rows of both sides that meet by their hash
            joined.append(df)
        return plain(df, name)

    decontaminate.written = seen
    try:
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b, broadcast_seeds=0).collect()}
    finally:
        decontaminate.written = plain
    assert got == {(k, k) for k in range(20)}
    assert "words#" in joined[0]._jdf.queryExecution().optimizedPlan().toString()
