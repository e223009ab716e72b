"""Chat windows, WARC archives and nearest neighbours: round trips and brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import ann, chat, warc

TURNS = "conv_id long, turn long, role string, text string, block int, kind string"


def turn_rows():
    rng = random.Random(6)
    rows = []
    for c in range(12):
        n = rng.randint(1, 30)
        for k in range(n):
            role = "system" if k == 0 and c % 3 == 0 else ("user", "assistant")[k % 2]
            rows.append((c, k, role, "".join(rng.choice("ab é</s>[&lt;\n") for _ in range(rng.randint(0, 200)))))
    rows += [(50, 0, "system", "only")] + [(51, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(40)]
    rows += [(52, 0, "system", "S" * 30)] + [(52, k, "assistant", "x" * (k % 90)) for k in range(1, 60)]
    rows += [(53, None, "user", None), (53, 3, None, "n"), (53, 3, "assistant", "dup"), (53, 3, "assistant", "dup"), (None, 0, "assistant", "&amp;lt; &lb; [/ROLE]</s>")]
    rows += [(54, 0, "assistant", "L" * 300_000), (54, 1, "user", ""), (55, 0, "s<s>[ROLE]", "<|im_start|>")]
    return [(*r, 1, "k") for r in rows]


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("budget,history,turns,block", [(1024, 256, 2, 256), (80, 30, 2, 8), (60, 0, 0, 4), (90, 40, 3, 16)])
def test_chat_round_trip(spark, budget, history, turns, block):
    rows = turn_rows()
    w = chat.windows(spark.createDataFrame(rows, TURNS), budget, history, turns, block).cache()
    want = ordered(rows)
    got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    assert set(got) == set(want)
    for c, v in want.items():
        lost = "".join(x for r, x in v if r == "assistant")
        assert got[c]["n_turns"] == len(v)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    for r in w.select("*", chat.read_turns(F.col("formatted")).alias("back")).collect():
        v, back = want[r["conv_id"]], [(x["role"], x["text"]) for x in r["back"]]
        assert len(back) == r["n_turns"]
        tok = lambda x: -(-len(x[1].encode()) // 4) + chat.TURN_COST
        assert r["tokens"] == sum(map(tok, back)) and r["over_budget"] == (r["tokens"] > budget)
        own = back[r["n_repeated"]:]
        if len(own) > 1 and not (len(own) == 2 and own[0][0] == "system"):
            assert r["tokens"] <= budget
        if v[0][0] == "system":
            assert back[0] == v[0]
        hist = [x for x in back[:r["n_repeated"]] if x != v[0] or v[0][0] != "system"]
        assert len(hist) <= turns and sum(map(tok, hist)) <= history
        assert r["n_turns"] - r["n_repeated"] <= len(v)
        body = r["formatted"][3:]
        assert all(s not in body.replace("[ROLE]", "").replace("[/ROLE]", "").replace("</s>", "") for s in chat.CONTROL)
    w.unpersist()


def test_chat_history_crosses_blocks(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}", 0, "") for k in range(10)]
    df = spark.createDataFrame(rows, TURNS)
    w = chat.windows(df, 1000, 100, 2, 4).collect()
    assert [(r["n_turns"], r["n_repeated"]) for r in w] == [(10, 0)]  # the budget holds all; blocks end no window
    w = chat.windows(df, 100, 40, 2, 4, 1).orderBy("block", "span").collect()
    assert [(r["n_turns"], r["n_repeated"]) for r in w] == [(7, 0), (3, 2), (4, 2)] and len({r["block"] for r in w}) == 2
    assert w[1]["formatted"].startswith("<s>[ROLE]assistant[/ROLE]turn 5</s>[ROLE]user[/ROLE]turn 6</s>")
    assert chat.windows(spark.createDataFrame(rows, TURNS).limit(0)).count() == 0


def test_chat_windows_do_not_depend_on_turn_numbers(spark):
    rows = [(c, k, ("user", "assistant")[(k + c) % 2] if k or c else "system", f"turn {k} " * (k % 5), 0, "") for c in range(3) for k in (range(600), range(300), range(5))[c]]
    def got(number, block):
        df = spark.createDataFrame([(c, number(k), *r) for c, k, *r in rows], TURNS).repartition(5)
        return sorted(map(str, chat.windows(df, 100, 40, 2, block).collect()))
    for block in (4, 256):
        dense = got(lambda k: k, block)
        for number in (lambda k: 10 * k, lambda k: 1000 * k, lambda k: 1_700_000_000 + 61 * k, lambda k: k - 250, lambda k: k or None):
            assert got(number, block) == dense
    one = spark.createDataFrame([(1, k // 100, "user", f"t{k:03}", 0, "") for k in range(600)], TURNS)  # alike turn numbers
    back = chat.read_back(chat.windows(one)).collect()[0]
    assert back["n_turns"] == 600 and back["turns_sha256"] == hashlib.sha256("".join(f"user\nt{k:03}\n" for k in range(600)).encode()).hexdigest()


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    parts = ["&", "amp;", "lt;", "lb;", "<", "[", "</s>", "<s>", "[INST]", "[/ROLE]", "x", "&amp;lt;", "/s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(s in r["e"] for s in chat.CONTROL)


def page_rows():
    big = "é" * 120
    return [(5, "http://a.com/x", big), (3, "http://b.com/y", big), (9, None, big), (4, "u v\r\nEvil: 1", "short"), (1, "http://a.com", "short"), (2, "http://user@WWW.A.com:8/p?q#f", None),
            (None, "x", big), (7, "", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.0\r\n" * 20), (8, "http://a.com/x", "z" * 3_000_000), (3, "http://b.com/y", big), (6, "http://a.com/x", "y" * 100), (10, "q", "y" * 100), (11, "q", "y" * 99), (12, "q", "y" * 99)]


def test_warc_round_trip(spark, scratch_dir):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    for most in (0, 200_000):
        got = warc.archive(df, f"{scratch_dir}/w{most}", per_file=3, broadcast_rows=most).collect()
        first = {}
        for p, _, h in rows:
            h = (h or "").encode()
            if len(h) >= 100:
                first[h] = min(first.get(h, 1 << 62), 1 << 62 if p is None else p)
        want, told = [], set()
        for p, _, h in rows:  # one response of each payload of 100 bytes or more
            h = (h or "").encode()
            best = len(h) < 100 or (first[h] == (1 << 62 if p is None else p) and h not in told)
            told |= {h} if best else set()
            want.append((str(p), len(h), hashlib.sha256(h).hexdigest(), *(("response", None) if best else ("revisit", first[h] if first[h] < 1 << 62 else None))))
        want.sort(key=lambda x: tuple(map(str, x)))
        assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=lambda x: tuple(map(str, x))) == want
        order = sorted(got, key=lambda r: r["place"])
        keys = [(r["url_key"], r["date"], r["page_id"] is None, r["page_id"] or 0) for r in order]
        assert keys == sorted(keys)
    assert any(r["url_key"] == "com,a,www)/p?q#f" for r in got)
    assert warc.archive(df.limit(0), f"{scratch_dir}/none").count() == 0


def test_warc_equal_rows_and_files_by_bytes(spark, scratch_dir):
    rows = [(1, "http://a/", "z" * 200)] * 3 + [(None, "http://b/", "y" * 200)] * 2 + [(5, "http://c/", "z" * 200)]
    rows += [(100 + k, f"http://d/{k}", chr(97 + k % 26) * (300_000 + k)) for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.archive(df, f"{scratch_dir}/bytes", file_bytes=1 << 20).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got if r["payload_bytes"] == 200) == sorted(
        [("1", "response", "None"), ("1", "revisit", "1"), ("1", "revisit", "1"), ("5", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "None")])
    sizes = defaultdict(int)
    for r in got:
        sizes[r["run"]] += r["length"]
    assert len(got) == 18 and max(sizes.values()) < 1_300_000 and len(sizes) >= 5


def test_warc_runs_are_sorted_as_the_index_merges(spark, scratch_dir):
    urls = ["http://a.com/a b", "http://a.com/a!b", "http://a.com/a\tb", "http://a.com/a#b", "http://a.com/a b", "a b", "a!b", "a\x7fb", "a~b", None, ""]
    rows = [(None if k % 3 == 0 else k % 5 * 31_536_000, u, f"h{k}") for k, u in enumerate(urls * 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    key = lambda r: (r["url_key"], r["date"], r["page_id"] is None, r["page_id"] or 0)
    got = warc.archive(df, f"{scratch_dir}/order").collect()
    assert len(got) == len(rows) and {r["run"] for r in got} == {got[0]["run"]}
    run = [key(r) for r in sorted(got, key=lambda r: r["seq"])]
    assert run == sorted(run)
    place = [key(r) for r in sorted(got, key=lambda r: r["place"])]
    assert place == sorted(place)


def test_warc_records_can_be_cut_out(spark, scratch_dir):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    for r in warc.archive(df, f"{scratch_dir}/one").collect():
        with open(r["run"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            (_, length, head, _), = warc.parse_records(f.read(r["length"]))
        assert length == r["length"] and head["warc-target-uri"] == r["url"]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.randint(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree(map(iter, runs))) == sorted(x for r in runs for x in r)


def vectors():
    rng = np.random.default_rng(3)
    v = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32) * rng.choice([1, 5])]) for i in range(300)]
    v += [(1000 + i, [1.0, 2.0, 0.5, 0.0, -1.0, 3.0]) for i in range(200)]  # one hot vector
    v += [(2000, None), (2001, [0.0] * 6), (2020, [float("nan")] + [1.0] * 5), (2021, [float("inf")] + [1.0] * 5), (2022, [None] + [1.0] * 5), (2040, []), (None, [1.0] * 6), (2060, [1.0, 2.0]), (2061, [3.0, 1.0]), (40, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    return v


def neighbours_brute(v, k):
    ok = [(i, np.array(x, dtype=float)) for i, x in v if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    asked = {}
    for i, x in ok:
        if i % 20 == 0 and (i not in asked or tuple(x) < tuple(asked[i])):
            asked[i] = x
    out = []
    for i, q in asked.items():
        s = []
        for j, x in ok:
            if j != i and len(x) == len(q):
                t = 0.0
                for a, b in zip(q, x, strict=True):
                    t += a * b
                s.append((-t, j))
        out += [(i, r + 1, j, -t) for r, (t, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(4096, 2048), (60, 7)])
def test_neighbours_exact(spark, shard, block):
    df = spark.createDataFrame([(i, x, 0) for i, x in vectors()], "vec_id long, embedding array<float>, dim int").repartition(3)
    got = sorted(tuple(r) for r in ann.search(df, shard_size=shard, block=block).collect())
    f32 = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in vectors()]
    assert got == neighbours_brute(f32, 20)
    assert ann.search(df.limit(0)).count() == 0


def test_a_row_repeated_many_times_makes_no_large_shard(spark):
    v = [(i, [float(i % 7) + 1, float(i % 11)]) for i in range(1, 60)] + [(61, [9.0, 9.0])] * 500 + [(62, [9.0, 9.0])] * 3
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(4)
    expected = neighbours_brute(v, 20)
    assert sorted(tuple(r) for r in ann.search(df, shard_size=10).collect()) == expected
    assert sorted(tuple(r) for r in ann.search(df, k=5, shard_size=10_000).collect()) == neighbours_brute(v, 5)
    assert {r[2] for r in expected} == {61} and len(expected) == 40


def test_relaxed_search_leaves_out_and_keeps_recall():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = np.vstack([c + 0.2 * rng.normal(size=(200, 16)) for c in centres])
    ids = np.arange(len(x))
    tree = ann.VPTree.load(ann.VPTree.build(x, ids, float(np.sqrt((x ** 2).sum(axis=1).max())), leaf=32).dump())
    largest = float(np.sqrt((x ** 2).sum(axis=1).max()))
    q, own = x[::40], ids[::40]
    exact = np.argsort(-(q @ x.T) + 1e9 * (own[:, None] == ids[None]), axis=1, kind="stable")[:, :10]
    for relax, least in ((1.0, 1.0), (1.3, 0.8)):
        got, _ = tree.search(q, own, 10, largest, relax)
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, exact, strict=True)]) >= least


def test_chat_windows_do_not_depend_on_the_layout(spark):
    rng = random.Random(12)
    rows = [(1, k, "user" if k % 2 else "assistant", "equal words here", 0, "") for k in range(700)]
    rows += [(2, k, "system" if k == 0 else rng.choice(["user", "assistant"]), "x" * rng.choice([0, 3, 40, 400, 5000]), 0, "") for k in range(300)]
    rows += [(None, k // 3, rng.choice(["system", "user"]), "y" * rng.randrange(90), 0, "") for k in range(90)] + [(3, 1, "user", "short", 0, "")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = [sorted(map(str, chat.windows(df, budget, 256, turns, block, strides).drop("block").collect()))
           for budget, turns in ((1024, 2), (300, 0)) for block, strides in ((10_000, 32), (4, 1), (64, 3))]
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] and len(got[0]) > 20
