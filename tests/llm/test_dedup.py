"""SimHash near-duplicates and line dedup against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatlens.llm import linededup, simhash
from chatlens.llm.common import components

SCHEMA = "doc_id long, text string, _h string, ROW string, fingerprint int, lines_removed int, source string, n_chars long"
BASE = "one two three four five six seven eight nine ten eleven twelve " * 30


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "s", 0) for i, t in pairs], SCHEMA)


EDGE = [(3, BASE), (1, BASE), (2, BASE + "more"), (7, None), (8, ""), (9, " \n\t"), (5, "alone here"), (5, "alone here"), (None, BASE), (None, None),
        (11, "A b C"), (12, "a B c"), (13, "word " * 200_000)]


def brute_classes(pairs, radius=2):
    fp = [simhash.fingerprint(None if t is None else t.encode()) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(pairs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, fp[i], low.get(find(i))) for i, (d, _) in enumerate(pairs))


def test_simhash_against_brute_force(spark):
    pairs = EDGE + [(100 + k, BASE.replace("seven", f"s{k}", k % 5)) for k in range(60)]
    got = simhash.classes(rows(spark, pairs)).select("doc_id", "fp", "component_id").collect()
    assert Counter((r[0], r[1] % (1 << 64), r[2]) for r in got) == brute_classes(pairs)


def test_fingerprint_by_definition():
    import xxhash
    for text in ("a b c d e", "A  b\tC", "x", "", "é Ü z z z z"):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = low.split()
        sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(text.encode()) == want


def test_bk_tree_finds_exactly_the_ball():
    import random
    rng = random.Random(3)
    vals = sorted({rng.getrandbits(64) & 0xFFFF00000000000F | rng.getrandbits(10) for _ in range(400)})
    tree = simhash.BKTree()
    for v in vals:
        tree.add(v)
    for q in vals[::17]:
        for r in (0, 1, 2, 5):
            assert sorted(tree.values[i] for i in tree.within(q, r)) == [v for v in vals if (v ^ q).bit_count() <= r]


@pytest.mark.parametrize("limit", [3, 40, 4096])
def test_links_complete_when_shards_are_split(spark, limit):
    import random
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    vals = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(120)}
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_limit=limit)
    got = {r[0]: r[1] for r in components(links).collect()}
    group = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert {v: got.get(v, v) for v in signed} == group


def test_keep_one_keeps_one_of_each_group_and_all_columns(spark):
    out = simhash.keep_one(rows(spark, EDGE))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = Counter(r["doc_id"] for r in out.collect())
    classes = {r["root"]: r["component_id"] for r in simhash.classes(rows(spark, EDGE)).collect()}
    assert kept == Counter(classes.values())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)] + [(300, 200), (200, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 300: 200}


def lines_brute(pairs, min_words):
    """By definition: a line goes if a run through it, of enough words, occurs earlier."""
    order = sorted({(d is None, d or 0, h, t) for d, h, t in pairs})
    seqs = [[x for x in (t or "").split("\n") if x.split()] for *_, t in order]
    gone = {}
    for a, s in enumerate(seqs):
        n = [len(x.split()) for x in s]
        cut = set()
        for b in range(len(s)):
            best = 0
            for c in range(a + 1):
                for e in range(len(seqs[c]) if c < a else b):
                    k = 0
                    while b + k < len(s) and e + k < len(seqs[c]) and s[b + k] == seqs[c][e + k]:
                        k += 1
                    best = max(best, k)
            if best and sum(n[b:b + best]) >= min_words:
                cut.update(range(b, b + best))
        gone[order[a][1] if not order[a][0] else None, order[a][3]] = cut
    return gone


def expected_text(text, cut):
    if text is None:
        return None
    at, keep, drop = -1, [], False
    for x in text.split("\n"):
        if x.split():
            at += 1
            drop = at in cut
        if not drop:
            keep.append(x)
    return "\n".join(keep)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_brute_force(spark, seed):
    import random
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(14)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(25)]
    passage = "\n".join(pool[:9])
    texts += [passage, "x y\n" + passage, passage + "\n" + passage, None, "", "\n\n"]
    pairs = [(k % 29 if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, texts[1])]
    df = rows(spark, pairs)
    hashes = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64("text")).collect()}
    want = lines_brute([(d, hashes[d, t], t) for d, t in pairs], 8)
    got = linededup.dedup_lines(df, min_words=8).select("doc_id", "text", "lines_removed", "n_chars", "_h").collect()
    exp = Counter((d, expected_text(t, want[d, t]), len(want[d, t])) for d, t in pairs)
    assert Counter((r[0], r[1], r[2]) for r in got) == exp
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["_h"] == "x" for r in got)


def test_line_dedup_of_empty_table(spark):
    assert linededup.dedup_lines(rows(spark, [])).count() == 0
    assert simhash.keep_one(rows(spark, [])).count() == 0
