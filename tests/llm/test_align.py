import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatlens.llm.align import BYTE_BPE, PIECE_BPE, TOKENIZERS, WIDE, _pairs, align, byte_level, common_ends, encode_by_file, link_counts, op13_tokenizer_alignment

from conftest import SF0001

A, B = f"{TOKENIZERS}/{BYTE_BPE}", f"{TOKENIZERS}/{PIECE_BPE}"


def tokens(text):
    """[(id, bytes)] of both sides, by the files' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    global _T, _P, _BYTES
    if "_T" not in globals():
        _T = Tokenizer.from_file(A)
        _T.encode_special_tokens = True
        _P = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        _BYTES = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    if not text:
        return [], []
    a = [(k, bytes(_BYTES[c] for c in _T.id_to_token(k))) for k in _T.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(_P.id_to_piece(k)[3:5], 16)]) if _P.is_byte(k) else _P.id_to_piece(k).replace("▁", " ").encode()) for k in _P.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def groups(text):
    a, b = tokens(text)
    ends = lambda t: np.cumsum([len(x) for _, x in t]).tolist()
    ea, eb = ends(a), ends(b)
    out, last = [], 0
    for end in sorted(set(ea) & set(eb)):
        out.append(([k for (k, _), e in zip(a, ea) if last < e <= end], [k for (k, _), e in zip(b, eb) if last < e <= end]))
        last = end
    return out


def brute(docs):
    per = [(d, groups(t)) for d, t in docs]
    links = [Counter((x, y) for g, h in gs for x in g for y in h) for _, gs in per]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (d, gs), c in zip(per, links):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs)
        out.append((d, sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


EDGES = [None, "", " ", "  ", "\n", "a", "Hello world", "<|endoftext|> </s> <s> <unk> <0x41>", "naïve café – 漢字かな 🙂🙂🏽", "x▁y", "tab\tand  two",
         " 　wide", "ﬁ ligature Å", "0" * 57, "=" * 301, " " * 90 + "end", "na" * 400, "ab\x00cd\x07", "the the the", "\r\n\r\n  x  ", "́", "ฺ๎"]


def test_edges_against_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(EDGES)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for block in (1, 1 << 20):  # a block for each text, one for all of a task
        assert sorted((tuple(r) for r in link_counts(df, block_bytes=block).collect()), key=str) == brute(docs)


def test_whole_table_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_tokenizer_alignment(spark, SF0001).collect()), key=str) == brute(docs)


def test_spans_and_rows(spark):
    df = spark.createDataFrame([(1, "Tokenizers differ", "x"), (2, None, "y")], "doc_id long, text string, a_ids string")
    got = {r["row"]["doc_id"]: r for r in align(df).collect()}
    assert got[1]["row"].asDict() == {"doc_id": 1, "text": "Tokenizers differ", "a_ids": "x"}
    spans = [(got[1]["a_ids"][i:j], got[1]["b_ids"][k:m]) for i, j, k, m in zip(
        [0, *got[1]["a_cut"]], got[1]["a_cut"], [0, *got[1]["b_cut"]], got[1]["b_cut"])]
    assert spans == groups("Tokenizers differ") and got[2]["a_cut"] == []


def test_empty_table(spark):
    assert link_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_diagonal_skipping_finds_every_common_end():
    r = random.Random(3)
    for _ in range(3000):
        n = r.randint(1, 60)
        a, b = (sorted({*(x for x in range(1, n) if r.random() < p), n}) for p in (r.random(), r.random()))
        if r.random() < 0.3:
            b = a[:]
        both = sorted(set(a) & set(b))
        got = common_ends(np.array(a), np.array(b))
        assert (got[0].tolist(), got[1].tolist()) == ([a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both])
    assert [len(x) for x in common_ends(np.array([], int), np.array([], int))] == [0, 0]


def test_wide_groups_count_by_distinct_ids():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 9, 300), r.integers(0, 7, 200)
    a_cut, b_cut = np.array([1, 299, 300]), np.array([2, 199, 200])
    assert 298 * 197 > WIDE
    codes, links = _pairs(a, b, a_cut, b_cut, 100)
    got = Counter()
    for c, n in zip(codes.tolist(), links.tolist()):
        got[c] += n
    want = Counter(int(x * 100 + y) for (i, j), (k, m) in zip([(0, 1), (1, 299), (299, 300)], [(0, 2), (2, 199), (199, 200)]) for x in a[i:j] for y in b[k:m])
    assert got == want


def test_rank_encoder_gives_the_file_s_ids():
    r = random.Random(1)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [r.randrange(0xE000, 0x110000) for _ in range(3000)]
    texts = [f" a{c}b {c} 1{c}2 {c}{c}  {c}!{c}" for c in map(chr, points)]
    texts += [" " + "".join(r.choice(al) for _ in range(400)) for al in ("a", "ab", " \n\tx", "0123 ", "'s't're", "éà漢 ") for _ in range(20)]
    assert all((x == y).all() for x, y in zip(byte_level(A).encode(texts), encode_by_file(A, texts), strict=True))


@pytest.mark.parametrize("text", ["word " * 100_000, "a" * 500_000])
def test_very_long_text(spark, text):
    got = link_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, b = tokens(text)
    assert (got["n_a"], got["n_b"]) == (len(a), len(b)) and got["n_groups"] > 0
