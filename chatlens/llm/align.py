"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both token sequences of a text end at increasing byte offsets. Where both have an end, a group
is closed. The ends are compared at the current index shift in stretches of 1, 2, 4, ...
tokens; a stretch that differs is halved until the first difference is found, so a one-to-one
run of n tokens costs about log n comparisons of whole slices. The irregular group behind it
is walked token by token to the next common end, which gives the new shift.

The corpus-wide counts of linked id pairs: tasks cut what they align into blocks of texts and
write, beside each document's pairs, the pairs of each block with the number of its
documents. Summed over blocks, the counts go back to the blocks that hold the pair, not to
documents: a pair of every document is one row per block, and no task sees more than one block.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import DOC_ID, table, written

#: Folder of the vocabulary files, on every machine.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of ids in a block of texts (a longer text is a block of its own), and of text in one batch of results.
BLOCK_BYTES, BATCH_BYTES = 16 << 20, 1 << 20
#: Groups of more links than this are counted by their distinct ids.
WIDE = 4096

# Fixed value: how a byte-level vocabulary of this kind cuts a text before its merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones
    for themselves, the others by the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file: ids of a text, bytes of an id. Strings of special tokens are plain text.

    If the file's merges are in the order of its ids and nothing is normalised, the same
    merges run through the rank encoder, which is several times faster; ids are the same.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        at, vocab = byte_of_char(), model["vocab"]
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        special = {t["content"] for t in spec["added_tokens"]}
        for token, k in vocab.items():
            if token not in special:
                self.bytes[k] = bytes(at[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = (model.get("type") in (None, "BPE") and not model.get("dropout") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix") and spec.get("normalizer") is None
                 and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and sorted(vocab.get(c, -1) for c in at) == list(range(256))
                 and all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges))
                 and len(vocab) - len(special & set(vocab)) == 256 + len(merges))
        if plain:
            import tiktoken

            ranks = {self.bytes[k]: k for t, k in vocab.items() if t not in special}
            name = base64.b64encode(path.encode()).decode()
            own = tiktoken.Encoding(name, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts]
        else:
            self.encode = functools.partial(encode_by_file, path)
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def _file(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode_by_file(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids by the tokenizer file itself."""
    return [np.array(e.ids, dtype=np.int64) for e in _file(path).encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A piece BPE model with byte fallback: ids of a text, bytes of an id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self._model.get_piece_size()
        names = self._model.id_to_piece(list(range(n)))
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    joined = ByteLevel.joined

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._model.encode(t, num_threads=1), dtype=np.int64) for t in texts]


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def runs_and_groups(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """The alignment of two lists of increasing ends with the same last, as pairs of a one-to-one run and the
    irregular group behind it: the run's tokens and its end on both sides, the group's ends (those of the run if
    there is none)."""
    i = j = 0
    n = len(a)
    runs: list[int] = []
    run_a: list[int] = []
    run_b: list[int] = []
    end_a: list[int] = []
    end_b: list[int] = []
    while i < n:
        at = i
        if a[i] == b[j]:
            i, j, step = i + 1, j + 1, 2
            while i < n and a[i:i + step] == b[j:j + step]:
                i, j, step = i + step, j + step, 2 * step
            if i > n:
                i, j = n, j - (i - n)
            while step > 2:  # the first difference lies in the last stretch
                step //= 2
                if i < n and a[i:i + step] == b[j:j + step]:
                    i, j = i + step, j + step
            if i < n and a[i] == b[j]:
                i, j = i + 1, j + 1
        runs.append(i - at)
        run_a.append(i)
        run_b.append(j)
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
        end_a.append(i)
        end_b.append(j)
    return runs, run_a, run_b, end_a, end_b


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side up to the end of each group."""
    runs, run_a, run_b, end_a, end_b = map(np.array, runs_and_groups(a.tolist(), b.tolist()))
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grouped = end_a > run_a
    size = runs + grouped
    last = np.cumsum(size)  # groups up to the end of each pair
    back = np.repeat(last, size) - np.arange(last[-1]) - 1  # groups behind, of the same pair
    lone = np.repeat(grouped, size) & (back == 0)
    back -= np.repeat(grouped, size)
    return (np.where(lone, np.repeat(end_a, size), np.repeat(run_a, size) - back),
            np.where(lone, np.repeat(end_b, size), np.repeat(run_b, size) - back))


def aligned_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """The batches without their column ``text``, with a_ids, b_ids, a_cut, b_cut (see ``align``)."""
    first, second = byte_level(a_path), pieces(b_path)
    lists = pa.list_(pa.int32())

    none = (np.zeros(0, np.int64),) * 4

    def of(texts: list[str | None]) -> list[tuple]:
        live = [k for k, t in enumerate(texts) if t]
        out = [none] * len(texts)
        for k, x, y in zip(live, first.encode([" " + texts[k] for k in live]), second.encode([texts[k] for k in live]), strict=True):
            whole = b" " + texts[k].encode()
            if first.joined(x) == whole and second.joined(y) == whole:
                out[k] = (x, y, *common_ends(np.cumsum(first.sizes[x]), np.cumsum(second.sizes[y])))
        return out

    for batch in batches:
        rest = batch.drop_columns(["text"])
        col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        size = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
        k = 0
        while k < len(col):
            e = max(k + 1, int(np.searchsorted(size, size[k] + BATCH_BYTES, side="right")) - 1)
            got = list(zip(*of(col.slice(k, e - k).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*(c.slice(k, e - k) for c in rest.columns), *(_lists(x) for x in got)],
                                             schema=pa.schema([*rest.schema, *(pa.field(n, lists) for n in ("a_ids", "b_ids", "a_cut", "b_cut"))]))
            k = e


def _lists(rows: tuple) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))


def align(docs: DataFrame, text_col: str = "text", a_path: str = f"{TOKENIZERS}/{BYTE_BPE}",
          b_path: str = f"{TOKENIZERS}/{PIECE_BPE}") -> DataFrame:
    """(row, a_ids, b_ids, a_cut, b_cut), a row per row of ``docs``, which is the struct ``row``.

    a_ids and b_ids are the two tokenizers' ids; group k holds the a tokens from a_cut[k - 1] to
    a_cut[k] and the b tokens from b_cut[k - 1] to b_cut[k]. All four are empty for null and
    empty texts, and where the bytes of either tokenizer are not those of a space and the text.
    """
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("a_ids", "b_ids", "a_cut", "b_cut")]
    return own.mapInArrow(lambda batches: aligned_batches(batches, a_path, b_path), StructType([own.schema["row"], *lists]))


def _pairs(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes, links of each) of one text; a pair may come more than once."""
    m, n = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    wide = np.flatnonzero(m * n > WIDE)
    small = np.flatnonzero(m * n <= WIDE)
    m, n = m[small], n[small]
    links = m * n
    place = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    per = np.repeat(n, links)
    x = np.repeat(a_cut[small] - m, links) + place // np.maximum(per, 1)
    y = np.repeat(b_cut[small] - n, links) + place % np.maximum(per, 1)
    codes, counts = [a[x] * width + b[y]], [np.ones(len(x), np.int64)]
    for g in wide:
        ua, ca = np.unique(a[a_cut[g - 1] if g else 0:a_cut[g]], return_counts=True)
        ub, cb = np.unique(b[b_cut[g - 1] if g else 0:b_cut[g]], return_counts=True)
        codes.append((ua[:, None] * width + ub[None, :]).ravel())
        counts.append((ca[:, None] * cb[None, :]).ravel())
    return np.concatenate(codes), np.concatenate(counts)


_DIGEST = ("doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, links binary, documents binary")
_DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                           ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("links", pa.binary()), ("documents", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch], width: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per document its figures and pairs (places in the block's list) with their links; per block a row
    with its distinct pairs and the number of documents that hold each (``documents`` not null)."""
    from pyspark import TaskContext

    task, block = TaskContext.get().partitionId(), 0
    names = np.empty((2, 2, 1 << 16), dtype=object)  # side, last of its group
    names[0], names[1] = ([[b"%d%s" % (k, x) for k in range(1 << 16)] for x in signs] for signs in ((b",", b"|"), (b",", b";")))

    def signed(ids: np.ndarray, cut: np.ndarray, side: int) -> np.ndarray:
        last = np.zeros(len(ids), dtype=np.int64)
        last[cut - 1] = 1
        if len(ids) and ids.max() >= 1 << 16:
            return np.array([b"%d%s" % (k, (b",", (b"|", b";")[side])[x]) for k, x in zip(ids.tolist(), last.tolist(), strict=True)], dtype=object)
        return names[side, last, ids]

    held: list[dict] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, block, size
        at = (task << 32) + block
        sizes = [len(r["pairs"]) for r in held]
        codes, place, docs = np.unique(np.concatenate([r["pairs"] for r in held]), return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes)
        rows = [r | {"block": at, "pairs": place[e - n:e].astype(np.uint32).tobytes(), "links": r["links"].tobytes()}
                for r, n, e in zip(held, sizes, ends, strict=True)]
        rows.append({"block": at, "pairs": codes.astype(np.int64).tobytes(), "documents": docs.astype(np.int64).tobytes()})
        held, block, size = [], block + 1, 0
        return pa.RecordBatch.from_pylist(rows, schema=_DIGEST_ARROW)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("a_ids", "b_ids", "a_cut", "b_cut")]
        offs = [c.offsets.to_numpy() for c in cols]
        vals = [c.values.to_numpy().astype(np.int64) for c in cols]
        for k, doc_id in enumerate(ids):
            a, b, a_cut, b_cut = (v[o[k]:o[k + 1]] for v, o in zip(vals, offs, strict=True))
            place = np.zeros(len(a) + len(b), dtype=object)  # ids and signs in the order of the text to hash
            ga, gb = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
            place[np.arange(len(a)) + np.repeat(b_cut - gb, ga)] = signed(a, a_cut, 0)
            place[np.arange(len(b)) + np.repeat(a_cut, gb)] = signed(b, b_cut, 1)
            text = b"".join(place.tolist())[:-1]
            codes, links = _pairs(a, b, a_cut, b_cut, width)
            pairs, inverse = np.unique(codes, return_inverse=True)
            held.append({"doc_id": doc_id, "n_a": len(a), "n_b": len(b), "n_groups": len(a_cut), "n_links": int(links.sum()),
                         "groups_sha256": hashlib.sha256(text).hexdigest() if text else "",
                         "pairs": pairs, "links": np.bincount(inverse, links, len(pairs)).astype(np.int64)})
            size += 4 * (len(a) + len(b))
            if size >= block_bytes:
                yield flush()
    if held:
        yield flush()


def link_counts(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{BYTE_BPE}", b_path: str = f"{TOKENIZERS}/{PIECE_BPE}",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    Built on what ``align`` gives. A pair of ids is linked by every pair of occurrences in a
    group; its count is the number of rows of ``docs`` that link it (repeated doc_ids and rows count
    each). n_best: links whose count is the highest of their a id in the corpus, ties included.
    Texts without tokens (null, empty, bytes that differ) have zeros and an empty hash.
    """
    width = len(pieces(b_path).bytes)
    own = docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), F.col("text").cast("string").alias("text"))
    got = written(own.mapInArrow(lambda batches: _digests(aligned_batches(batches, a_path, b_path), width, block_bytes), _DIGEST), "digests")
    blocks = got.where("documents is not null").select("block", "pairs", "documents")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = np.frombuffer(pairs, np.int64)
                for s in range(0, len(code), 1 << 16):
                    part = code[s:s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block)), pa.array(np.arange(s, s + len(part))), pa.array(part), pa.array(np.frombuffer(docs_, np.int64)[s:s + (1 << 16)])],
                        names=["block", "place", "code", "n"])

    each = written(blocks.mapInArrow(listed, "block long, place long, code long, n long"), "blockpairs")
    total = written(each.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    of_a = (F.col("code") / width).cast("long")
    most = total.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # a row per a id at most
    known = total.withColumn("a", of_a).join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    known = each.select("block", "place", "code").join(known, "code").select("block", "place", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n"))

    def looked_up(docs_: pa.Table, counts: pa.Table) -> pa.Table:
        by = np.argsort(counts["place"].to_numpy())
        n = counts["n"].to_numpy()[by]  # below zero: the best of its a id
        best, count = [], []
        for pairs, links in zip(docs_["pairs"].to_pylist(), docs_["links"].to_pylist(), strict=True):
            at, times = np.frombuffer(pairs, np.uint32), np.frombuffer(links, np.int64)
            own_ = n[at]
            best.append(int(times[own_ < 0].sum()))
            count.append(int((np.abs(own_) * times).sum()))
        return docs_.drop_columns(["pairs", "links", "block"]).append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(count, pa.int64()))

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    rows = got.where("documents is null").drop("documents")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(looked_up, out).select(
        DOC_ID, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: groups and links of the byte-level and the piece vocabulary over every document."""
    return link_counts(table(spark, sf_dir, "documents"))
