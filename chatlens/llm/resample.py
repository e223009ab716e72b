"""Importance resampling of documents towards the word distribution of a target.

Features are runs of words, hashed into buckets. A pass over the texts writes each document's
buckets as an array of small integers; bucket totals of the corpus and of the target give one
gain per bucket (log of the smoothed ratio), an array of fixed length that every task holds and
scores the written arrays with. A hash of seed and doc_id perturbs the weight (Gumbel noise),
so that the highest scores are a draw without replacement.

The cutoff is found by weighted median of medians: each task reports how many keys it still has
on either side of the pivot and the median of each side; the median of those medians, weighted
by the remaining sizes, is the next pivot, which discards a quarter of the remaining keys at
least. Keys differ in every row, so the k-th is exact. What remains is written anew whenever it
is an eighth of what was last written, so all rounds together read little more than the first
three. Only the winners are sorted, by ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..operators.position import with_position
from .batches import _IN_WORD, chunks, text_bytes
from .common import DOC_ID, TEXT_HASH, table, text_hash, unpacked, written

BUCKETS, LONGEST_RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Remaining keys are written anew when they are this fraction of what was last written.
REWRITE = 8
#: Words above so many bytes are hashed one by one.
LONG_WORD = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, bytes) of each word; words end where their text does."""
    inside = _IN_WORD[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(inside & (cut | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & np.concatenate([cut[1:] | ~inside[1:], [True]])) + 1
    return np.searchsorted(off, start, side="right") - 1, start, end - start


def crc_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 registers after ``size`` bytes of ``data`` from ``start`` each."""
    state = state.copy()
    for k in np.flatnonzero(size > LONG_WORD):
        done = zlib.crc32(data[start[k]:start[k] + size[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF)
        state[k] = done ^ 0xFFFFFFFF
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    for step in range(LONG_WORD):
        if not len(live):
            break
        now = state[live]
        state[live] = _CRC[(now ^ data[start[live] + step]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        live = live[size[live] > step + 1]
    return state


def bucket_arrays(data: np.ndarray, off: np.ndarray, longest_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text number of each feature in order, its bucket)."""
    doc, start, size = word_spans(data, off)
    words = np.bincount(doc, minlength=len(off) - 1)
    state = crc_after(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, size)
    docs, found = [doc], [state.copy()]
    for n in range(2, longest_run + 1):  # the registers go on over a space and the next word
        more = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, np.int64)
        now = state[more]
        now = _CRC[(now ^ np.uint32(32)) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        state[more] = crc_after(now, data, start[more + n - 1], size[more + n - 1])
        docs.append(doc[more])
        found.append(state[more])
    docs, found = np.concatenate(docs), np.concatenate(found)
    by = np.argsort(docs, kind="stable")
    return words, docs[by], ((found[by] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))


def _bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def with_buckets(texts: DataFrame, longest_run: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` with its column ``text`` replaced by ``n_words``, ``n_features`` and ``buckets`` (binary)."""
    if not (0 < buckets < 1 << 32 and longest_run > 0):
        raise ValueError("buckets and longest_run must be positive")
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rest = batch.drop_columns(["text"])
            data, off = text_bytes(batch.column(at))
            for k, e in chunks(off):
                words, doc, bucket = bucket_arrays(data[off[k]:off[e]], off[k:e + 1] - off[k], longest_run, buckets)
                n = np.bincount(doc, minlength=e - k)
                ends = np.concatenate([[0], np.cumsum(n)]) * np.dtype(kind).itemsize
                blob = pa.Array.from_buffers(pa.binary(), e - k, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(bucket.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(k, e - k) for c in rest.columns), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), blob],
                    names=[*rest.schema.names, "n_words", "n_features", "buckets"])

    return texts.mapInArrow(run, StructType(
        [*texts.drop("text").schema.fields, StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("buckets", BinaryType())]))


def _values(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, first value of each row and the end) of a binary column."""
    off = np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1, offset=col.offset * 4) if len(col) else np.zeros(1, np.int32)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (off - off[0]).astype(np.int64) // np.dtype(kind).itemsize


def bucket_totals(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows per bucket. Each task hands on one row per bucket, the driver gets as many."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0).cast(pa.binary()), kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of the smoothed shares)) per bucket, in doubles."""
    n = float(len(source))
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for s, t in zip(source, target, strict=True)], dtype=np.int64)


def with_weight(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` with its column ``buckets`` replaced by ``weight``, the sum of their gains."""
    kind = _bucket_type(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, off = _values(batch.column(batch.schema.get_field_index("buckets")).cast(pa.binary()), kind)
            total = np.concatenate([[0], np.cumsum(gain[ids])])
            rest = batch.drop_columns(["buckets"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(total[off[1:]] - total[off[:-1]])], names=[*rest.schema.names, "weight"])

    return featured.mapInArrow(run, StructType([*featured.drop("buckets").schema.fields, StructField("weight", LongType())]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of the first 32 bits of sha256('seed:doc_id'); a null doc_id counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


_KEY = ["k0", "k1", "k2", "k3"]


def _before(cols: list[np.ndarray], p: tuple[int, ...]) -> np.ndarray:
    """Which keys come before ``p``."""
    out = np.zeros(len(cols[0]), dtype=bool)
    for c, v in zip(reversed(cols), reversed(p), strict=True):
        out = (c < v) | ((c == v) & out)
    return out


def _sides(keys: DataFrame, lo: tuple | None, hi: tuple | None, pivot: tuple | None) -> list:
    """Of each task: (n, median) of its keys between lo and hi before the pivot, and of those behind it."""
    names = [f"{side}{c}" for side in ("a", "b") for c in ("n", *_KEY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            ok = np.ones(batch.num_rows, dtype=bool) if hi is None else _before(cols, hi)
            if lo is not None:
                ok &= ~_before(cols, (*lo[:-1], lo[-1] + 1))
            held.append([c[ok] for c in cols])
        cols = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 4
        out: list[int] = []
        first = np.ones(len(cols[0]), dtype=bool) if pivot is None else _before(cols, pivot)
        last = np.zeros(len(first), dtype=bool) if pivot is None else ~_before(cols, (*pivot[:-1], pivot[-1] + 1))
        for side in (first, last):
            own = [c[side] for c in cols]
            n = len(own[0])
            mid = np.lexsort(own[::-1])[(n - 1) // 2] if n else 0
            out += [n, *(int(c[mid]) if n else 0 for c in own)]
        if out[0] or out[5]:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in out], names=names)

    return keys.mapInArrow(run, ", ".join(f"{n} long" for n in names)).collect()


def cutoff(keys: DataFrame, k: int) -> tuple[int, ...] | None:
    """The ``k``-th key (from 1) in ascending order of the long columns k0..k3, of which no two rows
    are alike (k3 below the largest long). None if there are fewer keys. Needs a written table."""
    if k < 1:
        return None
    lo = hi = pivot = None
    size = last = None
    while True:
        rows = _sides(keys, lo, hi, pivot)
        before, behind = sum(r["an"] for r in rows), sum(r["bn"] for r in rows)
        if pivot is None:
            size = last = before
            if k > before:
                return None
            side = "a"
        elif k == before + 1:
            return pivot
        elif k <= before:
            hi, size, side = pivot, before, "a"
        else:
            k, lo, size, side = k - before - 1, pivot, behind, "b"
        medians = sorted((tuple(r[side + c] for c in _KEY), r[side + "n"]) for r in rows if r[side + "n"])
        seen = 0
        for pivot, n in medians:
            seen += n
            if 2 * seen >= size:
                break
        if size * REWRITE <= last:
            parts = max(1, math.ceil(len(rows) * size / last))
            here = _within(lo, hi)
            keys, last = written(keys.where(here).repartition(parts), "keys"), size


def _within(lo: tuple | None, hi: tuple | None) -> Column:
    key = F.struct(*[F.col(c) for c in _KEY])
    at = lambda p: F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(_KEY, p, strict=True)])
    out = F.lit(True)
    if lo is not None:
        out = out & (key > at(lo)) & (F.col("k0") >= lo[0])  # the plain bound reaches the scan
    if hi is not None:
        out = out & (key < at(hi)) & (F.col("k0") <= hi[0])
    return out


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
           longest_run: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED, rows: bool = False) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rows`` adds the row itself as
    a struct ``row``.

    floor(``percent`` * N / 100) rows are drawn, N being the rows of at least ``least_words`` words; rank
    runs from 1 by falling score, ties by doc_id (null last), then by the text's hash. Rows alike
    in all of these share no rank; which of them gets which cannot be told. Null and empty texts
    have no features, weigh 0 and are never drawn unless ``least_words`` is 0. An empty target
    leaves gains by the corpus alone; an empty ``docs`` gives no rows.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be 0 to 100")
    own = docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), text_hash().alias(TEXT_HASH), F.col("text").cast("string").alias("text"),
                      *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if rows else []))
    featured = written(with_buckets(own, longest_run, buckets), "buckets")
    wanted = with_buckets(target.select(F.col("text").cast("string").alias("text")), longest_run, buckets)
    gain = gains(bucket_totals(featured, buckets), bucket_totals(wanted, buckets))
    scored = with_weight(featured, gain)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col(DOC_ID), seed)).select(
        "*", (F.col("n_words") >= least_words).alias("may"), (-F.col("score")).alias("k0"),
        F.coalesce(F.col(DOC_ID), F.lit((1 << 63) - 1)).alias("k1"), F.col(TEXT_HASH).alias("k2"), F.monotonically_increasing_id().alias("k3"))
    scored = written(scored, "scored")
    keys = scored.where("may").select(*_KEY)
    last = cutoff(keys, keys.count() * percent // 100)
    key = F.struct(*[F.col(c) for c in _KEY])
    if last is None:
        drawn = F.lit(False)
    else:
        drawn = F.col("may") & (F.col("k0") <= last[0]) & (key <= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(_KEY, last, strict=True)]))
    columns = [DOC_ID, "n_features", "weight", "score", *(["row"] if rows else [])]
    out = scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    if last is None:
        return out
    best = with_position(scored.where(drawn).select(*columns, *_KEY), [F.col(c) for c in _KEY])
    return out.unionByName(best.select(*columns, F.col("position").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             longest_run: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, all their columns, with ``weight``, ``score`` and ``rank`` (see ``ranked``).

    A column of ``docs`` named like one of the three gives way.
    """
    got = ranked(docs, target, percent, least_words, longest_run, buckets, seed, rows=True).where("rank is not null")
    return unpacked(got, docs.columns, weight=F.col("weight"), score=F.col("score"), rank=F.col("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: weight, score and rank of every document, a tenth drawn towards the benchmark's texts."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
