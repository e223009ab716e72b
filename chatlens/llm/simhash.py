"""SimHash near-duplicates through BK-trees.

Fingerprints are made in Arrow batches, one row per document. Equal fingerprints are one
class before any search. The search is sharded by equal bit blocks: of four 16-bit
blocks, two must be equal when at most two bits differ, so each fingerprint goes to
the six shards named by a pair of its blocks, and no link can be missed. In each shard
a BK-tree (children keyed by their integer Hamming distance to the parent) is built, and a
search follows only the edges within the radius. A shard above ``shard_limit`` is split by
further equal blocks (again enough for two differing bits) until 14 bits are free, so a
tree has at most ``max(shard_limit, 2**14)`` nodes however the fingerprints lie.
Shards travel by a shuffle instead of a broadcast: together they grow with the corpus.

Edges of a shard leave it as a star around the smallest fingerprint of each group, never as
all pairs; components over the whole corpus follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT_HASH, apart, components, packed, table, text_hash, unpacked, written

RADIUS, SHINGLE, SHARD_LIMIT = 2, 3, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingle hashes set it.

    Words are runs of other than ASCII white space, A-Z lower-cased; repeats count. Fewer
    words than ``shingle``: the whole sequence is the one shingle. No word: 0.
    """
    import xxhash

    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    joined = b" ".join(w)
    ends = list(accumulate((len(x) + 1 for x in w)))
    starts = [0, *ends[:-1]]
    cut = (joined[s:e - 1] for s, e in zip(starts[:n], ends[min(shingle, len(w)) - 1:], strict=True))
    h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _th, fp) per row; fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in col), dtype=np.uint64, count=len(col))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "_th", "fp"])

    src = docs.select(F.col(DOC_ID).cast("long").alias("doc_id"), text_hash().alias(TEXT_HASH), F.col("text"))
    return src.mapInArrow(run, "doc_id long, _th long, fp long")


class BKTree:
    """Fingerprints under integer edges: a child hangs at its Hamming distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = nxt

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of all values at most ``radius`` bits away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


def _stars(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(value, smallest value of its group) of one shard's distinct values, alone ones left out."""
    values = sorted(values)
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):  # tree positions are list positions: values are distinct
        for j in tree.within(v, radius):
            a, b = sorted((find(i), find(j)))
            root[b] = a
        tree.add(v)
    for i, v in enumerate(values):
        if (r := find(i)) != i:
            yield v, values[r]


def _block(col: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(col, low).bitwiseAND((1 << width) - 1)


def _key(fp: Column, parts: tuple[tuple[int, int], ...]) -> Column:
    """Hash of the named blocks and their places; the tree's own distances settle a collision."""
    return F.xxhash64(F.lit(str(parts)), *[_block(fp, lo, w) for lo, w in parts])


def _free(parts: tuple[tuple[int, int], ...]) -> list[int]:
    used = {b for lo, w in parts for b in range(lo, lo + w)}
    return [b for b in range(64) if b not in used]


def _first_level() -> list[tuple[tuple[int, int], ...]]:
    return list(combinations([(0, 16), (16, 16), (32, 16), (48, 16)], 2))


def _third(parts: tuple[tuple[int, int], ...], radius: int) -> list[tuple[tuple[int, int], ...]]:
    """``parts`` plus each of radius + 1 even cuts of the bits still free: one must be equal."""
    free, out = _free(parts), []
    for cut in np.array_split(free, radius + 1):
        runs: list[list[int]] = []
        for b in map(int, cut):
            if runs and runs[-1][0] + runs[-1][1] == b:
                runs[-1][1] += 1
            else:
                runs.append([b, 1])
        out.append(parts + tuple((lo, w) for lo, w in runs))
    return out


def near_links(fps: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) among the distinct values of ``fps`` (one long column ``fp``), as stars
    inside each shard: values within ``radius`` bits end in one connected component."""
    if not 0 <= radius <= 2:
        raise ValueError("the block pairs are complete for a radius of 0 to 2 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush(out: list) -> None:
            if len(held) > 1:
                out.extend(_stars(held, radius))

        for b in batches:
            keys, vals = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys)) + 1 if len(keys) else []
            out: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if s == e:
                    continue
                if keys[s] != key:
                    flush(out)
                    key, held = keys[s], []
                held.extend(vals[s:e].tolist())
            yield _links(out)
        out = []
        flush(out)
        yield _links(out)

    def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
        m = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(m[:, 1]), pa.array(m[:, 0])], names=["a", "b"])

    def spread(df: DataFrame, levels: list[tuple]) -> DataFrame:
        return df.select("fp", F.explode(F.array(*[
            F.struct(F.lit(i).alias("lvl"), _key(F.col("fp"), p).alias("key")) for i, p in enumerate(levels)])).alias("s")
        ).select("fp", "s.lvl", "s.key")

    levels, now, done = _first_level(), fps.select("fp").distinct(), None
    now = spread(now, levels)
    for _ in range(2):
        now = written(now, "shards")
        hot = written(now.groupBy("key").count().where(F.col("count") > shard_limit).select("key"), "hot")
        if hot.isEmpty():
            break
        apart_hot = hot.select(apart(F.col("key")).alias("key"))
        part = now.join(apart_hot, "key", "left_anti").select("key", "fp")
        done = part if done is None else done.unionByName(part)
        deeper = [_third(p, radius) for p in levels]
        kids = F.array(*[F.array(*[F.struct(F.lit(i * (radius + 1) + j).alias("lvl"), _key(F.col("fp"), q).alias("key"))
                                   for j, q in enumerate(ps)]) for i, ps in enumerate(deeper)])
        now = now.join(apart_hot, "key", "left_semi").select("fp", F.explode(F.get(kids, F.col("lvl"))).alias("s")).select(
            "fp", "s.lvl", "s.key")
        levels = [q for ps in deeper for q in ps]
    rows = now.select("key", "fp")
    rows = rows if done is None else done.unionByName(rows)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, _th, fp, root, component_id): one row per row of ``docs``; root names the component.

    component_id is the smallest doc_id reachable over links of at most ``radius``
    differing bits, the document's own included. Null doc_ids never win; a component of
    null doc_ids only has a null component_id. Texts without words (null too) share
    fingerprint 0 and link like any other. An empty table gives no rows.
    """
    fp = written(fingerprints(docs, shingle), "fp")
    per = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(near_links(fp, radius, shard_limit))
    named = per.join(comp, per["fp"] == comp["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.join(least.select(apart(F.col("root")).alias("root"), "component_id"), "root").select(
        apart(F.col("fp")).alias("fp"), "root", "component_id")
    return fp.join(of_fp, "fp").select("doc_id", TEXT_HASH, "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest (doc_id, text hash).

    Groups of null doc_ids only keep the smallest text hash. Repeated rows (equal doc_id and
    text) shrink to one as well. Columns are those of ``docs``.
    """
    c = classes(docs, shingle, radius)
    per = c.where("doc_id <=> component_id").groupBy("root", DOC_ID, TEXT_HASH).count()
    keep = per.groupBy("root").agg(F.first(DOC_ID).alias("_id"), F.min(TEXT_HASH).alias("_h"),
                                   F.min_by("count", TEXT_HASH).alias("n")).drop("root")
    left = packed(docs, id=F.col(DOC_ID).cast("long"), h=text_hash())
    got = left.join(keep, left["id"].eqNullSafe(keep["_id"]) & (left["h"] == keep["_h"]))
    return unpacked(got.where("n = 1").unionByName(got.where("n > 1").dropDuplicates(["_id", "_h"])), docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document (3-word shingles, 2 bits)."""
    return classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
