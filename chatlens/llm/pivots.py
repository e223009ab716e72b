"""Near-duplicate vectors through a pivot-permutation index.

Pivots are reference vectors from a bounded sample, no two of them near duplicates. A vector is
described by its nearest pivots in order (the head of its permutation). Each pivot has an
inverted list of the vectors that name it; in a list, the pivots that two vectors share are
counted, and pairs that share enough are verified by their cosine. A pair that meets in
several lists counts in that of the smallest shared pivot alone, so links are neither
doubled nor shuffled to be told apart.

Equal vectors are one class with a count and go through the index once. A long list is cut into
blocks, and each pair of its blocks is one unit of work, so no task holds more than two
blocks. Units hand on link counts per vector and, of the links, a star per connected
part: all pairs are verified, none is written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import products
from .common import apart, components, packed, table, unpacked, written

THRESHOLD = 0.95
#: Pivots in the head of a permutation, and how many of them a verified pair shares.
HEAD, SHARED = 8, 2
#: Pivots per square root of the vectors, and the bounds of their number (65,536 of 64 components: 32 MB).
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 8, 16, 65_536
#: Vectors in a block of a list, and rows worked on at once when pivots are looked up.
BLOCK, ROWS = 256, 1024


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(products(v, v))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines, each sum in order of the components."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return products(a, b) / np.sqrt(products(a, a) * products(b, b))


def choose_pivots(sample: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """The first ``n`` unit rows of ``sample`` of which no two have a cosine of ``threshold`` or more."""
    taken = np.zeros((0, sample.shape[1]))
    for s in range(0, len(sample), 256):
        part = sample[s:s + 256]
        if len(taken):
            part = part[(part @ taken.T).max(axis=1) < threshold]
        near = np.tril(part @ part.T >= threshold, -1)
        keep = np.ones(len(part), dtype=bool)
        for k in np.flatnonzero(near.any(axis=1)):
            keep[k] = not (near[k] & keep).any()
        taken = np.concatenate([taken, part[keep]])
        if len(taken) >= n:
            break
    return taken[:n]


def heads(v: np.ndarray, pivots: np.ndarray, head: int) -> np.ndarray:
    """The nearest ``head`` pivots of each row of unit vectors, nearest first, ties to the smaller pivot."""
    near = v @ pivots.T
    head = min(head, len(pivots))
    if head < len(pivots):
        top = np.sort(np.argpartition(-near, head - 1, axis=1)[:, :head], axis=1)
    else:
        top = np.broadcast_to(np.arange(head), (len(v), head))
    by = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, by, axis=1)


def shared_counts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(len(p), len(q)): pivots that each two heads share, counted through the pivots' inverted lists."""
    order = np.argsort(q.ravel(), kind="stable")
    keys, rows = q.ravel()[order], order // q.shape[1]
    lo, hi = np.searchsorted(keys, p.ravel(), "left"), np.searchsorted(keys, p.ravel(), "right")
    n = hi - lo
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    pair = np.repeat(np.arange(len(lo)) // p.shape[1], n) * len(q) + rows[at]
    return np.bincount(pair, minlength=len(p) * len(q)).reshape(len(p), len(q))


def smallest_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise smallest pivot of both heads; rows share one at least."""
    both = (p[:, :, None] == q[:, None, :]).any(axis=2)
    return np.where(both, p, np.iinfo(p.dtype).max).min(axis=1)


def links_of(pivot: int, left: tuple, right: tuple | None, shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``left``, rows of ``right``) of the links that this pivot's list answers for. A side is
    (vectors, heads); without ``right``, pairs inside ``left``."""
    (x, p), (y, q) = left, right or left
    may = shared_counts(p, q) >= min(shared, p.shape[1])  # a table of few directions has few pivots
    if right is None:
        may = np.triu(may, 1)
    may &= unit(x) @ unit(y).T >= threshold - 1e-9
    r, c = np.nonzero(may)
    ok = smallest_shared(p[r], q[c]) == pivot
    r, c = r[ok], c[ok]
    ok = cosines(x[r], y[c]) >= threshold
    return r[ok], c[ok]


def parts(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected node of each of ``n`` nodes over the links (r, c)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, r, low[c])
        np.minimum.at(new, c, low[r])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def pair_links(classes: DataFrame, threshold: float = THRESHOLD, head: int = HEAD, shared: int = SHARED,
               per_root: float = PER_ROOT, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, n) for ``classes`` (cid, v, copies), which holds every vector once: rows with b null say that
    class a is linked to n vectors of other classes; the others that a and b are connected. Written."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.size("v").alias("dim")).count().collect()  # a row per length of a vector
    pivots: dict[int, np.ndarray] = {}
    for r in sizes:
        n = min(most_pivots, max(LEAST_PIVOTS, math.ceil(per_root * math.sqrt(r["count"]))))
        # a sample by hash, at most twice as many as there will be pivots
        got = classes.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("v"), "cid").limit(2 * n).select("v").toArrow()
        pivots[r["dim"]] = choose_pivots(unit(_matrix(got["v"].combine_chunks())), n, threshold)
    first = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist(), strict=False))
    held = spark.sparkContext.broadcast((pivots, first))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, start = held.value
        for batch in batches:
            col, dims = batch.column(1), batch.column(3).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for s in range(0, len(at), ROWS):
                    rows = pa.array(at[s:s + ROWS])
                    head_ = heads(unit(_matrix(col.take(rows))), points[dim], head) + start[dim]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, head_.size + 1, head_.shape[1], dtype=np.int32)), pa.array(head_.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), col.take(rows), batch.column(2).take(rows), flat], names=["cid", "v", "copies", "head"])

    described = written(classes.select("cid", "v", "copies", F.size("v").alias("dim")).mapInArrow(
        describe, "cid long, v array<double>, copies long, head array<int>"), "heads")
    listed = described.select("*", F.explode("head").alias("pivot"))
    lists = described.select(F.explode("head").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # one row per pivot: no more of them than most_pivots for each length
    placed = listed.join(F.broadcast(lists), "pivot").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"),
        "cid", "copies", "head", "v")

    def work(key: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        if len(t) < 2:
            return None
        cid, copies, second = (t.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 3))
        head_, v = _matrix(t.column(6)), _matrix(t.column(7))
        if key[1] == key[2]:
            left = right = np.arange(len(cid))
            r, c = links_of(key[0], (v, head_), None, shared, threshold)
        else:
            left, right = np.flatnonzero(~second), np.flatnonzero(second)
            if not len(left) or not len(right):
                return None
            r, c = links_of(key[0], (v[left], head_[left]), (v[right], head_[right]), shared, threshold)
        r, c = left[r], right[c]
        n = np.bincount(r, copies[c], len(cid)) + np.bincount(c, copies[r], len(cid))
        low = parts(r, c, len(cid))
        some, star = np.flatnonzero(n), np.flatnonzero(low != np.arange(len(cid)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([cid[some], cid[star]])), pa.array(np.concatenate([np.zeros(len(some), np.int64), cid[low[star]]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(star), bool)])),
             pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(star), np.int64)]))], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            p, i, j = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(p) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1 if len(p) else []
            for s, e in zip([0, *cuts], [*cuts, len(p)], strict=True):
                if s == e:
                    continue
                now = (int(p[s]), int(i[s]), int(j[s]))
                if now != key:
                    if rows and (got := work(key, rows)) is not None:
                        yield got
                    key, rows = now, []
                rows.append(batch.slice(s, e - s))
        if rows and (got := work(key, rows)) is not None:
            yield got

    unit_key = ["pivot", "i", "j"]
    return written(met.repartition(*unit_key).sortWithinPartitions(*unit_key).mapInArrow(run, "a long, b long, n long"), "links")


def linked(rows: DataFrame, threshold: float = THRESHOLD, head: int = HEAD, shared: int = SHARED,
           per_root: float = PER_ROOT, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, embedding), the row itself as ``row``.

    Rows link if their vectors have equal length and a cosine of at least ``threshold`` (above 0), as far as
    the index finds them; equal vectors always do. Null, empty, zero and not finite vectors
    link with nothing. Rows of one vec_id are told apart by their vectors and link by those
    only. component_id is the smallest vec_id reachable (a null never wins; null if all are);
    kept: the row's vec_id is its component's. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, up to 1")
    # one name for each vector, null for those that take no part
    own = packed(rows, vec_id=rows["vec_id"].cast("long"), embedding=rows["embedding"].cast("array<double>"))
    v = F.col("embedding")
    fit = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    own = own.withColumn("fit", fit)
    classes = written(own.where("fit").groupBy(F.col("embedding").alias("v")).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("low")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = pair_links(classes, threshold, head, shared, per_root, most_pivots, block)
    comp = written(components(found.where("b is not null").select("a", "b")), "components")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    named = classes.join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    info = named.join(least.select(apart(F.col("root")).alias("root"), "component_id"), "root").join(counts, "cid", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    info = written(info, "info")
    part = own.where("fit")
    got = part.join(info, part["embedding"] == info["v"]).select("row", "vec_id", "n_links", "component_id")
    alone = own.where("not fit").select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(alone).select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"), "row")


def drop_near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``rows`` that are kept, one vec_id of each component, with ``n_links`` and ``component_id``;
    columns of these names give way."""
    got = linked(rows, threshold).where("kept")
    return unpacked(got, rows.columns, n_links=F.col("n_links"), component_id=F.col("component_id"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: links and component of every vector at a cosine of 0.95."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return linked(rows).select("vec_id", "n_links", "component_id", "kept")


#: All pairs by their cosine, and what links reach.
ORACLE = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from v),
l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.size * b.size) >= 0.95),
r(node, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.node),
c as (select node, min(root) as component_id from r group by node),
k as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(k.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.node = e.vec_id left join k on k.a = e.vec_id
"""
