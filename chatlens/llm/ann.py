"""Nearest neighbours by inner product through vantage-point trees, one per shard.

Inner product is no metric; one more coordinate makes it one: with M the largest norm, x
becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0), and the nearest point in that space has the
largest inner product. A tree node splits its points at the median distance to a vantage
point. By the triangle inequality a side is left out if its bound exceeds the query's
current k-th distance; the bound is multiplied by ``relax`` first. Factor 1 is the exact search;
larger factors leave out more.

Index rows are shards (by a hash of vec_id, about ``shard_size`` vectors each) with their
tree in one written table. Queries go in blocks; each meets each shard once, in its own task.
All comparisons among candidates use the inner product of the original vectors, summed in
order of the components in double precision.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

K, SHARD, BLOCK, LEAF, EVERY = 20, 4096, 2048, 128, 20


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, each summed in order of the components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


@dataclass(frozen=True)
class VPTree:
    """points (with the extra coordinate) and ids in leaf order; per node: vantage point,
    radius, first and last point, children (-1: leaf)."""

    points: np.ndarray
    ids: np.ndarray
    vantage: np.ndarray
    radius: np.ndarray
    span: np.ndarray
    child: np.ndarray

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, largest: float, leaf: int = LEAF) -> VPTree:
        extra = np.sqrt(np.maximum(largest ** 2 - (vectors ** 2).sum(axis=1), 0))
        pts = np.hstack([vectors, extra[:, None]])
        order = np.argsort(ids, kind="stable")
        nodes: list[list] = []

        def make(lo: int, hi: int) -> int:
            at = len(nodes)
            nodes.append([np.zeros(pts.shape[1]), 0.0, (lo, hi), (-1, -1)])
            if hi - lo <= leaf:
                return at
            own = pts[order[lo:hi]]
            # the point farthest from the first one: near the border, so that distances spread
            vp = own[int(np.argmax(((own - own[0]) ** 2).sum(axis=1)))]
            d = np.sqrt(((own - vp) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][by]
            inner, outer = make(lo, lo + mid), make(lo + mid, hi)
            nodes[at][:] = [vp, (float(d[by[mid - 1]]), float(d[by[mid]])), (lo, hi), (inner, outer)]
            return at

        make(0, len(pts))
        radius = np.array([n[1] if isinstance(n[1], tuple) else (0.0, 0.0) for n in nodes])
        return VPTree(pts[order], ids[order], np.array([n[0] for n in nodes]), radius,
                      np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes]))

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.__dict__)
        return f.getvalue()

    @staticmethod
    def load(blob: bytes) -> VPTree:
        with np.load(io.BytesIO(blob)) as z:
            return VPTree(**{k: z[k] for k in z.files})

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, largest: float, relax: float = 1.0
               ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (queries, k), nearest first, ties to the smaller id; scores of
        missing neighbours are -inf. own: the id each query must not find."""
        n, dim = queries.shape
        score, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        q2 = (queries ** 2).sum(axis=1) + largest ** 2
        slack = 1e-9 * np.sqrt(q2) * max(largest, 1e-300)

        def reach(sub: np.ndarray) -> np.ndarray:
            d2 = q2[sub] - 2 * score[sub, -1]
            return np.sqrt(np.maximum(d2, 0)) + 1e-6 * np.sqrt(q2[sub])

        def at_leaf(lo: int, hi: int, sub: np.ndarray) -> None:
            x, xid = self.points[lo:hi, :dim], self.ids[lo:hi]
            rough = queries[sub] @ x.T
            r, c = np.nonzero((rough >= score[sub, -1][:, None] - slack[sub][:, None]) & (xid[None, :] != own[sub][:, None]))
            if not len(r):
                return
            rows = np.unique(r)
            exact = products(queries[sub[r]], x[c])
            who = np.concatenate([sub[r], np.repeat(sub[rows], k)])
            s = np.concatenate([exact, score[sub[rows]].ravel()])
            i = np.concatenate([xid[c], ids[sub[rows]].ravel()])
            by = np.lexsort((i, -s, who))
            who, s, i = who[by], s[by], i[by]
            first = np.concatenate([[True], who[1:] != who[:-1]])
            rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
            top = rank < k
            score[who[top], rank[top]] = s[top]
            ids[who[top], rank[top]] = i[top]

        def visit(node: int, sub: np.ndarray) -> None:
            if not len(sub):
                return
            inner, outer = self.child[node]
            if inner < 0:
                at_leaf(*self.span[node], sub)
                return
            vp = self.vantage[node]
            d = np.sqrt(np.maximum(q2[sub] - largest ** 2 + (vp ** 2).sum() - 2 * (queries[sub] @ vp[:dim]), 0))
            near, far = self.radius[node]
            inside = d <= (near + far) / 2
            visit(inner, sub[inside])
            visit(outer, sub[~inside])
            rest = inside & ((far - d) * relax <= reach(sub))
            visit(outer, sub[rest])
            rest = ~inside & ((d - near) * relax <= reach(sub))
            visit(inner, sub[rest])

        visit(0, np.arange(n))
        return ids, score


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: vec_id and vector not null, at least one component,
    all of them finite, not all zero."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where("vec_id is not null and size(v) > 0").where(finite).where(F.exists("v", lambda x: x != 0))


def search(rows: DataFrame, k: int = K, every: int = EVERY, relax: float = 1.0, shard_size: int = SHARD,
           block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of all other rows for each row whose
    vec_id is divisible by ``every``, by inner product, ties to the smaller vec_id.

    Only vectors of equal length meet. Null, zero and not finite vectors and null vec_ids
    take no part. Repeated vec_ids are candidates each, but never for a query of the same
    vec_id; a repeated query is answered once, for one of its vectors (the smallest). Fewer than
    ``k`` candidates give fewer rows; an empty table gives none. Repeated rows share a shard as ``k`` rows at
    most, so that a row repeated any number of times makes no shard larger.
    """
    good = usable(rows)
    dims = good.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest"))
    dims = written(dims.select("dim", F.ceil(F.col("n") / shard_size).cast("int").alias("shards"), "largest"), "dims")
    # Rows equal in vec_id and vector are one row with a count before they move: of n such rows no query can return more than k.
    once = good.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    once = once.select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("copy")).drop("copy")
    placed = once.withColumn("dim", F.size("v")).join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int"))

    def matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.asarray(col.combine_chunks().flatten()).reshape(n, -1)

    def build(t: pa.Table) -> pa.Table:
        tree = VPTree.build(matrix(t["v"], len(t)), np.asarray(t["vec_id"]), t["largest"][0].as_py())
        return pa.table({"dim": pa.array([t["dim"][0].as_py()], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()), "tree": pa.array([tree.dump()], pa.binary())})

    index = written(placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "index")
    asked = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        f = io.BytesIO()
        np.savez(f, q=matrix(t["v"], len(t)), ids=np.asarray(t["vec_id"]))
        return pa.table({"dim": pa.array([t["dim"][0].as_py()], pa.int32()), "block": pa.array([t["block"][0].as_py()], pa.int32()), "queries": pa.array([f.getvalue()], pa.binary())})

    packed = written(asked.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, queries binary"), "queries")
    met = packed.join(dims, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(index, ["dim", "shard"])

    def find(t: pa.Table) -> pa.Table:
        tree = VPTree.load(t["tree"][0].as_py())
        with np.load(io.BytesIO(t["queries"][0].as_py())) as z:
            q, own = z["q"], z["ids"]
        ids, score = tree.search(q, own, k, t["largest"][0].as_py(), relax)
        ok = score.ravel() > -np.inf
        return pa.table({"query_id": pa.array(np.repeat(own, k)[ok]), "vec_id": pa.array(ids.ravel()[ok]), "score": pa.array(score.ravel()[ok])})

    found = met.groupBy("dim", "shard", "block").applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 20 nearest of every vector whose vec_id is divisible by 20; exact (factor 1)."""
    return search(table(spark, sf_dir, "embeddings"))


#: Sums in order of the components, as the query's scores.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_reduce(list_prepend(0::double, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
