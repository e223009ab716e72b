"""Benchmark decontamination by spaced seeds, as DataFrame operations only.

A mask names the token offsets it looks at; the others may differ. Every position of every
text is hashed under each mask and joined with the same hashes of the benchmark items. A hit
fixes a diagonal (document position minus item position), on which all tokens of the item are
compared: the pair overlaps if some window of ``window`` aligned tokens (the whole item
if that is shorter) agrees in at least ``similarity`` of its places.

The two default masks are lossless for the default window: any two of 13 places may differ
and one mask still fits somewhere (tests enumerate all 78 patterns). An item too short for a window
or a mask is cut into one run of tokens more than may differ in it, so one run agrees wherever
the differences are; every position of every text is hashed over runs of these lengths too.

Seeds are three numbers (hash, item, place), whatever the item's length. They are broadcast while
they are at most ``broadcast_seeds`` rows (about 64 bytes each), and the items' tokens are, once each,
while they hold at most ``broadcast_bytes``; both are measured first. Beyond either the hashes
of both sides are shuffled, of the documents those that a bitmap of the seeds (``broadcast_bytes``
at most) lets through; then the tokens of documents with a hit meet an item once per diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT_HASH, counted, packed, table, text_hash, unpacked, written

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SIMILARITY, BROADCAST_SEEDS, BROADCAST_BYTES = 13, 0.8, 250_000, 16 << 20


def tokens(col: str = "text") -> Column:
    """Lower-cased runs of letters, marks and digits; null for null, empty without any."""
    return F.array_remove(F.split(F.lower(F.col(col)), r"[^\p{L}\p{M}\p{N}]+"), "")


def _runs(length: int, window: int, similarity: float) -> list[tuple[int, int]]:
    """(start, tokens) of an item's runs: in each window as many as may differ, and one more."""
    w = min(length, window)
    parts = min(max(k for k in range(w + 1) if (w - k) / w >= similarity) + 1, w)
    cuts = [w * k // parts for k in range(parts + 1)]
    return sorted({(p + a, b - a) for p in range(length - w + 1) for a, b in zip(cuts, cuts[1:])})  # noqa: B905


def _seed_keys(tok: str, at: str, masks: list[tuple[int, ...]], runs: dict[int, list[tuple[int, int]]], least: int | None = None) -> Column:
    """Seed hashes at position ``at``. runs: those of item lengths below ``least``, which the masks
    do not cover; ``least`` is given for items, whose keys depend on their length."""
    n, i = F.size(tok), F.col(at)
    keys = []
    for k, m in enumerate(masks):
        h = F.xxhash64(F.lit(k), *[F.get(F.col(tok), i + o) for o in m])
        fits = i + m[-1] < n
        keys.append(F.when(fits if least is None else fits & (n >= least), h))
    for size in sorted({t for r in runs.values() for _, t in r}):
        fits = i + size <= n
        if least is not None:
            starts = F.lit(False)
            for length, r in runs.items():
                starts = starts | ((n == length) & i.isin([a for a, t in r if t == size]))
            fits = fits & starts
        keys.append(F.when(fits, F.xxhash64(F.lit(-size), *[F.get(F.col(tok), i + o) for o in range(size)])))
    return F.array(*keys)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item): items of equal tokens are one, under the smallest item_id; items
    without tokens cannot overlap and drop out."""
    t = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens().alias("item")).where("size(item) > 0")
    return t.groupBy("item").agg(F.min("item_id").alias("item_id")).select("item_id", "item")


def _possible(keyed: DataFrame, seeds: DataFrame, n_seeds: int, most_bytes: int) -> DataFrame:
    """``keyed`` without most rows whose key no seed has; all rows with a seed's key stay. A bitmap has
    16 to 32 bits a seed (64 KB at least; beyond that ``most_bytes`` at most), in pieces of 64 words."""
    bits = 1 << max(19, min((32 * n_seeds).bit_length(), (8 * most_bytes).bit_length()) - 1)
    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = keyed.sparkSession.range(bits >> 6).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(
        seeds.select(F.shiftright(slot, 6).alias("w"), bit.alias("b"))).groupBy("w").agg(F.bit_or("b").alias("b"))
    pieces = words.groupBy(F.shiftright("w", 6).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("s"))
    pieces = written(pieces.select("piece", F.col("s.b").alias("words")), "bitmap")
    found = F.get(F.col("words"), F.shiftright(slot, 6).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(bit) != 0
    return keyed.join(F.broadcast(pieces), (F.shiftright(slot, 12) == F.col("piece")) & found).select(*keyed.columns)


def _window_sums(agree: Column, w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(agree) - w + 1), lambda s: F.aggregate(
        F.slice(agree, s, w), F.lit(0), lambda a, x: a + x))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple = MASKS, window: int = WINDOW,
             similarity: float = SIMILARITY, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, _th, item_id, matched, item_tokens, best_window) per overlapping document and item.

    matched: agreeing tokens on the pair's best diagonal; best_window: the largest share of agreeing
    places in a window. Null or empty texts and items overlap with nothing; repeated rows
    (equal doc_id and text) give one row; null doc_ids are kept apart by text; an empty table
    on either side gives no rows. Items of null item_id are taken as one item per text.
    """
    spark = docs.sparkSession
    masks = [tuple(m) for m in masks]
    least = max(window, max(m[-1] for m in masks) + 1)  # from this length on, masks find an item
    items = written(benchmark_items(benchmark).withColumn("no", F.monotonically_increasing_id()), "items")
    shorts = sorted(r[0] for r in items.select(F.size("item").alias("n")).where(F.col("n") < least).distinct().collect())  # below least values
    runs = {n: _runs(n, window, similarity) for n in shorts}
    seeds = written(items.select("no", "item", F.posexplode_outer("item").alias("j", "_t")).select(
        "no", "j", F.explode(_seed_keys("item", "j", masks, runs, least)).alias("key")
    ).where("key is not null"), "seeds")
    size = items.agg(F.sum(F.octet_length(F.array_join("item", " ")) + 16 * F.size("item"))).first()[0] or 0
    n_seeds = seeds.count()
    few = n_seeds <= broadcast_seeds and size <= broadcast_bytes
    toks = docs.select(F.col(DOC_ID).cast("long").alias("doc_id"), text_hash().alias(TEXT_HASH), tokens().alias("tok"))
    at = toks.select("doc_id", TEXT_HASH, "tok", F.posexplode_outer("tok").alias("i", "_t"))
    keyed = at.select("doc_id", TEXT_HASH, "tok", "i", F.explode(_seed_keys("tok", "i", masks, runs)).alias("key")
                      ).where("key is not null")
    if few:
        hits = keyed.join(F.broadcast(seeds), "key").join(F.broadcast(items), "no")
    else:
        places = _possible(keyed.select(F.col("doc_id").alias("_id"), F.col(TEXT_HASH).alias("_h"), "i", "key"), seeds, n_seeds, broadcast_bytes)
        first = written(places.join(seeds, "key").groupBy("_id", "_h", "no", (F.col("i") - F.col("j")).alias("_d")).agg(
            F.min("i").alias("i"), F.min("j").alias("j")).drop("_d"), "diagonals")
        same_doc = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(TEXT_HASH) == F.col("_h"))
        hit = written(first.select("_id", "_h").distinct(), "hit")
        if hit.count() <= broadcast_seeds:  # else all texts are shuffled
            toks = toks.join(F.broadcast(hit), same_doc, "left_semi")
        hits = toks.dropDuplicates(["doc_id", TEXT_HASH]).join(first.join(items, "no"), same_doc)
    # One hit of a run on the same diagonal is enough: the run's first under all masks.
    before = F.lit(False)
    for m in masks:
        same = F.lit(True)
        for o in m:
            same = same & F.get(F.col("tok"), F.col("i") - 1 + o).eqNullSafe(F.get(F.col("item"), F.col("j") - 1 + o)) \
                & (F.col("j") - 1 + o < F.size("item"))
        before = before | (same & (F.col("i") > 0) & (F.col("j") > 0) & (F.size("item") >= least))
    # agreement along the diagonal, 1 or 0 for each token of the item
    agree = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda p: F.when(
        (p + F.col("i") - F.col("j") >= 0) & (F.get(F.col("tok"), F.greatest(p + F.col("i") - F.col("j"), F.lit(0))) == F.get(F.col("item"), p)),
        F.lit(1)).otherwise(F.lit(0)))
    w = F.least(F.lit(window), F.size("item"))
    # An explode keeps the check above the join: pushed into it as a condition, it would
    # break the generated code, and every position would copy its document's tokens.
    best = F.when(~before, F.array_max(F.transform(F.array(agree), lambda g: F.array_max(_window_sums(g, w)) / w)))
    matched = F.when(~before, F.aggregate(agree, F.lit(0), lambda a, x: a + x).cast("long"))
    checked = hits.select("doc_id", TEXT_HASH, "item_id", F.size("item").cast("long").alias("item_tokens"), F.explode(
        F.array(F.struct(matched.alias("matched"), best.alias("best_window")))).alias("r")).select(
        "doc_id", TEXT_HASH, "item_id", "item_tokens", "r.*")
    return checked.where(F.col("best_window") >= similarity).groupBy("doc_id", TEXT_HASH, "item_id", "item_tokens").agg(
        F.max("matched").alias("matched"), F.max("best_window").alias("best_window"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; columns unchanged. They are
    shuffled only if more than ``broadcast_seeds`` of them go."""
    bad = overlaps(docs, benchmark, **kw).select(F.col("doc_id").alias("_id"), F.col(TEXT_HASH).alias("_h")).distinct()
    bad = counted(written(bad, "leaks"), kw.get("broadcast_seeds", BROADCAST_SEEDS))
    left = packed(docs, id=F.col(DOC_ID).cast("long"), h=text_hash())
    cond = left["id"].eqNullSafe(bad["_id"]) & (left["h"] == bad["_h"])
    return unpacked(left.join(bad, cond, "left_anti"), docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every (document, benchmark item) that overlaps."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "matched", "item_tokens", "best_window")


#: By the definition: tokens that agree on a diagonal, and the best window among those that begin at one.
ORACLE = r"""
with d as (
  select doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as tok from documents where text is not null),
dt as (select distinct doc_id, text, i, tok[i] as t from (select doc_id, text, tok, unnest(range(1, len(tok) + 1)) as i from d)),
b as (
  select item, min(item_id) as item_id from (
    select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as item from benchmark where text is not null)
  where len(item) > 0 group by item),
bt as (select item_id, n, j, item[j] as t from (select item_id, item, len(item) as n, unnest(range(1, len(item) + 1)) as j from b)),
m as (select doc_id, text, item_id, n, least(n, 13) as w, i - j as diagonal, j from dt join bt using (t)),
g as (select doc_id, text, item_id, diagonal, count(*) as matched from m group by all having count(*) >= 0.8 * least(min(m.n), 13)),
c as (select m.* from m join g using (doc_id, text, item_id, diagonal)),
s as (
  select a.doc_id, a.text, a.item_id, a.n, a.diagonal, a.j, count(*) / a.w::double as share
  from c a join c e on a.doc_id = e.doc_id and a.text = e.text and a.item_id = e.item_id and a.diagonal = e.diagonal
    and e.j >= least(a.j, a.n - a.w + 1) and e.j < least(a.j, a.n - a.w + 1) + a.w
  group by a.doc_id, a.text, a.item_id, a.n, a.w, a.diagonal, a.j),
r as (select s.doc_id, s.text, s.item_id, s.n, s.diagonal, max(share) as best from s group by all)
select r.doc_id, r.item_id, max(g.matched) as matched, r.n as item_tokens, max(r.best) as best_window
from r join g using (doc_id, text, item_id, diagonal) where r.best >= 0.8 group by r.doc_id, r.text, r.item_id, r.n
"""
