"""Mixing sources to target weights by pivotal dependent rounding, as DataFrame operations only.

Each source gets a target of words; a document is wanted ``target / source size`` times.
The whole part is taken, the fraction is a probability, rounded so that the sums hold: in
a block, two open entries meet, mass moves at random from one to the other until one is
0 or 1, and the other meets the next. What stays open at the end of a block (one entry at
most) goes up to a block of the next level: a reduction tree with blocks of about ``fan_in``.
Entries meet in order of their size, so that what one loses another of like size wins.

Draws are hashes of the entries, the level and the seed: reruns agree. Rows with equal
(doc_id, source, size) are counted before any shuffle and dealt out again at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOC_ID, apart, counted, packed, table, text_hash, unpacked, word_count, written

WEIGHTS, MOST, FAN_IN, SEED = (1, 2, 3), 3, 64, 7
#: Alike rows that one array deals out; longer groups are dealt out in so long stretches, by many tasks.
STRETCH = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target): one row per source of ``sizes`` (source, size, rows).

    Sources by code point, null last, weigh ``weights`` in turn. Targets share the words of all
    sources by weight and stop at ``most`` times the source's; the excess is shared again by
    weight. Closed form: in order of cap over weight, the sources below the water level
    are full, and the rest share what is left.
    The table has a row per source; only that goes through the ordered windows.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(x) for x in weights]), F.pmod(rank, F.lit(len(weights))))
    per = per.withColumn("w", w.cast("long"))
    cap = F.lit(most) * F.col("source_size")
    order = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = per.withColumn("before", F.coalesce(F.sum(cap).over(upto), F.lit(0)).cast("long"))
    x = x.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("total", F.sum("source_size").over(every))
    # full: its cap is not above its share of what the sources before it leave
    full = cap * F.col("rest") <= F.col("w") * (F.col("total") - F.col("before"))
    x = x.withColumn("full", full)
    x = x.withColumn("first_open", F.min(F.when(~F.col("full"), F.struct(cap / F.col("w"), "before", "rest"))).over(every))
    target = F.when(F.col("full"), cap.cast("double")).otherwise(
        (F.col("w") * (F.col("total") - F.col("first_open.before"))).cast("double") / F.col("first_open.rest"))
    return x.select("source", "source_size", "n", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _meet(seed: int, level: int) -> Column:
    """Fold of a block's entries ``e`` (size, k, p): (open entry, settled entries)."""
    none = "cast(null as struct<k: bigint, p: double>)"
    start = F.expr(f"named_struct('o', {none}, 'done', cast(array() as array<struct<k: bigint, up: int>>))")

    def step(acc: Column, e: Column) -> Column:
        a, b, done = acc["o"]["p"], e["p"], acc["done"]
        u = _uniform(F.lit(seed), F.lit(level), acc["o"]["k"], e["k"])
        entry = lambda k, p: F.struct(k.alias("k"), p.alias("p"))
        out = lambda k, up: F.struct(k.alias("k"), F.lit(up).alias("up"))
        # all mass to one of them, or one filled up to 1
        low = a + b < 1
        a_wins = F.when(low, u * (a + b) < a).otherwise(u * (2 - a - b) < 1 - b)
        winner, loser = F.when(a_wins, acc["o"]["k"]).otherwise(e["k"]), F.when(a_wins, e["k"]).otherwise(acc["o"]["k"])
        rest = F.when(low, entry(winner, a + b)).otherwise(entry(loser, a + b - 1))
        settled = F.when(low, out(loser, 0)).otherwise(out(winner, 1))
        kept = F.struct(rest.alias("o"), F.array_append(done, settled).alias("done"))
        return F.when(acc["o"].isNull(), F.struct(entry(e["k"], b).alias("o"), done.alias("done"))).otherwise(kept)

    return F.aggregate(F.array_sort("e"), start, step)


def pivotal_round(entries: DataFrame, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """(k, up) for entries (k long unique, grp long, size long, p in (0, 1)): up is 1 with
    probability p; in each grp the number of ups is the sum of p rounded up or down.

    Blocks hold about ``fan_in`` entries; the last entry of a group is drawn alone.
    """
    eps, level, settled = 1e-9, 0, None
    now = written(entries, "mix")
    while True:
        blocks = written(now.groupBy("grp").count().select("grp", F.ceil(F.col("count") / fan_in).cast("long").alias("nb")), "blocks")
        most = blocks.agg(F.max("nb")).first()[0]
        if most is None:
            break
        # one key for group and block: a hot group's rows go to as many tasks as it has blocks
        keyed = now.join(counted(blocks.select(apart(F.col("grp")).alias("grp"), "nb")), "grp").withColumn("block", F.xxhash64(
            "grp", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k"), F.col("nb"))))
        met = keyed.groupBy("block").agg(F.min("grp").alias("grp"), F.collect_list(F.struct("size", "k", "p")).alias("e")).select(
            "grp", _meet(seed, level).alias("m"), F.transform("e", lambda x: x["size"]).alias("sizes"))
        met = written(met.select("grp", "m", F.array_max("sizes").alias("size")), "met")
        out = met.select(F.explode("m.done").alias("d")).select("d.k", "d.up")
        left = met.select("m.o.k", "grp", "size", "m.o.p")
        whole = left.where((F.col("p") < eps) | (F.col("p") > 1 - eps)).select("k", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("up"))
        out = out.unionByName(whole)
        now = left.where((F.col("p") >= eps) & (F.col("p") <= 1 - eps))
        if most == 1:  # one block per group: its last entry is drawn
            last = now.select("k", F.when(_uniform(F.lit(seed), F.lit(-1), "k") < F.col("p"), 1).otherwise(0).alias("up"))
            return (out if settled is None else settled.unionByName(out)).unionByName(last)
        settled = out if settled is None else settled.unionByName(out)
        now, level = written(now, "mix"), level + 1
    return settled if settled is not None else entries.select("k", F.lit(0).alias("up")).limit(0)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan_in: int = FAN_IN,
             seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies): per distinct (doc_id, source, size).

    rows of the input are alike in those; copies is how often the mix takes them all
    together. size is the number of words (null text: 0). A null source is a source of its
    own; null doc_ids are entries like others. A source without words has target 0.
    """
    rows = docs.select(F.col(DOC_ID).cast("long").alias("doc_id"), F.col("source"), word_count().alias("size")).groupBy(
        "doc_id", "source", "size").agg(F.count("*").alias("rows"))
    rows = written(rows, "sizes")
    per = source_targets(rows, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = written(per.withColumn("rate", rate).withColumn("grp", F.xxhash64("source", F.col("source").isNull())), "sources")
    named = rows.join(counted(per.withColumnRenamed("source", "_s")), rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    share = F.col("rate") * F.col("rows")
    named = named.withColumn("k", F.xxhash64("doc_id", F.col("doc_id").isNull(), "grp", "size")).withColumn(
        "base", F.floor(share + 1e-9).cast("long")).withColumn("p", F.greatest(share - F.col("base"), F.lit(0.0)))
    named = written(named, "shares")
    open_ = named.where("size > 0 and p >= 1e-9").select("k", "grp", "size", "p")
    ups = pivotal_round(open_, fan_in, seed).groupBy("k").agg(F.max("up").alias("up"))
    return named.join(ups.select(apart(F.col("k")).alias("k"), "up"), "k", "left").select(
        "doc_id", "source", "size", "rows", "source_size", "target", (F.col("base") + F.coalesce("up", F.lit(0))).alias("copies"))


def _dealt(plan: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row per ``at`` from 1 to ``rows``. Groups of more than ``stretch`` are cut into stretches, which are spread over tasks first."""
    upto = F.least("rows", (F.col("part") + 1) * stretch)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / stretch).cast("long")))
    long = plan.where(F.col("rows") > stretch).withColumn("part", parts).repartition("doc_id", "source", "size", "part")
    spread = long.withColumn("at", F.explode(F.sequence(F.col("part") * stretch + 1, upto))).drop("part")
    return plan.where(F.col("rows") <= stretch).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).unionByName(spread)


def mix(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per row of ``docs``.

    copies of alike rows differ by one at most; taken = copies * size. Reruns agree.
    """
    plan = written(mix_plan(docs, **kw), "plan")
    one = _dealt(plan)
    copies = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("at") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return one.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))


def mix_texts(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` plus size, copies and taken, one row per row; input columns so named give way.

    Copies of alike rows (equal doc_id, source and size) differ by one at most: the rows are
    told apart by text, and rows equal in that too by an order that a rerun may change,
    which changes nothing in the result.
    """
    keyed = packed(docs, id=F.col(DOC_ID).cast("long"), source=F.col("source"), size=word_count(), h=text_hash())
    plan = written(mix_plan(docs, **kw).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("size").alias("_n"), "rows", F.col("copies").alias("_c")), "plan")
    got = keyed.join(plan, keyed["id"].eqNullSafe(plan["_id"]) & keyed["source"].eqNullSafe(plan["_s"]) & (keyed["size"] == plan["_n"]))
    at = F.row_number().over(Window.partitionBy("_id", "_s", "_n").orderBy("h"))
    more = got.where("rows > 1").withColumn("at", at).withColumn("_c", F.floor(F.col("_c") / F.col("rows")).cast("long") + F.when(
        F.col("at") <= F.col("_c") % F.col("rows"), 1).otherwise(0)).drop("at")
    if not plan.where("rows > 1").isEmpty():  # else the texts would move twice for nothing
        got = got.where("rows = 1").unionByName(more)
    return unpacked(got, docs.columns, size=F.col("size"), copies=F.col("_c"), taken=F.col("_c") * F.col("size"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
