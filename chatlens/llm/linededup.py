"""Line dedup: repeated runs of lines by a suffix array over line IDs.

All documents' lines, in (doc_id, text hash, line) order, form one sequence; each line is an ID (its
128-bit hash). Suffixes are ranked by prefix doubling: the rank of the first 2h lines is the place of
(rank of the first h, rank of the h after them) in a global sort. A run ends at its
document's end. A suffix whose first h lines occur once cannot begin a longer repeated run and
leaves the array, so the rounds shrink fast and end when nothing repeats.

Suffixes of equal rank after h lines are a longest-common-prefix interval of depth h or more;
an interval of any depth between h and 2h is named by two overlapping ranks. Of each
interval whose run has at least ``min_words`` words, all members but the first are later
copies; the lines they cover are deleted. Shorter intervals need no own test: a line is covered
by a repeated run of enough words exactly if it is covered by one that cannot lose its last
(or its first) line without falling below ``min_words``, and those are looked up for every line.

Lines without a word are not in the sequence: they go with the line before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import DOC_ID, TEXT_HASH, apart, one_per_text, packed, table, text_hash, unpacked, written

MIN_WORDS = 10
_LINE = "doc_id long, _th long, line int, rest int, ha long, hb long, ahead int, back int"


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line with words: its number among those, lines from it to the end, its ID,
    and the length of the shortest run of min_words words that begins (ahead) or ends (back)
    here, 0 if the document has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def rows(part: list) -> pa.RecordBatch:
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*part, strict=True)] or [np.zeros(0, np.int64)] * 8
            ids, null = cols[0], cols[8] if len(cols) > 8 else np.zeros(0, bool)
            arrays = [pa.array(ids, mask=null.astype(bool))] + [pa.array(c.astype(t)) for c, t in zip(cols[1:8], "i8 i4 i4 i8 i8 i4 i4".split(), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_th", "line", "rest", "ha", "hb", "ahead", "back"])

        for b in batches:
            part, held = [], 0
            for doc_id, th, text in zip(*(b.column(i).cast(pa.large_binary()) if i == 2 else b.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                lines = [(x, n) for x in (text or b"").split(b"\n") if (n := len(x.split()))]
                if not lines:
                    continue
                k = len(lines)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x, _ in lines), dtype=">i8").reshape(-1, 2)
                upto = np.concatenate([[0], np.cumsum([n for _, n in lines])])
                at = np.arange(k)
                end = np.searchsorted(upto, upto[:-1] + min_words)  # smallest end with enough words
                begin = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
                part.append((np.full(k, doc_id.as_py() or 0), np.full(k, th.as_py()), at, k - at, h[:, 0].astype(np.int64), h[:, 1].astype(np.int64),
                             np.where(end <= k, end - at, 0), np.where(begin >= 0, at + 1 - begin, 0), np.full(k, doc_id.as_py() is None)))
                held += k
                if held > 100_000:
                    yield rows(part)
                    part, held = [], 0
            if part:
                yield rows(part)

    return docs.select(F.col(DOC_ID).cast("long").alias("doc_id"), TEXT_HASH, "text").mapInArrow(run, _LINE)


def _ranked(classes: DataFrame, key: list[str], name: str) -> DataFrame:
    """Classes (distinct keys) with their place in the global order of the keys as ``_r``."""
    return written(classes.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(
        "_r", F.monotonically_increasing_id()), name)


def _repeated(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows (pos, rest, *key) whose key occurs again, as (pos, rest, r, first): r orders the
    keys, first is the smallest pos of the key. Written."""
    classes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1").drop("n")
    ranked = _ranked(classes, key, name + "-rank")
    other = ranked.select(*[apart(F.col(k)).alias(k) for k in key], "_r", "first")
    return written(rows.join(other, key).select("pos", "rest", F.col("_r").alias("r"), "first"), name)


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _th, lines): numbers (from 0, among the lines with words) of the lines to
    delete, for documents that have any. See ``dedup_lines``."""
    order = [F.col("doc_id").asc_nulls_last(), F.col(TEXT_HASH).asc()]
    # Written first: dealing by ranges reads its rows twice, once for the ranges' bounds.
    lines = written(_lines(one_per_text(docs), min_words), "ids")
    seq = written(lines.repartitionByRange(*order).sortWithinPartitions(
        *order, "line").withColumn("pos", F.monotonically_increasing_id()), "lines")
    levels = [_repeated(seq.select("pos", "rest", "ha", "hb"), ["ha", "hb"], "level")]
    while True:
        h = 1 << (len(levels) - 1)
        now = levels[-1]
        after = now.select((F.col("pos") - h).alias("pos"), F.col("r").alias("r2"))
        pairs = written(now.where(F.col("rest") > h).select("pos", "rest", "r").join(after, "pos"), "pairs")
        if pairs.isEmpty():
            break
        nxt = _repeated(pairs, ["r", "r2"], "level")
        if nxt.isEmpty():
            break
        levels.append(nxt)
    allr = None
    for k, lv in enumerate(levels):
        if 1 << k <= max(min_words, 1):  # a shortest run has a word in every line
            part = lv.select("pos", F.lit(k).alias("k"), "r", "first")
            allr = part if allr is None else allr.unionByName(part)
    depth = F.floor(F.log2("len") + 1e-9).cast("int")
    runs = seq.where("ahead > 0").select("pos", F.col("ahead").alias("len")).unionByName(
        seq.where("back > 1").select((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("len")))
    begun = written(runs.withColumn("k", depth).join(allr, ["pos", "k"]), "runs")
    power = F.expr("shiftleft(1, k)")
    even = begun.where(F.col("len") == power).where("pos > first").select("pos", "len")
    tail = allr.select("pos", "k", F.col("r").alias("r2"))
    odd = written(begun.where(F.col("len") > power).select(
        "len", F.col("r").alias("r1"), "k", F.col("pos").alias("at"), (F.col("pos") + F.col("len") - power).alias("pos")
    ).join(tail, ["pos", "k"]).select("at", "len", "r1", "r2"), "odd")
    least = odd.groupBy("len", "r1", "r2").agg(F.min("at").alias("first")).select(
        "len", apart(F.col("r1")).alias("r1"), apart(F.col("r2")).alias("r2"), "first")
    odd_later = odd.join(least, ["len", "r1", "r2"]).where("at > first").select(F.col("at").alias("pos"), "len")
    covered = even.unionByName(odd_later).select(F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("pos")).distinct()
    return seq.select("pos", "doc_id", TEXT_HASH, "line").join(covered, "pos").groupBy("doc_id", TEXT_HASH).agg(
        F.collect_list("line").alias("lines"))


@F.arrow_udf(StringType())
def _without(texts: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts, lines, strict=True):
        gone = gone.as_py()
        if not gone:
            out.append(text.as_py())
            continue
        gone, at, keep, drop = set(gone), -1, [], False
        for x in text.as_py().split("\n"):
            if x.strip(" \t\n\x0b\f\r"):
                at += 1
                drop = at in gone
            if not drop:
                keep.append(x)
        out.append("\n".join(keep))
    return pa.array(out, type=pa.string())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``, plus
    ``lines_removed`` (lines with words); n_chars, if there is one, follows the text.

    A run is consecutive lines of one document (lines without words aside) with at least
    ``min_words`` words; its first copy in (doc_id, nulls last; text hash; line) order
    stays, all others go, within a document too. Every row is kept: a text may become
    empty; null stays null. Rows with equal doc_id and text are one document and get equal
    results. Input columns named lines_removed give way. An empty table gives no rows.
    """
    gone = deleted_lines(docs, min_words).select(F.col("doc_id").alias("_id"), F.col(TEXT_HASH).alias("_h"), "lines")
    keyed = packed(docs, id=F.col(DOC_ID).cast("long"), h=text_hash(), text=F.col("text"))
    got = keyed.join(gone, keyed["id"].eqNullSafe(gone["_id"]) & (keyed["h"] == gone["_h"]), "left")
    got = got.select("row", _without("text", "lines").alias("new"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("removed"))
    follow = {"n_chars": F.length("new").cast("long")} if "n_chars" in docs.columns else {}
    return unpacked(got, docs.columns, text=F.col("new"), **follow, lines_removed=F.col("removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's text after line dedup."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")
