"""Keyword rules held as a table ``(rank, label, keyword)`` and matched by a join (SRC-14, UDF-2).

The compiled form (``functions.rules.tag_sql``) puts every keyword into the plan and tests each on every text: right
for tens of rules, not for thousands. Here a keyword is looked up by n-grams of its own, its anchors: a text is cut
into pieces, a piece into its distinct words, and these meet the anchors of each keyword's longest word with every
``stride``-th of their n-grams. Only keywords with an anchor in a word are compared with that word, and those of several words
with the piece too. The plan has one size for any rule set, and a text costs what its words of the keywords' lengths cost.

The texts do not move: anchors go to them (broadcast up to ``BROADCAST_BYTES``, beyond that a shuffled join on the
n-gram, which Spark may split), hits are reduced to the lowest rank per key before anything is exchanged, and labels
are joined back by key, so that the side joined back reads no text if ``key`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import FALLBACK_LABEL
from ..functions.rules import RuleSet

#: Shortest n-gram that anchors a keyword; shorter keywords are their own anchor.
GRAM = 3
#: Longest n-gram and widest stride, reached if no keyword of ``GRAM`` characters or more has under 8.
LONG_GRAM, STRIDE = 5, 4
#: Characters between the words of a text, as in a regular expression's brackets.
GAP = r" \t\r\n"
#: Characters of a piece of text. Pieces overlap by the longest keyword.
PIECE = 4096
#: Anchors of up to so many bytes are sent to the texts.
BROADCAST_BYTES = 16 << 20


def rule_rows(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """A rule set as a table: rank is the place of the rule, one row a keyword."""
    rows = [(rank, label, kw) for rank, (label, kws) in enumerate(rules.lowered()) for kw in kws]
    return spark.createDataFrame(rows, "rank int, label string, keyword string")


def _keywords(rules: DataFrame) -> DataFrame:
    """(keyword, rank): lower-cased keywords, each with the first rule it stands in."""
    rows = rules.select(F.lower("keyword").alias("keyword"), F.col("rank").cast("long").alias("rank"))
    return rows.where("keyword is not null and rank is not null").groupBy("keyword").agg(F.min("rank").alias("rank"))


def _labels(rules: DataFrame) -> DataFrame:
    """(rank, label): a rank with several labels has the smallest."""
    return rules.where("rank is not null and label is not null").groupBy(F.col("rank").cast("long").alias("rank")).agg(
        F.min("label").alias("label"))


def _grams(text: Column, n: int, stride: int = 1) -> Column:
    """The n-grams of a text that begin at multiples of ``stride``, in one pass, repeats included."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).{{1,{stride}}}"), F.lit(1))


def anchors(rules: DataFrame, counts: DataFrame | None = None, gram: int = GRAM, stride: int = 1) -> DataFrame:
    """(gram, keyword, rank): each keyword with its rarest n-gram, ties to the smallest gram.

    With a stride, that many n-grams in a row, rarest in sum: wherever the keyword stands in a word, one of them begins
    at a multiple of the stride. Keywords of ``GRAM`` characters or more must have ``gram + stride - 1``.
    Rare by ``counts`` (gram, n; n-grams that it lacks count 0) if given, such as ``gram_counts`` of the texts; else by the
    number of keywords that hold the n-gram. Any choice gives the same labels.
    """
    own = F.when(F.char_length("keyword") < GRAM, F.array("keyword")).otherwise(_grams(F.col("keyword"), gram))
    rows = _keywords(rules).where("keyword <> ''").select("keyword", "rank", own.alias("own"))
    n = counts.select("gram", "n") if counts is not None else rows.select(F.explode(F.array_distinct("own")).alias("gram")).groupBy(
        "gram").agg(F.count("*").alias("n"))
    first = F.sequence(F.lit(1), F.greatest(F.size("own") - (stride - 1), F.lit(1)))
    row = F.array_distinct(F.transform(first, lambda i: F.slice(F.col("own"), i, stride)))
    held = rows.select("keyword", "rank", F.explode(row).alias("grams")).select("*", F.explode(F.array_distinct("grams")).alias("gram"))
    rated = held.join(n, "gram", "left").groupBy("keyword", "rank", "grams").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = rated.groupBy("keyword", "rank").agg(F.min(F.struct("n", "grams"))["grams"].alias("grams"))
    return best.select(F.explode(F.array_distinct("grams")).alias("gram"), "keyword", "rank")


def _run(keyword: Column) -> Column:
    """The longest word of a keyword, ties to the smallest; the keyword itself if it is all gaps."""
    words = F.regexp_extract_all(keyword, F.lit(f"[^{GAP}]+"), F.lit(0))
    longest = F.array_min(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))["w"]
    return F.coalesce(longest, keyword)


def _cut(shortest: int, any_gram: bool) -> tuple[int, int]:
    """(gram, stride) for keywords of ``shortest`` characters or more."""
    gram = max(GRAM, min((shortest + 2) // 2, LONG_GRAM)) if any_gram else GRAM
    return gram, min(shortest - gram + 1, STRIDE)


def _pieces(lowered: Column, longest: int) -> Column:
    """Pieces of a text with the beginning of the next one, so that a keyword of up to ``longest`` characters lies in one whole."""
    cut = F.regexp_extract_all(lowered, F.lit(f"(?s).{{1,{max(PIECE, longest)}}}"), F.lit(0))
    if longest <= 1:
        return cut
    ahead = lambda c, i: F.coalesce(F.substring(F.get(c, i + 1), 1, longest - 1), F.lit(""))
    # The outer transform holds the pieces, so that they are cut once and not once per piece.
    return F.flatten(F.transform(F.array(cut), lambda c: F.transform(c, lambda piece, i: F.concat(piece, ahead(c, i)))))


def gram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): in how many pieces of the texts each n-gram of up to ``GRAM`` characters occurs, for ``anchors``."""
    piece = texts.select(F.explode(_pieces(F.lower(F.col(text_col)), GRAM)).alias("piece"))
    each = F.flatten(F.array(*[F.array_distinct(_grams(F.col("piece"), n)) for n in range(1, GRAM + 1)]))
    return piece.select(F.explode(each).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def first_ranks(texts: DataFrame, rules: DataFrame, key: list[str], text_col: str = "text",
                counts: DataFrame | None = None) -> DataFrame:
    """(key, rank): the first rule with a keyword in the lower-cased text; only keys with a hit."""
    held = _keywords(rules).withColumn("run", _run(F.col("keyword")))
    n, gapped = F.char_length("run"), F.col("run") != F.col("keyword")
    # The rule table is read once for these numbers; texts are not.
    size = held.agg(
        F.min(F.when(F.col("keyword") == "", F.col("rank"))).alias("empty"), F.max(F.char_length("keyword")).alias("longest"),
        F.min(F.when(n > 0, n)).alias("shortest"), F.min(F.when(n >= GRAM, n)).alias("long"),
        F.collect_set(F.when(n.between(1, GRAM - 1), n)).alias("short"), F.max(gapped).alias("gapped"),
        F.max((n > 0) & ~F.col("run").rlike(f"[^{GAP}]")).alias("blank"),
        F.sum(F.octet_length("run") + F.when(gapped, F.octet_length("keyword")).otherwise(0) + 48).alias("bytes")).first()
    empty = size["empty"]
    lowered = texts.select(*key, F.lower(F.col(text_col)).alias("_lt")).where(F.col("_lt").isNotNull())
    hits = None
    if size["longest"]:
        gram, stride = _cut(size["long"] or GRAM, counts is None)
        if size["bytes"] <= BROADCAST_BYTES < size["bytes"] * stride:
            gram, stride = GRAM, 1  # one row a keyword can still be sent to the texts
        found = anchors(held.select(F.col("run").alias("keyword"), F.lit(0).alias("rank")), counts, gram, stride).select(
            "gram", F.col("keyword").alias("run")).join(held, "run")
        side = F.broadcast(found) if size["bytes"] * stride <= BROADCAST_BYTES else found
        word = f"[^{GAP}]{{{size['shortest']},}}" + (f"|[{GAP}]{{{size['shortest']},}}" if size["blank"] else "")
        each = [_grams(F.col("_word"), k) for k in sorted(size["short"])] + ([_grams(F.col("_word"), gram, stride)] if size["long"] else [])
        kept = [*key, "_piece"] if size["gapped"] else key
        words = lowered.select(*key, F.explode(_pieces(F.col("_lt"), size["longest"])).alias("_piece")).select(
            *kept, F.explode(F.array_distinct(F.regexp_extract_all("_piece", F.lit(word), F.lit(0)))).alias("_word"))
        grams = words.select(*kept, "_word", F.explode(F.array_distinct(F.flatten(F.array(*each)))).alias("gram"))
        hits = grams.join(side, "gram").where(F.contains("_word", "run"))
        if size["gapped"]:
            hits = hits.where(~gapped | F.contains("_piece", "keyword"))
        hits = hits.select(*key, "rank")
    if empty is not None:  # the empty keyword is in every text
        every = lowered.select(*key, F.lit(empty).cast("long").alias("rank"))
        hits = every if hits is None else hits.unionByName(every)
    if hits is None:
        hits = lowered.select(*key, F.lit(None).cast("long").alias("rank")).limit(0)
    return hits.groupBy(*key).agg(F.min("rank").alias("rank"))


def tag_by_table(df: DataFrame, rules: DataFrame, out_col: str = "topic", text_col: str = "text", key: list[str] | None = None,
                 fallback: str = FALLBACK_LABEL, counts: DataFrame | None = None) -> DataFrame:
    """``df`` with the label of the first rule (lowest rank) that has a keyword in the lower-cased text, else ``fallback``.

    The labels are those of ``tag_sql`` over the same rules. ``key``: columns whose equal values mean equal texts
    (an id); without them rows go by a SHA-256 of the text. Null texts, and texts whose key holds a null, get what their key
    says: nulls are equal keys. Rows of the rule table with a null in rank, label or keyword take no part; an empty
    keyword is in every text; an empty rule table gives the fallback. Repeated rows stay repeated. Columns of ``df`` named
    like the result give way.
    """
    rules = rules.where("rank is not null and label is not null and keyword is not null")
    names = [c for c in df.columns if c.lower() != out_col.lower()]
    if key is None:
        own, texts = ["_k0"], df.withColumn("_k0", F.sha2(F.col(text_col), 256))
    else:
        own = [f"_k{i}" for i in range(len(key))]
        texts = df.withColumns({o: F.col(k) for o, k in zip(own, key)})
    ranks = first_ranks(texts, rules, own, text_col, counts).select(*[F.col(o).alias(f"_r{o}") for o in own], F.col("rank").alias("_first"))
    labels = _labels(rules).select(F.col("rank").alias("_rank"), F.col("label").alias("_label"))
    if (labels.agg(F.sum(F.octet_length("_label") + 48)).first()[0] or 0) <= BROADCAST_BYTES:
        labels = F.broadcast(labels)
    same = lambda a, b: a.eqNullSafe(b)
    cond = same(F.col(own[0]), F.col(f"_r{own[0]}"))
    for o in own[1:]:
        cond = cond & same(F.col(o), F.col(f"_r{o}"))
    tagged = texts.join(ranks.join(labels, F.col("_first") == F.col("_rank")), cond, "left")
    return tagged.select(*names, F.coalesce("_label", F.lit(fallback)).alias(out_col))
