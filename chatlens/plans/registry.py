"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

All read the driver tables (``conversations`` through the bridge, or
``documents``) in full; parameters below (reporting month, staff counts,
department map, custom rules) are the user inputs of the reference's page,
fixed here so that the SQL oracle can apply the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kpi import kpi_ladder_sql
from ..functions.rules import RuleSet, default_topic_rules, purpose_rules
from ..functions.text import word_count
from ..operators.cluster import N_CLUSTERS, cluster_prompts, prompt_terms, term_weights, vocabulary
from ..operators.distribution import distribution_string
from ..operators.enrich import tag_texts, user_rows, with_role_flags
from ..operators.metrics import by_department, conversation_stats
from ..operators.partitioning import with_text_partitions
from ..operators.period import filter_month
from ..operators import views
from ..operators.position import with_position
from ..operators.rule_table import rule_rows, tag_by_table
from .bridge import bridge_raw, load_messages, read_table
from ..session import written
from ..sources.exports import flatten_exports
from . import files
from .report import PERIOD, Analysis

# Parameters shared with the oracle SQL.
REPORT_YEAR, REPORT_MONTH = 2024, 2
STAFF = {"dept_1": 2, "dept_3": 3, "dept_4": 4}
DEPARTMENT_MAP = [("dept_0", "Kế toán"), ("dept_2", "Kinh doanh"), ("dept_4", None)]
CUSTOM_RULES_JSON = ('{"Tài chính": ["ngân sách", "doanh thu"], "Soạn thảo": ["viết", "email", "tóm tắt"], '
                     '"Kỹ thuật": ["code", "bug", "python"], "Trống": []}')
#: Shortest benchmark word that is a keyword of ``document_item_rules``.
RULE_WORD = 8


def compare_ready(df: DataFrame) -> DataFrame:
    """Result table as compared with the oracle: doubles rounded to 6 places,
    timestamps as ``YYYY-MM-DD HH:MM:SS`` text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _messages(spark, sf_dir):
    return load_messages(spark, sf_dir)


def _month(spark, sf_dir):
    return with_role_flags(filter_month(_messages(spark, sf_dir), REPORT_YEAR, REPORT_MONTH))


def _analysis(spark, sf_dir, **kw) -> Analysis:
    return Analysis(_messages(spark, sf_dir), **kw)


def _month_analysis(spark, sf_dir, **kw) -> Analysis:
    return Analysis(_messages(spark, sf_dir), REPORT_YEAR, REPORT_MONTH, **kw)


# ------------------------------------------------------------------ ingest
def mapping_export_docs(conversations: DataFrame) -> DataFrame:
    """One export document per message, mapping form: ``{id, title, mapping: {node: {id, message}}}``."""
    raw = bridge_raw(conversations)
    message = F.struct(
        F.col("message_id").alias("id"),
        F.struct(F.col("role").alias("role"), F.col("author").alias("name")).alias("author"),
        F.struct(F.lit("text").alias("content_type"), F.array(F.col("text")).alias("parts")).alias("content"),
        F.col("epoch_seconds").alias("create_time"),
    )
    node = F.struct(F.col("message_id").alias("id"), message.alias("message"))
    doc = F.struct(F.col("conversation_id").alias("id"), F.col("conversation_title").alias("title"),
                   F.create_map(F.col("message_id"), node).alias("mapping"))
    return raw.select("account", F.to_json(doc).alias("json"))


def list_export_docs(conversations: DataFrame) -> DataFrame:
    """One export document per message, wrapped list form:
    ``{conversations: [{conversation_id, conversation_title, messages: [{id, role, content, timestamp}]}]}``."""
    raw = bridge_raw(conversations)
    item = F.struct(F.col("message_id").alias("id"), F.col("role").alias("role"), F.col("text").alias("content"),
                    F.col("epoch_seconds").cast("long").cast("string").alias("timestamp"))
    conv = F.struct(F.col("conversation_id").alias("conversation_id"),
                    F.col("conversation_title").alias("conversation_title"),
                    F.array(item).alias("messages"))
    return raw.select("account", F.to_json(F.struct(F.array(conv).alias("conversations"))).alias("json"))


def _roundtrip(spark, sf_dir, builder):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    docs = builder(read_table(spark, sf_dir, "conversations"))
    return compare_ready(flatten_exports(docs, json_col="json", account_col="account").messages)


# ------------------------------------------------------------------ queries
def q_messages_flat(spark, sf_dir):
    return compare_ready(with_role_flags(_messages(spark, sf_dir)))


def q_ingest_mapping_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, mapping_export_docs)


def q_ingest_list_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, list_export_docs)


def q_month_messages(spark, sf_dir):
    return compare_ready(filter_month(_messages(spark, sf_dir), REPORT_YEAR, REPORT_MONTH))


def q_conversation_stats(spark, sf_dir):
    return compare_ready(conversation_stats(_month(spark, sf_dir)))


def q_overview(spark, sf_dir):
    return _month_analysis(spark, sf_dir).overview()


def q_by_department(spark, sf_dir):
    return by_department(conversation_stats(_month(spark, sf_dir)))


def q_by_department_topic(spark, sf_dir):
    return _month_analysis(spark, sf_dir).by_department_topic().drop("month")


def _all_prompts(spark, sf_dir, **kw):
    return tag_texts(user_rows(_messages(spark, sf_dir)), **kw)


def q_prompt_topic(spark, sf_dir):
    return _all_prompts(spark, sf_dir, with_purpose=False, with_quality=False, with_words=False).select(
        "message_id", "department", "topic")


def q_prompt_purpose(spark, sf_dir):
    return _all_prompts(spark, sf_dir, with_topic=False, with_quality=False, with_words=False).select(
        "message_id", "department", "purpose")


def q_prompt_quality(spark, sf_dir):
    return _all_prompts(spark, sf_dir, with_topic=False, with_purpose=False).select(
        "message_id", "word_count", "prompt_quality")


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def q_document_topic(spark, sf_dir):
    return tag_texts(_documents(spark, sf_dir), with_purpose=False, with_quality=False, with_words=False).select("doc_id", "topic")


def q_document_purpose(spark, sf_dir):
    return tag_texts(_documents(spark, sf_dir), with_topic=False, with_quality=False, with_words=False).select("doc_id", "purpose")


def q_word_count_documents(spark, sf_dir):
    return with_text_partitions(_documents(spark, sf_dir)).select("doc_id", word_count(F.col("text")).alias("word_count"))


def q_document_quality(spark, sf_dir):
    return tag_texts(_documents(spark, sf_dir), with_topic=False, with_purpose=False, with_words=False).select("doc_id", "prompt_quality")


def _distribution(spark, sf_dir, label):
    a = _analysis(spark, sf_dir)
    keys = list(PERIOD) + ["department"]
    counts = a.prompts.where(F.col("department").isNotNull()).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"))
    return distribution_string(counts, keys, label, out_col=f"{label}_distribution")


def q_purpose_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir, "purpose")


def q_topic_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir, "topic")


def q_department_metrics(spark, sf_dir):
    return compare_ready(_analysis(spark, sf_dir).department_metrics())


def q_kpi_per_head(spark, sf_dir):
    k = _analysis(spark, sf_dir, staff=STAFF).kpi()
    return k.select("month", "department", "rating", "raw_score", "staff", "kpi_score")


def department_map_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEPARTMENT_MAP, "account string, department string")


def q_department_override(spark, sf_dir):
    a = _month_analysis(spark, sf_dir, department_map=department_map_frame(spark))
    return a.by_department().drop("month")


def q_department_report(spark, sf_dir):
    return compare_ready(_month_analysis(spark, sf_dir).report())


def q_report_all_months(spark, sf_dir):
    return compare_ready(_analysis(spark, sf_dir).report())


def q_department_list(spark, sf_dir):
    return _analysis(spark, sf_dir).departments()


def q_kpi_table(spark, sf_dir):
    return _month_analysis(spark, sf_dir, staff=STAFF).kpi_table()


def q_conversation_list(spark, sf_dir):
    return compare_ready(views.conversation_list(_month_analysis(spark, sf_dir).conv_stats))


def q_prompt_list(spark, sf_dir):
    return compare_ready(views.prompt_list(_month_analysis(spark, sf_dir).prompts))


def q_assistant_replies(spark, sf_dir):
    return compare_ready(views.assistant_replies(_month(spark, sf_dir)))


def q_department_raw(spark, sf_dir):
    return compare_ready(views.department_raw(_month(spark, sf_dir)))


def q_transcript(spark, sf_dir):
    return views.transcript(_month(spark, sf_dir))


def q_custom_rules(spark, sf_dir):
    rules = RuleSet.from_json(CUSTOM_RULES_JSON)
    return _month_analysis(spark, sf_dir, topic_rules=rules).by_department_topic().drop("month")


def q_prompt_clusters(spark, sf_dir):
    a = _month_analysis(spark, sf_dir)
    return cluster_prompts(a.prompts).select("message_id", "department", "cluster")


def q_prompt_cluster_invariants(spark, sf_dir):
    """What holds for any clustering: a label of the given ones for every prompt, one for equal texts, sizes that add up."""
    a = _month_analysis(spark, sf_dir)
    got = written(cluster_prompts(a.prompts, n_init=1).select("text", "cluster"), "labels")
    texts = got.groupBy("text").agg(F.count("*").alias("n"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    return texts.agg(F.sum("n").alias("prompts"), F.count("*").alias("texts"), F.min("low").alias("smallest_label"),
                     F.max("high").alias("largest_label"), F.sum((F.col("low") != F.col("high")).cast("long")).alias("texts_of_two_labels")).select(
        "prompts", "texts", F.col("smallest_label").between(0, N_CLUSTERS - 1).alias("smallest_in_range"),
        F.col("largest_label").between(0, N_CLUSTERS - 1).alias("largest_in_range"), "texts_of_two_labels")


def q_prompt_terms(spark, sf_dir):
    a = _month_analysis(spark, sf_dir)
    return compare_ready(vocabulary(prompt_terms(a.prompts.select("message_id", "text"))))


def q_prompt_tfidf(spark, sf_dir):
    a = _month_analysis(spark, sf_dir)
    terms = prompt_terms(a.prompts.select("message_id", "text"))
    return compare_ready(term_weights(terms, vocabulary(terms), "message_id"))


def q_conversation_topic(spark, sf_dir):
    """User turns as they are in the table, without the bridge's phrases."""
    turns = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return tag_texts(turns).select("conv_id", "turn", "topic", "purpose", "prompt_quality", "word_count")


def q_document_topic_by_table(spark, sf_dir):
    """The default topic rules held as a table and matched by a join: the labels of ``document_topic``."""
    rules = rule_rows(spark, default_topic_rules())
    return tag_by_table(with_text_partitions(_documents(spark, sf_dir)), rules).select("doc_id", "topic")


def item_rules(benchmark: DataFrame) -> DataFrame:
    """(rank, label, keyword): a rule per benchmark item, its keywords the item's words of ``RULE_WORD`` characters or more."""
    word = benchmark.select("item_id", F.explode(F.split("text", " ")).alias("keyword"))
    return word.where(F.char_length("keyword") >= RULE_WORD).select(
        F.col("item_id").alias("rank"), F.concat(F.lit("item "), "item_id").alias("label"), "keyword").distinct()


def q_document_item_rules(spark, sf_dir):
    """Rules that come from a table and grow with it: the first benchmark item with a long word that is in the document."""
    rules = written(item_rules(read_table(spark, sf_dir, "benchmark")), "rules")
    return tag_by_table(with_text_partitions(_documents(spark, sf_dir)), rules, "first_item").select("doc_id", "first_item")


def q_custom_rules_by_table(spark, sf_dir):
    """The user's rules as a table through the whole analysis: the rows of ``custom_rules``."""
    rules = rule_rows(spark, RuleSet.from_json(CUSTOM_RULES_JSON))
    return _month_analysis(spark, sf_dir, topic_rules=rules).by_department_topic().drop("month")


def q_kpi_bands(spark, sf_dir):
    """The rating ladder over five metrics derived from the keys of ``orders``, so that every band occurs."""
    k = F.col("o_orderkey")
    m = read_table(spark, sf_dir, "orders").select(
        k.alias("o_orderkey"), (k * 7 % 260).alias("prompts"), (k * 3 % 32).alias("active_days"), (k * 5 % 21).alias("unique_topics"),
        ((k * 11 % 130) / 10.0).cast("double").alias("avg_prompts_per_conversation"), ((k * 13 % 500) / 10.0).cast("double").alias("avg_words_per_prompt"))
    rating, raw = kpi_ladder_sql()
    return m.select("o_orderkey", F.expr(rating).alias("rating"), F.expr(raw).alias("raw_score"))


def shaped_export_docs(conversations: DataFrame) -> DataFrame:
    """(file, json): one export document per message, of a shape chosen by (conv_id + turn) % 10.

    0 list root, map with null, empty, role-less nodes; 1 wrapped, list, text time; 2 single root, list, author,
    text content, ms; 3 single root, map, text content, title under its other name, node id as message id; 4 list
    items without time; 5 zero time with a timestamp; 6 a node that is no object; 7 no JSON; 8 a good and a
    bad conversation; 9 a bare string among conversations.
    """
    c = conversations.select(
        ((F.col("conv_id") + F.col("turn")) % 10).alias("s"), F.concat_ws("-", "conv_id", "turn").alias("m"), F.concat(F.lit("c"), "conv_id").alias("c"),
        "role", "text", (F.lit(1704067200) + F.col("conv_id") % 90 * 86400 + F.col("turn") * 60).alias("sec"))
    j = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    author = j(role=F.col("role"), name=F.lit("n"))
    parts = j(parts=F.array("text", F.lit(None).cast("string")))
    node = j(message=j(id=F.col("m"), author=author, content=parts, create_time=F.col("sec")))
    none = F.lit(None).cast("string")
    text_of = lambda st: F.to_json(st, {"ignoreNullFields": "false"})
    as_list = lambda st: F.concat(F.lit("["), text_of(st), F.lit("]"))
    no_role = j(message=j(id=F.lit("x"), author=j(role=none, name=none), content=j(parts=F.array(F.lit("lost"), none)), create_time=F.col("sec")))
    empty = j(message=j(id=F.lit("y"), author=author, content=j(parts=F.array(F.lit(""), none)), create_time=F.col("sec")))
    gone = j(message=F.lit(None).cast("struct<id:string,author:struct<role:string,name:string>,content:struct<parts:array<string>>,create_time:bigint>"))
    item = lambda **kw: F.array(j(**kw))
    good = j(id=F.col("c"), title=F.lit("T"), messages=item(id=F.col("m"), role=F.col("role"), content=F.col("text"), create_time=F.col("sec")))
    docs = (
        as_list(j(id=F.col("c"), title=F.lit("T"), mapping=F.create_map(F.lit("k"), node, F.lit("a"), no_role, F.lit("b"), empty, F.lit("d"), gone))),
        text_of(j(conversations=F.array(j(conversation_id=F.col("c"), conversation_title=F.lit("T"), messages=item(
            id=F.col("m"), role=F.col("role"), content=F.col("text"), timestamp=F.col("sec").cast("string")))))),
        text_of(j(id=F.col("c"), title=F.lit("T"), messages=item(id=F.col("m"), author=author, content=j(text=F.col("text")), create_time=F.col("sec") * 1000))),
        text_of(j(id=none, conversation_id=F.col("c"), title=F.lit(""), conversation_title=F.lit("T"), mapping=F.create_map(F.col("m"), j(message=j(
            author=author, content=j(text=F.col("text")), create_time=F.col("sec").cast("string")))))),
        as_list(j(id=F.col("c"), title=F.lit("T"), messages=item(id=F.col("m"), role=F.col("role"), content=F.col("text"), create_time=none))),
        as_list(j(id=F.col("c"), title=F.lit("T"), messages=item(id=F.col("m"), role=F.col("role"), content=F.col("text"), create_time=F.lit(0), timestamp=F.col("sec")))),
        as_list(j(id=F.col("c"), title=F.lit("T"), mapping=F.create_map(F.lit("k"), F.lit(5)))),
        F.concat(F.lit("{"), F.col("m")),
        F.concat(F.lit("["), text_of(good), F.lit(",{\"id\":\"bad\",\"messages\":[7]}]")),
        F.concat(F.lit("["), text_of(good), F.lit(",\"text\"]")),
    )
    json = F.when(F.col("s") == 0, docs[0])
    for k, d in enumerate(docs[1:], 1):
        json = json.when(F.col("s") == k, d)
    return c.select(F.concat(F.lit("f"), "m").alias("file"), json.alias("json"))


def _shapes(spark, sf_dir, on_error):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    docs = shaped_export_docs(read_table(spark, sf_dir, "conversations"))
    return flatten_exports(docs, json_col="json", account_col="file", on_error=on_error)


def q_ingest_shapes(spark, sf_dir):
    return compare_ready(_shapes(spark, sf_dir, "file").messages)


def q_ingest_record_mode(spark, sf_dir):
    return compare_ready(_shapes(spark, sf_dir, "record").messages)


def q_ingest_rejected(spark, sf_dir):
    return _shapes(spark, sf_dir, "file").rejected


def q_custom_rules_distribution(spark, sf_dir):
    a = _month_analysis(spark, sf_dir, topic_rules=RuleSet.from_json(CUSTOM_RULES_JSON))
    return a.department_metrics().select("department", "prompts", "unique_topics", "topic_distribution", "purpose_distribution")


VIEW_DEPARTMENT, VIEW_CONVERSATION = "dept_1", "c36"


def q_department_conversations(spark, sf_dir):
    """FIL-5 drill-down of one department, with the rows' positions."""
    v = views.conversation_list(_month_analysis(spark, sf_dir).conv_stats, VIEW_DEPARTMENT)
    return compare_ready(with_position(v, [F.asc_nulls_last("first_time"), F.asc("conversation_id")]))


def q_department_prompts(spark, sf_dir):
    v = views.prompt_list(_month_analysis(spark, sf_dir).prompts, VIEW_DEPARTMENT)
    return compare_ready(with_position(v, [F.asc_nulls_last("create_time"), F.asc("message_id")]))


def q_conversation_transcript(spark, sf_dir):
    """FIL-7: the turns of one conversation of a department, in order."""
    v = views.transcript(_analysis(spark, sf_dir).month_df, VIEW_DEPARTMENT, VIEW_CONVERSATION)
    return compare_ready(with_position(v, [F.asc("time_text"), F.asc("message_id")]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "messages_flat": q_messages_flat,
    "ingest_mapping_roundtrip": q_ingest_mapping_roundtrip,
    "ingest_list_roundtrip": q_ingest_list_roundtrip,
    "month_messages": q_month_messages,
    "conversation_stats": q_conversation_stats,
    "overview": q_overview,
    "by_department": q_by_department,
    "by_department_topic": q_by_department_topic,
    "prompt_topic": q_prompt_topic,
    "prompt_purpose": q_prompt_purpose,
    "prompt_quality": q_prompt_quality,
    "document_topic": q_document_topic,
    "document_purpose": q_document_purpose,
    "word_count_documents": q_word_count_documents,
    "document_quality": q_document_quality,
    "purpose_distribution": q_purpose_distribution,
    "topic_distribution": q_topic_distribution,
    "department_metrics": q_department_metrics,
    "kpi_per_head": q_kpi_per_head,
    "department_override": q_department_override,
    "department_report": q_department_report,
    "report_all_months": q_report_all_months,
    "kpi_table": q_kpi_table,
    "department_list": q_department_list,
    "conversation_list": q_conversation_list,
    "prompt_list": q_prompt_list,
    "assistant_replies": q_assistant_replies,
    "department_raw": q_department_raw,
    "transcript": q_transcript,
    "custom_rules": q_custom_rules,
    "custom_rules_distribution": q_custom_rules_distribution,
    "prompt_terms": q_prompt_terms,
    "prompt_tfidf": q_prompt_tfidf,
    "conversation_topic": q_conversation_topic,
    "document_topic_by_table": q_document_topic_by_table,
    "document_item_rules": q_document_item_rules,
    "custom_rules_by_table": q_custom_rules_by_table,
    "kpi_bands": q_kpi_bands,
    "ingest_shapes": q_ingest_shapes,
    "ingest_record_mode": q_ingest_record_mode,
    "ingest_rejected": q_ingest_rejected,
    "department_conversations": q_department_conversations,
    "department_prompts": q_department_prompts,
    "conversation_transcript": q_conversation_transcript,
    "prompt_clusters": q_prompt_clusters,
    "prompt_cluster_invariants": q_prompt_cluster_invariants,
}

QUERIES.update(files.QUERIES)

__all__ = ["QUERIES", "compare_ready", "mapping_export_docs", "list_export_docs", "default_topic_rules",
           "purpose_rules"]
