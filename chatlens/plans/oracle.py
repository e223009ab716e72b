"""Oracle SQL (DuckDB dialect) for every registered query that SQL can express.

Tag and score expressions are generated from the same rule tables as the Spark
expressions; the fixed tables are checked separately by tests (counts, order,
hand-computed tags). The KPI ladder is written out by hand.
"""

from __future__ import annotations

from ..functions.fixed_values import (LOCAL_TIME_ZONE, QUALITY_LENGTH_BANDS,
                                      QUALITY_LENGTH_TOP_POINTS, QUALITY_MARKER_GROUPS, QUALITY_MAX, QUALITY_MIN,
                                      SPEAKER_OTHER, SPEAKER_USER)
from ..functions.rules import RuleSet, default_topic_rules, purpose_rules
from .files import ACCOUNT_NAMES, MAPPED
from .bridge import BASE_EPOCH, DAY_SPREAD, DEPARTMENTS, PROMPT_PHRASES
from .registry import (CUSTOM_RULES_JSON, DEPARTMENT_MAP, REPORT_MONTH, REPORT_YEAR, RULE_WORD, STAFF, VIEW_CONVERSATION,
                       VIEW_DEPARTMENT)

WORD_RE = r"[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"
MONTH = f"{REPORT_YEAR:04d}-{REPORT_MONTH:02d}"
TS_FMT = "'%Y-%m-%d %H:%M:%S'"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def any_kw(lt: str, kws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lt}, {q(k)})" for k in kws) + ")" if kws else "false"


def tag_sql(lt: str, rules: RuleSet) -> str:
    whens = [f"WHEN {any_kw(lt, kws)} THEN {q(label)}" for label, kws in rules.lowered() if kws]
    return f"(CASE {' '.join(whens)} ELSE {q(rules.fallback)} END)" if whens else q(rules.fallback)


def words_sql(text: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({text}, '{WORD_RE}')), 0) AS BIGINT)"


def quality_sql(text: str, lt: str, words: str) -> str:
    band = "CASE " + " ".join(f"WHEN {words} < {b} THEN {p}" for b, p in QUALITY_LENGTH_BANDS) + \
           f" ELSE {QUALITY_LENGTH_TOP_POINTS} END"
    parts = [band]
    for _n, pts, markers in QUALITY_MARKER_GROUPS:
        kws = list(dict.fromkeys(m.lower() for m in markers))
        parts.append(f"(CASE WHEN {any_kw(lt, kws)} THEN {pts} ELSE 0 END)")
    total = " + ".join(parts)
    return (f"CAST(CASE WHEN {text} IS NULL OR {text} = '' THEN 0 "
            f"ELSE least({QUALITY_MAX}, greatest({QUALITY_MIN}, {total})) END AS BIGINT)")


def purpose_sql(text: str, lt: str) -> str:
    r = purpose_rules()
    return f"(CASE WHEN coalesce({text}, '') = '' THEN {q(r.fallback)} ELSE {tag_sql(lt, r)} END)"


#: The rating ladder, written out by hand from its thresholds: (condition, label, score), first match wins.
KPI_CASES = """
  WHEN prompts >= 200 AND active_days >= 25 AND unique_topics >= 17 AND {m} >= 10 AND {w} >= 40 THEN {a}
  WHEN prompts >= 150 AND active_days >= 22 AND unique_topics >= 14 AND {m} >= 8 AND {w} >= 35 THEN {b}
  WHEN prompts >= 120 AND active_days >= 16 AND unique_topics >= 12 AND {m} >= 6 AND {w} >= 30 THEN {c}
  WHEN prompts >= 100 AND active_days >= 14 AND unique_topics >= 10 AND {m} >= 5 AND {w} >= 25 THEN {d}
  WHEN prompts >= 100 AND active_days >= 12 AND {m} >= 4 AND {w} >= 20 THEN {e}
  WHEN (prompts >= 100 OR active_days >= 5) AND {m} >= 3 AND {w} >= 15 THEN {f}
  WHEN prompts > 0 THEN {g} ELSE {h} END"""
_METRICS = {"m": "avg_prompts_per_conversation", "w": "avg_words_per_prompt"}


def kpi_sql() -> tuple[str, str]:
    """(rating, score) of a row of metrics."""
    labels = dict(a="'Xuất sắc'", b="'Rất tốt'", c="'Tốt+'", d="'Tốt'", e="'Khá'", f="'Trung bình'", g="'Thấp'",
                  h="'Không sử dụng'")
    scores = dict(a=100, b=95, c=90, d=85, e=80, f=50, g=25, h=0)
    return ("CASE" + KPI_CASES.format(**_METRICS, **labels),
            "CAST(CASE" + KPI_CASES.format(**_METRICS, **scores) + " AS BIGINT)")


# ------------------------------------------------------------------ CTEs
def messages_cte() -> str:
    phrases = "[" + ", ".join(q(p) for p in PROMPT_PHRASES) + "]"
    n = len(PROMPT_PHRASES)
    local = f"timezone('{LOCAL_TIME_ZONE}', to_timestamp(epoch_seconds))"
    return f"""raw AS (
  SELECT 'dept_' || CAST(conv_id % {DEPARTMENTS} AS VARCHAR) AS account,
         'c' || CAST(conv_id AS VARCHAR) AS conversation_id,
         'Conversation ' || CAST(conv_id AS VARCHAR) AS conversation_title,
         CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id,
         role, CAST(NULL AS VARCHAR) AS author,
         CASE WHEN role = 'user' THEN {phrases}[((conv_id * 3 + turn) % {n}) + 1] || ' ' || text ELSE text END AS text,
         CAST({BASE_EPOCH} + ((conv_id * 37) % {DAY_SPREAD}) * 86400 + turn * 3600 AS DOUBLE) AS epoch_seconds,
         'dept_' || CAST(conv_id % {DEPARTMENTS} AS VARCHAR) AS department
  FROM conversations),
messages AS (
  SELECT account, conversation_id, conversation_title, message_id, role, author, text,
         timezone('UTC', to_timestamp(epoch_seconds)) AS create_time_utc,
         {local} AS create_time_local,
         CAST({local} AS DATE) AS date,
         strftime({local}, '%Y-%m') AS month,
         department
  FROM raw)"""


def flags(src: str) -> str:
    return (f"SELECT *, coalesce(role = 'user', false) AS is_user, coalesce(role = 'assistant', false) AS is_assistant "
            f"FROM {src}")


def month_cte(map_rows=None) -> str:
    base = f"SELECT * FROM messages WHERE month = '{MONTH}'"
    if map_rows is not None:
        vals = ", ".join(f"({q(a)}, {q(d)})" for a, d in map_rows)
        base = (f"SELECT m.account, m.conversation_id, m.conversation_title, m.message_id, m.role, m.author, m.text, "
                f"m.create_time_utc, m.create_time_local, m.date, m.month, "
                f"coalesce(dm.department_override, m.department) AS department "
                f"FROM ({base}) m LEFT JOIN (VALUES {vals}) dm(account, department_override) USING (account)")
    return f"month_df AS ({flags('(' + base + ')')})"


def all_month_cte() -> str:
    return f"month_df AS ({flags('(SELECT * FROM messages WHERE month IS NOT NULL)')})"


CONV_STATS = """conv_stats AS (
  SELECT month, account, department, conversation_id, conversation_title,
         min(create_time_local) AS first_time, max(create_time_local) AS last_time,
         count(*) FILTER (WHERE role = 'user') AS user_prompts,
         count(*) FILTER (WHERE role = 'assistant') AS assistant_msgs,
         count(message_id) AS total_msgs, count(DISTINCT date) AS active_days
  FROM month_df GROUP BY month, account, department, conversation_id, conversation_title)"""


def prompts_cte(topic_rules: RuleSet | None = None) -> str:
    topic_rules = topic_rules or default_topic_rules()
    return f"""prompts0 AS (SELECT *, lower(text) AS lt, {words_sql('text')} AS word_count FROM month_df WHERE role = 'user'),
prompts AS (
  SELECT *, {tag_sql('lt', topic_rules)} AS topic, {purpose_sql('text', 'lt')} AS purpose,
         {quality_sql('text', 'lt', 'word_count')} AS prompt_quality
  FROM prompts0)"""


def dist_cte(name: str, label: str, src: str) -> str:
    line = (f"'+ ' || label || ' (' || CAST(CAST(round_even(CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * 100.0, 0) "
            f"AS BIGINT) AS VARCHAR) || '%)'")
    return f"""{name} AS (
  SELECT month, department, string_agg({line}, chr(10) ORDER BY n DESC, label ASC) AS {label}_distribution
  FROM (SELECT *, sum(n) OVER (PARTITION BY month, department) AS total
        FROM (SELECT month, department, {label} AS label, sum(n) AS n FROM {src} GROUP BY month, department, {label}))
  GROUP BY month, department)"""


METRICS = """conv_part AS (
  SELECT month, department, count(DISTINCT conversation_id) AS conversations,
         avg(user_prompts) AS avg_prompts_per_conversation
  FROM conv_stats WHERE department IS NOT NULL GROUP BY month, department),
days_part AS (
  SELECT month, department, count(DISTINCT date) AS active_days
  FROM month_df WHERE department IS NOT NULL GROUP BY month, department),
cube AS (
  SELECT month, department, topic, purpose, count(*) AS n, sum(word_count) AS words
  FROM prompts WHERE department IS NOT NULL GROUP BY month, department, topic, purpose),
totals AS (
  SELECT month, department, sum(n) AS prompts, sum(words) AS words, count(DISTINCT topic) AS unique_topics
  FROM cube GROUP BY month, department),
""" + dist_cte("pdist", "purpose", "cube") + ",\n" + dist_cte("tdist", "topic", "cube") + """,
metrics AS (
  SELECT c.month, c.department, CAST(c.conversations AS BIGINT) AS conversations,
         c.avg_prompts_per_conversation, CAST(d.active_days AS BIGINT) AS active_days,
         CAST(coalesce(t.prompts, 0) AS BIGINT) AS prompts,
         CASE WHEN t.prompts > 0 THEN CAST(t.words AS DOUBLE) / CAST(t.prompts AS DOUBLE) ELSE 0.0 END
           AS avg_words_per_prompt,
         CAST(coalesce(t.unique_topics, 0) AS BIGINT) AS unique_topics,
         coalesce(pd.purpose_distribution, '') AS purpose_distribution,
         coalesce(td.topic_distribution, '') AS topic_distribution
  FROM conv_part c JOIN days_part d USING (month, department)
  LEFT JOIN totals t USING (month, department)
  LEFT JOIN pdist pd USING (month, department)
  LEFT JOIN tdist td USING (month, department))"""


def kpi_cte(staff: dict | None) -> str:
    rating, score = kpi_sql()
    if staff:
        vals = ", ".join(f"({q(k)}, {int(v)})" for k, v in staff.items())
        join = f"LEFT JOIN (VALUES {vals}) s(department, staff_n) USING (department)"
        staff_col = "CAST(coalesce(staff_n, 1) AS BIGINT)"
    else:
        join, staff_col = "", "CAST(1 AS BIGINT)"
    return f"""kpi0 AS (SELECT *, {rating} AS rating, {score} AS raw_score FROM metrics),
kpi AS (
  SELECT *, CASE WHEN staff > 0 THEN CAST(round_even(CAST(raw_score AS DOUBLE) / CAST(staff AS DOUBLE), 0) AS BIGINT)
                 ELSE 0 END AS kpi_score
  FROM (SELECT kpi0.*, {staff_col} AS staff FROM kpi0 {join}))"""


REPORT_SELECT = """SELECT department,
       CAST(row_number() OVER (PARTITION BY month ORDER BY department) AS BIGINT) AS ordinal,
       substr(month, 6, 2) || '-' || substr(month, 1, 4) AS month_label,
       active_days, conversations,
       round(avg_prompts_per_conversation, 6) AS avg_prompts_per_conversation,
       round(avg_words_per_prompt, 6) AS avg_words_per_prompt,
       purpose_distribution, topic_distribution, rating, kpi_score
FROM kpi"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def ts(col: str, alias: str | None = None) -> str:
    return f"strftime({col}, {TS_FMT}) AS {alias or col}"


MSG_COLS = ("account, conversation_id, conversation_title, message_id, role, author, text, "
            + ts("create_time_utc") + ", " + ts("create_time_local") + ", date, month, department")


def _month_report_base(staff=None, topic_rules=None):
    return with_(messages_cte(), month_cte(), CONV_STATS, prompts_cte(topic_rules), METRICS, kpi_cte(staff))


def _all_report_base(staff=None):
    return with_(messages_cte(), all_month_cte(), CONV_STATS, prompts_cte(), METRICS, kpi_cte(staff))


def _dist_query(label: str) -> str:
    return (with_(messages_cte(), all_month_cte(), prompts_cte(),
                  f"c AS (SELECT month, department, {label}, count(*) AS n FROM prompts "
                  f"WHERE department IS NOT NULL GROUP BY month, department, {label})",
                  dist_cte("d", label, "c"))
            + "SELECT * FROM d")


def _all_prompts_select(cols: str) -> str:
    return (with_(messages_cte(),
                  f"p AS (SELECT *, lower(text) AS lt, {words_sql('text')} AS word_count FROM messages "
                  f"WHERE role = 'user')")
            + f"SELECT {cols} FROM p")


def _documents_select(cols: str) -> str:
    return (f"WITH d AS (SELECT doc_id, text, lower(text) AS lt, {words_sql('text')} AS word_count FROM documents)\n"
            f"SELECT {cols} FROM d")


def oracle_sql() -> dict[str, str]:
    topic, purpose = default_topic_rules(), purpose_rules()
    msg_flags = MSG_COLS + ", is_user, is_assistant"
    return {
        "messages_flat": with_(messages_cte(), f"f AS ({flags('messages')})") + f"SELECT {msg_flags} FROM f",
        "ingest_mapping_roundtrip": with_(messages_cte()) + f"SELECT {MSG_COLS} FROM messages",
        "ingest_list_roundtrip": with_(messages_cte()) + f"SELECT {MSG_COLS} FROM messages",
        "month_messages": with_(messages_cte()) + f"SELECT {MSG_COLS} FROM messages WHERE month = '{MONTH}'",
        "conversation_stats": with_(messages_cte(), month_cte(), CONV_STATS)
        + "SELECT account, department, conversation_id, conversation_title, "
          + ts("first_time") + ", " + ts("last_time")
          + ", CAST(user_prompts AS BIGINT) AS user_prompts, CAST(assistant_msgs AS BIGINT) AS assistant_msgs, "
            "CAST(total_msgs AS BIGINT) AS total_msgs, CAST(active_days AS BIGINT) AS active_days FROM conv_stats",
        "overview": with_(messages_cte(), month_cte())
        + "SELECT count(DISTINCT conversation_id) AS total_conversations, "
          "count(*) FILTER (WHERE role = 'user') AS total_prompts, count(*) AS total_messages, "
          "count(DISTINCT department) AS departments FROM month_df",
        "by_department": with_(messages_cte(), month_cte(), CONV_STATS) + _by_dept_select(),
        "by_department_topic": with_(messages_cte(), month_cte(), prompts_cte())
        + "SELECT department, topic, count(*) AS prompts FROM prompts GROUP BY department, topic",
        "prompt_topic": _all_prompts_select(f"message_id, department, {tag_sql('lt', topic)} AS topic"),
        "prompt_purpose": _all_prompts_select(f"message_id, department, {purpose_sql('text', 'lt')} AS purpose"),
        "prompt_quality": _all_prompts_select(
            f"message_id, word_count, {quality_sql('text', 'lt', 'word_count')} AS prompt_quality"),
        "document_topic": _documents_select(f"doc_id, {tag_sql('lt', topic)} AS topic"),
        "document_purpose": _documents_select(f"doc_id, {purpose_sql('text', 'lt')} AS purpose"),
        "word_count_documents": _documents_select("doc_id, word_count"),
        "document_quality": _documents_select(
            f"doc_id, {quality_sql('text', 'lt', 'word_count')} AS prompt_quality"),
        "purpose_distribution": _dist_query("purpose"),
        "topic_distribution": _dist_query("topic"),
        "department_metrics": with_(messages_cte(), all_month_cte(), CONV_STATS, prompts_cte(), METRICS)
        + "SELECT month, department, conversations, round(avg_prompts_per_conversation, 6) AS "
          "avg_prompts_per_conversation, active_days, prompts, round(avg_words_per_prompt, 6) AS avg_words_per_prompt, "
          "unique_topics, purpose_distribution, topic_distribution FROM metrics",
        "kpi_per_head": _all_report_base(STAFF)
        + "SELECT month, department, rating, raw_score, staff, kpi_score FROM kpi",
        "department_override": with_(messages_cte(), month_cte(DEPARTMENT_MAP), CONV_STATS) + _by_dept_select(),
        "department_report": _month_report_base() + REPORT_SELECT,
        "report_all_months": _all_report_base() + REPORT_SELECT,
        "kpi_table": _month_report_base(STAFF) + "SELECT department, rating, kpi_score FROM kpi",
        "department_list": with_(messages_cte(), all_month_cte())
        + "SELECT DISTINCT month, department FROM month_df WHERE department IS NOT NULL",
        "conversation_list": with_(messages_cte(), month_cte(), CONV_STATS)
        + "SELECT department, conversation_id, conversation_title, " + ts("first_time") + ", " + ts("last_time")
        + ", CAST(user_prompts AS BIGINT) AS user_prompts, CAST(assistant_msgs AS BIGINT) AS assistant_msgs, "
          "CAST(total_msgs AS BIGINT) AS total_msgs, CAST(active_days AS BIGINT) AS active_days FROM conv_stats",
        "prompt_list": with_(messages_cte(), month_cte(), prompts_cte())
        + "SELECT department, " + ts("create_time_local", "create_time")
        + ", conversation_title, text, topic, purpose, prompt_quality, word_count, "
          "CAST(NULL AS BIGINT) AS cluster, message_id FROM prompts",
        "assistant_replies": with_(messages_cte(), month_cte())
        + "SELECT department, " + ts("create_time_local", "create_time")
        + ", conversation_title, text, message_id FROM month_df WHERE role = 'assistant'",
        "department_raw": with_(messages_cte(), month_cte()) + f"SELECT {msg_flags} FROM month_df",
        "transcript": with_(messages_cte(), month_cte())
        + "SELECT department, conversation_id, "
          "coalesce(CAST(conversation_id AS VARCHAR), 'None') || ' – ' || conversation_title AS conversation_label, "
          f"message_id, CASE WHEN role = 'user' THEN {q(SPEAKER_USER)} ELSE {q(SPEAKER_OTHER)} END AS speaker, "
          "coalesce(strftime(create_time_local, '%Y-%m-%d %H:%M'), '') AS time_text, text FROM month_df",
        "custom_rules": with_(messages_cte(), month_cte(), prompts_cte(RuleSet.from_json(CUSTOM_RULES_JSON)))
        + "SELECT department, topic, count(*) AS prompts FROM prompts GROUP BY department, topic",
        **more_oracles(),
        **file_oracles(),
    }


TERMS = (r"tok AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS uni FROM month_df WHERE role = 'user'), "
         "t AS (SELECT message_id, unnest(list_concat(uni, list_transform(range(1, len(uni)), lambda i: uni[i] || ' ' || uni[i + 1]))) AS term FROM tok), "
         "v0 AS (SELECT term, count(*) AS total, count(DISTINCT message_id) AS df FROM t GROUP BY term ORDER BY total DESC, term LIMIT 5000), "
         "v AS (SELECT term, total, df, ln((1.0 + (SELECT count(*) FROM tok)) / (1.0 + df)) + 1.0 AS idf FROM v0)")

SHAPED = f"""c AS (SELECT (conv_id + turn) % 10 AS s, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS m, 'c' || CAST(conv_id AS VARCHAR) AS c,
    role, text, CAST(1704067200 + conv_id % 90 * 86400 + turn * 60 AS DOUBLE) AS sec FROM conversations),
raw AS (SELECT 'f' || m AS account, c AS conversation_id, 'T' AS conversation_title, m AS message_id, role,
    CASE WHEN s IN (0, 2, 3) THEN 'n' END AS author, text, CASE WHEN s <> 4 THEN sec END AS epoch_seconds, 'f' || m AS department, s FROM c),
shaped AS (SELECT *, timezone('UTC', to_timestamp(epoch_seconds)) AS create_time_utc,
    timezone('{LOCAL_TIME_ZONE}', to_timestamp(epoch_seconds)) AS create_time_local,
    CAST(timezone('{LOCAL_TIME_ZONE}', to_timestamp(epoch_seconds)) AS DATE) AS date,
    strftime(timezone('{LOCAL_TIME_ZONE}', to_timestamp(epoch_seconds)), '%Y-%m') AS month
  FROM raw WHERE s NOT IN (6, 7) AND (s > 0 OR text <> '') AND (s <> 3 OR text <> ''))"""


def _view(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position"


def more_oracles() -> dict[str, str]:
    topic, custom = default_topic_rules(), RuleSet.from_json(CUSTOM_RULES_JSON)
    return {
        "custom_rules_distribution": _month_report_base(None, custom)
        + "SELECT department, prompts, unique_topics, topic_distribution, purpose_distribution FROM metrics",
        "prompt_cluster_invariants": with_(messages_cte(), month_cte(), prompts_cte())
        + "SELECT count(*) AS prompts, count(DISTINCT text) AS texts, true AS smallest_in_range, true AS largest_in_range, "
          "CAST(0 AS BIGINT) AS texts_of_two_labels FROM prompts",
        "prompt_terms": with_(messages_cte(), month_cte(), TERMS)
        + "SELECT term, CAST(total AS BIGINT) AS total, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM v",
        "prompt_tfidf": with_(messages_cte(), month_cte(), TERMS)
        + "SELECT message_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY message_id)), 6) AS weight FROM "
          "(SELECT message_id, term, count(*) * any_value(idf) AS w FROM t JOIN v USING (term) GROUP BY message_id, term)",
        "conversation_topic": f"WITH p AS (SELECT *, lower(text) AS lt, {words_sql('text')} AS word_count FROM conversations WHERE role = 'user')\n"
        f"SELECT conv_id, turn, {tag_sql('lt', topic)} AS topic, {purpose_sql('text', 'lt')} AS purpose, "
        f"{quality_sql('text', 'lt', 'word_count')} AS prompt_quality, word_count FROM p",
        "document_topic_by_table": _documents_select(f"doc_id, {tag_sql('lt', topic)} AS topic"),
        "document_item_rules": "WITH kw AS (SELECT lower(w) AS kw, min(item_id) AS item FROM (SELECT item_id, unnest(string_split(text, ' ')) "
        f"AS w FROM benchmark) WHERE length(w) >= {RULE_WORD} GROUP BY 1), t AS (SELECT DISTINCT text, lower(text) AS lt FROM documents),\n"
        "hit AS (SELECT text, min(item) AS item FROM t JOIN kw ON contains(lt, kw) GROUP BY text)\n"
        f"SELECT doc_id, coalesce('item ' || item, {q(topic.fallback)}) AS first_item FROM documents LEFT JOIN hit USING (text)",
        "custom_rules_by_table": with_(messages_cte(), month_cte(), prompts_cte(custom))
        + "SELECT department, topic, count(*) AS prompts FROM prompts GROUP BY department, topic",
        "kpi_bands": "WITH m AS (SELECT o_orderkey, o_orderkey * 7 % 260 AS prompts, o_orderkey * 3 % 32 AS active_days, "
        "o_orderkey * 5 % 21 AS unique_topics, CAST(o_orderkey * 11 % 130 AS DOUBLE) / 10.0 AS avg_prompts_per_conversation, "
        "CAST(o_orderkey * 13 % 500 AS DOUBLE) / 10.0 AS avg_words_per_prompt FROM orders)\n"
        f"SELECT o_orderkey, {kpi_sql()[0]} AS rating, {kpi_sql()[1]} AS raw_score FROM m",
        "ingest_shapes": "WITH " + SHAPED + f" SELECT {MSG_COLS} FROM shaped WHERE s < 6",
        "ingest_record_mode": "WITH " + SHAPED + f" SELECT {MSG_COLS} FROM shaped WHERE s <> 9",
        "ingest_rejected": "WITH " + SHAPED + " SELECT 'f' || m AS file, CASE WHEN s IN (7, 9) THEN 'not a JSON object or list of objects' "
        "ELSE 'conversation, message or author is not an object' END AS reason FROM c WHERE s >= 6",
        "department_conversations": with_(messages_cte(), month_cte(), CONV_STATS)
        + "SELECT department, conversation_id, conversation_title, " + ts("first_time") + ", " + ts("last_time")
        + ", CAST(user_prompts AS BIGINT) AS user_prompts, CAST(assistant_msgs AS BIGINT) AS assistant_msgs, "
          "CAST(total_msgs AS BIGINT) AS total_msgs, CAST(active_days AS BIGINT) AS active_days, "
        + _view("conv_stats.first_time NULLS LAST, conversation_id") + f" FROM conv_stats WHERE department = {q(VIEW_DEPARTMENT)}",
        "department_prompts": with_(messages_cte(), month_cte(), prompts_cte())
        + "SELECT department, " + ts("create_time_local", "create_time")
        + ", conversation_title, text, topic, purpose, prompt_quality, word_count, CAST(NULL AS BIGINT) AS cluster, message_id, "
        + _view("create_time_local NULLS LAST, message_id") + f" FROM prompts WHERE department = {q(VIEW_DEPARTMENT)}",
        "conversation_transcript": with_(messages_cte(), all_month_cte())
        + "SELECT department, conversation_id, conversation_id || ' – ' || conversation_title AS conversation_label, "
          f"message_id, CASE WHEN role = 'user' THEN {q(SPEAKER_USER)} ELSE {q(SPEAKER_OTHER)} END AS speaker, "
          "strftime(create_time_local, '%Y-%m-%d %H:%M') AS time_text, text, " + _view("strftime(create_time_local, '%Y-%m-%d %H:%M'), message_id")
        + f" FROM month_df WHERE department = {q(VIEW_DEPARTMENT)} AND conversation_id = {q(VIEW_CONVERSATION)}",
    }


def file_oracles() -> dict[str, str]:
    number = "CAST(replace(account, 'dept_', '') AS INT)"
    name = "CASE " + number + " " + " ".join(f"WHEN {k} THEN {q(n)}" for k, n in enumerate(ACCOUNT_NAMES)) + " END"
    named = (f"named AS (SELECT {name} AS account, conversation_id, conversation_title, message_id, role, author, text, "
             f"create_time_utc, create_time_local, date, month, {name} AS department FROM messages)")
    rows = [(f"dept_{k}", None if m in ("", "N/A") else m) for k, m in enumerate(MAPPED)]
    return {
        "export_files": with_(messages_cte(), named) + f"SELECT {MSG_COLS} FROM named",
        "department_map_csv": with_(messages_cte(), month_cte(rows), CONV_STATS) + "SELECT *, true AS map_used FROM (" + _by_dept_select() + ")",
        "department_map_wrong_header": with_(messages_cte(), month_cte(), CONV_STATS) + "SELECT *, false AS map_used FROM (" + _by_dept_select() + ")",
        "report_roundtrip": "SELECT *, ordinal AS position FROM (" + _all_report_base() + REPORT_SELECT + ")",
    }


def _by_dept_select() -> str:
    return ("SELECT department, count(DISTINCT conversation_id) AS conversations, "
            "CAST(sum(user_prompts) AS BIGINT) AS user_prompts, CAST(sum(assistant_msgs) AS BIGINT) AS assistant_msgs, "
            "CAST(sum(total_msgs) AS BIGINT) AS total_msgs FROM conv_stats GROUP BY department")
