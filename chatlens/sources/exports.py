"""Chat-export ingest: nested JSON exports -> flat message table (SRC-1..SRC-11, SET-1).

Design (scale): files are cut into conversations by byte ranges (``ranges``), so neither
a large file nor many small ones bound the tasks. Parsing uses a declared
``array<struct<...variant...>>`` schema — never inference — so polymorphic
fields (``content`` string-or-object, ids of any JSON kind, node maps with
arbitrary keys) stay intact and the variant size limit applies per field, not
per file. Whether a file must be rejected is decided on the parsed file row
with higher-order functions (no shuffle, no group by file); the accepted files
are then exploded twice (conversations, then messages or map nodes) in one
narrow pass. Land the result once as Parquet partitioned by month
(``land_messages``) and let later jobs prune partitions instead of re-parsing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import with_times
from ..functions.rules import sql_string
from ..functions.timefn import FLOAT_TEXT
from ..session import written
from .ranges import CONVERSATION, FRAME, cut_exports, joined_parts

_CONV_FIELDS = ("id:variant,conversation_id:variant,title:variant,conversation_title:variant,"
                "mapping:map<string,variant>,messages:array<variant>")
EXPORT_SCHEMA = f"array<struct<{_CONV_FIELDS},conversations:array<struct<{_CONV_FIELDS}>>>>"
#: No string of a document is too long for the parser (its own bound is 20 million characters).
_JSON_OPTIONS = {"maxStringLen": "2147483647"}
#: Documents up to this length hold no value above VARIANT's limit of 128 MiB.
VARIANT_LIMIT = 120 << 20
NO_OBJECT = "conversation, message or author is not an object"
#: Message columns before the times are normalised.
MESSAGE_FIELDS = ["account", "conversation_id", "conversation_title", "role", "author", "text", "epoch_seconds", "message_id", "department"]
_CONV_NAMES = ["id", "conversation_id", "title", "conversation_title", "mapping", "messages"]


# --------------------------------------------------------------------------
# SQL snippets over VARIANT values (SQL text so they work inside lambdas).
# Every helper takes a value and its kind (``schema_of_variant``) as *bound*
# names — lambda fields computed once per item — so no variant lookup is
# repeated inside the CASE branches.
# --------------------------------------------------------------------------
def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}')"


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _obj(k: str) -> str:
    return f"coalesce(startswith({k}, 'OBJECT'), false)"


def _truthy(v: str, k: str) -> str:
    """Python truthiness of a JSON value (null, '', 0, false, [] and {} are falsy)."""
    return (f"(CASE WHEN {v} IS NULL OR {k} = 'VOID' THEN false "
            f"WHEN {k} = 'STRING' THEN try_variant_get({v}, '$', 'string') <> '' "
            f"WHEN {k} = 'BOOLEAN' THEN coalesce(try_variant_get({v}, '$', 'boolean'), false) "
            f"WHEN startswith({k}, 'OBJECT') THEN {k} <> 'OBJECT<>' "
            f"WHEN startswith({k}, 'ARRAY') THEN {k} <> 'ARRAY<VOID>' "
            f"OR size(try_variant_get({v}, '$', 'array<variant>')) > 0 "
            f"ELSE coalesce(try_variant_get({v}, '$', 'double') <> 0, false) END)")


def _text(v: str, k: str) -> str:
    """String form of a JSON value: strings as is, booleans as True/False, others as JSON text."""
    return (f"(CASE WHEN {v} IS NULL OR {k} = 'VOID' THEN CAST(NULL AS STRING) "
            f"WHEN {k} = 'STRING' THEN try_variant_get({v}, '$', 'string') "
            f"WHEN {k} = 'BOOLEAN' THEN CASE WHEN try_variant_get({v}, '$', 'boolean') THEN 'True' ELSE 'False' END "
            f"ELSE CAST({v} AS STRING) END)")


def _seconds(v: str, k: str) -> str:
    """Epoch value -> double seconds as Python float() would read it; else NULL."""
    s = f"try_variant_get({v}, '$', 'string')"
    trimmed = f"regexp_replace({s}, {sql_string(r'(?U)^\s+|\s+$')}, '')"
    as_text = (f"CASE WHEN {s} rlike {sql_string(FLOAT_TEXT)} "
               f"THEN try_cast(replace({trimmed}, '_', '') AS DOUBLE) END")
    return (f"(CASE WHEN {v} IS NULL OR {k} = 'VOID' THEN CAST(NULL AS DOUBLE) "
            f"WHEN {k} = 'STRING' THEN {as_text} "
            f"WHEN {k} = 'BOOLEAN' THEN CASE WHEN try_variant_get({v}, '$', 'boolean') THEN 1.0D ELSE 0.0D END "
            f"WHEN startswith({k}, 'OBJECT') OR startswith({k}, 'ARRAY') THEN CAST(NULL AS DOUBLE) "
            f"ELSE try_variant_get({v}, '$', 'double') END)")


def _bad_nodes(mapping: str) -> str:
    """Any map node that is not an object, or whose truthy message / author is not an object."""
    nodes = f"transform(map_values({mapping}), n -> named_struct('kn', {_kind('n')}, 'm', {_get('n', '$.message')}))"
    nodes = (f"transform({nodes}, x -> named_struct('kn', x.kn, 'm', x.m, 'km', {_kind('x.m')}, "
             f"'a', {_get('x.m', '$.author')}))")
    nodes = f"transform({nodes}, y -> named_struct('y', y, 'ka', {_kind('y.a')}))"
    return (f"exists({nodes}, z -> NOT {_obj('z.y.kn')} "
            f"OR ({_truthy('z.y.m', 'z.y.km')} AND NOT {_obj('z.y.km')}) "
            f"OR ({_obj('z.y.km')} AND {_truthy('z.y.a', 'z.ka')} AND NOT {_obj('z.ka')}))")


def _bad_items(messages: str) -> str:
    """Any list item that is not an object, or whose truthy author is not an object."""
    items = f"transform({messages}, m -> named_struct('km', {_kind('m')}, 'a', {_get('m', '$.author')}))"
    items = f"transform({items}, x -> named_struct('x', x, 'ka', {_kind('x.a')}))"
    return (f"exists({items}, z -> NOT {_obj('z.x.km')} "
            f"OR ({_truthy('z.x.a', 'z.ka')} AND NOT {_obj('z.ka')}))")


def _conv_bad(c: str) -> str:
    return (f"(CASE WHEN {c}.mapping IS NOT NULL THEN {_bad_nodes(c + '.mapping')} "
            f"WHEN {c}.messages IS NOT NULL THEN {_bad_items(c + '.messages')} ELSE false END)")


def _message_rows(c: str) -> str:
    """One struct per accepted message of conversation ``c`` (map nodes or list items), fields final."""
    items = (f"CASE WHEN {c}.mapping IS NOT NULL THEN "
             f"transform(map_entries({c}.mapping), e -> named_struct('node_id', e.key, 'from_map', true, "
             f"'msg', {_get('e.value', '$.message')})) "
             f"ELSE transform({c}.messages, m -> named_struct('node_id', CAST(NULL AS STRING), 'from_map', false, "
             f"'msg', m)) END")
    # stage 1: every variant the fields need, looked up once
    a = (f"transform({items}, e -> named_struct('e', e, "
         f"'ra', {_get('e.msg', '$.author.role')}, 'na', {_get('e.msg', '$.author.name')}, "
         f"'rt', {_get('e.msg', '$.role')}, 'id', {_get('e.msg', '$.id')}, 'c', {_get('e.msg', '$.content')}, "
         f"'ct', {_get('e.msg', '$.create_time')}, 'ts', {_get('e.msg', '$.timestamp')}))")
    # stage 2: their kinds, once
    b = (f"transform({a}, a -> named_struct('a', a, 'km', {_kind('a.e.msg')}, 'kra', {_kind('a.ra')}, "
         f"'kna', {_kind('a.na')}, 'krt', {_kind('a.rt')}, 'kid', {_kind('a.id')}, 'kc', {_kind('a.c')}, "
         f"'kct', {_kind('a.ct')}, 'kts', {_kind('a.ts')}, "
         f"'parts', try_variant_get(a.c, '$.parts', 'array<variant>'), "
         f"'kctext', {_kind(_get('a.c', '$.text'))}, 'ctext', try_variant_get(a.c, '$.text', 'string')))")
    parts = ("transform(transform(filter(b.parts, p -> p IS NOT NULL AND NOT is_variant_null(p)), "
             f"p -> named_struct('p', p, 'k', {_kind('p')})), q -> {_text('q.p', 'q.k')})")
    msg_truthy = _truthy("b.a.e.msg", "b.km")
    ra_truthy = _truthy("b.a.ra", "b.kra")
    text = (f"CASE WHEN NOT {msg_truthy} THEN '' "
            f"WHEN {_obj('b.kc')} AND b.parts IS NOT NULL THEN array_join({parts}, '\\n') "
            f"WHEN {_obj('b.kc')} AND b.kctext = 'STRING' THEN b.ctext "
            f"WHEN b.kc = 'STRING' THEN try_variant_get(b.a.c, '$', 'string') ELSE '' END")
    # list items: `author.role or role`, `create_time or timestamp` (the second value as it is, even falsy)
    role = (f"CASE WHEN b.a.e.from_map OR {ra_truthy} THEN {_text('b.a.ra', 'b.kra')} "
            f"ELSE {_text('b.a.rt', 'b.krt')} END")
    seconds = (f"CASE WHEN b.a.e.from_map OR {_truthy('b.a.ct', 'b.kct')} THEN {_seconds('b.a.ct', 'b.kct')} "
               f"ELSE {_seconds('b.a.ts', 'b.kts')} END")
    mid = (f"CASE WHEN NOT b.a.e.from_map THEN {_text('b.a.id', 'b.kid')} "
           f"WHEN {_truthy('b.a.id', 'b.kid')} THEN {_text('b.a.id', 'b.kid')} ELSE b.a.e.node_id END")
    fields = (f"transform({b}, b -> named_struct('from_map', b.a.e.from_map, 'msg_truthy', {msg_truthy}, "
              f"'role_truthy', {ra_truthy}, 'role', {role}, 'author', {_text('b.a.na', 'b.kna')}, "
              f"'text', {text}, 'seconds', {seconds}, 'message_id', {mid}))")
    # map nodes need a truthy message, a truthy role and non-empty text; list items are all kept
    return f"filter({fields}, x -> NOT x.from_map OR (x.msg_truthy AND x.role_truthy AND x.text <> ''))"


def account_from_file_name(file_name) -> F.Column:
    """File name without its last extension; percent-escapes decoded, '+' kept (SRC-2)."""
    decoded = F.url_decode(F.replace(file_name, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"\.[^.]*$", "")


# --------------------------------------------------------------------------
# Parse + flatten
# --------------------------------------------------------------------------
@dataclass
class ExportResult:
    messages: DataFrame
    rejected: DataFrame


def _normalise_roots(docs: DataFrame, json_col: str) -> DataFrame:
    """Parse each document and normalise its root to a list of conversations (SRC-3)."""
    raw = F.col(json_col)
    # Strip a UTF-8 byte-order mark; only files that have one are copied.
    text = F.when(raw.startswith("\ufeff"), F.substring(raw, 2, 2147483647)).otherwise(raw)
    parsed = F.from_json(text, EXPORT_SCHEMA, _JSON_OPTIONS)
    strip = ", ".join(f"'{n}', c.{n}" for n in _CONV_NAMES)
    as_convs = f"transform(_parsed, c -> CASE WHEN c IS NULL THEN NULL ELSE named_struct({strip}) END)"
    convs = F.expr(
        "CASE WHEN _parsed IS NULL THEN NULL "
        "WHEN _root_is_list THEN " + as_convs + " "
        "WHEN _parsed[0].conversations IS NOT NULL THEN _parsed[0].conversations "
        "ELSE " + as_convs + " END")
    bad_conv = F.expr(f"exists(_convs, c -> c IS NULL OR {_conv_bad('c')})")
    # the parser leaves out a field with a value that VARIANT cannot hold
    too_large = (F.octet_length(raw) > VARIANT_LIMIT) & F.expr("exists(_convs, c -> c.mapping IS NULL AND c.messages IS NULL)")
    out = (docs.withColumn("_parsed", parsed)
           .withColumn("_root_is_list", text.rlike(r"^[ \t\n\r]*\["))
           .withColumn("_convs", convs)
           .withColumn("_listed", F.expr("_root_is_list OR _parsed[0].conversations IS NOT NULL"))
           .withColumn("_reject_reason",
                       F.when(~F.is_valid_utf8(raw), F.lit("not valid UTF-8"))
                       .when(F.col("_parsed").isNull(), F.lit("not a JSON object or list of objects"))
                       .when(too_large, F.lit("a value above 128 MiB"))
                       .when(bad_conv, F.lit(NO_OBJECT)))
           .drop("_parsed", "_root_is_list"))
    return out


def _rows(roots: DataFrame, carry: list[str], account_col: str, on_error: str, outer: bool) -> DataFrame:
    """The message rows of ``_normalise_roots`` beside the columns ``carry``; outer: a row without a message
    (``has`` is false) for documents and conversations that have none."""
    explode = F.explode_outer if outer else F.explode
    # Dropping is done on arrays before the explode, never with a Filter on the parsed
    # columns: a Filter would be pushed below the projection with ``from_json`` (and the
    # variant extraction) inlined, evaluating them twice.
    if on_error == "file":
        kept = "CASE WHEN _reject_reason IS NULL THEN _convs END"
    else:
        kept = f"filter(_convs, c -> c IS NOT NULL AND NOT {_conv_bad('c')})"
    names = [F.col(c) for c in carry]
    conv = roots.select(*names, F.col(account_col).alias("account"), explode(F.expr(kept)).alias("c"))
    conv = conv.select("*", F.expr(_kind("c.id")).alias("_kid"), F.expr(_kind("c.conversation_id")).alias("_kcid"),
                       F.expr(_kind("c.title")).alias("_kt"), F.expr(_kind("c.conversation_title")).alias("_kct"))
    # `id or conversation_id` (the second as it is); `title or conversation_title or ""`
    conv_id = (f"CASE WHEN {_truthy('c.id', '_kid')} THEN {_text('c.id', '_kid')} "
               f"ELSE {_text('c.conversation_id', '_kcid')} END")
    title = (f"CASE WHEN {_truthy('c.title', '_kt')} THEN {_text('c.title', '_kt')} "
             f"WHEN {_truthy('c.conversation_title', '_kct')} THEN {_text('c.conversation_title', '_kct')} "
             f"ELSE '' END")
    rows = conv.select(
        *names, "account",
        F.expr(conv_id).alias("conversation_id"),
        F.expr(title).alias("conversation_title"),
        explode(F.expr(_message_rows("c"))).alias("x"),
    )
    return rows.select(*names, "account", "conversation_id", "conversation_title",
                       F.col("x.role").alias("role"), F.col("x.author").alias("author"),
                       F.col("x.text").alias("text"), F.col("x.seconds").alias("epoch_seconds"),
                       F.col("x.message_id").alias("message_id"),
                       F.col("account").alias("department"), *([F.col("x").isNotNull().alias("has")] if outer else []))


def _checked(on_error: str) -> None:
    if on_error not in ("file", "record"):
        raise ValueError("on_error must be 'file' or 'record'")


def flatten_exports(docs: DataFrame, json_col: str = "json", account_col: str = "account",
                    file_col: str | None = None, on_error: str = "file") -> ExportResult:
    """Flatten export documents (one JSON text per row) into the message table.

    ``on_error='file'`` drops every row of a document that has a malformed part
    (reference behaviour); ``'record'`` drops only the malformed conversations.
    Either way the affected documents are listed in ``rejected``.
    """
    _checked(on_error)
    roots = _normalise_roots(docs, json_col)
    rejected = roots.where(F.col("_reject_reason").isNotNull()).select(
        F.col(file_col or account_col).alias("file"), F.col("_reject_reason").alias("reason"))
    return ExportResult(with_times(_rows(roots, [], account_col, on_error, False)), rejected)


def read_exports(spark: SparkSession, paths, on_error: str = "file") -> ExportResult:
    """Read ``*.json`` export files (one account per file) into the message table (SRC-1, SRC-2).

    Files are cut into conversations by byte ranges (see ``ranges``) and parsed one by one, so a file
    of any size is many tasks and no row holds more than one conversation. Parsed rows
    are written once under ``spark.checkpoint.dir``; whether a file must be rejected is then
    known from all its parts. Results equal those of ``flatten_exports`` on whole files.
    """
    _checked(on_error)
    # Python's json keeps the last of duplicate keys; without this the whole map would be NULL.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    cut = cut_exports(spark, [paths] if isinstance(paths, str) else list(paths))

    def parsed(docs: DataFrame, name: str) -> DataFrame:
        """Written message rows of the documents; parts of documents (``doc`` is false) stay as they are."""
        text = F.when(F.col("kind") == CONVERSATION, F.concat(F.lit(b"["), "json", F.lit(b"]"))).otherwise(F.col("json"))
        docs = docs.withColumn("_doc", F.when(F.col("doc"), text.cast("string"))).withColumn("json", F.when(~F.col("doc"), F.col("json")))
        roots = _normalise_roots(docs.withColumn("account", account_from_file_name(F.col("file"))), "_doc").withColumn(
            "reason", F.when(F.col("doc"), F.col("_reject_reason")))
        return written(_rows(roots, ["path", "file", "start", "kind", "json", "reason", "_listed"], "account", on_error, True), name)

    rows = parsed(cut.withColumn("doc", (F.col("kind") == CONVERSATION) | (F.col("kind") == FRAME) & F.col("whole")), "exports")
    parts = rows.where("json is not null").select("path", "file", "start", "kind", "json")
    rows = rows.where("json is null")
    if not parts.isEmpty():
        whole = joined_parts(parts).select("*", F.lit(None).cast("long").alias("start"), F.lit(True).alias("doc"))
        rows = rows.unionByName(parsed(whole, "exports"))
    # A root object whose list cannot be read is itself the conversation: what was cut from its list does not count.
    unlisted = (F.col("kind") == FRAME) & ~F.col("_listed")
    soft = F.col("reason") == NO_OBJECT
    marks = rows.where(F.col("reason").isNotNull() | unlisted).groupBy("path", "file").agg(
        F.min(F.when(~soft, F.col("reason"))).alias("hard"), F.coalesce(F.max(unlisted), F.lit(False)).alias("unlisted"),
        F.coalesce(F.max(soft & (F.col("kind") == FRAME)), F.lit(False)).alias("frame"), F.coalesce(F.max(soft & (F.col("kind") == CONVERSATION)), F.lit(False)).alias("element"))
    reason = F.coalesce("hard", F.when(F.col("frame") | F.col("element") & ~F.col("unlisted"), F.lit(NO_OBJECT)))
    marks = written(marks.select("path", "file", "hard", "unlisted", reason.alias("reason")), "marks")
    messages = rows.where("has")
    if not marks.isEmpty():
        drop = F.col("_gone") | F.col("unlisted") & (F.col("kind") == CONVERSATION)
        gone = marks.select(F.col("path"), "unlisted", F.col("reason" if on_error == "file" else "hard").isNotNull().alias("_gone"))
        messages = messages.join(gone, "path", "left").where(~F.coalesce(drop, F.lit(False)))
    return ExportResult(with_times(messages.select(*MESSAGE_FIELDS)), marks.where("reason is not null").select("file", "reason"))


def by_month(messages: DataFrame) -> DataFrame:
    """Rows of a month together, in as many partitions as its bytes ask for: adaptive execution
    splits large months (a hot account or conversation included) and merges small ones."""
    return messages.hint("rebalance", F.col("month"))


def land_messages(messages: DataFrame, path: str, mode: str = "overwrite"):
    """Write the message table once as Parquet partitioned by ``month`` (the landing table).

    Overwriting replaces the months of ``messages`` and leaves all others alone.
    """
    by_month(messages).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_landed(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Read the landing table (it may be empty); a month list becomes a partition filter (pruned at the scan)."""
    from ..schema import MESSAGE_COLUMNS, MESSAGES_DDL
    df = spark.read.schema(MESSAGES_DDL).parquet(path)
    if months:
        df = df.where(F.col("month").isin(months))
    return df.select(*MESSAGE_COLUMNS)
