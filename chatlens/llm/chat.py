"""Chat formatting in budgeted windows, as DataFrame operations only.

A conversation becomes training windows of at most ``budget`` tokens. The prefix sum of the turns'
tokens says where each turn begins and ends. What the budget leaves after the system turn and
the history is the stride: the turns that lie inside one stride are a span, and a turn that
crosses a stride's end is a span of its own. So spans are aligned with turns, hold at most a stride
(or one turn), and follow from the sums alone, not from the window before.
Each window holds the conversation's system turn, up to ``history_turns`` turns and
``history`` tokens from before its span, and the span. The loss mask covers the
assistant turns of the span; repeated ones are masked out, so each is a target once.

Conversations of more than ``block_turns`` turns are dealt by (conv_id, block of strides). Their turns
are ranked and summed by ranges first, so the sums run on over every border and a span never
crosses one; the system turn and the history are handed over the border as additional
rows. Windows do not depend on how rows were dealt.

Template: ``<s>``, then per turn ``[ROLE]role[/ROLE]text</s>``. Control strings inside roles and texts
are escaped reversibly as character references, and so is an ampersand that would read as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import counted, table, written

BUDGET, HISTORY, HISTORY_TURNS, BLOCK_TURNS, BLOCK_STRIDES, TURN_COST = 1024, 256, 2, 256, 32, 6
#: Control strings of the template and of common chat templates; each begins with < or [
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_NAMES = {"<": "&lt;", "[": "&lb;"}


def escaped(c: Column) -> Column:
    c = F.regexp_replace(c, "&(amp;|lt;|lb;)", "&amp;$1")
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(_NAMES[s[0]] + s[1:]))
    return c


def unescaped(c: Column) -> Column:
    for char, name in _NAMES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def turn_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its UTF-8 bytes, rounded up, and the markers."""
    return (F.ceil(F.octet_length(text) / 4) + TURN_COST).cast("long")


def _sums(items: Column, first: Column, value) -> Column:
    """[first, first + value of item 0, ...]: one element more than ``items``."""
    return F.aggregate(items, F.array(first), lambda acc, x: F.array_append(
        acc, F.element_at(acc, -1) + value(x)))


def _placed(t: DataFrame) -> DataFrame:
    """``t`` plus ``rank``, the place from 0 in the conversation by (turn, role, text), ``tok`` and ``before``, the tokens
    of the turns before it. Rows are dealt by ranges, so that a long conversation is not one task;
    counts and tokens of the ranges before are added to those in the own range."""
    # prefixes in the same order: the bounds of the ranges go through the driver
    by = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 33), F.when(F.length("role") <= 32, F.substring("text", 1, 32)).otherwise("")]
    dealt = written(t.repartitionByRange(*by).sortWithinPartitions("conv_id", "turn", "role", "text").withColumn(
        "place", F.monotonically_increasing_id()).withColumn("tok", turn_tokens(F.col("text"))), "turns").withColumn("range", F.shiftright("place", 33))
    per = dealt.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum("tok").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = written(per.select(F.col("conv_id").alias("_r"), F.col("range").alias("_range"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                             F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("sum")), "ranges")
    inside = F.sum("tok").over(Window.partitionBy("conv_id", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = dealt.withColumn("inside", inside - F.col("tok"))
    return own.join(counted(per), F.col("conv_id").eqNullSafe(F.col("_r")) & (F.col("range") == F.col("_range"))).select(
        *t.columns, "tok", (F.col("place") + F.col("shift")).alias("rank"), (F.col("sum") + F.col("inside")).alias("before"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS,
            block_turns: int = BLOCK_TURNS, block_strides: int = BLOCK_STRIDES) -> DataFrame:
    """(conv_id, block, span, formatted, n_turns, n_repeated, tokens, over_budget, loss).

    One row per window; (block, span) orders the windows of a conversation. n_repeated: how
    many of its n_turns turns, which come first, are repeats (system turn, history). loss:
    the mask, an array of (begin, end) code points of ``formatted``. over_budget: one turn
    alone is too long for the budget; it is kept whole.

    turns: (conv_id, turn, role, text), a row per turn. Null text and null role are empty; a
    null turn comes first; rows of one (conv_id, turn) are ordered by role, then text, and each is
    a turn. Turn numbers only order the rows and may have gaps. The system turn is the
    conversation's first row, if its role is system. Null conv_ids are one conversation.
    Other columns are not used. An empty table gives no rows. ``block_turns`` and
    ``block_strides`` only say how rows are dealt; the windows are the same for all of them.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = written(t.groupBy("conv_id").count().where(F.col("count") > block_turns).select(F.col("conv_id").alias("_l")), "long")
    if long.isEmpty():
        return _of_blocks(t.withColumn("block", F.lit(0).cast("long")).withColumn("kind", F.lit(2)).withColumn("at", F.lit(0).cast("long")),
                          budget, history, history_turns)
    several = F.col("conv_id").eqNullSafe(F.col("_l"))
    short = t.join(counted(long), several, "left_anti").select("*", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at"))
    t = written(_placed(t.join(counted(long), several, "left_semi")), "placed")
    head = written(t.where("rank = 0").select(F.col("conv_id").alias("_h"), F.when(F.col("role") == "system", F.col("text")).alias("system")), "heads")
    sys_tok = F.when(F.col("system").isNotNull(), turn_tokens(F.col("system"))).otherwise(F.lit(0))
    sums = head.select("_h", sys_tok.alias("sys_tok"), F.col("system").isNotNull().alias("has"))
    t = t.join(counted(sums), F.col("conv_id").eqNullSafe(F.col("_h")))
    at = F.greatest(F.col("before") - F.col("sys_tok"), F.lit(0))
    t = t.select("conv_id", "turn", "role", "text", "rank", "has", at.alias("at"),
                 F.floor(at / _stride(budget, history, F.col("sys_tok")) / block_strides).alias("block"))
    # Blocks of whole strides: a span, which begins in one stride, lies in one block.
    blocks = written(t.groupBy("conv_id", "block").agg(F.min("rank").alias("low")), "blocks")
    later = blocks.where("low > 0")
    # Every block but the first is handed the system turn, or a row of null text that says that there is none,
    handed = later.join(head, F.col("conv_id").eqNullSafe(F.col("_h"))).select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("system").alias("text"),
        "block", F.lit(0).cast("long").alias("at"), F.lit(0).alias("kind"))
    # and the turns right before it.
    wanted = later.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.explode(F.sequence(F.col("low") - history_turns, F.col("low") - 1)).alias("_k")) \
        if history_turns else later.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("low").alias("_k")).where("false")
    border = t.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("rank") == F.col("_k"))).where("rank > 0 or not has").select(
        "conv_id", "turn", "role", "text", F.col("_b").alias("block"), "at", F.lit(1).alias("kind"))
    rows = short.unionByName(t.drop("rank", "has")).withColumn("kind", F.lit(2)).unionByName(handed).unionByName(border)
    return _of_blocks(rows, budget, history, history_turns)


def _stride(budget: int, history: int, sys_tok: Column) -> Column:
    return F.greatest(F.lit(budget - history) - sys_tok, F.lit(TURN_COST)).cast("long")


def _of_blocks(rows: DataFrame, budget: int, history: int, history_turns: int) -> DataFrame:
    """Windows of (conv_id, block, turn, role, text, kind, at): kind 0 a system turn handed over, 1 history, 2 a turn;
    at: tokens of the conversation before the turn, without the system turn (the smallest of a block counts)."""
    one = F.struct("kind", "turn", "role", "text", turn_tokens(F.col("text")).alias("tok"))
    a = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(one)).alias("a"), F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("base")).where(
        F.exists("a", lambda x: x["kind"] == 2))
    first = F.get("a", 0)
    a = a.withColumn("later", first["kind"] == 0).withColumn("sys", F.when(
        (first["kind"] == 0) & first["text"].isNotNull() | (first["kind"] == 2) & (first["role"] == "system"), first))
    a = a.withColumn("b", F.when(F.col("later") | F.col("sys").isNotNull(), F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))).otherwise(F.col("a")))
    sys_tok = F.coalesce(F.col("sys.tok"), F.lit(0))
    a = a.withColumn("stride", _stride(budget, history, sys_tok)).withColumn(
        "room", F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - sys_tok)))
    a = a.select("conv_id", "block", "later", "sys", "b", "stride", "room",
                 _sums(F.col("b"), F.col("base"), lambda x: F.when(x["kind"] == 2, x["tok"]).otherwise(0)).alias("at"))
    place = lambda v: F.floor(v / F.col("stride"))
    # even: turns inside a stride; odd: the turn that crosses its end
    ids = F.transform("b", lambda x, i: F.when(x["kind"] == 2, 2 * place(F.get("at", i)) + F.when(
        place(F.get("at", i)) == place(F.get("at", i + 1) - 1), 0).otherwise(1)).otherwise(-1).cast("long"))
    a = a.withColumn("ids", ids)
    only_system = F.array(F.lit(0).cast("long"))
    spans = F.when((F.size("b") == 0) & F.col("sys").isNotNull(), only_system).otherwise(F.array_distinct(F.filter("ids", lambda s: s >= 0)))
    w = a.select("conv_id", "block", "later", "sys", "b", "room", "ids", F.posexplode(spans).alias("nth", "span"))
    w = w.withColumn("from", F.greatest(F.array_position("ids", F.col("span")).cast("int"), F.lit(1))).withColumn(
        "n", F.size(F.filter("ids", lambda s: s == F.col("span"))))
    tok_sum = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["tok"])
    back = F.aggregate(F.sequence(F.lit(1), F.lit(history_turns)), F.lit(0), lambda best, h: F.when(
        (h < F.col("from")) & (tok_sum(F.slice("b", F.greatest(F.col("from") - h, F.lit(1)), h)) <= F.col("room")), h).otherwise(best))
    w = w.withColumn("back", back if history_turns > 0 else F.lit(0))
    sys_part = F.when(F.col("sys").isNotNull(), F.array("sys")).otherwise(F.slice("b", 1, 0))
    w = w.withColumn("all", F.concat(sys_part, F.slice("b", F.col("from") - F.col("back"), F.col("back") + F.col("n"))))
    again = F.col("back") + F.when(F.col("sys").isNotNull() & (F.col("later") | (F.col("nth") > 0)), 1).otherwise(0)
    w = w.select("conv_id", "block", "span", again.alias("n_repeated"), F.col("all"), F.transform("all", lambda x: F.struct(
        F.concat(F.lit("[ROLE]"), escaped(x["role"]), F.lit("[/ROLE]")).alias("head"), escaped(x["text"]).alias("body"), x["role"].alias("role"))).alias("parts"))
    w = w.withColumn("starts", _sums(F.col("parts"), F.lit(3).cast("long"), lambda p: F.length(p["head"]) + F.length(p["body"]) + 4))
    loss = F.filter(F.transform("parts", lambda p, i: F.when((p["role"] == "assistant") & (i >= F.col("n_repeated")), F.struct(
        (F.get("starts", i) + F.length(p["head"])).alias("begin"), (F.get("starts", i) + F.length(p["head"]) + F.length(p["body"])).alias("end")))),
        lambda s: s.isNotNull())
    text = F.concat(F.lit("<s>"), F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), ""))
    return w.select("conv_id", "block", "span", text.alias("formatted"), F.size("parts").cast("long").alias("n_turns"),
                    F.col("n_repeated").cast("long").alias("n_repeated"), tok_sum(F.col("all")).alias("tokens"),
                    (tok_sum(F.col("all")) > budget).alias("over_budget"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a window, unescaped."""
    pieces = F.split(F.substr(formatted, F.lit(4)), "</s>")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substr(F.substring_index(p, "[/ROLE]", 1), F.lit(7))).alias("role"),
        unescaped(F.substr(p, F.length(F.substring_index(p, "[/ROLE]", 1)) + 8)).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of whole conversations from their windows' text and masks alone. Each
    conversation's new turns meet in one row, as the digests ask."""
    new = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)).cast("int"))
    said = F.array_join(F.transform(new, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    w = formatted.select("conv_id", F.struct("block", "span", said.alias("said"), lost.alias("lost"), (F.col("n_turns") - F.col("n_repeated")).alias("n"),
                                             F.length("formatted").cast("long").alias("chars")).alias("w"))
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x[f])
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return g.select("conv_id", total("n").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
                    F.length(joined("lost")).cast("long").alias("loss_chars"), F.sha2(joined("lost"), 256).alias("loss_sha256"),
                    total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("windows"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations and conversation -1, whose texts are control strings."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(windows(turns))


def _sql_escaped(c: str) -> str:
    c = f"regexp_replace({c}, '&(amp;|lt;|lb;)', '&amp;\\1', 'g')"
    for s in CONTROL:
        c = f"replace({c}, '{s}', '{_NAMES[s[0]] + s[1:]}')"
    return c


#: The same windows by SQL windows over whole conversations (below block_turns turns, as in the given tables).
ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    ceil(strlen(text) / 4)::bigint + {TURN_COST} as tok,
    17 + length({_sql_escaped('role')}) + length({_sql_escaped('text')}) as chars from t),
s as (select *, (i = 1 and role = 'system') as sys, max(case when i = 1 and role = 'system' then tok else 0 end) over (partition by conv_id) as sys_tok,
    max(case when i = 1 and role = 'system' then chars else 0 end) over (partition by conv_id) as sys_chars from o),
e as (select *, greatest({BUDGET - HISTORY} - sys_tok, {TURN_COST}) as stride, greatest(0, least({HISTORY}, {BUDGET} - sys_tok)) as room,
    sum(case when sys then 0 else tok end) over (partition by conv_id order by i) as cum from s),
p as (select *, 2 * floor((cum - tok) / stride) + case when floor((cum - tok) / stride) = floor((cum - 1) / stride) then 0 else 1 end as span
  from e where not sys),
f as (select conv_id, span, min(i) as first_i, min(cum - tok) as begin_at, sum(chars) as own, any_value(sys_chars) as sys_chars, any_value(room) as room
  from p group by conv_id, span),
h as (select f.conv_id, f.span, sum(p.chars) as hist from f join p on p.conv_id = f.conv_id and p.i < f.first_i
    and p.i >= f.first_i - {HISTORY_TURNS} and f.begin_at - (p.cum - p.tok) <= f.room group by f.conv_id, f.span),
w as (select f.conv_id, sum(3 + f.sys_chars + f.own + coalesce(h.hist, 0)) as chars, count(*) as windows
  from f left join h on h.conv_id = f.conv_id and h.span = f.span group by f.conv_id),
a as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as lost, any_value(sys_chars) as sys_chars from s group by conv_id)
select a.conv_id, n_turns::bigint as n_turns, turns_sha256, length(lost)::bigint as loss_chars, sha256(lost) as loss_sha256,
  coalesce(w.chars, 3 + a.sys_chars)::bigint as formatted_chars, coalesce(w.windows, 1)::bigint as windows
from a left join w on w.conv_id = a.conv_id
"""
