"""Preference formatting: the longest common turn prefix once as prompt, and two masked completions.

Conversations are rows (pair_id, turn, role, text). The prefix ends at the first turn whose role or text differs. It is
rendered once; what follows it on either side is rendered as a completion, with a mask: the character spans of what an
assistant says, end marks included, on which a model is trained.

Turns are ordered by turn, then role, then text, nulls first; null roles and texts count as empty. Repeated rows are
turns of their own. A side without rows is an empty conversation. If both sides are equal both completions are empty.
Rows with a null pair_id are left out; an empty table gives no pairs. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>"


def turns(rows: DataFrame, name: str) -> DataFrame:
    """(pair_id, name array<struct<role, text>>), in order."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = rows.where("pair_id is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list(t)).alias(name))
    return kept.withColumn(name, F.transform(name, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def common(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def render(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END + "\n"))), "")


def mask(part: Column) -> Column:
    """array<struct<start, end>>: spans of the rendered part, in characters, that are the assistant's."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t["role"]))
        end = begin + F.length(t["text"]) + len(END)
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(part, start, step, lambda acc: acc["spans"])


def pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask), one row per pair_id of chosen."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = turns(chosen, "a").join(turns(rejected, "b"), "pair_id", "left").withColumn("b", F.coalesce("b", none))
    both = both.withColumn("n", common(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    prefix = F.slice(F.col("a"), F.lit(1), F.col("n"))
    a, b = rest("a"), rest("b")
    return both.select("pair_id", F.col("n").alias("prompt_turns"), render(prefix).alias("prompt"), render(a).alias("chosen"), mask(a).alias("chosen_mask"), render(b).alias("rejected"), mask(b).alias("rejected_mask"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from single conversations (conv_id, turn, role, text), for tables without pairs of answers.

    The chosen side is the whole conversation. In the rejected side one reply of the assistant, number conv_id modulo the
    number of replies, is the one chosen by the same rule in the neighbour, conv_id xor 1, and the turns after it follow
    as they are; without such a neighbour the rejected side ends before that reply. Conversations without a reply make no
    pair. Turns are numbered anew, in the order of turn, role and text with nulls first, so that no turn is lost."""
    by_turn = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    c = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").withColumn("n", F.row_number().over(by_turn))
    replies = c.where(F.col("role") == ASSISTANT).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("r"))
    one = F.element_at("r", (F.pmod("conv_id", F.size("r")) + 1).cast("int"))
    swap = replies.select("conv_id", one["n"].alias("at"), F.coalesce(one["text"], F.lit("")).alias("own"))
    other = swap.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("own").alias("new"))
    all_ = c.join(swap.join(other, "conv_id", "left").select("conv_id", "at", "new"), "conv_id")
    side = lambda text: (F.col("conv_id").alias("pair_id"), F.col("n").alias("turn"), "role", text.alias("text"))
    rejected = all_.where((F.col("n") < F.col("at")) | F.col("new").isNotNull())
    return all_.select(*side(F.col("text"))), rejected.select(*side(F.when(F.col("n") == F.col("at"), F.col("new")).otherwise(F.col("text"))))


SQL = """
with c as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, coalesce(role = 'assistant', false) as reply,
           row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n from conversations where conv_id is not null),
r as (select *, row_number() over (partition by conv_id order by n) as k, count(*) over (partition by conv_id) as m from c where reply),
s as (select conv_id, n as spot, text as own from r where k = 1 + ((conv_id % m) + m) % m),
p as (select s.*, o.own as new, coalesce(o.own = s.own, false) as same from s left join s o on o.conv_id = xor(s.conv_id, 1)),
t as (select c.conv_id, c.n, c.role, c.reply, p.spot, p.same, p.new, c.text as yes, case when c.n = p.spot then p.new else c.text end as no from c join p on c.conv_id = p.conv_id),
u as (select *, '<|' || role || '|>' || chr(10) || yes || '<|end|>' || chr(10) as y, '<|' || role || '|>' || chr(10) || no || '<|end|>' || chr(10) as z from t),
v as (select *, sum(length(y)) over (partition by conv_id order by n) - length(y) as y_at, sum(length(z)) over (partition by conv_id order by n) - length(z) as z_at
      from u where n >= spot and not same)
select p.conv_id, cast(case when p.same then (select count(*) from c where c.conv_id = p.conv_id) else p.spot - 1 end as integer) as prompt_turns,
  coalesce((select string_agg(y, '' order by n) from u where u.conv_id = p.conv_id and (u.n < p.spot or p.same)), '') as prompt,
  coalesce((select string_agg(y, '' order by n) from v where v.conv_id = p.conv_id), '') as chosen,
  coalesce((select string_agg((y_at + 14) || '-' || (y_at + 21 + length(yes)), ',' order by n) from v where v.conv_id = p.conv_id and reply), '') as chosen_mask,
  coalesce((select string_agg(z, '' order by n) from v where v.conv_id = p.conv_id and p.new is not null), '') as rejected,
  coalesce((select string_agg((z_at + 14) || '-' || (z_at + 21 + length(no)), ',' order by n) from v where v.conv_id = p.conv_id and reply and p.new is not null), '') as rejected_mask
from p
"""
