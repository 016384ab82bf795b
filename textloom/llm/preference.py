"""Preference formatting: one prompt from the longest common turn prefix, and two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAINED_ROLES = ("assistant",)
BLOCK = 64  # turns that are put together before a conversation's blocks are

_KEY = ["pair_id", "part"]
_SPANS = "array<struct<from:bigint,to:bigint>>"


def opening():
    """What stands before a turn's words: its role in a marker line."""
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"))


def rendered():
    """A turn as text: its marker line, its words, an end marker."""
    return F.concat(opening(), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))


def swapped_answers(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Preference sides (pair_id, side, turn, role, text) from plain conversations (conv_id, turn, role, text).

    The chosen side of pair c is conversation c.  The rejected one is c with its last
    turn of ``role`` answered by the last such turn of its neighbour: conversations 2k and
    2k + 1 are neighbours.  Where one of the two has no such turn, both sides are
    equal.  Rows without conv_id or turn belong to no conversation and are left out;
    of several last turns with one number, the one with the largest text counts.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("pair_id is not null and turn is not null")
    last = rows.where(F.col("role") == role).groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    here = last.select("pair_id", F.col("last.turn").alias("at"))
    other = last.select((F.col("pair_id").bitwiseXOR(F.lit(1))).alias("pair_id"), F.col("last.text").alias("answer"))
    swap = here.join(other, "pair_id")
    wrong = rows.join(swap, "pair_id", "left").withColumn("text", F.when((F.col("role") == role) & (F.col("turn") == F.col("at")), F.col("answer")).otherwise(F.col("text")))
    columns = ["pair_id", "side", "turn", "role", "text"]
    return rows.withColumn("side", F.lit("chosen")).select(columns).unionByName(wrong.withColumn("side", F.lit("rejected")).select(columns))


def preference_turns(sides: DataFrame, trained=TRAINED_ROLES) -> DataFrame:
    """pair_id, part, turn, sub, role, rendered, opening, trained: a row for each turn of prompt and completions.

    ``sides`` has pair_id, side (``chosen`` or ``rejected``), turn, role and text.  The
    turns before the first place at which the two sides differ are the prompt, once,
    never trained on; the others are the completions, of which the turns of
    ``trained`` roles are trained on.  In order of (turn, sub) the texts of ``prompt``
    and of one side, put together, are that conversation.

    Sides are compared by counting and comparing at each place, so a conversation of
    any length is spread over tasks.  Rows repeated exactly count once; different rows
    of one turn follow each other by role and text (``sub``).  Null roles and texts
    are empty when rendered and equal to each other only.  A side without partner is
    a completion with an empty prompt; two equal ones are all prompt.
    """
    rows = sides.select("pair_id", "side", "turn", "role", "text").distinct()
    order = Window.partitionBy("pair_id", "side", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("sub", F.row_number().over(order) - 1)
    content = F.struct("role", "text")
    places = rows.groupBy("pair_id", "turn", "sub").agg(F.count("*").alias("c"), F.min(content).alias("low"), F.max(content).alias("high"))
    apart = places.where(~((F.col("c") == 2) & F.col("low").eqNullSafe(F.col("high"))))
    cut = apart.groupBy("pair_id").agg(F.min(F.struct("turn", "sub")).alias("cut"))
    shared = F.col("cut").isNull() | (F.struct("turn", "sub") < F.col("cut"))
    parted = rows.join(cut, "pair_id", "left").withColumn("part", F.when(shared, F.lit("prompt")).otherwise(F.col("side")))
    parted = parted.where("part <> 'prompt' or side = 'chosen'")
    mask = (F.col("part") != "prompt") & F.coalesce(F.col("role").isin(*trained), F.lit(False))
    return parted.select("pair_id", "part", "turn", "sub", "role", rendered().alias("rendered"), F.length(opening()).alias("opening"), mask.alias("trained"))


def _joined(texts: str, spans: str, rows: str = "rows") -> str:
    """SQL of the spans of all ``rows``, moved to where they come to stand when the ``texts`` are put together."""
    moved = f"concat(s.spans, transform(x.{spans}, p -> struct(p.from + s.at as from, p.to + s.at as to)))"
    return f"aggregate({rows}, struct(0L as at, cast(array() as {_SPANS}) as spans), (s, x) -> struct(s.at + length(x.{texts}) as at, {moved} as spans)).spans"


def preference_pairs(sides: DataFrame, trained=TRAINED_ROLES) -> DataFrame:
    """pair_id, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask: one row a pair of ``sides``.

    ``prompt`` and a completion, put together, are that conversation.  A mask is the
    spans (from, to; code points of the completion) to train on: the words and end
    markers of turns of ``trained`` roles.  What has no turn is an empty text.  See
    ``preference_turns`` for odd rows.

    Turns are put together in blocks of BLOCK by their numbers first, so that a task
    meets a very long conversation only as whole blocks; the row itself is as long as
    the conversation.
    """
    turns = preference_turns(sides, trained)
    own = F.when(F.col("trained"), F.array(F.struct(F.col("opening").cast("long").alias("from"), F.length("rendered").cast("long").alias("to")))).otherwise(F.expr(f"cast(array() as {_SPANS})"))
    turns = turns.select(*_KEY, F.expr(f"turn div {BLOCK}").alias("block"), F.struct("turn", "sub", F.col("rendered").alias("text"), own.alias("spans")).alias("x"))
    blocks = turns.groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    blocks = blocks.select(*_KEY, F.struct("block", F.size("rows").alias("n"), F.expr("array_join(transform(rows, x -> x.text), '')").alias("text"), F.expr(_joined("text", "spans")).alias("spans")).alias("x"))
    parts = blocks.groupBy("pair_id").pivot("part", ["prompt", "chosen", "rejected"]).agg(F.sort_array(F.collect_list("x")).alias("rows"))
    text = lambda c: F.coalesce(F.array_join(F.transform(F.col(c), lambda x: x.text), ""), F.lit(""))
    spans = lambda c: F.coalesce(F.expr(_joined("text", "spans", c)), F.expr(f"cast(array() as {_SPANS})"))
    count = F.coalesce(F.expr("aggregate(prompt, 0, (s, x) -> s + x.n)"), F.lit(0))
    return parts.select("pair_id", text("prompt").alias("prompt"), count.alias("prompt_turns"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_mask"), spans("rejected").alias("rejected_mask"))


ORACLE = """
with t as (
  select conv_id as pair_id, turn, role, text from conversations where conv_id is not null and turn is not null
), a as (
  select pair_id, max(turn) as at from t where role = 'assistant' group by pair_id
), l as (
  select t.pair_id, a.at, max(coalesce(t.text, '')) as answer from t join a on t.pair_id = a.pair_id and t.turn = a.at and t.role = 'assistant' group by all
), sides as (
  select pair_id, 'chosen' as side, turn, role, text from t
  union all
  select t.pair_id, 'rejected', t.turn, t.role, case when t.role = 'assistant' and t.turn = h.at then o.answer else t.text end
  from t left join l o on xor(t.pair_id, 1) = o.pair_id left join l h on t.pair_id = h.pair_id and o.pair_id is not null
), r as (
  select *, row_number() over (partition by pair_id, side, turn order by role nulls first, text nulls first) - 1 as sub from (select distinct * from sides)
), apart as (
  select coalesce(c.pair_id, j.pair_id) as pair_id, coalesce(c.turn, j.turn) as turn, coalesce(c.sub, j.sub) as sub
  from (from r where side = 'chosen') c full join (from r where side = 'rejected') j on c.pair_id = j.pair_id and c.turn = j.turn and c.sub = j.sub
  where c.side is null or j.side is null or c.role is distinct from j.role or c.text is distinct from j.text
), cut as (
  select pair_id, min(turn * 1000000 + sub) as at from apart group by pair_id
), p as (
  select r.pair_id, r.turn, r.sub, case when c.at is null or r.turn * 1000000 + r.sub < c.at then 'prompt' else side end as part, side, r.role,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as line, 5 + length(coalesce(role, '')) as opening
  from r left join cut c on r.pair_id = c.pair_id
), q as (
  select *, sum(length(line)) over (partition by pair_id, part order by turn, sub) as reached from p where part <> 'prompt' or side = 'chosen'
), b as (
  select pair_id, part, string_agg(line, '' order by turn, sub) as body, count(*) as n,
    string_agg(cast(reached - length(line) + opening as bigint) || '-' || cast(reached as bigint), ',' order by turn, sub) filter (role = 'assistant') as mask
  from q group by pair_id, part
)
select pair_id, coalesce(max(body) filter (part = 'prompt'), '') as prompt, cast(coalesce(max(n) filter (part = 'prompt'), 0) as integer) as prompt_turns,
  coalesce(max(body) filter (part = 'chosen'), '') as chosen, coalesce(max(body) filter (part = 'rejected'), '') as rejected,
  coalesce(max(mask) filter (part = 'chosen'), '') as chosen_mask, coalesce(max(mask) filter (part = 'rejected'), '') as rejected_mask
from b group by pair_id
"""
