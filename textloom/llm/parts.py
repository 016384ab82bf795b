"""Parts of the operators' results that SQL can tell, as queries of their own with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.llm.common import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOW_WORDS = _WORDS.replace("coalesce(text, '')", _LOWER)
#: The published CRC-32, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
  lambda s, c: list_reduce(list_transform(range(8), lambda i: cast(i as bigint)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(s, c)), 4294967295::bigint), 4294967295)"""


def rule_bases(spark, sf_dir):
    """The statistics behind the quality rules, and the base verdict."""
    from textloom.llm.rules import base_failed, statistics

    stats = statistics(table(spark, sf_dir, "documents"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


RULE_BASES = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from (select *, count(*) over (partition by doc_id, k) as c from g) where c > 1) group by doc_id),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d)
select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(w) < 10 or 100 * coalesce(r.n, 0) > 20 * len(w) as base_failed
from d join l using (doc_id) left join r using (doc_id)
"""


def mix_targets(spark, sf_dir):
    """Sizes of documents and sources, and each source's target in the mix."""
    from textloom.llm.mixing import sizes, targets

    rows = sizes(table(spark, sf_dir, "documents"))
    goal = targets(rows).select(F.col("source").alias("s"), "source_size", F.round("target", 6).alias("target"))
    return rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target")


MIX_TARGETS = f"""
with d as (select doc_id, source, len({_WORDS}) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
-- sources in order of how soon their cap binds: the level is where the first open one is below its cap
o as (select *, 3.0 * source_size / w as r, sum(source_size) over () as total, sum(3 * source_size) over (order by 3.0 * source_size / w, source rows between unbounded preceding and 1 preceding) as capped,
  sum(w) over (order by 3.0 * source_size / w, source rows between current row and unbounded following) as open from s),
v as (select arg_min((total - coalesce(capped, 0)) / open, r) as level from o where (total - coalesce(capped, 0)) / open <= r)
select doc_id, size, source_size, round(least(3.0 * source_size, coalesce(level, 1e300) * w), 6) as target from d join s on d.source is not distinct from s.source, v
"""


def base_scores(spark, sf_dir):
    """What the suffix tree's scores are held against: tokens, known ones, and the score by word counts alone."""
    from textloom.llm.suffix_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


BASE_SCORES = f"""
with d as (select doc_id, {_CRC} % 5 = 1 as held_out, unnest(list_append({_LOW_WORDS}, chr(10))) as w from documents),
c as (select w, count(*) as c from d where not held_out group by w), f as (select cast(sum(c) as bigint) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c.c) as n_known, n as train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) as base_score
from d left join c on d.w = c.w, f group by doc_id, held_out, n
"""


def edited_texts(spark, sf_dir):
    """Lengths of texts, and what their edited versions are."""
    from textloom.llm.phrases import phrase_fingerprints

    return phrase_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


EDITED_TEXTS = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
x as (select *, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as nxt from d)
select doc_id, n as n_chars, sha256(substr(t, 1, n - n // 3) || substr(nxt, 1, n // 3)) as edited_sha256 from x
"""

#: Links by shared shingles, then the smallest id that is reachable.
NEAR = f"""
with recursive d as materialized (select doc_id, {_LOW_WORDS} as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as materialized (select p.a, p.b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
g as materialized (select a as v, b as u from e union select b, a from e union select doc_id, doc_id from d),
t as (select v, u from g union select t.v, g.u from t join g on g.v = t.u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join n using (doc_id) join (select v, min(u) as component_id from t group by v) m on m.v = d.doc_id
"""

QUERIES = {f.__name__: f for f in (rule_bases, mix_targets, base_scores, edited_texts)}
ORACLE_SQL = {"rule_bases": RULE_BASES, "mix_targets": MIX_TARGETS, "base_scores": BASE_SCORES, "edited_texts": EDITED_TEXTS}
