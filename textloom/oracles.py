"""DuckDB SQL for the registered queries."""

from textloom import index_queries

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _bm25(source: str, key: str) -> str:
    terms = ["that", "idiot", "tion"]
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum(case when tf{i} > 0 then 1 else 0 end) as df{i}" for i in range(3))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3))
    return f"""w as (select {key}, {_TOKENS} as t from {source}), c as (select {key}, len(t) as dl, {tf} from w),
      f as (select count(*) as n, avg(dl) as avgdl, {df} from c),
      hits as (select {key}, {score} as score from c, f where tf0 > 0 or tf1 > 0 or tf2 > 0)"""


_COSINE = """near as (select e.vec_id, coalesce(list_dot_product(e.embedding::double[], q.embedding::double[]) /
  nullif(sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])), 0), 0) as score
  from embeddings e, (select embedding from embeddings where vec_id = 0) q)"""

_FOLD = r"lower(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g'))"


def _shingles(name: str, table: str, key: str, width: int = 32) -> str:
    """FNV-1a of each window of code points in two halves of 32 bits, so that no product overflows, then splitmix64 in wide numbers."""
    start = 0xCBF29CE484222325
    steps, last = [], f"{name}_l"
    for k in range(width):
        rest = "".join(f", c{j}" for j in range(k + 1, width))
        steps.append(f"{name}_{k} as (select {key}, p0, (x * 435) & 4294967295 as lo, (hi * 435 + ((x * 435) >> 32) + x * 256) & 4294967295 as hi{rest} from (select *, xor(lo, c{k}) as x from {last}))")
        last = f"{name}_{k}"
    mixed = lambda s, m: f"(xor(h, h >> {s})::uhugeint * {m}::uhugeint % {1 << 64}::uhugeint)::ubigint as h"
    return f"""{name}_c as (select {key}, unnest(range(0, length(b))) as p0, unnest(list_transform(string_split(b, ''), lambda x: ord(x)))::ubigint as c from (select {key}, {_FOLD} as b from {table}) where length(b) >= {width}),
  {name}_l as (select {key}, p0, c as c0, {", ".join(f"lead(c, {k}) over w as c{k}" for k in range(1, width))}, {start & 0xFFFFFFFF}::ubigint as lo, {start >> 32}::ubigint as hi
    from {name}_c window w as (partition by {key} order by p0) qualify c{width - 1} is not null), {", ".join(steps)},
  {name}_x as (select {key}, p0, (hi * 4294967296 + lo)::ubigint as h from {last}), {name}_y as (select {key}, p0, {mixed(30, 0xBF58476D1CE4E5B9)} from {name}_x),
  {name}_z as (select {key}, p0, {mixed(27, 0x94D049BB133111EB)} from {name}_y), {name} as (select {key}, p0, xor(h, h >> 31) as hash from {name}_z)"""


_BOTH = f"{_shingles('sa', 'benchmark', 'item_id')}, {_shingles('sb', 'documents', 'doc_id')}"
_CANDIDATES = f"""{_BOTH}, ka as (select distinct item_id as a, hash from sa where hash & 31 = 0), kb as (select distinct doc_id as b, hash from sb where hash & 31 = 0),
  g as (select hash from kb group by hash having count(*) >= 12),
  cand as (select a, b, count(*) as shared from ka join kb on ka.hash = kb.hash where kb.hash not in (select hash from g) group by 1, 2 having count(*) >= 3)"""
_LINES = r"list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_CONTENT = r"length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g'))"
_SUSPICION = f"""case when len({_LINES}) = 0 then '' when len({_LINES}) >= 4 and list_avg(list_transform({_LINES}, lambda x: length(trim(x)))) < 6 then 'short-lines'
  when {_CONTENT} < 220 then 'thin' else '' end"""
_BARE = r"regexp_replace(regexp_replace(x, '^[^\p{L}\p{Nd}]+', ''), '[^\p{L}\p{Nd}]+$', '')"
_WORDLIKE = f"""case when length({_BARE}) > 24 then false when length({_BARE}) = 0 then false when regexp_full_match({_BARE}, '\\p{{Nd}}+') then true
  when length(regexp_replace({_BARE}, '[^\\p{{L}}]', '', 'g')) >= 3 then regexp_matches(lower({_BARE}), '[aeiouy]') else length(regexp_replace({_BARE}, '[^\\p{{L}}]', '', 'g')) > 0 end"""
_FLAT = r"trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))"

ORACLES: dict[str, str] = {
    "bm25_search": f"with {_bm25('documents', 'doc_id')} select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 10",
    "bm25_under_path": f"with {_bm25('documents', 'doc_id')} select doc_id, 'doc/' || doc_id as path, round(score, 6) as score from hits where starts_with('doc/' || doc_id, 'doc/1') order by hits.score desc, doc_id limit 10",
    "cosine_search": f"with {_COSINE} select vec_id, round(score, 6) as score from near order by near.score desc, vec_id limit 10",
    "hybrid_search": f"""with {_bm25('documents', 'doc_id')}, {_COSINE},
      l as (select doc_id, row_number() over (order by score desc, doc_id) as r from hits qualify r <= 40),
      d as (select vec_id as doc_id, row_number() over (order by score desc, vec_id) as r from near where vec_id in (select doc_id from documents) qualify r <= 40),
      u as (select * from l union all select * from d), fused as (select doc_id, sum(1.0 / (60 + r - 1)) as score from u group by doc_id)
      select doc_id, round(score, 6) as score from fused order by fused.score desc, doc_id limit 10""",
    # words of the three stems, by their endings
    "bm25_stemmed": f"""with w as (select doc_id, {_TOKENS} as t from documents),
      c as (select doc_id, len(t) as dl, len(list_filter(t, lambda x: regexp_full_match(x, 'idiots?'))) as tf0, len(list_filter(t, lambda x: regexp_full_match(x, 'run(s|ning)?'))) as tf1,
        len(list_filter(t, lambda x: regexp_full_match(x, 'relat(e|es|ed|ing|ion|ions|ive|ives|ional)'))) as tf2 from w),
      f as (select count(*) as n, avg(dl) as avgdl, sum((tf0 > 0)::int) as df0, sum((tf1 > 0)::int) as df1, sum((tf2 > 0)::int) as df2 from c),
      h as (select doc_id, {" + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3))} as score from c, f where tf0 + tf1 + tf2 > 0)
      select doc_id, round(score, 6) as score from h order by h.score desc, doc_id limit 10""",
    "index_search": f"with {_bm25('documents', 'doc_id')} select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 10",
    "postings_stats": f"select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_TOKENS}) as term from documents) group by term",
    "best_turn_of_conversation": f"""with t0 as (select *, conv_id * 1000 + turn as frag_id from conversations), {_bm25('t0', 'frag_id')},
      r as (select frag_id // 1000 as conv_id, frag_id, round(score, 6) as score from hits)
      select conv_id, frag_id, score from r qualify row_number() over (partition by conv_id order by score desc, frag_id) = 1""",
    "match_documents": "select doc_id, 'doc/' || doc_id as path, source as title from documents where contains(lower(source), 'src1') or contains('doc/' || doc_id, 'src1')",
    "branch_overlay": """select doc_id, source, n_chars from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0
      union all select doc_id, 'branch', n_chars + 1 from documents where doc_id % 5 = 0""",
    "text_facts": f"select doc_id, {_CONTENT} as content_chars, sha256({_FOLD}) as folded, coalesce(list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) >= 5000, false) as minified, sha256({_FLAT}) as identity from documents",
    "page_gates": f"""select conv_id, turn, case when len({_WORDS}) = 0 then 'ok'
      when length(regexp_replace(text, '[^\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) / length(text) > 0.05 then 'junk'
      when (turn % 10) / 10.0 > 0 and (turn % 10) / 10.0 < 0.55 then 'confidence'
      when len({_WORDS}) >= 8 and len(list_filter({_WORDS}, lambda x: {_WORDLIKE})) / len({_WORDS}) < 0.35 then 'words' else 'ok' end as verdict,
      {_SUSPICION} as suspicion from conversations""",
    "line_repetition": f"select doc_id, round(case when len({_LINES}) > 0 then 1 - len(list_distinct({_LINES})) / len({_LINES}) else 0 end, 6) as repetition from documents",
    "numeric_tokens": r"""select doc_id, array_to_string(list_sort(list_distinct(n)), ' ') as numbers from (
      select doc_id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda x: length(x) >= 2) as n from documents) where len(n) > 0""",
    "html_to_text": "select page_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<[^<>]*>', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))) as text from pages",
    "clipped_titles": f"""select doc_id, case when length({_FLAT}) > 60 then substr({_FLAT}, 1, 60) || '…' else {_FLAT} end as title,
      case when instr(text, 'idiot') > 0 then substr(text, greatest(instr(text, 'idiot') - 80, 1), instr(text, 'idiot') + 85 - greatest(instr(text, 'idiot') - 80, 1)) else substr(text, 1, 160) end as excerpt from documents""",
    "url_kinds": """select page_id, case when regexp_matches(p, '[.]pdf$') then 'pdf' when page_id % 5 = 3 or regexp_matches(p, '[.](png|jpg|jpeg|gif|tif|tiff|webp|bmp)$') then 'image'
      when regexp_matches(p, '[.](docx|doc|odt|rtf|pptx|html|htm|epub)$') then 'office' when regexp_matches(p, '[.](xlsx|xls)$') then 'spreadsheet' when regexp_matches(p, '[.](eml|mbox)$') then 'email'
      when page_id % 5 = 1 or regexp_matches(p, '[.](txt|md|markdown|csv)$') then 'text' when page_id % 5 = 2 then 'office' else 'unknown' end as kind,
      case when regexp_replace(lower(url), '[^a-z0-9_-]', '', 'g') = '' then 'default' else regexp_replace(lower(url), '[^a-z0-9_-]', '', 'g') end as index_name
      from (select page_id, url, lower(url || ['.pdf', '.md', '.PNG', '.xlsx', '.eml', '', '.docx'][page_id % 7 + 1]) as p from pages)""",
    "identical_groups": "select sha256(text) as content_hash, array_to_string(list_sort(list(doc_id)), ',') as members from documents where text <> '' group by 1 having count(*) > 1",
    "same_bytes": "select doc_id, min(doc_id) over (partition by sha256(text)) as first, count(*) over (partition by sha256(text)) as members from documents where text <> '' qualify count(*) over (partition by sha256(text)) > 1",
    "sketch_facts": f"with {_shingles('s', 'documents', 'doc_id')} select doc_id, count(distinct hash) as total, count(distinct hash) filter (hash & 31 = 0) as sampled from s group by doc_id",
    "overlap_candidates": f"with {_CANDIDATES} select a, b, shared from cand",
    "shingle_similarity": f"""with {_CANDIDATES}, da as (select distinct item_id as a, hash from sa), db as (select distinct doc_id as b, hash from sb where doc_id in (select b from cand)),
      na as (select a, count(*) as n from da group by 1), nb as (select b, count(*) as n from db group by 1),
      m as (select cand.a, cand.b, count(*) as common from cand join da on da.a = cand.a join db on db.b = cand.b and da.hash = db.hash group by 1, 2)
      select m.a, m.b, common, round(common / (na.n + nb.n - common), 6) as jaccard, round(common / na.n, 6) as a_in_b, round(common / nb.n, 6) as b_in_a from m join na on na.a = m.a join nb on nb.b = m.b""",
    "alignment_runs": f"""with {_BOTH}, h as (select * from sb where hash in (select hash from sa)), few as (select doc_id, hash from h group by 1, 2 having count(*) <= 24),
      d as (select x.item_id as a, y.doc_id as b, x.p0 as p, y.p0 - x.p0 as delta from sa x join h y on x.hash = y.hash join few on few.doc_id = y.doc_id and few.hash = y.hash),
      i as (select *, case when p - lag(p) over (partition by a, b, delta order by p) <= 32 then 0 else 1 end as new from d),
      g as (select *, sum(new) over (partition by a, b, delta order by p) as island from i)
      select a, b, min(p) as from_a, max(p) + 32 as to_a, min(p) + delta as from_b, max(p) + 32 + delta as to_b from g group by a, b, delta, island having max(p) + 32 - min(p) >= 40""",
    "covered_intervals": """with i as (select user_id, floor(epoch(ts))::bigint as lo from events), s as (select user_id, lo, lead(lo) over (partition by user_id order by lo) as nx from (select distinct user_id, lo from i))
      select user_id, cast(sum(least(3600, coalesce(nx - lo, 3600))) as bigint) as covered from s group by user_id""",
    "fragment_round_trip": "select doc_id, sha256(text) as digest from documents",
    "not_withdrawn": "select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)",
    "oversized_documents": "select conv_id, max(length(text)) as longest from conversations group by 1 having max(length(text)) > 300",
    "windowed_job_metrics": "select date_trunc('day', ts) as window_start, count(*) as jobs, count(*) filter (event_type = 'error') as failed, round(avg(value), 6) as mean_value from events group by 1",
    "generic_masks": f"""with {_shingles('s', 'documents', 'doc_id')}, g as (select hash from (select distinct doc_id, hash from s where hash & 31 = 0) group by 1 having count(*) >= 3),
      n as (select doc_id, max(p0) + 32 as length from s group by 1),
      i as (select doc_id, greatest(p0 - 32, 0) as lo, least(p0 + 64, length) as hi from s join n using (doc_id) where hash in (select hash from g)),
      m as (select *, coalesce(lo > max(hi) over (partition by doc_id order by lo, hi rows between unbounded preceding and 1 preceding), true)::int as fresh from i),
      k as (select *, sum(fresh) over (partition by doc_id order by lo, hi rows unbounded preceding) as island from m)
      select doc_id, cast(min(lo) as integer) as lo, cast(max(hi) as integer) as hi from k group by doc_id, island""",
    "planned_sources": r"""select page_id, url from pages where (regexp_matches(url, '^https://(?:.*/)?[^/]*$') or regexp_matches(regexp_extract(url, '[^/]*$'), '^[^/]*1[^/]*$'))
      and not url like '%0' and not regexp_matches(url, '^(?:.*/)?[^/]*7$') and not regexp_matches(regexp_extract(url, '[^/]*$'), '^[^/]*9[^/]$')""",
    "region_geometry": """with a as (select l_orderkey, l_linenumber, l_orderkey % 64 / 64.0 as x, l_partkey % 32 / 32.0 as y, l_suppkey % 16 / 16.0 as w0, l_linenumber % 8 / 8.0 as h0 from lineitem),
      b as (select l_orderkey, l_linenumber, x::double as x, y::double as y, least(x + w0, 1)::double - x as w, least(y + h0, 1)::double - y as h from a),
      c as (select *, x + 0.25 * w as cx, y + 0.25 * h as cy, 0.5 * w as cw, x * h as ch, w * h as area from b where w > 0 and h > 0),
      d as (select *, least(x + w, cx + cw) - greatest(x, cx) as iw, least(y + h, cy + ch) - greatest(y, cy) as ih from c)
      select l_orderkey, l_linenumber, round(area, 12) as area, round(case when iw > 0 and ih > 0 then iw * ih / (area + cw * ch - iw * ih) else 0 end, 12) as iou, cw * ch / area < 0.8 as narrows,
      round((least(x + w + 0.5 / 8.5, 1) - greatest(x - 0.5 / 8.5, 0)) * (least(y + h + 0.5 / 11, 1) - greatest(y - 0.5 / 11, 0)), 12) as padded from d""",
    "mail_pages": r"select cast(conv_id as varchar) as path, cast(row_number() over (partition by conv_id order by turn) + 1 as integer) as page, 'turn ' || turn as subject, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as body from conversations",
}

ORACLES["stored_candidates"], ORACLES["stored_masks"] = ORACLES["overlap_candidates"], ORACLES["generic_masks"]
ORACLES["stored_status"] = """select doc_id, case when doc_id % 2 = 0 and doc_id % 14 <> 0 then case when doc_id % 5 = 1 and text <> '' then 'changed' else 'sketched' end when doc_id % 3 = 0 then 'stale' else 'unsketched' end as state from documents"""

ORACLES["split_archives"] = r"select conv_id || '/' || turn as subject, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as body from conversations where conv_id is not null and turn is not null"
ORACLES["updated_index_search"] = ORACLES["index_search"]
# words of the stems by their endings; a phrase is counted where its tokens follow each other
_PHRASES = [["is", "licen(se|ses|sed|sing)"], ["licen(se|ses|sed|sing)"], ["rights?"], ["all", "rights?", "reserv(e|es|ed|ing)"], ["idiots?"]]
_TF = [f"len(list_filter(range(1, len(t) + 1), lambda i: {' and '.join(f"coalesce(regexp_full_match(t[i + {k}], '{w}'), false)" for k, w in enumerate(p))}))" for p in _PHRASES]
ORACLES["index_phrases"] = f"""with w as (select doc_id, {_TOKENS} as t from documents), c as (select doc_id, len(t) as dl, {", ".join(f"{x} as tf{i}" for i, x in enumerate(_TF))} from w),
  f as (select count(*) as n, avg(dl) as avgdl, {", ".join(f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(_TF)))} from c),
  h as (select doc_id, {" + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(_TF)))} as score from c, f where {" + ".join(f"tf{i}" for i in range(len(_TF)))} > 0)
  select doc_id, round(score, 6) as score from h order by h.score desc, doc_id limit 10"""

ORACLES |= index_queries.ORACLES
