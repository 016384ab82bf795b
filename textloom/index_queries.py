"""Registered queries of the document index: each applies an operator to tables of ``plans.model``; its DuckDB SQL stands beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import regions as R
from textloom.functions import text as T
from textloom.operators import attest, health, pages, queue, records, search, similar
from textloom.plans import model
from textloom.plans.tasks import spread, written
from textloom.sources import transcripts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- the model in SQL

_PAGES = "pg as (select 'conv/' || conv_id as path, cast(turn + 1 as integer) as page, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null)"
_JOINED = f"""{_PAGES}, placed as (select *, cast(sum(length(text) + 2) over (partition by path order by page) - length(text) - 2 as integer) as off from pg),
  whole as (select path, string_agg(text, chr(10) || chr(10) order by page) as text from pg group by path),
  win as (select path, text as body, length(text) as n, unnest(range(0, cast(ceil(greatest(length(text) - 600, 0) / 400.0) as integer) + 1)) * 400 as s from whole where length(text) > 0),
  fr0 as (select path, body, n, cast(s as integer) as start_off, cast(least(s + 600, n) as integer) as end_off, substr(body, cast(s as integer) + 1, cast(least(s + 600, n) - s as integer)) as text from win),
  fr as (select f.*, (select max(p.page) from placed p where p.path = f.path and p.off <= f.start_off) as page,
    (select count(*) from placed p where p.path = f.path and p.off > f.start_off and p.off < f.end_off) as breaks,
    coalesce(lag(end_off) over (partition by path order by start_off), 0) as covered from fr0 f)"""
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_CONTENT = r"length(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_JOBS = """j0 as (select event_id, user_id, event_type, round(value, 2) as v, event_id % 8 = 7 as live from events),
  jb as (select event_id as id, '/d/' || user_id || case when user_id % 4 = 0 then '.pdf' else '.md' end as url,
    case when live and event_type = 'click' then 'running' when live then 'pending' when event_type = 'error' then 'error' else 'done' end as state,
    event_id * 1000000000 as begun, cast(round(v * 1000) as bigint) * 1000000 as took, user_id % 7 as owner_pid, case when event_id % 16 = 15 then 1 else 0 end as fresh, user_id from j0),
  st as (select id as job_id, seq, case seq when 1 then 'fetch' when 2 then 'segment' else 'llm-retries' end as name,
    case when state = 'error' and seq = 2 then 'error' when seq = 2 and id % 10 = 0 then 'degraded' when seq = 3 and id % 9 = 0 then 'warn' else 'ok' end as state
    from (select id, state, unnest(range(1, case when id % 3 = 0 then 4 else 3 end)) as seq from jb))"""
_READINGS = "rd as (select 'conv/' || user_id % 40 as path, cast(user_id % 3 + 1 as integer) as page, event_id as seq, 'v' || cast(trunc(value / 60) as integer) as text, case when event_type = 'purchase' then 'ann' else 'ocr-fast' end as who from events)"
_VERSIONS = f"""{_READINGS}, vs as (select *, who <> 'ocr-fast' as person, row_number() over (partition by path, page order by seq) as version
    from (select *, lag(text) over (partition by path, page order by seq) as before from rd) where before is null or text <> before),
  va as (select *, row_number() over (partition by path, page order by person desc, seq desc) = 1 as active from vs)"""
_RULINGS = """un as (select 'conv/' || conv_id as path, 'u' || turn as unit, coalesce(text, '') as text from conversations),
  rl as (select 'conv/' || user_id % 90 as path, event_id as seq, event_id % 23 = 0 or event_id % 97 = 0 as blanket,
    case when event_id % 23 = 0 or event_id % 97 = 0 then '' else 'u' || event_id % 9 end as unit, 'p' || user_id % 5 as who, 'stmt ' || event_id as statement,
    case when event_id % 23 = 0 then 'affirmed' when event_id % 97 = 0 then 'retract' when event_type = 'view' then 'confirmed' when event_type = 'click' then 'corrected'
      when event_type = 'purchase' then 'unclear' when event_type = 'signup' then 'unsupported' else 'retract' end as kind from events),
  -- each unit's own log with all sweeps of its document, as the fold meets them
  lg as (select u.path, u.unit, l.seq, l.kind, l.blanket, l.who from un u join rl l on u.path = l.path and (l.blanket or l.unit = u.unit)),
  own as (select path, unit, max(seq) filter (not blanket) as last_own, arg_max(kind, seq) filter (not blanket) as own_kind, arg_max(who, seq) filter (not blanket) as own_by,
    max(seq) filter (not blanket and kind = 'retract') as reset from lg group by path, unit),
  freed as (select u.path, u.unit, greatest(coalesce(o.last_own, -1), coalesce((select max(seq) from rl where rl.path = u.path and rl.blanket and rl.kind = 'retract'), -1)) as since, o.*
    exclude (path, unit) from un u left join own o on u.path = o.path and u.unit = o.unit),
  stt as (select f.path, f.unit, f.own_kind, f.own_by, f.last_own, f.reset,
    case when coalesce(f.own_kind, 'retract') = 'retract' then (select min(seq) from rl where rl.path = f.path and rl.blanket and rl.kind = 'affirmed' and rl.seq > f.since) end as sweep from freed f),
  state as (select s.path, s.unit, case when sweep is not null then 'affirmed' when coalesce(own_kind, 'retract') = 'retract' then '' else own_kind end as kind, sweep is not null as swept,
    case when sweep is not null then (select who from rl where rl.seq = sweep) when coalesce(own_kind, 'retract') = 'retract' then '' else own_by end as ruler,
    coalesce((select arg_max('c' || seq, seq) from rl where rl.path = s.path and rl.unit = s.unit and rl.kind = 'corrected' and rl.seq > coalesce(s.reset, -1)), (select text from un where un.path = s.path and un.unit = s.unit)) as text from stt s)"""


# ---------------------------------------------------------------- fragments and pages


@query(f"with {_JOINED} select path, start_off, end_off, page, cast(row_number() over (partition by path, page order by start_off) - 1 as integer) as ord, sha256(text) as digest, case when breaks > 0 then breaks + 1 else 0 end as spans from fr")
def fragment_windows(spark, sf_dir):
    """Windows of paged documents with page, number on the page and page spans."""
    return model.fragments(spark, sf_dir).select("path", "start_off", "end_off", "page", "ord", F.sha2("text", 256).alias("digest"), F.size(F.coalesce("page_spans", F.array())).alias("spans"))


@query(rf"""with recursive t as (select doc_id, text, length(text) as n from documents where length(text) > 0),
  w as (
    select doc_id, 0 as s, 0 as step, n from t
    union all
    select doc_id, nxt, step + 1, n from (
      select x.*, case when after <= s then e else after end as nxt from (
        select w.doc_id, w.step, w.n, w.s,
          case when w.s + 2000 >= w.n then w.n when strpos(reverse(substr(text, w.s + 1501, 500)), chr(10)) > 0 then w.s + 2000 - strpos(reverse(substr(text, w.s + 1501, 500)), chr(10)) + 1 else w.s + 2000 end as e,
          case when w.s + 1400 >= w.n then w.n when strpos(reverse(substr(text, greatest(w.s + 1400 - 512, 0) + 1, w.s + 1400 - greatest(w.s + 1400 - 512, 0))), chr(10)) > 0
            then w.s + 1400 - strpos(reverse(substr(text, greatest(w.s + 1400 - 512, 0) + 1, w.s + 1400 - greatest(w.s + 1400 - 512, 0))), chr(10)) + 1 else w.s + 1400 end as after
        from w join t on t.doc_id = w.doc_id where w.n > 2000) x) y
    where e < n and n - nxt >= 300),
  e as (select w.*, lead(w.s) over (partition by w.doc_id order by w.step) as nxt,
      case when w.s + 2000 >= w.n then w.n when strpos(reverse(substr(text, w.s + 1501, 500)), chr(10)) > 0 then w.s + 2000 - strpos(reverse(substr(text, w.s + 1501, 500)), chr(10)) + 1 else w.s + 2000 end as hard
    from w join t on t.doc_id = w.doc_id)
  select doc_id, cast(step as integer) as ord, cast(s as integer) as start_off, cast(case when nxt is null then n else hard end as integer) as end_off from e""")
def fragment_bounds(spark, sf_dir):
    """Bounds of snapped windows of all documents (they have no blank lines: the snaps are to line ends)."""
    from textloom.operators.fragments import fragments

    found = fragments(spread(model.table(spark, sf_dir, "documents")), "doc_id", "text", 2000, 1400, 300)
    return found.select("doc_id", "ord", "start_off", "end_off")


@query(f"""with {_JOINED}, h as (select path, start_off, page, breaks, case when strpos(lower(text), 'the') = 0 and strpos(lower(text), 'and') = 0 then -1
    else least(case when strpos(lower(text), 'the') = 0 then 100000 else strpos(lower(text), 'the') end, case when strpos(lower(text), 'and') = 0 then 100000 else strpos(lower(text), 'and') end) - 1 end as off from fr)
  select path, start_off, case when off < 0 then page else (select max(p.page) from placed p where p.path = h.path and p.off <= h.start_off + h.off) end as page from h""".replace("'and'", "'tion'"))
def hit_pages(spark, sf_dir):
    """The page that the first query term of each fragment is on."""
    frags = model.fragments(spark, sf_dir)
    return frags.select("path", "start_off", pages.hit_page(F.col("page"), F.col("page_spans"), F.col("text"), '"the" OR tion*').alias("page"))


@query(f"with {_JOINED} select path, sha256(text) as digest, length(text) as chars from whole where length(text) > 0")
def document_text(spark, sf_dir):
    """Whole texts put together from overlapping windows."""
    return pages.document_text(model.fragments(spark, sf_dir)).select("path", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))


@query(f"""with {_JOINED}, q as (select *, coalesce(lag(end_off) over (partition by path order by start_off), 0) as c from fr where page between 2 and 3),
  z as (select path, start_off, substr(text, greatest(c - start_off, 0) + 1) as piece from q)
  select path, sha256(string_agg(piece, '' order by start_off)) as digest from z group by path""")
def document_range(spark, sf_dir):
    """What fragments that begin on pages 2 and 3 bring."""
    return pages.document_text(model.fragments(spark, sf_dir), 2, 3).select("path", F.sha2("text", 256).alias("digest"))


@query(f"""with {_JOINED}, z as (select path, page, start_off, substr(text, greatest(covered - start_off, 0) + 1) as piece from fr),
  g as (select path, page, string_agg(piece, '' order by start_off) as t from z group by path, page),
  u as (select *, coalesce(sum(length(t) + 2) over (partition by path order by page rows between unbounded preceding and 1 preceding), 0) as used, sum(length(t)) over (partition by path) as total from g)
  select path, page, sha256(case when total > 900 then substr(t, 1, cast(900 - used as integer)) else t end) as digest, total > 900 as truncated from u where total <= 900 or used < 900""")
def document_pages_capped(spark, sf_dir):
    """Pages of documents cut at 900 characters."""
    found = pages.document_text(model.fragments(spark, sf_dir), max_chars=900)
    return found.select("path", "truncated", F.explode("pages").alias("p")).select("path", "p.page", F.sha2("p.text", 256).alias("digest"), "truncated")


@query(f"""with {_JOINED}, piece as (
    select p.path, p.page, f.start_off, substr(f.body, greatest(p.off, f.start_off, f.covered) + 1, least(p.off + length(p.text) + 2, f.end_off) - greatest(p.off, f.start_off, f.covered)) as t
    from placed p join fr f on p.path = f.path and greatest(p.off, f.start_off, f.covered) < least(p.off + length(p.text) + 2, f.end_off)),
  slots as (select path, unnest(range(min(page), max(page) + 1)) as page from fr group by path union select path, page from piece)
  select s.path, s.page, sha256(coalesce(string_agg(t, chr(10) || chr(10) order by start_off), '')) as digest from slots s left join piece q on s.path = q.path and s.page = q.page group by s.path, s.page""")
def true_pages(spark, sf_dir):
    """Documents at the grain of their real pages, from windows that do not heed them."""
    return pages.true_pages(model.fragments(spark, sf_dir)).select("path", "page", F.sha2("text", 256).alias("digest"))


_SCORE = """facts as (select count(*) as n, avg(len(t)) as avgdl, {df} from k), sc as (select k.*, {score} as score from k, facts where {any})"""


def _bm25(tf: list[str]) -> str:
    df = ", ".join(f"sum(case when {t} > 0 then 1 else 0 end) as df{i}" for i, t in enumerate(tf))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * ({t}) * 2.2 / (({t}) + 1.2 * (0.25 + 0.75 * len(t) / avgdl))" for i, t in enumerate(tf))
    return _SCORE.format(df=df, score=score, any=" or ".join(f"({t}) > 0" for t in tf))


def _count(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


@query(f"""with {_JOINED}, k as (select path, start_off, page, text, {_TOKENS.format('text')} as t from fr), {_bm25([_count('the'), _count('that')])},
  best as (select *, case when strpos(lower(text), 'the') = 0 and strpos(lower(text), 'that') = 0 then -1 else
    least(case when strpos(lower(text), 'the') = 0 then 100000 else strpos(lower(text), 'the') end, case when strpos(lower(text), 'that') = 0 then 100000 else strpos(lower(text), 'that') end) - 1 end as off
    from sc order by score desc, path || '@' || start_off limit 20)
  select path || '@' || start_off as frag_id, path, 'p' || (cast(substr(path, 6) as integer) % 3) as title, round(score, 6) as score,
    case when off < 0 then page else (select max(p.page) from placed p where p.path = best.path and p.off <= best.start_off + best.off) end as page from best""")
def search_hits(spark, sf_dir):
    """The engine's search: fragments by BM25 with their document's title and the page of the hit."""
    return _engine(spark, sf_dir).search("the that", limit=20).select("frag_id", "path", "title", F.round("score", 6).alias("score"), "page")


def _engine(spark, sf_dir):
    from textloom.engine import Engine

    frags = model.fragments(spark, sf_dir)
    docs = model.pages(spark, sf_dir).groupBy("path").agg(F.count("*").alias("pages"))
    title = F.concat(F.lit("p"), F.regexp_extract("path", r"(\d+)", 1).cast("int") % 3)
    return Engine(spark, {"documents": docs.withColumn("title", title).withColumn("index", F.lit("main")), "fragments": frags})


@query(f"""with k as (select doc_id, {_TOKENS.format('text')} as t from documents),
  {_bm25([_count('that'), "len(list_filter(range(1, greatest(len(t), 1)), lambda i: t[i] = 'of' and t[i + 1] = 'the'))"])}
  select doc_id, round(score, 6) as score from sc order by sc.score desc, doc_id limit 10""")
def phrase_search(spark, sf_dir):
    """A query word that splits is a phrase: its tokens must follow each other."""
    hits = search.phrase_search(model.table(spark, sf_dir, "documents"), "doc_id", "text", "that of-the")
    return search.top(hits, "doc_id", 10).withColumn("score", F.round("score", 6))


@query(f"""with k as (select doc_id, lang as idx, {_TOKENS.format('text')} as t from documents), {_bm25([_count('that'), _count('idiot')])},
  r as (select *, row_number() over (partition by idx order by score desc, doc_id) - 1 as rank from sc qualify rank < 16)
  select idx as index, doc_id, round(score, 6) as score, round(1.0 / (60 + rank), 6) as fused from r order by 1.0 / (60 + rank) desc, idx, doc_id limit 8""")
def cross_index_search(spark, sf_dir):
    """Hits of several indexes by fused rank, with their own scores."""
    docs = model.documents(spark, sf_dir)
    hits = search.bm25(docs, "doc_id", "text", ["that", "idiot"]).join(docs.select("doc_id", "index"), "doc_id")
    found = search.across_indexes(hits, "doc_id", 8)
    return found.select("index", "doc_id", F.round("score", 6).alias("score"), F.round("fused", 6).alias("fused"))


@query("select lang as index, count(*) as documents from documents where starts_with(lang, 'e') or lang = 'fr' group by lang")
def selected_indexes(spark, sf_dir):
    docs = model.documents(spark, sf_dir)
    return docs.where(search.selected(F.col("index"), "e*, fr")).groupBy("index").agg(F.count("*").alias("documents"))


_COS = """list_dot_product(e.embedding::double[], q.embedding::double[]) / nullif(sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])), 0)"""


@query(f"""select vec_id as media_id, path, title, page, description, round(score, 6) as score from (
  select e.vec_id, 'doc/' || d.doc_id as path, d.source as title, cast(e.vec_id % 5 + 1 as integer) as page, 'figure ' || e.vec_id as description, coalesce({_COS}, 0) as score
  from embeddings e join documents d on d.doc_id = e.vec_id % 100, (select embedding from embeddings where vec_id = 3) q where e.vec_id % 3 <> 2 and starts_with('doc/' || d.doc_id, 'doc/1'))
  order by score desc, media_id limit 10""")
def figure_search(spark, sf_dir):
    """Figures by cosine, of the spaces that a text query can be held against."""
    vectors = model.table(spark, sf_dir, "embeddings")
    media = vectors.select(F.col("vec_id").alias("media_id"), F.concat(F.lit("doc/"), F.col("vec_id") % 100).alias("path"), (F.col("vec_id") % 5 + 1).cast("int").alias("page"), F.concat(F.lit("figure "), "vec_id").alias("description"))
    spaces = F.element_at(F.array(*map(F.lit, ("text", "image-aligned", "image"))), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = vectors.select(F.col("vec_id").alias("media_id"), spaces.alias("space"), F.col("embedding").alias("vector"))
    ask = vectors.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return search.figure_search(media, rows, model.documents(spark, sf_dir), ask, 10, "doc/1").withColumn("score", F.round("score", 6))


@query(f"""select e.vec_id as frag_id, 'doc/' || d.doc_id as path, d.source as title, round(coalesce({_COS}, 0), 6) as score
  from embeddings e join documents d on d.doc_id = e.vec_id, (select embedding from embeddings where vec_id = 5) q order by coalesce({_COS}, 0) desc, e.vec_id limit 10""")
def vector_hits(spark, sf_dir):
    """The nearest vectors with the documents they belong to."""
    vectors = model.table(spark, sf_dir, "embeddings")
    hits = search.cosine(vectors, "vec_id", "embedding", vectors.where("vec_id = 5").select(F.col("embedding").alias("q")))
    met = hits.join(model.documents(spark, sf_dir), F.col("vec_id") == F.col("doc_id")).withColumnRenamed("vec_id", "frag_id")
    return search.top(met, "frag_id", 10).select("frag_id", "path", "title", F.round("score", 6).alias("score"))


@query(r"""with m as (select 'conv/' || conv_id as path, turn, unnest(regexp_extract_all(m, '\[FIGURE:\s*([^\]]*)\]', 1)) as description, generate_subscripts(regexp_extract_all(m, '\[FIGURE:\s*([^\]]*)\]', 1), 1) as nth
    from (select conv_id, turn, '[FIGURE: a ' || regexp_replace(coalesce(text, ''), '[\[\]\s]+', ' ', 'g') || 'z] x [FIGURE:two]' as m from conversations))
  select path, description, cast(row_number() over (partition by path order by turn, nth) - 1 as integer) as ord from m""")
def figure_marks(spark, sf_dir):
    """Every figure mark of a document, numbered through it; a turn's whole text is one's description."""
    told = F.regexp_replace("text", r"[\[\]\s]+", " ")
    marked = model.pages(spark, sf_dir).select("path", "page", F.lit(0).alias("ord"), F.concat("path", F.lit("@"), "page").alias("frag_id"), F.concat(F.lit("[FIGURE: a "), told, F.lit("z] x [FIGURE:two]")).alias("text"), F.lit("").alias("origin"))
    return pages.figure_rows(marked).select("path", "description", "ord")


# ---------------------------------------------------------------- transcripts and recognised words


@query(f"with {_PAGES} select path, page, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as digest from pg")
def transcript_pages(spark, sf_dir):
    """Transcripts written and parsed again: the pages are what they were."""
    return transcripts.parse(transcripts.render(model.pages(spark, sf_dir))).select("path", "page", F.sha2("text", 256).alias("digest"))


@query(r"""with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from conversations)
  select conv_id, turn, sha256(array_to_string(list_transform(range(1, len(ws) + 1), lambda i: case when i = 1 then '' when (i - 1) // 5 = (i - 2) // 5 then ' ' else chr(10) end || ws[i]), '')) as digest,
    len(ws) as words, round(case when len(ws) > 0 then list_avg(list_transform(range(1, len(ws) + 1), lambda i: 50 + i % 40)) / 100 else 0 end, 6) as confidence,
    case when len(ws) > 0 then cast(list_sort(list_transform(range(1, len(ws) + 1), lambda i: 8 + i % 9))[len(ws) // 2 + 1] as integer) else 0 end as glyph from w""")
def recognised_words(spark, sf_dir):
    """A recogniser's table of words put together to text, with mean confidence and median letter size."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    line = lambda x, i: F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), F.floor(i / 5).cast("string"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("40"), (F.lit(8) + (i + 1) % 9).cast("string"), (F.lit(50) + (i + 1) % 40).cast("string"), x)
    tsv = F.concat(F.lit("level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n4\t1\t1\t1\t1\t0\t0\t0\t1\t1\t-1\t\n5\t1\t1\t1\t0\t1\t0\t0\t9\t9\t-1\tlost\n"), F.array_join(F.transform(words, line), "\n"))
    rows = model.table(spark, sf_dir, "conversations").select("conv_id", "turn", transcripts.recognised(tsv).alias("r"))
    return rows.select("conv_id", "turn", F.sha2("r.text", 256).alias("digest"), "r.words", F.round("r.confidence", 6).alias("confidence"), "r.glyph")


@query("select user_id as path, case when a is null then 'new' when b is null then 'gone' else 'changed' end as change from (select user_id, max(event_id) filter (event_type in ('view', 'click')) as a, max(event_id) filter (event_type in ('view', 'signup')) as b from events group by user_id) where (a is not null or b is not null) and a is distinct from b")
def watched_changes(spark, sf_dir):
    """What a listing of a folder has that the last one had not: files as users, their times as the last of two kinds of events each."""
    events = model.table(spark, sf_dir, "events")
    side = lambda *kinds: events.where(F.col("event_type").isin(*kinds)).groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("modified"))
    return transcripts.changes(side("view", "click"), side("view", "signup"))


@query(f"""with {_JOINED} select f.path, count(*) as fragments, count(e.vec_id) as vectors from fr f left join embeddings e on f.start_off = 0 and e.vec_id = cast(substr(f.path, 6) as integer) group by f.path""")
def exported_documents(spark, sf_dir):
    """Documents as they are pooled: fragments in order with the vectors they have."""
    vectors = model.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("conv/"), F.col("vec_id"), F.lit("@0")).alias("frag_id"), F.col("embedding").alias("vector"))
    found = transcripts.exported(model.fragments(spark, sf_dir), vectors)
    return found.select("path", F.size("fragments").alias("fragments"), F.size(F.filter("fragments", lambda f: f["vector"].isNotNull())).alias("vectors"))


# ---------------------------------------------------------------- queue


@query(f"with {_JOBS} select state, count(*) as jobs from jb group by state")
def jobs_by_state(spark, sf_dir):
    return model.jobs(spark, sf_dir).groupBy("state").agg(F.count("*").alias("jobs"))


_RATE = "avg_ as (select avg(took / 1e9) as s from (select took from jb where state = 'done' order by begun + took desc limit 10))"


@query(f"with {_JOBS}, {_RATE} select count(*) filter (state = 'done') as done, count(*) filter (state = 'running') as running, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'error') as failed, round((select 60 / s from avg_), 6) as rate_per_min from jb")
def index_status(spark, sf_dir):
    """Jobs by state and the recent rate."""
    return queue.status(model.jobs(spark, sf_dir)).withColumn("rate_per_min", F.round("rate_per_min", 6))


@query(f"""with {_JOBS}, lanes as (select *, cast(substr(url, 4, 1) as integer) % 2 as lane from jb),
  a as (select lane, count(*) filter (state = 'done') as done, count(*) filter (state = 'error') as failed, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'running') as running from lanes group by lane),
  r as (select lane, 60 / avg(took / 1e9) as rate from (select * from lanes where state = 'done' qualify row_number() over (partition by lane order by begun + took desc) <= 10) group by lane)
  select cast(sum(done) as bigint) as done, cast(sum(running) as bigint) as running, cast(sum(pending) as bigint) as pending, cast(sum(failed) as bigint) as failed, round(max(rate), 6) as rate_per_min from a join r using (lane)""")
def status_of_all_indexes(spark, sf_dir):
    """The statuses of two indexes as one: counts add up, the rate is the better one."""
    jobs = model.jobs(spark, sf_dir).withColumn("lane", F.substring("url", 4, 1).cast("int") % 2)
    both = queue.status(jobs.where("lane = 0")).unionByName(queue.status(jobs.where("lane = 1")))
    return queue.status_of_all(both).withColumn("rate_per_min", F.round("rate_per_min", 6))


@query(f"with {_JOBS}, {_RATE}, p as (select id, url, state, row_number() over (order by case when state = 'running' then 0 else 1 end, id) as position from jb where state in ('pending', 'running')) select id, url, state, position, round(position * s, 4) as eta_seconds from p, avg_")
def active_jobs(spark, sf_dir):
    """Live jobs in order, with the time until each is done."""
    return queue.active(model.jobs(spark, sf_dir)).withColumn("eta_seconds", F.round("eta_seconds", 4))


_REQUESTS = "rq as (select '/d/' || (user_id + 100) || case when event_id % 5 = 0 then '.textloom-regions.json' when (user_id + 100) % 4 = 0 then '.pdf' else '.md' end as url, case when event_type = 'view' then 1 else 0 end as fresh, event_id as asked from events)"


@query(f"""with {_JOBS}, {_REQUESTS}, lv as (select url, max(fresh) as live from jb where state in ('pending', 'running') group by url),
  g as (select rq.url, rq.fresh, rq.asked, coalesce(lv.live, -1) as live, coalesce(max(rq.fresh) over (partition by rq.url order by rq.asked rows between unbounded preceding and 1 preceding), -1) as earlier
    from rq left join lv on rq.url = lv.url where not contains(rq.url, '.textloom-')),
  -- an earlier request of at least this freshness either went in or found a job as fresh
  n as (select * from g where live < fresh and earlier < fresh)
  select (select max(id) from jb) + row_number() over (order by asked) as id, url, fresh, asked as "at" from n""")
def enqueued_jobs(spark, sf_dir):
    """The jobs that a batch of requests adds to the queue."""
    events = model.table(spark, sf_dir, "events")
    suffix = F.when(F.col("event_id") % 5 == 0, ".textloom-regions.json").when((F.col("user_id") + 100) % 4 == 0, ".pdf").otherwise(".md")
    requests = events.select(F.concat(F.lit("/d/"), F.col("user_id") + 100, suffix).alias("url"), F.lit("").alias("title"), (F.col("event_type") == "view").cast("int").alias("fresh"), F.col("event_id").alias("at"))
    return queue.enqueued(model.jobs(spark, sf_dir), requests).select("id", "url", "fresh", "at")


@query(f"with {_JOBS} select id, url, state from jb where state <> 'pending' or id in (select min(id) from jb where state = 'pending' group by url)")
def deduped_jobs(spark, sf_dir):
    """The queue without repeated pending jobs; running and ended ones stay."""
    return queue.deduped(model.jobs(spark, sf_dir)).select("id", "url", "state")


_COMMANDS = "cm as (select event_id as id, case event_id % 6 when 0 then 'retry' when 1 then 'cancel' when 2 then 'forget' when 3 then 'abort' when 4 then 'complete' else 'fail' end as action from events where event_id % 5 = 0 or event_id % 7 = 0)"
_ALLOWED = "((action in ('retry', 'forget') and state in ('error', 'done')) or (action = 'cancel' and state = 'pending') or (action in ('abort', 'complete', 'fail') and state = 'running'))"


def _commands(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, ("retry", "cancel", "forget", "abort", "complete", "fail"))), (F.col("event_id") % 6 + 1).cast("int"))
    return model.table(spark, sf_dir, "events").where("event_id % 5 = 0 or event_id % 7 = 0").select(F.col("event_id").alias("id"), action.alias("action"), F.lit("told").alias("note"))


@query(f"""with {_JOBS}, {_COMMANDS}, m as (select jb.*, cm.action, coalesce({_ALLOWED}, false) as ok from jb left join cm on jb.id = cm.id)
  select id, case when ok then case action when 'retry' then 'pending' when 'complete' then 'done' else 'error' end else state end as state,
    case when ok and action in ('retry', 'complete') then '' when ok then 'told' when state = 'error' then 'failed' else '' end as error,
    case when ok and action = 'retry' then 0 when ok then 77 when state in ('done', 'error') then begun + took else 0 end as finished_at from m where not (ok and action in ('cancel', 'forget'))""")
def job_transitions(spark, sf_dir):
    """The queue after a batch of commands; those from a wrong state are void."""
    return queue.moved(model.jobs(spark, sf_dir), _commands(spark, sf_dir), 77).select("id", "state", "error", "finished_at")


@query(f"with {_JOBS}, {_COMMANDS} select cm.id, action, state from cm left join jb on jb.id = cm.id where not coalesce({_ALLOWED}, false)")
def refused_commands(spark, sf_dir):
    return queue.refused(model.jobs(spark, sf_dir), _commands(spark, sf_dir))


@query(f"with {_JOBS} select id, case when state = 'running' and owner_pid >= 3 then 'error' else state end as state, case when state = 'running' and owner_pid >= 3 then 'aborted: the worker is gone' when state = 'error' then 'failed' else '' end as error from jb")
def reclaimed_jobs(spark, sf_dir):
    """Running jobs of workers that are gone end as errors."""
    alive = spark.createDataFrame([(0,), (1,), (2,)], "owner_pid long")
    return queue.reclaimed(model.jobs(spark, sf_dir), alive, 9).select("id", "state", "error")


@query(f"with {_JOBS} select id, state, owner_pid from (select id, case when id = (select min(id) from jb where state = 'pending') then 'running' else state end as state, case when id = (select min(id) from jb where state = 'pending') then 4242 else owner_pid end as owner_pid from jb) where state = 'running'")
def claimed_job(spark, sf_dir):
    """Running jobs once the oldest pending one is claimed."""
    return queue.claimed(model.jobs(spark, sf_dir), 4242, 5).where("state = 'running'").select("id", "state", F.col("owner_pid").cast("long").alias("owner_pid"))


_RETRIES = """rt as (select user_id as job_id, event_id as seq, case event_type when 'error' then '5xx' when 'view' then '429' when 'click' then 'recovered' when 'signup' then 'transport' else 'gave-up' end as kind,
  event_id % 7 as delay, event_id % 11 as elapsed, case when event_type in ('error', 'view') then 429 + event_id % 80 else 0 end as status, 'body ' || event_id as body, event_id % 4 as ahead from events)"""


@query(f"""with {_RETRIES}, g as (select job_id, count(*) filter (kind = '429') as n429, count(*) filter (kind = '5xx') as n5xx, count(*) filter (kind = 'transport') as unreachable, count(*) filter (kind = 'recovered') as recovered,
    count(*) filter (kind = 'gave-up') as gave_up, cast(sum(delay) as bigint) as waited, max(elapsed) as worst, arg_max(status || ' ' || body, seq) filter (kind <> 'recovered' and status > 0) as last, max(ahead) as ahead from rt group by job_id)
  select job_id, array_to_string(list_filter([case when n429 > 0 then n429 || '×429' || case when ahead > 0 then ' (up to ' || ahead || ' ahead)' else '' end end, case when n5xx > 0 then n5xx || '×5xx' end, case when unreachable > 0 then unreachable || '×unreachable' end,
    case when recovered > 0 then recovered || ' recovered' end, case when gave_up > 0 then gave_up || ' gave up' end], lambda x: x is not null), ', ') || case when waited > 0 then '; waited ' || waited || 's' else '' end || case when worst > 0 then ', worst call ' || worst || 's' else '' end || coalesce('; last: ' || last, '') as detail, worst from g
  where n429 + n5xx + unreachable + gave_up > 0""")
def retry_tallies(spark, sf_dir):
    """What a job's calls went through, as a stage's detail."""
    kinds = F.create_map(*(F.lit(x) for pair in {"error": "5xx", "view": "429", "click": "recovered", "signup": "transport", "purchase": "gave-up"}.items() for x in pair))[F.col("event_type")]
    events = model.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kinds.alias("kind"), (F.col("event_id") % 7).alias("delay"), (F.col("event_id") % 11).alias("elapsed"), F.when(F.col("event_type").isin("error", "view"), 429 + F.col("event_id") % 80).otherwise(0).alias("status"), F.concat(F.lit("body "), "event_id").alias("body"), (F.col("event_id") % 4).alias("ahead"))
    return queue.retry_tally(events).select("job_id", queue.retry_detail().alias("detail"), "worst")


@query("""with p as (select source as recipe_hash, sha256(text) as file_hash, doc_id as last_used_at, n_chars as bytes from documents where doc_id >= 100),
  r as (select *, sum(bytes) over (order by last_used_at desc) as total, row_number() over (order by last_used_at desc) as n from p) select last_used_at, bytes from r where total <= 300000 and n <= 400""")
def pool_kept(spark, sf_dir):
    """Pool entries that are young enough and the newest in bytes and number."""
    docs = model.table(spark, sf_dir, "documents")
    pool = docs.select(F.col("source").alias("recipe_hash"), F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("last_used_at"), F.col("n_chars").alias("bytes"))
    return queue.pool_retained(pool, 1100, 1000, 300_000, 400).select("last_used_at", "bytes")


@query("select count(*) as entries, count(distinct sha256(text)) as files, cast(sum(length(text)) as bigint) as chars from documents")
def pool_stats(spark, sf_dir):
    return model.documents(spark, sf_dir).agg(F.count("*").alias("entries"), F.count_distinct("content_hash").alias("files"), F.sum(F.length("text")).alias("chars"))


# ---------------------------------------------------------------- health

_INDEXED = """us as (select distinct user_id from events where user_id is not null),
  dx as (select '/d/' || user_id || case when user_id % 4 = 0 then '.pdf' when user_id % 13 = 5 then '.textloom-transcription.md' else '.md' end || case when user_id % 11 = 3 then '#p1-2' else '' end as path, user_id % 3 <> 0 as has_fragments, user_id % 8 <> 0 as has_pages, user_id from us),
  wd as (select '/d/' || user_id || case when user_id % 4 = 0 then '.pdf' else '.md' end as path from us where user_id % 17 = 1),
  fs as (select '/d/' || user_id || '.md' as path from us where user_id % 5 <> 0 union all select '/d/' || user_id || '.pdf' from us where user_id % 5 <> 0)"""


@query(f"""with {_JOBS}, {_INDEXED},
  p as (select 1 as rank, 'no-fragments' as kind, path as subject, 0 as job_id, '' as stage from dx where not contains(path, '#p') and not has_fragments
  union all select 2, 'generated-indexed', path, 0, '' from dx where path like '%.textloom-transcription.md'
  union all select 3, 'missing-file', path, 0, '' from dx where not contains(path, '#p') and path not like '%.textloom-transcription.md' and path not in (select path from wd) and path not in (select path from fs)
  union all select 4, 'no-pages', path, 0, '' from dx where path like '%.pdf' and not has_pages
  union all select 5, 'job-failed', url, id, coalesce((select name from st where job_id = jb.id and st.state = 'error' order by seq desc limit 1), '') from jb where state = 'error'
    and url not in (select path from dx where has_fragments) and url not in (select path from wd) and url in (select path from fs)
  union all select 6, 'segment-degraded', url, id, name from st join jb on jb.id = st.job_id where st.state = 'degraded'
  union all select 7, 'llm-retries', url, id, name from st join jb on jb.id = st.job_id where name = 'llm-retries' and st.state = 'warn'
  union all select 8, 'withdrawn', path, 0, '' from wd)
  select rank, kind, subject, job_id, stage, case rank when 1 then 'ingest --fresh ' || subject when 2 then 'forget ' || subject when 3 then 'forget ' || subject when 4 then 'reread ' || subject when 5 then 'retry --match ' || subject when 6 then 'reread ' || subject else '' end as fix from p""")
def health_report(spark, sf_dir):
    """All eight kinds of problems, ranked."""
    docs = model.indexed(spark, sf_dir)
    users = model.table(spark, sf_dir, "events").select("user_id").where("user_id % 5 <> 0").distinct()
    files = users.select(F.explode(F.array(F.concat(F.lit("/d/"), "user_id", F.lit(".md")), F.concat(F.lit("/d/"), "user_id", F.lit(".pdf")))).alias("path"))
    found = health.problems(docs.select("path"), docs.where("has_fragments").select("path"), docs.where("has_pages").select("path"), model.jobs(spark, sf_dir), model.job_stages(spark, sf_dir), model.withdrawals(spark, sf_dir), files)
    return found.select("rank", "kind", "subject", "job_id", "stage", "fix")


# ---------------------------------------------------------------- readings, marks, slices, captions


@query(f"with {_VERSIONS} select path, page, seq, version, person, active from va")
def reading_versions(spark, sf_dir):
    """Readings that are versions, and the one that holds each page's seat."""
    return records.versions(model.readings(spark, sf_dir)).select("path", "page", "seq", "version", "person", "active")


@query(f"with {_PAGES}, {_VERSIONS} select pg.path, pg.page, sha256(case when va.person then va.text else pg.text end) as digest, coalesce(va.person, false) as corrected from pg left join va on pg.path = va.path and pg.page = va.page and va.active and va.person")
def corrected_pages(spark, sf_dir):
    """Pages with a person's reading in place of the text."""
    found = records.corrected_pages(model.pages(spark, sf_dir), model.readings(spark, sf_dir))
    return found.select("path", "page", F.sha2("text", 256).alias("digest"), "corrected")


@query(f"with {_PAGES}, {_VERSIONS} select pg.path, sha256(string_agg(case when trim(coalesce(va.text, '')) <> '' then va.text else pg.text end, chr(10) || chr(10) order by pg.page)) as digest from pg left join va on pg.path = va.path and pg.page = va.page and va.active group by pg.path")
def caption_sources(spark, sf_dir):
    """What captions are written from: active readings, else indexed text."""
    found = records.caption_source(model.pages(spark, sf_dir), model.readings(spark, sf_dir))
    return found.select("path", F.sha2("text", 256).alias("digest"))


@query(f"with {_READINGS} select path, page, max(seq) + 1 as next_seq from rd group by path, page")
def next_reading_numbers(spark, sf_dir):
    return records.next_versions(model.readings(spark, sf_dir))


_MARKS = "mk as (select least(user_id % 60, event_id % 50) as a, greatest(user_id % 60, event_id % 50) as b, case event_id % 3 when 0 then 'copy' when 1 then 'version' else 'unrelated' end as kind, event_id as seq from events)"


def _marks(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, records.MARKS)), (F.col("event_id") % 3 + 1).cast("int"))
    return model.table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("a"), (F.col("event_id") % 50).alias("b"), kind.alias("kind"), F.lit("").alias("supersedes"), F.col("event_id").alias("seq"))


@query(f"with {_MARKS} select a, b, arg_max(kind, seq) as kind, max(seq) as seq from mk group by a, b")
def latest_marks(spark, sf_dir):
    """The last mark of each unordered pair."""
    return records.marks(_marks(spark, sf_dir)).select("a", "b", "kind", "seq")


@query(f"with {_MARKS} select distinct least(user_id, event_id % 150) as a, greatest(user_id, event_id % 150) as b from events where (least(user_id, event_id % 150), greatest(user_id, event_id % 150)) not in (select (a, b) from mk)")
def unmarked_pairs(spark, sf_dir):
    """Pairs that nobody ruled on, once each."""
    pairs = model.table(spark, sf_dir, "events").select(F.col("user_id").alias("a"), (F.col("event_id") % 150).alias("b"))
    return records.unmarked(pairs, _marks(spark, sf_dir))


@query("""select event_id, case when a = '' or b = '' then 'a mark needs both sides' when a = b then 'one document is no pair' when kind not in ('copy', 'version', 'unrelated') then 'unknown kind'
    when s <> '' and kind <> 'version' then 'only a version supersedes' when s <> '' and s <> a and s <> b then 'supersedes none of the pair' end as fault
  from (select event_id, case when event_id % 11 = 0 then '' else 'd' || user_id % 7 end as a, 'd' || event_id % 7 as b, case event_id % 4 when 0 then 'copy' when 1 then 'version' when 2 then 'unrelated' else event_type end as kind,
    case when event_id % 3 = 0 then 'd' || event_id % 5 else '' end as s from events)""")
def mark_faults(spark, sf_dir):
    """What is wrong with marks of pairs."""
    events = model.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 3, F.col("event_type")).otherwise(F.element_at(F.array(*map(F.lit, records.MARKS)), (F.col("event_id") % 4 % 3 + 1).cast("int")))
    a = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("d"), F.col("user_id") % 7))
    rows = events.select("event_id", a.alias("a"), F.concat(F.lit("d"), F.col("event_id") % 7).alias("b"), kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), F.col("event_id") % 5)).otherwise("").alias("s"))
    return rows.select("event_id", records.mark_fault(F.col("a"), F.col("b"), F.col("kind"), F.col("s")).alias("fault"))


_SLICES = "sl as (select distinct user_id as parent, cast(event_id % 6 + 1 as integer) as low, cast(event_id % 6 + event_id % 4 as integer) as high from events where event_id % 5 = 0)"


def _slices(spark, sf_dir):
    events = model.table(spark, sf_dir, "events").where("event_id % 5 = 0")
    return events.select(F.col("user_id").alias("parent"), (F.col("event_id") % 6 + 1).cast("int").alias("low"), (F.col("event_id") % 6 + F.col("event_id") % 4).cast("int").alias("high")).distinct()


@query(f"""with {_SLICES}, pp as (select distinct user_id as parent, cast(user_id % 9 as integer) as pages from events), e as (select parent, pages, unnest(range(1, pages + 1)) as page from pp),
  n as (select e.*, (select count(*) from sl where sl.parent = e.parent and page between low and high) as n from e)
  select parent, pages, count(*) filter (n > 0) as covered, coalesce(string_agg(cast(page as varchar), ' ' order by page) filter (n = 0), '') as uncovered, coalesce(string_agg(page || 'x' || n, ' ' order by page) filter (n > 1), '') as overlaps from n group by parent, pages""")
def slice_coverage(spark, sf_dir):
    """How slices cover their parents' pages."""
    parents = model.table(spark, sf_dir, "events").select(F.col("user_id").alias("parent"), (F.col("user_id") % 9).cast("int").alias("pages")).distinct()
    found = records.slice_coverage(parents, _slices(spark, sf_dir))
    text = lambda c, f: F.array_join(F.transform(c, f), " ").alias(c)
    return found.select("parent", "pages", "covered", text("uncovered", lambda x: x.cast("string")), text("overlaps", lambda x: F.concat(x["page"].cast("string"), F.lit("x"), x["n"].cast("string"))))


@query(f"""with {_PAGES}, {_SLICES} select 'conv/' || parent || '#p' || low || '-' || high as path, parent || ' p' || low || '-' || high as title, page, sha256(text) as digest
  from sl join pg on pg.path = 'conv/' || parent and page between low and high where trim(regexp_replace(text, '\\s', '', 'g')) <> ''""")
def slice_fragments(spark, sf_dir):
    """Slices as documents, a fragment a page that is not blank."""
    slices = _slices(spark, sf_dir).select(F.concat(F.lit("conv/"), "parent").alias("parent"), "low", "high", F.lit("").alias("title"))
    return records.slice_fragments(model.pages(spark, sf_dir), slices).select("path", "title", "page", F.sha2("text", 256).alias("digest"))


@query(r"""with t as (select page_id, p, regexp_replace(trim(p), '^p', '') as q from (select page_id, ['7', 'p3-9', '9-3', ' 2 - 4', 'x', '0', 'p12', '4-'][page_id % 8 + 1] as p from pages)),
  u as (select page_id, regexp_extract(q, '^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$', 1) as a, regexp_extract(q, '^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$', 2) as b from t),
  v as (select page_id, try_cast(nullif(a, '') as integer) as low, try_cast(coalesce(nullif(b, ''), nullif(a, '')) as integer) as high from u)
  select page_id, case when low >= 1 and high >= low then low end as low, case when low >= 1 and high >= low then high end as high, case when low >= 1 and high >= low then 'd' || page_id else '' end as parent from v""")
def page_ranges(spark, sf_dir):
    """Page ranges as people write them, and slice paths and back."""
    given = F.element_at(F.array(*map(F.lit, ("7", "p3-9", "9-3", " 2 - 4", "x", "0", "p12", "4-"))), (F.col("page_id") % 8 + 1).cast("int"))
    rows = model.table(spark, sf_dir, "pages").select("page_id", T.page_range(given).alias("r"))
    child = T.child_path(F.concat(F.lit("d"), "page_id"), F.col("r.low"), F.col("r.high"))
    return rows.select("page_id", "r.low", "r.high", F.coalesce(T.child_parent(child), F.lit("")).alias("parent"))


_CAPTIONS = f"cp as (select 'doc/' || doc_id as path, case when doc_id % 4 = 0 then '' else 'name ' || doc_id end as name, case when doc_id % 3 = 0 then 'person' else 'machine' end as source, case when doc_id % 5 = 0 then 'old' else sha256({_FLAT.format('text')}) end as text_hash, text, doc_id from documents)"


@query(f"""with {_CAPTIONS}, w as (select path, doc_id, case when trim(name) = '' then case when {_CONTENT.format('text')} >= 200 then 'missing' end when source <> 'person' and text_hash <> sha256({_FLAT.format('text')}) then 'stale' end as why from cp)
  select path, why from w where why is not null and doc_id % 7 <> 0""")
def caption_todo(spark, sf_dir):
    """Documents that need a caption, or whose machine caption is of another text by now."""
    docs = model.documents(spark, sf_dir)
    captions = docs.select("path", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("name "), "doc_id")).alias("name"), F.when(F.col("doc_id") % 3 == 0, "person").otherwise("machine").alias("source"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(T.identity_hash(F.col("text"))).alias("text_hash"))
    jobs = docs.where("doc_id % 7 = 0").select("path", F.lit("skipped").alias("state"))
    return records.caption_todo(docs.select("path"), captions, jobs, docs.select("path", "text"))


@query(f"""with k as (select conv_id, turn, {_FLAT.format('text')} as name, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as told, [' Deed.', 'lease', 'E-Mail', 'nonsense', '', 'Record of Survey', 'OTHER'][turn % 7 + 1] as kind from conversations),
  n as (select *, case lower(trim(kind)) when 'deed.' then 'deed' when 'lease' then 'agreement' when 'e-mail' then 'correspondence' when 'record of survey' then 'survey' when 'other' then 'other' end as norm from k)
  select conv_id, turn, norm as kind, case when name = '' then 'name is empty' when length(name) > 200 then 'name is too long' when length(told) < 40 then 'summary says nothing' when length(told) > 2500 then 'summary is too long' when norm is null then 'kind is unknown' end as fault from n""")
def caption_faults(spark, sf_dir):
    """What is wrong with captions, and their kinds by any of their names."""
    given = F.element_at(F.array(*map(F.lit, (" Deed.", "lease", "E-Mail", "nonsense", "", "Record of Survey", "OTHER"))), (F.col("turn") % 7 + 1).cast("int"))
    text = F.col("text")
    return model.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normal_kind(given).alias("kind"), T.caption_fault(text, text, given).alias("fault"))


@query(f"""with {_CAPTIONS} select path, sha256('[what this document is — a description, ' || case when source = 'person' then 'recorded by a person' else 'generated by m1' end || '; NOT the document''s own words]' || chr(10) || 'NAME: ' || name || chr(10) || 'KIND: notes' || chr(10)) as digest from cp where name <> ''""")
def caption_fragments(spark, sf_dir):
    """Captions as fragments of their own origin."""
    docs = model.documents(spark, sf_dir).where("doc_id % 4 <> 0")
    captions = docs.select("path", F.concat(F.lit("name "), "doc_id").alias("name"), F.lit("").alias("summary"), F.lit("notes").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "person").otherwise("machine").alias("source"), F.lit("m1").alias("model"))
    return records.caption_fragments(captions).select("path", F.sha2("text", 256).alias("digest"))


@query(f"""with {_JOINED}, ex as (select path, sum({_CONTENT.format('text')}) as emitted, page from fr where start_off % 1200 <> 400 group by path, page),
  q as (select pg.path, pg.page, {_CONTENT.format('pg.text')} as given, coalesce(emitted, 0) as emitted from pg left join ex on pg.path = ex.path and pg.page = ex.page),
  r as (select *, cast(emitted + case when emitted > 0 then 0 else coalesce(greatest(lag(emitted - given) over (partition by path order by page), 0), 0) end as bigint) as kept from q)
  select path, page, given, kept from r where given >= 200 and kept * 100 < given * 60""")
def segment_alarms(spark, sf_dir):
    """Pages of which the fragments keep too little."""
    frags = model.fragments(spark, sf_dir).where("start_off % 1200 <> 400")
    return records.segment_alarms(model.pages(spark, sf_dir), frags)


@query(f"""with {_JOINED}, ex as (select path, sum({_CONTENT.format('text')}) as emitted, page from fr where start_off % 1200 <> 400 group by path, page),
  q as (select pg.path, pg.page, {_CONTENT.format('pg.text')} as given, coalesce(emitted, 0) as emitted from pg left join ex on pg.path = ex.path and pg.page = ex.page),
  r as (select *, cast(emitted + case when emitted > 0 then 0 else coalesce(greatest(lag(emitted - given) over (partition by path order by page), 0), 0) end as bigint) as kept from q),
  al as (select distinct path from r where given >= 200 and kept * 100 < given * 60)
  select path, start_off, sha256(text) as digest, 'windows' as mode from fr where path in (select path from al)
  union all select path, start_off, sha256(text), 'segments' from fr where start_off % 1200 <> 400 and path not in (select path from al)""")
def fallback_fragments(spark, sf_dir):
    """Segments of documents of which they keep enough, windows of the others."""
    rows, windows = model.pages(spark, sf_dir), model.fragments(spark, sf_dir)
    found = records.whole_or_windows(rows, windows.where("start_off % 1200 <> 400"), windows)
    return found.select("path", "start_off", F.sha2("text", 256).alias("digest"), "mode")


@query(f"""with {_JOINED}, pv as (select path, page, case when page % 3 = 0 then 'vision' when page % 3 = 1 then 'text' else 'cheap' end as engine from pg)
  select d.path, 't' as title, coalesce(f.n, 0) as fragments, p.pages, p.vision_pages, p.engines from (select distinct path from pg) d left join (select path, count(*) as n from fr group by path) f on d.path = f.path
  join (select path, count(*) as pages, count(*) filter (engine = 'vision') as vision_pages, array_to_string(list_filter(['cheap×' || nullif(count(*) filter (engine = 'cheap'), 0), 'text×' || nullif(count(*) filter (engine = 'text'), 0), 'vision×' || nullif(count(*) filter (engine = 'vision'), 0)], lambda x: x is not null), ', ') as engines from pv group by path) p on d.path = p.path""")
def listed_documents(spark, sf_dir):
    """Documents with their fragments, pages and engines."""
    rows = model.pages(spark, sf_dir)
    engine = F.element_at(F.array(*map(F.lit, ("vision", "text", "cheap"))), F.col("page") % 3 + 1)
    found = records.summaries(rows.select("path", F.lit("t").alias("title")).distinct(), model.fragments(spark, sf_dir), rows.select("path", "page", engine.alias("engine")))
    engines = F.array_join(F.transform(F.map_entries("engines"), lambda e: F.concat(e["key"], F.lit("×"), e["value"].cast("string"))), ", ")
    return found.select("path", "title", "fragments", "pages", "vision_pages", engines.alias("engines"))


@query(f"with {_JOINED} select pg.path, pg.page, 'e' || pg.page % 2 as engine, sha256(coalesce((select string_agg(fr.text, chr(10) || chr(10) order by start_off) from fr where fr.path = pg.path and fr.page = pg.page), '')) as digest from pg")
def page_review(spark, sf_dir):
    """Each page's engine and the fragments that begin on it."""
    rows = model.pages(spark, sf_dir).select("path", "page", F.concat(F.lit("e"), F.col("page") % 2).alias("engine"))
    return pages.page_review(model.fragments(spark, sf_dir), rows).select("path", "page", "engine", F.sha2("text", 256).alias("digest"))


@query("""select doc_id, source from documents where doc_id % 5 = 1 union all select doc_id, 'm' from documents where doc_id % 5 <> 1 and doc_id % 7 <> 2 and doc_id % 3 = 0
  union all select doc_id, 'r' from documents where doc_id % 5 <> 1 and doc_id % 7 <> 2 and doc_id % 3 <> 0 and doc_id % 11 <> 4""")
def layered_branches(spark, sf_dir):
    """A branch over a branch over the main index."""
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "source")
    name = lambda rows, x: rows.select("doc_id", F.lit(x).alias("source"))
    return records.layered([(docs.where("doc_id % 5 = 1"), docs.where("doc_id % 7 = 2")), (name(docs.where("doc_id % 3 = 0"), "m"), docs.where("doc_id % 11 = 4")), (name(docs, "r"), None)], "doc_id")


@query("select doc_id, source from documents where doc_id % 4 <> 0 union all select doc_id, 'fresh' from documents where doc_id % 4 = 0")
def replaced_documents(spark, sf_dir):
    """Documents with some swapped for new versions, twice over."""
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "source")
    fresh = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("fresh").alias("source"))
    return records.replaced(records.replaced(docs, fresh, "doc_id"), fresh, "doc_id")


@query(f"""with nm as (select distinct 'x/' || item_id % 3 || '/' || w as path, w from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) as w from benchmark))
  select nm.path as cited, 'conv/' || conv_id as path, cast(turn + 1 as integer) as page,
  sha256({_FLAT.format("substr(text, greatest(strpos(lower(text), w) - 80, 1), strpos(lower(text), w) + length(w) + 80 - greatest(strpos(lower(text), w) - 80, 1))")}) as excerpt from conversations, nm where contains(lower(text), w)""")
def citations(spark, sf_dir):
    """Texts that name a withdrawn document: the long words of benchmark passages stand for names, some in several folders."""
    words = model.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0)).alias("w"))
    names = words.select(F.concat(F.lit("x/"), F.col("item_id") % 3, F.lit("/"), "w").alias("path"))
    return records.citations(names, model.pages(spark, sf_dir)).withColumn("excerpt", F.sha2("excerpt", 256))


@query("""with p as (select conv_id, turn, upper(text) as t, upper(lead(text) over (partition by conv_id order by turn)) as want from conversations),
  w as (select conv_id, turn, list_transform(range(1, length(want) - 3), lambda i: substr(want, i, 5)) as ws, list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) as ts from p)
  select conv_id, turn, round(case when len(ws) > 0 then len(list_filter(ws, lambda x: list_contains(ts, x))) / len(ws) else 0 end, 6) as share from w""")
def expected_shares(spark, sf_dir):
    """How much of what the next turn says is in a turn, by windows of five characters."""
    turns = model.table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("want", following).select("conv_id", "turn", F.round(R.expected_share(F.col("text"), F.col("want")), 6).alias("share"))


@query("select path, state from (select 'doc/' || doc_id as path, case doc_id % 4 when 0 then 'pending' when 1 then 'done' when 2 then 'error' else 'skipped' end as state, n_chars % 50 as queued from documents) where state = 'error' order by queued desc, path limit 40")
def caption_jobs_by_state(spark, sf_dir):
    """The latest caption jobs that ended in an error."""
    docs = model.documents(spark, sf_dir)
    state = F.element_at(F.array(*map(F.lit, ("pending", "done", "error", "skipped"))), (F.col("doc_id") % 4 + 1).cast("int"))
    jobs = docs.select("path", state.alias("state"), (F.col("n_chars") % 50).alias("enqueued_at"))
    return records.caption_jobs_in(jobs, "error", 40).select("path", "state")


# ---------------------------------------------------------------- attestations


@query(f'with {_RULINGS} select path, unit, kind, swept, ruler as "by", sha256(text) as digest from state')
def attestation_state(spark, sf_dir):
    """Where each unit stands after the log of rulings."""
    return attest.states(model.units(spark, sf_dir), model.rulings(spark, sf_dir)).select("path", "unit", "kind", "swept", "by", F.sha2("text", 256).alias("digest"))


@query(f"with {_RULINGS} select path, unit, seq, kind from rl where not blanket and (path, unit) not in (select (path, unit) from un)")
def attestation_orphans(spark, sf_dir):
    """Rulings on units that are not there."""
    return attest.orphans(model.units(spark, sf_dir), model.rulings(spark, sf_dir)).select("path", "unit", "seq", "kind")


_STATS = f"""{_RULINGS}, ss as (select s.path, count(*) as total, count(*) filter (kind = 'confirmed') as confirmed, count(*) filter (kind = 'corrected') as corrected, count(*) filter (kind = 'affirmed') as affirmed,
    count(*) filter (kind = 'unclear') as unclear, count(*) filter (kind = 'unsupported') as unsupported, count(*) filter (kind = '') as untouched,
    (select count(*) from rl where rl.path = s.path and not blanket and (path, unit) not in (select (path, unit) from un)) as orphaned,
    (select case when arg_max(kind, seq) = 'affirmed' then arg_max(who, seq) end from rl where rl.path = s.path and blanket) as swept_by,
    (select case when arg_max(kind, seq) = 'affirmed' then arg_max(statement, seq) end from rl where rl.path = s.path and blanket) as statement,
    (select case when arg_max(kind, seq) = 'affirmed' then 'day ' || max(seq) end from rl where rl.path = s.path and blanket) as swept_at from state s group by s.path)"""


@query(f"with {_STATS} select path, total, confirmed, corrected, affirmed, unclear, unsupported, untouched, orphaned, swept_by, statement from ss")
def ruling_stats(spark, sf_dir):
    """Units by ruling, a row a document."""
    return attest.stats(model.units(spark, sf_dir), model.rulings(spark, sf_dir)).select("path", "total", *attest.KINDS, "untouched", "orphaned", "swept_by", "statement")


@query(f"""with {_STATS}, x as (select *, confirmed + corrected + unclear + unsupported as one from ss)
  select path, case when untouched = 0 then 'Review complete: ' || array_to_string(list_filter([case when one > 0 then one || ' checked one by one' end, case when affirmed > 0 then affirmed || ' accepted by affirmation' end], lambda q: q is not null), ', ') || ' of ' || total || ' units.'
      || case when affirmed = 0 then '' when coalesce(statement, '') <> '' then ' It reads: "' || statement || '" by ' || swept_by || ' on ' || swept_at || '.' else ' Its terms were not recorded.' end
    else 'Review incomplete: ' || one || ' checked one by one, ' || affirmed || ' accepted by affirmation, ' || untouched || ' of ' || total || ' units untouched.' end
    || case when corrected = 0 then ' No words were corrected by a person.' else ' Words corrected by a person in ' || corrected || ' of ' || total || ' units.' end
    || case when orphaned > 0 then ' ' || orphaned || ' rulings match no unit and are not counted.' else '' end as sentence from x
  union all select distinct path, 'No reading of this document by a machine is recorded.' from rl where path not in (select path from un)""")
def provenance_sentences(spark, sf_dir):
    """What must stand beside anything derived from a document."""
    log = model.rulings(spark, sf_dir).withColumn("at", F.concat(F.lit("day "), "seq"))
    found = attest.stats(model.units(spark, sf_dir), log)
    return attest.provenance(found, log.select("path").unionByName(found.select("path")))


@query("""with f as (select conv_id, turn, 'conv/' || conv_id as p, cast(turn * 10 as varchar) as a, cast(turn * 10 + length(text) as varchar) as b, role as l, text as t from conversations)
  select conv_id, turn, 'b' || a || '-' || substr(sha256('parent:' || strlen(p) || ':' || p || 'span.from:' || strlen(a) || ':' || a || 'span.to:' || strlen(b) || ':' || b || 'label:' || strlen(l) || ':' || l || 'text:' || strlen(t) || ':' || t || 'evidence:0:'), 1, 16) as unit from f""")
def unit_ids(spark, sf_dir):
    """Content addresses of units located by spans."""
    rows = model.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", attest.span_unit_id(F.concat(F.lit("conv/"), "conv_id"), F.col("turn") * 10, F.col("turn") * 10 + F.length("text"), F.col("role"), F.col("text")).alias("unit"))


@query("""select event_id, case when kind not in ('confirmed', 'corrected', 'affirmed', 'unclear', 'unsupported', 'retract', 'resegment') then 'unknown kind' when who = '' then 'no author'
    when kind <> 'resegment' and blanket and kind not in ('affirmed', 'retract') then 'this kind cannot be blanket' when kind <> 'resegment' and not blanket and unit = '' then 'no unit' end as fault
  from (select event_id, case when event_id % 5 = 0 then 'affirmed' when event_id % 5 = 1 then 'confirmed' when event_id % 5 = 2 then 'resegment' else event_type end as kind, case when event_id % 13 = 0 then '' else 'p' end as who, event_id % 3 = 0 as blanket,
    case when event_id % 4 = 0 then '' else 'u' end as unit from events)""")
def ruling_faults(spark, sf_dir):
    """What is wrong with entries of a log of rulings."""
    events = model.table(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "affirmed").when(i % 5 == 1, "confirmed").when(i % 5 == 2, "resegment").otherwise(F.col("event_type"))
    return events.select("event_id", attest.fault(kind, F.when(i % 13 == 0, "").otherwise("p"), i % 3 == 0, F.when(i % 4 == 0, "").otherwise("u")).alias("fault"))


# ---------------------------------------------------------------- likeness


@query()
def similar_pairs(spark, sf_dir):
    """All similar pairs of documents, measured exactly; tested against a plain version."""
    docs = model.table(spark, sf_dir, "documents")
    found = similar.similar_pairs(docs, docs, "doc_id", "text", write=written)
    return found.select("a", "b", "relation", *(F.round(c, 6).alias(c) for c in ("jaccard", "a_in_b", "b_in_a", "a_cover", "b_cover")), "generic_chars", "matched_chars", F.size("blocks").alias("blocks"), F.array_join("only_in_a", " ").alias("only_in_a"), F.array_join("only_in_b", " ").alias("only_in_b"))


@query()
def similar_passages(spark, sf_dir):
    """Benchmark passages against all documents."""
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    probes = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    found = similar.similar_pairs(probes, docs, "doc_id", "text", least_chars=40, write=written)
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "relation", F.round("a_cover", 6).alias("a_cover"), F.round("b_cover", 6).alias("b_cover"), "matched_chars")


@query()
def masked_blocks(spark, sf_dir):
    """The aligned regions of all similar pairs, without what is generic."""
    docs = model.table(spark, sf_dir, "documents")
    found = similar.similar_pairs(docs, docs, "doc_id", "text", write=written)
    return found.select("a", "b", F.explode("blocks").alias("k")).select("a", "b", "k.a_from", "k.a_to", "k.b_from", "k.b_to", "k.runs", "k.matched_chars", F.size("k.gaps").alias("gaps"))


@query()
def ruling_proposals(spark, sf_dir):
    """What could be ruled about each similar pair, those that share generic shingles among them."""
    docs = model.table(spark, sf_dir, "documents")
    found = similar.similar_pairs(docs, docs, "doc_id", "text", write=written, crowds=True)
    told = similar.proposal(F.col("relation"), F.col("only_in_a"), F.col("only_in_b"), F.col("a_cover"), F.col("b_cover"), F.col("jaccard"), F.col("matched_chars"))
    return found.select("a", "b", told.alias("p")).select("a", "b", "p.kind", "p.why", "p.confident")


@query(r"""with folded as (select sha256(lower(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g'))) as h, doc_id, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) > 0 as has from documents)
  select doc_id, case when has then min(doc_id) over (partition by h) else doc_id end as first, case when has then count(*) over (partition by h) else 1 end as members from folded""")
def folded_classes(spark, sf_dir):
    """Documents with equal folded texts, under the first of them."""
    return similar.classes(model.table(spark, sf_dir, "documents"), "doc_id", "text")


_MATCHES = r"""bd as (select conv_id // 2 as pair, conv_id % 2 as side, cast(turn + 1 as integer) as page, lower(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) as b from conversations),
  sh as (select distinct pair, side, page, substr(b, cast(i as integer) + 1, 8) as g from (select *, unnest(range(0, length(b) - 7)) as i from bd where length(b) >= 8)),
  ht as (select a.pair, a.page as a_page, z.page as b_page, count(*) as hit from sh a join sh z on a.pair = z.pair and a.side = 0 and z.side = 1 and a.g = z.g group by all),
  mt as (select x.pair, x.page as a_page, coalesce(h.b_page, 0) as b_page, coalesce(h.hit / (select count(*) from sh where sh.pair = x.pair and side = 0 and sh.page = x.page), 0) as rate, length(x.b) as a_chars
    from bd x left join (select * from ht qualify row_number() over (partition by pair, a_page order by hit desc, b_page) = 1) h on h.pair = x.pair and h.a_page = x.page where x.side = 0)"""


def _matches(spark, sf_dir):
    turns = model.table(spark, sf_dir, "conversations").select(F.expr("conv_id div 2").alias("pair"), (F.col("conv_id") % 2).alias("side"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    return similar.page_matches(turns.where("side = 0").drop("side"), turns.where("side = 1").drop("side"), 8)


@query(f"with {_MATCHES} select pair, a_page, b_page, round(rate, 6) as rate, a_chars from mt")
def page_matches(spark, sf_dir):
    """Each page of one document with its best page of another."""
    return _matches(spark, sf_dir).select("pair", "a_page", "b_page", F.round("rate", 6).alias("rate"), "a_chars")


@query(f"with {_MATCHES} select pair, count(*) as pages, count(*) filter (b_page > 0 and rate >= 0.999) as clean, count(*) filter (b_page > 0 and rate >= 0.6 and rate < 0.999) as noisy, count(*) filter (b_page > 0 and rate > 0 and rate < 0.6) as divergent, count(*) filter (b_page = 0 or rate = 0) as missing from mt group by pair")
def diff_shapes(spark, sf_dir):
    """What kind of copy a document is of another, by its pages."""
    return similar.diff_shape(_matches(spark, sf_dir))


@query(r"""with n as (select doc_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda x: length(x) >= 2)) as t from documents)
  select a.doc_id, array_to_string(list_sort(list_filter(a.t, lambda x: not list_contains(b.t, x))), ' ') as only_a, array_to_string(list_sort(list_filter(b.t, lambda x: not list_contains(a.t, x))), ' ') as only_b
  from n a join n b on b.doc_id = a.doc_id + 1 where len(list_filter(a.t, lambda x: not list_contains(b.t, x))) + len(list_filter(b.t, lambda x: not list_contains(a.t, x))) > 0""")
def numeric_disagreements(spark, sf_dir):
    """Numbers that one of two neighbouring documents has and the other has not."""
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    met = docs.select("doc_id", F.col("text").alias("a")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id").where(T.numbers_differ(F.col("a"), F.col("b")))
    only = lambda x, y: F.array_join(F.array_sort(F.array_except(T.numeric_tokens(F.col(x)), T.numeric_tokens(F.col(y)))), " ")
    return met.select("doc_id", only("a", "b").alias("only_a"), only("b", "a").alias("only_b"))


@query("""select count(*) filter (doc_id % 3 = 0) as sketched, count(*) filter (doc_id % 3 = 1) as stale, count(*) filter (doc_id % 3 = 2) as unsketched, 2 * count(*) filter (doc_id % 3 = 0) as rows from documents""")
def sketch_status(spark, sf_dir):
    """Documents by their sketches: of this recipe, of another only, of none."""
    docs = model.documents(spark, sf_dir)
    now, old = T.sketch_recipe(32, 32), T.sketch_recipe(24, 32)
    rows = docs.where("doc_id % 3 = 0").select("path", F.explode(F.array(*map(F.lit, (now, now, old)))).alias("recipe")).unionByName(docs.where("doc_id % 3 = 1").select("path", F.lit(old).alias("recipe")))
    return similar.sketch_status(docs, rows, now)


# ---------------------------------------------------------------- texts and regions


@query(rf"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: replace(replace(upper({_FLAT.format('x')}), 'ß', 'SS'), 'ẞ', 'SS')), lambda x: strlen(x) > 3) as ls, text from documents)
  select doc_id, round(case when len(ls) > 0 then 1 - len(list_distinct(ls)) / len(ls) else 0 end, 6) as repetition, cast(coalesce(list_sum(list_transform(list_distinct(ls), lambda x: length(x))), 0) as bigint) as distinct_chars,
    sha256(case when regexp_replace(regexp_replace(text, '[0-9]+', '█', 'g'), '[█\s]', '', 'g') = '' then '' else regexp_replace(text, '[0-9]+', '█', 'g') end) as masked, cast(floor(strlen(text) * 0.5) as integer) + 16 as tokens from l""")
def reading_measures(spark, sf_dir):
    """How far a reading repeats itself, its text without digits, and its tokens at most."""
    text = F.col("text")
    return model.table(spark, sf_dir, "documents").select("doc_id", F.round(R.repetition(text), 6).alias("repetition"), R.distinct_length(text).cast("long").alias("distinct_chars"), F.sha2(T.spelling_mask(text), 256).alias("masked"), T.token_estimate(text).alias("tokens"))


@query("""with t as (select 'c' || conv_id as page_id, turn, role as region, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations), u as (select *, sum(length(t) + 2) over (partition by page_id order by turn) - 2 as z from t where t <> '')
  select page_id, sha256(string_agg(t, chr(10) || chr(10) order by turn)) as digest, string_agg(region || ':' || cast(z - length(t) as bigint) || '-' || cast(z as bigint), ' ' order by turn) as spans from u group by page_id""")
def region_transcripts(spark, sf_dir):
    """Regions' texts in order, and where each is in the whole."""
    rows = model.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("page_id"), F.col("turn").alias("seq"), F.col("role").alias("region"), "text")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["region"], F.lit(":"), s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), " ")
    return R.transcript(rows).select("page_id", F.sha2("text", 256).alias("digest"), spans.alias("spans"))


@query("""select page_id, case when starts_with(h, '255044462D') then 'pdf' when starts_with(h, '89504E470D0A1A0A') or starts_with(h, 'FFD8FF') or starts_with(h, '474946383961') or starts_with(h, '49492A00') then 'image' when starts_with(h, 'D0CF11E0A1B11AE1') then 'office' else 'unknown' end as kind,
    page_id % 9 in (4, 5, 6) as opaque from (select page_id, ['255044462D312E34', '89504E470D0A1A0A', 'FFD8FFE000104A46', '474946383961', '49492A0008', 'D0CF11E0A1B11AE1', '7F454C460201', '504B0304', '68656C6C6F'][page_id % 9 + 1] as h from pages)""")
def sniffed_files(spark, sf_dir):
    """Files by their first bytes: what they are, and whether they are nothing a reader takes."""
    marks = ("255044462D312E34", "89504E470D0A1A0A", "FFD8FFE000104A46", "474946383961", "49492A0008", "D0CF11E0A1B11AE1", "7F454C460201", "504B0304", "68656C6C6F")
    content = F.unhex(F.element_at(F.array(*map(F.lit, marks)), (F.col("page_id") % 9 + 1).cast("int")))
    return model.table(spark, sf_dir, "pages").select("page_id", T.sniffed_kind(content).alias("kind"), T.opaque(content).alias("opaque"))


@query(r"""with t as (select page_id, case when page_id % 3 = 0 then array_to_string(list_transform(range(1, 12), lambda i: ' ' || i || ' line ' || page_id), chr(10)) when page_id % 3 = 1 then array_to_string(list_transform(range(1, 6), lambda i: i || ' line'), chr(10)) else 'plain ' || page_id end as s from pages)
  select page_id, case when page_id % 3 = 0 then array_to_string(list_transform(range(1, 12), lambda i: ' line ' || page_id), chr(10)) else s end as text from t""")
def pleading_numbers(spark, sf_dir):
    """Line numbers of pleadings gone, where there are enough of them."""
    lines = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), f), "\n")
    page = F.col("page_id")
    text = F.when(page % 3 == 0, lines(11, lambda i: F.concat(F.lit(" "), i.cast("string"), F.lit(" line "), page.cast("string")))).when(page % 3 == 1, lines(5, lambda i: F.concat(i.cast("string"), F.lit(" line")))).otherwise(F.concat(F.lit("plain "), page.cast("string")))
    return model.table(spark, sf_dir, "pages").select("page_id", T.without_line_numbers(text).alias("text"))


@query(r"""with p as (select conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) as t from conversations where conv_id is not null and turn is not null group by conv_id),
  q as (select conv_id, regexp_replace(unnest(regexp_split_to_array(t, '\n[ \t\r]*\n[ \t\n\x0b\f\r]*')), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') as x from p)
  select conv_id, count(*) as paragraphs, cast(sum(length(x)) as bigint) as chars from q where x <> '' group by conv_id""")
def text_paragraphs(spark, sf_dir):
    """Paragraphs of texts, told apart by blank lines."""
    whole = pages.joined_pages(model.pages(spark, sf_dir).withColumn("path", F.regexp_extract("path", r"(\d+)", 1).cast("long")))
    rows = whole.select("path", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return rows.groupBy(F.col("path").alias("conv_id")).agg(F.count("*").alias("paragraphs"), F.sum(F.length("p.text")).alias("chars"))


# ---------------------------------------------------------------- lists, caption jobs, pools


_CAPTION_JOBS = "cj as (select user_id as path, arg_max(case event_type when 'error' then 'error' when 'view' then 'pending' when 'click' then 'running' when 'signup' then 'skipped' else 'done' end, event_id) as state, max(event_id) as enqueued_at from events where user_id % 3 <> 0 group by user_id)"


def _caption_jobs(spark, sf_dir):
    states = F.create_map(*(F.lit(x) for pair in {"error": "error", "view": "pending", "click": "running", "signup": "skipped", "purchase": "done"}.items() for x in pair))[F.col("event_type")]
    last = model.table(spark, sf_dir, "events").where("user_id % 3 <> 0").groupBy("user_id").agg(F.max_by(states, "event_id").alias("state"), F.max("event_id").alias("enqueued_at"))
    return last.select(F.col("user_id").cast("string").alias("path"), "state", F.lit(0).alias("force"), F.lit("").alias("error"), "enqueued_at", F.lit(0).cast("long").alias("owner_pid"))


@query(f"""with {_CAPTION_JOBS}, q as (select distinct user_id as path from events where user_id % 2 = 0)
  select cast(coalesce(cj.path, q.path) as varchar) as path, case when q.path is not null and coalesce(cj.state, '') not in ('pending', 'running') then 'pending' else cj.state end as state,
    case when q.path is not null and coalesce(cj.state, '') not in ('pending', 'running') then 77 else cj.enqueued_at end as enqueued_at from cj full join q on cj.path = q.path""")
def caption_queue(spark, sf_dir):
    """Caption jobs after a batch of requests: one a document, live ones untouched."""
    asked = model.table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("path"))
    return records.caption_enqueued(_caption_jobs(spark, sf_dir), asked, 77).select("path", "state", "enqueued_at")


@query(f"""with {_CAPTION_JOBS} select cast(path as varchar) as path, case when state = 'running' and path % 5 = 0 then 'skipped' when state = 'running' and path % 5 = 1 then 'error' when state = 'running' and path % 5 < 4 then 'done'
  when state = 'running' then 'pending' else state end as state from cj""")
def caption_results(spark, sf_dir):
    """Caption jobs after results came in; those of a worker that is gone are pending again."""
    jobs = _caption_jobs(spark, sf_dir)
    number = F.col("path").cast("long") % 5
    results = jobs.where(number < 4).select("path", F.when(number == 1, "bad answer").otherwise("").alias("error"), (number == 0).alias("short"))
    done = records.caption_finished(jobs, results).withColumn("finished_at", F.lit(0).cast("long"))
    return queue.reclaimed(done, spark.createDataFrame([(99,)], "owner_pid long"), 5, "pending").select("path", "state")


@query(f"with {_JOBS} select id, url from jb where state = 'error' order by id desc limit 25")
def failed_jobs(spark, sf_dir):
    return queue.listed(model.jobs(spark, sf_dir), "error", 25).select("id", "url")


@query(f"with {_PAGES} select pg.path, pg.page, case when page % 3 = 0 then '' else 'e' || page % 3 end as engine from pg")
def page_engines(spark, sf_dir):
    """The engine that read each page, if any."""
    rows = model.pages(spark, sf_dir)
    return records.engines_of(rows, rows.where("page % 3 <> 0").select("path", "page", F.concat(F.lit("e"), F.col("page") % 3).alias("engine")))


@query("""select source as recipe_hash, count(*) as hits, cast(sum(case when doc_id % 4 = 1 then 7 else doc_id end) as bigint) as used from documents group by source""")
def pool_lookups(spark, sf_dir):
    """Pool entries that were asked for are used now."""
    docs = model.table(spark, sf_dir, "documents")
    pool = docs.select(F.col("source").alias("recipe_hash"), F.col("doc_id").cast("string").alias("file_hash"), F.col("doc_id").alias("last_used_at"))
    _, touched = transcripts.pool_hits(pool, pool.where("file_hash % 4 = 1"), 7)
    return touched.groupBy("recipe_hash").agg(F.count("*").alias("hits"), F.sum("last_used_at").alias("used"))


@query("select count(*) filter (doc_id % 6 = 0) as again, count(*) filter (doc_id % 6 <> 0) as kept from documents")
def reread_marks(spark, sf_dir):
    """Documents marked for another ingest."""
    docs = model.documents(spark, sf_dir)
    marked = records.to_reread(docs, docs.where("doc_id % 6 = 0"))
    return marked.agg(F.count_if(F.col("content_hash") == "").alias("again"), F.count_if(F.col("content_hash") != "").alias("kept"))


@query(r"""with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from documents)
  select a.doc_id, len(list_intersect(a.w, b.w)) as common, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) as either, len(a.w) - len(list_intersect(a.w, b.w)) as only_a from t a join t b on b.doc_id = a.doc_id + 1""")
def token_sets(spark, sf_dir):
    """Words that neighbouring documents share, that either has, and that only the first has."""
    words = model.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("a"))
    met = words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return met.select("doc_id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_a"))


@query(f"""with {_PAGES}, l as (select *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls from pg where not contains(text, '> **')),
  w as (select path, page, case when len(ls) = 0 then '' when len(ls) >= 4 and list_avg(list_transform(ls, lambda x: length(trim(x)))) < 6 then 'short-lines' when {_CONTENT.format('text')} < 220 then 'thin' else '' end as why from l)
  select path, page, why from w where why <> ''""")
def suspect_pages(spark, sf_dir):
    """Pages that do not look like text."""
    return transcripts.suspect_pages(model.pages(spark, sf_dir))
