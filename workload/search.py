"""As-of filters, vector and full-text search, fusion, fallback, reranking, tiers."""

from dataclasses import replace

from pyspark.sql import functions as F

from provenant.functions.text import tokenize
from provenant.operators import lexical, postings, retrieval, revisions, vector_index, vectors
from provenant.plans.session import stored
from provenant.settings import Settings
from workload.base import query
from workload.corpus import CHUNK_SQL, doc_chunks

SETTINGS = Settings()
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_tokens(text):
    return _TOKENS.format(text)


# Predicates. ------------------------------------------------------------------------------------

_WINDOWS = """
with w as (select event_id, user_id, event_type, value, cast(ts as date) as effective_from,
  cast(lead(ts) over (partition by user_id order by ts, event_id) as date) as effective_to from events)
"""


def _windows(t):
    return revisions.open_windows(t.events, "user_id", "ts", ["event_id"])


@query(_WINDOWS + """select event_id, user_id, event_type, effective_from, effective_to from w
 where effective_from <= date '2024-01-15' and (effective_to is null or effective_to >= date '2024-01-15')""")
def as_of_state(t):
    """Each user's state rows in force on a day, both bounds included."""
    day = F.lit("2024-01-15").cast("date")
    return retrieval.as_of(_windows(t), day).select("event_id", "user_id", "event_type", "effective_from", "effective_to")


@query(_WINDOWS + """select user_id, event_id from (
 select *, row_number() over (partition by user_id order by effective_from desc, event_id desc) as n from w
 where effective_from <= date '2024-01-15' and (effective_to is null or effective_to >= date '2024-01-15')) where n = 1""")
def as_of_latest(t):
    day = F.lit("2024-01-15").cast("date")
    return retrieval.as_of(_windows(t).withColumnRenamed("event_id", "id"), day, ["user_id"]).select("user_id", F.col("id").alias("event_id"))


@query("select doc_id, source from documents where lang = 'en' and source in ('src1', 'src5', 'src9')")
def scoped_documents(t):
    docs = t.documents.select("doc_id", "source", F.col("lang").alias("language"), F.col("source").alias("act_id"))
    return retrieval.scope(docs, "en", ["src1", "src5", "src9"]).select("doc_id", "source")


@query("""select l_orderkey, l_linenumber, l_partkey, cast(o_orderdate as date) as effective_from, o_orderpriority as source_url
 from lineitem join orders on l_orderkey = o_orderkey""")
def revision_lookup(t):
    """Chunks take dates and address from their revision."""
    chunks = t.lineitem.select(F.col("l_orderkey").alias("revision_id"), "l_linenumber", "l_partkey")
    revs = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("effective_from"),
                           F.lit(None).cast("date").alias("effective_to"), F.col("o_orderpriority").alias("source_url"))
    return retrieval.with_revision(chunks, revs).select(
        F.col("revision_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "effective_from", "source_url")


# Vectors: the vector of a benchmark item is the question. ---------------------------------------

def _asked_vectors(t):
    return t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding", "label")


def _vector_chunks(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 28).cast("int"))
    return t.embeddings.select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("label") % 2 == 0, "bn").otherwise("en").alias("language"),
        F.col("label").cast("string").alias("act_id"), day.alias("effective_from"),
        F.when(F.col("vec_id") % 3 == 0, F.date_add(day, 10)).alias("effective_to"))


_VEC = """
with pairs as (
  select b.item_id as query_id, c.vec_id as chunk_id, q.label as q_label, c.label,
    round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as score,
    date '2024-01-01' + cast(c.vec_id % 28 as integer) as f, case when c.vec_id % 3 = 0 then date '2024-01-11' + cast(c.vec_id % 28 as integer) end as u
  from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings c),
"""
_RANKED = "ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from kept)\n"


@query(_VEC + "kept as (select * from pairs), " + _RANKED + "select query_id, chunk_id, round(score, 6) as score, rank from ranked where rank <= 40")
def vector_search(t):
    hits = vectors.vector_topn(_asked_vectors(t).drop("label"), _vector_chunks(t).select("chunk_id", "embedding"), SETTINGS.top_n)
    return hits.withColumn("score", F.round("score", 6))


@query(_VEC + "kept as (select * from pairs), " + _RANKED + "select query_id, chunk_id, round(score, 6) as score, rank from ranked where rank <= 40")
def vector_search_blocks(t):
    """The same with small packs and blocks."""
    blocks = replace(SETTINGS, query_block_rows=64, chunk_columns=8, cell_bytes=16_384)
    hits = vectors.vector_topn(_asked_vectors(t).drop("label"), _vector_chunks(t).select("chunk_id", "embedding"), SETTINGS.top_n, blocks)
    return hits.withColumn("score", F.round("score", 6))


@query(_VEC + """kept as (select * from pairs where (label % 2 = 0) = (q_label % 2 = 0) and (q_label < 5 or label in (q_label, 1, 2))
  and f <= date '2024-01-20' and (u is null or u >= date '2024-01-20')), """ + _RANKED +
       "select query_id, chunk_id, round(score, 6) as score, rank from ranked where rank <= 40")
def vector_search_scoped(t):
    """Language, acts and date restrict the chunks before the cut."""
    label = F.col("label")
    asked = _asked_vectors(t).withColumns({
        "language": F.when(label % 2 == 0, "bn").otherwise("en"), "as_of": F.lit("2024-01-20").cast("date"),
        "act_ids": F.when(label < 5, F.array().cast("array<string>")).otherwise(F.array(label.cast("string"), F.lit("1"), F.lit("2")))}).drop("label")
    return vectors.vector_topn(asked, _vector_chunks(t), SETTINGS.top_n).withColumn("score", F.round("score", 6))


@query(_VEC + "kept as (select * from pairs), " + _RANKED + "select count(distinct query_id) as questions, count(*) as hits, true as recall_reached from ranked where rank <= 40")
def vector_search_approximate(t):
    """The inverted-file index finds at least nine in ten of the exact hits."""
    asked, chunks = _asked_vectors(t).drop("label"), _vector_chunks(t).select("chunk_id", "embedding")
    near = vector_index.approximate_topn(asked, chunks, SETTINGS.top_n).select("query_id", "chunk_id", F.lit(1).alias("near"))
    exact = vectors.vector_topn(asked, chunks, SETTINGS.top_n).select("query_id", "chunk_id", F.lit(1).alias("exact"))
    both = near.join(exact, ["query_id", "chunk_id"], "full")
    return both.agg(F.count_distinct("query_id").alias("questions"), F.sum("near").alias("hits"),
                    (F.count_if(F.col("near") + F.col("exact") == 2) >= 0.9 * F.sum("exact")).alias("recall_reached"))


# Full text. -------------------------------------------------------------------------------------

def _text_chunks(t):
    path = F.concat("source", F.lit(" > Section "), F.col("doc_id").cast("string"), F.lit(" ("), F.substring("text", 1, 40), F.lit(")"))
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("language"), F.col("source").alias("act_id"),
                              path.alias("hierarchy_path"), F.col("text").alias("content"), tokenize(F.col("text")).alias("tokens"))


_INDEXES = {}


def _index(t):
    """The documents' index, written by the first query of a session that searches them, as an ingest would."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEXES:
        _INDEXES[key] = postings.write_index(_text_chunks(t).drop("hierarchy_path", "content"))
    return _INDEXES[key]


def _asked(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


_DOCS = f"""
d as (select doc_id as chunk_id, lang as language, source as act_id, source || ' > Section ' || doc_id || ' (' || substring(text, 1, 40) || ')' as hierarchy_path,
        text as content, {sql_tokens('text')} as tokens from documents)"""


def sql_content(asked, chunks):
    """content(query_id, chunk_id, score) from clause(query_id, clause, terms, phrase, excluded) and ``chunks``."""
    return f"""
term_ as (select query_id, clause, len(terms) as n_terms, unnest(terms) as term from {asked}),
tok as (select chunk_id, unnest(tokens) as term, unnest(range(len(tokens))) as pos from {chunks}),
used as (select tok.* from tok where term in (select term from term_)),
good as (select query_id, clause, chunk_id, any_value(n_terms) as n_terms from term_ join (select distinct chunk_id, term from used) using (term)
         group by all having count(*) = any_value(n_terms)),
fits as (select g.* from good g join {asked} q using (query_id, clause)
  where (len(q.phrase) < 2 or exists (select 1 from tok a join tok b on a.chunk_id = b.chunk_id and b.pos = a.pos + 1
         where a.chunk_id = g.chunk_id and a.term = q.phrase[1] and b.term = q.phrase[2]))
    and (len(q.excluded) = 0 or not exists (select 1 from tok a where a.chunk_id = g.chunk_id and a.term = q.excluded[1]))),
m as (select f.query_id, f.clause, f.chunk_id, f.n_terms, used.pos, used.term from fits f join term_ using (query_id, clause) join used using (chunk_id, term)),
reach as (select a.query_id, a.clause, a.chunk_id, any_value(a.n_terms) as n_terms, a.pos as s, b.term, min(b.pos) as e
  from m a join m b on a.query_id = b.query_id and a.clause = b.clause and a.chunk_id = b.chunk_id and b.pos >= a.pos group by a.query_id, a.clause, a.chunk_id, a.pos, b.term),
ends as (select query_id, clause, chunk_id, any_value(n_terms) as n_terms, s, max(e) as e from reach group by query_id, clause, chunk_id, s having count(*) = any_value(n_terms)),
covers as (select query_id, clause, chunk_id, any_value(n_terms) as n_terms, e, max(s) as s from ends group by query_id, clause, chunk_id, e),
content as (select query_id, chunk_id, sum(0.1::double / (1 + e - s + 1 - n_terms)) as score from covers group by query_id, chunk_id)"""


_PASSAGES = f"clause as (select item_id as query_id, 0 as clause, list_distinct({sql_tokens('text')}) as terms, [] as phrase, [] as excluded from benchmark)"


def sql_path(chunks):
    """path_(query_id, chunk_id, score) from the long words of each benchmark text."""
    return f"""
bare as (select item_id, trim(unnest(string_split_regex(trim(text), '\\s+')), '?.,;:''"!()') as w from benchmark),
long as (select distinct item_id, unnest({sql_tokens('w')}) as term from bare where length(w) > 3),
pterm as (select * from long union all select distinct item_id, unnest({sql_tokens('text')}) from benchmark where item_id not in (select item_id from long)),
ptok as (select chunk_id, unnest({sql_tokens('hierarchy_path')}) as term from {chunks}),
path_ as (select item_id as query_id, chunk_id, count(*) * 0.1::double as score from pterm join ptok using (term) group by all)"""


_LEX = """
lex0 as (select query_id, chunk_id, max(score) as score from (select * from content union all select * from path_) group by all),
lex as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from lex0)"""


@query("with " + _DOCS + ", " + _PASSAGES + "," + sql_content("clause", "d") + """
select query_id, chunk_id, round(score, 6) as score, rank from (
 select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from content) where rank <= 40""")
def passage_matches(t):
    """Documents that have all words of a passage, by cover density."""
    hits = lexical.content_hits(_asked(t), _index(t), SETTINGS.top_n, SETTINGS)
    return hits.withColumn("score", F.round("score", 6))


_WEB = f"""
long_ as (select item_id, list_filter({sql_tokens('text')}, lambda x: length(x) > 5) as w from benchmark),
clause as (
  select item_id as query_id, 0 as clause, list_distinct([w[1], w[2], w[3]]) as terms, [w[2], w[3]] as phrase, [w[4]] as excluded from long_ where len(w) > 6
  union all select item_id, 1, list_distinct([w[5], w[6]]), [], [] from long_ where len(w) > 6)"""


@query("with " + _DOCS + "," + _WEB + "," + sql_content("clause", "d") + """
select query_id, chunk_id, round(score, 6) as score, rank from (
 select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from content) where rank <= 40""")
def web_style_search(t):
    """Words, a quoted phrase, an excluded word and an alternative, put together from each passage."""
    w = F.filter(tokenize(F.col("text")), lambda x: F.length(x) > 5)
    words = t.benchmark.select(F.col("item_id").alias("query_id"), w.alias("w")).filter(F.size("w") > 6)
    get = lambda i: F.get("w", F.lit(i))
    asked = words.select("query_id", F.concat(
        get(0), F.lit(' "'), get(1), F.lit(" "), get(2), F.lit('" -'), get(3), F.lit(" or "), get(4), F.lit(" "), get(5)).alias("query_text"))
    hits = lexical.content_hits(asked, _index(t), SETTINGS.top_n, SETTINGS)
    return hits.withColumn("score", F.round("score", 6))


@query("with " + _DOCS + "," + sql_path("d") + """
select query_id, chunk_id, round(score, 6) as score, rank from (
 select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from path_) where rank <= 40""")
def path_search(t):
    """Hierarchy paths that have any long word of the question."""
    hits = lexical.path_hits(_asked(t), _text_chunks(t), SETTINGS.top_n, SETTINGS)
    return hits.withColumn("score", F.round("score", 6))


@query("with " + _DOCS + ", " + _PASSAGES + "," + sql_content("clause", "d") + "," + sql_path("d") + "," + _LEX +
       "select query_id, chunk_id, round(score, 6) as score, rank from lex where rank <= 40")
def lexical_search(t):
    hits = lexical.lexical_topn(_asked(t), _text_chunks(t).drop("content"), SETTINGS.top_n, SETTINGS, _index(t))
    return hits.withColumn("score", F.round("score", 6))


# Fusion. ----------------------------------------------------------------------------------------

_HYBRID_DOCS = _DOCS.replace("from documents)", "from documents), e as (select vec_id as chunk_id, embedding from embeddings)")


def _hybrid_chunks(t):
    # The index holds the tokens; texts are read again for the few chunks that are scored anew.
    return stored(_text_chunks(t).drop("content", "tokens").join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left"))


def _hybrid_queries(t):
    return _asked(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


# All rankings are per language of the chunk, so that one statement serves both searches.
_BOTH = "with " + _HYBRID_DOCS + ", " + _PASSAGES + "," + sql_content("clause", "d") + "," + sql_path("d") + """,
lex0 as (select query_id, chunk_id, max(score) as score from (select * from content union all select * from path_) group by all),
vec0 as (select b.item_id as query_id, e.chunk_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as score
   from benchmark b join embeddings q on q.vec_id = b.item_id, e where e.chunk_id in (select chunk_id from d))"""

_FUSED = _BOTH + """,
lex as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from lex0),
vec as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from vec0),
parts as (select query_id, chunk_id, 0.5::double / (60 + rank) as part, true as lexical, null as sim from lex where rank <= 40
  union all select query_id, chunk_id, 1.0::double / (60 + rank), false, score from vec where rank <= 40),
fused as (select query_id, chunk_id, sum(part) as score, bool_or(lexical) as lexical, max(sim) as sim from parts group by all having bool_or(lexical) or coalesce(max(sim), 0) >= 0.15)"""


@query(_FUSED + "select query_id, chunk_id, round(score, 9) as score from fused")
def hybrid_search(t):
    """Vector and full-text lists fused by reciprocal ranks."""
    return retrieval.hybrid(_hybrid_queries(t), _hybrid_chunks(t), index=_index(t)).withColumn("score", F.round("score", 9))


@query(_FUSED.replace("0.5::double / (60 + rank) as part", "0.5::double / (60 + rank) as part") + """
select query_id, count(*) as hits, round(max(score), 9) as best, max(score) < 0.02 as weak from fused group by all""")
def fused_strength(t):
    """Which questions found too little and would search the other language."""
    queries = _hybrid_queries(t)
    hits = stored(retrieval.hybrid(queries, _hybrid_chunks(t), index=_index(t)))
    weak = retrieval.needs_fallback(queries, hits).select("query_id", F.lit(True).alias("weak"))
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 9).alias("best"))
    return found.join(weak, "query_id", "left").withColumn("weak", F.coalesce("weak", F.lit(False)))


_FALLBACK = _BOTH + """,
lexl as (select l.*, language, row_number() over (partition by query_id, language order by round(score, 9) desc, chunk_id) as rank from lex0 l join d using (chunk_id)),
vecl as (select v.*, language, row_number() over (partition by query_id, language order by score desc, chunk_id) as rank from vec0 v join d using (chunk_id)),
parts as (select query_id, language, chunk_id, 0.5::double / (60 + rank) as part, true as lexical, null as sim from lexl where rank <= 40
  union all select query_id, language, chunk_id, 1.0::double / (60 + rank), false, score from vecl where rank <= 40),
fused as (select query_id, language, chunk_id, sum(part) as score from parts group by all having bool_or(lexical) or coalesce(max(sim), 0) >= 0.15),
asked as (select item_id as query_id, case when item_id % 2 = 0 then 'en' else 'fr' end as own, case when item_id % 2 = 0 then 'fr' else 'en' end as other from benchmark),
best as (select a.query_id, coalesce(max(score), 0) < 0.02 as weak from asked a left join fused f on f.query_id = a.query_id and f.language = a.own group by all),
hits as (select query_id, chunk_id, score, 0 as source from fused join asked using (query_id) where language = own
  union all select query_id, chunk_id, score, 1 from fused join asked using (query_id) join best using (query_id) where weak and language = other)"""

_RERANKED = _FALLBACK + f""",
cut as (select *, row_number() over (partition by query_id order by score desc, source, chunk_id) as fused_rank from hits),
scored as (select c.query_id, c.chunk_id, c.score, c.fused_rank,
   len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct(d.tokens)))::double / len(list_distinct({sql_tokens('b.text')})) as rerank_score
  from cut c join benchmark b on b.item_id = c.query_id join d using (chunk_id) where fused_rank <= 50),
ranked as (select *, row_number() over (partition by query_id order by rerank_score desc, fused_rank) as rank from scored)"""


def _fallback(t):
    language = F.when(F.col("query_id") % 2 == 0, "en").otherwise("fr")
    queries = _hybrid_queries(t).withColumn("language", language)
    return queries, retrieval.with_fallback(queries, _hybrid_chunks(t), SETTINGS, lambda c: F.when(c == "en", "fr").otherwise("en"), index=_index(t))


@query(_FALLBACK + "select query_id, chunk_id, round(score, 9) as score, source from hits")
def fallback_search(t):
    """Weak questions also search the other language."""
    return _fallback(t)[1][0].withColumn("score", F.round("score", 9))


@query(_RERANKED + "select query_id, chunk_id, round(rerank_score, 6) as rerank_score, true as reranked, rank from ranked where rank <= 8")
def reranked_search(t):
    """The best fifty scored again by word overlap; the top eight."""
    queries, (hits, _) = _fallback(t)
    ranked = retrieval.rerank(hits, queries, _text_chunks(t).select("chunk_id", "content"), settings=SETTINGS)
    return retrieval.topk(ranked, SETTINGS.top_k).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "reranked", "rank")


@query(_RERANKED + """select a.query_id, case when weak or rerank_score is null then 'LOW' when rerank_score >= 0.85 then 'HIGH' when rerank_score >= 0.6 then 'MEDIUM' else 'LOW' end as confidence
 from asked a join best using (query_id) left join ranked r on r.query_id = a.query_id and r.rank = 1""")
def confidence_tiers(t):
    queries, (hits, flags) = _fallback(t)
    ranked = retrieval.rerank(hits, queries, _text_chunks(t).select("chunk_id", "content"), settings=SETTINGS)
    return retrieval.confidence(flags, ranked, SETTINGS)


# The flagship: passages against chunks of documents, end to end. --------------------------------

_CH = CHUNK_SQL + f""",
ch as (select doc_id || '-' || chunk_index as chunk_id, language, act_id, hierarchy_path, content, {sql_tokens('content')} as tokens from chunks),
"""


@query(_CH + _PASSAGES + "," + sql_content("clause", "ch") + "," + sql_path("ch") + "," + _LEX + f""",
fused as (select query_id, chunk_id, 0.5::double / (60 + rank) as score, rank as fused_rank from lex where rank <= 40),
scored as (select f.query_id, f.chunk_id, f.score, fused_rank, hierarchy_path,
   len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct(ch.tokens)))::double / len(list_distinct({sql_tokens('b.text')})) as rerank_score
  from fused f join benchmark b on b.item_id = f.query_id join ch using (chunk_id)),
ranked as (select *, row_number() over (partition by query_id order by rerank_score desc, fused_rank) as rank from scored)
select query_id, rank, chunk_id, round(score, 9) as score, round(rerank_score, 6) as rerank_score, hierarchy_path,
 case when max(rerank_score) over (partition by query_id) >= 0.85 then 'HIGH' when max(rerank_score) over (partition by query_id) >= 0.6 then 'MEDIUM' else 'LOW' end as confidence
from ranked where rank <= 8""")
def passage_search(t):
    """For each benchmark passage, the eight best document chunks with scores and tier."""
    # A corpus holds its chunks with their tokens as a table; here it is made from the documents.
    chunks = stored(doc_chunks(t).select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "language", "act_id", "hierarchy_path", "content",
                                         tokenize(F.col("content")).alias("tokens")))
    queries = _asked(t)
    hits = retrieval.rrf(None, lexical.lexical_topn(queries, chunks.drop("language", "act_id", "content"), SETTINGS.top_n, SETTINGS), SETTINGS)
    ranked = retrieval.topk(retrieval.rerank(hits, queries, chunks, settings=SETTINGS), SETTINGS.top_k)
    tiers = retrieval.confidence(queries.select("query_id", F.lit(False).alias("cross_lingual")), ranked, SETTINGS)
    return ranked.join(chunks.select("chunk_id", "hierarchy_path"), "chunk_id").join(tiers, "query_id").select(
        "query_id", "rank", "chunk_id", F.round("score", 9).alias("score"), F.round("rerank_score", 6).alias("rerank_score"), "hierarchy_path", "confidence")


