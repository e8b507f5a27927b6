"""Policy passes over conversations and documents; citations; response paths."""

from pyspark.sql import functions as F

from provenant.functions import hashing, policy
from provenant.operators import responses, retrieval
from provenant.settings import Settings
from workload.base import query

SETTINGS = Settings()

# Openings put before the texts of conversations so that every branch of the patterns is taken.
QUESTIONS = ["Should I sign? ", "List the sections of it. ", "Summarise this: ", "What is the scope? ", "How do I file? ", "Can they do it? ", ""]
ANSWERS = ["You must know. ", "You can't know. ", "It is illegal. ", "You need to see. ", "", "", ""]
FILLERS = ["Certainly! Sure, ", "Answer: ", "Based on the provided provisions, ", "**Answer:** Of course. ", "Great question! ", "", ""]


def _sql_pick(options):
    cases = " ".join(f"when {i} then '{o.replace(chr(39), chr(39) * 2)}'" for i, o in enumerate(options))
    return f"case (conv_id + turn) % {len(options)} {cases} end || text"


def _pick(options):
    parts = F.array(*[F.lit(o) for o in options])
    return F.concat(F.element_at(parts, ((F.col("conv_id") + F.col("turn")) % len(options) + 1).cast("int")), "text")


def _sql_case(column, labelled, default):
    return "case " + " ".join(f"when regexp_matches({column}, '(?i){p}') then {v}" for p, v in labelled) + f" else {default} end"


_B = r"(?:^|[^\p{L}\p{N}_])"
_E = r"(?:$|[^\p{L}\p{N}_])"
_INTENT_SQL = [
    (_B + r"(?:list|show|give me|what are the|enumerate)" + _E + r".{0,29}(?:sections?|chapters?|parts?|provisions?|clauses?)" + _E, "'section_list'"),
    (_B + r"(?:summarize?|summarise?|summary|overview|brief(?:ly)?|outline|in\s+brief)" + _E, "'act_summary'"),
    (_B + r"(?:explain|tell me about|what (?:is|does|covers?|contains?|includes?|are)(?:\s+the)?|about the|describe|introduction to|purpose of|scope of)" + _E, "'act_explain'"),
    (_B + r"(?:should\s+i|can\s+i|what\s+(?:should|can|must|do)\s+i|how\s+(?:do|can|should)\s+i|advise\s+me|my\s+rights|can\s+(?:they|he|she|my\s+employer))" + _E, "'legal_advice'"),
]


@query(f"select conv_id, turn, {_sql_case('q', _INTENT_SQL, chr(39) + 'legal_qa' + chr(39))} as intent from (select *, {_sql_pick(QUESTIONS)} as q from conversations)")
def question_intents(t):
    return t.conversations.select("conv_id", "turn", policy.classify_intent(_pick(QUESTIONS)).alias("intent"))


_DECLINE_SQL = [(_B + r"should\s+i" + _E, r"'advice_seeking_en: matched ''\\bshould\\s+i\\b'''"),
                (_B + r"how\s+(?:do|can|should)\s+i" + _E, r"'advice_seeking_en: matched ''\\bhow\\s+(?:do|can|should)\\s+i\\b'''")]


@query(f"""select conv_id, turn, case when intent = 'legal_qa' or turn % 2 = 0 then
   case when turn % 3 = 2 then 'recall_floor: top score 0.000 < 0.001' else {_sql_case('q', _DECLINE_SQL, 'null')} end end as reason
 from (select conv_id, turn, q, {_sql_case('q', _INTENT_SQL, chr(39) + 'legal_qa' + chr(39))} as intent from (select *, {_sql_pick(QUESTIONS)} as q from conversations))""")
def decline_gate(t):
    """Too little found, or advice asked for; questions of other intents pass (here on odd turns)."""
    question = _pick(QUESTIONS)
    score = F.when(F.col("turn") % 3 == 2, 0.0).otherwise(0.5)
    gated = F.when(F.col("turn") % 2 == 0, policy.decline_reason(question, score, None, SETTINGS)).otherwise(
        policy.decline_reason(question, score, policy.classify_intent(question), SETTINGS))
    ungated_pass = policy.classify_intent(question) == "legal_qa"
    return t.conversations.select("conv_id", "turn", F.when((F.col("turn") % 2 == 0) | ungated_pass, gated).alias("reason"))


_GUARD_SQL = [(_B + r"you\s+must" + _E, "'you must'"), (_B + r"you\s+can(?:not|''t)" + _E, "'you cannot'"), (_B + r"it\s+is\s+illegal" + _E, "'it is illegal'"),
              (_B + r"you\s+are\s+required\s+to" + _E, "'you are required to'"), (_B + r"you\s+need\s+to" + _E, "'you need to'")]


@query(f"select conv_id, turn, {_sql_case('a', _GUARD_SQL, 'null')} as phrase from (select *, {_sql_pick(ANSWERS)} as a from conversations)")
def guardrail_scan(t):
    return t.conversations.select("conv_id", "turn", policy.guardrail(_pick(ANSWERS)).alias("phrase"))


@query("""select conv_id, turn, case role when 'user' then 'act_summary' when 'assistant' then 'legal_advice' else 'legal_answer' end as family,
 case role when 'system' then 'v2' else 'v1' end as version from conversations""")
def prompt_families(t):
    intent = F.when(F.col("role") == "user", "act_explain").when(F.col("role") == "assistant", "legal_advice").otherwise("legal_qa")
    family = policy.prompt_family(intent, "v2")
    return t.conversations.select("conv_id", "turn", family["family"].alias("family"), family["version"].alias("version"))


@query(r"""select conv_id, turn, regexp_replace(a, '(?i)^\s*(?:(?:\*\*answer:\*\*|answer:|certainly[!,.]?|sure[!,.]?|of\s+course[!,.]?|great\s+question[!,.]?|based\s+on\s+the\s+provided\s+provisions?,?)\s*)*', '') as answer
 from (select *, """ + _sql_pick(FILLERS) + """ as a from conversations)""")
def strip_filler(t):
    return t.conversations.select("conv_id", "turn", policy.strip_filler(_pick(FILLERS)).alias("answer"))


# Citations: a conversation's turns cite suppliers as acts. ----------------------------------------

def _acts(t):
    year = (1900 + F.col("s_nationkey")).cast("int")
    with_year = F.col("s_suppkey") % 2 == 0
    name = lambda mark: F.when(with_year, F.concat("s_name", F.lit(mark), year.cast("string"))).otherwise(F.col("s_name"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), name(", ").alias("full_name_en"), name(", ").alias("full_name_bn"), year.alias("act_year"))


def _hits(t):
    """Turn t of a conversation is its hit of rank t + 1, of which top_k count; some acts are unknown."""
    count = 150
    hits = t.conversations.select(
        F.col("conv_id").alias("query_id"), F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn").alias("chunk_id"), (F.col("turn") + 1).cast("int").alias("rank"),
        ((F.col("conv_id") * 7 + F.col("turn")) % count).alias("act_id"), F.concat(F.lit("Act > Section "), F.col("conv_id") + 100, F.lit("(" ), F.col("turn"), F.lit(")")).alias("hierarchy_path"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("http://acts.example/"), "conv_id")).alias("source_url"), F.col("text").alias("content"), F.lit(0.5).alias("score"))
    return retrieval.topk(hits, SETTINGS.top_k)


def _languages(t):
    return t.conversations.select(F.col("conv_id").alias("query_id")).distinct().withColumn(
        "language", F.when(F.col("query_id") % 2 == 0, "en").otherwise("bn"))


_CITED = """
with acts as (select s_suppkey as id, 1900 + s_nationkey as y, case when s_suppkey % 2 = 0 then s_name || ', ' || (1900 + s_nationkey) else s_name end as name from supplier),
hits as (select conv_id, turn, 'c' || conv_id || 't' || turn as chunk_id, cast(turn + 1 as integer) as rank, (conv_id * 7 + turn) % 150 as act_id, (conv_id + 100) || '(' || turn || ')' as ref,
   'Act > Section ' || (conv_id + 100) || '(' || turn || ')' as path, case when turn % 2 = 0 then 'http://acts.example/' || conv_id end as url, text as content, case when conv_id % 2 = 0 then 'en' else 'bn' end as language from conversations where turn < 8),
bare as (select h.*, name, y, case when language = 'en' then 'Section ' || ref || ' of ' || name || case when id % 2 = 0 then '' else ', ' || y end
   else name || case when id % 2 = 0 then '' else ', ' || translate(cast(y as varchar), '0123456789', '০১২৩৪৫৬৭৮৯') end || '-এর ধারা ' || translate(ref, '0123456789', '০১২৩৪৫৬৭৮৯') end as cite
  from hits h join acts on acts.id = h.act_id),
cited as (select *, case when url is null then cite else '[' || cite || '](' || url || ')' end as citation from bare)
"""


@query(_CITED + "select conv_id as query_id, chunk_id, rank, name as act_name_en, cast(y as integer) as act_year, ref as section_ref, url as source_url from cited")
def citation_contexts(t):
    return responses.citation_contexts(_hits(t), _acts(t)).drop("act_name_bn")


@query(_CITED + "select conv_id as query_id, chunk_id, citation from cited")
def formatted_citations(t):
    rows = responses.citation_contexts(_hits(t), _acts(t)).join(_languages(t), "query_id")
    context = F.struct("act_name_en", "act_name_bn", "act_year", "section_ref", "source_url")
    return rows.select("query_id", "chunk_id", policy.format_citation(context, F.col("language")).alias("citation"))


@query("select conv_id, turn, translate(conv_id || '/' || turn || ' ' || text, '0123456789', '০১২৩৪৫৬৭৮৯') as numerals from conversations")
def bengali_numerals(t):
    return t.conversations.select("conv_id", "turn", policy.to_bengali_digits(
        F.concat(F.concat_ws("/", "conv_id", "turn"), F.lit(" "), "text")).alias("numerals"))


@query(_CITED + """select v.conv_id as query_id, v.turn, coalesce(a.citation, '') || 'see ' || coalesce(b.citation, '') || v.text || ' ' as text from conversations v
 left join cited a on a.conv_id = v.conv_id and a.chunk_id = 'c' || v.conv_id || 't' || v.turn
 left join cited b on b.conv_id = v.conv_id and b.chunk_id = 'c' || v.conv_id || 't' || (v.turn + 1)""")
def resolved_placeholders(t):
    """Both spellings of a placeholder; the next turn's chunk may not exist, nobody's never does."""
    mark = lambda turn, left, right: F.concat(F.lit(left + "cite:c"), F.col("conv_id"), F.lit("t"), turn, F.lit(right))
    body = F.concat(mark(F.col("turn"), "{{", "}}"), F.lit("see "), mark(F.col("turn") + 1, "{", "}"), "text", F.lit(" {{cite:nobody}}"))
    answers = t.conversations.select(F.col("conv_id").alias("query_id"), "turn", body.alias("text"),
                                     F.when(F.col("conv_id") % 2 == 0, "en").otherwise("bn").alias("language"))
    return responses.resolve_responses(answers, responses.citation_contexts(_hits(t), _acts(t))).select("query_id", "turn", "text")


DISCLAIMERS = {"v1": {"en": "**Disclaimer:** not advice.", "bn": "**দায়মুক্তি:** পরামর্শ নয়।"}, "v0": {"en": "old", "bn": "পুরোনো"}}
DECLINES = {"v1": {"en": "No advice here.", "bn": "এখানে পরামর্শ নেই।"}}
_DISC = "case when conv_id % 2 = 0 then '**Disclaimer:** not advice.' else '**দায়মুক্তি:** পরামর্শ নয়।' end"


def _disclaimer(texts=DISCLAIMERS):
    return responses.texts_by_language(texts, "v1", F.when(F.col("conv_id") % 2 == 0, "en").otherwise("bn"))


@query(f"select conv_id, turn, text || chr(10) || chr(10) || {_DISC} as answer from conversations")
def appended_disclaimers(t):
    return t.conversations.select("conv_id", "turn", policy.append_disclaimer(F.col("text"), _disclaimer()).alias("answer"))


@query(f"select conv_id, turn, text || chr(10) || chr(10) || {_DISC} as answer from conversations")
def refreshed_disclaimers(t):
    """Cached answers end in an old disclaimer, the active one, or none; all end up with the active one."""
    ending = F.when(F.col("turn") % 3 == 0, F.lit("\n\nold words")).when(F.col("turn") % 3 == 1, F.concat(F.lit("\n\n"), _disclaimer())).otherwise("")
    return t.conversations.select("conv_id", "turn", policy.refresh_disclaimer(F.concat("text", ending), _disclaimer()).alias("answer"))


@query("select conv_id, case when conv_id % 2 = 0 then 'No advice here.' else 'এখানে পরামর্শ নেই।' end as answer, count(*) as n from conversations group by all")
def decline_texts(t):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", _disclaimer(DECLINES).alias("answer"), "n")


@query(f"select conv_id, turn, regexp_replace(text, '\\s+$', '') as body, case when turn % 2 = 0 then {_DISC} end as disclaimer from conversations")
def split_disclaimers(t):
    answer = F.when(F.col("turn") % 2 == 0, policy.append_disclaimer(F.col("text"), _disclaimer())).otherwise(F.col("text"))
    parts = policy.split_disclaimer(answer)
    return t.conversations.select("conv_id", "turn", parts["body"].alias("body"), parts["disclaimer"].alias("disclaimer"))


@query(_CITED + """, q as (select conv_id, arg_min(text, turn) as question from conversations group by all)
select q.conv_id as query_id, '<question>' || chr(10) || question || chr(10) || '</question>' as question,
 string_agg('<provision chunk_id="' || chunk_id || '" path="' || path || '">' || chr(10) || content || chr(10) || '</provision>' || chr(10) || 'To cite this provision use: {cite:' || chunk_id || '}', chr(10) || chr(10) order by rank) as context
from q join hits using (conv_id) group by all""")
def assembled_context(t):
    return responses.assemble_context(_hits(t), _first_questions(t)).select("query_id", "question", "context")


def _first_questions(t):
    return t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query_text"))


@query(_CITED + """select h.conv_id as query_id, 'Relevant provisions (no summary available):' || string_agg(chr(10) || chr(10) || h.content || coalesce(' [' || c.citation || ']', ''), '' order by h.rank) as answer
 from hits h left join cited c using (conv_id, chunk_id) group by all""")
def fail_open_answers(t):
    hits = _hits(t)
    return responses.fail_open(hits, responses.citation_contexts(hits, _acts(t)), _languages(t))


@query("""select event_id, round(value * 100 / 1000.0 * 0.003 + 0.03072, 9) as cost, round(value * 100 / 1000.0 * 0.003 + 0.03072, 9) >= 0.1 as refused from events""")
def cost_guard(t):
    tokens = F.col("value") * 100
    return t.events.select("event_id", F.round(policy.projected_cost(tokens, SETTINGS), 9).alias("cost"), policy.over_ceiling(tokens, SETTINGS).alias("refused"))


@query("""select conv_id, 'response:' || sha256(regexp_replace(regexp_replace(lower(q), '\\s+', ' ', 'g'), '^ | $', '', 'g') || '|' || ids || '|2024-01-15|m|v2|r') as key
 from (select conv_id, arg_min(text, turn) as q, string_agg('c' || turn, '|' order by 'c' || turn) filter (where turn < 8) as ids from conversations group by all)""")
def cache_keys(t):
    rows = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.collect_list(F.when(F.col("turn") < SETTINGS.top_k, F.concat(F.lit("c"), "turn"))).alias("ids"))
    return rows.select("conv_id", hashing.cache_key(F.col("q"), F.col("ids"), F.lit("2024-01-15").cast("date"), "m", "v2", "r").alias("key"))


@query("select event_id, substring(sha256(case when event_type = 'error' then 'unknown' else '10.0.0.' || user_id end), 1, 16) as ip_hash from events")
def ip_hashes(t):
    ip = F.when(F.col("event_type") != "error", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    return t.events.select("event_id", hashing.ip_hash(ip).alias("ip_hash"))


def _response_inputs(t):
    """One question per conversation: odd ones failed at the provider, every fifth answered against the rules."""
    key = F.col("query_id")
    opening = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (key % len(QUESTIONS) + 1).cast("int"))
    queries = _first_questions(t).select(
        "query_id", F.concat(opening, "query_text").alias("query_text"), F.lit("en").alias("detected_language"),
        F.lit("2024-01-15").cast("date").alias("as_of"), F.array((key % 4).cast("string")).alias("act_ids"))
    drafts = queries.select(
        "query_id", F.concat(F.lit("Sure, see {{cite:c"), key, F.lit("t0}}. "), F.when(key % 5 == 0, "You must pay.").otherwise("")).alias("text"),
        F.when(key % 10 == 0, "You cannot pay.").otherwise("Answer: as said.").alias("retry_text"), (key % 3 == 1).alias("failed"))
    return queries, drafts


_PATH_SQL = """case when n = 1 and conv_id % 4 = 2 then 'section_list' when conv_id % 3 = 1 then 'provider_failed'
   when conv_id % 10 = 0 then 'guardrail_failed' else 'answered' end"""


@query(f"""select conv_id as query_id, path, path = 'declined' as declined, path in ('provider_failed', 'guardrail_failed') as degraded from (
  select conv_id, n, {_PATH_SQL} as path from (select distinct conv_id, conv_id % 7 as n from conversations))""")
def response_paths(t):
    """The whole decision chain: section list, decline, provider failure, guardrail, answer."""
    return _responses(t).select("query_id", "path", "declined", "degraded")


_SEVEN = ["cache_hit", "section_list", "declined", "cost_refused", "provider_failed", "guardrail_failed", "answered"]


@query(f"""select conv_id as query_id, path, path = 'cache_hit' as cached, path = 'declined' as declined,
  path in ('cost_refused', 'provider_failed', 'guardrail_failed') as degraded, case when path = 'cache_hit' then 'kept' when path = 'section_list' then '## list' end as body
  from (select distinct conv_id, {_SEVEN!r}[conv_id % 7 + 1] as path from conversations)""")
def all_response_paths(t):
    """Every question is brought onto one of the seven paths by what is found, cached, drafted and asked for."""
    key = F.col("query_id")
    case = key % 7
    queries = _first_questions(t).select(
        "query_id", F.concat(F.when(case == 1, "List the sections of the act. ").otherwise("Notice period of workers under section "), key.cast("string")).alias("query_text"),
        F.lit("en").alias("detected_language"), F.lit("2024-01-15").cast("date").alias("as_of"), F.array(F.lit("2")).alias("act_ids"))
    hits = queries.select("query_id", F.concat(F.lit("c"), key).alias("chunk_id"), F.lit(1).alias("rank"),
                          F.when(case == 2, 0.0001).otherwise(0.5).alias("score"), F.lit(2).cast("bigint").alias("act_id"), F.lit("Act > Section 5").alias("hierarchy_path"), F.lit("http://acts.example/2").alias("source_url"),
                          F.when(case == 3, F.repeat(F.lit("long text "), 20_000)).otherwise(F.lit("short text")).alias("content"))
    drafts = queries.select("query_id", F.when(case == 5, "You must pay.").otherwise("As said.").alias("text"),
                            F.when(case == 5, "You cannot pay.").otherwise("As said.").alias("retry_text"), (case == 4).alias("failed"))
    contexts = responses.citation_contexts(hits, _acts(t))
    lists = t.supplier.filter("s_suppkey = 2").select(F.lit("2").alias("act_id"), F.lit("## list").alias("text"))
    first = responses.respond(queries, hits, contexts, drafts, DISCLAIMERS, DECLINES, SETTINGS, section_lists=lists)
    cache = first.filter(case == 0).select(F.col("cache_key").alias("key"), F.lit("kept").alias("text"))
    done = responses.respond(queries, hits, contexts, drafts, DISCLAIMERS, DECLINES, SETTINGS, cache=cache, section_lists=lists)
    body = policy.split_disclaimer(F.col("answer"))["body"]
    return done.select("query_id", "path", "cached", "declined", "degraded", F.when(F.col("path").isin("cache_hit", "section_list"), body).alias("body"))


def _responses(t):
    queries, drafts = _response_inputs(t)
    hits = _hits(t)
    lists = t.supplier.filter("s_suppkey = 2").select(F.col("s_suppkey").cast("string").alias("act_id"), F.lit("## list").alias("text"))
    return responses.respond(queries, hits, responses.citation_contexts(hits, _acts(t)), drafts, DISCLAIMERS, DECLINES, SETTINGS, section_lists=lists)


@query(_CITED.replace("case when conv_id % 2 = 0 then 'en' else 'bn' end as language", "'en' as language") + f""", paths as (select conv_id, {_PATH_SQL} as path from (select distinct conv_id, conv_id % 7 as n from conversations)),
 opened as (select h.conv_id, 'Relevant provisions (no summary available):' || string_agg(chr(10) || chr(10) || h.content || coalesce(' [' || c.citation || ']', ''), '' order by h.rank) as answer
   from hits h left join cited c using (conv_id, chunk_id) group by all)
select conv_id as query_id, case path when 'section_list' then '## list'
   when 'answered' then case when conv_id % 5 = 0 then 'as said.' else 'see ' || coalesce(first_.citation, '') || '. ' end
   else opened.answer end || chr(10) || chr(10) || '**Disclaimer:** not advice.' as answer
from paths join opened using (conv_id) left join (
  select conv_id, case when url is null then en else '[' || en || '](' || url || ')' end as citation from (
    select *, cite as en from cited where rank = 1)) first_ using (conv_id)""")
def finished_answers(t):
    return _responses(t).select("query_id", "answer")
