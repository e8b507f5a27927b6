"""Golden sets, metrics, breakdowns, gates and samples."""

from pyspark.sql import functions as F

from provenant.functions import distance, policy
from provenant.operators import evaluation
from workload.base import query

# A conversation turn is a golden record; its text decides what the system is said to have done.
# DuckDB's levenshtein counts bytes, so what depends on the distance of whole texts has no SQL; tests compare it with a plain version.

def _golden(t):
    n, turn = F.length("text"), F.col("turn")
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 2 == 0, "en").otherwise("bn").alias("language"),
        F.when(turn < 4, F.concat(F.lit("act-"), turn)).alias("act_slug"), F.when(n % 3 != 0, (n % 10).cast("string")).alias("expected_section"),
        (n % 5 == 0).alias("should_decline"), F.when(turn % 2 == 1, F.col("text")).alias("reference_summary"))


def _results(t):
    """Results of all turns but the system's; these pairs become neutral."""
    n = F.length("text")
    return t.conversations.filter("role <> 'system'").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(n % 7 == 0, "mixed").when(F.col("conv_id") % 2 == 0, "en").otherwise("bn").alias("detected_language"),
        (n % 4 == 0).alias("declined"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)), lambda i: ((n + i * (n % 2)) % 10).cast("string")).alias("retrieved_sections"),
        F.concat(F.expr("substring(text, 11)"), F.substring("text", 1, 10)).alias("answer"))


def _pairs(t):
    return evaluation.pair_results(_golden(t), _results(t))


_PAIRS = f"""
with base as (select *, length(text) as n from conversations),
pairs as (
  select conv_id || '-' || turn as id, case when conv_id % 2 = 0 then 'en' else 'bn' end as language, case when turn < 4 then 'act-' || turn end as act_slug,
    case when n % 3 <> 0 then cast(n % 10 as varchar) end as expected, n % 5 = 0 as should_decline, case when turn % 2 = 1 then text end as reference,
    case when role = 'system' then 'en' when n % 7 = 0 then 'mixed' when conv_id % 2 = 0 then 'en' else 'bn' end as detected,
    role <> 'system' and n % 4 = 0 as declined,
    case when role = 'system' then [] else list_transform([0, 1, 2, 3, 4, 5], lambda i: cast((n + i * (n % 2)) % 10 as varchar)) end as sections,
    case when role = 'system' then '' else coalesce(substring(text, 11) || substring(text, 1, 10), '') end as answer from base)
"""
_ACC = "round(coalesce(avg(case when not should_decline and expected is not null then case when len(sections) > 0 and sections[1] = expected then 1.0 else 0.0 end end), 1), 9)"
_REC = "round(coalesce(avg(case when not should_decline and expected is not null then case when list_contains(sections[1:5], expected) then 1.0 else 0.0 end end), 1), 9)"
_ROUTE = "round(coalesce(avg(case when detected = language then 1.0 else 0.0 end), 1), 9)"
_DECL = "round(coalesce(avg(case when declined = should_decline then 1.0 else 0.0 end), 1), 9)"


def _rounded(rows):
    return rows.withColumns({c: F.round(c, 9) for c, kind in rows.dtypes if kind == "double"})


@query()
def evaluation_metrics(t):
    """All metrics in one pass over whole answers."""
    return _rounded(evaluation.metrics(_pairs(t)))


@query(_PAIRS + f"select {_ACC} as section_citation_accuracy, {_REC} as context_recall_at_5 from pairs")
def section_metrics(t):
    return _rounded(_pairs(t).agg(evaluation.section_accuracy().alias("section_citation_accuracy"), evaluation.recall_at_k().alias("context_recall_at_5")))


@query(_PAIRS + f"select {_ROUTE} as language_routing_accuracy, {_DECL} as decline_accuracy from pairs")
def routing_metrics(t):
    return _rounded(_pairs(t).agg(evaluation.routing_accuracy().alias("language_routing_accuracy"), evaluation.decline_accuracy().alias("decline_accuracy")))


@query(_PAIRS + f"""select 'act' as slice_by, coalesce(act_slug, '__no_act__') as slice, count(*) as n, {_ACC} as section_citation_accuracy, {_ROUTE} as language_routing_accuracy, {_DECL} as decline_accuracy from pairs group by act_slug
 union all select 'language', language, count(*), {_ACC}, {_ROUTE}, {_DECL} from pairs group by language
 union all select 'all', 'all', count(*), {_ACC}, {_ROUTE}, {_DECL} from pairs""")
def evaluation_breakdown(t):
    return _rounded(evaluation.breakdown(_pairs(t)))


@query(_PAIRS + f""", m as (select {_ACC} as a, {_ROUTE} as r, {_DECL} as d from pairs), g as (
 select 'section_citation_accuracy' as metric, a as value, 0.85 as threshold from m union all select 'language_routing_accuracy', r, 0.95 from m union all select 'decline_accuracy', d, 0.95 from m)
select metric, value, threshold::double as threshold, value >= threshold as passed, (select bool_and(value >= threshold) from g) as all_passed from g""")
def threshold_gate(t):
    return _rounded(evaluation.gate(evaluation.metrics(_pairs(t))))


@query(_PAIRS + "select id, detected as detected_language, declined, len(sections) as n_sections, answer from pairs")
def paired_results(t):
    return _pairs(t).select("id", "detected_language", "declined", F.size("retrieved_sections").cast("bigint").alias("n_sections"), "answer")


@query("""select c_custkey, case when c_custkey % 3 = 0 then null else cast(c_custkey as varchar) end as section, case when c_custkey % 3 = 0 then null else c_custkey || 'A' end as word from customer""")
def path_sections(t):
    """The deepest part that names a section counts for scoring, the first word for sampling."""
    key = F.col("c_custkey").cast("string")
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Act > Chapter "), key)).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("Act > section "), key, F.lit("A (see it)"))).otherwise(
        F.concat(F.lit("Act > Section "), key, F.lit("A > Note > SECTION "), key, F.lit("A (x) > End")))
    return t.customer.select("c_custkey", policy.section_of(path).alias("section"), policy.first_section(path).alias("word"))


@query("""
with m as (select o_orderpriority as prompt_version, o_orderdate, o_orderkey, o_totalprice,
  row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from orders)
select a.prompt_version, 'total' as metric, a.o_totalprice as value, b.o_totalprice as previous, round(a.o_totalprice - b.o_totalprice, 6) as delta
from m a left join m b on a.prompt_version = b.prompt_version and b.n = 2 where a.n = 1""")
def compared_runs(t):
    from provenant.plans.skew import top_per_group
    runs = t.orders.select(F.col("o_orderpriority").alias("prompt_version"), "o_orderdate", "o_orderkey",
                           F.create_map(F.lit("total"), F.col("o_totalprice")).alias("metrics"))
    two = top_per_group(runs, ["prompt_version"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, "n")
    return evaluation.compare_runs(two.filter("n = 1"), two.filter("n = 2")).withColumn("delta", F.round("delta", 6))


@query("""select source as act_slug, lang as language, 'factual' as category, source || '-' || lang || '-gen-' || sha256(cast(doc_id as varchar))[1:6] as id
 from documents qualify row_number() over (partition by source, lang order by sha256('7|' || doc_id), doc_id) <= 3
 union all select null, 'en', 'pool', 'pool-' || item_id from benchmark""")
def sampled_records(t):
    """Three chunks per act and language by seeded hash order, then the fixed pool."""
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("act_id"), F.col("lang").alias("language"),
                                F.concat("source", F.lit(" > Section "), "doc_id").alias("hierarchy_path"), F.col("text").alias("content"))
    acts = t.documents.select(F.col("source").alias("id"), F.col("source").alias("slug"), F.col("source").alias("full_name_en")).distinct()
    pool = t.benchmark.select(F.concat(F.lit("pool-"), "item_id").alias("id"), F.lit("en").alias("language"), F.lit("pool").alias("category"), F.lit(True).alias("should_decline"))
    return evaluation.sample_eval(chunks, acts, 3, 7, pool).select("act_slug", "language", "category", "id")


@query()
def edit_ratios(t):
    """How far clean white space, small letters and no digits are from each text."""
    clean = F.regexp_replace(F.lower("text"), r"[0-9\s]+", " ")
    found = t.documents.select(F.col("doc_id").alias("id"), "text", clean.alias("clean"))
    return found.select("id", distance.edit_distance("text", "clean").alias("distance"), F.round(evaluation.similarity(F.col("text"), F.col("clean")), 9).alias("ratio"))
