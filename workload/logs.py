"""Browsing and query-log analytics."""

from pyspark.sql import functions as F

from provenant.functions import policy
from provenant.operators import anchored, browse, logs
from provenant.plans import skew
from workload.base import query

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# Browsing: suppliers are acts, orders are ingestion runs or provisions. ---------------------------

def _acts(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("act-"), "s_suppkey").alias("slug"), F.col("s_name").alias("short_name"),
        F.concat(F.lit("The "), "s_name", F.lit(" Act")).alias("full_name_en"), F.col("s_name").alias("full_name_bn"),
        F.col("s_nationkey").cast("string").alias("act_number"), (1900 + F.col("s_nationkey")).cast("int").alias("act_year"))


@query("""select act_year, full_name_en, row_number() over (order by act_year, full_name_en) as place from (
  select 1900 + s_nationkey as act_year, 'The ' || s_name || ' Act' as full_name_en from supplier)""")
def listed_acts(t):
    """Acts in reading order, with the place of each, numbered year by year."""
    listed = skew.running_number(browse.list_acts(_acts(t)), [], [F.asc("full_name_en")], F.col("act_year"), "place")
    return listed.select(F.col("act_year").cast("bigint").alias("act_year"), "full_name_en", "place")


@query("select s_suppkey as id from supplier where contains(lower(s_name), lower('R#00000001')) or contains(lower('The ' || s_name || ' Act'), lower('R#00000001'))")
def searched_acts(t):
    return browse.search_acts(_acts(t), "R#00000001").select("id")


def _order_provisions(t):
    n = t.supplier.count()
    orders = t.orders.join(t.supplier.select(F.col("s_suppkey").alias("act_id")), F.col("o_custkey") % n == F.col("act_id") % n)
    kind = F.when(F.col("o_orderstatus") == "O", "chapter").when(F.col("o_orderstatus") == "F", "section").otherwise("clause")
    return orders.select(
        F.col("o_orderkey").alias("id"), "act_id", F.lit(None).cast("bigint").alias("parent_id"), kind.alias("kind"),
        F.col("o_orderkey").cast("string").alias("number"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("title"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("sort_path"))


_PROVISIONS = """
with p as (select o_orderkey as id, s_suppkey as act_id, case o_orderstatus when 'O' then 'chapter' when 'F' then 'section' else 'clause' end as kind,
   cast(o_orderkey as varchar) as number, case when o_orderpriority <> '5-LOW' then o_orderpriority end as title, lpad(cast(o_orderkey as varchar), 9, '0') as sort_path
  from orders join supplier on o_custkey % (select count(*) from supplier) = s_suppkey % (select count(*) from supplier))
"""


@query(_PROVISIONS + "select 'act-17' as slug, id, kind, sort_path, 0 as children from p where act_id = 17")
def act_structure(t):
    tree = browse.act_structure(_acts(t), _order_provisions(t), "act-17")
    return tree.select("slug", "id", "kind", "sort_path", F.size("children").alias("children"))


@query(_PROVISIONS + """, lines as (select *, case kind
  when 'chapter' then chr(10) || '#### Chapter ' || number || case when title is null then '' else ': ' || title end
  when 'section' then case when max(case when kind = 'chapter' then 1 end) over (partition by act_id order by sort_path) = 1 then '  - ' else '- ' end || '§' || number || case when title is null then '' else ' — ' || title end
  else '    - (' || number || ')' end as line from p)
select act_id, sort_path, line from lines""")
def section_lines(t):
    return browse.section_lines(_order_provisions(t)).select("act_id", "sort_path", "line")


@query(_PROVISIONS + """, lines as (select *, case kind
  when 'chapter' then chr(10) || '#### Chapter ' || number || case when title is null then '' else ': ' || title end
  when 'section' then case when max(case when kind = 'chapter' then 1 end) over (partition by act_id order by sort_path) = 1 then '  - ' else '- ' end || '§' || number || case when title is null then '' else ' — ' || title end
  else '    - (' || number || ')' end as line from p)
select s_suppkey as act_id, '## The ' || s_name || ' Act' || chr(10) || '*Act ' || s_nationkey || ' of ' || (1900 + s_nationkey) || '*' || chr(10) || coalesce(string_agg(chr(10) || line, '' order by sort_path), '')
  || case when count(id) <= 1 then chr(10) || chr(10) || '*Section data not yet indexed. Trigger ingestion to populate.*' else '' end as text
from supplier left join lines on act_id = s_suppkey group by s_suppkey, s_name, s_nationkey""")
def section_lists(t):
    return browse.section_list(_acts(t), _order_provisions(t))


def _provision_revisions(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("day"))
    return lines.select(
        F.col("l_orderkey").alias("provision_id"), F.when(F.col("l_linenumber") % 2 == 0, "bn").otherwise("en").alias("language"),
        F.to_date("day").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("authoritative").alias("translation_status"),
        F.col("l_linenumber").cast("string").alias("text"), F.lit("u").alias("source_url"))


_DETAIL = _PROVISIONS + """, r as (select l_orderkey, case when l_linenumber % 2 = 0 then 'bn' else 'en' end as language, cast(min(l_shipdate) as date) as day, cast(l_linenumber as varchar) as text
  from lineitem group by l_orderkey, l_linenumber),
d as (select p.*, s.s_name, (select string_agg(language || ' ' || day || ' ' || text, ';' order by language, day, text) from r where l_orderkey = p.id) as revisions from p join supplier s on s.s_suppkey = p.act_id),
o as (select id as provision_id, 'act-' || act_id as act_slug, number, 'The ' || s_name || ' Act > ' || upper(kind[1]) || kind[2:] || ' ' || number || case when title is null then '' else ' (' || title || ')' end as hierarchy_path,
  coalesce(revisions, '') as revisions, 'D' as disclaimer from d)
"""


def _flat(detail):
    line = lambda r: F.concat_ws(" ", r["language"], r["effective_from"].cast("string"), r["text"])
    return detail.select("provision_id", "act_slug", "number", "hierarchy_path", F.array_join(F.transform("revisions", line), ";").alias("revisions"), "disclaimer")


@query(_DETAIL + "select * from o where act_slug = 'act-17' and number = (select min(number) from o where act_slug = 'act-17')")
def section_detail(t):
    """The smallest section number of one act, looked up by slug and number."""
    provisions = _order_provisions(t)
    smallest = provisions.filter("act_id = 17").agg(F.min("number")).first()[0]
    return _flat(browse.section_detail(_acts(t), provisions, _provision_revisions(t), "act-17", smallest or "", "D"))


@query(_DETAIL + "select * from o where provision_id = (select max(id) from p)")
def provision_detail(t):
    provisions = _order_provisions(t)
    last = provisions.agg(F.max("id")).first()[0]
    return _flat(browse.provision_detail(_acts(t), provisions, _provision_revisions(t), last, "D"))


def _runs(t):
    status = F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("succeeded")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("act_id"), F.when(F.col("o_orderstatus") == "F", "bn").otherwise("en").alias("language"),
        status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"), F.lit(1).alias("provisions_processed"),
        (F.col("o_orderkey") % 100).cast("int").alias("chunks_created"), F.lit(None).cast("string").alias("error"))


def _customers(t):
    return t.customer.select(F.col("c_custkey").alias("id"), "c_name")


_RUNS = """
with r as (select o_orderkey as id, o_custkey, case when o_orderstatus = 'F' then 'bn' else 'en' end as language, case when o_orderpriority = '5-LOW' then 'failed' else 'succeeded' end as status,
   o_orderdate as ran, cast(o_orderkey % 100 as integer) as chunks from orders),
last as (select * from (select *, row_number() over (partition by o_custkey, language order by ran desc, id desc) as n from r) where n = 1),
l as (select c_custkey as act_id, b.id as bn_id, b.status as bn_status, b.ran as bn_at, b.chunks as bn_chunks, e.id as en_id, e.status as en_status, e.ran as en_at, e.chunks as en_chunks
 from customer left join last b on b.o_custkey = c_custkey and b.language = 'bn' left join last e on e.o_custkey = c_custkey and e.language = 'en')
"""


@query(_RUNS + "select act_id, bn_id, bn_status, en_id, en_status from l")
def latest_ingestion_runs(t):
    return browse.latest_runs(_customers(t), _runs(t)).select(
        "act_id", F.col("last_run_bn.id").alias("bn_id"), F.col("last_run_bn.status").alias("bn_status"),
        F.col("last_run_en.id").alias("en_id"), F.col("last_run_en.status").alias("en_status"))


@query(_RUNS + """select cast(sum(coalesce(bn_chunks, 0) + coalesce(en_chunks, 0)) as bigint) as total_chunks, count(*) filter (where bn_status = 'succeeded' or en_status = 'succeeded') as ingested_acts,
 count(*) filter (where bn_status = 'succeeded' and en_status = 'succeeded') as fully_ingested_acts from l""")
def coverage(t):
    return browse.coverage(browse.latest_runs(_customers(t), _runs(t)))


@query(_RUNS + "select act_id, cast(case when bn_id is not null then case when bn_status = 'succeeded' then bn_at end when en_status = 'succeeded' then en_at end as date) as snapshot from l")
def snapshot_dates(t):
    return browse.latest_runs(_customers(t), _runs(t)).select("act_id", browse.snapshot_date().alias("snapshot"))


# Query log: events. -------------------------------------------------------------------------------

def event_log(events):
    tier = F.when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "signup", "MEDIUM").otherwise("LOW")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("correlation_id"), "user_id", F.col("props").alias("query_text"),
        F.col("event_type").alias("detected_language"), (F.col("event_type") == "error").alias("declined"), tier.alias("confidence_tier"),
        (F.col("event_type") == "view").alias("cached"), (F.col("event_type") == "click").alias("degraded"), F.col("value").alias("latency_ms"),
        (F.round(F.col("value"), 2) / 1000).cast("decimal(10,6)").alias("cost_usd"))


METRIC_SQL = """count(*) as total, count(*) filter (where event_type = 'error') as declined_count, count(*) filter (where event_type = 'purchase') as high_count,
 count(*) filter (where event_type = 'signup') as medium_count, count(*) filter (where event_type not in ('purchase', 'signup')) as low_count,
 count(*) filter (where event_type = 'view') as cached_count, count(*) filter (where event_type = 'click') as degraded_count,
 {p95} round(coalesce(sum(round(value, 2) / 1000), 0), 6) as daily_spend_usd, round(count(*) filter (where event_type = 'error') / count(*), 9) as decline_rate,
 round(count(*) filter (where event_type = 'view') / count(*), 9) as cache_hit_rate, round(count(*) filter (where event_type = 'click') / count(*), 9) as degraded_rate"""
_P95 = "round(quantile_cont(value, 0.95), 6) as p95_latency_ms,"
RATES = ["daily_spend_usd", "decline_rate", "cache_hit_rate", "degraded_rate"]


def rounded(rows, extra=()):
    names = [*RATES, *extra]
    return rows.withColumns({n: F.round(n, 6 if n in ("daily_spend_usd", "p95_latency_ms") else 9) for n in names})


@query(f"select {METRIC_SQL.format(p95=_P95)} from events where ts >= timestamp '{NOW}' - interval 24 hours")
def trailing_metrics(t):
    return rounded(logs.metrics(event_log(t.events), now()), ["p95_latency_ms"])


@query(f"select cast(ts as date) as day, {METRIC_SQL.format(p95=_P95)} from events group by all")
def daily_metrics(t):
    """The same report per day over the whole log."""
    log = event_log(t.events).withColumn("day", F.to_date("created_at"))
    return rounded(logs.metrics(log, now(), 24 * 366, ["day"]), ["p95_latency_ms"])


@query(f"select count(*) as feedback_count from events where ts >= timestamp '{NOW}' - interval 24 hours")
def feedback_count(t):
    return logs.feedback_count(t.events.withColumnRenamed("ts", "created_at"), now())


@query("select event_id as id, substring(props, 1, 200) as query_text, event_type = 'error' as declined from events order by ts desc, event_id desc limit 50")
def recent_queries(t):
    return logs.recent_queries(event_log(t.events)).select("id", "query_text", "declined")


@query("select count(*) as total from events")
def query_total(t):
    return logs.query_total(event_log(t.events))


def _thread_log(t):
    start = F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 10 != 0, F.col("conv_id").cast("string")).otherwise("").alias("correlation_id"),
        F.col("text").alias("query_text"), F.col("role").alias("detected_language"), start.alias("created_at"),
        (F.col("turn") % 2 == 0).alias("declined"), F.lit(False).alias("degraded"), F.col("text").alias("response_text"))


_THREADS = """
with s as (select cast(conv_id as varchar) as thread_id, arg_min(text, turn) as first_question, count(*) as message_count,
  make_timestamp((1700000000 + conv_id * 3600 + max(turn) * 60) * 1000000) as last_activity, arg_max(role, turn) as detected_language
 from conversations where conv_id % 10 <> 0 group by conv_id)
"""


@query(_THREADS + "select * from s")
def thread_summaries(t):
    return logs.thread_summaries(_thread_log(t))


@query(_THREADS + "select * from s order by last_activity desc, thread_id limit 20 offset 10")
def thread_page(t):
    return logs.threads(_thread_log(t), 20, 10)


@query("select count(distinct conv_id) as total from conversations where conv_id % 10 <> 0")
def thread_count(t):
    return logs.thread_count(_thread_log(t))


@query("select true as within_five_percent")
def thread_count_approx(t):
    """The sketch's count beside the exact one."""
    exact = logs.thread_count(_thread_log(t)).withColumnRenamed("total", "exact")
    return logs.thread_count(_thread_log(t), approx=True).join(exact).select(
        (F.abs(F.col("total") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_five_percent"))


def _thread_feedback(t):
    """Assistant turns are rated; long ones twice."""
    rated = t.conversations.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.explode(F.when(F.length("text") > 300, F.array(F.lit("helpful"), F.lit("not_helpful"))).otherwise(
            F.array(F.lit("out_of_scope")))).alias("rating"))
    return rated.select(F.concat_ws("-", "query_id", "rating").alias("id"), "query_id", "rating", F.lit(None).cast("string").alias("comment"),
                        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("query_id") + F.length("rating")).alias("created_at"))


_FEEDBACK = """
with f as (select conv_id * 1000 + turn as query_id, unnest(case when length(text) > 300 then ['helpful', 'not_helpful'] else ['out_of_scope'] end) as rating from conversations where role = 'assistant'),
fb as (select query_id || '-' || rating as id, query_id, rating, make_timestamp((1700000000 + query_id + length(rating)) * 1000000) as created_at from f)
"""


@query(_FEEDBACK + """select conv_id * 1000 + turn as id, cast(conv_id as varchar) as correlation_id, rating as feedback_rating
 from conversations left join fb on query_id = conv_id * 1000 + turn where conv_id % 10 <> 0""")
def thread_messages(t):
    return logs.thread_messages(_thread_log(t), _thread_feedback(t)).select("id", "correlation_id", "feedback_rating")


@query(_FEEDBACK + """select conv_id * 1000 + turn as id, arg_max(rating, (created_at, rating)) as feedback_rating
 from conversations left join fb on query_id = conv_id * 1000 + turn where conv_id % 10 <> 0 group by all""")
def thread_messages_latest(t):
    return logs.thread_messages(_thread_log(t), _thread_feedback(t), latest_only=True).select("id", "feedback_rating")


_FLAT = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
_PREVIEW = f"case when length({_FLAT}) <= 300 then {_FLAT} else regexp_extract(substring({_FLAT}, 1, 298), '^(.*\\S) ', 1) || '...' end"


@query(_FEEDBACK + f"""select id, query_id, rating, {_PREVIEW} as preview from fb join conversations on query_id = conv_id * 1000 + turn
 where rating in ('not_helpful', 'out_of_scope') order by fb.created_at desc, id desc limit 20""")
def feedback_report(t):
    return logs.feedback_report(_thread_feedback(t), _thread_log(t)).select("id", "query_id", "rating", "preview")


@query(f"select conv_id, turn, {_PREVIEW} as preview from conversations")
def previews(t):
    return t.conversations.select("conv_id", "turn", policy.preview(F.col("text")).alias("preview"))


@query("""select source as act_id, case when quality = 1 then 'helpful' when toxic = 1 then 'out_of_scope' else 'not_helpful' end as rating, count(*) as n
 from labels join documents using (doc_id) group by all""")
def rating_patterns(t):
    rating = F.when(F.col("quality") == 1, "helpful").when(F.col("toxic") == 1, "out_of_scope").otherwise("not_helpful")
    log = t.documents.select(F.col("doc_id").alias("id"), F.array("source").alias("act_ids"))
    return logs.rating_patterns(t.labels.select(F.col("doc_id").alias("query_id"), rating.alias("rating")), log)


@query(f"""select event_id, case when m < 1 then 'just now' when m < 60 then m || 'm ago' when m < 1440 then (m // 60) || 'h ago' when m < 10080 then (m // 1440) || 'd ago'
 else strftime(ts, '%Y-%m-%d') end as age from (select event_id, ts, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) // 60000000 as m from events)""")
def age_buckets(t):
    return t.events.select("event_id", policy.age_bucket(F.col("ts"), now()).alias("age"))


# Anchored windows. ----------------------------------------------------------------------------------

def _chain(seconds, where=""):
    return f"""
with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
walk as (
  select user_id, event_id, i, ts, ts as opened, 1 as n from e where i = 1
  union all
  select e.user_id, e.event_id, e.i, e.ts, case when e.ts >= w.opened + interval {seconds} seconds then e.ts else w.opened end,
         case when e.ts >= w.opened + interval {seconds} seconds then 1 else w.n + 1 end
  from walk w join e on e.user_id = w.user_id and e.i = w.i + 1)
"""


@query(_chain(7200) + "select event_id, opened as window_start, cast(n as bigint) as n_in_window, n > 2 as flagged from walk")
def rate_windows(t):
    """Two events per user in two hours; the third and later ones are flagged."""
    return anchored.anchored_window(t.events, "user_id", "ts", 7200, 2, "event_id").select("event_id", "window_start", "n_in_window", "flagged")


@query(_chain(86400) + "select event_id, n > 1 as hit from walk")
def cache_hits(t):
    return anchored.cache_replay(t.events, "user_id", "ts", "event_id").select("event_id", "hit")


@query(_chain(86400) + "select count(*) as requests, count(*) filter (where n > 1) as hits, round(count(*) filter (where n > 1) / count(*), 9) as hit_rate from walk")
def cache_hit_rate(t):
    return anchored.hit_rate(anchored.cache_replay(t.events, "user_id", "ts", "event_id")).withColumn("hit_rate", F.round("hit_rate", 9))
