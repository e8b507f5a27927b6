"""Streaming jobs run to the end of the tables, each written to a folder and read back."""

from pyspark.sql import functions as F

from provenant.operators import bucketed
from provenant.plans.ingest import begin_corpus, ingest_batch
from provenant.plans.session import stored
from provenant.streaming import flags, ingest, metrics
from workload.base import query, scratch
from workload.corpus import FETCHES, fetches
from workload.logs import METRIC_SQL, event_log, rounded

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(t, name):
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _events(t):
    return _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(t, rows, schema=None):
    root = scratch(t.spark)
    rows.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/state").trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(root + "/out")


@query(f"""
with w as (select unnest(generate_series(date_trunc('hour', ts) - interval 23 hours, date_trunc('hour', ts), interval 1 hour)) as s, * from events)
select s as window_start, s + interval 24 hours as window_end, {METRIC_SQL.format(p95='')} from w
group by s having s + interval 24 hours <= (select max(ts) from events) - interval 1 hour""")
def stream_metrics(t):
    """Windows that the watermark has closed, as the batch aggregate of the same rows."""
    return rounded(_drain(t, metrics.stream_metrics(event_log(_events(t)))).drop("p95_latency_ms"))


@query("""
with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
walk as (select user_id, event_id, i, ts, ts as opened, 1 as n from e where i = 1
  union all select e.user_id, e.event_id, e.i, e.ts, case when e.ts >= w.opened + interval 7200 seconds then e.ts else w.opened end,
         case when e.ts >= w.opened + interval 7200 seconds then 1 else w.n + 1 end
  from walk w join e on e.user_id = w.user_id and e.i = w.i + 1)
select user_id as key, event_id, opened as window_start, cast(n as bigint) as n_in_window, n > 2 as flagged from walk""")
def stream_flags(t):
    """Rate flags from keyed state equal the batch chain."""
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return _drain(t, flags.stream_flags(_events(t), 7200, 2, "user_id", "ts", "event_id"))
    finally:
        if before is None:
            t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query(f"with {FETCHES} select doc_id as provision_id, lang as language, h as content_hash, cast(day as date) as effective_from, cast(until as date) as effective_to from changed")
def stream_ingest(t):
    """Four crawls of all documents arrive one after the other, each document as the page of an act of one section, the last with the first's
    pages again; the stream is stopped and started anew half way. Each micro-batch is parsed, placed, merged and chunked into the stored corpus.
    The stored revisions equal those of one batch merge."""
    root, stamp = scratch(t.spark), F.lit("2024-01-01").cast("timestamp")
    begin_corpus(t.spark, root)
    named = lambda c: F.concat(F.lit("act-"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    acts = stored(t.documents.select(named("doc_id").alias("slug"), F.lit("Act").alias("full_name_en"), F.lit(2024).alias("act_year")).distinct())

    def merge(batch, batch_id):
        ingest_batch(batch, acts, root, batch_id, stamp, stamp)

    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit('<div class="section"><div class="sec_head">1. Document</div><div class="sec_content">'), escaped, F.lit("</div></div>"))
    rows = fetches(t).select(F.col("provision_id").cast("string").alias("page_id"), named("provision_id").alias("slug"), "language", F.col("source_url").alias("url"),
                             html.alias("html"), "fetched_at", F.lit(False).alias("not_modified"))
    days = [F.to_date("fetched_at") == F.lit(f"2024-01-0{d}").cast("date") for d in (1, 2, 3, 4)]
    for crawl in (days[0], days[1], days[2], days[3] | days[0]):
        rows.filter(crawl).write.mode("append").parquet(f"{root}/pages")
        if crawl is not days[0]:
            pages = ingest.page_stream(t.spark, f"{root}/pages")
            ingest.stream_ingest(pages, merge, f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    names = bucketed.read_provisions(t.spark, root).select(F.col("id").alias("provision_id"), "act_id")
    return bucketed.read_revisions(t.spark, root).join(names, "provision_id").select(
        F.nullif(F.substring("act_id", 5, 64), F.lit("")).cast("long").alias("provision_id"), "language", "content_hash", "effective_from", "effective_to")
