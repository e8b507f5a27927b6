from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from check import TABLES, rows_of
from provenant import schemas
from provenant.operators import bucketed, embedding, lexical, vectors
from provenant.plans.answer import retrieve
from provenant.plans.ingest import begin_corpus, ingest, ingest_batch
from provenant.settings import Settings
from provenant.streaming import ingest as streaming
from test_parsing import HEADED, NESTED
from workload import QUERIES, SQL, streams

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id string, slug string, language string, url string, html string, fetched_at timestamp, not_modified boolean"
CHUNKS = "id string, revision_id string, provision_id string, act_id string, chunk_index int, language string, hierarchy_path string, content string, tokens array<string>, token_count int"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_ingest_twice_then_ask(spark):
    acts = spark.createDataFrame([("a", "a", "Law", "আইন", 2006), ("b", "b", "Rules", "বিধি", 2010)], "id string, slug string, full_name_en string, full_name_bn string, act_year int")
    day = lambda n: datetime(2024, n, 1)
    first = [("1", "a", "en", "http://a", NESTED, day(1), False), ("2", "b", "bn", "http://b", HEADED, day(1), False), ("3", "b", "en", "http://c", "", day(1), True)]
    stamp = F.lit("2024-01-01").cast("timestamp")
    fix = lambda rows: spark.createDataFrame(rows.collect(), rows.schema)
    one = ingest(spark.createDataFrame(first, PAGES), acts, spark.createDataFrame([], schemas.PROVISIONS), spark.createDataFrame([], schemas.REVISIONS), spark.createDataFrame([], CHUNKS), stamp, stamp)
    revisions, provisions, chunks = fix(one.revisions), fix(one.provisions), fix(one.chunks)
    assert {(r.act_id, r.language): r.status for r in one.runs.collect()} == {("a", "en"): "succeeded", ("b", "bn"): "succeeded", ("b", "en"): "succeeded"}
    paths = {r.hierarchy_path for r in chunks.collect()}
    assert "Law, 2006 > Chapter Chapter I Rest (Chapter I Rest) > Section 103 (103. Weekly holiday)(1)" in paths
    assert revisions.filter("effective_to is not null").count() == 0

    changed = [("1", "a", "en", "http://a", NESTED.replace("Ten days", "Twelve days"), day(2), False), ("2", "b", "bn", "http://b", HEADED, day(2), False)]
    two = ingest(spark.createDataFrame(changed, PAGES), acts, provisions, revisions, chunks, stamp, stamp)
    counts = {(r.act_id, r.language): (r.n_new, r.n_updated) for r in two.summary.collect()}
    assert counts == {("a", "en"): (0, 1), ("b", "bn"): (0, 0)}
    assert fix(two.provisions).count() == provisions.count()

    revisions, chunks = fix(two.revisions), fix(two.chunks)
    chunks = fix(embedding.hashed_embedding(chunks, "content", 32))
    asked = spark.createDataFrame([("q1", "Twelve days", "2024-03-01"), ("q2", "দ্বিতীয়", "2024-03-01"), ("q3", "Twelve days", "2024-01-15")], "query_id string, query_text string, day string").withColumn("as_of", F.to_date("day"))
    asked = fix(embedding.hashed_embedding(asked, "query_text", 32))
    found = retrieve(asked, chunks, revisions, F.lit("2024-03-01").cast("date"))
    top = {r.query_id: r.content for r in found.hits.filter("rank = 1").collect()}
    assert "Twelve days" in top["q1"] and "দ্বিতীয়" in top["q2"]
    assert not any("Twelve" in r.content for r in found.hits.filter("query_id = 'q3'").collect())
    assert {r.query_id: r.detected_language for r in found.queries.collect()} == {"q1": "en", "q2": "bn", "q3": "en"}
    assert set(r.confidence for r in found.confidence.collect()) <= {"HIGH", "MEDIUM", "LOW"}


def test_streamed_pages_are_parsed_placed_merged_and_chunked(spark, tmp_path):
    """Three crawls, the last two in one micro-batch after a restart, leave the corpus of three batch ingests."""
    acts = spark.createDataFrame([("a", "a", "Law", "আইন", 2006), ("b", "b", "Rules", "বিধি", 2010)], "id string, slug string, full_name_en string, full_name_bn string, act_year int")
    day = lambda n: datetime(2024, 1, n)
    changed = NESTED.replace("Ten days", "Twelve days")
    crawls = [[("1", "a", "en", "http://a", NESTED, day(1), False), ("2", "b", "bn", "http://b", HEADED, day(1), False), ("3", "none", "en", "http://n", HEADED, day(1), False)],
              [("1", "a", "en", "http://a", changed, day(2), False), ("2", "b", "bn", "http://b", "", day(2), True)],
              [("1", "a", "en", "http://a", changed.replace("Weekly", "Daily"), day(3), False), ("2", "b", "bn", "http://b", HEADED, day(3), False), ("4", "b", "en", "http://e", "<body> </body>", day(3), False)]]
    stamp, root = F.lit("2024-01-01").cast("timestamp"), str(tmp_path / "corpus")
    provisions, revisions, chunks = spark.createDataFrame([], schemas.PROVISIONS), spark.createDataFrame([], schemas.REVISIONS), spark.createDataFrame([], CHUNKS)
    fix = lambda rows: spark.createDataFrame(rows.collect(), rows.schema)
    for crawl in crawls:
        one = ingest(spark.createDataFrame(crawl, PAGES), acts, provisions, revisions, chunks, stamp, stamp)
        provisions, revisions, chunks = fix(one.provisions), fix(one.revisions), fix(one.chunks)

    begin_corpus(spark, root)
    merge = lambda batch, number: ingest_batch(batch, acts, root, number, stamp, stamp)

    def run():
        pages = streaming.page_stream(spark, str(tmp_path / "pages"))
        streaming.stream_ingest(pages, merge, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    for number, crawl in enumerate(crawls):
        spark.createDataFrame(crawl, PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        if number != 1:
            run()
    plain = lambda rows, *names: sorted(map(str, rows.select(*names).collect()))
    names = ["id", "act_id", "parent_id", "kind", "number", "title", "sort_path"]
    assert plain(bucketed.read_provisions(spark, root), *names) == plain(provisions, *names)
    names = ["id", "provision_id", "language", "text", "effective_from", "effective_to", "content_hash", "source_url"]
    assert plain(bucketed.read_revisions(spark, root), *names) == plain(revisions, *names) and revisions.filter("effective_to is not null").count() >= 1
    # Revisions that were replaced within the batch are stored, but not chunked.
    open_ = lambda rows: rows.join(revisions.filter("effective_to is null").selectExpr("id as revision_id"), "revision_id", "left_semi")
    stored_chunks = bucketed.read_chunks(spark, root, chunks.schema)
    assert plain(open_(stored_chunks), *chunks.columns) == plain(open_(chunks), *chunks.columns)
    assert not any("<" in r.content for r in stored_chunks.collect())
    told = spark.read.parquet(f"{root}/warnings").collect()
    assert [(r.act_id, r.language, r.message) for r in told] == [("b", "en", "content container yielded no provisions")]
    runs = {(r.batch, r.act_id, r.language): (r.status, r.provisions_processed > 0) for r in spark.read.parquet(f"{root}/runs").collect()}
    assert runs == {(0, "a", "en"): ("succeeded", True), (0, "b", "bn"): ("succeeded", True), (1, "a", "en"): ("succeeded", True),
                    (1, "b", "bn"): ("succeeded", True), (1, "b", "en"): ("succeeded", False)}
    before = plain(stored_chunks, *chunks.columns)
    merge(spark.createDataFrame(crawls[1] + crawls[2], PAGES), 1)
    assert plain(bucketed.read_chunks(spark, root, chunks.schema), *chunks.columns) == before and bucketed.read_revisions(spark, root).count() == revisions.count()


def test_stream_ingest_chunks_what_it_parsed(spark, tmp_path, monkeypatch):
    rows = [(1, "a & b\n<c> &amp; d", "en", "s"), (2, "same", "fr", "s"), (3, "same", "fr", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    root = str(tmp_path / "store")
    monkeypatch.setattr(streams, "scratch", lambda _: root)
    got = {(r.provision_id, str(r.effective_from), r.content_hash, r.language) for r in QUERIES["stream_ingest"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(f"select provision_id, effective_from, content_hash, language from ({SQL['stream_ingest']})").fetchall()
    assert got == {(i, str(day), h, lang) for i, day, h, lang in want}
    chunks = spark.read.parquet(f"{root}/chunks").filter("act_id = 'act-1'").collect()
    assert "Act, 2024 > Section 1 (1. Document)\na & b\n<c> &amp; d" in {r.content for r in chunks}


def test_plan_shapes(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    q = read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    docs = read("documents").select(F.col("doc_id").alias("chunk_id"), F.split("text", " ").alias("tokens"), F.col("source").alias("hierarchy_path"))
    plan = plan_of(lexical.lexical_topn(q, docs, 40, Settings()))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    vecs = read("embeddings")
    asked = vecs.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = plan_of(vectors.vector_topn(asked, vecs.select(F.col("vec_id").alias("chunk_id"), "embedding"), 8))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    plan = plan_of(QUERIES["key_lookup"](spark, FOLDER))
    assert "EqualTo(s_nationkey,7)" in plan


# One query per area; check.py runs them all.
SAMPLE = ["key_lookup", "link_index", "heading_sections", "chunks", "revision_outcomes", "web_style_search", "resolved_placeholders", "section_lists", "daily_metrics", "evaluation_breakdown"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
