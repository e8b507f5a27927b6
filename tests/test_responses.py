from pyspark.sql import functions as F

from provenant.operators import responses
from workload.answers import DECLINES, DISCLAIMERS

HITS = "query_id int, chunk_id string, rank int, score double, act_id string, hierarchy_path string, source_url string, content string"
QUERIES = "query_id int, query_text string, detected_language string, as_of date, act_ids array<string>"


def inputs(spark):
    hits = [(1, "a", 1, 0.9, "x", "Act > Section 1", "http://a", "one"), (1, "b", 2, 0.8, "x", "Act > Section 2", "http://b", None),
            (1, "c", 3, 0.7, "x", "Act > Section 3", "http://c", "ক" * 1001), (2, "d", 1, 0.9, "x", "Act", "http://d", None), (3, "e", 1, 0.5, "x", "Act", "http://e", "y")]
    queries = [(1, "Notice period?", "en", None, []), (2, "Wages?", "en", None, []), (3, None, "en", None, []), (4, "Nothing found", "en", None, [])]
    return spark.createDataFrame(hits, HITS), spark.createDataFrame(queries, QUERIES)


def test_prompt_tokens_come_from_lengths(spark):
    hits, queries = inputs(spark)
    built = responses.assemble_context(hits, queries).select("query_id", "input_tokens")
    assert sorted(responses.prompt_tokens(hits, queries).collect()) == sorted(built.collect())


def test_no_join_of_a_response_moves_the_assembled_context(spark):
    hits, queries = inputs(spark)
    acts = spark.createDataFrame([("x", "Law", "Law", 2000)], "id string, full_name_en string, full_name_bn string, act_year int")
    drafts = queries.select("query_id", F.lit("As said.").alias("text"), F.lit("As said.").alias("retry_text"), F.lit(False).alias("failed"))
    done = responses.respond(queries, hits, responses.citation_contexts(hits, acts), drafts, DISCLAIMERS, DECLINES)
    paths = done.select("query_id", "path", "cost_usd")
    assert "block#" not in paths._jdf.queryExecution().optimizedPlan().toString()
    assert paths.count() == 4
