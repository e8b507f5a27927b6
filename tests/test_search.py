import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.functions.text import tokenize
from provenant.operators import lexical, postings, retrieval, vector_index, vectors
from provenant.settings import Settings

S = Settings()


def test_vectors_against_brute_force(spark):
    """A third of the chunks are copies of one vector, so cuts fall inside ties."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[:100] = base[0]
    base[150] = 0
    asked = np.vstack([base[0] * 2, rng.normal(size=(6, 8)).astype(np.float32)])
    days = [f"2024-01-{1 + i % 28:02d}" for i in range(300)]
    chunk_rows = [(f"c{i:03d}", v.tolist(), "bn" if i % 2 else "en", str(i % 5), days[i], None if i % 3 else "2024-01-20") for i, v in enumerate(base)]
    query_rows = [(f"q{i}", v.tolist(), "bn" if i % 2 else "en", ["1", "3"] if i == 2 else [], "2024-01-15") for i, v in enumerate(asked)]
    chunks = spark.createDataFrame(chunk_rows + [("cx", None, "en", "0", days[0], None)], "chunk_id string, embedding array<float>, language string, act_id string, f string, u string").withColumns(
        {"effective_from": F.to_date("f"), "effective_to": F.to_date("u")}).drop("f", "u").repartition(5)
    queries = spark.createDataFrame(query_rows, "query_id string, embedding array<float>, language string, act_ids array<string>, d string").withColumn("as_of", F.to_date("d")).drop("d")
    want = {}
    for qid, qv, lang, acts, day in query_rows:
        found = []
        for cid, cv, clang, act, f, u in chunk_rows:
            norm = np.linalg.norm(cv)
            if norm and clang == lang and (not acts or act in acts) and f <= day and (u is None or u >= day):
                found.append((-round(float(np.dot(qv, cv) / norm / np.linalg.norm(qv)), 9), cid))
        want[qid] = [cid for _, cid in sorted(found)[:10]]
    for settings in (S, replace(S, query_block_rows=3, chunk_columns=4, cell_bytes=320)):
        hits = vectors.vector_topn(queries, chunks, 10, settings).orderBy("query_id", "rank").collect()
        got = {}
        for h in hits:
            got.setdefault(h.query_id, []).append(h.chunk_id)
        assert got == {q: c for q, c in want.items() if c}


def test_dimensions_must_agree(spark):
    make = lambda name, v: spark.createDataFrame([("x", v)], f"{name} string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.vector_topn(make("query_id", [1.0, 0.0]), make("chunk_id", [1.0]), 3).collect()


def brute_cover(tokens, terms):
    last, start, score = {}, -1, 0.0
    for at, token in enumerate(tokens):
        if token in terms:
            last[token] = at
            if len(last) == len(terms):
                first = min(last.values())
                score += 0.1 / (1 + at - first + 1 - len(terms))
                del last[min(last, key=last.get)]
    return score


def test_cover_density(spark, value):
    words = lambda s: F.split(F.lit(s), " ")
    places = lambda tokens: F.map_from_entries(F.transform(F.array_distinct(tokens), lambda w: F.struct(w, F.filter(
        F.transform(tokens, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    rank = lambda t, q: value(lexical.cover_density(places(words(t)), words(q)))
    assert rank("a b", "a b") == pytest.approx(0.1) and rank("a x x b", "a b") == pytest.approx(0.1 / 3)
    assert rank("a a a", "a") == pytest.approx(0.3) and rank("a x", "a b") == 0
    rng = random.Random(5)
    rows = [([rng.choice("abcdexyz") for _ in range(rng.randint(1, 40))], sorted(rng.sample("abcde", rng.randint(1, 3)))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "tokens array<string>, terms array<string>").select("tokens", "terms", lexical.cover_density(places(F.col("tokens")), F.col("terms")).alias("s"))
    for r in frame.collect():
        assert r.s == pytest.approx(brute_cover(r.tokens, r.terms))


def brute_lexical(queries, chunks, n):
    split = lambda s: [w for w in re.split(r"[^\w]+", s.lower()) if w]
    phrase = lambda toks, p: any(toks[i:i + len(p)] == p for i in range(len(toks)))
    out = {}
    for qid, text in queries:
        scored = {}
        for cid, path, content in chunks:
            toks, score = split(content), 0.0
            for part in re.split(r"\s+or\s+", text):
                quoted = [split(p) for p in re.findall(r'(?<!-)"([^"]*)"', part)]
                bare = re.sub(r'-?"[^"]*"', " ", part)
                negated = [split(w) for w in re.findall(r"(?:^|\s)-(\S+)", bare)]
                terms = set(split(re.sub(r"(?:^|\s)-\S+", " ", bare)) + [w for p in quoted for w in p])
                if terms and terms <= set(toks) and all(phrase(toks, p) for p in quoted) and not any(phrase(toks, p) for p in negated):
                    score += brute_cover(toks, terms)
            long = {w for x in text.split() for w in split(x.strip("?.,;:'\"!()")) if len(x.strip("?.,;:'\"!()")) > 3} or set(split(text))
            score = max(score, 0.1 * sum(w in long for w in split(path)))
            if score:
                scored[cid] = round(score, 9)
        out[qid] = sorted(scored, key=lambda c: (-scored[c], c))[:n]
    return {q: c for q, c in out.items() if c}


def test_lexical_against_brute_force(spark):
    """One word is in every chunk and a third of the chunks are copies."""
    rng = random.Random(11)
    vocabulary = ["rest", "wages", "holiday", "labour", "court", "tax", "the", "of", "fine"]
    body = lambda: "the " + " ".join(rng.choice(vocabulary) for _ in range(12))
    copy = body()
    chunks = [(i, f"Act > Section {rng.choice(['Holiday', 'Court', 'Tax'])} {i % 4}", copy if i % 3 == 0 else body()) for i in range(90)]
    queries = [(0, "the"), (1, "rest wages"), (2, '"rest wages" -fine'), (3, "tax or holiday rest"), (4, "court nowhere"), (5, "of"), (6, "Holiday, court?"), (7, "the or tax -court")]
    frame = spark.createDataFrame(chunks, "chunk_id int, hierarchy_path string, content string").withColumn("tokens", tokenize(F.col("content"))).drop("content")
    asked = spark.createDataFrame(queries, "query_id int, query_text string")
    got = {}
    for h in lexical.lexical_topn(asked, frame, 7, S).orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append(h.chunk_id)
    assert got == brute_lexical(queries, chunks, 7)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_fusion(spark):
    vec = hits(spark, [("q", "both", 0.9, 1), ("q", "good", 0.15, 2), ("q", "weak", 0.14, 3)])
    lex = hits(spark, [("q", "both", 0.2, 1), ("q", "text", 0.1, 2)])
    got = {r.chunk_id: r.score for r in retrieval.rrf(vec, lex).collect()}
    assert got == {"both": pytest.approx(1.5 / 61), "good": pytest.approx(1 / 62), "text": pytest.approx(0.5 / 62)}
    assert {r.chunk_id for r in retrieval.rrf(vec, lex, replace(S, vector_weight=0.0)).collect()} == {"both", "text"}
    with pytest.raises(ValueError):
        retrieval.rrf(None, None)


def test_fallback_and_flags(spark):
    asked = spark.createDataFrame([("strong", "en"), ("weak", "en"), ("none", "bn")], "query_id string, language string")
    table = {("strong", "en"): [("a", 0.03)], ("weak", "en"): [("b", 0.01)], ("weak", "bn"): [("c", 0.01), ("d", 0.02)]}
    rows = [(q, l, c, s) for (q, l), found in table.items() for c, s in found]
    known = spark.createDataFrame(rows, "query_id string, language string, chunk_id string, score double")
    search = lambda queries, chunks, settings: queries.join(known, ["query_id", "language"]).select("query_id", "chunk_id", "score")
    found, flags = retrieval.with_fallback(asked, known, S, search=search)
    assert sorted((r.query_id, r.chunk_id, r.source) for r in found.collect()) == [("strong", "a", 0), ("weak", "b", 0), ("weak", "c", 1), ("weak", "d", 1)]
    assert {r.query_id: r.cross_lingual for r in flags.collect()} == {"strong": False, "weak": True, "none": True}


def _rerank(spark, **kw):
    found = spark.createDataFrame([("q", f"c{i}", 1.0 - i / 100) for i in range(4)], "query_id string, chunk_id string, score double")
    asked = spark.createDataFrame([("q", "rest day")], "query_id string, query_text string")
    texts = spark.createDataFrame([("c0", "x"), ("c1", "rest"), ("c2", "day of rest"), ("c3", "rest day")], "chunk_id string, content string")
    return [(r.chunk_id, r.reranked) for r in retrieval.rerank(found, asked, texts, **kw).orderBy("rank").collect()]


def test_rerank(spark):
    assert _rerank(spark) == [("c2", True), ("c3", True), ("c1", True), ("c0", True)]
    assert _rerank(spark, settings=replace(S, rerank_top_n=2)) == [("c1", True), ("c0", True)]
    assert _rerank(spark, scorer=lambda q, c: [len(x) for x in c])[0] == ("c2", True)

    def down(questions, contents):
        raise retrieval.ScorerUnavailable("unavailable")
    assert _rerank(spark, scorer=down) == [("c0", False), ("c1", False), ("c2", False), ("c3", False)]


@pytest.mark.parametrize("score,reranked,cross,tier", [(0.92, True, False, "HIGH"), (0.85, True, False, "HIGH"), (0.72, True, False, "MEDIUM"), (0.5, True, False, "LOW"),
                                                      (0.92, False, False, "LOW"), (0.92, True, True, "LOW"), (None, None, False, "LOW")])
def test_tiers(spark, score, reranked, cross, tier):
    asked = spark.createDataFrame([("q", cross)], "query_id string, cross_lingual boolean")
    rows = [] if score is None else [("q", 1, reranked, score)]
    ranked = spark.createDataFrame(rows, "query_id string, rank int, reranked boolean, rerank_score double")
    assert [r.confidence for r in retrieval.confidence(asked, ranked).collect()] == [tier]


def test_as_of_bounds(spark):
    rows = spark.createDataFrame([("1", "p", "2024-01-01", "2024-02-01"), ("2", "p", "2024-02-01", None)], "id string, p string, f string, u string").withColumns(
        {"effective_from": F.to_date("f"), "effective_to": F.to_date("u")})
    ids = lambda day, **kw: sorted(r.id for r in retrieval.as_of(rows, F.lit(day).cast("date"), **kw).collect())
    assert ids("2024-01-31") == ["1"] and ids("2024-02-01") == ["1", "2"] and ids("2023-12-31") == []
    assert ids("2024-02-01", latest_only=["p"]) == ["2"]


def test_vector_index_finds_nine_in_ten(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 32))
    rows = [(f"c{i:04d}", (middles[i % 12] + 0.7 * rng.normal(size=32)).tolist() if i % 3 else middles[0].tolist(), "en" if i % 2 else "fr") for i in range(1500)]
    # The last question points away from most chunks; one has no vector.
    asked = [(f"q{i}", (middles[i] + 0.7 * rng.normal(size=32)).tolist(), "en") for i in range(12)] + [("far", (-middles.mean(axis=0)).tolist(), "fr"), ("none", None, "en")]
    chunks = spark.createDataFrame(rows + [("null", None, "en"), ("zero", [0.0] * 32, "en")], "chunk_id string, embedding array<double>, language string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>, language string")
    index = vector_index.write_vector_index(chunks, cells=24, sample=400)
    # Every vector is in one cell, also those beyond the sample.
    held = index.codes.select("cell", F.explode("chunk_id").alias("c")).groupBy("c").count()
    assert held.count() == 1500 and held.filter("count > 1").count() == 0 and len(index.centroids) == 24
    want = {(r.query_id, r.chunk_id) for r in vectors.vector_topn(queries, chunks, 10).collect()}
    got = vector_index.approximate_topn(queries, chunks, 10, index, probes=10).collect()
    assert len(got) == len(want) == 130 and len({(r.query_id, r.chunk_id) for r in got} & want) >= 0.9 * len(want)
    exact = {(r.query_id, r.chunk_id): r.score for r in vectors.vector_topn(queries, chunks, 1500).collect()}
    assert all(r.score == pytest.approx(exact[r.query_id, r.chunk_id], abs=1e-8) for r in got)
    # All cells probed and everything listed is the exact search.
    full = vector_index.approximate_topn(queries, chunks, 10, index, probes=24, shortlist=150).collect()
    assert {(r.query_id, r.chunk_id) for r in full} == want
    empty = chunks.limit(0)
    assert vector_index.approximate_topn(queries, empty, 3).count() == 0


def test_exact_search_plans_without_running(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    chunks = spark.createDataFrame([("c", [1.0, 0.5])], "chunk_id string, embedding array<double>")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("plan"))
    spark.sparkContext.setJobGroup("plan", "frames only")
    hits = vectors.vector_topn(queries, chunks, 3)
    assert jobs() == 0 and "CartesianProduct" not in _plan(hits)
    assert [r.chunk_id for r in hits.collect()] == ["c"] and jobs() > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_balls_spare_blocks():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 16))
    unit = vectors._unit(np.vstack([m + 0.05 * rng.normal(size=(40, 16)) for m in middles])[rng.permutation(800)])
    asked = vectors._Block({"query_id": list(range(20)), "embedding": vectors._unit(middles)})
    best = vectors._Best(asked, 5)
    order, bounds = vectors.cells_of(unit, 20)
    assert sorted(order) == list(range(800)) and (np.diff(bounds) <= 20).all() and bounds[0] == 0 and bounds[-1] == 800
    for a, b in zip(bounds, bounds[1:]):
        centre, radius = vectors.ball(unit[order[a:b]])
        best.add({"chunk_id": order[a:b], "embedding": unit[order[a:b]], "centre": centre, "radius": radius})
    want = {q: np.lexsort((np.arange(800), -np.round(unit @ v, 9)))[:5].tolist() for q, v in enumerate(asked.matrix)}
    assert {q: g["chunk_id"].tolist() for q, g in best.rows.groupby("q")} == want
    assert best.skipped > best.scored


def _plan(frame):
    return frame._jdf.queryExecution().toString()


def _zipf_chunks(spark, n=3000):
    """One word is in all chunks, a few have it often; another is in every second chunk."""
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(20)] + ["the"] * (1 + (i % 97 == 0) * (1 + i // 97)) + ["half"] * (i % 2)
        rng.shuffle(words)
        rows.append((i, words, "en" if i % 3 else "fr", str(i % 4)))
    return spark.createDataFrame(rows, "chunk_id int, tokens array<string>, language string, act_id string").repartition(4, "chunk_id")


def test_index_holds_all_positions(spark):
    chunks = _zipf_chunks(spark, 300).union(spark.createDataFrame([(900, None, "en", "1"), (901, [], "fr", None), (902, ["only"], None, None)], "chunk_id int, tokens array<string>, language string, act_id string"))
    index = postings.write_index(chunks, block=7)
    held = index.blocks.select("term", "language", F.explode("postings").alias("p")).select("term", "language", "p.chunk_id", "p.act_id", F.explode("p.at").alias("at"))
    want = chunks.select(F.posexplode("tokens").alias("at", "term"), "language", "chunk_id", "act_id").select(held.columns)
    assert held.count() == want.count() and held.exceptAll(want).count() == 0
    assert index.blocks.filter("n <> size(postings) or n > 7 or most <> size(postings[0].at)").count() == 0
    assert index.blocks.groupBy("term", "language", "segment", "block").count().filter("count > 1").count() == 0
    df = {r.term: r.df for r in index.terms.collect()}
    assert df["the"] == 300 and df["half"] == 150 and df["only"] == 1
    empty = postings.write_index(chunks.limit(0))
    assert empty.blocks.count() == empty.terms.count() == 0
    assert lexical.content_hits(spark.createDataFrame([(1, "the")], "query_id int, query_text string"), empty, 3, S).count() == 0


def test_search_reads_only_what_it_needs(spark):
    index = postings.write_index(_zipf_chunks(spark), buckets=16)
    asked = spark.createDataFrame([(1, "the half")], "query_id int, query_text string")
    search = lexical.ContentSearch(asked, index, 5, S)
    plan = _plan(search.lists.select("term", "n"))
    used = {r.b for r in search.needed.select(postings.bucket_of(F.col("term"), 16).alias("b")).collect()}
    folders = {r.f.split("bucket=")[1].split("/")[0] for r in index.of(sorted(used))[0].select(F.input_file_name().alias("f")).distinct().collect()}
    assert folders == {str(b) for b in used} and len(used) <= 2
    scan = plan[plan.index("PartitionFilters"):].split("\n")[0]
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1]
    assert all(re.search(rf"\b{b}\b", filters) for b in used) and "postings" not in scan[scan.index("ReadSchema"):]
    assert "tokens" not in _plan(search.scored(search.first))


def test_blocks_that_cannot_win_stay_closed(spark):
    chunks = _zipf_chunks(spark)
    index = postings.write_index(chunks, block=16)
    texts = ["the", "half the", "w1 the", "the or w2", "w3 or w5 half", '"the half" or w7', "w1 -the", "w1 -half", "nowhere or the", "w1 nowhere"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    every = replace(S, first_blocks=1_000_000)
    full = lexical.content_hits(asked, index, 5, every).collect()
    assert lexical.ContentSearch(asked, index, 5, every).heads.count() == lexical.ContentSearch(asked, index, 5, every).first.count()
    search = lexical.ContentSearch(asked, index, 5, S)
    assert sorted(map(tuple, search.hits().collect())) == sorted(map(tuple, full)) and len({r.query_id for r in full}) >= 7
    early = lexical.top_per_group(search.scored(search.first), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 5)
    heads = {r.query_id: r["count"] for r in search.heads.groupBy("query_id").count().collect()}
    late = {r.query_id: r["count"] for r in search.opened(early).groupBy("query_id").count().collect()}
    # Of the blocks of the word that all chunks hold, nearly all are skipped.
    assert heads[0] > 150 and late.get(0, 0) + S.first_blocks < heads[0] / 5


def test_scope_of_indexed_search(spark):
    chunks = _zipf_chunks(spark).withColumns({"effective_from": F.expr("date_add(date'2024-01-01', chunk_id % 20)"), "effective_to": F.expr("if(chunk_id % 5 = 0, date'2024-01-08', null)")})
    asked = spark.createDataFrame([(0, "the", "en", []), (1, "the half", "fr", ["1", "2"]), (2, "w1 or w2", "en", None)], "query_id int, query_text string, language string, act_ids array<string>").withColumn(
        "as_of", F.expr("date'2024-01-10'"))
    got = {}
    for r in lexical.content_hits(asked, postings.write_index(chunks, block=8), 6, S).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    rows = [r for r in chunks.collect() if str(r.effective_from) <= "2024-01-10" and (r.effective_to is None or str(r.effective_to) >= "2024-01-10")]
    for q, language, acts, options in ((0, "en", None, [["the"]]), (1, "fr", {"1", "2"}, [["the", "half"]]), (2, "en", None, [["w1"], ["w2"]])):
        scores = {}
        for r in rows:
            if r.language == language and (acts is None or r.act_id in acts):
                score = sum(brute_cover(r.tokens, o) for o in options if set(o) <= set(r.tokens))
                if score:
                    scores[r.chunk_id] = round(score, 9)
        assert got[q] == sorted(scores, key=lambda c: (-scores[c], c))[:6]


def test_paths_with_a_word_in_common(spark):
    """All paths hold "section"; a question of it meets one row per kind of path, not all paths."""
    rng = random.Random(3)
    paths = [(i, " > ".join(["Section Section" if i % 2 else "Section", rng.choice(["Wages", "Court", "Taxes"]), f"number{i}"]), "en" if i % 3 else "fr") for i in range(400)]
    paths += [(1000 + i, paths[i][1], paths[i][2]) for i in range(50)] + [(2000, None, "en"), (2001, "", "en")]
    texts = ["section wages", "section", "number7 section", "number3 number4", "court taxes section number9", "zzzz"]
    frame = spark.createDataFrame(paths, "chunk_id int, hierarchy_path string, language string")
    asked = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "query_id int, query_text string, language string")
    got = {}
    for r in lexical.path_hits(asked, frame, 9, replace(S, common_share=8)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    want = {}
    for i, text in enumerate(texts):
        scores = {c: round(0.1 * sum(w in text.split() for w in (p or "").lower().replace(">", " ").split()), 9) for c, p, lang in paths if lang == "en"}
        want[i] = [(c, s) for c, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if s][:9]
    assert got == {i: w for i, w in want.items() if w}


def test_only_texts_of_candidates_are_joined(spark):
    """Reranking cuts the texts to those of the candidates before they are shuffled."""
    found = spark.createDataFrame([("q", f"c{i}", 1.0 - i / 100) for i in range(4)], "query_id string, chunk_id string, score double")
    asked = spark.createDataFrame([("q", "rest day")], "query_id string, query_text string")
    texts = spark.createDataFrame([(f"c{i}", "rest" if i % 2 else "x") for i in range(50)] + [("c1", "rest day")], "chunk_id string, content string")
    ranked = retrieval.rerank(found, asked, texts)
    assert [r.chunk_id for r in ranked.orderBy("rank").collect()] == ["c1", "c1", "c3", "c0", "c2"]
    physical = ranked._jdf.queryExecution().sparkPlan().toString()
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in physical.splitlines())


def test_hybrid_chunks_carry_no_texts(spark, tmp_path):
    """The joined chunks are written for the search; the index holds the tokens and texts are read from their own table."""
    from workload import search
    from workload.base import Tables

    spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "fr", "s"), (3, "c", "en", None)], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, [0.5, 1.0]), (3, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    chunks = search._hybrid_chunks(Tables(spark, str(tmp_path)))
    assert sorted(chunks.columns) == ["act_id", "chunk_id", "embedding", "hierarchy_path", "language"]
    assert sorted((r.chunk_id, r.language, r.embedding) for r in chunks.collect()) == [(1, "en", [0.5, 1.0]), (2, "fr", None), (3, "en", None)]


def test_a_block_is_scored_by_a_few_queries_at_a_time():
    import tracemalloc
    rng = np.random.default_rng(1)
    unit = lambda n: vectors._unit(rng.normal(size=(n, 16)))
    asked = vectors._Block({"query_id": list(range(1024)), "embedding": unit(1024)})
    block = {"chunk_id": np.arange(4096), "embedding": unit(4096)}
    tracemalloc.start()
    found = {int(i): set(c[q == i].tolist()) for q, c, _ in vector_index.best_in_block(asked, block, 5) for i in np.unique(q)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.round(asked.matrix @ block["embedding"].T, vectors.SCORE_DIGITS)
    assert found == {i: set(np.flatnonzero(row >= np.sort(row)[-5]).tolist()) for i, row in enumerate(exact)}
    # All scores at once are 33.5 MB, and several times that with what is made of them.
    assert peak < 16e6
