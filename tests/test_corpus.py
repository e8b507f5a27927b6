import random
from datetime import date, datetime

from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from provenant.operators import bucketed, chunking, embedding, hierarchy, revisions
from provenant.settings import Settings

import pytest

TIGHT = Settings(chunk_target_tokens=10, chunk_max_tokens=20, chunk_overlap_tokens=3)
EMPTY = ("id string, provision_id string, language string, translation_status string, text string, effective_from date, effective_to date, "
         "amending_act_id string, provenance string, content_hash string, source_url string, fetched_at timestamp")


def nodes(spark):
    rows = [("t", "a", None, "act", "0", None), ("t", "1", "a", "chapter", "10", "Rest"), ("t", "2", "1", "section", "103", " Weekly "), ("t", "3", "2", "subsection", "2", None),
            ("t", "4", "3", "clause", "a", None), ("t", "5", "a", "section", "2", None), ("t", "6", "lost", "section", "9", None)]
    return spark.createDataFrame(rows, "act_id string, id string, parent_id string, kind string, number string, title string")


def test_paths_and_labels(spark):
    rows = {r.id: r for r in hierarchy.descend(nodes(spark).withColumn("root", F.lit("Law, 2006")), "act_id", "root").collect()}
    assert {k: r.sort_path for k, r in rows.items()} == {"1": "10", "2": "10/103", "3": "10/103/2", "4": "10/103/2/a", "5": "2"}
    assert rows["4"].hierarchy_path == "Law, 2006 > Chapter 10 (Rest) > Section 103 (Weekly)(2)(a)"
    assert sorted(r.sort_path for r in rows.values())[0] == "10" and "6" not in rows
    padded = {r.id: r.sort_path for r in hierarchy.sort_paths(nodes(spark), pad=4).collect()}
    assert padded["5"] == "0002" < padded["1"]


def test_nesting_and_reading_order(spark):
    flat = hierarchy.sort_paths(nodes(spark)).withColumn("parent_id", F.when(F.col("parent_id") != "a", F.col("parent_id")))
    tree = {r.id: r for r in hierarchy.nest(flat).collect()}
    assert set(tree) == {"1", "5"} and tree["1"].children[0].children[0].children[0].id == "4"
    order = {r.id: (r.prev_id, r.next_id) for r in hierarchy.reading_order(flat).collect()}
    assert order == {"2": (None, "3"), "3": ("2", "4"), "4": ("3", "5"), "5": ("4", None)}


def test_deep_and_wide_trees_nest_without_a_join_per_level(spark):
    rng = random.Random(3)
    rows = [(f"t{i % 2}", f"n{i}", None if i < 4 else f"n{i - 2 if i < 16 else i % 2 + 2 * rng.randrange(0, i // 4)}", f"{rng.randrange(30):02}") for i in range(150)]
    frame = spark.createDataFrame(rows, "act_id string, id string, parent_id string, sort_path string")

    def plain(parent, tree):
        return [(r[1], plain(r[1], tree)) for r in sorted((r for r in rows if r[0] == tree and r[2] == parent), key=lambda r: (r[3], r[1]))]
    tuples = lambda r: (r.id, [tuples(c) for c in r.children])
    nested = hierarchy.nest(frame, fields=("id", "sort_path"))
    got = {r.id: tuples(r)[1] for r in nested.collect()}
    assert got == {key: below for tree in ("t0", "t1") for key, below in plain(None, tree)}
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.fixture
def merged_by_sort(spark):
    """Joins as large tables have them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_nesting_shuffles_nodes_to_their_parents_and_roots_only(spark, monkeypatch, merged_by_sort):
    seen, keep = [], hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda rows: (seen.append(rows), keep(rows))[1])
    rows = [("t", "a", None, "1"), ("t", "c", "a", "3"), ("t", "b", "a", "2"), ("t", "d", "c", "1"), ("t", "e", "c", "1"), ("t", "z", None, "9"), ("t", "lost", "none", "1")]
    rows += [rows[3]] + [("u", f"r{i}", None, "1") for i in range(50)] + [("u", f"k{i}", f"r{i}", "1") for i in range(50)]
    got = {r.id: r for r in hierarchy.nest(spark.createDataFrame(rows, "act_id string, id string, parent_id string, sort_path string"), fields=("id",)).collect()}
    assert set(got) == {"a", "z", *[f"r{i}" for i in range(50)]} and all([c.id for c in got[f"r{i}"].children] == [f"k{i}"] for i in range(50))
    assert [(c.id, [x.id for x in c.children]) for c in got["a"].children] == [("b", []), ("c", ["d", "d", "e"])] and got["z"].children == []
    # The nodes and what their parents know, then the deal by root.
    assert _exchanges(seen[-1]) == 3


def test_small_trees_are_shuffled_by_their_tree_only(spark, monkeypatch, merged_by_sort):
    seen, keep = [], hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda rows: (seen.append(_exchanges(rows)), keep(rows))[1])
    rows = [(t, i, None if i == 0 else (i - 1) // 2, f"{9 - i}") for t in range(40) for i in range(7)]
    frame = spark.createDataFrame(rows, "act_id int, id int, parent_id int, sort_path string")
    got = {r.act_id: r for r in hierarchy.nest(frame, fields=("id",)).collect()}
    assert len(got) == 40 and all([(c.id, [x.id for x in c.children]) for c in r.children] == [(2, [6, 5]), (1, [4, 3])] for r in got.values())
    assert sum(seen) == 2, seen
    seen.clear()
    hierarchy.nest(frame.repartition("act_id"), fields=("id",)).collect()
    assert sum(seen) == 2, seen


def test_small_trees_nest_as_large_ones_do(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for t in range(30):
        for i in range(rng.randrange(1, 30)):
            up = None if i == 0 or rng.random() < .1 else f"n{rng.randrange(i)}" if rng.random() < .9 else rng.choice(["none", f"n{i}", f"n{i + 1}"])
            rows.append((f"t{t}", f"n{i}", up, rng.choice(["1", "2", None])))
    rows += [("deep", f"d{i}", f"d{i - 1}" if i else None, "1") for i in range(20)]
    rows += [("t3", "n0", None, "1"), ("t4", "n1", "n0", "9"), (None, "a", None, "1"), (None, "b", "a", "1"), ("t5", None, "n0", "1"), ("t6", None, None, "1")]
    frame = spark.createDataFrame(rows, "act_id string, id string, parent_id string, sort_path string")
    tuples = lambda r: (r.id, [tuples(c) for c in r.children])
    content = lambda: sorted(((str(r.act_id), str(r.id), str(r.sort_path), str(tuples(r))) for r in hierarchy.nest(frame, fields=("id",)).collect()))
    mixed = content()
    monkeypatch.setattr(hierarchy, "WHOLE_NODES", 12)
    some = content()
    monkeypatch.setattr(hierarchy, "WHOLE_NODES", 0)
    assert mixed == some == content()


def _merge(spark, current, rows, day):
    incoming = spark.createDataFrame([(p, l, t, "u", day, i) for i, (p, l, t) in enumerate(rows)], "provision_id string, language string, text string, source_url string, fetched_at timestamp, ordinal int")
    merged, outcomes = revisions.merge_revisions(current, incoming)
    merged = merged.collect()
    return spark.createDataFrame(merged, EMPTY), {(r.provision_id, r.language): (r.outcome, r.collisions) for r in outcomes.collect()}


def test_revision_lifecycle(spark):
    empty = spark.createDataFrame([], EMPTY)
    first, outcomes = _merge(spark, empty, [("p", "bn", "এক"), ("p", "en", "one"), ("q", "en", ""), ("r", "en", "x"), ("r", "en", "y")], datetime(2024, 1, 1))
    assert outcomes == {("p", "bn"): ("new", 0), ("p", "en"): ("new", 0), ("r", "en"): ("new", 1)}
    assert {r.language: r.translation_status for r in first.filter("provision_id = 'p'").collect()} == {"bn": "authoritative", "en": "reference_translation"}
    assert [r.text for r in first.filter("provision_id = 'r'").collect()] == ["y"]
    again, outcomes = _merge(spark, first, [("p", "bn", "এক"), ("p", "en", "one")], datetime(2024, 2, 1))
    assert set(outcomes.values()) == {("unchanged", 0)} and again.count() == 3
    changed, outcomes = _merge(spark, again, [("p", "en", "two")], datetime(2024, 3, 1))
    assert outcomes == {("p", "en"): ("updated", 0)}
    rows = sorted((r.text, r.effective_from, r.effective_to) for r in changed.filter("provision_id = 'p' and language = 'en'").collect())
    assert rows == [("one", date(2024, 1, 1), date(2024, 3, 1)), ("two", date(2024, 3, 1), None)]
    stale, outcomes = _merge(spark, changed, [("p", "en", "zero")], datetime(2024, 2, 1))
    assert outcomes == {("p", "en"): ("stale", 0)} and stale.count() == changed.count()


@hyp(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("pqr"), st.sampled_from(["x", "y", "z", ""])), max_size=5), min_size=1, max_size=3))
def test_open_rows_and_windows(spark, batches):
    current = spark.createDataFrame([], EMPTY)
    for month, batch in enumerate(batches, 1):
        current, _ = _merge(spark, current, [(p, "en", t) for p, t in batch], datetime(2024, month, 1))
    by_key = {}
    for r in current.collect():
        by_key.setdefault(r.provision_id, []).append(r)
    for rows in by_key.values():
        assert sum(r.effective_to is None for r in rows) == 1
        rows.sort(key=lambda r: r.effective_from)
        assert all(a.effective_to == b.effective_from for a, b in zip(rows, rows[1:]))


def test_runs(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    steps = spark.createDataFrame([("a", "bn", "new", None, 3), ("a", "bn", "unchanged", None, 0), ("a", "en", "new", None, 1), ("a", "en", None, "bad page", 0), ("b", "bn", None, None, 0)],
                                  "act_id string, language string, outcome string, error string, chunks int")
    runs = {(r.act_id, r.language): r for r in revisions.run_log(steps, now, now).collect()}
    assert [(k, r.status, r.provisions_processed, r.chunks_created, r.error) for k, r in sorted(runs.items())] == [
        (("a", "bn"), "succeeded", 2, 3, None), (("a", "en"), "failed", 0, 0, "bad page"), (("b", "bn"), "succeeded", 0, 0, None)]
    live = spark.createDataFrame([("1", "a", "running"), ("2", "b", "running"), ("3", "a", "succeeded")], "id string, act_id string, status string").withColumns(
        {"error": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
    assert {r.id: (r.status, r.error, r.finished_at is None) for r in revisions.cancel_runs(live, now, "a").collect()} == {
        "1": ("failed", "Cancelled by operator", False), "2": ("running", None, True), "3": ("succeeded", None, True)}


def expected_chunks(text, path, s):
    """The rules written out plainly for one text."""
    size = lambda x: max(1, len(x) // 4)
    text = text.strip()
    if not text:
        return []
    if size(path + "\n" + text) <= s.chunk_max_tokens:
        return [f"{path}\n{text}"]
    budget = max(1, s.chunk_max_tokens - size(path) - 1)
    import re
    pieces = []
    for block in re.split(r"\n{2,}", text):
        if block.strip():
            lines = [x.strip() for x in block.split("\n") if x.strip()]
            pieces += lines if size(block) > budget and all(size(x) <= budget for x in lines) else [block.strip()]
    bodies, used = [[]], 0
    for piece in pieces:
        if bodies[-1] and used + size(piece) > budget:
            bodies.append([])
            used = 0
        bodies[-1].append(piece)
        used += size(piece)
    joined = ["\n\n".join(b) for b in bodies]
    return [f"{path}\n{b if i == 0 else (joined[i - 1][-s.chunk_overlap_tokens * 4:] + chr(10) + b).strip()}" for i, b in enumerate(joined)]


def test_chunks_against_the_plain_rules(spark):
    rng = random.Random(7)
    texts = ["", "  \n ", "short", "x" * 500, "a\nb", "ক" * 90]
    texts += ["".join(rng.choice(["word ", "লম্বা ", "\n", "\n\n", "x" * 30, " "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame([(i, "A > B", t) for i, t in enumerate(texts)], "id int, hierarchy_path string, text string")
    got = {}
    for r in chunking.chunk(frame, TIGHT).orderBy("id", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.id, [])) and r.token_count == max(1, len(r.content) // 4)
        got[r.id].append(r.content)
    assert got == {i: e for i, t in enumerate(texts) if (e := expected_chunks(t, "A > B", TIGHT))}


def test_replace_chunks(spark):
    old = spark.createDataFrame([("r1", 0, "a"), ("r1", 1, "b"), ("r2", 0, "c")], "revision_id string, chunk_index int, content string")
    new = spark.createDataFrame([("r1", 0, "z")], old.schema)
    assert sorted(r.content for r in revisions.replace_chunks(old, new).collect()) == ["c", "z"]


def test_bucketed_revisions(spark, tmp_path):
    """Random batches appended to the store equal the plain merge; a batch touches its buckets only and can be repeated."""
    from pyspark.sql import types as T
    schema, root, rng = T.StructType.fromDDL(EMPTY), str(tmp_path / "store"), random.Random(5)
    bucketed.begin_revisions(spark, root, schema)
    plain = spark.createDataFrame([], schema)
    kind = "provision_id string, language string, text string, source_url string, fetched_at timestamp, ordinal int"
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    fields = ["id", "provision_id", "language", "text", "effective_from", "effective_to", "content_hash"]
    content = lambda rows: sorted(map(str, rows.select(*fields).collect()))
    for batch in range(5):
        rows = [(rng.choice("pqrstuvw"), "en", rng.choice(["x", "y", "z", ""]), "u", datetime(2024, 1, 1 + batch // 2, rng.randrange(24)), i) for i in range(6)]
        incoming = spark.createDataFrame(rows, kind)
        merged, told = revisions.merge_revisions(plain, incoming)
        before = files()
        outcomes = bucketed.merge_revisions(spark, root, incoming, batch, schema, 16)
        assert sorted(map(str, outcomes.collect())) == sorted(map(str, told.select(*outcomes.columns).collect()))
        plain = spark.createDataFrame(merged.collect(), schema)
        after = files()
        assert {k: v for k, v in after.items() if k in before} == before
        touched = {r[0] for r in incoming.select(F.pmod(F.xxhash64("provision_id", "language"), F.lit(16))).collect()}
        assert {int(k.split("bucket=")[1].split("/")[0]) for k in set(after) - set(before)} <= touched
        assert content(bucketed.read_revisions(spark, root, schema)) == content(plain)
        bucketed.merge_revisions(spark, root, incoming, batch, schema, 16)
        assert content(bucketed.read_revisions(spark, root, schema)) == content(plain)
    bucketed.compact_revisions(spark, root, str(tmp_path / "small"), 5, schema, 16)
    assert content(bucketed.read_revisions(spark, str(tmp_path / "small"), schema)) == content(plain)
    last = spark.createDataFrame([("p", "en", "new", "u", datetime(2024, 5, 1), 0)], kind)
    bucketed.merge_revisions(spark, str(tmp_path / "small"), last, 5, schema, 16)
    assert content(bucketed.read_revisions(spark, str(tmp_path / "small"), schema)) == content(revisions.merge_revisions(plain, last)[0])


def test_texts_of_a_batch_are_shuffled_once(spark, tmp_path, monkeypatch, merged_by_sort):
    from pyspark.sql import types as T
    schema, root, seen, write = T.StructType.fromDDL(EMPTY), str(tmp_path), [], bucketed._append
    bucketed.begin_revisions(spark, root, schema)
    monkeypatch.setattr(bucketed, "_append", lambda rows, path, batch: (seen.append(rows), write(rows, path, batch)))
    monkeypatch.setattr(bucketed, "PART_ROWS", 1)
    rows = [("p", "en", "x", "u", datetime(2024, 1, 1))] * 3 + [("p", "en", "y", None, datetime(2024, 1, 2)), ("p", None, "x", "u", datetime(2024, 1, 1))]
    rows += [(f"q{i}", "en", f"t{i}", "u", datetime(2024, 1, 1)) for i in range(20)]
    bucketed.merge_revisions(spark, root, spark.createDataFrame(rows, "provision_id string, language string, text string, source_url string, fetched_at timestamp"), 0, schema, 4)
    got = sorted((r.provision_id, str(r.language), r.text, str(r.source_url), str(r.effective_to)) for r in bucketed.read_revisions(spark, root, schema).collect())
    assert got == sorted([("p", "en", "x", "u", "2024-01-02"), ("p", "en", "y", "None", "None"), ("p", "None", "x", "u", "None")] + [(f"q{i}", "en", f"t{i}", "u", "None") for i in range(20)])
    assert "text" in seen[0].columns and _exchanges(seen[0]) == 1


def test_bucketed_chunks(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([("r1", 0, "a"), ("r1", 1, "b"), ("r2", 0, "c")], "revision_id string, chunk_index int, content string")
    bucketed.begin_chunks(spark, root, old.schema)
    assert bucketed.read_chunks(spark, root, old.schema).count() == 0
    bucketed.replace_chunks(old, root, 0)
    for _ in range(2):
        bucketed.replace_chunks(spark.createDataFrame([("r1", 0, "z"), ("r3", 0, "w")], old.schema), root, 1)
        assert sorted(r.content for r in bucketed.read_chunks(spark, root, old.schema).collect()) == ["c", "w", "z"]


def test_embedding_plugin(spark):
    rows = spark.createDataFrame([(i, "t" * (i + 1)) for i in range(10)], "id int, text string")
    seen = Settings(embed_batch_size=4)

    def plugin(texts, role):
        assert len(texts) <= 4 and role == "query"
        return [[float(len(x)), 1.0] for x in texts]
    out = embedding.embed(rows, "text", "query", plugin, seen).collect()
    assert {r.id: list(r.embedding) for r in out} == {i: [i + 1.0, 1.0] for i in range(10)}
    with pytest.raises(ValueError):
        embedding.embed(rows, "text", "passage", plugin)
    with pytest.raises(Exception, match="empty text"):
        embedding.embed(rows.withColumn("text", F.lit(" ")), "text", "query", plugin).collect()


def test_centroids(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0]), ("b", None)], "act string, embedding array<float>")
    assert {r.act: r.centroid for r in embedding.centroids(rows, ["act"]).collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
