import json
from datetime import date, datetime

import pytest

from provenant import schemas
from provenant.sources import evaluation, links, registry, snapshots, tables


def test_registry(spark, tmp_path):
    good = {"slug": "a", "short_name": "A", "full_name_en": "A", "full_name_bn": "ক", "act_number": "1", "act_year": 2006,
            "sources": [{"language": "bn", "source_url": "u"}, {"language": "en", "source_url": "v"}]}
    (tmp_path / "acts.json").write_text(json.dumps(good) + "\n")
    acts, sources = registry.read_registry(spark, str(tmp_path))
    row = acts.collect()[0]
    assert (row.slug, row.status, row.ministry) == ("a", "in_force", None)
    assert sorted((r.language, r.source_url) for r in sources.collect()) == [("bn", "u"), ("en", "v")]
    (tmp_path / "bad.json").write_text(json.dumps({"slug": "b"}) + "\n")
    with pytest.raises(Exception, match="lacks: short_name"):
        registry.read_registry(spark, str(tmp_path))[0].collect()


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "labour").mkdir()
    (tmp_path / "labour" / "bn.html").write_text("<p>\nছুটি</p>", encoding="utf-8")
    (tmp_path / "labour" / "bn.meta.json").write_text('{"url": "http://u", "fetched_at": "2024-01-02T03:04:05+00:00"}')
    rows = snapshots.read_snapshots(spark, str(tmp_path)).collect()
    assert [(r.slug, r.language, r.url, r.html, r.fetched_at) for r in rows] == [("labour", "bn", "http://u", "<p>\nছুটি</p>", datetime(2024, 1, 2, 3, 4, 5))]


def test_written_files_are_listed_by_few_tasks(spark, tmp_path):
    root, n = str(tmp_path / "files"), 100
    pages = spark.createDataFrame([(f"p{i}", "bn", "u", f"<p>\n{i}</p>", datetime(2024, 1, 1)) for i in range(n)],
                                  "slug string, language string, url string, html string, fetched_at timestamp")
    snapshots.write_snapshot_files(pages, root)
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(name), spark.sparkContext
    context.setJobGroup("listing", "")
    rows = snapshots.read_snapshot_files(spark, root)
    tracker = context.statusTracker()
    listed = [tracker.getStageInfo(stage).numTasks for job in tracker.getJobIdsForGroup("listing") for stage in tracker.getJobInfo(job).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert listed and max(listed) <= snapshots.LISTING_TASKS_PER_CORE * context.defaultParallelism
    assert spark.conf.get(name) == before
    assert {r.slug: r.html for r in rows.collect()} == {f"p{i}": f"<p>\n{i}</p>" for i in range(n)}


ADDRESSED = "slug string, language string, url string, html string, fetched_at timestamp"


@pytest.mark.parametrize("workers", [True, False])
def test_snapshot_files_keep_any_page(spark, tmp_path, monkeypatch, workers):
    if not workers:
        monkeypatch.setattr(snapshots, "_address", lambda *_: None)
    root, day = str(tmp_path / "a b"), datetime(2024, 1, 1)
    rows = [("a/b c", "bn", "u", "ছুটি\r\n\n<p>", day), ("..", "en", None, "", day), ("x", "en", "u", None, day), (None, "en", "u", "lost", day), ("%41=é", "b:n", "u", "y", day),
            ("a", "e", "u", "z", day), ("twice", "en", "u", "one", day), ("twice", "en", "v", "two", None), ("a", "en", "u", "a" * 100_000, day)]
    snapshots.write_snapshot_files(spark.createDataFrame(rows, ADDRESSED).repartition(3), root)
    got = snapshots.read_snapshot_files(spark, root).collect()
    files = {(slug, language): [x[3] or "" for x in rows if x[:2] == (slug, language)] for slug, language, *_ in rows}
    want = [(*x[:3], html, x[4]) for x in rows if x[0] for html in files[x[:2]]]
    assert sorted(map(str, [(r.slug, r.language, r.url, r.html, r.fetched_at) for r in got])) == sorted(map(str, want))
    assert len([p for p in (tmp_path / "a b" / "html").rglob("*.txt") if not p.name.startswith(".")]) == len(rows)


def test_snapshot_files_are_not_indexed_by_the_driver(spark, tmp_path):
    """Tasks list and read the pages, whose texts are not shuffled to their addresses."""
    root = str(tmp_path)
    pages = spark.createDataFrame([(f"p{i}", "en", "u", f"{i}", datetime(2024, 1, 1)) for i in range(200)], ADDRESSED)
    snapshots.write_snapshot_files(pages, f"{root}/files")
    rows = snapshots.read_snapshot_files(spark, f"{root}/files")
    assert not any("/html/" in name for name in rows.inputFiles())
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.slug: r.html for r in rows.collect()} == {f"p{i}": f"{i}" for i in range(200)}


def _page(slug, html):
    return (slug + "-bn", slug, "bn", "u", html, datetime(2024, 1, 1), False)


def test_snapshot_store(spark, tmp_path):
    root = str(tmp_path / "store")
    frame = lambda *rows: spark.createDataFrame(list(rows), "page_id string, slug string, language string, url string, html string, fetched_at timestamp, not_modified boolean")
    read = lambda: {r.slug: r.html for r in snapshots.read_snapshot_store(spark, root).collect()}
    snapshots.write_snapshots(frame(_page("a", "1")), root)
    snapshots.write_snapshots(frame(_page("a", "2"), _page("b", "2")), root)
    assert read() == {"a": "1", "b": "2"}
    snapshots.write_snapshots(frame(_page("a", "3")), root, force=True)
    assert read() == {"a": "3", "b": "2"}


def test_links(spark):
    html = '<a href="/act-9/section-5.html">x</a><a HREF="/act-9/chapter-6.html">y</a><a href="/act-9/section-5.html">z</a><a href="/act-9/chapter-5.html">w</a><a href="/other">o</a>'
    found = links.extract_links(spark.createDataFrame([(1, html)], "page_id int, html string"), "http://b")
    assert [(r.ord, r.link_id, r.url) for r in found.orderBy("ord").collect()] == [
        (0, "5", "http://b/act-9/section-5.html"), (1, "6", "http://b/act-9/chapter-6.html"), (2, "5", "http://b/act-9/chapter-5.html")]
    assert {r.link_id: r.url for r in links.link_index(found).collect()} == {"5": "http://b/act-9/chapter-5.html", "6": "http://b/act-9/chapter-6.html"}


def test_golden(spark, tmp_path):
    lines = [{"id": "1", "language": "bn", "question": "কী?", "category": "factual", "as_of_date": "2024-02-03", "must_cite": True},
             {"id": "2", "language": "en", "question": "?", "category": "factual"}]
    (tmp_path / "g.jsonl").write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n\n", encoding="utf-8")
    rows = evaluation.read_golden(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.must_cite, r.should_decline, r.as_of_date) for r in rows] == [("1", True, False, date(2024, 2, 3)), ("2", False, False, None)]


def test_latest_run(spark):
    runs = spark.createDataFrame([("a", "2024-01-01", "v1"), ("b", "2024-01-03", "v1"), ("c", "2024-01-02", "v1"), ("d", "2024-01-09", "v2")], "run_id string, timestamp string, prompt_version string")
    assert [r.run_id for r in evaluation.latest_run(runs, "v1").collect()] == ["b"]
    assert [r.run_id for r in evaluation.latest_run(runs, "v1", exclude="b").collect()] == ["c"]
    assert evaluation.latest_run(runs, "v9").count() == 0


def test_corpus_tables(spark, tmp_path):
    corpus = tables.Corpus(spark, str(tmp_path))
    rows = spark.createDataFrame([("f1", "q1", "helpful", None, datetime(2024, 1, 1)), ("f2", "q2", "bad", "c", datetime(2024, 1, 1))], schemas.FEEDBACK)
    good, bad = tables.quarantine(rows, "feedback")
    assert [r.id for r in good.collect()] == ["f1"] and [r.violations for r in bad.collect()] == [["rating"]]
    corpus.write("feedback", good)
    assert corpus.table("feedback").count() == 1 and corpus.lookup("feedback", id="nope").count() == 0
    plan = corpus.lookup("feedback", query_id="q1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(query_id,q1)" in plan
