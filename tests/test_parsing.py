from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from provenant.operators import parsing

NESTED = """<html><body><h1>Law</h1><div class="lawCon"><div class="chapter"><div class="chapter_title">Chapter I Rest</div>
<div class="section" id="s"><span class="sec_head">103. Weekly holiday</span><a href="/act-9/section-77.html?lang=en">go</a>
<div class="sub_section"><span class="sub_num">(1)</span><span class="sub_text">One day.</span></div>
<div class="clause"><span class="clause_num">(a)</span><span class="clause_text">ছুটি ১০৩</span></div></div>
<div class="section"><h3>104. Leave</h3><div class="sec_content">Ten days.<script>evil()</script></div></div></div></div></body></html>"""
HEADED = "<body>Intro<h2>Chapter I</h2><div><h3>১. নাম</h3><p>এই আইন।</p><div><p>দ্বিতীয়</p></div></div><h3>2. Start</h3><table><tr><td>At once</td></tr></table></body>"
TABLE = '<body><table class="section"><tr><th>7. Fines</th></tr><tr><td>Pay up</td></tr></table></body>'.replace('class="section"', 'class="chtitle"')


def pages(spark, **html):
    rows = [(i, f"http://x/{i}", h) for i, h in html.items()]
    return spark.createDataFrame(rows, "page_id string, url string, html string")


def test_nested_classes(spark):
    nodes, warnings = parsing.parse_pages(pages(spark, a=NESTED), "http://base")
    rows = {r.ordinal: r for r in nodes.collect()}
    assert [(r.kind, r.number, r.parent_ordinal) for _, r in sorted(rows.items())] == [
        ("chapter", "Chapter I Rest", None), ("section", "103", 0), ("subsection", "1", 1), ("clause", "a", 1), ("section", "104", 0)]
    assert rows[1].text == "" and rows[1].source_url == "http://base/act-9/section-77.html"
    assert rows[2].text == "One day." and rows[3].text == "ছুটি ১০৩" and rows[4].text == "Ten days."
    assert warnings.count() == 0


def test_headings_count_each_text_once(spark):
    nodes = parsing.parse_pages(pages(spark, a=HEADED))[0].orderBy("ordinal").collect()
    assert [(r.kind, r.number, r.title, r.text) for r in nodes] == [
        ("section", "?", None, "Intro"), ("chapter", "Chapter I", "Chapter I", ""), ("section", "১", "১. নাম", "এই আইন। দ্বিতীয়"),
        ("section", "2", "2. Start", "At once")]


def test_tables_flat_and_empty(spark):
    nodes, warnings = parsing.parse_pages(pages(spark, t=TABLE, f="<body><b>just</b> text</body>", e="", n=None))
    rows = {r.page_id: r for r in nodes.collect()}
    assert (rows["t"].number, rows["t"].title, rows["t"].text) == ("7", "7. Fines", "Pay up")
    assert (rows["f"].kind, rows["f"].number, rows["f"].text) == ("section", "1", "just text")
    assert {r.page_id for r in warnings.collect()} == {"e", "n"} and set(rows) == {"t", "f"}


def test_garbage_never_fails(spark):
    nodes, _ = parsing.parse_pages(pages(spark, a="<div class='section'><<<>&#xffffff; <p", b="</div></div>x<div class=section>y"))
    assert nodes.count() >= 1


def test_a_failing_walk_warns(spark, monkeypatch):
    from provenant.operators import markup
    def broken(self, html):
        raise RuntimeError("boom")
    monkeypatch.setattr(markup._Walker, "feed", broken)
    rows = list(markup.element_rows("<p>", "u", "structural"))
    assert rows == [(0, None, None, None, None, "", "u", "<p>", "unexpected error: boom")]


def test_amendments(spark):
    note = '<p class="footnote">Substituted by Act No. XLII of 2006, s. 3</p><i class="amend">omitted in 2013</i><p class="footnote">inserted by Act 5 of 2013</p><p class="footnote">see 2020</p>'
    rows = spark.createDataFrame([("a", note, datetime(2024, 5, 1)), ("b", "<p>no note</p>", datetime(2024, 5, 1))], "id string, html string, at timestamp")
    found = parsing.amendments(rows, "html", "at", ["id"])
    assert [(r.id, r.ord, str(r.effective_from), r.amending_act_slug, r.provenance) for r in found.orderBy("id", "ord").collect()] == [
        ("a", 0, "2006-01-01", "act-2006", "annotated"), ("a", 1, "2013-01-01", None, "annotated"), ("a", 2, "2013-01-01", "act-2013", "annotated"),
        ("b", 0, "2024-05-01", None, "snapshot")]
    latest = {r.id: r for r in parsing.latest_amendment(found, ["id"]).collect()}
    assert latest["a"].raw_annotation == "omitted in 2013" and latest["b"].provenance == "snapshot"


def test_heading_path_has_no_shuffle_and_no_python(spark):
    plan = parsing.heading_sections(pages(spark, a=HEADED))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_walker_holds_few_pages_at_once():
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "url": ["u"] * 200, "html": ["<table class='part'><tr><td>x</td></tr></table>"] * 199 + [""],
                                        "inner": ["<table class='part'><tr><td>x</td></tr></table>"] * 199 + [""]})
    walked = list(parsing._walked(iter([batch]), ["table"]))
    assert max(b.num_rows for b in walked) <= parsing.PAGES_AT_ONCE
    rows = [r for b in walked for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(200)) and [r["kind"] for r in rows] == ["part"] * 199 + [None]


def test_a_page_is_passed_once_for_its_container(spark):
    """What a container holds is taken by one pattern over the page, and not again where it is compared."""
    html = '<html><body class="x"><div class="a lawCon"><p>1</p><div>2</div></div>rest</body></html>'
    pages = spark.createDataFrame([(html,), ('<div class="lawCon"></div><p>whole</p>',), ("<body class='lawCon'>open</body> after",)], "html string")
    held = pages.select(parsing.content_container(F.col("html"), [(".", "lawCon")]).alias("inner"))
    assert [r.inner for r in held.collect()] == ["<p>1</p><div>2</div>", '<div class="lawCon"></div><p>whole</p>', "open"]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lawCon(?![\\w-])[^>]*>(.*?)") == 1
