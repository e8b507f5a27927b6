"""Sources, markup and parsing."""

from pyspark.sql import functions as F

from provenant.functions import text
from provenant.operators import parsing
from provenant import schemas
from provenant.plans.ingest import ingest
from provenant.plans.session import stored
from provenant.sources import evaluation, links, registry, snapshots, tables
from workload.base import query, scratch

HEADINGS = ["h1", "h2", "h3", "h4", "h5"]

# SQL spellings of the shared text functions, for the references that occur in the tables.
_HIDDEN = ["head", "script", "style", "noscript", "template", "iframe", "object", "svg"]


def sql_visible(html):
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in _HIDDEN:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({out}, '(?i)</?(?:embed|meta|link)\\b[^>]*>', '', 'g')"


def sql_decode(text):
    for name, value in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{value}')"
    return text


def sql_clean(text):
    out = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' *\\n *', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def sql_norm(text):
    return f"regexp_replace(regexp_replace({text}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


_BODY = "regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)', 1)"
_BLOCK = ("'(?i)</?(?:p|div|td|th|tr|li|ul|ol|table|tbody|thead|section|article|nav|footer|header|br|dl|dt|dd|h[1-6])"
          "\\b[^>]*>'")


def sql_text(markup):
    return sql_norm(sql_decode(f"regexp_replace(regexp_replace({markup}, {_BLOCK}, ' ', 'g'), '<[^>]*>', '', 'g')"))


def sql_kind(label):
    return (f"case when contains(lower({label}), 'part') then 'part' when contains(lower({label}), 'chap') then 'chapter' "
            f"when contains(lower({label}), 'sub') then 'subsection' when contains(lower({label}), 'clause') then 'clause' "
            "else 'section' end")


def sql_number(title):
    found = f"regexp_extract(trim({title}), '^(\\p{{Nd}}+[A-Z]?(?:\\.\\p{{Nd}}+)?)[.\\s]', 1)"
    return (f"case when {title} is null or {title} = '' then '?' when {found} <> '' then {found} "
            f"else substring(trim({title}), 1, 20) end")


@query("""
select sha256('supplier-' || s_suppkey) as id, 'supplier-' || s_suppkey as slug, s_name as short_name,
       s_name || ' Act' as full_name_en, s_name || ' Ain' as full_name_bn, 'No. ' || s_nationkey as act_number,
       cast(1900 + s_nationkey as integer) as act_year,
       case when s_acctbal > 0 then 'Ministry ' || s_nationkey end as ministry,
       case when s_acctbal < 0 then 'repealed' else 'in_force' end as status
from supplier""")
def registry_acts(t):
    return registry.registry(_registry_records(t))[0]


@query("""
select 'supplier-' || s_suppkey as slug, l as language, 'http://acts.example/' || s_suppkey || '?' || l as source_url
from supplier, unnest(['bn', 'en']) as u(l)""")
def registry_sources(t):
    return registry.registry(_registry_records(t))[1]


def _registry_records(t):
    key = F.col("s_suppkey").cast("string")
    source = lambda lang: F.struct(F.lit(lang).alias("language"), F.concat(
        F.lit("http://acts.example/"), key, F.lit("?" + lang)).alias("source_url"))
    return t.supplier.select(
        F.concat(F.lit("supplier-"), key).alias("slug"), F.col("s_name").alias("short_name"),
        F.concat("s_name", F.lit(" Act")).alias("full_name_en"), F.concat("s_name", F.lit(" Ain")).alias("full_name_bn"),
        F.concat(F.lit("No. "), F.col("s_nationkey").cast("string")).alias("act_number"),
        (1900 + F.col("s_nationkey")).cast("int").alias("act_year"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Ministry "), F.col("s_nationkey").cast("string"))).alias("ministry"),
        F.when(F.col("s_acctbal") < 0, "repealed").alias("status"), F.array(source("bn"), source("en")).alias("sources"))


def _snapshots(t):
    """Pages as snapshots: the host is the act, the first path part the language."""
    return t.pages.select(
        F.col("page_id").cast("string").alias("page_id"), F.concat(F.lit("act-"), "page_id").alias("slug"),
        F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("language"), "url", "html",
        F.timestamp_seconds(1_700_000_000 + F.col("page_id")).alias("fetched_at"), F.lit(False).alias("not_modified"))


_OLD = "starts_with(url, 'http://')"
_SNAP = """select cast(page_id as varchar) as page_id, 'act-' || page_id as slug,
 regexp_extract(html, '<html lang="(\\w+)"', 1) as language, url, sha256(html) as html_hash,
 make_timestamp((1700000000 + page_id) * 1000000) as fetched_at from pages"""


@query(f"select * from ({_SNAP}) where not {_OLD}")
def new_snapshots(t):
    pages = _snapshots(t)
    existing = pages.filter(F.col("url").startswith("http://"))
    return snapshots.new_snapshots(pages, existing).select(
        "page_id", "slug", "language", "url", F.sha2("html", 256).alias("html_hash"), "fetched_at")


@query(_SNAP)
def snapshot_store(t):
    """Write half of the pages, then all: the second write adds only what is missing."""
    root, pages = scratch(t.spark) + "/store", _snapshots(t).repartition(4, "language")
    return _stored(t, pages, root).select("page_id", "slug", "language", "url", F.sha2("html", 256).alias("html_hash"), "fetched_at")


def _stored(t, pages, root):
    """The store is partitioned by act; here the act is one per language so that few folders arise."""
    few = pages.withColumns({"act": F.col("slug"), "slug": F.when(F.col("url").startswith("http://"), "plain").otherwise("secure")})
    keep = ["page_id", "slug", "language", "url", "html", "fetched_at", "not_modified"]
    packed = few.withColumn("page_id", F.concat_ws("|", "page_id", "act")).select(*keep)
    snapshots.write_snapshots(packed.filter("slug = 'plain'"), root)
    snapshots.write_snapshots(packed, root)
    back = snapshots.read_snapshot_store(t.spark, root)
    return back.withColumns({"slug": F.split_part("page_id", F.lit("|"), F.lit(2)),
                             "page_id": F.split_part("page_id", F.lit("|"), F.lit(1))})


_LINK = r'href="(/(..?)[^"]*)"'
_LINKS_SQL = """
with found as (
  select page_id, unnest(regexp_extract_all(html, 'href="(/(..?)[^"]*)"', 1)) as path,
         unnest(regexp_extract_all(html, 'href="(/(..?)[^"]*)"', 2)) as link_id,
         unnest(range(len(regexp_extract_all(html, 'href="(/(..?)[^"]*)"', 1)))) as pos
  from pages),
firsts as (select page_id, path, link_id, min(pos) as pos from found group by all),
links as (select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as integer) as ord, link_id,
                 'https://acts.example' || path as url from firsts)
"""


@query(_LINKS_SQL + "select * from links")
def section_links(t):
    return links.extract_links(t.pages, "https://acts.example", _LINK)


@query(_LINKS_SQL + "select page_id, link_id, arg_max(url, ord) as url from links group by all")
def link_index(t):
    return links.link_index(links.extract_links(t.pages, "https://acts.example", _LINK))


@query("""
select 'b' || item_id as id, case when item_id % 2 = 0 then 'en' else 'bn' end as language, text as question,
       item_id % 3 = 0 as must_cite, item_id % 5 = 0 as should_decline,
       case when item_id % 4 = 0 then date '2024-01-15' end as as_of_date
from benchmark""")
def golden_roundtrip(t):
    """A golden set written as JSON lines and read back; absent flags become false."""
    root, item = scratch(t.spark), F.col("item_id")
    flag = lambda m: F.when(item % m == 0, True)
    evaluation.write_golden(t.benchmark.select(
        F.concat(F.lit("b"), item).alias("id"), F.when(item % 2 == 0, "en").otherwise("bn").alias("language"),
        F.col("text").alias("question"), flag(3).alias("must_cite"), flag(5).alias("should_decline"),
        F.when(item % 4 == 0, "2024-01-15").alias("as_of_date")), root + "/golden")
    return evaluation.read_golden(t.spark, root + "/golden").select(
        "id", "language", "question", "must_cite", "should_decline", "as_of_date")


def _eval_runs(t):
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("timestamp"),
        F.concat_ws("/", "o_orderpriority", F.year("o_orderdate")).alias("prompt_version"), F.lit("r1").alias("reranker_version"),
        F.create_map(F.lit("top_k"), F.lit("8")).alias("retrieval_config"),
        F.create_map(F.lit("total"), F.col("o_totalprice")).alias("metrics"), F.lit(84).alias("record_count"))


@query("""
select prompt_version, run_id, total from (
  select o_orderpriority || '/' || year(o_orderdate) as prompt_version, cast(o_orderkey as varchar) as run_id,
         o_totalprice as total,
         row_number() over (partition by o_orderpriority, year(o_orderdate) order by o_orderdate desc, cast(o_orderkey as varchar) desc) as n
  from orders where o_orderkey <> 17) where n = 1""")
def latest_eval_runs(t):
    """Runs appended to a store; the newest per prompt version, one run excluded."""
    root = scratch(t.spark) + "/runs"
    evaluation.append_run(_eval_runs(t), root)
    return evaluation.latest_runs(t.spark.read.parquet(root), exclude="17").select(
        "prompt_version", "run_id", F.col("metrics")["total"].alias("total"))


@query("select s_suppkey, s_name, s_acctbal from supplier where s_nationkey = 7 and s_suppkey > -1")
def key_lookup(t):
    return tables.lookup(t.supplier, s_nationkey=7).select("s_suppkey", "s_name", "s_acctbal")


@query("""
select event_id, event_type in ('view', 'click') as valid from events""")
def quarantine(t):
    """Rows outside the vocabulary of a column go to a frame of their own."""
    rating = F.when(F.col("event_type") == "view", "helpful").when(F.col("event_type") == "click", "not_helpful").otherwise(F.col("event_type"))
    good, bad = tables.quarantine(t.events.select("event_id", rating.alias("rating")), "feedback")
    return good.select("event_id", F.lit(True).alias("valid")).unionByName(
        bad.select("event_id", (F.size("violations") == 0).alias("valid")))


@query(f"select page_id, {sql_visible('html')} as visible from pages")
def visible_markup(t):
    return t.pages.select("page_id", text.drop_hidden(F.col("html")).alias("visible"))


_PAGE_TEXT = sql_clean(sql_decode("regexp_replace(" + sql_visible("html") + ", '<[^>]*>', chr(10), 'g')"))


@query(f"select page_id, {_PAGE_TEXT} as text from pages")
def page_text(t):
    return t.pages.select("page_id", text.html_text(F.col("html")).alias("text"))


@query(f"select doc_id, {sql_clean('replace(text, chr(46), chr(10) || chr(9) || chr(10) || chr(32) || chr(10))')} as text from documents")
def clean_whitespace(t):
    return t.documents.select("doc_id", text.clean_ws(F.replace(F.col("text"), F.lit("."), F.lit("\n\t\n \n"))).alias("text"))


@query(f"select doc_id, {sql_norm('text')} as title from documents")
def normal_titles(t):
    return t.documents.select("doc_id", text.norm_title(F.col("text")).alias("title"))


@query("select page_id, " + sql_norm(sql_decode(
    "regexp_replace(regexp_extract(" + sql_visible("html") + ", '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '<[^>]*>', '', 'g')")) + " as title from pages")
def page_titles(t):
    return t.pages.select("page_id", text.page_title(F.col("html")).alias("title"))


@query("""select page_id, regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1) as markup from pages""")
def content_containers(t):
    return t.pages.select("page_id", parsing.content_container(F.col("html"), [("#", "law_content"), (".", "ad")]).alias("markup"))


@query("""select page_id, repeat('<div>', cast(page_id % 4 as integer)) || '<h2>' || page_id || '. A</h2><DIV x="1">' || url || '<div/></DIV><divided></divided>'
  || repeat('</div>', cast(page_id % 4 as integer)) || 'tail' as markup from pages""")
def container_bounds(t):
    """Pages wrapped so that the container ends before siblings; what it holds is known."""
    depth = (F.col("page_id") % 4).cast("int")
    inner = F.concat(F.repeat(F.lit("<div>"), depth), F.lit("<h2>"), F.col("page_id").cast("string"), F.lit('. A</h2><DIV x="1">'), F.col("url"),
                     F.lit("<div/></DIV><divided></divided>"), F.repeat(F.lit("</div>"), depth), F.lit("tail"))
    page = F.concat(F.lit('<html><body><nav><div>n</div></nav><div class="x lawCon">'), inner, F.lit('</div ><div class="footer">OUTSIDE</div></body></html>'))
    return t.pages.select("page_id", parsing.content_container(page).alias("markup"))


_MIXED = {
    0: ('<div class="lawCon"><div class="section"><div class="sec_head">1. A</div><div class="sec_content">', '</div></div></div><div class="section">OUT</div>'),
    1: ("<h2>2. B</h2><p>", "</p>"), 2: ('<table class="t"><tr><th>3. C</th></tr><tr><td>', "</td></tr></table>"), 3: ("<p>", "</p>"),
    4: ("<h2>4. D</h2><p>", '</p><div class="sec_content">x</div>'), 5: ('<div class="sec_head">', "</div>"), 6: ("<script>", "</script>")}


@query("""select page_id, 1 as nodes, 'section' as kind, case page_id % 7 when 0 then '1' when 1 then '2' when 2 then '3' when 4 then '4' else '1' end as number,
  case page_id % 7 when 0 then '1. A' when 1 then '2. B' when 2 then '3. C' when 4 then '4. D' end as title,
  case when page_id % 7 = 4 then url || ' x' else url end as text, 0 as warnings from pages where page_id % 7 <> 6
union all select page_id, 0, null, null, null, null, 1 from pages where page_id % 7 = 6""")
def mixed_layout_pages(t):
    """Every page in one of seven layouts, three of them misleading: each gives a node or a warning."""
    html = F.lit("")
    for k, (before, after) in _MIXED.items():
        html = F.when(F.col("page_id") % 7 == k, F.concat(F.lit(before), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(after))).otherwise(html)
    pages = t.pages.select("page_id", "url", F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"))
    nodes, warnings = parsing.parse_pages(pages)
    one = nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("nodes"), *[F.min(c).alias(c) for c in ("kind", "number", "title", "text")])
    told = warnings.groupBy("page_id").agg(F.count(F.lit(1)).alias("warnings"))
    return one.join(told, "page_id", "full").withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("nodes", "warnings")})


@query("""select 'p' || page_id as slug, case when page_id % 2 = 0 then 'en' else 'bn' end as language, url, sha256(html) as html_hash, make_timestamp((1700000000 + page_id) * 1000000) as fetched_at from pages""")
def snapshot_files(t):
    """Pages written to the file layout of a crawl, one file each, and read back whole."""
    root = scratch(t.spark) + "/files"
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("slug"), F.when(F.col("page_id") % 2 == 0, "en").otherwise("bn").alias("language"), "url", "html",
                           F.timestamp_seconds(1_700_000_000 + F.col("page_id")).alias("fetched_at"))
    snapshots.write_snapshot_files(pages, root)
    return snapshots.read_snapshot_files(t.spark, root).select("slug", "language", "url", F.sha2("html", 256).alias("html_hash"), "fetched_at")


_SECTIONS = f"""
with marked as (
  select page_id, url, string_split(regexp_replace(regexp_replace({sql_visible(_BODY)}, '(?i)<(?:h1|h2|h3|h4|h5)\\b[^>]*>', chr(1) || chr(2), 'g'),
         '(?i)</(?:h1|h2|h3|h4|h5)\\s*>', chr(3), 'g'), chr(1)) as parts from pages),
pieces as (select page_id, url, unnest(parts) as piece, unnest(range(len(parts))) as pos from marked),
cut as (
  select page_id, url, pos, piece, starts_with(piece, chr(2)) as titled, instr(piece, chr(3)) as brk from pieces),
texts as (
  select page_id, url, pos,
         case when titled then nullif({sql_text("case when brk > 0 then substring(piece, 2, brk - 2) else substring(piece, 2) end")}, '') end as title,
         {sql_text("replace(case when not titled then piece when brk > 0 then substring(piece, brk + 1) else '' end, chr(3), ' ')")} as text
  from cut)
select page_id, cast(pos as integer) as ordinal, case when title is null then 'section' else {sql_kind('title')} end as kind,
       {sql_number('title')} as number, title, text, url as source_url
from texts where text <> '' or title is not null"""


@query(_SECTIONS)
def heading_sections(t):
    return parsing.heading_sections(t.pages, HEADINGS).drop("parent_ordinal")


@query(_SECTIONS)
def parsed_pages(t):
    """The whole parser: every test page has a heading, so it takes the heading layout."""
    return parsing.parse_pages(t.pages, headings=HEADINGS)[0].drop("parent_ordinal")


@query("select page_id, 'content container yielded no provisions' as message from pages where starts_with(url, 'https')")
def parse_warnings(t):
    """Pages emptied on purpose parse to nothing but a warning."""
    emptied = t.pages.withColumn("html", F.when(F.col("url").startswith("https"), "<body><script>x</script></body>").otherwise(F.col("html")))
    return parsing.parse_pages(emptied, headings=HEADINGS)[1].select("page_id", "message")


_FLAT = sql_clean("regexp_replace(" + sql_clean(sql_decode("regexp_replace(" + sql_visible(_BODY) + ", '<[^>]*>', chr(10), 'g')")) + ", '\\n+', ' ', 'g')")


@query(f"select page_id, 0 as ordinal, 'section' as kind, '1' as number, text from (select page_id, {_FLAT} as text from pages) where text <> ''")
def flat_sections(t):
    return parsing.flat_sections(t.pages).select("page_id", "ordinal", "kind", "number", "text")


def _lines(t):
    """Documents as lines of at least one visible character."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "&", "&amp;")), lambda x: F.trim(x) != "")
    return t.documents.withColumn("lines", lines).filter(F.size("lines") > 0)


def _nested_pages(t):
    items = F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x, i: F.concat(
        F.lit('<div class="sub_section"><span class="sub_num">('), (i + 1).cast("string"),
        F.lit(')</span> <span class="sub_text">'), x, F.lit("</span></div>")))
    return _lines(t).select(F.col("doc_id").alias("page_id"), F.lit("http://acts.example/p").alias("url"), F.concat(
        F.lit('<html><body><div class="lawCon"><div class="section"><div class="sec_head">'), F.element_at("lines", 1),
        F.lit("</div>"), F.array_join(items, ""), F.lit("</div></div></body></html>")).alias("html"))


_LINES_SQL = """
with docs as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents)
"""


@query(_LINES_SQL + f"""
select doc_id as page_id, 0 as ordinal, cast(null as integer) as parent_ordinal, 'section' as kind,
       {sql_number(sql_norm('lines[1]'))} as number, {sql_norm('lines[1]')} as title, '' as text from docs where len(lines) > 0
union all
select doc_id, cast(i as integer), 0, 'subsection', cast(i as varchar), null, {sql_norm('lines[i + 1]')}
from docs, unnest(range(1, len(lines))) as u(i) where len(lines) > 1""")
def structural_sections(t):
    """Documents written out as nested markup must come back as their own lines."""
    return parsing.structural_sections(_nested_pages(t)).drop("source_url")


@query(_LINES_SQL + f"""
select doc_id as page_id, cast(i as varchar) as number, {sql_norm('lines[i + 1]')} as text
from docs, unnest(range(1, len(lines))) as u(i) where len(lines) > 1""")
def sub_provisions(t):
    return parsing.sub_provisions(_nested_pages(t)).select("page_id", "number", "text")


@query(_LINES_SQL + f"""
select doc_id as page_id, 'chapter' as kind, {sql_number(sql_norm('lines[1]'))} as number, {sql_norm('lines[1]')} as title,
       {sql_norm("array_to_string(lines[2:], ' ')")} as text from docs where len(lines) > 0""")
def table_sections(t):
    rows = F.array_join(F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.concat(
        F.lit("<tr><td>"), x, F.lit("</td></tr>"))), "")
    pages = _lines(t).select(F.col("doc_id").alias("page_id"), F.lit("http://acts.example/p").alias("url"), F.concat(
        F.lit('<html><body><table class="chapter"><tr><th>'), F.element_at("lines", 1), F.lit("</th></tr>"), rows,
        F.lit("</table></body></html>")).alias("html"))
    return parsing.table_sections(pages).select("page_id", "kind", "number", "title", "text")


@query("""select p_partkey, """ + sql_kind("p_type || ' ' || p_name") + """ as kind,
  """ + sql_number("case when p_size % 2 = 0 then p_partkey || 'B. ' || p_name else p_name end") + """ as number from part""")
def kinds_and_numbers(t):
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("B. "), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", text.provision_kind(F.concat("p_type", F.lit(" "), "p_name")).alias("kind"),
                         text.provision_number(title).alias("number"))


@query("""select page_id, case page_id % 3 when 0 then 'https://acts.example/act-7/section-' || page_id || '.html'
  when 1 then 'https://acts.example/act-details-' || page_id || '.html' else url end as detail_url from pages""")
def detail_urls(t):
    page = F.col("page_id").cast("string")
    link = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="/act-7/section-'), page, F.lit('.html?lang=en">')))
            .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<a href="act-details-'), page, F.lit('.html">'))).otherwise(""))
    html = F.replace(F.col("html"), F.lit("<article>"), F.concat(F.lit("<article>"), link))
    return t.pages.select("page_id", text.detail_url(html, F.col("url"), "https://acts.example").alias("detail_url"))


_VERBS = ["that", "nicht", "pour", "como"]
_NOTES = """
with marked as (
  select page_id, make_timestamp(1700000000000000) as fetched,
         regexp_replace(html, '<p>', '<p class="x amend-note">Act No. XV of ' || (1950 + page_id % 80) || ' ', 'g') as html from pages),
found as (select page_id, cast(fetched as date) as fetched,
   list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*\\bclass\\s*=\\s*["''][^"'']*(?:amend|insert|substitut|footnote|endnote)[^"'']*["''][^>]*>(.*?)</p\\s*>', 1),
     lambda x: """ + sql_norm(sql_decode("regexp_replace(x, '<[^>]*>', '', 'g')")) + """) as notes from marked),
kept as (select page_id, fetched, list_filter(notes, lambda x: regexp_matches(x,
   '(?i)(?:^|[^\\p{L}\\p{N}_])(?:that|nicht|pour|como)(?:$|[^\\p{L}\\p{N}_])')) as notes from found),
rows_ as (
  select page_id, fetched, unnest(notes) as note, unnest(range(len(notes))) as ord from kept
  union all select page_id, fetched, null, 0 from kept where len(notes) = 0),
read as (
  select page_id, cast(ord as integer) as ord,
    case when note is null then fetched else make_date(cast(regexp_extract(note, '(?:^|[^\\p{L}\\p{N}_])(19\\d{2}|20\\d{2})(?:$|[^\\p{L}\\p{N}_])', 1) as bigint), 1, 1) end as effective_from,
    case when note is not null then 'act-' || regexp_extract(note, '(?i)Act(?:\\s+No\\.?)?\\s+([A-Z0-9]+)\\s+of\\s+(\\d{4})', 2) end as amending_act_slug,
    case when note is null then 'snapshot' else 'annotated' end as provenance, substring(coalesce(note, ''), 1, 500) as raw_annotation
  from rows_)
"""


def _amendments(t):
    mark = F.concat(F.lit('<p class="x amend-note">Act No. XV of '), (1950 + F.col("page_id") % 80).cast("string"), F.lit(" "))
    pages = t.pages.select("page_id", F.replace(F.col("html"), F.lit("<p>"), mark).alias("html"),
                           F.timestamp_seconds(F.lit(1_700_000_000)).alias("fetched"))
    return parsing.amendments(pages, "html", "fetched", ["page_id"], verbs=_VERBS)


@query(_NOTES + "select * from read")
def amendment_notes(t):
    return _amendments(t).drop("effective_to")


@query(_NOTES + """select page_id, effective_from, amending_act_slug, provenance, raw_annotation from
  (select *, row_number() over (partition by page_id order by effective_from desc, ord) as n from read) where n = 1""")
def latest_amendments(t):
    return parsing.latest_amendment(_amendments(t), ["page_id"]).drop("effective_to")


@query("select page_id, 'act' as kind, '0' as number, url as source_url from pages")
def act_roots(t):
    return parsing.act_roots(t.pages).drop("title")


# The whole ingest over the pages: two crawls, the second with some pages changed and some reported as unchanged.

_INGEST_CHUNKS = ("id string, revision_id string, provision_id string, act_id string, chunk_index int, language string, hierarchy_path string, "
                  "content string, tokens array<string>, token_count int")


def _crawl(t, second):
    html = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("</article>"), F.lit("<p>amended</p></article>"))).otherwise(F.col("html")) if second else F.col("html")
    return t.pages.select(F.col("page_id").cast("string").alias("page_id"), F.concat(F.lit("act-"), "page_id").alias("slug"),
                          F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("language"), "url", html.alias("html"),
                          F.to_timestamp(F.lit("2024-02-01" if second else "2024-01-01")).alias("fetched_at"),
                          (F.col("page_id") % 10 == 9 if second else F.lit(False)).alias("not_modified"))


@query(f"""with crawls as (select page_id, url, regexp_extract(html, '<html lang="(\\w+)"', 1) as language, html as first_html,
   case when page_id % 3 = 0 then replace(html, '</article>', '<p>amended</p></article>') else html end as second_html from pages),
 texts as (select page_id, language, (select {_FLAT.replace('html', 'first_html')}) as a, (select {_FLAT.replace('html', 'second_html')}) as b from crawls)
select 'act-' || page_id as act_id, language, sha256(a) as content_hash, date '2024-01-01' as effective_from,
   case when a <> b and page_id % 10 <> 9 then date '2024-02-01' end as effective_to,
   case when page_id % 10 = 9 then null when a = b then 'unchanged' else 'updated' end as second_outcome from texts
union all select 'act-' || page_id, language, sha256(b), date '2024-02-01', null, 'updated' from texts where a <> b and page_id % 10 <> 9""")
def ingest_pages(t):
    """Parse, place, merge and chunk all pages twice: the revisions after it, with the outcome of the second crawl."""
    slugs = t.pages.select(F.concat(F.lit("act-"), "page_id").alias("slug"))
    acts = slugs.select(F.col("slug").alias("id"), "slug", F.col("slug").alias("full_name_en"), F.lit(2000).alias("act_year"))
    stamp = F.lit("2024-01-01").cast("timestamp")
    empty = t.spark.createDataFrame
    one = ingest(_crawl(t, False), acts, empty([], schemas.PROVISIONS), empty([], schemas.REVISIONS), empty([], _INGEST_CHUNKS), stamp, stamp)
    two = ingest(_crawl(t, True), acts, stored(one.provisions), one.revisions, stored(one.chunks), stamp, stamp)
    names = stored(two.provisions).select(F.col("id").alias("provision_id"), "act_id")
    outcomes = two.outcomes.select("provision_id", "language", F.col("outcome").alias("second_outcome"))
    return two.revisions.join(names, "provision_id").join(outcomes, ["provision_id", "language"], "left").select(
        "act_id", "language", "content_hash", "effective_from", "effective_to", "second_outcome")
