"""Page snapshots to provision nodes.

A node is one row: (page_id, ordinal, parent_ordinal, kind, number, title, text, source_url).
Ordinals follow the page; every block of text belongs to exactly one node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provenant.functions import patterns as P
from provenant.functions.regex import let, unicode_pattern
from provenant.functions.text import (
    UNKNOWN_NUMBER, clean_ws, decode_entities, detail_url, drop_hidden,
    html_text, norm_title, page_title, provision_kind, provision_number, strip_tags)
from provenant.operators.markup import element_rows
from provenant.plans.session import stored

# Where the content of a page sits, in order of preference.
CONTAINERS = [(".", "lawCon"), ("#", "sub_section_content"), (".", "act_content"),
              ("#", "law_content"), (".", "sectionBody")]
HEADINGS = ["h2", "h3", "h4", "h5"]

#: Pages that a worker holds as Python objects, with their nodes.
PAGES_AT_ONCE = 64

_OPEN, _TITLE, _BODY = "\x01", "\x02", "\x03"
_BLOCKS = "p|div|td|th|tr|li|ul|ol|table|tbody|thead|section|article|nav|footer|header|br|dl|dt|dd|h[1-6]"

NODES = ("page_id {id}, ordinal int, parent_ordinal int, kind string, number string, "
         "title string, text string, source_url string, markup string, warning string")


def content_container(html: Column, containers: Sequence[tuple[str, str]] = CONTAINERS) -> Column:
    """Markup inside the first preferred container, up to its own end tag, else that of the body."""
    return let(html, lambda page: _container(page, containers))


def _balanced(rest: Column, tag: Column) -> Column:
    """What precedes the end tag that closes an element whose start tag stands before ``rest``.

    The markup is cut before each tag of the same name; depth is counted over the pieces. An element that is
    never closed runs to the end.
    """
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit("(?![\\w-]))")))
    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"))

    def step(state: Column, piece: Column) -> Column:
        moved = (F.when(piece.startswith("</"), -1)
                 .when(F.lower(piece).startswith(F.concat(F.lit("<"), F.lower(tag))) & ~piece.rlike("^<[^>]*/>"), 1).otherwise(0))
        depth = state["depth"] + moved
        return F.when((state["depth"] == 0) | (depth == 0), F.struct(F.lit(0).alias("depth"), state["length"].alias("length"))).otherwise(
            F.struct(depth.alias("depth"), (state["length"] + F.length(piece)).alias("length")))

    return F.substring(rest, F.lit(1), F.aggregate(pieces, begin, step, lambda state: state["length"]))


def _container(html: Column, containers: Sequence[tuple[str, str]]) -> Column:
    def begin(mark: str, name: str) -> Column:
        attribute = "class" if mark == "." else "id"
        start = rf"(?is)<(\w+)\b[^>]*\b{attribute}\s*=\s*[\"'][^\"']*(?<![\w-]){name}(?![\w-])[^>]*>"
        # The start tag alone ends the search for its name, so only one pattern passes the whole page.
        found = let(F.struct(F.regexp_extract(html, start, 1).alias("tag"), F.regexp_extract(html, start + r"(.*?)(?:</body\s*>|\z)", 2).alias("rest")),
                    lambda x: F.when(x["tag"] != "", _balanced(x["rest"], x["tag"])))
        # Most pages lack most containers: a substring test spares them the pattern. What is found is compared once it is held.
        return F.when(html.contains(name), let(found, lambda inner: F.when(inner != "", inner)))
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return F.coalesce(*[begin(*c) for c in containers], F.nullif(body, F.lit("")), html)


def heading_sections(pages: DataFrame, tags: Sequence[str] = HEADINGS, base: str = "") -> DataFrame:
    """Sections between headings, from one projection: no shuffle, no Python.

    Heading tags become split marks, so the pieces of a page are its sections; what precedes
    the first heading is an untitled section when it has text.
    """
    names = "|".join(tags)
    markup = drop_hidden(content_container(F.col("html")))
    marked = F.regexp_replace(markup, rf"(?i)<(?:{names})\b[^>]*>", _OPEN + _TITLE)
    marked = F.regexp_replace(marked, rf"(?i)</(?:{names})\s*>", _BODY)
    pieces = pages.select("page_id", "url", F.posexplode_outer(F.split(marked, _OPEN, -1)).alias("pos", "piece"))

    def text_of(markup: Column) -> Column:
        spaced = F.regexp_replace(markup, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", " ")
        return norm_title(decode_entities(strip_tags(spaced, "")))

    titled = F.col("piece").startswith(_TITLE)
    cut = F.instr("piece", _BODY)
    head = F.when(titled, F.when(cut > 0, F.substring(F.col("piece"), F.lit(2), cut - 2))
                  .otherwise(F.substring("piece", 2, 1 << 30)))
    body = (F.when(~titled, F.col("piece")).when(cut > 0, F.substring(F.col("piece"), cut + 1, F.length("piece")))
            .otherwise(""))
    rows = pieces.select(
        "page_id", "url", "pos", "piece",
        F.nullif(text_of(head), F.lit("")).alias("title"),
        text_of(F.regexp_replace(body, _BODY, " ")).alias("text"))
    kept = rows.filter((F.col("text") != "") | F.col("title").isNotNull())
    return kept.select(
        "page_id", F.col("pos").alias("ordinal"), F.lit(None).cast("int").alias("parent_ordinal"),
        F.coalesce(provision_kind(F.col("title")), F.lit("section")).alias("kind"),
        provision_number(F.col("title")).alias("number"), "title", "text",
        detail_url(F.col("piece"), F.col("url"), base).alias("source_url"))


def flat_sections(pages: DataFrame) -> DataFrame:
    """The whole page as section 1; an empty page gives no node and a warning instead."""
    text = clean_ws(F.regexp_replace(html_text(content_container(F.col("html"))), r"\n+", " "))
    return pages.select(
        "page_id", F.lit(0).alias("ordinal"), F.lit(None).cast("int").alias("parent_ordinal"),
        F.lit("section").alias("kind"), F.lit("1").alias("number"),
        F.lit(None).cast("string").alias("title"), text.alias("text"),
        F.col("url").alias("source_url")).filter("text <> ''")


def _walked(batches: Iterator[pa.RecordBatch], modes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    # A page may be long: few of them are Python objects at once.
    for batch in (whole.slice(at, PAGES_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, PAGES_AT_ONCE)):
        columns = {name: [] for name in ("page_id", "ordinal", "parent_ordinal", "kind", "number",
                                         "title", "text", "source_url", "markup", "warning", "html")}
        for page_id, url, html, inner in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "inner"))):
            rows = next((found for mode in modes if (found := list(element_rows(inner, url, mode)))), None)
            for row in rows or [(None, None, None, None, None, None, url, None, None)]:
                for name, value in zip(columns, (page_id, *row, None if rows else html)):
                    columns[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns["page_id"], batch.column("page_id").type)]
            + [pa.array(columns[c], pa.int32() if "ordinal" in c else pa.string())
               for c in list(columns)[1:]], names=list(columns))


def _elements(pages: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Run the markup walker over each page's container, in the first of the modes that finds a node.

    A page without nodes yields one row that carries its html, and a failing page one warning row.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    schema = NODES.format(id=id_type) + ", html string"
    inner = content_container(F.coalesce(F.col("html"), F.lit("")))
    return pages.select("page_id", "url", "html", inner.alias("inner")).mapInArrow(lambda batches: _walked(batches, modes), schema)


def _finished(nodes: DataFrame, base: str) -> DataFrame:
    """Titles, numbers and addresses are set by the same columns as in every other mode."""
    # Of its own, the title is normalised once and not wherever it is read.
    titled = nodes.filter("kind is not null").withColumn("title", norm_title(F.col("title")))
    title = F.nullif(F.col("title"), F.lit(""))
    # A null number is "read it from the title"; sub-provisions carry their own.
    number = F.coalesce(F.col("number"), provision_number(title), F.lit(UNKNOWN_NUMBER))
    return titled.select(
        "page_id", "ordinal", "parent_ordinal", "kind", number.alias("number"),
        title.alias("title"), clean_ws(F.col("text")).alias("text"),
        detail_url(F.col("markup"), F.col("source_url"), base).alias("source_url"))


def structural_sections(pages: DataFrame, base: str = "") -> DataFrame:
    """Parts, chapters and sections marked by class, with their sub-provisions."""
    return _finished(_elements(pages, ["structural"]), base)


def sub_provisions(pages: DataFrame, base: str = "") -> DataFrame:
    return structural_sections(pages, base).filter(F.col("kind").isin("subsection", "clause"))


def table_sections(pages: DataFrame, base: str = "") -> DataFrame:
    """Every table with a class is one section."""
    return _finished(_elements(pages, ["table"]), base)


def parse_pages(pages: DataFrame, base: str = "", headings: Sequence[str] = HEADINGS
                ) -> tuple[DataFrame, DataFrame]:
    """(nodes, warnings): classes, else headings, else tables, else the flat page.

    Markup decides which layout a page is tried in first; a page in which that layout finds no node goes on to
    the next. So every page yields nodes or a warning.
    """
    heading = rf"(?i)<(?:{'|'.join(headings)})\b"
    structural = r"(?i)\bclass\s*=\s*[\"'][^\"']*(?:section|chapter|sec_|(?<![\w-])part(?![\w-]))"
    table = r"(?i)<table\b[^>]*\bclass\s*="

    def next_layout(visible: Column) -> Column:
        return F.when(visible.rlike(heading), "heading").when(visible.rlike(table), "table").otherwise("flat")

    def inside(html: Column) -> Column:
        return content_container(drop_hidden(F.coalesce(html, F.lit(""))))

    layout = let(inside(F.col("html")), lambda visible: F.when(visible.rlike(structural), "structural").otherwise(next_layout(visible)))
    placed = stored(pages.select("page_id", "url", "html", layout.alias("layout")))
    pick = lambda rows, name: rows.filter(F.col("layout") == name).drop("layout")
    first = stored(_elements(pick(placed, "structural"), ["structural"]))
    rest = first.filter("html is not null").select("page_id", F.col("source_url").alias("url"), "html", next_layout(inside(F.col("html"))).alias("layout"))
    again = stored(rest)
    later = placed.filter("layout <> 'structural'").unionByName(again)
    # A page with headings has a node as soon as it has text; only its table or nothing could be left otherwise.
    second = stored(_elements(pick(later, "table"), ["table"]))
    flat = pick(later, "flat").unionByName(second.filter("html is not null").select("page_id", F.col("source_url").alias("url"), "html"))
    raw = first.filter("html is null").unionByName(second.filter("html is null")).drop("html")
    nodes = (_finished(raw, base).unionByName(heading_sections(pick(later, "heading"), headings, base))
             .unionByName(flat_sections(flat)))
    blank = html_text(content_container(F.coalesce(F.col("html"), F.lit("")))) == ""
    empty = flat.unionByName(pick(later, "heading")).filter(blank)
    warnings = raw.filter("warning is not null").select(
        "page_id", F.col("warning").alias("message"), F.substring("markup", 1, 200).alias("context"))
    return nodes, warnings.unionByName(empty.select(
        "page_id", F.lit("content container yielded no provisions").alias("message"),
        F.substring("html", 1, 200).alias("context")))


def act_roots(pages: DataFrame) -> DataFrame:
    """One root per page, whatever the page holds."""
    return pages.select("page_id", F.lit("act").alias("kind"), F.lit("0").alias("number"),
                        page_title(F.col("html")).alias("title"), F.col("url").alias("source_url"))


def amendments(nodes: DataFrame, markup: str, fetched_at: str, keys: Sequence[str],
               classes: Sequence[str] = P.AMENDMENT_CLASSES,
               verbs: Sequence[str] = P.AMENDMENT_VERBS) -> DataFrame:
    """Amendment notes in a node's markup, or one snapshot row where it has none."""
    marked = (rf"(?is)<(\w+)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:{'|'.join(classes)})[^\"']*[\"'][^>]*>"
              r"(.*?)</\1\s*>")
    verb = unicode_pattern(rf"\b(?:{'|'.join(verbs)})\b", True)
    found = F.transform(F.regexp_extract_all(markup, F.lit(marked), F.lit(2)),
                        lambda inner: norm_title(decode_entities(F.regexp_replace(inner, r"<[^>]*>", ""))))
    notes = F.filter(found, lambda note: note.rlike(verb))
    rows = nodes.select(*keys, F.to_date(fetched_at).alias("_fetched"),
                        F.posexplode_outer(notes).alias("ord", "note"))
    return rows.select(*keys, F.coalesce("ord", F.lit(0)).alias("ord"),
                       *annotation(F.col("note"), F.col("_fetched")))


def annotation(note: Column, fetched: Column) -> list[Column]:
    """Dates, slug and provenance read from one amendment note; a null note is a snapshot."""
    year = F.regexp_extract(note, unicode_pattern(P.YEAR), 1)
    act_year = F.regexp_extract(note, unicode_pattern(P.ACT_REFERENCE, True), 2)
    dated = F.when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)))
    return [F.coalesce(dated, fetched).alias("effective_from"),
            F.lit(None).cast("date").alias("effective_to"),
            F.when(act_year != "", F.concat(F.lit("act-"), act_year)).alias("amending_act_slug"),
            F.when(note.isNull(), "snapshot").otherwise("annotated").alias("provenance"),
            F.coalesce(F.substring(note, 1, P.ANNOTATION_CHARS), F.lit("")).alias("raw_annotation")]


def latest_amendment(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest note per key; among equals the first on the page."""
    fields = ["effective_from", "effective_to", "amending_act_slug", "provenance", "raw_annotation"]
    best = rows.groupBy(*keys).agg(F.max_by(
        F.struct(*fields), F.struct(F.col("effective_from"), -F.col("ord"))).alias("a"))
    return best.select(*keys, *[F.col(f"a.{f}").alias(f) for f in fields])
