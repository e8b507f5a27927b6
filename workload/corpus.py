"""Hierarchy, upserts, revisions, chunks, embeddings, language."""

import numpy as np
from pyspark.sql import Window, functions as F, types as T

from provenant.functions import hashing, language, text
from provenant.operators import bucketed, chunking, embedding, hierarchy, revisions
from provenant.settings import Settings
from workload.base import query, scratch

SETTINGS = Settings()


# Hierarchy: region is the act, nations are parts, suppliers sections, customers clauses. --------

def _geography(t, customers=True):
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    place = regions.select("n_nationkey", F.col("r_name").alias("act_id"), "n_name", "n_regionkey")
    root = t.region.select(F.col("r_name").alias("act_id"), key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"),
                           F.lit("act").alias("kind"), F.lit("0").alias("number"), F.col("r_name").alias("title"))
    parts = place.select("act_id", key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.lit("part").alias("kind"),
                         F.col("n_nationkey").cast("string").alias("number"), F.col("n_name").alias("title"))
    sections = t.supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "act_id", key("s", "s_suppkey").alias("id"), key("n", "s_nationkey").alias("parent_id"), F.lit("section").alias("kind"),
        F.col("s_suppkey").cast("string").alias("number"), F.col("s_name").alias("title"))
    nodes = root.unionByName(parts).unionByName(sections)
    if customers:
        # Customers are dealt to the suppliers by their numbers.
        n = t.supplier.count()
        clauses = t.customer.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("c_custkey") % n == F.col("s_suppkey") % n).join(
            place, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "act_id", key("c", "c_custkey").alias("id"), key("s", "s_suppkey").alias("parent_id"), F.lit("clause").alias("kind"),
            F.col("c_custkey").cast("string").alias("number"), F.lit(None).cast("string").alias("title"))
        nodes = nodes.unionByName(clauses)
    return nodes


_TREE = """
with place as (select n_nationkey, n_name, r_name as act_id from nation join region on n_regionkey = r_regionkey),
tree as (
  select act_id, 'n' || n_nationkey as id, 'part' as kind, 0 as depth, cast(n_nationkey as varchar) as sort_path,
         lpad(cast(n_nationkey as varchar), 6, '0') as padded, act_id || ' > Part ' || n_nationkey || ' (' || n_name || ')' as hierarchy_path
  from place
  union all
  select act_id, 's' || s_suppkey, 'section', 1, n_nationkey || '/' || s_suppkey, lpad(cast(n_nationkey as varchar), 6, '0') || '/' || lpad(cast(s_suppkey as varchar), 6, '0'),
         act_id || ' > Part ' || n_nationkey || ' (' || n_name || ') > Section ' || s_suppkey || ' (' || s_name || ')'
  from supplier join place on s_nationkey = n_nationkey
  union all
  select act_id, 'c' || c_custkey, 'clause', 2, n_nationkey || '/' || s_suppkey || '/' || c_custkey,
         lpad(cast(n_nationkey as varchar), 6, '0') || '/' || lpad(cast(s_suppkey as varchar), 6, '0') || '/' || lpad(cast(c_custkey as varchar), 6, '0'),
         act_id || ' > Part ' || n_nationkey || ' (' || n_name || ') > Section ' || s_suppkey || ' (' || s_name || ')(' || c_custkey || ')'
  from customer join supplier on c_custkey % (select count(*) from supplier) = s_suppkey % (select count(*) from supplier) join place on s_nationkey = n_nationkey)
"""


@query(_TREE + "select act_id, id, depth, sort_path from tree")
def sort_paths(t):
    return hierarchy.sort_paths(_geography(t)).select("act_id", "id", "depth", "sort_path")


@query(_TREE + "select act_id, id, padded as sort_path from tree")
def padded_sort_paths(t):
    return hierarchy.sort_paths(_geography(t), pad=6).select("act_id", "id", "sort_path")


@query(_TREE + "select act_id, id, hierarchy_path from tree")
def hierarchy_labels(t):
    return hierarchy.hierarchy_labels(_geography(t), "act_id").select("act_id", "id", "hierarchy_path")


@query(_TREE + "select act_id, id, sort_path, hierarchy_path from tree where kind <> 'part'")
def walk_text_nodes(t):
    nodes = _geography(t).withColumn("text", F.when(F.col("kind").isin("section", "clause"), F.col("id")).otherwise(""))
    return hierarchy.walk(nodes, "act_id").select("act_id", "id", "sort_path", "hierarchy_path")


@query(_TREE + """select id, lag(id) over w as prev_id, lead(id) over w as next_id from tree where kind <> 'part'
  window w as (partition by split_part(sort_path, '/', 1), act_id order by sort_path, id)""")
def reading_order(t):
    nodes = hierarchy.sort_paths(_geography(t)).withColumn("part", F.concat_ws("|", "act_id", F.split_part("sort_path", F.lit("/"), F.lit(1))))
    return hierarchy.reading_order(nodes, tree="part").select("id", "prev_id", "next_id")


def _chains(t):
    """Orders of a customer, each below the one before: chains as deep as a customer has orders."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("act_id"), F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(before).alias("parent_id"),
                           F.lit("clause").alias("kind"), (F.col("o_orderkey") % 97).cast("string").alias("number"), F.lit(None).cast("string").alias("title"))


@query("""
with recursive links as (select o_custkey as act_id, o_orderkey as id, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent_id,
    cast(o_orderkey % 97 as varchar) as number from orders),
tree as (select act_id, id, 0 as depth, number as sort_path, '(' || number || ')' as hierarchy_path from links where parent_id is null
  union all
  select l.act_id, l.id, tree.depth + 1, tree.sort_path || '/' || l.number, tree.hierarchy_path || '(' || l.number || ')' from tree join links l on l.parent_id = tree.id)
select act_id, id, depth, sort_path, hierarchy_path from tree""")
def deep_tree_paths(t):
    return hierarchy.descend(_chains(t)).select("act_id", "id", "depth", "sort_path", "hierarchy_path")


@query("""
with links as (select o_custkey as act_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as place from orders)
select act_id, id from links where act_id % 5 = 0 and place > 2""")
def unplaced_nodes(t):
    """Chains of which some lose their second order: all that hung below it is listed."""
    chains = _chains(t)
    second = Window.partitionBy("act_id").orderBy("id")
    cut = chains.withColumn("_place", F.row_number().over(second)).filter("act_id % 5 <> 0 or _place <> 2").drop("_place")
    return hierarchy.unplaced(cut, hierarchy.descend(cut)).select("act_id", "id")


def _order_nodes(t):
    none = F.lit(None).cast("string")
    orders = t.orders.repartition("o_orderkey").select(F.col("o_orderkey").alias("act_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"), none.alias("parent_id"),
                             F.lit("chapter").alias("kind"), F.col("o_orderkey").cast("string").alias("number"), F.lit("1").alias("sort_path"))
    # The rows are dealt by order once; a line and its flags come from one row.
    dealt = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.collect_set(F.struct("l_returnflag")).alias("flags"))
    line = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber")
    own = F.struct(line.alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.lit("section").alias("kind"),
                   F.col("l_linenumber").cast("string").alias("number"), F.concat(F.lit("1/"), "l_linenumber").alias("sort_path"))
    leaf = lambda x: F.struct(F.concat_ws("-", F.lit("f"), "l_orderkey", "l_linenumber", x["l_returnflag"]).alias("id"), line.alias("parent_id"),
                              F.lit("clause").alias("kind"), x["l_returnflag"].alias("number"),
                              F.concat(F.lit("1/"), "l_linenumber", F.lit("/"), x["l_returnflag"]).alias("sort_path"))
    below = lines.select(F.col("l_orderkey").alias("act_id"), F.explode(F.concat(F.array(own), F.transform("flags", leaf))).alias("n")).select("act_id", "n.*")
    return orders.unionByName(below).withColumn("title", none)


@query("""
with leaves as (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem),
lines as (select l_orderkey, l_linenumber, string_agg(l_returnflag, '' order by l_returnflag) as flags from leaves group by all),
kids as (select l_orderkey, string_agg(l_linenumber || '(' || flags || ')', ',' order by l_linenumber) as tree from lines group by all)
select 'o' || o_orderkey as id, coalesce(tree, '') as tree from orders left join kids on o_orderkey = l_orderkey""")
def nested_trees(t):
    """Orders with their lines and the flags of each line as nested nodes."""
    tree = hierarchy.nest(_order_nodes(t))
    leaf = lambda n: F.concat(n["number"], F.lit("("), F.array_join(F.transform(n["children"], lambda c: c["number"]), ""), F.lit(")"))
    return tree.select("id", F.array_join(F.transform("children", leaf), ",").alias("tree"))


# Upserts and revisions. -------------------------------------------------------------------------

def _acts(t, altered):
    acts = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("short_name"),
        F.col("s_name").alias("full_name_en"), F.col("s_name").alias("full_name_bn"), F.col("s_nationkey").cast("string").alias("act_number"),
        F.col("s_nationkey").alias("act_year"), F.lit(None).cast("string").alias("ministry"), F.lit("in_force").alias("status"))
    if not altered:
        return acts.filter(F.col("act_year") != 3)
    return acts.filter(F.col("act_year") != 5).withColumn("short_name", F.when(
        F.col("act_year") % 2 == 0, F.upper("short_name")).otherwise(F.col("short_name")))


@query("""
with old as (select 's' || s_suppkey as slug, s_name as short_name, s_nationkey as k from supplier where s_nationkey <> 3),
new as (select 's' || s_suppkey as slug, case when s_nationkey % 2 = 0 then upper(s_name) else s_name end as short_name, s_nationkey as k
        from supplier where s_nationkey <> 5)
select coalesce(old.slug, new.slug) as slug, coalesce(new.short_name, old.short_name) as short_name,
  case when new.slug is null then 'untouched' when old.slug is null then 'inserted' when old.short_name = new.short_name then 'unchanged' else 'updated' end as outcome
from old full join new using (slug)""")
def registry_upsert(t):
    return revisions.upsert_registry(_acts(t, False), _acts(t, True)).select("slug", "short_name", "outcome")


@query("""
with incoming as (select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders)
select 'a' as act_id, cast(c_custkey as varchar) as sort_path, case when o_custkey is null then c_name else o_orderpriority end as title,
  'section' as kind from customer left join incoming on c_custkey = o_custkey and n = 1""")
def provision_upsert(t):
    """Paths repeated in a batch keep their last row; stored kinds stay."""
    none = F.lit(None).cast("string")
    base = [F.lit("a").alias("act_id"), none.alias("parent_id")]
    current = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), *base, F.lit("section").alias("kind"),
                                F.col("c_custkey").cast("string").alias("number"), F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("sort_path"))
    incoming = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("id"), *base, F.lit("part").alias("kind"), F.col("o_custkey").cast("string").alias("number"),
                               F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("sort_path"), F.col("o_orderkey").alias("ordinal"))
    known = incoming.join(current.select("sort_path"), "sort_path", "left_semi")
    return revisions.upsert_provisions(current, known).select("act_id", "sort_path", "title", "kind")


_EMPTY = ("id string, provision_id bigint, language string, translation_status string, text string, effective_from date, "
          "effective_to date, amending_act_id string, provenance string, content_hash string, source_url string, fetched_at timestamp")


def _snapshot(t, second):
    day = "2024-02-01" if second else "2024-01-01"
    body = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text")) if second else F.col("text")
    rows = t.documents.filter(F.col("doc_id") % 17 != 0) if second else t.documents
    return rows.select(F.col("doc_id").alias("provision_id"), F.col("lang").alias("language"), body.alias("text"),
                       F.concat(F.lit("http://acts.example/"), "source").alias("source_url"), F.to_timestamp(F.lit(day)).alias("fetched_at"))


def _first(t):
    return revisions.merge_revisions(t.spark.createDataFrame([], _EMPTY), _snapshot(t, False))[0]


def _second(t):
    return revisions.merge_revisions(_first(t), _snapshot(t, True))


_REV = """
with first as (select doc_id, lang, text, sha256(text) as h from documents),
second as (select doc_id, case when doc_id % 10 = 0 then text || ' amended' else text end as text from documents where doc_id % 17 <> 0),
joined as (select f.doc_id, f.lang, f.h, sha256(s.text) as h2, s.text as text2 from first f left join second s using (doc_id)),
revs as (
  select doc_id, lang, h, date '2024-01-01' as effective_from, case when h2 <> h then date '2024-02-01' end as effective_to from joined
  union all select doc_id, lang, h2, date '2024-02-01', null from joined where h2 <> h)
"""


FETCHES = """fetched as (select doc_id, lang, d, text || case when (doc_id // (d + 1)) % 2 = 1 then ' x' else '' end as text,
    date '2024-01-01' + cast(d as integer) as day from documents, unnest(range(4)) as u(d)),
 hashed as (select doc_id, lang, day, sha256(text) as h from fetched),
 judged as (select *, lag(h) over (partition by doc_id, lang order by day) as prev from hashed),
 changed as (select *, lead(day) over (partition by doc_id, lang order by day) as until from judged where prev is null or prev <> h)"""


@query(f"with {FETCHES} select doc_id as provision_id, lang as language, h as content_hash, cast(day as date) as effective_from, cast(until as date) as effective_to from changed")
def revision_history(t):
    """Four dated fetches per document in one batch, with texts that change and come back: one revision per change."""
    merged, _ = revisions.merge_revisions(t.spark.createDataFrame([], _EMPTY), fetches(t))
    return merged.select("provision_id", "language", "content_hash", "effective_from", "effective_to")


def fetches(t):
    day = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = t.documents.withColumn("d", day)
    mark = F.when(F.floor(F.col("doc_id") / (F.col("d") + 1)) % 2 == 1, " x").otherwise("")
    return rows.select(F.col("doc_id").alias("provision_id"), F.col("lang").alias("language"), F.concat("text", mark).alias("text"),
                       F.concat(F.lit("http://acts.example/"), "source").alias("source_url"),
                       F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).alias("fetched_at"))


@query(_REV + """select sha256(doc_id || chr(31) || lang || chr(31) || effective_from || chr(31) || h) as id, doc_id as provision_id, lang as language,
 'reference_translation' as translation_status, h as content_hash, effective_from, effective_to from revs""")
def revision_merge(t):
    """Two snapshots merged into a stored table: changed texts close their row and open a new one."""
    root, schema = scratch(t.spark), T.StructType.fromDDL(_EMPTY)
    bucketed.begin_revisions(t.spark, root, schema)
    for batch, second in enumerate((False, True)):
        bucketed.merge_revisions(t.spark, root, _snapshot(t, second), batch, schema)
    return bucketed.read_revisions(t.spark, root, schema).select("id", "provision_id", "language", "translation_status", "content_hash", "effective_from", "effective_to")


@query(_REV + """select doc_id as provision_id, lang as language, case when h = h2 then 'unchanged' else 'updated' end as outcome, cast(0 as bigint) as collisions
 from joined where h2 is not null""")
def revision_outcomes(t):
    return _second(t)[1].select("provision_id", "language", "outcome", "collisions")


@query("select lang as language, count(*) as n_unchanged, 0 as n_new, 0 as n_updated from documents group by all")
def unchanged_reingest(t):
    """The same snapshot again changes nothing."""
    outcomes = revisions.merge_revisions(_first(t), _snapshot(t, False))[1]
    return revisions.ingest_summary(outcomes, ["language"]).select(
        "language", "n_unchanged", F.col("n_new").cast("int").alias("n_new"), F.col("n_updated").cast("int").alias("n_updated"))


@query(_REV + "select doc_id as provision_id, h as content_hash from revs where effective_from = date '2024-02-01'")
def pending_revisions(t):
    merged, outcomes = _second(t)
    return revisions.pending_revisions(merged, outcomes).select("provision_id", "content_hash")


@query(_REV + """select lang as language, count(*) filter (where h = h2) as n_unchanged, count(*) filter (where h <> h2) as n_updated, cast(0 as bigint) as n_new
 from joined where h2 is not null group by all""")
def ingest_summary(t):
    return revisions.ingest_summary(_second(t)[1], ["language"])


@query("""select l_orderkey as revision_id, l_linenumber as chunk_index, case when o_orderstatus = 'O' then 'fresh' else 'kept' end as content
 from (select l_orderkey, l_linenumber, count(*) from lineitem group by all) join orders on l_orderkey = o_orderkey""")
def replace_chunks(t):
    """Chunks of rewritten revisions are replaced as a whole, others stay."""
    stored = t.lineitem.groupBy(F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.lit("kept").alias("content"))
    stored = stored.join(t.orders.select(F.col("o_orderkey").alias("revision_id")), "revision_id", "left_semi")
    rewritten = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("revision_id"))
    fresh = stored.join(rewritten, "revision_id", "left_semi").withColumn("content", F.lit("fresh"))
    root = scratch(t.spark)
    bucketed.begin_chunks(t.spark, root, stored.schema)
    bucketed.replace_chunks(stored, root, 0)
    bucketed.replace_chunks(fresh, root, 1)
    return bucketed.read_chunks(t.spark, root, stored.schema).select("revision_id", "chunk_index", "content")


@query("""
select o_custkey % 50 as act_id, o_orderstatus as language, max(case when o_orderpriority = '1-URGENT' and o_totalprice > 400000 then 'bad page ' || o_orderkey end) as error,
  case when max(case when o_orderpriority = '1-URGENT' and o_totalprice > 400000 then 1 end) = 1 then 'failed' else 'succeeded' end as status,
  cast(case when max(case when o_orderpriority = '1-URGENT' and o_totalprice > 400000 then 1 end) = 1 then 0 else count(*) filter (where o_orderpriority <> '5-LOW') end as integer) as provisions_processed,
  cast(case when max(case when o_orderpriority = '1-URGENT' and o_totalprice > 400000 then 1 end) = 1 then 0 else sum(o_orderkey % 3) end as integer) as chunks_created
from orders group by all""")
def run_log(t):
    """One failing page fails its own run and no other."""
    bad = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    steps = t.orders.select((F.col("o_custkey") % 50).alias("act_id"), F.col("o_orderstatus").alias("language"),
                            F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise("unchanged").alias("outcome"),
                            F.when(bad, F.concat(F.lit("bad page "), "o_orderkey")).alias("error"), (F.col("o_orderkey") % 3).cast("int").alias("chunks"))
    stamp = F.lit("2024-01-01").cast("timestamp")
    return revisions.run_log(steps, stamp, stamp).select("act_id", "language", "error", "status", "provisions_processed", "chunks_created")


@query("""select cast(page_id as varchar) as act_id, 'unchanged' as outcome from pages where contains(url, '?')
 union all select cast(page_id as varchar), 'parse' from pages where not contains(url, '?')""")
def not_modified_pages(t):
    pages = t.pages.select(F.col("page_id").cast("string").alias("slug"), F.lit("en").alias("language"), F.col("url").contains("?").alias("not_modified"))
    parse, idle = revisions.split_not_modified(pages)
    return idle.select("act_id", "outcome").unionByName(parse.select(F.col("slug").alias("act_id"), F.lit("parse").alias("outcome")))


@query("""select o_orderkey as id, case when o_orderstatus = 'P' and o_custkey < 100 then 'failed' when o_orderstatus = 'P' then 'running' else 'succeeded' end as status,
 case when o_orderstatus = 'P' and o_custkey < 100 then 'Cancelled by operator' end as error,
 case when o_orderstatus = 'P' and o_custkey < 100 then timestamp '2024-02-01 00:00:00' end as finished_at from orders""")
def cancel_runs(t):
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") < 100, "low").otherwise("high").alias("act_id"), status.alias("status"),
                           F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("finished_at"))
    return revisions.cancel_runs(runs, F.lit("2024-02-01").cast("timestamp"), "low").drop("act_id")


@query("""select doc_id, sha256(text) as content_hash, case when lang = 'bn' then 'authoritative' else 'reference_translation' end as translation_status,
 greatest(1, length(text) // 4)::integer as tokens, (length(source) // 4)::integer as prompt_tokens from documents""")
def hashes_and_sizes(t):
    return t.documents.select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"), language.translation_status(F.col("lang")).alias("translation_status"),
                              text.token_count(F.col("text")).alias("tokens"), text.token_count(F.col("source"), 0).alias("prompt_tokens"))


# Chunks. ----------------------------------------------------------------------------------------

def doc_chunks(t):
    """Documents as revisions: the source is the act, the document a section of it."""
    path = F.concat("source", F.lit(" > Section "), F.col("doc_id").cast("string"))
    rows = t.documents.select("doc_id", F.col("lang").alias("language"), F.col("source").alias("act_id"), path.alias("hierarchy_path"), "text")
    return chunking.chunk(rows, SETTINGS).drop("text")


CHUNK_SQL = """
with recursive docs as (
  select doc_id, lang, source, source || ' > Section ' || doc_id as path, trim(text, ' ' || chr(10)) as body from documents),
sized as (select *, greatest(1, length(path || chr(10) || body) // 4) <= 768 as fits,
                 greatest(1, 768 - greatest(1, length(path) // 4) - 1) as budget from docs),
lined as (select *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from sized where not fits),
paras as (select doc_id, path, budget, case when list_bool_and(list_transform(lines, lambda x: greatest(1, length(x) // 4) <= budget)) then lines else [body] end as ps from lined),
items as (select doc_id, budget, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i from paras),
packed as (
  select doc_id, budget, i, p, greatest(1, length(p) // 4) as used, 0 as seg from items where i = 1
  union all
  select n.doc_id, n.budget, n.i, n.p,
         case when k.used + greatest(1, length(n.p) // 4) > n.budget then greatest(1, length(n.p) // 4) else k.used + greatest(1, length(n.p) // 4) end,
         case when k.used + greatest(1, length(n.p) // 4) > n.budget then k.seg + 1 else k.seg end
  from packed k join items n on n.doc_id = k.doc_id and n.i = k.i + 1),
bodies as (select doc_id, seg, string_agg(p, chr(10) || chr(10) order by i) as body from packed group by all),
overlapped as (select doc_id, seg, case when seg = 0 then body
     else trim(right(lag(body) over (partition by doc_id order by seg), 256) || chr(10) || body, ' ' || chr(10)) end as body from bodies),
segments as (select doc_id, 0 as seg, body from sized where fits union all select doc_id, seg, body from overlapped),
chunks as (select s.doc_id, cast(seg as integer) as chunk_index, d.lang as language, d.source as act_id, d.path as hierarchy_path,
                  d.path || chr(10) || s.body as content, cast(greatest(1, length(d.path || chr(10) || s.body) // 4) as integer) as token_count
           from segments s join docs d using (doc_id))
"""


@query(CHUNK_SQL + "select * from chunks")
def chunks(t):
    return doc_chunks(t)


@query(CHUNK_SQL + "select doc_id, cast(seg as integer) as seg, body from bodies")
def packed_paragraphs(t):
    """Segment bodies before overlap, of the documents over the limit."""
    path = F.concat("source", F.lit(" > Section "), F.col("doc_id").cast("string"))
    rows = t.documents.withColumn("path", path)
    long = rows.filter(text.token_count(F.concat("path", F.lit("\n"), "text")) > SETTINGS.chunk_max_tokens)
    budget = F.greatest(F.lit(1), F.lit(SETTINGS.chunk_max_tokens) - text.token_count(F.col("path")) - 1)
    return chunking.pack_paragraphs(long, "text", budget).select("doc_id", F.posexplode_outer("bodies").alias("seg", "body"))


def hashed_vectors(texts, role):
    """A stand-in for a model: 32 hashed letter counts, so that equal texts get equal vectors."""
    out = np.zeros((len(texts), 32), np.float32)
    for row, words in zip(out, texts):
        codes, counts = np.unique(np.frombuffer(words.encode("utf-16-le"), np.uint16) % 32, return_counts=True)
        row[codes] = counts
    return out


@query("""with codes as (
  select doc_id, unicode(unnest(string_split(text, ''))) % 32 as dim from documents),
 counts as (select doc_id, dim, count(*) as n from codes group by all)
 select doc_id, array_to_string(list_transform(range(32), lambda d: coalesce(list_extract(map_values(m), list_position(map_keys(m), d)), 0)), ' ') as vector
 from (select doc_id, map_from_entries(list((dim, n))) as m from counts group by doc_id)""")
def plugin_embedding(t):
    """The embedding stage with a plug-in, over whole texts."""
    vectors = embedding.embed(t.documents.select("doc_id", "text"), "text", "document", hashed_vectors)
    return vectors.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


@query("select doc_id, 64 as dims, 1.0::double as norm from documents where len(trim(text)) > 0")
def hashed_embedding(t):
    rows = embedding.hashed_embedding(t.documents.select("doc_id", "text"), "text", 64)
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("""with cells as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as dim from embeddings),
 means as (select label, dim, avg(x::double) as m from cells group by all)
 select label, len(list(m)) as dims, round(sum(m * m), 6) as square from means group by label""")
def centroids(t):
    rows = embedding.centroids(t.embeddings, ["label"])
    return rows.select("label", F.size("centroid").cast("bigint").alias("dims"), F.round(F.aggregate(
        "centroid", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


# Language. --------------------------------------------------------------------------------------

_LATIN1 = (0xC0, 0xFF)
_LANG = """with c as (select doc_id, length(regexp_replace(text, '\\s', '', 'g')) as total, length(regexp_replace(text, '[^À-ÿ]', '', 'g')) as inside from documents),
 r as (select doc_id, inside / nullif(total, 0) as ratio from c),
 l as (select doc_id, ratio, case when ratio is null or ratio <= 0.02 then 'en' when ratio >= 0.10 then 'bn' else 'mixed' end as language from r)
"""


def _detected(t):
    found = language.detect_language(F.col("text"), _LATIN1, 0.10, 0.02)
    return t.documents.select("doc_id", "lang", found["language"].alias("language"), found["confidence"].alias("confidence"))


@query(_LANG + """select doc_id, language, round(case when ratio is null then 1 when language = 'bn' then ratio when language = 'en' then 1 - ratio
 else greatest(ratio, 1 - ratio) end, 9) as confidence from l""")
def detect_language(t):
    return _detected(t).select("doc_id", "language", F.round("confidence", 9).alias("confidence"))


@query(_LANG + """select doc_id, case when language = 'bn' then 'bn' else 'en' end as search, case when language = 'mixed' then 'en' else language end as response,
 coalesce(case when lang = 'fr' then 'bn' end, case when language = 'bn' then 'bn' else 'en' end) as selected from l join documents using (doc_id)""")
def route_language(t):
    found = F.col("language")
    requested = F.when(F.col("lang") == "fr", "bn")
    return _detected(t).select("doc_id", language.search_language(found).alias("search"), language.response_language(found).alias("response"),
                               language.selected_language(requested, found).alias("selected"))


@query("""select doc_id, len(w) as n, w[1] as first_word, sha256(array_to_string(w, ' ')) as words from (
 select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') as w from documents)""")
def tokens(t):
    words = t.documents.select("doc_id", text.tokenize(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n"), F.get("w", F.lit(0)).alias("first_word"),
                        F.sha2(F.array_join("w", " "), 256).alias("words"))
