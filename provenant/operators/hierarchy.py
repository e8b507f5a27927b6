"""Provision trees as adjacency lists: paths, labels, nesting, reading order.

Trees may have any depth: each round of joins doubles the stretch of ancestors that a node has
collected, so a walk takes the logarithm of the depth in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.functions.regex import let
from provenant.plans.session import stored

READABLE_KINDS = ["section", "subsection", "clause"]
#: Parts that the roots of one tree are dealt to, at most.
DEALS = 4096
#: Trees of at most so many nodes and levels below their roots are nested as one value each.
WHOLE_NODES, WHOLE_LEVELS = 256, 16
_NAMED_KINDS = ["part", "chapter", "section"]


def label_suffix(kind: Column, number: Column, title: Column) -> Column:
    """What a node adds to its parent's label: named kinds a new path part, others "(number)"."""
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" ("), F.trim(title), F.lit(")"))).otherwise("")
    return F.when(kind.isin(_NAMED_KINDS), F.concat(F.lit(" > "), F.initcap(kind), F.lit(" "), number, titled)).otherwise(
        F.concat(F.lit("("), number, F.lit(")")))


def _joined(above: str, own: str) -> Column:
    return F.concat(above, F.lit("/"), own)


def _reached(nodes: DataFrame, tree: str, number: Column, suffix: Column, joined: Callable[[str, str], Column] = _joined) -> DataFrame:
    """(tree, _up, depth, _path, _label, _siblings): what the children of each placed node take from it, and how many they are.

    Only nodes that have children climb, by pointer doubling; those that have arrived are not shuffled to meet others.
    ``joined`` puts the numbers of a path together.
    """
    parents = nodes.select(F.col(tree), F.col("_up").alias("id")).filter("id is not null").groupBy(tree, "id").agg(F.count(F.lit(1)).cast("int").alias("_siblings"))
    climbing = stored(nodes.join(parents, [tree, "id"]).select(
        F.col(tree), "id", F.lit(0).alias("depth"), number.alias("_path"),
        suffix.alias("_label"), F.col("_up").alias("_next"), F.lit(False).alias("_lost"), "_siblings"))
    waiting = None
    while True:
        open_ = climbing.filter("_next is not null and not _lost").count()
        # Each round some node reaches its root, but for nodes below a cycle, which never do.
        if open_ == 0 or open_ == waiting:
            break
        waiting = open_
        above = climbing.select(F.col(tree), F.col("id").alias("_next"), F.col("depth").alias("_d"), F.col("_path").alias("_p"),
                                F.col("_label").alias("_l"), F.col("_next").alias("_then"), F.col("_lost").alias("_gone"), F.lit(True).alias("_met"))
        met = F.col("_met").isNotNull()
        done = F.col("_next").isNull() | F.col("_lost")
        climbing = stored(climbing.filter(~done).join(above, [tree, "_next"], "left").select(
            tree, "id", F.when(met, F.col("depth") + F.col("_d") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(met, joined("_p", "_path")).otherwise(F.col("_path")).alias("_path"),
            F.when(met, F.concat("_l", "_label")).otherwise(F.col("_label")).alias("_label"),
            F.when(met, F.col("_then")).otherwise(F.col("_next")).alias("_next"),
            (F.col("_lost") | F.coalesce("_gone", F.col("_next").isNotNull())).alias("_lost"), "_siblings").union(climbing.filter(done)))
    return climbing.filter("_next is null and not _lost").select(
        F.col(tree), F.col("id").alias("_up"), (F.col("depth") + 1).alias("depth"), "_path", "_label", "_siblings")


def _climb(nodes: DataFrame, tree: str) -> DataFrame:
    """Add depth, _path and _label to (tree, id, _up, _number, _suffix); orphans and cycles are left out.

    Nodes take the path of their parent in a single join, so the bulk of a tree is shuffled once.
    """
    reached = _reached(nodes, tree, F.col("_number"), F.col("_suffix")).drop("_siblings")
    roots = nodes.filter("_up is null").select("*", F.lit(0).alias("depth"), F.col("_number").alias("_path"), F.col("_suffix").alias("_label"))
    below = nodes.filter("_up is not null").join(reached, [tree, "_up"]).withColumns(
        {"_path": _joined("_path", "_number"), "_label": F.concat("_label", "_suffix")})
    return roots.unionByName(below.select(*roots.columns))


def unplaced(nodes: DataFrame, placed: DataFrame, tree: str = "act_id") -> DataFrame:
    """Nodes that have no path: their ancestors are missing or form a cycle."""
    return nodes.filter("kind <> 'act'").join(placed.select(tree, "id"), [tree, "id"], "left_anti")


def descend(nodes: DataFrame, tree: str = "act_id", root_label: str | None = None,
            pad: int | None = None) -> DataFrame:
    """Add depth, sort_path and hierarchy_path to (tree, id, parent_id, kind, number, title).

    Nodes of kind "act" are transparent: their children count as roots. Nodes that no root
    reaches are left out; ``unplaced`` lists them. ``root_label`` names the column with the label of the tree; ``pad``
    left-pads numbers with zeros, otherwise paths order as text ("10" before "2").
    """
    acts = nodes.filter("kind = 'act'").select(F.col(tree), F.col("id").alias("parent_id"), F.lit(True).alias("_act"))
    freed = nodes.filter("kind <> 'act'").join(acts, [tree, "parent_id"], "left").select(
        *nodes.columns, F.when(F.col("_act").isNull(), F.col("parent_id")).alias("_up"))
    keyed = freed.withColumns({
        "_number": F.lpad("number", pad, "0") if pad else F.col("number"),
        "_suffix": label_suffix(F.col("kind"), F.col("number"), F.col("title"))})
    label = F.col(root_label) if root_label else F.lit("")
    return _climb(keyed, tree).select(
        *nodes.columns, "depth", F.col("_path").alias("sort_path"), F.concat(label, "_label").alias("hierarchy_path"))


def sort_paths(nodes: DataFrame, pad: int | None = None, tree: str = "act_id") -> DataFrame:
    return descend(nodes, tree, pad=pad).drop("hierarchy_path")


def hierarchy_labels(nodes: DataFrame, root_label: str, tree: str = "act_id") -> DataFrame:
    return descend(nodes, tree, root_label)


def walk(nodes: DataFrame, root_label: str, tree: str = "act_id") -> DataFrame:
    """Nodes that carry text, with their paths; only these get revisions."""
    return descend(nodes, tree, root_label).filter(F.coalesce("text", F.lit("")) != "")


def _level(depth: int, below: Column | None, fields: Sequence[str]) -> Column:
    """The nodes of one level, each with its stretch of the level below.

    Both levels are held by an array of one struct, so that the level below is built once and not once a node.
    """
    def node(x: Column, under: Column) -> Column:
        return F.struct(*[x["_all"][f].alias(f) for f in fields], F.slice(under, x["_first"] + 1, x["_n"]).alias("children"))
    level = F.filter("_nodes", lambda x: x["depth"] == depth)
    both = F.struct(level.alias("here"), (F.array() if below is None else below).alias("under"))
    return F.transform(F.array(both), lambda s: F.transform(s["here"], lambda x: node(x, s["under"])))[0]


def _levels(held: Column) -> Column:
    """The levels below the roots of a tree that is held as one array of (sort_path, id, _up, _all)."""
    of = lambda rows: F.transform(rows, lambda x: x["id"])
    begin = F.struct(of(F.filter(held, lambda x: x["_up"].isNull())).alias("ids"), F.lit(0).alias("depth"))

    def step(state: Column, _: Column) -> Column:
        return let(of(F.filter(held, lambda x: F.coalesce(F.array_contains(state["ids"], x["_up"]), F.lit(False)))), lambda found: F.struct(
            found.alias("ids"), (state["depth"] + (F.size(found) > 0).cast("int")).alias("depth")))
    return F.aggregate(held, begin, step, lambda state: state["depth"])


def _held_below(parent: Column, depth: int, deepest: int, fields: Sequence[str]) -> Column:
    """The children of a node with all below them, from the array that holds its tree in order."""
    if depth > deepest:
        return F.array()
    return F.transform(F.filter("_held", lambda x: x["_up"] == parent), lambda x: F.struct(
        *[x["_all"][f].alias(f) for f in fields], _held_below(x["id"], depth + 1, deepest, fields).alias("children")))


def _in_levels(nodes: DataFrame, tree: str, columns: Sequence[str]) -> DataFrame:
    """A row per root: its nodes by level, each with its stretch of the level below, for trees of any width, depth and repetition."""
    # A path of (sort_path, id) pairs: nodes of one level in its order keep siblings together.
    own = F.array(F.struct("sort_path", "id"))
    keyed = nodes.select(tree, "id", F.col("parent_id").alias("_up"), "sort_path")
    reached = _reached(keyed, tree, own, F.lit(""), lambda above, number: F.concat(above, number)).drop("_label")
    top = nodes.filter("parent_id is null").select(*columns, F.lit(0).alias("depth"), F.slice(own, 1, 0).alias("_above"), F.lit(0).alias("_siblings"))
    under = nodes.filter("parent_id is not null").select(*columns, F.col("parent_id").alias("_up")).join(
        reached.withColumnRenamed("_path", "_above"), [tree, "_up"]).select(*columns, "depth", "_above", "_siblings")
    # What a node shares with its path is not dealt twice.
    root = lambda: F.when(F.col("depth") == 0, F.col("id")).otherwise(F.col("_above")[0]["id"])
    placed = top.unionByName(under).withColumn("_deal", F.pmod(F.xxhash64(root()), F.lit(DEALS)).cast("int")).repartition(tree, "_deal").withColumns(
        {"_root": root(), "_path": F.concat("_above", own)}).drop("_above")
    # In the order of paths a node, its repetitions and its first child follow each other; the child knows the number of its siblings.
    walk_ = Window.partitionBy(tree, "_deal", "_root").orderBy("_path")
    eldest = F.when(F.lead("depth").over(walk_) == F.col("depth") + 1, F.lead("_siblings").over(walk_))
    counted = placed.withColumns({"_eldest": eldest, "_at": F.row_number().over(walk_)}).withColumn(
        "_n", F.coalesce(F.max("_eldest").over(Window.partitionBy(tree, "_deal", "_root", "_path")), F.lit(0))).drop("_path", "_siblings", "_eldest")
    before = Window.partitionBy(tree, "_deal", "_root", "depth").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int"))
    node = F.struct("depth", "_at", "_first", "_n", F.struct(*columns).alias("_all"))
    return stored(numbered.groupBy(tree, "_deal", "_root").agg(F.array_sort(F.collect_list(node)).alias("_nodes")))


def nest(nodes: DataFrame, tree: str = "act_id",
         fields: Sequence[str] = ("id", "kind", "number", "title", "sort_path")) -> DataFrame:
    """One row per root with its descendants nested as arrays, ordered by sort_path.

    A small tree is collected once and nested as one value: its nodes are shuffled by their tree and nowhere else. In a large one, or
    one in which an id repeats, each node gets its place within its level of the root's tree, and the place and number of its children in the
    level below, where siblings stand together; the levels of a root then fold into each other by slices. The number of
    joins does not depend on the depth, though the type of the result does. The result is one value per root
    by definition, so it fits trees of document size; for wider ones use ``descend``.
    """
    columns = list(dict.fromkeys([tree, "id", "sort_path", *fields]))
    # Sizes come first, so that no large tree is ever collected.
    large = stored(nodes.groupBy(F.col(tree).alias("_tree")).agg(F.count(F.lit(1)).alias("_size")).filter(
        F.col("_tree").isNull() | (F.col("_size") > WHOLE_NODES)).select("_tree"))
    among = lambda how: nodes.join(large, nodes[tree].eqNullSafe(large["_tree"]), how)
    any_large = not large.isEmpty()
    held = F.collect_list(F.struct("sort_path", "id", F.col("parent_id").alias("_up"), F.struct(*columns).alias("_all")))
    trees = (among("left_anti") if any_large else nodes).groupBy(F.col(tree).alias("_tree")).agg(held.alias("_held")).select(F.array_sort("_held").alias("_held"))
    ids = F.transform("_held", lambda x: x["id"])
    alone = F.forall(ids, lambda x: x.isNotNull()) & (F.size(F.array_distinct(ids)) == F.size(ids))
    trees = stored(trees.withColumn("_levels", F.when(alone, _levels(F.col("_held")))))
    fits = F.coalesce(F.col("_levels") <= WHOLE_LEVELS, F.lit(False))
    deepest, others = trees.agg(F.max(F.when(fits, F.col("_levels"))), F.count_if(~fits)).first()

    rest = []
    if others:
        one = trees.filter(~fits).select(F.explode("_held").alias("_x"))
        rest.append(one.select(*[F.col(f"_x._all.{c}").alias(c) for c in columns if c != "parent_id"], F.col("_x._up").alias("parent_id")))
    if any_large:
        rest.append(among("left_semi").select(*[c for c in columns if c != "parent_id"], "parent_id"))
    roots = _in_levels(reduce(DataFrame.unionByName, rest), tree, columns) if rest else None
    if rest:
        deepest = max(deepest or 0, roots.agg(F.max(F.element_at("_nodes", -1)["depth"])).first()[0] or 0)
    whole = trees.filter(fits).select("_held", F.explode(F.filter("_held", lambda x: x["_up"].isNull())).alias("_root")).select(
        *[F.col(f"_root._all.{c}").alias(c) for c in columns if c != "parent_id"],
        _held_below(F.col("_root.id"), 1, deepest or 0, fields).alias("children"))
    if not rest:
        return whole
    folded, below = roots, None
    for depth in range(deepest, 0, -1):
        folded = folded.withColumn(f"_level{depth}", _level(depth, below, fields))
        below = F.col(f"_level{depth}")
    first = F.element_at("_nodes", 1)["_all"]
    return whole.unionByName(folded.select(*[first[c].alias(c) for c in columns if c != "parent_id"],
                                           (F.array() if below is None else below).alias("children")))


def reading_order(nodes: DataFrame, kinds: Sequence[str] = READABLE_KINDS, tree: str = "act_id",
                  order: str = "sort_path") -> DataFrame:
    """Readable nodes with their neighbours in the reading order of their tree."""
    in_tree = Window.partitionBy(tree).orderBy(order, "id")
    return nodes.filter(F.col("kind").isin(*kinds)).withColumns({
        "prev_id": F.lag("id").over(in_tree), "next_id": F.lead("id").over(in_tree)})
