"""N-gram Jaccard join by signature trees.

A document's set is its distinct shingles of five words, as 64-bit hashes. Documents with equal sets are one class, and only
classes are compared. Any two sets that are similar enough share one of the first shingles of their sets under any
common order (prefix filter); these shared shingles give lists of classes. Each list is searched by a signature tree:
leaves hold token bitmaps, inner nodes the bitmaps OR-combined, with ranges of size; a dual traversal from the root
discards pairs of nodes whose largest possible overlap is too small for the similarity, and pairs that are within
one component. What remains is verified on the full sets.

There are two passes. In the first, lists are searched on bitmaps of bounded width, and a pair that passes the bounds is
taken for a link while a list is searched, so that a list of n similar classes yields n - 1 pairs at most, not all of them.
No link is missed, so the components of these pairs, called bundles, hold all links. In the second, a bundle's whole sets are shipped
once to a cell and searched by the same traversal, with one bit for each shingle that two members share: there the overlap
is exact. Only links that join two groups of a cell leave it. A bundle of more than ``CELL`` shingles is cut into blocks:
at first each block meets the next one; bundles that then still hold several components are searched in all pairs of
blocks. So the components are exact, though links within one are not enumerated.

Frequent shingles (shared passages) come last in the order, so that they are in the prefix only of documents that consist of
them. They are counted in every part of the table; at most ``FREQUENT`` of them are shipped, which affects the length
of lists but never the result. Lists longer than ``BLOCK`` are searched in pairs of blocks.

Cases: letters A-Z count as small. A text of one to four words has one shingle, its whole sequence. A null text, an empty one
and one without words has no shingle, is linked with nothing and is its own component. Documents that repeat are one
class; texts are told by their class alone, so rows that repeat an id each get the component of their text, and rows without id
link like others. A null id counts as largest. Distinct sets
are told apart by a 64-bit hash of the set. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from provenant.llm.components import components
from provenant.plans.session import stored

SHINGLE, SHARE, BASE = 5, 80, 100
FREQUENT, BLOCK, LEAF = 400_000, 2048, 16
#: Shingles of a block of a bundle, and the widest bitmap of a set, in bits.
CELL, WIDEST = 1_000_000, 16384
#: Entries of a worker's table of words, and tokens that are counted at a time for frequency.
TABLE, CHUNK = 250_000, 2_000_000
#: Bits of the filter of classes that are in a bundle; a full filter only ships more sets.
FILTER_BITS = 1 << 23
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    # Bytes split at ASCII white space only and lower A-Z only.
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    if len(words) > TABLE:
        words.clear()
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if len(h) < SHINGLE:
        total = np.array([len(h)], np.uint64)
        for i in range(len(h)):
            total = mixed(total * _MULTIPLIERS[0] + h[i:i + 1])
        return total
    total = h[:len(h) - SHINGLE + 1] * _MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        total = mixed(total) + h[k:len(h) - SHINGLE + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mixed(total))


def prefix_length(n: int) -> int:
    return n - -(-SHARE * n // BASE) + 1


def signature(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a set, as 64-bit words; about a third of its bits are set, more for sets of many thousands."""
    width = min(WIDEST, max(64, 1 << int(2 * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap OR-folded to fewer words."""
    while len(bitmap) > words:
        bitmap = bitmap[:len(bitmap) // 2] | bitmap[len(bitmap) // 2:]
    return bitmap


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles that three different sets, and one in two thousand, of some part of the table share; the most frequent ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size, classes = Words(), [], 0, set()

        def chunk() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(3, len(held) // 2000)
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), words)
                key = _class_of(tokens)
                if len(tokens) and key not in classes:
                    classes.add(key)
                    held.append(tokens)
                    size += len(tokens)
                    if size >= CHUNK:
                        yield chunk()
                        held, size, classes = [], 0, set()
        if held:
            yield chunk()

    found = rows.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = stored(found)
    # From the most frequent down, as long as they fit; there are few different counts among frequent ones.
    least, room = 3, FREQUENT
    for n, c in found.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect():
        if c > room:
            least = n + 1
            break
        room -= c
    top = found.filter(F.col("n") >= least).select("token").toArrow().column("token").to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _class_of(tokens: np.ndarray) -> int:
    total = mixed(tokens + np.uint64(1)).sum(keepdims=True, dtype=np.uint64) * _MULTIPLIERS[0] + np.uint64(len(tokens))
    return int(mixed(total).view(np.int64)[0])


def _sets(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per document its class and set size, and, unless a part of the table repeats a set, a number, bitmap, prefix and the whole set."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, seen, number = Words(), shared.value, set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found: list[list] = [[] for _ in range(6)]
                for text in some.column("text"):
                    tokens = shingles(text.as_py(), words)
                    n, key = len(tokens), _class_of(tokens)
                    if not n or key in seen:
                        made = [n, key if n else None, None, None, None, None]
                    else:
                        if len(seen) < TABLE:
                            seen.add(key)
                        often = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens if len(last) else np.zeros(n, bool)
                        p = prefix_length(n)
                        first = tokens[~often][:p]
                        if len(first) < p:
                            first = np.concatenate((first, tokens[often][:p - len(first)]))
                        number += 1
                        made = [n, key, number, signature(tokens).tobytes(), first.view(np.int64), tokens.tobytes()]
                    for column, value in zip(found, made):
                        column.append(value)
                kinds = [*[pa.int64()] * 3, pa.binary(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *map(pa.array, found, kinds)],
                                                 names=["doc_id", "n", "class", "number", "bitmap", "prefix", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, class bigint, number bigint, bitmap binary, prefix array<bigint>, tokens binary")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, class), those of tokens with two classes at least, once each."""
    tail_t, tail_c = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pick(t: np.ndarray, c: np.ndarray) -> pa.RecordBatch | None:
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[fresh], c[fresh]
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(c[keep])], names=["token", "class"]) if keep.any() else None

    for batch in batches:
        t = np.concatenate((tail_t, batch.column("token").to_numpy()))
        c = np.concatenate((tail_c, batch.column("class").to_numpy()))
        # The last token's rows may go on in the next batch.
        cut = int(np.searchsorted(t, t[-1])) if len(t) else 0
        tail_t, tail_c = t[cut:], c[cut:]
        if (out := pick(t[:cut], c[:cut])) is not None:
            yield out
    if (out := pick(tail_t, tail_c)) is not None:
        yield out


def _lists(sets: DataFrame) -> DataFrame:
    """(list, class): lists of classes that share a prefix shingle, without lists that others contain."""
    rows = sets.filter("prefix is not null").select(F.explode("prefix").alias("token"), "class")
    rows = stored(rows.repartition("token").sortWithinPartitions("token", "class").mapInArrow(_shared_rows, "token bigint, class bigint"))
    # Of lists with equal members, one.
    marks = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("mark"))
    chosen = marks.groupBy("mark", "size").agg(F.min("token").alias("token"))
    rows = stored(rows.join(chosen.select("token", "size"), "token"))
    # A list all of whose members have one longer list as their longest is contained in that.
    longest = rows.groupBy("class").agg(F.max(F.struct("size", "token")).alias("longest"))
    span = rows.join(longest, "class").groupBy("token").agg(F.min("longest").alias("low"), F.max("longest").alias("high"))
    kept = span.filter("low <> high or low.token = token").select("token")
    return stored(rows.join(kept, "token").select(F.col("token").alias("list"), "class", "size"))


class Node:
    """A node of a signature tree: members [begin, end) of the sorted list, what their sets can hold, and their sizes."""

    __slots__ = ("begin", "end", "bitmap", "low", "high", "fewest", "children", "single")

    def __init__(self, begin: int, end: int, bitmap: np.ndarray, low: int, high: int, fewest: int, children: list[Node]):
        self.begin, self.end, self.bitmap, self.low, self.high = begin, end, bitmap, low, high
        self.fewest, self.children, self.single = fewest, children, False


def tree(sizes: np.ndarray, bitmaps: np.ndarray, counts: np.ndarray) -> Node:
    """The tree over members in their order; ``counts`` are the bits set per member."""
    level = []
    for b in range(0, len(sizes), LEAF):
        e = min(b + LEAF, len(sizes))
        level.append(Node(b, e, np.bitwise_or.reduce(bitmaps[b:e], axis=0), int(sizes[b:e].min()), int(sizes[b:e].max()), int(counts[b:e].min()), []))
    while len(level) > 1:
        upper = []
        for i in range(0, len(level), 4):
            kids = level[i:i + 4]
            upper.append(Node(kids[0].begin, kids[-1].end, np.bitwise_or.reduce([k.bitmap for k in kids], axis=0), min(k.low for k in kids),
                              max(k.high for k in kids), min(k.fewest for k in kids), kids))
        level = upper
    return level[0]


def _possible(a: Node, b: Node, exact: bool) -> bool:
    """Whether some member of one node may be similar enough to one of the other."""
    if a.low * BASE > b.high * BASE * BASE // SHARE or b.low * BASE > a.high * BASE * BASE // SHARE:
        return False
    both = int(np.bitwise_count(a.bitmap & b.bitmap).sum())
    if exact:
        overlap = min(a.high, b.high, both)
    else:
        overlap = min(a.high - max(0, a.fewest - both), b.high - max(0, b.fewest - both))
    # overlap / (x + y - overlap) >= SHARE / BASE for the smallest sizes that can have this overlap.
    x, y = max(a.low, overlap), max(b.low, overlap)
    return overlap * (BASE + SHARE) >= SHARE * (x + y)


class Groups:
    """Union of members that are linked or taken to be."""

    def __init__(self, roots: np.ndarray):
        self.up = list(range(len(roots)))
        first: dict[int, int] = {}
        for i, r in enumerate(roots.tolist()):
            self.up[i] = first.setdefault(r, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def single(self, node: Node) -> bool:
        """Whether a node's members are one group. Once they are, they stay so."""
        if not node.single:
            if node.children:
                node.single = all(map(self.single, node.children)) and len({self.find(k.begin) for k in node.children}) == 1
            else:
                node.single = len(set(map(self.find, range(node.begin, node.end)))) == 1
        return node.single


def search(sizes: np.ndarray, flat: np.ndarray, roots: np.ndarray, exact: bool, sides: np.ndarray | None = None,
           own: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of members that may be similar, as few as connect all such pairs, by dual traversal of the tree.

    ``exact``: the bitmaps have a bit for each shared shingle, so overlaps are known and the pairs are similar.
    ``sides``: of two blocks, only pairs across. ``own``: only pairs with one of these members.
    """
    counts = np.bitwise_count(flat).sum(axis=1).astype(np.int64)
    groups = Groups(roots)
    root = tree(sizes, flat, counts)
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if groups.single(a) and groups.single(b) and groups.find(a.begin) == groups.find(b.begin) or not _possible(a, b, exact):
            continue
        if a.children or b.children:
            if a is b:
                # A node with itself comes before pairs of nodes, which then have less to do.
                kids = a.children
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i + 1, len(kids))] + [(k, k) for k in kids]
            elif a.children and (not b.children or a.end - a.begin >= b.end - b.begin):
                stack += [(k, b) for k in a.children]
            else:
                stack += [(a, k) for k in b.children]
            continue
        both = np.bitwise_count(flat[a.begin:a.end, None] & flat[None, b.begin:b.end]).sum(axis=2).astype(np.int64)
        n, m = sizes[a.begin:a.end, None], sizes[None, b.begin:b.end]
        overlap = both if exact else np.minimum(n - counts[a.begin:a.end, None] + both, m - counts[None, b.begin:b.end] + both)
        fits = overlap * (BASE + SHARE) >= SHARE * (n + m)
        if sides is not None:
            fits &= sides[a.begin:a.end, None] != sides[None, b.begin:b.end]
        if own is not None:
            fits &= own[a.begin:a.end, None] | own[None, b.begin:b.end]
        for x, y in np.argwhere(fits).tolist():
            if groups.join(a.begin + x, b.begin + y):
                yield a.begin + x, b.begin + y


def shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Per set a bit for each shingle that two sets have at least, as 64-bit words."""
    all_, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets])
    distinct, place, n = np.unique(all_, return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[place]
    words = max(1, -(-int((n > 1).sum()) // 64))
    bits = np.zeros((len(sets), words), np.uint64)
    for i, (b, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        own = column[b:e]
        own = own[own >= 0]
        np.bitwise_or.at(bits[i], own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
    return bits


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches; a run's length is bounded by whoever made the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for b, e in zip(edges, edges[1:]):
            if b and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(b, e - b))
    if held:
        yield pa.Table.from_batches(held)


def _by_width(sizes: np.ndarray, bitmaps: list[np.ndarray], roots: np.ndarray, sides: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Pairs that bitmaps cannot keep apart. Sets that may be similar have bitmaps of one width, or of one and twice that, so none is folded further."""
    widths = np.array([len(b) for b in bitmaps])
    for width in np.unique(widths).tolist():
        own = widths == width
        at = np.flatnonzero(own | (widths == 2 * width) & (sizes * SHARE <= BASE * sizes[own].max()))
        if len(at) > 1:
            flat = np.stack([folded(bitmaps[i], width) for i in at.tolist()])
            for i, j in search(sizes[at], flat, roots[at], False, None if sides is None else sides[at], own[at]):
                yield int(at[i]), int(at[j])


def _searcher(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left.clear()
            right.clear()
            return out

        for rows in grouped(batches, "group"):
            n, classes, roots = (rows.column(c).to_numpy() for c in ("n", "class", "root"))
            # Similar sizes, then equal components, are neighbours in the tree.
            order = np.lexsort((classes, roots, n))
            sides = rows.column("side").to_numpy()[order]
            signs = rows.column("signs")
            held = [np.frombuffer(signs[i].as_buffer(), np.uint64) for i in order.tolist()]
            names, across = classes[order], sides if sides.any() else None
            found = search(n[order], shared_bits(held), roots[order], True, across) if exact else _by_width(n[order], held, roots[order], across)
            for i, j in found:
                x, y = int(names[i]), int(names[j])
                left.append(min(x, y))
                right.append(max(x, y))
                if len(left) >= 50_000:
                    yield made()
        if left:
            yield made()
    return run


def _searched(rows: DataFrame, exact: bool) -> DataFrame:
    """Pairs of classes found in cells: rows of (group, class, root, side, n, signs)."""
    rows = rows.repartition("group").sortWithinPartitions("group").select("group", "class", "root", "side", "n", "signs")
    return rows.mapInArrow(_searcher(exact), "a bigint, b bigint").distinct()


def _seats(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """The cells of each row where the blocks of a key meet in pairs; a block with itself has no sides."""
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda k: F.struct(
        F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), F.when(own == k, 0).when(own < k, 1).otherwise(2).cast("int").alias("side")))
    return rows.withColumn("_m", F.explode(meets)).select("class", "root", F.xxhash64(key, "_m.i", "_m.j").alias("group"), F.col("_m.side").alias("side"))


def _bundles(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that bitmaps cannot keep apart."""
    seats = _seats(lists.withColumn("root", F.col("class")), "list", F.ceil(F.col("size") / BLOCK).cast("int"))
    return stored(components(_searched(seats.join(classes, "class").withColumnRenamed("bitmap", "signs"), False)))


def _links(sets: DataFrame, bundles: DataFrame) -> DataFrame:
    """Links of classes, as many as connect all that are linked."""
    # Any row of a class has its set; the one with the least number gives it.
    chosen = sets.filter("number is not null").groupBy("class").agg(F.min("number").alias("number"), F.first("n").alias("n"))
    members = stored(bundles.select(F.col("node").alias("class"), F.col("root").alias("bundle")).join(chosen, "class"))
    cells = members.groupBy("bundle").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("blocks"))
    members = stored(members.join(cells, "bundle"))
    # A filter of FILTER_BITS / 8 bytes at most spares the sets of other classes the shuffle.
    bit = F.pmod(F.xxhash64("class"), F.lit(FILTER_BITS))
    parts = (members.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")))
    byte = F.ascii(F.decode(F.substr("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    marked = sets.filter("number is not null").select("class", "number", "n", F.col("tokens").alias("signs"), F.bitmap_bucket_number(bit).alias("part"),
                                                      F.bitmap_bit_position(bit).alias("bit")).join(F.broadcast(parts), "part")
    whole = marked.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select("number", "n", "signs")
    whole = stored(members.select("class", "number").join(whole, "number").select("class", "n", "signs"))

    # Each block meets itself and the next one, so that most bundles are one component after that.
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    ring = F.when(F.col("blocks") < 3, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(own, F.pmod(own + 1, F.col("blocks"))).cast("array<bigint>"))
    seats = members.withColumn("_cell", F.explode(ring)).select("class", F.col("class").alias("root"), F.xxhash64("bundle", "_cell").alias("group"), F.lit(0).alias("side"))
    first = stored(_searched(seats.join(whole, "class"), True))
    large = members.filter("blocks > 3")
    if large.isEmpty():
        return first
    roots = stored(components(first))
    large = large.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = large.groupBy("bundle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bundle")
    more = _searched(_seats(large.join(open_, "bundle"), "bundle", F.col("blocks")).join(whole, "class"), True)
    return first.union(more)


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Per document its id, class and set size; and the root of each class that is linked with others."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = stored(_sets(rows, _frequent(rows)))
    classes = sets.filter("bitmap is not null").select("class", "n", "bitmap").dropDuplicates(["class"])
    bundles = _bundles(_lists(sets), classes)
    return sets.select("doc_id", "n", "class"), stored(components(_links(sets, bundles)))


def class_column(text: str) -> Column:
    """The class of a text's set, also of the empty one."""
    @F.pandas_udf("bigint")
    def classes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for batch in batches:
            yield pd.Series([_class_of(shingles(x, words)) for x in batch], dtype="int64")

    return classes(text)


def chosen_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(class) of each component the one that has its least id."""
    sets, roots = _linked(docs, id_col, text_col)
    least = sets.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    named = least.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("least")).select("least.class")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, and component_id, the least id that links reach."""
    sets, roots = _linked(docs, id_col, text_col)
    named = sets.select("doc_id", "n", "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


LINK_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM parts),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r ON s.doc_id = r.doc_id
"""
