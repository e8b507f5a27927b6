"""Periodic runs of words by suffix trees, longest common extensions, and Lyndon roots.

A run is a stretch of words of smallest period q that no neighbour extends, of at least ``4 q`` and at least 6 words. Every run has a
root, one period long, that is a longest Lyndon word at its place in one of two orders of the words, the natural and the
reverse. So the longest Lyndon word at each place, in both orders, gives a candidate (place, period); it is extended
to the right by the longest common extension of two suffixes and to the left by that of two prefixes, and what is long enough is a run.

Suffix trees of a text and its reversal come from Ukkonen's algorithm. An Euler tour of a tree turns the extension of two suffixes
into the least depth between their leaves, answered in constant time from minima over blocks. The order of
the leaves in a tour is the order of the suffixes; the longest Lyndon word at a place ends before the next smaller suffix. Visiting
children in reverse gives the other order.

In a run each three neighbouring words recur at least twice more. Stretches of a text without such words hold no run, so trees are
built for the other stretches only, each in its own; this drops nothing and is no part of deciding what a run is.

Cases: a null, empty or short text has no words or runs. Words are compared byte by byte. Rows that repeat an id are separate;
only named columns are read. An empty table gives an empty table. A text is one row of one task, whatever its length; trees take
some 500 bytes a word of its recurring stretches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Periods and words a run has at least.
PERIODS, WORDS = 4, 6
#: Places of a tour whose least depth is kept as one.
TOUR_BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of ``symbols``, positive numbers; 0 is added as the end."""

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, 0]
        n, width = len(s), max(s) + 1
        # An edge is kept at its lower node, as the places of its first symbol and behind its last.
        first, last, link, parent = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            made = 0
            while waiting:
                if length == 0:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i), last.append(n), link.append(0), parent.append(node)
                    if made:
                        link[made] = node
                    made = 0
                else:
                    size = (last[below] if last[below] < i + 1 else i + 1) - first[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    at = first[below] + length
                    if s[at] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(first)
                    child[key] = split
                    first.append(first[below]), last.append(at), link.append(0), parent.append(node)
                    child[split * width + c] = split + 1
                    first.append(i), last.append(n), link.append(0), parent.append(split)
                    first[below], parent[below] = at, split
                    child[split * width + s[at]] = below
                    if made:
                        link[made] = split
                    made = split
                waiting -= 1
                if node == 0:
                    if length:
                        length -= 1
                        edge = i - waiting + 1
                else:
                    node = link[node]
        self.count = n
        self.spans = np.array(last) - np.array(first)
        self._children(child, width)

    def _children(self, child: dict[int, int], width: int) -> None:
        """Children of all nodes in one list, by node and symbol, and where each node's begin."""
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        self.kids = nodes[order]
        owners = keys[order] // width
        self.bounds = np.searchsorted(owners, np.arange(len(self.spans) + 1))

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depths along an Euler tour, the place in it of each suffix's leaf, and the suffixes in order."""
        kids, bounds, spans, n = self.kids.tolist(), self.bounds.tolist(), self.spans.tolist(), self.count
        depths, places, order = [], [0] * n, []
        # Below a node lie its children with the way back up to it between them; the way back is a negative number.
        stack, down = [0], [0]
        while stack:
            node, depth = stack.pop(), down.pop()
            if node < 0:
                depths.append(depth)
                continue
            depth += spans[node]
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                suffix = n - depth
                places[suffix] = len(depths)
                order.append(suffix)
                depths.append(depth)
                continue
            depths.append(depth)
            for kid in reversed(kids[a:b]):
                stack.append(-1), down.append(depth)
                stack.append(kid), down.append(depth)
        return np.array(depths), np.array(places), np.array(order)

    def reverse_order(self) -> np.ndarray:
        """Suffixes in the order that reverses the symbols; a suffix still comes after its own beginnings."""
        kids, bounds, spans, n = self.kids.tolist(), self.bounds.tolist(), self.spans.tolist(), self.count
        order, stack, down = [], [0], [0]
        while stack:
            node, depth = stack.pop(), down.pop()
            depth += spans[node]
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                order.append(n - depth)
                continue
            own = kids[a:b]
            # The end of the text is the least symbol in both orders; an edge that is only this symbol is a leaf's.
            if self._ends(own[0], depth):
                own = own[1:] + own[:1]
            stack += own
            down += [depth] * len(own)
        return np.array(order)

    def _ends(self, node: int, depth: int) -> bool:
        return self.bounds[node] == self.bounds[node + 1] and self.spans[node] == 1


class Extensions:
    """Longest common beginnings of pairs of suffixes, as least depths between two places of a tour."""

    def __init__(self, tree: SuffixTree):
        depths, self.places, self.order = tree.tour()
        size = -(-len(depths) // TOUR_BLOCK)
        self.blocks = np.full(size * TOUR_BLOCK, np.iinfo(np.int64).max)
        self.blocks[:len(depths)] = depths
        self.blocks = self.blocks.reshape(size, TOUR_BLOCK)
        self.before = np.minimum.accumulate(self.blocks, axis=1)
        self.behind = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1]
        level = self.before[:, -1]
        self.levels = [level]
        while 1 << len(self.levels) <= size:
            half = 1 << len(self.levels) - 1
            level = np.minimum(level[:-half], level[half:])
            self.levels.append(level)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For two different suffixes each."""
        x, y = self.places[a], self.places[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // TOUR_BLOCK, y // TOUR_BLOCK
        least = np.minimum(self.behind[p, x % TOUR_BLOCK], self.before[q, y % TOUR_BLOCK])
        between = q - p - 1
        far = np.flatnonzero(between > 0)
        if len(far):
            step = np.frexp(between[far])[1] - 1
            for k in np.unique(step):
                some, level = far[step == k], self.levels[k]
                least[some] = np.minimum(least[some], np.minimum(level[p[some] + 1], level[q[some] - (1 << k)]))
        near = np.flatnonzero(between < 0)
        if len(near):
            rows, offsets = self.blocks[p[near]], np.arange(TOUR_BLOCK)
            inside = (offsets >= (x[near] % TOUR_BLOCK)[:, None]) & (offsets <= (y[near] % TOUR_BLOCK)[:, None])
            least[near] = np.where(inside, rows, np.iinfo(np.int64).max).min(axis=1)
        return least


def next_smaller(order: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one, the first later suffix that is smaller in ``order``."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ranks, found, stack = rank.tolist(), [0] * (n - 1), [n - 1]
    for i in range(n - 2, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        found[i] = stack[-1]
        stack.append(i)
    return np.array(found, np.int64)


def runs_of(symbols: list[int], periods: int = PERIODS, words: int = WORDS) -> set[tuple[int, int, int]]:
    """Start, length and period of all runs of a list of positive numbers."""
    n = len(symbols)
    if n < 2:
        return set()
    tree = SuffixTree(symbols)
    ahead, back = Extensions(tree), Extensions(SuffixTree(symbols[::-1]))
    found: set[tuple[int, int, int]] = set()
    for order in (ahead.order, tree.reverse_order()):
        ends = next_smaller(order)
        starts = np.arange(n)
        period = ends - starts
        # A root that begins the last period has nothing to the right; one at the first word nothing to the left.
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        some = ends < n
        right[some] = ahead.of(starts[some], ends[some])
        some = starts > 0
        # The prefix before place i is the suffix of the reversal from n - i on.
        left[some] = back.of(n - starts[some], n - ends[some])
        length = left + period + right
        kept = (length >= periods * period) & (length >= words)
        found.update(zip((starts - left)[kept].tolist(), length[kept].tolist(), period[kept].tolist()))
    return found


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Where runs may lie: the longest stretches whose every three neighbouring words recur twice or more. Equal hashes of
    different words only make a stretch longer."""
    n = len(words)
    if n < WORDS:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        triples = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
    ordered = np.sort(triples)
    thrice = ordered[2:][ordered[2:] == ordered[:-2]]
    if not len(thrice):
        return []
    good = np.flatnonzero(np.isin(triples, np.unique(thrice)))
    cut = np.flatnonzero(np.diff(good) > 1)
    firsts, lasts = good[np.r_[0, cut + 1]], good[np.r_[cut, len(good) - 1]] + 3
    return [(a, b) for a, b in zip(firsts.tolist(), lasts.tolist()) if b - a >= WORDS]


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs, by start and then period."""
    found: list[tuple[int, int, int]] = []
    for a, b in stretches(words):
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(w, len(number) + 1) for w in words[a:b]]
        # A word of a run recurs; if too few words do, no tree is needed.
        if max(Counter(symbols).values()) >= PERIODS:
            found += [(a + start, length, period) for start, length, period in runs_of(symbols)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that lie in the first period of every run that holds them."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its words, its runs in order of start and period, and its text with each run cut to one period."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                counts, all_runs, texts = [], [], []
                for text in some.column("text").cast(pa.binary()):
                    words = text.as_py().split()
                    runs = runs_of_words(words)
                    counts.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(b" ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(all_runs, RUNS_TYPE),
                                                  pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run; of equally long ones that of least start, then least period. Null if there is none."""
    keys = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short")))
    best = F.array_max(keys)
    return F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["short"]).alias("period"))
