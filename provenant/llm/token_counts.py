"""Token counts by byte-pair merging on a heap and a linked list, without producing token ids.

A pre-token starts as its bytes, linked to their neighbours. All adjacent pairs with a rank wait on a heap; the lowest rank
is popped, its two symbols are joined, and the new pairs with the neighbours are pushed. Entries whose symbols have
changed meanwhile are skipped. The count is the number of bytes less the number of merges.

Equal parts of texts recur, so a worker keeps counts in a table of bounded size. Every document is one row of one Arrow
batch: nothing is shuffled, and a lost task is simply run again.

Cases: a null text counts as empty: 0 bytes, 0 tokens. The model's special strings inside a text count one token each
and split it. Rows that repeat an id are counted separately; only named columns are read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from provenant.llm.segments import parts

#: Pre-token pattern of byte-level models.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's table.
TABLE = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level models."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(kept))
    return [letters[b] for b in range(256)]


class MergeCounter:
    """Counts tokens of texts for one vocabulary file (tokenizers JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model["added_tokens"]]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        #: Rank and result of a pair of symbols; symbols are their byte letters.
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.words = regex.compile(PATTERN)
        self.pretokens: dict[str, int] = {}
        outer = self

        class Parts(dict):
            def __missing__(self, part: str) -> int:
                n = self[part] = outer.count_part(part)
                return n

        class Spaced(dict):
            def __missing__(self, part: str) -> int:
                n = self[part] = outer.count_part(" " + part)
                return n

        self.parts, self.spaced = Parts(), Spaced()

    def merges(self, word: bytes) -> int:
        symbols: list[str | None] = [self.letters[b] for b in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            # Stale: one of the two symbols has been merged since.
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            joined = symbols[i] = left + right
            symbols[j] = None
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((joined, symbols[k]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, joined, symbols[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbols[h], joined))
                if rank is not None:
                    heapq.heappush(heap, (rank, h, symbols[h], joined))
        return done

    def count_part(self, part: str) -> int:
        total = 0
        for word in self.words.findall(part):
            n = self.pretokens.get(word)
            if n is None:
                raw = word.encode("utf-8", "replace")
                n = self.pretokens[word] = len(raw) - self.merges(raw)
            total += n
        return total

    def count(self, text: str) -> int:
        for token in self.special:
            if token in text:
                pieces = text.split(token)
                return sum(map(self.count, pieces)) + len(pieces) - 1
        alone, spaced = parts(text)
        return sum(map(self.parts.__getitem__, alone)) + sum(map(self.spaced.__getitem__, spaced))

    def trim(self) -> None:
        for table in (self.parts, self.spaced, self.pretokens):
            if len(table) > TABLE:
                table.clear()


@cache
def counter(path: str) -> MergeCounter:
    """One per worker process."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the bytes of its text, its tokens, and whether these exceed ``limit``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            counts = []
            for text in batch.column("text"):
                counts.append(model.count(text.as_py()))
                model.trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
