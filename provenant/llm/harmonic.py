"""Packing token sequences by harmonic classes.

A piece of length n belongs to class k = capacity // n: k pieces of the class fit in a sequence, whatever their exact
lengths. Each worker fills the sequences of each class with exactly k pieces, on its own, and needs to know nothing
of other pieces. Since documents may be cut, a remainder that would waste more than ``slack`` tokens of its k-th share
is cut at capacity // (k + 1), which fills its class exactly, and what is left is much shorter; so little is
padded and a document has few pieces.

A worker ends with fewer than k open pieces per class. These are handed on, by groups of 64 workers, to further
rounds that do the same, until one group is left; its open pieces, a bounded number, are packed first-fit across
classes.

Cases: a null text counts as empty; an empty document is its end id alone. Special strings of the vocabulary inside a text
give their own ids, as the library does. Rows that repeat an id are separate documents. An empty table has no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice
from struct import pack as pack_numbers

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from provenant.llm.segments import parts
from provenant.llm.token_counts import PATTERN, byte_letters
from provenant.plans.session import stored

CAPACITY, SLACK, WORKERS_PER_GROUP = 2048, 8, 64
#: Entries of each of a worker's tables of token ids.
TABLE = 800_000
FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, worker bigint, sequence_id bigint, offset bigint"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "sequence_id", "offset"]


class Known(dict):
    """Token ids, as bytes, of pre-tokens or of parts of texts; a missing key is worked out by ``find``."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = self.find(key)
        return ids

    def trim(self) -> None:
        """Forget the older half of a full table."""
        if len(self) > TABLE:
            for key in list(islice(self, len(self) // 2)):
                del self[key]


class Ids:
    """Token ids of texts, as bytes, by the tokenizers library; a part of a text that recurs, and a pre-token that does, are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores run other tasks
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenize = self.tokenizer.model.tokenize
        pretokens, find = Known(self.pretoken), regex.compile(PATTERN).findall
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.alone = Known(lambda part: b"".join(map(pretokens.__getitem__, find(part))))
        self.spaced = Known(lambda part: b"".join(map(pretokens.__getitem__, find(" " + part))))
        self.tables = [pretokens, self.alone, self.spaced]

    def pretoken(self, word: str) -> bytes:
        # The model merges the letters that stand for the bytes.
        letters = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(letters)]
        return pack_numbers(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> list[str | bytes]:
        """Texts between special strings, and those strings' ids."""
        for token, number in self.special.items():
            if token in text:
                out: list[str | bytes] = []
                for i, piece in enumerate(text.split(token)):
                    out += [number.to_bytes(4, "little")] * (i > 0) + self.split(piece)
                return out
        return [text]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            out: list[bytes] = []
            for piece in self.split(text):
                if isinstance(piece, bytes):
                    out.append(piece)
                    continue
                alone, spaced = parts(piece)
                out += map(self.alone.__getitem__, alone)
                out += map(self.spaced.__getitem__, spaced)
            for table in self.tables:
                table.trim()
            yield b"".join(out)


@cache
def ids_of(path: str) -> Ids:
    """One per worker process."""
    return Ids(path)


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> Iterator[tuple[int, int]]:
    """Lengths and classes of a document's pieces, in order."""
    while n >= capacity:
        yield capacity, 1
        n -= capacity
    while n:
        k = capacity // n
        if capacity - k * n <= slack * k:
            yield n, k
            return
        size = capacity // (k + 1)
        yield size, k + 1
        n -= size


class Filler:
    """Fills the sequences of each class; ids of sequences start at ``base``."""

    def __init__(self, base: int):
        self.base, self.made = base, 0
        self.open: dict[int, list[list]] = defaultdict(list)

    def add(self, piece: list) -> list[list]:
        """The pieces of a sequence that this one completes, or none."""
        k = piece[5]
        bin_ = self.open[k]
        bin_.append(piece)
        if len(bin_) < k:
            return []
        self.open[k] = []
        return self.close(bin_)

    def close(self, bin_: list[list]) -> list[list]:
        at = 0
        for piece in bin_:
            piece[7], piece[8] = self.base + self.made, at
            at += piece[2]
        self.made += 1
        return bin_


def first_fit(pieces: list[list], filler: Filler, capacity: int) -> list[list]:
    bins: list[tuple[int, list[list]]] = []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3])):
        for i, (used, bin_) in enumerate(bins):
            if used + piece[2] <= capacity:
                bin_.append(piece)
                bins[i] = (used + piece[2], bin_)
                break
        else:
            bins.append((piece[2], [piece]))
    return [p for _, bin_ in bins for p in filler.close(bin_)]


def _base(round_: int, worker: int) -> int:
    return (round_ << 56) + (worker << 32)


def _types(id_type: pa.DataType) -> list[pa.DataType]:
    return [id_type, *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 3]


def refill(round_: int, last: bool, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Fill sequences from the open pieces of a group of workers; the last group leaves none open."""
    def run(table: pa.Table) -> pa.Table:
        pieces = [list(p.values()) for p in table.select(COLUMNS).to_pylist()]
        pieces.sort(key=lambda p: (p[5], p[0] is None, p[0] if p[0] is not None else 0, p[1:5]))
        filler, done = Filler(_base(round_, pieces[0][6])), []
        for piece in pieces:
            done += filler.add(piece)
        left = [p for bin_ in filler.open.values() for p in bin_]
        done += first_fit(left, filler, capacity) if last else left
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _types(table.schema.field("doc_id").type))], names=COLUMNS)
    return run


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, slack: int = SLACK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece its document, place, checksum, sequence and offset there."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {FIELDS}"
    end = end_id.to_bytes(4, "little")

    def cut_and_fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        model, filler, id_type = ids_of(path), Filler(_base(0, worker)), None

        def table(pieces: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), _types(id_type))], names=COLUMNS)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            done: list[list] = []
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                for doc, ids in zip(some.column("doc_id").to_pylist(), model.encode(some.column("text").to_pylist())):
                    ids = memoryview(ids + end)
                    total, start = len(ids) // 4, 0
                    for length, k in cuts(total, capacity, slack):
                        crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                        done += filler.add([doc, start, length, crc, total, k, worker, None, None])
                        start += length
            if done:
                yield table(done)
        if rest := [p for bin_ in filler.open.values() for p in bin_]:
            yield table(rest)

    pieces = stored(rows.mapInArrow(cut_and_fill, schema))
    out = pieces.filter("sequence_id is not null")
    rest, round_ = pieces.filter("sequence_id is null"), 0
    workers = (pieces.agg(F.max("worker")).first()[0] or 0) + 1
    while True:
        round_ += 1
        workers = -(-workers // WORKERS_PER_GROUP)
        last = workers == 1

        grouped = rest.withColumn("worker", F.floor(F.col("worker") / WORKERS_PER_GROUP))
        packed = stored(grouped.groupBy("worker").applyInArrow(refill(round_, last, capacity), schema))
        out = out.unionByName(packed.filter("sequence_id is not null"))
        if last:
            return out.drop("worker", "class")
        rest = packed.filter("sequence_id is null")
