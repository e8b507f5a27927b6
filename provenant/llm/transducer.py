"""Byte-pair encoding by a lazily determinised finite-state transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is the byte-pair encoding of its bytes if and only if each two neighbours are the encoding of
their concatenation. So a nondeterministic transducer does the encoding: a state is the last token written and the place in the
trie of the token being read, and after a token any token may begin that may follow it. Whether b may follow a is
read off the merges (``Merges.fits``): the symbols at the border grow by the merges inside a and b, and no merge across the border
may come earlier than the one that uses up one of its two symbols.

Subsets of its states are determinised when a text first needs them. The tokens that all states of a subset
agree on are written, the others wait with their state; since no token is longer than the longest of the vocabulary, so is the
lookahead. A table of subsets that is full is begun anew; of recurring parts of texts, the older half goes.

Decoding looks up a token's bytes and lets the UTF-8 machine, whose steps over whole tokens are compiled from its steps over bytes,
hold back the bytes of an unfinished character, so that each block handed on ends between characters.

Cases: a null text counts as empty and has no ids. Special strings have no meaning. A text without white space is one part and
is not kept in the table. Bytes that are no UTF-8 decode to themselves (``decode``) or to U+FFFD (``Utf8Stream.text``). Rows that
repeat an id are separate; only named columns are read. An empty table gives an empty table. An id that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
import string
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from provenant.llm.segments import parts

#: Entries of a worker's tables: recurring parts of texts, pre-tokens, and moves between subsets.
PARTS, PIECES, MOVES = 400_000, 250_000, 700_000
#: Longer parts are not kept, so that a table's bytes are bounded too.
KEPT_CHARACTERS = 64
#: Ids decoded at a time.
BLOCK = 8192
NEVER = 1 << 62
#: A move's run of tokens; a table of moves has fewer.
RUN_BITS = 24
RUN_MASK = (1 << RUN_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Merges:
    """The order of merges that a table of ranks stands for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes")
        #: Per token its last (first) symbol while its merges go on, from the byte up, with the rank of the merge that uses it up.
        self.ends: dict[int, list[tuple[bytes, int]]] = {}
        self.starts: dict[int, list[tuple[bytes, int]]] = {}
        #: Tokens that no merges make; they stand only for a whole pre-token.
        self.unmade: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(token) == 1:
                self.ends[rank] = self.starts[rank] = [(token, NEVER)]
                continue
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                # Both parts have been made by earlier merges and are next to each other when this one comes.
                if left in self.ends and right in self.starts and self.fits(left, right, rank):
                    self.ends[rank] = [*self.ends[right][:-1], (token[cut:], rank), (token, NEVER)]
                    self.starts[rank] = [*self.starts[left][:-1], (token[:cut], rank), (token, NEVER)]
                    break
            else:
                self.unmade[token] = rank

    def fits(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a and b stay apart under all merges of a rank below ``before``."""
        ends, starts, get = self.ends[a], self.starts[b], self.ranks.get
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = ends[i], starts[j]
            across = get(x + y, NEVER)
            # At equal ranks the merge further left comes first.
            if across < before and across < x_used and across <= y_used:
                return False
            if x_used <= y_used:
                if x_used == NEVER:
                    return True
                i += 1
            else:
                j += 1


class Transducer:
    """Encodes pre-tokens; subsets of states are numbered as they are first met."""

    def __init__(self, ranks: dict[bytes, int], most_moves: int = MOVES):
        self.merges, self.most_moves = Merges(ranks), most_moves
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for token, rank in ranks.items():
            if rank not in self.merges.ends:
                continue
            node = 0
            for byte in token:
                key = node << 8 | byte
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner[node] = True
                    self.inner.append(False)
                node = after
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        #: States of a subset as numbers: how many tokens wait, these, the last token, the place in the trie; the state between
        #: two tokens comes last.
        self.subsets: list[bytes] = [pack("<3i", 0, -1, 0)]
        self.number = {self.subsets[0]: 0}
        #: Runs of tokens that moves write; a move is the next subset and the number of such a run.
        self.runs: list[tuple[int, ...]] = [()]
        self.run_number: dict[tuple[int, ...], int] = {(): 0}
        #: What is left to write where a text ends, by subset.
        self.rest = [0]
        self.moves: dict[int, int] = {}

    def run(self, tokens: tuple[int, ...]) -> int:
        number = self.run_number.get(tokens)
        if number is None:
            number = self.run_number[tokens] = len(self.runs)
            self.runs.append(tokens)
        return number

    def states(self, subset: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """Waiting tokens, last token and place of each state."""
        packed, at = self.subsets[subset], 0
        numbers = unpack(f"<{len(packed) // 4}i", packed)
        while at < len(numbers):
            end = at + 1 + numbers[at]
            yield numbers[at + 1:end], numbers[end], numbers[end + 1]
            at = end + 2

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.most_moves:
                self.pairs.clear()
            known = self.pairs[key] = self.merges.fits(a, b)
        return known

    def move(self, subset: int, byte: int) -> int:
        """The subset after a byte and the run of tokens written."""
        states, between = [], None
        child, inner, token = self.child, self.inner, self.token
        for waiting, last, node in self.states(subset):
            after = child.get(node << 8 | byte)
            if after is None:
                continue
            if inner[after]:
                states.append((waiting, last, after))
            if between is None and (made := token[after]) >= 0 and (last < 0 or self.may_follow(last, made)):
                between = ((*waiting, made), made, 0)
        states.append(between)
        written = between[0]
        for waiting, _, _ in states:
            while written and written != waiting[:len(written)]:
                written = written[:-1]
        agreed = len(written)
        numbers = [x for waiting, last, node in states for x in (len(waiting) - agreed, *waiting[agreed:], last, node)]
        key = pack(f"<{len(numbers)}i", *numbers)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.subsets)
            self.subsets.append(key)
            self.rest.append(self.run(between[0][agreed:]))
        result = self.moves[subset << 8 | byte] = number << RUN_BITS | self.run(written)
        return result

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        if piece in self.merges.unmade:
            return [self.merges.unmade[piece]]
        if len(self.moves) > self.most_moves:
            self.clear()
        subset, out, moves, runs = 0, [], self.moves, self.runs
        for byte in piece:
            found = moves.get(subset << 8 | byte)
            if found is None:
                found = self.move(subset, byte)
            if found & RUN_MASK:
                out += runs[found & RUN_MASK]
            subset = found >> RUN_BITS
        out += runs[self.rest[subset]]
        return out


class Recent(dict):
    """A table of at most ``most`` results; when full, its older half goes."""

    def __init__(self, work: Callable[[str], bytes], most: int):
        super().__init__()
        self.work, self.half = work, most // 2
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= KEPT_CHARACTERS:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers; recurring parts and pre-tokens are encoded once."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.pretokens = regex.compile(pattern)
        alphabet = " " + string.ascii_letters
        self.letters = self.pretokens.findall(alphabet) == [alphabet]
        self.pieces = Recent(self.piece, PIECES)
        self.alone = Recent(self.part, PARTS // 8)
        self.spaced = Recent(lambda part: self.part(" " + part), PARTS)

    def piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        return pack(f"<{len(ids)}I", *ids)

    def part(self, part: str) -> bytes:
        # Letters behind a space are one pre-token of most patterns.
        if part[0] == " " and part.isascii() and part[1:].isalpha() and self.letters:
            return self.pieces[part]
        return b"".join(map(self.pieces.__getitem__, self.pretokens.findall(part)))

    def encode(self, text: str) -> bytes:
        alone, spaced = parts(text)
        return b"".join(map(self.alone.__getitem__, alone)) + b"".join(map(self.spaced.__getitem__, spaced))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(path, pattern)


class Utf8:
    """A state machine over bytes. States: 0 between characters; 1, 2, 3 that many continuation bytes to come; 4 to 7 two or three
    to come of which the first lies in a narrower range; 8 no UTF-8."""

    BAD = 8
    #: States by lead byte, as ranges; then the range of the next byte and the state after it.
    LEADS = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
             (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
    NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1),
            6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}

    def __init__(self):
        self.table = [[self.BAD] * 256 for _ in range(9)]
        for first, last, state in self.LEADS:
            self.table[0][first:last + 1] = [state] * (last - first + 1)
        for state, (first, last, after) in self.NEXT.items():
            self.table[state][first:last + 1] = [after] * (last - first + 1)

    def after(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.table[state][byte]
        return state

    def tail(self, data: bytes) -> int:
        """Bytes at the end of ``data`` that begin a character and do not end it."""
        for n in range(1, min(3, len(data)) + 1):
            if data[-n] >= 0xC0:
                return n if 0 < self.after(0, data[-n:]) < self.BAD else 0
            if data[-n] < 0x80:
                return 0
        return 0


class Utf8Stream:
    """Decodes ids block by block; what is handed on ends between characters."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.machine = tokens, Utf8()
        #: The state after each token, by state; the first is compiled, the others as they are needed.
        self.steps: list[dict[int, int]] = [dict() for _ in range(9)]
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of ``ids`` up to the end of their last whole character, after those held back before."""
        state, steps, tokens = self.state, self.steps, self.tokens
        ids = list(ids)
        for i in ids:
            after = steps[state].get(i)
            if after is None:
                if not 0 <= i < len(tokens):
                    raise ValueError(f"no token has the id {i}")
                # Behind bytes that are no UTF-8 a character may begin anew.
                after = steps[state][i] = self.machine.after(0 if state == Utf8.BAD else state, tokens[i])
            state = after
        data = self.held + b"".join(map(tokens.__getitem__, ids))
        n = 0 if state == 0 else self.machine.tail(data)
        self.held, self.state = (data[len(data) - n:], state) if n else (b"", 0)
        return data[:len(data) - n] if n else data

    def close(self) -> bytes:
        """What is still held back: a character that never ended."""
        data = self.held
        self.reset()
        return data

    def text(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text block by block; bytes that are no UTF-8 become U+FFFD."""
        for block in blocks:
            yield self.feed(block).decode("utf-8", "replace")
        yield self.close().decode("utf-8", "replace")


@cache
def stream(path: str) -> Utf8Stream:
    """One per worker process."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Utf8Stream(tokens)


Batches = Iterator[pa.RecordBatch]


def encoding(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """The work of a task: batches of ids and texts to batches of ids, counts and token ids."""
    def run(batches: Batches) -> Batches:
        model = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [model.encode(text.as_py()) for text in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids"])
    return run


def decoding(path: str) -> Callable[[Batches], Batches]:
    """The work of a task: batches with token ids to these with the decoded bytes."""
    def run(batches: Batches) -> Batches:
        model = stream(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, texts = batch.slice(at, 256), []
                for value in some.column("ids"):
                    ids = np.frombuffer(value.as_py() or b"", "<u4")
                    model.reset()
                    blocks = [model.feed(ids[i:i + BLOCK].tolist()) for i in range(0, len(ids), BLOCK)]
                    texts.append(b"".join([*blocks, model.close()]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.binary())], names=[*some.schema.names, "decoded"])
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its number of tokens and their ids, as little-endian unsigned 32-bit integers."""
    rows, schema = _texts(docs, id_col, text_col)
    return rows.mapInArrow(encoding(path, pattern), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes its ids stand for, as ``decoded``. Null ids count as none."""
    rows = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(decoding(path), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass, by one worker a core: the ids need not leave it in between."""
    rows, schema = _texts(docs, id_col, text_col)
    there, back = encoding(path, pattern), decoding(path)
    return rows.mapInArrow(lambda batches: back(there(batches)), f"{schema}, decoded binary")
