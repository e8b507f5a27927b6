"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language, in the context of its neighbours, so that text that switches between languages is
read word by word. A word's features are its affixes of one to four letters, all its character bigrams and trigrams, its
membership in each language's lexicon of frequent words, and its shape; they are hashed into one table of weights, and
the weights of all features of a word are added up, however many it has. Transitions between the labels of neighbouring
words are learned with them. Training maximises the likelihood of spans of known language that are
spliced into switching sequences, by the forward-backward algorithm and adaptive gradient steps. A document's
language is the label with the largest sum of word posteriors, each weighted by the letters of its word; its score is
that label's share.

The model is fitted on a bounded sample of documents, and of windows drawn from anywhere in each; documents are scored in Arrow batches where they lie. Sequences
of a batch are walked together, longest first, one matrix step per word position.

Cases: a text that is null or has no letter is ``und`` with score 0; without training documents all are. Words without a
letter take the labels of their neighbours and have no weight. Documents with a null language teach nothing. Rows that repeat an id
are labelled separately; only named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from provenant.llm.base import SPACES

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
#: Entries of a worker's table of words.
TABLE = 500_000


@dataclass(frozen=True)
class Settings:
    #: Training documents per language, at most about so many, and words taken of each, in windows from all of its text.
    docs_per_language: int = 250
    words_per_doc: int = 400
    window: int = 40
    hash_bits: int = 16
    lexicon: int = 300
    epochs: int = 12
    rate: float = 0.25
    decay: float = 1e-5
    #: Words of a spliced span, and of a training sequence.
    span: tuple[int, int] = (3, 30)
    sequence: int = 60
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    hash_bits: int
    weights: np.ndarray  # hashed feature x language
    transitions: np.ndarray  # from x to
    starts: np.ndarray


class Places(dict):
    """Hashed place of a named feature; most names recur."""

    def __init__(self, hash_bits: int):
        self.size = (1 << hash_bits) - 1

    def __missing__(self, name: str) -> int:
        if len(self) > TABLE:
            self.clear()
        place = self[name] = 1 + zlib.crc32(name.encode()) % self.size
        return place


def letters_of(word: str) -> str:
    """A word's letters, small."""
    return word.lower() if word.isalpha() else "".join(_LETTERS.findall(word)).lower()


def features(letters: str, lexicon: dict[str, int], place: Places) -> list[int]:
    """Places of a word's features. ``lexicon`` gives a bit mask of the languages whose frequent words it is among."""
    if not letters:
        return [place["none"]]
    padded = f"^{letters}$"
    names = [f"w{letters}", f"l{lexicon.get(letters, 0)}", "a" if letters.isascii() else "u"]
    for k in range(1, min(4, len(letters)) + 1):
        names += (f"p{letters[:k]}", f"s{letters[-k:]}")
    for k in (2, 3):
        names += (padded[i:i + k] for i in range(len(padded) - k + 1))
    return list({place[n]: 0 for n in names})


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All places one after the other, and how many each word has."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


def _added(weights: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each word's weights; every word has a feature."""
    return np.add.reduceat(weights[flat], np.cumsum(lengths) - lengths, axis=0)


class Words:
    """Emission scores of words, filled as words are met; words of equal letters share a row."""

    def __init__(self, model: Model):
        outer = self
        self.model = model
        self.rows: list[np.ndarray] = []
        self.letters: list[int] = []
        self.new: list[list[int]] = []
        self.place = Places(model.hash_bits)

        class Cores(dict):
            def __missing__(self, core: str) -> int:
                i = self[core] = len(outer.letters)
                outer.letters.append(len(core))
                outer.new.append(features(core, model.lexicon, outer.place))
                return i

        cores = Cores()

        class Table(dict):
            def __missing__(self, word: str) -> int:
                i = self[word] = cores[letters_of(word)]
                return i

        self.table = Table()
        self.scores = np.zeros((0, len(model.languages)))

    def emissions(self) -> np.ndarray:
        """Scores of all words met so far."""
        if self.new:
            self.scores = np.concatenate((self.scores, _added(self.model.weights, *_flat(self.new))))
            self.new = []
        return self.scores

    def trim(self) -> None:
        if len(self.table) > TABLE:
            self.__init__(self.model)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows as (position, sequence), longest first, and how many sequences reach each position."""
    lengths = np.array([len(s) for s in sequences])
    grid = np.zeros((int(lengths.max()), len(sequences)), np.int64)
    for j, s in enumerate(sequences):
        grid[:len(s), j] = s
    active = (lengths[None, :] > np.arange(len(grid))[:, None]).sum(axis=1)
    return grid, active


def posteriors(emission: np.ndarray, active: np.ndarray, transitions: np.ndarray, starts: np.ndarray,
               pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward: label probabilities (position, sequence, label), and expected transitions if asked for.

    ``emission`` has scores; sequences are ordered longest first, so those that reach a position come first.
    """
    steps, n, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    t, s = np.exp(transitions), np.exp(starts - starts.max())
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[0] = s * e[0]
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for i in range(1, steps):
        k = active[i]
        a = (alpha[i - 1, :k] @ t) * e[i, :k]
        alpha[i, :k] = a / a.sum(axis=1, keepdims=True)
    for i in range(steps - 2, -1, -1):
        k = active[i + 1]
        b = (e[i + 1, :k] * beta[i + 1, :k]) @ t.T
        beta[i, :k] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    total = p.sum(axis=2, keepdims=True)
    p = np.divide(p, total, out=np.zeros_like(p), where=total > 0)
    if not pairs:
        return p, None
    expected = np.zeros((labels, labels))
    for i in range(1, steps):
        k = active[i]
        x = alpha[i - 1, :k, :, None] * t[None] * (e[i, :k] * beta[i, :k])[:, None, :]
        expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, expected


def _spliced(docs: list[tuple[int, np.ndarray]], settings: Settings, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences of words and labels: spans of documents in shuffled order, a third of them of one language."""
    spans: list[tuple[int, np.ndarray]] = []
    for label, words in docs:
        at = 0
        while at < len(words):
            n = int(rng.integers(*settings.span)) if rng.random() < 2 / 3 else settings.sequence
            spans.append((label, words[at:at + n]))
            at += n
    rng.shuffle(spans)
    out, words, labels = [], [], []
    for label, span in spans:
        words.append(span)
        labels.append(np.full(len(span), label))
        if sum(map(len, words)) >= settings.sequence or rng.random() < 0.2:
            out.append((np.concatenate(words), np.concatenate(labels)))
            words, labels = [], []
    if words:
        out.append((np.concatenate(words), np.concatenate(labels)))
    return out


def train(texts: list[tuple[str, str]], settings: Settings = Settings()) -> Model | None:
    """The model of (language, text) pairs, in a fixed order."""
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    index = {lang: i for i, lang in enumerate(languages)}
    split = [(index[lang], text.split()) for lang, text in texts]
    counts = [Counter() for _ in languages]
    for label, words in split:
        counts[label].update(map(letters_of, words))
    lexicon: dict[str, int] = {}
    for label, counter in enumerate(counts):
        frequent = sorted(((n, w) for w, n in counter.items() if w), key=lambda x: (-x[0], x[1]))[:settings.lexicon]
        for _, w in frequent:
            lexicon[w] = lexicon.get(w, 0) | 1 << label
    size, labels = 1 << settings.hash_bits, len(languages)
    model = Model(languages, lexicon, settings.hash_bits, np.zeros((size, labels)), np.zeros((labels, labels)), np.zeros(labels))
    if labels == 1:
        return model
    table: dict[str, int] = {}
    place = Places(settings.hash_bits)
    places: list[list[int]] = []
    docs = []
    for label, words in split:
        rows = []
        for w in words:
            if w not in table:
                table[w] = len(places)
                places.append(features(letters_of(w), lexicon, place))
            rows.append(table[w])
        if rows:
            docs.append((label, np.array(rows)))
    where = [np.array(x, np.int64) for x in places]
    rng = np.random.default_rng(settings.seed)
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.transitions, model.starts)]
    for _ in range(settings.epochs):
        sequences = _spliced(docs, settings, rng)
        for at in range(0, len(sequences), 256):
            batch = sorted(sequences[at:at + 256], key=lambda s: -len(s[0]))
            grid, active = _padded([w for w, _ in batch])
            truth, _ = _padded([y for _, y in batch])
            rows, inverse = np.unique(grid, return_inverse=True)
            flat, lengths = np.concatenate([where[r] for r in rows]), np.array([len(where[r]) for r in rows])
            emission = _added(model.weights, flat, lengths)[inverse.reshape(grid.shape)]
            p, expected = posteriors(emission, active, model.transitions, model.starts, pairs=True)
            live = np.arange(grid.shape[1])[None, :] < active[:, None]
            error = -p
            np.put_along_axis(error, truth[:, :, None], np.take_along_axis(error, truth[:, :, None], 2) + 1.0, 2)
            error[~live] = 0.0
            n = live.sum()
            by_word = np.stack([np.bincount(inverse.ravel(), error[:, :, k].ravel(), len(rows)) for k in range(labels)], axis=1)
            gradient = np.stack([np.bincount(flat, np.repeat(by_word[:, k], lengths), size) for k in range(labels)], axis=1) / n
            seen = np.zeros((labels, labels))
            both = live[1:]
            np.add.at(seen, (truth[:-1][both], truth[1:][both]), 1.0)
            begin = np.bincount(truth[0], minlength=labels) - p[0].sum(axis=0)
            for x, g, s in ((model.weights, gradient, squares[0]), (model.transitions, (seen - expected) / n, squares[1]), (model.starts, begin / n, squares[2])):
                g = g - settings.decay * x
                s += g * g
                x += settings.rate * g / np.sqrt(s)
    return model


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trains on documents of known language that are not held out, drawn per language by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "lang is not null and text is not null").filter(F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, settings.docs_per_language / n))])
    drawn = rows.filter(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), "doc_id", F.split(F.trim("text"), SPACES).alias("words"))
    windows = F.sequence(F.lit(0), F.ceil(F.size("words") / settings.window).cast("int") - 1)
    order = F.array_sort(F.transform(windows, lambda i: F.struct(F.xxhash64("doc_id", F.lit("window"), i).alias("h"), i.alias("i"))))
    some = F.array_sort(F.transform(F.slice(order, 1, max(1, settings.words_per_doc // settings.window)), lambda x: x["i"]))
    spans = F.flatten(F.transform(some, lambda i: F.slice("words", i * settings.window + 1, settings.window)))
    sample = drawn.select("lang", F.array_join(spans, " ").alias("text"), "draw", "doc_id").collect()
    sample.sort(key=lambda r: (r["draw"], str(r["doc_id"]), r["text"]))
    return train([(r["lang"], r["text"]) for r in sample], settings)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its predicted language and the score of it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model) if model else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = _predict(model, words, [t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()),
                                                  pa.array([y for _, y in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def _predict(model: Model | None, words: Words | None, texts: list[str]) -> list[tuple[str, float]]:
    out = [(UNKNOWN, 0.0)] * len(texts)
    if model is None:
        return out
    words.trim()
    look = words.table.__getitem__
    sequences = [np.fromiter(map(look, parts), np.int64, len(parts)) for parts in (t.split() for t in texts)]
    scores, letters = words.emissions(), np.array(words.letters, np.int64)
    order = sorted((j for j, s in enumerate(sequences) if len(s) and letters[s].sum()), key=lambda j: -len(sequences[j]))
    at = 0
    while at < len(order):
        # So many sequences at once that their padded grid stays small, however long the first is.
        take = max(1, min(len(order) - at, 400_000 // len(sequences[order[at]])))
        some = order[at:at + take]
        at += take
        grid, active = _padded([sequences[j] for j in some])
        p, _ = posteriors(scores[grid], active, model.transitions, model.starts)
        weight = letters[grid] * (np.arange(len(some))[None, :] < active[:, None])
        total = (p * weight[:, :, None]).sum(axis=0)
        best = total.argmax(axis=1)
        share = total[np.arange(len(some)), best] / weight.sum(axis=0)
        for j, b, s in zip(some, best, share):
            out[j] = (model.languages[b], float(min(1.0, s)))
    return out
