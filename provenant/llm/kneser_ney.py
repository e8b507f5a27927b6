"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Words become tokens: frequent words of the trusted text stand for themselves, others for their shape (length, capitals,
digits, symbols), and a word in a run of equal words for its place there. No context foretells that a word repeats the
one before: such a token has only its probability as a unigram, so that a few trusted texts full of runs do not make runs
likely. The model has three orders and holds every other n-gram of the trusted text. Its counts, the counts of counts and the continuation counts are aggregations; discounted
probabilities and back-off weights come from joins of the count tables, hash-partitioned by context. Counts, continuation
counts and discounts cover all trusted documents but the third that is held out for the thresholds. The tables stay
distributed: documents' n-grams, added up per worker with the documents that have them, are joined with the trigrams, what
has no trigram with contexts and bigrams, and the logarithms are added up per text. They are added as whole multiples of
2**-24, so that a sum does not depend on its order. Only tables of one row per word of the vocabulary are collected. The
vocabulary has the most frequent words of each language.

A document is accepted if its perplexity is at most its language's threshold: a quantile over all trusted documents that
the model was not fitted on. A short document's mean is drawn towards the language's mean by ``prior`` tokens.

Cases: a null text counts as empty; a document without words has no perplexity and is rejected. A null or new
language, and one with few trusted documents, has the threshold of all. Without trusted text there is no model, and every
document with a word is accepted. Rows that repeat an id are judged separately; rows are told by a 64-bit hash of their
text, on which alone a perplexity depends. New columns replace equally named ones; all others are carried through.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provenant.plans.session import stored
from provenant.plans.skew import top_per_group

#: Bits of a token id in a key.
BITS = 20
_MASK = (1 << BITS) - 1
#: From REPEATED on: a word that equals the one, two, ... RUNS or more words before it.
BEGIN, REPEATED, RUNS = 0, 1, 4
FIRST_SHAPE = REPEATED + RUNS
SHAPES = [*(f"word{i}" for i in range(6)), "number", "capitals", "symbols", "mixed"]
FIRST_WORD = FIRST_SHAPE + len(SHAPES)
_PLAIN = re.compile(r"[(\"'«“¿¡]?([^\W\d_]+)[.,;:!?\"')»”…]?\Z")
#: Entries of a worker's table of words.
TABLE = 250_000
#: Counts that a worker holds before it adds them up and hands them on.
CHUNK = 1_000_000
#: Logarithms are added as whole multiples of 1 / UNIT.
UNIT = float(1 << 24)
#: A pair is in the model as a bigram and as a context, told by these bits of its key.
PAIR, CONTEXT = 1 << 61, 1 << 62


@dataclass(frozen=True)
class Settings:
    #: Share of the trusted documents that the model is fitted on; all others are for the thresholds.
    model_share: float = 2 / 3
    #: Words of each language that stand for themselves.
    vocabulary: int = 4000
    quantile: float = 0.995
    #: Thresholds are this factor above the quantile of the logarithm of perplexity.
    margin: float = 1.1
    prior: float = 12.0
    #: Trusted documents that a language needs for a threshold of its own.
    least: int = 50


@dataclass
class Model:
    words: dict[str, int]
    #: By token: probability, and weight of the token as a context.
    unigram_p: np.ndarray
    unigram_weight: np.ndarray
    #: (k, v) of all trigrams, (k, v) of all pairs and contexts, and (token, p, weight), as logarithms.
    triples: DataFrame
    pairs: DataFrame
    unigrams: DataFrame
    #: Documents that were counted, and those behind the thresholds.
    counted: int = 0
    held_out: int = 0
    mean: float = 0.0
    thresholds: dict[str | None, float] | None = None


def shape(word: str) -> tuple[int, str | None]:
    """Token of a word that is not in the vocabulary, and the form to look up there."""
    plain = _PLAIN.match(word)
    if plain:
        core = plain[1]
        if len(core) > 1 and core.isupper():
            return FIRST_SHAPE + 7, None
        bucket = (len(core) > 1) + (len(core) > 2) + (len(core) > 4) + (len(core) > 8) + (len(core) > 14)
        return FIRST_SHAPE + bucket, core.lower()
    if any(c in "#*$%&|<>{}[]=_~^\\" for c in word) or "!!" in word or not any(c.isalnum() for c in word):
        return FIRST_SHAPE + 8, None
    return FIRST_SHAPE + (6 if any(c.isdigit() for c in word) else 9), None


class Tokens:
    """Token ids of texts; one per worker and vocabulary."""

    def __init__(self, words: dict[str, int]):
        class Table(dict):
            def __missing__(self, word: str) -> int:
                token, core = shape(word)
                token = self[word] = words.get(core, token) if core else token
                return token

        self.table = Table()

    def ids(self, text: str) -> np.ndarray:
        if len(self.table) > TABLE:
            self.table.clear()
        words = text.split()
        ids = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        if len(words) > 1:
            same = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
            before = same
            for k in range(RUNS):
                ids[k + 1:][before] = REPEATED + k
                before = before[1:] & same[:-k - 1]
        return ids


def keys(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram keys of all documents one after the other, and where each document begins."""
    lengths = np.array([len(x) for x in ids], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 2)[:-1])) if len(ids) else lengths
    padded = np.full(int(lengths.sum() + 2 * len(ids)), BEGIN, np.int64)
    keep = np.ones(len(padded), bool)
    keep[begins] = keep[begins + 1] = False
    padded[keep] = np.concatenate(ids) if ids else []
    found = np.flatnonzero(keep)
    return (padded[found - 2] << 2 * BITS) | (padded[found - 1] << BITS) | padded[found], np.cumsum(lengths) - lengths


def _trusted(labels: DataFrame, settings: Settings) -> DataFrame:
    """Ids of all trusted documents, and whether the model is fitted on them, drawn by a hash of the id."""
    trusted = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 30)) / float(1 << 30)
    return trusted.select("doc_id", (draw < settings.model_share).alias("for_model"))


def _vocabulary(sample: DataFrame, settings: Settings) -> dict[str, int]:
    """Tokens of each language's most frequent words; if they exceed the ids, the least frequent of every language are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, Counter] = defaultdict(Counter)

        def cores() -> pa.RecordBatch:
            rows = [(lang, core, n) for lang, words in found.items() for word, n in words.items() if (core := shape(word)[1])]
            langs, names, n = zip(*rows) if rows else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["lang", "core", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found[lang].update(text.split())
            if sum(map(len, found.values())) > TABLE:
                yield cores()
        yield cores()

    counts = sample.mapInArrow(count, "lang string, core string, n bigint").groupBy("lang", "core").agg(F.sum("n").alias("n")).filter("n > 1")
    frequent = top_per_group(counts, ["lang"], [F.desc("n"), F.asc("core")], settings.vocabulary).groupBy("core").agg(
        F.min("rank").alias("rank"), F.sum("n").alias("n")).orderBy("rank", F.desc("n"), "core").limit(_MASK - FIRST_WORD).collect()
    return {r["core"]: FIRST_WORD + i for i, r in enumerate(frequent)}


def _counts(sample: DataFrame, words: dict[str, int]) -> DataFrame:
    """(k, n) of all trigrams; workers add counts up before they hand them on."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(words)
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

        size = 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(keys([tokens.ids(text.as_py())])[0])
                size += len(held[-1])
                if size >= CHUNK:
                    yield added()
                    size = 0
        yield added()

    return sample.select("text").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """The model of the trusted texts and its thresholds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    texts = stored(rows.join(_trusted(labels, settings), "doc_id").select("text", "lang", "for_model"))
    sample = texts.filter("for_model").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not sizes:
        return None
    words = _vocabulary(sample, settings)
    counts = stored(_counts(sample, words))
    if counts.isEmpty():
        return None
    model = _estimate(counts, words)
    model.counted = sum(sizes.values())
    _set_thresholds(model, texts.filter("not for_model").select("text", "lang"), settings)
    return model


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; never 0, so that unseen words keep a probability."""
    got = counts.agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [max(1, got[f"n{i}"] or 0) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i * 0.95) for i in (1, 2, 3)]


def _discounted(counts: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """Each n-gram's discounted share of its context, and the weight that its context leaves to the shorter one."""
    d = _discounts(counts)
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    totals = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("ones"),
                                         F.sum((F.col("n") == 2).cast("long")).alias("twos"), F.count(F.lit(1)).alias("all"))
    left = F.col("ones") * d[0] + F.col("twos") * d[1] + (F.col("all") - F.col("ones") - F.col("twos")) * d[2]
    totals = totals.select(context, "total", (left / F.col("total")).alias("weight"))
    return counts.join(totals, context).select("k", context, "weight", ((F.col("n") - cut) / F.col("total")).alias("share")), totals.select(context, "weight")


def _estimate(trigrams: DataFrame, words: dict[str, int]) -> Model:
    size = FIRST_WORD + len(words)
    spark = trigrams.sparkSession

    def last(kind: int) -> Column:
        return F.col("k").bitwiseAND(F.lit((1 << kind * BITS) - 1))

    def continued(longer: DataFrame, kind: int) -> DataFrame:
        """Of shorter n-grams, the number of words seen before them."""
        return stored(longer.groupBy(last(kind).alias("k")).agg(F.count(F.lit(1)).alias("n")))

    def by_token(rows: DataFrame, token: str, value: str, other: float) -> np.ndarray:
        # One row per token of the vocabulary at most.
        out = np.full(size, other)
        for t, v in rows.select(token, value).collect():
            out[t] = v
        return out

    def told_by_context(grams: DataFrame) -> DataFrame:
        return grams.filter(~last(1).between(REPEATED, REPEATED + RUNS - 1))

    bigrams = continued(trigrams, 2)
    unigrams = continued(bigrams, 1)
    trigrams, bigrams = told_by_context(trigrams), told_by_context(bigrams)
    share1, rest1 = _discounted(unigrams.withColumn("c", F.lit(0)), "c")
    floor = rest1.first()["weight"] / size
    unigram_p = by_token(share1.withColumn("p", F.col("share") + F.lit(floor)), "k", "p", floor)
    share2, rest2 = _discounted(bigrams.withColumn("c", F.shiftright("k", BITS)), "c")
    unigram_weight = by_token(rest2, "c", "weight", 1.0)
    tokens = stored(spark.createDataFrame(pa.table({"token": np.arange(size), "p": np.log(unigram_p), "weight": np.log(unigram_weight)})))
    second = stored(share2.join(tokens.select(F.col("token").alias("w"), F.exp("p").alias("lower")), last(1) == F.col("w"))
                    .select("k", (F.col("share") + F.col("weight") * F.col("lower")).alias("p")))
    share3, rest3 = _discounted(trigrams.withColumn("c", F.shiftright("k", BITS)), "c")
    third = share3.withColumn("w", last(2)).join(second.select(F.col("k").alias("w"), F.col("p").alias("lower")), "w").select(
        "k", (F.col("share") + F.col("weight") * F.col("lower")).alias("p"))

    def term(rows: DataFrame, bit: int, key: str, value: str) -> DataFrame:
        return rows.select(F.col(key).bitwiseOR(F.lit(bit)).alias("k"), F.log(value).alias("v"))

    triples = stored(term(third, 0, "k", "p"))
    pairs = stored(term(second, PAIR, "k", "p").union(term(rest3, CONTEXT, "c", "weight")))
    return Model(words, unigram_p, unigram_weight, triples, pairs, tokens)


def _grams(rows: DataFrame, words: dict[str, int]) -> DataFrame:
    """(k, h, n): how often the texts ``h`` have a trigram. A worker adds up the copies of a text that it meets at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(words)
        held: dict[int, list] = {}

        def added() -> Iterator[pa.RecordBatch]:
            if held:
                k = np.concatenate([x for x, _, _ in held.values()])
                h = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x) for x, _, _ in held.values()])
                n = np.concatenate([x * copies for _, x, copies in held.values()])
                held.clear()
                yield from pa.table({"k": k, "h": h, "n": n.astype(np.int64)}).to_batches(100_000)

        size = 0
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text")):
                if h in held:
                    held[h][2] += 1
                    continue
                held[h] = [*np.unique(keys([tokens.ids(text.as_py())])[0], return_counts=True), 1]
                size += len(held[h][0])
                if size >= CHUNK:
                    yield from added()
                    size = 0
        yield from added()

    return rows.select("h", "text").mapInArrow(run, "k bigint not null, h bigint not null, n bigint not null")


def _logarithms(model: Model, grams: DataFrame) -> DataFrame:
    """(h, n, x): tokens, and their logarithms of probability in units, to be added up by ``h``."""
    def units(value: Column) -> Column:
        return (F.col("n") * F.round(value * UNIT).cast("long")).alias("x")

    def token(column: Column) -> Column:
        return column.bitwiseAND(F.lit(_MASK))

    # Both branches read one exchange of the n-grams; they are many more than their texts' bytes tell, so never to be broadcast.
    triples = model.triples.hint("merge")
    found = grams.join(triples, "k").select("h", "n", units(F.col("v")))
    shorter = F.array(F.shiftright("k", BITS).bitwiseOR(F.lit(CONTEXT)), F.col("k").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).bitwiseOR(F.lit(PAIR)))
    missed = grams.join(triples, "k", "left_anti").select("h", "n", F.explode(shorter).alias("k")).join(model.pairs.hint("merge"), "k", "left")
    # A context that was not seen has weight 1, a pair that was not the last word's own probability.
    first = model.unigrams.select(F.col("token").alias("w"), F.col("p").alias("lower"))
    before = model.unigrams.select(F.col("token").alias("u"), F.col("weight").alias("left"))
    missed = missed.join(first, token(F.col("k")) == F.col("w"), "left").join(before, token(F.shiftright("k", BITS)) == F.col("u"), "left")
    context = F.col("k") >= CONTEXT
    value = F.coalesce("v", F.when(context, F.lit(0.0)).otherwise(F.col("lower") + F.col("left")))
    return found.union(missed.select("h", F.when(context, F.lit(0)).otherwise(F.col("n")), units(value)))


def log_probabilities(model: Model, found: np.ndarray) -> np.ndarray:
    """Natural logarithm of each trigram's interpolated probability."""
    spark = model.triples.sparkSession
    rows = spark.createDataFrame(pa.table({"h": np.arange(len(found)), "k": found}))
    got = _logarithms(model, rows.withColumn("n", F.lit(1))).groupBy("h").agg(F.sum("x").alias("x"))
    out = np.zeros(len(found))
    for h, x in got.collect():
        out[h] = x / UNIT
    return out


def _sums(rows: DataFrame, model: Model | None) -> DataFrame:
    """(h, n, total): tokens and logarithm of probability of each text; texts without words are left out."""
    grams = _grams(rows, model.words if model else {})
    if model is None:
        parts = grams.select("h", "n", F.lit(0).alias("x"))
    else:
        parts = _logarithms(model, grams)
    # Every copy of a text was counted.
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    sums = parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(copies, "h")
    return sums.select("h", F.expr("n div copies").alias("n"), (F.expr("x div copies") / UNIT).alias("total"))


def _judged(settings: Settings, mean: float) -> Column:
    return (F.lit(settings.prior * mean) - F.col("total")) / (F.col("n") + settings.prior)


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns, with n_tokens, perplexity, threshold and accepted."""
    new = ["n_tokens", "perplexity", "threshold", "accepted"]
    kept = [c for c in docs.columns if c not in new]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    text, lang = F.coalesce(F.col(names[kept.index(text_col)]), F.lit("")), F.col(names[kept.index(lang_col)])
    rows = rows.withColumn("h", F.xxhash64(text))
    judged = rows.join(_sums(rows.select("h", text.alias("text")), model).withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if model is None:
        return judged.select(*names, "n", F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("n") > 0).toDF(*kept, *new)
    limit = F.lit(model.thresholds[None])
    own = [F.lit(x) for pair in model.thresholds.items() if pair[0] is not None for x in pair]
    if own:
        limit = F.when(lang.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*own), lang), limit)).otherwise(limit)
    perplexity = F.when(F.col("n") > 0, F.exp(F.least(F.lit(700.0), -F.col("total") / F.col("n"))))
    accepted = (F.col("n") > 0) & (_judged(settings, model.mean) <= limit)
    return judged.select(*names, "n", perplexity, F.exp(limit), F.coalesce(accepted, F.lit(False))).toDF(*kept, *new)


def _set_thresholds(model: Model, texts: DataFrame, settings: Settings) -> None:
    """The quantiles of the mean surprise of all trusted documents that were held out."""
    rows = texts.withColumn("h", F.xxhash64("text"))
    rows = stored(rows.select("h", "lang").join(_sums(rows, model), "h").select("lang", "n", "total"))
    got = rows.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    model.held_out = got["rows"]
    model.mean = -(got["total"] or 0.0) / max(1, got["n"] or 0)
    cut = F.percentile_approx(_judged(settings, model.mean), F.lit(settings.quantile), F.lit(10_000)).alias("cut")
    overall = rows.agg(cut).first()["cut"]
    model.thresholds = {None: overall * settings.margin if overall is not None else math.inf}
    for r in rows.filter("lang is not null").groupBy("lang").agg(cut, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= settings.least).collect():
        model.thresholds[r["lang"]] = r["cut"] * settings.margin
