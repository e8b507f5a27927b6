"""Learned decision lists over text statistics: quality rules that a reader can check.

Sequential covering: a rule is a conjunction of thresholds, grown condition by condition for the largest information
gain on two thirds of the labelled rows, pruned on the other third, and kept if it stays precise there. The
rows it covers are set aside and the next rule is grown from the rest. The list becomes one conditional
expression, evaluated in order. All counting is aggregation over a table of labelled statistics; only counts per
(feature, bin), whose number the parameters fix, reach the driver.

Cases: labels that are null, and labelled ids without a document, teach nothing; several labels of a document are
averaged and a tie counts as good. Without labels of both kinds the list is empty and keeps everything that passes the
base rules. A null or empty text fails the base rules. Rows that repeat a doc_id are judged separately. Statistics are
computed over whole texts and only named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from provenant.llm.stats import with_stats
from provenant.plans.session import stored

#: Name of each feature and how it follows from the statistics.
FEATURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "stutter_share": "n_stutters / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "n_words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        holds = F.lit(True)
        for condition in self.conditions:
            holds = holds & condition.column()
        return holds

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class Settings:
    #: Labelled rows to learn from, at most about so many, drawn by a hash of the id.
    sample_rows: int = 50_000
    #: Candidate thresholds per feature.
    bins: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    #: Share of bad rows among those a rule covers, on the growing and on the pruning part.
    precision: float = 0.9
    #: Rows that a rule must cover on the growing part.
    min_cover: int = 3


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.expr(rule).cast("double") for name, rule in FEATURES.items() if name != "n_words"})


def labelled(stats: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Features, bad (0/1) and part (grow or prune) of a bounded sample of the labelled rows."""
    votes = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.when(F.avg("quality") >= 0.5, 0).otherwise(1).alias("bad")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = settings.sample_rows / max(1, votes.count())
    rows = with_features(stats).join(votes.filter(draw < share), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) < 2
    return stored(rows.filter(~F.col("base_failed")).select(*[F.col(f).cast("double").alias(f) for f in FEATURES], "bad",
                                                            part.alias("grow")))


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    # Quantiles of each kind of row alone, since the bad ones are few.
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, points, 1000).alias(f) for f in FEATURES]).collect()
    values = {f: sorted({value for row in found for value in row[f]}) for f in FEATURES}
    # Midway between neighbours, so that a rule keeps its distance from the values it was learned on.
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, list[tuple[float, float, float]]]:
    """Per feature its thresholds with the bad and good rows at or below each."""
    thresholds = {f: ts for f, ts in thresholds.items() if ts}
    bins = [F.struct(F.lit(f).alias("feature"), F.expr(
        f"size(filter(array({','.join(f'{t!r}D' for t in ts)}), t -> t < {f}))").alias("bin")) for f, ts in thresholds.items()]
    got = (rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.feature", "x.bin")
           .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect())
    out = {}
    for f, ts in thresholds.items():
        per = {r["bin"]: (r["bad"], r["good"]) for r in got if r["feature"] == f}
        p = n = 0
        out[f] = []
        for i, t in enumerate(ts):
            p, n = p + per.get(i, (0, 0))[0], n + per.get(i, (0, 0))[1]
            out[f].append((t, p, n))
        last = per.get(len(ts), (0, 0))
        out[f].append((float("inf"), p + last[0], n + last[1]))
    return out


def _gain(p: float, n: float, total_p: float, total_n: float) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((total_p + 1e-9) / (total_p + total_n + 1e-9)))


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], settings: Settings) -> Rule | None:
    conditions: list[Condition] = []
    while len(conditions) < settings.max_conditions:
        covered = rows.filter(Rule(tuple(conditions)).column())
        best: tuple[float, Condition, float, float] | None = None
        for feature, steps in sorted(_counts(covered, thresholds).items()):
            total_p, total_n = steps[-1][1:]
            for t, p, n in steps[:-1]:
                for above, (bad, good) in ((False, (p, n)), (True, (total_p - p, total_n - n))):
                    if bad >= settings.min_cover and bad + good < total_p + total_n:
                        gain = _gain(bad, good, total_p, total_n)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, Condition(feature, above, t), bad, good)
        if best is None:
            break
        conditions.append(best[1])
        if best[3] == 0:
            break
    return Rule(tuple(conditions)) if conditions else None


def _tally(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    sums = []
    for i, rule in enumerate(rules):
        sums += [F.sum(F.when(rule.column(), F.col("bad"))).alias(f"p{i}"), F.sum(F.when(rule.column(), 1 - F.col("bad"))).alias(f"n{i}")]
    got = rows.agg(*sums).first()
    return [(got[f"p{i}"] or 0, got[f"n{i}"] or 0) for i in range(len(rules))]


def learn(rows: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """The ordered rules for bad rows; ``rows`` as from :func:`labelled`."""
    kinds = {r["bad"] for r in rows.select("bad").distinct().collect()}
    if kinds != {0, 1}:
        return []
    thresholds = _thresholds(rows, settings.bins)
    if not any(thresholds.values()):
        return []
    rest, rules = rows, []
    while len(rules) < settings.max_rules:
        grown = _grow(rest.filter("grow"), thresholds, settings)
        if grown is None:
            break
        forms = [Rule(grown.conditions[:k]) for k in range(1, len(grown.conditions) + 1)]
        on_prune = _tally(rest.filter(~F.col("grow")), forms)
        on_grow = _tally(rest.filter("grow"), forms)
        # A form without rows in the pruning part is judged by the growing part alone.
        fit = [(p - n) / (p + n) if p + n else -1.0 for p, n in on_prune]
        if max(fit) <= -1.0:
            fit = [(p - n) / (p + n) if p + n else -1.0 for p, n in on_grow]
        k = max(range(len(forms)), key=lambda i: (fit[i], -i))
        p, n = on_prune[k][0] + on_grow[k][0], on_prune[k][1] + on_grow[k][1]
        if p < settings.precision * (p + n) or on_prune[k][0] < settings.precision * sum(on_prune[k]):
            break
        rules.append(forms[k])
        rest = rest.filter(~forms[k].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, or null."""
    chain: Column | None = None
    for i, rule in enumerate(rules, 1):
        chain = F.when(rule.column(), i) if chain is None else chain.when(rule.column(), i)
    return F.lit(None).cast("int") if chain is None else chain.cast("int")


def base_rules() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """Per document its statistics, whether the base rules fail it, the rule that rejects it, and kept; and the rules."""
    stats = stored(with_stats(docs, id_col, text_col).withColumn("base_failed", base_rules()))
    rules = learn(labelled(stats, labels, settings), settings)
    fired = F.when(~F.col("base_failed"), verdict(rules))
    judged = with_features(stats).withColumn("rule", fired).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged, rules
