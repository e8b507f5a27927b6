"""Pattern-driven decisions about questions and answers, as columns.

Every function takes its patterns as data, so another language or vocabulary needs no code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from provenant.functions import patterns as P
from provenant.functions.regex import matches, rstrip, strip, unicode_pattern
from provenant.settings import Settings


def _first(branches: list[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    chain = None
    for condition, value in branches:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(default) if chain is None else chain.otherwise(default)


def classify_intent(question: Column, intents: Sequence[tuple] = P.INTENTS,
                    default: str = P.DEFAULT_INTENT) -> Column:
    return _first([(matches(question, en, True) | matches(question, bn), name)
                   for name, en, bn in intents], default)


def prompt_family(intent: Column, active_version: str) -> Column:
    """struct(family, version)."""
    def pair(family: str, version: str) -> Column:
        return F.struct(F.lit(family).alias("family"), F.lit(version).alias("version"))
    return _first([(intent == name, pair(family, version))
                   for name, family, version in P.PROMPT_FAMILIES],
                  pair(P.DEFAULT_PROMPT_FAMILY, active_version))


def decline_reason(question: Column, top_score: Column, intent: Column | None,
                   settings: Settings, english: Sequence[str] = P.ADVICE_EN,
                   bengali: Sequence[str] = P.ADVICE_BN) -> Column:
    """Why a question is not answered, or null: too little found, or advice is asked for."""
    score = F.coalesce(top_score, F.lit(0.0))
    low = F.concat(F.lit("recall_floor: top score "), F.format_string("%.3f", score),
                   F.lit(f" < {settings.decline_recall_floor}"))
    branches = [(score < settings.decline_recall_floor, low)]
    branches += [(matches(question, p, True), f"advice_seeking_en: matched {p!r}") for p in english]
    branches += [(matches(question, p), f"advice_seeking_bn: matched {p!r}") for p in bengali]
    reason = _first(branches, None)
    gate = F.lit(settings.decline_gate_enabled)
    if intent is not None:
        gate = gate & ~intent.isin(P.UNGATED_INTENTS)
    return F.when(gate, reason)


def guardrail(text: Column, english: Sequence[tuple[str, str]] = P.NORMATIVE_EN,
              bengali: Sequence[tuple[str, str]] = P.NORMATIVE_BN) -> Column:
    """Label of the first normative phrase, or null."""
    return _first([(matches(text, p, True), label) for label, p in english]
                  + [(matches(text, p), label) for label, p in bengali], None)


def strip_filler(text: Column, english: Sequence[str] = P.FILLER_EN,
                 bengali: Sequence[str] = P.FILLER_BN) -> Column:
    """Drop any run of openers from the front of an answer."""
    openers = [rf"(?iu:{unicode_pattern(p)})" for p in english]
    openers += [unicode_pattern(p) for p in bengali]
    space = unicode_pattern(r"\s*")
    return F.regexp_replace(text, rf"^{space}(?:(?:{'|'.join(openers)}){space})*", "")


def to_bengali_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", P.BENGALI_DIGITS)


def section_reference(path: Column) -> Column:
    """Last part of a hierarchy path without its leading kind word."""
    last = F.element_at(F.split(path, " > ", -1), -1)
    return strip(F.regexp_replace(last, unicode_pattern(P.REFERENCE_PREFIX, True), ""))


def section_of(path: Column, pattern: str = P.SECTION_DIGITS) -> Column:
    """Section number of the deepest part of a path that names one."""
    spelled = unicode_pattern(pattern, True)
    named = F.filter(F.split(path, " > ", -1), lambda part: part.rlike(spelled))
    return F.when(F.size(named) > 0, F.regexp_extract(F.element_at(named, -1), spelled, 1))


def first_section(path: Column) -> Column:
    """First word that follows "Section" anywhere in a path, as sampling reads it."""
    return F.nullif(F.regexp_extract(path, unicode_pattern(P.SECTION_WORD, True), 1), F.lit(""))


def format_citation(context: Column, language: Column) -> Column:
    """context: struct(act_name_en, act_name_bn, act_year, section_ref, source_url)."""
    year = context["act_year"].cast("string")
    year_bn, ref_bn = to_bengali_digits(year), to_bengali_digits(context["section_ref"])
    en, bn = context["act_name_en"], context["act_name_bn"]
    in_english = F.concat(
        F.lit("Section "), context["section_ref"], F.lit(" of "), en,
        F.when(rstrip(en).endswith(year), "").otherwise(F.concat(F.lit(", "), year)))
    in_bengali = F.concat(
        bn, F.when(bn.contains(year) | bn.contains(year_bn), "").otherwise(
            F.concat(F.lit(", "), year_bn)), F.lit("-এর ধারা "), ref_bn)
    text = F.when(language == "bn", in_bengali).otherwise(in_english)
    url = F.coalesce(context["source_url"], F.lit(""))
    return F.when(url == "", text).otherwise(F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")")))


def resolve_placeholders(text: Column, citations: Column) -> Column:
    """Replace {{cite:id}} and {cite:id} by citations[id]; unknown ids disappear."""
    marks = F.regexp_extract_all(text, F.lit(P.PLACEHOLDER), F.lit(0))
    gaps = F.split(text, P.PLACEHOLDER, -1)
    def rendered(mark: Column) -> Column:
        name = F.regexp_replace(mark, r"^\{\{?cite:|\}\}?$", "")
        return F.coalesce(F.try_element_at(citations, name), F.lit(""))
    return F.array_join(
        F.zip_with(gaps, F.transform(marks, rendered),
                   lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit("")))), "")


def append_disclaimer(text: Column, disclaimer: Column) -> Column:
    return F.concat(text, F.lit("\n\n"), disclaimer)


def refresh_disclaimer(text: Column, disclaimer: Column) -> Column:
    """Replace the last paragraph of a cached answer unless it is the active disclaimer."""
    body = F.regexp_replace(text, r"(?s)^(.*)\n\n.*$", "$1")
    return F.when(text.endswith(disclaimer), text).otherwise(append_disclaimer(body, disclaimer))


def split_disclaimer(text: Column, marker: str = P.DISCLAIMER_MARKER) -> Column:
    """struct(body, disclaimer), cut at the first marker."""
    at = F.regexp_instr(text, F.lit(marker))
    found = at > 0
    return F.struct(
        F.when(found, rstrip(F.substring(text, F.lit(1), at - 1))).otherwise(text).alias("body"),
        F.when(found, strip(F.substring(text, at, F.length(text)))).alias("disclaimer"))


def projected_cost(input_tokens: Column, settings: Settings) -> Column:
    return (input_tokens / 1000.0 * settings.cost_per_1k_input
            + F.lit(settings.max_output_tokens / 1000.0 * settings.cost_per_1k_output))


def over_ceiling(input_tokens: Column, settings: Settings) -> Column:
    """Reaching the ceiling already refuses."""
    return projected_cost(input_tokens, settings) >= settings.cost_ceiling


def age_bucket(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (F.when(minutes < 1, "just now").when(minutes < 60, label(minutes, "m"))
            .when(hours < 24, label(hours, "h")).when(days < 7, label(days, "d"))
            .otherwise(F.date_format(then, "yyyy-MM-dd")))


def preview(text: Column, width: int = 300, ellipsis: str = "...") -> Column:
    """Whitespace collapsed; longer texts end at a word and the ellipsis, within the width."""
    flat = strip(F.regexp_replace(text, unicode_pattern(r"\s+"), " "))
    room = width - len(ellipsis)
    head = F.substring(flat, 1, room + 1)
    cut = F.regexp_extract(head, r"^(.*\S) ", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(cut, F.lit(ellipsis)))


