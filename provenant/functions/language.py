"""Script-based language detection and routing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from provenant.functions.regex import SPACE, let

# The Bengali block and the two coverage thresholds.
BENGALI = (0x0980, 0x09FF)
MAJORITY = 0.70
MINORITY = 0.10


def detect_language(text: Column, script: tuple[int, int] = BENGALI, majority: float = MAJORITY,
                    minority: float = MINORITY, code: str = "bn", other: str = "en") -> Column:
    """struct(language, confidence) from the share of the script among visible characters."""
    low, high = script
    # Runs, not single characters: a match costs far more than a character.
    total = F.length(F.regexp_replace(text, f"{SPACE}+", ""))
    inside = F.length(F.regexp_replace(text, rf"[^\x{{{low:x}}}-\x{{{high:x}}}]+", ""))

    def judged(ratio: Column) -> Column:
        language = (F.when(ratio.isNull() | (ratio <= minority), other)
                    .when(ratio >= majority, code).otherwise("mixed"))
        confidence = (F.when(ratio.isNull(), 1.0).when(ratio >= majority, ratio)
                      .when(ratio <= minority, 1 - ratio).otherwise(F.greatest(ratio, 1 - ratio)))
        return F.struct(language.alias("language"), confidence.alias("confidence"))
    # Branches would each count the text again.
    return let(inside / F.nullif(total, F.lit(0)), judged)


def search_language(detected: Column) -> Column:
    return F.when(detected == "bn", "bn").otherwise("en")


def response_language(detected: Column) -> Column:
    return F.when(detected == "mixed", "en").otherwise(detected)


def selected_language(requested: Column, detected: Column) -> Column:
    return F.coalesce(requested, search_language(detected))


def translation_status(language: Column) -> Column:
    return F.when(language == "bn", "authoritative").otherwise("reference_translation")
