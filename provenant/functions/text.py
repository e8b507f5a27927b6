"""Markup, whitespace, headings and tokens."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from provenant.functions.regex import INLINE_SPACE, SPACE, let, strip, unicode_pattern

# Elements whose whole subtree is never shown, with and without a closing tag.
HIDDEN_ELEMENTS = ["script", "style", "noscript", "template", "head", "iframe", "object", "svg"]
HIDDEN_VOID_ELEMENTS = ["embed", "meta", "link"]

# Title selectors in order of preference, as attribute patterns.
TITLE_PATTERNS = [
    r'class\s*=\s*["\'][^"\']*(?<![\w-])act_title(?![\w-])',
    r'class\s*=\s*["\'][^"\']*(?<![\w-])act-title(?![\w-])',
    r'id\s*=\s*["\']act_title["\']',
    None,  # the first h1
    r'class\s*=\s*["\'][^"\']*(?<![\w-])lawTitle(?![\w-])',
]

# Leading number of a heading; length of the fallback identifier.
NUMBER_PATTERN = r"^(\d+[A-Z]?(?:\.\d+)?)[.\s]"
NUMBER_FALLBACK_CHARS = 20
UNKNOWN_NUMBER = "?"

# Links to a single provision, current and older form.
DETAIL_LINK = (r'(?i)<a\b[^>]*\bhref\s*=\s*["\']([^"\'?]*'
               r'(?:/act-\d+/(?:section|chapter|sub-section)-\d+\.html|act-details-\d+\.html))')
DETAIL_LEGACY = r"(?i)(act-details-\d+\.html)$"


def drop_hidden(html: Column) -> Column:
    paired = "|".join(HIDDEN_ELEMENTS)
    void = "|".join(HIDDEN_VOID_ELEMENTS)
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, rf"(?is)<({paired})\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(html, rf"(?i)</?(?:{void})\b[^>]*>", "")


def _code_point(number: Column) -> Column:
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    wide = F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")
    return F.decode(F.unhex(wide), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, in one pass so nothing is decoded twice."""
    named = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    pairs = "\x1e".join(f"{name}\x1f{value}" for name, value in sorted(named.items()))
    table = F.str_to_map(F.lit(pairs), F.lit("\x1e"), F.lit("\x1f"))
    reference = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def value(ref: Column) -> Column:
        return (F.when(ref.rlike("^#[xX]"), _code_point(F.conv(F.substring(ref, 3, 8), 16, 10).cast("bigint")))
                .when(ref.startswith("#"), _code_point(F.substring(ref, 2, 8).cast("bigint")))
                .otherwise(F.try_element_at(table, ref)))

    def piece(text: Column) -> Column:
        return let(F.regexp_extract(text, reference, 1), lambda ref: F.coalesce(
            F.concat(value(ref), F.substring(text, F.length(ref) + 2, F.length(text))),
            F.concat(F.lit("&"), text)))

    def whole(pieces: Column) -> Column:
        return F.concat(F.element_at(pieces, 1), F.array_join(
            F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))
    return let(F.split(text, "&", -1), lambda pieces: F.when(
        F.size(pieces) > 1, whole(pieces)).otherwise(F.element_at(pieces, 1)))


def clean_ws(text: Column) -> Column:
    """One space per run of blanks, trimmed lines, at most one empty line; Unicode untouched."""
    text = F.regexp_replace(text, r"\R|[\x1c-\x1e]", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, rf"{INLINE_SPACE}*\n{INLINE_SPACE}*", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip_tags(html: Column, separator: str = "\n") -> Column:
    return F.regexp_replace(html, r"<[^>]*>", separator)


def html_text(html: Column) -> Column:
    """Visible text, one text node per line."""
    return clean_ws(decode_entities(strip_tags(drop_hidden(html))))


def norm_title(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def page_title(html: Column) -> Column:
    """First title that is not empty, in the order of TITLE_PATTERNS."""
    def element(visible: Column, attribute: str | None) -> Column:
        head = r"<h1\b[^>]*>" if attribute is None else rf"<\w+\b[^>]*{attribute}[^>]*>"
        closing = r"</h1\s*>" if attribute is None else r"</(?:div|h[1-6]|p|td|span|a)\s*>"
        inner = F.regexp_extract(visible, rf"(?is){head}(.*?){closing}", 1)
        return F.nullif(norm_title(strip_tags(inner, "")), F.lit(""))
    found = let(drop_hidden(html), lambda visible: F.coalesce(*[element(visible, p) for p in TITLE_PATTERNS]))
    return norm_title(decode_entities(found))


def provision_kind(label: Column) -> Column:
    """First match wins, by substring: "department" is a part."""
    low = F.lower(label)
    return (F.when(low.contains("part"), "part")
            .when(low.contains("chap"), "chapter")
            .when(low.contains("sub"), "subsection")
            .when(low.contains("clause"), "clause")
            .otherwise("section"))


def provision_number(title: Column) -> Column:
    bare = strip(title)
    found = F.regexp_extract(bare, unicode_pattern(NUMBER_PATTERN), 1)
    return (F.when(title.isNull() | (title == ""), UNKNOWN_NUMBER)
            .when(found != "", found)
            .otherwise(F.substring(bare, 1, NUMBER_FALLBACK_CHARS)))


def detail_url(html: Column, page_url: Column, base: str) -> Column:
    """The link of the provision itself where the markup has one, else the page's address."""
    link = F.regexp_extract(html, DETAIL_LINK, 1)
    legacy = F.regexp_extract(link, DETAIL_LEGACY, 1)
    return (F.when(link == "", page_url)
            .when(legacy != "", F.concat(F.lit(base + "/"), legacy))
            .otherwise(F.concat(F.lit(base), link)))


def tokenize(text: Column) -> Column:
    """Lower-cased words in order; marks stay with their letters, nothing is stemmed."""
    words = F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", -1)
    return F.filter(words, lambda w: w != "")


def token_count(text: Column, floor: int = 1) -> Column:
    """Four characters to a token."""
    return token_count_of_length(F.length(text), floor)


def token_count_of_length(length: Column, floor: int = 1) -> Column:
    return F.greatest(F.lit(floor), F.floor(length / 4)).cast("int")
