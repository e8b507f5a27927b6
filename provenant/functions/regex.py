r"""Patterns with Unicode meaning for \b, \s, \d and \w, whatever the JDK.

Java's shorthand classes are ASCII by default and its \b has changed between releases, so
patterns are spelled with explicit Unicode classes before Spark sees them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character Unicode calls white space, plus the four separators U+001C to U+001F.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
INLINE_SPACE = r"[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_SHORTHAND = {r"\b": _BOUNDARY, r"\s": SPACE, r"\d": r"\p{Nd}", r"\w": WORD}


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    spelled = re.sub(r"\\\\|\\[bsdw]", lambda m: _SHORTHAND.get(m.group(), m.group()), pattern)
    return ("(?iu)" if ignore_case else "") + spelled


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(text.rlike(unicode_pattern(pattern, ignore_case)), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim any Unicode whitespace (Spark's one-argument trim removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))
