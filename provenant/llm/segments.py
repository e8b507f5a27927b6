"""Splitting a text where a byte-level tokenizer never merges, so that each part is worked out once.

No pre-token spans the place between a character and the white space behind it. A text is therefore cut before each run
of white space. Nearly all texts have single spaces only; there ``str.split`` does the cutting, and each part but
the first stands for itself with a space in front.
"""

from __future__ import annotations

import re

#: White space as Unicode defines it, which is what the tokenizer's pattern means by \\s.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_WHITE}]{{2}}")
_PART = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def parts(text: str) -> tuple[list[str], list[str]]:
    """Parts as they are, and parts that have a space in front of what is given here. In order, one list after the other."""
    if not text:
        return [], []
    if _RUN.search(text):
        return _PART.findall(text), []
    spaced = text.split(" ")
    first = spaced.pop(0)
    return ([first] if first else []), spaced
