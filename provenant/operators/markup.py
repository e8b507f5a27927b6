"""One page's nested markup as node rows, for layouts that regular expressions cannot nest."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head", "iframe", "object", "svg"}
# Class names that hold titles, bodies, numbers and texts.
TITLES = {"sec_head", "sec-title", "section_title", "chapter_title"}
BODIES = {"sec_content", "sec-body", "section_body", "secBody"}
TITLE_TAGS = {"h2", "h3", "h4"}


class _Walker(HTMLParser):
    """Open elements on a stack; text goes to the innermost node, split into its parts."""

    def __init__(self, mode: str):
        super().__init__(convert_charrefs=True)
        self.mode, self.nodes, self.stack, self.hidden = mode, [], [], 0

    def _kind(self, tag: str, classes: list[str]) -> str | None:
        joined = " ".join(classes).lower()
        if self.mode == "table":
            return _kind_of(joined) if tag == "table" and classes else None
        if any(c in ("sub_section", "subsection", "clause") for c in classes) or "sub_" in joined:
            roles = ("num", "text")
            if any(r in joined for r in roles) and any(n["sub"] for _, n, _ in self.stack if n):
                return None
            return "clause" if "clause" in joined else "subsection"
        if any(c in TITLES | BODIES for c in classes):
            return None
        if any(c in ("section", "chapter", "part") for c in classes) or any(
                mark in joined for mark in ("sec_", "section", "chapter")):
            return _kind_of(joined)
        return None

    def _role(self, tag: str, classes: list[str], node: dict) -> str | None:
        joined = " ".join(classes).lower()
        if node["sub"]:
            return "num" if "num" in joined else "body" if "text" in joined else None
        if self.mode == "table":
            return "title" if "sec_head" in classes or tag == "th" else None
        if any(c in TITLES for c in classes) or tag in TITLE_TAGS:
            return "title"
        return "body" if any(c in BODIES for c in classes) else None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in VOID:
            self._text(" ")
            return
        if tag in HIDDEN:
            self.hidden += 1
        classes = (attrs.get("class") or "").split()
        outer = next((node for _, node, _ in reversed(self.stack) if node), None)
        kind = self._kind(tag, classes)
        node = role = None
        if kind:
            node = {"kind": kind, "sub": self.mode != "table" and kind in ("subsection", "clause"),
                    "ordinal": len(self.nodes), "parent": outer and outer["ordinal"],
                    "num": [], "title": [], "body": [], "rest": [], "links": []}
            self.nodes.append(node)
        elif outer:
            role = self._role(tag, classes, outer)
            # The first title counts; later headings are body text.
            if role == "title" and outer["title"]:
                role = None
        if tag == "a" and attrs.get("href") and outer:
            outer["links"].append(attrs["href"])
        self.stack.append((tag, node, role))
        self._text(" ")

    def handle_endtag(self, tag):
        if tag in VOID or all(open_tag != tag for open_tag, _, _ in self.stack):
            return
        self._text(" ")
        while self.stack:
            closed = self.stack.pop()[0]
            self.hidden -= closed in HIDDEN
            if closed == tag:
                return

    def handle_data(self, data):
        if not self.hidden:
            self._text(data)

    def _text(self, data):
        role = None
        for _, node, inner in reversed(self.stack):
            role = role or inner
            if node:
                node[role or "rest"].append(data)
                return


def _kind_of(label: str) -> str:
    for mark, kind in (("part", "part"), ("chap", "chapter"), ("sub", "subsection"),
                       ("clause", "clause")):
        if mark in label:
            return kind
    return "section"


def element_rows(html: str | None, url: str, mode: str) -> Iterator[tuple]:
    """(ordinal, parent, kind, number, title, text, url, links, warning) per node.

    Markup that cannot be walked gives a warning row instead of failing the task.
    """
    try:
        walker = _Walker(mode)
        walker.feed(html or "")
        walker.close()
        nodes = walker.nodes
        for n in nodes:
            own = "".join(n["body"])
            n["text"] = own if own.strip() else "".join(n["rest"])
        with_children = {n["parent"] for n in nodes if n["sub"] and n["text"].strip()}
        rows = []
        for n in nodes:
            text, number = n["text"], None
            if n["sub"]:
                if not text.strip():
                    continue
                number = " ".join("".join(n["num"]).split()).strip("()") or "?"
            elif n["ordinal"] in with_children:
                text = ""
            links = "".join(f'<a href="{link}">' for link in n["links"])
            rows.append((n["ordinal"], n["parent"], n["kind"], number, "".join(n["title"]) or None,
                         text, url, links, None))
    except Exception as error:  # a bad page must not stop the others
        rows = [(0, None, None, None, None, "", url, (html or "")[:200], f"unexpected error: {error}")]
    yield from rows
