"""Elements of an HTML page by selectors: tags, #id, .class, [attribute] with =, *=,
^= and $=, descendants (a blank), children (>) and alternatives (a comma)."""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CLOSED_BY_NEXT = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
_PART = re.compile(r"""\s*(>)\s*|\s*(,)\s*|(\s+)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)["']?([^"'\]]*)["']?)?\]|([\w-]+|\*)""")


class Tree(HTMLParser):
    """tags, attributes and parents of all elements in the order of the page, and
    its text pieces with the elements that they stand in. Unclosed elements end with
    those around them; what was never opened is passed over. references: the names of
    the character references that are read (&name;), all others stay as they are
    written; None reads every one that HTML knows."""

    def __init__(self, page: str, references: tuple[str, ...] | None = None):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[int] = []
        self.feed(page if references is None else re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)" if references else "&", "&amp;", page))
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        above = self.tags[self.open[-1]] if self.open else ""
        if above == tag and tag in _CLOSED_BY_NEXT or above == "p" and tag in _ENDS_PARAGRAPH:
            self.open.pop()
        self.tags.append(tag)
        self.attributes.append({k: v or "" for k, v in reversed(attrs)})
        self.parents.append(self.open[-1] if self.open else -1)
        if tag not in _VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.tags[self.open[i]] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.open and data.strip() and self.tags[self.open[-1]] not in ("script", "style"):
            self.pieces.append((self.open[-1], data.strip()))

    def inside(self, element: int, root: int) -> bool:
        while element > root:
            element = self.parents[element]
        return element == root

    def text(self, element: int) -> str:
        """All text of an element, pieces trimmed and put together."""
        return "".join(piece for at, piece in self.pieces if at >= element and self.inside(at, element))

    def select(self, selector: str, root: int = -1) -> list[int]:
        """The elements inside root (all: -1) that a selector names, in order."""
        chains = parsed(selector)
        return [i for i in range(root + 1, len(self.tags)) if (root < 0 or self.inside(i, root)) and any(self._named(i, chain) for chain in chains)]

    def _named(self, element: int, chain: list[tuple[str, dict]]) -> bool:
        how, test = chain[-1]
        if not self._is(element, test):
            return False
        if len(chain) == 1:
            return True
        above = self.parents[element]
        while above >= 0:
            if self._named(above, chain[:-1]):
                return True
            if how == ">":
                return False
            above = self.parents[above]
        return False

    def _is(self, element: int, test: dict) -> bool:
        own = self.attributes[element]
        return (
            test["tag"] in ("*", self.tags[element]) and all(own.get("id") == x for x in test["ids"]) and set(test["classes"]) <= set(own.get("class", "").split())
            and all(_holds(own.get(name), how, value) for name, how, value in test["attributes"])
        )


def _holds(own: str | None, how: str, value: str) -> bool:
    if own is None or not how:
        return own is not None
    return own == value if how == "=" else bool(value) and (value in own if how == "*=" else own.startswith(value) if how == "^=" else own.endswith(value))


@functools.lru_cache(maxsize=1024)
def parsed(selector: str) -> list[list[tuple[str, dict]]]:
    """Alternatives, each a chain of (how it stands in the one before, test)."""
    chains, how = [[]], " "

    def last() -> dict:
        if not chains[-1] or how_open[0]:
            chains[-1].append((how, {"tag": "*", "ids": [], "classes": [], "attributes": []}))
            how_open[0] = False
        return chains[-1][-1][1]

    how_open, at, text = [True], 0, selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            raise ValueError(f"no selector: {selector!r}")
        child, comma, blank, id_, kind, name, test, value, tag = m.groups()
        if child or blank:
            how, how_open[0] = child or " ", True
        elif comma:
            chains.append([])
            how, how_open[0] = " ", True
        elif tag:
            last()["tag"] = tag.lower()
        elif id_:
            last()["ids"].append(id_)
        elif kind:
            last()["classes"].append(kind)
        else:
            last()["attributes"].append((name.lower(), test or "", value or ""))
        at = m.end()
    if not all(chains):
        raise ValueError(f"no selector: {selector!r}")
    return chains
