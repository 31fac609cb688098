"""A page's tags as a tree, and CSS selectors on it: tags, classes, ids, attributes, descendants, children and lists of these."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

#: tags without an end (fixed values)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    inside: list[Node | str] = field(default_factory=list)

    def nodes(self) -> Iterator[Node]:
        """All tags below, in the order of the page; no recursion, so that depth is no matter."""
        todo = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def text(self) -> str:
        """Pieces of text below, without outer spaces, joined by one."""
        found, todo = [], list(reversed(self.inside))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo += reversed(x.inside)
            elif x.strip():
                found.append(x.strip())
        return " ".join(found)

    def select(self, selector: str) -> list[Node]:
        """Tags below that a selector fits, in the order of the page."""
        chains = _parsed(selector)
        return [n for n in self.nodes() if any(_fits_chain(n, chain) for chain in chains)]

    def first(self, selector: str | None) -> Node | None:
        if not selector:
            return None
        chains = _parsed(selector)
        return next((n for n in self.nodes() if any(_fits_chain(n, chain) for chain in chains)), None)


class _Builder(HTMLParser):
    """An end closes the nearest open tag of its name and what is open in it; one without a start is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.inside.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_PART = re.compile(r"""\s*(?P<step>[>,])\s*|(?P<space>\s+)|(?P<tag>[\w-]+|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]""")


@lru_cache(256)
def _parsed(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Lists of (how it hangs on the one before: "", " " or ">"; tests); what isn't understood raises ``ValueError``."""
    chains: list[list[tuple[str, list[tuple]]]] = [[("", [])]]
    text, at = selector.strip(), 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"selector {selector!r} at {at}")
        at = m.end()
        if m["step"] == ",":
            chains.append([("", [])])
        elif m["step"] or m["space"]:
            chains[-1].append((m["step"] or " ", []))
        else:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
            test = ("tag", m["tag"].lower()) if m["tag"] else ("class", m["cls"]) if m["cls"] else ("id", m["id"]) if m["id"] else ("attr", m["attr"].lower(), m["op"], value)
            chains[-1][-1][1].append(test)
    if any(not tests for chain in chains for _, tests in chain):
        raise ValueError(f"selector {selector!r} has an empty part")
    return chains


def _fits(node: Node, tests: list[tuple]) -> bool:
    for kind, name, *rest in tests:
        if kind == "tag":
            ok = name in ("*", node.tag)
        elif kind == "class":
            ok = name in node.attrs.get("class", "").split()
        elif kind == "id":
            ok = node.attrs.get("id") == name
        else:
            (op, want), have = rest, node.attrs.get(name)
            ok = have is not None and (
                op is None or (op == "=" and have == want) or (op == "~=" and want in have.split()) or (op == "|=" and (have == want or have.startswith(want + "-")))
                or bool(want) and ((op == "^=" and have.startswith(want)) or (op == "$=" and have.endswith(want)) or (op == "*=" and want in have))
            )
        if not ok:
            return False
    return True


def _fits_chain(node: Node, chain: list[tuple[str, list[tuple]]]) -> bool:
    """From the last part to the first; a descendant step tries every tag above."""
    how, tests = chain[-1]
    if not _fits(node, tests):
        return False
    if len(chain) == 1:
        return True
    above = node.parent
    while above is not None and above.parent is not None:
        if _fits_chain(above, chain[:-1]):
            return True
        if how == ">":
            return False
        above = above.parent
    return False
