"""Fields of web pages: single ones by built-in functions, rows by the nesting of their elements."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INPUT, EngineError


def tag_text(html: Column | str, tag: str) -> Column:
    """The text of the first element of a tag, without inner tags; null if there is none."""
    c = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, "<[^>]*>", "")))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per href of a page, in order."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("position", "href"))


@dataclass(eq=False)
class Node:
    """An element of a page with what it holds: texts and elements in order."""

    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    inside: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        """Its text without tags, scripts and styles."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style") or x is self:
                todo += reversed(x.inside)
        return "".join(out).strip()

    def below(self) -> Iterator[Node]:
        """The elements within it, in the order of the page."""
        todo = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo += (y for y in reversed(x.inside) if isinstance(y, Node))


#: Elements without an end tag, and those that a sibling of a kind ends (HTML, chapter 13).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
#: What such a sibling can't end from within.
WALLS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ("div", "td", "li", "body")}


class _Tree(HTMLParser):
    """A page as nested elements, by a stack of open ones. An end tag closes the nearest open element of its name and all within; one without such an element is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {})

    def handle_starttag(self, tag, attrs):
        at = self.open
        while at.tag and at.tag not in WALLS.get(tag, ()):
            if at.tag in CLOSES.get(tag, ()):
                self.open = at.parent
                if tag != "tr" or at.tag == "tr":
                    break
            at = at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open)
        self.open.inside.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag):
        at = self.open
        while at.tag and at.tag != tag:
            at = at.parent
        if at.tag:
            self.open = at.parent

    def handle_data(self, data):
        self.open.inside.append(data)


def tree(page: str) -> Node:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


_SIMPLE = re.compile(r"""(\*|[\w-]+)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:[~^$*]?=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\])*)""")
_PART = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")


class Selector:
    """Elements by tag, .class, #id and [attribute], [a=b], [a~=b], [a^=b], [a$=b], [a*=b]; "a b" is b anywhere within a, "a > b" directly within; commas give alternatives."""

    def __init__(self, text: str):
        self.choices = [self._chain(part.strip()) for part in text.split(",")]

    def _chain(self, text: str) -> list[tuple[str, Callable[[Node], bool]]]:
        out, at, way = [], 0, " "
        while at < len(text):
            m = _SIMPLE.match(text, at)
            if not m[0]:
                raise EngineError(INPUT, f"no selector {text!r}")
            out.append((way, self._simple(m[1], m[2])))
            gap = re.compile(r"\s*(>)\s*|\s+").match(text, m.end())
            if not gap and m.end() < len(text):
                raise EngineError(INPUT, f"no selector {text!r}")
            at, way = (gap.end(), gap[1] or " ") if gap else (len(text), " ")
        if not out:
            raise EngineError(INPUT, "an empty selector")
        return out

    @staticmethod
    def _simple(tag: str | None, more: str) -> Callable[[Node], bool]:
        tests: list[Callable[[Node], bool]] = [] if tag in (None, "*") else [lambda n: n.tag == tag.lower()]
        for kind, name, key, op, *values in _PART.findall(more):
            v = next((x for x in values if x), "")
            if kind == ".":
                tests.append(lambda n, name=name: name in n.attributes.get("class", "").split())
            elif kind == "#":
                tests.append(lambda n, name=name: n.attributes.get("id") == name)
            else:
                how = {
                    "": lambda x, v: True, "=": lambda x, v: x == v, "~=": lambda x, v: v in x.split(), "^=": lambda x, v: x.startswith(v), "$=": lambda x, v: x.endswith(v), "*=": lambda x, v: v in x,
                }[op]
                tests.append(lambda n, key=key.lower(), v=v, how=how: key in n.attributes and how(n.attributes[key], v))
        return lambda n: all(t(n) for t in tests)

    def matches(self, node: Node, top: Node) -> bool:
        """Whether a node, within top, is one; top and what is about it count as ancestors only where they are within the page."""

        def ends(n: Node, chain: list, i: int) -> bool:
            way, test = chain[i]
            if not test(n):
                return False
            if i == 0:
                return True
            at = n.parent
            while at is not None and at is not top and at.tag:
                if ends(at, chain, i - 1):
                    return True
                if way == ">":
                    return False
                at = at.parent
            return False

        return any(ends(node, c, len(c) - 1) for c in self.choices)

    def find(self, top: Node) -> Iterator[Node]:
        return (n for n in top.below() if self.matches(n, top))


def rows(pages: DataFrame, row: str, fields: dict[str, str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, position and the fields of every element that a row selector finds, in the order of the page; elements nest as the page's tags do.

    A field is a selector within the row (see ``Selector``), the text of whose first element without tags it gives, or
    selector@attribute; "@attribute" is the row's own, "" the row's text. What is not there or empty is null. An element that is not
    closed ends with the one about it (or, for li, td and the like, before the next of its kind); a null page has no rows.
    """
    schema = T.StructType([pages.schema[id_col], T.StructField("position", T.IntegerType()), *(T.StructField(name, T.StringType()) for name in fields)])
    own = Selector(row)
    wanted = [(inner, at) for inner, _, at in (s.partition("@") for s in fields.values())]
    inner = [Selector(s) if s else None for s, _ in wanted]

    def values(node: Node) -> list[str | None]:
        out = []
        for selector, (_, attribute) in zip(inner, wanted):
            n = node if selector is None else next(selector.find(node), None)
            out.append((n.attributes.get(attribute.lower(), "") if attribute else n.text()) or None if n else None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                places, found = [], []
                for i, page in enumerate(b.column(1).to_pylist()):
                    for position, node in enumerate(own.find(tree(page or ""))):
                        places.append(i)
                        found.append([position, *values(node)])
                cols = list(zip(*found)) if found else [()] * (1 + len(fields))
                arrays = [b.column(0).take(pa.array(places, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(run, schema)
