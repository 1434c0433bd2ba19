"""HTML and XML as rows (EX-1): one tokenizer, one pass over a page, only the wanted tags built.

The tree follows what recovering HTML parsers do: void elements have no content, a new p, li, dt, dd, option, tr, td or th ends
the open one, block elements end an open p, an end tag closes what is open inside it and is ignored if nothing it names is open, and
scripts and styles hold raw text. Text of an element is all text under it, comments included. A named character reference counts only
with its semicolon, in texts and attributes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.schemas import NODE

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: A start tag of the key ends open elements of the values, unless one of STOP lies between.
BLOCKS = frozenset("address blockquote center dir div dl fieldset form h1 h2 h3 h4 h5 h6 hr menu noframes ol p pre table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOP = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_MARKUP = re.compile(r"""<!--(.*?)(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[a-zA-Z][a-zA-Z0-9]*;)")


class _Element:
    __slots__ = ("attrs", "children", "end", "own", "path", "pos", "start", "tag", "want")

    def __init__(self, tag: str, pos: int, start: int, attrs: str, path: str, want: bool):
        self.tag, self.pos, self.start, self.attrs, self.path, self.want = tag, pos, start, attrs, path, want
        self.end, self.own, self.children = -1, -1, {}


def _plain(text: str) -> str:
    """text with its character references read; "&amp" that was cut off, or "&copy=2" in a link, stays as it is."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text) if "&" in text else text


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), _plain(a or b or c))
    return out


def _step(selector: str) -> tuple[str, str, frozenset[str]]:
    """(tag, id, classes) of tag#id.class."""
    tag, ident, classes = re.match(r"^([\w-]*)", selector)[1].lower(), "", []
    for kind, name in re.findall(r"([#.])([\w-]+)", selector):
        if kind == "#":
            ident = name
        else:
            classes.append(name)
    return tag, ident, frozenset(classes)


def _fits(step: tuple[str, str, frozenset[str]], tag: str, attrs: dict[str, str]) -> bool:
    return step[0] in ("", "*", tag) and step[1] in ("", attrs.get("id", "")) and step[2] <= set(attrs.get("class", "").split())


def nodes(html: str | None, tags: frozenset[str] | None = None, within: str | None = None, xml: bool = False) -> list[tuple]:
    """(pos, tag, attrs, own, text, path) of each wanted element, in document order; pos counts all elements.

    own: text before the first child, None if there is none. path: /html[1]/body[1]/p[2]. within: descendant selectors such as
    "div.text p#lead" or xpath steps such as ".//div"; only elements in (or at) a match are given.
    xml (UD-4): names keep their case, nothing is void or ends by itself, CDATA is text.
    """
    if not html:
        return []
    steps = [_step(s) for s in within.replace(".//", " ").replace("//", " ").split()] if within else []
    stack: list[_Element] = []
    depth: list[int] = []
    found: list[_Element] = []
    texts: list[str] = []
    top: dict[str, int] = {}
    pos, at = 0, 0

    def add(text: str) -> None:
        if text:
            texts.append(text)

    def close(n: int) -> None:
        for e in stack[n:]:
            e.end = len(texts)
            if e.own < 0:
                e.own = e.end
        del stack[n:]
        del depth[n:]

    def auto_close(tag: str) -> None:
        ends, stops = ENDS.get(tag, frozenset()), STOP.get(tag, frozenset())
        for n in range(len(stack) - 1, -1, -1):
            open_tag = stack[n].tag
            if open_tag in ends or (tag in BLOCKS and open_tag == "p"):
                close(n)
                return
            if open_tag in stops or (tag in BLOCKS and open_tag in ("table", "td", "th", "li", "button")):
                return

    while m := _MARKUP.search(html, at):
        add(_plain(html[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            if stack and stack[-1].own < 0:
                stack[-1].own = len(texts)
            add(m[1])
            continue
        if m[3] is None:
            if xml and m[0].startswith("<![CDATA["):
                texts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[3] if xml else m[3].lower()
        if m[2]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].tag == tag:
                    close(n)
                    break
            continue
        if not xml:
            auto_close(tag)
        if stack and stack[-1].own < 0:
            stack[-1].own = len(texts)
        siblings = stack[-1].children if stack else top
        siblings[tag] = siblings.get(tag, 0) + 1
        path = f"{stack[-1].path if stack else ''}/{tag}[{siblings[tag]}]"
        fits = depth[-1] if depth else 0
        if steps and fits < len(steps) and _fits(steps[fits], tag, _attrs(m[4])):
            fits += 1
        e = _Element(tag, pos, len(texts), m[4], path, (tags is None or tag in tags) and fits == len(steps))
        pos += 1
        if e.want:
            found.append(e)
        if (tag in VOID and not xml) or m[4].endswith("/"):
            e.end = e.own = len(texts)
            continue
        stack.append(e)
        depth.append(fits)
        if tag in RAW and not xml:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            stop = end.start() if end else len(html)
            add(html[at:stop])
            at = stop
    add(_plain(html[at:]))
    close(0)
    return [(e.pos, e.tag, _attrs(e.attrs), "".join(texts[e.start : e.own]) if e.own > e.start else None, "".join(texts[e.start : e.end]), e.path) for e in found]


_FIELDS = pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own", pa.string()), ("text", pa.string()), ("path", pa.string())])
_NAMES = ("pos", "tag", "attrs", "own", "text", "path")


def html_nodes(html: Column, tags: tuple[str, ...] | None = None, within: str | None = None, xml: bool = False) -> Column:
    """array<struct<pos,tag,attrs,own,text,path>>: parsed once per page; the tags are this parser's pushed-down projection."""
    want = frozenset(tags) if tags is not None else None

    @F.arrow_udf(f"array<{NODE}>")
    def run(col: pa.Array) -> pa.Array:
        out = [[{k: list(v.items()) if k == "attrs" else v for k, v in zip(_NAMES, n, strict=True)} for n in nodes(x, want, within, xml)] for x in col.to_pylist()]
        return pa.array(out, pa.list_(_FIELDS))

    return run(html)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: parsing costs far more than moving a page."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


class _NodeRows:
    def eval(self, html: str, tags: str) -> Iterator[tuple]:
        yield from nodes(html, frozenset(tags.split(",")) if tags else None)


def register(spark: SparkSession) -> None:
    """html_nodes(html, 'p,h1') as a table function for LATERAL in SQL."""
    spark.udtf.register("html_nodes", F.udtf(_NodeRows, returnType="pos int, tag string, attrs map<string,string>, own string, text string, path string"))
