"""Main text of web pages by wrappers that are inferred for each host.

A page is a stream of block tags and texts.  Runs of equal shape within a page fold
into repeated groups.  The pages of a host are then aligned one after the other: what
only some have becomes an optional group, what repeats becomes a repeated group, and
texts become slots, constant where every page has the same words.  The result is one
union-free regular expression per host, its wrapper.

Wrappers are merged in two steps, within tasks and then per host, so that a host of
any size sends one wrapper per task and none of its pages to another task.  A page is
read by aligning it with its host's wrapper: slots under the wrapper's article are its
text, slots under menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are not.  Where a wrapper has no article, constant texts that at
least ``MIN_SUPPORT`` pages share are furniture too.

Null html is an empty page, a page without article text has empty text, a null or
unreadable url has the empty host.  Repeated rows give repeated rows, unclosed and
cut markup is read as far as it goes, extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.staging import materialize, ship_package

MIN_SUPPORT = 8
# Wrappers of all hosts are broadcast up to this size and joined by shuffle beyond it.
BROADCAST_BYTES = 32 << 20
# Nodes of one repeated unit.
_UNIT = 24

# Fixed values of HTML: elements that are read as raw text, that have no end tag, and
# that stand within a line.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
# Elements, and words of class, id and role attributes, that hold no article text.
FURNITURE = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav", "select"}
FURNITURE_WORDS = {"ad", "ads", "advert", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies", "reply", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
ARTICLE = {"article", "main"}
ARTICLE_WORDS = {"article", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


# Fixed values of names that say what a page has, not what an element is.
STATES = {"has", "with", "no", "without", "is", "js"}


def _hints(attributes: str) -> set[str]:
    """First and last words of each name; a name like has-sidebar or post-share-story says nothing."""
    found = _ATTRIBUTE.findall(attributes) if "=" in attributes else ()
    hints = set()
    for name in (n for m in found for n in "".join(m[1:]).lower().split()):
        words = re.findall(r"[a-z0-9]+", name)
        if words and (len(words) == 1 or words[0] not in STATES):
            hints |= {words[0], words[-1]}
    return hints


def _mark(name: str, attributes: str) -> str:
    """The tag with the hints that decide its part: ``a`` article, ``f`` furniture."""
    if name in ("html", "body"):
        return name
    hints = _hints(attributes)
    if name in FURNITURE or hints & FURNITURE_WORDS:
        return f"{name}.f"
    if name in ARTICLE or hints & ARTICLE_WORDS:
        return f"{name}.a"
    return name


def tokens(page: str) -> list[tuple[str, str]]:
    """("<", tag), (">", tag) and ("t", text of one block) in page order."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    marked: list[str] = []  # inline elements that are furniture
    paragraph = False  # whether one is open; its end tag may be left out

    def flush() -> None:
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            out.append(("t", words))

    at, length = 0, len(page)
    while at < length:
        found = _TOKEN.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        text.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            if closing:
                if marked and marked[-1].split(".")[0] == name:
                    flush()
                    out.append((">", marked.pop()))
                continue
            mark = _mark(name, found[3])
            if mark.endswith(".f") and name not in VOID:
                flush()
                out.append(("<", mark))
                marked.append(mark)
            continue
        flush()
        if paragraph and (closing or name in CLOSES_P):
            out.append((">", "p"))
            paragraph = False
            if name == "p" and closing:
                continue
        if closing:
            if name != "p":
                out.append((">", name))
        else:
            out.append(("<", _mark(name, found[3])))
            paragraph |= name == "p"
    flush()
    return out


# Nodes of a wrapper, all JSON: ["<", tag, optional], [">", tag, optional],
# ["t", pages, hash or null where it varies, optional, token places (pages only)],
# ["+", nodes of one unit, optional].


def _shape(node: list) -> tuple:
    if node[0] == "+":
        return ("+", *map(_shape, node[1]))
    return ("t",) if node[0] == "t" else (node[0], node[1])


def _key(node: list) -> tuple:
    """What has to agree for two nodes to be aligned."""
    if node[0] == "+":
        return ("+", _shape(node[1][0]))
    return ("t",) if node[0] == "t" else (node[0], node[1])


def _same_unit(a: list[list], b: list[list]) -> list[list]:
    """One unit from two of equal shape."""
    return [
        ["+", _same_unit(x[1], y[1]), False] if x[0] == "+"
        else _slot(x, y) if x[0] == "t"
        else x
        for x, y in zip(a, b, strict=True)
    ]


def _slot(a: list, b: list, pages: int | None = None) -> list:
    same = a[2] if a[2] is not None and a[2] == b[2] else None
    return ["t", a[1] if pages is None else pages, same, a[3] or b[3], a[4] + b[4]]


def fold(nodes: list[list]) -> list[list]:
    """Replace adjacent units of equal shape by repeated groups, inner groups first."""
    unit = 2
    while unit <= min(_UNIT, len(nodes) // 2):
        shapes = [_shape(n) for n in nodes]
        if not any(x == y and x[0] == "<" for x, y in zip(shapes, shapes[unit:])):
            unit += 1
            continue
        out, i = [], 0
        while i < len(nodes):
            group, after = nodes[i : i + unit], i + unit
            if shapes[i][0] == "<":
                while shapes[i : i + unit] == shapes[after : after + unit]:
                    group = _same_unit(group, nodes[after : after + unit])
                    after += unit
            if after > i + unit:
                out.append(["+", group, False])
                i = after
            else:
                out.append(nodes[i])
                i += 1
        unit = unit + 1 if len(out) == len(nodes) else 2
        nodes = out
    return nodes


def page_nodes(stream: list[tuple[str, str]]) -> list[list]:
    """The page as a wrapper of its own; texts keep their places in ``stream``."""
    nodes = [
        ["t", 1, blake2b(x.encode("utf-8", "replace"), digest_size=8).hexdigest(), False, [i]]
        if kind == "t"
        else [kind, x, False]
        for i, (kind, x) in enumerate(stream)
    ]
    return fold(nodes)


def _as_groups(nodes: list[list], others: list[list]) -> list[list]:
    """Turn single units into groups where the other side has a group of that shape."""
    for group in (n for n in others if n[0] == "+"):
        shape, size = [_shape(n) for n in group[1]], len(group[1])
        out, i = [], 0
        while i < len(nodes):
            if [_shape(n) for n in nodes[i : i + size]] == shape:
                unit = nodes[i : i + size]
                out.append(["+", unit, any(_optional(n) for n in unit)])
                i += size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _optional(node: list) -> bool:
    return node[3] if node[0] == "t" else node[2]


def _as_optional(node: list) -> list:
    out = list(node)
    out[3 if node[0] == "t" else 2] = True
    return out


def pairs(a: list[list], b: list[list]) -> list[tuple[list | None, list | None]]:
    """Cheapest alignment of two node lists: longest common subsequence of their keys."""
    ka, kb = [_key(n) for n in a], [_key(n) for n in b]
    head = 0
    while head < min(len(a), len(b)) and ka[head] == kb[head]:
        head += 1
    n, m = len(a) - head, len(b) - head
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            if ka[head + i] == kb[head + j]:
                row[j] = below[j + 1] + 1
            else:
                row[j] = max(below[j], row[j + 1])
    out: list[tuple[list | None, list | None]] = list(zip(a[:head], b[:head], strict=True))
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[head + i] == kb[head + j]:
            out.append((a[head + i], b[head + j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((a[head + i], None))
            i += 1
        else:
            out.append((None, b[head + j]))
            j += 1
    return out


def merge(a: list[list], b: list[list]) -> list[list]:
    """One wrapper that reads whatever either of two reads."""
    a, b = _as_groups(a, b), _as_groups(b, a)
    out = []
    for x, y in pairs(a, b):
        if x is None or y is None:
            out.append(_as_optional(x if y is None else y))
        elif x[0] == "t":
            out.append(_slot(x, y, x[1] + y[1]))
        elif x[0] == "+":
            out.append(["+", merge(x[1], y[1]), x[2] or y[2]])
        else:
            out.append([x[0], x[1], x[2] or y[2]])
    return out


def _plain(nodes: list[list]) -> list[list]:
    """Without the places of a page's tokens."""
    return [
        [*n[:4], []] if n[0] == "t" else ["+", _plain(n[1]), n[2]] if n[0] == "+" else n
        for n in nodes
    ]


def _slots(nodes: list[list], stack: list[str]) -> Iterator[tuple[list, tuple[str, ...]]]:
    """Every text node with the elements that are open around it."""
    for node in nodes:
        if node[0] == "+":
            yield from _slots(node[1], stack)
        elif node[0] == "t":
            yield node, tuple(stack)
        elif node[0] == "<":
            if node[1].split(".")[0] not in VOID:
                stack.append(node[1])
        else:
            name = node[1].split(".")[0]
            if any(x.split(".")[0] == name for x in stack):
                while stack.pop().split(".")[0] != name:
                    pass


def _kept(nodes: list[list]) -> set[int]:
    """Identities of the text nodes that are article text."""
    seen = list(_slots(nodes, []))

    def furniture(stack: tuple[str, ...]) -> bool:
        inside = False
        for x in stack:
            inside |= x.endswith(".a")
            # A header within an article holds its title.
            if x.endswith(".f") or x.split(".")[0] == "header" and not inside:
                return True
        return False

    free = [(n, s) for n, s in seen if not furniture(s)]
    within = [n for n, s in free if any(x.endswith(".a") for x in s)]
    if not within:
        varied = any(n[2] is None for n, _ in free)
        within = [n for n, _ in free if not (varied and n[2] is not None and n[1] >= MIN_SUPPORT)]
    return {id(n) for n in within}


@lru_cache(maxsize=512)
def _read(wrapper: str) -> tuple[list[list], set[int]]:
    nodes = json.loads(wrapper)
    return nodes, _kept(nodes)


def _places(wrapper: list[list], page: list[list], keep: set[int], own: set[int], out: set[int]):
    grouped, page = _as_groups(wrapper, page), _as_groups(page, wrapper)
    for x, y in pairs(grouped, page):
        if y is None:
            continue
        if y[0] == "+":
            _places(x[1] if x else [], y[1], keep, own, out)
        elif y[0] == "t" and (id(x) in keep if x else id(y) in own):
            out.update(y[4])


def extract(page: str | None, wrapper: str | None) -> str:
    """Article text of one page, read with its host's wrapper."""
    stream = tokens(page or "")
    nodes = page_nodes(stream)
    whole, keep = _read(wrapper) if wrapper else ([], set())
    places: set[int] = set()
    _places(whole, nodes, keep, _kept(nodes), places)
    return "\n".join(stream[i][1] for i in sorted(places))


def host(url: str = "url"):
    """Lower-case host of a url; empty if there is none."""
    found = F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.coalesce(F.lower(F.regexp_replace(found, r"^.*@|:\d+$", "")), F.lit(""))


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper (JSON) over every page."""
    ship_package(pages.sparkSession)

    def absorb(held: dict, name: str, nodes: list[list]) -> None:
        held[name] = merge(held[name], nodes) if name in held else nodes

    def rows(held: dict) -> pd.DataFrame:
        return pd.DataFrame(
            {"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}, dtype=object
        )

    def within_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[list]] = {}
        for batch in batches:
            for name, page in zip(batch["host"], batch["html"], strict=True):
                absorb(held, name, _plain(page_nodes(tokens(page))))
            if len(held) > 5_000:
                yield rows(held)
                held = {}
        yield rows(held)

    def per_host(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[list]] = {}
        last = None
        for batch in batches:
            for name, wrapper in zip(batch["host"], batch["wrapper"], strict=True):
                if name != last and held:
                    yield rows(held)
                    held = {}
                last = name
                absorb(held, name, json.loads(wrapper))
        yield rows(held)

    schema = "host string, wrapper string"
    return (
        pages.select(host(url).alias("host"), F.coalesce(html, F.lit("")).alias("html"))
        .mapInPandas(within_task, schema)
        .repartition("host")
        .sortWithinPartitions("host", "wrapper")
        .mapInPandas(per_host, schema)
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    spark = pages.sparkSession
    ship_package(spark)
    wrappers = materialize(infer(pages), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, wrapper in batches:
            yield pd.Series(
                [extract(p, w) for p, w in zip(page, wrapper, strict=True)], dtype=object
            )

    return (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.coalesce("html", F.lit("")).alias("html"),
            host().alias("host"),
        )
        .join(wrappers, "host", "left")
        .select("page_id", "url", text("html", "wrapper").alias("text"))
    )
