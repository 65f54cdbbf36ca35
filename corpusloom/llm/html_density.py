"""HTML extraction by composite text density.

Every node of a page gets its characters per tag, adjusted for the share of both
that links hold. A node's density sum adds up the densities of its children; the
node with the greatest sum marks the content, and the least density on the path
from the body to it is the threshold above which other nodes may hold content too.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|</{t}\Z", re.I) for t in ("script", "style", "template", "noscript", "svg")}
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends if it is the innermost open element of its kind.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
_ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
_SPACE = re.compile(r"\s+")


_LONG_CODE = re.compile(r"&#[0-9]{20,};?")


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Place behind the ``>`` that ends a tag: the first outside quotes, else the first at all."""
    first, tried = at, []
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.end()
        if m.start() in dead:
            break
        tried.append(m.start())
        end = html.find(m[0], m.end())
        if end < 0:
            break
        at = end + 1
    dead.update(tried)
    return html.find(">", first) + 1


def _plain(raw: str) -> str:
    """Character references read, white space collapsed; a code of 20 digits or more is no character."""
    return _SPACE.sub(" ", unescape(_LONG_CODE.sub("\ufffd", raw) if "&#" in raw else raw))


class Page:
    """Elements of one page in document order; element 0 stands above all.

    Reading is linear in the page's length, however broken it is: behind the last
    ``>`` all is text, a quote that was once found to lead nowhere isn't followed
    again, and open elements are looked up by name.
    """

    def __init__(self, html: str) -> None:
        self.tag, self.parent = ["#page"], [-1]
        self.runs: list[tuple[int, str]] = []  # element, its text as written
        self.body = 0
        self._parse(html)

    def _parse(self, html: str) -> None:
        tag, parent, runs = self.tag, self.parent, self.runs
        open_, size, last = [0], len(html), html.rfind(">")
        places: dict[str, list[int]] = {}  # name -> its places in open_, rising
        dead: set[int] = set()  # quotes that open nothing

        def close(k: int) -> None:
            while len(open_) > k:
                places[tag[open_.pop()]].pop()

        def top(names) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        at = begun = 0
        floor = 0  # an end tag reaches no further down than the body
        while True:
            start = html.find("<", at)
            if start < 0 or (start > last and not html.startswith(("<!--", "<![CDATA["), start)):
                break
            name, data = "", None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4) + 3
                at = end if end > 2 else size
            elif html.startswith("<![CDATA[", start):
                end = html.find("]]>", start + 9)
                data = html[start + 9 : end if end >= 0 else size]
                at = end + 3 if end >= 0 else size
            elif html[start + 1 : start + 2] in ("!", "?"):
                at = html.find(">", start) + 1
            elif m := _NAME.match(html, start):
                name, at = m[1].lower(), _tag_end(html, m.end(), dead)
            else:
                at = start + 1
                continue
            if start > begun:
                runs.append((open_[-1], html[begun:start]))
            begun = at
            if data is not None:
                runs.append((open_[-1], data))
            if not name:
                continue
            if html[start + 1] == "/":
                if name not in ("body", "html") and places.get(name) and places[name][-1] > floor:
                    close(places[name][-1])
                continue
            if name in _CLOSES:
                ended, within = _CLOSES[name]
                while (k := top(ended)) > top(within):
                    close(k)
            elif name in _ENDS_P and tag[open_[-1]] == "p":
                close(len(open_) - 1)
            if name == "body" and self.body:
                continue
            node = len(tag)
            tag.append(name)
            parent.append(open_[-1])
            if name == "body":
                self.body, floor = node, len(open_)
            if name in _RAW:
                end = _RAW[name].search(html, at)
                stop = html.find(">", end.start()) if end else -1
                at = begun = stop + 1 if stop >= 0 else size
            elif name not in _VOID and html[at - 2] != "/":
                places.setdefault(name, []).append(len(open_))
                open_.append(node)
        if begun < size:
            runs.append((open_[-1], html[begun:]))

    def content(self) -> tuple[str, float]:
        """Content text, blocks on lines of their own, and the greatest density sum."""
        tag, parent, n, body = self.tag, self.parent, len(self.tag), self.body
        chars, tags, linked, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        texts = [(node, _plain(raw)) for node, raw in self.runs]
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
        for node, text in texts:
            size = len(text.strip())
            chars[node] += size
            if in_link[node]:
                linked[node] += size
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
        share = linked[body] / chars[body] if chars[body] else 0.0
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t = chars[i], max(1, tags[i])
            if c:
                lc, lt = max(1, linked[i]), max(1, link_tags[i])
                base = log(c / max(1, c - linked[i]) * linked[i] + share * c + e)
                density[i] = c / t * max(0.0, log(c / lc * t / lt)) / max(log(base), 1e-9) if base > 1.0 + 1e-12 else c / t
        inside = [False] * n
        inside[body] = True
        for i in range(1, n):
            inside[i] = inside[i] or inside[parent[i]]
            if inside[i] and i != body:
                sums[parent[i]] += density[i]
        best = list(range(n))  # of each subtree, the element with the greatest sum, the first of equals
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if (sums[best[i]], -best[i]) > (sums[best[p]], -best[p]):
                best[p] = best[i]
        top = at = best[body]
        threshold = density[top]
        while at != body:
            at = parent[at]
            threshold = min(threshold, density[at])
        marked = [False] * n
        marked[top] = True
        for i in range(n):
            if inside[i] and density[i] >= threshold and chars[i] and i != body:
                marked[best[i]] = True
        block = list(range(n))
        for i in range(1, n):
            marked[i] = marked[i] or (marked[parent[i]] and i != body)
            if tag[i] not in _BLOCK:
                block[i] = block[parent[i]]
        out: list[str] = []
        last = -1
        for node, text in texts:
            if marked[node] and inside[node]:
                out.append(text if block[node] == last else "\n" + text)
            last = block[node] if marked[node] else -1
        lines = (_SPACE.sub(" ", line).strip() for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line), sums[top]


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("density_sum", T.DoubleType())])


def extract(html: str | None) -> tuple[str | None, float | None]:
    if html is None:
        return None, None
    text, density = Page(html).content()
    return text, round(density, 6)


@F.pandas_udf(_RESULT)
def _extract(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h) for h in pages], columns=["text", "density_sum"])


def extract_content(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, density_sum`` for every row of ``pages``, from its whole HTML.

    Null HTML gives nulls; an empty page, or one without text, the empty text and
    sum 0. Broken markup is read as far as it goes: tags left open end with the
    page, stray end tags are dropped. Text of scripts, styles, templates and
    comments is none. Repeated rows and null ids are kept one by one; other
    columns are dropped. A map without a shuffle.
    """
    return pages.select("page_id", "url", _extract(F.col("html").cast("string")).alias("_c")).select(
        "page_id", "url", "_c.text", "_c.density_sum"
    )
