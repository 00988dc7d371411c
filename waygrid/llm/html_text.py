"""Main text of web pages by composite text density.

A page becomes a tree of elements; known boilerplate (by element, role or class) is left out of it. A name alone proves little, so
an element that its class, id, role or kind only makes likely to be boilerplate stays in the tree if the page has no article outside
such elements and less than SPARE of its unlinked text there. For each node, from its characters C, tags T, link characters LC and
link tags LT, and the body's Cb and LCb:
  density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))
with zeros taken as 1, and C / T alone where the body has no links. A node's sum is that of its children's densities. The node
with the largest sum is the main one; the threshold is the least density on its path to the body. If it lies in an article element,
or articles hold half of its text, the articles that reach the threshold are the result; if not, the node of the largest sum inside
every node that reaches it is.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("head nav footer aside form script style noscript template iframe object embed applet svg math canvas audio video map button select textarea input label option datalist dialog menu title xmp noembed noframes frameset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that start no block of text of their own: cells of a row are one block.
CELL = frozenset(("td", "th"))
CLOSES_P = BLOCK - CELL - frozenset("body html tr tbody thead tfoot caption legend summary option optgroup".split())
#: A start tag ends an open element of these kinds, up to the element that holds the list or table.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select", "datalist"))}
#: A class or id with one of these words is boilerplate if the word ends it, or begins it and is in FIRST.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promoted promotion recommended related replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Words that never name what holds an article.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus gdpr navbar navigation replies reply respond sponsor sponsored".split())
FIRST = frozenset("ad ads advert advertisement adsense breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr menu nav navbar navigation newsletter notice pagination promo related reader share sidebar social sponsor sponsored subscribe".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
KEEP = frozenset(("html", "body", "article", "main"))
#: Elements that can hold a whole page.
LIKELY = frozenset(("form", "aside", "header", "dialog", "footer"))
#: Text outside likely boilerplate, as a share of that within, below which it is none.
SPARE = 0.25
CLEAN, SOFT, HARD = 0, 1, 2

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAIL = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def noise_of(tag: str, attributes: str, in_article: bool) -> int:
    """CLEAN, SOFT (likely boilerplate) or HARD (certain)."""
    if tag in DROP or tag == "header" and not in_article:
        return SOFT if tag in LIKELY else HARD
    if not attributes or tag in KEEP:
        return CLEAN
    a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return HARD
    out = SOFT if a.get("role") in ROLES else CLEAN
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = _PARTS.findall(name)
        if parts and parts[-1] in NOISE and parts[0] not in ("has", "with", "no"):
            out = max(out, HARD if parts[-1] in FIRM else SOFT)
        if len(parts) > 1 and parts[0] in FIRST:
            out = max(out, HARD if parts[0] in FIRM else SOFT)
    return out


class Page:
    """Nodes in page order; a node's parent has a smaller number. Node 0 holds all."""

    def __init__(self, html: str):
        self.tag, self.parent, self.own, self.link = ["#"], [-1], [0], [False]
        self.kind, self.noise = [CLEAN], [False]  # of the element itself; whether it or one around it is left out
        self.events: list[tuple[int, str | None]] = []  # a node and its text, or None where a block of text ends at the node's border
        self.stack, self.open = [0], {}
        self.article = [False]
        self.parse(html)
        self.spare()
        self.blocks: list[tuple[set[int], str]] = []  # the nodes that a block lies in, its text
        self.collect()

    def spare(self) -> None:
        """Decides which SOFT nodes are left out, those of most text first; then the nodes inside."""
        n = len(self.tag)
        outer, apart, whole = [0] * n, [0] * n, [0] * n  # the nearest SOFT node around; unlinked text without and with that of SOFT nodes inside
        for k in range(1, n):
            p = self.parent[k]
            outer[k] = p if self.kind[p] == SOFT else outer[p]
        for k in range(n - 1, -1, -1):
            own = 0 if self.link[k] else self.own[k]
            apart[k] += own
            whole[k] += own
            if k:
                whole[self.parent[k]] += whole[k]
                if self.kind[k] != SOFT:
                    apart[self.parent[k]] += apart[k]
        soft = [k for k in range(1, n) if self.kind[k] == SOFT]
        article = any(apart[k] and not outer[k] and t in ("article", "main") for k, t in enumerate(self.tag))
        if not article:
            text = apart[0]
            for k in sorted(soft, key=lambda k: (-whole[k], k)):
                if whole[k] and text < SPARE * whole[k] and self.kind[outer[k]] != SOFT:
                    self.kind[k] = CLEAN
                    text += apart[k]
        for k in range(1, n):
            self.noise[k] = self.kind[k] != CLEAN or self.noise[self.parent[k]]
            if self.noise[k]:
                self.own[k] = 0

    def collect(self) -> None:
        """The blocks of text outside what is left out."""
        nodes, pieces = set(), []
        for k, raw in [*self.events, (0, None)]:
            if self.noise[k]:
                continue
            if raw is not None:
                nodes.add(k)
                pieces.append(raw)
            elif pieces:
                if text := " ".join("".join(pieces).split()):
                    self.blocks.append((nodes, text))
                nodes, pieces = set(), []

    def text(self, raw: str) -> None:
        k = self.stack[-1]
        if raw and not self.noise[k]:
            raw = unescape(raw) if "&" in raw else raw
            self.events.append((k, raw))
            self.own[k] += len(raw.strip())

    def close_to(self, depth: int) -> None:
        """Ends the open elements from place depth of the stack on."""
        for k in self.stack[depth:]:
            self.open[self.tag[k]] -= 1
            if self.tag[k] in BLOCK and self.tag[k] not in CELL and not self.noise[k]:
                self.events.append((k, None))
        del self.stack[depth:], self.article[depth:]

    def up(self, tags, until=()) -> int:
        """The place of the innermost open element of tags, 0 if one of until comes first."""
        if not any(self.open.get(t) for t in tags):
            return 0
        for d in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[d]]
            if t in tags:
                return d
            if t in until:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and (d := self.up(("p",), ("table", "button", "td", "th"))):
            self.close_to(d)
        if tag in ENDS and (d := self.up(*ENDS[tag])):
            self.close_to(d)
        if tag == "body" and (d := self.up(("head",))):
            self.close_to(d)
        if tag == "br" or tag in CELL:
            self.text(" ")
        top = self.stack[-1]
        kind = HARD if self.noise[top] else noise_of(tag, attributes, self.article[-1])
        if tag in VOID:
            if tag not in ("br", "wbr") and kind != HARD:
                k = self.add(tag, kind)
                if tag in BLOCK:
                    self.events.append((k, None))
            return
        self.stack.append(k := self.add(tag, kind))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in BLOCK and tag not in CELL and kind != HARD:
            self.events.append((k, None))
        self.article.append(self.article[-1] or tag in ("article", "main"))

    def add(self, tag: str, kind: int) -> int:
        top = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(top)
        self.own.append(0)
        self.link.append(tag == "a" or self.link[top])
        self.kind.append(kind)
        self.noise.append(kind == HARD)
        return len(self.tag) - 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag not in ("html", "body"):  # what follows them still belongs to the body
            if d := self.up((tag,), BLOCK if tag not in BLOCK else ("article", "main") if tag == "p" else ()):
                self.close_to(d)

    def parse(self, html: str) -> None:
        at, n, find = 0, len(html), html.find
        while at < n:
            lt = find("<", at)
            if lt < 0:
                return self.text(html[at:])
            m = _NAME.match(html, lt)
            if not m:
                if html.startswith("<!--", lt):
                    self.text(html[at:lt])
                    end = lt + 2 if html.startswith(("<!-->", "<!--->"), lt) else find("-->", lt + 4)
                    if end < 0:
                        return None
                    at = find(">", end) + 1
                elif html.startswith(("<!", "<?", "</"), lt):
                    self.text(html[at:lt])
                    end = find(">", lt)
                    if end < 0:
                        return None
                    at = end + 1
                else:
                    self.text(html[at : lt + 1])
                    at = lt + 1
                continue
            self.text(html[at:lt])
            tail = _TAIL.match(html, m.end())
            end = tail.end() if tail else find(">", m.end()) + 1
            if not end:
                return None  # a tag that breaks off with the page
            tag, attributes = m[2].lower(), html[m.end() : end - 1]
            at = end
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, attributes)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if not close:
                    return None
                self.end(tag)
                at = (find(">", close.end()) + 1) or n
            elif attributes.endswith("/") and tag not in VOID and tag in ("svg", "math", "path"):
                self.end(tag)
        return None

    def densities(self, root: int) -> tuple[list[float], list[float]]:
        """Each node's density and its sum over children, within root."""
        n = len(self.tag)
        chars, tags, lchars, ltags = list(self.own), [0] * n, [c if a else 0 for c, a in zip(self.own, self.link, strict=True)], [0] * n
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            if not self.noise[k]:
                chars[p] += chars[k]
                lchars[p] += lchars[k]
                tags[p] += tags[k] + 1
                ltags[p] += ltags[k] + (self.tag[k] == "a")
        density, total = [0.0] * n, [0.0] * n
        body_c, body_l = chars[root], lchars[root]
        for k in range(n - 1, -1, -1):
            if self.noise[k] or not chars[k]:
                continue
            c, t = chars[k], tags[k] or 1
            density[k] = c / t
            if body_l:
                base = math.log(c / ((c - lchars[k]) or 1) * lchars[k] + body_l / body_c * c + math.e)
                density[k] *= max(0.0, math.log(c / (lchars[k] or 1) * t / (ltags[k] or 1))) / math.log(base)
            if k:
                total[self.parent[k]] += density[k]
        return density, total

    def main(self) -> set[int] | None:
        """The chosen nodes; None if the page has no text."""
        root = next((k for k, t in enumerate(self.tag) if t == "body" and not self.noise[k]), 0)
        density, total = self.densities(root)
        n = len(self.tag)
        if not density[root]:
            return {0} if self.blocks else None
        inside = [False] * n
        inside[root] = True
        for k in range(root + 1, n):
            inside[k] = inside[self.parent[k]] and not self.noise[k]
        best = max((k for k in range(n) if inside[k]), key=lambda k: (total[k], -k))
        path = [best]
        while path[-1] != root:
            path.append(self.parent[path[-1]])
        threshold = min(density[k] for k in path)
        for tag in ("article", "main"):
            own = [inside[k] and self.tag[k] == tag for k in range(n)]
            if any(own[k] for k in path) or self.share(best, own) >= 0.5:
                return {k for k in range(n) if own[k] and density[k] >= threshold}
        top = list(range(n))  # the node of the largest sum inside each node
        for k in range(n - 1, root, -1):
            p = self.parent[k]
            if inside[k] and (total[top[k]], -top[k]) > (total[top[p]], -top[p]):
                top[p] = top[k]
        return {top[k] for k in range(n) if inside[k] and density[k] >= threshold and density[k] > 0}

    def share(self, top: int, chosen: list[bool]) -> float:
        """The share of top's text that lies in chosen nodes."""
        n = len(self.tag)
        within, under, text, all_text = list(chosen), [False] * n, 0, 0
        under[top] = True
        for k in range(top, n):
            if k != top:
                under[k] = under[self.parent[k]]
                within[k] = within[k] or within[self.parent[k]]
            if under[k]:
                all_text += self.own[k]
                text += self.own[k] * within[k]
        return text / (all_text or 1)

    def result(self) -> str:
        chosen = self.main()
        if not chosen:
            return ""
        within = [k in chosen for k in range(len(self.tag))]
        for k in range(1, len(within)):
            within[k] = within[k] or within[self.parent[k]]
        return "\n\n".join(text for nodes, text in self.blocks if any(within[k] for k in nodes))


def main_text(html: str | None) -> str:
    """The main text: blocks joined by a blank line, '' if there is none or html is null."""
    return Page(html).result() if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars. Null or empty html gives '' and 0; broken markup is read as far as it goes."""
    ship(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
