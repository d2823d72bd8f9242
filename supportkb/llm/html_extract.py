"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements with their classes, its presentations
are the child sequences seen there, its contents the hashed block texts. A node's importance is the normalised entropy of
its contents mixed with that of its presentations; what all pages of a host repeat scores near 0 and is removed
as a branch, where at least ``min_pages`` pages of the host show it. Two priors stand above the entropy, because
random per-page menus and adverts are as varied as articles: elements that are furniture by kind (menus, headers,
footers, asides, forms, hidden parts, or so named by class, id or role) have importance 0, and where a page marks its
article (``article``, ``main``, role main) only blocks inside it are text, and of these a block goes only if its own
node (not a node above it) is to be removed. An article of which nothing would be left stays whole. Inside an article a
class or id names furniture only as a whole (``comments``, ``ad-box``), not by a part of another name
(``search-results``). Marks are a prior, not a wall: where the text outside them that the tree keeps is more than
``teaser`` times as long, they mark a teaser, and all of it is the main text.

The tree is never in one place: each task counts (node, content) pairs of its pages, the counts are added by key, the
entropy is one sum per node, and only nodes to be removed go back to the pages (broadcast when measured small,
else joined).

Defined cases: null or empty html gives an empty text; a null or odd url belongs to the host ""; unclosed elements end
with their parent; repeated rows are extracted alike; a very long page is one row and is parsed whole."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportkb.llm.common import written
from supportkb.sizing import broadcast_if_small

# Element kinds.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset"}
RAW = "script|style|title|noscript|template|textarea|iframe|svg|math|object|canvas|video|audio|select|button"
ENDS_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "div", "article", "section", "body", "html", "main", "nav", "aside", "select", "tr"}

_TOKEN = re.compile(
    rf"(?is)<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<[!?/][^>]*+>")
_ATTR = re.compile(r"(?is)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|comments?|commentlist|disqus|replies|respond|sidebar|side|menu|nav|navbar|navigation"
    r"|breadcrumbs?|header|masthead|topbar|footer|foot|bottom|related|recommend\w*|shar(?:e|ing)|social|toolbar|widget"
    r"|pagination|pager|login|signup|search|toc|hidden|copyright|legal|disclaimer)(?:$|[\s_-])")
# What the boxes of furniture are called besides.
_HOLDERS = {"area", "bar", "block", "box", "container", "form", "frame", "inner", "items", "links", "list", "panel", "section",
            "slot", "unit", "wrap", "wrapper"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_DIGITS = re.compile(r"\d+")


def _named_whole(value: str) -> bool:
    """Whether one of the names consists of furniture words and words for boxes only."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+|\d+", name.lower()) if w and w not in _HOLDERS]
        if words and all(_NAMED.fullmatch(w) for w in words):
            return True
    return False


def _node(tag: str, attrs: str, inside: bool):
    """(name in a path, is furniture, is the article) of an element; ``inside`` an article or not."""
    name, furniture, article = tag, tag in FURNITURE, tag in ("article", "main")
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("class", "id"):
                name += ("." if kind == "class" else "#") + _DIGITS.sub("N", value)
                furniture = furniture or (_named_whole(value) if inside else bool(_NAMED.search(value)))
            elif kind == "role":
                furniture, article = furniture or value.lower() in _ROLES, article or value.lower() == "main"
            elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                furniture = True
            elif kind == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                furniture = True
    return name, furniture, article


def blocks(page: str):
    """Blocks of a page in order: (text, path hashes of its block elements, is furniture, in the article, link characters),
    and the child sequence of every closed path."""
    out, shapes, text, linked = [], Counter(), [], 0
    # open elements: tag, path hash, furniture, article, child names
    stack = [("", 0, False, False, [])]
    link = 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((joined, tuple(e[1] for e in stack if e[1]), stack[-1][2], stack[-1][3], linked))
            text.clear()
        linked = 0

    def close(to: int):
        while len(stack) > to:
            _, path, _, _, children = stack.pop()
            if children:
                shapes[(path, zlib.crc32(">".join(dict.fromkeys(children)).encode()))] += 1

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = html.unescape(page[at:m.start()])
            text.append(piece)
            if link:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = 0 if m["end"] else 1
        if tag not in BLOCKS:
            continue
        flush()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if len(stack) > 1 and any(e[0] == "p" for e in stack[-3:]):      # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
        peers = ENDS_PEERS.get(tag)
        if peers:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in peers:
                    close(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        name, furniture, article = _node(tag, m["attrs"], stack[-1][3])
        stack[-1][4].append(name)
        if tag in VOID:
            continue
        path = zlib.crc32(name.encode(), stack[-1][1]) or 1
        stack.append((tag, path, furniture or stack[-1][2] or (tag == "header" and not stack[-1][3]),
                      article or stack[-1][3], []))
    if at < len(page):
        text.append(html.unescape(page[at:]))
    flush()
    close(1)
    return out, shapes


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def node_importance(pages: DataFrame, mix: float = 0.7) -> DataFrame:
    """(host, path, pages, importance) of the style tree of every host; pages: page_id, url, html."""
    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, shapes = blocks(page or "")
                shown = set()
                for text, path, furniture, _, _ in found:
                    if not furniture and path:
                        seen[(h, path[-1], "text", zlib.crc32(text.encode("utf-8", "surrogatepass")))] += 1
                        shown.update(path)
                for (path, shape), n in shapes.items():
                    seen[(h, path, "shape", shape)] += n
                for path in shown:
                    seen[(h, path, "page", 0)] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.int64()),
                 pa.array([seen[k] for k in keys], pa.int64())], ["host", "path", "kind", "what", "n"])
    counted = (pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
               .mapInArrow(run, "host string, path long, kind string, what long, n long")
               .groupBy("host", "path", "kind", "what").agg(F.sum("n").alias("n")))

    def of(kind, value):
        return F.sum(F.when(F.col("kind") == kind, value))

    def entropy(kind):
        total = of(kind, F.col("n"))
        spread = F.log(total) - of(kind, F.col("n") * F.log(F.col("n"))) / total
        return F.when(total > 1, spread / F.log(total)).otherwise(F.lit(1.0))
    nodes = counted.groupBy("host", "path").agg(
        F.coalesce(of("page", F.col("n")), F.lit(0)).alias("pages"), entropy("text").alias("text"), entropy("shape").alias("shape"),
        of("text", F.col("n")).alias("texts"))
    importance = F.when(F.col("texts").isNull(), F.lit(1.0)).otherwise(F.lit(mix) * F.col("text") + F.lit(1 - mix) * F.coalesce("shape", "text"))
    return nodes.select("host", "path", "pages", importance.alias("importance"))


def extract(pages: DataFrame, threshold: float = 0.35, min_pages: int = 8, link_share: float = 0.6,
            teaser: float = 3.0) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    low = written(node_importance(pages).filter((F.col("pages") >= min_pages) & (F.col("importance") < threshold))
           .groupBy("host").agg(F.collect_list("path").alias("dropped")), "style-tree")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    joined = rows.join(broadcast_if_small(low), "host", "left").select("page_id", "url", "html", "dropped")

    def main_text(page: str, dropped: set) -> str:
        found, _ = blocks(page)
        article = [b[3] and not b[2] for b in found]
        inside = [a and not (b[1] and b[1][-1] in dropped) for a, b in zip(article, found)]
        if not any(inside):
            inside = article
        outside = [not a and not b[2] and not dropped.intersection(b[1]) and b[4] <= link_share * len(b[0])
                   for a, b in zip(article, found)]
        sizes = [sum(len(b[0]) for take, b in zip(some, found) if take) for some in (inside, outside)]
        both = sizes[1] > teaser * sizes[0]
        kept = [b[0] for i, o, b in zip(inside, outside, found) if i or both and o]
        return "\n".join(kept)

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", set(d or ())) for p, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long")
