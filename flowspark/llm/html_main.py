"""Main text of web pages, by removal of what a site repeats.

Each page is parsed into elements; the subtree of each element that may be boilerplate has a hash of its
tags, marks (class, id, role) and text.  Spark counts with how many different articles of a host each hash occurs;
hashes that recur with ``MIN_PAGES`` of them, and with the binary logarithm of the number of the host's
different articles, are the host's template, so that what one section of a large host repeats is.  The page's
own recurring hashes come back to it by page_id, and these subtrees go, with elements that name themselves as
menu, header, footer, sidebar, notice, advert, form or comments, and lists that hold nothing but links.

A page with an article (or main) element keeps only what is inside.  There, only containers (``INNER``)
can be template, never paragraphs or headings, so that tags and marks alone decide in articles without
containers; and a subtree's count is that of the different articles it occurs with, so that copies of one
article do not erase each other.

A hot host is no hot spot: counts combine before the shuffle by (host, hash), and pages meet their
templates by (host, hash) on rows of a few bytes, which a skew join can split.

Nulls and edge cases: null or empty html gives an empty text; a page without url shares a null host with
the like; unclosed and stray tags close as browsers do for blocks; repeated rows get equal results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import stored

MIN_PAGES = 5

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head title nav header footer aside form menu button select option textarea input label fieldset dialog".split()) | RAW
INNER = frozenset("div section ul ol dl table figure details".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer sidebar side aside widget related recommended notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login "
    "share sharing social comment comments respond reply replies disqus form search pagination pager toolbar skip".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACES = re.compile(r"[ \t-\r\x85\xa0  -     　]+")


class Element:
    __slots__ = ("children", "digest", "marks", "tag")

    def __init__(self, tag: str, marks: str):
        self.tag, self.marks, self.children, self.digest = tag, marks, [], 0


def parse(text: str) -> Element:
    """The element tree; children are elements and decoded strings."""
    root = Element("", "")
    stack, at, n = [root], 0, len(text)
    while at < n:
        token = _TOKEN.search(text, at)
        stop = token.start() if token else n
        if stop > at:
            stack[-1].children.append(references.unescape(text[at:stop]))
        if not token:
            break
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # a closing inline tag reaches no further than its block
            if depth and (tag in BLOCK or not any(e.tag in BLOCK for e in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or (tag == stack[i].tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        marks = " ".join(a or b or c for a, b, c in _MARK.findall(token[3])) if "=" in token[3] else ""
        element = Element(tag, marks)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID and not token[3].endswith("/"):
            stack.append(element)
    return root


def _post_order(root: Element) -> list[Element]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if isinstance(c, Element)]
    return out[::-1]


def digest(root: Element) -> list[Element]:
    """All elements, inner ones first, with the hash of their subtrees; 0 for those without text."""
    nodes = _post_order(root)
    for node in nodes:
        if node.tag in RAW:
            continue
        parts = [node.tag, node.marks]
        filled = False
        for child in node.children:
            own = str(child.digest) if isinstance(child, Element) else _SPACES.sub(" ", child).strip()
            filled = filled or own not in ("", "0")
            parts.append(own)
        if filled:
            value = hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            node.digest = int.from_bytes(value, "big", signed=True) or 1
    return nodes


def _named(node: Element) -> bool:
    return node.tag in DROPPED or (bool(node.marks) and any(m in MARKS for m in re.split(r"[\s_\-:]+", node.marks.lower())))


def _only_links(node: Element) -> bool:
    """A list all of whose text is in links."""
    if node.tag not in ("ul", "ol"):
        return False
    stack, seen = [node], False
    while stack:
        now = stack.pop()
        for child in now.children:
            if isinstance(child, Element):
                if child.tag == "a":
                    seen = True
                else:
                    stack.append(child)
            elif child.strip():
                return False
    return seen


def _roots(nodes: list[Element], root: Element) -> tuple[list[Element], bool]:
    """Where the main text is: the outermost article elements, else main, else all of the page."""
    for tag in ("article", "main"):
        found: list[Element] = []
        stack = [root]
        while stack:
            node = stack.pop()
            for child in reversed(node.children):
                if isinstance(child, Element):
                    if child.tag == tag:
                        found.append(child)
                    elif not _named(child):
                        stack.append(child)
        if found:
            place = {id(n): i for i, n in enumerate(reversed(nodes))}
            return sorted(found, key=lambda n: place[id(n)]) if len(found) > 1 else found, True
    return [root], False


def blocks(page: str, template: frozenset[int]) -> list[str]:
    """The blocks of main text in page order."""
    root = parse(page)
    starts, sure = _roots(_post_order(root), root)
    if template:
        digest(root)
    out: list[str] = []
    pieces: list[str] = []

    def close() -> None:
        text = _SPACES.sub(" ", "".join(pieces)).strip(" ")
        pieces.clear()
        if text:
            out.append(text)

    for start in starts:
        stack: list = [start]
        while stack:
            node = stack.pop()
            if node is None:
                close()
            elif isinstance(node, str):
                pieces.append(node)
            elif node is not start and (_named(node) or _only_links(node) or (node.digest in template and (not sure or node.tag in INNER))):
                if node.tag in BLOCK:
                    close()
                else:
                    pieces.append(" ")
            else:
                if node.tag == "br":
                    pieces.append(" ")
                if node.tag in BLOCK:
                    close()
                    stack.append(None)
                stack += reversed(node.children)
        close()
    return out


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, hosts, articles, hashes = [], [], [], []
        for page_id, host, page in zip(batch["page_id"].to_pylist(), batch["host"].to_pylist(), batch["html"], strict=True):
            root = parse(page.as_py() or "")
            nodes = digest(root)
            starts, sure = _roots(nodes, root)
            article = hash(tuple(n.digest for n in starts))
            found = {n.digest for n in nodes if n.digest and n is not root and (n.tag in INNER if sure else n.tag in BLOCK) and n.tag not in ("html", "body", "article", "main")}
            # 0 is no subtree: it counts the articles themselves
            found.add(0)
            pages += [page_id] * len(found)
            hosts += [host] * len(found)
            articles += [article] * len(found)
            hashes += found
        columns = [pa.array(pages, pa.int64()), pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(hashes, pa.int64())]
        yield pa.record_batch(columns, ["page_id", "host", "article", "subtree"])


def _text_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n\n".join(blocks(page.as_py() or "", frozenset(template or ()))) for page, template in zip(batch["html"], batch["template"].to_pylist(), strict=True)]
        yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    sited = own.withColumn("host", F.coalesce(host, F.lit("")))
    subtrees = sited.select("page_id", "host", "html").mapInArrow(_hash_task, "page_id long, host string, article long, subtree long")
    articles = subtrees.groupBy("host", "article", "subtree").agg(F.count("*").alias("pages"))
    often = stored(articles.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    sizes = often.where("subtree = 0").select("host", F.col("n").alias("articles"))
    recurring = often.where("subtree <> 0").join(sizes, "host").where(F.col("n") >= F.log2("articles")).select("host", "subtree")
    templates = subtrees.where("subtree <> 0").join(recurring, ["host", "subtree"], "left_semi").groupBy("page_id").agg(F.collect_set("subtree").alias("template"))
    return own.join(templates, "page_id", "left").mapInArrow(_text_task, "page_id long, url string, text string, n_chars long")
