"""Main text of pages by a site style tree.

Pages are parsed once. Per host the block-level trees are merged: a node of the style tree is a path
of (tag, class) steps; each page adds the presentation of the node (its children's steps) and its
content (its own text). Counts of presentations and contents give each node an entropy-based importance
(logarithms to the base of the number of pages that have the node); a branch whose own and all inner
importances are below ``THRESHOLD`` is removed from the host's pages. Pages of a host whose text blocks
are equal count once, so that a copied text is no more boilerplate than one that stands alone; a page all
of whose branches would go keeps them.

Entropy cannot tell a menu whose links differ on every page from an article. Presentation nodes whose
tag, role or class says what they are (``NOISE_TAGS``, ``NOISE_WORDS``) therefore have importance 0 from the
start. The words do not count on ``html``, ``body`` and ``main`` and on what is or holds an ``article`` or
``main``: that is a wrapper, judged by its statistics. Inside an article (where comments are articles too) it
has to hold more than half of the article's text to be one. Digits in classes and ids do not tell nodes apart
(``post-123`` and ``post-124`` are one).

Measured importance is shrunk towards 1 by ``PRIOR`` pages of importance 1, so that evidence grows with a host's
pages without a step. ``article`` and ``main`` are a stronger prior: the nodes themselves have importance 1, and each
node inside them has ``INSIDE`` such pages. All other branches, also beside an article, are judged by entropy alone.

Defined cases: null or empty html gives an empty text; a null url has the empty host; a node on one page of its
host only has no evidence against it and stays; repeated pages and null ids (integers of any width) are rows of
their own; extra columns are ignored; unclosed and stray tags are closed where the next block begins; an unclosed
raw element is ordinary markup; an empty table gives no rows. Texts are never cut; time is linear in the
bytes of a page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import BROADCAST_ROWS
from ._store import written
from .url_filters import split_url

THRESHOLD = 0.2
#: Characters of a path above which the next step begins a subtree of its own.
LONG = 2000
#: Pages of importance 1 that count beside a node's own, elsewhere and inside an article or main.
PRIOR, INSIDE = 2.0, 8.0

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements read as raw text: the first two to the end of the page if they are not closed.
CODE, RAW = "script style", "noscript template textarea title svg iframe canvas select"
#: Elements that are never main text, whatever their class.
NOISE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog", *CODE.split(), *RAW.split(), "head"])
MAIN_TAGS = frozenset(["article", "main"])
#: Words of class, id or role that name a part of the page beside the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disclaimer disqus footer header menu nav navbar navigation newsletter notice notices pagination popup"
    " promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget".split()
)
#: Inline elements that are main text within an article or main only.
INLINE = frozenset(["math", "object", "button"])
#: A start tag that closes an open element of the same kind.
CLOSES_SELF = frozenset("p li dt dd tr td th option".split())
CLOSES_P = BLOCKS - {"body", "html"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in (*CODE.split(), *RAW.split())}
_DIGITS = re.compile(r"\d+")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("article", "children", "holds", "named", "noise", "parent", "path", "size", "tag", "text")

    def __init__(self, tag: str, path: str, named: bool, parent: Node | None) -> None:
        self.tag, self.path, self.named, self.parent = tag, path, named, parent
        self.noise = self.article = False
        #: Whether the node is or holds an article or main, and the characters of its branch that no tag calls noise.
        self.holds, self.size = tag in MAIN_TAGS, 0
        self.children: list[str] = []
        self.text: list[str] = []


def _judge(nodes: list[Node]) -> None:
    """Sets ``noise`` and ``article`` of nodes in page order, once their branches are known."""
    for n in reversed(nodes):
        n.size = 0 if n.tag in NOISE_TAGS else n.size + sum(map(len, n.text))
        if n.parent:
            n.parent.size += n.size
            n.parent.holds |= n.holds and n.tag not in NOISE_TAGS
    around: dict[Node, Node | None] = {}  # the nearest article or main above a node
    for n in nodes[1:]:
        up = n.parent
        around[n] = outer = up if up.article and up.tag in MAIN_TAGS else around.get(up)
        named = n.named and n.tag not in ("html", "body", "main")
        if named and n.holds:
            named = outer is not None and 2 * n.size <= outer.size
        n.noise = up.noise or n.tag in NOISE_TAGS or named
        n.article = not n.noise and (up.article or n.tag in MAIN_TAGS)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block-level nodes of a page and its text blocks, in page order."""
    root = Node("", "", False, None)
    open_, nodes, blocks, buffer = [root], [root], [], []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            blocks.append((open_[-1], text))
            open_[-1].text.append(text)

    at, skipped = 0, None  # skipped: the inline element outside an article that is being left out, and where it began
    never: set[str] = set()  # raw elements that no end tag follows any more
    count = Counter()  # open elements by tag
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            buffer.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _CLOSE and not m["end"] and tag not in never:
            if close := _CLOSE[tag].search(page, at):
                at = close.end()
                continue
            never.add(tag)
            if tag in CODE.split():
                at = len(page)
                continue
        if tag not in BLOCKS:
            if tag == "br":
                buffer.append(" ")
            elif tag in INLINE:
                if not m["end"]:
                    if skipped is None and not any(count[t] for t in MAIN_TAGS):
                        skipped = tag, len(buffer)
                elif skipped and skipped[0] == tag:
                    del buffer[skipped[1] :]
                    skipped = None
            continue
        if skipped:
            skipped = None if tag in MAIN_TAGS else (skipped[0], 0)  # not closed before an article
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            while count[tag]:
                closed = open_.pop().tag
                count[closed] -= 1
                if closed == tag:
                    break
            continue
        if tag in CLOSES_P and open_[-1].tag == "p":
            count[open_.pop().tag] -= 1
        if tag in CLOSES_SELF and open_[-1].tag == tag:
            count[open_.pop().tag] -= 1
        words = [w.lower() for a in _ATTR.finditer(m["attrs"]) for w in (a[2] or a[3] or a[4] or "").split()]
        parent = open_[-1]
        step = ".".join([tag, *(_DIGITS.sub("0", w) for w in words)]).replace("/", "_")
        named = any(w in NOISE_WORDS for word in words for w in _WORD.findall(word))
        # A page of nested tags alone stays linear: deep steps begin a subtree that is judged on its own.
        path = f"{parent.path}/{step}" if len(parent.path) < LONG else f"/{_digest(parent.path):x}/{step}"
        parent.children.append(step)
        node = Node(tag, path, named, parent)
        open_.append(node)
        count[tag] += 1
        nodes.append(node)
    buffer.append(html.unescape(page[at:]))
    flush()
    _judge(nodes)
    return nodes, blocks


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


PARSED = (
    "page_id bigint, url string, host string, blocks array<struct<path:string,text:string>>,"
    " features array<struct<path:string,kind:int,feature:bigint>>, vote bigint"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("path", pa.string()), ("text", pa.string())])
    feature = pa.struct([("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64())])
    for batch in batches:
        all_blocks, all_features, votes = [], [], []
        for page in batch.column("html").to_pylist():
            nodes, blocks = parse(page or "")
            clear = [(n, t) for n, t in blocks if not n.noise]
            votes.append(_digest("\n".join(f"{n.path}\n{t}" for n, t in clear)))
            all_blocks.append([{"path": n.path, "text": t} for n, t in clear])
            shown: dict[tuple[str, int, int], None] = {}
            for n in nodes:
                if n.noise:
                    continue  # its importance is 0
                shown[n.path, 0, _digest(" ".join(n.children))] = None
                if n.text:
                    shown[n.path, 1, _digest("\n".join(n.text))] = None
            all_features.append([{"path": p, "kind": k, "feature": f} for p, k, f in shown])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                batch.column("host"),
                pa.array(all_blocks, pa.list_(block)),
                pa.array(all_features, pa.list_(feature)),
                pa.array(votes, pa.int64()),
            ],
            names=["page_id", "url", "host", "blocks", "features", "vote"],
        )


def style_tree(parsed: DataFrame) -> DataFrame:
    """``host, path, pages, importance, branch``: a node's own importance and the largest in its branch."""
    pages = parsed.groupBy("host", "vote").agg(F.min("features").alias("features"))
    each = pages.select("host", F.explode("features").alias("f")).select("host", "f.path", "f.kind", "f.feature")
    counts = each.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    nodes = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, c)).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, c * F.ln(c))).alias("shape_clnc"),
        F.avg(F.when(F.col("kind") == 1, F.ln(c))).alias("content_lnc"),
    )
    ln_m = F.ln("pages")
    shape = 1 - F.col("shape_clnc") / (F.col("pages") * ln_m)  # -sum p log_m p
    content = 1 - F.col("content_lnc") / ln_m
    measured = F.greatest(shape, F.coalesce(content, F.lit(0.0)))
    tags = "|".join(sorted(MAIN_TAGS))
    is_main, within = F.col("path").rlike(rf"/({tags})(\.[^/]*)?$"), F.col("path").rlike(rf"/({tags})(\.[^/]*)?/")
    nodes = nodes.withColumn(
        "importance",
        F.when((F.col("pages") < 2) | is_main, F.lit(1.0))
        .when(within, (INSIDE + F.col("pages") * measured) / (INSIDE + F.col("pages")))
        .otherwise((PRIOR + F.col("pages") * measured) / (PRIOR + F.col("pages"))),
    )
    ancestors = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    up = nodes.select("host", F.explode(ancestors).alias("path"), "importance")
    branch = up.groupBy("host", "path").agg(F.max("importance").alias("branch"))
    return nodes.join(branch, ["host", "path"]).select("host", "path", "pages", "importance", "branch")


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    host, _ = split_url(F.col("url"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.col("html").cast("string").alias("html")
    )
    parsed = written(rows.mapInArrow(_parse, PARSED), "pages-parsed")
    # The topmost low branches of each host are what its pages lose.
    low = written(style_tree(parsed).where(f"branch < {THRESHOLD} AND path <> ''").select("host", "path"), "style-tree")
    low = low.groupBy(F.col("host").alias("__host")).agg(F.collect_set("path").alias("__low"))
    if low.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10:
        low = F.broadcast(low)
    rows = parsed.join(low, F.col("host") == F.col("__host"), "left")
    noisy = "exists(__low, p -> startswith(concat(b.path, '/'), concat(p, '/')))"
    kept = F.expr(f"filter(blocks, b -> NOT coalesce({noisy}, false))")
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
