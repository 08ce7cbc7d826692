"""Main text of web pages by container paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongraph.llm.common import parts
from sessiongraph.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of HTML: elements without content, with unparsed content, and those that open a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Elements an open <p> ends before, and those that end an open element of the same group.
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl menu table div article section body td th main select".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
# Never part of the main text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer frameset head header iframe input menu nav "
    "noembed noframes noscript object script select style svg template textarea title video xmp".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer footer form header hidden masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("advert comment comments promo related replies reply sponsored".split())
# Names of what is no main text however long it is, unless it holds the marks of the main text.
STRICT_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advertisement adverts consent cookie cookies newsletter popup promoted promotion respond sponsor".split()
)
FORM = "<form>"
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())

HEADINGS = frozenset("h1 h2".split())
# A container's own text is running text if one of its blocks has so many characters, or half of the page's longest.
RUNNING = 80

KEPT_PATHS = 3
# A voted path is taken where it scores at least this share of the page's best container.
NEAR = 0.25
# Rows of (host, up to three paths): some ten MB at most.
BROADCAST_HOSTS = 100_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
# Only these attributes matter.
_NAMED = re.compile(r"class|id|role|hidden", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """An open element; `names` are its own and its parents' names with words of what is dropped."""

    tag: str
    path: str
    dropped: bool
    names: frozenset[str] = frozenset()


@dataclass
class Block:
    """A run of text between block borders, with the paths of the containers around it."""

    text: str
    paths: tuple[str, ...]
    linked: int = 0
    names: frozenset[str] = frozenset()
    heading: bool = False
    marked: bool = False

    @property
    def gain(self) -> int:
        return len(self.text) - 2 * min(self.linked, len(self.text))


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes of a container with runs of digits generalised."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def _is_dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    return attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes


def _names(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()


def _dropped_names(tag: str, attributes: dict[str, str]) -> list[str]:
    """Classes and ids with a word of what is dropped; `decide` tells whether they name the layout instead."""
    if tag == "form":
        return [FORM]
    if not attributes or tag in ("html", "body"):
        return []
    words = COMMENT_WORDS if tag in ("article", "main") else DROPPED_WORDS
    # "has-sidebar" and the like tell what is next to the content.
    names = [n for n in _names(attributes) if not n.startswith(("has-", "with-", "no-", "is-"))]
    return [n for n in names if not words.isdisjoint(_WORD.findall(n))]


def decide(blocks: list[Block], marks: list[frozenset[str]]) -> list[Block]:
    """The blocks that stay. A name drops its elements, unless these together hold most of the page's text.

    Names of comments, adverts and forms must also hold most of the `marks` (names around the first article, main
    elements and main headings), and their text does not count for the others. A page that would lose all its text
    keeps that of names which are not strict, or else all but forms.
    """
    held = {name for block in blocks for name in block.names}
    if not held:
        return blocks
    strict = {n for n in held if n == FORM or not STRICT_WORDS.isdisjoint(_WORD.findall(n))}
    never = {n for n in strict if 2 * sum(n in names for names in marks) <= len(marks)}
    total = 0
    sizes = dict.fromkeys(held, 0)
    for block in blocks:
        if never.isdisjoint(block.names):
            size = max(0, len(block.text) - block.linked)
            total += size
            for name in block.names:
                sizes[name] += size
    dropping = {n for n in held if n in never or 2 * sizes[n] <= total}
    for names in (dropping, never, {FORM}):
        kept = [block for block in blocks if names.isdisjoint(block.names)]
        if kept:
            return kept
    return []


def score(blocks: list[Block]) -> dict[str, float]:
    """A score for each container path: all text below it against the boilerplate below it.

    Linked text is boilerplate, and so is text of containers without running text or a main heading. If `article` and
    `main` elements hold most of the running text, all outside them is boilerplate too.
    """
    longest = max((len(b.text) - b.linked for b in blocks), default=0)
    running = {b.paths[-1:] for b in blocks if len(b.text) - b.linked >= min(RUNNING, max(1, longest / 2))}
    gains = [
        b.gain if b.gain < 0 or b.heading or b.paths[-1:] in running else -float(len(b.text)) for b in blocks
    ]
    positive = sum(g for g in gains if g > 0)
    marked = 2 * sum(g for g, b in zip(gains, blocks, strict=True) if g > 0 and b.marked) > positive
    scores: dict[str, float] = {}
    for gain, block in zip(gains, blocks, strict=True):
        if marked and not block.marked:
            gain = -abs(gain)
        for path in set(block.paths):
            scores[path] = scores.get(path, 0.0) + gain
    return scores


def parse(source: str) -> Page:
    """Blocks of text that are not dropped, in page order, and a score for each container path.

    Tolerant: unclosed elements end with their parents, stray end tags are ignored, a page may stop anywhere.
    """
    blocks: list[Block] = []
    marks: list[frozenset[str]] = []
    articles = 0
    stack = [Node("", "", False)]
    chunks: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if chunks:
            text = " ".join("".join(chunks).split())
            chunks.clear()
            if text:
                block = Block(text, tuple(n.path for n in stack if n.tag in CONTAINERS), linked, stack[-1].names)
                block.heading = any(n.tag in HEADINGS for n in stack)
                block.marked = any(n.tag in ("article", "main") for n in stack)
                blocks.append(block)
        linked = 0

    def close(depth: int) -> None:
        if chunks and any(n.tag in BLOCKS for n in stack[depth:]):
            end_block()
        del stack[depth:]

    def add(chunk: str) -> None:
        nonlocal linked
        if chunk and not stack[-1].dropped:
            chunks.append(html.unescape(chunk) if "&" in chunk else chunk)
            if stack[-1].tag == "a" or stack[-2:-1] and stack[-2].tag == "a":
                linked += len(chunk.strip())

    position = 0
    while True:
        found = _MARKUP.search(source, position)
        if found is None:
            add(source[position:])
            break
        add(source[position : found.start()])
        position = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in SCOPES and tag not in SCOPES and tag not in ("body", "html"):
                    break
            continue
        attributes = _attributes(found[3]) if _NAMED.search(found[3]) else {}
        if tag in ENDS_PARAGRAPH:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        if tag in SIBLINGS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SIBLINGS[tag]:
                    close(depth)
                    break
                if stack[depth].tag in SCOPES and stack[depth].tag not in ("td", "th"):
                    break
        if stack[-1].dropped:
            pass
        elif tag in BLOCKS:
            end_block()
        elif tag == "br":
            chunks.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, position)
            position = end.end() if end else len(source)
            continue
        if stack[-1].dropped:
            stack.append(Node(tag, stack[-1].path, True))
            continue
        # An article's own header holds its title, a button inside a paragraph is a word of it.
        kept_here = tag == "header" and any(n.tag == "article" for n in stack)
        kept_here = kept_here or tag == "button" and any(n.tag == "p" for n in stack)
        dropped = _is_dropped("" if kept_here else tag, attributes)
        path = stack[-1].path
        if tag in CONTAINERS:
            path = f"{path}>{_step(tag, attributes)}" if path else _step(tag, attributes)
        names = stack[-1].names
        if not dropped and (found_names := _dropped_names(tag, attributes)):
            end_block()
            names = names.union(found_names)
        if tag in ("h1", "main") and not dropped:
            marks.append(names)
        elif tag == "article" and not dropped and not articles:
            # A comment's own article is no mark; "post comments-open" is one.
            others = [w for n in _names(attributes) if n not in names for w in _WORD.findall(n)]
            if not found_names or not GOOD_WORDS.isdisjoint(others):
                articles += 1
                marks.append(names)
        stack.append(Node(tag, path, dropped, names))
    end_block()
    kept = decide(blocks, marks)
    return Page(kept, score(kept))


def best_path(page: Page) -> str | None:
    """The container path with the highest score; if equal the innermost, then the first by name."""
    return min(page.scores, key=lambda path: (-page.scores[path], -path.count(">"), path), default=None)


def host_of(url):
    """The lower-cased host of a URL without `www.`; null and unreadable URLs share the host ''."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def page_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, best container path and its score of every page."""
    for batch in batches:
        for part in parts(batch, column=2):
            best, weights, scores, blocks = [], [], [], []
            for source in part.column(2).to_pylist():
                page = parse(source) if source else Page()
                path = best_path(page)
                best.append(path)
                weights.append(int(page.scores[path]) if path is not None else None)
                scores.append(list(page.scores.items()))
                blocks.append([{"text": block.text, "paths": block.paths} for block in page.blocks])
            kind = pa.list_(pa.struct([("text", pa.string()), ("paths", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(best, type=pa.string()),
                    pa.array(weights, type=pa.int64()),
                    pa.array(scores, type=pa.map_(pa.string(), pa.float64())),
                    pa.array(blocks, type=kind),
                ],
                names=["page_id", "url", "best", "weight", "scores", "blocks"],
            )


def host_paths(read: DataFrame, keep: int = KEPT_PATHS) -> DataFrame:
    """(host, paths): the `keep` container paths with the most votes of each host, one vote a page; ties go to the
    higher total score, then by name."""
    votes = read.where("best is not null").groupBy("host", "best")
    totals = votes.agg(F.count("*").alias("votes"), F.sum("weight").alias("weight"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("weight"), "best")
    ranked = totals.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep)
    return ranked.groupBy("host").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_place", "best"))), lambda r: r["best"]).alias("voted")
    )


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    1. Every page is parsed once, in Python: blocks of text with the container paths (tags and classes, digits
       generalised) around them, stored in the shared folder. It votes for the path that
       scores highest, all text below it against the boilerplate below it: the smallest container of the whole article.
    2. Votes are counted per host in Spark, combined per task first: a hot host is a few rows per task.
    3. A page's text is that of its blocks inside the most voted path that scores at least `NEAR` of what the page's
       own best container does, taken from the stored blocks. A page without such a path, as one of a rarer layout of
       its host, falls back on its own best container.

    Menus, headers, footers, asides, scripts and the like are dropped by element or role wherever they are, forms,
    adverts, sidebars, notices, comments and the like also by class or id, unless what bears the name holds most of
    the page's text (see `decide`). The header of an article stays, and inline elements that are dropped do not cut
    their block. Text is unescaped, white space inside a block is one space,
    blocks are joined by a newline. Null, empty and textless pages give an empty text; rows with a null or
    unreadable url vote as one host; repeated rows are kept; other columns are not read. The paths are
    broadcast if they are at most `BROADCAST_HOSTS` rows, else joined by a shuffle.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).alias("html"),
    )
    schema = (
        "page_id long, url string, best string, weight long, scores map<string, double>, "
        "blocks array<struct<text:string,paths:array<string>>>"
    )
    read = materialize(rows.mapInArrow(page_reader, schema).withColumn("host", host_of(F.col("url"))), "page_blocks")
    voted = materialize(host_paths(read.select("host", "best", "weight")), "host_paths")
    if voted.count() <= BROADCAST_HOSTS:
        voted = F.broadcast(voted)
    enough = F.col("weight") - (1 - NEAR) * F.abs("weight")
    fitting = F.filter("voted", lambda p: F.coalesce(F.try_element_at("scores", p) >= enough, F.lit(False)))
    chosen = F.coalesce(F.get(fitting, F.lit(0)), "best")
    inside = F.filter(
        "blocks", lambda b: F.col("_chosen").isNull() | F.coalesce(F.array_contains(b["paths"], F.col("_chosen")), F.lit(False))
    )
    return (
        read.join(voted, "host", "left")
        .withColumn("_chosen", chosen)
        .withColumn("text", F.array_join(F.transform(inside, lambda b: b["text"]), "\n"))
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    )
