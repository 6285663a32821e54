"""Main text of web pages by consensus paths of each host.

Every page scores its containers by the running text they hold and names the best one by its path: tags and classes from
the body down, numbers generalised. Spark counts these votes per host. Each page is then read again: its text comes from
the containers on the host's winning path, or from its own best container where a page has none or where they hold next
to nothing: less than SHARE of the weight of its own, or less than TEMPLATE_SHARE if its own is on a path that a tenth of
the host's pages, and two at least, vote for (another template of the host).

Votes are summed before they are shuffled, and the table of winners has one row a host; Spark broadcasts it where its
files are small, and splits hot hosts of a shuffled join otherwise. Pages themselves are never grouped.

Defined results: null or empty html gives an empty text; a page without running text too; a url without a host votes
under an empty host; repeated rows vote and are returned each; an empty table gives an empty one; extra columns don't
matter, since only page_id, url and html are read. Cut pages are read as far as they go; an unfinished tag is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import staged

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas textarea select title".split())
DROPPED = RAW | set("head nav footer aside form button dialog menu label fieldset".split())
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("body main article section div td center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class, id and role that mark what isn't the article.
BOILERPLATE = set(
    "ad ads advert advertisement adverts advertising alert alerts banner breadcrumb breadcrumbs byline comment comments consent "
    "contentinfo complementary cookie cookies dialog disqus footer form gdpr legal login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted promotion recommended related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Of these, the words that are subjects of articles too: an article's section with such an id is told by its text.
ORDINARY = set(
    "advertising alert alerts banner dialog form legal menu navigation notice notices notification promotion related reply search "
    "share sharing skip social subscription".split()
)
TITLES = set("h1 h2 h3 h4 h5 h6".split())
LONG = 80
#: Weight on the winning path, as a share of that of the page's own best container, below which the page's own is read.
SHARE = 0.025
TEMPLATE_SHARE = 0.25
#: A path is a template of its host from this share of the votes, and two votes.
TEMPLATE_VOTES = 0.1
WEIGHT = {"article": 1.6, "main": 1.3, "section": 1.0, "div": 1.0, "td": 0.8, "center": 0.8, "body": 0.7}
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    """An open or closed element: its path, whether it is dropped, and what its own blocks weigh.

    One in doubt has an id that may mark boilerplate, and is dropped at the end of the page unless it holds running text.
    """

    __slots__ = ("tag", "path", "parent", "dropped", "inside", "score", "linked", "doubt")

    def __init__(self, tag: str, path: str, parent: Node | None, dropped: bool, inside: bool):
        self.tag, self.path, self.parent, self.dropped, self.inside = tag, path, parent, dropped, inside
        self.score = self.linked = 0.0
        self.doubt: list[float] | None = None  # characters, those in links, long blocks


def _named(text: str) -> tuple[str, set[str], set[str], bool]:
    """(class for a path, words of class and role, words of the id, hidden) of an element's attributes."""
    if not text or ("=" not in text and "hidden" not in text):
        return "", set(), set(), False
    names, words, own, hidden = "", set(), set(), False
    for key, value in ATTRIBUTE.findall(text):
        key, value = key.lower(), value.strip("\"'")
        if key in ("hidden", "aria-hidden"):
            hidden |= value.lower() != "false"
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none", value))
        elif key == "id":
            own |= {w.lower() for w in WORDS.findall(value)}
        else:
            words |= {w.lower() for w in WORDS.findall(value)}
            if key == "class":
                names = ".".join(sorted({re.sub(r"\d+", "#", c.lower()) for c in value.split()}))
    return names, words, own, hidden


def _marks(tag: str, words: set[str], own: set[str], inside: bool) -> tuple[bool, bool]:
    """(boilerplate, in doubt) by the words of class and role and those of the id.

    The id of a heading is a slug of its text. In an article that holds for other ids too: there one counts only if all
    of it is in the list, never for a paragraph, and the element's text decides where the words are ordinary ones.
    """
    if tag in TITLES:
        own = set()
    if not inside:
        words = words | own
        return bool(words & BOILERPLATE) or "header" in words | {tag}, False
    if words & BOILERPLATE:
        return True, False
    marked = bool(own) and own <= BOILERPLATE and tag != "p"
    return marked and not own <= ORDINARY, marked and own <= ORDINARY


def _settle(blocks: list[tuple[Node, Node, str, int]], nodes: list[Node], doubtful: list[Node]) -> tuple[list, list]:
    """The blocks and containers left when elements in doubt that hold no running text are gone."""
    for top, _, text, links in blocks:
        above: Node | None = top
        while above is not None:
            if above.doubt is not None:
                above.doubt[0] += len(text)
                above.doubt[1] += links
                above.doubt[2] += len(text) > LONG and 2 * links < len(text)
            above = above.parent
    for n in doubtful:
        chars, links, long = n.doubt or (0, 0, 0)
        n.dropped = not long or 2 * links > chars

    def stays(n: Node | None) -> bool:
        while n is not None:
            if n.doubt is not None and n.dropped:
                return False
            n = n.parent
        return True

    return [b for b in blocks if stays(b[0])], [n for n in nodes if stays(n)]


def _weight(text: str, links: int) -> float:
    return max(0, len(text) - 2 * links) + (20 if len(text) > LONG else 0)


def blocks_of(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """((nearest container, text, characters in links) of each block in page order, all containers)."""
    root = Node("html", "", None, False, False)
    stack, nodes, found_blocks, doubtful = [root], [], [], []
    parts: list[str] = []
    link_chars = 0
    in_link = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split()) if parts else ""
        parts.clear()
        if text:
            top = stack[-1]
            if not top.dropped:
                holder = top
                while holder.tag not in CONTAINERS and holder.parent is not None:
                    holder = holder.parent
                found_blocks.append((top, holder, text, link_chars))
        link_chars = 0

    at, end = 0, len(page)
    while at < end:
        open_at = page.find("<", at)
        if open_at < 0:
            open_at = end
        if open_at > at and not stack[-1].dropped:
            text = entities.unescape(page[at:open_at])
            parts.append(text)
            if in_link:
                link_chars += len(text)
        if open_at == end:
            break
        found = TAG.match(page, open_at)
        if found is None:
            if open_at + 1 < end and not stack[-1].dropped and page[open_at + 1] != "/":
                parts.append("<")
            at = open_at + 1
            if at < end and page[at] == "/":  # </ without a name is a comment
                close = page.find(">", at)
                at = end if close < 0 else close + 1
            continue
        at = found.end()
        if found[2] is None and (found[5] is None or page[at - 1] != ">"):
            continue  # a comment, or a tag that the end of the page cuts
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if any(n.tag == tag for n in stack[1:]):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "a":
            in_link += 1
        if tag in BLOCKS:
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()) or stack[-1].tag not in BLOCKS | DROPPED):
                stack.pop()
            in_link = 0 if tag != "a" else in_link
        elif tag not in DROPPED:
            continue  # inline markup neither holds nor ends a block
        top = stack[-1]
        names, words, own, hidden = _named(attributes)
        marked, doubt = _marks(tag, words, own, top.inside)
        dropped = top.dropped or hidden or tag in DROPPED or (marked and tag not in ("html", "body", "article", "main"))
        path = f"{top.path}>{tag}{'.' + names if names else ''}" if tag in CONTAINERS else top.path
        node = Node(tag, path, top, dropped, top.inside or tag in ("article", "main"))
        stack.append(node)
        if doubt and not dropped and tag not in ("html", "body", "article", "main"):
            node.doubt = [0, 0, 0]
            doubtful.append(node)
        if tag in CONTAINERS and not dropped:
            nodes.append(node)
    flush()
    if doubtful:
        found_blocks, nodes = _settle(found_blocks, nodes, doubtful)
    for _, holder, text, links in found_blocks:
        weight = _weight(text, links)
        holder.score += weight
        holder.linked += links
        above = holder.parent
        while above is not None and above.tag not in CONTAINERS:
            above = above.parent
        if above is not None:
            above.score += weight / 2
    return [x[1:] for x in found_blocks], nodes


def _best(nodes: list[Node]) -> tuple[str, float] | None:
    scored = [(n.score * WEIGHT.get(n.tag, 1.0), n.path) for n in nodes if n.score > 0]
    if not scored:
        return None
    score, path = max(scored, key=lambda x: (x[0], -len(x[1]), x[1]))
    return path, score


def best_path(page: str | None) -> tuple[str, float] | None:
    """(path, score) of the container that holds most running text."""
    return _best(blocks_of(page or "")[1])


def text_at(page: str | None, path: str | None, templates: Sequence[str] | None = None) -> str:
    """The blocks below the containers on ``path``; without one of them, or where they weigh too little, below the page's
    own best container. ``templates`` are the host's other paths."""
    blocks, nodes = blocks_of(page or "")
    own = _best(nodes)

    def below(path: str | None) -> tuple[list[str], float]:
        texts, weight = [], 0.0
        for holder, text, links in blocks:
            above: Node | None = holder
            while above is not None and not (above.path == path and above.tag in CONTAINERS):
                above = above.parent
            if above is not None:
                texts.append(text)
                weight += _weight(text, links)
        return texts, weight

    texts, weight = below(path)
    if own is not None and own[0] != path:
        other, most = below(own[0])
        share = TEMPLATE_SHARE if templates is not None and own[0] in templates else SHARE
        if path is None or not any(n.path == path for n in nodes) or weight < share * most:
            texts = other
    return "\n\n".join(texts)


def host_of(url: Column) -> Column:
    """Host in lower case, without port; empty where there is none."""
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes, templates): the path most pages of a host vote for; ties go to the higher score, then the name.
    The templates are its other paths with enough votes, nine at most."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [best_path(x) for x in b.html]
            yield pd.DataFrame({
                "host": b.host, "path": [x and x[0] for x in found], "score": [x[1] if x else None for x in found],
            })

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = votes.mapInPandas(vote, "host string, path string, score double").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.floor("score")).alias("score"))
    best_first = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    ranked = counted.withColumn("_n", F.row_number().over(best_first))
    ranked = ranked.withColumn("_all", F.sum("votes").over(Window.partitionBy("host")))
    template = (F.col("votes") >= 2) & (F.col("votes") >= TEMPLATE_VOTES * F.col("_all"))
    first = F.col("_n") == 1
    return ranked.filter(first | template).groupBy("host").agg(
        F.max(F.when(first, F.col("path"))).alias("path"),
        F.max(F.when(first, F.col("votes"))).alias("votes"),
        F.collect_list(F.when(~first, F.col("path"))).alias("templates"),
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every page."""
    winners = staged(winning_paths(pages), "page-paths").select("host", "path", "templates")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, path, templates in batches:
            yield pd.Series([text_at(*x) for x in zip(page, path, templates, strict=True)], dtype=object)

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    texts = rows.join(winners, "host", "left").withColumn("text", read("html", "path", "templates"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
