"""Main text of web pages by equivalence classes of same-host pages.

The tokens of a page are its tags and its blocks of text, told apart by the containers around them. Over the pages of a
host each token has an occurrence vector: how often it stands in each page. Tokens with one vector
are an equivalence class (Arasu and Garcia-Molina 2003). Classes of enough tokens that stand in nearly all pages are checked:

- order: by their first places in a page, their tags have the same ranks in nearly all pages; tags that don't are left out;
- nesting: they stand in one slot of the classes around them; tokens that stand in another container than most of
  their class do not belong to it.

Valid classes nest into the host's template. What it leaves open are slots, the texts that differ by page. Blocks of text that are tokens of the
template themselves, such as a notice that every article repeats, are none of the text. Of the slots, those inside
an article or main container of the template count if it has one, otherwise all that vary and are not mostly links. Names and tags only
say what a slot is for: one inside navigation, notices, forms, comments and the like is none of the text.

Only sums by host and token are shuffled, and a host's template is no longer than a page, however many pages it has.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, written

#: Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button", "object", "canvas", "math")
CONTAINERS = ("html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "details", "dialog", "fieldset")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "caption", "blockquote", "pre", "hr", "address", "figcaption", "summary", "legend", "thead", "tbody", "tfoot")
#: Containers that never hold the text, by tag and by word of their class, id or role; a header inside an article belongs to it.
ASIDE_TAGS = ("head", "nav", "header", "footer", "aside", "form", "dialog", "fieldset")
COMMENT_WORDS = ("comment", "comments", "disqus", "replies", "respond")
ASIDE_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "consent", "contentinfo", "cookie", "cookies", "footer", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "recommended", "related", "search", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "toc", "toolbar", "widget",
)
MAIN_TAGS, MAIN_WORDS = ("article", "main"), ("article", "main")
#: Share of a host's pages in which a template's classes stand and are in order; share of link characters from which a slot is a menu.
TEMPLATE_SHARE, MENU_SHARE = 0.9, 0.6
#: Pages of a host that has a template, and tokens of a class, at least.
LEAST_PAGES, LEAST_TOKENS = 5, 2

# Quotes belong to a value only behind an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in RAW}
_CONTAINERS, _BLOCKS, _RAW = frozenset(CONTAINERS), frozenset(BLOCKS) | frozenset(CONTAINERS), frozenset(RAW)
_DIGITS = re.compile(r"\d+")


def _hash(text: str, around: int) -> int:
    """A signed hash of 64 bits of a token inside a container."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), around & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def _names(attributes: str) -> list[str]:
    """The words of class, id and role in lower case, sorted."""
    found = {w for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role") for w in v.strip("\"'").lower().split()} if "=" in attributes else ()
    return sorted(found)


class Page:
    """The containers, tags and blocks of text of a page.

    Only containers nest, so tags that are never closed do no harm. A token of a tag is its hash with its names, in which all numbers are the
    same (ids differ by page), and with the containers around it; that of a block is the hash of its text with the containers.
    """

    def __init__(self, html: str | None):
        #: Of every container its parent's number, tag, names and token; number 0 is the page.
        self.parents, self.tags, self.names, self.tokens = [-1], [""], [[]], [0]
        #: (token, container) of every tag in order; (text, container, characters in links) of every block.
        self.marks: list[tuple[int, int]] = []
        self.blocks: list[tuple[str, int, int]] = []
        self._read(html or "")

    def _read(self, page: str) -> None:
        stack, held, at, link, link_chars, block_in = [0], [], 0, False, 0, 0

        def close() -> None:
            nonlocal link_chars
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text:
                    self.blocks.append((text, block_in, min(link_chars, len(text))))
                held.clear()
            link_chars = 0

        while at < len(page):
            m = _TOKEN.search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                if not held:
                    block_in = stack[-1]
                held.append(text)
                link_chars += len(text) * link
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link = False
                if tag in _BLOCKS:
                    close()
                if tag in _CONTAINERS and any(self.tags[i] == tag for i in stack):
                    while self.tags[stack.pop()] != tag:
                        pass
                    link = False
                continue
            names = _names(m[3])
            if tag in _BLOCKS:
                close()
                link = False
            around = stack[-1]
            token = _hash(_DIGITS.sub("#", " ".join([tag, *names])), self.tokens[around])
            self.marks.append((token, around))
            if tag in _CONTAINERS:
                stack.append(len(self.parents))
                for kept, x in zip((self.parents, self.tags, self.names, self.tokens), (around, tag, names, token)):
                    kept.append(x)
            elif tag == "a":
                link = True
            elif tag == "br":
                held.append(" ")
            if tag in _RAW and not (tag in ("svg", "math") and m[3].rstrip().endswith("/")):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
        close()

    @property
    def aside(self) -> list[bool]:
        """For every container whether it is inside one that never holds the text."""
        return self._roles[0]

    @property
    def main(self) -> list[bool]:
        """For every container whether it is inside an article or main one."""
        return self._roles[1]

    @cached_property
    def _roles(self) -> tuple[list[bool], list[bool]]:
        n = len(self.parents)
        is_main = [t in MAIN_TAGS or any(w in MAIN_WORDS for w in names) for t, names in zip(self.tags, self.names)]
        holds_main = list(is_main)
        for i in range(n - 1, 0, -1):
            holds_main[self.parents[i]] = holds_main[self.parents[i]] or holds_main[i]
        aside, main = [False] * n, [False] * n
        for i in range(1, n):
            up, tag = self.parents[i], self.tags[i]
            words = {w for x in self.names[i] for w in re.split(r"[-_]+", x)}
            comment = any(w in COMMENT_WORDS for w in words)
            by_tag = tag in ASIDE_TAGS and not (tag == "header" and main[up])
            # A name doesn't count on what holds the article, or is it.
            by_name = not holds_main[i] and any(w in ASIDE_WORDS for w in words)
            main[i] = main[up] or is_main[i]
            aside[i] = aside[up] or by_tag or (tag not in ("html", "body", "main") and ((comment and not (holds_main[i] and not is_main[i])) or by_name))
        return aside, main

    def block_token(self, text: str, container: int) -> int:
        return _hash(text, ~self.tokens[container])


TOKENS = T.StructType([
    T.StructField("tokens", T.ArrayType(T.StructType([
        T.StructField("token", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("is_text", T.BooleanType()), T.StructField("is_main", T.BooleanType()),
        T.StructField("times", T.IntegerType()), T.StructField("chars", T.LongType()), T.StructField("link_chars", T.LongType()), T.StructField("state", T.LongType()),
    ]))),
])


def occurrences(html: str | None) -> list[tuple[int, int, bool, bool, int, int, int, int]]:
    """(token, parent, is_text, is_main, times, chars, link_chars, state) of a page's tokens.

    Characters are those of the text directly in a container. The state differs where what the token holds does: for a container a hash of its text, for
    a block of text one of all text of the page that isn't in an aside.
    """
    page = Page(html)
    tags: dict[int, list] = {}
    for token, around in page.marks:
        tags.setdefault(token, [page.tokens[around], False, False, 0, 0, 0, 0])[3] += 1
    texts: dict[int, list] = {}
    everything = 0
    for text, container, links in page.blocks:
        token, own = page.block_token(text, container), _hash(text, 0)
        everything += 0 if page.aside[container] else own
        texts.setdefault(token, [page.tokens[container], True, page.main[container], 0, len(text), links, 0])[3] += 1
        held = tags.get(page.tokens[container])
        if held is not None:
            held[4], held[5], held[6] = held[4] + len(text), held[5] + links, held[6] * 31 + own
    for i, token in enumerate(page.tokens):
        if i and page.main[i] and not page.aside[i]:
            tags[token][2] = True
    low = lambda x: (x & (1 << 63) - 1)
    out = [(k, *x[:6], low(x[6])) for k, x in tags.items()]
    return out + [(k, *x[:6], low(everything)) for k, x in texts.items()]


def token_order(html: str | None) -> list[int]:
    """The tokens of a page's tags in order of their first place."""
    return list(dict.fromkeys(token for token, _ in Page(html).marks))


@F.pandas_udf(TOKENS)
def page_tokens(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tokens": [occurrences(x) for x in pages]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def page_order(pages: pd.Series) -> pd.Series:
    return pd.Series([token_order(x) for x in pages], dtype=object)


def host_of(url: Column) -> Column:
    """The host of a URL; '' for null or none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(ex_host, token, signature, parent, is_text, is_main, n_pages, chars, link_chars, varies): the tokens that stand in nearly all pages of their host.

    The signature stands for the occurrence vector: the sums of both halves of a hash of (page, times), which can be taken in parts, and in which a page that is there twice counts
    twice. Tokens with equal signatures are one class.
    Only classes of ``LEAST_TOKENS`` or more, of hosts with ``LEAST_PAGES`` or more, are here.
    """
    found = page_tokens.asNondeterministic()  # else a filter for empty arrays would run it once more
    rows = pages.select("ex_host", "ex_page", found("html").alias("x")).select("ex_host", "ex_page", F.explode("x.tokens").alias("t")).select("ex_host", "ex_page", "t.*")
    of_page = F.xxhash64("ex_page", "times")
    signature = F.xxhash64(F.sum(F.shiftright(of_page, 32)), F.sum(of_page.bitwiseAND(0xFFFFFFFF)))
    tokens = rows.groupBy("ex_host", "token").agg(
        signature.alias("signature"), F.min("parent").alias("parent"), F.max("is_text").alias("is_text"), F.max("is_main").alias("is_main"),
        F.count(F.lit(1)).alias("n_pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), (F.min("state") < F.max("state")).alias("varies"),
    )
    hosts = pages.groupBy("ex_host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    common = tokens.join(hosts, "ex_host").where(F.col("n_pages") >= F.lit(TEMPLATE_SHARE) * F.col("host_pages")).drop("host_pages")
    common = written(common, "page-tokens")  # what follows reads it several times
    large = common.groupBy("ex_host", "signature").agg(F.count(F.lit(1)).alias("n_tokens")).where(F.col("n_tokens") >= LEAST_TOKENS).drop("n_tokens")
    return common.join(large, ["ex_host", "signature"])


def nested(classes: DataFrame) -> DataFrame:
    """The tokens of ``classes`` whose container is of their own class, or is the one outside of it in which most of the class stands."""
    own = classes.select("ex_host", "signature", F.col("token").alias("parent"), F.lit(True).alias("inside"))
    placed = classes.join(own, ["ex_host", "signature", "parent"], "left")
    outside = placed.where("inside is null").groupBy("ex_host", "signature", "parent").agg(F.count(F.lit(1)).alias("n"))
    slot = outside.groupBy("ex_host", "signature").agg(F.max_by("parent", F.struct("n", "parent")).alias("slot"))
    return placed.join(slot, ["ex_host", "signature"], "left").where("inside or parent = slot").drop("inside", "slot")


def ordered(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """(ex_host, token): the tags that, by their first places, have one rank among the tags of their class in nearly all pages.

    Pages with the same tags in the same order are one row; of these there are few for each host.
    """
    kinds = pages.select("ex_host", page_order.asNondeterministic()("html").alias("order")).groupBy("ex_host", "order").agg(F.count(F.lit(1)).alias("n"))
    rows = kinds.select("ex_host", "n", F.xxhash64("order").alias("kind"), F.posexplode("order").alias("place", "token"))
    mine = rows.join(classes.where("not is_text").select("ex_host", "token", "signature"), ["ex_host", "token"])
    ranks = mine.groupBy("ex_host", "signature", "kind").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("x"))
    ranks = ranks.select("ex_host", "n", F.posexplode("x").alias("rank", "x")).groupBy("ex_host", F.col("x.token").alias("token"), "rank").agg(F.sum("n").alias("n"))
    best = ranks.groupBy("ex_host", "token").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.where(F.col("most") >= F.lit(TEMPLATE_SHARE) * F.col("all")).select("ex_host", "token")


def template(pages: DataFrame) -> DataFrame:
    """The valid tokens of every host's classes, as ``equivalence_classes`` has them. A text goes with the tags of its class that are out of order if it stands directly in one."""
    classes = written(nested(equivalence_classes(pages)), "page-classes")
    good = ordered(pages, classes)
    tags = classes.where("not is_text").join(good, ["ex_host", "token"], "left_semi")
    bad = classes.where("not is_text").join(good, ["ex_host", "token"], "left_anti").select("ex_host", F.col("token").alias("parent"))
    return tags.unionByName(classes.where("is_text").join(bad, ["ex_host", "parent"], "left_anti"))


def host_slots(tokens: DataFrame) -> DataFrame:
    """(ex_host, ex_main, ex_closed): whether a template has an article or main container, and its tokens that are no slots: texts, and containers that don't vary or are menus.

    A text that stands only in copies of one page is none of the template.
    """
    menu = F.col("link_chars") > F.lit(MENU_SHARE) * F.col("chars")
    closed = F.when(F.col("is_text"), F.col("varies")).otherwise((F.col("chars") > 0) & (menu | ~F.col("varies")))
    return tokens.groupBy("ex_host").agg(F.max(F.col("is_main") & ~F.col("is_text")).alias("ex_main"), F.collect_list(F.when(closed, F.col("token"))).alias("ex_closed"))


def main_text(html: str | None, has_main: bool | None, closed: frozenset[int]) -> str:
    """The blocks of the text in the page's slots; has_main is None for a host without a template, whose pages go by themselves."""
    page = Page(html)
    blocks = [(text, container, links) for text, container, links in page.blocks if not page.aside[container]]
    if has_main is not False and any(page.main[c] for _, c, _ in blocks):
        blocks = [x for x in blocks if page.main[x[1]]]
    elif has_main is None:
        chars, link_chars = [0] * len(page.parents), [0] * len(page.parents)
        for text, c, links in blocks:
            chars[c] += len(text)
            link_chars[c] += links
        blocks = [x for x in blocks if link_chars[x[1]] <= MENU_SHARE * chars[x[1]]]
    else:
        blocks = [x for x in blocks if page.tokens[x[1]] not in closed]
    own = [text for text, c, _ in blocks if page.block_token(text, c) not in closed]
    # A template holds less text than its slots; where it doesn't, pages are near copies of each other.
    if 2 * sum(map(len, own)) < sum(len(text) for text, _, _ in blocks):
        own = [text for text, _, _ in blocks]
    return "\n\n".join(own)


@F.pandas_udf(T.StringType())
def slot_text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, mains, closed in batches:
        yield pd.Series([main_text(p, None if m is None else bool(m), frozenset(() if c is None else c)) for p, m, c in zip(pages, mains.astype(object).where(mains.notna(), None), closed)], dtype=object)


def extract_text(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` with ex_text, '' where there is none.

    A null html is empty; pages with a null URL, or one without a host, form one host of their own. Pages of a host with fewer than ``LEAST_PAGES`` go by their own
    tags. Repeated rows count each. An empty table gives an empty
    result. Columns whose names begin with ``ex_`` are replaced; all others pass through.
    """
    pages = pages.select([c for c in pages.columns if not c.startswith("ex_")])
    keyed = pages.withColumn("ex_host", host_of(F.col("url")))
    slots = host_slots(template(keyed.select("ex_host", F.xxhash64("page_id", "url").alias("ex_page"), "html")))
    # A row a host, no longer than a page: where all fit Spark broadcasts them, otherwise it splits the pages of a large host.
    return keyed.join(slots, "ex_host", "left").withColumn("ex_text", slot_text("html", "ex_main", "ex_closed")).drop("ex_host", "ex_main", "ex_closed")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.col("ex_text").alias("text"), F.char_length("ex_text").cast("long").alias("n_chars"))
