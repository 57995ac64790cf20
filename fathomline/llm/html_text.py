r"""Main text of web pages, with the templates of a site removed.

First pass: each page is parsed into its tree of elements, every element's subtree is hashed (tag, class, id, texts and
children), and Spark counts on how many pages of a host each hash occurs. Pages count once for each content: for a subtree
within an article that is the article's text, for others the text of the whole body, so that copies of a page make none of
it a template. Subtrees on at least `min_pages` such pages are the host's template, whatever its size. Hashes are joined by
(host, hash) with those of each page, so no list of a host is ever put together: a page's list has at most its own elements. Pages
are parsed once: what the second pass needs of them (texts with the subtrees that they are in) is written to the shared folder. A
page none of whose texts lie in a subtree that can be template counts like any other, but its text is settled at once.

Second pass: template subtrees are deleted; the main text is looked for in what is left: the article element (of several
the longest), else main, else the body. What a page says of itself to be beside the text goes too: navigation, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers. Ids of headings and text blocks never tell against them, nor does a class that only has such a word in it.

Inside an article plain text blocks that recur on a site, such as a licence line, are content and stay; other recurring
subtrees go. An article that recurs, such as a card that advertises another page, goes if its page has others.

Text: character references are decoded once in each text, white space inside a block (`<br>` included) becomes one space,
blocks are trimmed, empty ones go, and the others are joined in page order by an empty line.

Defined results: null html is empty and gives an empty text; broken markup is read as far as it goes (open elements end
with their parents, an unknown end tag is ignored, `<` that starts no tag is text), in linear time. A null or odd url has
the host ''. Rows that repeat have a row each, and count as one page. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, rows_of, table

MIN_PAGES = 5

#: A quoted value goes to its closing quote, however far; only a tag without one, or with a bare <, is read by the last form. This
#: takes linear time: nothing is tried twice within a tag, and tries that begin at different < are never in the same state at the same
#: place (outside quotes, in double, in single ones: each quote swaps two of these, and a bare < ends a try), so at most three pass any place.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd figcaption td th".split())
BLOCKS = TEXT_BLOCKS | frozenset(
    "html body head div article main section ul ol dl table tbody thead tfoot tr caption figure header footer nav aside form fieldset hr address details summary center dialog".split()
)
#: An open element of the key ends when one of the value begins.
ENDS = {"p": BLOCKS - {"td", "th", "tr"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}
for _h in "h1 h2 h3 h4 h5 h6".split():
    ENDS[_h] = frozenset({"p", "div", "article", "section", *"h1 h2 h3 h4 h5 h6".split()})
#: Ends of these reach no further out than the nearest of the value.
FENCES = {"li": frozenset({"ul", "ol"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"})}

ASIDE_TAGS = frozenset("script style noscript template iframe svg math head nav footer aside form button select textarea dialog input object canvas".split())
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs
    footer masthead comment comments disqus reply replies respond promo promotion sponsor sponsored newsletter subscribe subscription signup social share sharing
    related recommended popup modal widget toolbar pagination pager skip""".split()
)
#: Classes of several words that stand beside a text wherever they are, and ids of parts of a page.
ASIDE_CLASSES = ASIDE_WORDS | frozenset(
    """ad-slot ad-banner ad-container advert-box comment-list comments-area comments-section cookie-banner cookie-notice cookie-consent newsletter-signup page-header
    related-posts related-articles share-buttons share-bar site-footer site-header site-nav social-links social-share""".split()
)
ASIDE_IDS = frozenset("ads breadcrumbs comments cookie-banner cookie-notice disqus_thread footer header masthead menu nav navbar respond sidebar".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
KEPT_TAGS = frozenset("html body article main".split())


class Element:
    __slots__ = ("tag", "words", "id", "role", "hidden", "children", "hash", "size")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.words, self.id, self.role, self.hidden, self.children = tag, "", "", "", False, []
        if attributes.strip():
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "class":
                    self.words += f" {value.lower()}"
                elif name == "id":
                    self.id = value.lower()
                elif name == "role":
                    self.role = value.lower()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    self.hidden = True


#: Elements that an element of the key ends.
ENDED: dict[str, frozenset[str]] = {}
for _open, _by in ENDS.items():
    for _tag in _by:
        ENDED[_tag] = ENDED.get(_tag, frozenset()) | {_open}


class Stack:
    """The open elements. Where those of a tag are is kept in lists, so that looking for one does not walk the stack."""

    def __init__(self, root: Element):
        self.items = [root]
        self.places: dict[str, list[int]] = {}  # by tag; "#block" of all blocks, "#solid" of blocks that no start tag ends

    def kinds(self, tag: str) -> list[str]:
        return [tag, *(["#block"] if tag in BLOCKS else []), *(["#solid"] if tag in BLOCKS and tag not in ENDS else [])]

    def push(self, node: Element) -> None:
        for kind in self.kinds(node.tag):
            self.places.setdefault(kind, []).append(len(self.items))
        self.items.append(node)

    def innermost(self, *kinds: str) -> int:
        """Place of the innermost open element of these kinds, 0 if there is none."""
        return max((found[-1] for kind in kinds if (found := self.places.get(kind))), default=0)

    def cut(self, place: int) -> None:
        """End the element at this place and all within it."""
        while len(self.items) > place:
            for kind in self.kinds(self.items.pop().tag):
                self.places[kind].pop()

    def end(self, tag: str) -> None:
        """An end tag ends the innermost element of its tag, unless a fence (of an inline tag: any block) lies between."""
        place = self.innermost(tag)
        if place and place > self.innermost(*FENCES.get(tag, ()), *(["#block"] if tag not in BLOCKS else [])):
            self.cut(place)

    def make_way(self, tag: str) -> None:
        """A start tag ends the innermost element that can't hold it, unless a fence or a block that it can't end lies between."""
        place = self.innermost(*ENDED.get(tag, ()))
        if place and place > self.innermost("#solid", *FENCES.get(tag, ())):
            self.cut(place)


def parse(source: str) -> Element:
    root = Element("#root")
    stack, at, last = Stack(root), 0, len(source)
    while at < last:
        m = TAG.search(source, at)
        if m is None:
            stack.items[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack.items[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            stack.end(tag)
            continue
        stack.make_way(tag)
        node = Element(tag, m[3] or m[6] or "")
        stack.items[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = close.end() if close else last
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.push(node)
    return root


def in_post_order(root: Element):
    """Elements, children first, without recursion: markup may be nested to any depth."""
    todo = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            yield node
            continue
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children) if not isinstance(c, str))


def hash_subtrees(root: Element) -> None:
    """Sets hash and size (code points of text) of every element."""
    from xxhash import xxh64_intdigest

    for node in in_post_order(root):
        parts, size = [node.tag, node.words, node.id], 0
        for c in node.children:
            if isinstance(c, str):
                if c and not c.isspace():
                    parts.append(c.strip())
                    size += len(c)
            else:
                parts.append(f"\x00{c.hash:x}")
                size += c.size
        x = xxh64_intdigest("\x01".join(parts).encode("utf-8", "replace"))
        node.hash, node.size = (x - (1 << 64) if x >> 63 else x), size


def beside(node: Element, in_article: bool) -> bool:
    """Whether an element says of itself that it isn't part of the text.

    Classes count as a whole (`notice`, not `notice-period`); only outside of articles, and of elements that hold others, do their parts count. Ids count as a whole, and of
    a div only: those of headings and text blocks are made of the text."""
    if node.tag in KEPT_TAGS and not (node.tag == "article" and in_article):
        return False
    if node.tag in ASIDE_TAGS or node.hidden or node.role in ASIDE_ROLES or node.tag == "header" and not in_article:
        return True
    if node.tag == "div" and node.id in ASIDE_IDS and not (in_article and node.id == "header"):
        return True
    if node.words:
        if named_aside(node):
            return True
        if not in_article and node.tag in BLOCKS and node.tag not in TEXT_BLOCKS:
            parts = set(re.split(r"[\s_-]+", node.words))
            return bool(parts & ASIDE_WORDS) or "header" in parts
    return False


def named_aside(node: Element) -> bool:
    return bool(node.words) and not ASIDE_CLASSES.isdisjoint(node.words.split())


class Page:
    """What is needed of a page to delete templates and read its text, without its tree.

    Subtrees that can be part of a template are numbered: hashes, contents (hash of what a page is counted by), and parents (number of the next
    one around, or -1). Of each element that may hold the text: its rank (article, main, body), its owner (the innermost subtree
    around it or itself, -1 for none) and its parts, in order: text, number of the block, owner.
    """

    def __init__(self, root: Element):
        hash_subtrees(root)
        self.hashes: list[int] = []
        self.parents: list[int] = []
        tags = Counter(node.tag for node in in_post_order(root))
        self.holds = "article" if tags["article"] else "main" if tags["main"] else None
        numbers, owners, articles = self.number(root, tags["article"])
        self.holders = [(rank, owners.get(id(node), -1), parts_of(node, rank < 2, numbers, owners.get(id(node), -1))) for rank, node in self.candidates(root, numbers)]
        keys: dict[int | None, int] = {}
        for article in articles:
            if id(article) not in keys:
                keys[id(article)] = hashed(assemble(parts_of(article or root, article is not None, {}, -1)))
        self.contents = [keys[id(article)] for article in articles]

    def number(self, root: Element, n_articles: int) -> tuple[dict[int, int], dict[int, int], list]:
        """Numbers of the subtrees that can be template, owner of each element passed, and the article that each subtree is in.

        Never template: an element that holds an article (or, on a page without, main), and within one plain text blocks and all in them. An article is
        one if its page has others."""
        whole: set[int] = set()
        for node in in_post_order(root):
            if node.tag == self.holds or any(id(c) in whole for c in node.children if not isinstance(c, str)):
                whole.add(id(node))
        numbers, owners, articles, todo = {}, {}, [], [(root, None, -1)]
        while todo:
            node, article, owner = todo.pop()
            text = article is not None and (node.tag in TEXT_BLOCKS or node.tag not in BLOCKS)
            card = node.tag == "article" and (article is not None or n_articles > 1)
            if node.size and not text and (card or id(node) not in whole and node.tag not in KEPT_TAGS):
                numbers[id(node)] = len(self.hashes)
                self.hashes.append(node.hash)
                self.parents.append(owner)
                articles.append(article)
                owner = numbers[id(node)]
            owners[id(node)] = owner
            inside = node if article is None and node.tag == self.holds else article
            if not text:
                todo.extend((c, inside, owner) for c in reversed(node.children) if not isinstance(c, str))
        return numbers, owners, articles

    def candidates(self, root: Element, numbers: dict[int, int]) -> list[tuple[int, Element]]:
        """Elements that may hold the text, with their rank. One that no template can take makes those of lower rank needless."""
        found: list[list[Element]] = [[], [], []]
        todo = [(root, False)]
        while todo:
            node, in_main = todo.pop()
            rank = {"article": 0, "main": 1, "body": 2}.get(node.tag)
            if rank is not None and not (rank == 0 and named_aside(node)):
                if rank != 1 or not in_main:  # an inner main is part of the outer one
                    found[rank].append(node)
                if rank == 0:
                    continue
            if node.tag in ASIDE_TAGS and node.tag != "head" or node.hidden:
                continue
            todo.extend((c, in_main or rank == 1) for c in reversed(node.children) if not isinstance(c, str))
        out = []
        for rank, nodes in enumerate((found[0], found[1], found[2][:1] or [root])):
            out += [(rank, node) for node in nodes]
            if nodes and not any(id(node) in numbers for node in nodes):
                break
        return out

    def is_settled(self) -> bool:
        """Whether no text that the page may give lies in a subtree that can be template: its text is then the same whatever is deleted."""
        return len(self.holders) == 1 and self.holders[0][1] < 0 and all(owner < 0 for _, _, owner in self.holders[0][2])

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """The main text once the subtrees with these hashes are deleted: of the first rank that is left the longest, the earlier of equals."""
        return chosen_text(self.hashes, self.parents, self.holders, template)


def chosen_text(hashes: list[int], parents: list[int], holders: list, template: frozenset[int]) -> str:
    gone = []
    for x, parent in zip(hashes, parents, strict=True):  # parents come first
        gone.append(x in template or parent >= 0 and gone[parent])
    best = None
    for rank, owner, parts in holders:
        if owner < 0 or not gone[owner]:
            left = [p for p in parts if p[2] < 0 or not gone[p[2]]]
            size = sum(len(p[0]) for p in left)
            if best is None or rank == best[0] and size > best[1]:
                best = rank, size, left
    return assemble(best[2]) if best else ""


def hashed(text: str) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(text.encode("utf-8", "replace"))
    return x - (1 << 64) if x >> 63 else x


def assemble(parts: list) -> str:
    """Parts of a block joined, white space made one space; blocks that are not empty joined by an empty line."""
    blocks = (" ".join("".join(text for text, _, _ in some).split()) for _, some in groupby(parts, key=lambda p: p[1]))
    return "\n\n".join(b for b in blocks if b)


def parts_of(article: Element, real: bool, numbers: dict[int, int], owner: int) -> list[tuple[str, int, int]]:
    """The texts of an element without what is beside it: text, number of the block, owner."""
    parts: list[tuple[str, int, int]] = []
    block, todo = 0, [(article, owner)]
    while todo:
        node, owner = todo.pop()
        if node is None:
            block += 1
        elif isinstance(node, str):
            if node:
                parts.append((html.unescape(node), block, owner))
        elif node is not article and beside(node, real):
            block += node.tag in BLOCKS
        elif node.tag == "br":
            parts.append((" ", block, owner))
        else:
            owner = numbers.get(id(node), owner)
            if node.tag in BLOCKS or node is article:
                block += 1
                todo.append((None, owner))
            todo.extend((c, owner) for c in reversed(node.children))
    return parts


def page_hashes(source: str | None) -> list[tuple[int, int]]:
    """What can be template in a page: the different (hash, hash of the content that it is counted by)."""
    page = Page(parse(source or ""))
    return list(set(zip(page.hashes, page.contents, strict=True)))


def main_text(source: str | None, template: frozenset[int] = frozenset()) -> str:
    return Page(parse(source or "")).text(template)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


PARTS = "text string, hashes array<long>, contents array<long>, parents array<int>, holders array<struct<rank:int,owner:int,texts:array<string>,blocks:array<int>,owners:array<int>>>"


def parsed(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, host, html. Each with a uid and what Page holds, in place of the html; read once, and written to the shared folder.

    Settled pages have their text, the others their parents and holders, from which templates are still to be deleted."""

    def kernel(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        ints, holder = pa.list_(pa.int32()), pa.struct([("rank", pa.int32()), ("owner", pa.int32()), ("texts", pa.list_(pa.string())), ("blocks", pa.list_(pa.int32())), ("owners", pa.list_(pa.int32()))])
        for part, (_, _, _, sources) in rows_of(batches, 128):
            found = [Page(parse(s or "")) for s in sources]
            done = [p.is_settled() for p in found]
            columns = [
                pa.array(np.arange(uid, uid + len(found))), pa.array([p.text() if d else None for p, d in zip(found, done, strict=True)], pa.string()),
                pa.array([p.hashes for p in found], pa.list_(pa.int64())), pa.array([p.contents for p in found], pa.list_(pa.int64())),
                pa.array([None if d else p.parents for p, d in zip(found, done, strict=True)], ints), pa.array([None if d else held(p) for p, d in zip(found, done, strict=True)], pa.list_(holder)),
            ]
            uid += len(found)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["page_id", "url", "host", "uid", *[f.split()[0] for f in PARTS.split(", ")]])

    def held(page):
        lists = [(rank, owner, *(map(list, zip(*parts, strict=True)) if parts else ([], [], []))) for rank, owner, parts in page.holders]
        return [dict(zip(("rank", "owner", "texts", "blocks", "owners"), x, strict=True)) for x in lists]

    return materialize(pages.mapInArrow(kernel, f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, uid long, {PARTS}"), "parsed")


def page_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages as of parsed, all of which count. Returns uid and template, the hashes of template subtrees of that page, for pages that aren't settled and have any."""
    subtrees = pages.select(F.col("text").isNull().alias("open"), "uid", "host", F.explode(F.arrays_zip("hashes", "contents")).alias("s")).select("open", "uid", "host", F.col("s.hashes").alias("hash"), F.col("s.contents").alias("content"))
    each = subtrees.select("host", "hash", "content").distinct()
    frequent = materialize(each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "hash"), "frequent")
    return subtrees.where("open").select("uid", "host", "hash").join(frequent, ["host", "hash"]).groupBy("uid").agg(F.sort_array(F.collect_set("hash")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text."""
    url = F.col(url_col).cast("string")
    rows = parsed(pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col(html_col).cast("string").alias("html")))
    # Lists are hashed on their side of the join, so that pages need no sort.
    templates = materialize(page_templates(rows, min_pages), "templates")
    joined = rows.where("text is null").join(templates.hint("shuffle_hash"), "uid", "left").select("page_id", "url", "hashes", "parents", "holders", "template")

    def kernel(batches):
        import pyarrow as pa

        for part, (_, _, hashes, parents, holders, templates) in rows_of(batches, 128):
            texts = []
            for x, p, held, gone in zip(hashes, parents, holders, templates, strict=True):
                read = [(h["rank"], h["owner"], list(zip(h["texts"], h["blocks"], h["owners"], strict=True))) for h in held]
                texts.append(chosen_text(x, p, read, frozenset(gone or ())))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = joined.mapInArrow(kernel, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
    return rows.where("text is not null").select("page_id", "url", "text").unionByName(found)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
