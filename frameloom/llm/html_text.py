"""Main text of HTML pages, with site templates removed by subtree hashes.

A page is parsed into a tree. Every element's subtree is hashed (tag, class, id, and what it holds) and the hashes are counted over the
pages of each host in Spark. Subtrees that recur on many pages of their host are template and are deleted, the outermost whole.
The article itself is never taken for template, nor are its paragraphs, headings, quotes and listings: they may recur (copies of a page, licence
lines) and are text all the same. Inside it only containers (``CONTAINERS``) are counted, over pages of different main text: pages with one
longest block count once, so that copies and near copies of a page don't make template of what they share. What is a menu, header, footer, sidebar, notice, advert, form, comment or code by its element, role or class goes as well.

Results: a null or empty page, or one without text, gives the empty string. Malformed markup is read as browsers do it: unclosed
elements end with their parent, a block ends an open paragraph, stray end tags are skipped. Repeated rows count as pages of their own and each
get their text. A null url is the host "".
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import map_rows, materialise

#: A subtree is template if it recurs on at least so many pages of its host, and on at least this share of them; outside the main text,
#: twice the root of the number of pages is enough, which is less than that share on hosts of over 100 pages.
LEAST_PAGES, LEAST_SHARE = 4, 0.2
#: Template hashes that may be broadcast; more are joined in a shuffle.
BROADCAST_ROWS = 200_000

# a quote is one only after an equals sign, so that apostrophes in bare values are plain characters
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split())
#: What an opening tag closes, up to the nearest of the elements that hold it.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that can be template inside the main text.
CONTAINERS = frozenset("div section ul ol dl table figure details center article header".split())
GONE = frozenset("nav footer aside form script style noscript template iframe svg math button select option textarea input head title object embed canvas audio video dialog menu datalist label fieldset map applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CLASSES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner banners promo promotion promoted sponsor sponsored sponsors
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall
    sidebar sidebars widget widgets related recommended recommendations share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs
    header footer masthead topbar comment comments commentlist reply replies respond disqus discussion login search searchbox pagination pager skip
    copyright disclaimer toolbar hidden""".split()
)
#: Of these, what also decides inside the main text, as a class; the others need links or recurrence there.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot promo cookie cookies newsletter subscribe share sharing social comment comments commentlist respond disqus pagination breadcrumb breadcrumbs".split())
#: Words that may stand beside a strong one in a name (share-bar, post-comments); beside others it says something else (market-share).
BESIDE = frozenset(
    """area article bar block bottom box button buttons card container content desktop entry fixed float form group header holder icon icons inline item items js left link links list menu mid middle mobile
    module native page panel post right row section side signup slot sticky strip template text thread tool tools top unit wrap wrapper""".split()
)
#: Ids of reader comments, which decide inside the main text as well.
COMMENTS = frozenset("comments comment-section comments-section comments-area commentlist respond disqus_thread".split())
#: Of the elements that go, those that pages also put around their main text.
WRAPPERS = frozenset("form dialog fieldset".split())
TEASERS = frozenset("comment comments reply ad ads advert related promo teaser card".split())
#: Parts of a class that make it a state of the element, not its kind.
STATES = frozenset("has no not with without is are js hide show enabled disabled open opened closed on off".split())
_SPLIT = re.compile(r"[-_]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")


class Node:
    """An element: its tag, attributes and children (nodes and strings)."""

    __slots__ = ("attrs", "holds", "kids", "linked", "size", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.size, self.linked, self.holds = 0, 0, False

    def get(self, *names: str) -> str:
        if not self.attrs.strip():
            return ""
        return " ".join(v.strip("\"'") for k, v in _ATTR.findall(self.attrs) if k.lower() in names)


def parse(page: str | None) -> Node:
    """The tree of a page, of any depth. Strings keep their character references."""
    root = Node("#root")
    stack, opened, at, page = [root], Counter(), 0, page or ""

    def end(i: int) -> None:
        """Closes the elements of the stack from the i-th on."""
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            stack[-1].kids.append(html.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if opened[tag] > 0:
                end(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in BLOCK and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    end(i)
                    break
                if stack[i].tag in BLOCK or stack[i].tag in ("td", "th", "button"):
                    break
        if tag in CLOSES:
            ends, holds = (x.split() for x in CLOSES[tag])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in holds:
                    break
                if stack[i].tag in ends and (tag != "tr" or stack[i].tag == "tr"):
                    end(i)
                    break
        node = Node(tag, m[4])
        stack[-1].kids.append(node)
        if tag in VOID or m[4].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.kids.append(page[at : stop.start() if stop else len(page)])
            at = stop.end() if stop else len(page)
            continue
        stack.append(node)
        opened[tag] += 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    measure(root)
    return root


def nodes(root: Node) -> list[Node]:
    """All elements of a tree, parents before their children, in page order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(_kids(x))
    return out


def measure(root: Node) -> None:
    """Sets for each element the characters of its text, those in links, and whether it holds the main text: an article or main element."""
    for x in reversed(nodes(root)):
        kids = _kids(x)
        x.holds = any(k.holds or k.tag in ("article", "main") or "role" in k.attrs and k.get("role") == "main" for k in kids)
        if x.tag not in GONE or x.tag in WRAPPERS and x.holds:
            x.size = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + sum(k.size for k in kids)
            x.linked = x.size if x.tag == "a" else sum(k.linked for k in kids)


def kinds(names: str) -> set[str]:
    """The words of a class or id attribute that say what an element is: the first or last part of a name, unless the name is a state (has-sidebar)."""
    out = set()
    for name in names.lower().split():
        parts = _SPLIT.split(name)
        if not STATES & set(parts):
            out |= {name, parts[0], parts[-1]}
    return out


def strong(names: str) -> bool:
    """Whether a class attribute has a name of which a ``STRONG`` word is all, or all but words that say nothing else."""
    for name in names.lower().split():
        parts = _SPLIT.split(name)
        if name in STRONG or not STATES & set(parts) and {parts[0], parts[-1]} & STRONG and all(p in STRONG or p in CLASSES or p in BESIDE or p.isdigit() or not p for p in parts):
            return True
    return False


def hidden(node: Node) -> bool:
    """Whether an element's attributes hide it: hidden, aria-hidden, or a style that doesn't show it."""
    for name, value in _ATTR.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


def boilerplate(node: Node, inside: bool, whole: int = 0, beside: bool = False) -> bool:
    """Whether an element is none of the main text by what it is. ``inside``: in the main text, where a header holds its title; ``beside``: in a main element, but in none of its articles.

    A class or id doesn't decide about an element that holds the article, or more than half of the ``whole`` text. In an article ids don't decide, but for those of reader comments, and classes that
    aren't ``strong`` only if at least half of the text is links; what recurs on the host is found by counting. A form or dialog around the article stays.
    """
    if node.tag in GONE and not (node.tag in WRAPPERS and node.holds) or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("body", "html"):
        return False
    if inside and not (whole and 2 * node.size > whole) and node.tag not in ("main", *HEADINGS) and node.get("id").lower() in COMMENTS:
        return True
    if not node.holds and not (whole and 2 * node.size > whole) and node.tag not in ("main", *HEADINGS):
        if node.tag == "article":
            if kinds(node.get("class", "id")) & TEASERS:
                return True
        elif inside and not beside:
            names = node.get("class")
            if node.tag != "header" and (strong(names) or kinds(names) & CLASSES and 2 * node.linked >= node.size):
                return True
        elif kinds(node.get("class", "id")) & CLASSES:
            return True
        if ROLES & set(node.get("role").lower().split()):
            return True
    return hidden(node)


def _kids(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node)]


def main_roots(root: Node) -> list[Node]:
    """The elements that hold the main text: the outermost main elements, else the outermost articles, else the body; where they are several, none that is mostly links."""

    def find(want) -> list[Node]:
        out, todo = [], [root]
        while todo:
            x = todo.pop()
            if want(x):
                out.append(x)
            elif not boilerplate(x, False, root.size):
                todo += reversed(_kids(x))
        found = [x for x in out if blocks(x, frozenset())]
        return [x for x in found if 2 * x.linked < x.size] or found

    for want in (lambda x: x.tag == "main" or "role" in x.attrs and x.get("role") == "main", lambda x: x.tag == "article" and not boilerplate(x, False), lambda x: x.tag == "body"):
        if found := find(want):
            return found
    return [root]


def subtree_hashes(node: Node, into: dict[int, bytes]) -> bytes:
    """Hash of a subtree; ``into`` gets those of all elements by their identity. White space between words doesn't matter."""
    for x in reversed(nodes(node)):
        h = hashlib.blake2b(f"{x.tag}|{x.get('class', 'id', 'role')}".encode(), digest_size=8)
        for k in x.kids:
            h.update(into[id(k)] if isinstance(k, Node) else b"t" + " ".join(k.split()).encode())
        into[id(x)] = h.digest()
    return into[id(node)]


def template_key(digest: bytes, inside: bool) -> int:
    """The counted number of a subtree: its hash, with the last bit telling whether it lies in the main text."""
    return int.from_bytes(digest, "big", signed=True) & ~1 | inside


def template_candidates(page: str | None) -> tuple[list[int], int]:
    """Distinct keys of the elements with text that aren't the main text or around it (in it, only containers), and a hash of its longest block."""
    root = parse(page)
    roots = main_roots(root)
    keep = {id(x) for x in roots}
    into: dict[int, bytes] = {}
    subtree_hashes(root, into)
    order = nodes(root)
    up = {id(k): x for x in order for k in _kids(x)}
    around: set[int] = set()
    for x in roots:
        while id(x) in up and id(x) not in around:
            around.add(id(x))
            x = up[id(x)]
    out: set[int] = set()
    todo = [(root, False, False)]
    while todo:
        x, inside, beside = todo.pop()
        beside = beside and x.tag != "article"
        if inside and boilerplate(x, True, roots[0].size, beside):
            continue
        if id(x) in keep and x.tag != "body" and x.tag != "#root":
            inside, beside = True, beside_articles(x)
        elif x.kids and (x.tag in CONTAINERS if inside else id(x) not in around and x.tag not in ("#root", "html", "body", "head")):
            out.add(template_key(into[id(x)], inside))
        todo += [(k, inside, beside) for k in _kids(x)]
    longest = max((b for r in roots for b in blocks(r, frozenset())), key=lambda b: (len(b), b), default="")
    return sorted(out), int.from_bytes(hashlib.blake2b(longest.encode(), digest_size=8).digest(), "big", signed=True)


def blocks(node: Node, template: frozenset[int], inside: bool = False) -> list[str]:
    """The text blocks of a main element in page order. ``inside``: it is an article or main element."""
    into: dict[int, bytes] = {}
    if template:
        subtree_hashes(node, into)
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                out.append(text)
            run.clear()

    frames = [(iter(node.kids), False, beside_articles(node))]
    while frames:
        kids, is_block, beside = frames[-1]
        k = next(kids, None)
        if k is None:
            frames.pop()
            if is_block:
                close()
        elif not isinstance(k, Node):
            run.append(k)
        elif k.tag in VOID:
            if k.tag in ("br", "hr"):
                close()
        elif boilerplate(k, True, node.size, beside) or _teaser(k, node) or template and template_key(into[id(k)], inside) in template:
            if k.tag in BLOCK:
                close()
        else:
            if k.tag in BLOCK:
                close()
            elif k.tag in ("td", "th"):
                run.append(" ")
            frames.append((iter(k.kids), k.tag in BLOCK, beside and k.tag != "article"))
    close()
    return out


def beside_articles(node: Node) -> bool:
    """Whether the children of a main text's root lie beside articles."""
    return node.tag != "article" and node.holds


def _teaser(node: Node, root: Node) -> bool:
    """Whether an article inside a main element only points to another page: mostly links, and less than half of the text."""
    return node.tag == "article" and 2 * node.linked >= node.size and 2 * node.size < root.size


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given the template hashes of its host."""
    roots = main_roots(parse(page))
    inside = roots[0].tag not in ("body", "#root")
    return "\n".join(b for r in roots for b in blocks(r, template, inside))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Returns ``id_col, url_col, text, n_chars`` for every page.

    One map finds candidate hashes, which are counted by host and hash, those inside the main text once for each longest block (pre-aggregated; a host with a third of all pages is many keys). The
    templates, for each host at most as many as a page's elements times the larger of 1 / ``least_share`` and half the root of its pages, are broadcast while they are few, else joined.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    seen = map_rows(pages.select(host.alias("host"), F.col(html_col).alias("h")), "host string, hashes array<long>, main long", lambda: lambda h, page: (h, *template_candidates(page)))
    each = seen.select("host", "main", F.explode(F.array_append("hashes", F.lit(None).cast("long"))).alias("hash"))  # null: the page itself
    inside = F.coalesce(F.col("hash").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    by_main = each.groupBy("host", "hash", F.when(inside | F.col("hash").isNull(), F.col("main")).alias("main")).count()
    counts = by_main.groupBy("host", "hash").agg(F.sum(F.when(inside, F.lit(1)).otherwise(F.col("count"))).alias("count"), F.count("*").alias("mains"))
    counts = materialise(counts.where(F.col("hash").isNull() | (F.col("count") >= least_pages)), "subtrees")
    size = counts.where("hash is null").select("host", F.col("count").alias("pages"), F.col("mains").alias("of"))
    template = counts.where("hash is not null").join(size, "host").where(F.col("count") >= F.when(inside, least_share * F.col("of")).otherwise(F.least(least_share * F.col("pages"), 2 * F.sqrt("pages")))).groupBy("host").agg(F.collect_set("hash").alias("hashes"))
    rows = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), host.alias("host"), F.col(html_col).alias("h"))
    out = f"k {pages.schema[id_col].dataType.simpleString()}, u {pages.schema[url_col].dataType.simpleString()}, text string"
    if template.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        held = spark.sparkContext.broadcast({h: frozenset(x) for h, x in template.collect()})

        def make():
            known = held.value
            return lambda k, u, h, page: (k, u, main_text(page, known.get(h, frozenset())))

        texts = map_rows(rows, out, make)
    else:
        joined = rows.join(template, "host", "left").select("k", "u", "h", "hashes")
        texts = map_rows(joined, out, lambda: lambda k, u, page, hashes: (k, u, main_text(page, frozenset(hashes or ()))))
    return texts.select(F.col("k").alias(id_col), F.col("u").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
