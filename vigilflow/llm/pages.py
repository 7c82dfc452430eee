"""Main text of web pages by site template removal.

Every element's subtree (tags, classes, texts and children) has a hash. Spark counts, per host and per section of a
host (the first folder of the path), on how many different pages (by all text of their articles, or of the page where
it has none) a subtree occurs. Subtrees that recur on many pages, and on a share of the host's or of one section's, are
template and are deleted; as the share may be a section's, a section's template goes on a large host as on a small one.
Inside an article only containers are: a paragraph or heading of an article stays, however often it recurs.
Elements that HTML itself or their class, id or role name as menu, header, footer, sidebar, notice, advert, form or
reader comment go as well; so do scripts and styles. A class or id names such a part only if all its words do so or are
about layout ("site-footer", "ad-box-2"); "share-price" or "ad-hoc" name none, and recurrence alone decides there. What
is left of the article (or of the main part or the body, where a page has none) is split into blocks.

Defined cases: null html is empty and gives an empty text; a page cut off inside a tag loses that tag only; a null
or odd URL has the host ""; copies of a page count once for the template and each give their text; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, texts

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

# What HTML defines of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
# an opening tag ends these open elements before it
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
LIMITS = frozenset("table ul ol dl select body article main".split())  # implied ends do not reach beyond these
# Elements that are never part of an article.
NEVER = frozenset("head nav footer aside form button select input textarea script style noscript template iframe svg canvas object embed applet audio video map "
                  "dialog menu math title datalist fieldset noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
                  "newsletter subscribe subscription sidebar comment comments commentlist disqus respond reply replies menu nav navbar navigation breadcrumb breadcrumbs footer "
                  "header masthead topbar share sharing social related recommended widget widgets pagination pager login signup search toolbar skip".split())
# Words of layout that may stand next to those in a class or id.
LAYOUT = frozenset("site page main global top bottom left right upper lower inner outer center box bar area zone section block container wrapper wrap holder list item items link links row "
                   "col column columns module component panel title text primary secondary tertiary fixed sticky floating mobile desktop js slot unit button buttons icon icons group "
                   "count form field input post posts article articles entry entries blog author user view message bottombar static full wide small large the of and".split())
WEAK = frozenset(("header", "search", "related"))  # not decisive inside an article
KEPT_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd td th tr figcaption article main b i em strong a span code".split())
# A subtree is template from this many different pages and this share of those of the host or of one section on.
LEAST_PAGES, LEAST_SHARE, LEAST_SHARE_IN_ARTICLE = 10, 0.05, 0.3
MOST_HASHES = 1_000_000  # eight bytes each are broadcast


@lru_cache(maxsize=20_000)
def named(name: str) -> frozenset[str]:
    """The template words of a class or id; none where any other word but one of layout stands beside them."""
    if name in NAMES:
        return frozenset((name,))
    words = re.split(r"[-_]+", name)
    hit = NAMES.intersection(words)
    return hit if hit and all(w in NAMES or w in LAYOUT or len(w) < 2 or w.isdigit() for w in words) else frozenset()


NO_NAMES: frozenset[str] = frozenset()


class Element:
    __slots__ = ("tag", "names", "attrs", "parts", "parent", "hash", "holds")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Element | str] = []
        self.holds = False  # an article or main part stands inside
        self.hash = 0
        self.names = NO_NAMES
        if "class" in attrs or "id" in attrs:
            self.names = NO_NAMES.union(*map(named, (*attrs.get("class", "").lower().split(), attrs.get("id", "").lower())))

    @property
    def is_main(self) -> bool:
        return self.tag in ("article", "main") or self.attrs.get("role", "").lower() in ("main", "article")


def parse(html: str) -> Element:
    """The element tree; unclosed elements end with their parent, stray ends are ignored."""
    root = node = Element("html", {}, None)
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text:
            node.parts.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            continue
        if m[1] or m[5]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag == "br":
                node.parts.append(" ")
            continue
        attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m[3] or m[7] or "")}
        if tag in ("html", "body") and (tag == "html" or any(isinstance(p, Element) and p.tag == "body" for p in root.parts)):
            continue
        if tag in BLOCKS and tag != "html":  # a block ends an open paragraph
            up = node
            while up is not root and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in ENDS:
            up, last = node, None
            while up is not root and (up.tag not in LIMITS or up.tag in ENDS[tag]):
                if up.tag in ENDS[tag]:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        if tag[0] == "h" and len(tag) == 2 and node.tag == tag:
            node = node.parent
        if tag == "body" and node.tag == "head":
            node = root
        child = Element(tag, attrs, node)
        node.parts.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(html, at)
            child.parts.append(html[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] or m[7] or "").endswith("/") or tag in BLOCKS - VOID:
            node = child
    _finish(root)
    return root


def _finish(root: Element) -> None:
    """Hashes from the leaves up, without recursion: pages may be nested deeply."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [p for p in e.parts if isinstance(p, Element)]
    for e in reversed(order):
        parts = [f"\x01{p.hash}" if isinstance(p, Element) else SPACE.sub(" ", p) for p in e.parts]
        e.hash = xxhash.xxh3_64_intdigest("\x02".join([e.tag, e.attrs.get("class", ""), e.attrs.get("id", ""), *parts])) - (1 << 63)
        e.holds = any(isinstance(p, Element) and (p.is_main or p.holds) for p in e.parts)


def is_template(e: Element, common: frozenset, very: frozenset, inside: bool) -> bool:
    """Whether an element goes: by what it is, by its names or because its subtree recurs on the host."""
    if e.tag in NEVER or (e.tag == "header" and not inside):
        return not (e.tag == "form" and e.holds)  # some sites wrap all of a page in one form
    if e.holds:
        return False
    if "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", e.attrs.get("style", "")):
        return True
    if e.attrs.get("role", "").lower() in ROLES or e.tag in ("body", "html"):
        return e.tag not in ("body", "html")
    if e.names and not (inside and e.names <= WEAK):
        return True
    return e.hash in (very if inside else common) and not (inside and e.tag in KEPT_IN_ARTICLE)


def _regions(root: Element) -> list[Element]:
    """The outermost articles; else the main parts; else the page."""
    for wanted in (("article",), ("main",), ()):
        found, todo = [], [root]
        while todo:
            e = todo.pop(0)
            role = e.attrs.get("role", "").lower()
            if wanted and (e.tag in wanted or role in wanted) and not (e.names - WEAK):
                found.append(e)
                continue
            if e.tag in NEVER and not e.holds or (e.names and not e.holds):
                continue
            todo = [p for p in e.parts if isinstance(p, Element)] + todo
        if found:
            return found
    return [root]


def main_text(root: Element, common: frozenset = frozenset(), very: frozenset = frozenset()) -> str:
    """Blocks of what is left, one to a line."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    for region in _regions(root):
        todo: list[tuple[Element | str | None, bool]] = [(region, region.is_main)]
        first = True
        while todo:
            part, inside = todo.pop()
            if part is None:
                close()
            elif isinstance(part, str):
                line.append(part)
            elif first or not is_template(part, common, very, inside):
                first = False
                if part.tag == "br":
                    line.append(" ")
                inside = inside or part.is_main
                block = part.tag in BLOCKS
                if block:
                    close()
                    todo.append((None, inside))
                todo += [(p, inside) for p in reversed(part.parts)]
            elif part.tag in BLOCKS:
                close()
        close()
    return "\n".join(blocks)


def subtrees(root: Element) -> tuple[int, set[int], set[int]]:
    """Hash of the text of the page's articles (of all of it, where they hold none), and hashes of the elements that may
    be template outside and inside articles."""
    outside, inside, words, others = set(), set(), [], [p for p in root.parts if isinstance(p, str)]
    todo = [(p, False) for p in root.parts if isinstance(p, Element)]
    while todo:
        e, within = todo.pop()
        within = within or e.is_main
        if e.tag not in NEVER:
            (words if within else others).extend(p for p in e.parts if isinstance(p, str))
        if not e.holds and e.tag not in ("body", "head") and any(isinstance(p, Element) or p.strip() for p in e.parts):
            if not within:
                outside.add(e.hash)
            elif e.tag not in KEPT_IN_ARTICLE:
                inside.add(e.hash)
        if e.tag not in NEVER:
            todo += [(p, within) for p in e.parts if isinstance(p, Element)]
    text = SPACE.sub(" ", "\x02".join(words)).strip(" \x02") or SPACE.sub(" ", "\x02".join(others))
    return xxhash.xxh3_64_intdigest(text) - (1 << 63), outside, inside


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def section_of(url: Column) -> Column:
    """The first folder of the path; "" where a page stands at the top."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)/[^?#]", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, common and very: subtree hashes that are template outside and inside articles of a host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, section, html in zip(b["host"], b["section"], texts(b["html"])):
                page, outside, inside = subtrees(parse(html))
                out += [(host, section, page, h, False) for h in outside] + [(host, section, page, h, True) for h in inside] + [(host, section, page, 0, False)]
            yield pd.DataFrame(out, columns=["host", "section", "page", "subtree", "inside"])

    seen = pages.select(host_of(F.col("url")).alias("host"), section_of(F.col("url")).alias("section"), "html").mapInPandas(
        run, "host string, section string, page long, subtree long, inside boolean")
    # copies of a page count once in its host (section null) and once in its section; subtree 0 counts the pages
    seen = seen.withColumn("section", F.explode(F.array(F.col("section"), F.lit(None)))).distinct()
    counts = seen.groupBy("host", "section", "subtree", "inside").agg(F.count("*").alias("n"))
    counts = store(counts.where(F.col("n") >= LEAST_PAGES), "pages-subtrees")
    total = counts.where("subtree = 0").select(F.col("host").alias("_h"), F.col("section").alias("_s"), F.col("n").alias("pages"))
    often = counts.where("subtree != 0").join(total, (F.col("host") == F.col("_h")) & F.col("section").eqNullSafe(F.col("_s"))).where(
        F.col("n") >= F.when(F.col("inside"), LEAST_SHARE_IN_ARTICLE).otherwise(LEAST_SHARE) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set(F.when(~F.col("inside"), F.col("subtree"))).alias("common"),
                                     F.collect_set(F.when(F.col("inside"), F.col("subtree"))).alias("very"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page. The subtrees that recur on a section are a share of one page's elements at most
    each, so a host's list is bounded by its pages' size over the least share. All lists are broadcast only where their
    hashes were counted and found few; else they are joined by shuffle."""
    often = store(templates(pages), "pages-templates")
    hashes = often.agg(F.sum(F.size("common") + F.size("very") + F.lit(1))).first()[0] or 0
    if hashes <= MOST_HASHES:
        often = F.broadcast(often)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, tuple[frozenset, frozenset]] = {}
        for b in batches:
            out = []
            for host, html, common, very in zip(b["host"], texts(b["html"]), b["common"], b["very"]):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = tuple(frozenset(int(h) for h in s) if s is not None else frozenset() for s in (common, very))
                out.append(main_text(parse(html), *sets[host]))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out})

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(often, "host", "left")
    return rows.mapInPandas(run, "page_id long, url string, text string")
