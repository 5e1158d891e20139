"""Main text of web pages by removing what a site repeats.

Each page is parsed in Arrow batches.  Its element subtrees are hashed in two ways: exactly (tags, classes and
text), and as a slot (their place and their shape, whatever the text).  Spark counts per host how many different
pages hold each hash and how much text.  Subtrees that recur on many pages of their host are the site's template and
are deleted in a second pass: exact ones always, slots if they are named as boilerplate, consist of links or hold
little of the host's text.  What is left of the article (or else the main part, or else the body) is the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.sources.scratch import save_scratch

#: A subtree is a template from so many different pages of its host, and such a share of them.
LEAST_PAGES, LEAST_SHARE = 4, 0.4
#: A recurring slot that isn't named is a template if so much of its text is links, or it has so little of the host's text.
LINKED, LITTLE = 0.5, 0.15
#: Lists of templates of all hosts are sent to every task up to this many hashes; beyond it they are joined by host.
BROADCAST_HASHES = 200_000
#: Pages parsed at once.
PAGES_AT_ONCE = 64

# fixed values of HTML: elements by their role
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset("head script style noscript template title textarea iframe noembed noframes svg math canvas object embed audio video select button dialog input".split())
BOILERPLATE = frozenset("nav footer aside form menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead tfoot caption figure figcaption summary".split())
CONTAINERS = frozenset("address article body center details dir div dl fieldset hgroup header hr html legend main ol section table ul".split()) | BOILERPLATE
BLOCKS = PROSE | CONTAINERS
LISTS = frozenset("dl hr ol table ul".split())
#: A start tag of these closes what stands open in the value, up to the element that bounds it.
ENDS_OPEN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote".split())
# words of classes, ids and roles that name boilerplate, and words that name content
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byads comment comments commentlist consent contentinfo cookie cookies copyright disclaimer"
    " disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related reply"
    " replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CONTENT_WORDS = frozenset("article body content copy entry headline main post prose story text title".split())

_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)"  # comments
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"  # tags
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+\Z"  # declarations, and a tag that the page's end cuts
    r"|(?P<text>[^<]++|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_WORDS = re.compile(r"[a-z]+")


class Element:
    """``children`` are elements and texts; ``mark`` is the tag with its classes."""

    __slots__ = ("boilerplate", "children", "content", "mark", "tag")

    def __init__(self, tag: str, rest: str = "") -> None:
        self.tag, self.mark, self.children = tag, tag, []
        self.boilerplate, self.content = tag in BOILERPLATE, False
        if "=" in rest or "hidden" in rest:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
            names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()
            if names != "  ":
                self.mark = f"{tag}.{names}"
                words = _WORDS.findall(names)
                self.boilerplate |= not BOILERPLATE_WORDS.isdisjoint(words)
                self.content = not CONTENT_WORDS.isdisjoint(words)
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if hidden or (tag == "article" and "comment" in names):
                self.boilerplate = True
            elif tag in ("article", "main", "body", "html"):
                self.boilerplate = False


def parsed(page: str) -> Element:
    """The element tree of a page; what isn't closed or wrongly closed is closed as browsers do for common cases."""
    root = Element("html")
    stack, at, end = [root], 0, len(page)
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        ends, tag, rest, text = token.groups()
        if text is not None:
            stack[-1].children.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("body", "html", "main"):
                    break  # an end tag doesn't reach out of these
            continue
        if tag in BLOCKS and tag != "body":
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends, with what is open in it
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ENDS_OPEN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS_OPEN[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDS:
                    break
        if tag in ("html", "body") and len(stack) > 1 and stack[1].tag != "head":
            continue
        if tag == "body":
            del stack[1:]
        element = Element(tag, rest)
        stack[-1].children.append(element)
        if tag in RAW:
            closed = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.IGNORECASE).search(page, at)
            at = closed.end() if closed else end
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(element)
    return root


def regions(root: Element) -> list[Element]:
    """The page's articles, or else its main parts, or else the page; not what lies in boilerplate, a form around them aside."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        element, inside = todo.pop()
        kind = "main" if element.mark.endswith(" main") else element.tag
        if kind == "article" or (kind == "main" and not inside):
            found[kind].append(element)
            inside = True
        if kind != "article":
            todo += [(c, inside) for c in reversed(element.children) if isinstance(c, Element) and c.tag not in NEVER_TEXT and (c.tag == "form" or not c.boilerplate)]
    return found["article"] or found["main"] or [root]


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode(errors="replace")) - (1 << 63)


def _texts_of(element: Element) -> list[str]:
    """All texts of a subtree, in order."""
    out, todo = [], [element]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag not in NEVER_TEXT:
            todo += reversed(item.children)
    return out


def _only_prose(element: Element) -> bool:
    todo = [element]
    while todo:
        for child in todo.pop().children:
            if not isinstance(child, str) and child.tag not in NEVER_TEXT:
                if child.tag in CONTAINERS and child.tag not in LISTS:
                    return False
                todo.append(child)
    return True


class Hashed:
    """Hashes of a page's subtrees: for each block element its exact hash and its slot, with the text's and the links' length.

    ``content`` is the hash of the text of the page's regions.
    """

    def __init__(self, root: Element) -> None:
        self.rows: dict[int, tuple[int, int, int, int, bool]] = {}  # by identity
        kept = regions(root)
        self.content = _hash(*(text for r in kept for text in _texts_of(r)))
        self._walk(root, "", False, frozenset(id(r) for r in kept if r is not root))

    def _walk(self, element: Element, path: str, inside: bool, kept: frozenset[int]) -> tuple[str, str, int, int]:
        """Exact text, shape, characters and characters in links of a subtree."""
        within = inside or id(element) in kept
        if within and _only_prose(element):  # nothing in it can be the site's
            texts = _texts_of(element)
            return str(_hash(*texts)), element.mark, sum(map(len, texts)), 0
        exact, shape, chars, links = [element.mark], [], 0, 0
        place = f"{path}>{element.mark}"
        for child in element.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                exact.append(words)
                chars += len(words)
            elif child.tag not in NEVER_TEXT:
                what, form, n, linked = self._walk(child, place, within, kept)
                exact.append(what)
                if not shape or shape[-1] != form:  # a run of equal shapes counts as one
                    shape.append(form)
                chars, links = chars + n, links + linked
        if element.tag == "a":
            links = chars
        if element.tag in BLOCKS and element.tag not in ("html", "body", "article", "main") and chars:
            # in the article, only what isn't prose can be the site's, and only as it stands
            exact_key = 0 if within and element.tag in PROSE | LISTS else _hash("exact", *exact)
            slot_key = 0 if within or element.tag in PROSE or element.content else _hash("slot", place, *shape)
            self.rows[id(element)] = (exact_key, slot_key, chars, links, element.boilerplate)
        return str(_hash(*exact)), f"{element.mark}({','.join(shape)})" if len(shape) < 40 else str(_hash(element.mark, *shape)), chars, links


def main_text(root: Element, templates: frozenset[int] | set[int]) -> str:
    """Text of the page's region without templates and boilerplate, blocks joined by one space."""
    drop: set[int] = set()
    if templates:
        drop = {key for key, (exact, slot, *_) in Hashed(root).rows.items() if exact in templates or slot in templates}
    blocks: list[list[str]] = [[]]

    def walk(element: Element) -> None:
        block = element.tag in BLOCKS
        if block:
            blocks.append([])
        for child in element.children:
            if isinstance(child, str):
                blocks[-1].append(child)
            elif child.tag == "br":
                blocks[-1].append(" ")
            elif child.tag not in NEVER_TEXT and not child.boilerplate and id(child) not in drop:
                walk(child)
        if block:
            blocks.append([])

    for region in regions(root):
        if id(region) not in drop:
            walk(region)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(t for t in texts if t)


def _deep(page: str | None) -> Element:
    """Parsed, with elements nested beyond 200 levels flattened into the one at that depth, so that walks are bounded."""
    root = parsed(page or "")
    todo = [(root, 0)]
    while todo:
        element, depth = todo.pop()
        if depth == 200:
            flat, rest = [], list(reversed(element.children))
            while rest:
                child = rest.pop()
                if isinstance(child, str):
                    flat.append(child)
                elif child.tag not in NEVER_TEXT and not child.boilerplate:
                    flat.append(" ") if child.tag in BLOCKS or child.tag == "br" else None
                    rest += reversed(child.children)
            element.children = flat
        else:
            todo += [(c, depth + 1) for c in element.children if isinstance(c, Element)]
    return root


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the subtrees of pages, each once a page; the row of hash 0 stands for the page."""
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(start, PAGES_AT_ONCE)
            out: list[tuple] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                hashed = Hashed(_deep(page))
                content = hashed.content
                found = {0: (host, 0, content, len(page or ""), 0, False, False)}
                for exact, slot, chars, links, named in hashed.rows.values():
                    for key, is_slot in ((exact, False), (slot, True)):
                        if key and key not in found:
                            found[key] = (host, key, content, chars, links, named, is_slot)
                out += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)


_NAMES = ["host", "key", "content", "chars", "links", "named", "slot"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def site_templates(pages: DataFrame) -> DataFrame:
    """``host, templates``: hashes of subtrees that recur on many different pages of ``host`` (pages: ``host, html``).

    Pages of one text count once, so copies of an article don't make it a template.  A template is on a share of its host's pages,
    so the list of a host is bounded by what a page holds, not by the number of pages.
    """
    rows = pages.mapInArrow(_subtrees, "host string, key long, content long, chars long, links long, named boolean, slot boolean")
    once = rows.groupBy("host", "key", "content").agg(F.max("chars").alias("chars"), F.max("links").alias("links"), F.max("named").alias("named"), F.max("slot").alias("slot"))
    counted = save_scratch(
        once.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("named").alias("named"), F.max("slot").alias("slot"))
        .where((F.col("n") >= LEAST_PAGES) | (F.col("key") == 0)), "subtrees",
    )
    hosts = counted.where("key = 0").select("host", F.col("n").alias("pages"), F.col("chars").alias("size")).where(F.col("pages") >= LEAST_PAGES)
    share = F.col("n") >= LEAST_SHARE * F.col("pages")
    slot = F.col("named") | (F.col("links") >= LINKED * F.col("chars")) | (F.col("chars") <= LITTLE * F.col("size"))
    found = counted.where("key <> 0").join(hosts, "host").where(share & (~F.col("slot") | slot))
    return found.groupBy("host").agg(F.collect_set("key").alias("templates"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(start, PAGES_AT_ONCE)
            pages = zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True)
            texts = pa.array([main_text(_deep(page), frozenset(known or ())) for page, known in pages], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of each row of ``pages``: the main text, empty if there is none.

    Hosts are what stands between ``://`` and the next ``/``, ``?`` or ``#``, in lower case; pages without one (or with a
    null url) have no templates.  A null html is an empty page.  Repeated rows have equal results and count as one page of
    their host.  Pages of any length are taken whole; what is nested deeper than 200 levels counts as text of that
    level.  An empty table has no rows; extra columns are left out.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    templates = save_scratch(site_templates(rows.where("host <> '' AND html IS NOT NULL").select("host", "html")), "templates")
    size = templates.agg(F.sum(F.size("templates"))).first()[0] or 0
    known = F.broadcast(templates) if size <= BROADCAST_HASHES else templates
    both = rows.join(known, "host", "left").select("page_id", "url", "html", "templates")
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return both.mapInArrow(_texts, f"{kinds}, text string")
