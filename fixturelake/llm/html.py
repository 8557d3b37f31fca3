"""Main text of web pages by equivalence-class template deduction over the pages of a host.

A token is a start tag with its path of block elements. Over the pages of one host each token has an occurrence
vector (how often it stands on each page); tokens with equal vectors form an equivalence class. Classes that hold
on at least SUPPORT of the host's pages are valid; those that occur once a page are the template's skeleton, and
classes that repeat (paragraphs, list items) nest in the skeleton token that is their nearest ancestor. Text hangs in the
slot of its nearest skeleton token. Vectors are compared by the exclusive or of a hash of (page, count), so they
are aggregated like sums and no host's pages are ever gathered in one task.

The slots of a host are then told apart. By the template: slots outside an article whose text is equal on all of five or more
different pages are fixed; copies of a page count once. Fixed slots have no weight where the article is looked for, and are left out where it
is the whole page, unless they hold most of the pages' text: then the pages are copies of one article. By structure: elements for menus, footers, sidebars and forms, roles, and slots
of mere links by their link share. By names last, and only where a whole class name or id speaks of nothing else: menus, page headers,
footers, sidebars, notices, adverts and reader comments. What is left under the article's slot is extracted from every
page, in page order. A page that lacks its host's main slot is decided by its own slots; one without elements is all text.

Null or empty html gives an empty text. A null url counts as a host of its own; null ids are kept. Repeated rows give repeated
results; an empty table gives none. Of slots with equal text the innermost is the article. Pages are parsed in one pass, each
alone, in time that grows with their length however deep or unbalanced their elements are. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table

SUPPORT = 0.5
LINK_SHARE = 0.6
#: Parts of a path at most.
DEPTH = 128

# HTML element names by role.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template svg iframe textarea select button head title object canvas video audio map option datalist dialog".split())
_BOILER_TAGS = frozenset("nav footer aside form menu fieldset".split())
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure details".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("ul ol dl table tbody thead div section article main body html".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class names and ids for what is not the article, and words that say nothing about it.
_BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar side aside widget widgets advert adverts advertisement advertisements ad ads adsense banner banners promo promos promotion sponsor"
    " sponsored cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommend recommended recommendations"
    " comment comments commentlist reply replies respond disqus pagination pager toolbar masthead copyright legal disclaimer alert alerts skip".split()
)
_NEUTRAL_WORDS = frozenset(
    "section block box list area wrapper wrap container inner outer top bottom left right center main primary secondary global site page post posts article articles entry content body text title heading"
    " header head button buttons btn bar link links icon icons item items group form forms user users reader readers panel thread row col column grid media more read also like you may by policy message"
    " js wp tpl the of for and on in sign log up us this slot unit image img native wide narrow small large mobile desktop sticky fixed floating inline default".split()
)
_HEADER_WORDS = re.compile(r"(?:^|[^a-z])(?:site-?header|page-?header|top-?bar|header)(?![a-z])")
_MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|content|main|body-?text|article-?body|post-?content)(?![a-z])")

# a quote opens a value only after "=", and only where it is closed before the tag ends or in front of what may follow a value
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"<>]*\"|=\s*'[^'<>]*'|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_ARTICLE = re.compile(r"/(?:article|main)(?![a-z0-9-])|@main(?![a-z0-9-])")
_SPACE = re.compile(r"\s+")
#: The last part of the path of a whole page.
_WHOLE = re.compile(r"(?:html|body)?(?:\W|$)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in _RAW}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if "=" in text else {}


def named_boilerplate(named: str) -> bool:
    """Whether one of the class names or ids is about boilerplate and nothing else: ``share-buttons`` is, ``share-price`` is not."""
    for token in _CAMEL.sub("-", named).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", token) if len(p) > 1]
        if not _BOILER_WORDS.isdisjoint(parts) and all(p in _BOILER_WORDS or p in _NEUTRAL_WORDS for p in parts):
            return True
    return False


def _part(tag: str, attrs: dict[str, str]) -> tuple[str, bool]:
    """The element in a path, and whether it is boilerplate by element or naming."""
    said = " ".join(filter(None, (attrs.get("class"), attrs.get("id"))))
    named = said.lower()
    role = attrs.get("role", "").lower()
    part = tag + ("." + re.sub(r"\d+", "0", ".".join(named.split())) if named else "") + (f"@{role}" if role else "")
    hidden = re.search(r"display\s*:\s*none", attrs.get("style", ""))
    boiler = tag in _BOILER_TAGS or role in _BOILER_ROLES or bool(hidden) or attrs.get("aria-hidden") == "true"
    if named and not boiler and tag not in ("html", "body", "main", "article"):
        boiler = named_boilerplate(said)
    return part, boiler


class _Open:
    """The open elements of a page, with the places of each name, of blocks and of holders, so that none is searched for."""

    def __init__(self) -> None:
        self.items: list[tuple[str, str, bool, bool, int]] = []  # tag, path, boilerplate here or above, dropped here or above, parts of the path
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.holders: list[int] = []

    def state(self) -> tuple[str, bool, bool, int]:
        return self.items[-1][1:] if self.items else ("", False, False, 0)

    def last(self, tags) -> int:
        """The place of the innermost element of some names, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, item: tuple[str, str, bool, bool, int]) -> None:
        k, tag = len(self.items), item[0]
        self.items.append(item)
        self.places[tag].append(k)
        if tag not in _INLINE:
            self.blocks.append(k)
        if tag in _HOLDERS:
            self.holders.append(k)

    def close(self, k: int) -> bool:
        """Close the element at a place and all within it; whether a block was among them."""
        block = bool(self.blocks) and self.blocks[-1] >= k
        while len(self.items) > k:
            self.places[self.items.pop()[0]].pop()
        for places in (self.blocks, self.holders):
            while places and places[-1] >= k:
                places.pop()
        return block


def blocks(page: str) -> list[tuple[str, bool, str, int]]:
    """(path, boilerplate, text, characters in links) of each run of text between block boundaries, in page order; and of each block's start, with empty text.

    Work is in proportion to the page. An element below DEPTH others has the path of the last of those, as in browsers.
    """
    out: list[tuple[str, bool, str, int]] = []
    stack = _Open()
    parts: list[str] = []
    links = in_link = 0
    now = held = stack.state()  # held: where the collected text stands

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((held[0], held[1], text, links))
            parts.clear()
        links = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] == "<" and m.end() - m.start() > 1:  # comment or declaration
                continue
            piece = m[0]
            if not now[2]:
                piece = entities.unescape(piece) if "&" in piece else piece
                if not parts:
                    held = now
                parts.append(piece)
                links += len(piece) if in_link else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            k = stack.last((tag,))
            if k < 0:
                if tag in ("p", "br"):
                    flush()
            elif not (tag in _INLINE and stack.blocks and stack.blocks[-1] > k):
                if stack.close(k):
                    flush()
                if stack.state()[1] != now[1]:
                    flush()
                now = stack.state()
            continue
        if tag in _VOID:
            if tag in ("br", "hr") and not now[2]:
                if not parts:
                    held = now
                parts.append(" ")
            continue
        attrs = _attributes(m[3])
        if tag in _RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag not in _INLINE:
            flush()
            holder = stack.holders[-1] if stack.holders else -1
            for names in (("p",) if tag in _CLOSE_P else (), _SAME.get(tag, ())):
                k = stack.last(names)
                if k > holder:
                    stack.close(k)
            now = stack.state()
        elif tag == "a":
            in_link = 1
        path, boiler, dropped, depth = now
        part, own = _part(tag, attrs)
        if m[3].rstrip().endswith("/") and tag not in _INLINE:
            continue
        # boilerplate inside a line of text is cut out, and what stands on either side stays together
        dropped = dropped or tag in _DROPPED or (own and not boiler and tag in _INLINE)
        if tag not in _INLINE:
            if depth < DEPTH:
                path, depth = f"{path}/{part}", depth + 1
            out.append((path, boiler or own, "", -1))
            boiler = boiler or own
        stack.push((tag, path, boiler, dropped, depth))
        now = stack.state()
    flush()
    return out


def _header_like(path: str) -> bool:
    """A page header: a header element or naming outside the article."""
    for part in path.split("/"):
        if part.startswith(("article", "main")):
            return False
        if part == "header" or part.startswith(("header.", "header@")) or (not part.startswith(("html", "body")) and _HEADER_WORDS.search(part)):
            return True
    return False


def choose_main(slots: list[tuple[str, int, int, bool]]) -> str | None:
    """The path of the main slot among (path, characters, link characters, fixed text) of the slots that are not boilerplate."""
    mass: dict[str, float] = defaultdict(float)
    for path, chars, links, fixed in slots:
        if chars and not fixed and links <= LINK_SHARE * chars and not _header_like(path):
            parts = path.split("/")
            for k in range(1, len(parts) + 1):
                mass["/".join(parts[:k])] += chars - links
    if not mass:
        return None
    last = {p: p.rpartition("/")[2] for p in mass}
    article = [p for p in mass if re.match(r"(article|main)(\W|$)", last[p]) or "@main" in last[p]]
    if article:  # the one with most text, innermost of equals
        most = max(mass[p] for p in article)
        return max((p for p in article if mass[p] >= 0.5 * most), key=lambda p: (last[p].startswith("article"), mass[p], len(p)))
    named = [p for p in mass if "." in last[p] and _MAIN_WORDS.search(last[p])]
    total = max(mass.values())
    if named and max(mass[p] for p in named) >= 0.5 * total:
        most = max(mass[p] for p in named)
        return max((p for p in named if mass[p] >= 0.9 * most), key=len)
    # plain containers: the deepest that still holds most of the text
    return max((p for p in mass if mass[p] >= 0.8 * total), key=lambda p: (len(p.split("/")), p))


def main_slot(slots: list, skeleton: set[str]) -> tuple[str | None, set[str]]:
    """The path of a host's main slot, and the paths of fixed slots that are left out under it.

    Fixed text is the template's only where the pages differ in most of their text: copies of one article have nothing else. It then has
    no weight in the choice, but what stands inside the slot that is chosen is the article's, unless that is the whole page.
    """
    open_ = [s for s in slots if not s["boiler"] and s["path"] in skeleton and not _header_like(s["path"])]
    fixed = {s["path"] for s in open_ if s["fixed"] and not _ARTICLE.search(s["path"])}
    mass = lambda only: sum(s["chars"] - s["links"] for s in open_ if s["links"] <= LINK_SHARE * s["chars"] and (s["path"] in fixed or not only))
    if 2 * mass(True) > mass(False):
        fixed = set()
    main = choose_main([(s["path"], s["chars"], s["links"], s["path"] in fixed) for s in open_])
    return main, fixed if main is not None and _WHOLE.match(main.rpartition("/")[2]) else set()


def _slot(path: str, skeleton: frozenset[str] | set[str]) -> str:
    while path and path not in skeleton:
        path = path.rpartition("/")[0]
    return path


def page_slots(found: list[tuple[str, bool, str, int]], skeleton: set[str]) -> list[tuple[str, int, int, bool]]:
    slots: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for path, boiler, text, links in found:
        if text and not boiler:
            s = slots[_slot(path, skeleton)]
            s[0] += len(text)
            s[1] += links
    return [(p, c, n, False) for p, (c, n) in slots.items()]


def main_text(found: list[tuple[str, bool, str, int]], skeleton: set[str], main: str | None, fixed: set[str]) -> str:
    own = {p for p, *_ in found}
    if main is None or main not in own:
        main = choose_main(page_slots(found, own))
    if main is None:
        return ""
    sub = len(main.split("/"))
    bare = _WHOLE.match(main.rpartition("/")[2])  # its header is no part of the article
    return " ".join(
        text
        for path, boiler, text, _ in found
        if text
        and not boiler
        and (path == main or path.startswith(main + "/"))
        and not (len(path.split("/")) > sub and _slot(path, skeleton) in fixed and _slot(path, skeleton) != main)
        and not (bare and _header_like(path))
    )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for host, key, page in zip(b.column("host").to_pylist(), b.column("page_key").to_pylist(), b.column("html").to_pylist(), strict=True):
            seen: dict[str, list] = {}
            for path, boiler, text, links in blocks(page or ""):
                s = seen.setdefault(path, [0, boiler, 0, 0, []])
                if links < 0:
                    s[0] += 1
                else:
                    s[2] += len(text)
                    s[3] += links
                    s[4].append(text)
            for path, (n, boiler, chars, links, texts) in seen.items():
                for c, v in zip(cols, (host, path, key, n, boiler, chars, links, "\n".join(texts)), strict=True):
                    c.append(v)
        names = ["host", "path", "page_key", "n", "boiler", "chars", "links", "said"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def different(pages: DataFrame) -> DataFrame:
    """host, html: each page of a host once. Only hashes of pages are shuffled, and the html of those that repeat."""
    keyed = pages.select("host", "html", F.xxhash64("html").alias("page_key"))
    again = materialise(keyed.groupBy("host", "page_key").agg(F.count("*").alias("n")).where("n > 1").select("host", "page_key"), "repeated-pages")
    few = again.count()
    if not few:
        return keyed.select("host", "html")
    side = F.broadcast(again) if few <= 100_000 else again
    copies = keyed.join(side, ["host", "page_key"], "left_semi").select("host", "html").distinct()
    return keyed.join(side, ["host", "page_key"], "left_anti").select("host", "html").unionByName(copies)


def deduce_templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, slots: the skeleton of each host's template, an array of (path, class id, chars, links, fixed, boiler)."""
    pages = different(pages)
    tokens = pages.select("host", F.xxhash64("html").alias("page_key"), "html").mapInArrow(
        _tokens, "host string, path string, page_key long, n long, boiler boolean, chars long, links long, said string"
    )
    said = F.xxhash64("said")
    per_token = tokens.groupBy("host", "path").agg(
        F.bit_xor(F.xxhash64("page_key", "n")).alias("vector"),
        F.count("*").alias("pages"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.bool_or("boiler").alias("boiler"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
        (F.min(said) == F.max(said)).alias("same"),
    )
    n_pages = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    valid = per_token.join(n_pages, "host").where(F.col("pages") >= support * F.col("n_pages"))
    # one class a vector; the skeleton is what stands once on a page
    skeleton = valid.where("least = 1 AND most = 1").select(
        "host",
        F.struct("path", F.col("vector").alias("class_id"), "chars", "links", (F.col("same") & (F.col("n_pages") >= 5) & (F.col("chars") > 0)).alias("fixed"), "boiler").alias("slot"),
    )
    return skeleton.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for b in batches:
        texts = []
        for host, slots, page in zip(b.column("host").to_pylist(), b.column("slots").to_pylist(), b.column("html").to_pylist(), strict=True):
            if host not in known:
                slots = slots or []
                if len(known) > 2000:
                    known.clear()
                classes: dict[int, int] = defaultdict(int)
                for s in slots:
                    classes[s["class_id"]] += 1
                # large classes first: a class of one token is kept only if it nests below a larger one
                large = {s["path"] for s in slots if classes[s["class_id"]] > 1}
                skeleton = {s["path"] for s in slots if s["path"] in large or s["path"].rpartition("/")[0] in large or not large}
                known[host] = (skeleton, *main_slot(slots, skeleton))
            texts.append(main_text(blocks(page or ""), *known[host]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    ship(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn(
        "host", F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    )
    templates = materialise(deduce_templates(slim, support), "templates")
    done = slim.join(templates, "host", "left").select("page_id", "url", "host", "slots", "html").mapInArrow(_extract, "page_id long, url string, text string")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
