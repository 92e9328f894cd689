"""HTML extraction by equivalence classes of template tokens.

Tokens of a page are its structural elements (with their path) and its text
nodes.  Over the pages of one host each token has an
occurrence vector (how often on which page); tokens with equal vectors form an
equivalence class.  A class is a candidate if it has at least ``MIN_SIZE`` tokens, of
which one is an element, and support on at least ``MIN_PAGES`` and half of the
host's distinct pages (pages with equal text count once).  A second look at the
pages then keeps of it what is a template:

* order: the tokens of a class are numbered by their place on a page; a token
  stays if its number is the same in every repetition on every page;
* nesting: a class that starts between two tokens of another one must end there,
  and must lie between the same two tokens on every page, else it goes (and may
  take classes inside it along, so text is rather kept);
* near copies: a page with ``NEAR_COPY`` of its text or more in candidate tokens
  tells no template from an article that many pages share.  All such pages of a
  host count as one page when the support is counted again, so the paragraphs of
  an article with many near copies are no template, and a host of nothing but
  such pages has none.

What lies between template tokens is a slot.  Slots under menus, headers, footers, sidebars, notices,
adverts, forms and comments are dropped by the element they lie in; where a page
has an article or main element, its slots are the text, else all slots that are
left, in both cases without the template's own text.

Vectors are never gathered: a token's vector is represented by two sums of
hashes of (page, count) modulo a prime, so a host with a third of all pages only
adds up partial sums; each of n copies of a page adds 1 / n of it.  A template is at most twice as long as an average page.

Defined results: null or empty html gives an empty text; pages of hosts with
fewer than ``MIN_PAGES`` distinct pages, or without a host, use the structure of the page
alone; broken markup closes at the next fitting end tag, an unclosed element at
the end; repeated rows get equal results; equal
page ids with different html are separate pages; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktwert.llm import common as C

MIN_SIZE = 2
MIN_PAGES = 3
SUPPORT = 0.5
#: Share of a page's text in candidate tokens from which it counts as a near copy.
NEAR_COPY = 0.7
_PRIME = (1 << 31) - 1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template",
                                                     "svg", "iframe", "select", "xmp", "noembed")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
           "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "object", "audio", "video", "canvas"}
_ARTICLE = {"article", "main"}
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|sidebar|side|aside|menu|nav|"
    r"navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|toolbar|comments?|disqus|replies|respond|cookies?|"
    r"consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|"
    r"recommended|pagination|pager|widget|search|login)(?:$|[\s_-])", re.I)


def _names(attributes: str) -> str:
    return " ".join(m.strip("\"'") for m in _NAMES.findall(attributes)) if "=" in attributes else ""


def walk(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, chrome, in article) of a page in order.  Kinds: ``tag``
    (value: path of a structural element), ``text`` (raw text), ``break``."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, chrome, article
    at = 0
    path, chrome, article = "", False, False
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], chrome, article
            return
        if m.start() > at:
            yield "text", page[at:m.start()], chrome, article
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag not in _INLINE:
                yield "break", "", chrome, article
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                path, chrome, article = stack[-1][1:] if stack else ("", False, False)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            yield "break", "", chrome, article
            continue
        if tag in _INLINE and not _CHROME.search(_names(m.group(3))):
            continue
        if tag not in _INLINE:
            yield "break", "", chrome, article
        if tag in _VOID or tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") \
                and not _CHROME.search(_names(m.group(3))):
            continue
        names = _names(m.group(3))
        path = f"{path}/{tag}.{names}" if names else f"{path}/{tag}"
        in_article = article or tag in _ARTICLE or "articlebody" in names.lower()
        # a header inside an article holds its title
        drops = tag in _NOT_TEXT or (tag == "header" and not article) or (
            tag not in ("html", "body", "article", "main") and bool(_CHROME.search(names))
            and not (tag == "header" and article))
        chrome, article = chrome or drops, in_article
        stack.append((tag, path, chrome, article))
        yield "tag", path, chrome, article


def placed(page: str) -> Iterator[tuple[int, int, bool]]:
    """Template candidates of a page in order: token (64-bit hash; even: element,
    odd: text node), length of its text, and whether extraction without a
    template returns that text."""
    path, seen_article = "", False
    rows: list[tuple[int, int, bool, bool]] = []
    for kind, value, chrome, article in walk(page):
        if kind == "tag":
            path = value
            seen_article = seen_article or article
            rows.append((xxhash.xxh64_intdigest(value) & ~1, 0, False, article))
        elif kind == "text" and (text := " ".join(value.split())):
            rows.append((xxhash.xxh64_intdigest(f"{path}|{text}") | 1, len(text), not chrome, article))
    for token, size, free, article in rows:
        yield token, size, free and (article or not seen_article)


def nested(places: list[tuple[int, int]]) -> tuple[dict[int, list[int]], set[int], dict[int, set[tuple[int, int]]]]:
    """Order and nesting of the classes on one page, given its (token, class) in
    order: the places of every token in its class, the classes that cross the
    one around them, and the slots (class, token before) that each class lies in."""
    runs: dict[int, list[int]] = {}
    for token, group in places:
        runs.setdefault(group, []).append(token)
    width = {group: len(set(run)) for group, run in runs.items()}
    ranks: dict[int, list[int]] = {}
    seen: Counter = Counter()
    crossing: set[int] = set()
    slots: dict[int, set[tuple[int, int]]] = {}
    open_: list[tuple[int, int]] = []  # class, its last token
    for token, group in places:
        rank = seen[group] % width[group]
        seen[group] += 1
        ranks.setdefault(token, []).append(rank)
        if rank == 0:
            slots.setdefault(group, set()).add(open_[-1] if open_ else (0, 0))
            open_.append((group, token))
        elif any(g == group for g, _ in open_):
            while open_[-1][0] != group:
                crossing.add(open_.pop()[0])
            open_[-1] = (group, token)
        if rank == width[group] - 1 and open_ and open_[-1][0] == group:
            open_.pop()
    return ranks, crossing, slots


def extract(page: str, template: frozenset[int] | set[int]) -> str:
    """Main text of a page, given the tokens of its host's template."""
    inside: list[str] = []
    anywhere: list[str] = []
    open_inside: list[str] = []
    open_anywhere: list[str] = []
    seen_article = False
    path = ""

    def end(parts: list[str], blocks: list[str]) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(text)

    for kind, value, chrome, article in walk(page):
        if kind == "text":
            if chrome:
                continue
            if article or not seen_article:
                text = " ".join(value.split())
                if not text or (xxhash.xxh64_intdigest(f"{path}|{text}") | 1) not in template:
                    (open_inside if article else open_anywhere).append(value)
        else:
            end(open_inside, inside)
            end(open_anywhere, anywhere)
            if kind == "tag":
                path = value
                seen_article = seen_article or article
    end(open_inside, inside)
    end(open_anywhere, anywhere)
    return " ".join(inside if seen_article else anywhere)


# ---- jobs ------------------------------------------------------------------
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marked(batches) -> Iterator[pa.RecordBatch]:
    """Pages with a mark of their text."""
    for batch in C.pieces(batches):
        marks = [_signed(xxhash.xxh64_intdigest(extract(p or "", frozenset()).encode("utf-8", "surrogatepass")))
                 for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(marks, pa.int64()), batch.column("html")],
                                         ["host", "mark", "html"])


def _vectors(batches) -> Iterator[pa.RecordBatch]:
    """Partial sums of the occurrence vectors of a batch."""
    for batch in C.pieces(batches):
        sums: dict[tuple[str, int], list] = {}
        for host, mark, copies, page in zip(*(batch.column(c).to_pylist() for c in ("host", "mark", "copies", "html"))):
            part = pow(copies, -1, _PRIME)
            found, returned = Counter(), set()
            for token, _, free in placed(page or ""):
                found[token] += 1
                if free:
                    returned.add(token)
            for token, n in found.items():
                h = xxhash.xxh64_intdigest(f"{mark}|{n}")
                row = sums.setdefault((host, token), [0.0, 0, 0, 0])
                row[3] |= token in returned
                row[0] += 1 / copies
                row[1] += (h & 0xFFFFFFFF) * part % _PRIME
                row[2] += (h >> 32) * part % _PRIME
        keys, values = list(sums), list(sums.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()),
             pa.array([v[0] for v in values], pa.float64()),
             *[pa.array([int(v[i]) for v in values], pa.int64()) for i in (1, 2, 3)]],
            ["host", "token", "pages", "v1", "v2", "free"])


_CHECKED = ("host string, token long, varied double, near long, low long, high long, crossing long, "
            "first_slot long, last_slot long")


def _checked(batches) -> Iterator[pa.RecordBatch]:
    """Per host and candidate token of a batch: pages that hold it (near copies
    apart), least and greatest place in its class, crossings, least and greatest
    slot.  Token 0 stands for the pages of the host."""
    names = [c.split()[0] for c in _CHECKED.split(", ")]
    for batch in C.pieces(batches):
        known: dict[str, dict[int, int]] = {}
        sums: dict[tuple[str, int], list] = {}
        for host, copies, page, classes in zip(*(batch.column(c).to_pylist() for c in ("host", "copies", "html", "classes"))):
            if host not in known:
                known[host] = {c["token"]: c["class"] for c in classes}
            group_of = known[host]
            places, shared, returned = [], 0, 0
            for token, size, free in placed(page or ""):
                group = group_of.get(_signed(token))
                if group is not None:
                    places.append((_signed(token), group))
                if free:
                    returned += size
                    shared += size if group is not None else 0
            near = returned > 0 and shared >= NEAR_COPY * returned
            ranks, crossing, slots = nested(places)
            marks = {g: [_signed(xxhash.xxh64_intdigest(f"{s}")) for s in found] for g, found in slots.items()}
            for token, group, rank in [(0, None, [0]), *((t, group_of[t], r) for t, r in ranks.items())]:
                slot = marks.get(group, [0])
                row = sums.setdefault((host, token), [0.0, 0, rank[0], rank[0], 0, slot[0], slot[0]])
                if near:
                    row[1] = 1
                else:
                    row[0] += 1 / copies
                row[2], row[3] = min(row[2], *rank), max(row[3], *rank)
                row[4] |= group in crossing
                row[5], row[6] = min(row[5], *slot), max(row[6], *slot)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()),
             pa.array([v[0] for v in sums.values()], pa.float64()),
             *[pa.array([int(v[i]) for v in sums.values()], pa.int64()) for i in range(1, 7)]], names)


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _distinct(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of known hosts with the ``copies`` of their text, and the distinct
    texts of each host."""
    known = pages.where("host <> ''").select("host", "html").mapInArrow(_marked, "host string, mark long, html string")
    distinct = C.store(spark, known.groupBy("host", "mark").agg(F.count("*").alias("copies")), "distinct")
    repeated = C.store(spark, distinct.where("copies > 1"), "repeated")
    return (known.join(repeated, ["host", "mark"], "left")
            .select("host", "mark", F.coalesce("copies", F.lit(1)).alias("copies"), "html")), distinct


def templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``host`` and ``template`` (tokens of its candidate classes), ``classes``
    (these tokens with their class) and ``free`` (extraction returns text of
    one); ``pages`` has ``host``, ``id``, ``html``."""
    return _candidates(spark, *_distinct(spark, pages))


def _candidates(spark: SparkSession, counted: DataFrame, distinct: DataFrame) -> DataFrame:
    sums = (counted.mapInArrow(_vectors, "host string, token long, pages double, v1 long, v2 long, free long")
            .groupBy("host", "token").agg(F.round(F.sum("pages")).cast("long").alias("pages"), F.max("free").alias("free"),
                                          *[F.pmod(F.sum(c), F.lit(_PRIME)).alias(c) for c in ("v1", "v2")]))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= MIN_PAGES)
    strong = C.store(spark, sums.join(hosts, "host").where(
        F.col("pages") >= F.greatest(F.lit(MIN_PAGES), SUPPORT * F.col("all"))), "vectors")
    classes = (strong.groupBy("host", "pages", "v1", "v2")
               .agg(F.count("*").alias("size"), F.max((F.col("token") % 2 == 0).cast("int")).alias("element"))
               .where((F.col("size") >= MIN_SIZE) & (F.col("element") == 1)))
    named = strong.join(classes.select("host", "pages", "v1", "v2"), ["host", "pages", "v1", "v2"])
    return named.groupBy("host").agg(
        F.collect_set("token").alias("template"), F.max("free").alias("free"),
        F.collect_list(F.struct("token", F.xxhash64("pages", "v1", "v2").alias("class"))).alias("classes"))


def valid_templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``host`` and ``template``: the candidate tokens that keep order and
    nesting and have their support without near copies.  Hosts whose candidates
    hold no text that extraction returns are left out: their template changes
    nothing, and their pages are not read again."""
    counted, distinct = _distinct(spark, pages)
    found = C.store(spark, _candidates(spark, counted, distinct).where("free = 1").select("host", "classes"), "candidates")
    checked = C.store(spark, counted.join(found, "host").select("host", "copies", "html", "classes")
                      .mapInArrow(_checked, _CHECKED).groupBy("host", "token")
                      .agg((F.round(F.sum("varied")) + F.max("near")).cast("long").alias("pages"),
                           F.min("low").alias("low"), F.max("high").alias("high"), F.max("crossing").alias("crossing"),
                           F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot")), "checked")
    hosts = checked.where("token = 0").select("host", F.col("pages").alias("all"))
    return (checked.where("token <> 0 and low = high and crossing = 0 and first_slot = last_slot").join(hosts, "host")
            .where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), SUPPORT * F.col("all")))
            .groupBy("host").agg(F.collect_set("token").alias("template")))


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        known: dict[tuple, frozenset] = {}
        out = []
        for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
            key = tuple(template or ())
            if key not in known:
                known[key] = frozenset(t % (1 << 64) for t in key)
            out.append(extract(page or "", known[key]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())],
                                         ["id", "url", "text"])


def main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """``id``, ``url`` and ``text`` of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(url_col).alias("host"))
    found = C.store(spark, valid_templates(spark, rows.select("host", "id", "html")), "templates")
    return (rows.join(found, "host", "left").select("id", "url", "html", "template")
            .mapInArrow(_extract, f"id {kind}, url string, text string"))
