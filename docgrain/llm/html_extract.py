"""Main text of web pages, with site templates removed by counting element subtrees.

Every element subtree of block level is hashed (tag, class, and the hashes or text below it) and told by its slot, the path of
tags and classes above it. Spark counts on how many pages of a host with different articles each stands. Templates are

* subtrees on min_share of such pages of the host, and on min_pages at least;
* subtrees on min_repeats of them at least in a slot whose fillings mostly are such repeats (slot_share), as sites deal their
  menus, notices and adverts from a pool, while what recurs in the article's slots now and then is a quotation.

Pages whose articles have the same least hash of word runs count once, so that copies and near copies of an article do not make
its paragraphs a template. Templates are deleted wherever they stand in their slot. Hosts of few pages have no templates; so elements
whose tag, role or class names a page part that is never the article (menus, footers, forms, ...) go as well. What is left
of the article, or of several in page order, is the text.

Null or empty html gives an empty text; a null url counts as a host of its own; repeated rows give repeated rows;
columns other than the three are ignored. Pages are parsed in time linear in their length, whatever their depth.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, small_batches

#: Elements that HTML never closes, and those whose end the next of their kind implies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Page parts that are not the article.
NEVER = RAW | frozenset("head nav footer aside form button select input dialog menu noframes audio video".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NEVER_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar"
    " navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe signup login comment comments commentlist respond disqus replies reply share sharing social related recommended recommendations"
    " pagination pager widget widgets skip hidden".split()
)
#: Of these, parts that may hold <article> elements of their own, one for each remark.
READERS_WORD = frozenset("comment comments commentlist respond disqus replies reply related recommended recommendations".split())
ARTICLE_WORD = frozenset("article content main post entry story body text".split())
TAG_END = re.compile(r"=[ \t\r\n\f]*[\"']|>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Element:
    """An element of a page. A page is a list of elements and texts in page order; an element's subtree ends before the item numbered end."""

    __slots__ = ("tag", "attrs", "up", "end", "held")

    def __init__(self, tag: str, attrs: str = "", up: int = 0):
        self.tag, self.attrs, self.up, self.end, self.held = tag, attrs, up, 0, None

    def marks(self) -> tuple[frozenset[str], str]:
        """Words of class and id, and the role."""
        if self.held is None:
            words, role = set(), ""
            if self.attrs and not self.attrs.isspace():
                for m in ATTRIBUTE.finditer(self.attrs):
                    name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                    if name in ("class", "id"):
                        words.update(x.lower() for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if x)
                    elif name == "role":
                        role = value.strip().lower()
                    elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                        words.add("hidden")
            self.held = (frozenset(words), role)
        return self.held


class Open:
    """The elements that are open while a page is parsed, found by tag without a search."""

    def __init__(self, items: list):
        self.items, self.stack, self.places, self.blocks = items, [0], {}, [0]

    def push(self, at: int) -> None:
        tag = self.items[at].tag
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(at)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((held[-1] for t in tags if (held := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > max(1, place):
            x = self.items[self.stack.pop()]
            x.end = len(self.items)
            self.places[x.tag].pop()
            if x.tag in BLOCK:
                self.blocks.pop()


def tag_end(text: str, at: int, unmatched: set) -> int:
    """Where the > of a start tag stands, quoted values stepped over; -1 if there is none. unmatched: quotes that don't come again."""
    while m := TAG_END.search(text, at):
        if m[0] == ">":
            return m.start()
        quote, at = m[0][-1], m.end()
        if quote not in unmatched:
            close = text.find(quote, at)
            if close < 0:
                unmatched.add(quote)
            else:
                at = close + 1
    return -1


RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def parse(text: str) -> list:
    """Elements and texts in page order, the root first, as lenient as browsers are about missing ends. Each character is looked at a fixed number of times."""
    items: list = [Element("#root")]
    opened = Open(items)
    unmatched: set[str] = set()
    at, n = 0, len(text)

    def texts(x: str) -> None:
        items.append((opened.stack[-1], x))

    while at < n:
        start = text.find("<", at)
        if start < 0:
            texts(text[at:])
            break
        if start > at:
            texts(text[at:start])
        at = start + 1
        first = text[at : at + 1]
        if first in ("!", "?"):
            if text.startswith("!--", at):
                end = text.find("-->", at + 3)
                at = n if end < 0 else end + 3
            elif text.startswith("![CDATA[", at):
                end = text.find("]]>", at)
                texts(html_lib.escape(text[at + 8 : end if end >= 0 else n], quote=False))
                at = n if end < 0 else end + 3
            else:
                end = text.find(">", at)
                at = n if end < 0 else end + 1
            continue
        closing = first == "/"
        m = NAME.match(text, at + closing)
        if m is None:
            if closing and (end := text.find(">", at)) >= 0:
                at = end + 1  # a stray end without a name says nothing
            else:
                texts("<")
            continue
        end = text.find(">", m.end()) if closing else tag_end(text, m.end(), unmatched)
        if end < 0:
            texts(text[start:])  # no tag ends from here on
            break
        at, tag, attrs = end + 1, m[0].lower(), text[m.end() : end]
        if closing:
            place = opened.last((tag,))
            # A stray inline end does not close a block.
            if place and (tag in BLOCK or opened.blocks[-1] < place):
                opened.close(place)
            continue
        if tag in BLOCK and (place := opened.last(("p",))) and place >= opened.blocks[-1]:
            opened.close(place)  # a block ends an open paragraph
        if tag in SELF_CLOSING:
            ends, stops = SELF_CLOSING[tag]
            if (place := opened.last(ends)) > opened.last(stops):
                opened.close(place)
        node = Element(tag, attrs, opened.stack[-1])
        items.append(node)
        node.end = len(items)
        if attrs.endswith("/"):
            continue
        if tag in RAW:
            found = RAW_END[tag].search(text, at)
            items.append((len(items) - 1, text[at : found.start() if found else n]))
            node.end = len(items)
            at = found.end() if found else n
        elif tag not in VOID:
            opened.push(len(items) - 1)
    opened.close(1)
    items[0].end = len(items)
    return items


def page_parts(items: list) -> set[int]:
    """The elements that are parts of a page and never the article, told by tag, role and class."""
    inner = [i for i, x in enumerate(items) if type(x) is Element and x.tag in ("article", "main")]
    out, i, inside = set(), 1, 0
    while i < len(items):
        x = items[i]
        if type(x) is Element:
            gone = x.tag in NEVER or x.tag == "header" and i >= inside
            if not gone and x.attrs:
                words, role = x.marks()
                gone = role in NEVER_ROLE or x.tag not in ("html", "body") and bool(words & READERS_WORD)
                if not gone and words & NEVER_WORD and x.tag not in ("html", "body", "article", "main"):
                    k = bisect_left(inner, i)
                    gone = k == len(inner) or inner[k] >= x.end
            if gone:
                out.add(i)
                i = x.end
                continue
            if x.tag in ("article", "main"):
                inside = max(inside, x.end)
        i += 1
    return out


def blocks(items: list, tops: list[int], gone: set[int] = frozenset()) -> list[str]:
    """The texts of the blocks inside these elements in page order: references decoded, white space one space, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)

    for top in tops:
        i, stop, ends = top + 1, items[top].end, []
        while i < stop:
            while ends and ends[-1] <= i:
                ends.pop()
                flush()
            x = items[i]
            if type(x) is not Element:
                run.append(x[1])
            elif i in gone:
                if x.tag in BLOCK:
                    flush()
                i = x.end
                continue
            elif x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                flush()
                ends.append(x.end)
            i += 1
        flush()
    return out


def digest(*parts: bytes) -> int:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(len(p).to_bytes(4, "little"))
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


#: What holds the page or its article; never a template itself.
FRAME = frozenset(("html", "body", "article", "main"))


def subtree_hashes(items: list) -> list[tuple[int, int, int]]:
    """(item, slot, key) of the block elements with text: a hash of the path of tags and classes from the root, and one of slot and subtree."""
    below: dict[int, list[bytes]] = {}
    names: dict[int, bytes] = {}
    held, keys = set(), {}
    for i in range(len(items) - 1, 0, -1):  # an element's subtree comes before it
        x = items[i]
        if type(x) is not Element:
            if clean := " ".join(x[1].split()):
                below.setdefault(x[0], []).append(b"t" + clean.encode("utf-8", "surrogatepass"))
                held.add(x[0])
            continue
        names[i] = " ".join([x.tag, *(sorted(x.marks()[0]) if x.attrs else ())]).encode("utf-8", "surrogatepass")
        keys[i] = digest(names[i], *reversed(below.pop(i, ())))
        below.setdefault(x.up, []).append(b"e" + keys[i].to_bytes(8, "little", signed=True))
        if i in held:
            held.add(x.up)
    slots, out = {0: 0}, []
    for i, x in enumerate(items):
        if i and type(x) is Element:
            slots[i] = slot = digest(slots[x.up].to_bytes(8, "little", signed=True), names[i])
            if i in held and x.tag in BLOCK and x.tag not in FRAME:
                out.append((i, slot, slot ^ keys[i]))
    return out


def sizes(items: list, gone: set[int]) -> tuple[list[int], list[int]]:
    """Characters before each item, without links and with them; what is gone has none."""
    own, every = [0] * (len(items) + 1), [0] * (len(items) + 1)
    i, linked = 0, 0
    while i < len(items):
        x = items[i]
        if i in gone:
            for k in range(i + 1, x.end + 1):
                own[k], every[k] = own[i], every[i]
            i = x.end
            continue
        own[i + 1], every[i + 1] = own[i], every[i]
        if type(x) is not Element:
            k = len(x[1].strip())
            every[i + 1] += k
            own[i + 1] += 0 if i < linked else k
        elif x.tag == "a":
            linked = max(linked, x.end)
        i += 1
    return own, every


def outermost(items: list, gone: set[int], want) -> list[int]:
    """The elements that want takes and that are in none that it takes."""
    out, i = [], 1
    while i < len(items):
        x = items[i]
        if type(x) is Element and (i in gone or want(x)):
            if i not in gone:
                out.append(i)
            i = x.end
        else:
            i += 1
    return out


def article(items: list, gone: set[int]) -> tuple[list[int], set[int]]:
    """The elements that hold the article, and what is gone from them.

    All elements <article>, or all that are <main>; else a container named so that holds most of the page; else the page, of
    which lists and boxes that are mostly links go.
    """
    own, every = sizes(items, gone)
    size = lambda i: own[items[i].end] - own[i]
    for name in ("article", "main"):
        if found := [i for i in outermost(items, gone, lambda x: x.tag == name or bool(x.attrs) and x.marks()[1] == name) if size(i)]:
            return found, gone
    named = outermost(items, gone, lambda x: x.tag in ("div", "section", "td") and bool(x.attrs) and bool(x.marks()[0] & ARTICLE_WORD))
    if named and 2 * size(best := max(named, key=size)) >= size(0):
        return [best], gone
    lists, i = [], 1
    while i < len(items):
        x = items[i]
        if type(x) is Element and (i in gone or x.tag in ("ul", "ol", "div", "section", "table", "dl") and 2 * size(i) < every[x.end] - every[i]):
            lists.append(i)
            i = x.end
        else:
            i += 1
    return [0], gone.union(lists)


def extract(text: str, templates=frozenset(), parts: bool = True) -> str:
    """The main text of one page; templates: keys of its host's recurring subtrees. Without parts, tags and classes say nothing and templates alone decide."""
    if not text:
        return ""
    items = parse(text)
    gone = {i for i, _, key in subtree_hashes(items) if key in templates} if templates else set()
    if not parts:
        gone.update(i for i, x in enumerate(items) if type(x) is Element and (x.tag in RAW or x.tag == "head"))
        return "\n".join(blocks(items, [0], gone))
    return "\n".join(blocks(items, *article(items, gone | page_parts(items))))


RUN = 5


def page_subtrees(text: str) -> tuple[dict[int, int], int]:
    """The slot of each subtree key of a page, and the least hash of the runs of RUN words of its main text."""
    if not text:
        return {}, 0
    items = parse(text)
    words = "\n".join(blocks(items, *article(items, page_parts(items)))).encode("utf-8", "surrogatepass").split()
    least = min((xxhash.xxh64_intdigest(b" ".join(words[i : i + RUN])) for i in range(max(1, len(words) - RUN + 1))), default=0)
    return {key: slot for _, slot, key in subtree_hashes(items)}, least - (1 << 63)


def host_of(url):
    """The host of a URL in lower case, empty for a null or a text that is no URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


MIN_PAGES, MIN_SHARE, MIN_REPEATS, SLOT_SHARE, SLOT_PAGES = 5, 0.3, 3, 0.5, 10


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_repeats: int = MIN_REPEATS, slot_share: float = SLOT_SHARE, slot_pages: int = SLOT_PAGES) -> DataFrame:
    """(host_key, subtree): keys of subtrees that stand on min_share of a host's pages and on min_pages at least, or on min_repeats at least in
    a slot of slot_pages fillings or more of which slot_share are such repeats.

    Pages of one article count once. Rows are summed before each shuffle; a host of any size is spread over its subtrees.
    """
    ship(pages.sparkSession)

    def emit(batches):
        for batch in small_batches(batches, 1 << 20):
            host, slots, keys, main = [], [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, sig = page_subtrees(text or "")
                n = len(found) + 1
                host.append(np.full(n, h))
                main.append(np.full(n, sig))
                keys.append(np.fromiter((0, *found), np.int64, n))  # 0 stands for the page itself
                slots.append(np.fromiter((0, *found.values()), np.int64, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (host, slots, keys, main)], names=["host_key", "slot", "subtree", "main"])

    rows = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host_key"), "html").mapInArrow(emit, "host_key long, slot long, subtree long, main long")
    counts = rows.distinct().groupBy("host_key", "slot", "subtree").agg(F.count(F.lit(1)).alias("n"))
    # What does not recur is only needed as a sum of its slot.
    often = F.col("n") >= min(min_repeats, min_pages)
    counts = counts.groupBy("host_key", "slot", F.when(often | (F.col("subtree") == 0), F.col("subtree")).alias("subtree")).agg(F.sum("n").alias("n"))
    counts = saved(counts, "subtree-counts")
    slots = counts.groupBy("host_key", "slot").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("subtree").isNotNull() & (F.col("n") >= min_repeats), F.col("n"))).alias("again"))
    total = counts.where("subtree = 0").select("host_key", F.col("n").alias("total"))
    found = counts.where("subtree <> 0").join(slots, ["host_key", "slot"]).join(total, "host_key")
    common = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("total"))
    dealt = (F.col("n") >= min_repeats) & (F.col("all") >= slot_pages) & (F.col("again") >= slot_share * F.col("all"))
    return found.where(common | dealt).select("host_key", "subtree")


#: Templates up to this many are sent to every executor (16 bytes each); beyond it they are joined by page.
MOST_BROADCAST = 1_000_000


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_broadcast: int = MOST_BROADCAST, parts: bool = True, **rule) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page. Without parts, templates alone decide; rule: further parameters of site_templates."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select("page_id", "url", "html")
    templates = saved(site_templates(pages, min_pages, min_share, **rule), "templates")
    n = templates.count()
    schema = "page_id long, url string, text string, n_chars long"
    with_host = pages.withColumn("host_key", F.xxhash64(host_of(F.col("url"))))

    def result(ids, urls, texts):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if n <= most_broadcast:
        got = templates.toArrow()
        order = np.argsort(host := got.column(0).to_numpy(), kind="stable")
        held = spark.sparkContext.broadcast((host[order], got.column(1).to_numpy()[order]))

        def run(batches):
            hosts, keys = held.value
            sets: dict[int, frozenset] = {}
            for batch in small_batches(batches):
                ids, urls, pages_, own = (c.to_pylist() for c in batch.columns)
                texts = []
                for h, text in zip(own, pages_):
                    if h not in sets:
                        if len(sets) > 4096:
                            sets.clear()
                        a, b = np.searchsorted(hosts, [h, h], side="left")[0], np.searchsorted(hosts, h, side="right")
                        sets[h] = frozenset(keys[a:b].tolist())
                    texts.append(extract(text or "", sets[h], parts))
                yield result(ids, urls, texts)

        return with_host.mapInArrow(run, schema)

    def emit(batches):
        for batch in small_batches(batches, 1 << 20):
            rows = [(a, b, h, k) for a, b, h, text in zip(*(c.to_pylist() for c in batch.columns)) for k in page_subtrees(text or "")[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["row_a", "row_b", "host_key", "subtree"])

    # A page is told by 128 bits.
    keyed = with_host.withColumn("row_a", F.xxhash64("page_id", "url", "html")).withColumn("row_b", F.xxhash64(F.lit(1), "html", "url", "page_id"))
    hits = keyed.select("row_a", "row_b", "host_key", "html").mapInArrow(emit, "row_a long, row_b long, host_key long, subtree long").join(templates, ["host_key", "subtree"], "left_semi")
    drop = hits.groupBy("row_a", "row_b").agg(F.collect_set("subtree").alias("drop"))

    def run_joined(batches):
        for batch in small_batches(batches):
            ids, urls, pages_, drops = (c.to_pylist() for c in batch.columns)
            yield result(ids, urls, [extract(t or "", frozenset(d or ()), parts) for t, d in zip(pages_, drops)])

    return keyed.join(drop, ["row_a", "row_b"], "left").select("page_id", "url", "html", "drop").mapInArrow(run_joined, schema)
