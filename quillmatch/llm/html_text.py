"""Main text of web pages by nearest-URL page differencing.

Method: within each host pages are ordered by URL path, and each is paired with its neighbours before and after. The text lines (blocks) of a pair are
aligned by longest common subsequence; lines shared with a neighbour are the site's, not the page's, and go. Markup that states what a part is for
comes first: menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles go even if no neighbour has them. A container
is evidence: a ``main`` element is the main part, ``article`` elements are if they hold at least half of the characters outside of boilerplate (teaser cards don't). Nothing outside of a
main part stays. On other pages all lines outside of boilerplate are compared with both neighbours.

Inside a main part a line goes only if two of the four nearest pages (two before, two after) share it and aren't copies: a page that shares half of the main part's characters or more has the same
article, and says nothing about whose lines they are. So copied articles stay, and so do passages that one neighbour quotes.

Shape: pairing works on a narrow table (host, path, key, and lengths and 64-bit hashes of lines) that is dealt by ranges of host and path and
numbered, so a host with a third of all pages is spread over many tasks; neighbours are found by number. Only texts that lose lines
travel, to be joined with their deletions by key.

Cases: null and empty html give an empty text; a null url belongs to the empty host; repeated rows each get their result; unclosed elements end with the
page; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.rows import map_blocks, maybe_among
from quillmatch.shared import written

# Element names by their role, and tokens of class, id and role attributes that mark parts which are not the article: fixed values.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button xmp noembed noframes object".split())
SKIPPED = frozenset("nav header footer aside form menu dialog head".split())
NOT_MAIN = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that go with those of NOT_MAIN in names of parts, and headings, whose ids are made from their text.
PARTS = frozenset("area article articles bar block box button buttons container content form inner item items link links list media module outer panel post posts row section slot stories story top bottom unit widget wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
MAIN, OTHER = 1, 0
#: Columns for the lines of pages so many ranks before.
NEAR = {1: "before", -1: "after", 2: "before2", -2: "after2"}


def names_boiler(value: str) -> bool:
    """Whether one of the class or id names in a main container says that its part isn't the article: all of its words must, as ids made from headings hold words of any kind. A notice
    alone may be the article's."""
    for one in value.split():
        found = set(WORD.findall(one))
        if found <= NOT_MAIN | PARTS and found & NOT_MAIN - {"notice", "notices"}:
            return True
    return False


def is_boiler(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element's own markup says that it isn't part of the article. An article's own header stays, as it holds the headline."""
    if name in SKIPPED and not (name == "header" and in_main):
        return True
    if attributes:
        for k, *values in ATTRIBUTE.findall(attributes):
            k, value = k.lower(), next(filter(None, values), "").lower()
            if k == "role":
                if value in ROLES:
                    return True
            elif k == "hidden":
                return True
            elif in_main:
                if not (k == "id" and name in HEADINGS) and name not in ("article", "main") and names_boiler(value):
                    return True
            elif name not in ("body", "html", "article", "main") and not NOT_MAIN.isdisjoint(WORD.findall(value)):
                return True
    return False


def lines_of(page: str) -> tuple[list[str], bool]:
    """(text lines outside of boilerplate, whether they are those of a main container). Lines are blocks with references decoded and white space made one space."""
    lines: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # element, whether in boilerplate, whether in a main container
    boiler = inside = stated = False
    parts: list[str] = []

    def flush():
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text and not boiler:
                lines.append((text, inside))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1]
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    boiler, inside = open_[-1][1:] if open_ else (False, False)
                    break
        elif not m[3].endswith("/"):
            if name not in BLOCK and not m[3]:
                continue  # an inline element without attributes changes nothing
            now = boiler or is_boiler(name, m[3], inside)
            if now and not boiler and name not in BLOCK:
                flush()
            boiler_before, boiler = boiler, now
            inside = inside or (not now and (name in ("article", "main") or 'role="main"' in m[3]))
            stated = stated or inside and (name == "main" or 'role="main"' in m[3])
            if name == "p" and open_ and open_[-1][0] == "p":
                open_.pop()
            open_.append((name, boiler, inside))
    flush()
    held = [t for t, k in lines if k]
    if held and (stated or 2 * sum(map(len, held)) >= sum(len(t) for t, _ in lines)):
        return held, True
    return [t for t, _ in lines], False


def line_hashes(lines: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(t) - (1 << 63) for t in lines]


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Indices into ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k] = j
                chains[k] = link
    got, link = set(), chains[-1] if chains else None
    while link:
        got.add(link[0])
        link = link[1]
    return got


def neighbours(pages: DataFrame) -> DataFrame:
    """(key, lines, sizes, has_main, before, after, before2, after2) for distinct pages: the line hashes of the pages next to each in its host by path."""
    spark = pages.sparkSession
    ordered = pages.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("__at", F.monotonically_increasing_id())
    ordered = written(ordered, "ordered")
    # One row per range, of their number: the ranks at which ranges begin.
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("__at", 33).alias("r")).count().collect())
    begins, total = {}, 0
    for r, n in sizes:
        begins[r] = total
        total += n
    offsets = spark.createDataFrame([(int(r), int(b)) for r, b in begins.items()] or [(0, 0)], "r long, begin long")
    ranked = ordered.withColumn("r", F.shiftright("__at", 33)).join(F.broadcast(offsets), "r").withColumn("rank", F.col("begin") + F.col("__at").bitwiseAND((1 << 33) - 1))
    ranked = written(ranked.select("rank", "host", "key", "lines", "sizes", "has_main"), "ranked")
    both = ranked
    for d in (1, -1, 2, -2):
        side = ranked.select((F.col("rank") + d).alias("rank"), F.col("host").alias("h"), F.col("lines").alias("l"))
        both = both.join(side, "rank", "left").withColumn(NEAR[d], F.when(F.col("h") == F.col("host"), F.col("l"))).drop("h", "l")
    return both.select("key", "lines", "sizes", "has_main", *NEAR.values())


def site_lines(lines: list[int], sizes: list[int], has_main: bool, near: list) -> list[int]:
    """The indices of a page's lines that are the site's; ``near`` has the lines of the pages before and after it, then of those two before and two after."""
    if not has_main:
        return sorted(set().union(*(shared_lines(lines, n or []) for n in near[:2])))
    total, count = sum(sizes), [0] * len(lines)
    for n in near:
        got = shared_lines(lines, n) if n else ()
        if 2 * sum(sizes[i] for i in got) < total:  # else a copy
            for i in got:
                count[i] += 1
    return [i for i, c in enumerate(count) if c > 1]


def deletions(pairs: DataFrame) -> DataFrame:
    """(key, shared): the indices of each page's lines that are the site's."""

    def make():
        def run(block):
            lines, sizes, has_main, *near = (block.column(block.schema.get_field_index(c)).to_pylist() for c in ("lines", "sizes", "has_main", *NEAR.values()))
            return [[site_lines(*page, n) for *page, n in zip(lines, sizes, has_main, zip(*near))]]

        return run

    return map_blocks(pairs, make, "shared array<int>", drop=["lines", "sizes", "has_main", *NEAR.values()]).where(F.size("shared") > 0)


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    whole = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    pages = df.select(F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(address, whole).alias("key"), F.col(f"`{html}`").alias("html"))

    def make():
        def run(block):
            got = [lines_of(p or "") for p in block.column(block.schema.get_field_index("html")).to_pylist()]
            return [[g[0] for g in got], [line_hashes(g[0]) for g in got], [[len(t) for t in g[0]] for g in got], [g[1] for g in got]]

        return run

    parsed = written(map_blocks(pages, make, "text_lines array<string>, lines array<long>, sizes array<int>, has_main boolean", drop=["html"]), "parsed")
    narrow = parsed.groupBy("host", "path", "key").agg(*[F.first(c).alias(c) for c in ("lines", "sizes", "has_main")])
    gone = written(deletions(neighbours(narrow)), "gone")
    marked = maybe_among(parsed.select("page", "url", "text_lines", "key"), F.col("key"), gone.select("key"))
    columns = ["page", "url", "text_lines", "shared"]
    whole_ = marked.where("not __maybe").withColumn("shared", F.lit(None).cast("array<int>"))
    cut = marked.where("__maybe").join(gone, "key", "left")
    every = whole_.select(columns).unionByName(cut.select(columns))
    kept = F.when(F.col("shared").isNull(), F.col("text_lines")).otherwise(F.filter("text_lines", lambda t, i: ~F.array_contains("shared", i)))
    text = F.array_join(kept, "\n\n")
    return every.select(F.col("page").alias(key), F.col("url").alias(url), text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op8(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
