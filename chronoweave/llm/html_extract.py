"""Main text of HTML pages: structure, and differencing against the page with the nearest URL.

Pages become lines, one for each block. Pages of a host are ordered by URL path; each is aligned, by longest
common subsequence of lines, with the neighbour whose path shares the longer prefix (the earlier one on
ties), and shared lines go. Inside <article> or <main> a shared line goes only if all of its text is links:
prose there is the page's own by its mark-up, even if a neighbour quotes it; with such an element, lines
outside it go as well, but for the h1 before an article that has none. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
go by element, role, class or id, and hidden elements go; the header of an article, with its headline, stays.

End tags may be left out where HTML allows it (p, li, td and so on end where the next one begins or their
parent ends). An unwanted element that is never closed ends where an article, main, section or h1 begins, a
menu also at a paragraph or heading. A class or id counts only as a whole: every part of it between hyphens or
capitals must belong to the name of such a block, so ``site-footer`` and ``adContainer`` go and ``no-sidebar`` and
``article-header`` do not. A single paragraph or heading is not taken for a menu, header or share bar by its class,
and of several articles the first one never goes by its class. A tag that is never closed ends where the next begins.

Scale: URLs alone are sorted into ranges of the order (host, path, page_id) of about ``RANGE_PAGES`` pages, so a
host with a third of all pages is many ranges. Texts are shuffled once, by range; the first and last page of
each range also visit the neighbouring range, so every page meets its true neighbours. The driver keeps two
keys per range; ranges grow in number with the pages, and in size only beyond ``RANGES`` of them.

Defined cases: null or empty html gives an empty text; a null url is its own host with an empty path; a url
may hold any byte; a null page_id sorts first; a neighbour that shares all of a page's lines is a copy of it and
removes nothing; repeated rows give equal rows; an empty table gives no rows; extra columns are left out.
"""

import html
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import small_batches

RANGE_PAGES, RANGES = 1000, 100_000
# Elements by how HTML reads them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# What a start tag ends, and the elements beyond which it does not look.
CELL = {"td", "th", "caption", "table", "html", "button", "object"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
ENDS_P = BLOCKS - {"br", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
OPTIONAL = {"p", "li", "dd", "dt", "td", "th", "tr", "option", "optgroup", "tbody", "thead", "tfoot"}
# Roles, parts of names, and the parts that may stand beside them, of what is not main text.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising banner banners cookie cookies notice notices sidebar sidebars menu menus nav navbar navigation comment comments commentlist disqus respond "
    "footer header promo promos promotion sponsored sponsor sponsors share sharing social breadcrumb breadcrumbs newsletter subscribe popup modal consent gdpr related recommended".split()
)
BESIDE = set(
    "top bottom left right main site page global primary secondary sub mobile box bar block inner outer container wrapper wrap list section area item items slot unit widget link links button buttons form signup text "
    "reader user post posts icons media thread message panel overlay layer the by and of to".split()
)
#: The first article of a page is its own; a later one goes by these names.
OTHERS = {"comment", "comments", "related", "recommended", "promo", "promos", "sponsored", "ad", "ads", "advert", "teaser", "teasers"}
#: Blocks that hold prose of their own, and names that are as likely to say what it is about.
SINGLE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
TOPICS = {"social", "related", "recommended", "header", "banner", "banners", "sponsor", "sponsors", "promotion", "respond", "share", "sharing", "nav", "navigation", "menu", "menus"}
KNOWN = BLOCKS | VOID | RAW | DROPPED | set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# A quoted value may hold anything up to 4,096 characters, and beyond that all but "<"; a lone quote is an ordinary character. A tag that is never closed ends
# where the next one starts. So no attempt reads far, however a page is broken.
_QUOTED = """"(?:[^"<]*+"|[^"]{0,4096}+")|'(?:[^'<]*+'|[^']{0,4096}+')"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|{_QUOTED}|["'])*+(?=>)|[^<>]*+)(>?)|<[!?][^<>]*+>""", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_ATTR = re.compile(r"""(?<![^\s"'])(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[^_-]+")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z_-]+")


def _names(value: str, unwanted: set) -> bool:
    """Whether some name of a class or id attribute is one of an unwanted block, cut at hyphens or at capitals."""
    for name in value.split():
        for cut in (_PART.findall(name), _HUMP.findall(name)):
            parts = [p for p in (x.lower().rstrip("0123456789") for x in cut) if p]
            if any(p in unwanted for p in parts) and all(p in NAMES or p in OTHERS or p in BESIDE for p in parts):
                return True
    return False


def _unwanted(name: str, attrs: str, inside: bool, later: bool) -> bool:
    """Whether an element is none of the main text; ``inside`` an article or main, ``later``: an article after the first."""
    if name in DROPPED:
        return not (inside and name == "header")
    if name in ("html", "body", "main"):
        return False
    if "hidden" in attrs.lower() and _HIDDEN.search(_VALUE.sub('""', attrs)):
        return True
    if "=" not in attrs:
        return False
    unwanted = (OTHERS if later else set()) if name == "article" else NAMES - TOPICS if name in SINGLE else NAMES - {"header"} if inside else NAMES
    for m in _ATTR.finditer(attrs):
        value, kind = html.unescape(m[2] or m[3] or m[4] or ""), m[1].lower()
        if kind == "style":
            found = _UNSEEN.search(value)
        elif kind == "role":
            found = value.strip().lower() in ROLES and name != "article"
        else:
            found = _names(value, unwanted)
        if found:
            return True
    return False


class _Balance:
    """Whether an element that starts at some place is closed later on the page."""

    def __init__(self, page: str):
        self.page, self.at = page, None

    def closed(self, name: str, at: int) -> bool:
        if self.at is None:
            self.at = {}
            for m in _NAME.finditer(self.page):
                self.at.setdefault(m[2].lower(), ([], []))[bool(m[1])].append(m.start())
        starts, ends = self.at.get(name, ([], []))
        return len(ends) - bisect_left(ends, at) > len(starts) - bisect_left(starts, at)


def page_lines(page) -> list[tuple[str, bool, bool]]:
    """(line, inside article or main, only links) of each block, without unwanted subtrees; time is in proportion to the page.

    Where the article has no h1 of its own, the last one before it counts as inside.
    """
    out: list[tuple[str, bool, bool]] = []
    if not isinstance(page, str) or not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements; whether one is the root of an unwanted subtree, and whether it is in ``depth``
    places: dict[str, list[int]] = {}  # of the open elements of a name
    solid: list[int] = []  # places of open blocks and roots
    depth = skipping = links = articles = 0  # open: article and main, unwanted roots, a; articles so far
    plain = False  # text outside links in this line
    headline, headed = None, False
    balance = _Balance(page)

    def flush():
        nonlocal plain, headline, headed
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                if places.get("h1"):
                    headed = headed or depth > 0
                    headline = headline if depth or any(inside for _, inside, _ in out[-1:]) else len(out)
                out.append((line, depth > 0, not plain))
            parts.clear()
        plain = False

    def pop(k):
        """Closes the open elements from the k-th on."""
        nonlocal depth, skipping, links
        if not skipping and solid and solid[-1] >= k:
            flush()
        while len(stack) > k:
            n, root, counted = stack.pop()
            places[n].pop()
            if solid and solid[-1] == len(stack):
                solid.pop()
            skipping -= root
            depth -= counted
            links -= n == "a"

    def last(names, stops):
        """Place of the innermost open element of ``names``, unless one of ``stops`` is inside of it."""
        k = max((places[n][-1] for n in names if places.get(n)), default=None)
        return k if k is not None and all(places[n][-1] <= k for n in stops if places.get(n)) else None

    def text(t):
        nonlocal plain
        if not skipping:
            parts.append(t)
            plain = plain or not links and bool(t.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if not m[4] and not (m[3] and name in KNOWN and ("=" in m[3] or not m[3].strip(" \t\n\r\f/"))):
            text(m[0])  # "<" before a word is no tag unless a known name and attributes, or nothing, follow
            continue
        if m[1]:
            if name in VOID or name == "p" and last({"p"}, CELL) is None:
                if not skipping and name in BLOCKS:
                    flush()
                continue
            k = last({name}, CELL if name not in CELL and name not in ENDS else {"table"} if name != "table" else set())
            if k is not None and (name in BLOCKS or not solid or solid[-1] <= k):
                pop(k)
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?![^\s/><])[^<>]*+>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in ENDS_P and (k := last({"p"}, CELL)) is not None:
            pop(k)
        if name in ENDS and (k := last(*ENDS[name])) is not None:
            pop(k)
        if skipping and (name in ("article", "main", "section", "h1", "h2", "h3", "p")):
            k = root_at
            root = stack[k][0]
            if (name in ("article", "main", "section", "h1") or root in ("nav", "menu")) and root not in OPTIONAL and not balance.closed(root, m.start()):
                pop(k)
        if not skipping and name in BLOCKS:
            flush()
        if name in VOID or m[3].endswith("/"):
            continue
        root = not skipping and _unwanted(name, m[3], depth > 0, articles > 0)
        counted = not root and not skipping and name in ("article", "main")
        if root:
            root_at = len(stack)
        if name in BLOCKS or root:
            solid.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, root, counted))
        skipping += root
        depth += counted
        articles += counted and name == "article"
        links += name == "a"
    text(page[at:])
    flush()
    if headline is not None and not headed and any(inside for _, inside, _ in out):
        out[headline] = (out[headline][0], True, out[headline][2])
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b`` (Hunt and Szymanski)."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k] = j
                links[k] = node
    found, node = set(), links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def main_text(lines: list[tuple[str, bool, bool]], neighbour: list[tuple[str, bool, bool]] | None) -> str:
    """The page's lines after differencing, joined by newlines."""
    shared: set[int] = set()
    if neighbour:
        shared = common_lines([x[0] for x in lines], [x[0] for x in neighbour])
        if len(shared) == len(lines):
            shared = set()
    marked = any(inside for _, inside, _ in lines)
    return "\n".join(x for i, (x, inside, linked) in enumerate(lines) if (inside or not marked) and (i not in shared or inside and not linked))


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


KEY = ("host", "path", "id")


def _keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path and id, the order in which pages are neighbours."""
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1))
    path = F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("id"))


def _ranges(keys: DataFrame) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The highest key of each range, in order, and the further ranges that each range's first and last key visit."""
    total = keys.count()
    size = max(RANGE_PAGES, -(-total // RANGES))
    if total <= size:
        return [], {}

    def cut(batches):
        """First and last key of each ``size`` sorted rows; equal keys stay together."""
        low = last = None
        n = 0
        for batch in batches:
            found = []
            for k in zip(*(batch[c] for c in KEY)):
                if n >= size and k != last:
                    found.append((*low, *last))
                    n = 0
                low = k if n == 0 else low
                last = k
                n += 1
            yield pd.DataFrame(found, columns=[*KEY, *(f"last_{c}" for c in KEY)])
        if n:
            yield pd.DataFrame([(*low, *last)], columns=[*KEY, *(f"last_{c}" for c in KEY)])

    # few partitions with many ranges each: Spark samples keys in the driver for every partition
    parts = keys.repartitionByRange(-(-total // (64 * size)), *KEY).sortWithinPartitions(*KEY)
    ends = parts.mapInPandas(cut, "host string, path string, id long, last_host string, last_path string, last_id long").collect()
    ends = sorted(((r.host, r.path, r.id), (r.last_host, r.last_path, r.last_id)) for r in ends)
    visits: dict[tuple, list[int]] = {}
    for r, (a, b) in enumerate(zip(ends, ends[1:])):
        visits.setdefault(a[1], []).append(r + 1)
        visits.setdefault(b[0], []).append(r)
    return [hi for _, hi in ends], visits


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    spark = small_batches(pages).sparkSession
    keyed = _keyed(pages)
    bounds, visits = _ranges(keyed.select(*KEY))
    shared = spark.sparkContext.broadcast((bounds, visits))

    def places(host: pd.Series, path: pd.Series, page: pd.Series) -> pd.Series:
        cuts, also = shared.value
        out = []
        for k in zip(host, path, page.tolist()):
            own = min(bisect_left(cuts, k), max(0, len(cuts) - 1))
            out.append([own, *(r for r in also.get(k, ()) if r != own)])
        return pd.Series(out)

    placed = keyed.withColumn("at", F.pandas_udf(places, "array<long>")(*KEY))
    placed = placed.select("page_id", "url", "html", *KEY, F.posexplode("at").alias("guest", "range"))
    tasks = max(len(bounds), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartition(tasks, "range").sortWithinPartitions("range", *KEY)

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch[c] for c in ("page_id", "url", "html", "guest", "range", *KEY)))

        def result(before, now, after):
            (page, url, _, _, r, host, path, _), lines = now
            near = None
            best = -1
            for other in (before, after):
                if other and other[0][4:6] == (r, host) and _prefix(path, other[0][6]) > best:
                    best, near = _prefix(path, other[0][6]), other[1]
            text = main_text(lines, near)
            return page, url, text, len(text)

        out, size = [], 0
        before = now = None
        for row in _and_end(rows()):
            after = row and (row, page_lines(row[2]))
            if now and not now[0][3]:
                out.append(result(before, now, after))
                size += out[-1][3]
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})
                    out, size = [], 0
            before, now = now, after
        if out:
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})

    return ordered.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def _and_end(rows):
    yield from rows
    yield None
