"""Main text of web pages: markup rules, and lines shared with the pages of nearest URL in the same host."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.llm.common import cut

#: An attribute, and a tag by the grammar of attributes; a tag whose quotes do not close ends at the next >.
ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+"""
INNER = re.sub(r"\((?!\?)", "(?:", ATTRIBUTE)
#: Comments, declarations, elements whose content is no text of the page, and tags.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    rf"|<(script|style|textarea|title|noscript|template|iframe|noframes)\b(?:[\s/]++|{INNER})*+>.*?(?:</\1\s*>|\Z)"
    rf"|(</?[a-zA-Z][^\s/>]*+(?:(?:[\s/]++|{INNER})*+>|[^<>]*+>))",
    re.S | re.I,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(ATTRIBUTE)
#: Elements and roles that never belong to the article, elements that end a block, and elements without content.
OUTSIDE = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head"])
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"])
BLOCK = frozenset(
    ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form"]
    + ["h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary"]
    + ["table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"]
)
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
ITEMS = frozenset(["li", "dd", "dt", "option", "tr", "td", "th"])
CLOSES_P = BLOCK - frozenset(["caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements whose id may name a region of the page; elsewhere an id is only the target of a link.
REGIONS = frozenset(["div", "section", "ul", "ol", "table", "details"])
#: A class or id that is one of these names a region outside the article; a class that has one as a part makes it suspect.
REGION = frozenset(
    ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "side-bar", "widget"]
    + ["cookie", "cookies", "cookie-notice", "cookie-banner", "cookie-consent", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay"]
    + ["newsletter", "subscribe", "signup", "paywall", "comment", "comments", "comment-list", "commentlist", "comments-area", "disqus", "disqus_thread", "respond", "replies"]
    + ["breadcrumb", "breadcrumbs", "pagination", "pager", "nav", "navbar", "navigation", "menu", "footer", "masthead", "toolbar", "skip-link", "login"]
)
PARTS = REGION | frozenset(["share", "sharing", "social", "related", "recommended", "reply", "search", "skip", "tags", "toc", "teaser", "subscription"])
WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
GAPS = re.compile(r"[\s\u00a0]+")
#: How surely a block belongs to the article.
OWN, GUESS = True, False
#: What rules out what an element holds: nothing, what it is, or only a form that stands around it, which an article inside undoes.
IN, OUT, FORM = 0, 1, 2


def attributes(tag: str) -> dict[str, str]:
    """Names, in small letters, and values of a tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTES.finditer(tag, NAME.match(tag).end()):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def judged(name: str, tag: str, level: int) -> tuple[bool, bool]:
    """Whether an element is outside every article, and whether its class makes that likely only."""
    if name in OUTSIDE:
        return not (name == "header" and level == 2), False
    if name in ("html", "body", "article", "main") or len(tag) <= len(name) + 2:
        return False, False
    a = attributes(tag)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True, False
    if not ROLES.isdisjoint(a.get("role", "").lower().split()):
        return True, False
    if name in HEADINGS:
        return False, False
    names = a.get("class", "").split() + (a.get("id", "").split() if name in REGIONS else [])
    if not REGION.isdisjoint([x.lower() for x in names]):
        return True, False
    return False, any(not PARTS.isdisjoint([w.lower() for w in WORDS.split(x)]) for x in names)


def lines(page: str | None) -> tuple[list[str], list[bool]]:
    """Blocks of text that the markup does not rule out, and for each whether it surely is the article's (OWN) or a GUESS.

    A page with an article element (or else main) keeps what is inside, where only blocks of suspect classes are guesses, and,
    with an article inside main, what main has beside it. Of a page without such an element every block is a guess.
    A form rules out what it holds, but not an article or main element that it stands around; on a page without either, a form that holds
    more text than everything outside stands around the page, and counts as a plain container.
    """
    found: list[tuple[str, int, bool, int]] = []  # text, level (2 in an article, 1 in main, 0 elsewhere), suspect, IN or FORM
    stack: list[tuple[str, int, int, bool]] = []  # element, what rules it out, level, suspect
    text: list[str] = []
    page = page or ""
    last, drop, level, suspect = 0, IN, 0, False

    def flush() -> None:
        if text:
            s = "".join(text)
            text.clear()
            if "&" in s:
                s = html.unescape(s)
            s = GAPS.sub(" ", s).strip()
            if s:
                found.append((s, level, suspect, drop))

    def leave(k: int) -> tuple[int, int, bool]:
        del stack[k:]
        return stack[-1][1:] if stack else (IN, 0, False)

    for m in TOKEN.finditer(page):
        if drop != OUT and m.start() > last:
            text.append(page[last : m.start()])
        last = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        name = NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    drop, level, suspect = leave(k)
                    break
                if stack[k][0] in ("article", "main", "body", "table") and name not in ("html", "body", "article", "main"):
                    break
            continue
        if name == "br":
            if drop != OUT:
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID or tag.endswith("/>"):
            continue
        if name in CLOSES_P or name in ITEMS:
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph or list item ends here
                if stack[k][0] == "p" and name in CLOSES_P or stack[k][0] == name and name in ITEMS:
                    drop, level, suspect = leave(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if drop != OUT:
            hard, likely = judged(name, tag, level)
            out = FORM if name == "form" and level < 2 else OUT if hard else IN if name in ("article", "main") else drop
            deeper = 2 if name == "article" else max(level, 1) if name == "main" else level
            if (out, suspect or likely, deeper) != (drop, suspect, level):
                flush()
            drop, level, suspect = out, deeper, suspect or likely
        stack.append((name, drop, level, suspect))
    if drop != OUT and last < len(page):
        text.append(page[last:])
    flush()
    top = max([n for _, n, _, out in found if out == IN], default=0)
    around = not top and 2 * sum(len(s) for s, _, _, out in found if out == FORM) > sum(len(s) for s, *_ in found)
    kept = [(s, n == top > 0 and not x) for s, n, x, out in found if (n or not top) and (out == IN or around)]
    return [s for s, _ in kept], [own for _, own in kept]


def _scores(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of p and each front of q."""
    row = np.zeros(len(q) + 1, dtype=np.int32)
    for x in p:
        np.maximum(row[1:], np.where(q == x, row[:-1] + 1, 0), out=row[1:])
        np.maximum.accumulate(row, out=row)
    return row


def _by_matches(p: np.ndarray, q: np.ndarray, at: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence as a longest rising run through the pairs of equal lines: work and memory follow their number."""
    ends: list[int] = []  # the earliest place in q at which a run of each length can end
    tops: list[tuple] = []  # that run, as a chain
    for i, x in enumerate(p.tolist()):
        for j in at.get(x, ()):  # from the last to the first, so that one line of p is used once
            k = bisect_left(ends, j)
            link = (i, j, tops[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tops.append(link)
            elif j < ends[k]:
                ends[k], tops[k] = j, link
    out, link = [], tops[-1] if tops else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _subsequence(p: np.ndarray, q: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: through the pairs of equal lines if these are within `cells`, else by tables, which are halved
    until they are, so memory stays within that."""
    if not len(p) or not len(q):
        return []
    at: dict[int, list[int]] = {}
    for j in range(len(q) - 1, -1, -1):
        at.setdefault(int(q[j]), []).append(j)
    if sum(len(at.get(x, ())) for x in p.tolist()) <= cells >> 2:
        return _by_matches(p, q, at)
    if len(p) > 1 and len(p) * len(q) > cells:
        half = len(p) // 2
        cut_at = int(np.argmax(_scores(p[:half], q) + _scores(p[half:][::-1], q[::-1])[::-1]))
        return _subsequence(p[:half], q[:cut_at], cells) + [(i + half, j + cut_at) for i, j in _subsequence(p[half:], q[cut_at:], cells)]
    t = np.zeros((len(p) + 1, len(q) + 1), dtype=np.int32)
    for i in range(len(p) - 1, -1, -1):
        row = np.maximum(t[i + 1, :-1], np.where(p[i] == q, t[i + 1, 1:] + 1, 0))
        t[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if p[i] == q[j] and t[i, j] == t[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1, j] >= t[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_lines(a: list, b: list, cells: int = 1 << 22) -> tuple[set[int], set[int]]:
    """Places in a and b of a longest common subsequence.

    Lines that only one side has are left out first, equal fronts are paired; the rest is solved by tables of at most `cells` cells.
    """
    both = set(a) & set(b)
    x, y = [i for i, s in enumerate(a) if s in both], [j for j, s in enumerate(b) if s in both]
    head = 0
    while head < min(len(x), len(y)) and a[x[head]] == b[y[head]]:
        head += 1
    ids = {s: k for k, s in enumerate(both)}
    p, q = np.array([ids[a[i]] for i in x[head:]], dtype=np.int64), np.array([ids[b[j]] for j in y[head:]], dtype=np.int64)
    left, right = set(x[:head]), set(y[:head])
    for i, j in _subsequence(p, q, cells):
        left.add(x[head + i])
        right.add(y[head + j])
    return left, right


def shared_lines(a: tuple[list, list[int]], b: tuple[list, list[int]]) -> tuple[set[int], set[int]]:
    """Places of the lines that two pages, neighbours by URL, share.

    A page is its lines, or hashes of them, and their lengths. Two pages that share more than half of either's text are
    versions of one article, and nothing is shared between them that could be boilerplate.
    """
    left, right = common_lines(a[0], b[0])
    if 2 * sum(a[1][i] for i in left) > min(sum(a[1]), sum(b[1])):
        return set(), set()
    return left, right


def differ(pages: list[tuple[list[str], list[bool]]]) -> list[list[str]]:
    """The lines kept of pages that follow each other by URL, given as lines() gives them: guesses that a neighbour shares go."""
    gone: list[set[int]] = [set() for _ in pages]
    for k in range(len(pages) - 1):
        a, b = pages[k][0], pages[k + 1][0]
        left, right = shared_lines((a, [len(t) for t in a]), (b, [len(t) for t in b]))
        gone[k] |= left
        gone[k + 1] |= right
    return [[t for i, t in enumerate(texts) if own[i] or i not in out] for (texts, own), out in zip(pages, gone, strict=True)]


def neighbours(pages: DataFrame) -> DataFrame:
    """(row, host, place, meeting): the pages with a host by their place in the order of host, folder and URL path.

    A page has two meetings, one with the page before it and one with the page after it, so neighbours within a host meet once.
    The order is taken by ranges of host, path, URL and row and numbered by range: no task holds a host, a folder or
    the pages of one path.
    """
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^(?:(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"(?:/index)?\.[a-z]{3,5}$|/+$", ""), "/+", "/")
    d = pages.select("row", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("url")).where("host <> ''")
    d = d.withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1)).withColumn("size", F.length("path"))
    order = ["host", "folder", "size", "path", "url", "row"]
    d = cut(d.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.xxhash64("host").alias("host")))
    at = F.monotonically_increasing_id()
    d = d.withColumn("at", at).select("row", "host", F.shiftrightunsigned("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("i"))
    sizes = d.groupBy("range").agg((F.max("i") + 1).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").select("row", "host", (F.col("before") + F.col("i")).alias("place"))
    return d.withColumn("meeting", F.explode(F.array(F.col("place"), F.col("place") + 1)))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every page: its blocks joined by line breaks, and how many lines differencing took.

    What the markup calls the article is kept whoever else has it. Where it only lets guess (blocks of suspect classes, pages without
    an article), lines that the page of nearest URL before or after has too are deleted, by a longest common subsequence. What
    travels to a page's neighbours is a hash and a length for each line; the lines themselves are shuffled once, to meet the places
    to delete. Text inside a block has its character references decoded and its white space folded; nothing is cut or capped.

    Null and empty html gives empty text. Equal URLs are neighbours like any others, ordered by a hash of the row; rows that are equal in page_id,
    URL and html count as one page in pairing and each get its text. Pages without a host have no neighbour. Very long pages are
    parsed whole and compared in tables of bounded size. Other columns are ignored, whatever their names. An empty table gives none.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lines(x) for x in b.column(1).to_pylist()]
            texts = pa.array([x for x, _ in got], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array([[k for k, own in enumerate(x) if not own] for _, x in got], pa.list_(pa.int32()))], names=["row", "lines", "guesses"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting, so neighbours follow each other in a partition."""
        held: dict | None = None
        for b in batches:
            done: dict = {"row": [], "gone": []}
            for r in b.to_pylist():
                if held and (held["meeting"], held["host"]) == (r["meeting"], r["host"]) and (held["guesses"] or r["guesses"]):
                    for page, out in zip((held, r), shared_lines((held["codes"], held["sizes"]), (r["codes"], r["sizes"])), strict=True):
                        if gone := sorted(out.intersection(page["guesses"])):
                            done["row"].append(page["row"])
                            done["gone"].append(gone)
                held = r
            yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32()))]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([lines(x)[0] for x in b.column(3).to_pylist()], pa.list_(pa.string()))], names=["row", "page_id", "url", "lines"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    key = F.xxhash64("page_id", F.col("page_id").isNull(), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    found = rows.select(key.alias("row"), "html").mapInArrow(digest, "row bigint, lines array<string>, guesses array<int>")
    codes = found.select("row", F.transform("lines", lambda x: F.xxhash64(x)).alias("codes"), F.transform("lines", F.length).alias("sizes"), "guesses")
    met = neighbours(rows.select(key.alias("row"), "url").dropDuplicates(["row"])).join(codes.dropDuplicates(["row"]), "row")
    met = met.repartition("meeting").sortWithinPartitions("meeting", "place")
    gone = met.select("meeting", "host", "row", "codes", "sizes", "guesses").mapInArrow(compare, "row bigint, gone array<int>")
    gone = gone.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))  # two lists at most
    parsed = rows.select(key.alias("row"), "page_id", "url", "html").mapInArrow(parse, "row bigint, page_id bigint, url string, lines array<string>")
    out = F.coalesce("gone", F.array().cast("array<int>"))
    text = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains(out, i)), "\n")
    done = parsed.join(gone, "row", "left").select("page_id", "url", text.alias("text"), F.size(out).cast("long").alias("n_shared"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op2_page_differencing(pages: DataFrame) -> DataFrame:
    """The contract's columns from main_text."""
    return main_text(pages)
