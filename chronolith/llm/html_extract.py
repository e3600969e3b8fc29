"""HTML extraction: page structure, and nearest-URL page differencing.

Pages are ordered by host and URL path, so that a page's neighbours are the nearest URLs of its host. The lines that
structure leaves are aligned with those of the nearest neighbours that are not copies by longest common subsequences;
lines that all of these share are the site's template and are deleted. A neighbour is a copy of the page if over half of
the lines that structure calls the page's article are in it, so that copies of an article under neighbouring URLs lose
nothing.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROW = "page_id long, url string, text string, n_chars long"
# A tag whose quoted attribute values may hold ">", and the same where quotes mean nothing; both without backtracking.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
# Elements whose text is not the page's prose, and elements that begin and end a block (fixed values).
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "xmp", "noframes"}
SKIPPED = RAW | {"head", "svg", "math", "object", "canvas", "video", "audio", "map", "nav", "menu", "footer", "aside", "form", "button", "select", "dialog", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Open elements that a start tag closes, and elements beyond which it does not look for them (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "menu", "dir", "dl", "table", "select", "article", "section", "body"}
# Words of class and id names, and roles, that mark what is not the article (fixed values).
MARKS = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disqus|footer|footnav|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|pagination|paywall|popup|promo|promotion|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget",
    re.IGNORECASE,
)
# Words before or after a mark that tell what an element has or is about, not what it is (fixed values).
ABOUT = {"has", "have", "no", "with", "without", "is", "not", "show", "hide", "open", "closed", "enabled", "disabled", "layout"}
STORY = {"article", "entry", "post", "story", "content"}  # whose headers are the article's own
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# Elements of running text: on pages without article and main, the structure's best guess of the article (fixed values).
PROSE = {"p", "pre", "blockquote", "h1"}
WHITE = re.compile(r"\s+")
DEPTH = 256  # elements nested deeper count as their parents' text
WINDOW = 8  # pages before and after among which the nearest ones that are no copies are looked for
VOTERS = 5  # of these so many decide, and must agree
BLOCK_ROWS = 512  # pages that are differenced together


@dataclass
class Page:
    """A page's lines in order; kind 2: inside the element that holds the article, 1: elsewhere in running text, 0: elsewhere."""

    lines: list[str]
    kinds: list[int]

    def body(self) -> list[tuple[str, bool]]:
        """The lines of the article's element if there is one, else all, and whether structure calls them the article."""
        best = max(self.kinds, default=0)
        return [(x, k == best) for x, k in zip(self.lines, self.kinds, strict=True) if k == best or best < 2]


def marked(names: str, inside: bool) -> bool:
    """Whether one of the class or id names marks what is not the article; inside: the element is in an article or main."""
    for name in names.split():
        words = [w for w in re.split(r"[-_:]+", name.lower()) if w]
        if not words or ABOUT & set(words):
            continue
        for w in {words[0], words[-1], name.lower()}:
            if MARKS.fullmatch(w) and not (w == "header" and (STORY & set(words) or inside and w == name.lower())):
                return True
    return False


def _unwanted(name: str, attrs: str, inside: bool) -> bool:
    if name in SKIPPED or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and marked(value, inside):
            return True
    return False


class Parser:
    """One page's elements, and its text by element. The time taken is in proportion to the page's length."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()
        self.name, self.parent, self.bad, self.known_end = ["#page"], [-1], [False], [True]  # by element
        self.open, self.count = [0], Counter()  # open elements, and how many of each name
        self.inside = 0  # open article and main elements
        self.pieces: list[tuple[int, str]] = []  # text by element; element -1: a block begins
        self._read()
        for e in self.open[1:]:
            self.known_end[e] = self.name[e] not in SKIPPED and not self.bad[e]

    def _find(self, what: str, at: int) -> int:
        """text.find(), at most one vain search for each ``what``."""
        if what in self.gone:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def _say(self, start: int, end: int) -> None:
        if end > start:
            self.pieces.append((self.open[-1], html.unescape(self.text[start:end])))

    def _pop(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        for e in self.open[to:]:
            self.count[self.name[e]] -= 1
            self.inside -= self.name[e] in ("article", "main")
        del self.open[to:]

    def _close(self, names: set[str], bounds: set[str] = frozenset()) -> bool:
        """Close the innermost open element of these names and all in it, unless a bound lies between."""
        if any(self.count[n] for n in names):
            for i in range(len(self.open) - 1, 0, -1):
                if self.name[self.open[i]] in names:
                    self._pop(i)
                    return True
                if self.name[self.open[i]] in bounds:
                    break
        return False

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCKS and self.count["p"]:
            self._close({"p"}, BLOCKS - {"p"})
        while name in CLOSES and self._close(CLOSES[name], BOUNDS):
            pass
        if len(self.open) < DEPTH:
            self.name.append(name)
            self.parent.append(self.open[-1])
            self.bad.append(_unwanted(name, attrs, self.inside > 0))
            self.known_end.append(True)
            self.open.append(len(self.name) - 1)
            self.count[name] += 1
            self.inside += name in ("article", "main")

    def _read(self) -> None:
        text, tag, pos, held = self.text, TAG, 0, 0  # held: where text that is not yet said begins
        while (i := text.find("<", pos)) >= 0:
            nxt = text[i + 1 : i + 2]
            if nxt and nxt in "!?":
                opener, closer = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if text.startswith(o, i)), ("<", ">"))
                end = self._find(closer, i + len(opener))
                if end < 0 and opener == "<![CDATA[":
                    opener, closer = "<", ">"
                    end = self._find(">", i)
                if end < 0 and opener == "<":  # never closed: text
                    break
                self._say(held, i)
                if opener == "<![CDATA[":
                    self.pieces.append((self.open[-1], text[i + 9 : end]))
                held = pos = len(text) if end < 0 else end + len(closer)
                continue
            letter = text[i + 2 : i + 3] if nxt == "/" else nxt
            if not (letter.isascii() and letter.isalpha()):
                pos = i + 1
                continue
            m = tag.match(text, i)
            if not m and tag is TAG:
                tag = LOOSE_TAG  # a quote is never closed: from here on they mean nothing
                m = tag.match(text, i)
            if not m:
                if self._find(">", i) < 0:
                    break
                pos = i + 1
                continue
            self._say(held, i)
            held = pos = m.end()
            end, name, attrs = m[1], m[2].lower(), m[3]
            if name == "br":
                self.pieces.append((self.open[-1], " "))
            elif name in BLOCKS:
                self.pieces.append((-1, ""))
            if end:
                self._close({name})
            elif name in RAW:
                held = pos = self._raw_end(name, pos)
            elif name not in VOID and not (attrs.endswith("/") and name not in BLOCKS):
                self._start(name, attrs)
            if name in BLOCKS:
                self.pieces.append((-1, name if not end else ""))
        self._say(held, len(text))

    def _raw_end(self, name: str, at: int) -> int:
        """Where the text after a raw element goes on; one that is never closed goes to the page's end."""
        if name not in self.gone and (m := re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(self.text, at)):
            return m.end()
        self.gone.add(name)
        return len(self.text)

    def page(self) -> Page:
        n, sizes = len(self.name), [0] * len(self.name)
        lost = [b and k for b, k in zip(self.bad, self.known_end, strict=True)]  # an element without an end has no certain extent
        for e in range(1, n):
            lost[e] = lost[e] or lost[self.parent[e]]
        for e, t in self.pieces:
            if e >= 0:
                sizes[e] += len(t.strip())
        whole = [s if not x else 0 for s, x in zip(sizes, lost, strict=True)]
        for e in range(n - 1, 0, -1):  # children come after their parents
            sizes[self.parent[e]] += sizes[e]
            whole[self.parent[e]] += whole[e]
        holders = [e for e in range(1, n) if self.name[e] in ("article", "main")]
        best = max((e for e in holders if whole[e] and not lost[e] and self.name[e] == "article"), key=lambda e: whole[e], default=0)
        main = max((e for e in holders if whole[e] and not lost[e] and self.name[e] == "main"), key=lambda e: whole[e], default=0)
        if main and (not best or 2 * whole[best] < whole[main]):
            best = main
        if not best and (some := [e for e in holders if sizes[e] and not self.bad[e]]):
            best = max(some, key=lambda e: sizes[e])
        up = best
        while up > 0:  # what holds the article is no sidebar or form, whatever its name
            self.bad[up] = False
            up = self.parent[up]
        if not best and not any(w for w in whole):
            self.bad = [b and x != "form" for b, x in zip(self.bad, self.name, strict=True)]  # a page that is a form as a whole
        keep, within = [True] * n, [False] * n
        for e in range(1, n):
            keep[e] = keep[self.parent[e]] and not (self.bad[e] and self.known_end[e])
            within[e] = e == best or within[self.parent[e]]
        out, held, kind, block = Page([], []), [], 0, ""

        def flush() -> None:
            line = WHITE.sub(" ", "".join(held)).strip()
            held.clear()
            if line:
                out.lines.append(line)
                out.kinds.append(kind)

        for e, t in self.pieces:
            if e < 0:
                flush()
                kind, block = 0, t
            elif keep[e]:
                held.append(t)
                kind = max(kind, 2 if within[e] else int(block in PROSE))
            elif not held or held[-1] != " ":
                held.append(" ")
        flush()
        return out


def parse(text: str | None) -> Page:
    """The page's visible lines outside unwanted elements. Never fails: what is not markup is text.

    End tags that may be omitted are implied. An unwanted element that is never closed counts as none. The article is the
    longest article element outside unwanted ones, or main if that holds over twice its text; an unwanted element around
    it is kept for its sake.
    """
    return Parser(text or "").page()


def common_subsequence(a: list[int], b: list[int]) -> list[bool]:
    """Marks of the lines of a that are in a longest common subsequence with b.

    Equal ends are matched at once; the rest takes one bit-parallel row for each line of b.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    marks = [True] * lo + [False] * (len(a) - lo - hi) + [True] * hi
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y:
        return marks
    where: dict[int, int] = {}
    for i, v in enumerate(x):
        where[v] = where.get(v, 0) | 1 << i
    full, row, rows = (1 << len(x)) - 1, (1 << len(x)) - 1, []
    for v in y:  # a zero bit at i: the subsequence grows at line i
        rows.append(row)
        u = row & where.get(v, 0)
        row = ((row + u) | (row - u)) & full
    rows.append(row)
    i, j = len(x) - 1, len(y)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif rows[j - 1] >> i & 1:
            marks[lo + i] = True
            i, j = i - 1, j - 1
        else:
            j -= 1
    return marks


def shared_with(body: list[tuple[str, bool]], other: list[str], most: float = 0.5) -> list[bool] | None:
    """Marks of body's lines that are shared with other; None if over ``most`` of its article is, so that other is a copy, not a sibling, of the page."""
    marks = common_subsequence([hash(x) for x, _ in body], [hash(x) for x in other])
    shared = sum(len(x) for (x, core), m in zip(body, marks, strict=True) if m and core)
    return None if shared > most * sum(len(x) for x, core in body if core) else marks


def text_of(page: Page, neighbours: Iterable[Page]) -> str:
    """The page's text without its template: the lines shared with each of the VOTERS nearest neighbours that are no copies.

    One neighbour alone would take a sentence that two articles of a host have in common for the site's; a template is on
    all pages.
    """
    body, votes, n = page.body(), [], 0
    for other in neighbours if body else ():
        if (marks := shared_with(body, other.lines)) is not None:
            votes.append(marks)
            if (n := len(votes)) == VOTERS:
                break
    return "\n".join(x for (x, _), *got in zip(body, *votes, strict=True) if not votes or sum(got) < n)


def _key(host, path, page_id, url, digest) -> tuple:
    """Where a page lies among the others, nulls first; pages with equal keys are repeated rows."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or "", digest


def _edges(keyed: DataFrame) -> list[list[tuple]]:
    """Keys at which blocks begin, WINDOW keys before and WINDOW - 1 after: ranks are a key's place in its range partition and what lies before that."""
    spark, names = keyed.sparkSession, ["host", "path", "page_id", "url", "digest"]
    keys = keyed.select(names).distinct().repartitionByRange("host", "path", "page_id", "url", "digest").sortWithinPartitions(names)
    keys = materialise(keys.withColumn("at", F.monotonically_increasing_id()), "html-keys").withColumn("part", F.shiftright("at", 33))
    sizes, before, n = sorted(keys.groupBy("part").agg(F.count("*")).collect()), [], 0
    for part, size in sizes:
        before.append((part, n - (part << 33)))
        n += size
    rows = max(BLOCK_ROWS, n // 20_000)  # at most 20,000 edges
    ranked = keys.join(F.broadcast(spark.createDataFrame(before, "part long, shift long")), "part").withColumn("rank", F.col("at") + F.col("shift"))
    out = []
    for shift in (0, -WINDOW, WINDOW - 1):
        edge = ranked.where((F.pmod(F.col("rank") - shift, F.lit(rows)) == 0) & (F.col("rank") - shift > 0)).select("rank", *names).collect()
        out.append([_key(*r[1:]) for r in sorted(edge, key=lambda r: r.rank)])
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text (its main text, empty if none), n_chars.

    A null html is an empty page. Pages are dealt to blocks of consecutive pages by host and path, of which a hot host
    has many, and the WINDOW pages beside a block come along, so that what a page is compared with does not depend on
    how the table is partitioned. Pages whose WINDOW pages on both sides are copies or of other hosts keep what
    structure leaves. Repeated rows each get their row, and being copies they take nothing from each other. A null url
    or page_id stays null. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    keyed = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("html").alias("digest"), "html")
    edges = keyed.sparkSession.sparkContext.broadcast(_edges(keyed))
    columns = ["host", "path", "page_id", "url", "digest"]
    shape = "host string, path string, page_id long, url string, digest long, block long, own boolean, lines string, kinds string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, lows, highs = edges.value
        for b in batches:
            rows = []
            for *at, source in zip(b.host, b.path, [None if x is pd.NA else int(x) for x in b.page_id.astype("Int64")], b.url, b.digest, b.html, strict=True):
                key, page = _key(*at), parse(source)
                block = bisect.bisect_right(starts, key)
                held = "\n".join(page.lines), "".join(map(str, page.kinds))
                rows.append((*at, block, True, *held))
                # Into the next block from WINDOW keys before its start on, into the one before up to WINDOW keys after ours.
                if block < len(lows) and key >= lows[block]:
                    rows.append((*at, block + 1, False, *held))
                if block and (block > len(highs) or key <= highs[block - 1]):
                    rows.append((*at, block - 1, False, *held))
            out = pd.DataFrame(rows, columns=[*columns, "block", "own", "lines", "kinds"])
            yield out.assign(page_id=out.page_id.astype("Int64"))

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []  # of one block, by key: key, page, own rows
        now = None

        def near(i: int) -> Iterator[Page]:
            for d in range(1, WINDOW + 1):
                for j in (i - d, i + d):
                    if 0 <= j < len(held) and held[j][0][0] == held[i][0][0] and held[i][0][0]:
                        yield held[j][1]

        def done() -> pd.DataFrame:
            rows = []
            for i, (key, page, own) in enumerate(held):
                if own:
                    text = text_of(page, near(i))
                    rows += [(key[3] if key[2] else None, key[5] if key[4] else None, text, len(text))] * own
            held.clear()
            out = pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"])
            return out.assign(page_id=out.page_id.astype("Int64"))

        for b in batches:
            for *at, block, own, lines, kinds in zip(b.host, b.path, [None if x is pd.NA else int(x) for x in b.page_id.astype("Int64")], b.url, b.digest, b.block, b.own, b.lines, b.kinds, strict=True):
                if block != now:
                    if held:
                        yield done()
                    now = block
                key = _key(*at)
                if not held or held[-1][0] != key:
                    held.append([key, Page(lines.split("\n") if lines else [], list(map(int, kinds))), 0])
                held[-1][2] += bool(own)
        if held:
            yield done()

    dealt = keyed.mapInPandas(cut, shape)
    return dealt.repartition("block").sortWithinPartitions("block", *columns).mapInPandas(difference, ROW)
