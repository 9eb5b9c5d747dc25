"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, those in links less, and
tags negative, with weights from labelled pages: those that mark their article, where a
kind of word or tag inside the article is set against the same kind outside. Words under a
class name that labelled pages have outside their article score negative. Where a page
marks an article, its start and end tag weigh nearly as much as the words between them, so
that a region leaves it only for about as many words. One linear scan finds the contiguous
region of the highest sum. What is never main text - scripts, styles, menus, headers,
footers, sidebars, notices, adverts, forms, comments - is cut out before.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Labelled pages that the weights are fitted on.
SAMPLE_ROWS = 2000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|[\"'][^>]*(?:>|\Z)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Elements that never hold main text.
DROPPED = RAW | set("head nav footer aside form button select option datalist dialog menu menuitem noscript template svg canvas audio video map label fieldset legend input".split())
#: Elements that do not end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder object".split())
#: Words in class, id or role of menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
NOISE = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer contentinfo sidebar aside rail complementary cookie cookies consent gdpr notice notification "
    "alert popup modal overlay dialog ad ads advert adverts advertisement advertising sponsor sponsored promo promotion form comment comments commentlist reply replies respond disqus".split()
)
#: Of these, in an article or main element's own class, or around one.
STRONG_NOISE = set("ad ads advert adverts advertisement sponsored promo comment comments commentlist reply replies".split())
#: Beside these the word header tells of an article's own header.
CONTENT = set("article post entry story content main section title heading page".split())
#: Beside these a word tells of what is around.
AROUND = set("layout wrapper wrap container grid".split())
#: Before these it does so, too, whatever the word.
PREFIXES = set("has with no without is".split())
#: Words of what is mostly no main text: weights without labelled pages.
DOUBT = set("related recommended recommendations trending popular teaser teasers share sharing discussion discussions thread threads reviews feedback newsletter subscribe subscription signup login pagination pager toolbar".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A heading called a header is a title.
HEADING_NOISE = NOISE - {"header", "banner"}
_MARK = re.compile(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody\b", re.I)
#: Start tags that end open elements (the first set) up to the nearest of the second.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_BLOCK_ENDS_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class _Open:
    """The open elements, with the places of each name, so that no tag has to look through all of them."""

    def __init__(self):
        self.stack: list = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, name: str, state) -> None:
        self.places[name].append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, state))

    def pop(self):
        name, state = self.stack.pop()
        self.places[name].pop()
        if name not in INLINE:
            self.blocks.pop()
        return name, state

    def implied_end(self, name: str) -> int:
        """Depth that a start tag leaves."""
        depth = len(self.stack)
        if name in _ENDS:
            shut, scope = _ENDS[name]
            least = max((self.places[x][-1] for x in scope if self.places[x]), default=-1)
            for x in shut:
                at = self.places[x]
                if at and at[-1] > least:
                    depth = min(depth, at[bisect_right(at, least)])
        elif name in _BLOCK_ENDS_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            depth = self.blocks[-1]
        return depth


def _attributes(attributes: str) -> tuple[bool, list[list[str]]]:
    """Whether an element is hidden, and the words of each of its class, id and role names."""
    hidden, names = False, []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden" or name == "style":
            v = value.replace(" ", "").lower()
            hidden |= v == "true" or "display:none" in v or "visibility:hidden" in v
        else:
            names += [[x.lower() for x in _PARTS.findall(v)] for v in value.split()]
    return hidden, names


def _noise(names: list[list[str]], words: set) -> bool:
    """Whether a name tells of noise; names like has-sidebar tell of what is around, article-header of an article."""
    for parts in names:
        found = words.intersection(parts) if parts[:1] and parts[0] not in PREFIXES else set()
        if CONTENT.intersection(parts):
            found -= {"header", "banner"}
        if found and (found & STRONG_NOISE or not AROUND.intersection(parts)):
            return True
    return False


class Token(NamedTuple):
    """``kind``: ``w`` or ``w:a`` for text, else a tag with its slash."""

    kind: str
    text: str
    #: Whether it is in an article, main element or the like, and whether it is cut out.
    inside: bool
    cut: bool
    #: Class words of the innermost element that has any, with those of doubtful elements around.
    cues: frozenset
    #: Number of the mark that a start or end tag belongs to.
    mark: int = -1


_NO_CUES: frozenset = frozenset()


def tokens(page: str | None, doubt: set = DOUBT) -> list[Token]:
    """The page as tokens.

    Text keeps its white space, with character references decoded. Raw text of scripts and
    the like gives none. An article within an element whose name only sounds like noise is
    an article all the same; one among comments or adverts is not.
    """
    page = page or ""
    out: list[Token] = []
    open_ = _Open()
    # Depth in what is dropped for good, in what a name only makes suspect, in articles, in links.
    dropped = suspect = inside = links = marks = 0
    cues = _NO_CUES
    at, end = 0, len(page)

    def put(kind, text="", mark=-1):
        out.append(Token(kind, text, inside > 0, bool(dropped or suspect), cues, mark))

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            put("w:a" if links else "w", html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not m.group(2):
            if m.group().startswith("<![CDATA["):
                put("w", m.group()[9:].removesuffix("]]>"))
            continue
        name, attributes = m.group(2).lower(), m.group(3) or ""
        closing = bool(m.group(1))
        if closing:
            places = open_.places[name]
            depth = places[-1] if places else len(open_.stack)
            if not places:
                continue
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        elif name in VOID:
            put(name)
            continue
        else:
            depth = open_.implied_end(name)
        mark = -1
        while len(open_.stack) > depth:
            last, (was_dropped, suspect, was_mark, was_link, cues) = open_.pop()
            if was_mark >= 0:
                put("/" + last, mark=was_mark)
            dropped, inside, links = dropped - was_dropped, inside - (was_mark >= 0), links - was_link
            mark = was_mark
        if closing:
            if mark < 0:
                put("/" + name)
            continue
        article = name in ("article", "main")
        hidden, names = _attributes(attributes) if attributes and name not in ("html", "body") else (False, [])
        drop = hidden or name in DROPPED or (name == "header" and not inside) or _noise(names, STRONG_NOISE)
        shaky = not drop and not article and _noise(names, HEADING_NOISE if name in HEADINGS else NOISE)
        mark = marks if not drop and not shaky and not dropped and (article or _MARK.search(attributes) is not None) else -1
        marks += mark >= 0
        put(name, mark=mark)
        if name == "svg" and attributes.endswith("/"):
            continue
        state = (drop, suspect, mark, name == "a", cues)
        open_.push(name, state)
        if mark >= 0:
            suspect = 0
        elif shaky:
            suspect += 1
        if names:
            cues = frozenset(x for parts in names if not AROUND.intersection(parts) and parts[:1] and parts[0] not in PREFIXES for x in parts) | (cues & doubt)
        dropped, inside, links = dropped + drop, inside + (mark >= 0), links + (name == "a")
    while open_.stack:
        last, (was_dropped, suspect, was_mark, _, cues) = open_.pop()
        dropped, inside = dropped - was_dropped, inside - (was_mark >= 0)
        if was_mark >= 0:
            put("/" + last, mark=was_mark)
    return out


def _is_text(t: Token) -> bool:
    return t.kind == "w" or t.kind == "w:a"


def kind_counts(page: str | None) -> tuple[Counter, Counter]:
    """How often each kind of token, and each class word (as ``@word``) over words, occurs inside and outside the article of a labelled page."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for t in tokens(page):
        counts = found[not t.inside or t.cut]
        if _is_text(t):
            n = len(t.text.split())
            counts[t.kind] += n
            for c in t.cues:
                counts["@" + c] += n
        elif t.mark < 0:
            counts[t.kind] += 1
    return found


#: Weights without labelled pages, and for kinds that these lack.
PLAIN, LINK, TAG, CUE = 1.0, -0.3, -0.5, -1.0
#: Weight of a tag inside a marked article, and of a mark over that of the words it encloses.
INSIDE_TAG, MARK = -0.01, 0.95
#: Least weight of a tag, and of one that structures text.
LEAST_TAG, LEAST_TEXT_TAG = -3.0, -0.3
#: Words that a class word must have on the labelled pages to be one that tells of no main text.
CUE_WORDS = 20
#: Tags that structure text cost little.
TEXT_TAGS = {t: -0.1 for name in "p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li b i em strong span br figure figcaption".split() for t in (name, "/" + name)}


def fit_weights(inside: dict, outside: dict) -> dict[str, float]:
    """Weights by kind: the log of how much likelier a kind is inside; words positive, tags and class words negative."""
    out = {"w": PLAIN, "w:a": LINK, **TEXT_TAGS, **{"@" + c: CUE for c in DOUBT}}
    if not inside:
        return out
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    for kind in {*inside, *outside}:
        a, b = inside.get(kind, 0), outside.get(kind, 0)
        ratio = math.log((a + 0.5) / n_in) - math.log((b + 0.5) / n_out)
        if kind == "w":
            out[kind] = min(2.0, max(1.0, ratio))
        elif kind == "w:a":
            out[kind] = min(0.3, max(-1.0, ratio))
        elif kind[0] != "@":
            out[kind] = min(-0.01, max(LEAST_TEXT_TAG if kind in TEXT_TAGS else LEAST_TAG, ratio - 2.0))
        elif a + b >= CUE_WORDS:
            if ratio < -1:
                out[kind] = max(-2.0, ratio / 2)
            else:
                out.pop(kind, None)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the highest sum, in one scan; (0, 0) if no sum is positive."""
    best, best_from, best_to, now, now_from = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(scores):
        now += x
        if now <= 0:
            now, now_from = 0.0, k + 1
        elif now > best:
            best, best_from, best_to = now, now_from, k + 1
    return best_from, best_to


def scores(seq: list[Token], weights: dict[str, float], cues: bool = True) -> list[float]:
    """Score of each token.

    The tags of a mark weigh ``MARK`` times the words between them. Of marks in each other
    the outer one counts, and the inner ones only if there are several side by side.
    """
    out, word = [], weights["w"]
    words = {c: weights["@" + c] for t in seq for c in t.cues if "@" + c in weights} if cues else {}
    for t in seq:
        if _is_text(t):
            n = len(t.text.split())
            base = word if t.inside else weights.get(t.kind, word)
            out.append(n * min((words[c] for c in t.cues if c in words), default=base))
        else:
            out.append(INSIDE_TAG if t.inside else weights.get(t.kind, TAG))
    # Marks: (number, place of the start tag, sum inside, inner marks).
    open_: list = []
    costs: dict[int, float] = {}

    def charge(mark, total):
        costs[mark] = MARK * total

    for k, t in enumerate(seq):
        if t.mark >= 0 and t.kind[0] != "/":
            open_.append([t.mark, 0.0, []])
        elif t.mark >= 0 and open_:
            mark, total, inner = open_.pop()
            if len(inner) > 1:
                for x in inner:
                    charge(*x)
            if open_:
                open_[-1][1] += total
                open_[-1][2].append((mark, total))
            else:
                charge(mark, total)
        elif open_ and out[k] > 0:
            open_[-1][1] += out[k]
    for k, t in enumerate(seq):
        if t.mark in costs:
            out[k] = -costs[t.mark]
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the maximum-scoring region, joined by an empty line.

    If class words alone leave no region they are disregarded.
    """
    weights = weights or fit_weights({}, {})
    seq = [t for t in tokens(page, {k[1:] for k in weights if k[0] == "@"}) if not t.cut]
    lo, hi = best_region(scores(seq, weights))
    if hi == 0:
        lo, hi = best_region(scores(seq, weights, cues=False))
    blocks, part = [], []
    for t in seq[lo:hi]:
        if _is_text(t):
            part.append(t.text)
        elif t.kind == "br":
            part.append("\n")
        elif t.kind.removeprefix("/") not in INLINE:
            blocks.append("".join(part))
            part = []
    blocks.append("".join(part))
    blocks = [_SPACE.sub(" ", b).strip() for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def fit(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights from a bounded sample of the pages that mark their article.

    Only counts by kind, as many as there are tag names, reach the driver.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # The keys are chosen first: no page is sorted or moved but those of the sample.
    key = F.xxhash64("page_id", "url")
    keys = marked.select(key.alias("k")).distinct().orderBy("k").limit(sample_rows)
    labelled = marked.select(key.alias("k"), "html").join(F.broadcast(keys), "k").dropDuplicates(["k"]).select("html")

    def run(batches):
        sums = (Counter(), Counter())
        for batch in slices(batches):
            for page in batch.column("html").to_pylist():
                for total, more in zip(sums, kind_counts(page)):
                    total.update(more)
        rows = [(k, bool(o), n) for o in (0, 1) for k, n in sums[o].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "outside", "n"])

    got = labelled.mapInArrow(run, "kind string, outside boolean, n long").groupBy("kind", "outside").agg(F.sum("n").alias("n")).collect()
    return fit_weights({r["kind"]: r["n"] for r in got if not r["outside"]}, {r["kind"]: r["n"] for r in got if r["outside"]})


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of each row, from its whole html.

    Null html counts as empty. Repeated rows, null page_id and null url are taken like
    others; other columns are ignored; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", pages.schema["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in slices(batches):
            got = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
