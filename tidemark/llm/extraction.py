"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, both moved by
weights learned from labelled pages: the log odds of a word's surroundings (the element it stands
in, inside a link or not) and of a tag between the article and the rest of a page. One linear scan finds the
contiguous run with the greatest sum; its blocks are the text.

Labelled pages are those whose article is marked up (one ``article`` or ``main`` element); the marking
elements themselves are no learned features, so pages without them are scored by the rest. On a page
that has them, words outside lose up to ``MARK``, in proportion to the share of the page's words
inside: a marked article with half of the words outweighs the rest, a marked teaser does not. Weights are
fitted on a bounded sample of ``FIT_PAGES`` pages (by a hash of the row); every page is then extracted
whole. Elements that are never article text (scripts, forms, navigation, adverts, reader comments ...)
score nothing and give no text, wherever they stand. A class, id or role says so as a whole word ('sidebar') or
in a name whose other parts only say what kind of box it is ('sidebar-widget', 'comment-list'), not in
one that says something else ('share-price') or denies it ('no-sidebar'), and never of an article or of an
element with most of the page's words; in all other names such a word is a feature of the texts in that
element, for the weights to judge.

Edge cases: null and empty html give an empty text; a page without any word or with no labelled
pages to learn from falls back to the plain scores; unclosed elements end at the next block; repeated
and null ids are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.html_tokens import BLOCK, RAW, VOID, Lines, Tag, tokens

FIT_PAGES = 2000
#: Scores before learning, and the largest weight learning may add.
WORD, TAG, MOST = 1.0, -0.5, 3.0
#: What a word outside of the marking elements loses where all words stand inside.
MARK = 4.0

#: Elements without article text.
NEVER = frozenset("""script style head title noscript template iframe nav footer aside form select button textarea
input svg canvas object menu dialog noembed noframes""".split())
#: Class, id and role words of such blocks: whole, and as part of a longer name.
_NAMES = r"""(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|gdpr|
  nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|comments?|reader-comments|disqus|replies|respond|
  related|recommended|share|sharing|social|subscribe|newsletter|signup|login|search|popup|modal|overlay|
  contentinfo|complementary|alert|(?:cookies?|consent|gdpr)[_-](?:notices?|banner|bar|consent))"""
HINTS = re.compile(rf"(?:^|\s){_NAMES}(?=$|\s)", re.IGNORECASE | re.VERBOSE)
PARTS = re.compile(rf"(?:^|[\s_-]){_NAMES}(?=$|[\s_-])", re.IGNORECASE | re.VERBOSE)
#: Parts of a name that say what box it is, not what is in it (fixed words).
BOXES = frozenset("""list item items area slot widget widgets box section wrap wrapper container block inner outer panel content
body form bar unit zone space holder module region row col column group links link title heading label top bottom left right
middle center primary secondary main site page post posts article articles entry story stories videos global mobile desktop inline sticky fixed
toggle tools buttons button icons icon text info count thread level parent children single rail stack""".split())
NAME = re.compile(rf"{_NAMES}", re.IGNORECASE | re.VERBOSE)
MARKED = ("article", "main")
#: Tags that more often part an article from its surroundings than its own blocks.
LAYOUT = frozenset("html body div section table tr td th article main header fieldset".split())


class Word:
    """A run of text with its surroundings."""
    __slots__ = ("text", "count", "context", "inside")

    def __init__(self, text: str, context: str, inside: bool):
        self.text, self.context, self.inside = text, context, inside
        self.count = len(text.split())


#: Stands for an excluded block: it ends a line and scores nothing.
CUT = Tag("div", True, "")


def _names(tag: Tag) -> str:
    if not tag.source.strip(" /\n\t>"):
        return ""
    a = tag.attributes
    return " ".join(a.get(k, "") for k in ("class", "id", "role"))


def _boxed(names: str) -> bool:
    """Whether one of the names is made of an excluding word and words for boxes alone."""
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if p and not p.isdigit()]
        hints = sum(NAME.fullmatch(p) is not None for p in parts)
        if hints and len(parts) > 1 and all(NAME.fullmatch(p) or p.lower() in BOXES for p in parts):
            return True
    return False


def _excluded(tag: Tag, marked: int, most: Callable[[], bool]) -> bool:
    """``most``: whether the element holds most of the page's words."""
    if tag.name in NEVER:
        return True
    if tag.name == "header":
        return not marked
    if tag.name in ("main", "body", "html"):
        return False
    if tag.source.strip(" /\n\t>"):
        if "hidden" in tag.attributes:
            return True
        names = _names(tag)
        return tag.name != "article" and (HINTS.search(names) is not None or _boxed(names)) and not most()
    return False


def _extents(flat: list[Tag | str]) -> tuple[dict[int, int], list[int]]:
    """Where each element closes (by the place of its tag), and the visible words before each place."""
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    words, raw = [0], ""
    for i, t in enumerate(flat):
        if isinstance(t, str):
            words.append(words[-1] + (0 if raw else len(t.split())))
            continue
        words.append(words[-1])
        raw = t.name if not t.closing and t.name in RAW else ""
        if not t.closing:
            if t.name not in VOID:
                open_.setdefault(t.name, []).append(i)
        elif open_.get(t.name):
            ends[open_[t.name].pop()] = i
    return ends, words


def scan(html: str) -> list[Word | Tag]:
    """The page without excluded elements; every text knows its surroundings."""
    out: list[Word | Tag] = []
    closes: dict[str, int] = {}
    flat = list(tokens(html))
    for t in flat:
        if isinstance(t, Tag) and t.closing:
            closes[t.name] = closes.get(t.name, 0) + 1
    block, link, marked, skip, depth = "body", 0, 0, "", 0
    extents: tuple[dict[int, int], list[int]] | None = None
    soft: list[int] = []  # where the open elements close whose names hold a hint

    def most(i: int) -> bool:
        nonlocal extents
        extents = extents or _extents(flat)
        ends, words = extents
        return 2 * (words[ends[i]] - words[i]) > words[-1] if i in ends else False

    for i, t in enumerate(flat):
        while soft and soft[-1] <= i:
            soft.pop()
        if isinstance(t, Tag) and t.closing:
            closes[t.name] -= 1
        if skip:
            if isinstance(t, Tag):
                if t.name == skip and t.name not in VOID:
                    depth += -1 if t.closing else 1
                    if depth == 0:
                        skip = ""
                elif depth < 0 and t.name in BLOCK:  # never closed: ends at the next block
                    skip = ""
                else:
                    continue
                if skip or depth == 0:
                    depth = max(depth, 0)
                    continue
                depth = 0
            else:
                continue
        if isinstance(t, str):
            if t.strip():
                out.append(Word(t, block + ("/a" if link else "") + ("/hint" if soft else ""), marked > 0))
            elif out and isinstance(out[-1], Word):
                out[-1].text += " "
            elif t:
                out.append(Word(" ", block, marked > 0))
            continue
        if t.closing:
            if t.name in MARKED:
                marked = max(0, marked - 1)
            if t.name == "a":
                link = max(0, link - 1)
            if t.name in BLOCK:
                block, link = "body", 0
        elif _excluded(t, marked, lambda i=i: most(i)):
            if t.name not in VOID:
                skip, depth = t.name, (1 if closes.get(t.name, 0) > 0 or t.name in RAW else -1)
            if t.name in BLOCK:
                out.append(CUT)
            continue
        else:
            if t.name in MARKED:
                marked += 1
            if t.name == "a":
                link = 1
            if t.name in BLOCK and t.name not in MARKED:
                block = t.name
                if PARTS.search(_names(t)) and not most(i) and i in extents[0]:
                    soft.append(extents[0][i])
        out.append(t)
    return out


def _label(t: Word | Tag) -> str:
    if isinstance(t, Word):
        return "w:" + t.context
    return "t:" + ("/" if t.closing else "") + t.name


def observations(html: str) -> dict[tuple[str, bool], int]:
    """How often each feature of a labelled page lies in its article or outside ({}: not labelled)."""
    page = scan(html)
    opened = [t.name for t in page if isinstance(t, Tag) and not t.closing and t.name in MARKED]
    if len(opened) != 1:
        return {}
    out: dict[tuple[str, bool], int] = {}
    inside = False
    for t in page:
        if t is CUT:
            continue
        if isinstance(t, Tag) and t.name in MARKED:
            inside = not t.closing
            continue
        key = (_label(t), inside)
        out[key] = out.get(key, 0) + (t.count if isinstance(t, Word) else 1)
    return out


def fit_weights(pages: DataFrame, fit_pages: int = FIT_PAGES, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weight per feature: smoothed log odds of the article against the rest (one row per feature)."""
    total = pages.count()
    share = min(1.0, fit_pages / max(1, total))
    # also by the page itself: rows of one id are drawn one by one
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(html_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = pages.where(draw < share).select(F.col(html_col).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for html in batch.column("html").to_pylist():
                for key, n in observations(html or "").items():
                    seen[key] = seen.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.bool_()),
                                          pa.array(list(seen.values()), pa.int64())], names=["feature", "inside", "n"])

    rows = (sample.mapInArrow(count, "feature string, inside boolean, n long")
            .groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect())
    n_in = sum(r["n"] for r in rows if r["inside"]) + 1
    n_out = sum(r["n"] for r in rows if not r["inside"]) + 1
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r["feature"], [0, 0])[0 if r["inside"] else 1] += r["n"]
    out = {}
    for feature, (a, b) in by.items():
        odds = log((a + 0.5) / n_in) - log((b + 0.5) / n_out)
        out[feature] = max(-MOST, min(MOST, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the greatest sum (the first and shortest such), as a half-open range."""
    best, at, sum_, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if sum_ <= 0:
            sum_, begin = 0.0, i
        sum_ += s
        if sum_ > best:
            best, at = sum_, (begin, i + 1)
    return at


def extract(html: str, weights: dict[str, float]) -> str:
    """The article's blocks, one per line."""
    page = scan(html)
    words = [t for t in page if isinstance(t, Word)]
    outside = MARK * sum(t.count for t in words if t.inside) / max(1, sum(t.count for t in words))
    scores = []
    for t in page:
        label = _label(t)
        w = 0.0 if t is CUT else weights.get(label, weights.get(label.removesuffix("/hint"), 0.0))
        if t is CUT:
            scores.append(0.0)
        elif isinstance(t, Word):
            # words count for the article unless their surroundings were seen mostly outside of one
            score = WORD + min(0.0, w) - (0.0 if t.inside else outside)
            scores.append(t.count * score)
        else:
            scores.append(TAG + min(0.0, w) if t.name in LAYOUT else TAG / 5)
    a, b = best_run(scores)
    lines = Lines()
    for t in page[a:b]:
        if isinstance(t, Word):
            lines.text(t.text)
        elif t.name in BLOCK:
            lines.cut()
        elif t.name == "br":
            lines.text(" ")
    return lines.result()


def extract_pages(pages: DataFrame, weights: dict[str, float], html_col: str = "html",
                  keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``."""
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*kept, "text", "n_chars"])

    kinds = ", ".join(f"{k} {pages.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep))
    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "text", "n_chars")


def extraction_digest(pages: DataFrame) -> DataFrame:
    """The registered query: page_id, url, text, n_chars."""
    return extract_pages(pages, fit_weights(pages))
