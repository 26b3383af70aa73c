"""Operator 2: main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words. A word scores by the block that it stands in and by whether that is in an article, a tag by its name; the scores
are log odds of content against the rest, counted on labelled pages (``labelled_pages``) and clipped,
so words of running text are positive, and links and the tags around them negative.
One linear scan (Kadane's) finds the contiguous region with the greatest sum; in time, too, a page is linear.

What is never content wherever it stands scores 0, so a long one does not cut an article in two, and is not in the text:
scripts, comments, embedded objects, and elements whose tag says so (menus, forms, ...), or that are hidden. A class, id or role that hints at a menu, an
advert, comments (``sidebar``, ``relatedPosts``) makes an element a candidate; whether it is left out is told by a regression over the name and what
stands in the element (``page_names``), never of an element that holds most of the page's words and its heading or article. Where articles (or ``main``) carry the page, by a first heading in them or a third of its words,
what stands outside of them counts as left out too, so several articles are one region. A line that begins with a copyright sign outside an article is a notice.

Character references are decoded, white space in a block becomes one space, and blocks are joined by one space.

Cases: null and empty html give an empty text; a page without positive words gives an empty text;
pages may break off anywhere; elements may be left open and nested to any depth; very long pages are read whole; of equal regions the first is taken;
rows that repeat are extracted each on its own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_names import labelled
from .page_names import Candidate, Content, NameModel, candidate, facts, features, fit, slug

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: One attribute with its value, so neither the inside of values nor parts of names are read as attributes.
_ATTR = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Score kind of all that is left out: elements that are never content, with their tags and words, scripts and comments.
OUT = "out"
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no content wherever they stand.
EMBEDDED = frozenset("svg math object canvas template".split())
NEVER = {**dict.fromkeys(EMBEDDED, "embedded"), "nav": "menu", "menu": "menu", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "select": "form", "option": "form", "dialog": "notice", "head": "head", "title": "head"}
_KEPT = frozenset("html body main".split())
_CLOSES_P = BLOCKS - {"br", "button", "option", "select", "title", "head", "td", "th", "tr", "caption", "legend", "summary"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("article aside body div dl footer form header html li main nav ol section table td th ul blockquote figure".split()) | EMBEDDED
#: Elements of running text, whose names' words tell of adverts at most.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr figure figcaption caption span b i em strong a u q s cite code small sub sup abbr mark time label font".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Score kinds of words in running text.
_PARAGRAPHS = frozenset(f"word:{b}" for b in ("p", "blockquote", "pre", "dd"))
_NOTICE = re.compile(r"\s*(?:\u00a9|\(c\)\s|copyright\b)", re.I)


def _told(name: str, attrs: str, inside: bool) -> tuple[bool, tuple[Candidate, ...]]:
    """Whether an element is never content, and what its class, id and role hint at. inside: it stands in an article."""
    if name in NEVER or name == "header" and not inside:
        return True, ()
    found = []
    if attrs and name not in _KEPT:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, ()
            if key in ("class", "id", "role"):
                found += [c for c in (candidate(key, x) for x in value.split()) if c]
    if name in _RUNNING:
        found = [c for c in found if c.kind == "ad" and c.key == "class"]
    if name == "article":
        found = [c for c in found if c.kind in ("ad", "comment", "side")]
    return False, tuple(c for c in found if not (inside and c.kind == "header"))


class Page:
    """Tags and stretches of text in order, and the elements that they stand in; an element is a run of them."""

    def __init__(self, page: str):
        self.kinds: list[str] = []  # tag:name, word:block, or OUT
        self.texts: list[str] = []
        self.blocks: list[bool] = []  # a tag of a block
        self.at: list[int] = []  # the element
        self.names, self.parents, self.never, self.hints, self.inside, self.above, self.first, self.last = [""], [-1], [False], [()], [False], ["root"], [0], [0]
        self.marked = [False]  # labelled as left out, on labelled pages
        self.stack, self.open, self.scopes = [0], {}, [0]  # open elements; where the open ones of each name stand in the stack; where those that bound others do
        self._read(page)
        self._close(1)
        self.last[0] = len(self.kinds)

    def _add(self, kind: str, text: str, block: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.blocks.append(block)
        self.at.append(self.stack[-1])

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.last[e] = len(self.kinds)
            self.open[self.names[e]].pop()
            if self.scopes[-1] == len(self.stack):
                self.scopes.pop()

    def _end(self, names: set[str] | frozenset[str], bounded: bool) -> None:
        """Close the last open element of these names; bounded: if it stands within the block that now stands open."""
        found = max((self.open[n][-1] for n in names if self.open.get(n)), default=0)
        if found and not (bounded and found < self.scopes[-1]):
            self._close(found)

    def _start(self, name: str, attrs: str) -> None:
        e, above = len(self.names), self.stack[-1]
        never, hints = _told(name, attrs, self.inside[above])
        self.names.append(name)
        self.parents.append(above)
        self.never.append(never or self.never[above])
        self.hints.append(hints)
        self.marked.append(self.marked[above] or "data-out" in attrs)
        self.inside.append(self.inside[above] or name in ("article", "main"))
        self.above.append("h" if re.fullmatch("h[1-6]", name) else name if name == "a" or name in BLOCKS else self.above[above])
        self.first.append(len(self.kinds))
        self.last.append(len(self.kinds))
        if name in _SCOPE:
            self.scopes.append(len(self.stack))
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)

    def _text(self, raw: str) -> None:
        e = self.stack[-1]
        self._add(OUT if self.never[e] else "word:" + self.above[e], html.unescape(raw), False)

    def _read(self, page: str) -> None:
        ends: dict[str, int] = {}  # where the last end tag of an embedded element stands
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or m["raw"] or "").lower()
            if not name or m["raw"]:
                self._add(OUT, "", False)
                continue
            block, kind = name in BLOCKS, "tag:" + name
            if m["end"] or m["end2"]:
                self._add(OUT if self.never[self.stack[-1]] else kind, "", block)
                self._end({name}, name not in _SCOPE)
                continue
            if name in _CLOSES_P:
                self._end({"p"}, True)
            if name in _SAME and name != "p":
                self._end(_SAME[name], True)
            attrs = m["attrs"] or m["attrs2"] or ""
            if name in EMBEDDED and name not in ends:
                ends[name] = max((x.start() for x in re.finditer(f"</{name}\\b", page, re.I)), default=-1)
            if name in EMBEDDED and (ends[name] < at or name in ("svg", "math") and _self_closed(attrs)):
                self._add(OUT, "", False)  # nothing stands in it
            elif name in VOID:
                self._add(OUT if self.never[self.stack[-1]] else kind, "", block)
            else:
                self._start(name, attrs)
                self._add(OUT if self.never[self.stack[-1]] else kind, "", block)
        if at < len(page):
            self._text(page[at:])

    def contents(self) -> Iterator[tuple[int, Content]]:
        """What stands in each element whose name hints at something."""
        words, linked, running = [0], [0], [0]
        for kind, text in zip(self.kinds, self.texts):
            n = len(text.split()) if kind != OUT else 0
            words.append(words[-1] + n)
            linked.append(linked[-1] + n * (kind == "word:a"))
            running.append(running[-1] + n * (kind in _PARAGRAPHS))
        paragraphs, headings, out, slugs = [], [], [], []
        for e in range(1, len(self.names)):
            if self.never[e]:
                if not self.never[self.parents[e]]:
                    out.append(self.first[e])
            elif self.names[e] == "p":
                paragraphs.append(self.first[e])
            elif self.names[e] in _HEADINGS:
                headings.append(self.first[e])
                slugs.append(slug(" ".join(self.texts[self.first[e] : min(self.last[e], self.first[e] + 40)])))
        for e in range(1, len(self.names)):
            if self.hints[e] and not self.never[e]:
                lo, hi = self.first[e], self.last[e]
                number = lambda places: bisect_left(places, hi) - bisect_left(places, lo)  # noqa: B023, E731
                at = bisect_left(headings, lo)
                first = frozenset(slugs[at : at + 1]) if at < bisect_left(headings, hi) else frozenset()
                yield e, Content(words[hi] - words[lo], linked[hi] - linked[lo], running[hi] - running[lo], number(paragraphs), number(headings), first, number(out), self.inside[e], self.names[e])

    def settle(self, model: NameModel) -> None:
        """Decide by the whole page what names and articles say, and give each piece its final kind."""
        sums = [0]  # words that may be content before each piece
        for kind, text in zip(self.kinds, self.texts):
            sums.append(sums[-1] + (len(text.split()) if kind != OUT else 0))
        words = lambda e: sums[self.last[e]] - sums[self.first[e]]
        real = [e for e in range(1, len(self.names)) if not self.never[e]]
        told = {e for e, content in self.contents() if any(model.score(c, content) > 0 for c in self.hints[e])}
        anchors = [self.first[e] for e in real if self.names[e] in ("h1", "main") or self.names[e] == "article" and e not in told]

        def holds(e: int) -> bool:
            """It holds most of the page, with its heading or article if there is one."""
            own = bisect_left(anchors, self.last[e]) - bisect_left(anchors, self.first[e])
            return 2 * words(e) > sums[-1] and (own > 0 or not anchors)

        out, within = list(self.never), [False] * len(self.names)
        for e in real:
            out[e] = out[self.parents[e]] or e in told and not holds(e)
            within[e] = within[self.parents[e]] or not out[e] and self.names[e] in ("article", "main")
        left = [0, 0]
        for kind, text, e in zip(self.kinds, self.texts, self.at):
            if kind != OUT and not out[e]:
                left[within[e]] += len(text.split())
        carry = 2 * left[1] >= max(left[0], 1) or any(within[e] and self.names[e] == "h1" for e in real)
        for i, (kind, text, e) in enumerate(zip(self.kinds, self.texts, self.at)):
            if kind == OUT or out[e] or carry and left[1] and not within[e] or not within[e] and _NOTICE.match(text):
                self.kinds[i] = OUT
            elif within[e]:
                self.kinds[i] = kind + "@article"


@lru_cache(1)
def name_model() -> NameModel:
    """The regression over names and contents, fitted on the labelled pages."""
    return fit_names(labelled(1, 500))


def fit_names(found: list[str]) -> NameModel:
    rows = []
    for html_ in found:
        read = Page(html_)
        rows += [(features(c, facts(c, content)), read.marked[e]) for e, content in read.contents() for c in read.hints[e]]
    return fit(rows)


def segments(page: str, model: NameModel | None = None) -> Iterator[tuple[str, str, bool]]:
    """Tags and stretches of text in order: (score kind, text, is a block's tag)."""
    read = Page(page)
    read.settle(model or name_model())
    return zip(read.kinds, read.texts, read.blocks)


def _self_closed(attrs: str) -> bool:
    return attrs.endswith("/") and not re.search(r"=\s*[^\s\"'][^\s]*\Z|=\s*\Z", attrs)


def learn(pages: list[tuple[str, str, str]]) -> dict[str, float]:
    """Scores from labelled pages (what stands before the content, the content, what stands after): clipped log odds of each kind."""
    counts = {True: Counter(), False: Counter()}
    for before, content, after in pages:
        seen = 0
        for kind, text, _ in segments(before + "\x02" + content + "\x03" + after):
            for part in re.split("([\x02\x03])", text) if text else [""]:
                seen += part in ("\x02", "\x03")
                counts[seen == 1][kind] += (0 if part in ("\x02", "\x03") else len(part.split())) if kind.startswith("word") else 1
        assert seen == 2, (before, content)
    scores = {}
    for kind in (counts[True] | counts[False]).keys() - {OUT}:
        odds = math.log((counts[True][kind] + 0.5) / (counts[False][kind] + 0.5))
        if kind.startswith("tag"):
            scores[kind] = min(-0.05, max(-1.0, odds / 4 - 0.25))
        else:
            scores[kind] = max(-0.2, min(1.0, odds / 2))
    return scores | {OUT: 0.0}


#: For kinds that no labelled page holds: words, tags, and both in articles.
DEFAULT_WORD, DEFAULT_TAG, ARTICLE_WORD, ARTICLE_TAG = 0.3, -0.25, 0.5, -0.05


def _default(kind: str) -> float:
    if kind.endswith("@article"):
        return ARTICLE_WORD if kind.startswith("word") else ARTICLE_TAG
    return DEFAULT_WORD if kind.startswith("word") else DEFAULT_TAG


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the first region with the greatest sum above 0; (0, 0) if there is none."""
    best, bounds, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best + 1e-12:
            best, bounds = run, (start, i + 1)
    return bounds


def extract(page: str | None, scores: dict[str, float], model: NameModel | None = None) -> str:
    found = list(segments(page or "", model))
    each = []
    for kind, text, _ in found:
        score = scores.get(kind)
        score = _default(kind) if score is None else score
        each.append(score * len(text.split()) if kind.startswith("word") else score)
    start, end = best_region(each)
    parts = [" " if block else text if kind != OUT else "" for kind, text, block in found[start:end]]
    return " ".join("".join(parts).split())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    from .labelled_pages import PAGES

    scores, model = learn(PAGES), name_model()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), scores, model) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")
