"""Whether an element whose name hints at a menu, advert, comments, ... is left out: name and content must agree.

A class, id or role is cut into pieces at punctuation and where capitals begin (``relatedPosts``: related, posts). A piece that hints makes the element a candidate; what the
name says (kind, attribute, whole name or words of a topic besides) and what stands in the element (words, links, paragraphs, headings, the name's own
words as a heading, its place) are features of a logistic regression, which is fitted on labelled pages (``labelled_names``).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Words of class, id and role that hint at what an element is.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promos promotion promoted doubleclick dfp",
    "menu": "menu menus nav navbar navigation sidenav topnav subnav breadcrumb breadcrumbs pagination pager toc toolbar skip",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular complementary share sharing sharebar social tags tagcloud",
    "notice": "cookie cookies consent gdpr notice alert newsletter subscribe subscription signup popup modal overlay paywall toast dialog",
    "comment": "comment comments commentlist disqus reply replies respond responses reactions",
    "form": "login signin search searchbox form",
    "footer": "footer contentinfo copyright legal colophon",
    "header": "header masthead topbar",
}
HINT = {w: kind for kind, words in HINTS.items() for w in words.split()}
#: Pieces that say what an element is for, not what it is about.
PLAIN = frozenset("box bar block area container wrapper wrap inner outer list item items section panel module unit slot zone region group row col column left right top bottom main page site global post posts article articles links link buttons button icons icon content body text primary secondary small large mobile desktop fixed sticky js ui c o u el wp in user users our my".split())
#: Pieces that tell how a page is laid out.
LAYOUT = frozenset("with without has have no not is open opened closed enabled disabled allow allowed show hide".split())
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+")


def pieces(name: str) -> list[str]:
    return [p.lower() for p in _PIECE.findall(name)]


def slug(text: str) -> str:
    return "-".join(pieces(text.lower()))


class Candidate(NamedTuple):
    """A name that hints, by its first word that does."""

    word: str
    kind: str
    key: str
    place: str  # whole, first, last, inner
    topical: bool
    layout: bool
    slug: str


@lru_cache(1 << 14)
def candidate(key: str, name: str) -> Candidate | None:
    own = pieces(name)
    found = [i for i, w in enumerate(own) if w in HINT]
    if not found:
        return None
    i = found[0]
    others = [w for k, w in enumerate(own) if k not in found]
    place = "whole" if not others else "first" if i == 0 else "last" if i == len(own) - 1 else "inner"
    return Candidate(own[i], HINT[own[i]], key, place, any(w not in PLAIN and w not in LAYOUT for w in others), any(w in LAYOUT for w in others), "-".join(own))


class Content(NamedTuple):
    """What stands in an element, and where."""

    words: int
    linked: int
    in_paragraphs: int
    paragraphs: int
    headings: int
    slugs: frozenset[str]
    left_out: int
    inside: bool
    tag: str


def facts(c: Candidate, e: Content) -> tuple:
    """What of the content counts, in few values."""
    links = e.linked / e.words if e.words else 0.0
    running = e.in_paragraphs / e.words if e.words else 0.0
    length = e.in_paragraphs / e.paragraphs if e.paragraphs else 0.0
    return (bisect_left((0, 12, 40, 120), e.words), bisect_left((0, 0.3, 0.5, 0.7), links), bisect_left((0, 0.4, 0.8), running), bisect_left((0, 16, 30), length), e.headings > 0, c.slug in e.slugs, e.left_out > 0, e.inside, e.tag == "section")


def features(c: Candidate, found: tuple) -> list[str]:
    """The names of all features that hold."""
    words, links, running, length, headed, named, left_out, inside, section = found
    return [
        "any",
        f"word {c.word}",
        f"word {c.word} {c.key} {c.topical}",
        f"kind {c.kind}",
        f"key {c.key}",
        f"place {c.place}",
        f"topical {c.topical}",
        f"{c.kind} topical {c.topical} {c.key}",
        f"layout {c.layout}",
        f"words {words}",
        f"links {links}",
        f"{c.kind} links {links > 2}",
        f"running {running}",
        f"paragraph {length}",
        f"{c.kind} long paragraphs {length > 1}",
        f"headed {headed}",
        f"named by heading {named}",
        f"named by heading {named} {c.kind == 'comment'} {c.topical}",
        f"word {c.word} named by heading {named}",
        f"left out {left_out}",
        f"inside {inside}",
        f"section {section} {c.key}",
    ]


@dataclass(frozen=True)
class NameModel:
    weights: dict[str, float]
    known: dict[tuple, float] = field(default_factory=dict, compare=False)

    def score(self, c: Candidate, e: Content) -> float:
        """Log odds of being left out."""
        at = (c, *facts(c, e))
        if at not in self.known:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            self.known[at] = sum(self.weights.get(f, 0.0) for f in features(c, at[1:]))
        return self.known[at]


def fit(rows: list[tuple[list[str], bool]], *, steps: int = 800, rate: float = 1.0, ridge: float = 1e-3) -> NameModel:
    """Logistic regression with a ridge penalty, all rows at each step."""
    at = {f: i for i, f in enumerate(sorted({f for own, _ in rows for f in own}))}
    x = np.zeros((len(rows), len(at)))
    for k, (own, _) in enumerate(rows):
        x[k, [at[f] for f in own]] = 1
    y, w = np.array([out for _, out in rows], float), np.zeros(len(at))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge * w)
    assert math.isfinite(float(w @ w))
    return NameModel({f: float(w[i]) for f, i in at.items()})
