"""Labelled pages for ``page_names``: generated from lists of names and of texts, elements that are left out marked by ``data-out``."""

from __future__ import annotations

import random

from .page_names import pieces

#: Names of elements that are left out, by what they hold.
OUT = {
    "ad": "ad ads advert ad-slot adBox ad-banner top-ads adsbygoogle content-ad with-ads sponsored sponsoredContent promo-box promoted-post banner-ad google-ads adUnit in-article-ad",
    "links": "sidebar sidebar author-widget widget aside-box complementary menu mainMenu nav-links navbar sidenav topNav breadcrumbs pagination toc related related-posts relatedPosts recommended recommendedArticles trending-now popularPosts share share-buttons shareButtons social-links socialIcons tags tag-cloud post-tags widget-links sidebar sideBar site-navigation skip-links pager",
    "notice": "cookie-banner cookieBanner cookie-notice gdprConsent newsletter newsletterBox newsletter-signup subscribe-box subscribeForm paywall popup modal-dialog alert-box signupPanel overlay consent",
    "comment": "comments comment-list commentsSection userComments comment-area disqus_thread replies respond user-comments commentlist comments comment",
    "form": "login loginForm search-box searchForm signin login-panel",
    "footer": "footer site-footer footerLinks copyright legal-links colophon page-footer",
}
#: Headings of sections of articles; their ids are made from them.
KEPT = """Login problems|Search algorithms|Comments on the treaty|Social history|Form of government|Legal status|Related work|Navigation at sea|The reply|Tags|Promotion|Advertising in the press|Side effects|Notice period|Alert levels|Menu of the feast|Header files|Footer of a letter|Reply to critics|Cookie recipes
Sponsored research|Banner of the guild|Newsletter history|Widget production|Sharing of power|Related species|Trending of faults|Breadcrumb trails in folklore|Search for the source|Responses of the public|Legal form|Social structure|Navigation by stars|Copyright law|Subscription libraries|Dialog and drama|Side streets
Early life|Geography|Etymology|Reactions|Consent in law|Popular culture|Signup of volunteers|Overlay networks|Modal verbs|Masthead of ships|Recommended dosage|Promoted pawns|Tags in markup|Skip distance|Toolbar design|Promotion of trade|Comment in statistics""".replace("\n", "|").split("|")
#: Classes of wrappers and parts of articles that are kept.
WRAPPERS = "layout with-sidebar|content has-sidebar|page no-ads|post has-comments|wrapper menu-open|entry|main-content|text with-share|article-body has-related|".split("|")
_SENTENCES = """The town lies on the northern bank of the river and has been a market since the middle ages.
Most of the houses were built after the great fire, when stone had become cheap enough for common people.
It is not known who drew the first map, but three copies of it have been kept in the archive.
In later years the method was used by sailors, who measured the height of the sun at noon.
Two of the witnesses agreed on the day, and the third remembered that it had been raining.
The council voted against the plan because the costs could not be told before the work began.
Scholars have argued about the meaning of the word, which appears only once in the old books.
A small harbour was added to the mill, so that boats could be loaded in every season.
When the pressure falls below a certain level, the valve opens and the water runs back into the tank.
Each of the five rules can be broken without harm, as long as the others are kept.""".split("\n")
_SHORT = ["Great piece, thank you!", "I do not agree at all.", "First!", "My uncle lived there.", "What a story that was.", "Can you say more about this?"]
_SALES = ["Buy two pairs of shoes today and get the third for nothing.", "The best phones at the lowest prices, only this week.", "Book your holiday now.", "Try our new coffee and win a trip to the sea."]


def _links(rng: random.Random) -> str:
    one = lambda: f'<a href="/{rng.randrange(1000)}">{" ".join(rng.choice(_SENTENCES).split()[: rng.randint(1, 5)])}</a>'
    if rng.random() < 0.6:
        return rng.choice(["", "<h3>More</h3>"]) + "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"
    return " ".join(one() for _ in range(rng.randint(1, 6)))


def _paragraphs(rng: random.Random) -> str:
    return "".join(f"<p>{' '.join(rng.sample(_SENTENCES, rng.randint(1, 3)))}</p>" for _ in range(rng.randint(1, 4)))


def _title(name: str, kind: str) -> str:
    """The heading of an element that is left out: for readers' comments the name itself, else something of its own."""
    return " ".join(pieces(name)).capitalize() if kind == "comment" else {"ad": "Only today", "links": "More from us", "notice": "Stay with us"}[kind]


def _left_out(rng: random.Random, kinds: list[str], names: dict[str, list[str]]) -> str:
    kind = rng.choice(kinds)
    name = rng.choice(names[kind])
    made = {
        "ad": lambda: rng.choice(_SALES) if rng.random() < 0.7 else f'<a href="/buy">{rng.choice(_SALES)}</a>' if rng.random() < 0.5 else f"<p>{rng.choice(_SALES)}</p>",
        "links": lambda: _links(rng),
        "notice": lambda: rng.choice(["", "<h4>Before you go on</h4>"]) + f"<p>{rng.choice(['We use cookies to improve your visit.', 'Get our letters every week.', 'Read on for one coin a week.'])}</p><button>Accept</button>",
        "comment": lambda: rng.choice(["", "<h3>Comments</h3>"]) + "".join(f"<{t}>{rng.choice(['<b>anna</b> ', ''])}{rng.choice(_SHORT)}</{t}>" for t in rng.choices(["p", "div", "li"], k=rng.randint(1, 6))),
        "form": lambda: "<form><label>Name</label><input><button>Go</button></form> Forgot it? <a href='/f'>Click here</a>",
        "footer": lambda: "&copy; 2024 The Daily. All rights reserved. <a href='/t'>Terms</a> <a href='/p'>Privacy</a>",
    }[kind]()
    if kind in ("ad", "links", "comment", "notice") and rng.random() < 0.4:  # what is left out may be as long as an article
        made = rng.choice(["", f"<h3>{_title(name, kind)}</h3>"] if kind != "comment" else [f"<h2>{_title(name, kind)}</h2>", ""]) + rng.choice([_paragraphs(rng), _paragraphs(rng) + _paragraphs(rng), "".join(f"<div>{' '.join(rng.sample(_SENTENCES, 3))}</div>" for _ in range(rng.randint(1, 4)))])
    tag = rng.choice(["div", "div", "section", "ul" if "<li>" in made and not made.startswith("<h") else "div"])
    return f'<{tag} data-out="1" {rng.choice(["class", "class", "id"])}="{name}">{made}</{tag}>'


def _section(rng: random.Random, headings: list[str]) -> str:
    title = rng.choice(headings)
    name = "-".join(title.lower().split()) if rng.random() < 0.7 else "_".join(title.split())
    level, tag = rng.choice(["h2", "h3"]), rng.choice(["section", "section", "div"])
    own = rng.choice([f'id="{name}"', f'id="{name}"', f'class="section {name}"', f'class="sect-{name}"'])
    return f"<{tag} {own}><{level}>{title}</{level}>{_paragraphs(rng)}</{tag}>"


def page(rng: random.Random, names: dict[str, list[str]], headings: list[str]) -> str:
    """A page whose elements with ``data-out`` are not content; all that stands in the article or main part besides is."""
    around = lambda n: "".join(_left_out(rng, list(names), names) for _ in range(rng.randint(0, n)))
    within = lambda: _left_out(rng, [k for k in names if k != "footer"], names) if rng.random() < 0.35 else ""
    body = "".join(_section(rng, headings) + within() for _ in range(rng.randint(2, 5)))
    tag = rng.choice(["article", "main", "div"])
    return f'<html><body>{around(3)}<{tag} class="{rng.choice(WRAPPERS)}"><h1>A page</h1>{_paragraphs(rng)}{body}{_paragraphs(rng)}</{tag}>{around(4)}</body></html>'


def labelled(seed: int, n: int, part: int | None = None, parts: int = 4) -> list[str]:
    """``n`` pages; of all names and headings those of one part are used, or those of the others where ``part`` is negative (-1 leaves out part 0)."""
    rng = random.Random(seed)
    chosen = lambda xs: [x for i, x in enumerate(xs) if part is None or (i % parts == part if part >= 0 else i % parts != -1 - part)]
    names = {k: chosen(v.split()) for k, v in OUT.items()}
    headings = chosen(KEPT)
    return [page(rng, names, headings) for _ in range(n)]
