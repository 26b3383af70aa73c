"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import exact_dedup, hnsw, html_text, labelled_names, licences, mixing, near_dedup, packing, quality, token_shards, tokens, warc
from gristmill.llm.common import word_hashes
from gristmill.llm.labelled_pages import PAGES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, size int, score string, _rank int, uid int, grade string, at int, x double, p_ge_1 int, _text string, copies string, _at_row string, n int, form string, leaf int, root int, spans int, output int, _words int, _held int, position int"


def docs_of(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), True, "x", 7, "s", 3, 1, "g", 1, 0.5, 2, "t", "c", "r", 4, "f", 5, 6, 7, 8, 9, 10, 11) for i, t, s in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = "lorem ipsum dolor " * 120_000

EDGES = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", "a"), (4, "one", "a"), (None, "one", "b"), (5, LONG, "b"), (6, "ties are ties", "b"), (7, "ties are ties", "a"), (8, "é ß 漢字   x", "")]


# --- 1: quality ------------------------------------------------------------------------


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.filter("doc_id % 3 = 0")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    r = quality.rate(docs, model).join(held, "doc_id").select("kept", "quality", "toxic", "expected_grade").collect()
    right = np.mean([x.kept == (x.quality == 1) for x in r])
    assert right > 0.93, right
    assert np.mean([x.kept for x in r if x.quality == 1]) > 0.95
    grade = lambda q, t: np.mean([x.expected_grade for x in r if (x.quality, x.toxic) == (q, t)])
    assert grade(0, 0) < grade(1, 1) < grade(1, 0)


def test_quality_edges(spark):
    docs = docs_of(spark, EDGES)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, None), (6, 0, 1), (5, 0, 0), (None, 1, 0), (99, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    r = quality.rate(docs, model).collect()
    assert len(r) == len(EDGES) and all(0 <= x.p_ge_2 <= x.p_ge_1 <= 1 for x in r)
    assert len({x.score for x in r if x.doc_id in (1, 2, 3)}) == 1
    assert all(x.kept for x in quality.rate(docs, quality.train(docs, labels.limit(0))).collect())
    assert quality.rate(docs.limit(0), model).count() == 0


def test_quality_gradient_reaches_the_optimum():
    """The fitted parameters are a minimum of the penalised likelihood, written out plainly: no small step in any direction lowers it."""
    rng = np.random.default_rng(9)
    n, d = 120, 6
    x = rng.random((n, d)) + 0.1
    grades = np.digitize(x @ rng.normal(size=d) + rng.logistic(size=n) * 0.3, [0.0, 0.8])
    weight = rng.random(n) + 0.5
    at = [np.arange(d) * 3 for _ in range(n)]
    model = quality.fit(at, list(x), grades, weight, steps=3000, rate=0.02, ridge=0.01)

    def loss(w, t):
        total = 0.0
        for xi, g, wi in zip(x, grades, weight / weight.sum()):
            tail = [1.0] + [1 / (1 + math.exp(tk - xi @ w)) for tk in t] + [0.0]
            total -= wi * math.log(tail[g] - tail[g + 1])
        return total + 0.005 * (w @ w)

    w, t = model.weights[np.arange(d) * 3].astype(float), model.thresholds
    best = loss(w, t)
    for i in range(d + 2):
        for step in (-0.02, 0.02):
            moved = np.append(w, t)
            moved[i] += step
            assert loss(moved[:d], moved[d:]) > best - 1e-6
    for text_at, xi in zip(at[:5], x):
        s = float(xi @ w)
        assert np.allclose(model.tails([s])[0], [1 / (1 + math.exp(tk - s)) for tk in t], atol=1e-5)


def test_quality_scores_against_a_plain_version():
    """Features by plain counting, bucket by bucket."""
    rng = np.random.default_rng(1)
    model = quality.Ordinal(rng.normal(size=1 << quality.BITS).astype(np.float32), np.array([0.0, 1.0]))
    for text in ("One two, two THREE 33 -- 4x4 one", "a", "", None, "word " * 300_000):
        at, x = quality.features(text)
        assert math.isclose(model.score(text), sum(float(model.weights[i]) * float(v) for i, v in zip(at, x)), rel_tol=1e-4, abs_tol=1e-6)
        if text:
            tokens_of = text.split()
            again = sum(a.strip(",-").lower() == b.strip(",-").lower() != "" for a, b in zip(tokens_of, tokens_of[1:]))
            assert math.isclose(float((x.astype(float) ** 2).sum()), 3.0, rel_tol=1e-3)  # each family's shares add up to 1
            shares = sorted(round(float(v) ** 2 * len(tokens_of)) for v in x)
            assert sum(shares) == 3 * len(tokens_of) and again in shares + [0, len(tokens_of)]


def test_quality_fit_is_bounded(spark):
    docs = spark.createDataFrame([(i % 6, f"some words {i % 6} " * (i % 6 + 1)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels).weights.any()
    assert not quality.train(docs, labels, most_bytes=10).weights.any()


def test_quality_features_of_blocks():
    text = "The BIG dog!! 123 dog dog " * 60_000
    a, x = quality.features(text)
    b, y = quality.features("The BIG dog!! 123 dog dog " * 6)
    assert set(b) <= set(a) and len(a) - len(b) <= 1


# --- 2: html -----------------------------------------------------------------------------


SCORES = html_text.learn(PAGES)


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><nav><a href=x>only a menu</a></nav></html>", ""),
        ("plain words &amp; more&nbsp;words", "plain words & more words"),
        ("<p>one <b>t</b>wo<p>three<br>four", "one two three four"),
        ("<article><p>Kept text is here for you.</p><script>var x = '</p>';</script><p>And this too.</article><footer>gone</footer>", "Kept text is here for you. And this too."),
        ("<div class='menu'><a>Home</a></div><div><h1>Title</h1><p>Some words of the story.</p></div><div id='comments'><p>First! What a story that was, really.</p></div>", "Title Some words of the story."),
        ("<main><p>A first paragraph of the page.</p><aside>Buy it now</aside><form><label>Mail</label><input></form><p>A second paragraph of it.</p></main>", "A first paragraph of the page. A second paragraph of it."),
        ("<body><p>cut off in the middle of a tag<p", "cut off in the middle of a tag"),
        ('<p title="a > b">quoted</p>', "quoted"),
        ("<p>5 < 6 and 7 > 6</p>", "5 < 6 and 7 > 6"),
        ('<p>before the icon <svg viewBox="0 0 1 1"/> after it</p><p>more words <svg><title>no</title><path d="x"/></svg> here</p>', "before the icon after it more words here"),
        ("<div><p>one two three <object data=x>and</p><p>four five six</div><p>seven eight</p>", "one two three and four five six seven eight"),
        ("<p>one two three <object data=x><p>no</p><object>no</object> no</object> four five</p>", "one two three four five"),
        ("<p>one two <template><div>no<p>no</div></template><math><mi>x</mi></math><canvas>no</canvas> three</p>", "one two three"),
        ("<p>walk to <b title='so hidden'>the <i data-id=sidebar>old <u data-x='a class=ad b'>valley</u></i></b> and <span onclick=f('x',hidden)>back</span></p>", "walk to the old valley and back"),
        ("<p>all here <b class=note id='x' HIDDEN>no</b><b data-a='1'class=\"ad\">no</b><b hidden>no</b> is kept</p>", "all here is kept"),
    ],
)
def test_html_pages(page, text):
    assert html_text.extract(page, SCORES) == text


@pytest.mark.parametrize("start,end", [("<aside>", "</aside>"), ("<nav>", "</nav>"), ("<form>", "</form>"), ("<div class=ad>", "</div>"), ("<div class=cookie-notice>", "</div>"), ("<section id=comments>", "</section>"), ("<aside><p><a>", "</a></p></aside>" * 2)])
def test_html_left_out_elements_do_not_cut_an_article(start, end):
    block = start + "<label>skip</label> " * 100 + "skip " * 500 + end
    slots = "<!-- slot --><script>track()</script>" * 40
    body = "<p>" + "A body of many words in a row. " * 3 + "</p>"
    want = " ".join(["Six words stand in this heading"] + ["A body of many words in a row."] * 3 + ["The last word."])
    page = f"<nav>menu</nav><article><h1>Six words stand in this heading</h1>{block}{slots}{block}{body}{block}<p>The last word.</p></article>{block}<footer>gone</footer>"
    assert html_text.extract(page, SCORES) == want


@pytest.mark.parametrize("attrs", ["href='/the-hidden-valley'", 'href="/post?id=comment"', "href=/post?class=ad", "data-id=sidebar data-hidden=1"])
def test_html_attributes_are_read_by_name(attrs):
    assert html_text.extract(f"<p>Many words are around <a {attrs}>this link</a> and many more stand behind it</p>", {**SCORES, "word:a": 0.5}) == "Many words are around this link and many more stand behind it"


STORY = "".join(f"<p>Paragraph {i} of the story says a few more things about it.</p>" for i in range(6))
TOLD = " ".join(f"Paragraph {i} of the story says a few more things about it." for i in range(6))
LINK_LIST = "<ul>" + "".join(f"<li><a href='/{i}'>Other page {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f'<div class="content with-sidebar"><h1>Title</h1>{STORY}</div>', "Title " + TOLD),
        (f'<div class="sidebar-layout"><h1>Title</h1>{STORY}<div class="sidebar">Buy now</div></div>', "Title " + TOLD),
        (f'<div class="post comments-open"><article>{STORY}</article></div>', TOLD),
        (f'<div class="post comments">{STORY}</div>', TOLD),
        (f'<div data-id="menu">{STORY}</div>', TOLD),
        (f'<div title="The hidden truth">{STORY}</div>', TOLD),
        (f'<article>{STORY}<p class="legal">The law of the land is part of it.</p>{STORY}</article>', f"{TOLD} The law of the land is part of it. {TOLD}"),
        (f"<article>{STORY}</article><p>Copyright 2024 The Daily. All rights reserved.</p>", TOLD),
        (f"{STORY}<p>Copyright 2024 The Daily. All rights reserved.</p>", TOLD),
        (f"<article><h1>Short</h1><p>A short one.</p></article><div><p>{'First comment by a reader. ' * 20}</p></div>", "Short A short one."),
        (f"<article>{STORY}</article>{LINK_LIST}<article>{STORY}</article>", f"{TOLD} {TOLD}"),
        (f"<article>{STORY}{LINK_LIST * 20}{STORY}</article>", f"{TOLD} {' '.join(f'Other page {i}' for i in range(12) for _ in [0])} ".replace("  ", " ") + (" ".join(f"Other page {i}" for i in range(12)) + " ") * 19 + TOLD),
        (f'<div class="ad"><p>{"Buy this today. " * 6}</p></div><main><h1>Title</h1>{STORY}</main><section class="comments">{"<article class=comment><p>I say so, and so do we all of us here.</p></article>" * 30}</section>', "Title " + TOLD),
        (f'{LINK_LIST}<div><h1>Title</h1>{STORY}</div><div class="related">{"<article><a href=x>Something else</a></article>" * 9}</div>', "Title " + TOLD),
    ],
)
def test_html_wrappers_and_neighbours(page, text):
    assert html_text.extract(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>gone</footer></body></html>", SCORES) == text


@pytest.mark.parametrize("piece", ["<b>x ", "<b>x </i>", "<p>x <b>", "<div>x ", "<li>x <span>", "</div>x ", "<svg>x ", "<article>x ", "<div class=ad>x ", "<!-- x ", "<p title='x ", "&amp; <"])
def test_html_time_is_linear(piece):
    began = time.perf_counter()
    html_text.extract("<body>" + piece * 100_000, SCORES)
    assert time.perf_counter() - began < 5


def test_html_labelled_pages_are_recovered():
    for before, content, after in PAGES:
        want = " ".join(re.sub(r"<[^>]*>", " ", content).split())
        assert " ".join(html_text.extract(before + content + after, SCORES).split()) == want.replace(" ,", ",")


def test_best_region_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-1.0, -0.5, 0.5, 1.0]) for _ in range(rng.randint(0, 12))]
        best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        a, b = html_text.best_region(s)
        assert math.isclose(sum(s[a:b]), best, abs_tol=1e-9)


def test_html_query_rows(spark):
    d = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>" + "word " * 400_000, 5)], "page_id long, url string, html string, text int")
    r = html_text.main_text(d).collect()
    assert sorted(x.n_chars for x in r) == [0, 0, 400_000 * 5 - 1]
    assert html_text.main_text(d.limit(0)).count() == 0


_STORY = "<p>The mill was built by the river and worked for two hundred years before the railway came to the valley.</p><p>Nobody knows who drew the plans, but the stones still stand and can be seen from the road.</p>"


@pytest.mark.parametrize("name", "login-problems search-algorithms comments-on-the-treaty social-history form-of-government legal-status related-work navigation-at-sea the-reply tags promotion side-effects notice-period header-files copyright-law".split())
@pytest.mark.parametrize("shape", ["<section id='%s'><h2>%s</h2>%s</section>", "<div class='section %s'><h3>%s</h3>%s</div>"])
def test_html_sections_named_after_their_headings_are_kept(name, shape):
    if "class" in shape and name in ("tags", "promotion"):
        return  # a class of that one word is not made from a heading
    section = shape % (name, name.replace("-", " ").capitalize(), "<p>Kept words are here and there is more to be said about them in this section of the page.</p>")
    page = f"<html><body><main><h1>A title</h1>{_STORY}{section}{_STORY}</main></body></html>"
    assert "Kept words" in html_text.extract(page, SCORES)


@pytest.mark.parametrize("name", "relatedPosts userComments commentsSection cookieBanner adBox adsbygoogle sidenav shareButtons newsletterBox content-ad with-ads ad-slot SideBar cookie_notice".split())
@pytest.mark.parametrize("inner", ["Out words of the thing", "<a href=x>Out words</a> <a href=y>more</a>", "<p>Out words are here for you.</p>"])
def test_html_boilerplate_by_compound_names_is_left_out(name, inner):
    thing = f"<div class='{name}'>{inner}</div>"
    for page in (f"<html><body><main><h1>A title</h1>{_STORY}{thing}{_STORY}</main></body></html>", f"<html><body><main><h1>A title</h1>{_STORY}</main>{thing}</body></html>", f"<html><body><div><h1>A title</h1>{_STORY}{thing}{_STORY}</div></body></html>"):
        text = html_text.extract(page, SCORES)
        assert "Out words" not in text and "Nobody knows" in text


@pytest.mark.parametrize("name,attr", [("comments", "class"), ("comments", "id"), ("ad", "class"), ("sidebar", "class"), ("newsletter", "id")])
def test_html_long_boilerplate_is_left_out(name, attr):
    long = "".join(f"<p>Out words of reader {i}, who has a lot to say about the mill and about the river, and about all the people that he met there in his youth.</p>" for i in range(3))
    page = f"<html><body><article><h1>A title</h1>{_STORY * 4}</article><div {attr}='{name}'><h3>{name.capitalize()}</h3>{long}</div></body></html>"
    assert "Out words" not in html_text.extract(page, SCORES)


def test_html_names_on_held_out_words_and_pages():
    """Fitted without a quarter of the names and headings, and tried on pages with these only: elements, and words of whole pages."""
    right = total = 0
    for part in range(4):
        model = html_text.fit_names(labelled_names.labelled(10, 300, -1 - part))
        kept, wanted, both = 0, 0, 0
        for page in labelled_names.labelled(20 + part, 60, part):
            read = html_text.Page(page)
            for e, content in read.contents():
                told = max(model.score(c, content) for c in read.hints[e]) > 0
                right, total = right + (told == read.marked[e]), total + 1
            want = Counter(" ".join(t for t, e, k in zip(read.texts, read.at, read.kinds) if not read.marked[e] and k != html_text.OUT).split())
            got = Counter(html_text.extract(page, SCORES, model).split())
            kept, wanted, both = kept + got.total(), wanted + want.total(), both + (got & want).total()
        assert both / kept > 0.95 and both / wanted > 0.95, (part, both / kept, both / wanted)
    assert right / total > 0.97, right / total


# --- 3: nearest neighbours -------------------------------------------------------------------


def test_hnsw_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 16))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    rows += [(2000 + i, rows[50][1]) for i in range(400)]  # one common vector
    bad = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [1.0] * 15 + [None]), (5200, [float("nan")] * 16), (5250, [float("inf")] * 16), (None, rows[3][1]), (5300, [1.0, 2.0]), (5350, [2.0, 1.0])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + rows[:1]], "vec_id long, embedding array<float>, score int, rank int")
    got = hnsw.search(hnsw.index(d, shard_rows=512), d.filter("vec_id % 50 = 0")).collect()
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[i], 9)
        s[i] = -2
        want = ids[np.lexsort((ids, -s))[:5]]
        mine = [v for _, v, _ in sorted(by[ids[i]])]
        hits, total = hits + len(set(want) & set(mine)), total + 5
        assert len(mine) == 5 and ids[i] not in mine
    assert hits / total > 0.95
    assert [v for _, v, _ in sorted(by[2000])] == [50, 2001, 2002, 2003, 2004]
    assert [v for _, v, _ in by[5300]] == [5350] and not {5000, 5050, 5100, 5150, 5200, 5250} & set(by)
    assert hnsw.nearest(d.limit(0), d.limit(0)).count() == 0


def test_hnsw_wide_vectors_in_shards_of_bounded_bytes(spark):
    """16,384 numbers a vector: a shard is bounded by its bytes, and the shards together find what all pairs find."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 16_384)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    graphs = hnsw.index(d, shard_bytes=1 << 20).cache()
    assert graphs.count() >= 6 and graphs.select(F.max(F.octet_length("vectors"))).first()[0] < 3 << 20
    got = {}
    for r in hnsw.search(graphs, d.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in (0, 50, 100):
        s = unit @ unit[i]
        s[i] = -2
        assert [v for _, v in sorted(got[i])] == list(np.argsort(-s, kind="stable")[:5])


def test_hnsw_recall_over_shards_that_are_grown(spark):
    """Vectors of sf0.1 in four shards, most of each inserted by search, against all pairs; and in double precision."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = hnsw.nearest(rows, rows.filter("vec_id % 50 = 0"), k=5, seed=128, spread=4).collect()
    ids, v = (np.array(x) for x in zip(*[(r.vec_id, r.embedding) for r in rows.collect()]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits, asked = 0, [i for i in ids if i % 50 == 0]
    for i in asked:
        score = unit @ unit[ids == i][0]
        want = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:5]
        hits += len({j for _, j in want} & {r.vec_id for r in got if r.query_id == i})
    assert len(got) == 5 * len(asked) and hits >= 0.97 * len(got), hits / len(got)
    wide = spark.createDataFrame([(i, [1.0, 1e-12 * i, 0.0]) for i in range(8)], "vec_id long, embedding array<double>")
    r = {x.rank: x.vec_id for x in hnsw.nearest(wide, wide.filter("vec_id = 0"), k=3).collect()}
    assert set(r.values()) <= set(range(1, 8)) and len(r) == 3


# --- 4: near duplicates ------------------------------------------------------------------------


def brute_classes(texts):
    """Plain set similarity of five-word runs, all pairs, smallest id of each component."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(11)
    texts, at = {}, 0
    for size in (1, 1, 1, 2, 3, 60):
        base = words(rng, 300)
        for _ in range(size):
            texts[at] = edited(rng, base, rng.randint(0, 4)) if size > 1 else base
            at += 1
    shared = words(rng, 60)
    for _ in range(20):  # a passage in common does not make copies
        texts[at] = shared + " " + words(rng, 60)
        at += 1
    texts |= {at: None, at + 1: "", at + 2: "...", at + 3: "two words", at + 4: "Two, words!", at + 5: "two words more"}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs_of(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == brute_classes(texts)


def weighted_classes(texts, level):
    """All pairs by the operator's own measure, weights by plain counting over its frequencies."""
    sets = {i: near_dedup.weigh(t)[1:] for i, t in texts.items()}
    of = {i: i for i in texts}
    weight = {i: dict(zip(s.tolist(), (n * level[near_dedup.bucket(s)]).tolist())) for i, (s, n) in sets.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = weight[a], weight[b]
        both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
        if x and y and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
            lo, hi = sorted((of[a], of[b]))
            of = {i: lo if c == hi else c for i, c in of.items()}
    return of


def test_near_dedup_where_frequencies_decide(spark):
    """Short texts that have little but a passage that hundreds of others have are apart, though nine tenths of their shingles are the same; near copies of a large group stay together."""
    rng = random.Random(31)
    passage, base = words(rng, 100), words(rng, 150)
    texts = {i: passage + " " + words(rng, 800) for i in range(400)}
    texts |= {1000 + i: passage + " " + words(rng, 6) for i in range(6)}
    texts |= {2000 + i: edited(rng, base, rng.randint(0, 3)) for i in range(300)}
    docs = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    level = near_dedup.document_frequencies(docs)
    passage_levels, base_levels = (level[near_dedup.bucket(near_dedup.weigh(t)[1])] for t in (passage, base))
    assert passage_levels.max() <= 5 and np.median(base_levels) == near_dedup.LEVELS
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == weighted_classes(texts, level)
    assert len({got[i] for i in range(1000, 1006)}) == 6 and len({c for i, c in got.items() if i >= 2000}) == 1
    plain = brute_classes({i: t for i, t in texts.items() if i >= 1000})
    assert len({plain[i] for i in range(1000, 1006)}) == 1


def test_effective_document_counts():
    """n documents of different families count as n, copies of one as one."""
    rng = np.random.default_rng(2)
    n, all_docs = 4000, 1 << 14
    apart = np.array([near_dedup.signs(k) for k in rng.integers(0, 1 << 63, n, dtype=np.uint64)], np.int64)
    copies = np.repeat(near_dedup.signs(np.uint64(77))[None].astype(np.int64), n, axis=0)
    level = near_dedup.levels(np.array([-1, 5, 6]), np.array([all_docs, n, n]), np.vstack([np.zeros((1, near_dedup.SKETCHES)), apart.sum(axis=0), copies.sum(axis=0)]).astype(np.int64))
    assert level[6] == near_dedup.LEVELS and abs(int(level[5]) - 2) <= 1 and level[7] == near_dedup.LEVELS


def test_near_dedup_screens_no_pair_at_the_threshold():
    rng = np.random.default_rng(12)
    least = near_dedup.least_agreement(0.8)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, 450, dtype=np.uint64))
        b = np.sort(np.concatenate([a[:400], np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))]))  # 400 of 500
        one, two = (near_dedup.signature(x, np.full(len(x), 8)) >> np.uint64(48) for x in (a, b))
        assert near_dedup.agreeing(one, two) >= least


def test_near_dedup_repeated_identifiers(spark):
    """Rows of one doc_id are one document, kept or dropped together."""
    rng = random.Random(6)
    t = words(rng, 200)
    rows = [(1, t, "s"), (2, edited(rng, t, 1), "s"), (2, edited(rng, t, 1), "s"), (3, words(rng, 50), "s"), (3, words(rng, 50), "s")]
    r = near_dedup.classes(docs_of(spark, rows)).collect()
    assert sorted((x.doc_id, x.class_id, x.kept) for x in r) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (3, 3, True)]
    assert sorted(x.doc_id for x in near_dedup.keep_one(docs_of(spark, rows), ["doc_id"]).collect()) == [1, 3, 3]


def test_near_dedup_edges(spark):
    r = near_dedup.classes(docs_of(spark, EDGES)).collect()
    assert len(r) == len(EDGES)
    assert {x.doc_id: x.class_id for x in r} == {1: 1, 2: 2, 3: 3, 4: 4, None: None, 5: 5, 6: 6, 7: 6, 8: 8}
    assert {x.doc_id for x in r if not x.kept} == {7}
    assert near_dedup.classes(docs_of(spark, EDGES).limit(0)).count() == 0
    assert near_dedup.keep_one(docs_of(spark, EDGES), ["doc_id", "text"]).count() == len(EDGES) - 1


def test_near_dedup_links_across_centres(spark):
    """A chain of texts each near the next only: one class, whichever text is a centre."""
    rng = random.Random(2)
    w = words(rng, 400).split()
    chain = {}
    for i in range(12):
        chain[i] = " ".join(w)
        for k in range(4):
            w[(i * 31 + k * 100) % 400] = words(rng, 1)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs_of(spark, [(i, t, "s") for i, t in chain.items()])).collect()}
    assert got == brute_classes(chain) and set(got.values()) == {0}


def test_near_dedup_in_blocks(spark):
    """All that stars leave, compared block against block, gives the links that all pairs give."""
    rng = random.Random(21)
    base = words(rng, 120)
    texts = {i: edited(rng, base, rng.randint(0, 9)) for i in range(60)}
    docs = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    level = spark.sparkContext.broadcast(near_dedup.document_frequencies(docs))
    sets = {i: near_dedup.weigh(t)[1:] for i, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if a % 7 != b % 7 and near_dedup.similarity(sets[a], sets[b], level.value) >= 0.8}
    apart = spark.createDataFrame([(1, i, 100, i % 7, 60) for i in texts], "key long, rep long, weight long, component long, n long")
    reps = near_dedup.sign(docs, level).withColumnRenamed("doc_id", "rep")
    got = near_dedup.verify_blocks(apart, docs, reps, level, 0.8, 16).collect()
    assert {(r.a, r.b) for r in got} <= want
    assert {frozenset((r.a % 7, r.b % 7)) for r in got} == {frozenset((a % 7, b % 7)) for a, b in want}


def test_weighted_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    level = rng.integers(1, near_dedup.LEVELS + 1, 1 << near_dedup.DF_BITS).astype(np.uint8)
    same, share = [], []
    weight = lambda x: level[near_dedup.bucket(x)].astype(np.int64)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        b = np.sort(np.concatenate([a[:300], np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))]))
        na, nb = rng.integers(1, 4, len(a)), np.ones(len(b), int)
        share.append(near_dedup.similarity((a, na), (b, nb), level))
        same.append(np.mean(near_dedup.signature(a, na * weight(a)) == near_dedup.signature(b, nb * weight(b))))
    assert abs(np.mean(same) - np.mean(share)) < 0.02


# --- 5: mixing ---------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = {n for n in free if share[n] > cap * sizes[n]}
        if not over:
            target |= share
            break
        for n in over:
            target[n] = cap * sizes[n]
        left -= sum(target[n] for n in over)
        free -= over
    return target


def test_mixing_targets_and_takings(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "B", "é", "\U0001f600", "z", None]) if i % 40 else "tiny") for i in range(3000)]
    r = mixing.mix(docs_of(spark, rows)).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = plain_targets(sizes)
    taken = {}
    for x in r:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, target[x.source], rel_tol=1e-9)
        assert 0 <= x.taken <= 3 * x["size"] and x.taken == x.copies * x["size"]
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 60 for s in sizes)
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((x.doc_id, x.taken) for x in r) == sorted((x.doc_id, x.taken) for x in again)
    out = mixing.draw(docs_of(spark, rows), ["doc_id", "text", "size"]).collect()
    assert sorted(x.doc_id for x in out) == sorted(i for x in r for i in [x.doc_id] * x.copies) and {x["size"] for x in out} == {7}
    tied = [(1, f"text {i % 5}", "a") for i in range(50)] + [(2, "w " * 40, "b")]  # one identifier, different texts
    assert sorted(x.text for x in mixing.draw(docs_of(spark, tied), ["text"]).collect()) == sorted(x.text for x in mixing.draw(docs_of(spark, tied[::-1]).repartition(7), ["text"]).collect())


def test_mixing_edges(spark):
    r = mixing.mix(docs_of(spark, EDGES)).collect()
    assert len(r) == len(EDGES)
    assert {x["size"] for x in r if x.doc_id in (1, 2, 3)} == {0}
    assert {x.target for x in r if x.source is None} == {0.0}
    assert mixing.mix(docs_of(spark, EDGES).limit(0)).count() == 0
    assert all(x.taken == 0 for x in mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, None)])).collect())


# --- 6: licences ---------------------------------------------------------------------------------


def plain_scan(text, least=0.6):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licences.BASE:
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        if own:
            base.add(label)
            score = 1.0
    for label, phrase, key in licences.TEMPLATES:
        p, k = re.findall("[a-z0-9]+", phrase.lower()), key.split()
        first = next(i for i in range(len(p)) if p[i : i + len(k)] == k)
        for s in range(-first, len(w)):
            if s + first >= 0 and w[s + first : s + first + len(k)] == k:
                share = sum(0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(p)) / len(p)
                if share >= least:
                    labels.add(label)
                    score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def test_licences_against_a_plain_scan(spark):
    rng = random.Random(6)
    pieces = [p for p, _ in licences.BASE] + [p for _, p, _ in licences.TEMPLATES] + ["mit", "cc by", "nc", "MIT License", "GNU General Public License, version 3.", "K ſ İ", "under the"]
    rows = [(i, " ".join(rng.choice(pieces).upper() if rng.random() < 0.2 else rng.choice([rng.choice(pieces), words(rng, 3)]) for _ in range(rng.randint(1, 12))), "s") for i in range(150)]
    for i, (_, text, _) in enumerate(licences.TEMPLATES * 6):  # edited, cut short at either end, in the middle of other words
        w = text.split()
        for _ in range(rng.randint(0, 3 + len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = words(rng, rng.randint(0, 1)).split()
            w = w or ["x"]
        rows.append((300 + i, " ".join(words(rng, 3).split() * (i % 2) + w[rng.choice([0, 0, 1, 5]) :]), "s"))
    rows += [(1000, "under the mit license" * 2, "s"), (1001, "license version 2 apache license version 2", "s"), (1002, "CC-BY-NC cc by nc", "s")] + [(2000 + (i or 0), t, s) for i, t, s in EDGES]
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        want = plain_scan(t)
        assert got[i][:6] == want[:6] and math.isclose(got[i][6], want[6]), (t, got[i], want)
    assert licences.scan(docs_of(spark, EDGES).limit(0)).count() == 0


# --- 7: packing ------------------------------------------------------------------------------------


def test_tokens_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", "Hello, world's 12 cats!  \n\n x", "a<|endoftext|>b", "<|endoftext|>", "  é漢字 👍🏽 'll 'S", "x" * 500, "tab\tand   spaces   ", "\x00\x1f"]:
        assert list(tokens.encode(text, tokens.default_path())) == [*t.encode(text, add_special_tokens=False).ids, 0], text


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_pieces_and_places(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.choice([0, 1, 3, 10, 40, 90])), "s") for i in range(800)] + EDGES
    size = 64
    out = packing.pack_documents(docs_of(spark, rows), size).collect()
    n = check_packing(out, size)
    total = 0
    pieces = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    want = []
    for i, t, _ in rows:
        ids = tokens.encode(t, tokens.default_path())
        total += len(ids)
        first = len(ids) % size or min(size, len(ids))
        bounds = [0, *range(first, len(ids) + 1, size)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert pieces == sorted(want)
    assert n <= 1.02 * -(-total // size) + 1
    assert packing.pack_documents(docs_of(spark, EDGES).limit(0), size).count() == 0
    ids = packing.pieces(docs_of(spark, rows[:9]), size, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)


def test_packing_a_length_that_nearly_all_pieces_have(spark):
    """Its ranks are counted in as many cells as it takes: no window sorts more than a few cells' rows."""
    rows = [(i, 0, 0, 64 if i % 10 else 1 + i % 63, i) for i in range(9000)]
    d = spark.createDataFrame(rows, packing.PIECE)
    packed = packing.pack(d, 64, cell_rows=100)
    out = packed.collect()
    assert len(out) == 9000 and check_packing(out, 64) <= 8100 + 900
    full = d.filter("length = 64").withColumn("c", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(81)))
    assert full.groupBy("c").count().agg(F.max("count")).first()[0] < 200
    assert "cells" not in packed.columns and packed.columns[:5] == d.columns


def test_best_two_fit():
    size = 100
    rng = np.random.default_rng(9)
    for _ in range(30):
        counts = np.zeros(size + 1, int)
        for l in rng.integers(1, size + 1, rng.integers(0, 200)):
            counts[l] += 1
        patterns = packing.best_two_fit(counts, size)
        used = np.zeros(size + 1, int)
        for times, items in patterns:
            assert sum(l * n for l, n in items) <= size
            for l, n in items:
                used[l] += n * times
        assert (used == counts).all()
    one = np.zeros(11, int)  # greedy takes 6 and 3; 2 and 2 fill the gap of the 3 better
    one[6], one[3], one[2] = 1, 1, 2
    assert packing.best_two_fit(one, 10)[0] == (1, [(6, 1), (2, 2)])


# --- 8: exact copies -----------------------------------------------------------------------------------


def plain_groups(rows):
    norm = {}
    for i, t, _ in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {t: ids for t, ids in norm.items()}


def smallest(ids):
    return min((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """With a weak digest most hits are false: the bytes decide. Rows without doc_id come last."""
    rows = [(i, f"text\t{i % 7}" + " " * (i % 3 + 1) + "end", "s") for i in range(101, 220)] + EDGES + [(None, "text 3 end", "s"), (None, "only null", "s"), (None, "only null", "s")]
    digest = (lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256
    out = exact_dedup.dedup(docs_of(spark, rows).repartition(3), digest=digest).collect()
    groups = plain_groups(rows)
    want = sorted((str(i), str(smallest(ids)), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == want
    kept = [r for r in out if r.kept]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(smallest(ids)) for ids in groups.values())
    assert all(r.doc_id == r.keep_id for r in kept)
    if not weak:
        assert {r.digest for r in out if r.doc_id == 4} == {hashlib.sha256(b"one").hexdigest()}


def test_exact_dedup_edges(spark):
    assert exact_dedup.dedup(docs_of(spark, EDGES).limit(0)).count() == 0
    kept = exact_dedup.keep_first(docs_of(spark, EDGES), ["doc_id", "text", "digest"])
    assert sorted((str(r.doc_id), r.digest) for r in kept.collect()) == sorted((str(smallest(ids)), "x") for ids in plain_groups(EDGES).values())


def test_exact_dedup_takes_up_its_state(spark, tmp_path):
    """A second call on the same state holds its rows against those of the first."""
    state = (tmp_path / "state").as_uri()
    one = [(5, "a b", "s"), (6, "c", "s"), (7, "a  b", "s")]
    two = [(3, "a b", "s"), (9, "c", "s"), (10, "new", "s")]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(docs_of(spark, one), state=state).collect()} == {(5, 5, 2), (6, 6, 1), (7, 5, 2)}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs_of(spark, two), state=state).collect()} == {(3, 3, 3, True), (9, 6, 2, False), (10, 10, 1, True)}
    weak = lambda t: F.lit("same")
    state = (tmp_path / "weak").as_uri()
    exact_dedup.dedup(docs_of(spark, one), digest=weak, state=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(docs_of(spark, two), digest=weak, state=state).collect()} == {(3, 3, 3), (9, 6, 2), (10, 10, 1)}


# --- 9: WARC ---------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "shared page " * 20
    rows = [(i, f"http://x/{i}\r\n", same if i % 3 else f"page {i} " * 30) for i in range(1, 1300)]
    rows += [(5000, None, None), (5001, "u", ""), (5002, "u", "short"), (5003, "u", "short"), (None, "u", same), (5004, "é", "ü" * 99), (5005, "long", LONG)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.archive(d, (tmp_path / "w").as_uri())
    html = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(k for k in html if k is not None):
        first.setdefault(html[i], i)
    records = warc.reconstruct(spark, path)
    raw = [bytes(r.record) for r in records.collect()]
    found = warc.parse(records).collect()
    assert len(raw) == len(found) == len(rows)
    revisit = lambda i: len(html[i]) >= 100 and i != first[html[i]]
    for r in found:
        body = html[r.page_id]
        assert (r.record_type, r.refers_to) == (("revisit", first[body]) if revisit(r.page_id) else ("response", None))
        assert bytes(r.block) == (b"" if revisit(r.page_id) else body) and r.declared == hashlib.sha256(body).hexdigest()
    for record in raw:
        head, _, rest = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
    assert len(set(raw)) == len(rows)
    for r in warc.resolve(warc.parse(records)).collect():
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest())
    assert spark.read.parquet(f"{path}/payloads").count() == len(set(html.values()))
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_damage_is_found(spark):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:" + hashlib.sha256(b"abc").hexdigest() + "\r\nContent-Length: 3\r\n\r\n"
    good = [bytearray((head + "abc\r\n\r\n").encode())]
    assert [bytes(r.block) for r in warc.parse(spark.createDataFrame([good], "record binary")).collect()] == [b"abc"]
    for bad in (head + "abd\r\n\r\n", head + "abcd\r\n\r\n"):
        with pytest.raises(Exception, match="differs from its header"):
            warc.parse(spark.createDataFrame([[bytearray(bad.encode())]], "record binary")).collect()


# --- 10: token shards --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = token_shards.permute(np.arange(n), n, "k")
    assert sorted(p) == list(range(n))
    if n >= 1000:
        assert (p != token_shards.permute(np.arange(n), n, "other")).mean() > 0.9 and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_token_shards(spark, tmp_path):
    """Sequence i of the documents laid end to end stands at slot permute(i), however files are split."""
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randint(0, 80)), "s") for i in range(300)] + [(1000, None, "s"), (1001, "", "s"), (7, words(rng, 3), "s"), (None, "x", "s"), (None, "x", "s"), (1002, words(rng, 5000), "s"), (1003, LONG, "s")]
    rows += [(2000 + i, "tail", "s") for i in range(40)]
    docs_of(spark, rows).repartition(3).write.option("parquet.block.size", 4096).parquet((tmp_path / "docs").as_uri())
    d = spark.read.parquet((tmp_path / "docs").as_uri())
    order = [r.text for r in d.select("text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    laid = np.concatenate([tokens.encode(t, tokens.default_path()) for t in order])
    n = -(-len(laid) // 32)
    want = np.append(laid, [token_shards.PAD] * (n * 32 - len(laid))).reshape(n, 32)[np.argsort(token_shards.permute(np.arange(n), n, "order-1"))]
    for k, split in enumerate(("8k", "128m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        path = (tmp_path / f"shards{k}").as_uri()
        (tmp_path / f"shards{k}").mkdir()
        (tmp_path / f"shards{k}" / ".shard-00000000.bin-x").touch()  # as an attempt that failed leaves it
        index = token_shards.write(d, path, length=32, per_shard=500, most_parts=[20_000, 7][k])
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        r = sorted(token_shards.check(index, path, 32).collect(), key=lambda x: x.slot)
        assert all(f.name.startswith("shard-") or f.name.endswith(".crc") for f in (tmp_path / f"shards{k}").iterdir())
        assert [x.slot for x in r] == list(range(n)) and all(x.ids_crc32 == x.read_crc32 for x in r)
        records = list(token_shards.read(path))
        assert (np.array(records) == want).all()
        assert [list(x) for x in token_shards.read(path, 777, 1333)] == [list(x) for x in records[777:1333]]
        assert sum(x.length for x in r) == len(laid) and {i for x in r for i in x.doc_ids} == {i for i, _, _ in rows}
    assert token_shards.materialise(docs_of(spark, rows[:5])).count() == 1
    assert token_shards.materialise(d.limit(0)).count() == 0


# --- shared ---------------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_blocks():
    text = ("Éa b1-c, " * 200_000)[:1_500_000]
    h = word_hashes(text)
    w = re.findall(r"[^\W_]+", text.lower())
    assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
