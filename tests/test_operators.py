"""Operators on hand-made rows: truth tables, quirks, properties, dirty input."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gristmill.functions import labels as L
from gristmill.functions import sentences as Y
from gristmill.functions import text as X
from gristmill.functions import vectors as V
from gristmill.functions.arrays import without_nested
from gristmill.operators import abbreviations, articles, joins, metrics, models, reports, sampling
from gristmill.operators.ranking import global_rank, rank_by_group, running_sums

from gristmill.sources import io
from gristmill.streaming import ingest


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


# --- labels ---------------------------------------------------------------------------------


def expected(answerable, c, g, f, n, failed=False):
    if failed or None in (c, g, f, n) or (g and f and n):
        return None
    if c:
        return 1
    if f and g:
        return 0 if answerable else None
    if f:
        return 1
    if n:
        return 1 if answerable else 0
    return 0


def test_judgement_truth_table(spark):
    rows = []
    for a, *v in itertools.product([True, False], *[[True, False, None]] * 4):
        rows += [(a, *v, None), (a, *v, True), (a, *v, False)]
    d = spark.createDataFrame(rows, "a boolean, conflicting boolean, grounded boolean, has_factual_information boolean, no_clear_answer boolean, fail boolean")
    pred = F.struct(*[F.col("fail").alias(n) for n in L.FAILS], *L.VERDICTS)
    got = d.select("*", L.from_judgement(F.col("a"), pred).alias("t")).collect()
    assert all(r.t == expected(r.a, r.conflicting, r.grounded, r.has_factual_information, r.no_clear_answer, r.fail is True) for r in got)
    none = F.lit(None).cast(d.select(pred.alias("p")).schema["p"].dataType)
    assert d.limit(1).select(L.from_judgement(F.lit(True), none).alias("t")).first().t is None


def test_judgement_checks_quotes(spark):
    """Each section's echo, its quote in the sentence and, but for the last, its quote in the context."""
    part = "struct<section_content:string,necessary_chunk_quote:string,section_quote:string,result:boolean,has_factual_information:boolean>"
    good = ("The sky is blue today.", "blue sky", "sky IS", True, True)
    rows = [((good, good, good), (False,) * 6), ((("The sky is green.",) + good[1:], good, good), (True,) + (False,) * 5), (((good[0], "nowhere") + good[2:], good, good), (False, True) + (False,) * 4), ((good, good, (good[0], "nowhere") + good[2:]), (False,) * 6), ((good, good[:2] + ("not there",) + good[3:], good[:2] + ("not there",) + good[3:]), (False, False, False, True, False, True))]
    d = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], f"i int, s struct<conflicting:{part},grounded:{part},cannot_really_answer:{part}>")
    got = {r.i: r.p for r in d.select("i", L.judgement(F.col("s"), F.lit("The sky is blue today."), F.lit("A blue sky, all day.")).alias("p")).collect()}
    for i, (_, want) in enumerate(rows):
        assert tuple(got[i][f] for f in L.FAILS) == want and got[i].conflicting and got[i].has_factual_information


@pytest.mark.parametrize("answerable,mark,target", [(True, "W", 1), (True, "IDK", 1), (True, "R", 0), (False, "W", 1), (False, "IDK", 0), (False, "R", None), (True, None, None)])
def test_human_label(spark, answerable, mark, target):
    d = spark.createDataFrame([(answerable, mark)], "a boolean, m string")
    assert d.select(L.from_human(F.col("a"), F.col("m")).alias("t")).first().t == target


def test_mistakes(spark):
    d = spark.createDataFrame([("The Cat sat, there.", [Row(type="A", output_quote="dog"), Row(type="B", output_quote="cat SAT"), Row(type="C", output_quote="cat")]), ("x", []), ("x", None)], "s string, m array<struct<type:string,output_quote:string>>")
    assert [r.p for r in d.select(L.from_mistakes(F.col("s"), F.col("m")).alias("p")).collect()] == ["B", "CORRECT", "UNKNOWN"]


# --- text ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        (" \n \n", []),
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("It was 2024. Then it rained. Pi is 3.14 now.", ["It was 2024. Then it rained.", "Pi is 3.14 now."]),
        ('He said "no." She left.\nNew line', ['He said "no."', "She left.", "New line"]),
        (" A b. C\U0001f600. D", ["A b.", "C\U0001f600.", "D"]),
        ("1. First\n2. Second", ["1. First", "2. Second"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, Y.sentences) == want


def test_sentences_of_null(spark):
    assert one(spark, None, Y.sentences) is None


@pytest.mark.parametrize(
    "labels,want",
    [([], [0, 0, 0]), ([(2, 5)], [1, 0, 0]), ([(2, 12)], [1, 1, 0]), ([(2, 10)], [1, 1, 0]), ([(-3, 1)], [1, 0, 0]), ([(25, 99)], [0, 0, 1]), ([(0, 1), (21, 22)], [1, 0, 1])],
)
def test_span_targets(spark, labels, want):
    d = spark.createDataFrame([([0, 10, 20], [Row(start=s, end=e) for s, e in labels])], "s array<long>, l array<struct<start:long,end:long>>")
    assert d.select(X.span_targets(F.col("s"), F.col("l")).alias("t")).first().t == want


def test_span_join_equals_expression(spark):
    s = spark.createDataFrame([(1, [0, 10, 20]), (2, [0]), (3, [5, 40, 30, 60]), (4, [10, 20])], "k long, starts array<long>")
    l = spark.createDataFrame([(1, 2, 10), (9, 0, 5), (3, 45, 46), (4, 0, 5), (4, None, 9), (None, 1, 2)], "k long, start long, `end` long")
    got = {(r.k, r.sent_i): r.target for r in joins.spans_to_targets(s, l, "k").collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 0, (2, 0): 0, (3, 0): 0, (3, 1): 0, (3, 2): 1, (3, 3): 0, (4, 0): 0, (4, 1): 0}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Smith met Mr. J. R. Jones at 5 p.m. in St. Louis, e.g. on Mondays. It rained.", ["Dr. Smith met Mr. J. R. Jones at 5 p.m. in St. Louis, e.g. on Mondays.", "It rained."]),
        ("He came at 5 p.m. The shop was shut.", ["He came at 5 p.m.", "The shop was shut."]),
        ("Acme Inc. The end", ["Acme Inc.", "The end"]),
        ('She asked "Dr. Who?" twice. (Prof. X did not.) No', ['She asked "Dr. Who?"', "twice.", "(Prof. X did not.)", "No"]),
        ("See vol.\nNext line", ["See vol.", "Next line"]),
        ("Wait... Then go.", ["Wait...", "Then go."]),
        ("Drift etc. Smith left.", ["Drift etc. Smith left."]),
    ],
)
def test_sentences_after_abbreviations(spark, text, want):
    assert one(spark, text, Y.sentences) == want


def test_sentences_over_lines(spark):
    split = lambda x: Y.sentences(x, mask=False, lines=False)
    assert one(spark, "A heading\nand more. It was 2024. Then\nit rained.\nEnd", split) == ["A heading\nand more.", "It was 2024.", "Then\nit rained.", "End"]


def test_learned_abbreviations(spark):
    """A short word that hardly ever stands without its full stop is an abbreviation; sentence ends and rare words are not; words that begin sentences end one."""
    nouns = ["Haus", "Baum", "Weg", "Fluss", "Berg", "Stadt"]
    rows = [(f"Gestern kam {nouns[i % 6]} zu str. {nouns[i % 5]} und abt. {nouns[i % 4]} mit. Danach ging man mit {nouns[i % 3]}. Danach nahm der {nouns[i % 6]} den {nouns[(i + 1) % 6]} mit.",) for i in range(300)]
    texts = spark.createDataFrame([*rows, ("Selten xq. Einmal",), (None,), ("",)], "text string")
    model = abbreviations.learn(texts, "text")
    assert model.abbreviations - Y.KNOWN == {"str", "abt"} and model.openers - Y.OPENERS == {"danach"}
    got = one(spark, "Er wohnt in der str. Baum 4. Dort abt. Danach kam er.", lambda x: Y.sentences(x, model=model))
    assert got == ["Er wohnt in der str. Baum 4. Dort abt.", "Danach kam er."]
    assert abbreviations.learn(texts.limit(0), "text") == Y.ENGLISH


def test_starts_of_sentences(spark, monkeypatch):
    """The first place of each sentence, also inside another one before; the automaton and the plain search agree."""
    texts = ["Yes. He said yes. Yes. No", "aa. a. aa. a.", "x\ny\nx", "\U0001f600 A. \U0001f600 A. B", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Y.sentences(F.col("t")).alias("s"))
    want = [None if r.t is None else [r.t.find(s) for s in r.s] for r in d.collect()]
    assert [r.p for r in d.select(Y.starts(F.col("t"), F.col("s")).alias("p")).collect()] == want
    monkeypatch.setattr(Y, "DIRECT", -1)
    assert [r.p for r in d.select(Y.starts(F.col("t"), F.col("s")).alias("p")).collect()] == want


def test_starts_in_linear_time(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"This is sentence number {i * 7919 % n} of the text." for i in range(n))
        d = spark.createDataFrame([(text,)], "t string").select("t", Y.sentences(F.col("t")).alias("s"))
        d.select(Y.starts(F.col("t"), F.col("s"))).collect()
        began = time.perf_counter()
        (r,) = d.select(F.col("s"), Y.starts(F.col("t"), F.col("s")).alias("p")).collect()
        took.append(time.perf_counter() - began)
        assert len(r.p) == n and all(r.p[k] == text.find(r.s[k]) for k in range(0, n, n // 50))
    assert took[1] < 9 * took[0] + 1, took


def test_similarity_by_bounds(spark):
    """Bounds never contradict the comparison, and leave little to it."""
    from difflib import SequenceMatcher

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefg \u00e9") for _ in range(n))
    rows = [("", ""), ("", "a"), ("a", ""), (None, "a"), ("a", None)]
    for _ in range(300):
        a = text(rng.randint(0, 60))
        b = rng.choice([a, text(rng.randint(0, 60)), a[: rng.randint(0, 60)], "".join(rng.sample(a, len(a))), a.replace("a", "b", 1)])
        rows.append((a, b))
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.similar_by_bounds(F.col("a"), F.col("b"), 0.95).alias("told"), X.similar(F.col("a"), F.col("b"), 0.95).alias("similar"))
    got = d.collect()
    for r in got:
        want = None if r.a is None or r.b is None else SequenceMatcher(None, r.a, r.b).ratio() >= 0.95
        assert r.similar == want and r.told in (None, want), r
    assert sum(r.told is None for r in got) < 0.5 * len(got)


def test_judgements_compare_few_sentences(spark):
    """Of the sentences against the section that the judge gives back, the share that is compared character by character."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.posexplode(Y.sentences(F.col("text"))).alias("i", "s"))
    told = X.similar_by_bounds(F.col("s"), F.when(F.col("doc_id") % 4 != 0, F.col("s")).otherwise(F.lit("another text")), 0.95)
    assert d.agg(F.avg(told.isNull().cast("int"))).first()[0] < 0.01


def test_materialised_after_a_crash_and_after_a_change(spark, tmp_path):
    path, source, made = str(tmp_path / "cache"), str(tmp_path / "in"), []
    spark.range(10).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source)

    def broken():
        boom = F.udf(lambda x: 1 // (x - 7), "long")
        return spark.range(10).select(boom("id").alias("id"))

    with pytest.raises(Exception, match="ZeroDivision"):
        io.materialised(spark, path, broken, [source])
    assert io.materialised(spark, path, make, [source]).count() == 10 and io.materialised(spark, path, make, [source]).count() == 10 and len(made) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert io.materialised(spark, path, make, [source]).count() == 15 and len(made) == 2
    (tmp_path / "cache" / "_writing-dead").mkdir()
    (tmp_path / "cache" / "_writing-dead" / "part-0").write_text("x")
    assert io.sweep(spark, path) >= 1 and io.materialised(spark, path, make, [source]).count() == 15 and len(made) == 2
    whole = io.fingerprint(spark, [source])
    (next((tmp_path / "cache").glob(whole + "/_SUCCESS"))).unlink()  # a move that was interrupted
    assert io.materialised(spark, path, make, [source]).count() == 15 and len(made) == 3
    assert io.materialised(spark, str(tmp_path / "other"), lambda: spark.range(3)).count() == 3


def test_listing_entries(spark):
    item = '<li class="a" data-mw-revid="5"><a class="mw-newpages-time" href="#">%s</a> <a href="/wiki/%s" title="%s" class="x mw-newpages-pagename">t</a></li>'
    html = "<ul>" + item % ("09:05, 3 May 2024", "A", "A &amp; B") + item % ("nonsense", "B", "B") + '<li data-mw-revid="1"><b>no link</b></li><li><a>plain</a></li>' + item % ("2024-05-02", "C", "C") + '</ul><a class="mw-nextlink" href="/n?a&amp;b">next</a>'
    d = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(articles.new_pages(F.col("h")).alias("e"), articles.next_page(F.col("h")).alias("n")).collect()
    assert [(x.href, x.title, str(x.created)) for x in d[0].e] == [("/wiki/A", "A & B", "2024-05-03 09:05:00"), ("/wiki/C", "C", "2024-05-02 00:00:00")]
    assert d[0].n == "/n?a&b" and not d[1].e and not d[2].e and d[2].n is None


def test_listing_stream_adds_new_links_only(spark, tmp_path):
    item = lambda n, day: f'<li data-mw-revid="1"><a class="mw-newpages-time">10:{n:02d}, {day} May 2024</a><a class="mw-newpages-pagename" href="/{n}" title="{n}">{n}</a></li>'
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: ingest.ingest_listing(spark, source, out, state, start="2024-05-20 00:00:00", end="2024-05-02 00:00:00", files_per_batch=1)
    add = lambda *items: spark.createDataFrame([("<ul>" + "".join(items) + "</ul>",)], "html string").coalesce(1).write.mode("append").parquet(source)
    links = lambda: sorted(r.href for r in spark.read.parquet(out).collect())
    add(item(1, 19), item(2, 18), item(3, 21))  # one is after the window
    run()
    assert links() == ["/1", "/2"]
    add(item(2, 18), item(4, 3), item(5, 1), item(4, 3))  # older ones come later: repeats, one before the window
    run()
    assert links() == ["/1", "/2", "/4"]
    run()
    add(item(6, 17), item(1, 19))
    run()
    assert links() == ["/1", "/2", "/4", "/6"]


def test_simplify_and_containment(spark):
    assert one(spark, "A b, C!\t~d", X.simplify) == "abcd"
    d = spark.createDataFrame([("", "abc"), ("B c", "a.b-C"), ("z", "abc")], "p string, w string")
    assert [r.y for r in d.select(X.is_in(F.col("p"), F.col("w")).alias("y")).collect()] == [True, True, False]


def test_json_snippet(spark):
    assert one(spark, 'x ```json\n{"a": 1}\n``` ```json{}```', X.json_snippet).strip() == '{"a": 1}'
    assert one(spark, "plain", X.json_snippet) == "plain"


def test_reference_fields(spark):
    got = one(spark, "{{cite web |url = http://x/?a=b |date=1|date= 2 |bare}} tail", X.reference_fields)
    assert got == {"ref_label": "cite web", "url": "http://x/?a=b", "date": "2"}
    assert one(spark, "no template", X.reference_fields) == {}


@pytest.mark.parametrize("text,want", [("2024-03-21", "2024-03-21"), ("21 March 2024", "2024-03-21"), ("March 4, 2024", "2024-03-04"), ("soon", None), (None, None)])
def test_dates(spark, text, want):
    y = one(spark, text, X.any_date)
    assert (y and str(y.date())) == want


def test_fold_system(spark):
    m = [Row(role="system", content="S"), Row(role="user", content="U"), Row(role="assistant", content="A")]
    d = spark.createDataFrame([(m,), (m[1:],)], "m array<struct<role:string,content:string>>")
    got = [[(x.role, x.content) for x in r.y] for r in d.select(X.fold_system(F.col("m")).alias("y")).collect()]
    assert got == [[("user", "S\n\nU"), ("assistant", "A")], [("user", "U"), ("assistant", "A")]]


def test_similarity_is_difflib(spark):
    d = spark.createDataFrame([("abcd", "bcde"), ("same", "same"), (None, "x")], "a string, b string")
    assert [r.y for r in d.select(X.similarity("a", "b").alias("y")).collect()] == [0.75, 1.0, None]


def test_space_after_references(spark):
    cases = {"a<ref>x</ref>b": "a<ref>x</ref> b", "a<ref>x</ref> b": "a<ref>x</ref> b", "a<ref name=q/><b>": "a<ref name=q/><b>", "a<ref>x</ref>  <i>": "a<ref>x</ref>  <i>", "a<ref>x</ref>": "a<ref>x</ref> ", "<ref>x</ref><ref>y</ref>z": "<ref>x</ref><ref>y</ref> z"}
    assert {c: one(spark, c, X.space_after_references) for c in cases} == cases


def test_strip_markup(spark):
    cases = {
        "{{a|{{b}}|{{c|{{d}}}}}}x": "x", "[[A|b]] [[C]]": "b C", "[[File:a.jpg|thumb|see [[b|c]] here]].": "thumb|see c here.", "[http://x.org/a label here] [https://y.org]!": "label here !",
        "== Head ==\ntext\n\n\n\nmore": "Head\ntext\n\nmore", "'" * 3 + "bold" + "'" * 3 + " " + "'" * 2 + "it" + "'" * 2 + " don't": "bold it don't", "a<!-- no -->b<br/>c": "abc", "5&nbsp;km &amp;lt; &quot;x&quot;": '5\u00a0km &lt; "x"', "\n\nx\n": "x",
    }
    assert {c: one(spark, c, X.strip_markup) for c in cases} == cases


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_quartiles_in_one_and_in_two_levels(spark, monkeypatch, few):
    monkeypatch.setattr(reports, "FEW", few)
    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(50)])) for g in ("a", "b", None) for _ in range(rng.randint(1, 200))] + [("empty", None)]
    got = {r.g: r for r in reports.describe(spark.createDataFrame(rows, "g string, x int"), "x", "g").collect()}
    for g in {g for g, _ in rows}:
        own = [x for h, x in rows if h == g and x is not None]
        assert got[g].n == len(own)
        if own:
            assert np.allclose([got[g].q25, got[g].q50, got[g].q75], np.quantile(own, [0.25, 0.5, 0.75]))


def test_uglify_changes_as_many_words_as_it_says(spark):
    n = 40_000
    words = [f"word{i:05d}" for i in range(n)]
    got = one(spark, " ".join(words), lambda x: X.uglify(F.lit(7), x))
    assert got == one(spark, " ".join(words), lambda x: X.uglify(F.lit(7), x)) != one(spark, " ".join(words), lambda x: X.uglify(F.lit(8), x))
    left = [w for w in got.split() if w]
    same = set(words) & set(left)
    short = sum(len(w) == 8 for w in left)
    swapped = sum(len(w) == 9 and w not in same for w in left)
    near = lambda found, share: abs(found / n - share) < 0.006
    assert near(n - len(left), 0.03) and near(short, 0.97 * 0.05)
    assert near(swapped, 0.97 * 0.04 * 0.95 * 0.86)  # equal digits that change places do not show
    assert near(len(re.findall(r"[^ \n] {3,6}(?=[^ \n])|[^ \n] {3,6}\n", got)), 0.97 * 0.05)
    assert near(len(re.findall(r"\n+", got)), 0.97 * 0.02) and max(map(len, re.findall(r"\n+", got))) == 2
    assert one(spark, None, lambda x: X.uglify(F.lit(7), x)) is None and one(spark, "", lambda x: X.uglify(F.lit(7), x)) == ""


def test_bpe_count(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(X.default_vocabulary())
    for text in ("", "Some words, and 漢字.", "x" * 5000):
        assert one(spark, text, lambda x: X.bpe_count(x, X.default_vocabulary())) == len(t.encode(text, add_special_tokens=False).ids)


def test_softmax(spark):
    got = spark.createDataFrame([([1.0, 3.0, -1e3, 800.0, 800.0],), ([0.0],), ([],)], "x array<double>").select(V.softmax(F.col("x")).alias("p")).collect()
    assert got[0].p == [0, 0, 0, 0.5, 0.5] and got[1].p == [1.0] and got[2].p == []


# --- articles ------------------------------------------------------------------------------------


def test_references(spark):
    text = 'A<ref name="b"/>. B<ref name="a">{{web|date=1}}</ref><ref>{{news|x=y}}</ref> C<ref name=a /> <ref name="note">n</ref>D<ref name="b">{{map}}</ref><ref name="a">{{other}}</ref><ref name="a"></ref><ref name="zz"/>'
    r = articles.references(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id long, t string"), "id", "t").orderBy("i").collect()
    got = [(x.name, x.anchor_index == x.starts_at, x["values"]) for x in r]
    web, both = {"ref_label": "web", "date": "1"}, {"ref_label": "map"} if False else {}
    assert [g[0] for g in got] == ["b", "a", None, "a ", "b", "a", "zz"]  # without quotes, the blank is part of the name
    assert [g[1] for g in got] == [True, True, False, True, True, True, False]
    assert got[1][2] == web and got[3][2] == {} and got[5][2] == web and got[2][2] == {"ref_label": "news", "x": "y"} and got[6][2] == both
    assert all(text[x.starts_at : x.ends_at].startswith("<ref") and text[x.starts_at : x.ends_at].endswith(">") for x in r)
    assert all(x.duplicate for x in r)


def test_references_with_several_attributes(spark):
    text = '<ref group="n" name="b">{{web|date=1}}</ref> <ref name="x" group="g"/> <ref name = "b" /> <ref group=q>{{map}}</ref>'
    r = articles.references(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("i").collect()
    assert [(x.name, x["values"].get("ref_label")) for x in r] == [("b", "web"), ("g", None), ("b", "web"), ("q", "map")]


def test_articles_of_unknown_age_are_recent(spark):
    cutoff = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    passage = "named_struct('start', 0, 'end', 90, 'contains_article', false, 'references', array(named_struct('access_date', timestamp_ntz'2024-02-01', 'date', timestamp_ntz'2024-02-01', 'archive_date', cast(null as timestamp_ntz))))"
    age = "CASE id WHEN 0 THEN timestamp_ntz'2024-01-01' WHEN 1 THEN timestamp_ntz'2024-01-02' END"
    d = spark.range(4).selectExpr("id", f"{age} AS earliest_creation_date", "CASE WHEN id < 3 THEN timestamp_ntz'2024-01-05' END AS created_en", "CASE WHEN id < 3 THEN false END AS removed_duplicates", "'T' AS title", f"array({passage}) AS passage_data")
    assert sorted(r.id for r in articles.useful_articles(d, cutoff).collect()) == [1, 2, 3]


def plain_start(article, candidate):
    for i in range(1, len(candidate)):
        if article.count(candidate[:i]) <= 1:
            at = article.find(candidate[:i])
            return at if at >= 0 else None
    return None


def plain_end(article, candidate):
    for i in range(1, len(candidate)):
        if article.count(candidate[-i:]) <= 1:
            at = article.find(candidate[-i:])
            return at + i if at >= 0 else None
    return None


def plain_span(article, candidates, anchor):
    for width in range(1, anchor + 1):
        candidates = [c for c in candidates if article[anchor - width : anchor] in c]
        if len(candidates) == 1:
            start = plain_start(article, candidates[0])
            if not start:
                return None, None
            return start, anchor if start + len(candidates[0]) == anchor else plain_end(article, candidates[0])
        if not candidates:
            break
    return None, None


def test_passage_bounds(spark):
    rng = random.Random(1)
    rows = [(None, "a"), ("a", None)]
    for _ in range(500):
        article = "".join(rng.choice("ab é") for _ in range(rng.randint(0, 40)))
        a = rng.randint(0, 40)
        rows.append((article, article[a : a + rng.randint(0, 12)] or rng.choice(["", "x", "ab"])))
    d = spark.createDataFrame(rows, "a string, c string").select("a", "c", articles.start_in(F.col("a"), F.col("c")).alias("s"), articles.end_in(F.col("a"), F.col("c")).alias("e"))
    for r in d.collect():
        assert (r.s, r.e) == ((None, None) if r.a is None or r.c is None else (plain_start(r.a, r.c), plain_end(r.a, r.c))), r


def test_passage_span(spark):
    article = "Intro words. One passage here. Another passage there."
    s = ["Intro words.", "One passage here.", "Another passage there."]
    rows = [(article, s, 30), (article, s, 12), (article, s, 0), (article, [], 5), (None, s, 3), (article, s, None)]
    rng = random.Random(2)
    for _ in range(300):
        parts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "." for _ in range(rng.randint(1, 6))]
        text = " ".join(parts)
        rows.append((text, parts, rng.randint(0, len(text))))
    got = spark.createDataFrame(rows, "a string, s array<string>, k int").select("a", "s", "k", articles.span_in(F.col("a"), F.col("s"), F.col("k")).alias("x")).collect()
    assert tuple(got[0].x) == (13, 30) and tuple(got[1].x) == (None, None)  # an offset of 0 counts as not found
    for r in got:
        want = (None, None) if r.a is None or r.k is None else plain_span(r.a, r.s, r.k)
        assert (tuple(r.x) if r.x else (None, None)) == want, r


def test_assemble_against_a_plain_version(spark):
    """Whole results on documents with references: spans by the plain searches, passages by plain grouping."""
    from gristmill.plans.text_queries import wikitext

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    d = docs.select("doc_id", F.concat(F.lit("Lead. "), F.replace(wikitext(), F.lit("<ref"), F.lit(".<ref"))).alias("w"))
    bare = X.without_references(F.col("w"))
    texts = {r.doc_id: r for r in d.select("doc_id", "w", Y.sentences(bare).alias("s"), X.strip_markup(bare, headings=False).alias("content")).collect()}
    spans = {}
    for r in articles.references(d, "doc_id", "w").collect():
        t = texts[r.doc_id]
        a, b = plain_span(t.w, list(t.s), r.anchor_index)
        if a and b and a > 0 and b > 0:
            spans.setdefault((r.doc_id, a, b), []).append(r.i)
    parts = spark.createDataFrame([(k, a, b, texts[k].w[a:b]) for k, a, b in spans], "k long, a int, b int, t string").withColumn("t", X.without_references(F.col("t")))
    want = []
    for r in parts.select("k", "a", "b", X.has_link(F.col("t")).alias("linked"), X.strip(X.strip_markup(F.col("t"))).alias("p")).collect():
        start, end = plain_start(texts[r.k].content, r.p), plain_end(texts[r.k].content, r.p)
        if start is not None and end is not None:
            want.append((r.k, start, end, r.linked, sorted(spans[r.k, r.a, r.b])))
    got = [(r.doc_id, r.start, r.end, r.contains_article, [x.i for x in r.references]) for r in articles.assemble(d, "doc_id", "w").collect()]
    assert sorted(got) == sorted(want) and len(want) > 60


@pytest.mark.parametrize("text,want", [("a{{b}}c", "ac"), ("{{" * 50 + "x" + "}}" * 50 + "y", "y"), ("}}a{{b}}", "}}a"), ("a {{b {{c}} d", "a {{b  d"), ("{{a}} }} {{", " }} {{"), ("{{a|{{b}}{{c}}}}x{{d}}", "x"), ("{{}}", ""), ("none", "none"), ("", ""), (None, None)])
def test_nested_templates(spark, text, want):
    assert one(spark, text, lambda x: without_nested(x, "{{", "}}")) == want


def test_nested_marks_against_a_plain_stack(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice(["{{", "}}", "a", "b"]) for _ in range(rng.randint(0, 30))),) for _ in range(300)]

    def plain(t):
        marks = [(m.start(), m.group()) for m in re.finditer(r"\{\{|\}\}", t)]
        stack, gone = [], set()
        for at, m in marks:
            if m == "{{":
                stack.append(at)
            elif stack:
                gone |= set(range(stack.pop(), at + 2))
        return "".join(c for i, c in enumerate(t) if i not in gone)

    got = spark.createDataFrame(rows, "t string").select("t", without_nested(F.col("t"), "{{", "}}").alias("w")).collect()
    assert [r.w for r in got] == [plain(r.t) for r in got]


def test_assemble(spark):
    ref = "<ref>{{cite web|access-date=2024-01-0%d|date=2023-05-01}}</ref>"
    wiki = "A short lead without a source here.\nThe ''old'' bridge was closed in spring." + ref % 9 + ref % 5 + "\nIt lies by the [[river]] north of town." + ref % 7 + "\nNobody cites this one."
    r = articles.assemble(spark.createDataFrame([(1, wiki), (2, None), (3, "no refs")], "id long, w string"), "id", "w").orderBy("start").collect()
    content = "A short lead without a source here.\nThe old bridge was closed in spring.\nIt lies by the river north of town.\nNobody cites this one."
    assert [content[x.start : x.end] for x in r] == ["The old bridge was closed in spring.", "It lies by the river north of town."]
    assert [x.contains_article for x in r] == [False, True] and [len(x.references) for x in r] == [2, 1]
    assert str(r[0].earliest_access_date.date()) == "2024-01-05"


# --- sampling ------------------------------------------------------------------------------------


def test_global_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), i) for i in range(1000)]
    r = global_rank(spark.createDataFrame(rows, "k long, i long"), "k", "i", parts=16).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(x.k, x.i) for x in sorted(r, key=lambda x: x["rank"])] == want
    assert sorted(x["rank"] for x in r) == list(range(1000))


def test_group_split_never_splits_a_group(spark):
    for sizes in ([5, 1, 9, 3, 2], [40, 1], [7]):
        rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
        r = sampling.group_split(spark.createDataFrame(rows, "g long, i long"), "g").collect()
        assert len(r) == len(rows)
        assert all(len({x.split for x in r if x.g == g}) == 1 for g in range(len(sizes)))


def test_balanced_classes(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(53)]
    d = spark.createDataFrame(rows, "id long, y int")
    under = sampling.undersample(d, "y", ["id"]).collect()
    assert sum(r.y for r in under) == 11 and len(under) == 22 and max(r.id for r in under if r.y == 0) == 13
    over = sampling.oversample(d, "y", ["id"]).collect()
    assert sum(r.y for r in over) == 42 and len(over) == 84
    assert sampling.undersample(d.filter("y = 1"), "y", ["id"]).count() == 0


def test_balance_plan_lowers_imbalance():
    counts = {("a", 0): 50, ("a", 1): 10, ("b", 0): 20, ("b", 1): 5}
    more = sampling.balance_plan(counts)
    after = {k: n + more.get(k, 0) for k, n in counts.items()}
    assert sampling.imbalance(after, 2) <= 1e-4 < sampling.imbalance(counts, 2)


def test_balance_plan_takes_the_best_step_each_time():
    rng = random.Random(2)
    for _ in range(20):
        counts = {c: rng.randint(1, 30) for c in itertools.product("ab", (None, 1, 2), (0, 1)) if rng.random() < 0.8}
        now, scores, added = dict(counts), [sampling.imbalance(counts, 3)], []
        while scores[-1] > 1e-4 and len(added) < 150:
            tried = [sampling.imbalance({**now, c: n + 1}, 3) for c, n in now.items()]
            added.append(list(now)[tried.index(min(tried))])
            now[added[-1]] += 1
            scores.append(min(tried))
        kept = added[: scores.index(min(scores))]
        assert sampling.balance_plan(counts, steps=150, gain=-1.0) == {c: kept.count(c) for c in kept}


def test_multi_oversample_query_takes_all_steps_and_columns(spark, tmp_path):
    from gristmill.plans import registry

    d = spark.range(10_000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src1' AS source", "1 AS n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    d.selectExpr("doc_id", "1 AS quality", "int(hash(doc_id, 7) % 100 in (0, 1, 2, 3, 4, 5, -1, -2, -3, -4, -5, -6)) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    r = registry.queries()["g8_multi_oversample"](spark, str(tmp_path)).cache()
    assert {"quantization", "answerable", "chunk_size", "chunks_per_prompt", "template", "target"} <= set(r.columns)
    assert r.count() > 12_000
    shares = [x.n for x in r.groupBy("target").agg(F.count("*").alias("n")).collect()]
    assert ((max(shares) - min(shares)) / sum(shares)) ** 2 < 0.2


def test_multi_oversample_keeps_nulls_and_every_row(spark):
    rows = [(i, None if i % 3 else "int4", int(i % 4 == 0)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, q string, y int")
    r = sampling.multi_oversample(d, ["q", "y"], "id").collect()
    assert {x.id for x in r} == set(range(60))
    assert reports.imbalance_score(spark.createDataFrame(r), ["q", "y"]).first().score < reports.imbalance_score(d, ["q", "y"]).first().score
    copies = [x.copy for x in r if x.q is None and x.y == 1]
    assert max(copies) <= min(max(x.copy for x in r if x.id == i) for i in {x.id for x in r if x.q is None and x.y == 1}) + 1


def test_permuted_labels_keep_their_number(spark):
    d = spark.createDataFrame([(i, i % 3, int(i % 7 == 0)) for i in range(300)], "id long, s int, y int")
    r = sampling.permute_labels(d, "id", "y", ["s"], "x").collect()
    assert len(r) == 300 and all(sum(x.y for x in r if x.s == s) == sum(int(i % 7 == 0) for i in range(300) if i % 3 == s) for s in range(3))


def test_thin(spark):
    rows = [(1, 1, "Who is it"), (1, 2, "what was"), (2, 3, "who was"), (2, 4, "What else"), (3, 5, "WHO again"), (4, 6, "")]
    r = sampling.thin(spark.createDataFrame(rows, "a long, i long, t string"), "a", "t", "i").collect()
    assert {(x.a, x.i) for x in r} == {(1, 1), (2, 4), (3, 5)}


def test_other_passages(spark):
    d = spark.createDataFrame([(i, i % 5) for i in range(200)], "id long, g long")
    r = joins.other_passages(d, "id", "g", 3, "s").collect()
    per = {}
    for x in r:
        per.setdefault(x.id, []).append(x.other)
    assert set(per) == set(range(200)) and all(len(set(o)) == 3 and all(v % 5 != k % 5 for v in o) for k, o in per.items())


@pytest.mark.parametrize("groups", [lambda i: 0 if i % 10 else i, lambda i: None if i < 80 else i % 3, lambda i: str(i % 2) if i < 6 else "x", lambda i: int(i == 7), lambda i: 1])
def test_other_passages_of_a_group_that_holds_most_rows(spark, groups):
    of = {i: groups(i) for i in range(120)}
    kind = "string" if isinstance(of[0], str) else "long"
    r = joins.other_passages(spark.createDataFrame(list(of.items()), f"id long, g {kind}"), "id", "g", 3, "s", draws=4).collect()
    per = {i: [] for i in of}
    for x in sorted(r, key=lambda x: x.j):
        assert x.j == len(per[x.id])
        per[x.id].append(x.other)
    for i, others in per.items():
        assert len(set(others)) == len(others) == min(3, sum(g != of[i] for g in of.values())) and all(of[o] != of[i] for o in others)


def plain_thin(rows):
    """(group, order, text): of each group the row whose first word has been taken least."""
    taken, out = {}, set()
    for g in sorted({r[0] for r in rows}):
        own = [(taken.get(t.split()[0].lower(), 0), i, t.split()[0].lower()) for h, i, t in sorted(rows) if h == g and t.split()]
        if own:
            _, i, w = min(own, key=lambda x: x[:2])
            taken[w] = taken.get(w, 0) + 1
            out.add((g, i))
    return out


def test_thin_against_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), i, " ".join(rng.choice(["who", "What", "how", "Who", "when", ""]) for _ in range(3))) for i in range(400)]
    r = sampling.thin(spark.createDataFrame(rows, "a long, i long, t string"), "a", "t", "i").collect()
    assert {(x.a, x.i) for x in r} == plain_thin(rows)


def test_running_sums_whatever_the_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, -5, 0, 1, 2, 3, 1000, rng.randrange(50)]), i, i % 3) for i in range(300)]
    d = spark.createDataFrame(rows, "k long, i long, g int")
    for parts in (1, 2, 3, 7, 8, 256):
        r = running_sums(d, F.col("k"), [F.col("k").asc_nulls_first(), "i"], {"s": F.col("i")}, by=["g"], parts=parts).collect()
        for g in range(3):
            want = list(itertools.accumulate(i for _, i, _ in sorted((x for x in rows if x[2] == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))))
            assert sorted(x.s for x in r if x.g == g) == sorted(want)


def test_rank_by_group(spark):
    rows = [(i, [None, "a", "ab", "b", "same prefix 1", "same prefix 2"][min(i * i % 11, 5)]) for i in range(500)]
    r = rank_by_group(spark.createDataFrame(rows, "k long, g string"), "g", "k", "n").collect()
    assert [x.k for x in sorted(r, key=lambda x: x.n)] == [k for k, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))] and {x.n for x in r} == set(range(500))


def test_clusters_have_equal_classes(spark):
    rows = [(i, ["a", "b", None][i % 3], i % 4, int(i % 5 == 0)) for i in range(240)]
    r = sampling.clustered_undersample(spark.createDataFrame(rows, "id long, q string, c int, y int"), ["q", "c"], "y", "id", k=4).collect()
    of = {}
    for x in r:
        of.setdefault(x.cluster, [0, 0])[x.y] += 1
        assert (x.id, x.q, x.c, x.y) in rows
    assert len(of) == 4 and all(a == b > 0 for a, b in of.values()) and len({x.id for x in r}) == len(r)
    assert all(len({x.cluster for x in r if (x.q, x.c) == t}) == 1 for t in {(x.q, x.c) for x in r})


# --- models ------------------------------------------------------------------------------------------


def test_perceptron_gradients():
    rng = np.random.default_rng(3)
    sizes = [5, 7, 4, 1]
    flat = models.Perceptron.new(sizes, rng).flat()
    x, y = rng.normal(size=(11, 5)), (rng.random(11) < 0.5).astype(float)
    g = models.Perceptron.of(sizes, flat).gradient(x, y)
    for at in rng.integers(len(flat), size=30):
        loss = []
        for step in (1e-5, -1e-5):
            moved = flat.copy()
            moved[at] += step
            loss.append(models.losses(models.Perceptron.of(sizes, moved), x, y)[0])
        assert abs((loss[0] - loss[1]) / 2e-5 - g[at]) < 1e-5


def test_perceptron_learns_stops_and_keeps_the_best():
    rng = np.random.default_rng(4)
    x, ids, training = rng.normal(size=(600, 6)), np.arange(600), np.arange(600) < 400
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    check = lambda r, y: models.losses(models.Perceptron.of([6, 16, 8, 1], r.best), x[400:], y[400:]) / 200
    (r,) = models.fit(x, y, ids, training, hidden=(16, 8), settings=models.Settings(epochs=200, patience=20, rate=0.01, dropout=0.0, batches=12))
    assert r.least[1] > 0.85 and np.allclose(check(r, y)[:2], r.least)
    noise = (rng.random(600) < 0.5).astype(float)
    (r,) = models.fit(x, noise, ids, training, hidden=(16, 8), settings=models.Settings(epochs=200, patience=5, rate=0.01, batches=12))
    assert r.epochs < 100 and np.allclose(check(r, noise)[:2], r.least)
    model = models.Perceptron.of([6, 16, 8, 1], r.best)
    assert (models.Perceptron.from_bytes(model.to_bytes()).score(x) == model.score(x)).all()
    assert models.Settings() == models.Settings(epochs=800, patience=30, rate=2.5e-6, decay=1e-5, dropout=0.15, batches=1, seed=432) and models.HIDDEN == (256, 128, 64)


def test_perceptron_draws():
    """Batches part the rows of an epoch; dropout leaves out its share, another one in each step."""
    ids = np.arange(5000, dtype=np.int64) * 7919
    batches = models.draws(ids, 432, 0, 3, 1) % np.uint64(10)
    assert np.bincount(batches.astype(int), minlength=10).min() > 400 and (batches != models.draws(ids, 432, 0, 4, 1) % np.uint64(10)).mean() > 0.8
    kept = models.kept_inputs(ids[:1000], 20, 0.15, 432, 0, 1, 2)
    assert abs(kept.mean() - 0.85) < 0.01 and abs(kept.mean(axis=0) - 0.85).max() < 0.06
    assert (kept != models.kept_inputs(ids[:1000], 20, 0.15, 432, 0, 2, 2)).any()


@pytest.mark.parametrize("batches", [1, 3])
def test_training_over_executors_equals_one_process(spark, batches):
    """However rows are dealt, the models are those of the same training on arrays."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 2, 1) for _ in range(3)], i % 2, "train" if i % 4 else "val") for i in range(200)]
    d = spark.createDataFrame([*rows, (900, None, 1, "train"), (901, [0.0, 0.0, 0.0], None, "test"), (902, [1.0], 1, "train"), (903, [], 0, "val")], "k long, features array<float>, y int, split string").repartition(7)
    options = {"epochs": 4, "rate": 0.01, "batches": batches}
    found = {r.run: r for r in models.train(d.filter("split = 'train'"), d.filter("split = 'val'"), "k", runs=2, hidden=(6, 4), **options).collect()}
    used = sorted(d.filter("size(features) = 3 and y is not null").select("features", "y", F.xxhash64("k").alias("h"), "split").collect(), key=lambda r: r.h)
    x, y = np.array([r.features for r in used], float), np.array([r.y for r in used], float)
    plain = models.fit(x, y, np.array([r.h for r in used]), np.array([r.split == "train" for r in used]), hidden=(6, 4), settings=models.Settings(**options), runs=2)
    assert sorted(found) == [0, 1]
    for r in plain:
        assert np.allclose(models.Perceptron.from_bytes(bytes(found[r.number].model)).flat(), r.best, atol=1e-10)
        assert found[r.number].epochs == r.epochs and np.allclose((found[r.number].val_loss, found[r.number].val_accuracy), r.least)
    scores = models.predict(models.train(d.filter("split = 'train'"), d.filter("k < 0"), "k", runs=2, hidden=(4,), epochs=1), d.filter("size(features) = 3")).collect()
    assert len(scores) == 2 * 201 and all(0 < r.score < 1 for r in scores)
    assert models.train(d.limit(0), d.limit(0), "k").collect() == []


@pytest.mark.parametrize("most", [0, 1, 5, 4095, 8191])
def test_largest_fit(most):
    assert models.largest_fit(lambda n: n <= most) == most


# --- metrics -----------------------------------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame([("g", float(s), y) for s, y in rows], "grp string, score double, y int")


def test_areas_equal_rank_statistics(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(200)]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows if y for b, z in rows if not z)
    want = wins / (sum(y for _, y in rows) * sum(1 - y for _, y in rows))
    assert abs(metrics.areas(scored(spark, rows), ["grp"]).first().roc_auc - want) < 1e-8
    assert abs(metrics.areas(scored(spark, rows), ["grp"], positive=0).first().roc_auc - (1 - want)) < 1e-8


def test_sweep_is_strict_at_thresholds(spark):
    rows = [(k / 100, k % 2) for k in range(101)] + [(0.295, 1), (1.0, 1), (0.0, 0)]
    for r in metrics.sweep(scored(spark, rows), ["grp"]).collect():
        assert r.tp == sum(s > r.threshold and y == 1 for s, y in rows), r.threshold
        assert r.fp == sum(s > r.threshold and y == 0 for s, y in rows), r.threshold
        assert r.tp + r.fn == sum(y for _, y in rows)


def test_degenerate_groups(spark):
    for rows in ([(0.3, 0)] * 4, [(0.3, 1)] * 4, [(0.5, 0), (0.5, 1)]):
        best = metrics.best_thresholds(metrics.sweep(scored(spark, rows), ["grp"]), ["grp"])
        r = metrics.at_thresholds(scored(spark, rows), best, ["grp"], ["grp"]).first()
        assert r.accuracy is not None and r.mcc == 0.0 and (r.kappa is None or r.kappa == 0.0)
    assert metrics.sweep(scored(spark, []), ["grp"]).count() == 0


def test_run_summary_ignores_nan(spark):
    d = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("a", float("nan")), ("a", None)], "k string, value double")
    assert tuple(metrics.run_summary(d, ["k"]).first()) == ("a", 60.0, 10.0)


def test_reports_on_empty_and_null_groups(spark):
    d = spark.createDataFrame([("m", None, None), ("m", None, 1), ("m", "q", 0)], "model string, q string, target int")
    r = {x.q: (x.sentences, x.valid, x.rate) for x in reports.label_stats(d, "q").collect()}
    assert r == {None: (2, 1, 1.0), "q": (1, 1, 0.0)}
    assert reports.label_stats(d.limit(0), "q").count() == 0


def test_token_counts_hold_few_tokens_at_once(monkeypatch):
    """Texts are encoded in pieces of bounded size, however many a batch has."""
    seen = []

    class Words:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.append(sum(map(len, texts)))
            return [t.split() for t in texts]

    monkeypatch.setattr(X, "TOKENS_AT_ONCE", 100)
    texts = ["a b c " * 5, None, "", "d " * 90, *["e f"] * 200]
    assert list(X.token_counts(iter(texts), Words())) == [15, None, 0, 90, *[2] * 200]
    assert max(seen) == 180 and sorted(seen)[-2] <= 100 and list(X.token_counts([], Words())) == []


def plan_of(df):
    """The optimized plan, as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_is_difflibs_ratio():
    """Exactly difflib's number, and the texts that it would compare slowly are settled by a few long integers."""
    from difflib import SequenceMatcher

    from gristmill.functions import matching

    rng = random.Random(3)
    text = lambda k, n: "".join(rng.choice("ab. é漢xyz"[:k]) for _ in range(rng.randrange(n)))
    for k, n in [(1, 30), (2, 40), (4, 60), (9, 80), (9, 260)] * 60:
        a, b = text(k, n), text(k, n)
        assert matching.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
    for a, b in (("", ""), ("", "a"), ("a" * 199, "a" * 198), ("a" * 300, "a" * 200), ("x" + "ab" * 90, "ab" * 99)):
        assert matching.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


SF1 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p18_similarity", "s5_decumulate"])
def test_neighbours_within_the_row(spark, name):
    """What stands before a sentence is read in its document's row: no window, so no copies of texts are shuffled."""
    from gristmill.plans import registry

    assert "Window" not in plan_of(registry.queries()[name](spark, SF1))


def test_sentences_worked_out_once(spark):
    """No filter before the rows are made works all sentences out a second time."""
    from gristmill.plans.text_queries import sentence_rows

    plan = plan_of(sentence_rows(spark, SF1).select("doc_id", "sentence"))
    assert plan.count("regexp_extract") == 2


def test_words_are_matched_once_each(spark):
    """Patterns read the different words with their numbers, not all words: equal ones are counted first."""
    d = spark.createDataFrame([(1, "The end. (The end.) See etc. The end, the end"), (2, None), (3, "")], "id int, text string")
    found = Counter()
    for r in abbreviations.tokens(d, "text").collect():
        found[r.t, r.p] += r.n
    assert found == {("The", None): 1, ("end.", None): 2, ("The", "end."): 1, ("See", "end."): 1, ("etc.", None): 1, ("The", "etc."): 1, ("end", None): 2, ("the", None): 1}
    counts = {r.word: (r.n, r.n_stop) for r in abbreviations.word_counts(d, "text").collect()}
    assert counts["end"] == (4, 2) and counts["the"] == (4, 0) and counts["etc"] == (1, 1)
    first = {r.word: (r.n, r.n_first) for r in abbreviations.opener_scores(d, "text", frozenset({"etc"})).collect()}
    assert first["the"] == (4, 1) and first["see"] == (1, 1) and first["end"] == (4, 0)


def test_judged_places_found_once(spark):
    """A sentence's place in its text is looked for once."""
    from gristmill.plans import registry

    assert plan_of(registry.queries()["l2_judgement_fields"](spark, SF1)).count("instr(text") == 1


def test_strip_takes_the_class_of_spaces(spark):
    """The listed characters are those of the pattern, and no other up to U+FFFF is one."""
    chars = spark.range(1, 0xD800).union(spark.range(0xE000, 0x10000)).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert sorted(r.c for r in chars.filter(F.regexp_like("c", F.lit(f"^{X.SPACE}\\z"))).collect()) == sorted(X.SPACES)
    assert one(spark, "　\n a  b \x0b", X.strip) == "a  b" and one(spark, "​\x1c", X.strip) == "​\x1c"


@pytest.mark.parametrize("t", ["x", "```json{}```", "a ```json 1 ``` ```json 2 ```", "```json no end", "````json`````", "``` 1 ```json 2", None])
def test_json_snippet_is_the_first_fenced_block(spark, t):
    found = re.search("(?s)```json(.*?)```", t or "")
    assert one(spark, t, X.json_snippet) == (found.group(1) if found else t)
