"""Articles and their cited passages: references in wikitext, passage spans, date minima, the quality filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import least_where, let
from ..functions.sentences import sentences
from ..functions.text import ENTITIES, REFERENCE, any_date, has_link, reference_fields, strip, strip_markup, without_references
from ..sources.io import work_folder


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """References in order: (key, i, name, starts_at, ends_at, anchor_index, values, duplicate).

    A named reference counts where it is first filled; later uses, and uses before it, take its values; a
    second filling is left out and marks the article as ``duplicate``; notes are left out;
    references that follow each other without a gap share the first one's start as anchor.
    """
    found = F.expr(
        f"""aggregate(regexp_extract_all({text}, '{REFERENCE.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'")}', 0),
        named_struct('at', 1, 'refs', cast(array() as array<struct<m:string,s:int>>)),
        (acc, m) -> named_struct('at', locate(m, {text}, acc.at) + length(m), 'refs', array_append(acc.refs, named_struct('m', m, 's', locate(m, {text}, acc.at) - 1))),
        acc -> acc.refs)"""
    )
    d = df.select(key, F.posexplode_outer(found).alias("i", "r")).filter("i is not null")  # the plain posexplode is planned with a filter that finds all references again
    full = F.endswith(F.lower(F.col("r.m")), F.lit("</ref>"))
    group = lambda n: F.regexp_extract(F.col("r.m"), REFERENCE, n)
    name = F.nullif(F.when(full, group(1)).otherwise(group(3)), F.lit(""))
    d = d.select(key, "i", F.col("r.s").alias("starts_at"), (F.col("r.s") + F.length("r.m")).alias("ends_at"), full.alias("full"), name.alias("name"), F.when(full, group(2)).alias("info"))
    d = d.filter(~F.coalesce(F.lower(strip(F.col("name"))).isin("note", "notes"), F.lit(False)))
    order = F.row_number().over(Window.partitionBy(key, "name", "full").orderBy("i"))
    d = d.withColumn("nth", F.when(F.col("full") & F.col("name").isNotNull(), order))
    again = F.coalesce((F.col("nth") > 1) & (strip(F.col("info")) != ""), F.lit(False))
    d = d.withColumn("again", again).withColumn("duplicate", F.max("again").over(Window.partitionBy(key)))
    defined = d.filter("nth = 1").select(key, "name", reference_fields(F.col("info")).alias("given"))
    kept = d.filter("not again")
    w = Window.partitionBy(key).orderBy("i")
    fresh = F.coalesce(F.lag("ends_at").over(w) != F.col("starts_at"), F.lit(True)).cast("int")
    kept = kept.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    kept = kept.withColumn("anchor_index", F.min("starts_at").over(Window.partitionBy(key, "_run")))
    values = F.when(F.col("name").isNull(), reference_fields(F.col("info"))).otherwise(F.coalesce("given", F.create_map().cast("map<string,string>")))
    return kept.join(defined, [key, "name"], "left").select(key, "i", "name", "starts_at", "ends_at", "anchor_index", values.alias("values"), "duplicate")


def _once_at_most(part: Column, whole: Column) -> Column:
    """Whether a text that is not empty stands in another once at most, without overlap."""
    again = lambda p: let(F.instr(whole, p), lambda at: (at > 0) & (F.position(p, whole, at + F.length(p)) > 0))
    return ~let(part, again)


def _tail(text: Column, n: Column) -> Column:
    return F.substring(text, F.length(text) - n + 1, n)


def start_in(article: Column, candidate: Column) -> Column:
    """Where the shortest proper beginning of the candidate that stands in the article once at most does; null if nowhere.

    The longer a part, the more seldom it stands there, so its length is found by bisection.
    """
    part = lambda c, n: F.substring(c, F.lit(1), n)
    least = lambda c: least_where(F.lit(1), F.length(c) - 1, lambda n: _once_at_most(part(c, n), article))
    at = lambda c: let(least(c), lambda n: F.nullif(F.instr(article, part(c, n)), F.lit(0)) - 1)
    return let(candidate, at)


def end_in(article: Column, candidate: Column) -> Column:
    """Where the shortest proper ending of the candidate that stands in the article once at most ends; null if nowhere."""
    least = lambda c: least_where(F.lit(1), F.length(c) - 1, lambda n: _once_at_most(_tail(c, n), article))
    at = lambda c: let(least(c), lambda n: F.nullif(F.instr(article, _tail(c, n)), F.lit(0)) - 1 + n)
    return let(candidate, at)


def span_in(article: Column, candidates: Column, anchor: Column) -> Column:
    """(start, end) of the candidate that an anchor belongs to: the one that holds the text left of it, as much as it takes to
    leave one at most. An offset of 0 counts as not found. Fewer candidates hold more text, so the width is found by bisection."""
    left = lambda w: F.substring(article, anchor - w + 1, w)
    holding = lambda w: let(left(w), lambda t: F.filter(candidates, lambda c: F.contains(c, t)))
    longest = F.coalesce(F.array_max(F.transform(candidates, lambda c: F.length(c))), F.lit(0))
    width = least_where(F.lit(1), F.least(anchor, longest + 1), lambda w: F.size(holding(w)) <= 1)
    none = F.lit(None).cast("int")

    def place(own: Column) -> Column:
        ends = lambda start: F.when(start > 0, F.struct(start.alias("start"), F.when(start + F.length(own) == anchor, anchor).otherwise(end_in(article, own)).cast("int").alias("end"))).otherwise(F.struct(none.alias("start"), none.alias("end")))
        return let(start_in(article, own).cast("int"), ends)

    return let(let(width, lambda w: F.get(holding(w), F.lit(0))), place)


def date_field(values: Column, name: str) -> Column:
    """The date in the field whose key is ``name`` in lower case without hyphens; of several, the last entry."""
    own = F.filter(F.map_entries(values), lambda e: F.replace(strip(F.lower(e["key"])), F.lit("-"), F.lit("")) == name)
    return any_date(F.get(own, F.size(own) - 1)["value"])


def passages(refs: DataFrame, keys: list[str]) -> DataFrame:
    """References (values map) grouped by passage, with the earliest of each kind of date."""
    dates = {n: date_field(F.col("values"), k) for n, k in (("access_date", "accessdate"), ("date", "date"), ("archive_date", "archivedate"))}
    d = refs.withColumns(dates)
    info = F.struct("i", F.size("values").alias("key_count"), F.element_at("values", "ref_label").alias("ref_label"), "access_date", "date", "archive_date")
    return d.groupBy(*keys).agg(F.min("access_date").alias("earliest_access_date"), F.min("date").alias("earliest_date"), F.min("archive_date").alias("earliest_archive_date"), F.array_sort(F.collect_list(info)).alias("references"))


def assemble(df: DataFrame, key: str, wikitext: str) -> DataFrame:
    """Wikitext to cited passages: (key, start, end, contains_article, earliest dates, references) in the readable content.

    Each reference is led to the sentence that ends at its anchor; references of one sentence make a passage,
    whose place in the content without markup is found by its unique beginning and ending. An article's anchors are settled in its one row:
    its texts are read there, never copied to a reference and never part of a key. The key tells articles apart.
    """
    path = work_folder(df.sparkSession, "references")
    references(df, key, wikitext).write.parquet(path)  # read twice
    refs = df.sparkSession.read.parquet(path)
    anchors = refs.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set("anchor_index")).alias("_anchors"))
    d = df.select(key, F.col(wikitext).alias("_w")).join(anchors, F.col(key) == F.col("_key"))
    d = d.withColumn("_bare", without_references(F.col("_w")))
    d = d.select(key, "_w", "_anchors", sentences(F.col("_bare")).alias("_s"), strip_markup(F.col("_bare"), headings=False).alias("_content"))
    spans = F.transform("_anchors", lambda a: F.struct(a.alias("anchor"), span_in(F.col("_w"), F.col("_s"), a).alias("span")))
    d = d.select(key, "_w", "_content", F.filter(spans, lambda x: (x["span"]["start"] > 0) & (x["span"]["end"] > 0)).alias("_spans"))

    def placed(span: Column) -> Column:
        """A passage's place in the content, and whether it has links."""
        plain = without_references(F.substring(F.col("_w"), span["start"] + 1, span["end"] - span["start"]))
        of = lambda t: F.struct(span.alias("span"), has_link(t).alias("contains_article"), let(strip(strip_markup(t)), lambda p: F.struct(start_in(F.col("_content"), p).alias("start"), end_in(F.col("_content"), p).alias("end"))).alias("at"))
        return let(plain, of)

    d = d.select(key, "_spans", F.transform(F.array_distinct(F.transform("_spans", lambda x: x["span"])), placed).alias("_placed"))
    found = d.select(F.col(key).alias("_key"), F.explode_outer("_spans").alias("_x"), "_placed")  # the plain explode is planned with a filter that works all spans out again
    own = F.get(F.filter("_placed", lambda p: p["span"] == F.col("_x")["span"]), F.lit(0))
    found = found.select("_key", F.col("_x.anchor").alias("_anchor"), F.col("_x.span").alias("_span"), own.alias("_p")).filter("_anchor is not null and _p.at.start is not null and _p.at.end is not null")
    found = found.select("_key", "_anchor", "_span", F.col("_p.at.start").alias("start"), F.col("_p.at.end").alias("end"), F.col("_p.contains_article").alias("contains_article"))
    rows = refs.join(found, (F.col(key) == F.col("_key")) & (F.col("anchor_index") == F.col("_anchor")))
    return passages(rows.select(key, "i", "values", "_span", "start", "end", "contains_article"), [key, "_span", "start", "end", "contains_article"]).drop("_span")


def useful_passages(passage_data: Column, cutoff: Column, least: int = 50) -> Column:
    """Passages without links, long enough, with references that are all dated at the cutoff or after."""
    fresh = lambda r: F.coalesce((r["access_date"] >= cutoff) & (r["date"] >= cutoff) & (r["archive_date"].isNull() | (r["archive_date"] >= cutoff)), F.lit(False))
    return F.filter(passage_data, lambda p: ~p["contains_article"] & (F.size(p["references"]) > 0) & (p["end"] - p["start"] >= least) & F.forall(p["references"], fresh))


def useful_articles(articles: DataFrame, cutoff: Column, most: int = 9) -> DataFrame:
    """Recent articles that are no lists, with 1 to ``most`` useful passages; only those passages stay. An article whose age is not known is recent."""
    recent = lambda c: F.col(c).isNull() | (F.col(c) >= cutoff)
    d = articles.filter(recent("earliest_creation_date") & recent("created_en") & ~F.coalesce("removed_duplicates", F.lit(False)) & ~F.contains(F.lower("title"), F.lit("list")))
    return d.withColumn("passage_data", useful_passages(F.col("passage_data"), cutoff)).filter(F.size("passage_data").between(1, most))


def listing(html: Column) -> Column:
    """Entries of an HTML listing: array of (href, title) of the links in list items."""
    items = F.regexp_extract_all(html, F.lit(r'(?is)<li[^>]*>\s*<a\s+[^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))
    return F.transform(items, lambda x: F.struct(F.regexp_extract(x, r'href="([^"]*)"', 1).alias("href"), F.regexp_extract(x, r">([^<]*)</a>", 1).alias("title")))


#: Fixed: how a listing of new pages marks its entries, an entry's time and its page.
ENTRY, TIME_LINK, PAGE_LINK, NEXT_LINK = "data-mw-revid", "mw-newpages-time", "mw-newpages-pagename", "mw-nextlink"
#: Fixed: how the time is written.
LISTED_AT = "HH:mm, d MMMM yyyy"


def _link(item: Column, kind: str) -> Column:
    """The first link of a class, with its tag; empty if there is none."""
    return F.regexp_extract(item, rf"""(?is)<a\s(?:[^>]*\s)?class="(?:[^"]*\s)?{kind}(?:\s[^"]*)?"[^>]*>[^<]*</a>""", 0)


def _attribute(link: Column, name: str) -> Column:
    value = F.regexp_extract(link, rf"""(?is)^<a\s(?:[^>]*\s)?{name}="([^"]*)\"""", 1)
    for entity, to in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(to))
    return value


def new_pages(html: Column) -> Column:
    """Entries of a listing of new pages: array of (href, title, created). Entries without a page or a time that can be read are left out."""
    items = F.regexp_extract_all(html, F.lit(rf"(?is)<li\s[^>]*\b{ENTRY}\b[^>]*>.*?</li>"), F.lit(0))
    one = lambda x: let(F.struct(_link(x, PAGE_LINK).alias("page"), F.regexp_extract(_link(x, TIME_LINK), r">([^<]*)<", 1).alias("time")), lambda l: F.struct(_attribute(l["page"], "href").alias("href"), _attribute(l["page"], "title").alias("title"), F.coalesce(F.try_to_timestamp(strip(l["time"]), F.lit(LISTED_AT)).cast("timestamp_ntz"), any_date(l["time"])).alias("created")))
    return F.filter(F.transform(items, one), lambda e: e["created"].isNotNull() & (e["href"] != ""))


def next_page(html: Column) -> Column:
    """The address of the listing's next page, null on the last one."""
    return F.nullif(_attribute(_link(html, NEXT_LINK), "href"), F.lit(""))
