"""Sources and sinks (IO1-IO18): written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles, sampling
from ..sources import io
from ..sources.io import table
from ..streaming.ingest import ingest_days, ingest_listing
from .registry import query


@query("SELECT doc_id, lang, source, length(text) AS n FROM documents")
def io1_io9_json_documents(spark, sf):
    path = io.work_folder(spark, "json")
    io.write_json(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), path)
    d = io.json_lines(spark, path, "doc_id long, lang string, source string, text string")
    return d.select("doc_id", "lang", "source", F.length("text").alias("n"))


@query("SELECT conv_id, count(*) AS turns, min(role) AS first_role FROM conversations GROUP BY conv_id")
def io2_io3_json_lines(spark, sf):
    path = io.work_folder(spark, "jsonl")
    io.write_json(table(spark, sf, "conversations").select("conv_id", "turn", "role"), path)
    d = io.json_lines(spark, path, "conv_id long, turn long, role string")
    return d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("role").alias("first_role"))


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON r_regionkey = n_regionkey")
def io4_json_multiline(spark, sf):
    """Documents written over several lines, one a file."""
    path = io.work_folder(spark, "multi")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    pretty = F.concat(F.lit('{\n "region": "'), F.col("r_name"), F.lit('",\n "nations": '), F.to_json("nations"), F.lit("\n}"))
    nested.select(pretty.alias("value"), F.col("r_name").alias("file")).write.partitionBy("file").text(path)
    d = io.json_documents(spark, path, "region string, nations array<string>")
    return d.select("region", F.explode("nations").alias("nation"))


@query("SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def io5_io10_nested_table(spark, sf):
    """Nested binary tables as Parquet in place of pickles."""
    path = io.work_folder(spark, "nested")
    table(spark, sf, "embeddings").select("vec_id", F.struct("label", "embedding").alias("state")).write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "state.label", F.size("state.embedding").alias("dim"))


_RUNS = "SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, CASE doc_id % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END AS model, CASE doc_id % 3 WHEN 0 THEN 'int4' WHEN 1 THEN 'int8' END AS quantization"


def _runs(spark, sf):
    path = io.work_folder(spark, "runs")
    d = table(spark, sf, "documents").selectExpr(*_RUNS.removeprefix("SELECT ").replace(", CASE", "\nCASE").split("\n"))
    io.write_runs(d, path)
    return path, d.schema


@query(f"{_RUNS} FROM documents")
def io6_partition_discovery(spark, sf):
    path, schema = _runs(spark, sf)
    return io.runs(spark, path, schema)


@query(f"SELECT * FROM ({_RUNS} FROM documents) WHERE model = 'alpha' AND quantization IS NULL")
def io7_partition_pruning(spark, sf):
    """The unquantized runs of one model."""
    path, schema = _runs(spark, sf)
    return io.runs(spark, path, schema, "alpha", "None")


@query("SELECT event_id, ts::DATE AS created_date FROM events WHERE ts::DATE >= DATE '2024-01-10' AND ts::DATE < DATE '2024-01-12'")
def io8_day_partitions(spark, sf):
    path = io.work_folder(spark, "days")
    io.write_days(table(spark, sf, "events").select("event_id", "ts"), path, "ts")
    d = spark.read.schema("event_id long, ts timestamp_ntz, created_date date").parquet(path)
    return d.filter("created_date >= '2024-01-10' and created_date < '2024-01-12'").select("event_id", "created_date")


@query("SELECT ts::DATE AS created_date, count(*) AS n FROM events GROUP BY ALL")
def io8_day_stream(spark, sf):
    """Day partitions filled by a stream over arriving files."""
    base = io.work_folder(spark, "stream")
    table(spark, sf, "events").select("event_id", "ts").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    ingest_days(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state", "ts")
    return spark.read.parquet(f"{base}/out").groupBy("created_date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def io11_materialised(spark, sf):
    """Made once, and made again only if the events' files change."""
    path = io.work_folder(spark, "cache")
    make = lambda: table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    inputs = [f"{sf}/events.parquet"]
    io.materialised(spark, path, make, inputs)
    return io.materialised(spark, path, make, inputs)


def listing_pages(spark, sf):
    """Listing pages over the events, newest entries first; some entries have no time, and each page repeats the first entries of the next one."""
    name = F.concat(F.lit("Event &quot;"), F.col("event_id").cast("string"), F.lit("&quot;"))
    time = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit('<a href="#" class="mw-newpages-time">'), F.date_format("ts", articles.LISTED_AT), F.lit("</a>"))).otherwise(F.lit("nominated"))
    item = F.concat(F.lit('<li data-mw-revid="1" class="x">'), time, F.lit(' <a href="/wiki/E'), F.col("event_id").cast("string"), F.lit('?a=1&amp;b=2" class="mw-newpages-pagename" title="'), name, F.lit('">'), name, F.lit("</a> (<a href='#'>hist</a>)</li>"))
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 50).alias("page"), "event_id", item.alias("item"))
    both = F.array_distinct(F.array("page", F.floor((F.col("event_id") + 5) / 50)))
    e = e.select(F.explode(both).alias("page"), "event_id", "item")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "item")), asc=False), lambda x: x["item"])
    return e.groupBy("page").agg(F.concat(F.lit("<html><ul>"), F.array_join(listed, "\n"), F.lit('</ul><a class="mw-nextlink" href="/next">older</a>')).alias("html"))


_WINDOW = {"start": "2024-01-20 00:00:00", "end": "2024-01-05 00:00:00"}


@query(f"""SELECT '/wiki/E' || event_id || '?a=1&b=2' AS href, 'Event "' || event_id || '"' AS title, date_trunc('minute', ts) AS created FROM events
WHERE event_id % 17 <> 0 AND date_trunc('minute', ts) > TIMESTAMP '{_WINDOW["end"]}' AND date_trunc('minute', ts) <= TIMESTAMP '{_WINDOW["start"]}'""")
def io12_new_pages(spark, sf):
    """New pages within a window, each link once, by a stream over listing pages that arrive in two rounds and overlap."""
    base = io.work_folder(spark, "listing")
    pages = listing_pages(spark, sf)
    for part in (F.col("page") % 2 == 0, F.lit(True)):
        pages.filter(part).select("html").write.mode("append").parquet(f"{base}/in")
        ingest_listing(spark, f"{base}/in", f"{base}/out", f"{base}/state", **_WINDOW)
    return spark.read.parquet(f"{base}/out")


@query(r"""SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS href, regexp_extract(x, '>([^<]*)</a>', 1) AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li[^>]*>\s*<a\s+[^>]*href="[^"]*"[^>]*>[^<]*</a>', 0, 'is')) AS x FROM pages)""")
def io12_listing(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(articles.listing(F.col("html"))).alias("x")).select("page_id", "x.href", "x.title")


@query("SELECT user_id, min(ts) AS earliest FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id")
def io12_io14_earliest(spark, sf):
    """Dates within a listing's window, the earliest of each key."""
    e = table(spark, sf, "events").filter(io.between(F.col("ts"), "2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    return io.earliest(e, "user_id", "ts")


@query("SELECT d.doc_id, l.quality AS answer FROM documents d LEFT JOIN labels l USING (doc_id)")
def io15_io16_responses(spark, sf):
    """An external model's answers as a table."""
    answers = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("answer"))
    return io.with_responses(table(spark, sf, "documents").select("doc_id"), answers, ["doc_id"])


@query(
    """WITH g AS (SELECT m AS model, q AS quantization, s AS split FROM (VALUES ('alpha'), ('beta'), ('gamma')) a(m), (VALUES (NULL), ('float8'), ('int8'), ('int4')) b(q), (VALUES ('train'), ('val'), ('test')) c(s) WHERE NOT (m = 'gamma' AND q IS NULL)),
d AS (SELECT source, count(*) AS documents FROM documents GROUP BY source) SELECT source, documents, model, quantization, split FROM d, g"""
)
def io17_io18_job_grid(spark, sf):
    """All runs of each source as rows of one job; the largest model has no unquantized run."""
    runs = sampling.settings(model=("alpha", "beta", "gamma"), quantization=("none", "float8", "int8", "int4"), split=("train", "val", "test"))
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents")).select("source", "documents", F.inline(runs))
    return d.withColumn("quantization", F.nullif("quantization", F.lit("none"))).filter("not (model = 'gamma' and quantization is null)")
