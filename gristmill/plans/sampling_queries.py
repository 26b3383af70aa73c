"""Assignment, splits, balancing, samples (G1-G15), filters (F3-F10), joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import md5_int, md5_sql
from ..operators import joins, models, sampling
from ..operators.ranking import first_per, rank_by_group
from ..sources.io import table
from .registry import query
from .standins import LABELLED, SCORED, labelled, scored
from .text_queries import SENTENCES, sentence_rows

_FACTORS = {"chunk_size": (350, 550, 750), "chunks_per_prompt": (1, 3, 5), "template": ("question_first", "context_first", "reminder"), "uglified": (False,)}
_FACTOR_SQL = "CASE i // 9 % 3 WHEN 0 THEN 350 WHEN 1 THEN 550 ELSE 750 END AS chunk_size, CASE i // 3 % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS chunks_per_prompt, CASE i % 3 WHEN 0 THEN 'question_first' WHEN 1 THEN 'context_first' ELSE 'reminder' END AS template, false AS uglified"


@query()
def g1_thin(spark, sf):
    """One document of each source, by its first word's use so far."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("cast(substring(source, 4) as int)").alias("article"), "text")
    return sampling.thin(d, "article", "text", "doc_id").select("article", "doc_id")


@query(f"SELECT o_orderkey, {_FACTOR_SQL} FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def g2_factorial(spark, sf):
    return sampling.factorial(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", _FACTORS)


@query(
    """SELECT doc_id, answerable, CASE WHEN answerable THEN (doc_id % 3)::INT END AS at, list_transform([0, 1, 2], lambda i: CASE WHEN answerable AND i = doc_id % 3 THEN 'answer ' || doc_id ELSE 'other ' || i END) AS chunks
FROM documents, (VALUES (false), (true)) a(answerable)"""
)
def g3_prompt_pairs(spark, sf):
    chunks = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.concat(F.lit("other "), i.cast("string")))
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("at"), chunks.alias("chunks"), F.concat(F.lit("answer "), F.col("doc_id").cast("string")).alias("answer"))
    return sampling.prompt_pairs(d, "chunks", "answer", "at").select("doc_id", "answerable", "at", "chunks")


_SPLITS = {"train": 756, "val": 162, "test": 162}


@query("SELECT o_orderkey, CASE WHEN i < 756 THEN 'train' WHEN i < 918 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 1080")
def g4_contiguous_split(spark, sf):
    return sampling.contiguous_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", _SPLITS)


@query(
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT source, n, sum(n) OVER (ORDER BY source) AS z, sum(n) OVER () AS t FROM c),
b AS (SELECT max(z - n) FILTER (WHERE z - n <= floor(t * 0.7::DOUBLE) AND floor(t * 0.7::DOUBLE) < z) AS b1, max(z - n) FILTER (WHERE z - n <= floor(t * 0.85::DOUBLE) AND floor(t * 0.85::DOUBLE) < z) AS b2 FROM e)
SELECT doc_id, source, CASE WHEN z - e.n < b1 THEN 'train' WHEN z - e.n < b2 THEN 'val' ELSE 'test' END AS split FROM documents JOIN e USING (source), b"""
)
def g5_group_split(spark, sf):
    return sampling.group_split(table(spark, sf, "documents").select("doc_id", "source"), "source")


@query(f"WITH {LABELLED}, k AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY id) AS k FROM lab WHERE target IS NOT NULL), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM k GROUP BY target)) SELECT id, target FROM k, m WHERE k <= m")
def g6_undersample(spark, sf):
    return sampling.undersample(labelled(spark, sf).filter("target is not null").select("id", "target"), "target", ["id"])


@query(
    f"""WITH {LABELLED}, k AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY id) AS k, count(*) OVER (PARTITION BY target) AS n FROM lab WHERE target IS NOT NULL), m AS (SELECT max(n) AS m FROM k)
SELECT id, target, unnest(range((m // n + (k <= m % n)::INT)::BIGINT))::INT AS copy FROM k, m"""
)
def g7_oversample(spark, sf):
    return sampling.oversample(labelled(spark, sf).filter("target is not null").select("id", "target"), "target", ["id"]).select("id", "target", "copy")


@query()
def g8_multi_oversample(spark, sf):
    """Copies per trait combination until the traits are balanced."""
    cols = ["quantization", "answerable", "chunk_size", "chunks_per_prompt", "template", "target"]
    d = labelled(spark, sf).filter("target is not null").select("id", *cols)
    return sampling.multi_oversample(d, cols, "id")


@query()
def g9_clustered_undersample(spark, sf):
    d = labelled(spark, sf).filter("target is not null").select("id", "quantization", "chunk_size", "template", "target")
    return sampling.clustered_undersample(d, ["quantization", "chunk_size", "template"], "target", "id").select("id", "cluster", "target")


@query(f"WITH {LABELLED} SELECT id, target FROM lab WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY {md5_sql('id', chr(39) + '432' + chr(39))}, id) <= 25")
def g11_stratified_sample(spark, sf):
    return sampling.stratified(labelled(spark, sf).filter("target is not null").select("id", "target"), ["target"], 25, "id", "432")


@query(
    f"""WITH {SCORED}, a AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) AS i FROM scored), b AS (SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY {md5_sql('id', chr(39) + '432' + chr(39))}, id) AS i FROM scored)
SELECT id, split, y FROM a JOIN b USING (split, i)"""
)
def g12_permuted_labels(spark, sf):
    return sampling.permute_labels(scored(spark, sf).select("id", "split", "y"), "id", "y", ["split"], "432").select("id", "split", "y")


@query("WITH s AS (SELECT doc_id FROM documents WHERE lang = 'fr'), l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang = 'en') SELECT doc_id FROM s UNION ALL SELECT doc_id FROM l WHERE k <= (SELECT count(*) FROM s)")
def g13_length_matched(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.length_matched(d.filter("lang = 'fr'").select("doc_id"), d.filter("lang = 'en'").select("doc_id"), "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 50")
def g14_g15_limit(spark, sf):
    """The first 50 in a pinned order (a top-k report)."""
    return table(spark, sf, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(50)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 1000 AND text IS NOT NULL")
def f3_predicates(spark, sf):
    return table(spark, sf, "documents").filter(F.col("lang").isin("de", "fr") & (F.col("n_chars") >= 1000) & F.col("text").isNotNull()).select("doc_id", "lang")


@query(f"WITH {LABELLED} SELECT id, target FROM lab WHERE target IS NOT NULL AND NOT (split = 'train' AND template = 'reminder')")
def f4_f5_valid_rows(spark, sf):
    """Without invalid labels, and with a caller's predicate on (split, traits)."""
    ignore = (F.col("split") == "train") & (F.col("template") == "reminder")
    return labelled(spark, sf).filter(F.col("target").isNotNull() & ~ignore).select("id", "target")


@query(f"WITH {LABELLED} SELECT id, split FROM lab WHERE split = 'test' OR quantization IS DISTINCT FROM 'int4'")
def f6_leave_one_out(spark, sf):
    return models.leave_out(labelled(spark, sf), "split", F.col("quantization"), "int4").select("id", "split")


_LEVELS = [("chunk_size", str(v)) for v in (350, 550, 750)] + [("chunks_per_prompt", str(v)) for v in (1, 3, 5)] + [("template", v) for v in ("context_first", "question_first", "reminder")] + [("answerable", v) for v in ("true", "false")]


@query(f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{c}' AS factor, '{v}' AS level, split, count(*) AS n, count(target) AS valid FROM lab WHERE split = 'test' OR {c}::VARCHAR IS DISTINCT FROM '{v}' GROUP BY split" for c, v in _LEVELS))
def f6_robustness_grid(spark, sf):
    """All configurations that leave one level out, in one pass: a row is exploded to the configurations that keep it."""
    levels = F.array(*[F.struct(F.lit(c).alias("factor"), F.lit(v).alias("level"), F.col(c).cast("string").alias("own")) for c, v in _LEVELS])
    d = labelled(spark, sf).select("split", "target", F.explode(F.filter(levels, lambda x: (F.col("split") == "test") | ~x["own"].eqNullSafe(x["level"]))).alias("x"))
    return d.groupBy("x.factor", "x.level", "split").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("valid"))


@query("SELECT doc_id, CASE WHEN length(text) >= 3112 THEN 'long' WHEN length(text) + length(last) < 3112 THEN 'short' END AS bucket FROM (SELECT doc_id, text, regexp_extract(text, '([^\n]*)$', 1) AS last FROM documents)")
def f7_length_buckets(spark, sf):
    d = models.by_length(table(spark, sf, "documents"), F.col("text"), F.substring_index("text", "\n", -1))
    return d.select("doc_id", "bucket")


@query("SELECT id, prediction FROM (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'WRONG' ELSE 'CORRECT' END AS prediction FROM events) WHERE prediction <> 'UNKNOWN'")
def f9_without_unknown(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS id", "CASE event_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'WRONG' ELSE 'CORRECT' END AS prediction")
    return e.filter("prediction <> 'UNKNOWN'")


@query("WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS answerable FROM documents), m AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM d) SELECT doc_id, answerable FROM d, m WHERE NOT (doc_id = lo AND answerable) AND NOT (doc_id = hi AND NOT answerable)")
def f10_trim_parity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("answerable"))
    return sampling.trim_parity(d, "doc_id")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j1_lookup_join(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    d = joins.responses_with_sources(l, o, "o_orderkey", F.col("o_orderstatus") == "F")
    return d.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j2_semi_join(spark, sf):
    keys = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.only_known(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), keys, "o_orderkey")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def j3_j4_common_keys(spark, sf):
    """Keys that all members (models, files) have."""
    return joins.common_keys(table(spark, sf, "events"), "user_id", "event_type")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS art FROM documents), q AS (SELECT event_id, event_id % (SELECT count(*) FROM a) AS art FROM events) SELECT event_id, art, doc_id FROM q JOIN a USING (art)")
def j5_positional_join(spark, sf):
    """Positions as a key made once over a stable order, then an equi-join."""
    a = rank_by_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", "art").select("art", "doc_id")
    n = a.agg(F.count(F.lit(1)).alias("n"))
    q = table(spark, sf, "events").select("event_id").crossJoin(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("art"))
    return q.join(a, "art").select("event_id", "art", "doc_id")


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), w AS (SELECT r.doc_id AS k, r.source AS s, d, {md5_sql('r.doc_id', 'd', chr(39) + 'others' + chr(39))} % n AS i FROM r, range(1, 17) g(d)),
m AS (SELECT k, r.doc_id AS other, min(d) AS d FROM w JOIN r USING (i) WHERE w.s <> r.source GROUP BY ALL) SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY d, other) - 1)::INT AS j, other FROM m QUALIFY j < 3"""
)
def j6_other_passages(spark, sf):
    """Three documents of other sources for each document."""
    return joins.other_passages(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 3, "others", draws=16)


@query(f"WITH {SENTENCES} SELECT doc_id, sent_i FROM sen WHERE sentence IN (SELECT sentence FROM sen WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
def j8_trimmed_exists(spark, sf):
    """Sentences that occur in documents of good quality, white space around them aside."""
    d = sentence_rows(spark, sf).select("doc_id", "sent_i", "sentence")
    known = joins.only_known(d, table(spark, sf, "labels").filter("quality = 1"), "doc_id").select(F.concat(F.lit("  "), F.col("sentence"), F.lit("\n")).alias("sentence"))
    return joins.trimmed_exists(d, known, "sentence").select("doc_id", "sent_i")


@query("SELECT doc_id, source, size, k, template FROM documents, (VALUES (350), (550), (750)) a(size), (VALUES (1), (3), (5)) b(k), (VALUES ('question_first'), ('context_first'), ('reminder')) c(template)")
def j9_parameter_grid(spark, sf):
    """Every document with each of the 27 settings: the grid is an array in its row."""
    settings = sampling.settings(size=(350, 550, 750), k=(1, 3, 5), template=("question_first", "context_first", "reminder"))
    return table(spark, sf, "documents").select("doc_id", "source", F.inline(settings))


@query("SELECT doc_id AS id, 'd' AS kind FROM documents UNION ALL SELECT page_id, 'p' FROM pages UNION ALL SELECT item_id, 'b' FROM benchmark")
def u1_u2_union_all(spark, sf):
    one = lambda t, c, k: table(spark, sf, t).select(F.col(c).alias("id"), F.lit(k).alias("kind"))
    return joins.union_all(one("documents", "doc_id", "d"), one("pages", "page_id", "p"), one("benchmark", "item_id", "b"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def u3_distinct_keep_first(spark, sf):
    return first_per(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT doc_id, list_transform([1, 2, 3, 4], lambda i: CASE WHEN i = doc_id % 4 + 1 THEN -1 ELSE i END) AS chunks FROM documents")
def u4_replace_at(spark, sf):
    chunks = F.array(*map(F.lit, (1, 2, 3, 4)))
    return table(spark, sf, "documents").select("doc_id", F.transform(chunks, lambda c, i: F.when(i == F.col("doc_id") % 4, F.lit(-1)).otherwise(c)).alias("chunks"))


@query(f"WITH {LABELLED} SELECT id, split, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS corpus, CASE WHEN id % 2 = 0 AND split <> 'test' THEN 'fit' WHEN id % 2 = 1 AND split = 'test' THEN 'apply' END AS role FROM lab WHERE (id % 2 = 0 AND split <> 'test') OR (id % 2 = 1 AND split = 'test')")
def v15_transfer_sets(spark, sf):
    """Fit on one corpus, test on the other."""
    d = labelled(spark, sf).withColumn("corpus", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    role = F.when((F.col("corpus") == "a") & (F.col("split") != "test"), "fit").when((F.col("corpus") == "b") & (F.col("split") == "test"), "apply")
    return d.select("id", "split", "corpus", role.alias("role")).filter("role is not null")


_COMBOS = [("short", "short"), ("short", "long"), ("long", "long"), ("long", "short"), ("both", "short"), ("both", "long"), ("both", "both")]


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN n_chars >= 3112 THEN 'long' ELSE 'short' END AS b, doc_id % 5 = 0 AS test FROM documents) "
    + " UNION ALL ".join(f"SELECT '{a}' AS train_on, '{b}' AS test_on, count(*) FILTER (WHERE NOT test AND b IN ({a_in})) AS train_rows, count(*) FILTER (WHERE test AND b IN ({b_in})) AS test_rows FROM d" for a, b, a_in, b_in in [(a, b, *["'short', 'long'" if x == "both" else f"'{x}'" for x in (a, b)]) for a, b in _COMBOS])
)
def v16_length_combinations(spark, sf):
    """Seven pairs of training and test lengths, counted in one pass."""
    d = table(spark, sf, "documents").select(F.when(F.col("n_chars") >= 3112, "long").otherwise("short").alias("b"), (F.col("doc_id") % 5 == 0).alias("test"))
    c = d.groupBy("b", "test").agg(F.count(F.lit(1)).alias("n"))
    combos = spark.createDataFrame(_COMBOS, ["train_on", "test_on"])
    within = lambda x: (F.col(x) == "both") | (F.col(x) == F.col("b"))
    j = combos.crossJoin(F.broadcast(c))  # four rows
    return j.groupBy("train_on", "test_on").agg(F.sum(F.when(within("train_on") & ~F.col("test"), F.col("n")).otherwise(0)).alias("train_rows"), F.sum(F.when(within("test_on") & F.col("test"), F.col("n")).otherwise(0)).alias("test_rows"))
