"""Grouped reports (A1-A6, A19-A21), correlation (A7), labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import metrics, reports
from ..sources.io import table
from .registry import query
from .standins import LABELLED, labelled

_STATS = "count(*) AS sentences, count(target) AS valid, round(count(target) / count(*)::DOUBLE, 9) AS valid_share, coalesce(sum(target), 0)::BIGINT AS hallucinated, round(sum(target) / count(target)::DOUBLE, 9) AS rate"


@query(f"WITH {LABELLED} SELECT lang, {_STATS} FROM lab GROUP BY lang")
def a1_label_stats(spark, sf):
    return reports.label_stats(labelled(spark, sf), "lang")


@query(f"WITH {LABELLED} SELECT model, quantization, {_STATS} FROM lab GROUP BY model, quantization")
def a1_model_stats(spark, sf):
    return reports.label_stats(labelled(spark, sf), "model", "quantization")


_DIMS = ("chunk_size", "chunks_per_prompt", "template", "answerable")


def _rates(where: str = "") -> str:
    parts = [f"SELECT model, '{d}' AS dim, {d}::VARCHAR AS value, count(*) AS n, round(avg(target), 9) AS rate FROM lab WHERE target IS NOT NULL {where} GROUP BY model, {d}" for d in _DIMS]
    return f"WITH {LABELLED} " + " UNION ALL ".join(parts)


@query(_rates())
def a2_rates_by_dimension(spark, sf):
    return reports.rates_by(labelled(spark, sf), "model", _DIMS)


@query(f"WITH {LABELLED} SELECT model, template, round(avg(target) FILTER (WHERE answerable), 9) AS answerable_rate, round(avg(target) FILTER (WHERE NOT answerable), 9) AS unanswerable_rate FROM lab GROUP BY ALL")
def a3_rates_by_answerable(spark, sf):
    rate = lambda c: F.round(F.avg(F.when(c, F.col("target"))), 9)
    return labelled(spark, sf).groupBy("model", "template").agg(rate(F.col("answerable")).alias("answerable_rate"), rate(~F.col("answerable")).alias("unanswerable_rate"))


@query(f"WITH {LABELLED} SELECT answer_chunk_index, " + ", ".join(f"round(avg(target) FILTER (WHERE model = 'org/{m}'), 9) AS {m.split('-')[0]}" for m in ("alpha-7b", "beta-7b", "gamma-13b")) + " FROM lab WHERE chunks_per_prompt = 5 GROUP BY answer_chunk_index")
def a4_rates_by_answer_index(spark, sf):
    d = labelled(spark, sf).filter("chunks_per_prompt = 5").groupBy("answer_chunk_index").pivot("model", ["org/alpha-7b", "org/beta-7b", "org/gamma-13b"]).agg(F.round(F.avg("target"), 9))
    return d.toDF("answer_chunk_index", "alpha", "beta", "gamma")


@query(f"WITH {LABELLED} SELECT model, " + ", ".join(f"coalesce(sum((target IS NULL)::INT) FILTER (WHERE split = '{s}'), 0)::BIGINT AS {s}" for s in ("train", "val", "test")) + " FROM lab GROUP BY model")
def a5_invalid_matrix(spark, sf):
    d = labelled(spark, sf).groupBy("model").pivot("split", ["train", "val", "test"]).agg(F.sum(F.col("target").isNull().cast("int")))
    return d.fillna(0)


_COLS = ("quantization", "chunk_size", "template", "target")


@query(f"WITH {LABELLED} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM lab GROUP BY {c}""" for c in _COLS))
def a6_value_counts(spark, sf):
    return reports.value_counts(labelled(spark, sf), _COLS)


@query(f"WITH {LABELLED} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM lab WHERE {c} IS NOT NULL GROUP BY {c}""" for c in _COLS))
def a6_value_counts_without_null(spark, sf):
    return reports.value_counts(labelled(spark, sf), _COLS).filter("value is not null")


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, round(quantile_cont(n_chars, 0.25), 9) AS q25, round(quantile_cont(n_chars, 0.5), 9) AS q50, round(quantile_cont(n_chars, 0.75), 9) AS q75, max(n_chars)::DOUBLE AS max FROM documents GROUP BY lang")
def a19_describe_lengths(spark, sf):
    return reports.describe(table(spark, sf, "documents"), "n_chars", "lang")


@query(
    """WITH l AS (SELECT n_chars, (lang = 'en') AS long FROM documents), t AS (SELECT DISTINCT n_chars AS t FROM l),
x AS (SELECT t, count(*) FILTER (WHERE long AND n_chars >= t) AS above, count(*) FILTER (WHERE NOT long AND n_chars < t) AS below FROM t, l GROUP BY t)
SELECT t, above, below FROM x ORDER BY abs(above - below), t LIMIT 1"""
)
def a20_balanced_threshold(spark, sf):
    d = table(spark, sf, "documents")
    return reports.balanced_threshold(d.filter("lang <> 'en'"), d.filter("lang = 'en'"), "n_chars")


@query(f"WITH {LABELLED}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS n FROM lab GROUP BY {c}" for c in ("quantization", "answerable", "chunk_size", "target")) + "), s AS (SELECT c, (max(n) - min(n)) / sum(n)::DOUBLE AS d FROM v GROUP BY c) SELECT round(sum(d * d), 9) AS score FROM s")
def a21_imbalance(spark, sf):
    return reports.imbalance_score(labelled(spark, sf), ("quantization", "answerable", "chunk_size", "target"))


_HUMAN = "CASE WHEN id % 5 = 0 THEN 'IDK' WHEN id % 5 < 3 THEN 'R' WHEN id % 5 = 3 THEN 'W' END"
_HUMAN_SQL = f"(SELECT *, {_HUMAN} AS mark FROM lab)"
_TARGET_SQL = "CASE WHEN mark = 'W' THEN 1 WHEN mark = 'IDK' AND answerable THEN 1 WHEN mark = 'R' AND answerable THEN 0 WHEN mark = 'IDK' AND NOT answerable THEN 0 END"


@query(
    f"""WITH {LABELLED}, h AS (SELECT model, target AS prediction, {_TARGET_SQL} AS label FROM {_HUMAN_SQL}), f AS (SELECT * FROM h WHERE label IS NOT NULL AND prediction IS NOT NULL)
SELECT CASE WHEN grouping(model) = 1 THEN 'All' ELSE model END AS model, count(*) AS n, round(avg(label), 9) AS label_mean, round(avg(prediction), 9) AS prediction_mean,
round(avg((label = prediction)::INT), 9) AS accuracy, CASE WHEN isfinite(corr(label, prediction)) THEN round(corr(label, prediction), 6) END AS correlation FROM f GROUP BY ROLLUP (model)"""
)
def a7_benchmark_report(spark, sf):
    d = labelled(spark, sf).withColumn("mark", F.expr(_HUMAN))
    d = d.select("model", F.col("target").alias("prediction"), L.from_human(F.col("answerable"), F.col("mark")).alias("label"))
    return reports.correlation_report(d, "model")


_MATRIX = "sum((p = 1 AND y = 1)::INT)::DOUBLE AS tp, sum((p = 1 AND y = 0)::INT)::DOUBLE AS fp, sum((p = 0 AND y = 1)::INT)::DOUBLE AS fn, sum((p = 0 AND y = 0)::INT)::DOUBLE AS tn"
FORMULAS = """round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
round(CASE WHEN pe <> 1 THEN ((tp + tn) / (tp + fp + fn + tn) - pe) / (1 - pe) END, 9) AS kappa,
round(CASE WHEN sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) <> 0 THEN (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END, 9) AS mcc,
round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision_hallucinated, round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall_hallucinated,
round(CASE WHEN 2*tp + fp + fn <> 0 THEN 2*tp / (2*tp + fp + fn) ELSE 0 END, 9) AS f1_hallucinated,
round(CASE WHEN tn + fn <> 0 THEN tn / (tn + fn) ELSE 0 END, 9) AS precision_grounded, round(CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0 END, 9) AS recall_grounded,
round(CASE WHEN 2*tn + fn + fp <> 0 THEN 2*tn / (2*tn + fn + fp) ELSE 0 END, 9) AS f1_grounded"""
CHANCE = "((tp+fp)*(tp+fn) + (tn+fn)*(tn+fp)) / ((tp+fp+fn+tn)*(tp+fp+fn+tn)) AS pe"


@query(
    f"""WITH {LABELLED}, h AS (SELECT model, target AS p, {_TARGET_SQL} AS y FROM {_HUMAN_SQL}), m AS (SELECT model, {_MATRIX} FROM h WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY model), c AS (SELECT *, {CHANCE} FROM m)
SELECT model, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {FORMULAS} FROM c"""
)
def a8_a11_human_agreement(spark, sf):
    d = labelled(spark, sf).withColumn("mark", F.expr(_HUMAN))
    d = d.select("model", "target", L.from_human(F.col("answerable"), F.col("mark")).alias("y")).filter("target is not null and y is not null")
    return metrics.with_metrics(metrics.confusion(d, F.col("target"), F.col("y"), ["model"]))


_BITS = ("conflicting", "grounded", "has_factual_information", "no_clear_answer")


def _bit(i: int, name: str, div: str) -> str:
    return f"CASE WHEN event_id % 11 = {i} THEN NULL ELSE (event_id {div} {2**i}) % 2 = 1 END AS {name}"


_FAIL = "CASE WHEN event_id % 13 = 0 THEN true WHEN event_id % 13 = 1 THEN NULL ELSE false END"


@query(
    f"""WITH e AS (SELECT event_id, (event_id // 16) % 2 = 1 AS answerable, {_FAIL} AS fail, {", ".join(_bit(i, n, "//") for i, n in enumerate(_BITS))} FROM events)
SELECT event_id, CASE WHEN event_id % 17 = 0 OR coalesce(fail, false) OR conflicting IS NULL OR grounded IS NULL OR has_factual_information IS NULL OR no_clear_answer IS NULL
 OR (grounded AND has_factual_information AND no_clear_answer) THEN NULL WHEN conflicting THEN 1 WHEN has_factual_information AND grounded THEN CASE WHEN answerable THEN 0 END
 WHEN has_factual_information THEN 1 WHEN no_clear_answer THEN CASE WHEN answerable THEN 1 ELSE 0 END ELSE 0 END AS target FROM e"""
)
def l1_judgement_target(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "(event_id div 16) % 2 = 1 AS answerable", f"{_FAIL} AS fail", *[_bit(i, n, "div") for i, n in enumerate(_BITS)])
    fields = [F.col("fail").alias(L.FAILS[0]), *[F.lit(False).alias(f) for f in L.FAILS[1:]], *[F.col(b) for b in _BITS]]
    pred = F.when(F.col("event_id") % 17 != 0, F.struct(*fields))
    return e.withColumn("pred", pred).select("event_id", L.from_judgement(F.col("answerable"), F.col("pred")).alias("target"))


@query()
def l2_judgement_fields(spark, sf):
    """The judge's JSON per sentence, checked against the sentence and the chunk around it."""
    from ..functions.arrays import let
    from ..functions.sentences import sentences, start_of
    from ..functions.text import chunk, json_snippet

    around = lambda x: let(start_of(x, F.col("text")), lambda start: chunk(F.col("text"), start, start + F.length(x), F.length(x) + 100))
    own = F.transform(sentences(F.col("text")), lambda x: F.struct(x.alias("sentence"), around(x).alias("context")))  # in the document's row: a sentence's place is found once
    d = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(own).alias("sent_i", "x")).filter("sent_i is not null").select("doc_id", "sent_i", "x.*")
    part = "struct<section_content:string,necessary_chunk_quote:string,section_quote:string,result:boolean,has_factual_information:boolean>"
    section = f"struct<conflicting:{part},grounded:{part},cannot_really_answer:{part}>"
    one = F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("sentence")).otherwise(F.lit("another text")).alias("section_content"), F.substring("context", 11, 40).alias("necessary_chunk_quote"), F.substring("sentence", 5, 30).alias("section_quote"), (F.col("doc_id") % 3 == 0).alias("result"), F.lit(True).alias("has_factual_information"))
    reply = F.concat(F.lit("```json"), F.to_json(F.struct(one.alias("conflicting"), one.alias("grounded"), one.alias("cannot_really_answer"))), F.lit("```"))
    d = d.withColumn("section", F.from_json(json_snippet(reply), section))
    d = d.withColumn("pred", L.judgement(F.col("section"), F.col("sentence"), F.col("context")))
    return d.select("doc_id", "sent_i", "pred.*", L.from_judgement(F.col("doc_id") % 2 == 1, F.col("pred")).alias("target"))


@query(f"WITH {LABELLED} SELECT id, {_TARGET_SQL} AS label FROM {_HUMAN_SQL}")
def l3_human_target(spark, sf):
    return labelled(spark, sf).select("id", L.from_human(F.col("answerable"), F.expr(_HUMAN)).alias("label"))


_SIMPLE = r"regexp_replace(lower({x}), '[\s\p{{Z}}[:punct:]]', '', 'g')"


@query(
    rf"""WITH d AS (SELECT doc_id, text AS s, CASE WHEN doc_id % 7 <> 0 THEN [substr(text, 5, 20 + (doc_id % 3)::INT), CASE WHEN doc_id % 2 = 0 THEN substr(text, 3, 12) || '!?' ELSE 'not there at all' END] END AS q, ['INVENTED', 'WRONG'] AS kinds FROM documents),
m AS (SELECT doc_id, q, list_filter([1, 2], lambda i: contains({_SIMPLE.format(x="s")}, {_SIMPLE.format(x="CASE WHEN i = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'nowhere to be found' ELSE q[1] END ELSE q[2] END")})) AS hit FROM d)
SELECT doc_id, CASE WHEN q IS NULL THEN 'UNKNOWN' WHEN len(hit) = 0 THEN 'CORRECT' WHEN hit[1] = 1 THEN 'INVENTED' ELSE 'WRONG' END AS prediction,
CASE WHEN q IS NULL THEN NULL WHEN len(hit) = 0 THEN 0 ELSE 1 END AS positive FROM m"""
)
def l4_mistake_label(spark, sf):
    d = table(spark, sf, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("nowhere to be found")).otherwise(F.substring("text", F.lit(5), (20 + F.col("doc_id") % 3).cast("int")))
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring("text", 3, 12), F.lit("!?"))).otherwise(F.lit("not there at all"))
    mistakes = F.when(F.col("doc_id") % 7 != 0, F.array(F.struct(F.lit("INVENTED").alias("type"), first.alias("output_quote")), F.struct(F.lit("WRONG").alias("type"), second.alias("output_quote"))))
    d = d.select("doc_id", L.from_mistakes(F.col("text"), mistakes).alias("prediction"))
    return d.withColumn("positive", L.is_positive(F.col("prediction")))


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL ELSE doc_id % 2 = 1 END AS flag, doc_id % 4 AS n FROM documents)
SELECT doc_id, flag AS has_mistakes, n::INT AS mistakes, (coalesce(flag::INT, -1) <> n AND n > 0) AS contradictory FROM d"""
)
def l5_contradictory(spark, sf):
    """Whether a judge's flag fits the list that comes with it."""
    flag = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2 == 1)
    listed = F.array_repeat(F.lit("x"), (F.col("doc_id") % 4).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", flag.alias("has_mistakes"), listed.alias("l"))
    return d.select("doc_id", "has_mistakes", F.size("l").alias("mistakes"), L.contradictory(F.col("has_mistakes"), F.col("l")).alias("contradictory"))
