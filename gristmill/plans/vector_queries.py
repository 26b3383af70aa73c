"""Vectors and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.keys import md5_int, md5_sql
from ..operators import metrics, models
from ..sources.io import table
from .registry import query

_E = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("SELECT vec_id, len(c) AS n, round(c[1]::DOUBLE, 6) AS first, round(c[-1]::DOUBLE, 6) AS last FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS c FROM embeddings)")
def v1_concat_states(spark, sf):
    e = table(spark, sf, "embeddings")
    c = V.concat_states(F.col("embedding"), F.slice("embedding", 1, 8))
    return e.select("vec_id", c.alias("c")).select("vec_id", F.size("c").alias("n"), F.round(F.get("c", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.element_at("c", -1).cast("double"), 6).alias("last"))


#: Sixteen layers of four numbers each, cut from an embedding of 64.
_LAYERS = "list_transform(range(16), lambda i: embedding[(i * 4 + 1):(i * 4 + 4)])"


def _layers(spark, sf):
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    return table(spark, sf, "embeddings").select("vec_id", cut.alias("layers"))


@query(f"SELECT vec_id, round(l[8][1]::DOUBLE, 6) AS half, round(l[16][4]::DOUBLE, 6) AS full_depth FROM (SELECT vec_id, {_LAYERS} AS l FROM embeddings)")
def v2_layer_pick(spark, sf):
    d = _layers(spark, sf)
    return d.select("vec_id", F.round(F.get(V.layer_at(F.col("layers"), 0.5), F.lit(0)).cast("double"), 6).alias("half"), F.round(F.get(V.layer_at(F.col("layers"), 1.0), F.lit(3)).cast("double"), 6).alias("full_depth"))


@query(f"SELECT vec_id, list_transform([1, 2, 3, 4], lambda k: round(list_sum(list_transform(l[7:10], lambda v: v[k]::DOUBLE)) / 3, 6)) AS mean FROM (SELECT vec_id, {_LAYERS} AS l FROM embeddings)")
def v3_layer_mean(spark, sf):
    """Layers 6 to 9 over 3, the difference of the bounds."""
    d = _layers(spark, sf)
    return d.select("vec_id", F.transform(V.layers_mean(F.col("layers"), 0.4, 0.6, 4), lambda x: F.round(x, 6)).alias("mean"))


@query(
    f"""WITH l AS (SELECT vec_id, label, {_E} AS x FROM embeddings), s AS (SELECT vec_id, label, list_transform(x, lambda v: exp(v - list_max(x))) AS p FROM l), q AS (SELECT vec_id, label, list_transform(p, lambda v: v / list_sum(p)) AS p FROM s)
SELECT vec_id, round(p[label + 1], 9) AS probability, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) AS entropy FROM q"""
)
def a22_token_probability(spark, sf):
    """A token's probability and the distribution's entropy from logits."""
    d = table(spark, sf, "embeddings").select("vec_id", "label", V.softmax(F.col("embedding")).alias("p"))
    return d.select("vec_id", F.round(F.get("p", F.col("label")), 9).alias("probability"), F.round(V.entropy(F.col("p")), 6).alias("entropy"))


@query("SELECT model, max(tokens) AS most FROM (SELECT user_id % 5 AS model, length(props) AS tokens, value > 20 AS fits FROM events) WHERE fits GROUP BY model")
def a23_largest_fit(spark, sf):
    """The largest size that fits, from a table of trials; ``models.largest_fit`` is the search itself, on a device of the caller's."""
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("model"), F.length("props").alias("tokens"), (F.col("value") > 20).alias("fits"))
    return e.filter("fits").groupBy("model").agg(F.max("tokens").alias("most"))


@query(
    """WITH m AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system')
SELECT conv_id, (k - 1)::INT AS i, role, CASE WHEN k = 1 AND s IS NOT NULL AND s <> '' THEN s || chr(10) || chr(10) || text ELSE text END AS content FROM r JOIN m USING (conv_id)"""
)
def v5_fold_system(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    folded = X.fold_system(F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return d.select("conv_id", F.posexplode(folded).alias("i", "m")).select("conv_id", "i", "m.role", "m.content")


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    split = F.expr("CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END")
    return e.select("vec_id", F.col("embedding").alias("features"), (F.col("label") >= 5).cast("int").alias("y"), split.alias("split"))


def _trained(spark, sf, runs: int):
    """The models of the runs, in a written table, and all rows. A step takes all training rows, so its rate is larger than that for 32 rows."""
    from ..sources.io import work_folder

    d = _vectors(spark, sf)
    path = work_folder(spark, "models")
    models.train(d.filter("split = 'train'"), d.filter("split = 'val'"), "vec_id", runs=runs, epochs=40, rate=1e-3).write.parquet(path)
    return spark.read.parquet(path), d


def _evaluated(scores):
    """Thresholds from the training rows, metrics of all splits."""
    best = metrics.best_thresholds(metrics.sweep(scores.filter("split = 'train'"), ["run"]), ["run"])
    return metrics.at_thresholds(scores, best, ["run", "split"], ["run"])


@query()
def v6_v9_perceptron(spark, sf):
    """Train on vectors until the validation loss stops falling, thresholds from train, metrics on all splits."""
    return _evaluated(models.predict(*_trained(spark, sf, 1)))


@query()
def v8_validation(spark, sf):
    """Epochs, validation loss and accuracy of a training."""
    return _trained(spark, sf, 1)[0].select("run", "epochs", F.round("val_loss", 6).alias("val_loss"), F.round("val_accuracy", 6).alias("val_accuracy"))


@query()
def v14_repeated_runs(spark, sf):
    """Ten trainings with seeds of their own, side by side, and their metrics."""
    return _evaluated(models.predict(*_trained(spark, sf, 10)))


@query()
def v12_saved_model(spark, sf):
    """A model saved to the shared folder and loaded again: its scores."""
    return models.predict(*_trained(spark, sf, 1)).select("vec_id", F.round("score", 9).alias("score"))


@query(f"SELECT vec_id, {md5_sql('vec_id', "'seed-432'")} AS draw, ({md5_sql('vec_id', "'seed-432'")} / 4294967296.0::DOUBLE < 0.7::DOUBLE) AS train FROM embeddings")
def v17_seeded_draws(spark, sf):
    """A row's draw depends on its key and the seed alone, not on order, partitions or engine."""
    draw = md5_int("vec_id", F.lit("seed-432"))
    return table(spark, sf, "embeddings").select("vec_id", draw.alias("draw"), (draw / F.lit(4294967296.0) < 0.7).alias("train"))
