"""Threshold sweeps, curves, losses and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import md5_int, md5_sql
from ..operators import metrics
from .label_queries import CHANCE, FORMULAS
from .registry import query
from .standins import SCORED, scored

_GRID = "th AS (SELECT k / 100.0::DOUBLE AS threshold FROM range(101) r(k))"
_M = "sum((score > threshold AND y = 1)::INT)::DOUBLE AS tp, sum((score > threshold AND y = 0)::INT)::DOUBLE AS fp, sum((NOT score > threshold AND y = 1)::INT)::DOUBLE AS fn, sum((NOT score > threshold AND y = 0)::INT)::DOUBLE AS tn"
_SWEEP = f"{_GRID}, m AS (SELECT grp, threshold, {_M} FROM scored, th {{where}} GROUP BY grp, threshold), c AS (SELECT *, {CHANCE} FROM m), sw AS (SELECT grp, threshold, tp, fp, fn, tn, {FORMULAS} FROM c)"


@query(f"WITH {SCORED}, {_SWEEP.format(where='')} SELECT grp, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, accuracy, kappa, mcc, precision_hallucinated, recall_hallucinated, f1_hallucinated, precision_grounded, recall_grounded, f1_grounded FROM sw")
def j10_threshold_sweep(spark, sf):
    return metrics.sweep(scored(spark, sf), ["grp"])


_BEST = ", ".join(f"arg_max(threshold, (coalesce({m}, -2), threshold)) AS {m}_threshold" for m in metrics.SWEPT)


@query(f"WITH {SCORED}, {_SWEEP.format(where='')} SELECT grp, {_BEST} FROM sw GROUP BY grp")
def a14_best_thresholds(spark, sf):
    return metrics.best_thresholds(metrics.sweep(scored(spark, sf), ["grp"]), ["grp"])


def _at(where: str, metric: str, columns: str) -> str:
    m = _M.replace("threshold", f"{metric}_threshold")
    return f"SELECT grp, split, {columns} FROM (SELECT *, {CHANCE} FROM (SELECT grp, split, {m} FROM scored JOIN best USING (grp) GROUP BY grp, split))"


def _formula(name: str) -> str:
    return next(line.strip() for line in FORMULAS.replace("\n", " ").replace(", round(", "\nround(").split("\n") if line.strip().rstrip(",").endswith(f"AS {name}")).rstrip(",")


_TRANSFER = (
    f"WITH {SCORED}, {_SWEEP.format(where=chr(39).join(['WHERE split = ', 'train', '']))}, best AS (SELECT grp, {_BEST} FROM sw GROUP BY grp), "
    + ", ".join(f"x{i} AS ({_at('', m, _formula(m))})" for i, m in enumerate(metrics.SWEPT))
    + f", z AS ({_at('', 'accuracy', ', '.join(map(_formula, ('precision_hallucinated', 'recall_hallucinated', 'precision_grounded', 'recall_grounded'))) + ', tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn')})"
    + " SELECT * FROM x0 JOIN x1 USING (grp, split) JOIN x2 USING (grp, split) JOIN x3 USING (grp, split) JOIN x4 USING (grp, split) JOIN z USING (grp, split)"
)


@query(_TRANSFER)
def v11_threshold_transfer(spark, sf):
    """Thresholds found on train, metrics on every split."""
    d = scored(spark, sf)
    best = metrics.best_thresholds(metrics.sweep(d.filter("split = 'train'"), ["grp"]), ["grp"])
    return metrics.at_thresholds(d, best, ["grp", "split"], ["grp"])


def _areas(y: str) -> str:
    return f"""c AS (SELECT grp, score, sum({y}) AS p, sum(1 - {y}) AS n FROM scored GROUP BY ALL),
k AS (SELECT grp, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS pos, sum(n) OVER (PARTITION BY grp) AS neg FROM c WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
r AS (SELECT grp, score, tp / pos::DOUBLE AS r, fp / neg::DOUBLE AS f, tp / (tp + fp)::DOUBLE AS p FROM k),
s AS (SELECT *, lag(r, 1, 0.0::DOUBLE) OVER w AS r0, lag(f, 1, 0.0::DOUBLE) OVER w AS f0, lag(p, 1, 1.0::DOUBLE) OVER w AS p0 FROM r WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
SELECT grp, round(sum((f - f0) * (r + r0) / 2), 9) AS roc_auc, round(sum((r - r0) * (p + p0) / 2), 9) AS pr_auc FROM s GROUP BY grp"""


@query(f"WITH {SCORED}, {_areas('y')}")
def a12_a13_areas(spark, sf):
    return metrics.areas(scored(spark, sf), ["grp"])


@query(f"WITH {SCORED}, {_areas('(1 - y)')}")
def a12_a13_areas_grounded(spark, sf):
    """Of the grounded class with the score as it is: roc_auc is one less that of the other class."""
    return metrics.areas(scored(spark, sf), ["grp"], positive=0)


@query(
    f"""WITH {SCORED}, c AS (SELECT grp, score, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY ALL)
SELECT grp, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS pos, sum(n) OVER (PARTITION BY grp) AS neg FROM c WINDOW w AS (PARTITION BY grp ORDER BY score DESC)"""
)
def a12_curve_points(spark, sf):
    return metrics.curve(scored(spark, sf), ["grp"])


@query(f"WITH {SCORED} SELECT grp, split, round(avg(-(y * CASE WHEN score > 0 THEN greatest(ln(score), -100) ELSE -100 END + (1 - y) * CASE WHEN 1 - score > 0 THEN greatest(ln(1 - score), -100) ELSE -100 END)), 9) AS loss FROM scored GROUP BY ALL")
def a15_log_loss(spark, sf):
    return scored(spark, sf).groupBy("grp", "split").agg(F.round(metrics.log_loss(F.col("score"), F.col("y")), 9).alias("loss"))


_RUNS = f"runs AS (SELECT grp, run, avg((CASE WHEN score > 0.2 + 0.06 * run THEN 1 ELSE 0 END = y)::INT) AS value FROM scored, range(10) r(run) GROUP BY grp, run)"


def _runs(spark, sf):
    d = scored(spark, sf).crossJoin(F.broadcast(spark.range(10).withColumnRenamed("id", "run")))
    hit = ((F.col("score") > 0.2 + 0.06 * F.col("run")).cast("int") == F.col("y")).cast("int")
    return d.groupBy("grp", "run").agg(F.avg(hit).alias("value"))


@query(f"WITH {SCORED}, {_RUNS} SELECT grp, round(avg(value) * 100, 2) AS mean, round(stddev_pop(value) * 100, 2) AS std FROM runs GROUP BY grp")
def a16_run_summary(spark, sf):
    """Ten runs a configuration, then their mean and deviation."""
    return metrics.run_summary(_runs(spark, sf), ["grp"])


_SHARES = "(SELECT grp, run, " + ", ".join(f"sum((({p}) AND y = {y})::INT) / count(*)::DOUBLE AS {n}" for n, p, y in (("tp", "score > 0.2 + 0.06 * run", 1), ("fp", "score > 0.2 + 0.06 * run", 0), ("fn", "NOT score > 0.2 + 0.06 * run", 1), ("tn", "NOT score > 0.2 + 0.06 * run", 0))) + " FROM scored, range(10) r(run) GROUP BY grp, run)"


@query(f"WITH {SCORED}, s AS {_SHARES}, u AS (" + " UNION ALL ".join(f"SELECT grp, '{c}' AS cell, {c} AS value FROM s" for c in ("tp", "fp", "fn", "tn")) + ") SELECT grp, cell, round(avg(value) * 100, 2) AS mean, round(stddev_pop(value) * 100, 2) AS std FROM u GROUP BY ALL")
def a17_matrix_summary(spark, sf):
    """Confusion matrices normalised per run, then their mean and deviation."""
    d = scored(spark, sf).crossJoin(F.broadcast(spark.range(10).withColumnRenamed("id", "run")))
    m = metrics.confusion(d, (F.col("score") > 0.2 + 0.06 * F.col("run")).cast("int"), F.col("y"), ["grp", "run"])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    long = m.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), (F.col(c) / n).alias("value")) for c in ("tp", "fp", "fn", "tn")])).alias("x")).select("grp", "x.*")
    return metrics.run_summary(long, ["grp", "cell"])


@query(f"WITH {SCORED}, q AS (SELECT grp, CASE id % 3 WHEN 0 THEN 'float8' WHEN 1 THEN 'int4' ELSE 'none' END AS quantization, (CASE WHEN score > 0.5 THEN 1 ELSE 0 END = y)::INT AS hit FROM scored) SELECT grp, " + ", ".join(f"round(avg(hit) FILTER (WHERE quantization = '{x}') * 100, 2) AS {y}" for x, y in (("none", "none"), ("float8", "float8"), ("int4", "int4"))) + " FROM q GROUP BY grp")
def a18_result_matrix(spark, sf):
    q = F.expr("CASE id % 3 WHEN 0 THEN 'float8' WHEN 1 THEN 'int4' ELSE 'none' END")
    hit = ((F.col("score") > 0.5).cast("int") == F.col("y")).cast("int")
    return (
        scored(spark, sf).select("grp", q.alias("q"), hit.alias("hit")).groupBy("grp").pivot("q", ["none", "float8", "int4"]).agg(F.round(F.avg("hit") * 100, 2))
    )


_RANDOM = f"scored2 AS (SELECT id, split, grp, y, {md5_sql('id', chr(39) + 'noise' + chr(39))} / 4294967296.0::DOUBLE AS score FROM scored)"


@query(f"WITH {SCORED}, {_RANDOM}, m AS (SELECT grp, {_M.replace('threshold', '0.5')} FROM scored2 GROUP BY grp), c AS (SELECT *, {CHANCE} FROM m) SELECT grp, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {FORMULAS} FROM c")
def v10_random_baseline(spark, sf):
    """Uniform noise as score, all thresholds at 0.5."""
    d = scored(spark, sf).withColumn("score", md5_int("id", F.lit("noise")) / F.lit(4294967296.0))
    return metrics.with_metrics(metrics.confusion(d, (F.col("score") > 0.5).cast("int"), F.col("y"), ["grp"]))
