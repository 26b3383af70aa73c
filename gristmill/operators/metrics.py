"""Classifier metrics as aggregates over scored rows (score in [0, 1], y 0 or 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_sums

STEPS = 101
SWEPT = ("accuracy", "kappa", "mcc", "f1_hallucinated", "f1_grounded")


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def formulas(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of a confusion matrix; counts are doubles."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    agreed = (tp + tn) / n
    return {
        "accuracy": agreed,
        "kappa": F.when(chance != 1, (agreed - chance) / (1 - chance)),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "precision_hallucinated": _ratio(tp, tp + fp),
        "recall_hallucinated": _ratio(tp, tp + fn),
        "f1_hallucinated": _ratio(2 * tp, 2 * tp + fp + fn),
        "precision_grounded": _ratio(tn, tn + fn),
        "recall_grounded": _ratio(tn, tn + fp),
        "f1_grounded": _ratio(2 * tn, 2 * tn + fn + fp),
    }


def confusion(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    one = lambda p, y: F.sum(F.when((predicted == p) & (actual == y), 1).otherwise(0))
    return df.groupBy(*by).agg(one(1, 1).alias("tp"), one(1, 0).alias("fp"), one(0, 1).alias("fn"), one(0, 0).alias("tn"))


def with_metrics(matrix: DataFrame, digits: int = 9) -> DataFrame:
    found = formulas(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return matrix.select("*", *[F.round(c, digits).alias(n) for n, c in found.items()])


def sweep(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics at thresholds k / 100 (prediction: score > threshold): one pass into 102 bins, then running sums over the bins."""
    k = F.ceil(F.col("score") * 100).cast("int")
    k = F.when(F.col("score") > k / F.lit(100.0), k + 1).when(F.col("score") <= (k - 1) / F.lit(100.0), k - 1).otherwise(k)
    bins = scored.withColumn("k", F.greatest(F.lit(0), F.least(F.lit(STEPS), k)))  # above thresholds 0 to k - 1
    counts = bins.groupBy(*by, "k").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    every = counts.select(*by).distinct().crossJoin(F.broadcast(scored.sparkSession.range(STEPS + 1).select(F.col("id").cast("int").alias("k"))))
    full = every.join(counts, [*by, "k"], "left").fillna(0, ["p", "n"])
    above = Window.partitionBy(*by).orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    total = Window.partitionBy(*by)
    d = full.select(*by, "k", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("fp"), F.sum("p").over(total).alias("_p"), F.sum("n").over(total).alias("_n"))
    d = d.filter(F.col("k") < STEPS).select(*by, (F.col("k") / F.lit(100.0)).alias("threshold"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))
    return with_metrics(d)


def best_thresholds(swept: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each metric the threshold where it is greatest, the largest of equals."""
    return swept.groupBy(*by).agg(*[F.max_by("threshold", F.struct(F.coalesce(F.col(m), F.lit(-2.0)), "threshold")).alias(f"{m}_threshold") for m in SWEPT])


def at_thresholds(scored: DataFrame, thresholds: DataFrame, by: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Metrics each at its own threshold, precision, recall and the matrix at that of accuracy; thresholds may come from another split."""
    d = scored.join(F.broadcast(thresholds), list(on)) if on else scored.crossJoin(F.broadcast(thresholds))  # a row a group
    sums = []
    for m in SWEPT:
        hit = F.col("score") > F.col(f"{m}_threshold")
        for name, test in (("tp", hit & (F.col("y") == 1)), ("fp", hit & (F.col("y") == 0)), ("fn", ~hit & (F.col("y") == 1)), ("tn", ~hit & (F.col("y") == 0))):
            sums.append(F.sum(test.cast("int")).alias(f"_{m}_{name}"))
    d = d.groupBy(*by).agg(*sums)
    found = {m: formulas(*[F.col(f"_{m}_{c}") for c in ("tp", "fp", "fn", "tn")]) for m in SWEPT}
    out = [F.round(found[m][m], 9).alias(m) for m in SWEPT]
    out += [F.round(found["accuracy"][m], 9).alias(m) for m in ("precision_hallucinated", "recall_hallucinated", "precision_grounded", "recall_grounded")]
    return d.select(*by, *out, *[F.col(f"_accuracy_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")])


def curve(scored: DataFrame, by: Sequence[str], positive: int = 1) -> DataFrame:
    """Points of the ROC and precision-recall curves, one a distinct score, from the highest down: p and n at the score, tp and fp from it up."""
    good = (F.col("y") == positive).cast("long")
    points = scored.groupBy(*by, "score").agg(F.sum(good).alias("p"), F.sum(1 - good).alias("n"))
    totals = points.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))  # a row a group
    d = running_sums(points, -F.col("score"), [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}, by)
    return d.join(totals, list(by)).select(*by, "score", "p", "n", "tp", "fp", "pos", "neg")


def areas(scored: DataFrame, by: Sequence[str], positive: int = 1) -> DataFrame:
    """roc_auc and pr_auc, both by trapezoids; pr starts at recall 0 with precision 1."""
    tp, fp, tp0, fp0 = F.col("tp"), F.col("fp"), F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    first = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0))).otherwise(F.lit(1.0))
    return curve(scored, by, positive).groupBy(*by).agg(
        F.round(F.sum((fp - fp0) / F.col("neg") * (tp + tp0) / F.col("pos") / 2), 9).alias("roc_auc"),
        F.round(F.sum((tp - tp0) / F.col("pos") * (tp / (tp + fp) + first) / 2), 9).alias("pr_auc"),
    )


def log_loss(score: Column, y: Column) -> Column:
    """Mean binary cross entropy with logarithms held at -100 and above."""
    log = lambda x: F.when(x > 0, F.greatest(F.ln(x), F.lit(-100.0))).otherwise(F.lit(-100.0))
    return F.avg(-(y * log(score) + (1 - y) * log(1 - score)))


def run_summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of ``value`` over runs, in per cent with two digits; NaN left out."""
    fine = runs.filter(~F.isnan("value") & F.col("value").isNotNull())
    return fine.groupBy(*by).agg(F.round(F.avg("value") * 100, 2).alias("mean"), F.round(F.stddev_pop("value") * 100, 2).alias("std"))
