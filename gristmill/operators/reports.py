"""Grouped reports over labelled rows (target 1, 0 or null for invalid)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import work_folder
from .ranking import running_sums


def label_stats(df: DataFrame, *by: str) -> DataFrame:
    """Rows, valid ones and their share, positives and their rate among the valid."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.count("target").alias("valid"),
        F.round(F.count("target") / F.count(F.lit(1)), 9).alias("valid_share"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("hallucinated"),
        F.round(F.sum("target") / F.count("target"), 9).alias("rate"),
    )


def rates_by(df: DataFrame, first: str, dims: Sequence[str], where: Column | None = None) -> DataFrame:
    """Rate by (first, each dim): one pass with grouping sets, long form (first, dim, value, n, rate)."""
    d = df.filter("target is not null")
    d = d if where is None else d.filter(where)
    text = d.select(first, "target", *[F.col(c).cast("string").alias(c) for c in dims])
    sets = [[F.col(first), F.col(c)] for c in dims]
    grouped = text.groupingSets(sets, first, *dims).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("target"), 9).alias("rate"), *[F.grouping(c).alias(f"_g_{c}") for c in dims])
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in dims:
        dim, value = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dim), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(first, dim.alias("dim"), value.alias("value"), "n", "rate")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n), nulls counted, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def imbalance_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum over columns of the squared difference between largest and smallest share."""
    shares = value_counts(df, columns).groupBy("column").agg(((F.max("n") - F.min("n")) / F.sum("n")).alias("d"))
    return shares.agg(F.round(F.sum(F.col("d") * F.col("d")), 9).alias("score"))


#: Distinct values up to which one window takes a whole group.
FEW = 1 << 18


def describe(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum.

    Quartiles come from running counts of the distinct values, a table that is written once: in one window where these are few, else in
    two levels, so no group's values are held in one place.
    """
    path = work_folder(df.sparkSession, "values")
    df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    per = df.sparkSession.read.parquet(path)
    if per.count() <= FEW:
        cum = per.withColumn("_to", F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        cum = running_sums(per, F.col("_v"), ["_v"], {"_to": F.col("_n")}, by=by)
    stats = df.groupBy(*by).agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"))
    total = stats.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("n").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)
    cum = cum.join(total, same) if by else cum.crossJoin(F.broadcast(total))  # a row a group; one row

    def quantile(p: float) -> Column:
        at = (F.col("_all") - 1) * F.lit(p)
        holds = lambda k: F.max(F.when((F.col("_to") - F.col("_n") <= k) & (k < F.col("_to")), F.col("_v")))
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        return F.round(low + (high - low) * F.max(at - F.floor(at)), 9)

    quarters = cum.groupBy(*by).agg(quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"))
    out = ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if not by:
        return stats.crossJoin(F.broadcast(quarters)).select(*out)  # one row each
    quarters = quarters.select(*[F.col(c).alias(f"_{c}") for c in by], "q25", "q50", "q75")
    return stats.join(quarters, same, "left").select(*by, *out)


def balanced_threshold(short: DataFrame, long: DataFrame, length: str) -> DataFrame:
    """The least t among the lengths where the long rows of at least t and the short rows below t are nearest in number."""
    counts = short.groupBy(length).agg(F.count(F.lit(1)).alias("s"), F.lit(0).alias("l")).unionByName(long.groupBy(length).agg(F.lit(0).alias("s"), F.count(F.lit(1)).alias("l")))
    per = counts.groupBy(length).agg(F.sum("s").alias("s"), F.sum("l").alias("l"))  # a row a length
    d = running_sums(per, F.col(length), [length], {"s_to": F.col("s"), "l_to": F.col("l")}).crossJoin(F.broadcast(per.agg(F.sum("l").alias("all"))))  # one row
    d = d.select(F.col(length).alias("t"), (F.col("s_to") - F.col("s")).alias("below"), (F.col("all") - F.col("l_to") + F.col("l")).alias("above"))
    diff = F.abs(F.col("above") - F.col("below"))
    return d.agg(F.min(F.struct(diff.alias("diff"), "t", "above", "below")).alias("x")).select("x.t", "x.above", "x.below")


def correlation_report(df: DataFrame, by: str, all_name: str = "All") -> DataFrame:
    """Mean label, mean prediction, accuracy and Pearson correlation of (label, prediction), each group and over all."""
    d = df.filter("label is not null and prediction is not null")
    r = d.rollup(by).agg(F.grouping(by).alias("_g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 9).alias("label_mean"), F.round(F.avg("prediction"), 9).alias("prediction_mean"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 9).alias("accuracy"), F.round(F.corr("label", "prediction"), 6).alias("correlation"))
    return r.select(F.when(F.col("_g") == 1, all_name).otherwise(F.col(by)).alias(by), "n", "label_mean", "prediction_mean", "accuracy", "correlation")
