"""Row numbers over a whole table without one task holding it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, number: Column, order: Sequence[Column | str], sums: dict[str, Column], by: Sequence[str] = (), parts: int = 256) -> DataFrame:
    """Running totals (rows up to and with each one) in ``order``, each group of ``by`` for itself.

    ``number`` must not fall along the order; it deals the rows to ranges by approximate quantiles, which do not change
    the result. Totals run inside (group, range) and the ranges' own totals are added, so neither a group nor the
    whole table is one task. Rows of one number stay in one range.
    """
    d = df.withColumn("_number", number.cast("double"))
    bounds = sorted(set(d.agg(F.percentile_approx("_number", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    halves = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1))) if bounds else F.array().cast("array<int>")
    place = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(cuts, at + half - 1) < F.col("_number"), at + half).otherwise(at))  # bounds below the number, by bisection
    d = d.withColumn("_range", place)
    d = d.withColumns({f"_v_{n}": c for n, c in sums.items()})
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*by, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])  # at most ``parts`` rows a group
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_range") == F.col("_r")]
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(totals, same).withColumns({n: F.col(f"_t_{n}") + F.sum(f"_v_{n}").over(within) for n in sums})
    return d.drop("_number", "_range", "_r", *[f"_by_{c}" for c in by], *[f"_{k}_{n}" for n in sums for k in "vt"])


def text_number(df: DataFrame, column: str) -> Column:
    """Six bytes of a text as a number that never falls along the order of UTF-8 strings: those after what all texts of the column begin with."""
    lo, hi = df.agg(F.min(F.col(column).cast("binary")), F.max(F.col(column).cast("binary"))).first()
    same = 0 if lo is None else next((i for i, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), same + 1, 6)), 12, "0"), 16, 10).cast("double")


def global_rank(df: DataFrame, key: str, *more: str, name: str = "rank", parts: int = 256) -> DataFrame:
    """Row number from 0 by a numeric key and tiebreaks, nulls first."""
    order = [F.col(key).asc_nulls_first(), *more]
    return running_sums(df, F.col(key), order, {name: F.lit(1)}, parts=parts).withColumn(name, F.col(name) - 1)


def rank_within(df: DataFrame, by: Sequence[str], number: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Row number from 1 in ``order`` within each group, however large it is; ``number`` must not fall along the order."""
    return running_sums(df, number, order, {name: F.lit(1)}, by=by)


def rank_by_group(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Row number from 0 by group (as text, nulls first) and numeric key: ranks within the groups after the rows of the groups before."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_name", F.col(group).cast("string"))
    starts = running_sums(sizes, text_number(sizes, "_name"), [F.col("_name").asc_nulls_first(), group], {"_end": F.col("_n")})
    starts = starts.select(F.col(group).alias("_g"), (F.col("_end") - F.col("_n")).alias("_start"))
    own = rank_within(df, [group], F.col(key), [F.col(key).asc_nulls_first()], "_place")
    return own.join(starts, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_g", "_start", "_place")


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a pinned order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")
