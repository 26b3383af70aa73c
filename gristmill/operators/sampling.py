"""Assignment, splits, balancing and samples; random choices come from MD5 keys."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import md5_int
from .ranking import first_per, global_rank, rank_within, running_sums, text_number


def factorial(df: DataFrame, key: str, factors: dict[str, Sequence]) -> DataFrame:
    """Give the i-th row combination i mod n of the factors, the last factor changing fastest."""
    d = global_rank(df, key, name="_i")
    size = 1
    for name, values in reversed(factors.items()):
        at = (F.floor(F.col("_i") / F.lit(size)) % len(values)).cast("int")
        d = d.withColumn(name, F.get(F.array(*map(F.lit, values)), at))
        size *= len(values)
    return d.drop("_i")


def prompt_pairs(df: DataFrame, chunks: str, answer: str, at: str) -> DataFrame:
    """Two rows each: unanswerable with other chunks only, answerable with the chunk at position ``at`` replaced by the answer."""
    d = df.withColumn("answerable", F.explode(F.array(F.lit(False), F.lit(True))))
    mixed = F.transform(F.col(chunks), lambda c, i: F.when(F.col("answerable") & (i == F.col(at)), F.col(answer)).otherwise(c))
    return d.withColumn(chunks, mixed).withColumn(at, F.when(F.col("answerable"), F.col(at)))


def contiguous_split(df: DataFrame, key: str, sizes: dict[str, int], *more: str) -> DataFrame:
    """``split`` by rank: the first rows to the first name, and so on; rows beyond all sizes go."""
    d = global_rank(df, key, *more, name="_i")
    split, end = F.lit(None).cast("string"), sum(sizes.values())
    for name, n in reversed(sizes.items()):
        split = F.when(F.col("_i") < end, name).otherwise(split)
        end -= n
    return d.withColumn("split", split).filter("split is not null").drop("_i")


def trim_parity(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Drop a first row that is answerable and a last row that is not."""
    ends = df.agg(F.min(F.struct(key, *more, "answerable")).alias("lo"), F.max(F.struct(key, *more, "answerable")).alias("hi"))
    d = df.crossJoin(F.broadcast(ends))  # one row
    same = lambda e: F.struct(key, *more) == F.struct(*[F.col(f"{e}.{c}") for c in (key, *more)])
    return d.filter(~(same("lo") & F.col("answerable")) & ~(same("hi") & ~F.col("answerable"))).drop("lo", "hi")


def group_split(df: DataFrame, group: str, train: float = 0.7, val: float = 0.85) -> DataFrame:
    """``split`` so that no group straddles two: borders are the groups at floor(n * share) in string order of the group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.col(group).cast("string"))
    cum = running_sums(counts, text_number(counts, "_key"), [F.col("_key").asc_nulls_first(), group], {"_end": F.col("_n")})
    cum = cum.withColumn("_start", F.col("_end") - F.col("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    holds = lambda share: F.max(F.when((F.col("_start") <= F.floor(F.col("_all") * F.lit(share))) & (F.floor(F.col("_all") * F.lit(share)) < F.col("_end")), F.col("_start")))
    borders = cum.crossJoin(F.broadcast(total)).agg(holds(train).alias("_b1"), holds(val).alias("_b2"))  # one row each
    cum = cum.crossJoin(F.broadcast(borders))
    border = {train: F.col("_b1"), val: F.col("_b2")}.__getitem__
    split = F.when(F.col("_start") < border(train), "train").when(F.col("_start") < border(val), "val").otherwise("test")
    return df.join(cum.select(F.col(group).alias("_g"), split.alias("split")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def undersample(df: DataFrame, target: str, order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Equal classes (within ``by``): the first rows of each by ``order`` (the first column a number), as many as the smallest has."""
    counts = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("_n"))
    least = counts.groupBy(*by).agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_classes"))
    d = _attach(rank_within(df, [*by, target], F.col(order[0]), order, "_k"), least, by)
    return d.filter((F.col("_k") <= F.col("_least")) & (F.col("_classes") > 1)).drop("_k", "_least", "_classes")


def oversample(df: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Equal classes: the smaller is repeated whole, then its first rows once more; ``copy`` counts from 0."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(F.broadcast(counts.withColumn("_most", F.max("_n").over(Window.partitionBy()))), target)  # a row a class
    d = rank_within(d, [target], F.col(order[0]), order, "_k")
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_k") <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).drop("_k", "_n", "_most")


def _attach(df: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(rows, list(by)) if by else df.crossJoin(F.broadcast(rows))


def stratified(df: DataFrame, strata: list[str], n: int, key: str, seed: str) -> DataFrame:
    """n rows of each stratum, by MD5 order."""
    return first_per(df, strata, [md5_int(F.col(key), F.lit(seed)), F.col(key)], n)


def permute_labels(df: DataFrame, key: str, target: str, by: list[str], seed: str) -> DataFrame:
    """Labels dealt anew within ``by``: the i-th row by key gets the label of the i-th row by MD5."""
    draw = md5_int(F.col(key), F.lit(seed))
    own = rank_within(df, by, F.col(key), [key], "_i")
    drawn = rank_within(df, by, draw, [draw, key], "_i")
    return own.drop(target).join(drawn.select(*by, "_i", target), [*by, "_i"]).drop("_i")


def length_matched(short: DataFrame, long: DataFrame, order: str) -> DataFrame:
    """The short set and the first rows of the long one, at most as many."""
    n = short.agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(long, order, name="_i").crossJoin(F.broadcast(n))  # one row
    return short.unionByName(ranked.filter("_i < _n").drop("_i", "_n"))


def thin(df: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """One row of each group, in ascending order of groups the one whose first word has been taken least so far.

    Of the rows of a group with one first word only the first can be chosen, so one row a group and word is left before. Each choice
    depends on all before it, so these run in one task: as many rows as groups have different first words.
    """
    first = F.lower(F.regexp_extract(F.col(text), r"(\S+)", 1))
    slim = df.select(group, order, first.alias("_w")).filter("_w <> ''").groupBy(group, "_w").agg(F.min(order).alias(order))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, int] = {}
        rows = []
        part = part.sort_values([group, order])
        for g, own in itertools.groupby(zip(part[group], part[order], part["_w"]), key=lambda r: r[0]):
            _, at, word = min(own, key=lambda r: taken.get(r[2], 0))  # the first of equals
            taken[word] = taken.get(word, 0) + 1
            rows.append((g, at))
        return pd.DataFrame(rows, columns=[group, order])

    kinds = dict(df.dtypes)
    chosen = slim.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(choose, f"{group} {kinds[group]}, {order} {kinds[order]}")
    return df.join(chosen, [group, order], "left_semi")


def imbalance(counts: dict[tuple, int], columns: int) -> float:
    """Sum over columns of the squared difference between the largest and the smallest share of a value."""
    total = sum(counts.values())
    score = 0.0
    for c in range(columns):
        per: dict = {}
        for combo, n in counts.items():
            per[combo[c]] = per.get(combo[c], 0) + n
        score += ((max(per.values()) - min(per.values())) / total) ** 2
    return score


def balance_plan(counts: dict[tuple, int], max_err: float = 1e-4, steps: int = 10_000, window: int = 100, gain: float = 0.005) -> dict[tuple, int]:
    """Copies to add to each combination: greedily the one that lowers the imbalance most, cut where it was least.

    A copy changes one value's count in each column, so a step works out each value's term once and adds them up by combination.
    """
    combos, added = list(counts), []
    total, per, at = sum(counts.values()), [], []
    for c in range(len(combos[0])):
        place = {v: i for i, v in enumerate(dict.fromkeys(combo[c] for combo in combos))}
        at.append(np.array([place[combo[c]] for combo in combos]))
        per.append([0] * len(place))
        for combo, n in counts.items():
            per[c][place[combo[c]]] += n
    scores = [imbalance(counts, len(per))]
    while scores[-1] > max_err and len(added) < steps:
        after, total = np.zeros(len(combos)), total + 1
        for own, places in zip(per, at):  # added up in the order of imbalance(), so equal scores stay equal
            terms = []
            for i, n in enumerate(own):
                own[i] = n + 1
                terms.append(((max(own) - min(own)) / total) ** 2)
                own[i] = n
            after += np.array(terms)[places]
        best = int(after.argmin())
        for own, places in zip(per, at):
            own[places[best]] += 1
        added.append(combos[best])
        scores.append(float(after[best]))
        if len(scores) > window and scores[-window - 1] - scores[-1] <= gain:
            break
    keep = min(range(len(scores)), key=lambda i: (scores[i], i))
    out: dict[tuple, int] = {}
    for combo in added[:keep]:
        out[combo] = out.get(combo, 0) + 1
    return out


def multi_oversample(df: DataFrame, columns: list[str], key: str, **limits) -> DataFrame:
    """Repeat rows until the columns are balanced: planned over the counts of combinations, dealt evenly over a combination's rows."""
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).collect()  # a row a combination
    rows.sort(key=lambda r: r["first"])
    counts = {tuple(r[c] for c in columns): r["n"] for r in rows}
    more = balance_plan(counts, **limits) if counts else {}
    fields = [df.schema[c] for c in columns]
    schema = type(df.schema)(fields).add("_more", "long").add("_size", "long")
    plan = df.sparkSession.createDataFrame([(*combo, n, counts[combo]) for combo, n in more.items()], schema)
    named = plan.select(*[F.col(c).alias(f"_{c}") for c in columns], "_more", "_size")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    d = rank_within(df, columns, F.col(key), [key], "_k")
    d = d.join(F.broadcast(named), same, "left")  # a row a combination
    extra = F.when(F.col("_more").isNull(), 0).otherwise(F.floor(F.col("_more") / F.col("_size")) + F.when(F.col("_k") <= F.col("_more") % F.col("_size"), 1).otherwise(0))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0), extra.cast("int")))).drop("_k", "_more", "_size", *[f"_{c}" for c in columns])


def clustered_undersample(df: DataFrame, traits: list[str], target: str, key: str, k: int = 10, seed: int = 432) -> DataFrame:
    """Equal classes within each cluster of one-hot traits (k-means)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    text = df.select("*", *[F.coalesce(F.col(t).cast("string"), F.lit("none")).alias(f"_{t}") for t in traits])
    index = StringIndexer(inputCols=[f"_{t}" for t in traits], outputCols=[f"_{t}_i" for t in traits], stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"_{t}_i" for t in traits], outputCols=[f"_{t}_v" for t in traits], dropLast=False)
    from pyspark.ml.feature import VectorAssembler

    parts = Pipeline(stages=[index, hot, VectorAssembler(inputCols=[f"_{t}_v" for t in traits], outputCol="_x")])
    x = parts.fit(text).transform(text)
    most = min(k, max(2, x.select("_x").distinct().count()))
    d = KMeans(k=most, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x).transform(x)
    return undersample(d.select(*df.columns, "cluster"), target, [key], ["cluster"])


def settings(**values: Sequence) -> Column:
    """All combinations of a few parameter values as an array of structs, to be put beside each row without a join."""
    one = lambda combo: F.struct(*(F.lit(v).alias(n) for n, v in zip(values, combo)))
    return F.array(*map(one, itertools.product(*values.values())))


def share_of(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a key."""
    return md5_int(key, F.lit(seed)) / F.lit(4294967296.0)
