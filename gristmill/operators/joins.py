"""Joins and set operations over responses, sources and passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_greatest
from ..functions.keys import md5_int
from ..functions.text import span_targets
from ..sources.io import work_folder
from .ranking import global_rank, running_sums, text_number


def responses_with_sources(responses: DataFrame, sources: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Responses whose source is known; the join strategy is Catalyst's by the sides' sizes."""
    return responses.join(sources if where is None else sources.filter(where), key)


def only_known(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_semi")


def common_keys(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that every member has: one aggregate, however many members there are."""
    n = rows.agg(F.countDistinct(member).alias("_n"))
    own = rows.groupBy(key).agg(F.countDistinct(member).alias("_k"))
    return own.crossJoin(F.broadcast(n)).filter("_k = _n").select(key)  # one row


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def trimmed_exists(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose trimmed text is among the known ones: a hash semi join."""
    from ..functions.text import strip

    keys = known.select(strip(F.col(column)).alias("_t")).distinct()
    return rows.join(keys, strip(F.col(column)) == F.col("_t"), "left_semi")


def other_passages(rows: DataFrame, key: str, group: str, k: int, seed: str, draws: int | None = None) -> DataFrame:
    """(key, j, other): k others of another group for each row, by drawn ordinals and an equi-join instead of all pairs.

    Each row draws more ordinals than it needs; repeats, itself and its own group drop out, and the first k by draw stay.
    Rows that then have fewer are filled up from the ranks outside their group, so only rows with fewer than k others at
    all get less. Rows without a group are a group of their own.
    """
    draws = draws or 4 * k + 4
    ranked = global_rank(rows.select(key, group), key, name="_i")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    wanted = ranked.crossJoin(F.broadcast(n)).withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws))))  # one row
    wanted = wanted.select(F.col(key).alias("_key"), F.col(group).alias("_group"), "_d", (md5_int(F.col(key), F.col("_d"), F.lit(seed)) % F.col("_n")).alias("_i"))
    met = wanted.join(ranked, "_i").groupBy("_key", "_group", key, group).agg(F.min("_d").alias("_d"))  # each ordinal meets a row
    other = F.when(~F.col("_group").eqNullSafe(F.col(group)), F.struct("_d", F.col(key).alias("other")))
    first = F.slice(F.array_sort(F.collect_list(other)), 1, k)  # at most ``draws`` a row
    path = work_folder(rows.sparkSession, "others")
    met.groupBy("_key", "_group").agg(first.alias("o")).select("_key", "_group", F.transform("o", lambda x: x["other"]).alias("o")).write.parquet(path)
    found = rows.sparkSession.read.parquet(path)
    short = found.filter(F.size("o") < k)
    if not short.isEmpty():
        found = found.filter(F.size("o") >= k).unionByName(_filled_up(short, rows, key, group, k, seed))
    return found.select(F.col("_key").alias(key), F.posexplode("o").alias("j", "other"))


def _filled_up(short: DataFrame, rows: DataFrame, key: str, group: str, k: int, seed: str) -> DataFrame:
    """short (_key, _group, o) with o filled up to k, or to all there are.

    Rows are ranked by group and key, so a group is one run of ranks. The ranks outside it are cut into 2 k - 1 slices and
    one is drawn from each: all are different, and at most k - 1 of them can be in o already.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_name", F.col(group).cast("string"))
    starts = running_sums(sizes, text_number(sizes, "_name"), [F.col("_name").asc_nulls_first(), group], {"_end": F.col("_n")})
    starts = starts.select(F.col(group).alias("_g"), "_n", (F.col("_end") - F.col("_n")).alias("_start"))
    within = running_sums(rows.select(key, group), F.col(key), [F.col(key).asc_nulls_first()], {"_place": F.lit(1)}, by=[group])
    placed = within.join(starts, F.col(group).eqNullSafe(F.col("_g"))).select((F.col("_start") + F.col("_place") - 1).alias("_at"), F.col(key).alias("other"))
    d = short.join(starts, F.col("_group").eqNullSafe(F.col("_g"))).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    d = d.withColumn("_m", F.col("_all") - F.col("_n")).filter("_m > 0").withColumn("_c", F.least(F.col("_m"), F.lit(2 * k - 1)))
    d = d.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    d = d.withColumn("_lo", F.expr("_s * _m div _c")).withColumn("_hi", F.expr("(_s + 1) * _m div _c"))
    d = d.withColumn("_at", F.col("_lo") + md5_int(F.col("_key"), F.col("_s"), F.lit(seed), F.lit("fill")) % (F.col("_hi") - F.col("_lo")))
    d = d.withColumn("_at", F.col("_at") + F.when(F.col("_at") >= F.col("_start"), F.col("_n")).otherwise(0))
    d = d.withColumn("_d", md5_int(F.col("_key"), F.col("_s"), F.lit(seed), F.lit("order"))).join(placed, "_at")
    new = F.array_sort(F.collect_list(F.when(~F.array_contains("o", F.col("other")), F.struct("_d", "other"))))  # at most 2 k - 1 a row
    d = d.groupBy("_key", "_group", "o").agg(new.alias("_new"))
    return d.select("_key", "_group", F.slice(F.concat("o", F.transform("_new", lambda x: x["other"])), 1, k).alias("o"))


def spans_to_targets(sentences: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """target of each sentence (key, sent_i) from label spans (key, start, end): an interval join within a key.

    ``sentences`` has a row a key with ``starts``; a start before an earlier one counts as that one. A sentence is marked where a label begins before the
    next one's start and ends at its own start or after. As sentences stand in order, a label marks a run of them, so the spans of a key
    go to its one row and each finds its run's ends.
    """
    d = labels.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("_labels"))
    d = sentences.select(key, running_greatest(F.col("starts")).alias("_starts")).join(d, F.col(key) == F.col("_key"), "left")
    own = F.filter(F.coalesce("_labels", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda l: l["end"] >= F.get("_starts", F.lit(0)))
    return d.select(key, F.posexplode(span_targets(F.col("_starts"), own)).alias("sent_i", "target"))
