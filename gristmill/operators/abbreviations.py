"""Unsupervised sentence model: abbreviations and words that begin sentences, by log-likelihood ratios of counts over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.sentences import CLOSING, KNOWN, OPENERS, OPENING, SentenceModel
from ..functions.text import SPACE
from ..sources.io import work_folder

#: A word with full stops inside at most, and perhaps one after it.
TYPE = r"^\p{L}+(\.\p{L}+)*\.?$"
#: Fixed: how often an abbreviation has its full stop, the least score of one, and the least likelihood ratio of one and of a word that begins sentences.
WITH_STOP, LEAST_SCORE, LEAST_RATIO, LEAST_OPENER = 0.99, 0.3, 10.83, 30.0
#: The share of all words before a full stop (of all sentence ends) that an entry of a list must have, so a list holds 1 / SHARE words at most.
SHARE = 1e-5


def _word(t: Column) -> Column:
    """Without what stands around it."""
    return F.regexp_replace(t, f"^[{OPENING}]+|[{CLOSING},;:]+$", "")


def _bare(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, r"\.$", ""))


def _binomial(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at probability p; 0 log 0 is 0."""
    part = lambda m, q: F.when(m > 0, m * F.log(q)).otherwise(F.lit(0.0))
    return part(k, p) + part(n - k, 1 - p)


def tokens(texts: DataFrame, text: str) -> DataFrame:
    """t, p, n: how often a word stands after the word p, which is null where it holds no full stop, and so ends nothing.

    Words are counted as they stand between white space; patterns are then matched against each different one once.
    """
    one = lambda ts: F.transform(ts, lambda t, i: F.struct(t.alias("t"), F.when(F.contains(F.get(ts, i - 1), F.lit(".")), F.get(ts, i - 1)).alias("p")))
    d = texts.select(F.explode_outer(let(F.split(text, SPACE + "+"), one)).alias("x")).select("x.*")  # the plain explode is planned with a filter that splits all texts again
    d = d.filter("t is not null").groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    return d.select(_word(F.col("t")).alias("t"), _word(F.col("p")).alias("p"), "n").filter(F.regexp_like("t", F.lit(TYPE)))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word, n (all its occurrences), n_stop (those before a full stop)."""
    return _word_counts(tokens(texts, text))


def _word_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(_bare(F.col("t")).alias("word")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.endswith("t", F.lit(".")), F.col("n"))), F.lit(0)).alias("n_stop"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """Counts with ``ratio``, the likelihood ratio of "almost always before a full stop" against "as often as any word", and
    ``score``, the ratio scaled by length, inner full stops and occurrences without a full stop."""
    total = counts.agg(F.sum("n").alias("_n"), F.sum("n_stop").alias("_stops"))  # one row
    d = counts.crossJoin(F.broadcast(total))
    length = F.length(F.replace("word", F.lit(".")))
    ratio = 2 * (_binomial(F.col("n_stop"), F.col("n"), F.lit(WITH_STOP)) - _binomial(F.col("n_stop"), F.col("n"), F.col("_stops") / F.col("_n")))
    d = d.withColumn("ratio", ratio)
    score = F.col("ratio") * F.exp(-length.cast("double")) * (1 + F.length("word") - length) * F.pow(length.cast("double"), (F.col("n_stop") - F.col("n")).cast("double"))
    return d.withColumn("score", score).withColumn("listed", (F.col("score") >= LEAST_SCORE) & (F.col("ratio") >= LEAST_RATIO) & (F.col("n_stop") >= SHARE * F.col("_stops"))).drop("_n", "_stops")


def opener_scores(texts: DataFrame, text: str, abbreviations: frozenset[str]) -> DataFrame:
    """word, n, n_first (in capitals after a full stop that is no abbreviation's), ratio and ``listed``: it stands there more often than by chance."""
    return _opener_scores(tokens(texts, text), abbreviations)


def _opener_scores(found: DataFrame, abbreviations: frozenset[str]) -> DataFrame:
    known = sorted(abbreviations)
    ends = lambda t: F.endswith(t, F.lit(".")) & F.regexp_like(t, F.lit(TYPE)) & ~_bare(t).isin(known) & ~F.regexp_like(t, F.lit(r"^(\p{Lu}|\p{L}(\.\p{L})+)\.$"))
    first = F.regexp_like("t", F.lit(r"^\p{Lu}")) & ends(F.col("p"))
    counts = found.groupBy(_bare(F.col("t")).alias("word")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("n_first"))
    path = work_folder(found.sparkSession, "openers")
    counts.write.parquet(path)
    counts = found.sparkSession.read.parquet(path)
    d = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_n"), F.sum("n_first").alias("_ends"))))  # one row
    k, n, a, every = F.col("n_first"), F.col("n"), F.col("_ends"), F.col("_n")
    apart = _binomial(k, a, k / a) + _binomial(n - k, every - a, (n - k) / (every - a))
    ratio = 2 * (apart - _binomial(k, a, n / every) - _binomial(n - k, every - a, n / every))
    d = d.withColumn("ratio", F.when(F.col("_ends") > 0, ratio))
    return d.withColumn("listed", F.coalesce((F.col("ratio") >= LEAST_OPENER) & (k * every > n * a) & (k >= SHARE * a), F.lit(False))).drop("_n", "_ends")


def learn(texts: DataFrame, text: str) -> SentenceModel:
    """The corpus's model with the known words. One aggregation over all words, two over the different ones; only the lists, of 1 / SHARE words at most, come to the driver."""
    path = work_folder(texts.sparkSession, "words")
    tokens(texts, text).write.parquet(path)
    found = texts.sparkSession.read.parquet(path)
    listed = lambda d: frozenset(r.word for r in d.filter("listed").select("word").collect())
    short = KNOWN | listed(abbreviation_scores(_word_counts(found)))
    return SentenceModel(short, OPENERS | listed(_opener_scores(found, short)))


def _binomial_sql(k: str, n: str, p: str) -> str:
    part = lambda m, q: f"CASE WHEN {m} > 0 THEN ({m}) * ln({q}) ELSE 0 END"
    return f"({part(k, p)} + {part(f'{n} - {k}', f'1 - {p}')})"


def learn_sql(text: str, source: str) -> str:
    """DuckDB's form, as tables: tok (ts), words with their counts, scored, short (l, a list), openers (l, a list)."""
    quote = lambda t: t.replace("'", "''")
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
    bare = "lower(regexp_replace({t}, '\\.$', ''))"
    length = "length(replace(word, '.', ''))"
    ratio = f"2 * ({_binomial_sql('n_stop', 'n', f'{WITH_STOP}::DOUBLE')} - {_binomial_sql('n_stop', 'n', '(s / t)')})"
    ends = f"(regexp_matches(p, '{TYPE}') AND ends_with(p, '.') AND NOT list_contains((SELECT l FROM short), {bare.format(t='p')}) AND NOT regexp_matches(p, '^(\\p{{Lu}}|\\p{{L}}(\\.\\p{{L}})+)\\.$'))"
    apart = f"{_binomial_sql('k', 'a', '(k / a)')} + {_binomial_sql('(n - k)', '(t - a)', '((n - k) / (t - a))')}"
    alike = f"{_binomial_sql('k', 'a', '(n / t)')} - {_binomial_sql('(n - k)', '(t - a)', '(n / t)')}"
    return rf"""tok AS (SELECT list_transform(regexp_split_to_array({text}, '{SPACE}+'), lambda t: regexp_replace(t, '^[{quote(OPENING)}]+|[{quote(CLOSING)},;:]+$', '', 'g')) AS ts FROM {source}),
words AS (SELECT {bare.format(t='t')} AS word, count(*) AS n, count(*) FILTER (WHERE ends_with(t, '.')) AS n_stop FROM (SELECT unnest(ts) AS t FROM tok) WHERE regexp_matches(t, '{TYPE}') GROUP BY 1),
scored AS (SELECT word, n, n_stop, s, ratio, ratio * exp(-{length}) * (1 + length(word) - {length}) * pow({length}, n_stop - n) AS score FROM (SELECT *, {ratio} AS ratio FROM words, (SELECT sum(n)::DOUBLE AS t, sum(n_stop)::DOUBLE AS s FROM words))),
short AS (SELECT list_concat({listed(KNOWN)}, coalesce(list(word) FILTER (WHERE score >= {LEAST_SCORE} AND ratio >= {LEAST_RATIO} AND n_stop >= {SHARE} * s), [])) AS l FROM scored),
firsts AS (SELECT {bare.format(t='t')} AS word, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE p IS NOT NULL AND {ends} AND regexp_matches(t, '^\p{{Lu}}')))::DOUBLE AS k FROM (SELECT unnest(ts) AS t, unnest(list_prepend(NULL, ts[:-2])) AS p FROM tok WHERE len(ts) > 0) WHERE regexp_matches(t, '{TYPE}') GROUP BY 1),
openers AS (SELECT list_concat({listed(OPENERS)}, coalesce(list(word) FILTER (WHERE 2 * ({apart} - {alike}) >= {LEAST_OPENER} AND k * t > n * a AND k >= {SHARE} * a), [])) AS l FROM firsts, (SELECT sum(n) AS t, sum(k) AS a FROM firsts) WHERE a > 0)"""
