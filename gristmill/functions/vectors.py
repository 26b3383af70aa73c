"""Array expressions over vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_states(*states: Column) -> Column:
    return F.concat(*states)


def layer_at(layers: Column, share: float) -> Column:
    """The layer at floor((n - 1) * share)."""
    return F.get(layers, F.floor((F.size(layers) - 1) * F.lit(share)).cast("int"))


def layers_mean(layers: Column, low: float, high: float, dim: int) -> Column:
    """Elementwise sum from floor((n - 1) * low) to floor((n - 1) * high), both in, over the difference of the two (not the count)."""
    start = F.floor((F.size(layers) - 1) * F.lit(low)).cast("int")
    end = F.floor((F.size(layers) - 1) * F.lit(high)).cast("int")
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(F.slice(layers, start + 1, end - start + 1), zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / (end - start))


def softmax(logits: Column) -> Column:
    """The greatest logit and the sum are repeated beside the numbers: inside a lambda they would be worked out anew for each."""
    beside = lambda x, one: F.array_repeat(one, F.size(x))
    powers = F.zip_with(logits, beside(logits, F.array_max(logits).cast("double")), lambda x, top: F.exp(x.cast("double") - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(powers, beside(powers, total), lambda x, t: x / t)


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def dot(a: Column, weights: list[float]) -> Column:
    return reduce(lambda x, y: x + y, [F.get(a, F.lit(i)).cast("double") * F.lit(w) for i, w in enumerate(weights)])
