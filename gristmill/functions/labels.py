"""Labels from judgements: 1 hallucinated, 0 grounded, null invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_in, similar, simplify

FAILS = ("conflicting_fail_content", "conflicting_fail", "grounded_fail_content", "grounded_fail", "no_clear_answer_fail_content", "no_clear_answer_fail")
VERDICTS = ("conflicting", "grounded", "has_factual_information", "no_clear_answer")


def from_judgement(answerable: Column, pred: Column) -> Column:
    """Target of a sentence from the judge's verdicts; null where a check failed, a verdict is missing, or they contradict."""
    c, g, f, n = (pred[v] for v in VERDICTS)
    failed = F.lit(False)
    for name in FAILS:
        failed = failed | F.coalesce(pred[name], F.lit(False))
    missing = pred.isNull() | c.isNull() | g.isNull() | f.isNull() | n.isNull()
    return (
        F.when(missing | failed | (g & f & n), F.lit(None).cast("int"))
        .when(c, 1)
        .when(f & g, F.when(answerable, 0))
        .when(f, 1)
        .when(n, F.when(answerable, 1).otherwise(0))
        .otherwise(0)
    )


def judgement(section: Column, sentence: Column, context: Column, threshold: float = 0.95) -> Column:
    """A judge's section to six checks and four verdicts; what is missing stays null."""

    def echoed(part: Column) -> Column:
        return ~similar(sentence, part["section_content"], threshold)

    def quoted(part: Column, chunk: bool) -> Column:
        wrong = ~is_in(part["section_quote"], sentence)
        return ~is_in(part["necessary_chunk_quote"], context) | wrong if chunk else wrong

    parts = {"conflicting": section["conflicting"], "grounded": section["grounded"], "no_clear_answer": section["cannot_really_answer"]}
    fields = []
    for name, part in parts.items():
        fields += [echoed(part).alias(f"{name}_fail_content"), quoted(part, name != "no_clear_answer").alias(f"{name}_fail")]
    fields += [parts["conflicting"]["result"].alias("conflicting"), parts["grounded"]["result"].alias("grounded")]
    fields += [parts["grounded"]["has_factual_information"].alias("has_factual_information"), parts["no_clear_answer"]["result"].alias("no_clear_answer")]
    return F.struct(*fields)


def from_human(answerable: Column, mark: Column) -> Column:
    """Wrong (W), right (R) and "I don't know" (IDK) to a target."""
    return F.when(mark == "W", 1).when((mark == "IDK") & answerable, 1).when((mark == "R") & answerable, 0).when((mark == "IDK") & ~answerable, 0)


def from_mistakes(sentence: Column, mistakes: Column) -> Column:
    """Type of the first mistake whose quote is in the sentence; CORRECT without one, UNKNOWN without a list."""
    held = F.filter(mistakes, lambda m: F.contains(simplify(sentence), simplify(m["output_quote"])))
    return F.when(mistakes.isNull(), "UNKNOWN").otherwise(F.coalesce(F.get(held, F.lit(0))["type"], F.lit("CORRECT")))


def is_positive(prediction: Column) -> Column:
    """0/1 of a mistake label, null for UNKNOWN."""
    return F.when(prediction != "UNKNOWN", (prediction != "CORRECT").cast("int"))


def contradictory(has_mistakes: Column, mistakes: Column) -> Column:
    """Whether the flag does not fit the list: it differs from the list's length (true counts as 1, false as 0) and the list is not empty.

    So a true flag with one mistake fits, with two it does not; an empty list always fits.
    """
    n = F.coalesce(F.size(mistakes), F.lit(0))
    return (F.coalesce(has_mistakes.cast("int"), F.lit(-1)) != n) & (n > 0)
