"""Sentences and their places: what ends a sentence is decided by a model of abbreviations and words that begin sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let
from .text import MASK, SPACE, strip

#: Fixed: abbreviations that hold in every corpus, in lower case without the last full stop.
KNOWN = frozenset(
    """al apr approx assn aug ave blvd bros ca capt cf co col corp dec dept dr ed eds est et etc feb fig figs gen gov hon inc jan jr jul jun lt ltd mar messrs mr mrs ms mt no nov
    oct op pp prof rep rev sen sep sept sgt sr st vol vs""".split()
)
#: Fixed: words that begin a sentence rather than go on after an abbreviation, in lower case.
OPENERS = frozenset("a after an and as at but by for from he her his however i if in it its my on our she so that the their then there these they this those we what when while with you your".split())
#: What may stand before and after a word without being part of it.
OPENING, CLOSING = "\"'(\\[{“‘«", "\"')\\]}”’»"
#: A full stop, mark or several, closing quotes, and white space: where a sentence may end.
STOP = rf"([.!?]+[\"')”’]*)({SPACE}+)"
#: Stands for a place where a sentence may end, and for one where it does.
CUT = "\ue001"
#: An abbreviation with what stands around it is looked for in so many of the last characters.
LONGEST = 24
_LAST = rf"(?:^|[^\p{{L}}\p{{N}}.])(\p{{L}}+(?:\.\p{{L}}+)*)\.[\"')”’]*{SPACE}*$"
_NEXT = rf"^[{OPENING}]*(\p{{Lu}}\p{{L}}*)"
#: Initials, and letters with full stops between, are abbreviations by their form.
_FORM = r"^(\p{Lu}|\p{L}(\.\p{L})+)$"


@dataclass(frozen=True)
class SentenceModel:
    """Abbreviations, and words that begin sentences even after one; both in lower case."""

    abbreviations: frozenset[str] = KNOWN
    openers: frozenset[str] = OPENERS


ENGLISH = SentenceModel()


def sentences(x: Column, *, mask: bool = True, lines: bool = True, model: SentenceModel = ENGLISH) -> Column:
    """Trimmed sentences without empty ones.

    A sentence ends with . ! ? and closing quotes before white space, but not after an abbreviation unless a word that begins
    sentences follows. mask: a digit's full stop never ends one; lines: a line's end always does.
    """
    y = F.regexp_replace(x, r"([0-9])\.", "$1" + MASK) if mask else x
    within = lambda w, known: w.isin(sorted(known)) if known else F.lit(False)

    def goes_on(piece: Column, after: Column) -> Column:
        short = lambda last: (last != "") & (F.regexp_like(last, F.lit(_FORM)) | within(F.lower(last), model.abbreviations))
        return let(F.regexp_extract(F.right(piece, F.lit(LONGEST)), _LAST, 1), short) & ~within(F.lower(F.regexp_extract(after, _NEXT, 1)), model.openers)

    end = "\n" if lines else CUT
    joined = lambda ps: F.transform(ps, lambda p, i: F.concat(p, F.when(goes_on(p, F.coalesce(F.get(ps, i + 1), F.lit(""))), F.lit("")).otherwise(F.lit(end))))
    pieces = let(F.split(F.regexp_replace(y, STOP, "$1$2" + CUT), CUT, -1), joined)
    own = F.transform(F.split(F.array_join(pieces, ""), end, -1), lambda s: F.replace(strip(s), F.lit(MASK), F.lit(".")))
    return F.when(x.isNotNull(), F.filter(own, lambda s: s != ""))


def sentences_sql(x: str, source: str, *, mask: bool = True, lines: bool = True, abbreviations: str | None = None, openers: str | None = None) -> str:
    """DuckDB's form: a query for the columns of ``source`` (a FROM item) and ``l``, the sentences of ``x``; the lists as SQL, those of ``ENGLISH`` by default."""
    quote = lambda t: t.replace("'", "''").replace("\\\"", '"').replace("\\'", "'")
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
    y = rf"regexp_replace({x}, '([0-9])\.', '\1' || chr(57344), 'g')" if mask else x
    cut, end = "chr(57345)", "chr(10)" if lines else "chr(57345)"
    last = f"regexp_extract(right(p, {LONGEST}), '{quote(_LAST)}', 1)"
    after = f"lower(regexp_extract(coalesce(ps[i + 1], ''), '{quote(_NEXT)}', 1))"
    goes_on = f"{last} <> '' AND (regexp_matches({last}, '{_FORM}') OR list_contains({abbreviations or listed(KNOWN)}, lower({last}))) AND NOT list_contains({openers or listed(OPENERS)}, {after})"
    stripped = f"regexp_replace(regexp_replace(s, '^{SPACE}+', ''), '{SPACE}+$', '')"
    return rf"""SELECT * EXCLUDE (ps), list_filter(list_transform(string_split(array_to_string(list_transform(ps, lambda p, i: p || CASE WHEN {goes_on} THEN '' ELSE {end} END), ''), {end}), lambda s: replace({stripped}, chr(57344), '.')), lambda s: s <> '') AS l
FROM (SELECT *, string_split(regexp_replace({y}, '{quote(STOP)}', '\1\2' || {cut}, 'g'), {cut}) AS ps FROM {source})"""


#: Sentences times characters up to which each sentence is looked for on its own.
DIRECT = 1 << 18


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _first_places(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The first place of each sentence in its text by one automaton of all of them: one pass over the text. Only one row's strings are held as Python's."""
    import ahocorasick

    def places(text: str, own: list[str]) -> list[int]:
        first: dict[str, int] = {}
        seek = ahocorasick.Automaton()
        for s in own:
            seek.add_word(s, s)
        seek.make_automaton()
        for end, s in seek.iter(text):
            if s not in first:
                first[s] = end + 1 - len(s)
        return [first.get(s, -1) for s in own]

    for texts, lists in parts:
        rows = ((t.as_py(), s.as_py()) for t, s in zip(texts, lists))
        yield pa.array((places(t, s) if t is not None and s else None for t, s in rows), pa.list_(pa.int32()))


def starts(response: Column, own: Column) -> Column:
    """Code points before the first occurrence of each sentence, -1 where there is none.

    A sentence that stands in the text before, on its own or inside another one, has that place. Looking for each from the beginning takes
    the square of the length, so long texts are read once by an automaton of all their sentences. Both arguments are columns of a table, not expressions.
    """
    long = F.size(own).cast("long") * F.length(response) > DIRECT
    return F.coalesce(_first_places(F.when(long, response), F.when(long, own)), F.transform(own, lambda s: F.instr(response, s) - 1))


def start_of(sentence: Column, response: Column) -> Column:
    """Code points before the first occurrence of the sentence."""
    return F.instr(response, sentence) - 1


def valid_sentence(x: Column) -> Column:
    """At least 20 characters, with no bracket or colon at either end."""
    ends = [F.lit(c) for c in ":[](){}"]
    return (F.length(x) >= 20) & ~F.left(x, F.lit(1)).isin(*ends) & ~F.right(x, F.lit(1)).isin(*ends)
