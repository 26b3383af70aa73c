"""Text expressions: trimming, sentences, chunks, containment, wikitext, prompts. All are built-in columns but where said."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let, without_nested, without_nested_sql
from .matching import ratio

SPACE = r"[\s\p{Z}]"
#: The characters of that class.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Stands for the full stop after a digit while sentences are split.
MASK = "\ue000"
#: Fixed: a reference with content, optionally named, or a use of a named one; of several attributes the last one's value is the name.
PLAIN_REFERENCE = r'<ref(?:\s*[^>]+\s*=\s*"?([^">\/]*)"?\s*)?\s*>(.*?)<\/ref>|<ref(?:\s*[^>]+\s*=\s*"?([^">]*)"?\s*)?\s*\/>'
REFERENCE = "(?is)" + PLAIN_REFERENCE


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(SPACES))


def one_newline(x: Column) -> Column:
    return F.regexp_replace(x, r"\n+", "\n")


def simplify(x: Column) -> Column:
    """Lower case without white space and ASCII punctuation."""
    return F.regexp_replace(F.lower(x), r"[\s\p{Z}\p{Punct}]+", "")


def is_in(part: Column, whole: Column) -> Column:
    """Containment of the simplified texts; an empty part is in everything."""
    return F.contains(simplify(whole), simplify(part))


def span_targets(starts: Column, labels: Column) -> Column:
    """0/1 for each sentence: a label marks all from the one its start is in to the one its end is in.

    An end equal to a sentence's start reaches that sentence; a start before the first counts as in it.
    Each label's first and last sentence are found once; what stands inside the last lambda is worked out anew for every sentence.
    """
    rank = lambda at: F.greatest(F.size(F.filter(starts, lambda s: s <= at)) - 1, F.lit(0))
    bounds = F.transform(labels, lambda l: F.struct(rank(l["start"]).alias("lo"), rank(l["end"]).alias("hi")))
    places = F.transform(starts, lambda _, i: i)
    return F.zip_with(places, F.array_repeat(bounds, F.size(starts)), lambda i, own: F.exists(own, lambda b: (i >= b["lo"]) & (i <= b["hi"])).cast("int"))


def chunk(content: Column, start: Column, end: Column, size: Column, share: Column | None = None) -> Column:
    """Text about [start, end): share of the spare characters before, the rest after; without share, ``size`` on both sides."""
    spare = F.greatest(size - (end - start), F.lit(0))
    before = size if share is None else F.floor(share * (spare + 1)).cast("int")
    after = size if share is None else spare - before
    first = F.when(spare > 0, F.greatest(start - before, F.lit(0))).otherwise(start)
    last = F.when(spare > 0, end + after).otherwise(end)  # a substring ends with its text
    return one_newline(F.substring(content, (first + 1).cast("int"), (last - first).cast("int")))


def section_before(content: Column, start: Column) -> Column:
    """What stands between the last heading's end and the passage, trimmed."""
    return strip(F.substring_index(F.substring(content, F.lit(1), start.cast("int")), "==\n", -1))


def json_snippet(x: Column) -> Column:
    """The first fenced JSON block, else the whole text."""
    fence, end = "```json", "```"
    rest = lambda t: F.when(F.contains(t, F.lit(fence)), F.substring(t, F.instr(t, fence) + len(fence), F.length(t)))
    return let(x, lambda t: let(rest(t), lambda r: F.when(F.contains(r, F.lit(end)), F.substring_index(r, end, 1)).otherwise(t)))


def space_after_references(x: Column) -> Column:
    """A space after each reference that neither white space nor a tag follows, as at the end."""
    return F.regexp_replace(x, f"(?d)({PLAIN_REFERENCE})(?!{SPACE}*<)(?!{SPACE})", "$1 ")


def without_references(x: Column) -> Column:
    return F.regexp_replace(x, REFERENCE, "")


def has_link(x: Column) -> Column:
    return F.contains(x, F.lit("[[")) & F.contains(x, F.lit("]]"))


#: Fixed: character references that are decoded, the last one last.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
_COMMENTS = (r"(?s)<!--.*?-->", "")
_ARGUMENTS = (r"\{\{\{[^{}]*\}\}\}", "")
_MARKUP = (
    (r"<[^<>]*>|'{2,}", ""),
    *[(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")] * 3,
    (r"\[(?:https?:)?//[^\s\]]+\]", ""),
    (r"\[(?:https?:)?//[^\s\]]+[ \t]+([^\]]*)\]", "$1"),
)
_HEADINGS = (r"(?m)^={1,6}[ \t]*([^=\n]+?)[ \t]*={1,6}[ \t]*$", "$1")
_LINES = ((r"\n{3,}", "\n\n"), (r"^\n+", ""), (r"\n+$", ""))


def strip_markup(x: Column, *, headings: bool = True) -> Column:
    """Readable text of wikitext or HTML: templates to any depth, comments, tags and emphasis go, links (in links, three deep) leave what stands behind their target, headings their title."""
    for form, to in (_COMMENTS, _ARGUMENTS):
        x = F.regexp_replace(x, form, to)
    x = without_nested(x, "{{", "}}")
    for form, to in (*_MARKUP, *([_HEADINGS] if headings else [])):
        x = F.regexp_replace(x, form, to)
    for name, to in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(to))
    for form, to in _LINES:
        x = F.regexp_replace(x, form, to)
    return x


def strip_markup_sql(x: str) -> str:
    quote = lambda t: t.replace("'", "''")
    for form, to in (_COMMENTS, _ARGUMENTS):
        x = f"regexp_replace({x}, '{form}', '', 'g')"
    x = without_nested_sql(x, "{{", "}}")
    for form, to in (*_MARKUP, _HEADINGS):
        x = f"regexp_replace({x}, '{quote(form)}', '{to.replace('$', chr(92))}', 'g')"
    for name, to in ENTITIES:
        x = f"replace({x}, '{name}', '{to}')"
    for form, to in _LINES:
        x = f"regexp_replace({x}, '{form}', {'chr(10) || chr(10)' if to else chr(39) * 2}, 'g')"
    return x


def reference_fields(info: Column) -> Column:
    """Map of the first template in a reference: its label under ref_label, then the fields; of equal keys the last counts, a template in it ends it."""
    body = F.split(F.split_part(F.split_part(info, F.lit("{{"), F.lit(2)), F.lit("}}"), F.lit(1)), r"\|")
    given = F.contains(info, F.lit("{{")) & F.contains(info, F.lit("}}"))
    is_field = lambda p: F.contains(p, F.lit("="))
    fields = F.filter(body, lambda p, i: given & ((i == 0) | is_field(p)))
    key = lambda p: F.when(is_field(p), strip(F.split_part(p, F.lit("="), F.lit(1)))).otherwise(F.lit("ref_label"))
    pairs = F.transform(fields, lambda p: F.struct(key(p).alias("k"), strip(F.regexp_replace(p, r"(?s)^[^=]*=", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))


def any_date(x: Column) -> Column:
    """A date in one of the common written forms, null if in none."""
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM yyyy", "yyyy")
    return F.coalesce(*[F.try_to_timestamp(strip(x), F.lit(f)) for f in forms]).cast("timestamp_ntz")


def title_of(url: Column) -> Column:
    """The last path segment, percent-decoded; a plus stays a plus."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    return F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def model_name(model: Column, quantization: Column) -> Column:
    return F.concat(F.substring_index(model, "/", -1), F.coalesce(F.concat(F.lit(" ("), quantization, F.lit(")")), F.lit("")))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


#: Prompt wordings: (system message or None, text around the context and question).
TEMPLATES = {
    "question_first": (None, "Answer from the chunks only.\nQuestion: %1$s\n\n%2$s"),
    "context_first": ("You answer from given chunks.", "%2$sQuestion: %1$s"),
    "reminder": ("You answer from given chunks.", "%2$sQuestion: %1$s\nSay so if the chunks hold no answer."),
}
_MESSAGES = "array<struct<role:string,content:string>>"


def numbered_chunks(chunks: Column) -> Column:
    """'### Chunk i: title' and the content of each (title, content), counted from 1."""
    one = lambda c, i: F.concat(F.lit("### Chunk "), (i + 1).cast("string"), F.lit(": "), c["title"], F.lit("\n"), c["content"], F.lit("\n\n"))
    return F.array_join(F.transform(chunks, one), "")


def prompt(template: str, question: Column, chunks: Column) -> Column:
    """Chat messages of a template."""
    system, form = TEMPLATES[template]
    user = F.struct(F.lit("user").alias("role"), F.format_string(form, question, numbered_chunks(chunks)).alias("content"))
    first = [] if system is None else [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))]
    return F.array(*first, user).cast(_MESSAGES)


def fold_system(messages: Column) -> Column:
    """Chat for models without a system role: its text goes before the first user message."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    joined = F.transform(rest, lambda m, i: F.struct(m["role"].alias("role"), F.when((i == 0) & (system != ""), F.concat(system, F.lit("\n\n"), m["content"])).otherwise(m["content"]).alias("content")))
    return joined.cast(_MESSAGES)


def judge_prompt(question: Column, answer_sections: Column) -> Column:
    """Request to judge numbered sections, with braces doubled and a JSON skeleton for each."""
    safe = lambda s: F.replace(F.replace(s, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    listed = F.array_join(F.transform(answer_sections, lambda s, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(": "), safe(s))), "\n")
    form = F.array_join(F.transform(answer_sections, lambda _, i: F.concat(F.lit('"section_'), (i + 1).cast("string"), F.lit('": {"conflicting": null, "grounded": null, "no_clear_answer": null}'))), ", ")
    return F.concat(F.lit("Question: "), safe(question), F.lit("\n"), listed, F.lit("\nReply as JSON: {"), form, F.lit("}"))


def comparison_prompt(chunks: Column, question: Column, answer: Column) -> Column:
    """Request to list an answer's mistakes against the chunks, by kind, with a quote from either side."""
    form = 'Chunks:\n%s\nQuestion: %s\n\nAnswer: %s\n\nList what in the answer is without ground in the chunks (NOT_GROUNDED) or against them (CONFLICTING), as JSON: {"has_mistakes": null, "mistakes": [{"type": null, "output_quote": null, "chunks_quote": null}]}'
    return F.format_string(form, numbered_chunks(chunks), question, answer)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters as difflib gives it, with its own heuristics; equal texts are not compared."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What ``similarity`` can reach at most: the characters that both texts have, by their numbers."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    number = lambda t, c: F.length(t) - F.length(F.replace(t, c))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(number(a, c), number(b, c))))
    return F.when(longest == 0, F.lit(1.0)).otherwise(2.0 * F.least(common, shortest) / (longest + shortest))


def similar_by_bounds(a: Column, b: Column, threshold: float) -> Column:
    """Whether ``similarity`` reaches the threshold, where equality, the lengths or the characters' numbers tell; null where only the comparison does."""
    lengths = 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
    return F.when(a == b, F.lit(True)).when(lengths < threshold, F.lit(False)).when(ratio_bound(a, b) < threshold, F.lit(False))


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether ``similarity`` reaches the threshold; only texts that bounds leave open are compared character by character."""
    told = similar_by_bounds(a, b, threshold)
    return F.coalesce(told, similarity(F.when(told.isNull(), a), F.when(told.isNull(), b)) >= threshold)


#: Fixed: the shares of words that go, lose a character, and have two change places; of those that spaces and line breaks stand after.
SPOILED = {"lost": 0.03, "shorter": 0.05, "swapped": 0.04, "spaced": 0.05, "broken": 0.02}


def uglify(key: Column, text: Column) -> Column:
    """Spoil a text's words: 3 % go, 5 % lose a character, in 4 % two change places; after 5 % stand 1 to 4 spaces more, after 2 % 1 to 2 line breaks.

    What stands after a word is joined like a word, by a space. A word's draws are the eight groups of four hex digits of the MD5 of key and place.
    """

    def spoiled(word: Column, h: Column) -> Column:
        digits = lambda k: F.substring(h, 4 * k + 1, 4)
        draw = lambda k: F.conv(digits(k), 16, 10).cast("int")
        hit = {name: digits(k) < f"{int(share * 65536):04x}" for k, (name, share) in enumerate(SPOILED.items())}  # hex digits are in the order of their numbers
        at = draw(5) % F.length(word)
        shorter = F.when(hit["shorter"], F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)

        def swapped(w: Column) -> Column:
            n = F.length(w)
            places = let(draw(6) % n, lambda a: let((a + 1 + draw(7) % (n - 1)) % n, lambda b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))))
            turned = lambda x: F.concat(F.substring(w, F.lit(1), x["lo"]), F.substring(w, x["hi"] + 1, F.lit(1)), F.substring(w, x["lo"] + 2, x["hi"] - x["lo"] - 1), F.substring(w, x["lo"] + 1, F.lit(1)), F.substring(w, x["hi"] + 2, n))
            return F.when(hit["swapped"] & (n > 1), let(places, turned)).otherwise(w)

        after = [F.when(hit["spaced"], F.repeat(F.lit(" "), draw(3) % 4 + 1)), F.when(hit["broken"], F.repeat(F.lit("\n"), draw(4) % 2 + 1))]
        other = hit["shorter"] | hit["swapped"] | hit["spaced"] | hit["broken"]  # five of six words stay as they are
        return F.when(hit["lost"], F.lit(None).cast("string")).when(~other, word).otherwise(F.concat_ws(" ", let(shorter, swapped), *after))

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    drawn = lambda i: F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), i.cast("string")).cast("binary"))
    return F.array_join(F.transform(words, lambda w, i: let(drawn(i), lambda h: spoiled(w, h))), " ")


def uglify_sql(key: str, text: str) -> str:
    """DuckDB's form."""
    draw = lambda k: f"('0x' || substr(v.h, {4 * k + 1}, 4))::INT"
    hit = {name: f"{draw(k)} < {int(share * 65536)}" for k, (name, share) in enumerate(SPOILED.items())}
    bind = lambda fields, body: f"list_transform([{{{fields}}}], lambda v: {body})[1]"
    pieces = f"""list_filter([CASE WHEN {hit["swapped"]} AND length(v.w) > 1 THEN substr(v.w, 1, v.lo) || substr(v.w, v.hi + 1, 1) || substr(v.w, v.lo + 2, v.hi - v.lo - 1) || substr(v.w, v.lo + 1, 1) || substr(v.w, v.hi + 2) ELSE v.w END,
CASE WHEN {hit["spaced"]} THEN repeat(' ', {draw(3)} % 4 + 1) END, CASE WHEN {hit["broken"]} THEN repeat(chr(10), {draw(4)} % 2 + 1) END], lambda p: p IS NOT NULL)"""
    places = bind("'h': v.h, 'w': v.w, 'lo': least(v.a, v.b)::INT, 'hi': greatest(v.a, v.b)::INT", pieces)
    second = bind(f"'h': v.h, 'w': v.w, 'a': v.a, 'b': CASE WHEN length(v.w) > 1 THEN (v.a + 1 + {draw(7)} % (length(v.w) - 1)) % length(v.w) ELSE 0 END", places)
    first = bind(f"'h': v.h, 'w': v.w, 'a': CASE WHEN length(v.w) > 0 THEN {draw(6)} % length(v.w) ELSE 0 END", second)
    short = bind(f"'h': v.h, 'w': CASE WHEN {hit['shorter']} THEN substr(v.w, 1, ({draw(5)} % length(v.w))::INT) || substr(v.w, ({draw(5)} % length(v.w) + 2)::INT) ELSE v.w END", first)
    word = bind(f"'w': w, 'h': md5(coalesce({key}::VARCHAR, '') || '|' || (i - 1))", f"CASE WHEN {hit['lost']} THEN [] ELSE {short} END")
    return f"array_to_string(flatten(list_transform(list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> ''), lambda w, i: {word})), ' ')"


#: Characters of texts whose tokens are held at once: a token takes a hundred bytes and more until it is counted.
TOKENS_AT_ONCE = 1 << 16


def token_counts(texts: Iterable[str | None], tokenizer) -> Iterator[int | None]:
    """Tokens of each text, encoded in pieces of ``TOKENS_AT_ONCE`` characters or one longer text; null for null."""

    def counted(piece: list[str | None]) -> list[int | None]:
        found = tokenizer.encode_batch_fast([t or "" for t in piece], add_special_tokens=False)
        return [None if t is None else len(e) for t, e in zip(piece, found)]

    piece, held = [], 0
    for t in texts:
        if piece and held + len(t or "") > TOKENS_AT_ONCE:
            yield from counted(piece)
            piece, held = [], 0
        piece.append(t)
        held += len(t or "")
    if piece:
        yield from counted(piece)


def bpe_count(x: Column, vocabulary: str) -> Column:
    """Tokens of a text under a byte-pair vocabulary (a file of the ``tokenizers`` library); null for null."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(token_counts((t.as_py() for t in b), _tokenizer(vocabulary)), pa.int64())

    return count(x)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
