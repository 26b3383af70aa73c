"""Operator 13: secret scan by sliding-window entropy of each character class. DataFrame functions only.

Base kinds are found by their patterns. Besides, each class of characters (hexadecimal, lower-case with digits, base 64) has candidates: the longest runs of
its characters that hold what the class asks for. Over a candidate a window slides, and the Shannon entropy of its
characters follows from incremental counts: with one count for each character of the class, a character that enters or leaves changes one
count and one term of the sum of c * log2 c. Terms are whole millionths, so sums are exact in any order. From the first window whose entropy
reaches the class's bits to the end of the last one the candidate is a span. An allow-list suppresses candidates that are known to be
harmless by their form (placeholders, straight runs, UUIDs, paths, ...) or by what stands before them (checksums, commits, data URIs). It never suppresses a base kind.

A long candidate is taken in pieces that overlap by a window, so the work is linear and its characters are never all in memory one by one.
Every row is worked out on its own; nothing is shuffled.

Cases: null text counts as empty; without spans counts are 0 and lists empty; very long texts are read whole; spans of several kinds at one place are
all kept, in the order of start, kind and end; rows that repeat are scanned each on its own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, matches

#: Fixed: words that announce a secret, in letters of either case.
_ANNOUNCED = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Fixed: the base kinds in their order, as patterns. A hexadecimal run and an access key are greedy, so a least length in the pattern drops the same matches as a check after it.
BASE = (
    ("assign", rf"""({_ANNOUNCED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24,}"),
)
#: What an assignment's value has at least; shorter ones use up their text all the same.
ASSIGNED = 6
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Class:
    """A class of characters: its candidates hold ``must`` and are at least a window long, its spans reach ``bits`` of entropy."""

    name: str
    characters: str
    window: int
    bits: float
    must: tuple[str, ...]

    @property
    def pattern(self) -> str:
        return "[" + self.characters.replace("-", r"\-") + "]{" + str(self.window) + ",}"

    @property
    def terms(self) -> list[int]:
        """c * log2 c in millionths for c = 0, 1, ..., window."""
        return [round(1e6 * c * math.log2(c)) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """The largest sum of terms at which a window's entropy, log2(window) - sum / window, reaches ``bits``."""
        return math.floor(1e6 * self.window * (math.log2(self.window) - self.bits))


CLASSES = (
    Class("entropy-hex", _DIGITS + "abcdefABCDEF", 20, 3.0, ("[0-9]", "[A-Fa-f]")),
    Class("entropy-alnum", _DIGITS + _LOWER, 20, 3.45, ("[0-9][^0-9]*[0-9]", "[a-z]")),
    Class("entropy-base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 24, 3.85, ("[0-9]", "[a-z]", "[A-Z]")),
)
#: Fixed: forms of candidates, in lower case, that are no secrets.
ALLOWED = (
    "example|sample|placeholder|changeme|dummy|redacted|your[_-]|xxxx|0000",
    "01234567|12345678|abcdefgh|qwerty",
    "^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$",
    "^/?([a-z]+|[0-9]{1,4})([/_+-]+([a-z]+|[0-9]{1,4}))+/?$",
    "^sha(1|256|384|512)-",
)
#: Fixed: what the text before a candidate that is no secret ends with, in lower case.
ALLOWED_AFTER = (r"""(sha-?(1|224|256|384|512)|md5|crc32|checksum|digest|commit|integrity|etag)["']?\x20*[:=-]?\x20*["']?$""", r"base64,\x20*$")
#: How much of the text before is looked at.
BEFORE = 32
#: Windows of a candidate that are taken at once.
PIECE = 4096


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.regexp_like(x, F.lit(p)) for p in patterns))


def _hot(piece: Column, own: Class) -> Column:
    """(lo, hi): where the first window that reaches the class's bits begins and the last one ends in a piece, or nulls."""
    terms = F.array(*map(F.lit, own.terms))
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(own.characters), c))
    event = lambda code, by: F.struct(code.alias("code"), F.lit(by).alias("by"))
    both = lambda cs: F.flatten(F.transform(cs, lambda c, i: F.when(i < own.window, F.array(event(c, 1))).otherwise(F.array(event(F.get(cs, i - own.window), -1), event(c, 1)))))
    # a count is the character '0' + count at its code's place: one is changed without the others being touched
    begin = F.struct(F.lit("0" * len(own.characters)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def slide(state: Column, e: Column) -> Column:
        count = F.ascii(F.substring(state["counts"], e["code"], F.lit(1))) - 48
        total = state["sum"] + F.get(terms, count + e["by"]) - F.get(terms, count)
        n = state["n"] + F.greatest(e["by"], F.lit(0))
        reaches = (e["by"] > 0) & (n >= own.window) & (total <= own.most)
        return F.struct(
            F.overlay(state["counts"], F.char(count + e["by"] + 48), e["code"], F.lit(1)).alias("counts"),
            total.cast("long").alias("sum"),
            n.alias("n"),
            F.coalesce(state["lo"], F.when(reaches, n - own.window)).alias("lo"),
            F.when(reaches, n).otherwise(state["hi"]).alias("hi"),
        )

    return F.aggregate(let(codes, both), begin, slide, lambda s: F.struct(s["lo"], s["hi"]))


def candidates(text: Column, own: Class) -> Column:
    """Runs of a class's characters that hold what it asks for and that no entry of the allow-list is about."""
    ok = lambda m: reduce(lambda a, b: a & b, (F.regexp_like(m["found"], F.lit(p)) for p in own.must)) & ~_any(F.lower(m["found"]), ALLOWED) & ~_any(F.lower(F.right(m["before"], F.lit(BEFORE))), ALLOWED_AFTER)
    return F.filter(matches(text, own.pattern), ok)


def entropy_spans(text: Column, own: Class) -> Column:
    """(start, end) of a class's spans."""

    def hot(m: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(m["found"]) - own.window) / F.lit(PIECE)).cast("int")), lambda b: F.struct((b * PIECE).alias("at"), F.substring(m["found"], b * PIECE + 1, F.lit(PIECE + own.window - 1)).alias("piece")))
        found = F.transform(pieces, lambda p: let(_hot(p["piece"], own), lambda h: F.struct((m["start"] + p["at"] + h["lo"]).alias("lo"), (m["start"] + p["at"] + h["hi"]).alias("hi"))))
        bounds = lambda hs: F.struct(F.array_min(F.transform(hs, lambda h: h["lo"])).alias("start"), F.array_max(F.transform(hs, lambda h: h["hi"])).alias("end"))
        return let(found, bounds)

    return F.filter(F.transform(candidates(text, own), hot), lambda s: s["start"].isNotNull())


def spans(text: Column) -> Column:
    """All spans of a text in order: array of (start, rank, end, kind)."""
    found = []
    for rank, (kind, pattern) in enumerate(BASE):
        own = matches(text, pattern)
        if kind == "assign":
            own = F.filter(own, lambda m: F.length(F.regexp_extract(m["found"], pattern, 2)) >= ASSIGNED)  # noqa: B023
        found.append((rank, kind, own))
    found += [(len(BASE) + k, c.name, entropy_spans(text, c)) for k, c in enumerate(CLASSES)]
    one = lambda s, rank, kind: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.array_sort(F.concat(*(F.transform(own, lambda s: one(s, rank, kind)) for rank, kind, own in found)))  # noqa: B023


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of ``docs``."""
    d = docs.select("doc_id", spans(F.coalesce(F.col("text"), F.lit(""))).alias("_spans"))
    number = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("_spans", lambda s: s["rank"] < len(BASE)))
    return d.select("doc_id", *(number(k) for k, _ in BASE), F.sha2(base, 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with what ``spans`` found in it replaced; spans that overlap are replaced together."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        between = F.when(apart, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], between).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(found, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def scan_sql() -> str:
    """DuckDB's form: each window's entropy from its own counts."""
    quote = lambda p: p.replace("'", "''")
    out, kinds = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"], []
    for rank, (kind, pattern) in enumerate([*BASE, *((c.name, c.pattern) for c in CLASSES)]):
        t, p = f"k{rank}", quote(pattern)
        out.append(f"{t}l AS (SELECT r, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms FROM d)")
        out.append(
            f"{t} AS (SELECT r, i, m, before, e - length(m) AS s, e FROM (SELECT r, i, m, before, sum(length(m) + length(before)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest(ms) AS m, generate_subscripts(ms, 1) AS i, unnest(gaps[1:len(ms)]) AS before FROM {t}l)))"
        )
        if rank < len(BASE):
            where = f" WHERE length(regexp_extract(m, '{p}', 2)) >= {ASSIGNED}" if kind == "assign" else ""
            kinds.append(f"SELECT r, s, {rank} AS rank, e, '{kind}' AS kind FROM {t}{where}")
            continue
        c = CLASSES[rank - len(BASE)]
        ok = " AND ".join([*(f"regexp_matches(m, '{x}')" for x in c.must), *(f"NOT regexp_matches(lower(m), '{x}')" for x in ALLOWED), *(f"NOT regexp_matches(lower(right(before, {BEFORE})), '{quote(x)}')" for x in ALLOWED_AFTER)])
        out.append(f"{t}w AS (SELECT r, i, s, unnest(range(0, length(m) - {c.window - 1})) AS o, m FROM {t} WHERE {ok})")
        out.append(f"{t}c AS (SELECT r, i, s, o, ch, count(*) AS n FROM (SELECT r, i, s, o, unnest(string_split(substr(m, (o + 1)::INT, {c.window}), '')) AS ch FROM {t}w) GROUP BY ALL)")
        out.append(f"{t}h AS (SELECT r, i, s, o FROM {t}c GROUP BY ALL HAVING sum(round(1000000 * n * log2(n))) <= {c.most})")
        kinds.append(f"SELECT r, s + min(o), {rank}, s + max(o) + {c.window}, '{kind}' FROM {t}h GROUP BY r, i, s")
    listed_sql = lambda more: f"coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e){more}, '')"
    number = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _ in BASE)
    out.append("a AS (" + "\nUNION ALL ".join(kinds) + ")")
    out.append(f"g AS (SELECT r, {number}, {listed_sql(f' FILTER (WHERE rank < {len(BASE)})')} AS base, {listed_sql('')} AS spans FROM a GROUP BY r)")
    numbers = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _ in BASE)
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, {numbers}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"
