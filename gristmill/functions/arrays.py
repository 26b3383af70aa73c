"""Array expressions that take one pass: bound values, running totals, places of a pattern's matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where ``body`` names it in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column, zero: int, join: Callable[[Column, Column], Column], block: int) -> Column:
    """``join`` of all numbers up to and with each one, as longs; ``zero`` joins to any number without changing it.

    An array that grows is copied at each step, so this is done within blocks and then with the blocks' own results: time grows with the
    length, but for a square of length / block.
    """
    begin = F.array(F.lit(zero).cast("long"))
    last = lambda acc: F.element_at(acc, -1)
    add = lambda acc, x: F.array_append(acc, join(last(acc), x))

    def of(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(zero).cast("long"), join)
        before = F.slice(F.aggregate(blocks, begin, lambda acc, b: add(acc, total(b))), F.lit(1), F.size(blocks))
        own = lambda b, start: F.slice(F.aggregate(b, F.array(start), add), F.lit(2), F.size(b))
        return F.flatten(F.zip_with(blocks, before, own))

    def cut(xs: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / F.lit(block)), F.lit(0)).cast("int"))
        return let(F.transform(places, lambda b: F.slice(xs, b * block + 1, F.lit(block))), of)

    return let(F.transform(numbers, lambda x: x.cast("long")), cut)


def running_totals(numbers: Column, block: int = 256) -> Column:
    """Totals up to and with each number."""
    return _running(numbers, 0, lambda a, b: a + b, block)


def running_greatest(numbers: Column, block: int = 256) -> Column:
    """The greatest number up to and with each one."""
    return _running(numbers, -(1 << 63), lambda a, b: F.greatest(a, b), block)


def least_where(lo: Column, hi: Column, holds: Callable[[Column], Column]) -> Column:
    """The least whole number from ``lo`` to ``hi`` that ``holds``, by bisection; null if ``hi`` does not. What holds must hold for all greater numbers."""
    begin = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(holds(middle), F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).cast("int").alias("lo"), s["hi"].alias("hi")))

    found = lambda: F.aggregate(F.array_repeat(F.lit(0), 31), begin, halve, lambda s: s["lo"])
    return F.when((lo <= hi) & holds(hi.cast("int")), found())


def _beyond(steps: Column) -> Column:
    """Which steps of +1 and -1 take their running total below all before and below 0: closing marks that no opening one stands for."""

    def of(totals: Column) -> Column:
        deepest = running_greatest(F.transform(totals, lambda x: -x))
        return let(deepest, lambda g: F.transform(totals, lambda x, i: -x > F.greatest(F.lit(0), F.coalesce(F.get(g, i - 1), F.lit(0)))))

    return let(running_totals(steps), of)


def without_nested(text: Column, opening: str, closing: str) -> Column:
    """The text without what stands between an opening and its closing mark, to any depth, in one pass: the running depth
    of marks is worked out and what has depth 0 is kept. Marks without a partner stay as text. Both are literal and not empty."""
    marks = f"\\Q{opening}\\E|\\Q{closing}\\E"

    def kept(own: Column) -> Column:
        steps = F.transform(own["marks"], lambda m: F.when(m == opening, 1).otherwise(-1))
        turned = F.reverse(F.transform(own["marks"], lambda m: F.when(m == opening, -1).otherwise(1)))
        alone = F.zip_with(_beyond(steps), F.reverse(_beyond(turned)), lambda a, b: a | b)

        def join(flags: Column) -> Column:
            depth = running_totals(F.zip_with(steps, flags, lambda s, f: F.when(f, 0).otherwise(s)))
            one = lambda ds: F.transform(ds, lambda d, i: F.when(d == 0, F.concat(F.when(F.get(flags, i), F.get(own["marks"], i)).otherwise(F.lit("")), F.get(own["pieces"], i + 1))).otherwise(F.lit("")))
            return F.concat(F.get(own["pieces"], F.lit(0)), F.array_join(let(depth, one), ""))

        return let(alone, join)

    found = lambda t: F.struct(F.split(t, marks, -1).alias("pieces"), F.regexp_extract_all(t, F.lit(marks), F.lit(0)).alias("marks"))
    return let(text, lambda t: F.when(F.contains(t, F.lit(opening)) & F.contains(t, F.lit(closing)), let(found(t), kept)).otherwise(t))


def without_nested_sql(x: str, opening: str, closing: str) -> str:
    """DuckDB's form, by running sums over prefixes."""
    marks = "|".join("".join(f"\\{c}" for c in m) for m in (opening, closing))
    sums = lambda d: f"list_transform(range(1, len({d}) + 1), lambda i: list_sum({d}[1:i]))"
    beyond = lambda s: f"list_transform(range(1, len({s}) + 1), lambda i: {s}[i] < least(0, coalesce(list_min({s}[1:(i - 1)]), 0)))"
    within = lambda fields, body: f"list_transform([{{{fields}}}], lambda v: {body})[1]"
    step = lambda a, b: f"list_transform(v.m, lambda m: CASE WHEN m = '{opening}' THEN {a} ELSE {b} END)"
    last = "v.p[1] || coalesce(array_to_string(list_transform(range(1, len(v.m) + 1), lambda i: CASE WHEN v.d[i] = 0 THEN CASE WHEN v.f[i] THEN v.m[i] ELSE '' END || v.p[i + 1] ELSE '' END), ''), '')"
    depth = within("'p': v.p, 'm': v.m, 'f': v.f, 'd': " + sums("v.e"), last)
    effect = within("'p': v.p, 'm': v.m, 'f': v.f, 'e': list_transform(range(1, len(v.m) + 1), lambda i: CASE WHEN v.f[i] THEN 0 ELSE v.a[i] END)", depth)
    flags = within("'p': v.p, 'm': v.m, 'a': v.a, 'f': list_transform(range(1, len(v.m) + 1), lambda i: v.x[i] OR v.y[len(v.m) + 1 - i])", effect)
    alone = within(f"'p': v.p, 'm': v.m, 'a': v.a, 'x': {beyond('v.s')}, 'y': {beyond('v.t')}", flags)
    totals = within(f"'p': v.p, 'm': v.m, 'a': v.a, 's': {sums('v.a')}, 't': {sums('v.b')}", alone)
    steps = within(f"'p': v.p, 'm': v.m, 'a': {step(1, -1)}, 'b': list_reverse({step(-1, 1)})", totals)
    return within(f"'p': string_split_regex({x}, '{marks}'), 'm': regexp_extract_all({x}, '{marks}')", steps)


def matches(text: Column, pattern: str) -> Column:
    """The pattern's matches, leftmost and without overlap: array of (start, end, found, before) with places in code points from 0, the
    end exclusive, and the text between the match before and this one. The pattern must not match nothing."""

    def placed(own: Column) -> Column:
        lengths = F.zip_with(F.slice(own["gaps"], F.lit(1), F.size(own["found"])), own["found"], lambda g, m: F.length(g) + F.length(m))
        one = lambda ends: F.transform(own["found"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("found"), F.get(own["gaps"], i).alias("before")))
        return let(running_totals(lengths), one)

    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string,before:string>>")
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(pieces, placed)).otherwise(none)
