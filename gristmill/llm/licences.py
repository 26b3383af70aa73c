"""Operator 6: licence scan with a positional rare-token index. DataFrame functions only.

A template is a licence notice or text as words, with a mandatory key phrase in it. The index holds, of each template, the postings (word, template, position)
of the words with the highest inverse document frequency in the corpus, one more than may differ where a share of ``least`` of all words must stand in place; so
every place that qualifies is found by one of them at least. A file's words that the index holds are its highest-IDF licence words:
each occurrence less the posting's position is a place where the template may begin. There
the key phrase must stand whole, and the share of all the template's words that stand at their
relative positions must reach ``least``. A base phrase is its own key phrase and must stand whole.

Whole texts are read once: the words of files that hold all words of a key phrase, and of each file the licence words
that it holds, go to a written table, from which frequencies are counted and places found. Nothing else is shuffled.

Cases: null text counts as empty; without words all counts are 0 and labels empty; very long texts are read whole; a place
near either end of a text matches what is there; of places with equal shares all count and the score is the same; rows that repeat are scanned each on its
own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed: phrases whose places are all counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Fixed: notices and texts of licences with their labels and mandatory key phrases.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "granted free of charge to any person"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', "free of charge to any person"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "in compliance with the license"),
    ("gpl-3", "This work is licensed under the GNU General Public License version 3", "gnu general public license version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "either version 3 of the license"),
    ("gpl-2", "This work is licensed under the GNU General Public License version 2", "gnu general public license version 2"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "either version 2 of the license"),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License version 3", "gnu lesser general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "source and binary forms"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "must retain the above copyright notice"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "mozilla public license version 2"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public license v 2"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "any purpose with or without fee"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "purpose with or without fee"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software"),
)


def words(text: Column) -> Column:
    """Lower-casing moves one other character into a-z, the Kelvin sign; it is exchanged first, so only A-Z change in effect."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(plain, BETWEEN), "")  # a fifth of the time that regexp_extract_all takes


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


#: (label, words, words of the key phrase, where that begins) of all templates; of base phrases.
ALL = [(label, w := plain_words(t), k := key.split(), next(i for i in range(len(w)) if w[i : i + len(k)] == k)) for label, t, key in TEMPLATES]
BASES = [(label, phrase.split(), phrase.split(), 0) for phrase, label in BASE]


def _array(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def _all_of(items: list[str]) -> Column:
    return F.size(F.array_except(_array(list(dict.fromkeys(items))), "_held")) == 0


def read(docs: DataFrame) -> DataFrame:
    """Written table of doc_id, n_words, _held (the licence words in the file) and, where a key phrase's words are all there, _words."""
    vocabulary = sorted({w for _, ws, _, _ in ALL + BASES for w in ws})
    d = docs.select("doc_id", words(F.col("text")).alias("_words"))
    d = d.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", _array(vocabulary)).alias("_held"), "_words")
    some = reduce(lambda a, b: a | b, (_all_of(k) for k in {tuple(k): k for _, _, k, _ in ALL + BASES}.values()))
    return cut(d.withColumn("_words", F.when(some, F.col("_words"))), "licence-words")


def frequencies(found: DataFrame) -> dict[str, int]:
    """Documents that hold each word of the templates; as many rows as the vocabulary has words."""
    return {r.w: r.n for r in found.select(F.explode("_held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def postings(ws: list[str], df: dict[str, int], least: float) -> list[tuple[str, int]]:
    """(word, position) of a template's rarest words, one more than may be out of place."""
    spare = math.floor(len(ws) - math.ceil(least * len(ws) - 1e-9) + 1e-9)
    return sorted(((w, m) for m, w in enumerate(ws)), key=lambda x: (df.get(x[0], 0), x[1]))[: spare + 1]


def _places(ws: list[str], key: list[str], first: int, df: dict[str, int], least: float) -> Column:
    """(start, share) of the places where a template stands; null where words of its key phrase are missing."""
    own = postings(ws, df, least)
    index = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(m).alias("m")) for w, m in own))
    rare = _array(sorted({w for w, _ in own}))
    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda p: F.array_contains(rare, F.get("_words", p)))
    starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(F.filter(index, lambda x: x["w"] == F.get("_words", p)), lambda x: p - x["m"]))))
    starts = F.filter(starts, lambda s: (s + first >= 0) & (F.slice("_words", F.greatest(s + first + 1, F.lit(1)), len(key)) == _array(key)))
    steps = F.sequence(F.lit(0), F.lit(len(ws) - 1))
    share = lambda s: F.size(F.filter(steps, lambda i: F.get("_words", s + i) == F.get(_array(ws), i))) / F.lit(float(len(ws)))
    placed = F.transform(starts, lambda s: F.struct(s.alias("start"), share(s).alias("share")))
    return F.when(F.col("_words").isNotNull() & _all_of(key), F.filter(placed, lambda x: x["share"] >= least))


def scan(docs: DataFrame, *, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs``."""
    d = read(docs)
    df = frequencies(d)
    base = {f"_b{i}": _places(w, k, at, df, 1.0) for i, (_, w, k, at) in enumerate(BASES)}
    more = {f"_t{i}": F.array_max(F.transform(_places(w, k, at, df, least), lambda x: x["share"])) for i, (_, w, k, at) in enumerate(ALL)}
    d = d.select("doc_id", "n_words", *[c.alias(n) for n, c in {**base, **more}.items()])
    none = F.array().cast("array<int>")
    every = F.concat(*(F.coalesce(F.transform(n, lambda x: x["start"]), none) for n in base))
    base_labels = [F.when(F.size(n) > 0, F.lit(label)) for n, (label, _, _, _) in zip(base, BASES)]
    more_labels = [F.when(F.col(n) >= least, F.lit(label)) for n, (label, _, _, _) in zip(more, ALL)]
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    scores = [F.when(F.size(n) > 0, F.lit(1.0)).otherwise(F.lit(0.0)) for n in base] + [F.coalesce(F.col(n), F.lit(0.0)) for n in more]
    return d.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        join(base_labels).alias("base_labels"),
        join(base_labels + more_labels).alias("labels"),
        F.greatest(*scores).alias("score"),
    )


def scan_sql(least: float = 0.6) -> str:
    """DuckDB's form: the votes of all template words by relative position, key phrases in full."""
    rows = []
    for kind, items in (("b", BASES), ("t", ALL)):
        for n, (label, w, k, first) in enumerate(items):
            rows += [f"('{kind}{n}','{label}',{i},'{x}',{len(w)},{len(k)},{str(first <= i < first + len(k)).lower()})" for i, x in enumerate(w)]
    return rf"""
WITH tpl(tid, label, m, w, n, kn, k) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
v AS (SELECT doc_id, tid, label, i - m AS s, count(*) / n::DOUBLE AS share FROM p JOIN tpl USING (w) GROUP BY doc_id, tid, label, i - m, n, kn HAVING count(*) FILTER (WHERE k) = kn),
r AS (SELECT doc_id, count(*) FILTER (WHERE tid[1] = 'b') AS n_base, min(s) FILTER (WHERE tid[1] = 'b') AS first_word, max(s) FILTER (WHERE tid[1] = 'b') AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE tid[1] = 'b') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= {least}) AS labels, max(share) FILTER (WHERE share >= {least}) AS score FROM v GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN r USING (doc_id)"""
