"""License scans: base phrases, and an exact set-similarity join with templates.

All of it is DataFrame operations. Words are lower-cased runs of digits, A-Z and
non-ASCII characters. With H words in the longest template, a block is 2 H words
and a new one starts every H words, so each run of H words, and with it each
notice, lies whole in one block whatever its length. A block meets a template
when it holds at least the share CONTAINED of the template's distinct words and
all of the few words that tell the license from its siblings. Of the templates
of one family that a block meets only the best counts (by share, then size), as
a notice of the lesser license holds every word of the general one's.

The join is exact. Template words are ordered by their frequency over all
documents, rarest first. A block that meets a template of n words, t of them
needed, holds one of the first n - t + 1 in that order (prefix filter), holds at
least t template words at all (length filter), and behind its first common word
at places i of the template and j of the block there are enough left,
1 + min(n - i, m - j) >= t (positional filter). Blocks reach the templates
through an index of prefix words; candidates are verified on the full sets. The
templates are a parameter of a few dozen rows, so their side of the join is
small whatever the data.

Null and empty texts have no words, no places and score 0. A long text is a row
of more blocks; nothing is cut off. Every row gets one row, repeated rows and
rows without an id too; score is 1 where a base phrase stands, else the best
share. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER

CONTAINED = 0.8
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice: its label, the family it competes in, its text, and words that it cannot lack."""

    label: str
    family: str
    text: str
    must: tuple[str, ...]

    def words(self) -> list[str]:
        return re.findall(_WORD, self.text.translate(str.maketrans(UPPER, LOWER)))


#: Phrase and label of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_PROGRAM = "this program is free software you can redistribute it and or modify it under the terms of the "
_LATER = " as published by the free software foundation either version 3 of the license or at your option any later version"
#: Notices in common use. Labels of the base scan and finer ones.
TEMPLATES = (
    Template("gpl", "gnu", "licensed under the gnu general public license version", ("gnu", "general", "public")),
    Template("gpl", "gnu", "under the terms of the gnu general public license as published by the free software foundation", ("gnu", "general", "public")),
    Template("gpl", "gnu", _PROGRAM + "gnu general public license" + _LATER, ("gnu", "general", "public")),
    Template("lgpl", "gnu", "licensed under the gnu lesser general public license version", ("gnu", "lesser", "public")),
    Template("lgpl", "gnu", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu", "lesser", "public")),
    Template("lgpl", "gnu", _PROGRAM + "gnu lesser general public license" + _LATER, ("gnu", "lesser", "public")),
    Template("agpl", "gnu", "licensed under the gnu affero general public license version", ("gnu", "affero", "public")),
    Template("agpl", "gnu", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu", "affero", "public")),
    Template("agpl", "gnu", _PROGRAM + "gnu affero general public license" + _LATER, ("gnu", "affero", "public")),
    Template("apache", "apache", "licensed under the apache license version 2 0", ("apache", "license")),
    Template("apache", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache", "license")),
    Template("mit", "mit", "released under the mit license", ("mit", "license")),
    Template("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission", "granted", "charge")),
    Template("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary", "forms")),
    Template("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission", "purpose", "fee")),
    Template("mpl", "mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla", "public", "license")),
    Template("mpl", "mpl", "licensed under the mozilla public license", ("mozilla", "public", "license")),
    Template("epl", "epl", "licensed under the eclipse public license", ("eclipse", "public", "license")),
    Template("cc-by", "cc", "licensed under cc by 4 0", ("cc", "by")),
    Template("cc-by-nc", "cc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Template("cc-by-sa", "cc", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Template("cc-by", "cc", "licensed under a creative commons attribution 4 0 international license", ("creative", "commons", "attribution")),
    Template("cc-by-nc", "cc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative", "commons", "noncommercial")),
    Template("cc-by-sa", "cc", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative", "commons", "sharealike")),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered", "public", "domain")),
)


def block_step(templates: tuple[Template, ...] = TEMPLATES) -> int:
    """Words between the starts of blocks: those of the longest template; a block is twice as long."""
    return max(len(t.words()) for t in templates)


def _spaced(text: Column) -> Column:
    """The words, not lower-cased, each with one space before it, and a last space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _CUT, " ")), F.lit(" "))


def _places(spaced: Column, phrase: str) -> Column:
    """struct(n, first, last) of the word places of a phrase."""
    size = len(phrase.split())
    pieces = F.split(spaced, f"(?i)(?<= ){phrase}(?= )", -1)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    first = spaces(F.element_at(pieces, 1)) - 1
    last = spaces(spaced) - spaces(F.element_at(pieces, -1)) - (size - 1) - 1
    n = F.size(pieces) - 1
    return F.struct(n.cast("long").alias("n"), F.when(n > 0, first.cast("long")).alias("first"), F.when(n > 0, last.cast("long")).alias("last"))


def _sets(templates: tuple[Template, ...], contained: float) -> list[tuple[Template, list[str], int]]:
    """(template, distinct words, words needed) of each template."""
    out = [(t, sorted(set(t.words()))) for t in templates]
    return [(t, words, math.ceil(contained * len(words) - 1e-9)) for t, words in out]


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Documents that hold each of the words: at most one row a word comes to the driver."""
    own = F.array_intersect(F.split(F.translate(_spaced(F.coalesce(F.col("text"), F.lit(""))), UPPER, LOWER), " "), F.array(*map(F.lit, words)))
    return {r.w: r["count"] for r in docs.select(F.explode(own).alias("w")).groupBy("w").count().collect()}


def _index(sets: list[tuple[Template, list[str], int]], seen: dict[str, int]) -> tuple[dict[str, int], list[Column]]:
    """(rank of each word, rarest first; index rows: prefix rank, template, its ranks, must, place, needed)."""
    every = sorted({w for _, words, _ in sets for w in words}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(every)}
    rows = []
    for t, words, need in sets:
        ranks = sorted(rank[w] for w in words)
        whole = [F.lit(t.label).alias("label"), F.lit(t.family).alias("family"), F.array(*map(F.lit, ranks)).alias("ranks"), F.array(*(F.lit(rank[w]) for w in t.must)).cast("array<int>").alias("must"), F.lit(need).alias("need")]
        rows += [F.struct(F.lit(r).alias("token"), F.lit(place).alias("i"), *whole) for place, r in enumerate(ranks[: len(ranks) - need + 1])]
    return rank, rows


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """row, label, score, block: the best template of each family that a block meets. docs has row (an id for each row) and text."""
    spark = docs.sparkSession
    sets = _sets(templates, contained)
    rank, rows = _index(sets, frequencies(docs, sorted({w for _, words, _ in sets for w in words})))
    index = spark.range(1).select(F.inline(F.array(*rows)))
    least = min(need for _, _, need in sets)
    # a text without the rarest telling word of any template can meet none
    able = docs
    if all(t.must for t in templates):
        telling = "|".join(sorted({re.escape(min(t.must, key=rank.get)) for t in templates}))
        able = docs.where(F.col("text").rlike(rf"(?i)(?<![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])(?:{telling})(?![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])"))
    ranks = F.create_map(*(x for w, i in rank.items() for x in (F.lit(w), F.lit(i))))

    words = able.select("row", F.filter(F.split(F.translate(_spaced(F.col("text")), UPPER, LOWER), " "), lambda w: w != "").alias("words"))
    step = block_step(templates)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("words") - 1) / step), F.lit(0)).cast("int"))
    blocks = words.select("row", F.posexplode(F.transform(starts, lambda i: F.array_intersect(F.slice("words", i * step + 1, F.lit(2 * step)), F.array(*map(F.lit, rank))))).alias("block", "own"))
    blocks = blocks.where(F.size("own") >= least).select("row", "block", F.array_sort(F.transform("own", lambda w: F.element_at(ranks, w))).alias("own"))
    probes = blocks.select("row", "block", "own", F.posexplode("own").alias("j", "token"))
    met = probes.join(F.broadcast(index), "token").where((F.size("own") >= F.col("need")) & (F.lit(1) + F.least(F.size("ranks") - F.col("i") - 1, F.size("own") - F.col("j") - 1) >= F.col("need")))
    # a pair is verified once, at its first common word
    met = met.where(F.element_at(F.array_intersect("ranks", "own"), 1) == F.col("token"))
    common = F.size(F.array_intersect("ranks", "own"))
    met = met.where((common >= F.col("need")) & (F.size(F.array_intersect("must", "own")) == F.size("must")))
    best = F.max(F.struct((common / F.size("ranks")).alias("score"), F.size("ranks").alias("size"), "label")).alias("best")
    return met.groupBy("row", "block", "family").agg(best).select("row", "block", "best.label", "best.score")


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = matches(own.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), "text"), templates)
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    # only texts with a base phrase's last word are rewritten
    spaced = F.when(F.col("text").rlike(r"(?i)licen|cc"), _spaced(F.col("text"))).otherwise(F.lit(" "))
    base = own.select("doc_id", F.xxhash64("text").alias("h"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), spaced.alias("spaced"))
    places = [_places(F.col("spaced"), p) for p in PHRASES]
    base = base.select("doc_id", "h", "n_words", F.when(F.col("spaced") != " ", F.array(*places)).alias("p"))
    at = lambda f: F.transform("p", lambda x: x[f])
    labels = F.array_sort(F.array_distinct(F.filter(F.transform(F.arrays_zip(F.col("p"), F.array(*map(F.lit, PHRASES.values())).alias("l")), lambda x: F.when(x["p"]["n"] > 0, x["l"])), lambda x: x.isNotNull())))
    base = base.select(
        "doc_id", "h", "n_words", F.coalesce(F.aggregate(at("n"), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).alias("n_base"),
        F.array_min(at("first")).alias("first_word"), F.array_max(at("last")).alias("last_word"), F.coalesce(labels, F.array().cast("array<string>")).alias("own"),
    )
    key = F.struct("doc_id", "h")
    out = base.join(found, key.eqNullSafe(F.col("row")), "left")
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def _oracle() -> str:
    """The same results by brute force over all words, for DuckDB."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    base = ",\n".join(
        f"({k}, '{label}', [{', '.join(repr(w) for w in phrase.split())}])" for k, (phrase, label) in enumerate(PHRASES.items())
    )
    quoted = lambda words: "[" + ", ".join(repr(w) for w in words) + "]"
    sets = ",\n".join(f"('{t.label}', '{t.family}', {quoted(words)}, {quoted(t.must)}, {need})" for t, words, need in _sets(TEMPLATES, CONTAINED))
    step = block_step()
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
phrases(k, label, p) AS (VALUES {base}),
sets(label, family, t, must, need) AS (VALUES {sets}),
words AS MATERIALIZED (SELECT r, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
places AS (SELECT r, i - 1 AS i, label FROM words JOIN phrases ON x = p[1] AND w[i : i + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own FROM places GROUP BY r),
starts AS (SELECT r, unnest(range(0, greatest(len(w), 1), {step})) AS s, w FROM d),
blocks AS (SELECT r, s, list_distinct(w[s + 1 : s + {2 * step}]) AS b FROM starts),
met AS (SELECT r, s, label, len(list_intersect(t, b)) / len(t) AS score, row_number() OVER (PARTITION BY r, s, family ORDER BY len(list_intersect(t, b)) / len(t) DESC, len(t) DESC, label DESC) AS k
  FROM blocks, sets WHERE len(list_intersect(t, b)) >= need AND len(list_intersect(must, b)) = len(must)),
found AS (SELECT r, list(DISTINCT label) AS more, max(score) AS best FROM met WHERE k = 1 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


ORACLE_SQL = _oracle()
