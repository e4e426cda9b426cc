"""Spans: where a pattern matches, as native array expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,matched:string>>"
#: Matches that one inner fold places, and characters of a piece that cut() reads.
FOLD, PIECE = 256, 512


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, matched>> of all matches, start counted in characters from 0.

    The pattern must not match an empty string. Matches and the pieces between
    them alternate, so a start is the sum of the lengths before it. An array that
    grows in a fold is copied at each step, so matches are folded FOLD at a time
    and the blocks put in place after that: the cost is linear in the matches of
    a text, but for a square of a few thousandths of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"))
    none = F.array().cast(EMPTY)

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["p"])
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("start"), x["m"].alias("matched")))).alias("out"))

    def block(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def placed(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / FOLD).cast("int")), lambda k: block(F.slice(every, k * FOLD + 1, F.lit(FOLD))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{EMPTY}>>").alias("blocks"))
        laid = F.aggregate(blocks, start, lambda st, b: F.struct((st["at"] + b["at"]).alias("at"), F.concat(st["blocks"], F.array(F.struct(st["at"].alias("at"), b["out"].alias("out")))).alias("blocks")))
        return F.flatten(F.transform(laid["blocks"], lambda b: F.transform(b["out"], lambda x: F.struct((x["start"] + b["at"]).alias("start"), x["matched"].alias("matched")))))

    # one element, so that what follows reads the matches by name and they are found once
    once = F.element_at(F.transform(F.array(steps), lambda every: F.when(F.size(every) <= FOLD, block(every)["out"]).otherwise(placed(every))), 1)
    return F.when(text.rlike(pattern), once).otherwise(none)


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE characters; make it a column before cut() reads it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, size: Column) -> Column:
    """size characters of a text from start on (0 first), at a cost that does not grow with the text."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + size) / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substring(near, start - first * PIECE + 1, size)


def contains_any(text: Column, words: list[str]) -> Column:
    """Any of the words stands in the text: one pattern, so the expression stays small."""
    return text.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def tokens(text: Column, white: str) -> Column:
    return F.filter(F.split(text, white + "+"), lambda t: t != "")


def first(items: Column, n: Column | int) -> Column:
    return F.slice(items, 1, F.lit(n) if isinstance(n, int) else n)


def last(items: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)
