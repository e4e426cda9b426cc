"""Text normalisers. All are native but NFKC, whose Arrow function gets null for texts that are plain ASCII."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _clusters(t: str) -> tuple[str, list[int]]:
    """NFKC of a text, cluster by cluster (a character and the marks behind it), and the place that each character is from."""
    out, places, i = [], [], 0
    while i < len(t):
        j = i + 1
        while j < len(t) and unicodedata.combining(t[j]):
            j += 1
        part = unicodedata.normalize("NFKC", t[i:j])
        out.append(part)
        places += [i] * len(part) if len(part) != j - i else range(i, j)
        i = j
    return "".join(out), places


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
def _nfkc_mapped(s: pd.Series) -> pd.DataFrame:
    """Null for null and for texts that NFKC leaves as they are."""
    rows = [(None, None) if t is None or unicodedata.is_normalized("NFKC", t) else _clusters(t) for t in s]
    return pd.DataFrame(rows, columns=["text", "places"])


@functools.cache
def _folding() -> tuple[str, str, str]:
    """(characters, what they fold to, characters that vanish): canonical decomposition without marks, from the Unicode data."""
    kept, folded, gone = [], [], []
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            gone.append(c)
        elif unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
            if base != c and len(base) == 1:
                kept.append(c)
                folded.append(base)
    return "".join(kept), "".join(folded), "".join(gone)


def _fold(t: str) -> str:
    kept, folded, gone = _folding()
    return t.translate(str.maketrans(kept, folded, gone))


def normalized(text: Column) -> Column:
    """Compatibility composition; of plain ASCII texts the Python side sees nulls."""
    plain = text.rlike(_ASCII)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def mapped(text: Column) -> Column:
    """struct(text, places) of NFKC: the original place of each character; null where the text stays as it is."""
    return _nfkc_mapped(F.when(~text.rlike(_ASCII), text))


def for_search(text: Column, case_sensitive: bool = False) -> Column:
    return normalized(text) if case_sensitive else F.lower(normalized(text))


def smart_punctuation(text: Column) -> Column:
    """Typographic quotes and dashes as ASCII, one character for one."""
    return F.translate(text, *fixed.MARKS)


def strip_separators(text: Column) -> Column:
    return F.translate(text, fixed.SEPARATORS, "")


def separator_map(text: Column) -> Column:
    """The original place of each character that strip_separators keeps."""
    kept = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~x["c"].isin(*fixed.SEPARATORS) & (x["c"] != ""))
    return F.transform(kept, lambda x: x["i"])


def fold_diacritics(text: Column) -> Column:
    """Letters without their diacritics, one character for one; free-standing marks vanish."""
    kept, folded, gone = _folding()
    return F.when(text.rlike(_ASCII), text).otherwise(F.translate(text, kept + gone, folded))


def fold_map(text: Column) -> Column:
    """The original place of each character of fold_diacritics."""
    plain = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    marks = r"\p{Mn}"
    kept = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["c"] != "") & ~x["c"].rlike(marks))
    return F.when(~text.rlike(marks), plain).otherwise(F.transform(kept, lambda x: x["i"]))


def compose_maps(outer: Column, inner: Column) -> Column:
    return F.transform(inner, lambda i: F.element_at(outer, i + 1))


def canonical(text: Column) -> Column:
    """Entity key: composed, lower case, letters, digits and marks only."""
    return F.regexp_replace(F.lower(normalized(text)), r"[^\p{L}\p{N}\p{M}]", "")


def surface_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalized(text)), fixed.WHITE + "+", " "))


def confusions_repaired(line: Column) -> Column:
    """Look-alike letters and digits repaired, token by token.

    A token with more clear digits than clear letters is read as digits, the
    reverse as letters; a token without a majority follows its line, and stays
    as it is where the line has none.
    """
    clear_digit, clear_letter = r"[2-79]", r"[\p{L}&&[^OoIlBSZG]]"

    def lean(t: Column) -> Column:
        return F.regexp_count(t, F.lit(clear_digit)) - F.regexp_count(t, F.lit(clear_letter))

    whole = lean(line)

    def repaired(t: Column) -> Column:
        own = F.when(lean(t) == 0, whole).otherwise(lean(t))
        return F.when(own > 0, F.translate(t, *fixed.TO_DIGITS)).when(own < 0, F.translate(t, *fixed.TO_LETTERS)).otherwise(t)

    words = F.regexp_extract_all(line, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    gaps = F.split(line, r"[\p{L}\p{N}]+", -1)
    pieces = F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w")), lambda x: F.concat(x["g"], F.coalesce(repaired(x["w"]), F.lit(""))))
    # without a digit no token has a digit majority, and letters stay as they are
    return F.when(line.rlike("[0-9]"), F.array_join(pieces, "")).otherwise(line)


#: A capital behind another character of its word (separators part words), or a digraph whose capital is not its title form.
_RECASED = r"[^\s:;,/][\p{javaUpperCase}\p{javaTitleCase}]|[\x{01C4}\x{01C7}\x{01CA}\x{01F1}]"


def shadow_recases(text: Column) -> Column:
    """Whether the shadow of a text may change a letter; if not, it only has spaces for : ; , and /."""
    return text.rlike(_RECASED)


def shadow(text: Column) -> Column:
    """A text of the same length in which names in capitals or glued to labels read as words.

    : ; , and / become spaces; in words in capitals, but for known acronyms, each
    run of letters keeps its first capital only. White space stays as it is.
    """
    spaced = F.translate(text, ":;,/", "    ")
    bare = lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")
    shouted = lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & w.rlike(r"\p{L}") & ~bare(w).isin(*fixed.ACRONYMS)
    words = F.regexp_extract_all(spaced, F.lit(r"\S+"), F.lit(0))
    gaps = F.split(spaced, r"\S+", -1)
    # initcap lowers all but the first letter after a space; letter runs are parted by a mark for that
    runs = lambda w: F.replace(F.initcap(F.regexp_replace(w, r"(?<=\P{L})(?=\p{L})", "\x01 ")), F.lit("\x01 "), F.lit(""))
    cased = lambda w: F.when(shouted(w) & (F.length(runs(w)) == F.length(w)), runs(w)).otherwise(w)
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w")), lambda x: F.concat(x["g"], F.coalesce(cased(x["w"]), F.lit("")))), "")


def title_case(text: Column) -> Column:
    """Words in capitals get title case, but for known acronyms; single spaces part words."""
    bare = lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")
    shouted = lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & w.rlike(r"\p{L}")
    cased = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(bare(w).isin(*fixed.ACRONYMS), w).when(shouted(w), cased(w)).otherwise(w)), " ")


def masked(text: Column) -> Column:
    return F.when(F.length(text) <= 4, "…").otherwise(F.concat(F.left(text, F.lit(2)), F.lit("…"), F.right(text, F.lit(2))))


def neutralised(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def text_layer(text: Column) -> Column:
    bare = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{fixed.WHITE}+|{fixed.WHITE}+$", ""))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, "none").when(bare < 10, "sparse").otherwise("rich")


def fallback(text: Column) -> Column:
    """Why a text layer cannot be trusted; null if it can."""
    t = F.coalesce(text, F.lit(""))
    bad = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    bare = F.trim(t)
    return (
        F.when(F.length(t) == 0, "noExtractableText")
        .when(bad > F.length(t) * 0.01, "encodingFailure")
        .when(t.rlike(r"[\x{0590}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"), "rtlText")
        .when((F.length(bare) >= 50) & (F.size(F.array_distinct(F.split(bare, ""))) < 10), "unresolvedEncoding")
    )
