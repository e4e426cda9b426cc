"""Checksums and structural checks of identifiers, as native expressions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _mod10(text: Column) -> Column:
    return F.call_function("luhn_check", text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def number(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def luhn(text: Column) -> Column:
    """Mod 10 over 13 to 19 digits; any other character is skipped."""
    d = digits(text)
    return F.length(d).between(13, 19) & _mod10(d)


def card_prefix(text: Column) -> Column:
    d = digits(text)
    two, four = number(d, 1, 2), number(d, 1, 4)
    known = (F.substring(d, 1, 1) == "4") | two.between(51, 55) | four.between(2221, 2720) | two.isin(34, 37, 65, 62) | (four == 6011) | four.between(3528, 3589)
    return (F.length(d) >= 4) & F.coalesce(known, F.lit(False))


def npi(text: Column) -> Column:
    return text.rlike("^[0-9]{10}$") & _mod10(F.concat(F.lit("80840"), text))


def _sum(text: Column, weights: list[int], skip: int = 0) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + number(text, i + 1 + skip, 1) * w
    return out


def dea(text: Column) -> Column:
    ok = text.rlike(f"^[{fixed.DEA_LETTERS}][A-Z][0-9]{{7}}$")
    return ok & F.coalesce(_sum(text, [1, 2, 1, 2, 1, 2], 2) % 10 == number(text, 9, 1), F.lit(False))


def aba(text: Column) -> Column:
    two = number(text, 1, 2)
    prefix = two.between(1, 12) | two.between(21, 32) | two.between(61, 72) | (two == 80)
    return text.rlike("^[0-9]{9}$") & F.coalesce(prefix & (_sum(text, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0), F.lit(False))


def ssn(text: Column) -> Column:
    """Nine digits of a possible area, group and serial; not the famous specimen, not one digit throughout."""
    d = digits(text)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000") & (d != "078051120") & ~d.rlike(r"^([0-9])\1{8}$")


def itin(text: Column) -> Column:
    d = digits(text)
    yy = number(d, 4, 2)
    return (F.length(d) == 9) & F.coalesce(yy.between(50, 65) | yy.between(70, 88) | yy.between(90, 92) | yy.between(94, 99), F.lit(False))


def ein(text: Column) -> Column:
    d = digits(text)
    return (F.length(d) == 9) & ~F.substring(d, 1, 2).isin(*fixed.EIN_NEVER)


def passport(text: Column) -> Column:
    return F.upper(text).rlike("|".join(f"(?:{p})" for p in fixed.PASSPORTS.values()))


def calendar(text: Column) -> Column:
    """month, day, year parted by - / or . are a day from 1900 to 2030; two-digit years turn at 30."""
    parts = F.split(text, "[-/.]")
    month, day, year = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    year = F.when(year < 100, year + F.when(year <= 30, 2000).otherwise(1900)).otherwise(year)
    real = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    return F.coalesce((F.size(parts) == 3) & month.between(1, 12) & day.between(1, 31) & year.between(1900, 2030) & real.isNotNull(), F.lit(False))


def textual_year(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1).try_cast("int").between(1900, 2030), F.lit(False))


def labelled_date(text: Column) -> Column:
    """Where the date is numeric its month and day are possible."""
    month = F.regexp_extract(text, r"([0-9]{1,2})[/-][0-9]{1,2}[/-][0-9]{2,4}$", 1).try_cast("int")
    day = F.regexp_extract(text, r"[0-9]{1,2}[/-]([0-9]{1,2})[/-][0-9]{2,4}$", 1).try_cast("int")
    return F.coalesce(month.between(1, 12) & day.between(1, 31), F.lit(True))


def zip_prefixes() -> dict[str, str]:
    """State of each three-digit prefix, as the postal service deals them out: in ranges."""
    return {f"{k:03}": state for first, last, state in fixed.ZIP_RANGES for k in range(first, last + 1)}


def zip_state(code: Column, own: dict[str, str] | None = None) -> Column:
    """State of a ZIP code: of the user's own table, else the five-digit exception, else its three-digit prefix; null if unknown.

    Each table is a map that is looked up once a row.
    """
    lookup = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    state = F.coalesce(lookup(fixed.ZIP_OVERRIDES, code), lookup(zip_prefixes(), F.left(code, F.lit(3))))
    if own:
        state = F.coalesce(lookup(own, code), state)
    return F.when(F.length(code) >= 3, state)
