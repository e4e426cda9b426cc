"""Addresses spread over lines, and institutions named in a text or its header.

A line with a ZIP code looks back over three lines at most, inside the array of
a document's lines, so no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, fixed

BACK, HEADER = 3, 512
ANCHORS = {"federal_agency": "foia", "financial_institution": "financial", "employer": "financial"}


def state_of(line: Column) -> Column:
    """Code of the first state named in full, else of the first code in capitals; null without one."""
    names = "|".join(sorted(fixed.STATES, key=lambda n: (-len(n), n)))
    codes = "|".join([*fixed.STATES.values(), *fixed.MORE_STATES])
    table = F.create_map(*(F.lit(x) for pair in fixed.STATES.items() for x in pair))
    named = F.try_element_at(table, F.regexp_extract(F.lower(line), f"({names})", 1))
    code = F.regexp_extract(line, rf"\b({codes})\b", 1)
    return F.coalesce(named, F.when(code != "", code))


def city_of(line: Column) -> Column:
    """The words before the state or the ZIP code of a line, lower case; null without any."""
    before = F.regexp_replace(F.regexp_replace(line, r"\b\d{5}(?:-\d{4})?\b.*$", ""), rf"[\s,]*\b(?:{'|'.join([*fixed.STATES.values(), *fixed.MORE_STATES])})\b[\s,]*$", "")
    city = F.trim(F.lower(F.regexp_extract(before, r"([\p{L}][\p{L} .'-]*)[\s,]*$", 1)))
    return F.when(city != "", city)


def assembled(texts: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """doc_id, line, text, zip, state, confidence of addresses around a ZIP code.

    A state that contradicts the ZIP code drops the address; without a state and
    a street line there is none. With a table of cities(word), a line whose city
    is not among them counts 0.20 less, 0.30 at least.
    """
    lines = texts.where(F.col("text").rlike(r"\d{5}")).select("doc_id", F.split("text", "\n").alias("lines"))
    around = F.transform("lines", lambda t, i: F.struct(i.alias("line"), t.alias("hit"), F.slice("lines", F.greatest(i - BACK, F.lit(0)) + 1, F.least(i, F.lit(BACK)) + 1).alias("block")))
    rows = lines.select("doc_id", F.inline(F.filter(around, lambda x: x["hit"].rlike(fixed.ZIP_LINE)))).withColumn("zip", F.regexp_extract("hit", fixed.ZIP_LINE, 1))
    found = F.filter(F.transform(F.reverse("block"), state_of), lambda s: s.isNotNull())
    rows = rows.withColumn("state", F.get(found, F.lit(0))).withColumn("by_zip", checks.zip_state(F.col("zip"))).withColumn("street", F.exists("block", lambda t: t.rlike(fixed.STREET_LINE)))
    rows = rows.where((F.col("street") | F.col("state").isNotNull()) & ~F.coalesce(F.col("state") != F.col("by_zip"), F.lit(False)))
    score = F.when(F.col("street") & F.col("state").isNotNull(), 0.80).when(F.col("state").isNotNull(), 0.65).otherwise(0.55)
    rows = rows.withColumn("score", score)
    if cities is not None:
        known = cities.select(F.lower("word").alias("city"), F.lit(True).alias("known")).distinct()
        rows = rows.withColumn("city", city_of(F.col("hit"))).join(known, "city", "left")
        rows = rows.withColumn("score", F.when(F.col("city").isNotNull() & F.col("known").isNull(), F.greatest(F.lit(0.30), F.col("score") - 0.20)).otherwise(F.col("score")))
    return rows.select("doc_id", "line", F.array_join("block", ", ").alias("text"), "zip", "state", F.col("score").alias("confidence"))


def institution(text: Column, known: dict[str, str]) -> tuple[Column, Column]:
    """(name, category) of the longest known institution that stands in the text as whole words.

    known is an optional dimension (name in lower case -> category), a parameter of a run.
    """
    name = category = F.lit(None).cast("string")
    low = F.lower(text)
    for key in sorted((k for k in known if len(k) >= 3), key=lambda k: (len(k), k)):
        hit = low.rlike(r"(?<![\p{L}\p{N}])\Q" + key + r"\E(?![\p{L}\p{N}])")
        name, category = F.when(hit, key).otherwise(name), F.when(hit, known[key]).otherwise(category)
    return name, category


def anchored(text: Column, known: dict[str, str]) -> Column:
    """The document class that an institution in the header stands for; null without one."""
    _, category = institution(F.substring(text, 1, HEADER), known)
    out = F.lit(None).cast("string")
    for name, doctype in ANCHORS.items():
        out = F.when(category == name, doctype).otherwise(out)
    return out


def header_suppressed(found: DataFrame, anchor: str) -> DataFrame:
    """SSN, NPI and name spans under an anchored header count 0.6 of their score, but no less than their floor."""
    floor = F.when(F.col("category") == "ssn", fixed.PROFILES["ssn"][5]).when(F.col("category") == "npi", fixed.PROFILES["npi"][5]).otherwise(0.0)
    hit = F.col("category").isin("ssn", "npi", "name") & F.col(anchor).isNotNull()
    return found.withColumn("confidence", F.when(hit, F.greatest(floor, F.col("confidence") * 0.6)).otherwise(F.col("confidence")))
