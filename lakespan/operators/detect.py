"""Detectors: one scan of the text gives the spans of all categories asked for.

Everything before the explode is a narrow projection. A span carries at most 200
characters of each side, so scoring never drags whole texts behind spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, fixed
from ..functions.spans import contains_any, cut, first, last, pieces_of, spans, tokens

SIDE = 200
CATEGORIES = list(fixed.RANKS)
#: Rules that may match a text without a digit.
LETTERS_ONLY = {"mrn.labeled", "mrn.patientID", "licensePlate.labeled", "name.prefix"}
FIXED_SCORES = {"creditCard": 0.95, "email": 0.90, "address": 0.70, "driversLicense": 0.80, "passport": 0.80, "name": 0.65}
#: What must hold of the matched text, by rule.
VALID = {
    "ssn.regex": checks.ssn, "cc.luhn": lambda m: checks.luhn(m) & checks.card_prefix(m), "email.regex": lambda m: F.length(m) <= 254,
    "ein.hyphen": checks.ein, "ein.space": checks.ein, "ein.run": checks.ein, "itin.yy-bucket": checks.itin, "dob.numeric": checks.calendar,
    "dob.textual": checks.textual_year, "dob.labelled": checks.labelled_date, "passport.regex": checks.passport, "npi.80840": checks.npi,
    "dea.letter-check": checks.dea, "routingNumber.aba-checksum": checks.aba,
}


def _gate(category: str, rule: str, doctype: Column | None) -> Column | None:
    """Where a rule runs; None: everywhere. An unknown class gates nothing."""
    if doctype is None:
        return None if rule != "dob.labelled" else F.lit(False)
    if rule == "dob.labelled":
        return F.coalesce(doctype == "financial", F.lit(False))
    if category == "dob":
        return F.coalesce(doctype != "financial", F.lit(True))
    return F.coalesce(doctype.isin(fixed.GATES[category]), F.lit(True)) if category in fixed.GATES else None


def _span(category: str, rule: str, group: str | None):
    """How a match becomes a span: all of it, or the last group of a pattern."""

    def of(s: Column) -> Column:
        whole = s["matched"]
        matched = F.regexp_extract(whole, group, 1) if group else whole
        start = s["start"] + F.length(whole) - F.length(matched) if group else s["start"]
        return F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), start.cast("int").alias("start"), matched.alias("matched"))

    return of


def _valid(wanted: set[str]):
    """The check of a span by its rule."""
    rules = {rule for category, rule, _, _ in fixed.PATTERNS if category in wanted and rule in VALID}

    def of(s: Column) -> Column:
        out = F.lit(True)
        for rule in sorted(rules):
            out = F.when(s["rule"] == rule, VALID[rule](s["matched"])).otherwise(out)
        return out

    return of


def allowed(doctype: str = "doctype") -> Column:
    """Whether the gates of a class let a found span stand."""
    out = F.lit(True)
    for category, rule, _, _ in fixed.PATTERNS:
        gate = _gate(category, rule, F.col(doctype))
        if gate is not None:
            out = F.when((F.col("category") == category) & (F.col("rule") == rule), gate).otherwise(out)
    return out


def candidates(texts: DataFrame, categories: list[str] | None = None, doctype: str | None = None, keep: tuple[str, ...] = ("doc_id",), gated: bool = True) -> DataFrame:
    """keep..., category, rule, start, len, matched, before, after: spans that pass their checks.

    With gated=False all rules run, and allowed() tells later, by the class, which spans stand.
    """
    wanted = set(categories or CATEGORIES)
    text = F.col("text")
    none = F.array().cast("array<struct<category:string,rule:string,start:int,matched:string>>")
    guarded: dict[str, list[Column]] = {}
    for category, rule, pattern, group in fixed.PATTERNS:
        if category not in wanted:
            continue
        gate = _gate(category, rule, F.col(doctype) if doctype else None) if gated else None
        found = F.transform(spans(text, pattern), _span(category, rule, pattern if group else None))
        need = "@" if category == "email" else "" if rule in LETTERS_ONLY else "[0-9]"
        guarded.setdefault(need, []).append(found if gate is None else F.when(gate, found).otherwise(none))
    # one cheap test of the text stands before all the patterns that need a digit
    parts = [F.concat(*found) if not need else F.when(text.rlike(need), F.concat(*found)).otherwise(none) for need, found in guarded.items()]
    every = F.when(text.isNotNull(), F.concat(*parts)).otherwise(none)
    carried = [F.col(k) for k in keep] + ([F.col(doctype)] if doctype and doctype not in keep else [])

    def sides(s: Column) -> Column:
        start, size = s["start"], F.length(s["matched"])
        left = F.greatest(start - SIDE, F.lit(0))
        return F.struct(
            s["category"].alias("category"), s["rule"].alias("rule"), start.alias("start"), size.alias("len"), s["matched"].alias("matched"),
            cut(F.col("pieces"), left, start - left).alias("before"), cut(F.col("pieces"), start + size, F.lit(SIDE)).alias("after"),
        )

    radius = _by_category({c: F.lit(p[2]) for c, p in fixed.PROFILES.items() if c in wanted}, F.lit(5), lambda s: s["category"])

    def context(s: Column) -> Column:
        # computed before the explode, whose output columns are read by every later test without being computed again
        before, after, matched = s["before"], s["after"], s["matched"]
        near = F.lower(F.concat(F.right(before, F.lit(80)), matched, F.left(after, F.lit(80))))
        words = window(before, after, radius(s))
        dated = s["category"].isin(*fixed.PROFILES) & inside_date(before, matched, after)
        return F.struct(*(s[c].alias(c) for c in ("category", "rule", "start", "len", "matched", "before", "after")), words.alias("window"), near.alias("near"), dated.alias("dated"))

    valid = _valid(wanted)
    rows = texts.select(*carried, "text", F.filter(every, valid).alias("spans"))
    # the sides of a span are cut from pieces, so that they cost the same wherever in a long text it stands
    rows = rows.select(*carried, "spans", F.when(F.size("spans") > 0, pieces_of(text)).alias("pieces"))
    return rows.select(*carried, F.inline(F.transform(F.transform("spans", sides), context)))


def window(before: Column, after: Column, n: Column | int) -> Column:
    """The last n tokens before and the first n after, lower case."""
    left, right = last(tokens(before, fixed.WHITE), n), first(tokens(after, fixed.WHITE), n)
    return F.lower(F.concat(F.array_join(left, " "), F.lit(" "), F.array_join(right, " ")))


def inside_date(before: Column, matched: Column, after: Column) -> Column:
    """The span lies within a date found in it and 20 characters on each side."""
    left = F.right(before, F.lit(20))
    near = F.concat(left, matched, F.left(after, F.lit(20)))
    at = F.length(left)
    covers = lambda s: (s["start"] <= at) & (s["start"] + F.length(s["matched"]) >= at + F.length(matched))
    out = F.lit(False)
    for pattern in (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}-\d{1,2}-\d{1,2}"):
        out = out | (near.rlike(pattern) & F.exists(spans(near, pattern), covers))
    return out


def _by_category(values: dict[str, Column], otherwise: Column, of=None):
    """A value by category: of the column, or of what `of` takes from a span (then a function of the span)."""

    def chosen(category: Column) -> Column:
        out = otherwise
        for name, value in values.items():
            out = F.when(category == name, value).otherwise(out)
        return out

    return chosen(F.col("category")) if of is None else lambda s: chosen(of(s))


def _one(category: str, profile: tuple) -> Column:
    """Confidence of a category that is scored by its keyword window."""
    pos, neg, _, low, high, floor = profile
    plain = F.when(contains_any(F.col("window"), pos), high)
    if neg:
        plain = plain.when(contains_any(F.col("window"), neg), max(floor, low - (low - floor) * 0.5))
    return F.when(F.col("dated"), min(floor, 0.05)).otherwise(plain.otherwise(low))


def scored(found: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Adds base, confidence, has_context and other_context; drops what needs context and has none."""
    wanted = set(categories or CATEGORIES)
    profiles = {c: p for c, p in fixed.PROFILES.items() if c in wanted}
    only = lambda values: {c: v for c, v in values.items() if c in wanted}
    words, near = F.col("window"), F.col("near")
    positive = _by_category({c: contains_any(words, p[0]) for c, p in profiles.items()} | only({"phone": contains_any(near, fixed.PHONE_WORDS), "dob": contains_any(near, fixed.BIRTH_WORDS)}), F.lit(False))
    negative = _by_category({c: contains_any(words, p[1]) for c, p in profiles.items() if p[1]} | only({"phone": contains_any(near, fixed.PHONE_OTHER)}), F.lit(False))
    around = F.lower(F.concat(F.right("before", F.lit(40)), F.col("matched"), F.left("after", F.lit(40))))
    aged = around.rlike(r"\b(?:age|aged)[\s:]*?(\d{1,3})\b")
    base = _by_category({c: F.lit(p[3]) for c, p in profiles.items()} | only({c: F.lit(s) for c, s in FIXED_SCORES.items()} | {"phone": F.lit(0.60), "dob": F.when(F.col("rule") == "dob.labelled", 0.85).otherwise(0.05)}), F.lit(0.0))

    birth = F.when(F.col("rule") == "dob.labelled", F.lit(0.85)).otherwise(F.least(F.lit(0.95), F.lit(0.05) + F.when(contains_any(near, fixed.BIRTH_WORDS), 0.30).otherwise(0.0) + F.when(aged, 0.15).otherwise(0.0)))
    phone = F.when(contains_any(near, fixed.PHONE_WORDS), 0.80).when(contains_any(near, fixed.PHONE_OTHER), -1.0).otherwise(0.60)
    confidence = _by_category({c: _one(c, p) for c, p in profiles.items()} | only({c: F.lit(s) for c, s in FIXED_SCORES.items()} | {"phone": phone, "dob": birth}), F.lit(0.0))
    out = found.select("*", base.alias("base"), confidence.alias("confidence"), positive.alias("has_context"), negative.alias("other_context"))
    drop = (F.col("confidence") < 0) | (F.col("rule").isin("ein.space", "ein.run") & (F.col("confidence") <= F.col("base"))) | ((F.col("category") == "account") & (F.col("confidence") <= 0))
    return out.where(~drop).drop("near", "dated")


def detected(texts: DataFrame, categories: list[str] | None = None, doctype: str | None = None, keep: tuple[str, ...] = ("doc_id",), gated: bool = True) -> DataFrame:
    """Spans with their confidence, for the categories asked for (all by default).

    texts has text and the columns to keep; null texts have no spans.
    """
    return scored(candidates(texts, categories, doctype, keep, gated), categories)


def saved_patterns(texts: DataFrame, library: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., label, start, matched for each saved pattern of a library."""

    def labelled(name: str):
        return lambda s: F.struct(F.lit(name).alias("label"), s["start"].alias("start"), s["matched"].alias("matched"))

    arrays = [F.transform(spans(F.col("text"), p), labelled(n)) for n, p in (library or fixed.SAVED).items()]
    return texts.select(*keep, F.inline(F.concat(*arrays)))
