"""Queries that detect and classify, each with SQL that finds the same in its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, fixed
from ..operators import detect, doctype
from ..sources import scratch
from ..sources.tables import FIXTURE, corpus, fixture, table

SPAN = ("doc_id", "rule", "start", "len", "matched", "confidence")


def _values() -> str:
    return ",\n".join(f"({-1 - i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(FIXTURE))


#: CTE with the texts that the Spark side reads.
TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values()}) f(doc_id, text))"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_spans(pattern: str, rule: str, where: str = "true") -> str:
    """Spans of a pattern without look-around: starts are summed from the pieces between matches."""
    p = _re(pattern)
    return f"""SELECT doc_id, text, '{rule}' AS rule, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, found[i] AS matched
  FROM (SELECT doc_id, text, found, parts, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS found, string_split_regex(text, {p}) AS parts FROM texts WHERE regexp_matches(text, {p})))
  WHERE {where}"""


_ALONE = "NOT regexp_matches(substr(text, start, 1), '[0-9]') AND NOT regexp_matches(substr(text, start + length(matched) + 1, 1), '[0-9]')"
_D = "regexp_replace(matched, '[^0-9]', '', 'g')"


def _digit_sum(weights: list[int], first: int = 1) -> str:
    return " + ".join(f"CAST(substr(matched, {first + i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights))


def _luhn(d: str) -> str:
    step = f"list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER) ELSE CASE WHEN CAST(substr({d}, i, 1) AS INTEGER) > 4 THEN CAST(substr({d}, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr({d}, i, 1) AS INTEGER) * 2 END END)"
    return f"list_sum({step}) % 10 = 0"


_MARKS = ["-", " ", "‑", "‒", "–", "—", ""]
_DATE = (
    "(SELECT len(p) = 3 AND m BETWEEN 1 AND 12 AND y BETWEEN 1900 AND 2030 AND d BETWEEN 1 AND CASE WHEN m = 2 THEN CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END "
    "FROM (SELECT p, CAST(p[1] AS INTEGER) AS m, CAST(p[2] AS INTEGER) AS d, CASE WHEN CAST(p[3] AS INTEGER) < 100 THEN CAST(p[3] AS INTEGER) + CASE WHEN CAST(p[3] AS INTEGER) <= 30 THEN 2000 ELSE 1900 END ELSE CAST(p[3] AS INTEGER) END AS y FROM (SELECT string_split_regex(matched, '[-/.]') AS p)))"
)


def _sql_candidates(category: str) -> str:
    """Spans of a category: arms of patterns without look-around, then neighbours and checks."""
    nine = f"length({_D}) = 9"
    p = {r: x for _, r, x, _ in fixed.PATTERNS}
    arms = {
        "ssn": [(f"[0-9]{{3}}{m}[0-9]{{2}}{m}[0-9]{{4}}", "ssn.regex", f"{_ALONE} AND substr({_D}, 1, 3) NOT IN ('000', '666') AND substr({_D}, 1, 1) <> '9' AND substr({_D}, 4, 2) <> '00' AND substr({_D}, 6) <> '0000' AND {_D} <> '078051120' AND {_D} <> repeat(substr({_D}, 1, 1), 9)") for m in _MARKS],
        "creditCard": [(r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,7}", "cc.luhn", f"{_ALONE} AND length({_D}) BETWEEN 13 AND 19 AND {_luhn(_D)} AND (substr({_D}, 1, 1) = '4' OR substr({_D}, 1, 2) IN ('34', '37', '65', '62', '51', '52', '53', '54', '55') OR CAST(substr({_D}, 1, 4) AS INTEGER) BETWEEN 2221 AND 2720 OR substr({_D}, 1, 4) = '6011' OR CAST(substr({_D}, 1, 4) AS INTEGER) BETWEEN 3528 AND 3589)")],
        "email": [(r"[a-zA-Z0-9_%+-]+(?:\.[a-zA-Z0-9_%+-]+)*@(?:[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?)\.[a-zA-Z]{2,}", "email.regex", "length(matched) <= 254")],
        "phone": [(r"(?:\+1[\s.-]?)?(?:\([0-9]{3}\)[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}|[0-9]{3}[\s.-]?[0-9]{3}[\s.-]?[0-9]{4})", "phone.regex", _ALONE)],
        "ein": [(f"[0-9]{{2}}{m}[0-9]{{7}}", r, f"{_ALONE} AND substr(matched, 1, 2) NOT IN ({', '.join(_re(x) for x in fixed.EIN_NEVER)})") for m, r in (("-", "ein.hyphen"), (" ", "ein.space"))] + [("[0-9]+", "ein.run", f"length(matched) = 9 AND substr(matched, 1, 2) NOT IN ({', '.join(_re(x) for x in fixed.EIN_NEVER)})")],
        "itin": [(f"9[0-9]{{2}}{m}[0-9]{{2}}{m}[0-9]{{4}}", "itin.yy-bucket", f"{_ALONE} AND {nine} AND (CAST(substr({_D}, 4, 2) AS INTEGER) BETWEEN 50 AND 65 OR CAST(substr({_D}, 4, 2) AS INTEGER) BETWEEN 70 AND 88 OR CAST(substr({_D}, 4, 2) AS INTEGER) BETWEEN 90 AND 92 OR CAST(substr({_D}, 4, 2) AS INTEGER) BETWEEN 94 AND 99)") for m in _MARKS],
        "address": [(p[r], r, "true") for r in ("address.street", "address.po-box", "address.rural", "address.military")],
        "dob": [("[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}", "dob.numeric", f"{_ALONE} AND {_DATE}"), (p["dob.textual"], "dob.textual", "CAST(regexp_extract(matched, '([0-9]{4})$', 1) AS INTEGER) BETWEEN 1900 AND 2030")],
        "driversLicense": [(p["dl.regex"], "dl.regex", "true")],
        "passport": [(p["passport.regex"], "passport.regex", f"regexp_matches(upper(regexp_extract(matched, {_re(p['passport.regex'])}, 1)), {_re('|'.join(f'(?:{x})' for x in fixed.PASSPORTS.values()))})")],
        "mrn": [(p[r], r, "true") for r in ("mrn.labeled", "mrn.patientID", "mrn.institution")],
        "npi": [("[0-9]+", "npi.80840", f"length(matched) = 10 AND substr(matched, 1, 1) IN ('1', '2') AND {_luhn(chr(40) + chr(39) + '80840' + chr(39) + ' || matched' + chr(41))}")],
        "dea": [("[A-Z]{2}[0-9]{7}", "dea.letter-check", f"NOT regexp_matches(substr(text, start, 1), '[A-Z]') AND NOT regexp_matches(substr(text, start + 10, 1), '[0-9]') AND contains('{fixed.DEA_LETTERS}', substr(matched, 1, 1)) AND ({_digit_sum([1, 2, 1, 2, 1, 2], 3)}) % 10 = CAST(substr(matched, 9, 1) AS INTEGER)")],
        "account": [("[A-Za-z0-9]+", "account.regex", "regexp_full_match(matched, '[A-Z]{0,3}[0-9]{6,15}')")],
        "routingNumber": [("[0-9]+", "routingNumber.aba-checksum", f"length(matched) = 9 AND (CAST(substr(matched, 1, 2) AS INTEGER) BETWEEN 1 AND 12 OR CAST(substr(matched, 1, 2) AS INTEGER) BETWEEN 21 AND 32 OR CAST(substr(matched, 1, 2) AS INTEGER) BETWEEN 61 AND 72 OR substr(matched, 1, 2) = '80') AND ({_digit_sum([3, 7, 1, 3, 7, 1, 3, 7, 1])}) % 10 = 0")],
        "licensePlate": [(p["licensePlate.labeled"], "licensePlate.labeled", "true")],
        "name": [(p["name.prefix"], "name.prefix", "true")],
    }
    out = []
    for pattern, rule, where in arms[category]:
        inner = f"SELECT * FROM ({sql_spans(pattern, rule)}) WHERE {where}"
        if rule in ("dl.regex", "passport.regex", "name.prefix"):
            g = f"regexp_extract(matched, {_re(pattern)}, 1)"
            inner = f"SELECT doc_id, text, rule, CAST(start + length(matched) - length({g}) AS INTEGER) AS start, {g} AS matched FROM ({inner})"
        out.append(inner)
    return "\nUNION ALL\n".join(out)


def _any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_re(w)})" for w in words) + ")" if words else "false"


_WIN = r"'[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"


def _sql_scored(category: str) -> str:
    """doc_id, rule, start, len, matched, confidence of a category."""
    near = lambda n: f"lower(substr(text, greatest(start - {n}, 0) + 1, least(start, {n}) + length(matched) + {n}))"
    if category in fixed.PROFILES:
        pos, neg, radius, low, high, floor = fixed.PROFILES[category]
        before, after = "substr(text, greatest(start - 200, 0) + 1, least(start, 200))", "substr(text, start + length(matched) + 1, 200)"
        toks = lambda t: f"list_filter(string_split_regex({t}, {_WIN}), lambda x: x <> '')"
        words = f"lower(array_to_string({toks(before)}[-{radius}:], ' ') || ' ' || array_to_string({toks(after)}[1:{radius}], ' '))"
        near20 = "substr(text, greatest(start - 20, 0) + 1, least(start, 20) + length(matched) + 20)"
        dated = " OR ".join(
            f"len(list_filter(range(1, len(regexp_extract_all({near20}, '{d}')) + 1), lambda i: coalesce(list_sum(list_transform(string_split_regex({near20}, '{d}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all({near20}, '{d}')[1:i - 1], lambda x: length(x))), 0) <= least(start, 20) "
            f"AND coalesce(list_sum(list_transform(string_split_regex({near20}, '{d}')[1:i], lambda x: length(x))), 0) + list_sum(list_transform(regexp_extract_all({near20}, '{d}')[1:i], lambda x: length(x))) >= least(start, 20) + length(matched))) > 0"
            for d in ("[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
        )
        score = f"CASE WHEN {dated} THEN {min(floor, 0.05)} WHEN {_any('w', pos)} THEN {high} WHEN {_any('w', neg)} THEN {max(floor, low - (low - floor) * 0.5)} ELSE {low} END"
        keep = {"ein": f"(rule = 'ein.hyphen' OR confidence > {low})", "account": "confidence > 0"}.get(category, "true")
        return f"SELECT doc_id, rule, start, CAST(length(matched) AS INTEGER) AS len, matched, confidence FROM (SELECT *, CAST({score} AS DOUBLE) AS confidence FROM (SELECT *, {words} AS w FROM cand)) WHERE {keep}"
    score, keep = str(detect.FIXED_SCORES.get(category, 0)), "true"
    if category == "phone":
        score = f"CASE WHEN {_any(near(80), fixed.PHONE_WORDS)} THEN 0.8 ELSE 0.6 END"
        keep = f"NOT ({_any(near(80), fixed.PHONE_OTHER)} AND NOT {_any(near(80), fixed.PHONE_WORDS)})"
    if category == "dob":
        age = r"\b(?:age|aged)[\s:]*?[0-9]{1,3}\b"
        score = f"least(0.95, 0.05 + CASE WHEN {_any(near(80), fixed.BIRTH_WORDS)} THEN 0.30 ELSE 0.0 END + CASE WHEN regexp_matches({near(40)}, {_re(age)}) THEN 0.15 ELSE 0.0 END)"
    return f"SELECT doc_id, rule, start, CAST(length(matched) AS INTEGER) AS len, matched, round(CAST({score} AS DOUBLE), 6) AS confidence FROM cand WHERE {keep}"


def _detector(category: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.detected(corpus(spark, sf_dir), [category])
        return found.select(*SPAN[:-1], F.round("confidence", 6).alias("confidence"))

    return query


def sql_found(category: str) -> str:
    return f"WITH {TEXTS}, cand AS ({_sql_candidates(category)}) {_sql_scored(category)}"


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, documents and mean confidence of each category, over all detectors in one scan."""
    found = detect.detected(corpus(spark, sf_dir))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def _counts_sql() -> str:
    parts = [f"SELECT '{c}' AS category, * FROM ({sql_found(c)})" for c in detect.CATEGORIES]
    return f"SELECT category, count(*) AS spans, count(DISTINCT doc_id) AS documents, round(avg(confidence), 6) AS mean_confidence FROM ({' UNION ALL '.join(parts)}) GROUP BY category"


def saved_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.saved_patterns(corpus(spark, sf_dir), {k: v for k, v in fixed.SAVED.items() if k in ("caseNumber", "iban", "ipv4", "uuid", "iso8601")})


def saved_patterns_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole library of ten patterns; four of them have look-arounds, which DuckDB lacks, so there is no SQL."""
    return detect.saved_patterns(corpus(spark, sf_dir))


def _saved_sql() -> str:
    return f"WITH {TEXTS} SELECT doc_id, rule AS label, start, matched FROM ({' UNION ALL '.join(sql_spans(fixed.SAVED[k], k) for k in ('caseNumber', 'iban', 'ipv4', 'uuid', 'iso8601'))})"


def card_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over plain numbers made from orders and customers."""
    n = table(spark, sf_dir, "orders").select(F.lpad((F.col("o_orderkey") * 7919 + 1000003).cast("string"), 9, "0").alias("n"))
    return n.select("n", checks.aba(F.col("n")).alias("aba"), checks.ssn(F.col("n")).alias("ssn"), checks.itin(F.col("n")).alias("itin"), checks.ein(F.col("n")).alias("ein"), checks.luhn(F.concat(F.lit("4111111"), F.col("n"))).alias("luhn"), checks.npi(F.concat(F.lit("1"), F.col("n"))).alias("npi"))


CHECKS_SQL = f"""
WITH t AS (SELECT lpad(CAST(o_orderkey * 7919 + 1000003 AS VARCHAR), 9, '0') AS n FROM orders),
s AS (SELECT n, n AS matched FROM t)
SELECT n, (CAST(substr(n, 1, 2) AS INTEGER) BETWEEN 1 AND 12 OR CAST(substr(n, 1, 2) AS INTEGER) BETWEEN 21 AND 32 OR CAST(substr(n, 1, 2) AS INTEGER) BETWEEN 61 AND 72 OR substr(n, 1, 2) = '80') AND ({_digit_sum([3, 7, 1, 3, 7, 1, 3, 7, 1])}) % 10 = 0 AS aba,
 substr(n, 1, 3) NOT IN ('000', '666') AND substr(n, 1, 1) <> '9' AND substr(n, 4, 2) <> '00' AND substr(n, 6) <> '0000' AND n <> '078051120' AND n <> repeat(substr(n, 1, 1), 9) AS ssn,
 CAST(substr(n, 4, 2) AS INTEGER) BETWEEN 50 AND 65 OR CAST(substr(n, 4, 2) AS INTEGER) BETWEEN 70 AND 88 OR CAST(substr(n, 4, 2) AS INTEGER) BETWEEN 90 AND 92 OR CAST(substr(n, 4, 2) AS INTEGER) BETWEEN 94 AND 99 AS itin,
 substr(n, 1, 2) NOT IN ({', '.join(_re(x) for x in fixed.EIN_NEVER)}) AS ein, {_luhn("('4111111' || n)")} AS luhn, {_luhn("('808401' || n)")} AS npi FROM s
"""


def classify_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doctype.classified(corpus(spark, sf_dir))
    return rows.select("doc_id", "primary", "runner_up", F.array_join(F.array_sort("bonuses"), ",").alias("bonuses"), F.array_join("keywords", ",").alias("keywords"), F.round(F.array_max("probabilities"), 6).alias("probability"))


def _doctype_ctes() -> str:
    words = "list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}''-]+'), lambda x: x <> ''))"
    cols = []
    for name in fixed.DOCTYPES:
        kws = ", ".join(_re(k) for k in fixed.DOCTYPE_KEYWORDS[name])
        bonus = [f"CASE WHEN regexp_matches(lower(text), {_re(p)}) THEN {b} ELSE 0 END" for c, _, p, b in fixed.DOCTYPE_BONUSES if c == name]
        names = [f"CASE WHEN regexp_matches(lower(text), {_re(p)}) THEN '{r}' END" for c, r, p, _ in fixed.DOCTYPE_BONUSES if c == name]
        cols.append(f"list_sort(list_intersect(w, [{kws}])) AS k_{name}, least(len(list_intersect(w, [{kws}])), 5) + {' + '.join(bonus) or '0'} AS s_{name}, [{', '.join(names)}] AS b_{name}")
    every = ", ".join(f"s_{n}" for n in fixed.DOCTYPES)
    order = ", ".join(f"{{'p': -s_{n}, 'name': '{n}'}}" for n in fixed.DOCTYPES)
    return f"""w AS (SELECT doc_id, text, {words} AS w FROM texts), e AS (SELECT doc_id, {', '.join(cols)} FROM w),
classes AS (SELECT doc_id, list_sort([{order}]) AS o, {' || '.join(f'k_{n}' for n in fixed.DOCTYPES)} AS k, list_sort(list_filter({' || '.join(f'b_{n}' for n in fixed.DOCTYPES)}, lambda x: x IS NOT NULL)) AS b,
 1 / ({' + '.join(f'exp(s_{n} - greatest({every}))' for n in fixed.DOCTYPES)}) AS p FROM e)"""


DOCTYPE_SQL = f"WITH {TEXTS}, {_doctype_ctes()} SELECT doc_id, o[1].name AS \"primary\", o[2].name AS runner_up, array_to_string(b, ',') AS bonuses, array_to_string(k, ',') AS keywords, round(p, 6) AS probability FROM classes"


def doctype_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that carries over from turn to turn of a conversation; fixture texts are the turns of one."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(fixture(spark).select(F.lit(-1).cast("long").alias("conv_id"), (-F.col("doc_id")).alias("turn"), "text"))
    rows = doctype.carried(doctype.classified(own), "conv_id", "turn")
    return rows.select("conv_id", "turn", "primary", "effective")


def _carry_sql() -> str:
    texts = f"f AS (SELECT * FROM (VALUES {_values()}) f(doc_id, text)), turns AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, -doc_id, text FROM f), texts AS (SELECT row_number() OVER () AS doc_id, * FROM turns)"
    return f"WITH {texts}, {_doctype_ctes()}, c AS (SELECT conv_id, turn, o[1].name AS p, len(k) AS k FROM classes JOIN texts USING (doc_id)) SELECT conv_id, turn, p AS \"primary\", coalesce(lag(CASE WHEN k > 0 THEN p END) OVER (PARTITION BY conv_id ORDER BY turn), p) AS effective FROM c"


def gated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors under the gates of each text's class."""
    # texts are classified where something was found in them, and nowhere else
    texts = corpus(spark, sf_dir)
    found = scratch.written(detect.detected(texts, gated=False).select("doc_id", "category", "rule"), "found")
    classes = doctype.classified(texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", F.col("primary").alias("doctype"))
    found = found.join(classes, "doc_id").where(detect.allowed())
    return found.groupBy("doctype", "category").agg(F.count(F.lit(1)).alias("spans"))


def _gated_sql() -> str:
    parts = []
    for c in detect.CATEGORIES:
        gate = f"o[1].name IN ({', '.join(_re(d) for d in fixed.GATES[c])})" if c in fixed.GATES else "o[1].name <> 'financial'" if c == "dob" else "true"
        parts.append(f"SELECT o[1].name AS doctype, '{c}' AS category FROM ({sql_found(c)}) JOIN (WITH {TEXTS}, {_doctype_ctes()} SELECT doc_id, o FROM classes) USING (doc_id) WHERE {gate}")
    label = next(x for _, r, x, _ in fixed.PATTERNS if r == "dob.labelled")
    good = "(NOT regexp_matches(matched, '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$') OR (CAST(regexp_extract(matched, '([0-9]{1,2})[/-][0-9]{1,2}[/-][0-9]{2,4}$', 1) AS INTEGER) BETWEEN 1 AND 12 AND CAST(regexp_extract(matched, '[0-9]{1,2}[/-]([0-9]{1,2})[/-][0-9]{2,4}$', 1) AS INTEGER) BETWEEN 1 AND 31))"
    parts.append(f"SELECT o[1].name AS doctype, 'dob' AS category FROM (WITH {TEXTS} {sql_spans(label, 'dob.labelled')}) JOIN (WITH {TEXTS}, {_doctype_ctes()} SELECT doc_id, o FROM classes) USING (doc_id) WHERE o[1].name = 'financial' AND {good}")
    return f"SELECT doctype, category, count(*) AS spans FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def queries() -> dict:
    out = {f"detect_{c}": _detector(c) for c in detect.CATEGORIES}
    return out | {f.__name__: f for f in (finding_counts, saved_patterns, saved_patterns_all, card_checks, classify_doctype, doctype_carry_over, gated_findings)}


def oracle_sql() -> dict:
    out = {f"detect_{c}": sql_found(c) for c in detect.CATEGORIES}
    return out | {"finding_counts": _counts_sql(), "saved_patterns": _saved_sql(), "card_checks": CHECKS_SQL, "classify_doctype": DOCTYPE_SQL, "doctype_carry_over": _carry_sql(), "gated_findings": _gated_sql()}
