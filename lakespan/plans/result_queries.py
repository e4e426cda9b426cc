"""Queries over results: filters, selection, counts, evaluation, audit records, the whole scan and the verification sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, normalize
from ..functions.spans import tokens
from ..operators import detect, doctype, report, results, scan, scoring, search, sweep
from ..sources.tables import corpus, table
from .detecting import TEXTS, _doctype_ctes, _re
from .scoring_queries import _ISLANDS, _cut_sql, _found, _sql_all

SOME = ["email", "phone", "creditCard", "ssn"]


def _some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, SOME).select("doc_id", "category", "rule", "start", "len", "matched", F.round("confidence", 6).alias("confidence"))


def result_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three categories from a confidence on, with what a selection of 75 % takes."""
    out = results.selected(results.filtered(_some(spark, sf_dir), ["email", "phone", "ssn"], least=0.5), "high")
    return out.select("doc_id", "category", "start", "confidence", "selected")


FILTERS_SQL = f"SELECT doc_id, category, start, confidence, confidence >= 0.75 AS selected FROM ({_sql_all(SOME)}) WHERE category <> 'creditCard' AND confidence >= 0.5"


def search_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 hits of a page (the cap is the feature)."""
    hits = search.literal(corpus(spark, sf_dir), "the").withColumn("category", F.lit("term"))
    return results.highlights(hits).select("doc_id", "start", "saturated")


HIGHLIGHTS_SQL = f"""WITH {TEXTS}, h AS (SELECT doc_id, unnest(list_filter(range(1, length(text) - 1), lambda i: lower(substr(text, i, 3)) = 'the')) - 1 AS start FROM (SELECT doc_id, text FROM texts WHERE contains(lower(text), 'the') AND length(text) < 20000)
UNION ALL SELECT doc_id, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 3 * (k - 1) AS start FROM (SELECT doc_id, unnest(string_split(lower(text), 'the')) AS p, generate_subscripts(string_split(lower(text), 'the'), 1) AS k, len(string_split(lower(text), 'the')) AS n FROM texts WHERE length(text) >= 20000) QUALIFY k < max(n) OVER (PARTITION BY doc_id))
SELECT doc_id, CAST(start AS INTEGER) AS start, n > 500 AS saturated FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM h) WHERE k <= 500"""


def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and distinct places of each document."""
    return results.occurrences(_found(spark, sf_dir, ["account", "ssn", "ein", "itin", "phone", "routingNumber", "npi", "creditCard"]))


OCCURRENCE_SQL = f"SELECT doc_id, count(*) AS spans, count(DISTINCT {{'s': start, 'l': len}}) AS occurrences FROM ({_sql_all(['account', 'ssn', 'ein', 'itin', 'phone', 'routingNumber', 'npi', 'creditCard'])}) GROUP BY doc_id"


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by frequency, then name, and whether a posterior applies to them."""
    return results.partitioned(results.category_counts(_found(spark, sf_dir, [*SOME, "account", "ein"])))


CATEGORY_COUNTS_SQL = f"SELECT category, count(*) AS spans, CAST(row_number() OVER (ORDER BY count(*) DESC, category) AS INTEGER) AS place, CASE WHEN category IN ('account', 'phone', 'mrn', 'ein', 'itin') THEN 'scored' ELSE 'plain' END AS family FROM ({_sql_all([*SOME, 'account', 'ein'])}) GROUP BY category"


def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and mean confidence of the lines under a region; order lines stand in for recognised ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).alias("start"), F.lit(8).alias("len"), F.col("l_discount").alias("confidence"))
    regions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(15).alias("start"), F.lit(20).alias("len"))
    return results.line_confidence(lines, regions).select("doc_id", "region", "least", F.round("mean", 6).alias("mean"))


LINE_CONFIDENCE_SQL = "SELECT o_orderkey AS doc_id, 15 AS region, min(l_discount) AS least, round(avg(l_discount), 6) AS mean FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber * 10 < 35 AND 15 < l_linenumber * 10 + 8 GROUP BY o_orderkey"


def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms from parts, each once; a boundary is needed if all entries need it."""
    return results.term_set(table(spark, sf_dir, "part").select(F.col("p_brand").alias("text"), (F.col("p_size") > 5).alias("needs_boundary")))


TERM_SETS_SQL = "SELECT p_brand AS text, bool_and(p_size > 5) AS needs_boundary FROM part WHERE trim(p_brand) <> '' GROUP BY p_brand"


def glyph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of characters of a line without wide gaps; order lines stand in for characters."""
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.floor(F.col("l_linenumber") / 4).cast("int").alias("line"), (F.col("l_linenumber") * 10).alias("x"), F.floor(F.col("l_quantity") / 5).cast("int").alias("width"))
    glyphs = glyphs.groupBy("doc_id", "line", "x").agg(F.max("width").alias("width"))
    return results.runs(glyphs).groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("glyphs"), F.min("x").alias("first"))


GLYPH_RUNS_SQL = """WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber // 4 AS line, l_linenumber * 10 AS x, max(CAST(floor(l_quantity / 5) AS INTEGER)) AS w FROM lineitem GROUP BY ALL),
o AS (SELECT *, CASE WHEN lag(x) OVER p IS NULL OR line <> lag(line) OVER p OR x - lag(x + w) OVER p >= lag(w) OVER p * 1.5 THEN 1 ELSE 0 END AS opens FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY line, x)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line, x) AS run FROM o) SELECT doc_id, CAST(run AS BIGINT) AS run, count(*) AS glyphs, CAST(min(x) AS INTEGER) AS first FROM r GROUP BY ALL"""


def positive_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn but for some sentinels."""
    t = F.transform(tokens(F.lower("text"), fixed.WHITE), lambda w: w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(results.positives(t, ["the", "and", "of"])).alias("words"))


POSITIVES_SQL = "SELECT conv_id, turn, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[^\\s]+')), lambda w: w NOT IN ('the', 'and', 'of'))) AS INTEGER) AS words FROM conversations"

_NEVER, _ALWAYS = ["jane.doe@example.com"], ["prescriber"]


def scan_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: detection, never-flag, overlap, cutoffs, always-flag."""
    out = scan.scanned(corpus(spark, sf_dir), [*SOME, "account", "routingNumber"], scoring.preset("balanced"), (_NEVER, []), (_ALWAYS, []))
    return out.withColumn("confidence", F.round("confidence", 6))


def _scan_sql() -> str:
    better = "CASE WHEN abs(p.confidence - f.confidence) > 0.02 THEN p.confidence > f.confidence ELSE p.rank > f.rank END"
    always = f"SELECT doc_id, unnest(list_filter(range(1, length(text) + 1), lambda i: lower(substr(text, i, {len(_ALWAYS[0])})) = '{_ALWAYS[0]}')) - 1 AS start, text FROM texts WHERE contains(lower(text), '{_ALWAYS[0]}')"
    return f"""WITH RECURSIVE {TEXTS}, a AS (SELECT * FROM ({_sql_all([*SOME, 'account', 'routingNumber'])}) WHERE lower(matched) <> '{_NEVER[0]}'), {_ISLANDS},
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY place) AS k FROM i),
fold AS (SELECT doc_id, island, k, place AS best, confidence, rank FROM p WHERE k = 1 UNION ALL SELECT p.doc_id, p.island, p.k, CASE WHEN {better} THEN p.place ELSE f.best END, CASE WHEN {better} THEN p.confidence ELSE f.confidence END, CASE WHEN {better} THEN p.rank ELSE f.rank END
 FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.island = f.island AND p.k = f.k + 1),
best AS (SELECT doc_id, island, arg_max(best, k) AS best FROM fold GROUP BY ALL), wide AS (SELECT doc_id, island, min(start) AS s0, max(e) AS e0 FROM i GROUP BY ALL)
SELECT i.doc_id, category, rule, CAST(s0 AS INTEGER) AS start, CAST(e0 - s0 AS INTEGER) AS len, matched, round(confidence, 6) AS confidence FROM i JOIN best ON i.doc_id = best.doc_id AND i.island = best.island AND place = best JOIN wide ON i.doc_id = wide.doc_id AND i.island = wide.island
WHERE coalesce(confidence >= {_cut_sql('balanced')}, true)
UNION ALL SELECT doc_id, 'user', 'user.alwaysFlag', CAST(start AS INTEGER), {len(_ALWAYS[0])}, substr(text, start + 1, {len(_ALWAYS[0])}), 1.0 FROM ({always})"""


_NEGATIVE = [("phone", "generic", "order", 0.4), ("phone", "generic", "license", 1.0), ("email", "generic", "the", 0.2), ("email", "court", "the", 1.0), ("ssn", "generic", "ssn", 0.5), ("creditCard", "generic", "a", 0.6), ("creditCard", "generic", "e", 0.3)]


def negative_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores lowered by the strongest keyword of a span's category and class around it; the keywords are invented."""
    words = spark.createDataFrame(_NEGATIVE, "category string, doctype string, keyword string, weight double")
    found = _found(spark, sf_dir, SOME).withColumn("doctype", F.lit("generic"))
    return scan.suppressed(found, words).select("doc_id", "category", "start", F.round("confidence", 5).alias("confidence"), "suppressed_by")


def _negative_sql() -> str:
    rows = ", ".join(f"('{c}', '{k}', {w})" for c, d, k, w in _NEGATIVE if d == "generic")
    return f"""WITH {TEXTS}, a AS ({_sql_all(SOME)}), k(category, word, weight) AS (VALUES {rows}),
b AS (SELECT a.*, lower(substr(text, greatest(start - 200, 0) + 1, start - greatest(start - 200, 0)) || ' ' || matched || ' ' || substr(text, start + len + 1, 200)) AS near FROM a JOIN texts USING (doc_id)),
c AS (SELECT doc_id, category, start, len, rule, confidence, (SELECT arg_max(k.word, k.weight) FROM k WHERE k.category = b.category AND contains(near, k.word)) AS suppressed_by, (SELECT max(k.weight) FROM k WHERE k.category = b.category AND contains(near, k.word)) AS w FROM b)
SELECT doc_id, category, start, round(CASE WHEN w IS NULL THEN confidence ELSE greatest(CASE category WHEN 'ssn' THEN 0.25 ELSE 0 END, confidence * greatest(0.25, 1 - w * 0.75)) END, 5) AS confidence, suppressed_by FROM c"""


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with or without a prefix, known to invented gazetteers."""
    surnames, given = spark.createDataFrame([("Bean",), ("Doe",), ("Smith",)], "word string"), spark.createDataFrame([("roy",), ("jane",)], "word string")
    return scan.names(corpus(spark, sf_dir), surnames, given).withColumn("confidence", F.round("confidence", 6))


_TERMS = ["license", "Released under", "jane.doe@example.com"]


def sweep_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in the bytes of outputs; each third output is in UTF-16."""
    wide = F.col("doc_id") % 3 == 0
    outputs = corpus(spark, sf_dir).select("doc_id", F.when(wide, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return sweep.swept(outputs, _TERMS).select("doc_id", "term", "encoding", "hits")


def _sweep_sql() -> str:
    from ..operators.redact import variants

    parts = []
    for t in _TERMS:
        hits = " + ".join(f"(length(text) - length(replace(text, {_re(v)}, ''))) // {len(v)}" for v in variants(t))
        parts.append(f"SELECT doc_id, '{t}' AS term, {hits} AS hits FROM texts")
    return f"WITH {TEXTS}, h AS ({' UNION ALL '.join(parts)}) SELECT doc_id, term, CASE WHEN doc_id % 3 = 0 THEN 'UTF-16BE' ELSE 'UTF-8' END AS encoding, CAST(hits AS INTEGER) AS hits FROM h WHERE hits > 0"


def sweep_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the sweep, known terms found, end marks, and characters that can still be read, for each output."""
    texts = corpus(spark, sf_dir)
    outputs = texts.select("doc_id", "text", F.encode(F.concat("text", F.expr("repeat('%%EOF', cast(abs(doc_id) % 3 as int))")), "UTF-8").alias("content"))
    states = sweep.sweep_status(outputs, _TERMS).withColumnRenamed("status", "sweep")
    marks = sweep.end_marks(outputs).select("doc_id", "marks", F.col("status").alias("ends"))
    left = sweep.readable(outputs.select("doc_id", "text")).select("doc_id", "characters")
    again = sweep.extracted_again(texts, ["Released under"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("again"))
    out = states.join(marks, "doc_id").join(sweep.known_terms(outputs, _TERMS), "doc_id").join(left, "doc_id").join(again, "doc_id", "left")
    return out.select("doc_id", "sweep", "terms", "marks", "ends", "found", "characters", F.coalesce("again", F.lit(0)).alias("again"))


def _states_sql() -> str:
    from ..operators.redact import variants

    hit = [" OR ".join(f"contains(text, {_re(v)})" for v in variants(t)) for t in _TERMS]
    n = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for h in hit)
    return f"""WITH {TEXTS}, h AS (SELECT doc_id, text, CAST({n} AS BIGINT) AS terms, CAST(abs(doc_id) % 3 + (length(text) - length(replace(text, '%%EOF', ''))) // 5 AS INTEGER) AS marks FROM texts)
SELECT doc_id, CASE WHEN terms > 0 THEN 'fail' ELSE 'pass' END AS sweep, terms, marks, CASE WHEN marks > 1 THEN 'fail' WHEN regexp_matches(text, '<[?]xpacket begin|<x:xmpmeta') THEN 'warn' ELSE 'pass' END AS ends, terms AS found,
 CAST(length(regexp_replace(text, '[\\s█]', '', 'g')) AS INTEGER) AS characters, CAST(CASE WHEN contains(lower(regexp_replace(text, '[\\s█]', '', 'g')), 'releasedunder') THEN 1 ELSE 0 END AS BIGINT) AS again FROM h"""


def character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that lost or gained characters, against what was meant to go; white space does not count."""
    texts = corpus(spark, sf_dir)
    after = texts.select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit("a"), F.lit(""))).when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit(" xyz"))).otherwise(F.col("text")).alias("text"))
    excluded = texts.where("doc_id % 8 = 1").select("doc_id", F.regexp_count("text", F.lit("a")).alias("n"))
    return sweep.counts(texts, after, excluded)


COUNTS_SQL = f"""WITH {TEXTS}, x AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 1 THEN replace(text, 'a', '') WHEN doc_id % 4 = 2 THEN text || ' xyz' ELSE text END AS t, CASE WHEN doc_id % 8 = 1 THEN length(text) - length(replace(text, 'a', '')) ELSE 0 END AS n FROM texts),
y AS (SELECT doc_id, length(regexp_replace(text, '[\\s█]', '', 'g')) - n AS expected, length(regexp_replace(t, '[\\s█]', '', 'g')) AS actual FROM x)
SELECT doc_id, CAST(expected AS INTEGER) AS expected, CAST(actual AS INTEGER) AS actual, CASE WHEN actual < expected THEN 'fail' WHEN actual > expected + 2 THEN 'warn' ELSE 'pass' END AS status FROM y"""


def explain_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest classes and up to five keywords, with log-probabilities and a softmax at another temperature."""
    rows = doctype.explained(doctype.classified(corpus(spark, sf_dir)))
    cold = doctype.classified(corpus(spark, sf_dir), temperature=0.5).select("doc_id", F.round(F.array_max("probabilities"), 5).alias("cold"))
    out = rows.select("doc_id", F.array_join(F.transform("top", lambda t: t["name"]), ",").alias("top"), F.array_join("top_keywords", ",").alias("keywords"), F.array_join("rules", ",").alias("rules"), F.round(F.array_max(doctype.log_probabilities()), 5).alias("log_p"))
    return out.join(cold, "doc_id")


def _explain_sql() -> str:
    cold = " + ".join(f"exp((-(o[{k + 1}].p) - greatest({', '.join(f'-(o[{j + 1}].p)' for j in range(len(fixed.DOCTYPES)))})) / 0.5)" for k in range(len(fixed.DOCTYPES)))
    return f"""WITH {TEXTS}, {_doctype_ctes()} SELECT doc_id, o[1].name || ',' || o[2].name || ',' || o[3].name AS top, array_to_string(k[1:5], ',') AS keywords, array_to_string(b, ',') AS rules, round(ln(p), 5) AS log_p, round(1 / ({cold}), 5) AS cold FROM classes"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from findings: those of even documents, each fifth of them to be left alone."""
    found = _found(spark, sf_dir, SOME).where("doc_id % 2 = 0")
    return found.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "court").otherwise("generic").alias("doctype"), F.concat(F.lit("b"), (F.abs("doc_id") % 2 + F.abs("doc_id") % 4).cast("string")).alias("bucket"), "category", "start", "len", F.when(F.col("start") % 5 == 0, "suppress").alias("outcome"))


def evaluation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the strict preset against labels, by category, class and bucket."""
    found = scoring.thresholded(_found(spark, sf_dir, SOME), scoring.preset("conservative"))
    return report.evaluation_cells(found.where("start % 7 != 0"), _truth(spark, sf_dir))


CELLS_SQL = f"""WITH a AS ({_sql_all(SOME)}), f AS (SELECT DISTINCT doc_id, category, start, start + len AS e FROM a WHERE confidence >= {_cut_sql('conservative')} AND start % 7 <> 0),
t AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'court' ELSE 'generic' END AS doctype, 'b' || (abs(doc_id) % 2 + abs(doc_id) % 4) AS bucket, category, start, start + len AS e, start % 5 = 0 AS quiet FROM a WHERE doc_id % 2 = 0),
h AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.doc_id = t.doc_id AND f.category = t.category AND f.start < t.e AND t.start < f.e) AS hit FROM t),
x AS (SELECT f.category, d.doctype, d.bucket FROM f JOIN (SELECT DISTINCT doc_id, doctype, bucket FROM t) d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM t WHERE f.doc_id = t.doc_id AND f.category = t.category AND f.start < t.e AND t.start < f.e)),
u AS (SELECT category, doctype, bucket, CASE WHEN hit AND NOT quiet THEN 1 ELSE 0 END AS a, CASE WHEN NOT hit AND NOT quiet THEN 1 ELSE 0 END AS b, 0 AS c, CASE WHEN quiet THEN 1 ELSE 0 END AS d, CASE WHEN quiet AND NOT hit THEN 1 ELSE 0 END AS g FROM h UNION ALL SELECT category, doctype, bucket, 0, 0, 1, 0, 0 FROM x)
SELECT category, doctype, bucket, CAST(sum(a) AS BIGINT) AS true_positives, CAST(sum(b) AS BIGINT) AS false_negatives, CAST(sum(c) AS BIGINT) AS false_positives, CAST(sum(d) AS BIGINT) AS suppress_total, CAST(sum(g) AS BIGINT) AS suppress_fired FROM u GROUP BY ALL"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with invented states of a review."""
    return _some(spark, sf_dir).withColumns({"applied": F.col("start") % 3 == 0, "selected": F.col("start") % 2 == 0, "suppressed": F.col("start") % 11 == 0})


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, pages, applied, deselected, below the cutoff and suppressed, by category and in all."""
    return report.scan_report(_states(spark, sf_dir), scoring.preset("balanced"))


_REPORT = f"count(*) AS candidates, count(DISTINCT doc_id) AS pages, count(*) FILTER (start % 3 = 0) AS applied, count(*) FILTER (start % 2 <> 0 AND start % 11 <> 0 AND NOT confidence < {_cut_sql('balanced')}) AS deselected, count(*) FILTER (confidence < {_cut_sql('balanced')}) AS below, count(*) FILTER (start % 11 = 0) AS suppressed"
REPORT_SQL = f"WITH a AS ({_sql_all(SOME)}) SELECT category, {_REPORT} FROM a GROUP BY category UNION ALL SELECT NULL, {_REPORT} FROM a"


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 19 columns of an audit record, without sensitive texts."""
    return report.audit_records(_states(spark, sf_dir).withColumn("base", F.col("confidence")), scoring.preset("balanced"), manifest="1")


def _audit_sql() -> str:
    catalogue = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in fixed.CATALOGUE.items()) + " ELSE '' END"
    safe = lambda x: f"CASE WHEN regexp_matches({x}, '^[=+@\\t\\r-]') THEN '''' || {x} ELSE {x} END"
    masked = "CASE WHEN length(matched) <= 4 THEN '…' ELSE left(matched, 2) || '…' || right(matched, 2) END"
    checked = ", ".join(f"'{r}'" for r in sorted(detect.VALID))
    flag = lambda x: f"CASE WHEN {x} THEN 'true' ELSE 'false' END"
    return f"""SELECT sha256(concat_ws('|', doc_id, start, len, category)) AS id, {safe('CAST(doc_id AS VARCHAR)')} AS "pageIndex", {safe(masked)} AS "matchedText", 'textLayer' AS source, category AS "piiCategory", printf('%.4f', confidence) AS "piiConfidence",
 category AS term, rule AS "ruleID", {catalogue} AS "ruleVersion", '1' AS "gazetteerManifestVersion", printf('%.4f', confidence) AS "finalScore", printf('%.4f', CAST({_cut_sql('balanced')} AS DOUBLE)) AS "appliedThreshold",
 'regex(' || rule || ')' || CASE WHEN rule IN ({checked}) THEN '; validator(' || rule || ')' ELSE '' END AS "rationaleSummary", {flag('start % 2 = 0')} AS "isSelected", {flag('start % 3 = 0')} AS "wasApplied", {flag('start % 11 = 0')} AS "suppressedByOverlap",
 '' AS "foiaExemption", '' AS "foiaCitation", '' AS "foiaNote" FROM ({_sql_all(SOME)})"""


def live_and_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live results completed by the snapshots of applied ones."""
    found = _some(spark, sf_dir)
    return report.with_snapshots(found.where("start % 2 = 0"), found.where("start % 3 = 0").withColumn("confidence", F.lit(0.5)))


SNAPSHOTS_SQL = f"""WITH a AS (SELECT concat_ws('|', doc_id, start, len, category) AS fingerprint, start, confidence FROM ({_sql_all(SOME)}))
SELECT fingerprint, CASE WHEN start % 2 = 0 THEN confidence ELSE 0.5 END AS confidence, start % 3 = 0 AS applied FROM a WHERE start % 2 = 0 OR start % 3 = 0"""


def name_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadows of texts: as long as the text, with words in capitals in title case."""
    rows = corpus(spark, sf_dir).withColumn("shadow", normalize.shadow(F.col("text")))
    return rows.select("doc_id", F.length("shadow").alias("length"), (F.length("shadow") == F.length("text")).alias("same"), F.regexp_count("shadow", F.lit("[:;,/]")).alias("separators"))


SHADOW_SQL = f"WITH {TEXTS} SELECT doc_id, CAST(length(text) AS INTEGER) AS length, true AS same, 0 AS separators FROM texts"


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same findings by SQL: views and the table function over texts with an @."""
    scan.register_views(spark, corpus(spark, sf_dir))
    return spark.sql("SELECT doc_id, d.category, d.matched FROM (SELECT doc_id, spans_of(text, 'email') AS a FROM lakespan_texts WHERE contains(text, '@')) LATERAL VIEW inline(a) d")


_QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (result_filters, FILTERS_SQL), (search_highlights, HIGHLIGHTS_SQL), (occurrence_counts, OCCURRENCE_SQL), (category_counts, CATEGORY_COUNTS_SQL), (line_confidence, LINE_CONFIDENCE_SQL),
        (term_sets, TERM_SETS_SQL), (glyph_runs, GLYPH_RUNS_SQL), (positive_words, POSITIVES_SQL), (scan_categories, _scan_sql()), (negative_context, _negative_sql()), (known_names, None),
        (sweep_terms, _sweep_sql()), (sweep_states, _states_sql()), (character_counts, COUNTS_SQL), (explain_doctype, _explain_sql()), (evaluation_cells, CELLS_SQL), (scan_report, REPORT_SQL),
        (audit_records, _audit_sql()), (live_and_applied, SNAPSHOTS_SQL), (name_shadow, SHADOW_SQL), (sql_surface, f"SELECT doc_id, 'email' AS category, matched FROM ({_sql_all(['email'])})"),
    )
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
