"""Queries over scored spans: posterior, thresholds, overlaps, entities, reports. The SQL starts from spans found in its own way."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, fixed
from ..operators import detect, entities, overlap, redact, report, scoring, terms
from ..sources import scratch, sinks
from ..sources.tables import corpus, table
from .detecting import TEXTS, _any, _doctype_ctes, _re, sql_found

#: Categories of the queries over spans that meet; the queries named ..._all run over all 17.
MEETING = ["ssn", "ein", "itin", "creditCard", "phone", "routingNumber", "npi", "account", "email", "dob", "mrn"]


def _found(spark: SparkSession, sf_dir: str, categories: list[str] | None = None) -> DataFrame:
    return detect.detected(corpus(spark, sf_dir), categories)


def _sql_all(categories: list[str] | None = None) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS category, * FROM ({sql_found(c)})" for c in categories or detect.CATEGORIES)


def _rank_sql(column: str = "category") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{c}' THEN {r}" for c, r in fixed.RANKS.items()) + " ELSE 0 END"


def _cut_sql(preset: str, column: str = "category") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{c}' THEN {v}" for c, v in fixed.PRESETS[preset].items()) + " END"


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans kept and dropped by each preset."""
    table_ = [(name, c, v) for name in fixed.PRESETS for c, v in scoring.preset(name).items()]
    dim = F.broadcast(spark.createDataFrame(table_, "preset string, category string, cutoff double"))
    rows = _found(spark, sf_dir).select("category", "confidence").join(dim, "category")
    return rows.groupBy("preset", "category").agg(F.count_if(F.col("confidence") >= F.col("cutoff")).alias("kept"), F.count_if(F.col("confidence") < F.col("cutoff")).alias("dropped"))


THRESHOLDS_SQL = f"WITH a AS ({_sql_all()}) " + " UNION ALL ".join(f"SELECT category, count(*) FILTER (confidence >= {_cut_sql(p)}) AS kept, count(*) FILTER (confidence < {_cut_sql(p)}) AS dropped, '{p}' AS preset FROM a GROUP BY category" for p in fixed.PRESETS)


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the spans whose families carry a context term, under their text's class."""
    from ..operators import doctype

    # texts are classified where something was found in them, and nowhere else
    texts = corpus(spark, sf_dir)
    found = scratch.written(detect.detected(texts, ["account", "phone", "ein", "itin", "mrn"]), "found")
    classes = doctype.classified(texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", F.col("primary").alias("doctype"))
    found = found.join(classes, "doc_id")
    out = scoring.composed(found, "doctype")
    return out.select("doc_id", "category", "rule", "start", "len", F.round("confidence", 6).alias("confidence"), F.round("posterior", 5).alias("posterior"))


def _posterior_sql() -> str:
    fams = scoring._families()

    def nearest(words: list[str]) -> str:
        gaps = []
        for w in words:
            gaps += [f"CASE WHEN contains(lb, {_re(w)}) THEN strpos(reverse(lb), {_re(w[::-1])}) - 1 END", f"CASE WHEN contains(la, {_re(w)}) THEN strpos(la, {_re(w)}) - 1 END", f"CASE WHEN contains(lower(matched), {_re(w)}) THEN 0 END"]
        return f"coalesce(1.0 / (1.0 + list_min([{', '.join(gaps)}]) / 10.0), 0.0)" if words else "0.0"

    win = r"'[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
    toks = lambda t: f"list_filter(string_split_regex({t}, {win}), lambda x: x <> '')"
    feats = {c: [f"CASE WHEN {_any('w5', p)} THEN 1.0 ELSE 0.0 END", f"CASE WHEN {_any('w5', n)} THEN 1.0 ELSE 0.0 END", nearest(p), nearest(n)] for c, (p, n) in fams.items()}
    common = ["CAST(length(regexp_replace(matched, '[^\\p{N}]', '', 'g')) AS DOUBLE)", "CASE WHEN regexp_matches(matched, '[^\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END", "CASE WHEN regexp_matches(tb[-1], '[:#]$') THEN 1.0 ELSE 0.0 END", "CASE WHEN regexp_matches(before, '[\\n\\r][\\t \\x{A0}]*$') OR (start <= 200 AND regexp_matches(before, '^[\\t \\x{A0}]*$')) THEN 1.0 ELSE 0.0 END"] + [f"CASE WHEN doctype = '{d}' THEN 1.0 ELSE 0.0 END" for d in fixed.DOCTYPES]
    context = []
    for c, w in fixed.CONTEXT_WEIGHTS.items():
        total = " + ".join(f"(({x}) - {m}) / {s} * {k}" for x, m, s, k in zip(feats[c] + common, w["means"], w["scales"], w["weights"], strict=True) if k)
        context.append(f"WHEN category = '{c}' THEN {w['bias']} + {total}")
    logit = "ln(least(greatest(confidence, 1e-6), 1 - 1e-6) / (1 - least(greatest(confidence, 1e-6), 1 - 1e-6)))"
    return f"""WITH {TEXTS}, {_doctype_ctes()}, a AS ({_sql_all(['account', 'phone', 'ein', 'itin', 'mrn'])}),
b AS (SELECT a.*, o[1].name AS doctype, substr(text, greatest(start - 200, 0) + 1, least(start, 200)) AS before, substr(text, start + len + 1, 200) AS after FROM a JOIN texts USING (doc_id) JOIN classes USING (doc_id)),
c AS (SELECT *, lower(before) AS lb, lower(after) AS la, {toks('before')} AS tb, lower(array_to_string({toks('before')}[-5:], ' ') || ' ' || array_to_string({toks('after')}[1:5], ' ')) AS w5 FROM b),
d AS (SELECT *, 1 / (1 + exp(-({logit} + CASE {' '.join(context)} ELSE 0 END))) AS post FROM c)
SELECT doc_id, category, rule, start, len, confidence, round(CASE WHEN category IN ('account', 'phone') AND confidence >= 0.7 THEN greatest(post, least(confidence, {_cut_sql('conservative')})) ELSE post END, 5) AS posterior FROM d"""


def _meeting(spark: SparkSession, sf_dir: str, categories: list[str]) -> DataFrame:
    return _found(spark, sf_dir, categories).select("doc_id", "category", "rule", "start", "len", "matched", F.round("confidence", 6).alias("confidence"))


_ISLANDS = f"""r AS (SELECT *, start + len AS e, {_rank_sql()} AS rank FROM a),
o AS (SELECT *, row_number() OVER w AS place, CASE WHEN start >= max(e) OVER (PARTITION BY doc_id ORDER BY start, rank DESC, rule, matched ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY start, rank DESC, rule, matched)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM o)"""


def overlap_scan(spark: SparkSession, sf_dir: str, categories: list[str] = MEETING) -> DataFrame:
    """Winners by cutoff and posterior (here the confidence), widened to their island."""
    found = _meeting(spark, sf_dir, categories)
    dim = F.broadcast(scoring.cutoffs(spark, scoring.preset("balanced")))
    rows = found.join(dim, "category").withColumn("meets", F.col("confidence") >= F.col("cutoff")).withColumn("posterior", F.col("confidence"))
    return overlap.survivors(overlap.resolved_by_posterior(rows)).select("doc_id", "category", "rule", "start", "len", "matched")


def _scan_sql(categories: list[str]) -> str:
    return f"""WITH a AS ({_sql_all(categories)}), {_ISLANDS},
s AS (SELECT *, min(start) OVER p AS s0, max(e) OVER p AS e0, row_number() OVER (PARTITION BY doc_id, island ORDER BY confidence >= {_cut_sql('balanced')} DESC, confidence DESC, rank DESC, place) AS n FROM i WINDOW p AS (PARTITION BY doc_id, island))
SELECT doc_id, category, rule, s0 AS start, e0 - s0 AS len, matched FROM s WHERE n = 1"""


def overlap_search(spark: SparkSession, sf_dir: str, categories: list[str] = MEETING) -> DataFrame:
    """Winners by confidence with a tolerance, else rank, folded in order."""
    return overlap.survivors(overlap.resolved_by_confidence(_meeting(spark, sf_dir, categories))).select("doc_id", "category", "rule", "start", "len", "matched")


def _search_sql(categories: list[str]) -> str:
    return f"""WITH RECURSIVE a AS ({_sql_all(categories)}), {_ISLANDS},
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY place) AS k FROM i),
fold AS (SELECT doc_id, island, k, place AS best, confidence, rank FROM p WHERE k = 1
 UNION ALL SELECT p.doc_id, p.island, p.k, CASE WHEN CASE WHEN abs(p.confidence - f.confidence) > 0.02 THEN p.confidence > f.confidence ELSE p.rank > f.rank END THEN p.place ELSE f.best END,
  CASE WHEN CASE WHEN abs(p.confidence - f.confidence) > 0.02 THEN p.confidence > f.confidence ELSE p.rank > f.rank END THEN p.confidence ELSE f.confidence END,
  CASE WHEN CASE WHEN abs(p.confidence - f.confidence) > 0.02 THEN p.confidence > f.confidence ELSE p.rank > f.rank END THEN p.rank ELSE f.rank END FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.island = f.island AND p.k = f.k + 1),
best AS (SELECT doc_id, island, arg_max(best, k) AS best FROM fold GROUP BY ALL), range AS (SELECT doc_id, island, min(start) AS s0, max(e) AS e0 FROM i GROUP BY ALL)
SELECT doc_id, category, rule, s0 AS start, e0 - s0 AS len, matched FROM i JOIN best USING (doc_id, island) JOIN range USING (doc_id, island) WHERE place = best"""


def overlap_suppressed(spark: SparkSession, sf_dir: str, categories: list[str] = MEETING) -> DataFrame:
    return overlap.suppressed_counts(overlap.resolved_by_confidence(_meeting(spark, sf_dir, categories)))


def _suppressed_sql(categories: list[str]) -> str:
    search = _search_sql(categories)
    return search[: search.rindex("SELECT doc_id, category")] + """, w AS (SELECT i.* FROM i JOIN best USING (doc_id, island) WHERE place = best)
SELECT l.category, count(*) AS suppressed FROM i l JOIN w USING (doc_id, island) WHERE l.place <> w.place AND NOT (l.start = w.start AND l.e = w.e AND l.category = w.category) GROUP BY l.category"""


def merged_spans(spark: SparkSession, sf_dir: str, categories: list[str] = MEETING) -> DataFrame:
    """All spans merged where at most three characters part them."""
    return overlap.merged(_meeting(spark, sf_dir, categories), gap=3)


def _merged_sql(categories: list[str]) -> str:
    return f"""WITH a AS ({_sql_all(categories)}), r AS (SELECT doc_id, start, len, start + len AS e FROM a),
o AS (SELECT *, CASE WHEN start > max(e) OVER (PARTITION BY doc_id ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 OR row_number() OVER (PARTITION BY doc_id ORDER BY start, len) = 1 THEN 1 ELSE 0 END AS opens FROM r),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, len ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT doc_id, min(start) AS start, max(e) - min(start) AS len, count(*) AS n FROM i GROUP BY doc_id, run"""


def cross_page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal findings, a row for each document of a group, with the group's size."""
    found = scratch.written(_found(spark, sf_dir, ["email", "phone", "creditCard", "ssn", "name"]).select("doc_id", "category", "matched"), "found")
    return entities.memberships(found)


GROUPS_SQL = f"""WITH a AS ({_sql_all(['email', 'phone', 'creditCard', 'ssn', 'name'])}), c AS (SELECT *, regexp_replace(lower(matched), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g') AS canonical FROM a)
, p AS (SELECT category, canonical, doc_id, count(*) AS spans FROM c WHERE canonical <> '' GROUP BY ALL)
SELECT *, CAST(sum(spans) OVER w AS BIGINT) AS members, count(*) OVER w AS pages FROM p WINDOW w AS (PARTITION BY category, canonical) QUALIFY members >= 2"""

_NAMES = "SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'John Smith' WHEN 1 THEN 'J. Smith' WHEN 2 THEN 'Smith' WHEN 3 THEN 'Mary Jones' WHEN 4 THEN 'Maria Jones' WHEN 5 THEN 'Jones' ELSE c_name END AS name FROM customer"


def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of names made from customer keys."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("lakespan_customer")
    names = spark.sql(_NAMES.replace("FROM customer", "FROM lakespan_customer"))
    return entities.clusters(names)


NAME_CLUSTERS_SQL = f"""WITH RECURSIVE n AS ({_NAMES}), t AS (SELECT id, name, list_filter(string_split_regex(trim(name), '[\\s,]+'), lambda x: x <> '') AS k FROM n),
p AS (SELECT id, name, lower(k[-1]) AS surname, CASE WHEN len(k) > 1 THEN lower(k[1][1]) END AS initial FROM t),
f AS (SELECT surname, initial, name, min(id) AS node FROM p GROUP BY ALL),
sim AS (SELECT a.node AS a, b.node AS b FROM f a JOIN f b ON a.surname = b.surname AND a.node <> b.node AND (a.initial = b.initial OR jaro_winkler_similarity(lower(a.name), lower(b.name)) >= 0.7
  OR jaro_winkler_similarity(lower(array_to_string(list_sort(string_split(a.name, ' ')), ' ')), lower(array_to_string(list_sort(string_split(b.name, ' ')), ' '))) >= 0.7)),
reach AS (SELECT node AS a, node AS b FROM f UNION SELECT reach.a, sim.b FROM reach JOIN sim ON reach.b = sim.a),
c AS (SELECT a AS node, min(b) AS cluster FROM reach GROUP BY a), x AS (SELECT id, p.initial AS initial, cluster FROM p JOIN f ON p.surname = f.surname AND p.initial IS NOT DISTINCT FROM f.initial AND p.name = f.name JOIN c USING (node))
SELECT id, cluster, count(*) OVER w >= 15 AND max(initial) OVER w IS NULL AS ambiguous FROM x WINDOW w AS (PARTITION BY cluster)"""


def never_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, ["email", "phone", "name"])
    return terms.never_flagged(found, ["Jane.Doe@example.com", "john smith"], [r"[0-9().+ -]*0147"]).select("doc_id", "rule", "start", "matched")


NEVER_FLAG_SQL = f"""WITH a AS ({_sql_all(['email', 'phone', 'name'])}) SELECT doc_id, rule, start, matched FROM a
WHERE trim(regexp_replace(lower(matched), '\\s+', ' ', 'g')) NOT IN ('jane.doe@example.com', 'john smith') AND NOT regexp_full_match(matched, '[0-9().+ -]*0147')"""


def redact_text(spark: SparkSession, sf_dir: str, categories: list[str] = MEETING) -> DataFrame:
    """Texts without what the balanced preset keeps of the categories, with counts."""
    found = scoring.thresholded(_found(spark, sf_dir, categories), scoring.preset("balanced"))
    return redact.redacted(corpus(spark, sf_dir), found)


def _redact_sql(categories: list[str]) -> str:
    return f"""WITH RECURSIVE {TEXTS}, a AS ({_sql_all(categories)}), k AS (SELECT doc_id, start, len FROM a WHERE confidence >= {_cut_sql('balanced')}),
chars AS (SELECT DISTINCT doc_id, unnest(range(start, start + len)) AS i FROM k), hit AS (SELECT doc_id, list(i) AS cut FROM chars GROUP BY doc_id)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN list_contains(cut, i - 1) THEN '█' ELSE substr(text, i, 1) END), '') END AS text,
 CAST(coalesce(len(cut), 0) AS INTEGER) AS excluded, CAST(length(text) - coalesce(len(cut), 0) AS INTEGER) AS surviving FROM texts LEFT JOIN hit USING (doc_id)"""


def verify_layers(spark: SparkSession, sf_dir: str, categories: list[str] = MEETING) -> DataFrame:
    """Status of each layer and verdict of each document that had a finding of the categories; the terms are two that redaction leaves."""
    texts = corpus(spark, sf_dir)
    found = scratch.written(scoring.thresholded(_found(spark, sf_dir, categories), scoring.preset("balanced")).select("doc_id", "start", "len"), "found")
    own = texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    out = scratch.written(redact.redacted(own, found), "redacted")
    digests = scratch.written(redact.digest(own, out), "digests")
    results = redact.layers(own, found, out, digests, ["jane.doe@example.com", "prescriber", "bank"])
    verdicts = redact.verdict(results).select("doc_id", F.lit("verdict").alias("layer"), "status")
    return results.select("doc_id", "layer", "status").unionByName(verdicts)


def _verify_sql(categories: list[str]) -> str:
    return f"""WITH {TEXTS}, a AS ({_sql_all(categories)}), k AS (SELECT doc_id, start, len FROM a WHERE confidence >= {_cut_sql('balanced')}),
chars AS (SELECT DISTINCT doc_id, unnest(range(start, start + len)) AS i FROM k), hit AS (SELECT doc_id, list(i) AS cut FROM chars GROUP BY doc_id),
o AS (SELECT doc_id, array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN list_contains(cut, i - 1) THEN '█' ELSE substr(text, i, 1) END), '') AS t FROM texts JOIN hit USING (doc_id)),
s AS (SELECT doc_id, list_bool_or(list_transform(['jane.doe@example.com', 'JANE.DOE@EXAMPLE.COM', 'Jane.Doe@Example.Com', 'prescriber', 'PRESCRIBER', 'Prescriber', 'bank', 'BANK', 'Bank'], lambda x: contains(t, x))) AS left_ FROM o)
SELECT doc_id, 'terms' AS layer, CASE WHEN left_ THEN 'attention' ELSE 'pass' END AS status FROM s UNION ALL SELECT doc_id, unnest(['ranges', 'counts', 'lineage']), 'pass' FROM s UNION ALL SELECT doc_id, 'verdict', CASE WHEN left_ THEN 'attention' ELSE 'pass' END FROM s"""


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.broadcast(scoring.cutoffs(spark, scoring.preset("balanced")))
    out = report.coverage(_found(spark, sf_dir).join(dim, "category"))
    return sinks.coverage_lines(out)


COVERAGE_SQL = f"""WITH a AS ({_sql_all()}), r AS (SELECT coalesce(category, 'all') AS category, count(*) AS candidates, count(DISTINCT doc_id) AS documents, count(*) FILTER (confidence < {_cut_sql('balanced')}) AS below FROM a GROUP BY ROLLUP (category))
SELECT category || '.candidates' AS metric, candidates AS value FROM r UNION ALL SELECT category || '.documents', documents FROM r UNION ALL SELECT category || '.below', below FROM r"""


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(_found(spark, sf_dir))


HISTOGRAM_SQL = f"WITH a AS (SELECT *, least(greatest(floor(round(confidence * 5, 9)), 0), 4) AS band FROM ({_sql_all()})) SELECT category, " + ", ".join(f"count(*) FILTER (band = {b}) AS band{b}" for b in range(5)) + " FROM a GROUP BY category"


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict preset loses against the balanced one; the detectors run once."""
    found = scratch.written(_found(spark, sf_dir).select("doc_id", "category", "start", "len", "confidence"), "found")
    return report.run_difference(scoring.thresholded(found, scoring.preset("balanced")), scoring.thresholded(found, scoring.preset("conservative")))


RUN_DIFF_SQL = f"""WITH a AS ({_sql_all()}), f AS (SELECT concat_ws('|', doc_id, start, len, category) AS fingerprint, bool_or(confidence >= {_cut_sql('balanced')}) AS x, bool_or(confidence >= {_cut_sql('conservative')}) AS y FROM a GROUP BY 1)
SELECT fingerprint, CASE WHEN x AND y THEN 'unchanged' WHEN x THEN 'removed' ELSE 'added' END AS change FROM f WHERE x OR y"""


def audit_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.audit(_found(spark, sf_dir, ["email", "phone", "creditCard", "ssn", "npi", "account"]))
    return out.select("doc_id", "category", "rule", "catalogue", "start", "len", "masked", "confidence", "fingerprint")


def _audit_sql() -> str:
    cat = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in fixed.CATALOGUE.items()) + " END"
    mask = "CASE WHEN length(matched) <= 4 THEN '…' ELSE left(matched, 2) || '…' || right(matched, 2) END"
    return f"""WITH a AS (SELECT *, {mask} AS m FROM ({_sql_all(['email', 'phone', 'creditCard', 'ssn', 'npi', 'account'])}))
SELECT doc_id, category, rule, {cat} AS catalogue, start, len, CASE WHEN regexp_matches(m, '^[=+@\\t\\r-]') THEN '''' || m ELSE m END AS masked, confidence, sha256(concat_ws('|', doc_id, start, len, category)) AS fingerprint FROM a"""


def eval_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict findings scored against the balanced ones as if those were labels; the detectors run once."""
    found = scratch.written(_found(spark, sf_dir).select("doc_id", "category", "start", "len", "confidence"), "found")
    truth = scoring.thresholded(found, scoring.preset("balanced")).where(F.col("len") > 9)
    return report.evaluation(scoring.thresholded(found, scoring.preset("conservative")), truth)


EVAL_SQL = f"""WITH a AS ({_sql_all()}), t AS (SELECT DISTINCT doc_id, category, start, start + len AS e FROM a WHERE confidence >= {_cut_sql('balanced')} AND len > 9), f AS (SELECT DISTINCT doc_id, category, start, start + len AS e FROM a WHERE confidence >= {_cut_sql('conservative')}),
h AS (SELECT t.*, EXISTS (SELECT 1 FROM f WHERE f.doc_id = t.doc_id AND f.category = t.category AND f.start < t.e AND t.start < f.e) AS hit FROM t), x AS (SELECT f.*, EXISTS (SELECT 1 FROM t WHERE f.doc_id = t.doc_id AND f.category = t.category AND f.start < t.e AND t.start < f.e) AS hit FROM f),
c AS (SELECT category, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, 0 AS fp FROM h GROUP BY 1 UNION ALL SELECT category, 0, 0, count(*) FILTER (NOT hit) FROM x GROUP BY 1)
SELECT category, CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(fn) AS BIGINT) AS false_negatives, CAST(sum(fp) AS BIGINT) AS false_positives FROM c GROUP BY category HAVING sum(tp) + sum(fn) + sum(fp) > 0 OR category IN (SELECT category FROM t)"""


def covered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone and account spans that no card span covers."""
    found = _found(spark, sf_dir, ["phone", "account", "creditCard", "ssn"])
    return redact.uncovered(found.where("category IN ('phone', 'account')"), found.where("category IN ('creditCard', 'ssn')")).select("doc_id", "rule", "start", "len")


COVERED_SQL = f"""WITH a AS ({_sql_all(['phone', 'account', 'creditCard', 'ssn'])}) SELECT doc_id, rule, start, len FROM a n WHERE category IN ('phone', 'account') AND NOT EXISTS (SELECT 1 FROM a c WHERE c.category IN ('creditCard', 'ssn') AND c.doc_id = n.doc_id
 AND c.start < n.start + n.len AND n.start < c.start + c.len AND (least(n.start + n.len, c.start + c.len) - greatest(n.start, c.start)) / n.len > 0.8)"""


def nearest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The email or card nearest to each phone number, within 400 characters."""
    found = _found(spark, sf_dir, ["phone", "email", "creditCard"])
    points = found.where("category = 'phone'").select("doc_id", F.col("start").alias("at")).distinct()
    return redact.nearest(points, found.where("category != 'phone'"), 400)


NEAREST_SQL = f"""WITH a AS ({_sql_all(['phone', 'email', 'creditCard'])}), p AS (SELECT DISTINCT doc_id, start AS x FROM a WHERE category = 'phone'), d AS (SELECT p.doc_id, p.x, a.start, greatest(a.start - x, x - (a.start + a.len), 0) AS distance FROM p JOIN a ON a.doc_id = p.doc_id AND a.category <> 'phone')
SELECT doc_id, x AS "at", start, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY distance, start) AS n FROM d WHERE distance <= 400) WHERE n = 1"""


def zip_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP codes made from keys, with their states."""
    rows = table(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") * 61 % 100000).cast("string"), 5, "0").alias("zip"))
    rows = rows.unionByName(spark.createDataFrame([(z,) for z in fixed.ZIP_OVERRIDES], "zip string"))
    return rows.select("zip", checks.zip_state(F.col("zip")).alias("state"))


ZIP_SQL = f"""WITH z AS (SELECT lpad(CAST(c_custkey * 61 % 100000 AS VARCHAR), 5, '0') AS zip FROM customer UNION ALL SELECT unnest([{', '.join(_re(z) for z in fixed.ZIP_OVERRIDES)}])), t(a, e, s) AS (VALUES {', '.join(f"({a}, {e}, '{s}')" for a, e, s in fixed.ZIP_RANGES)}), o(z, s) AS (VALUES {', '.join(f"('{z}', '{s}')" for z, s in fixed.ZIP_OVERRIDES.items())})
SELECT zip, coalesce(o.s, t.s) AS state FROM z LEFT JOIN o ON o.z = zip LEFT JOIN t ON CAST(left(zip, 3) AS INTEGER) BETWEEN a AND e"""

_DECISIONS = "SELECT event_type AS category, ts, event_id AS id, (event_id * 7919) % 11 < 7 AS accepted FROM events"


def priors_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as categories, their events as decisions in order."""
    table(spark, sf_dir, "events").createOrReplaceTempView("lakespan_events")
    out = report.priors(spark.sql(_DECISIONS.replace("FROM events", "FROM lakespan_events")))
    return out.select("category", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("mean", 6).alias("mean"), F.col("decisions").cast("long").alias("decisions"))


PRIORS_SQL = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts, id) AS k FROM ({_DECISIONS})),
f AS (SELECT category, 0::BIGINT AS k, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0 AS side, 0 AS streak FROM (SELECT DISTINCT category FROM d)
UNION ALL SELECT category, k, CASE WHEN skip THEN a WHEN a + da + b + db > 50 THEN greatest(1.0, (a + da) * 50.0 / (a + da + b + db)) ELSE a + da END, CASE WHEN skip THEN b WHEN a + da + b + db > 50 THEN greatest(1.0, (b + db) * 50.0 / (a + da + b + db)) ELSE b + db END,
 CASE WHEN skip THEN side ELSE way END, CASE WHEN skip THEN streak WHEN side = way THEN least(streak + 1, 255) ELSE 1 END
 FROM (SELECT f.category, d.k, f.a, f.b, f.side, f.streak, CASE WHEN accepted THEN 1 ELSE -1 END AS way, CASE WHEN accepted THEN 1.0 ELSE 0.0 END AS da, CASE WHEN accepted THEN 0.0 ELSE 1.0 END AS db, f.streak >= 5 AND f.side = CASE WHEN accepted THEN 1 ELSE -1 END AS skip FROM f JOIN d ON d.category = f.category AND d.k = f.k + 1))
SELECT category, round(arg_max(a, k), 6) AS alpha, round(arg_max(b, k), 6) AS beta, round(0.95 * arg_max(a, k) / (arg_max(a, k) + arg_max(b, k)) + 0.025, 6) AS mean, max(k) AS decisions FROM f GROUP BY category"""

_QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (thresholds, THRESHOLDS_SQL), (posterior, _posterior_sql()), (overlap_scan, _scan_sql(MEETING)), (overlap_search, _search_sql(MEETING)), (overlap_suppressed, _suppressed_sql(MEETING)),
        (merged_spans, _merged_sql(MEETING)), (cross_page_groups, GROUPS_SQL), (name_clusters, NAME_CLUSTERS_SQL), (never_flag, NEVER_FLAG_SQL), (redact_text, _redact_sql(MEETING)),
        (verify_layers, _verify_sql(MEETING)), (coverage_report, COVERAGE_SQL), (confidence_histogram, HISTOGRAM_SQL), (run_diff, RUN_DIFF_SQL), (audit_masked, _audit_sql()),
        (eval_cells, EVAL_SQL), (covered_regions, COVERED_SQL), (nearest_span, NEAREST_SQL), (zip_states, ZIP_SQL), (priors_fold, PRIORS_SQL),
    )
}
_BY_CATEGORIES = ((overlap_scan, _scan_sql), (overlap_search, _search_sql), (overlap_suppressed, _suppressed_sql), (merged_spans, _merged_sql), (redact_text, _redact_sql), (verify_layers, _verify_sql))
_QUERIES |= {f"{f.__name__}_all": (partial(f, categories=detect.CATEGORIES), sql(detect.CATEGORIES)) for f, sql in _BY_CATEGORIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _QUERIES.items()}
