"""Queries of normalisers, search, user terms, HTML analogues and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, normalize, similarity
from ..functions.spans import tokens
from ..operators import address, detect, doctype, entities, rationale, redact, report, search, terms
from ..sources.tables import corpus, fixture, table
from ..streaming import live
from .detecting import TEXTS, _re, _values, sql_found, sql_spans

_FIX = f"texts AS (SELECT * FROM (VALUES {_values()}) f(doc_id, text))"


def normalize_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisers that keep to native expressions, over all texts."""
    t = F.col("text")
    return corpus(spark, sf_dir).select(
        "doc_id", F.sha2(normalize.smart_punctuation(t), 256).alias("marks"), F.sha2(normalize.strip_separators(t), 256).alias("stripped"),
        normalize.text_layer(t).alias("layer"), normalize.fallback(t).alias("fallback"), normalize.masked(t).alias("masked"),
    )


NORMALIZE_SQL = f"""WITH {TEXTS} SELECT doc_id, sha256(translate(text, '{fixed.MARKS[0]}', '""''''-----')) AS marks, sha256(regexp_replace(text, '[- ./,]', '', 'g')) AS stripped,
 CASE WHEN length(text) = 0 THEN 'none' WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 10 THEN 'sparse' ELSE 'rich' END AS layer,
 CASE WHEN length(text) = 0 THEN 'noExtractableText' WHEN length(text) - length(replace(text, chr(65533), '')) > length(text) * 0.01 THEN 'encodingFailure' WHEN regexp_matches(text, '[\\x{{0590}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]') THEN 'rtlText'
  WHEN length(trim(text)) >= 50 AND len(list_distinct(string_split(trim(text), ''))) < 10 THEN 'unresolvedEncoding' END AS fallback,
 CASE WHEN length(text) <= 4 THEN '…' ELSE left(text, 2) || '…' || right(text, 2) END AS masked FROM texts"""


def fold_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without diacritics, and the sum of the places kept."""
    t = F.col("text")
    return corpus(spark, sf_dir).select("doc_id", F.sha2(normalize.fold_diacritics(t), 256).alias("folded"), F.aggregate(normalize.fold_map(t), F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


FOLD_SQL = f"WITH {TEXTS} SELECT doc_id, sha256(strip_accents(text)) AS folded, CAST(length(text) * (length(text) - 1) // 2 AS BIGINT) AS places FROM texts"


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names and words of the fixture and of customers (composed by an Arrow function where not ASCII)."""
    rows = fixture(spark).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text")))
    return rows.select("doc_id", normalize.canonical(F.col("text")).alias("canonical"), normalize.surface_form(F.col("text")).alias("surface"), normalize.neutralised(F.col("text")).alias("cell"))


CANONICAL_SQL = f"""WITH {_FIX}, r AS (SELECT * FROM texts UNION ALL SELECT c_custkey, c_name FROM customer) SELECT doc_id, regexp_replace(lower(translate(nfc_normalize(text), '‑', '‐')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g') AS canonical, trim(regexp_replace(lower(translate(nfc_normalize(text), '‑', '‐')), '\\s+', ' ', 'g')) AS surface,
 CASE WHEN regexp_matches(text, '^[=+@\\t\\r-]') THEN '''' || text ELSE text END AS cell FROM r"""


def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alikes repaired and capitals cased, line by line."""
    lines = corpus(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", normalize.confusions_repaired(F.col("text")).alias("repaired"))


OCR_SQL = f"""WITH {TEXTS}, l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM texts),
w AS (SELECT *, len(regexp_extract_all(t, '[2-79]')) - len(regexp_extract_all(t, '\\p{{L}}')) + len(regexp_extract_all(t, '[OoIlBSZG]')) AS lean, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS k, string_split_regex(t, '[\\p{{L}}\\p{{N}}]+') AS g FROM l),
r AS (SELECT *, list_transform(k, lambda x: CASE WHEN len(regexp_extract_all(x, '[2-79]')) - len(regexp_extract_all(x, '\\p{{L}}')) + len(regexp_extract_all(x, '[OoIlBSZG]')) <> 0 THEN len(regexp_extract_all(x, '[2-79]')) - len(regexp_extract_all(x, '\\p{{L}}')) + len(regexp_extract_all(x, '[OoIlBSZG]')) ELSE lean END) AS s FROM w)
SELECT doc_id, CAST(line AS INTEGER) AS line, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(k) THEN '' WHEN s[i] > 0 THEN translate(k[i], 'OoIlBSZG', '00118526') WHEN s[i] < 0 THEN translate(k[i], '0158', 'OISB') ELSE k[i] END), '') AS repaired FROM r"""


def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shouted words of the fixture and of short texts in title case."""
    return fixture(spark).unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.upper("p_name").alias("text"))).select("doc_id", normalize.title_case(F.col("text")).alias("cased"))


TITLE_SQL = f"""WITH {_FIX}, r AS (SELECT * FROM texts UNION ALL SELECT p_partkey, upper(p_name) FROM part)
SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: CASE WHEN list_contains([{', '.join(_re(a) for a in fixed.ACRONYMS)}], regexp_replace(w, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')) THEN w
 WHEN length(w) >= 2 AND w = upper(w) AND regexp_matches(w, '\\p{{L}}') THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END), ' ') AS cased FROM r"""


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring customers' and parts' names."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("b"))
    return c.join(p, "k").select("k", F.round(similarity.similarity(F.col("a"), F.col("b")), 6).alias("jw"), F.round(similarity.token_sort(F.col("a"), F.col("b")), 6).alias("sorted"))


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal(corpus(spark, sf_dir), "license")


def _literal_sql(term: str, where: str = "true") -> str:
    start, size = "start", f"{len(term)}"
    left, end = f"greatest({start} - 20, 0)", f"least({start} + {size} + 20, length(text))"
    snippet = f"CASE WHEN {left} > 0 THEN '…' ELSE '' END || translate(substr(text, {left} + 1, {end} - {left}), chr(10), ' ') || CASE WHEN {end} < length(text) THEN '…' ELSE '' END"
    return f"SELECT doc_id, '{term}' AS term, start, CAST({size} AS INTEGER) AS len, matched, {snippet} AS snippet FROM ({sql_spans('(?i)' + term.replace('.', '[.]'), 'x')}) WHERE {where}"


_BOUND = "(start = 0 OR NOT regexp_matches(substr(text, start, 1), '[\\p{L}\\p{N}_]')) AND NOT regexp_matches(substr(text, start + length(matched) + 1, 1), '[\\p{L}\\p{N}_]')"


def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal(corpus(spark, sf_dir), "repeat", search.Options(whole_word=True)).unionByName(search.literal(corpus(spark, sf_dir), "the", search.Options(whole_word=True)))


def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that ignores diacritics and separators, with places in the original text."""
    return search.literal(corpus(spark, sf_dir), "cafe naive", search.Options(fold_diacritics=True, strip_separators=True)).unionByName(search.literal(corpus(spark, sf_dir), "4155552671", search.Options(strip_separators=True)))


def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex(corpus(spark, sf_dir), r"[0-9]{4}-[0-9]{3,7}", whole_word=True)


SEARCH_REGEX_SQL = f"WITH {TEXTS} SELECT doc_id, '[0-9]{{4}}-[0-9]{{3,7}}' AS term, start, CAST(length(matched) AS INTEGER) AS len, matched, CASE WHEN greatest(start - 20, 0) > 0 THEN '…' ELSE '' END || translate(substr(text, greatest(start - 20, 0) + 1, least(start + length(matched) + 20, length(text)) - greatest(start - 20, 0)), chr(10), ' ') || CASE WHEN least(start + length(matched) + 20, length(text)) < length(text) THEN '…' ELSE '' END AS snippet FROM ({sql_spans('[0-9]{4}-[0-9]{3,7}', 'x')}) WHERE {_BOUND}"


def search_multi_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in documents that hold every term."""
    return search.multi(corpus(spark, sf_dir), ["License", " released", "MIT"], search.Options(conjunction=True)).select("doc_id", "term", "start", "matched")


_MULTI = " UNION ALL ".join(_literal_sql(t) for t in ("License", "released", "MIT"))
MULTI_SQL = f"WITH {TEXTS}, h AS ({_MULTI}), d AS (SELECT doc_id FROM h GROUP BY doc_id HAVING count(DISTINCT term) = 3) SELECT doc_id, term, start, matched FROM h SEMI JOIN d USING (doc_id)"


def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.preview(corpus(spark, sf_dir), ["license", "token", "the"])


PREVIEW_SQL = f"WITH {TEXTS}, h AS ({' UNION ALL '.join(_literal_sql(t) for t in ('license', 'token', 'the'))}) SELECT term, count(*) AS hits, count(DISTINCT doc_id) AS documents, count(*) > 10000 AS saturated FROM h GROUP BY term"


def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand hits by document and place (the cap is the feature)."""
    hits, _ = search.capped(search.literal(corpus(spark, sf_dir), "the"), ["doc_id", "start"])
    return hits.select("doc_id", "start", "matched")


def search_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category scan with always-flag terms beside it."""
    texts = corpus(spark, sf_dir)
    found = detect.detected(texts, ["email", "phone"]).select("doc_id", "category", "rule", "start", "len", "matched", "confidence")
    return found.unionByName(terms.always_flagged(texts, ["prescriber", "Released under"]))


CATEGORY_SQL = f"""WITH {TEXTS} SELECT doc_id, 'email' AS category, rule, start, len, matched, confidence FROM ({sql_found('email')}) UNION ALL SELECT doc_id, 'phone', rule, start, len, matched, confidence FROM ({sql_found('phone')})
UNION ALL SELECT doc_id, 'user', 'user.alwaysFlag', start, len, matched, 1.0 FROM ({_literal_sql('prescriber')} UNION ALL {_literal_sql('released under')})"""


def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on surface forms, made from events, applied to spans."""
    texts = corpus(spark, sf_dir)
    found = detect.detected(texts, ["email", "name"]).select("doc_id", "category", "start", "matched", "confidence")
    decisions = spark.createDataFrame([("JANE.DOE@example.com", False, 1), ("jane.doe@example.com", True, 2), ("Roy  Bean", False, 1)], "text string, accepted boolean, ts long")
    out = terms.with_surface_decisions(found, terms.surface_decisions(decisions))
    return out.select("doc_id", "category", "start", "matched", F.round("confidence", 6).alias("confidence"), "bypass")


SURFACE_SQL = f"""WITH a AS (SELECT 'email' AS category, * FROM ({sql_found('email')}) UNION ALL SELECT 'name', * FROM ({sql_found('name')}))
SELECT doc_id, category, start, matched, CASE WHEN lower(matched) = 'jane.doe@example.com' THEN greatest(confidence, 0.9) ELSE confidence END AS confidence, lower(matched) = 'jane.doe@example.com' AS bypass FROM a WHERE lower(matched) <> 'roy bean'"""


def html_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.annotations(table(spark, sf_dir, "pages"))


HTML_SQL = "WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) SELECT tag, count(*) AS uses, count(DISTINCT page_id) AS pages FROM t GROUP BY tag"


def html_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.markup(table(spark, sf_dir, "pages"))


HTML_LAYERS_SQL = r"""WITH f AS (SELECT page_id, regexp_matches(html, '(?i)<script\b') AS s, regexp_matches(html, '(?i)<[a-z][^>]*\son[a-z]+\s*=') AS h, regexp_matches(html, '(?i)<form\b') AS f, regexp_matches(html, '(?i)<meta[^>]+name=["'']?author\b') AS a, contains(html, '<!--') AS c FROM pages)
SELECT page_id, CASE WHEN s OR h THEN 'fail' WHEN f OR a THEN 'warn' WHEN c THEN 'info' ELSE 'pass' END AS status, array_to_string(list_filter([CASE WHEN s THEN 'script' END, CASE WHEN h THEN 'handler' END, CASE WHEN f THEN 'form' END, CASE WHEN a THEN 'author' END, CASE WHEN c THEN 'comment' END], lambda x: x IS NOT NULL), ',') AS findings FROM f"""


def html_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors over the markup of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return detect.detected(pages, ["email", "account", "creditCard"], keep=("page_id",)).select("page_id", "category", "start", "matched", F.round("confidence", 6).alias("confidence"))


HTML_FINDINGS_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS page_id, '{c}' AS category, start, matched, confidence FROM ({sql_found(c).replace(TEXTS, 'texts AS (SELECT page_id AS doc_id, html AS text FROM pages)')})" for c in ("email", "account", "creditCard")
)


def props_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors over payloads carried by events, decoded from their JSON."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("account "), F.lpad((F.get_json_object("props", "$.k").cast("long") * 7919 + 1000000).cast("string"), 9, "0")).alias("text"))
    return detect.detected(events, ["account", "routingNumber"], keep=("event_id",)).groupBy("category").agg(F.count(F.lit(1)).alias("spans"))


def reverse_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For snippets of all texts (the first word with an @ or four digits, some of the fixture, one that is absent): what each category says of it, and why."""
    texts = doctype.classified(corpus(spark, sf_dir)).select("doc_id", "text", F.col("primary").alias("doctype"))
    own = texts.select("doc_id", F.regexp_extract("text", r"\S*(?:@|\d{4})\S*", 0).alias("snippet")).where("snippet != ''")
    some = spark.createDataFrame([(-1, "212-45-6789"), (-5, "(415) 555-2671"), (-8, "912-70-1234"), (-19, "XYZ998877"), (-19, "absent")], "doc_id long, snippet string")
    return rationale.explained(texts, own.unionByName(some), fixed.PRESETS["balanced"], "doctype", (["912-70-1234"], []), (["Jane.Doe@example.com"], [r"[(]415[)] [0-9-]+"]))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events, read as a stream and drained."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_folder(spark, sf_dir, "events"))
    stream = live.event_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", late="3650 days")
    out = live.drained(stream, "lakespan_stream_counts", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM_SQL = "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table's path as a glob that a stream can watch: one file or a folder of files."""
    return f"{sf_dir}/{name}[.]parquet"


def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that arrive as a stream."""
    stream = live.spans(spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(_folder(spark, sf_dir, "documents")), ["email", "phone", "creditCard"])
    out = live.landed(stream.select("doc_id", "category", "start", "matched"), "findings")
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("documents"))


STREAM_FINDINGS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS spans, count(DISTINCT doc_id) AS documents FROM ({sql_found(c)}) WHERE doc_id >= 0" for c in ("email", "phone", "creditCard"))


def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last five distinct event types, as a ring of recent queries."""
    return report.recent(table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("query")), 5)


RECENT_SQL = "WITH l AS (SELECT user_id, event_type AS query, max(ts) AS ts FROM events GROUP BY ALL) SELECT user_id, query, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query) AS n FROM l) WHERE n <= 5"


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent longer words, with anchors first (a top-k report)."""
    return report.word_list(corpus(spark, sf_dir), ["Licensed", "account"])


WORD_LIST_SQL = f"""WITH {TEXTS}, w AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}{{5,}}')) AS word FROM texts), c AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN ('licensed', 'account') GROUP BY word ORDER BY n DESC, word LIMIT 50),
a AS (SELECT 'licensed' AS word, -2 AS o UNION ALL SELECT 'account', -1 UNION ALL SELECT word, row_number() OVER (ORDER BY n DESC, word) FROM c) SELECT word, CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS place FROM a"""


def nickname_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases and known names over an optional dimension; the dimension here is invented."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "Bob Smith").when(F.col("c_custkey") % 3 == 1, "Smyth").otherwise("Ann Jones").alias("name"))
    verdicts = entities.gazetteer_verdict(names, spark.createDataFrame([("Smith",), ("Jones",)], "word string"), spark.createDataFrame([("ann",)], "word string"))
    alias = entities.expanded(names.withColumn("name", F.element_at(F.split("name", " "), 1)), spark.createDataFrame([("Bob", "Robert")], "alias string, canonical string"))
    return verdicts.join(alias.select("id", "canonical"), "id").select("id", "boost", "canonical")


NICKNAME_SQL = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 0.10 WHEN 1 THEN 0.05 ELSE 0.15 END::DOUBLE AS boost, CASE c_custkey % 3 WHEN 0 THEN 'Robert' WHEN 1 THEN 'Smyth' ELSE 'Ann' END AS canonical FROM customer"


def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each conversation turn: how many, first and last."""
    t = tokens(F.col("text"), fixed.WHITE)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).alias("n"), F.try_element_at(t, F.lit(1)).alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"))


TOKENS_SQL = "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS INTEGER) AS n, regexp_extract_all(text, '[^\\s]+')[1] AS first, regexp_extract_all(text, '[^\\s]+')[-1] AS last FROM conversations"

def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address.assembled(corpus(spark, sf_dir))


def _address_sql() -> str:
    names = "|".join(sorted(fixed.STATES, key=lambda n: (-len(n), n)))
    codes = "|".join([*fixed.STATES.values(), *fixed.MORE_STATES])
    named = "CASE regexp_extract(lower(l), '(" + names + ")', 1) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in fixed.STATES.items()) + " END"
    ranges = ", ".join(f"({a}, {e}, '{s}')" for a, e, s in fixed.ZIP_RANGES)
    exceptions = ", ".join(f"('{z}', '{s}')" for z, s in fixed.ZIP_OVERRIDES.items())
    return f"""WITH {TEXTS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM texts WHERE regexp_matches(text, '[0-9]{{5}}')),
s AS (SELECT *, coalesce({named}, nullif(regexp_extract(l, '\\b({codes})\\b', 1), '')) AS st, regexp_matches(l, {_re(fixed.STREET_LINE)}) AS street FROM l),
w AS (SELECT doc_id, i, l, list(l) OVER b AS block, coalesce(st, lag(st, 1) OVER o, lag(st, 2) OVER o, lag(st, 3) OVER o) AS state, bool_or(street) OVER b AS street FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i), b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, regexp_extract(l, {_re(fixed.ZIP_LINE)}, 1) AS zip FROM w WHERE regexp_matches(l, {_re(fixed.ZIP_LINE)})), t(a, e, s) AS (VALUES {ranges}), o(z, s) AS (VALUES {exceptions}),
y AS (SELECT z.*, coalesce(o.s, t.s) AS by_zip FROM z LEFT JOIN o ON o.z = zip LEFT JOIN t ON CAST(left(zip, 3) AS INTEGER) BETWEEN a AND e)
SELECT doc_id, CAST(i AS INTEGER) AS line, array_to_string(block, ', ') AS text, zip, state, CAST(CASE WHEN street AND state IS NOT NULL THEN 0.80 WHEN state IS NOT NULL THEN 0.65 ELSE 0.55 END AS DOUBLE) AS confidence
FROM y WHERE (street OR state IS NOT NULL) AND NOT coalesce(state <> by_zip, false)"""


#: An invented dimension of institutions.
INSTITUTIONS = {"internal revenue service": "federal_agency", "first national bank": "financial_institution", "national bank": "financial_institution", "the archive": "library"}


def header_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose document's header names an agency or a bank count less."""
    texts = corpus(spark, sf_dir).withColumn("anchor", address.anchored(F.col("text"), INSTITUTIONS))
    found = address.header_suppressed(detect.detected(texts, ["ssn", "npi", "name", "email"], keep=("doc_id", "anchor")), "anchor")
    return found.select("doc_id", "category", "rule", "start", "anchor", F.round("confidence", 6).alias("confidence"))


def _anchor_sql() -> str:
    hit = lambda k: f"regexp_matches(lower(left(text, 512)), '(^|[^\\p{{L}}\\p{{N}}]){k}($|[^\\p{{L}}\\p{{N}}])')"
    case = "CASE " + " ".join(f"WHEN {hit(k)} THEN '{address.ANCHORS.get(c, '')}'" for k, c in sorted(INSTITUTIONS.items(), key=lambda x: -len(x[0]))) + " END"
    found = " UNION ALL ".join(f"SELECT '{c}' AS category, * FROM ({sql_found(c)})" for c in ("ssn", "npi", "name", "email"))
    return f"""WITH {TEXTS}, h AS (SELECT doc_id, nullif({case}, '') AS anchor FROM texts), a AS ({found})
SELECT doc_id, category, rule, start, anchor, round(CASE WHEN anchor IS NOT NULL AND category IN ('ssn', 'npi', 'name') THEN greatest(CASE category WHEN 'ssn' THEN 0.25 WHEN 'npi' THEN 0.3 ELSE 0 END, confidence * 0.6) ELSE confidence END, 6) AS confidence FROM a JOIN h USING (doc_id)"""


def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by document, and each hit's neighbours."""
    hits = search.multi(corpus(spark, sf_dir), ["license", "released", "token"])
    out = search.grouped(hits).select("doc_id", "hits", F.array_join("terms", ",").alias("terms"), "first")
    last = search.navigated(hits).where("next IS NULL").select("doc_id", F.col("start").alias("last"))
    return out.join(last, "doc_id")


_GROUPED = " UNION ALL ".join(_literal_sql(t) for t in ("license", "released", "token"))
GROUPED_SQL = f"WITH {TEXTS}, h AS ({_GROUPED}) SELECT doc_id, count(*) AS hits, array_to_string(list_sort(list_distinct(list(term))), ',') AS terms, min(start) AS first, max(start) AS last FROM h GROUP BY doc_id"

_QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (normalize_native, NORMALIZE_SQL), (fold_diacritics, FOLD_SQL), (canonical_forms, CANONICAL_SQL), (ocr_repair, OCR_SQL), (title_case, TITLE_SQL), (name_similarity, None),
        (search_literal, f"WITH {TEXTS} {_literal_sql('license')}"), (search_whole_word, f"WITH {TEXTS} {_literal_sql('repeat', _BOUND)} UNION ALL {_literal_sql('the', _BOUND)}"), (search_folded, None),
        (search_regex, SEARCH_REGEX_SQL), (search_multi_and, MULTI_SQL), (search_preview, PREVIEW_SQL), (search_top, f"WITH {TEXTS} SELECT doc_id, start, matched FROM ({_literal_sql('the')}) ORDER BY doc_id, start LIMIT 1000"),
        (search_category, CATEGORY_SQL), (surface_forms, SURFACE_SQL), (html_annotations, HTML_SQL), (html_layers, HTML_LAYERS_SQL), (html_findings, HTML_FINDINGS_SQL), (props_findings, None),
        (reverse_rationale, None), (stream_counts, STREAM_SQL), (stream_findings, STREAM_FINDINGS_SQL), (recent_queries, RECENT_SQL), (word_list, WORD_LIST_SQL), (nickname_expansion, NICKNAME_SQL), (context_tokens, TOKENS_SQL),
        (address_lines, _address_sql()), (header_anchor, _anchor_sql()), (search_grouped, GROUPED_SQL),
    )
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
