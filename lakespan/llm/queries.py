"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, mixing, near_dedup, quality, substring_dedup, topk, toxicity, url_filter


def tokenizer_path() -> str:
    """Where the public vocabulary files are installed; the same place on each machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, _table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(_table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


#: (action, host, path prefix)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def _op8_sql() -> str:
    """The same rules and estimates, written over grouped tables."""
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])))
    action = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in URL_RULES)
    double = ", ".join(f"'{d}'" for d in url_filter.SUFFIXES)

    marks = url_filter.MARKS.replace("'", "''")

    def strength(units: str) -> str:
        spread = "m * (1 - m)"
        share = f"CASE WHEN {spread} * (sn - sn2 / sn - (k - 1)) > 0 THEN (s - {spread} * (k - 1)) / ({spread} * (sn - sn2 / sn - (k - 1))) ELSE 0.5 END"
        return f"""(SELECT CASE WHEN k < 2 THEN 1.0 ELSE (1 - r) / r END FROM (SELECT k, least(greatest({share}, 0.01), 0.99) AS r
          FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS sn, CAST(sum(n * n) AS DOUBLE) AS sn2, sum(n * pow(bad / n - m, 2)) AS s, any_value(m) AS m FROM {units}, mean WHERE n > 0)))"""

    return f"""
WITH u AS (SELECT page_id, regexp_replace(html, '{url_filter.TAG}', ' ', 'g') AS plain, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p0 AS (SELECT page_id, plain, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS (SELECT page_id, host, path, regexp_matches(host, '(^|[.-])({"|".join(url_filter.SEED_TERMS)})([.-]|$)') OR len(regexp_extract_all(plain, '{marks}')) >= len(regexp_extract_all(plain, '{url_filter.WORD}')) * {url_filter.JUNK_SHARE} AS bad FROM p0),
r AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM p),
h AS (SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l, count(bad) AS n, CAST(count(*) FILTER (bad) AS DOUBLE) AS bad FROM p GROUP BY host),
x AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({double}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix, CASE WHEN array_to_string(l[-2:], '.') IN ({double}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h),
mean AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1) / (sum(n) + 2) ELSE 0 END AS m FROM h),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM x GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
k AS (SELECT {strength("s")} AS ks, {strength("d")} AS kd, {strength("x")} AS kh),
s2 AS (SELECT suffix, (ks * m + bad) / (n + ks) AS above FROM s, k, mean), d2 AS (SELECT domain, (above * kd + bad) / (n + kd) AS prior FROM d JOIN s2 USING (suffix), k),
e AS (SELECT host, (prior * kh + bad) / (n + kh) AS share, n + kh AS size FROM x JOIN d2 USING (domain), k)
SELECT page_id, host, path, rule, coalesce(CASE rule {action} END, CASE WHEN share - sqrt(share * (1 - share) / (size + 1)) * {url_filter.DEVIATIONS} >= {url_filter.BLOCK_FROM} THEN 'block' ELSE 'allow' END) AS verdict, round(share, 6) AS reputation
FROM r JOIN e USING (host)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, _table(spark, sf_dir, "labels")))


OP10_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_license_scan": op2_license_scan,
        "op3_mixing": op3_mixing,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_topk": op5_topk,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_bpe": op7_bpe,
        "op8_url_filter": op8_url_filter,
        "op9_toxicity": op9_toxicity,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict:
    return {"op2_license_scan": license_scan.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op4_substring_dedup": substring_dedup.ORACLE_SQL, "op5_topk": OP5_SQL, "op8_url_filter": _op8_sql(), "op10_exact_dedup": OP10_SQL}
