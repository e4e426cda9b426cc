"""URL filters: explicit rules, and empirical-Bayes reputations of hosts elsewhere.

Outcomes of pages (bad or not) are counted for each host, registered domain and
suffix, with map-side combine. Each level's share of bad pages has a beta prior
whose mean is the posterior mean of the level above (the root's is that of all
outcomes) and whose strength comes from the level's own overdispersion, by
moments of the beta-binomial. A page is blocked when the lower bound of its
host's posterior reaches BLOCK_FROM: one bad page does not condemn a host, many
do, and a new host stands as its domain does. Without outcomes nothing is blocked.

Pages carry no labels, so by default a page is labelled by what it holds: it is
bad if JUNK_SHARE of its words end in runs of marks, or a seed word stands in
its host. Pages without html are unlabelled unless a seed word decides.

Rules are a parameter, a handful of (action, host, path prefix); the longest
that fits wins and outranks reputations. Null urls and urls without :// have an
empty host and path, which no rule fits; very long urls are taken whole; repeated
rows and rows without an id are judged each; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .exact_dedup import LOWER, UPPER
from .skew import join_counted

#: Common suffixes of two labels, under which registered domains have three (a parameter).
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "govt.nz", "gov.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "com.br", "net.br", "org.br", "gov.br", "co.in", "net.in", "org.in", "gov.in", "ac.in", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.tw", "org.tw", "com.hk", "com.sg", "com.my", "co.kr", "or.kr",
    "co.za", "org.za", "com.mx", "org.mx", "com.ar", "com.tr", "org.tr", "com.ua", "com.pl", "co.il", "org.il", "com.sa", "com.eg", "com.co", "com.pe", "com.ve", "co.id", "co.th", "com.vn", "com.ph", "com.pk",
)
BLOCK_FROM, DEVIATIONS, JUNK_SHARE = 0.5, 1.645, 0.2
#: Words that label a page as bad where no outcomes are given (a parameter of judged).
SEED_TERMS = ("casino", "bets", "poker", "pills", "viagra", "porn", "xxx", "ads", "adserver", "payday", "warez", "spam")
#: Tags, words, and runs of three marks or entities, as in junk text.
TAG, WORD, MARKS = r"<[^>]*>", r"[^ \t\n\r]+", r"([!-%'-/:-@\[-`{-~]{3}|(&[a-z]+;){3})"
LEVELS = ("suffix", "domain", "host")


def parts(name: str = "url") -> tuple[Column, Column]:
    """(host, path) of a url."""
    url = F.col(name).cast("string")
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_for(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as host and path, its action) of the longest rule that fits; null where none does."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def levels(host: str = "host", suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host, without its user and port."""
    labels = F.split(F.regexp_replace(F.regexp_replace(F.col(host), "^.*@", ""), ":[0-9]*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    double = two.isin(*suffixes) if suffixes else F.lit(False)
    return F.when(double, two).otherwise(F.element_at(labels, -1)), F.when(double, three).otherwise(two)


def junk(html: str = "html") -> Column:
    """Whether runs of marks stand behind JUNK_SHARE of the words outside tags; null for null."""
    plain = F.regexp_replace(F.col(html).cast("string"), TAG, " ")
    return F.regexp_count(plain, F.lit(MARKS)) >= F.regexp_count(plain, F.lit(WORD)) * JUNK_SHARE


def _strength(units: DataFrame, mean: float) -> float:
    """Prior strength of a level: from the overdispersion of its units' shares."""
    row = units.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, F.lit(2))).alias("s")
    ).first()
    if not row.k or row.k < 2 or not 0 < mean < 1:
        return 1.0
    spread = mean * (1 - mean)
    below = spread * (row.n - row.n2 / row.n - (row.k - 1))
    share = (row.s - spread * (row.k - 1)) / below if below > 0 else 0.5
    share = min(max(share, 0.01), 0.99)
    return (1 - share) / share


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, pages, mean, bound for hosts(host, pages, n, bad): n labelled pages, bad of them bad.

    Suffixes with very many domains, and domains with very many hosts, are joined
    where those lie; the number of units under each key is counted before.
    """
    suffix, domain = levels("host", suffixes)
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("hosts")).first()
    n, bad = float(total.n or 0), float(total.bad or 0)
    mean = (bad + 1) / (n + 2) if n else 0.0
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("units")]
    by_domain = scratch.written(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(*sums)
    k = {name: _strength(units, mean) for name, units in (("suffix", by_suffix), ("domain", by_domain), ("host", hosts))}
    by_suffix = by_suffix.select("suffix", "units", ((F.lit(k["suffix"] * mean) + F.col("bad")) / (F.col("n") + k["suffix"])).alias("above"))
    domains = join_counted(by_domain.withColumnRenamed("units", "hosts"), by_suffix, "suffix", "units", by_domain.count())
    domains = domains.select("domain", F.col("hosts").alias("units"), ((F.col("above") * k["domain"] + F.col("bad")) / (F.col("n") + k["domain"])).alias("prior"))
    a = F.col("prior") * k["host"] + F.col("bad")
    size = F.col("n") + k["host"]
    share = a / size
    bound = share - F.sqrt(share * (1 - share) / (size + 1)) * DEVIATIONS
    return join_counted(hosts, domains, "domain", "units", total.hosts).select("host", "pages", share.alias("mean"), bound.alias("bound"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], outcome: Column | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation for each page.

    outcome is true for bad pages, false for good ones, null for unlabelled
    ones. The pages are read once; what is left of them is written to the shared
    folder and read for the hosts and for the verdicts.
    """
    host, path = parts()
    name, action = rule_for(rules, F.col("host"), F.col("path"))
    if outcome is None:
        seeds = host.rlike(r"(^|[.-])(" + "|".join(SEED_TERMS) + r")([.-]|$)")
        outcome = seeds | junk() if "html" in pages.columns else seeds
    rows = scratch.written(pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), outcome.alias("bad")), "page-outcomes")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    known = scratch.written(reputations(scratch.written(hosts, "hosts"), suffixes), "reputations")
    out = join_counted(rows.drop("bad").withColumn("rule", name).withColumn("action", action), known, "host", "pages", rows.count())
    verdict = F.coalesce("action", F.when(F.col("bound") >= BLOCK_FROM, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("mean", 6).alias("reputation"))
