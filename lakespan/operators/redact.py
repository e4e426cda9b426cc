"""Redaction of text, and verification layers that read the written result again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlap import merged

BLOCK = "█"
COVERED = 0.8


def redacted(texts: DataFrame, found: DataFrame, halo: int = 0, mark: str = BLOCK) -> DataFrame:
    """doc_id, text, excluded, surviving: each character of a span (and halo characters around it) becomes the mark."""
    wide = found.select("doc_id", F.greatest(F.col("start") - halo, F.lit(0)).alias("start"), (F.col("len") + F.least(F.col("start"), F.lit(halo)) + halo).cast("int").alias("len"))
    cuts = merged(wide).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("cuts"))
    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(cuts, "doc_id", "left")

    def cut(state: Column, c: Column) -> Column:
        size = F.least(c["len"], F.length("text") - c["start"])
        out = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, c["start"] - state["at"]), F.repeat(F.lit(mark), size.cast("int")))
        return F.struct((c["start"] + size).cast("int").alias("at"), out.alias("out"), (state["gone"] + size).cast("int").alias("gone"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("gone"))
    state = F.aggregate(F.coalesce("cuts", F.array().cast("array<struct<start:int,len:int>>")), start, cut)
    rows = rows.select("doc_id", "text", state.alias("s"))
    rest = F.concat(F.col("s.out"), F.substring(F.col("text"), F.col("s.at") + 1, F.length("text")))
    return rows.select("doc_id", rest.alias("text"), F.col("s.gone").alias("excluded"), (F.length("text") - F.col("s.gone")).alias("surviving"))


def applied(texts: DataFrame, wanted: DataFrame, already: DataFrame | None = None, halo: int = 0) -> tuple[DataFrame, DataFrame]:
    """(redacted texts, regions): a batch of spans applied, but for those that earlier ones cover.

    Regions are one row a span: doc_id, start, len, category, state (applied or
    covered) and a fingerprint, for the audit.
    """
    new = wanted if already is None else uncovered(wanted, already)
    keep = ["doc_id", "start", "len", "category"]
    marked = new.select(*keep).distinct().withColumn("state", F.lit("applied"))
    rows = wanted.select(*keep).distinct().join(marked, keep, "left").withColumn("state", F.coalesce("state", F.lit("covered")))
    print_ = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("doc_id", "start", "len", "category"))), 256)
    both = new.select("doc_id", "start", "len") if already is None else new.select("doc_id", "start", "len").unionByName(already.select("doc_id", "start", "len"))
    return redacted(texts, both, halo), rows.withColumn("fingerprint", print_)


def lineage(text: Column, mark: str = BLOCK) -> Column:
    """SHA-256 over each surviving character that is not white space, with its place."""
    chars = F.transform(F.split(text, ""), lambda c, i: F.when(~c.rlike(r"^\s*$") & (c != mark), F.concat(c, F.lit("\x1f"), i.cast("string"), F.lit("\x1f"))).otherwise(""))
    return F.sha2(F.array_join(chars, ""), 256)


def digest(texts: DataFrame, out: DataFrame) -> DataFrame:
    """doc_id, extracted, excluded, surviving, lineage of the redacted text."""
    rows = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("extracted")).join(out, "doc_id")
    return rows.select("doc_id", "extracted", "excluded", "surviving", lineage(F.col("text")).alias("lineage"))


def uncovered(new: DataFrame, applied: DataFrame) -> DataFrame:
    """New spans of which no applied one covers more than 0.8."""
    a = applied.select("doc_id", F.col("start").alias("a_start"), (F.col("start") + F.col("len")).alias("a_end"))
    n = new.withColumn("end", F.col("start") + F.col("len"))
    share = (F.least("end", "a_end") - F.greatest("start", "a_start")) / F.col("len")
    hit = n.join(a, "doc_id").where((F.col("a_start") < F.col("end")) & (F.col("start") < F.col("a_end")) & (share > COVERED)).select("doc_id", "start", "len").distinct()
    return new.join(hit, ["doc_id", "start", "len"], "left_anti")


def nearest(points: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """doc_id, at, start, distance: the span nearest to each point(doc_id, at) within the radius, the first of ties."""
    gap = F.greatest(F.col("start") - F.col("at"), F.col("at") - (F.col("start") + F.col("len")), F.lit(0))
    rows = points.join(found.select("doc_id", "start", "len"), "doc_id").withColumn("distance", gap).where(F.col("distance") <= radius)
    return rows.groupBy("doc_id", "at").agg(F.min(F.struct("distance", "start")).alias("m")).select("doc_id", "at", F.col("m.start").alias("start"), F.col("m.distance").alias("distance"))


def variants(term: str) -> list[str]:
    """Case variants under which a term is looked for."""
    return list(dict.fromkeys([term, term.lower(), term.upper(), term.title()]))


def searchable(term: str) -> bool:
    """Three characters at least, two from U+2E80 on."""
    return len(term) >= 3 or (len(term) >= 2 and all(ord(c) >= 0x2E80 for c in term))


def residual(out: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, term: terms still readable in the output, in any case variant, as they are, reversed by encoding or in hex.

    One pass over the text checks all terms; terms is a parameter of a run.
    """
    tests = []
    for t in dict.fromkeys(x for x in terms if searchable(x)):
        plain = F.lit(False)
        for v in variants(t):
            plain = plain | F.contains("text", F.lit(v)) | F.contains("text", F.lit(v.encode().hex()))
        tests.append(F.when(plain, F.lit(t)))
    if not tests:
        return out.select("doc_id", F.lit(None).cast("string").alias("term")).limit(0)
    return out.select("doc_id", F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("term"))


SEVERITY = {"fail": 0, "attention": 1, "warn": 2, "skipped": 3, "info": 4, "pass": 5}


def layers(texts: DataFrame, found: DataFrame, out: DataFrame, digests: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, layer, status, message for the text layers: residual spans, terms, counts, excluded ranges, lineage."""
    ids = texts.select("doc_id")
    status = lambda bad, worst: F.when(bad, worst).otherwise("pass").alias("status")
    left = residual(out, terms).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    term_layer = ids.join(left, "doc_id", "left").select("doc_id", F.lit("terms").alias("layer"), status(F.col("n") > 0, "attention"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" terms left")).alias("message"))
    cuts = found.select("doc_id", "start", "len").join(out.select("doc_id", "text"), "doc_id")
    seen = cuts.where(~F.substring("text", F.col("start") + 1, F.col("len")).rlike(f"^{BLOCK}*$")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    range_layer = ids.join(seen, "doc_id", "left").select("doc_id", F.lit("ranges").alias("layer"), status(F.col("n") > 0, "fail"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" spans readable")).alias("message"))
    both = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("before")).join(out.select("doc_id", F.length("text").alias("after"), lineage(F.col("text")).alias("now")), "doc_id").join(digests.select("doc_id", "lineage"), "doc_id")
    counts = both.select("doc_id", F.lit("counts").alias("layer"), F.when(F.col("after") < F.col("before"), "fail").when(F.col("after") > F.col("before") + 2, "warn").otherwise("pass").alias("status"), F.concat((F.col("after") - F.col("before")).cast("string"), F.lit(" characters")).alias("message"))
    line = both.select("doc_id", F.lit("lineage").alias("layer"), status(F.col("now") != F.col("lineage"), "fail"), F.lit("").alias("message"))
    return term_layer.unionByName(range_layer).unionByName(counts).unionByName(line)


def verdict(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status: fail, else attention, else warn; all skipped is skipped, some skipped is warn, else pass."""
    has = lambda s: F.count_if(F.col("status") == s)
    rows = results.groupBy(key).agg(has("fail").alias("f"), has("attention").alias("a"), has("warn").alias("w"), has("skipped").alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.when(F.col("f") > 0, "fail").when(F.col("a") > 0, "attention").when(F.col("w") > 0, "warn").when(F.col("s") == F.col("n"), "skipped").when(F.col("s") > 0, "warn").otherwise("pass").alias("status"))


def same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: pages before and after, and pass or fail."""
    a, b = before.agg(F.count(F.lit(1)).alias("n")), after.agg(F.count(F.lit(1)).alias("n"))
    both = a.select(F.lit("before").alias("side"), "n").unionByName(b.select(F.lit("after").alias("side"), "n"))
    return both.agg(F.max(F.when(F.col("side") == "before", F.col("n"))).alias("before"), F.max(F.when(F.col("side") == "after", F.col("n"))).alias("after")).withColumn("status", F.when(F.col("before") == F.col("after"), "pass").otherwise("fail"))


def markup(pages: DataFrame) -> DataFrame:
    """page_id, status, findings: active content and personal metadata left in HTML."""
    tests = {"script": ("fail", r"(?i)<script\b"), "handler": ("fail", r"(?i)<[a-z][^>]*\son[a-z]+\s*="), "form": ("warn", r"(?i)<form\b"), "author": ("warn", r"(?i)<meta[^>]+name=[\"']?author\b"), "comment": ("info", r"<!--")}
    found = F.filter(F.array(*(F.when(F.col("html").rlike(p), F.lit(n)) for n, (_, p) in tests.items())), lambda x: x.isNotNull())
    rows = pages.select("page_id", F.coalesce(found, F.array().cast("array<string>")).alias("findings"))
    worst = F.when(F.exists("findings", lambda f: f.isin("script", "handler")), "fail").when(F.exists("findings", lambda f: f.isin("form", "author")), "warn").when(F.size("findings") > 0, "info").otherwise("pass")
    return rows.select("page_id", worst.alias("status"), F.array_join("findings", ",").alias("findings"))


def annotations(pages: DataFrame) -> DataFrame:
    """tag, uses, pages: how often each element occurs, and in how many pages."""
    tags = F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    rows = pages.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("tag").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("pages"))
