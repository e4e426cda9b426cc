"""Entity resolution: groups of equal keys across pages, and clusters of person names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, normalize, similarity
from ..sources.scratch import written
from .components import components

SIMILAR, AMBIGUOUS = 0.70, 15


def groups(found: DataFrame, page: str = "doc_id") -> DataFrame:
    """category, canonical, members, pages: spans of one category and canonical form, two at least, and on how many pages."""
    rows = found.withColumn("canonical", normalize.canonical(F.col("matched"))).where("canonical != ''")
    return rows.groupBy("category", "canonical").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(page).alias("pages")).where("members >= 2")


def memberships(found: DataFrame, page: str = "doc_id") -> DataFrame:
    """category, canonical, page, spans, members, pages: a row for each page of a group, so that no group is gathered in one row."""
    rows = found.withColumn("canonical", normalize.canonical(F.col("matched"))).where("canonical != ''")
    own = rows.groupBy("category", "canonical", page).agg(F.count(F.lit(1)).alias("spans"))
    sums = own.groupBy("category", "canonical").agg(F.sum("spans").alias("members"), F.count(F.lit(1)).alias("pages")).where("members >= 2")
    return own.join(sums, ["category", "canonical"]).select("category", "canonical", page, "spans", "members", "pages")


def name_parts(names: DataFrame) -> DataFrame:
    """Adds surname (last token) and initial (of the first of several tokens), lower case."""
    tokens = F.filter(F.split(normalize.normalized(F.trim(F.col("name"))), rf"(?:{fixed.WHITE}|,)+"), lambda t: t != "")
    rows = names.withColumn("t", tokens).where(F.size("t") > 0)
    return rows.withColumn("surname", F.lower(F.element_at("t", -1))).withColumn("initial", F.when(F.size("t") > 1, F.lower(F.left(F.element_at("t", 1), F.lit(1))))).drop("t")


def _labels(nodes: DataFrame, links: DataFrame, rounds: int | None) -> DataFrame:
    """node, label: the smallest node that links lead to, when nothing changes any more."""
    found = components(written(links, "name-links"), rounds)
    return written(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label")), "labels")


def clusters(names: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, cluster (its smallest id), ambiguous: names(id, name) linked within a surname.

    Two names link when their initials agree or they are similar. All spellings
    of one surname and initial link to the first of them; first only those firsts
    are compared, a few dozen a surname, and then only spellings that are still
    in different components, so a frequent surname costs no pairs of all its
    spellings and no link between different components is lost.
    """
    rows = name_parts(names)
    forms = written(rows.groupBy("surname", "initial", "name").agg(F.min("id").alias("node")), "name-forms")
    firsts = forms.where("initial IS NOT NULL").groupBy("surname", "initial").agg(F.min("node").alias("b"))
    by_initial = forms.join(firsts, ["surname", "initial"]).select(F.col("node").alias("a"), "b").where("a != b")
    heads = forms.join(firsts.select(F.col("b").alias("node")), "node", "left_semi").unionByName(forms.where("initial IS NULL").select("node", "surname", "initial", "name"))
    links = by_initial.unionByName(_close(heads.withColumn("label", F.col("node"))))
    label = _labels(forms, links, rounds)
    rest = _close(forms.join(label, "node"))
    label = _labels(forms, label.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b").unionByName(rest), rounds)
    by_form = forms.join(label, "node").select(F.col("surname").alias("s"), F.col("initial").alias("i"), F.col("name").alias("n"), F.col("label").alias("cluster"))
    out = rows.join(by_form, (F.col("surname") == F.col("s")) & F.col("initial").eqNullSafe(F.col("i")) & (F.col("name") == F.col("n"))).select("id", "initial", "cluster")
    bare = out.groupBy("cluster").agg((F.count(F.lit(1)) >= AMBIGUOUS).alias("many"), F.max("initial").isNull().alias("none"))
    return out.join(bare, "cluster").select("id", "cluster", (F.col("many") & F.col("none")).alias("ambiguous"))


def _close(forms: DataFrame) -> DataFrame:
    """a, b: similar names of one surname with different labels."""
    left, right = (forms.select("surname", *(F.col(c).alias(f"{c}{k}") for c in ("node", "name", "label"))) for k in (1, 2))
    met = left.join(right, "surname").where((F.col("node1") > F.col("node2")) & (F.col("label1") != F.col("label2")))
    return met.where(similarity.combined(F.col("name1"), F.col("name2")) >= SIMILAR).select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def expanded(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Names with the canonical names of their alias: nicknames(alias, canonical)."""
    return names.join(nicknames.withColumn("alias", F.lower("alias")), F.lower("name") == F.col("alias"), "left").select("id", "name", F.coalesce("canonical", "name").alias("canonical"))


#: Endings of a name that are no part of it.
SUFFIXES = [
    "jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "v", "esq", "esq.", "md", "m.d.", "do", "d.o.", "phd", "ph.d.", "jd", "j.d.", "llm", "l.l.m.", "mba", "m.b.a.", "rn", "r.n.", "np", "n.p.", "pa", "p.a.", "crna",
    "dds", "d.d.s.", "dmd", "d.m.d.", "od", "o.d.", "cpa", "c.p.a.", "cfa", "cfp", "ret", "ret.",
]


def _lacking_one(word: Column) -> Column:
    """The word, and the word without each one of its characters."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))))


def gazetteer_verdict(names: DataFrame, surnames: DataFrame, given: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """id, boost, given_only of names(id, name): surname and given name known 0.15, surname alone 0.10, a near surname 0.05.

    Endings such as jr are no part of a name. All parts of a hyphenated surname
    known count as the surname, some of them as near. Near is also one edit from a
    known surname, or rn read for m. The dimension tables are optional, (word)
    each; nicknames(alias, canonical) stand for given names. Words that are one
    edit apart share a word that lacks one character of either, so near surnames
    meet by an equal key and are compared then. given_only: a single word that is
    a known given name and no surname.
    """
    tokens = F.filter(F.split(normalize.normalized(F.trim(F.col("name"))), rf"(?:{fixed.WHITE}|,)+"), lambda t: F.regexp_replace(t, r"^\p{P}+|\p{P}+$", "") != "")
    lasts = F.reverse(F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, r"^\p{P}+|\p{P}+$", ""))))
    # endings are dropped from the back, but never the whole name
    kept = F.reverse(F.aggregate(lasts, F.array().cast("array<string>"), lambda out, t: F.when((F.size(out) == 0) & t.isin(*SUFFIXES), out).otherwise(F.concat(out, F.array(t)))))
    rows = names.select("id", F.col("name").alias("whole"), F.when(F.size(kept) > 0, kept).otherwise(F.reverse(lasts)).alias("t")).where(F.size("t") > 0)
    rows = rows.select("id", F.element_at("t", -1).alias("surname"), F.when(F.size("t") > 1, F.array_join(F.slice("t", 1, F.size("t") - 1), " ")).alias("first"))
    rows = written(rows, "name-parts")  # read once for each dimension
    s = surnames.select(F.lower("word").alias("w")).distinct()
    g = given.select(F.lower("word").alias("w")).distinct()
    aliases = g.select(F.col("w").alias("alias"))
    if nicknames is not None:
        aliases = aliases.unionByName(nicknames.select(F.lower("alias").alias("alias"), F.lower("canonical").alias("w")).join(g, "w", "left_semi").select("alias")).distinct()
    known = lambda column, dim, name: rows.select(F.col(column).alias("w")).where("w IS NOT NULL").distinct().join(dim, "w", "left_semi").select(F.col("w").alias(column), F.lit(True).alias(name))
    exact, firsts, only = known("surname", s, "s"), known("first", aliases.withColumnRenamed("alias", "w"), "g"), known("surname", g, "o")
    parts = rows.select("surname").where(F.contains("surname", F.lit("-"))).distinct().select("surname", F.explode(F.split("surname", "-")).alias("w")).where("w != ''")
    hyphens = parts.join(s.withColumn("hit", F.lit(1)), "w", "left").groupBy("surname").agg((F.count("hit") == F.count(F.lit(1))).alias("every"), (F.count("hit") > 0).alias("some"))
    asked = rows.select("surname").distinct().join(exact, "surname", "left_anti")
    keys = s.select(F.col("w").alias("word"), F.explode(_lacking_one(F.col("w"))).alias("key"))
    near = asked.select("surname", F.explode(_lacking_one(F.col("surname"))).alias("key")).join(keys, "key").where(F.levenshtein("surname", "word") == 1).select("surname")
    read = asked.where(F.contains("surname", F.lit("rn"))).select("surname", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("surname") - 1, F.lit(1))), lambda i: F.substring("surname", i, F.lit(2)) == "rn"), lambda i: F.concat(F.left("surname", i - 1), F.lit("m"), F.substring("surname", i + 2, F.length("surname"))))).alias("w")).join(s, "w", "left_semi").select("surname")
    fuzzy = near.unionByName(read).distinct().withColumn("f", F.lit(True))
    rows = rows.join(exact, "surname", "left").join(firsts, "first", "left").join(only, "surname", "left").join(hyphens, "surname", "left").join(fuzzy, "surname", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    full = yes("s") | yes("every")
    boost = F.when(full & yes("g"), 0.15).when(full, 0.10).when(yes("some") | yes("f"), 0.05).otherwise(0.0)
    return rows.select("id", boost.alias("boost"), (F.col("first").isNull() & yes("o") & (boost == 0)).alias("given_only"))
