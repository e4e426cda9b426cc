"""Search: literal, multi-term, regex and category, over documents or pages."""

from __future__ import annotations

import re
import subprocess
import sys
import unicodedata
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, normalize
from ..functions.spans import cut, pieces_of, spans

RESULT_CAP, PREVIEW_CAP, PATTERN_CHARS = 1000, 10_000, 200
_WORD = r"[\p{L}\p{N}_]"


@dataclass(frozen=True)
class Options:
    """How a literal search treats text and query."""

    case_sensitive: bool = False
    whole_word: bool = False
    normalize_unicode: bool = True
    exact_match: bool = False
    smart_punctuation: bool = False
    fold_diacritics: bool = False
    strip_separators: bool = False
    conjunction: bool = False


@dataclass(frozen=True)
class SavedSearch:
    """A query that can be stored as JSON and run again; unknown keys are refused."""

    mode: str
    terms: list[str]
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spec: dict) -> SavedSearch:
        unknown = set(spec) - {"mode", "terms", "options"} | set(spec.get("options", {})) - set(asdict(Options()))
        if unknown or spec.get("mode") not in ("literal", "regex", "multi", "category"):
            raise ValueError(f"not a search: {sorted(unknown) or spec.get('mode')}")
        return cls(spec["mode"], list(spec["terms"]), dict(spec.get("options", {})))

    def run(self, texts: DataFrame) -> DataFrame:
        options = Options(**self.options)
        if self.mode == "regex":
            return regex(texts, self.terms[0], options.whole_word)
        if self.mode == "category":
            from .detect import detected

            return detected(texts, self.terms)
        return multi(texts, self.terms, options) if self.mode == "multi" else literal(texts, self.terms[0], options)


def unsafe(pattern: str) -> str | None:
    """Why a pattern must not run: too long, invalid, empty match, or more repetition than a long row bears.

    Java's matcher has no time limit for a row, so this is decided before
    planning. The pattern is scanned once: a repeated group must not hold a
    repetition, an option or an alternative, a repeat count stays below 1000, and
    at most three open repetitions stand in a row of one level without a
    character between them that the repeated ones cannot match.
    """
    if not pattern or len(pattern) > PATTERN_CHARS:
        return "length"
    # classes by Unicode property are Java's; Python checks the rest of the grammar
    try:
        if re.compile(re.sub(r"\\[pP](\{\w+\}|\w)", lambda m: r"\w" if m[0][1] == "p" else r"\W", pattern)).search("") is not None:
            return "matches the empty string"
    except re.error:
        return "invalid"
    return _repetition(pattern)


_REPEAT = re.compile(r"[*+?]|\{(\d*)(,(\d*))?\}")
_ATOM = re.compile(r"\\[pP](?:\{\w+\}|\w)|\\x\{\w+\}|\\x\w\w|\\u\w{4}|\\Q.*?\\E|\\.|\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]", re.S)


def _repetition(pattern: str) -> str | None:
    """The first shape that makes matching take more than a few passes over a row."""
    # of each open group: it holds a repetition, an option or an alternative; atoms repeated without bound in a row
    stack, at, last = [[False, []]], 0, None
    while at < len(pattern):
        atom = _ATOM.match(pattern, at)
        c = pattern[at]
        if atom:
            last, at = atom[0], atom.end()
        elif c == "(":
            stack.append([False, []])
            at += 1
            head = re.match(r"\?(?:[imsux-]+:|[:=!>]|<[=!]|P?<\w+>)", pattern[at:])
            at += head.end() if head else 0
            continue
        elif c == ")":
            inner = stack.pop() if len(stack) > 1 else [False, []]
            stack[-1][0] |= inner[0]
            last, at = inner, at + 1
        elif c == "|":
            stack[-1][0], last, at = True, None, at + 1
            stack[-1][1] = []
            continue
        elif c in "^$":
            at += 1
            continue
        else:
            last, at = c, at + 1
        repeat = _REPEAT.match(pattern, at)
        if not repeat:
            if isinstance(last, str):
                stack[-1][1] = [x for x in stack[-1][1] if _meet(x, last)]
            continue
        low, many = repeat[1], repeat[0]
        high = repeat[3] if repeat[2] else low
        open_ = many in "*+" or (repeat[2] and high == "")
        if any(x and int(x) >= 1000 for x in (low, high) if x):
            return "repeat count"
        # a group that holds choices must not be repeated, be it a bounded number of times
        if isinstance(last, list) and last[0] and many != "?" and not (many.startswith("{") and high and int(high) <= 1):
            return "nested repetition"
        stack[-1][0] = True
        at = repeat.end() + (pattern[repeat.end() : repeat.end() + 1] in ("?", "+"))
        if open_ or (repeat[2] and int(high) - int(low or 0) > 100):
            stack[-1][1].append(last if isinstance(last, str) else "(")
            if len(stack[-1][1]) > 3:
                return "repetitions in a row"
    return None


def _meet(repeated: str, literal: str) -> bool:
    """Whether a repeated atom can match the atom that follows it, as far as one sees."""
    if repeated == "(" or literal.startswith(("[", "\\p", "\\P", ".")) or repeated.startswith(("\\p", "\\P")):
        return True
    sample = literal[1:] if literal.startswith("\\") and not literal[1:2].isalnum() else {"\\d": "5", "\\w": "a", "\\s": " "}.get(literal, literal)
    try:
        return len(sample) == 1 and re.fullmatch(repeated, sample, re.S) is not None
    except re.error:
        return True


#: What a pattern is tried on before a run: text, other letters, a long run of one letter, text; and the seconds it may take.
SENTINEL_CHARS, SENTINEL_SECONDS = 10_240, 2.0


def sentinel() -> str:
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:!?-_/()[]{}<>@#$%^&*+=\"'\n"
    head = plain * (4000 // len(plain) + 1) + "αβγδεζ∑√∞" + "a" * 2048 + "b" + "1" * 1024 + "x"
    return (head + plain * 100)[:SENTINEL_CHARS]


_TRIAL = "import re, sys\np, t = sys.stdin.read().split('\\0')\nfor _ in re.compile(p).finditer(t): pass"


def slow(pattern: str, seconds: float = SENTINEL_SECONDS) -> bool:
    """Whether a backtracking matcher takes longer than that over the sentinel text; it runs in a process of its own, which is ended then."""
    plain = re.sub(r"\\[pP](\{\w+\}|\w)", lambda m: r"\w" if m[0][1] == "p" else r"\W", pattern)
    try:
        return subprocess.run([sys.executable, "-c", _TRIAL], input=f"{plain}\0{sentinel()}".encode(), timeout=seconds, capture_output=True, check=False).returncode != 0
    except subprocess.TimeoutExpired:
        return True


def checked_terms(terms: list[str]) -> list[str]:
    """Trimmed, not empty, at most 200 characters, no term twice (whatever its case)."""
    out: dict[str, str] = {}
    for t in (x.strip() for x in terms):
        if not t or len(t) > PATTERN_CHARS:
            raise ValueError(f"not a search term: {t[:20]!r}")
        out.setdefault(t.lower(), t)
    return list(out.values())


def _unspaced(text: Column) -> Column:
    """Most letters of the first 500 characters are Han, Kana or Hangul: words have no bounds to test."""
    letters = F.regexp_replace(F.left(text, F.lit(500)), r"\P{L}", "")
    return F.length(F.regexp_replace(letters, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "")) * 2 > F.length(letters)


def _whole(pieces: Column, start: Column, len_: Column, size: Column) -> Column:
    """The neighbours of a hit are no word characters."""
    before, after = cut(pieces, F.greatest(start - 1, F.lit(0)), F.lit(1)), cut(pieces, start + len_, F.lit(1))
    return ((start == 0) | ~before.rlike(_WORD)) & ((start + len_ >= size) | ~after.rlike(_WORD))


def snippet(pieces: Column, start: Column, len_: Column, size: Column, side: int = 20) -> Column:
    """The hit with its surroundings on one line, with an ellipsis where text is cut off."""
    left = F.greatest(start - side, F.lit(0))
    end = F.least(start + len_ + side, size)
    body = F.translate(cut(pieces, left, end - left), "\n", " ")
    return F.concat(F.when(left > 0, "…").otherwise(""), body, F.when(end < size, "…").otherwise(""))


def _cut_out(rows: DataFrame, text: str, keep: tuple[str, ...], whole_word: bool) -> DataFrame:
    """keep..., term, start, len, matched, snippet for each of hits(term, start, len), cut from pieces of the text.

    All is cut before a hit becomes a row, as a row would carry the pieces. The
    array of hits is no filter, which would be pushed down and find them twice.
    """
    some = lambda c: F.when(F.size("hits") > 0, c)
    rows = rows.select(*keep, "hits", some(pieces_of(F.col(text))).alias("pieces"), some(F.length(text)).alias("size"), some(_unspaced(F.col(text))).alias("unspaced"))

    def whole(s: Column) -> Column:
        at = s["start"], s["len"]
        parts = [s["term"].alias("term"), s["start"].cast("int").alias("start"), s["len"].cast("int").alias("len"), cut(F.col("pieces"), *at).alias("matched"), snippet(F.col("pieces"), *at, F.col("size")).alias("snippet")]
        return F.struct(*parts, (F.col("unspaced") | _whole(F.col("pieces"), *at, F.col("size"))).alias("apart")) if whole_word else F.struct(*parts)

    out = rows.select(*keep, F.inline(F.transform("hits", whole)))
    return out.where("apart").drop("apart") if whole_word else out


def _searched(texts: DataFrame, terms: list[str], options: Options, keep: tuple[str, ...]) -> DataFrame:
    """keep..., term, start, len, matched, snippet of the original text: all terms in one pass over it.

    What is searched is a form of the text (composed, without typographic marks,
    diacritics or separators, as the options say) with the original place of each
    of its characters, so hits are cut from the text as it is.
    """
    rows = texts.select(*keep, F.col("text").alias("base")).where("base IS NOT NULL")
    page, queries, place = F.col("base"), list(terms), None
    if options.normalize_unicode:
        rows = rows.withColumn("composed", normalize.mapped(F.col("base"))).withColumn("page", F.coalesce("composed.text", "base")).withColumn("place", F.col("composed.places")).drop("composed")
        page, place, queries = F.col("page"), F.col("place"), [unicodedata.normalize("NFKC", q) for q in queries]
    if options.smart_punctuation:
        page, queries = normalize.smart_punctuation(page), [q.translate(str.maketrans(*fixed.MARKS)) for q in queries]
    for wanted, form, origin, query in (
        (options.fold_diacritics, normalize.fold_diacritics, normalize.fold_map, normalize._fold),
        (options.strip_separators, normalize.strip_separators, normalize.separator_map, lambda q: q.translate({ord(c): None for c in fixed.SEPARATORS})),
    ):
        if wanted:
            inner = origin(page)
            rows = rows.select(*(c for c in rows.columns if c not in ("page", "place")), form(page).alias("page"), (inner if place is None else F.when(place.isNull(), inner).otherwise(normalize.compose_maps(place, inner))).alias("place"))
            page, place, queries = F.col("page"), F.col("place"), [query(q) for q in queries]
    if not all(queries):
        raise ValueError("nothing left to search for")

    def hits(term: str, query: str) -> Column:
        pattern = ("" if options.case_sensitive else "(?iu)") + r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
        found = spans(page, pattern)
        if place is None:
            return F.transform(found, lambda s: F.struct(F.lit(term).alias("term"), s["start"].alias("start"), F.length(s["matched"]).alias("len")))

        def origin(s: Column) -> Column:
            last = s["start"] + F.length(s["matched"])
            first, end = F.coalesce(F.element_at(place, s["start"] + 1), s["start"]), F.coalesce(F.element_at(place, last), last - 1)
            # a hit that ends within what a character became takes the marks behind that character too
            following = F.when(last < F.size(place), F.greatest(F.element_at(place, F.least(last + 1, F.size(place))), end + 1)).otherwise(F.length("base"))
            after = F.when(place.isNull(), last).otherwise(end + 1 if options.strip_separators else following)
            return F.struct(F.lit(term).alias("term"), first.alias("start"), (after - first).alias("len"))

        return F.transform(found, origin)

    every = F.concat(*(hits(t, q) for t, q in zip(terms, queries, strict=True)))
    return _cut_out(rows.select(*keep, "base", every.alias("hits")), "base", keep, options.whole_word or options.exact_match)


def literal(texts: DataFrame, term: str, options: Options = Options(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """keep..., term, start, len, matched, snippet of the original text for each hit, left to right."""
    return _searched(texts, [term], options, keep)


def regex(texts: DataFrame, pattern: str, whole_word: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As literal, for a pattern that unsafe() lets pass and that is not slow()."""
    why = unsafe(pattern) or ("takes too long" if slow(pattern) else None)
    if why:
        raise ValueError(f"pattern refused: {why}")
    hits = F.transform(spans(F.col("text"), pattern), lambda s: F.struct(F.lit(pattern).alias("term"), s["start"].alias("start"), F.length(s["matched"]).alias("len")))
    return _cut_out(texts.where("text IS NOT NULL").select(*keep, "text", hits.alias("hits")), "text", keep, whole_word)


def multi(texts: DataFrame, terms: list[str], options: Options = Options(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """Hits of any term, in one pass over the texts; with conjunction, of documents that hold every term."""
    terms = checked_terms(terms)
    out = _searched(texts, terms, options, keep)
    if options.conjunction:
        full = out.groupBy(*keep).agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len(terms)).select(*keep)
        out = out.join(full, list(keep), "left_semi")
    return out


def capped(hits: DataFrame, order: list[str], cap: int = RESULT_CAP) -> tuple[DataFrame, Column]:
    """The first `cap` hits, and whether there are more, as a column of a one-row table's count."""
    more = hits.limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return hits.orderBy(*order).limit(cap), more.select((F.col("n") > cap).alias("saturated"))


def preview(texts: DataFrame, terms: list[str], options: Options = Options()) -> DataFrame:  # noqa: B008
    """term, hits, documents, saturated."""
    hits = multi(texts, terms, options)
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents")).withColumn("saturated", F.col("hits") > PREVIEW_CAP)


def grouped(hits: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, hits, terms, first: hits of a document (or of a term), with the first place."""
    return hits.groupBy(by).agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("term")).alias("terms"), F.min("start").alias("first"))


def navigated(hits: DataFrame) -> DataFrame:
    """Adds previous and next: the places of a document's neighbouring hits."""
    order = Window.partitionBy("doc_id").orderBy("start", "term")
    return hits.withColumn("previous", F.lag("start").over(order)).withColumn("next", F.lead("start").over(order))
