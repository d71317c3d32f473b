"""Facts for a question, each with one primary source found by a cascade of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking
from .common import cut
from .search import ranked

c = F.col
#: Distinct terms: of a question to be asked at all, and of a fact in the source that proves it.
LEAST_TERMS = 2
#: Sources by rank that are looked at before a step gives up.
LOOKED_AT = 8
#: What is known to be proven comes before what some evidence supports, then the rest: fixed values.
PRIORITY = {"JUDICIALLY_PROVEN": 0, "ADMITTED": 0, "EVIDENCE_SUPPORTED": 1}
# Months in file names of recordings.
_SHORT = {
    "enero": "ene", "febrero": "feb", "marzo": "mar", "abril": "abr", "mayo": "may", "junio": "jun", "julio": "jul", "agosto": "ago",
    "septiembre": "sep", "setiembre": "sep", "octubre": "oct", "noviembre": "nov", "diciembre": "dic",
}
_DATE = rf"(?iu)\b([0-9]{{1,2}})\s+de\s+({'|'.join(_SHORT)})\s+(?:de\s+)?([0-9]{{4}})\b"
SOURCE = ["document_id", "page_number", "media_id", "segment_id", "start_ms"]


def first_found(rows: DataFrame, keys: list[str], steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows of the first step that finds something for a key, with ``step`` from 1; later steps see the rest only.

    Each step takes the rows that are left and returns some of their keys with the columns found, a row a key.
    """
    rest, out = cut(rows), None
    for n, step in enumerate(steps, 1):
        found = cut(step(rest).withColumn("step", F.lit(n)))
        out = found if out is None else out.unionByName(found)
        rest = cut(rest.join(found.select(*keys), keys, "left_anti"))
    return out


def proves(text: Column, terms: Column) -> Column:
    """Whether a source has enough of the distinct terms of a fact, as they are or by their stem."""
    known = T.content_set(text)
    return T.bound(T.fold(text), lambda t: T.bound(known, lambda k: F.size(F.filter(terms, lambda x: F.contains(t, x) | F.array_contains(k, T.stem(x)))) >= LEAST_TERMS))


def _days(text: Column) -> Column:
    """Dates of a fact as recordings are named after them, such as 7mar2024."""
    whole = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_DATE), F.lit(0))
    month = F.create_map(*[F.lit(x) for pair in _SHORT.items() for x in pair])
    part = lambda x, i: F.regexp_extract(x, _DATE, i)
    return F.array_distinct(F.transform(whole, lambda x: F.concat(part(x, 1).cast("int").cast("string"), F.try_element_at(month, F.lower(part(x, 2))), part(x, 3))))


def _named_days(filename: Column) -> Column:
    """The dates in a file name, a day of two digits also as its last digit."""
    found = F.regexp_extract_all(F.lower(filename), F.lit(rf"[0-9]{{1,2}}(?:{'|'.join(sorted(set(_SHORT.values())))})[0-9]{{4}}"), F.lit(0))
    short = F.transform(found, lambda x: F.regexp_replace(x, "^[0-9]([0-9][a-z])", "$1"))
    bare = F.transform(F.concat(found, short), lambda x: F.regexp_replace(x, "^0([0-9])", "$1"))
    return F.array_distinct(F.concat(found, short, bare))


def facts_for_questions(
    questions: DataFrame,
    facts: DataFrame,
    pages: DataFrame,
    segments: DataFrame,
    media: DataFrame,
    citations: DataFrame,
    positions: DataFrame,
    links: DataFrame,
    limit: int = 6,
) -> DataFrame:
    """``question_id, place, fact_id, step, document_id, page_number, media_id, segment_id, start_ms``.

    questions: question_id, text; facts: fact_id, text, proof_status; pages: page_id, document_id, page_number, text;
    segments: segment_id, media_id, start_ms, text; media: media_id, filename; citations: citation_id, fact_id (null if it
    is not of a fact), document_id, page_number, media_id, segment_id, start_ms; positions: fact_id, citation_id; links:
    fact_id, document_id, media_id.  Ids are whole numbers.

    The facts that rank best for a question come in order of proof, then rank.  Each gets one source: (1) the best segment
    of recordings named after a date in the fact, (2) its own citation, (3) the citation of a position on it, (4) the best page
    of linked documents, (5) the best segment of linked recordings, (6) the best page of all, (7) the best segment of all.
    A source ranks by the question's terms, and must have two terms of the fact itself.  Facts without a source and facts
    with the source of an earlier one are left out.
    """
    asked = questions.select("question_id", F.explode(T.content_set(c("text"))).alias("term")).distinct()
    enough = asked.groupBy("question_id").agg(F.count("*").alias("n")).filter(c("n") >= LEAST_TERMS)
    asked = cut(asked.join(enough.select("question_id"), "question_id", "left_semi"))

    rank = ranked(ranking.plain_rank(facts, asked, "fact_id", "question_id"), "question_id", "fact_id", 3 * limit)
    known = facts.select("fact_id", "text", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), c("proof_status")), F.lit(2)).alias("priority"))
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("priority", "rank"))
    picked = rank.join(known, "fact_id").withColumn("place", order).withColumn("terms", T.content_terms(c("text")))
    candidates = picked.filter(F.size("terms") >= LEAST_TERMS).select("question_id", "fact_id", "place", "terms", _days(c("text")).alias("days"))
    keys = ["question_id", "fact_id"]

    page_terms = cut(ranking.positions(pages, "page_id").select("page_id", "term", F.size("places").alias("n")).join(asked.select("term").distinct(), "term", "left_semi"))
    segment_terms = cut(ranking.positions(segments, "segment_id").select("segment_id", "term", F.size("places").alias("n")).join(asked.select("term").distinct(), "term", "left_semi"))
    of_page = pages.select("page_id", "document_id", "page_number", F.lit(None).cast("long").alias("media_id"), F.lit(None).cast("long").alias("segment_id"), F.lit(None).cast("long").alias("start_ms"), "text")
    of_segment = segments.select("segment_id", F.lit(None).cast("long").alias("document_id"), F.lit(None).cast("long").alias("page_number"), "media_id", c("start_ms").cast("long").alias("start_ms"), "text")

    def best(scored: DataFrame, sources: DataFrame, key: str, by: str) -> DataFrame:
        """The first source by rank that proves the fact, of (question, fact, terms, key, score) that may."""
        first = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), by, key)
        near = cut(scored.join(sources.select(key, by), key).withColumn("at", F.row_number().over(first)).filter(c("at") <= LOOKED_AT))
        ok = near.drop(by).join(sources.withColumn("key", c(key)), key).filter(proves(c("text"), c("terms")))
        columns = F.struct(*[c("key").alias("segment_id") if (x == "segment_id" and key == "segment_id") else c(x) for x in SOURCE])
        return ok.groupBy(*keys).agg(F.min_by(columns, "at").alias("s")).select(*keys, "s.*")

    def scoped(rest: DataFrame, allowed: DataFrame, terms: DataFrame, key: str) -> DataFrame:
        """Scores of the sources that each fact may use: joined on (source, term), never on a term alone."""
        met = rest.join(allowed, keys).join(asked, "question_id").join(terms, [key, "term"])
        return met.groupBy(*keys, "terms", key).agg((ranking.WEIGHT * F.sum("n")).alias("score"))

    def anywhere(texts: DataFrame, key: str) -> DataFrame:
        """The best sources of each question among all, equal scores by id."""
        return ranking.density_top_k(texts, asked, key, LOOKED_AT, "question_id").select("question_id", key, "score")

    def cited(own: DataFrame) -> DataFrame:
        at = F.struct(c("page_number").isNull(), "page_number", c("start_ms").isNull(), "start_ms", "citation_id")
        return own.groupBy(*keys).agg(F.min_by(F.struct(*SOURCE), at).alias("s")).select(*keys, "s.*")

    def dated(rest: DataFrame) -> DataFrame:
        named = media.select("media_id", F.explode(_named_days(c("filename"))).alias("day"))
        two = named.withColumn("rn", F.row_number().over(Window.partitionBy("day").orderBy("media_id"))).filter("rn <= 2").drop("rn")
        allowed = rest.select(*keys, F.explode("days").alias("day")).join(two, "day").join(segments.select("media_id", "segment_id"), "media_id").select(*keys, "segment_id").distinct()
        return best(scoped(rest, allowed, segment_terms, "segment_id"), of_segment, "segment_id", "start_ms")

    def by_target(rest: DataFrame) -> DataFrame:
        return cited(rest.select(*keys).join(citations, "fact_id"))

    def by_position(rest: DataFrame) -> DataFrame:
        return cited(rest.select(*keys).join(positions.select("fact_id", "citation_id").distinct(), "fact_id").join(citations.drop("fact_id"), "citation_id"))

    def linked_pages(rest: DataFrame) -> DataFrame:
        allowed = rest.select(*keys).join(links.filter("document_id is not null").select("fact_id", "document_id").distinct(), "fact_id").join(pages.select("document_id", "page_id"), "document_id").select(*keys, "page_id")
        return best(scoped(rest, allowed, page_terms, "page_id"), of_page, "page_id", "page_number")

    def linked_segments(rest: DataFrame) -> DataFrame:
        allowed = rest.select(*keys).join(links.filter("media_id is not null").select("fact_id", "media_id").distinct(), "fact_id").join(segments.select("media_id", "segment_id"), "media_id").select(*keys, "segment_id")
        return best(scoped(rest, allowed, segment_terms, "segment_id"), of_segment, "segment_id", "start_ms")

    def any_page(rest: DataFrame) -> DataFrame:
        return best(rest.join(anywhere(pages, "page_id"), "question_id").select(*keys, "terms", "page_id", "score"), of_page, "page_id", "page_number")

    def any_segment(rest: DataFrame) -> DataFrame:
        return best(rest.join(anywhere(segments, "segment_id"), "question_id").select(*keys, "terms", "segment_id", "score"), of_segment, "segment_id", "start_ms")

    found = first_found(candidates, keys, [dated, by_target, by_position, linked_pages, linked_segments, any_page, any_segment])
    placed = found.join(candidates.select(*keys, "place"), keys)
    same = F.when(c("document_id").isNotNull() & c("page_number").isNotNull(), F.struct(F.lit("doc").alias("k"), c("document_id").alias("a"), c("page_number").alias("b"))).otherwise(F.struct(F.lit("seg").alias("k"), c("segment_id").alias("a"), F.lit(None).cast("long").alias("b")))
    item = placed.withColumn("same", same).filter(c("same.a").isNotNull() & (c("document_id").isNotNull() | c("start_ms").isNotNull()))
    once = item.withColumn("rn", F.row_number().over(Window.partitionBy("question_id", "same").orderBy("place"))).filter("rn = 1")  # a few facts of one question
    last = once.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).filter(c("place") <= limit)
    return last.select("question_id", "place", "fact_id", "step", *SOURCE)
