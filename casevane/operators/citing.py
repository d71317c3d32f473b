"""Citations against their primary text: whether they hold, and which source supports a claim instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

c = F.col
#: Shares of a claim's terms that its own source, and another source, must have; below the first, what is kept for review.
SUPPORT, ELSEWHERE, REVIEW = 0.34, 0.5, 0.20


def validity(citations: DataFrame, pages: DataFrame, segments: DataFrame) -> DataFrame:
    """``citation_id, valid, reasons``: what is wrong with each citation, in this order (V5).

    citations: citation_id, case_id, source_type, document_id, page_number, char_start, char_end, quote_hash, media_id,
    segment_id, start_ms, end_ms; pages: case_id, document_id, page_number, text; segments: case_id, media_id, segment_id,
    start_ms, end_ms.  Offsets count characters; the hash is that of the quoted characters.  A page or segment that isn't
    there is the only reason given.  Sources are unique by their keys.
    """
    of_page = pages.select(c("case_id").alias("p_case"), "document_id", "page_number", "text", F.lit(True).alias("p_there"))
    of_segment = segments.select(c("case_id").alias("s_case"), c("media_id").alias("s_media"), "segment_id", c("start_ms").alias("s_start"), c("end_ms").alias("s_end"), F.lit(True).alias("s_there"))
    is_page = c("source_type") == "document_page"
    both = citations.filter(is_page).join(of_page, ["document_id", "page_number"], "left")
    text = F.coalesce("text", F.lit(""))
    beyond = c("char_end") > F.length(text)
    quote = F.substring(text, c("char_start") + 1, c("char_end") - c("char_start"))
    hashed = c("char_start").isNotNull() & ~beyond & (F.trim("quote_hash") != "") & (F.sha2(quote, 256) != F.trim("quote_hash"))
    differs = lambda a, b: ~c(a).eqNullSafe(c(b))
    page_reasons = _reasons(c("p_there"), "page_not_found", ("case_mismatch", differs("p_case", "case_id")), ("offset_out_of_range", c("char_start").isNotNull() & beyond), ("quote_hash_mismatch", hashed))
    spoken = citations.filter(~is_page | c("source_type").isNull()).join(of_segment, "segment_id", "left")
    outside = (c("start_ms") < c("s_start")) | (c("end_ms") > c("s_end"))
    said_reasons = _reasons(c("s_there"), "segment_not_found", ("media_mismatch", differs("s_media", "media_id")), ("case_mismatch", differs("s_case", "case_id")), ("timestamp_out_of_segment", outside))
    told = both.select("citation_id", page_reasons.alias("reasons")).unionByName(spoken.select("citation_id", said_reasons.alias("reasons")))
    return told.select("citation_id", (F.size("reasons") == 0).alias("valid"), "reasons")


def _reasons(there: Column, missing: str, *checks: tuple[str, Column]) -> Column:
    found = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))
    return F.when(there, found).otherwise(F.array(F.lit(missing)))


def support(claims: DataFrame, citations: DataFrame, items: DataFrame, required: Callable[[Column, Column], Column] = lambda claim, source: F.lit(True), limit: float = SUPPORT) -> DataFrame:
    """``case_id, claim_id, status, handles, overlap``: claims held against the primary text of what they cite (V4).

    claims: case_id, claim_id, text; citations: case_id, claim_id, handle; items: case_id, handle, text, citable.  A claim
    without a citable source is an ``invalid_citation``.  Enough of its terms in the cited texts together, no number missing and
    whatever ``required`` asks for: ``supported``.  Else the one citable item of the case with the greatest share (half at
    least, equal ones by handle) that has all numbers takes its place: ``reassigned``.  Else a lesser share without a missing
    number is kept for ``review``, the rest is ``not_grounded``.  An answer has a handful of items, which join on the case.
    """
    keys = ["case_id", "claim_id"]
    said = claims.filter(F.trim("text") != "").select(*keys, c("text").alias("claim"), T.content_set(c("text")).alias("terms"))
    usable = items.filter("citable").select("case_id", "handle", c("text").alias("source"))
    cited = citations.select(*keys, "handle").distinct().join(usable, ["case_id", "handle"])
    own = cited.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("handle", "source"))).alias("cites"))  # the sources of one claim
    own = own.select(*keys, F.transform("cites", lambda x: x["handle"]).alias("handles"), F.array_join(F.transform("cites", lambda x: F.coalesce(x["source"], F.lit(""))), " ").alias("source"))
    share = lambda: F.round(T.share_in(c("terms"), T.content_set(c("source"))), 6)
    whole = F.size(T.missing_numbers(c("claim"), c("source"))) == 0
    judged = said.join(own, keys, "left").withColumn("overlap", F.when(c("source").isNotNull(), share())).withColumn("sound", whole & required(c("claim"), c("source")))
    weak = judged.filter(c("source").isNotNull() & ~((c("overlap") >= limit) & c("sound"))).select(*keys, "claim", "terms")
    others = weak.join(usable, "case_id").withColumn("s", share()).filter((c("s") >= ELSEWHERE) & whole & required(c("claim"), c("source")))
    best = others.groupBy(*keys).agg(F.min(F.struct((-c("s")).alias("s"), "handle")).alias("best"))
    out = judged.join(best, keys, "left")
    status = (
        F.when(c("source").isNull(), "invalid_citation")
        .when((c("overlap") >= limit) & c("sound"), "supported")
        .when(c("best").isNotNull(), "reassigned")
        .when((c("overlap") >= REVIEW) & c("sound"), "review")
        .otherwise("not_grounded")
    )
    handles = F.when(c("source").isNull(), F.slice(F.array("best.handle"), 1, 0)).when(status == "reassigned", F.array("best.handle")).otherwise(c("handles"))
    return out.select(*keys, status.alias("status"), handles.alias("handles"), F.when(status == "reassigned", -c("best.s")).otherwise(c("overlap")).alias("overlap"))
