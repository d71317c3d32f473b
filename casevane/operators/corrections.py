"""Human corrections as data operators: each gives the changed table and the review rows that keep what was there before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

c = F.col


def _review(kind: str, ident: Column, action: str, before: Column, after: Column, reason: Column) -> list[Column]:
    return [F.lit(kind).alias("entity_type"), ident.cast("string").alias("entity_id"), F.lit(action).alias("action"), before.alias("before"), after.alias("after"), reason.alias("reason")]


def correct_texts(rows: DataFrame, fixes: DataFrame, keys: list[str], kind: str, text: str = "text", confidence: str = "confidence") -> tuple[DataFrame, DataFrame]:
    """Pages or transcript segments with corrected text, and their reviews.

    fixes: keys, new_text, reason, made_at; the last fix of a key wins (of fixes made at one time the greatest text), blank
    ones are refused.  A corrected row has confidence 1 and needs no review; a fix that changes nothing leaves no trace.
    Rows that were corrected before stay marked, if the table has the column ``human_corrected``.
    """
    latest = F.max(F.struct("made_at", "new_text", "reason"))
    last = fixes.filter(F.trim("new_text") != "").groupBy(*keys).agg(latest.alias("f"))
    before = F.coalesce("human_corrected", F.lit(False)) if "human_corrected" in rows.columns else F.lit(False)
    both = rows.join(last, keys, "left").withColumn("hit", F.coalesce(c("f.new_text") != c(text), F.lit(False)))
    own = [x for x in rows.columns if x not in (text, confidence, "human_corrected", "needs_review")]
    fixed = both.select(
        *own,
        F.when(c("hit"), c("f.new_text")).otherwise(c(text)).alias(text),
        F.when(c("hit"), 1.0).otherwise(c(confidence)).alias(confidence),
        (c("hit") | before).alias("human_corrected"),
    )
    ident = F.concat_ws(":", *[c(k).cast("string") for k in keys])
    reviews = both.filter("hit").select(*_review(kind, ident, "correct", c(text), c("f.new_text"), c("f.reason")))
    return fixed, reviews


def rename_speakers(speakers: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speakers (media_id, speaker_id, label, display_name, resolution_status) with confirmed names (media_id, speaker_id, name)."""
    keys = ["media_id", "speaker_id"]
    given = names.filter(F.trim("name") != "").groupBy(*keys).agg(F.max("name").alias("name"))
    both = speakers.join(given, keys, "left")
    hit = c("name").isNotNull()
    named = both.select(*keys, "label", F.coalesce("name", "display_name").alias("display_name"), F.when(hit, "CONFIRMED").otherwise(c("resolution_status")).alias("resolution_status"))
    before = F.coalesce("display_name", "label")
    return named, both.filter(hit & (before != c("name"))).select(*_review("speaker", c("speaker_id"), "rename", before, c("name"), F.lit("")))


def merge_speakers(segments: DataFrame, speakers: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments on the speaker that stays, the speakers left, and reviews.

    merges: media_id, keep_id, drop_id, within one medium; of several merges of one speaker the one into the least id counts.
    Chains (a into b, b into c) are followed by doubling, in a number of steps that is the logarithm of their length at
    most, each written once.  Of speakers merged in a circle the least id stays.  A speaker can't be merged into itself.
    """
    step = merges.filter("keep_id <> drop_id").groupBy("media_id", "drop_id").agg(F.min("keep_id").alias("keep_id"))
    step = cut(step.withColumn("least", F.col("drop_id")))  # the least of the speakers passed on the way
    following = lambda: step.select("media_id", c("drop_id").alias("keep_id"), c("keep_id").alias("later"), c("least").alias("later_least"))
    for _ in range(step.count().bit_length() + 1):
        if not step.join(following(), ["media_id", "keep_id"], "left_semi").limit(1).count():
            break
        step = cut(step.join(following(), ["media_id", "keep_id"], "left").select("media_id", "drop_id", F.coalesce("later", "keep_id").alias("keep_id"), F.least("least", "later_least").alias("least")))
    # What still leads to a merged speaker leads into a circle.
    step = step.join(following(), ["media_id", "keep_id"], "left").select("media_id", "drop_id", F.coalesce("later_least", "keep_id").alias("keep_id")).filter("keep_id <> drop_id")
    gone = step.withColumnRenamed("drop_id", "speaker_id")
    moved = segments.join(gone, ["media_id", "speaker_id"], "left").withColumn("speaker_id", F.coalesce("keep_id", "speaker_id")).drop("keep_id")
    left = speakers.join(gone, ["media_id", "speaker_id"], "left_anti")
    reviews = gone.select(*_review("speaker", c("speaker_id"), "merge", c("speaker_id").cast("string"), c("keep_id").cast("string"), F.lit("")))
    return moved, left, reviews


def diagnose(pages: DataFrame, key: str, mode: str, confidence: str, low: float = 0.55) -> DataFrame:
    """``key, mode, pages, mean_confidence, low_pages, suggestion`` of each document and reading: what to read again."""
    by_mode = pages.groupBy(key, mode).agg(F.count("*").alias("pages"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.count_if(c(confidence) < low).alias("low_pages"))
    worse = (c("mean_confidence") < low) | (c("low_pages") * 2 > c("pages"))
    return by_mode.withColumn("suggestion", F.when(worse, "reprocess").when(c("low_pages") > 0, "review").otherwise("keep"))


def reprocess_plan(pages: DataFrame, key: str, page: str, mode: str, confidence: str, low: float = 0.55, limit: int = 20) -> DataFrame:
    """``key, target, pages``: the ``limit`` worst pages below the limit, as requests to the other engine, one per document."""
    worst = pages.filter(c(confidence) <= low).orderBy(confidence, key, page).limit(limit)  # a stated number of pages
    target = F.when(c(mode) == "document_ai", "basico").otherwise("document_ai")
    return worst.groupBy(key, target.alias("target")).agg(F.array_sort(F.collect_list(page)).alias("pages"))


def last_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each entity."""
    w = Window.partitionBy("entity_type", "entity_id").orderBy(F.desc("made_at"))
    return reviews.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
