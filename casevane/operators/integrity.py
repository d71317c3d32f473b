"""Tenancy, reference checks, hash chains, state machines and limits as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed transitions of a job and of a case.
JOB_STEPS = {
    "QUEUED": ["RUNNING", "CANCELLED"],
    "RUNNING": ["SUCCEEDED", "FAILED", "RETRYING", "CANCELLED", "QUEUED"],
    "RETRYING": ["RUNNING", "FAILED", "CANCELLED", "QUEUED"],
    "FAILED": ["RETRYING"],
    "SUCCEEDED": [],
    "CANCELLED": [],
}
CASE_STEPS = {
    "CREATED": ["UPLOADING", "INGESTING", "ARCHIVED"],
    "UPLOADING": ["INGESTING", "FAILED"],
    "INGESTING": ["PROCESSING", "FAILED"],
    "PROCESSING": ["PARTIALLY_READY", "READY_FOR_REVIEW", "FAILED"],
    "PARTIALLY_READY": ["PROCESSING", "READY_FOR_REVIEW", "FAILED"],
    "READY_FOR_REVIEW": ["REVIEWING", "PROCESSING"],
    "REVIEWING": ["READY", "READY_FOR_REVIEW", "PROCESSING"],
    "READY": ["PROCESSING", "REVIEWING", "ARCHIVED"],
    "FAILED": ["PROCESSING", "ARCHIVED"],
    "ARCHIVED": [],
}
# Errors after which a job is tried again.
RETRYABLE = ("network_error", "model_timeout", "schema_error", "provider_unavailable")


def tenant(df: DataFrame, organization: str | None, column: str = "organization_id") -> DataFrame:
    """Only the tenant's rows; none without a tenant."""
    return df.filter(F.lit(False)) if organization is None else df.filter(F.col(column) == organization)


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose parent (or tenant) is missing."""
    named = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(keys.values())]).distinct()
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(keys)]
    return child.join(named, on, "left_anti")


def changed_or_gone(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change`` for rows of an append-only table that differ from an earlier snapshot."""
    h = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias(n))
    both = h(before, "a").join(h(after, "b"), key, "left")
    return both.select(key, F.when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").alias("change")).filter("change is not null")


def link_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def broken_links(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a log (prev_hash, hash, payload) whose link or content does not check out."""
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.lag("hash").over(w).eqNullSafe(F.col("prev_hash")) & (F.col("hash") == link_hash(F.coalesce("prev_hash", F.lit("")), F.col("payload")))
    return log.withColumn("_ok", ok).filter("not _ok").drop("_ok")


def invalid_steps(steps: DataFrame, allowed: dict[str, list[str]] = JOB_STEPS) -> DataFrame:
    """Rows (from, to) that the state machine does not allow."""
    known = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    return steps.filter(~F.coalesce(F.array_contains(known, F.concat("from", F.lit(">"), "to")), F.lit(False)))


def backoff(attempt: Column, jitter: Column) -> Column:
    """Seconds before a retry."""
    return 30 * F.pow(F.lit(2), attempt) + F.least(jitter, F.lit(15))


def over_rate(df: DataFrame, key: str, time: str, seconds: int, most: int) -> DataFrame:
    """``key, window_start, n`` of fixed windows with more than ``most`` rows."""
    slot = F.window(F.col(time).cast("timestamp"), f"{seconds} seconds")
    return df.groupBy(key, slot.alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.col("w.start").alias("window_start"), "n")
