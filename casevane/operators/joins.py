"""Relational shapes that recur: term filters, top-one, as-of, interval joins, upserts, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_terms(df: DataFrame, column: str, terms: list[str], least: int = 3) -> DataFrame:
    """Rows that contain every term of at least ``least`` characters, in any case."""
    used = [F.col(column).ilike("%" + t.replace("%", r"\%").replace("_", r"\_") + "%") for t in terms if len(t) >= least]
    return df.filter(reduce(lambda a, b: a & b, used)) if used else df


def top_one(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``keys, top``: the value of the row that is last by ``order``; one aggregate, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("top"))


def as_of_last(df: DataFrame, keys: list[str], order: str, is_source: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the latest source row at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(w))


def as_of_by_type(df: DataFrame, keys: list[str], time: str, ident: str, kind: str, answers: dict[str, list[str]]) -> DataFrame:
    """For rows of an answering kind, the latest other row at or before them whose kind they answer.

    Rows at the same time count (inclusive); of several the largest id wins.  One window per key, no self join.
    """
    out = None
    for source, targets in answers.items():
        w = Window.partitionBy(*keys).orderBy(F.col(time)).rangeBetween(Window.unboundedPreceding, 0)
        target = F.max(F.when(F.col(kind).isin(*targets), F.struct(F.col(time).alias("t"), F.col(ident).alias("i")))).over(w)["i"]
        part = df.withColumn("target", target).filter(F.col(kind) == source)
        out = part if out is None else out.unionByName(part)
    return out


def interval_points(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside spans, both ends included: an equi-join on the key and a time bucket of ``width``."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "_b"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def most_overlap(segments: DataFrame, turns: DataFrame, keys: list[str], ident: str, width: int, unknown: str = "UNKNOWN") -> DataFrame:
    """Each segment (start_ms, end_ms) with the label of the turn (t_start, t_end, label) it overlaps longest.

    Ties go to the turn that starts first; without an overlap the label is ``unknown``.  Equi-join on time buckets.
    """
    s = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.greatest("start_ms", "end_ms") / width))))
    t = turns.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t_start") / width), F.floor(F.greatest("t_start", "t_end") / width))))
    shared = F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start")
    hits = s.join(t, [*keys, "_b"]).withColumn("_o", shared).filter("_o > 0").groupBy(*keys, ident).agg(F.max_by("label", F.struct("_o", -F.col("t_start"))).alias("label"))
    return segments.join(hits, [*keys, ident], "left").withColumn("label", F.coalesce("label", F.lit(unknown)))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the changed ones winning; of several changes for a key the largest row wins."""
    values = [c for c in base.columns if c not in keys]
    both = base.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    return both.groupBy(*keys).agg(F.max(F.struct("_src", *values)).alias("_r")).select(*keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def dominant(df: DataFrame, keys: list[str], value: str, first_by: str) -> DataFrame:
    """The most frequent value per key; ties go to the one seen first."""
    g = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(first_by).alias("_f"))
    return g.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_f"))).alias("value"))


def ancestors(tree: DataFrame, most: int = 20) -> DataFrame:
    """``id, ancestor, depth`` of every node of (id, parent), itself included; one join per level that exists."""
    edges = tree.select(F.col("id").alias("_c"), F.col("parent").alias("_p")).filter("_p is not null")
    level = tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, most + 1):
        level = level.join(edges, F.col("ancestor") == F.col("_c")).select("id", F.col("_p").alias("ancestor"), F.lit(d).alias("depth"))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def rollup_tree(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, name, n``: counts summed over each node's subtree."""
    up = ancestors(tree).join(counts, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("n"))
    return tree.join(up, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def nearest(left: DataFrame, right: DataFrame, key: str, value: str, ident: str, other: str, width: float, digits: int = 2) -> DataFrame:
    """``ident, nearest``: for each left row the right row of its key with the nearest value, the least id on ties.

    Two as-of lookups, one down and one up, instead of all pairs of a key.  Rows meet in slots of ``width`` of the value;
    what lies beyond a slot is looked up in a table with one row per filled slot.
    """
    slot = lambda df: df.withColumn("_slot", F.floor(F.col(value) / width))
    a, b = slot(left), slot(right)
    points = b.groupBy(key, "_slot", value).agg(F.min(other).alias("_o"))
    mark = F.struct(F.col(value).alias("v"), F.col("_o").alias("o"))
    ends = points.groupBy(key, "_slot").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    # For every slot of either side, the last point below it and the first one above.
    slots = a.select(key, "_slot").distinct().join(ends, [key, "_slot"], "full")
    order = Window.partitionBy(key).orderBy("_slot")
    around = slots.select(
        key,
        "_slot",
        F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    none = F.lit(None)
    both = a.select(key, "_slot", F.col(value).alias("_x"), F.col(ident).alias("_i"), none.cast("struct<v:double,o:long>").alias("_p")).unionByName(
        points.select(key, "_slot", F.col(value).alias("_x"), none.cast(left.schema[ident].dataType).alias("_i"), F.struct(F.col(value).cast("double").alias("v"), F.col("_o").cast("long").alias("o")).alias("_p"))
    )
    inside = Window.partitionBy(key, "_slot").orderBy("_x")
    seen = both.withColumn("_down", F.last("_p", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("_up", F.first("_p", ignorenulls=True).over(inside.rangeBetween(0, Window.unboundedFollowing)))
    seen = seen.filter("_i is not null").join(around, [key, "_slot"])
    far = lambda p: F.when(p.isNotNull(), F.struct(F.round(F.abs(F.col("_x") - p["v"]), digits).alias("d"), p["o"].cast("long").alias("o")))
    best = F.least(far(F.coalesce("_down", F.col("_before").cast("struct<v:double,o:long>"))), far(F.coalesce("_up", F.col("_after").cast("struct<v:double,o:long>"))))
    return seen.select(F.col("_i").alias(ident), best["o"].alias("nearest")).filter("nearest is not null")


def last_event(spans: DataFrame, events: DataFrame, key: str, ident: str, start: str, end: Column, time: str, name: str, after: int, before: int | None = None) -> DataFrame:
    """``key, ident, name``: the last event of the key up to ``after`` beyond a span's end, and not earlier than ``before`` ahead of its start.

    One sorted pass over events and spans together; spans without such an event are left out.
    """
    mark = F.struct(F.col(time).cast("long").alias("t"), F.col(name).alias("n"))
    none = F.lit(None)
    seen = events.select(key, F.col(time).cast("long").alias("_at"), mark.alias("_e"), none.cast(spans.schema[ident].dataType).alias("_i"), none.cast("long").alias("_s"))
    asked = spans.select(key, (end + after).cast("long").alias("_at"), none.cast(seen.schema["_e"].dataType).alias("_e"), F.col(ident).alias("_i"), F.col(start).cast("long").alias("_s"))
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    both = seen.unionByName(asked).withColumn("_l", F.max("_e").over(w)).filter("_i is not null and _l is not null")
    near = both if before is None else both.filter(F.col("_l.t") >= F.col("_s") - before)
    return near.select(key, F.col("_i").alias(ident), F.col("_l.n").alias("name"))
