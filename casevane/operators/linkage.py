"""Record linkage: consolidation of names and events, reference absorption, greedy matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def name_ratio(a: Column, b: Column) -> Column:
    """Likeness of two strings by edit distance; 1 when one contains the other."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.contains(b) | b.contains(a), F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def consolidate_entities(df: DataFrame, ident: str, name: str, kind: str, key: Column) -> DataFrame:
    """``key, canonical, kind, aliases, n`` per normalised name: first row is canonical, the dominant kind wins (L1)."""
    rows = df.withColumn("_k", key).filter("_k <> ''")
    kinds = rows.groupBy("_k", kind).agg(F.count("*").alias("_n"), F.min(ident).alias("_f")).groupBy("_k").agg(F.max_by(kind, F.struct("_n", -F.col("_f"))).alias("kind"))
    base = rows.groupBy("_k").agg(F.min(ident).alias("canonical"), F.min_by(name, ident).alias("_first"), F.collect_set(name).alias("_names"), F.count("*").alias("n"))
    return base.join(kinds, "_k").select(F.col("_k").alias("key"), "canonical", "kind", F.array_sort(F.array_remove(F.col("_names"), F.col("_first"))).alias("aliases"), "n")


def consolidate_events(events: DataFrame, bucket: list[str], ident: str, day: str, page: str, terms: str) -> DataFrame:
    """``ident, duplicate_of``: seed-based clusters within a bucket (L2).

    Events are taken in order of day (null last) and id; each is compared with the first event of every cluster only:
    same page, or same day with likeness 0.55, up to three days apart with 0.75, undated with 0.85.  The first seed that
    fits wins.  One shuffle brings buckets together in order; a task scans its rows once, whatever the number and size
    of its buckets.  Seeds are found by page and by day, so only those of the last three days are looked at.
    """
    kind = events.schema[ident].dataType.simpleString()
    keys = len(bucket)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seeds = None, None
        for rows in batches:
            found = []
            columns = [c.to_pylist() for c in rows.columns]
            for key, (i, d, p, words) in zip(zip(*columns[:keys], strict=True), zip(*columns[keys:], strict=True), strict=True):
                if key != current:
                    current, seeds = key, _Seeds()
                found.append(seeds.place(i, d, p, frozenset(words or ())))
            yield pa.RecordBatch.from_arrays([rows.column(keys), pa.array(found, rows.column(keys).type)], names=[ident, "duplicate_of"])

    rows = events.select(*bucket, ident, day, page, terms).repartition(*bucket).sortWithinPartitions(*bucket, F.col(day).asc_nulls_last(), ident)
    return rows.mapInArrow(scan, f"`{ident}` {kind}, duplicate_of {kind}")


class _Seeds:
    """First events of the clusters of one bucket."""

    def __init__(self):
        self.count = 0
        self.by_page: dict = {}
        self.by_day: dict = defaultdict(list)

    def place(self, ident, day, page, words: frozenset):
        """The seed that takes the event in, or none: then it is a seed itself."""
        able = [self.by_page[page]] if page is not None and page in self.by_page else []
        if day is None:
            near = [(seed, 0.85) for seeds in self.by_day.values() for seed in seeds]
        else:
            near = [(seed, 0.75 if back else 0.55) for back in range(4) for seed in self.by_day.get(day - back, ())]
        able += [seed[:2] for seed, least in near if len(words & seed[2]) >= least * len(words | seed[2]) and (words or seed[2])]
        if able:
            return min(able)[1]
        self.by_day[day].append((self.count, ident, words))
        if page is not None:
            self.by_page.setdefault(page, (self.count, ident))
        self.count += 1
        return None


def absorb_references(references: DataFrame, events: DataFrame, keys: list[str], days: int = 45, accept: float = 0.6) -> DataFrame:
    """``ref_id, event_id, score``: the best real event of each reference within ``days`` (L3).

    Both sides have keys, day (int), subtype and terms.  Equi-join on the keys and a band of days, so no cross product.
    """
    r = references.withColumn("_b", F.explode(F.array(*[F.floor(F.col("day") / days) + k for k in (-1, 0, 1)])))
    e = events.select(*keys, "event_id", F.col("day").alias("e_day"), F.col("subtype").alias("e_subtype"), F.col("terms").alias("e_terms"), F.floor(F.col("day") / days).alias("_b"))
    alike = jaccard(F.col("terms"), F.col("e_terms"))
    same = F.col("subtype") == F.col("e_subtype")
    gap = F.abs(F.col("day") - F.col("e_day"))
    score = F.when(same, 0.6).otherwise(0.3) + F.when(gap == 0, 0.4).otherwise(0.2) + 0.4 * alike
    pairs = r.join(e, [*keys, "_b"]).filter((gap <= days) & (same | (alike >= 0.5))).withColumn("score", F.round(score, 6)).filter(F.col("score") >= accept)
    best = F.max_by(F.struct("event_id", "score"), F.struct("score", -F.col("event_id")))
    return pairs.groupBy("ref_id").agg(best.alias("b")).select("ref_id", "b.event_id", "b.score")


def greedy_pairs(pairs: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one matching in order of score within each group."""
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in (group, left, right, score))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        for i, l, r in pdf.sort_values([score, left, right], ascending=[False, True, True])[[left, right]].itertuples():
            if l not in used_l and r not in used_r:
                used_l.add(l)
                used_r.add(r)
                keep.append(i)
        return pdf.loc[keep, [group, left, right, score]]

    return pairs.groupBy(group).applyInPandas(match, kinds)


def keep_best(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """``keys, value``: the value of the first row of each key; partial minima meet, not rows."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def token_pairs(names: DataFrame, name: str, tokens: str, common: int = 1, share: float = 0.0, contained: bool = False) -> DataFrame:
    """``name, other, s, z``: pairs of different names (name < other) that may share ``common`` tokens and ``share`` of both.

    Tokens are ordered by how rare they are.  Names with ``k`` tokens in common meet within the first ``n - k + 1`` of
    each, so only this prefix is joined, and tokens that very many names have come last and are hardly ever in it.  With
    ``contained`` a name also meets all names that have its rarest token.
    """
    rows = names.select(name, F.explode(tokens).alias("w"))
    df = rows.groupBy("w").agg(F.count("*").alias("df"))
    ranked = rows.join(df, "w").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("r"))  # one array per name
    n = F.size("r")
    need = F.greatest(F.lit(common), F.ceil(F.lit(share) * n).cast("int"))
    item = F.col("p")
    short = ranked.select(name, F.posexplode(F.slice("r", F.lit(1), F.greatest(F.lit(0), n - need + 1))).alias("i", "p")).select(name, item["w"].alias("w"))
    met = short.join(short.withColumnRenamed(name, "other"), "w")
    if contained:
        first = ranked.select(name, F.get("r", F.lit(0))["w"].alias("w"))
        all_words = rows.withColumnRenamed(name, "other")
        met = met.select(name, "other").union(first.join(all_words, "w").select(name, "other"))
    pairs = met.where(F.col(name) != F.col("other")).select(F.least(name, "other").alias(name), F.greatest(name, "other").alias("other")).distinct()
    return pairs.join(names.select(name, F.col(tokens).alias("s")), name).join(names.select(F.col(name).alias("other"), F.col(tokens).alias("z")), "other")
