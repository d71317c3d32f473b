"""Conflict-constrained best-fit packing of documents into training sequences.

Documents become pieces of at most ``capacity`` units: full pieces fill a bin alone, the rest of each document is
an item.  Items are packed in decreasing size.  The bins of a shard are kept in order of their residual space;
the search for an item starts at the tightest bin it fits and goes on to each successor until a bin's *source
bitmap* and *duplicate-cluster bitmap* show no conflict (at most one document of a source and one of a cluster per
bin).  Without such a bin a new one is opened.  The bitmaps of all bins are stored by column: for each source, and for
each cluster with two items or more in the shard, the bins that carry it are the bits of one integer.  One operation on
integers then skips all conflicting bins of a residual, and an item whose source is in every open bin opens a new one
at once.

Shards hold about ``shard_units`` units and ``shard_items`` items at most each and are dealt by a hash of the row, so a
source or cluster with a third of all rows is a third of every shard, and no shard grows with the input.

Edge cases: a null or empty text is an item of size 0 units counted as 1; null source or cluster conflicts with
nothing; rows with equal ids (or none) are separate items; equally tight bins are taken in order of opening, items of
equal size in order of id, then of the row's hash; a very long text is cut into full pieces and one rest; an empty
table gives an empty table; columns of other names are not read, whatever they are called.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

CAPACITY = 2048
SHARD_UNITS = 2_000_000
SHARD_ITEMS = 4_096


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def text_cluster(text: Column) -> Column:
    """Cluster of texts that differ only in letter case and white space; null for blank texts."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain != "", F.xxhash64(plain))


class _Marks:
    """For each key the bins that carry it, as bits of one integer; a list while they are few."""

    FEW = 8

    def __init__(self):
        self.few: dict[int, list[int]] = {}
        self.many: dict[int, int] = {}

    def __getitem__(self, key: int | None) -> int:
        if key is None:
            return 0
        if (bits := self.many.get(key)) is not None:
            return bits
        bits = 0
        for b in self.few.get(key, ()):
            bits |= 1 << b
        return bits

    def add(self, key: int | None, b: int) -> None:
        if key is None:
            return
        if key in self.many:
            self.many[key] |= 1 << b
            return
        own = self.few.setdefault(key, [])
        own.append(b)
        if len(own) > self.FEW:
            self.many[key] = self[key]
            del self.few[key]


def best_fit(sizes: list[int], sources: list[int | None], clusters: list[int | None], capacity: int) -> tuple[list[int], int]:
    """Bin number of each item, items given in packing order; and how many bins were opened.

    ``sources`` and ``clusters`` are numbers local to the shard.  The bins of one residual are the bits of one integer,
    the residuals in use a sorted list; of equally tight bins the one opened first wins.
    """
    order: list[int] = []  # residuals in use, ascending
    here: dict[int, int] = {}  # residual -> its bins
    open_, rest = 0, []  # bins with any space; residual of each bin
    by_source, by_cluster = _Marks(), _Marks()
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        able = open_ & ~(by_source[source] | by_cluster[cluster])
        found = None
        if 0 < able.bit_count() <= 16:  # few bins without a conflict: look at them
            while able:
                low = able & -able
                b = low.bit_length() - 1
                if rest[b] >= size and (found is None or rest[b] < rest[found]):
                    found = b
                able ^= low
        elif able:  # from the tightest residual on, each successor without the bins in conflict
            for at in range(bisect.bisect_left(order, size), len(order)):
                if fit := here[order[at]] & able:
                    found = (fit & -fit).bit_length() - 1
                    break
        if found is None:
            found = len(rest)
            rest.append(capacity)
        else:
            before = rest[found]
            here[before] ^= 1 << found
            if not here[before]:
                del here[before]
                order.pop(bisect.bisect_left(order, before))
        by_source.add(source, found)
        by_cluster.add(cluster, found)
        rest[found] = left = rest[found] - size
        if left > 0:
            open_ |= 1 << found
            if left not in here:
                here[left] = 0
                bisect.insort(order, left)
            here[left] |= 1 << found
        elif open_ >> found & 1:
            open_ ^= 1 << found
        out.append(found)
    return out, len(rest)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    size: Column | None = None,
    source: Column | None = None,
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    shard_units: int = SHARD_UNITS,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """A row per piece: ``id_col, piece, start, n_units, shard, bin, slot, bin_units``.

    One small aggregate sizes the shards; one shuffle of ids and numbers (never texts) deals the items.
    """
    text = whole()
    size = estimated_tokens(text) if size is None else size
    source = F.col("source") if source is None else source
    cluster = text_cluster(text) if cluster is None else cluster
    whole_table = docs.agg(F.sum(F.coalesce(size, F.lit(1))).alias("units"), F.count("*").alias("items")).first()
    shards = max(1, -(-int(whole_table["units"] or 0) // shard_units), -(-whole_table["items"] // shard_items))
    id_type = docs.schema[id_col].dataType.simpleString()
    items = docs.select(
        F.col(id_col).alias("_id"),
        F.greatest(F.lit(1), F.coalesce(size, F.lit(1))).cast("long").alias("_size"),
        F.xxhash64(source.cast("string")).alias("_s"),
        source.isNull().alias("_no_s"),
        F.coalesce(cluster.cast("long"), F.lit(0)).alias("_c"),
        cluster.isNull().alias("_no_c"),
    ).withColumn("_shard", F.pmod(F.xxhash64("_id", "_size", "_c"), F.lit(shards)).cast("int"))

    def run(key: tuple[pa.Scalar, ...], items: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        t = items.to_pydict()
        rows = sorted(
            zip(t["_id"], t["_size"], t["_s"], t["_no_s"], t["_c"], t["_no_c"], strict=True),
            key=lambda r: (-(r[1] % capacity), r[0] is None, r[0] or 0, r[1], r[2], r[4]),
        )
        s_bit, c_bit = {}, {}
        copies = Counter(r[4] for r in rows if r[1] % capacity and not r[5])
        sizes, ss, cs, who = [], [], [], []
        out = {k: [] for k in (id_col, "piece", "start", "n_units", "bin")}
        for i, (_, n, s, no_s, c, no_c) in enumerate(rows):
            if rest := n % capacity:
                sizes.append(rest)
                ss.append(None if no_s else s_bit.setdefault(s, len(s_bit)))
                cs.append(None if no_c or copies[c] < 2 else c_bit.setdefault(c, len(c_bit)))
                who.append(i)
        bins, opened = best_fit(sizes, ss, cs, capacity)
        tail = dict(zip(who, bins, strict=True))
        for i, (doc, n, *_) in enumerate(rows):
            full = n // capacity
            for p in range(full):
                for k, v in zip(out, (doc, p, p * capacity, capacity, opened), strict=True):
                    out[k].append(v)
                opened += 1
            if i in tail:
                for k, v in zip(out, (doc, full, full * capacity, n - full * capacity, tail[i]), strict=True):
                    out[k].append(v)
        used, slots = [0] * opened, []
        count = [0] * opened
        for b, n in zip(out["bin"], out["n_units"], strict=True):
            slots.append(count[b])
            count[b] += 1
            used[b] += n
        return pa.table(
            {
                id_col: pa.array(out[id_col], pa_id),
                "piece": pa.array(out["piece"], pa.int32()),
                "start": pa.array(out["start"], pa.int64()),
                "n_units": pa.array(out["n_units"], pa.int64()),
                "shard": pa.array([shard] * len(slots), pa.int32()),
                "bin": pa.array(out["bin"], pa.int32()),
                "slot": pa.array(slots, pa.int32()),
                "bin_units": pa.array([used[b] for b in out["bin"]], pa.int64()),
            }
        )

    from pyspark.sql.pandas.types import to_arrow_type

    pa_id = to_arrow_type(docs.schema[id_col].dataType)
    return items.groupBy("_shard").applyInArrow(run, f"`{id_col}` {id_type}, piece int, start long, n_units long, shard int, bin int, slot int, bin_units long")
