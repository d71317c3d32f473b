"""What each filter of a chain removes, keeps from the others and repeats, for every order of the filters.

A document fails a set of filters, its *mask*.  Every figure of every order is a sum over masks, so one vector of 32
counts a part of the corpus answers all 120 orders.

1. *Fingerprint routing.* The filter for exact copies needs the whole table.  Each task keys its texts by xxhash and
   keeps collision chains, the full texts under one hash with the least id seen; of a task's copies only the least id
   goes on with the text, the others leave at once as copies.  ``partitionBy`` deals the chains by fingerprint; where
   they meet they merge, and ids that are not the least leave with the bit for copies.  A text that a third of the rows
   share so crosses once a task, not once a row.
2. *Count vectors.* Masks join the labels on the id (ids, parts and numbers only); ``combineByKey`` adds vectors of
   counts by mask inside each task, then by part.
3. The 120 orders are sums over that vector.

Chains of a task are written on when they hold ``CHAIN_BYTES``, and the number of fingerprint partitions follows the
bytes of the texts, so memory does not grow with the input.  Lost tasks are recomputed from the lineage of the RDD.

Edge cases: a null text is empty; a null source is the part ''; a null id is neither smaller nor greater than another,
so such a row never counts as a copy and makes none of others; rows with equal id and equal text are not copies of each
other (no id is smaller) and each counts; an id is good or toxic if any row of the labels says so, a null id never is;
very long texts are taken whole; an empty table gives no part, hence no row; columns of other names are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_for, whole

LETTERS = "ABCDE"
#: The filter that the chains answer; the others look at one text.
COPIES = LETTERS.index("E")
CHAIN_BYTES = 32 << 20
TASK_BYTES = 32 << 20

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"

OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at 0x20 and 0x09-0x0D
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | marked << 3


class Chains:
    """fingerprint -> entries ``[text, least id, its (part, mask) counts]``, one an exact text."""

    def __init__(self) -> None:
        self.held: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, who, rows: Counter) -> Iterator[tuple]:
        """Take in rows of an id; yields ``(id, rows)`` of an id that is now known as not the least."""
        chain = self.held.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if who == entry[1]:
                    entry[2] += rows
                elif who > entry[1]:
                    yield who, rows
                else:
                    yield entry[1], entry[2]
                    entry[1:] = [who, rows]
                return
        chain.append([text, who, rows])
        self.bytes += len(text) + 200

    def drain(self) -> Iterator[tuple]:
        for key, chain in self.held.items():
            for text, who, rows in chain:
                yield key, text, who, rows
        self.held, self.bytes = {}, 0


def _flat(who, rows: Counter, copy: bool) -> Iterator[tuple]:
    for (part, mask), n in rows.items():
        yield who, part, mask | copy << COPIES, n


def _local(conditions: Callable[[str], int]) -> Callable[[Iterable], Iterator[tuple]]:
    """Rows ``(id, part, text)`` of a task -> ``(fingerprint, (text, id, rows))``; text is None where the rows are final."""

    def run(rows: Iterable) -> Iterator[tuple]:
        import xxhash

        chains, final = Chains(), defaultdict(Counter)

        def drain() -> Iterator[tuple]:
            yield from ((k, (t, w, r)) for k, t, w, r in chains.drain())
            for who, theirs in final.items():
                yield xxhash.xxh3_64_intdigest(repr(who)), (None, who, theirs)
            final.clear()

        for who, part, text in rows:
            own = Counter({(part, conditions(text)): 1})
            if who is None:
                final[None] += own
            else:
                raw = text.encode("utf-8", "replace")
                for other, theirs in chains.add(xxhash.xxh3_64_intdigest(raw), raw, who, own):
                    final[other] += _as_copy(theirs)
            if chains.bytes + 400 * len(final) > CHAIN_BYTES:
                yield from drain()
        yield from drain()

    return run


def _as_copy(rows: Counter) -> Counter:
    return Counter({(part, mask | 1 << COPIES): n for (part, mask), n in rows.items()})


def _meet(rows: Iterable) -> Iterator[tuple]:
    """Chains of one fingerprint partition -> ``(id, part, mask, n)`` of every document."""
    chains = Chains()
    for key, (text, who, own) in rows:
        if text is None:
            yield from _flat(who, own, False)
        else:
            for other, theirs in chains.add(key, text, who, own):
                yield from _flat(other, theirs, True)
    for _, _, who, own in chains.drain():
        yield from _flat(who, own, False)


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", conditions: Callable[[str], int] = failed) -> DataFrame:
    """``id, part, mask, n``: which filters each document fails, exact copies of a smaller id included."""
    text = whole(text_col)
    parts = batches_for(docs, F.octet_length(text) + 200, TASK_BYTES)
    rows: RDD = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).rdd
    met = rows.mapPartitions(_local(conditions)).partitionBy(parts, lambda key: key).mapPartitions(_meet)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.sparkSession.createDataFrame(met, f"id {kind}, part string, mask int, n long", verifySchema=False)


def _vectors(rows: RDD) -> RDD:
    """``(part, (mask, n, good, toxic))`` -> ``(part, counts)`` with a row of counts for each mask."""

    def add(v: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        v[mask] += (n, n * good, n * toxic)
        return v

    return rows.combineByKey(lambda row: add(np.zeros((1 << len(LETTERS), 3), np.int64), row), add, lambda a, b: a + b)


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """All orders of the filters and their steps from the counts by mask."""
    at = np.arange(len(counts))
    removed: dict[tuple[int, int], np.ndarray] = {}
    for before in range(len(counts)):
        for f in range(len(LETTERS)):
            if not before >> f & 1:
                removed[before, f] = counts[(at & before == 0) & (at >> f & 1 == 1)].sum(axis=0)
    shapley = [0] * len(LETTERS)
    rows = []
    for order in itertools.permutations(range(len(LETTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            here = removed[before, f]
            shapley[f] += int(here[0])
            redundant = counts[(at & before != 0) & (at >> f & 1 == 1), 0].sum()
            kept = counts[at & (before | 1 << f) == 0, 0].sum()
            rows.append((order, step, f, int(kept), int(here[0]), int(redundant), int(counts[1 << f, 0]), int(here[1]), int(here[2])))
            before |= 1 << f
    for order, step, f, *figures in rows:
        yield part, "".join(LETTERS[x] for x in order), step, *figures, shapley[f]


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", conditions: Callable[[str], int] = failed) -> DataFrame:
    """A row per part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``."""
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col, conditions=conditions).join(known, "id", "left")
    rows = rows.select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    counted = _vectors(rows.rdd.map(lambda r: (r[0], r[1:])))
    return docs.sparkSession.createDataFrame(counted.flatMap(lambda kv: orders(*kv)), OUT, verifySchema=False)


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
failing AS (
  SELECT w.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false) AS e, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM words w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
long AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM failing GROUP BY ALL),
letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perm AS (
  SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM letter p, letter q, letter r, letter s, letter u
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM perm),
seen AS (
  SELECT s.*, m.*, fails[o[step]] AS now,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM steps s, long m),
rows AS (
  SELECT part, filter_order, step, o[step] AS f,
         coalesce(sum(n) FILTER (NOT gone AND NOT now), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND now), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND now), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (now AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n * good) FILTER (NOT gone AND now), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (NOT gone AND now), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM rows"""
