"""Lexical ranking: positional postings, plain rank, cover density, and BM25 scored where the documents are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import cut, spread
from .search import K1, B, fuse, has_phrase, locate, ranked

#: What one occurrence is worth, and the limit of the sum of 1 / n^2 by which the plain rank is divided: fixed values.
WEIGHT = 0.1
SQUARES = 1.64493406685
BLOCK = 2048
CELLS = 2_000_000


def folded_words(text: Column) -> Column:
    """All words of a text in order, folded; a word's place is its index."""
    return F.split(T.fold(F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.WORD), F.lit(0)), " ")), " ")


def _indexed(word: Column) -> Column:
    return (F.length(word) >= 3) & ~word.isin(*sorted({*T.STOP_WORDS, *T.QUESTION_WORDS}))


def stems(text: Column) -> Column:
    """The stems under which a text is indexed, repeats kept."""
    return F.transform(F.filter(folded_words(text), _indexed), T.stem)


def positions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, places``: for each document and stem the ascending places of its words, from 1; stop words take places too.

    Made inside the row of a document, nothing is shuffled; no text and no term is cut short.
    """
    placed = F.filter(F.transform(folded_words(F.col(text)), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p"))), lambda x: _indexed(x["w"]))
    ordered = F.sort_array(F.transform(placed, lambda x: F.struct(T.stem(x["w"]).alias("term"), x["p"].alias("p"))))

    def runs(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(xs, i)["term"] != F.get(xs, i - 1)["term"]))
        places = lambda i, end: F.transform(F.slice(xs, i + 1, end - i), lambda x: x["p"])
        return F.when(n > 0, T.bound(starts, lambda ss: F.transform(ss, lambda i, j: F.struct(F.get(xs, i)["term"].alias("term"), places(i, F.coalesce(F.get(ss, j + 1), n)).alias("places")))))

    return docs.select(key, F.explode(T.bound(ordered, runs)).alias("e")).select(key, "e.term", "e.places")


def _wanted(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of terms that some query has, written once."""
    return cut(rows.join(queries.select("term").distinct(), "term", "left_semi"))


def plain_rank(docs: DataFrame, queries: DataFrame, key: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """``query, key, score`` of documents with any term of the query (query, term): each term adds the sum of 1 / n^2 over its
    occurrences, and the sum over the terms found is divided by the number of terms of the query (X4)."""
    asked = queries.select(query, "term").distinct()
    sizes = asked.groupBy(query).agg(F.count("*").alias("_n"))
    own = _wanted(positions(docs, key, text), asked)
    # What a term is worth in a document does not depend on the query.
    worth = F.aggregate(F.sequence(F.lit(1), F.size("places")), F.lit(0.0), lambda s, n: s + WEIGHT / (n * n)) / SQUARES
    scored = asked.join(own.select(key, "term", worth.alias("_w")), "term").groupBy(query, key).agg(F.sum("_w").alias("_s"))
    return scored.join(sizes, query).select(query, key, (F.col("_s") / F.col("_n")).alias("score"))


def density_of_any(docs: DataFrame, queries: DataFrame, key: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """``query, key, score``: cover density of a query that any of its terms answers; each occurrence is a cover of its own."""
    asked = queries.select(query, "term").distinct()
    own = _wanted(positions(docs, key, text).select(key, "term", F.size("places").alias("_n")), asked)
    return asked.join(own, "term").groupBy(query, key).agg((WEIGHT * F.sum("_n")).alias("score"))


def _density(entries: Column, groups: Column) -> Column:
    """Sum over the minimal covers of sorted entries ``(p, groups)``.

    At each entry the cover that ends there begins at the least of the groups' last entries.  That beginning never moves
    back; the first entry at which it is new ends a minimal cover.  A cover is worth less the more words between its entries.
    """
    start = F.struct(F.array_repeat(F.lit(-1), groups).alias("last"), F.lit(-1).alias("begin"), F.lit(0).alias("i"), F.lit(0.0).alias("score"))

    def step(s: Column, e: Column) -> Column:
        last = F.transform(s["last"], lambda x, g: F.when(F.array_contains(e["groups"], g), s["i"]).otherwise(x))
        return T.bound(last, lambda ls: T.bound(F.array_min(ls), lambda b: after(s, e, ls, b)))

    def after(s: Column, e: Column, last: Column, begin: Column) -> Column:
        noise = (e["p"] - F.get(entries, begin)["p"]) - (s["i"] - begin)
        found = F.when(begin > s["begin"], WEIGHT / (1 + noise)).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(begin, s["begin"]).alias("begin"), (s["i"] + 1).alias("i"), (s["score"] + found).alias("score"))

    return F.aggregate(entries, start, step, lambda s: s["score"])


def density_of_all(docs: DataFrame, queries: DataFrame, key: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """``query, key, score``: cover density of documents that answer every group of the query (query, grp, term).

    A group is answered by any of its terms; groups are numbered from 0.  The group with the fewest postings finds the
    documents; the other postings join on (document, term), so a frequent term is no hot key.
    """
    asked = queries.select(query, "grp", "term").distinct()
    sizes = asked.groupBy(query).agg((F.max("grp") + 1).alias("_groups"))
    own = _wanted(positions(docs, key, text), asked)
    df = own.groupBy("term").agg(F.count("*").alias("_df"))
    weights = asked.join(df, "term", "left").groupBy(query, "grp").agg(F.sum(F.coalesce("_df", F.lit(0))).alias("_df"))
    rarest = weights.groupBy(query).agg(F.min_by("grp", F.struct("_df", "grp")).alias("grp"))
    found = asked.join(rarest, [query, "grp"]).join(own.select(key, "term"), "term").select(query, key).distinct()
    hits = found.join(asked, query).join(own, [key, "term"]).select(query, key, "grp", F.explode("places").alias("p"))
    entries = hits.groupBy(query, key, "p").agg(F.collect_set("grp").alias("groups"))  # the groups of one word
    each = entries.groupBy(query, key).agg(F.sort_array(F.collect_list(F.struct("p", "groups"))).alias("_e"))  # words of one document
    each = each.join(sizes, query).withColumn("score", _density(F.col("_e"), F.col("_groups")))
    return each.filter("score > 0").select(query, key, "score")


def _hits(terms: pa.Array, out: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, stems) -> key, size, numbers of the wanted terms and how often they occur; whole columns at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(1)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            found = pc.index_in(lists.flatten(), value_set=terms)
            at = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
            numbers = found.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * len(terms) + numbers, return_counts=True)
            ends = np.searchsorted(pairs // max(1, len(terms)), np.arange(len(sizes) + 1)).astype(np.int32)
            offsets = pa.array(ends)
            lists_of = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32()))
            every = pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), lists_of(pairs % max(1, len(terms))), lists_of(counts)], schema=out)
            yield every.filter(pa.array(sizes > 0))

    return run


class _Best:
    """The k best documents of each query so far; equal rounded scores by key."""

    def __init__(self, k: int, queries: int, digits: int) -> None:
        self.k, self.digits = k, digits
        self.score = np.zeros((0, queries))
        self.key = np.zeros((0, queries), np.int64)

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """scores: documents x queries, negative without a common term."""
        s = np.concatenate((self.score, scores))
        k = np.concatenate((self.key, np.repeat(keys[:, None], scores.shape[1], axis=1)))
        order = np.lexsort((k, -np.round(s, self.digits)), axis=0)[: self.k]
        self.score, self.key = np.take_along_axis(s, order, 0), np.take_along_axis(k, order, 0)


def bm25_top_k(docs: DataFrame, queries: DataFrame, key: str, k: int, query: str = "query_id", text: str = "text", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """``query, key, rank, score``: the k best documents of each query (query, term) by BM25; ids are whole numbers.

    A stated set of queries against all documents, in blocks of ``block`` queries: the terms of a block go to every task.
    A first pass keeps of each document its size and the numbers of the block's terms in it; only these are written, and
    give the statistics.  A second pass scores each document where it lies and keeps k documents a query and task, so what
    is shuffled is queries * k * tasks rows, whatever the number of documents that share a frequent term.
    """
    return _top_k(docs, queries, key, k, query, text, digits, block, True)


def density_top_k(docs: DataFrame, queries: DataFrame, key: str, k: int, query: str = "query_id", text: str = "text", digits: int = 9, block: int = BLOCK) -> DataFrame:
    """As ``bm25_top_k``, by the cover density of any term of the query."""
    return _top_k(docs, queries, key, k, query, text, digits, block, False)


def _top_k(docs: DataFrame, queries: DataFrame, key: str, k: int, query: str, text: str, digits: int, block: int, bm25: bool) -> DataFrame:
    asked = queries.select(query, "term").distinct()
    parts = max(1, -(-asked.select(query).distinct().count() // block))
    asked = asked.withColumn("_b", F.pmod(F.xxhash64(query), F.lit(parts)))
    if parts > 1:
        asked = cut(asked)
    got = None
    for b in range(parts):
        one = _block_top_k(docs, asked.filter(F.col("_b") == b), key, k, query, text, digits, bm25)
        got = one if got is None else got.unionByName(one)
    return ranked(got, query, key, k, digits)


def _block_top_k(docs: DataFrame, asked: DataFrame, key: str, k: int, query: str, text: str, digits: int, bm25: bool) -> DataFrame:
    rows = asked.select(query, "term").collect()  # one block
    names, ids = sorted({r["term"] for r in rows}), sorted({r[query] for r in rows})
    number, place = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(ids)}
    of_term: list[list[int]] = [[] for _ in names]
    for r in rows:
        of_term[number[r["term"]]].append(place[r[query]])
    terms = pa.array(names, pa.string())

    out = pa.schema([pa.field(key, pa.int64()), pa.field("size", pa.int64()), pa.field("terms", pa.list_(pa.int32())), pa.field("counts", pa.list_(pa.int32()))])
    own = spread(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))).select(key, stems(F.col("text")).alias("stems"))
    own = cut(own.mapInArrow(_hits(terms, out), f"{key} long, size long, terms array<int>, counts array<int>"))
    total = own.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    df = np.zeros(len(names))
    if bm25:
        for r in own.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            df[r["t"]] = r["count"]
    idf = np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
    mean = total["mean"] or 1.0
    wide = max(1, min(len(names), CELLS // max(1, len(ids))))  # terms of one product
    step = max(1, CELLS // max(1, len(ids), wide))  # documents of one product

    def has_term(low: int) -> np.ndarray:
        """Terms from ``low`` on x queries: 1 where the query has the term."""
        out = np.zeros((min(wide, len(names) - low), len(ids)))
        for i in range(len(out)):
            out[i, of_term[low + i]] = 1.0
        return out

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Best(k, len(ids), digits)
        once = has_term(0) if wide == len(names) else None
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                part = whole.slice(a, step)
                lists, n = part.column(2), part.num_rows
                doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy().astype(np.float64)
                size = part.column(1).to_numpy()[doc]
                worth = idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))) if bm25 else WEIGHT * tf
                scores = np.zeros((n, len(ids)))
                for low in range(0, len(names), wide):
                    own = (term >= low) & (term < low + wide)
                    if own.any():
                        weights = np.zeros((n, min(wide, len(names) - low)))
                        weights[doc[own], term[own] - low] = worth[own]
                        scores += weights @ (has_term(low) if once is None else once)
                scores[scores == 0] = -1.0  # no common term: each term is worth something
                kept.add(part.column(0).to_numpy(), scores)
        at = np.argwhere(kept.score >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[q] for q in at[:, 1].tolist()], pa.int64()), pa.array(kept.key[at[:, 0], at[:, 1]], pa.int64()), pa.array(kept.score[at[:, 0], at[:, 1]], pa.float64())],
            names=[query, key, "score"],
        )

    return own.mapInArrow(best, f"{query} long, {key} long, score double")


def asked_terms(docs: DataFrame, text: str) -> DataFrame:
    """``query_id, term``: the stems of one question."""
    one = docs.sparkSession.createDataFrame([(0, text)], "query_id long, text string")
    return one.select("query_id", F.explode(T.content_set(F.col("text"))).alias("term"))


def search_texts(texts: DataFrame, text: str, k: int, key: str = "id") -> DataFrame:
    """``key, place, score``: the k best texts for a question by cover density of any of its terms."""
    found = density_top_k(texts, asked_terms(texts, text), key, k)
    return found.select(key, F.col("rank").alias("place"), "score")


def case_search(pages: DataFrame, segments: DataFrame, text: str, k: int = 8) -> DataFrame:
    """``kind, id, found, place``: exact phrases first, then speech with any word, then what ranks best.

    pages: id, text; segments: id, text, speaker; ids are whole numbers.  Exact phrases are looked for in pages and segments;
    what several ways find counts where it comes first; of one way pages come first, then ids, ranked ones by rank.
    """
    limit = min(max(1, k), 40)
    every = pages.select(F.lit("page").alias("kind"), "id", "text").union(segments.select(F.lit("segment"), "id", "text"))
    exact = every.filter(has_phrase(F.col("text"), text)).select("kind", "id", F.lit(0).alias("way"), F.lit(0).alias("rank"))
    said = locate(pages.limit(0), segments, text).select("kind", "id", F.lit(1).alias("way"), F.lit(0).alias("rank"))
    best = bm25_top_k(pages, asked_terms(pages, text), "id", limit).select(F.lit("page").alias("kind"), "id", F.lit(2).alias("way"), F.col("rank").cast("int").alias("rank"))
    once = exact.union(said).union(best).groupBy("kind", "id").agg(F.min(F.struct("way", "rank")).alias("w"))
    top = once.orderBy("w.way", "w.rank", "kind", "id").limit(limit)
    name = F.element_at(F.array(*map(F.lit, ("exact", "transcript", "hybrid"))), F.col("w.way") + 1)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("w.way", "w.rank", "kind", "id"))  # a top-k list
    return top.select("kind", "id", name.alias("found"), place.alias("place"))


def retrieve(coverage: DataFrame, lists: list[DataFrame], citable: DataFrame, extra: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, k: int, candidates: int = 30, least: float = 0.0) -> DataFrame:
    """``query_id, key, place, handle, score``: what an answer may cite, in order (X11).

    A question whose terms the case covers to ``least`` or less gets nothing, and no later step sees it; one without a measured
    coverage goes on (coverage: query_id, coverage).  The ranked lists (query_id, key, rank) are fused to ``candidates``; what
    can't be cited (citable: key) leaves before the top is taken; hits in sources that have no index (extra, as the lists) join
    behind.  ``score`` gives each of these rows its ``score`` (query_id, key, rank, coverage); the k best are E1, E2 and so on, equal
    ones by their place before.
    """
    passed = cut(coverage.filter(F.col("coverage").isNull() | (F.col("coverage") > least)).select("query_id", "coverage"))
    open_ = lambda df: df.join(passed.select("query_id"), "query_id", "left_semi")
    fused = fuse([open_(x) for x in lists], "query_id", key, candidates).join(citable.select(key).distinct(), key, "left_semi")
    behind = open_(extra).select("query_id", key, (F.col("rank") + candidates).alias("rank"))
    both = fused.select("query_id", key, "rank").unionByName(behind).groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    rated = score(both.join(passed, "query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank", key)
    best = rated.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return best.select("query_id", key, "place", F.concat(F.lit("E"), F.col("place").cast("string")).alias("handle"), "score")
