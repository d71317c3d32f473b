"""Search over text tables: postings, BM25, vector similarity, rank fusion, scores, diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import cut

K1, B = 1.2, 0.75


def _entries(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, tf, size``: the stems of each document and how often it has them, and one entry with an empty term.

    The text is folded once; terms are sorted and counted inside the row, so nothing is shuffled.
    """
    words = F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(T.WORD), F.lit(0)), lambda w: F.length(w) >= 3)
    folded = F.split(T.fold(F.array_join(words, " ")), " ")
    drop = sorted({*T.STOP_WORDS, *T.QUESTION_WORDS, ""})
    stems = F.sort_array(F.transform(F.filter(folded, lambda w: ~w.isin(*drop)), T.stem))
    entry = lambda term, tf, n: F.struct(term.alias("term"), tf.cast("long").alias("tf"), n.cast("long").alias("size"))

    def counted(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        run = lambda ss: F.transform(ss, lambda i, j: entry(F.get(ws, i), F.coalesce(F.get(ss, j + 1), n) - i, n))
        return F.when(n > 0, F.concat(F.array(entry(F.lit(""), F.lit(0), n)), T.bound(starts, run)))

    return docs.select(key, F.explode(T.bound(stems, counted)).alias("e")).select(key, "e.*")


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, tf, size``: one row per document and stem."""
    return _entries(docs, key, text).filter("term <> ''")


def bm25(docs: DataFrame, queries: DataFrame, key: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """``query, key, score`` for the stems of each query (query, term).

    One pass keeps, of each document, its size and the postings of terms that some query has; only these are written and
    read again for the statistics.
    """
    wanted = queries.select("term").distinct()
    none = wanted.sparkSession.createDataFrame([("",)], "term string")
    own = cut(_entries(docs, key, text).join(wanted.union(none), "term", "left_semi"))
    stats = own.filter("term = ''").agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    own = own.filter("term <> ''")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    scored = own.join(df, "term").join(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return queries.join(scored.select(key, "term", (idf * tf).alias("w")), "term").groupBy(query, key).agg(F.sum("w").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; null for empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block: int = 2048) -> DataFrame:
    """``query_id, key, score``: the k nearest of each query vector; a stated set of queries against all rows.

    Query vectors are packed into blocks of ``block`` rows by an aggregate; each block is broadcast to the rows in turn,
    so neither the driver nor a task holds more than a block, however many queries there are.  Each task keeps k rows per
    query before the shuffle, so what moves is queries * k * tasks.
    """
    count = queries.count()
    parts = max(1, -(-count // block))
    dealt = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_b"))
    if parts > 1:
        dealt = cut(dealt)
    got = None
    for b in range(parts):
        one = _nearest(vectors, dealt.filter(F.col("_b") == b), k, key)
        got = one if got is None else got.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return got.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """The k nearest that each task sees, for one block of queries."""
    import numpy as np

    rows = queries.select("query_id", "embedding").collect()  # one block
    ids = np.array([r["query_id"] for r in rows], np.int64)
    mat = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)

    def best(batches):
        keep: dict[int, list] = {}
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(lambda e: e is not None and len(e) == mat.shape[1])]
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            own = pdf[key].to_numpy()[norm > 0]
            sims = np.round(mat @ (x[norm > 0] / norm[norm > 0][:, None]).T, 9)
            for q in range(len(ids)):
                near = np.argpartition(-sims[q], k)[: k + 1] if len(own) > k + 1 else np.arange(len(own))
                least = sims[q][near].min() if len(near) else 0.0
                near = np.flatnonzero(sims[q] >= least)  # all ties of the last one
                pool = keep.get(q, []) + list(zip(sims[q][near].tolist(), own[near].tolist(), strict=True))
                keep[q] = sorted(pool, key=lambda r: (-r[0], r[1]))[:k]
        yield pd.DataFrame([(int(ids[q]), v, s) for q, pool in keep.items() for s, v in pool], columns=["query_id", key, "score"])

    return vectors.select(key, "embedding").mapInPandas(best, f"query_id long, {key} long, score double")


def ranked(scored: DataFrame, query: str, key: str, k: int, digits: int = 9) -> DataFrame:
    """``query, key, rank, score`` of the k best of each query; scores equal in these digits are ties, broken by key."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", digits)), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query, key, "rank", "score")


def fuse(lists: list[DataFrame], query: str, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists; ties by first list, rank there, then key."""
    both = None
    for i, x in enumerate(lists):
        part = x.select(query, key, (1 / (constant + F.col("rank"))).alias("w"), F.struct(F.lit(i).alias("i"), F.col("rank").alias("r")).alias("first"))
        both = part if both is None else both.unionByName(part)
    s = both.groupBy(query, key).agg(F.round(F.sum("w"), 9).alias("score"), F.min("first").alias("first"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), "first", key)
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query, key, "rank", "score")


def relevance(coverage: Column, entity: Column, prior: Column, proximity: Column, overall: Column) -> Column:
    """Weighted score in 0..1; a question that the case covers badly leans on coverage."""
    usual = 0.40 * coverage + 0.25 * entity + 0.20 * prior + 0.15 * proximity
    thin = 0.55 * coverage + 0.20 * entity + 0.15 * prior + 0.10 * proximity
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(overall < 0.5, thin).otherwise(usual))), 6)


def select_diverse(candidates: DataFrame, query: str, *, k: int, per_file: int = 5, per_page: int = 5, reserve: float = 0.0, speech: float = 0.0, trade: float = 0.7) -> DataFrame:
    """Greedy selection per query: relevance against similarity to what is chosen, within quotas.

    Input rows: query, key, rank_score, terms (array of strings), file, page, is_document; a top-k list per query, so a
    group is small by construction.  Output: query, key, position.
    """
    kinds = f"`{query}` {candidates.schema[query].dataType.simpleString()}, key {candidates.schema['key'].dataType.simpleString()}, position int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = sorted(pdf.to_dict("records"), key=lambda r: (-r["rank_score"], r["key"]))
        for r in pool:
            r["set"] = frozenset(r["terms"])
        chosen: list[dict] = []
        files: dict = {}
        pages: dict = {}

        def free(rows):
            return [r for r in rows if files.get(r["file"], 0) < per_file and pages.get(r["page"], 0) < per_page]

        def value(r) -> float:
            alike = max((len(r["set"] & o["set"]) / len(r["set"] | o["set"]) if r["set"] | o["set"] else 0.0 for o in chosen), default=0.0)
            return round(trade * r["rank_score"] - (1 - trade) * alike, 12)

        def fill(limit: int, wanted=lambda r: True) -> None:
            while len(chosen) < limit:
                able = free([r for r in pool if wanted(r)])
                if not able:
                    return
                best = min(able, key=lambda r: (-value(r), r["key"]))
                pool.remove(best)
                chosen.append(best)
                files[best["file"]] = files.get(best["file"], 0) + 1
                pages[best["page"]] = pages.get(best["page"], 0) + 1

        fill(min(int(k * reserve), k), lambda r: r["is_document"])
        fill(min(len(chosen) + int(k * max(0.0, speech)), k), lambda r: not r["is_document"])
        fill(k)
        return pd.DataFrame([(pdf[query].iloc[0], r["key"], i) for i, r in enumerate(chosen[:k])], columns=[query, "key", "position"])

    return candidates.groupBy(query).applyInPandas(pick, kinds)


# Words by which a question asks for testimony.
TESTIMONY = (
    "testigo testigos testimonio testimonios declaracion declaraciones declaro declararon audiencia audiencias hablante hablantes intervencion intervenciones intervino"
    " intervinieron video videos audio audios grabacion grabaciones transcripcion transcripciones minuto minutos dijo dijeron hablo hablaron"
).split()
# Fixed value: what a proper noun is.
PROPER = r"\b[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]{2,}(?:\s+[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]{2,})*\b"


def proper_nouns(question: Column) -> Column:
    """Folded names in capitals, without the word that begins the question."""
    bare = F.ltrim(F.coalesce(question, F.lit("")), F.lit("¿¡ \t"))
    first = F.regexp_extract(bare, "^" + PROPER, 0)
    rest = F.substring(bare, F.length(first) + 1, F.length(bare))
    names = F.transform(F.regexp_extract_all(rest, F.lit(PROPER), F.lit(0)), T.fold)
    return F.filter(names, lambda n: (F.length(n) >= 3) & ~n.isin(*T.STOP_WORDS, *T.QUESTION_WORDS))


def entity_score(question: Column, haystack: Column, entities: Column) -> Column:
    """1.0 for a proper noun of the question in the item, 0.6 for an entity that is a term, 0.4 for one that has a term, else 0."""
    terms, text = T.content_set(question), T.fold(haystack)
    own = F.filter(F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.trim(T.fold(e))), lambda e: e != "")
    named = F.exists(proper_nouns(question), lambda n: F.contains(text, n))
    part = F.exists(own, lambda e: F.exists(terms, lambda t: (F.length(t) >= 4) & F.contains(e, t)))
    return F.when(named, 1.0).when(F.arrays_overlap(own, terms), 0.6).when(part, 0.4).otherwise(0.0)


def source_prior(is_document: Column, question: Column, navigates: Column) -> Column:
    """1.0 for documents and 0.7 for speech; the other way round for questions of testimony."""
    testimony = navigates | F.arrays_overlap(T.content_set(question), F.array(*map(F.lit, TESTIMONY)))
    return F.when(is_document == testimony, 0.7).otherwise(1.0)


def dedupe_pages(items: DataFrame, keys: list[str], score: str, mode: str, ident: str) -> DataFrame:
    """One item of each document page: the best score, on a tie the layout reading, then the least id."""
    best = F.max_by(F.struct(*[x for x in items.columns if x not in keys]), F.struct(F.round(score, 9), F.coalesce(F.col(mode) == "document_ai", F.lit(False)), -F.col(ident)))
    return items.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def dedupe_speech(segments: DataFrame, window: int = 2000) -> DataFrame:
    """``media_id, speaker, start_ms, end_ms, text, score``: the best segment of each speaker and window, neighbours merged.

    Segments up to ``window`` ms after the one before become one: first start, last end, longest text, best score.
    """
    keys = ["media_id", "speaker"]
    slot = F.floor(F.col("start_ms") / window)
    first = F.max_by(F.struct("start_ms", "end_ms", "text", "score"), F.struct("score", -F.col("start_ms")))
    best = segments.groupBy(*keys, slot.alias("_slot")).agg(first.alias("_b")).select(*keys, "_b.*")
    w = Window.partitionBy(*keys).orderBy("start_ms")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    run = F.sum(F.when(gap.between(0, window), 0).otherwise(1)).over(w)
    merged = best.withColumn("_run", run).groupBy(*keys, "_run")
    return merged.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max_by("text", F.struct(F.length("text"), -F.col("start_ms"))).alias("text"), F.max("score").alias("score")).drop("_run")


def neighbours(near: Column) -> Column:
    """The first two neighbours of an item, as context that is never cited."""
    return F.slice(F.coalesce(near, F.array().cast("array<string>")), 1, 2)


def has_word(text: Column, token: str) -> Column:
    """Whether a text has a token: a number as a word, leading zeros apart; other tokens anywhere, folded."""
    if token.isdigit():
        return T.fold(text).rlike(rf"(^|[^0-9a-z])0*{token.lstrip('0') or '0'}([^0-9a-z]|$)")
    return F.contains(T.fold(text), T.fold(F.lit(token)))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a text has the words of a phrase in order, twelve characters apart at most."""
    from ..functions.rules import phrase_pattern

    return T.fold(text).rlike((phrase_pattern(phrase) or "$^").replace(r"\b", "(^|[^0-9a-z])", 1)[: -len(r"\b")] + "([^0-9a-z]|$)")


def locate(pages: DataFrame, segments: DataFrame, term: str, k: int | None = None) -> DataFrame:
    """``kind, id``: pages that have all tokens of a term, and segments (or their speakers) that have any.

    pages: id, text, one row per page after ``dedupe_pages``; segments: id, text, speaker.  Two filtered scans.
    """
    import re
    from functools import reduce

    tokens = [t for t in re.split(r"[^0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+", term or "") if len(t) >= 2][:6]
    if not tokens:
        raise ValueError("a term of at least two characters is required")
    every = reduce(lambda a, b: a & b, [has_word(F.col("text"), t) for t in tokens])
    some = reduce(lambda a, b: a | b, [has_word(F.col("text"), t) | has_word(F.coalesce("speaker", F.lit("")), t) for t in tokens])
    found = pages.filter(every).select(F.lit("page").alias("kind"), "id").union(segments.filter(some).select(F.lit("segment"), "id"))
    return found if k is None else found.orderBy("kind", "id").limit(k)


def occurrences(hits: DataFrame, cap: int, gap: int = 2000) -> DataFrame:
    """``file, speaker, start_ms, end_ms``: places in recordings as a list shows them.

    Neighbours of one speaker up to ``gap`` ms apart are one place; a speaker has one place a minute; a file at most ``cap``.
    """
    keys = ["file", "speaker"]
    w = Window.partitionBy(*keys).orderBy("start_ms")
    far = F.col("start_ms") - F.lag("end_ms").over(w)
    runs = hits.withColumn("_run", F.sum(F.when(far.between(0, gap), 0).otherwise(1)).over(w)).groupBy(*keys, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    minutes = runs.groupBy(*keys, F.floor(F.col("start_ms") / 60_000).alias("_m")).agg(F.min(F.struct("start_ms", "end_ms")).alias("p")).select(*keys, "p.*")
    return minutes.withColumn("_rn", F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "speaker"))).filter(F.col("_rn") <= cap).drop("_rn")


def query_prefixes(question: Column) -> Column:
    """Prefixes to search for (X2): each term as it is, its stem, and without a final s; of numbers only whole ones of 3 to 6 digits."""
    words = lambda t: F.concat(F.array(t, T.stem(t)), F.when(t.endswith("s") & (F.length(t) > 4), F.array(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array().cast("array<string>")))
    forms = lambda t: F.when(~t.rlike("^[0-9]"), words(t)).when(t.rlike("^[0-9]{3,6}$"), F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.flatten(F.transform(T.search_terms(question), forms)), lambda x: F.length(x) >= 3))
