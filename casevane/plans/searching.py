"""Search, ranking and diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking, resolution, search
from ..operators.common import cut, spread
from . import duck as D
from .registry import Tables, query

c = F.col

_ALL = f"list_transform(list_filter(list_transform({D.raw('text', 3)}, lambda t: {D.fold('t')}), lambda t: NOT list_contains({D.words([*T.STOP_WORDS, *T.QUESTION_WORDS])},t)), lambda w: {D.stem('w')})"
POSTINGS = f"post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_ALL}) AS term FROM documents) GROUP BY 1,2), size AS (SELECT doc_id, sum(tf) AS size FROM post GROUP BY 1)"
QUERIES_SQL = f"q AS (SELECT DISTINCT item_id AS query_id, unnest({D.stems('text')}) AS term FROM benchmark)"
BM25 = (
    POSTINGS + ", " + QUERIES_SQL + ", st AS (SELECT count(*) AS docs, avg(size) AS mean FROM size), df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY 1),"
    " sc AS (SELECT query_id, p.doc_id, sum(ln(1+(docs-df+0.5)/(df+0.5)) * tf*2.2/(tf+1.2*(0.25+0.75*size/mean))) AS score FROM q JOIN post p USING(term) JOIN df USING(term) JOIN size z ON z.doc_id=p.doc_id, st GROUP BY 1,2),"
    " lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score,6) DESC, doc_id) AS rank FROM sc)"
)


def terms_of(t: Tables):
    return t.benchmark.select(c("item_id").alias("query_id"), F.explode(T.content_set(c("text"))).alias("term")).distinct()


def doc_sets(t: Tables, ids):
    """``doc_id, s`` and the columns of documents but the text: content sets once per document, for the documents of a top-k list."""
    return spread(t.documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("s", T.content_set(c("text"))).drop("text")


def lexical(t: Tables, k: int = 20):
    return ranking.bm25_top_k(t.documents, terms_of(t), "doc_id", k)


@query("x1_postings", f"WITH {POSTINGS} SELECT post.doc_id, term, tf, CAST(size AS BIGINT) AS size FROM post JOIN size USING(doc_id)")
def _(t: Tables):
    return search.postings(t.documents, "doc_id")


@query("x3_bm25_top_k", f"WITH {BM25} SELECT lex.query_id, lex.doc_id, rank, round(score,4) AS score FROM lex JOIN sc ON sc.query_id=lex.query_id AND sc.doc_id=lex.doc_id WHERE rank<=10")
def _(t: Tables):
    return lexical(t, 10).select("query_id", "doc_id", c("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


#: Words with their places, and the places of indexed stems; short questions are the first three content stems of an item.
PLACES = (
    f"word AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w,1) AS p FROM (SELECT doc_id, list_transform({D.raw('text', 1)}, lambda t: {D.fold('t')}) AS w FROM documents)),"
    f" place AS (SELECT doc_id, p, {D.stem('w')} AS term FROM word WHERE length(w)>=3 AND NOT list_contains({D.words([*T.STOP_WORDS, *T.QUESTION_WORDS])},w))"
)
SHORT = (
    f"ordered AS (SELECT item_id AS query_id, list_transform({D.ordered_terms('text')}, lambda w: {D.stem('w')}) AS o FROM benchmark),"
    " three AS (SELECT DISTINCT query_id, (list_filter(o, lambda t, i: list_position(o, t) = i))[1:3] AS s FROM ordered), short AS (SELECT query_id, unnest(s) AS term, generate_subscripts(s,1)-1 AS grp FROM three)"
)


def short_questions(t: Tables):
    s = F.slice(T.content_set(c("text")), 1, 3)
    return t.benchmark.select(c("item_id").alias("query_id"), F.posexplode(s).alias("grp", "term"))


def _ten(scored):
    return search.ranked(scored, "query_id", "doc_id", 10).select("query_id", "doc_id", c("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_TEN = "r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score,6) AS score FROM r WHERE rank<=10"


@query(
    "x4_plain_rank",
    f"WITH {PLACES}, {QUERIES_SQL}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), w AS (SELECT doc_id, term, 0.1::DOUBLE*list_sum(list_transform(range(1,count(*)+1), lambda j: 1.0::DOUBLE/(j*j)))/1.64493406685::DOUBLE AS w FROM place GROUP BY doc_id, term),"
    f" s AS (SELECT query_id, doc_id, sum(w)/any_value(n) AS score FROM q JOIN w USING(term) JOIN n USING(query_id) GROUP BY 1,2), {_TEN}",
)
def _(t: Tables):
    return _ten(ranking.plain_rank(t.documents, terms_of(t), "doc_id"))


@query("x3_density_of_any", f"WITH {PLACES}, {QUERIES_SQL}, s AS (SELECT query_id, doc_id, 0.1::DOUBLE*count(*) AS score FROM q JOIN place USING(term) GROUP BY 1,2), {_TEN}")
def _(t: Tables):
    return _ten(ranking.density_of_any(t.documents, terms_of(t), "doc_id"))


@query(
    "x3_density_of_all",  # covers by definition: intervals with all terms that lose one when an end moves in
    f"WITH {PLACES}, {SHORT}, h AS (SELECT query_id, doc_id, p, grp FROM short JOIN place USING(term)), g AS (SELECT query_id, count(DISTINCT term) AS n FROM short GROUP BY 1),"
    " full_docs AS (SELECT query_id, doc_id FROM h JOIN g USING(query_id) GROUP BY 1,2 HAVING count(DISTINCT grp)=any_value(n)),"
    " ends AS (SELECT DISTINCT query_id, doc_id, p FROM h SEMI JOIN full_docs USING(query_id, doc_id)),"
    " upto AS (SELECT e.query_id, e.doc_id, e.p AS q, h.grp, max(h.p) AS last FROM ends e JOIN h ON h.query_id=e.query_id AND h.doc_id=e.doc_id AND h.p<=e.p GROUP BY ALL),"
    " spans AS (SELECT u.query_id, doc_id, q, min(last) AS b FROM upto u JOIN g USING(query_id) GROUP BY u.query_id, doc_id, q HAVING count(*)=any_value(n)),"
    " covers AS (SELECT query_id, doc_id, b, min(q) AS q FROM spans GROUP BY ALL),"
    " inside AS (SELECT c.query_id, c.doc_id, c.b, c.q, count(DISTINCT e.p) AS n FROM covers c JOIN ends e ON e.query_id=c.query_id AND e.doc_id=c.doc_id AND e.p BETWEEN c.b AND c.q GROUP BY ALL),"
    f" s AS (SELECT query_id, doc_id, sum(0.1::DOUBLE/(1+(q-b)-(n-1))) AS score FROM inside GROUP BY 1,2), {_TEN}",
)
def _(t: Tables):
    return _ten(ranking.density_of_all(t.documents, short_questions(t), "doc_id"))


@query("x6_vector_top_k", "SELECT query_id, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),9) DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id%100=0) WHERE rn<=5")
def _(t: Tables):
    q = t.embeddings.filter(c("vec_id") % 100 == 0).select(c("vec_id").alias("query_id"), "embedding")
    return search.vector_top_k(t.embeddings, q, 5).select("query_id", "vec_id", "score")


def dense(t: Tables, k: int = 20):
    """The second list of the hybrid search: documents ordered by the vector of the same number."""
    q = t.embeddings.join(t.benchmark.select(c("item_id").alias("vec_id")), "vec_id", "left_semi").select(c("vec_id").alias("query_id"), "embedding")
    return search.ranked(search.vector_top_k(t.embeddings, q, k).withColumnRenamed("vec_id", "doc_id"), "query_id", "doc_id", k)


HYBRID = BM25 + (
    ", vs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),9) AS s FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),"
    " vec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM vs),"
    " u AS (SELECT query_id, doc_id, 1.0::DOUBLE/(60+rank) AS w, 0 AS i, rank FROM lex WHERE rank<=20 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE/(60+rank), 1, rank FROM vec WHERE rank<=20),"
    " f AS (SELECT query_id, doc_id, round(sum(w),9) AS score, min((i,rank)) AS first FROM u GROUP BY 1,2),"
    " h AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM f)"
)


@query("x10_rank_fusion", f"WITH {HYBRID} SELECT query_id, doc_id, rank, score FROM h WHERE rank<=10")
def _(t: Tables):
    return search.fuse([lexical(t), dense(t)], "query_id", "doc_id", 10).select("query_id", "doc_id", c("rank").cast("long").alias("rank"), "score")


@query("x11_hybrid_with_quota", f"WITH {HYBRID}, d AS (SELECT h.query_id, h.doc_id, h.rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY h.rank) AS per FROM h JOIN documents USING(doc_id) WHERE rank<=30), k AS (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM d WHERE per<=2) SELECT * FROM k WHERE pos<=8")
def hybrid(t: Tables):
    """Lexical and vector lists, fused, at most two documents of a source, best eight."""
    f = search.fuse([lexical(t), dense(t)], "query_id", "doc_id", 30).join(t.documents.select("doc_id", "source"), "doc_id")
    f = f.withColumn("per", F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))).filter("per <= 2")
    f = f.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long")).filter("pos <= 8")
    return f.select("query_id", "doc_id", "source", "pos")


@query("x12_unindexed_supplement", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars>25000)")
def _(t: Tables):
    return t.documents.select("source").join(t.documents.filter("n_chars > 25000").select("source"), "source", "left_anti").distinct()


@query("x14_scope_merge", "WITH u AS (SELECT doc_id, 0 AS p, doc_id AS r FROM documents WHERE lang='es' UNION ALL SELECT doc_id, 1, doc_id FROM documents WHERE n_chars>3000), m AS (SELECT doc_id, min((p,r)) AS k FROM u GROUP BY 1) SELECT doc_id, row_number() OVER (ORDER BY k) AS pos FROM m ORDER BY pos LIMIT 50")
def _(t: Tables):
    a = t.documents.filter("lang = 'es'").select("doc_id", F.lit(0).alias("p"))
    m = a.union(t.documents.filter("n_chars > 3000").select("doc_id", F.lit(1))).groupBy("doc_id").agg(F.min("p").alias("p")).orderBy("p", "doc_id").limit(50)
    return m.select("doc_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p", "doc_id")).cast("long").alias("pos"))  # a merged top-k list


#: Six kinds of source: speech, and the names of five kinds of entity.
_HAVE = " UNION ".join(f"SELECT DISTINCT unnest({D.stems(x)}) AS term FROM {table}" for table, x in (("conversations", "text"), ("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"), ("pages", "url"), ("nation", "n_name")))


@query(
    "x15_term_coverage",
    f"WITH {QUERIES_SQL}, have AS ({_HAVE}) SELECT query_id, round(count(h.term)/count(*)::DOUBLE,6) AS coverage FROM q LEFT JOIN have h USING(term) GROUP BY 1",
)
def coverage(t: Tables):
    of = lambda df, text: spread(df.select(text)).select(F.explode(T.content_set(c(text))).alias("term"))
    have = reduce(lambda a, b: a.union(b), [of(t.conversations, "text"), of(t.part, "p_name"), of(t.supplier, "s_name"), of(t.customer, "c_name"), of(t.pages, "url"), of(t.nation, "n_name")])
    asked = terms_of(t)
    have = have.join(asked.select("term").distinct(), "term", "left_semi").distinct().withColumn("hit", F.lit(1))  # few terms are asked for
    return asked.join(have, "term", "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


@query(
    "x16_should_abstain",
    f"WITH {QUERIES_SQL}, have AS ({_HAVE}) SELECT query_id FROM q LEFT JOIN have h USING(term) GROUP BY 1 HAVING round(count(h.term)/count(*)::DOUBLE,6) < 0.6",
)
def _(t: Tables):
    return coverage(t).filter("coverage < 0.6").select("query_id")


@query("x28_file_resolution", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%00001%' ORDER BY length(s_name), s_suppkey LIMIT 1")
def _(t: Tables):
    return t.supplier.filter(c("s_name").ilike("%00001%")).orderBy(F.length("s_name"), "s_suppkey").limit(1).select("s_suppkey")


@query("x25_graph_expansion", "SELECT DISTINCT n_name AS label, r_name AS alias FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_name ILIKE '%_1%' ESCAPE '\\' OR r_name ILIKE '%asia%' ORDER BY label, alias LIMIT 8")
def _(t: Tables):
    n = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).filter(c("n_name").ilike("%_1%") | c("r_name").ilike("%asia%"))
    return n.select(c("n_name").alias("label"), c("r_name").alias("alias")).distinct().orderBy("label", "alias").limit(8)


@query("x31_citation_carry_over", "SELECT conv_id, arg_max(turn, turn) FILTER (WHERE role='assistant') AS answer FROM conversations GROUP BY 1")
def _(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.max(F.when(c("role") == "assistant", c("turn"))).alias("answer"))


@query("r1_relevance_score", f"WITH {BM25}, have AS ({_HAVE}), cv AS (SELECT query_id, round(count(h.term)/count(*)::DOUBLE,6) AS overall FROM q LEFT JOIN have h USING(term) GROUP BY 1), q2 AS (SELECT item_id AS query_id, {D.stems('text')} AS q FROM benchmark), x AS (SELECT lex.query_id, doc_id, len(list_intersect(q,{D.stems('text')}))/len(q)::DOUBLE AS cov, least(1.0::DOUBLE,n_chars/20011.0::DOUBLE) AS prox, CASE WHEN lang='en' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS prior, overall FROM lex JOIN cv USING(query_id) JOIN documents USING(doc_id) JOIN q2 ON q2.query_id=lex.query_id WHERE rank<=20) SELECT query_id, doc_id, round(least(1,greatest(0,CASE WHEN overall<0.5 THEN 0.55::DOUBLE*cov+0.15::DOUBLE*prior+0.10::DOUBLE*prox ELSE 0.40::DOUBLE*cov+0.20::DOUBLE*prior+0.15::DOUBLE*prox END)),6) AS score FROM x")
def _(t: Tables):
    q = t.benchmark.select(c("item_id").alias("query_id"), T.content_set(c("text")).alias("q"))
    top = cut(lexical(t).select("query_id", "doc_id"))
    d = top.join(doc_sets(t, top), "doc_id").join(q, "query_id").join(coverage(t).withColumnRenamed("coverage", "overall"), "query_id")
    cov = F.size(F.array_intersect("q", "s")) / F.size("q")
    return d.select("query_id", "doc_id", search.relevance(cov, F.lit(0.0), F.when(c("lang") == "en", 1.0).otherwise(0.7), F.least(F.lit(1.0), c("n_chars") / 20011), c("overall")).alias("score"))


@query(
    "r2_tolerant_coverage",
    f"WITH {BM25}, q2 AS (SELECT item_id, {D.stems('text')} AS q FROM benchmark), x AS (SELECT lex.query_id AS item_id, doc_id, q, {D.stems('text')} AS s FROM lex JOIN documents USING(doc_id) JOIN q2 ON q2.item_id=lex.query_id WHERE rank<=5),"
    " h AS (SELECT item_id, doc_id, q, list_filter(q, lambda t: list_contains(s,t) OR (length(t)>=4 AND len(list_filter(s, lambda o: length(o)>=4 AND abs(length(o)-length(t))<=2 AND (starts_with(o,t) OR starts_with(t,o))))>0)) AS hit FROM x)"
    " SELECT item_id, doc_id, CASE WHEN len(q)=0 THEN 0.5::DOUBLE ELSE round(len(hit)/len(q)::DOUBLE,6) END AS coverage FROM h",
)
def _(t: Tables):
    q = t.benchmark.select("item_id", T.content_set(c("text")).alias("q"))
    top = cut(lexical(t, 5).select("query_id", "doc_id"))
    d = top.join(doc_sets(t, top), "doc_id").select(c("query_id").alias("item_id"), "doc_id", "s")
    return q.join(d, "item_id").select("item_id", "doc_id", F.round(T.tolerant_share(c("q"), c("s")), 6).alias("coverage"))


@query("r7_r8_diverse_selection")
def _(t: Tables):
    found = cut(lexical(t, 30))
    x = found.join(doc_sets(t, found), "doc_id")
    top = F.max("score").over(W.partitionBy("query_id"))
    rows = x.select("query_id", c("doc_id").alias("key"), F.round(c("score") / top, 6).alias("rank_score"), c("s").alias("terms"), c("source").alias("file"), c("doc_id").cast("string").alias("page"), (c("lang") == "en").alias("is_document"))
    return search.select_diverse(rows, "query_id", k=8, per_file=2, reserve=0.5, speech=0.35)


@query("r10_evidence_dedupe", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT coalesce(nullif(md5(lower(text)),''), source) AS text_key, doc_id FROM documents) GROUP BY 1")
def _(t: Tables):
    return t.documents.select(F.coalesce(F.nullif(F.md5(F.lower("text")), F.lit("")), "source").alias("text_key"), "doc_id").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))


def _posted(name: str, key: str, source: str) -> str:
    return f"{name} AS (SELECT id, term, count(*) AS n FROM (SELECT {key} AS id, unnest({_ALL}) AS term FROM {source}) GROUP BY 1,2)"


def _proves(x: str) -> str:
    return f"len(list_filter(terms, lambda x: contains({x}.folded, x) OR list_contains({x}.known, {D.stem('x')}))) >= 2"


#: Facts are turns of users, segments those of assistants, pages the documents.  A conversation with a system turn is proven and
#: its facts cite the answer; elsewhere later turns have a position that cites it, and all are linked to the document of their number.
_FACTS = (
    f"{QUERIES_SQL}, nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1 HAVING count(*)>=2), sys AS (SELECT DISTINCT conv_id FROM conversations WHERE role='system'),"
    " fact AS (SELECT conv_id*100+turn AS fact_id, conv_id, turn, text FROM conversations WHERE role='user'), seg AS (SELECT conv_id*100+turn AS id, conv_id, turn*10000 AS start_ms, text FROM conversations WHERE role='assistant'),"
    f" {_posted('fp', 'fact_id', 'fact')}, {_posted('sp', 'id', 'seg')}, {_posted('dp', 'doc_id', 'documents')},"
    " fw AS (SELECT id, term, 0.1::DOUBLE*list_sum(list_transform(range(1,n+1), lambda j: 1.0::DOUBLE/(j*j)))/1.64493406685::DOUBLE AS w FROM fp),"
    " fs AS (SELECT query_id, id, sum(w)/any_value(nq.n) AS score FROM q JOIN nq USING(query_id) JOIN fw USING(term) GROUP BY 1,2),"
    " fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS rank FROM fs),"
    f" cand AS (SELECT query_id, fact_id, conv_id, turn, row_number() OVER (PARTITION BY query_id ORDER BY (conv_id NOT IN (FROM sys))::INT, rank) AS place, {D.ordered_terms('text')} AS terms FROM fr JOIN fact ON fact_id=id WHERE rank<=18),"
    " ok AS MATERIALIZED (SELECT * FROM cand WHERE len(terms)>=2),"
    f" dd AS MATERIALIZED (SELECT doc_id, {D.fold('text')} AS folded, {D.stems('text')} AS known FROM documents), gg AS MATERIALIZED (SELECT id, conv_id, start_ms, {D.fold('text')} AS folded, {D.stems('text')} AS known FROM seg),"
    " ds AS MATERIALIZED (SELECT query_id, id, 0.1::DOUBLE*sum(dp.n) AS score FROM q JOIN nq USING(query_id) JOIN dp USING(term) GROUP BY 1,2), ss AS MATERIALIZED (SELECT query_id, id, 0.1::DOUBLE*sum(sp.n) AS score FROM q JOIN nq USING(query_id) JOIN sp USING(term) GROUP BY 1,2),"
    " d8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS r FROM ds) WHERE r<=8), s8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS r FROM ss) WHERE r<=8),"
    " own8 AS (SELECT * FROM (SELECT query_id, fact_id, ss.id, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY round(score,9) DESC, start_ms, ss.id) AS r FROM ok JOIN seg USING(conv_id) JOIN ss USING(query_id, id)) WHERE r<=8),"
    " steps AS (SELECT query_id, fact_id, 2 AS step, 0 AS tie, NULL AS page, g.id AS segment FROM ok JOIN sys USING(conv_id) JOIN seg g ON g.id=fact_id+1"
    " UNION ALL SELECT query_id, fact_id, 3, 0, NULL, g.id FROM ok ANTI JOIN sys USING(conv_id) JOIN seg g ON g.id=fact_id+1 WHERE turn>=2"
    f" UNION ALL SELECT query_id, fact_id, 4, 0, doc_id, NULL FROM ok JOIN dd d ON d.doc_id=conv_id JOIN ds USING(query_id) WHERE ds.id=d.doc_id AND {_proves('d')}"
    f" UNION ALL SELECT query_id, fact_id, 5, r, NULL, g.id FROM ok JOIN own8 USING(query_id, fact_id) JOIN gg g USING(id) WHERE {_proves('g')}"
    f" UNION ALL SELECT query_id, fact_id, 6, r, doc_id, NULL FROM ok JOIN d8 USING(query_id) JOIN dd d ON d.doc_id=d8.id WHERE {_proves('d')}"
    f" UNION ALL SELECT query_id, fact_id, 7, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY round(score,9) DESC, start_ms, g.id), NULL, g.id FROM ok JOIN s8 USING(query_id) JOIN gg g USING(id) WHERE {_proves('g')}),"
    " one AS (SELECT query_id, fact_id, min({'step': step, 'tie': tie, 'page': page, 'segment': segment}) AS m FROM steps GROUP BY 1,2),"
    " once AS (SELECT query_id, o.fact_id, m.step AS step, m.page AS page, m.segment AS segment, place FROM one o JOIN cand USING(query_id, fact_id) QUALIFY row_number() OVER (PARTITION BY query_id, m.page, m.segment ORDER BY place)=1)"
)


@query(
    "x29_facts_for_questions",
    f"WITH {_FACTS} SELECT query_id, k AS place, fact_id, step, page AS document_id, segment AS segment_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM once) WHERE k<=6",
)
def _(t: Tables):
    v, none = t.conversations, F.lit(None).cast("long")
    ident = (c("conv_id") * 100 + c("turn")).alias
    proven = v.filter("role = 'system'").select("conv_id").distinct().withColumn("sys", F.lit(True))
    facts = v.filter("role = 'user'").join(proven, "conv_id", "left").select(ident("fact_id"), "text", F.when(c("sys"), "ADMITTED").otherwise("ALLEGED").alias("proof_status"))
    segments = v.filter("role = 'assistant'").select(ident("segment_id"), c("conv_id").alias("media_id"), (c("turn") * 10_000).alias("start_ms"), "text")
    pages = t.documents.select(c("doc_id").alias("page_id"), c("doc_id").alias("document_id"), F.lit(1).cast("long").alias("page_number"), "text")
    media = v.select(c("conv_id").alias("media_id")).distinct().withColumn("filename", F.concat(F.lit("conversation "), c("media_id").cast("string")))
    answers = v.filter("role = 'assistant'").join(proven, "conv_id", "left")
    citations = answers.select(ident("citation_id"), F.when(c("sys"), c("conv_id") * 100 + c("turn") - 1).alias("fact_id"), none.alias("document_id"), none.alias("page_number"), c("conv_id").alias("media_id"), ident("segment_id"), (c("turn") * 10_000).alias("start_ms"))
    asked = v.filter("role = 'user'").join(proven, "conv_id", "left_anti")
    positions = asked.filter("turn >= 2").select(ident("fact_id"), (c("conv_id") * 100 + c("turn") + 1).alias("citation_id"))
    links = v.filter("role = 'user'").select(ident("fact_id"), c("conv_id").alias("document_id"), c("conv_id").alias("media_id"))
    questions = t.benchmark.select(c("item_id").alias("question_id"), "text")
    got = resolution.facts_for_questions(questions, facts, pages, segments, media, citations, positions, links)
    return got.select(c("question_id").alias("query_id"), c("place").cast("long").alias("place"), "fact_id", "step", "document_id", "segment_id")
