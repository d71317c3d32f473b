"""Citations, support on primary text, golden evaluation, parties, incremental index and scoped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citing, evaluation, extraction, guard, ranking, search
from ..sources import packages
from ..sources.tenants import Catalogue
from . import duck as D
from .checking import FOUND, passages_found
from .registry import Tables, query
from .searching import _HAVE, BM25, HYBRID, QUERIES_SQL, _posted, coverage, dense, doc_sets, lexical, terms_of

c = F.col

#: Turns of users cite documents, others segments of speech; the quoted characters, cases and times follow from the turn.
_CITES = (
    "cit AS (SELECT conv_id*100+turn AS citation_id, 'c'||(conv_id%50) AS case_id, role, conv_id + (turn%3=2)::INT AS document_id, turn*40 AS char_start, turn*40+30 AS char_end,"
    " conv_id AS media_id, CASE WHEN turn%5=4 THEN -1 ELSE conv_id*100+turn END AS segment_id, turn*10000 AS start_ms, turn*11000 AS end_ms, turn FROM conversations),"
    " seg AS (SELECT conv_id*100+turn AS id, 'c'||(conv_id%50) AS seg_case, conv_id AS seg_media, turn*10000 AS s0, turn*10000+5000 AS s1 FROM conversations WHERE role='assistant'),"
    " pg AS (SELECT doc_id, 'c'||(doc_id%50) AS page_case, coalesce(text,'') AS text FROM documents)"
)


V5 = (
    f"WITH {_CITES}, p AS (SELECT citation_id, CASE WHEN doc_id IS NULL THEN 'page_not_found' ELSE concat_ws(',', CASE WHEN page_case<>case_id THEN 'case_mismatch' END, CASE WHEN char_end>length(text) THEN 'offset_out_of_range' END,"
    " CASE WHEN char_end<=length(text) AND turn%4=3 AND substring(text,char_start+1,30)<>'another' THEN 'quote_hash_mismatch' END) END AS reasons FROM cit LEFT JOIN pg ON doc_id=document_id WHERE role='user'),"
    " s AS (SELECT citation_id, CASE WHEN id IS NULL THEN 'segment_not_found' ELSE concat_ws(',', CASE WHEN seg_case<>case_id THEN 'case_mismatch' END, CASE WHEN start_ms<s0 OR end_ms>s1 THEN 'timestamp_out_of_segment' END) END AS reasons FROM cit LEFT JOIN seg ON id=segment_id WHERE role<>'user')"
    " SELECT citation_id, reasons='' AS valid, reasons FROM (FROM p UNION ALL FROM s) WHERE true"
)


@query("v5_citation_validity", V5)
def _(t: Tables):
    return citing.validity(*cited_turns(t)).select("citation_id", "valid", F.array_join("reasons", ",").alias("reasons"))


def cited_turns(t: Tables):
    """Citations, pages and segments."""
    v = t.conversations
    case = lambda x: F.concat(F.lit("c"), (c(x) % 50).cast("string"))
    pages = t.documents.select(case("doc_id").alias("case_id"), c("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    segments = v.filter("role = 'assistant'").select(case("conv_id").alias("case_id"), c("conv_id").alias("media_id"), (c("conv_id") * 100 + c("turn")).alias("segment_id"), (c("turn") * 10_000).alias("start_ms"), (c("turn") * 10_000 + 5_000).alias("end_ms"))
    cited = v.select(
        (c("conv_id") * 100 + c("turn")).alias("citation_id"), case("conv_id").alias("case_id"), F.when(c("role") == "user", "document_page").otherwise("transcript_segment").alias("source_type"),
        (c("conv_id") + (c("turn") % 3 == 2).cast("int")).alias("document_id"), F.lit(1).alias("page_number"), (c("turn") * 40).cast("int").alias("char_start"), (c("turn") * 40 + 30).cast("int").alias("char_end"),
        c("conv_id").alias("media_id"), F.when(c("turn") % 5 == 4, -1).otherwise(c("conv_id") * 100 + c("turn")).alias("segment_id"), (c("turn") * 10_000).alias("start_ms"), (c("turn") * 11_000).alias("end_ms"), "turn",
    )
    quoted = t.documents.select(c("doc_id").alias("document_id"), c("text").alias("primary"))
    # Who quoted took the characters from the document, but for every fourth turn.
    taken = F.when(c("turn") % 4 == 3, F.lit("another")).otherwise(F.substring("primary", c("char_start") + 1, c("char_end") - c("char_start")))
    cited = cited.join(quoted, "document_id", "left").withColumn("quote_hash", F.sha2(F.coalesce(taken, F.lit("")), 256)).drop("primary", "turn")
    return cited, pages, segments


_NUMBERS = lambda a, b: f"len(list_filter({D.numbers(a)}, lambda n: NOT list_contains({D.numbers(b)}, n)))=0"


@query(
    "v4_claim_support",
    f"WITH cl AS (SELECT conv_id AS case_id, turn AS claim_id, text AS claim, {D.stems('text')} AS s FROM conversations WHERE role='user' AND trim(text)<>''),"
    f" it AS (SELECT conv_id AS case_id, turn AS handle, text AS source, {D.stems('text')} AS e FROM conversations WHERE role='assistant'),"
    f" own AS (SELECT cl.*, handle, CASE WHEN handle IS NOT NULL THEN round({D.share('s', 'e')},6) END AS overlap, {_NUMBERS('claim', 'source')} AS sound FROM cl LEFT JOIN it ON it.case_id=cl.case_id AND it.handle=cl.claim_id+1),"
    f" oth AS (SELECT cl.case_id, claim_id, it.handle, round({D.share('s', 'e')},6) AS r FROM cl JOIN it USING(case_id) WHERE {_NUMBERS('claim', 'source')}),"
    " best AS (SELECT case_id, claim_id, arg_min(handle, (-r, handle)) AS h, max(r) AS r FROM oth WHERE r>=0.5 GROUP BY 1,2),"
    " j AS (SELECT o.*, h, b.r AS br, CASE WHEN handle IS NULL THEN 'invalid_citation' WHEN overlap>=0.34 AND sound THEN 'supported' WHEN h IS NOT NULL THEN 'reassigned' WHEN overlap>=0.20 AND sound THEN 'review' ELSE 'not_grounded' END AS status FROM own o LEFT JOIN best b USING(case_id, claim_id))"
    " SELECT case_id, claim_id, status, CASE WHEN status='reassigned' THEN h ELSE handle END AS handle, CASE WHEN status='reassigned' THEN br ELSE overlap END AS overlap FROM j",
)
def _(t: Tables):
    """Turns of users as claims that cite the next turn; the answers of the conversation are the items."""
    v = t.conversations
    claims = v.filter("role = 'user'").select(c("conv_id").alias("case_id"), c("turn").alias("claim_id"), "text")
    items = v.filter("role = 'assistant'").select(c("conv_id").alias("case_id"), c("turn").alias("handle"), "text", F.lit(True).alias("citable"))
    cites = claims.select("case_id", "claim_id", (c("claim_id") + 1).alias("handle"))
    return citing.support(claims, cites, items).select("case_id", "claim_id", "status", F.get("handles", F.lit(0)).alias("handle"), "overlap")


@query(
    "k11_golden_evaluation",
    f"WITH {BM25}, {FOUND}, must AS (SELECT item_id AS query_id, doc_id FROM b JOIN d ON contains(x, head)), n AS (SELECT query_id, count(*) AS musts FROM must GROUP BY 1),"
    " ev AS (SELECT query_id, doc_id, rank<=5 AS used, m.doc_id IS NOT NULL AS hit FROM lex LEFT JOIN must m USING(query_id, doc_id) WHERE rank<=10),"
    " g AS (SELECT query_id, count(*) FILTER (WHERE hit) AS found, count(*) FILTER (WHERE hit AND used) AS cited, count(*) FILTER (WHERE used) AS visible FROM ev GROUP BY 1),"
    " r AS (SELECT item_id AS case_id, coalesce(musts,0) AS m, coalesce(found,0) AS f, coalesce(cited,0) AS c, coalesce(visible,0) AS v FROM benchmark LEFT JOIN n ON n.query_id=item_id LEFT JOIN g ON g.query_id=item_id),"
    " o AS (SELECT case_id, CASE WHEN m=0 THEN 1.0::DOUBLE ELSE round(f/m::DOUBLE,6) END AS retrieval_recall, CASE WHEN m=0 THEN 1.0::DOUBLE ELSE round(c/m::DOUBLE,6) END AS citation_recall,"
    " CASE WHEN m>0 AND v>0 THEN round(c/v::DOUBLE,6) END AS citation_precision, CASE WHEN m>0 AND v>0 THEN v-c END AS noise, v<=4 AS coherent FROM r)"
    " SELECT *, retrieval_recall>=1 AND citation_recall>=1 AND coherent AS passed FROM o",
)
def _(t: Tables):
    """Passages as questions: documents that hold a passage must be cited; the ten best are found, the best five cited, four may be shown."""
    top = lexical(t, 10)
    none = F.lit(None).cast("long")
    rest = [F.lit(None).cast("int").alias("page_number"), none.alias("media_id"), none.alias("segment_id"), none.alias("start_ms")]
    evidence = top.select(c("query_id").alias("case_id"), c("rank").alias("place"), (c("rank") <= 5).alias("used"), c("doc_id").alias("document_id"), *rest)
    expected = passages_found(t).select(c("item_id").alias("case_id"), c("doc_id").alias("expectation"), F.lit(True).alias("must"), c("doc_id").alias("document_id"), *rest)
    cases = t.benchmark.select(c("item_id").alias("case_id"), F.lit("direct").alias("answer_kind"), F.lit(1).alias("claims"), F.lit(0).alias("occurrences"), F.lit("direct").alias("expected_kind"), F.lit(False).alias("expected_abstention"), F.lit(4).alias("max_visible"))
    return evaluation.golden(cases, expected, evidence).drop("abstention", "kind_matches")


_PARTIES = "p AS (SELECT o_custkey AS case_id, o_orderkey, 'Casa '||n_name||' Norte' AS a, 'Banco '||r_name||' S.A.' AS b FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey)"


def party_pages(t: Tables):
    """A page an order: a heading with the claimant, a line that ends with the defendant."""
    x = t.orders.join(t.customer, c("c_custkey") == c("o_custkey")).join(t.nation, c("n_nationkey") == c("c_nationkey")).join(t.region, c("r_regionkey") == c("n_regionkey"))
    text = F.concat(F.lit("Auto\nDEMANDANTE: Casa "), "n_name", F.lit(" Norte; obra en autos\n  Banco "), "r_name", F.lit(" S.A., EJECUTADO\nfin"))
    return x.select(c("o_custkey").alias("case_id"), c("o_orderkey").alias("document_id"), c("o_orderkey").alias("filename"), F.lit(1).alias("page_number"), text.alias("text"))


@query(
    "l11_party_extraction",
    f"WITH {_PARTIES}, n AS (SELECT case_id, o_orderkey, a AS name, 'claimant' AS role FROM p UNION ALL SELECT case_id, o_orderkey, trim(b,'.'), 'defendant' FROM p)"
    " SELECT case_id, regexp_replace(upper(name),'[^A-Z0-9]','','g') AS key, any_value(name) AS name, any_value(role) AS role, CASE WHEN any_value(role)='claimant' THEN 'person' ELSE 'organization' END AS entity_type, count(*) AS mentions, min(o_orderkey) AS document_id FROM n GROUP BY 1,2",
)
def _(t: Tables):
    return extraction.parties(party_pages(t)).drop("page_number")


@query(
    "l13_side_vote",
    "WITH v AS (SELECT o_custkey AS party_id, 4*count(*) FILTER (WHERE o_orderstatus='F') AS claimant, 4*count(*) FILTER (WHERE o_orderstatus='O') + 2*count(*) FILTER (WHERE o_orderstatus='P') AS defendant FROM orders GROUP BY 1),"
    " w AS (SELECT c_custkey AS party_id, coalesce(claimant,0) AS claimant, coalesce(defendant,0) AS defendant FROM customer LEFT JOIN v ON party_id=c_custkey)"
    " SELECT *, CASE WHEN claimant>=2 AND claimant>defendant THEN 'attorney_claimant' WHEN defendant>=2 AND defendant>claimant THEN 'attorney_defendant' ELSE 'attorney' END AS role FROM w",
)
def _(t: Tables):
    """An attorney a customer, a text an order: both surnames see the word for an attorney, so a plain text votes twice for its side; a block once."""
    name = lambda k: F.concat(F.lit("Ana Perez"), c(k).cast("string"))
    attorneys = t.customer.select(c("c_custkey").alias("case_id"), c("c_custkey").alias("party_id"), name("c_custkey").alias("name"))
    side = F.when(c("o_orderstatus") == "F", F.concat(F.lit("Consta que la apoderada "), name("o_custkey"), F.lit(" de la parte demandante obra."))).when(
        c("o_orderstatus") == "O", F.concat(F.lit("El apoderado, doctor "), name("o_custkey"), F.lit(", del demandado y de la ejecutante.")))
    text = side.otherwise(F.concat(F.lit("Demandante: X\nDemandado: Y\nApoderado: "), name("o_custkey")))
    return extraction.attorney_sides(attorneys, t.orders.select(c("o_custkey").alias("case_id"), text.alias("text")))


@query(
    "c11_index_changes",
    "WITH o AS (SELECT source, doc_id, md5(text) AS h FROM documents), n AS (SELECT source, doc_id, md5(CASE WHEN quality=0 THEN text||' edited' ELSE text END) AS h FROM documents LEFT JOIN labels USING(doc_id) WHERE coalesce(toxic,0)=0),"
    " f AS (SELECT coalesce(o.source,n.source) AS source, CASE WHEN n.h IS NULL THEN 'drop' WHEN o.h IS NULL THEN 'add' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.source=n.source AND o.doc_id=n.doc_id AND o.h=n.h)"
    " SELECT source, action, count(*) AS n FROM f GROUP BY 1,2",
)
def _(t: Tables):
    """Toxic documents went, those of low quality were edited."""
    old = t.documents.select("source", "doc_id", "text", F.lit("m1").alias("model"))
    new = old.join(t.labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0).withColumn("text", F.when(c("quality") == 0, F.concat("text", F.lit(" edited"))).otherwise(c("text")))
    return packages.index_changes(old, new, "source", ["doc_id"]).groupBy("source", "action").agg(F.count("*").alias("n"))


@query(
    "s3_scoped_tables",
    "SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey=7 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey=7 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey=7 UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'nobody', 0",
)
def _(t: Tables):
    """Every table of the catalogue as one tenant sees it, and as nobody does."""
    all_of = Catalogue(t.spark, t.sf_dir, {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey"}, shared=("region",))
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = count("nobody", all_of.of(None).table("customer"))
    for name in all_of.names:
        out = out.unionByName(count(name, all_of.of(7).table(name)))
    return out


# ---- searches as users call them ----

PHRASE = "(^|[^0-9a-z])with.{0,12}that([^0-9a-z]|$)"
_TWO = "q AS (SELECT 0 AS query_id, unnest(['with','that']) AS term)"
CASE_SEARCH = (
    f"WITH {BM25.replace(QUERIES_SQL, _TWO)}, v AS (SELECT conv_id*100+turn AS id, {D.fold('text')} AS f, role FROM conversations),"
    f" x AS (SELECT 'page' AS kind, doc_id AS id, 0 AS way, 0 AS rank FROM documents WHERE regexp_matches({D.fold('text')}, '{PHRASE}') UNION ALL SELECT 'segment', id, 0, 0 FROM v WHERE regexp_matches(f, '{PHRASE}')"
    " UNION ALL SELECT 'segment', id, 1, 0 FROM v WHERE contains(f,'with') OR contains(f,'that') OR contains(role,'with') OR contains(role,'that') UNION ALL SELECT 'page', doc_id, 2, rank FROM lex WHERE rank<=40),"
    " m AS (SELECT kind, id, min(way*1000+rank) AS w FROM x GROUP BY 1,2) SELECT kind, id, ['exact','transcript','hybrid'][w//1000+1] AS found, row_number() OVER (ORDER BY w, kind, id) AS place FROM m ORDER BY place LIMIT 40"
)


def case_texts(t: Tables):
    """Pages and segments of all cases as searches take them."""
    return t.documents.select(c("doc_id").alias("id"), "text"), t.conversations.select((c("conv_id") * 100 + c("turn")).alias("id"), "text", c("role").alias("speaker"))


@query("x18_phrase", f"SELECT 'page' AS kind, doc_id AS id FROM documents WHERE regexp_matches({D.fold('text')}, '{PHRASE}') UNION ALL SELECT 'segment', conv_id*100+turn FROM conversations WHERE regexp_matches({D.fold('text')}, '{PHRASE}')")
def _(t: Tables):
    pages, segments = case_texts(t)
    every = pages.select(F.lit("page").alias("kind"), "id", "text").union(segments.select(F.lit("segment"), "id", "text"))
    return every.filter(search.has_phrase(c("text"), "With THAT")).select("kind", "id")


@query("x20_case_search", CASE_SEARCH)
def _(t: Tables):
    return ranking.case_search(*case_texts(t), "with that", 40).withColumn("place", c("place").cast("long"))


_SPOKEN = "v AS (SELECT conv_id*100+turn AS id, text FROM conversations)"


@query(
    "x22_transcript_search",
    f"WITH {_SPOKEN}, {_posted('vp', 'id', 'v')}, s AS (SELECT id, 0.1::DOUBLE*sum(n) AS score FROM vp WHERE term IN ('with','that') GROUP BY 1) SELECT id, row_number() OVER (ORDER BY round(score,9) DESC, id) AS place, round(score,6) AS score FROM s ORDER BY place LIMIT 25",
)
def _(t: Tables):
    return ranking.search_texts(case_texts(t)[1], "with that", 25).select("id", c("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query(
    "x13_lexical_fallback",
    f"WITH {_SPOKEN}, u AS (SELECT doc_id*2 AS id, text FROM documents UNION ALL SELECT id*2+1, text FROM v), {_posted('up', 'id', 'u')}, {QUERIES_SQL}, s AS (SELECT query_id, id, 0.1::DOUBLE*sum(n) AS score FROM q JOIN up USING(term) GROUP BY 1,2),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, id) AS place FROM s) SELECT query_id, CASE WHEN id%2=0 THEN 'page' ELSE 'segment' END AS kind, id//2 AS id, place FROM r WHERE place<=12",
)
def _(t: Tables):
    """Pages and segments in one list, for every question."""
    pages, segments = case_texts(t)
    both = pages.select((c("id") * 2).alias("id"), "text").union(segments.select(c("id") * 2 + 1, "text"))  # one number line: pages are even
    asked = t.benchmark.select(c("item_id").alias("query_id"), F.explode(T.content_set(c("text"))).alias("term")).distinct()
    found = ranking.density_top_k(both, asked, "id", 12)
    return found.select("query_id", F.when(c("id") % 2 == 0, "page").otherwise("segment").alias("kind"), F.shiftright("id", 1).alias("id"), c("rank").cast("long").alias("place"))


def rules_of(t: Tables):
    """Parts as rules: each has an identifier, and its title names the next article."""
    return t.part.select(c("p_partkey").cast("string").alias("identifier"), c("p_brand").alias("source"), F.concat(F.lit("Artículo "), (c("p_partkey") + 1).cast("string")).alias("title"), c("p_name").alias("text"), F.date_add(F.to_date(F.lit("2000-01-01")), c("p_size").cast("int")).alias("version_date"))


@query(
    "x27_rule_lookup",
    "WITH o AS (SELECT o_orderkey AS k, o_orderkey%(SELECT 3*count(*) FROM part)+1 AS a FROM orders) SELECT k, coalesce(p.p_name, n.p_name) AS rule FROM o LEFT JOIN part p ON p.p_partkey=a LEFT JOIN part n ON n.p_partkey+1=a WHERE coalesce(p.p_name, n.p_name) IS NOT NULL",
)
def _(t: Tables):
    """Orders cite an article: the part with that identifier, or else the one whose title names it."""
    cited = (c("o_orderkey") % F.lit(3 * t.part.count()) + 1).cast("string")
    norms = t.orders.select(c("o_orderkey").alias("k"), F.lit("article").alias("kind"), cited.alias("identifier"), F.lit("").alias("jurisdiction"), F.lit("").alias("text"))
    return guard.rules_for(norms, rules_of(t), ["k"]).select("k", "r.rule")


_RATED = "0.40::DOUBLE*cov+0.20::DOUBLE*prior+0.15::DOUBLE*prox"


@query(
    "x11_gated_retrieval",
    f"WITH {HYBRID}, have AS ({_HAVE}), cv AS (SELECT query_id, round(count(h.term)/count(*)::DOUBLE,6) AS coverage FROM q LEFT JOIN have h USING(term) GROUP BY 1 HAVING coverage>0.6),"
    " bare AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), " + _posted("bp", "doc_id", "bare") + ","
    " bs AS (SELECT query_id, id AS doc_id, 0.1::DOUBLE*sum(n) AS s FROM q JOIN bp USING(term) GROUP BY 1,2), b5 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s,9) DESC, doc_id) AS rank FROM bs),"
    " c AS (SELECT query_id, doc_id, min(rank) AS rank FROM (SELECT query_id, doc_id, rank FROM h WHERE rank<=30 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1) UNION ALL SELECT query_id, doc_id, rank+30 FROM b5 WHERE rank<=5) GROUP BY 1,2),"
    f" qs AS (SELECT item_id AS query_id, {D.stems('text')} AS q FROM benchmark), ds AS MATERIALIZED (SELECT doc_id, lang, n_chars, {D.stems('text')} AS s FROM documents WHERE doc_id IN (SELECT doc_id FROM c)),"
    " x AS (SELECT query_id, doc_id, rank, len(list_intersect(q,s))/len(q)::DOUBLE AS cov, least(1.0::DOUBLE,n_chars/20011.0::DOUBLE) AS prox, CASE WHEN lang='en' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS prior FROM c JOIN cv USING(query_id) JOIN ds USING(doc_id) JOIN qs USING(query_id)),"
    f" r AS (SELECT query_id, doc_id, rank, round(least(1,greatest(0,{_RATED})),6) AS score FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS place FROM r)"
    " SELECT query_id, doc_id, place, 'E'||place AS handle, score FROM o WHERE place<=8",
)
def _(t: Tables):
    """Toxic documents can't be cited; documents without a vector have no index."""
    bare = t.documents.select("doc_id", "text").join(t.embeddings.select(c("vec_id").alias("doc_id")), "doc_id", "left_anti")
    extra = ranking.density_top_k(bare, terms_of(t), "doc_id", 5)
    citable = t.documents.select("doc_id").join(t.labels.filter("toxic = 1"), "doc_id", "left_anti")
    asked = t.benchmark.select(c("item_id").alias("query_id"), T.content_set(c("text")).alias("q"))

    def score(rows):
        x = rows.join(doc_sets(t, rows), "doc_id").join(asked, "query_id")
        share = F.size(F.array_intersect("q", "s")) / F.size("q")
        rated = search.relevance(share, F.lit(0.0), F.when(c("lang") == "en", 1.0).otherwise(0.7), F.least(F.lit(1.0), c("n_chars") / 20011), c("coverage"))
        return x.select("query_id", "doc_id", "rank", rated.alias("score"))

    got = ranking.retrieve(coverage(t), [lexical(t), dense(t)], citable, extra, score, "doc_id", 8, least=0.6)
    return got.withColumn("place", c("place").cast("long"))
