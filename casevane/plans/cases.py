"""Search as the tools use it, chunks, corrections, packages and the case graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corrections, graph, search, sequence
from ..sources import packages
from . import duck as D
from .registry import Tables, query

c = F.col


# ---- where a term stands ----


@query(
    "x17_locate",
    f"WITH p AS (SELECT 'page' AS kind, doc_id AS id, text FROM documents WHERE contains({D.fold('text')}, 'heoron') AND regexp_matches({D.fold('text')}, '(^|[^0-9a-z])0*7([^0-9a-z]|$)')),"
    f" s AS (SELECT 'segment' AS kind, conv_id*100+turn AS id, text FROM conversations WHERE contains({D.fold('text')}, 'heoron') OR regexp_matches({D.fold('text')}, '(^|[^0-9a-z])0*7([^0-9a-z]|$)') OR contains(role,'heoron'))"
    " SELECT kind, id FROM p UNION ALL SELECT kind, id FROM s",
)
def _(t: Tables):
    pages = t.documents.select(c("doc_id").alias("id"), "text")
    segments = t.conversations.select((c("conv_id") * 100 + c("turn")).alias("id"), "text", c("role").alias("speaker"))
    return search.locate(pages, segments, "Heoron 007").select("kind", "id")


@query(
    "x19_occurrences",
    "WITH s AS (SELECT DISTINCT l_orderkey%200 AS file, l_linestatus AS speaker, l_linenumber*7000+(l_partkey%5)*1000 AS a FROM lineitem), g AS (SELECT *, sum(CASE WHEN a-(p+1500) BETWEEN 0 AND 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY file, speaker ORDER BY a) AS run FROM (SELECT *, lag(a) OVER (PARTITION BY file, speaker ORDER BY a) AS p FROM s)),"
    " m AS (SELECT file, speaker, min(a) AS a FROM g GROUP BY file, speaker, run), d AS (SELECT file, speaker, a//60000 AS minute, min(a) AS start_ms FROM m GROUP BY 1,2,3) SELECT file, speaker, start_ms FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_ms, speaker) AS rn FROM d) WHERE rn<=8",
)
def _(t: Tables):
    start = c("l_linenumber") * 7000 + (c("l_partkey") % 5) * 1000
    s = t.lineitem.select((c("l_orderkey") % 200).alias("file"), c("l_linestatus").alias("speaker"), start.alias("start_ms"), (start + 1500).alias("end_ms")).distinct()
    return search.occurrences(s, cap=8).select("file", "speaker", "start_ms")


@query(
    "x2_query_variants",
    f"WITH w AS (SELECT item_id, unnest({D.search_terms('text')}) AS t FROM benchmark), v AS (SELECT item_id, unnest(CASE WHEN regexp_matches(t,'^[0-9]') THEN CASE WHEN regexp_matches(t,'^[0-9]{{3,6}}$') THEN [t] ELSE [] END ELSE [t, {D.stem('t')}] || CASE WHEN t LIKE '%s' AND length(t)>4 THEN [left(t,-1)] ELSE [] END END) AS x FROM w)"
    " SELECT item_id, string_agg(DISTINCT x||':*', ' | ' ORDER BY x||':*') AS prefixes FROM v WHERE length(x)>=3 GROUP BY 1",
)
def _(t: Tables):
    return t.benchmark.select("item_id", F.array_join(F.transform(F.array_sort(search.query_prefixes(c("text"))), lambda x: F.concat(x, F.lit(":*"))), " | ").alias("prefixes")).filter("prefixes <> ''")


# ---- chunks ----


@query(
    "c3_document_chunks",
    "WITH v AS (SELECT doc_id, 'document_ai' AS mode, 'ai '||text AS text FROM documents WHERE doc_id%3=0 UNION ALL SELECT doc_id, 'basico', text FROM documents WHERE doc_id%3<>2 UNION ALL SELECT doc_id+1000000, 'basico', text FROM documents WHERE doc_id%50=1)"
    " SELECT doc_id, mode, md5(text) AS h FROM v WHERE trim(text)<>'' UNION ALL SELECT doc_id, 'none', md5(text) FROM documents WHERE doc_id%3=2 AND trim(text)<>''",
)
def _(t: Tables):
    # Readings by one or two engines; a third of the pages has none, and some readings have no page.
    d = t.documents.select("doc_id", "text")
    versions = d.filter("doc_id % 3 = 0").select("doc_id", F.lit("document_ai").alias("mode"), F.concat(F.lit("ai "), "text").alias("text"))
    versions = versions.union(d.filter("doc_id % 3 <> 2").select("doc_id", F.lit("basico"), "text")).union(d.filter("doc_id % 50 = 1").select(c("doc_id") + 1000000, F.lit("basico"), "text"))
    return sequence.readings(d, versions, "doc_id").select("doc_id", F.coalesce("mode", F.lit("none")).alias("mode"), F.md5("text").alias("h"))


@query("c6_gap_merge")
def _(t: Tables):
    start = c("l_linenumber") * 4000 + (c("l_partkey") % 4) * 150
    x = t.lineitem.select(c("l_orderkey").alias("media_id"), c("l_linenumber").alias("i"), F.when(c("l_suppkey") % 5 == 0, "B").otherwise("A").alias("speaker"), start.alias("start_ms"), (start + 3800).alias("end_ms"), F.concat(F.lit("w"), "l_partkey", F.when(c("l_partkey") % 7 == 0, "-").otherwise("")).alias("text"), c("l_discount").alias("confidence"))
    return sequence.merge_segments(x, ["media_id"]).select("media_id", "start_ms", "end_ms", "speaker", "text", F.round("confidence", 6).alias("confidence"))


@query("z11_split_at_boundary", "WITH w AS (SELECT conv_id, turn, string_split_regex(trim(text),'[ \\t\\n\\r]+') AS ws FROM conversations WHERE trim(text)<>'') SELECT conv_id, turn, array_to_string(ws[1:5],' ') AS head, md5(array_to_string(ws[6:],' ')) AS tail FROM w WHERE len(ws)>5")
def _(t: Tables):
    # Words last 60 ms; the boundary is at 300 ms, the start of the sixth.
    words = F.transform(F.split(F.trim("text"), r"[ \t\n\r]+"), lambda w, i: F.struct(w.alias("word"), (i * 60).alias("start_ms")))
    x = t.conversations.filter(F.trim("text") != "").select("conv_id", "turn", sequence.split_words(words, F.lit(300)).alias("p")).filter("p is not null")
    return x.select("conv_id", "turn", c("p.head").alias("head"), F.md5("p.tail").alias("tail"))


@query("z13_layout_lines")
def _(t: Tables):
    # The lines of an order are words in boxes: two columns, four lines, a gap before the third.
    y = F.when(c("l_linenumber") > 4, (c("l_linenumber") - 1) / 2 * 14 + 40).otherwise(F.floor((c("l_linenumber") - 1) / 2) * 14)
    box = F.struct(F.concat(F.lit("w"), "l_linenumber").alias("text"), (c("l_linenumber") % 2 * 80).cast("double").alias("x"), F.floor(y).cast("double").alias("y"), F.lit(20.0).alias("w"), F.lit(10.0).alias("h"))
    boxes = t.lineitem.select("l_orderkey", "l_linenumber", box.alias("b")).dropDuplicates(["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.collect_list("b").alias("words"))  # the words of one page
    return boxes.select("l_orderkey", sequence.layout(c("words")).alias("text"))


# ---- corrections ----

_FIXES = "f AS (SELECT doc_id, 'corrected '||doc_id AS new_text FROM documents WHERE doc_id%7=0)"


@query("w_correct_ocr_page", f"WITH {_FIXES} SELECT d.doc_id, md5(coalesce(f.new_text, d.text)) AS h, CASE WHEN f.doc_id IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM documents d LEFT JOIN f USING(doc_id)")
def _(t: Tables):
    pages = t.documents.select("doc_id", "text", F.lit(0.5).alias("confidence"))
    made = t.documents.filter("doc_id % 7 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("older").alias("new_text"), F.lit(1).alias("made_at")), F.struct(F.concat(F.lit("corrected "), "doc_id").alias("new_text"), F.lit(2).alias("made_at")))).alias("f"))
    fixed, _ = corrections.correct_texts(pages, made.select("doc_id", "f.new_text", F.lit("said so").alias("reason"), "f.made_at"), ["doc_id"], "page")
    return fixed.select("doc_id", F.md5("text").alias("h"), "confidence")


@query("w_correct_transcript_segment", "SELECT 'segment' AS entity_type, conv_id||':'||turn AS entity_id, md5(text) AS before, 'fixed' AS after FROM conversations WHERE turn%4=1 AND text<>'fixed'")
def _(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "text", F.lit(0.4).alias("confidence"))
    fixes = t.conversations.filter("turn % 4 = 1").select("conv_id", "turn", F.lit("fixed").alias("new_text"), F.lit("heard").alias("reason"), F.lit(1).alias("made_at"))
    return corrections.correct_texts(rows, fixes, ["conv_id", "turn"], "segment")[1].select("entity_type", "entity_id", F.md5("before").alias("before"), "after")


@query("w_rename_speaker", "SELECT s_nationkey AS media_id, s_suppkey AS speaker_id, CASE WHEN s_suppkey%3=0 THEN 'Juez '||s_suppkey ELSE s_name END AS display_name, CASE WHEN s_suppkey%3=0 THEN 'CONFIRMED' ELSE 'OPEN' END AS resolution_status FROM supplier")
def _(t: Tables):
    speakers = t.supplier.select(c("s_nationkey").alias("media_id"), c("s_suppkey").alias("speaker_id"), F.lit("SPEAKER").alias("label"), c("s_name").alias("display_name"), F.lit("OPEN").alias("resolution_status"))
    names = speakers.filter("speaker_id % 3 = 0").select("media_id", "speaker_id", F.concat(F.lit("Juez "), "speaker_id").alias("name"))
    return corrections.rename_speakers(speakers, names)[0].drop("label")


@query("w_merge_speakers", "WITH m AS (SELECT conv_id, turn, CASE WHEN role IN ('assistant','system') THEN 'user' ELSE role END AS speaker_id FROM conversations) SELECT conv_id AS media_id, speaker_id, count(*) AS segments FROM m GROUP BY 1,2")
def _(t: Tables):
    s = t.conversations.select(c("conv_id").alias("media_id"), "turn", c("role").alias("speaker_id"))
    speakers = s.select("media_id", "speaker_id").distinct()
    pairs = F.array(F.struct(F.lit("assistant").alias("keep_id"), F.lit("system").alias("drop_id")), F.struct(F.lit("user").alias("keep_id"), F.lit("assistant").alias("drop_id")))
    merges = speakers.select("media_id").distinct().select("media_id", F.explode(pairs).alias("m")).select("media_id", "m.keep_id", "m.drop_id")
    return corrections.merge_speakers(s, speakers, merges)[0].groupBy("media_id", "speaker_id").agg(F.count("*").alias("segments"))


@query("w_suggest_reprocess", "SELECT l_orderkey, l_linestatus AS mode, count(*) AS pages, round(avg(l_discount*10),6) AS mean_confidence, count(*) FILTER (WHERE l_discount*10<0.55) AS low_pages, CASE WHEN round(avg(l_discount*10),6)<0.55 OR 2*count(*) FILTER (WHERE l_discount*10<0.55)>count(*) THEN 'reprocess' WHEN count(*) FILTER (WHERE l_discount*10<0.55)>0 THEN 'review' ELSE 'keep' END AS suggestion FROM lineitem GROUP BY 1,2")
def _(t: Tables):
    return corrections.diagnose(t.lineitem.select("l_orderkey", c("l_linestatus").alias("mode"), (c("l_discount") * 10).alias("confidence")), "l_orderkey", "mode", "confidence")


@query("w_reprocess_low_confidence", "WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, min(l_discount*10) AS k FROM lineitem GROUP BY 1,2), w AS (SELECT * FROM p WHERE k<=0.55 ORDER BY k, l_orderkey, l_linenumber LIMIT 20) SELECT l_orderkey, 'document_ai' AS target, array_to_string(list(l_linenumber ORDER BY l_linenumber),',') AS pages FROM w GROUP BY 1")
def _(t: Tables):
    pages = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(c("l_discount") * 10).alias("k")).withColumn("mode", F.lit("basico"))
    return corrections.reprocess_plan(pages, "l_orderkey", "l_linenumber", "mode", "k").select("l_orderkey", "target", F.array_join(c("pages").cast("array<string>"), ",").alias("pages"))


# ---- packages ----


@query("s11_index_match", "WITH f AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey%500 AS VARCHAR),3,'0')||' - escrito '||o_custkey||'.pdf' AS name FROM orders), i AS (SELECT c_custkey AS entry, CAST(c_custkey AS VARCHAR)||'. '||c_name AS title FROM customer) SELECT id, entry FROM f JOIN i ON CAST(regexp_extract(name,'^0*([0-9]+)',1) AS BIGINT)=entry")
def _(t: Tables):
    files = t.orders.select(c("o_orderkey").alias("id"), F.concat(F.lpad((c("o_orderkey") % 500).cast("string"), 3, "0"), F.lit(" - escrito "), "o_custkey", F.lit(".pdf")).alias("name"))
    index = t.customer.select(c("c_custkey").alias("entry"), F.concat("c_custkey", F.lit(". "), "c_name").alias("title"))
    return packages.match_index(files, index, "name", "title").select("id", "entry")


@query("s13_package_manifest", "SELECT c_custkey AS case_id, count(DISTINCT o_orderkey) AS documents, count(l_linenumber) AS pages FROM customer LEFT JOIN orders ON o_custkey=c_custkey LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1")
def _(t: Tables):
    documents = t.orders.select(c("o_custkey").alias("case_id"), "o_orderkey")
    pages = t.lineitem.join(documents, c("l_orderkey") == c("o_orderkey")).select("case_id", "l_linenumber")
    return packages.case_manifest(t.customer.select(c("c_custkey").alias("case_id")), {"documents": documents, "pages": pages})


@query("s15_fact_rows", "SELECT o_orderkey AS id, o_orderstatus AS proof_status, l_linenumber AS position, CASE WHEN l_returnflag='R' THEN 'DENIES' ELSE 'ALLEGES' END AS stance FROM orders JOIN lineitem ON l_orderkey=o_orderkey")
def _(t: Tables):
    stance = F.when(c("l_returnflag") == "R", "DENIES").otherwise("ALLEGES")
    positions = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_linenumber").alias("position"), stance.alias("stance"))).alias("positions"))  # the positions on one fact
    facts = t.orders.join(positions, c("o_orderkey") == c("l_orderkey")).select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("proof_status"), "positions")
    return packages.fact_rows(facts)


# ---- the case graph: every kind of node, and edges of the fixed kinds ----

_NODES = (
    "n AS (SELECT 'Case' AS kind, 'case'||c_custkey AS id FROM customer UNION ALL SELECT 'Document', 'doc'||o_orderkey FROM orders UNION ALL SELECT 'Person', 'per'||s_suppkey FROM supplier WHERE s_suppkey%2=0 UNION ALL SELECT 'Organization', 'org'||s_suppkey FROM supplier WHERE s_suppkey%2=1"
    " UNION ALL SELECT DISTINCT 'Claim', 'clm'||l_orderkey||'-'||l_linenumber FROM lineitem UNION ALL SELECT 'Fact', 'fct'||p_partkey FROM part UNION ALL SELECT 'Event', 'evt'||event_id FROM events UNION ALL SELECT 'Decision', 'dec'||n_nationkey FROM nation UNION ALL SELECT 'Issue', 'iss'||r_regionkey FROM region"
    " UNION ALL SELECT DISTINCT 'Speaker', 'spk'||user_id FROM events UNION ALL SELECT DISTINCT 'Evidence', 'evd'||l_orderkey FROM lineitem)"
)
_EDGES = (
    "e AS (SELECT 'CITES' AS kind, 'doc'||l_orderkey AS source, 'clm'||l_orderkey||'-'||l_linenumber AS target FROM lineitem UNION ALL SELECT CASE l_returnflag WHEN 'A' THEN 'ASSERTS' WHEN 'R' THEN 'REFUTES' ELSE 'SUPPORTS' END, 'clm'||l_orderkey||'-'||l_linenumber, 'fct'||l_partkey FROM lineitem"
    " UNION ALL SELECT CASE l_linestatus WHEN 'O' THEN 'ALLEGES' ELSE 'DENIES' END, CASE WHEN l_suppkey%2=0 THEN 'per' ELSE 'org' END||l_suppkey, 'fct'||l_partkey FROM lineitem UNION ALL SELECT 'PRECEDES', 'evt'||a, 'evt'||b FROM (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL"
    " UNION ALL SELECT 'TESTIFIED_IN', 'spk'||user_id, 'evt'||event_id FROM events UNION ALL SELECT 'FACT_ABOUT_ISSUE', 'fct'||p_partkey, 'iss'||(p_partkey%5) FROM part UNION ALL SELECT 'DECISION_PROVES_FACT', 'dec'||(p_partkey%25), 'fct'||p_partkey FROM part WHERE p_size>40 UNION ALL SELECT 'IS_PARTY', CASE WHEN s_suppkey%2=0 THEN 'per' ELSE 'org' END||s_suppkey, 'case'||(s_suppkey%10) FROM supplier"
    " UNION ALL SELECT 'DERIVED_FROM', 'evd'||l_orderkey, 'doc'||l_orderkey FROM lineitem)"
)


def case_graph(t: Tables):
    """Nodes and edges by kind; a node is there as often as rows name it, and who needs each once makes ids distinct."""
    ident = lambda p, *x: F.concat(F.lit(p), *x)
    claim = ident("clm", "l_orderkey", F.lit("-"), "l_linenumber")
    party = F.concat(F.when(c("l_suppkey") % 2 == 0, "per").otherwise("org"), c("l_suppkey"))
    nodes = {
        "Case": t.customer.select(ident("case", "c_custkey").alias("id"), c("c_name").alias("label")),
        "Document": t.orders.select(ident("doc", "o_orderkey").alias("id"), c("o_orderpriority").alias("label")),
        "Person": t.supplier.filter("s_suppkey % 2 = 0").select(ident("per", "s_suppkey").alias("id"), c("s_name").alias("label")),
        "Organization": t.supplier.filter("s_suppkey % 2 = 1").select(ident("org", "s_suppkey").alias("id"), c("s_name").alias("label")),
        "Claim": t.lineitem.select(claim.alias("id"), F.lit("").alias("label")),
        "Fact": t.part.select(ident("fct", "p_partkey").alias("id"), c("p_name").alias("label")),
        "Event": t.events.select(ident("evt", "event_id").alias("id"), c("event_type").alias("label")),
        "Decision": t.nation.select(ident("dec", "n_nationkey").alias("id"), c("n_name").alias("label")),
        "Issue": t.region.select(ident("iss", "r_regionkey").alias("id"), c("r_name").alias("label")),
        "Speaker": t.events.select(ident("spk", "user_id").alias("id"), F.lit("").alias("label")),
        "Evidence": t.lineitem.select(ident("evd", "l_orderkey").alias("id"), F.lit("").alias("label")),
    }
    e = t.events.select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next")).filter("next is not null")
    pair = lambda df, s, d: df.select(s.alias("source"), d.alias("target"))
    fact = ident("fct", "l_partkey")
    li, part = t.lineitem, t.part
    edges = [("CITES", pair(li, ident("doc", "l_orderkey"), claim))]
    edges += [(k, pair(li.filter(c("l_returnflag") == f), claim, fact)) for k, f in (("ASSERTS", "A"), ("REFUTES", "R"))]
    edges += [("SUPPORTS", pair(li.filter(~c("l_returnflag").isin("A", "R")), claim, fact)), ("ALLEGES", pair(li.filter("l_linestatus = 'O'"), party, fact)), ("DENIES", pair(li.filter("l_linestatus <> 'O'"), party, fact))]
    edges += [("PRECEDES", pair(e, ident("evt", "event_id"), ident("evt", "next"))), ("TESTIFIED_IN", pair(t.events, ident("spk", "user_id"), ident("evt", "event_id")))]
    edges += [("FACT_ABOUT_ISSUE", pair(part, ident("fct", "p_partkey"), ident("iss", (c("p_partkey") % 5).cast("string")))), ("DECISION_PROVES_FACT", pair(part.filter("p_size > 40"), ident("dec", (c("p_partkey") % 25).cast("string")), ident("fct", "p_partkey")))]
    s = t.supplier
    edges += [("IS_PARTY", pair(s, F.concat(F.when(c("s_suppkey") % 2 == 0, "per").otherwise("org"), c("s_suppkey")), ident("case", (c("s_suppkey") % 10).cast("string")))), ("DERIVED_FROM", pair(li, ident("evd", "l_orderkey"), ident("doc", "l_orderkey")))]
    return nodes, edges


@query("g1_graph_build", f"WITH {_NODES}, {_EDGES}, d AS (SELECT DISTINCT kind, source, target FROM e), k AS (SELECT d.* FROM d WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)) SELECT kind, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM k GROUP BY 1")
def _(t: Tables):
    nodes, edges = graph.build(*case_graph(t))
    # The edges lie by source: sources are counted there, without moving them again.  Both counts read the same shuffle, so
    # both have to ask for the same columns.
    g = graph.between(nodes, edges.drop("provenance"))
    sources = g.groupBy("kind", "source").agg(F.count("target").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("sources"))
    return sources.join(g.groupBy("kind", "target").agg(F.count("*")).groupBy("kind").agg(F.count("*").alias("targets")), "kind")


@query("g1_graph_nodes", f"WITH {_NODES} SELECT kind, count(DISTINCT id) AS n FROM n GROUP BY 1")
def _(t: Tables):
    return graph.build(*case_graph(t))[0].select("kind", "id").distinct().groupBy("kind").agg(F.count("*").alias("n"))
