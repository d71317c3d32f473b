"""The read tools by name: ``TOOLS[name](tables, **arguments) -> DataFrame``, over the tables as a case file.

Stand-ins: a source is a document and a doc_id its page; a conversation is a recording and a turn its segment; orders are
facts and line items their evidence; benchmark passages are claims; parts are rules; region, nation and supplier make
the graph.  A query for each tool calls it with fixed arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as T
from ..operators import citing, graph, guard, joins, ranking, search, sequence
from . import duck as D
from .evidence import CASE_SEARCH, V5, case_texts, cited_turns, rules_of
from .linking import EDGES, edges_of
from .more import MARKDOWN_OF
from .registry import Tables, query
from .searching import _posted

c = F.col
TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(sql: str | None = None, **arguments):
    """Register a tool, and a query that calls it with these arguments."""

    def register(f):
        TOOLS[f.__name__] = f
        query(f"tool_{f.__name__}", sql)(lambda t: f(t, **arguments))
        return f

    return register


def pages(t: Tables) -> DataFrame:
    return t.documents.select(c("source").alias("document_id"), c("doc_id").alias("page_number"), "text", "n_chars")


def segments(t: Tables) -> DataFrame:
    return sequence.segments(t.conversations)


def has(term: str):
    return F.lower("text").contains(term.lower())


@tool(CASE_SEARCH, query="with that", k=40)
def search_case(t: Tables, query: str, k: int = 8) -> DataFrame:
    return ranking.case_search(*case_texts(t), query, k).withColumn("place", c("place").cast("long"))


@tool(f"WITH {_posted('dp', 'doc_id', 'documents')}, s AS (SELECT id, sum(n) AS n FROM dp WHERE term IN ('with','that') GROUP BY 1) SELECT id AS page_number FROM s ORDER BY n DESC, id LIMIT 5", query="with that")
def search_documents(t: Tables, query: str, k: int = 5) -> DataFrame:
    return ranking.search_texts(case_texts(t)[0], query, k).select(c("id").alias("page_number"))


@tool("SELECT doc_id AS page_number, n_chars FROM documents WHERE source='src1' AND doc_id BETWEEN 0 AND 900 ORDER BY doc_id LIMIT 10", document_id="src1", from_page=0, to_page=900)
def read_document(t: Tables, document_id: str, from_page: int, to_page: int) -> DataFrame:
    return pages(t).filter((c("document_id") == document_id) & c("page_number").between(from_page, to_page)).orderBy("page_number").limit(10).select("page_number", "n_chars")


@tool("SELECT doc_id AS page_number, md5(text) AS h FROM documents WHERE doc_id=7", page_number=7)
def get_document_page(t: Tables, page_number: int, document_id: str | None = None) -> DataFrame:
    p = pages(t).filter(c("page_number") == page_number)
    return (p if document_id is None else p.filter(c("document_id") == document_id)).select("page_number", F.md5("text").alias("h"))


@tool(MARKDOWN_OF, document_id="src2")
def get_document_markdown(t: Tables, document_id: str) -> DataFrame:
    parts = pages(t).filter(c("document_id") == document_id).select("page_number", T.markdown(c("text")).alias("markdown"))
    return parts.orderBy("page_number")


@tool("SELECT role AS speaker, count(*) AS n, min(turn*10000) AS first_ms FROM conversations GROUP BY 1")
def list_speakers(t: Tables) -> DataFrame:
    return segments(t).groupBy("speaker").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"))


@tool("SELECT s_name AS name FROM supplier WHERE s_acctbal>5000 ORDER BY s_acctbal DESC, s_name LIMIT 15", role="creditor")
def list_people_by_role(t: Tables, role: str, k: int = 15) -> DataFrame:
    limit = {"creditor": c("s_acctbal") > 5000, "debtor": c("s_acctbal") < 0}[role]
    return t.supplier.filter(limit).orderBy(F.desc("s_acctbal"), "s_name").limit(k).select(c("s_name").alias("name"))


@tool("SELECT doc_id AS page_number FROM documents JOIN labels USING(doc_id) WHERE quality<=0 ORDER BY quality, doc_id LIMIT 20", limit=20, max_confidence=0)
def list_low_confidence_pages(t: Tables, limit: int, max_confidence: float, mode: str | None = None) -> DataFrame:
    p = t.documents.join(t.labels, "doc_id").filter(c("quality") <= max_confidence)
    p = p if mode is None else p.filter(c("lang") == mode)
    return p.orderBy("quality", "doc_id").limit(limit).select(c("doc_id").alias("page_number"))


def links(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(c("event_id").alias("source"), F.lead("event_id").over(w).alias("target"), F.lit("precedes").alias("kind")).filter("target is not null")


LINKS = "ln AS (SELECT * FROM (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL)"


@tool(f"WITH {LINKS} SELECT source AS other, 'in' AS direction FROM ln WHERE target=50 UNION ALL SELECT target, 'out' FROM ln WHERE source=50 LIMIT 40", event=50)
def event_relations(t: Tables, event: int, relationship: str | None = None, k: int = 40) -> DataFrame:
    n = graph.neighbours(links(t)).filter(c("id") == event)
    return (n if relationship is None else n.filter(c("kind") == relationship)).limit(k).select("other", "direction")


@tool(f"WITH RECURSIVE {LINKS}, r AS (SELECT 5::BIGINT AS id, 0 AS depth UNION ALL SELECT target, depth+1 FROM r JOIN ln ON source=id WHERE depth<4) SELECT id, CAST(depth AS INT) AS depth FROM r", event=5, depth=4)
def process_path(t: Tables, event: int, depth: int = 6) -> DataFrame:
    return graph.traverse(links(t), t.spark.createDataFrame([(event,)], "id long"), min(depth, 12), directed=True)


@tool(f"WITH v AS (SELECT conv_id*100+turn AS id, text FROM conversations), {_posted('vp', 'id', 'v')}, s AS (SELECT id, sum(n) AS n FROM vp WHERE term IN ('with','that') GROUP BY 1) SELECT id//100 AS media_id, id%100 AS turn FROM s ORDER BY n DESC, id LIMIT 30", query="with that", k=30)
def search_transcripts(t: Tables, query: str, k: int, media_id: int | None = None) -> DataFrame:
    s = case_texts(t)[1]
    found = ranking.search_texts(s if media_id is None else s.filter(F.floor(c("id") / 100) == media_id), query, k)
    return found.select(F.floor(c("id") / 100).alias("media_id"), (c("id") % 100).alias("turn"))


@tool(f"WITH {D.SEGMENTS} SELECT media_id, turn FROM seg WHERE end_ms>=0.1::DOUBLE*60000 AND start_ms<=0.5::DOUBLE*60000 AND lower(text) LIKE '%on%' ORDER BY media_id, start_ms LIMIT 50", query="on", from_minute=0.1, to_minute=0.5, k=50)
def search_transcript_by_time(t: Tables, query: str, from_minute: float, to_minute: float, k: int, media_id: int | None = None) -> DataFrame:
    s = segments(t).filter((c("end_ms") >= from_minute * 60000) & (c("start_ms") <= to_minute * 60000) & has(query))
    return (s if media_id is None else s.filter(c("media_id") == media_id)).orderBy("media_id", "start_ms").limit(k).select("media_id", "turn")


@tool(f"WITH {D.SEGMENTS} SELECT turn FROM seg WHERE media_id=4 ORDER BY CASE WHEN 30000 BETWEEN start_ms AND end_ms THEN 0 ELSE 1 END, abs(start_ms-30000), turn LIMIT 1", media_id=4, at_minute=0.5)
def get_video_segment(t: Tables, media_id: int, at_minute: float) -> DataFrame:
    at = int(at_minute * 60000)
    near = (F.when(F.lit(at).between(c("start_ms"), c("end_ms")), 0).otherwise(1), F.abs(c("start_ms") - at), c("turn"))
    return segments(t).filter(c("media_id") == media_id).orderBy(*near).limit(1).select("turn")


@tool(f"SELECT kind, id FROM (SELECT 'page' AS kind, doc_id AS id FROM documents WHERE contains({D.fold('text')},'with') AND contains({D.fold('text')},'that') UNION ALL SELECT 'segment', conv_id*100+turn FROM conversations WHERE contains({D.fold('text')},'with') OR contains({D.fold('text')},'that')) ORDER BY kind, id LIMIT 300", term="With that")
def locate(t: Tables, term: str, k: int = 300) -> DataFrame:
    return search.locate(*case_texts(t), term, k)


@tool("SELECT source AS name, count(*) AS pages FROM documents WHERE source ILIKE '%src1%' GROUP BY 1", query="src1")
def get_file(t: Tables, query: str) -> DataFrame:
    return joins.all_terms(t.documents, "source", [query]).groupBy(c("source").alias("name")).agg(F.count("*").alias("pages"))


@tool("SELECT 'document' AS kind, source AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'media', CAST(conv_id AS VARCHAR), count(*) FROM conversations GROUP BY 2 ORDER BY kind, name LIMIT 50")
def list_case_files(t: Tables, kind: str | None = None, limit: int = 50) -> DataFrame:
    d = t.documents.groupBy(c("source").alias("name")).agg(F.count("*").alias("n")).select(F.lit("document").alias("kind"), "name", "n")
    f = d.union(t.conversations.groupBy(c("conv_id").cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit("media"), "name", "n"))
    return (f if kind is None else f.filter(c("kind") == kind)).orderBy("kind", "name").limit(limit)


@tool(f"WITH RECURSIVE {EDGES}, st AS (SELECT source AS a, target AS b FROM ed WHERE kind='in_region' UNION SELECT target, source FROM ed WHERE kind='in_region'), r AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT b, depth+1 FROM r JOIN st ON id=a WHERE depth<2) SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1", start_node_id="r1", depth=2, edge_type="in_region")
def graph_query(t: Tables, start_node_id: str, depth: int = 1, edge_type: str | None = None) -> DataFrame:
    return graph.traverse(edges_of(t)[1], t.spark.createDataFrame([(start_node_id,)], "id string"), min(depth, 3), kinds=[edge_type] if edge_type else None)


@tool(f"WITH {EDGES} SELECT source AS other FROM ed WHERE target='n5' AND kind='in_nation' ORDER BY 1 LIMIT 10", node_id="n5", edge_type="in_nation", limit=10)
def graph_neighbors(t: Tables, node_id: str, edge_type: str | None = None, limit: int = 20) -> DataFrame:
    n = graph.neighbours(edges_of(t)[1]).filter(c("id") == node_id)
    return (n if edge_type is None else n.filter(c("kind") == edge_type)).orderBy("other").limit(limit).select("other")


@tool("SELECT 's'||s_suppkey AS id, 'n'||s_nationkey AS other FROM supplier WHERE s_name ILIKE '%00001%'", name="00001")
def find_person(t: Tables, name: str, k: int | None = None) -> DataFrame:
    """All neighbours of the people whose name has these letters; k at most where given."""
    nodes, edges = edges_of(t)
    found = nodes.filter((c("kind") == "supplier") & c("label").ilike(f"%{name}%")).select("id")
    met = graph.neighbours(edges).join(found, "id", "left_semi").select("id", "other")
    return met if k is None else met.orderBy("id", "other").limit(k)


@tool("SELECT item_id FROM benchmark WHERE text ILIKE '%tion%' AND text ILIKE '%the%' ORDER BY item_id DESC LIMIT 10", query="tion the", k=10)
def search_claims(t: Tables, query: str, k: int) -> DataFrame:
    return joins.all_terms(t.benchmark, "text", query.split()).orderBy(F.desc("item_id")).limit(k).select("item_id")


@tool("SELECT o_orderkey AS fact_id FROM orders WHERE o_orderpriority ILIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 12", query="urgent", k=12)
def search_facts(t: Tables, query: str, k: int) -> DataFrame:
    return joins.all_terms(t.orders, "o_orderpriority", query.split()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(k).select(c("o_orderkey").alias("fact_id"))


@tool("SELECT l_orderkey, l_partkey, p_name FROM lineitem JOIN part ON l_partkey=p_partkey WHERE p_name ILIKE '%ring%' ORDER BY l_orderkey, l_partkey, l_linenumber LIMIT 15", query="ring", k=15)
def search_evidence(t: Tables, query: str, k: int) -> DataFrame:
    x = joins.all_terms(t.part, "p_name", query.split()).join(t.lineitem, c("p_partkey") == c("l_partkey"))
    return x.orderBy("l_orderkey", "l_partkey", "l_linenumber").limit(k).select("l_orderkey", "l_partkey", "p_name")


@tool("SELECT event_id FROM events WHERE event_type='error' AND ts>=TIMESTAMP '2024-01-05' AND ts<TIMESTAMP '2024-01-10' ORDER BY ts NULLS LAST, event_id LIMIT 10", query="error", start_date="2024-01-05", end_date="2024-01-10")
def search_timeline(t: Tables, query: str | None = None, start_date: str | None = None, end_date: str | None = None, k: int = 10) -> DataFrame:
    e = t.events
    for given, cond in ((query, c("event_type") == query), (start_date, c("ts") >= F.to_timestamp_ntz(F.lit(f"{start_date} 00:00:00"))), (end_date, c("ts") < F.to_timestamp_ntz(F.lit(f"{end_date} 00:00:00")))):
        e = e if given is None else e.filter(cond)
    return e.orderBy(c("ts").asc_nulls_last(), "event_id").limit(k).select("event_id")


@tool("SELECT event_id FROM events WHERE event_type='signup' ORDER BY ts, event_id LIMIT 15", query="signup")
def get_timeline(t: Tables, query: str | None = None, k: int = 15) -> DataFrame:
    return search_timeline(t, query, k=k)


@tool("SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS evidence FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderkey=33 GROUP BY 1,2", fact_id=33)
def get_fact(t: Tables, fact_id: int) -> DataFrame:
    n = t.lineitem.filter(c("l_orderkey") == fact_id).agg(F.count("*").alias("evidence"), F.lit(fact_id).cast("long").alias("o_orderkey"))
    return t.orders.filter(c("o_orderkey") == fact_id).select("o_orderkey", "o_orderstatus").join(n, "o_orderkey")


@tool("SELECT o_orderkey FROM orders WHERE o_orderstatus='P' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey=o_custkey AND c_mktsegment='BUILDING') ORDER BY o_orderkey LIMIT 25", proof="P", side="BUILDING", limit=25)
def list_facts(t: Tables, proof: str | None = None, side: str | None = None, limit: int = 50) -> DataFrame:
    f = t.orders if proof is None else t.orders.filter(c("o_orderstatus") == proof)
    if side is not None:
        f = f.join(t.customer.filter(c("c_mktsegment") == side), c("o_custkey") == c("c_custkey"), "left_semi")
    return f.orderBy("o_orderkey").limit(limit).select("o_orderkey")


@tool(f"{V5} AND citation_id=1", citation=1)
def verify_citation(t: Tables, citation: int) -> DataFrame:
    cited, pages, segments = cited_turns(t)
    return citing.validity(cited.filter(c("citation_id") == citation), pages, segments).select("citation_id", "valid", F.array_join("reasons", ",").alias("reasons"))


@tool(
    "SELECT CAST(p_partkey AS VARCHAR) AS identifier, p_brand AS source, 'Artículo '||(p_partkey+1) AS title, p_name AS rule, DATE '2000-01-01'+CAST(p_size AS INT) AS version_date, p_partkey=12 AS exact FROM part"
    " WHERE CAST(p_partkey AS VARCHAR) LIKE '%12%' OR CAST(p_partkey+1 AS VARCHAR) LIKE '%12%' OR p_name ILIKE '%12%' OR p_brand ILIKE '%12%' ORDER BY exact DESC, version_date DESC NULLS LAST, p_partkey",
    identifier="Art. 12",
)
def lookup_legal_rule(t: Tables, identifier: str, jurisdiction: str = "", source: str = "", k: int | None = None) -> DataFrame:
    """All rules that bear the norms cited, or else the words asked for: the very one first, then the newest; k at most where given."""
    asked = t.spark.createDataFrame([(identifier,)], "asked string")
    cited = F.transform(L.norms(c("asked")), lambda n: n["identifier"])
    asked = asked.select(F.explode(F.when(F.size(cited) > 0, cited).otherwise(F.array("asked"))).alias("identifier"))
    found = guard.rules_named(rules_of(t), asked, jurisdiction, source).withColumnRenamed("text", "rule")
    found = found.orderBy(F.desc("exact"), F.desc_nulls_last("version_date"), c("identifier").try_cast("long"), "identifier")
    return found if k is None else found.limit(k)
