"""Linkage and graph queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, joins, linkage
from .registry import Tables, query

c = F.col


NAMES = "x AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name,' ')) AS s FROM part)"


def names(t: Tables):
    """The different names with their tokens: pairs are formed between names, not between their rows."""
    return t.part.select("p_name").distinct().select("p_name", F.array_distinct(F.split("p_name", " ")).alias("s"))


@query("j17_token_set_join", f"WITH {NAMES} SELECT a.p_name, b.p_name AS other FROM x a JOIN x b ON a.p_name<b.p_name WHERE len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s)))::DOUBLE >= 0.3 OR len(list_intersect(a.s,b.s))=least(len(a.s),len(b.s))")
def _(t: Tables):
    ok = (linkage.jaccard(c("s"), c("z")) >= 0.3) | (F.size(F.array_intersect("s", "z")) == F.least(F.size("s"), F.size("z")))
    return linkage.token_pairs(names(t), "p_name", "s", share=0.3, contained=True).filter(ok).select("p_name", "other")


@query("j18_ratio_join", f"WITH {NAMES} SELECT a.p_name, b.p_name AS other FROM x a JOIN x b ON a.p_name<b.p_name WHERE len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s)))::DOUBLE >= 0.3 AND (contains(a.p_name,b.p_name) OR contains(b.p_name,a.p_name) OR 1-levenshtein(a.p_name,b.p_name)/greatest(length(a.p_name),length(b.p_name),1)::DOUBLE >= 0.6)")
def _(t: Tables):
    return linkage.token_pairs(names(t), "p_name", "s", share=0.3).filter((linkage.jaccard(c("s"), c("z")) >= 0.3) & (linkage.name_ratio(c("p_name"), c("other")) >= 0.6)).select("p_name", "other")


@query(
    "l1_entity_consolidation",
    "WITH x AS (SELECT p_partkey, p_name, p_type, regexp_replace(upper(p_name),'[^A-Z0-9]','','g') AS k FROM part), g AS (SELECT k, p_type, count(*) AS n, min(p_partkey) AS f FROM x GROUP BY 1,2), d AS (SELECT k, arg_max(p_type,(n,-f)) AS kind FROM g GROUP BY 1) SELECT x.k AS key, min(p_partkey) AS canonical, any_value(kind) AS kind, count(*) AS n FROM x JOIN d USING(k) GROUP BY 1",
)
def _(t: Tables):
    return linkage.consolidate_entities(t.part, "p_partkey", "p_name", "p_type", T.normal_name(c("p_name"))).select("key", "canonical", "kind", "n")


@query("l2_event_consolidation")
def _(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), F.lit(None).cast("int").alias("page"), F.array("event_type", F.get_json_object("props", "$.k")).alias("terms"))
    return linkage.consolidate_events(e, ["user_id", "event_type"], "event_id", "day", "page", "terms")


@query(
    "l3_reference_absorption",
    "WITH e AS (SELECT user_id, event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, event_type AS st, value, list_distinct([event_type, json_extract_string(props,'$.k')]) AS s FROM events), p AS (SELECT r.event_id AS ref_id, x.event_id, round(CASE WHEN r.st=x.st THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN r.day=x.day THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END + 0.4::DOUBLE*len(list_intersect(r.s,x.s))/len(list_distinct(list_concat(r.s,x.s)))::DOUBLE,6) AS score, r.st=x.st AS same, len(list_intersect(r.s,x.s))/len(list_distinct(list_concat(r.s,x.s)))::DOUBLE AS sim FROM e r JOIN e x ON r.user_id=x.user_id WHERE r.value<5 AND x.value>=5 AND abs(r.day-x.day)<=45), q AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, event_id) AS rn FROM p WHERE (same OR sim>=0.5) AND score>=0.6) SELECT ref_id, event_id, score FROM q WHERE rn=1",
)
def _(t: Tables):
    e = t.events.select("user_id", "event_id", "value", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), c("event_type").alias("subtype"), F.array_distinct(F.array("event_type", F.get_json_object("props", "$.k"))).alias("terms"))
    return linkage.absorb_references(e.filter("value < 5").withColumnRenamed("event_id", "ref_id"), e.filter("value >= 5"), ["user_id"])


@query("l5_review_flags", "WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), g AS (SELECT h, count(*) AS n, min(doc_id) AS f FROM d GROUP BY 1) SELECT doc_id, CASE WHEN n>1 AND doc_id>f THEN 'duplicate' WHEN lab.doc_id IS NULL THEN 'no_source' ELSE 'ok' END AS flag FROM d JOIN g USING(h) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) lab USING(doc_id)")
def _(t: Tables):
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    g = d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    x = d.join(g, "h").join(t.labels.select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left")
    return x.select("doc_id", F.when((c("n") > 1) & (c("doc_id") > c("f")), "duplicate").when(c("l").isNull(), "no_source").otherwise("ok").alias("flag"))


@query("l6_absorb_without_duplicates", "SELECT DISTINCT user_id, event_type FROM events a WHERE value<50 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.value>40 AND b.user_id IS NOT DISTINCT FROM a.user_id AND b.event_type IS NOT DISTINCT FROM a.event_type)")
def _(t: Tables):
    a = t.events.filter("value < 50").alias("a")
    b = t.events.filter("value > 40").select("user_id", "event_type").distinct().alias("b")
    return a.join(b, c("a.user_id").eqNullSafe(c("b.user_id")) & c("a.event_type").eqNullSafe(c("b.event_type")), "left_anti").select("user_id", "event_type").distinct()


@query("l7_speaker_dedupe", "SELECT p_name, arg_min(p_partkey, (p_type<>'PROMO', -p_size, p_partkey)) AS kept FROM part GROUP BY 1")
def _(t: Tables):
    return linkage.keep_best(t.part, ["p_name"], [c("p_type") != "PROMO", -c("p_size"), c("p_partkey")], "p_partkey").select("p_name", c("p_partkey").alias("kept"))


@query("l9_authority_groups", "SELECT array_to_string(list_sort(string_split(lower(p_name),' ')),'|') AS signature, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy(F.array_join(F.array_sort(F.split(F.lower("p_name"), " ")), "|").alias("signature")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("l15_greedy_matching")
def _(t: Tables):
    d = t.conversations.select("conv_id", "turn", "role", T.content_set(c("text")).alias("s"))
    pairs = d.filter("role = 'user'").select("conv_id", c("turn").alias("q"), c("s").alias("a")).join(d.filter("role = 'assistant'").select("conv_id", c("turn").alias("r"), "s"), "conv_id")
    scored = pairs.select("conv_id", "q", "r", F.round(linkage.jaccard(c("a"), c("s")), 6).alias("score")).filter("score > 0")
    return linkage.greedy_pairs(scored, "conv_id", "q", "r", "score")


def edges_of(t: Tables):
    nodes = {
        "region": t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), c("r_name").alias("label")),
        "nation": t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), c("n_name").alias("label")),
        "supplier": t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), c("s_name").alias("label")),
    }
    edges = [
        ("in_region", t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))),
        ("in_nation", t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))),
    ]
    return graph.build(nodes, edges)


EDGES = "ed AS (SELECT 'n'||n_nationkey AS source, 'r'||n_regionkey AS target, 'in_region' AS kind FROM nation UNION ALL SELECT 's'||s_suppkey, 'n'||s_nationkey, 'in_nation' FROM supplier)"


@query("g2_traverse", f"WITH RECURSIVE {EDGES}, st AS (SELECT source AS a, target AS b FROM ed UNION SELECT target, source FROM ed), r AS (SELECT 'n3' AS id, 0 AS depth UNION SELECT b, depth+1 FROM r JOIN st ON id=a WHERE depth<3) SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1")
def _(t: Tables):
    return graph.traverse(edges_of(t)[1], t.spark.createDataFrame([("n3",)], "id string"), 3)


@query("g2_touching_edges", f"WITH {EDGES} SELECT source, target, kind FROM ed WHERE source='n3' OR target='n3'")
def _(t: Tables):
    e = edges_of(t)[1]
    return graph.touching(e, t.spark.createDataFrame([("n3",)], "id string")).select("source", "target", "kind")


@query("g3_neighbours", f"WITH {EDGES} SELECT target AS other, kind, 'out' AS direction FROM ed WHERE source='n3' UNION ALL SELECT source, kind, 'in' FROM ed WHERE target='n3'")
def _(t: Tables):
    return graph.neighbours(edges_of(t)[1]).filter("id = 'n3'").select("other", "kind", "direction")


@query("g4_process_path", "WITH RECURSIVE st AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), s0 AS (SELECT min(event_id) AS id FROM events), r AS (SELECT id, 0 AS depth FROM s0 UNION ALL SELECT b, depth+1 FROM r JOIN st ON id=a WHERE b IS NOT NULL AND depth<6) SELECT id, CAST(depth AS INT) AS depth FROM r")
def _(t: Tables):
    nxt = t.events.select(c("event_id").alias("source"), F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("target"), F.lit("precedes").alias("kind")).filter("target is not null")
    return graph.traverse(nxt, t.events.agg(F.min("event_id").alias("id")), 6, directed=True)


@query("g5_evidence_matrix", "SELECT l_suppkey AS fact, count(*) FILTER (WHERE l_returnflag='A') AS \"A\", count(*) FILTER (WHERE l_returnflag='N') AS \"N\", count(*) FILTER (WHERE l_returnflag='R') AS \"R\" FROM lineitem GROUP BY 1")
def _(t: Tables):
    p = t.lineitem.groupBy(c("l_suppkey").alias("fact")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return p.select("fact", *[F.coalesce(x, F.lit(0)).alias(x) for x in "ANR"])


@query("g6_find_node", "SELECT 'n'||n_nationkey AS id, n_name AS label FROM nation WHERE n_name ILIKE '%2%'")
def _(t: Tables):
    return edges_of(t)[0].filter((c("kind") == "nation") & c("label").ilike("%2%")).select("id", "label")


@query("g7_event_relations", "SELECT source, target, CASE WHEN source%2=0 THEN 'out' ELSE 'in' END AS direction FROM (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL")
def _(t: Tables):
    x = t.events.select(c("event_id").alias("source"), F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("target")).filter("target is not null")
    return x.select("source", "target", F.when(c("source") % 2 == 0, "out").otherwise("in").alias("direction"))


@query("g8_timeline", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey),',') AS parts FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderdate>=TIMESTAMP '1996-01-01' GROUP BY 1,2")
def _(t: Tables):
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",")
    o = t.orders.filter("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    return o.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).groupBy("o_orderkey", "day").agg(parts.alias("parts"))


@query("g9_folder_path", "SELECT 'n'||n_nationkey AS id, 'root/'||r_name||'/'||n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT 'r'||r_regionkey, 'root/'||r_name FROM region UNION ALL SELECT 'root','root'")
def _(t: Tables):
    tree = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent"), c("r_name").alias("name"))
    tree = tree.union(t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name"))
    return graph.paths(tree.union(t.spark.createDataFrame([("root", None, "root")], "id string, parent string, name string")))


@query("j19_scored_theta_join", "SELECT s_suppkey, arg_min(c_custkey, (round(abs(s_acctbal-c_acctbal),2), c_custkey)) AS nearest FROM supplier JOIN customer ON s_nationkey=c_nationkey GROUP BY 1")
def _(t: Tables):
    a = t.supplier.select(c("s_nationkey").alias("k"), c("s_acctbal").alias("x"), "s_suppkey")
    b = t.customer.select(c("c_nationkey").alias("k"), c("c_acctbal").alias("x"), "c_custkey")
    return joins.nearest(a, b, "k", "x", "s_suppkey", "c_custkey", width=20).select("s_suppkey", c("nearest"))
