"""Further operators: rules over single values, profile and claim checks, small reads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import joins, linkage, search, sequence
from . import duck as D
from .linking import NAMES, names
from .registry import Tables, query

c = F.col


@query("t2_immutable_unaccent", f"SELECT conv_id, turn, md5({D.unaccent('text')}) AS h FROM conversations")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", F.md5(T.unaccent(c("text"))).alias("h"))


_GENERAL = "['oficio','numero','num','radicado','proceso','procesal','ejecutiva','ejecutivo','acumulada','acumulado','cautelar','cautelares','medidas','demanda','contestacion','sentencia','auto','providencia','recurso','apelacion','audiencia','diligencia']"


@query(
    "t12_specific_term",
    f"WITH a AS (SELECT conv_id, turn, text, {D.ordered_terms('text')} AS ts FROM conversations WHERE role='user'),"
    f" b AS (SELECT *, list_sort(list_transform(ts, lambda t, i: {{'s': CASE WHEN regexp_matches(t,'[0-9]') THEN 4::DOUBLE+0.2::DOUBLE*least(length(t),10) ELSE 0 END - CASE WHEN list_contains({_GENERAL},t) THEN 4 ELSE 0 END + 0.1::DOUBLE*(i-1), 'p': i}})) AS r FROM a),"
    " d AS (SELECT *, list_last(r).p AS pos, ts[list_last(r).p] AS term FROM b),"
    f" e AS (SELECT *, list_filter(ts[1:pos-1], lambda t: NOT regexp_matches(t,'[0-9]') AND NOT list_contains({_GENERAL},t)) AS nouns, regexp_extract(text, '[\"“«'']([^\"”»'']{{2,80}})[\"”»'']', 1) AS quoted FROM d)"
    f" SELECT conv_id, turn, CASE WHEN trim(quoted)<>'' THEN {D.stem(D.fold('trim(quoted)'))} WHEN len(ts)=0 THEN NULL WHEN NOT regexp_matches(term,'[0-9]') THEN {D.stem('term')}"
    f" WHEN len(nouns)=0 OR contains({D.fold('text')}, 'oficio '||term) THEN term ELSE {D.stem('list_last(nouns)')}||' '||term END AS term FROM e",
)
def _(t: Tables):
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", T.specific_term(c("text")).alias("term"))


@query("t13_expand_query", f"WITH w AS (SELECT item_id, unnest({D.terms('text')}) AS term FROM benchmark), s(term,syn) AS (VALUES ('the','den'),('and','und'),('thed','thees'),('eron','eren')) SELECT item_id, w.term, syn FROM w JOIN s ON s.term=w.term")
def _(t: Tables):
    s = t.spark.createDataFrame([("the", "den"), ("and", "und"), ("thed", "thees"), ("eron", "eren")], "term string, syn string")
    return t.benchmark.select("item_id", F.explode(T.content_terms(c("text"))).alias("term")).join(F.broadcast(s), "term").select("item_id", "term", "syn")


@query("t14_phrase_regex", f"SELECT doc_id FROM documents WHERE regexp_matches({D.fold('text')}, '(^|[^a-z0-9])of.{{0,12}}the([^a-z0-9]|$)')")
def _(t: Tables):
    pattern = R.phrase_pattern("OF the").replace(r"\b", "", 1)[: -len(r"\b")]
    return t.documents.filter(T.fold(c("text")).rlike(f"(^|[^a-z0-9]){pattern}([^a-z0-9]|$)")).select("doc_id")


@query("t15_name_candidates")
def _(t: Tables):
    return t.documents.select("doc_id", F.explode(R.each(R.name_candidates, "array<string>")(c("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("t21_word_error")
def _(t: Tables):
    return t.benchmark.select("item_id", R.each(R.word_error, "double")(c("text"), F.regexp_replace("text", "th", "t")).alias("wer"))


@query("t28_filename_context", "SELECT s_suppkey, lower(regexp_replace(regexp_replace(s_name,'([a-z])([A-Z0-9])','\\1 \\2','g'),'[^A-Za-z0-9]+',' ','g')) AS context FROM supplier")
def _(t: Tables):
    return t.supplier.select("s_suppkey", F.lower(F.regexp_replace(F.regexp_replace("s_name", "([a-z])([A-Z0-9])", "$1 $2"), "[^A-Za-z0-9]+", " ")).alias("context"))


_KNOWN = (
    "'HECHOS','PRETENSIONES','PETICIONES','FUNDAMENTOS','FUNDAMENTOS DE DERECHO','CONTESTACIÓN','CONTESTACION','RESUELVE','RESUELVO','CONSIDERANDO','CONSIDERACIONES','ANTECEDENTES','DECIDE','DECISIÓN',"
    "'DECISION','RESUMEN','ASUNTO','PARTES','PRUEBAS','ANEXOS','DECLARACIONES','NOTIFICACIÓN','NOTIFICACION','APELACIÓN','APELACION','ANTECEDENTES PROCESALES','ACTUACIÓN PROCESAL','ACTUACION PROCESAL',"
    "'COMPETENCIA','LEGITIMACIÓN','LEGITIMACION','PROCEDIMIENTO','CONCLUSIONES','SOLICITUD','PODER'"
)
_LETTERS, _CAPITALS = "len(regexp_extract_all(x,'\\p{L}'))", "len(regexp_extract_all(x,'\\p{Lu}'))::DOUBLE"
_HEADING = (
    f"length(x) BETWEEN 2 AND 90 AND NOT regexp_matches(x,'[.;,]$') AND {_LETTERS}>0 AND (trim(upper(x),':') IN ({_KNOWN}) OR regexp_matches(x,'(?i)^(PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[ÉE]PTIMO|OCTAVO|NOVENO|D[ÉE]CIMO)\\b')"
    f" OR ({_CAPITALS}/{_LETTERS}>=0.85 AND length(x)>=4) OR (x LIKE '%:' AND length(x)<=60 AND {_CAPITALS}/{_LETTERS}>=0.5))"
)
_MARK = "^([-•*·▪◦]|[0-9]{1,3}[.)])\\s+"


MARKDOWN = (
    "WITH l AS (SELECT doc_id, list_transform(string_split_regex(coalesce(text,''), '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')) AS ls FROM documents),"
    " u AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls,1) AS i FROM l),"
    f" k AS (SELECT *, CASE WHEN x='' THEN 'blank' WHEN {_HEADING} THEN 'heading' WHEN regexp_matches(x,'{_MARK}') THEN 'item' ELSE 'text' END AS kind FROM u),"
    " g AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k),"
    " n AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g WHERE kind<>'blank'),"
    " o AS (SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before='item' THEN chr(10) WHEN kind='text' AND prev='text' THEN ' ' ELSE chr(10)||chr(10) END ||"
    f" CASE kind WHEN 'heading' THEN '### '||x WHEN 'item' THEN CASE WHEN regexp_matches(x,'^[0-9]') THEN '1. ' ELSE '- ' END||regexp_replace(x,'{_MARK}','') ELSE x END, '' ORDER BY i) AS m FROM n GROUP BY 1)"
    " SELECT doc_id, md5(coalesce(m,'')) AS h FROM documents LEFT JOIN o USING(doc_id)"
)
#: The same for the pages of one document.
MARKDOWN_OF = MARKDOWN.replace(" SELECT doc_id, md5(coalesce(m,'')) AS h FROM documents LEFT JOIN o USING(doc_id)", " SELECT doc_id AS page_number, coalesce(m,'') AS markdown FROM documents LEFT JOIN o USING(doc_id) WHERE source='src2'")


@query("t30_markdown", MARKDOWN)
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(T.markdown(c("text"))).alias("h"))


@query("t36_identifier_key", "SELECT p_brand AS law, array_to_string(list_sort(list(DISTINCT p_size)),',') AS articles FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy(c("p_brand").alias("law")).agg(F.array_join(F.array_sort(F.collect_set("p_size")).cast("array<string>"), ",").alias("articles"))


@query("w9_quota_per_file", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn<=5")
def _(t: Tables):
    return t.documents.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("rn <= 5").select("doc_id")


@query("o13_array_difference", f"WITH a AS (SELECT conv_id, turn, {D.terms('text')} AS s FROM conversations) SELECT a.conv_id, a.turn, {D.joined('list_filter(b.s, lambda x: NOT list_contains(a.s,x))')} AS new_terms FROM a JOIN a b ON a.conv_id=b.conv_id AND b.turn=a.turn+1")
def _(t: Tables):
    turn = lambda k, n: t.conversations.select("conv_id", (c("turn") - k).alias("turn"), T.content_terms(c("text")).alias(n))
    return turn(0, "a").join(turn(1, "b"), ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(F.array_sort(F.array_except("b", "a")), " ").alias("new_terms"))


@query("a11_weighted_vote", "WITH v AS (SELECT user_id, event_type, round(sum(value*pow(0.5, greatest(date_diff('day',CAST(ts AS DATE),DATE '2024-01-31'),0)/90.0)),6) AS score FROM events GROUP BY 1,2) SELECT user_id, arg_max(event_type,(score, -ascii(event_type))) AS label FROM v GROUP BY 1")
def _(t: Tables):
    w = c("value") * T.recency_weight(F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")))
    return E.vote(t.events, "user_id", "event_type", w).select("user_id", c("event_type").alias("label"))


@query("x5_or_query", f"SELECT item_id, array_to_string(list_transform(list_sort({D.terms('text')}), lambda w: '\"'||w||'\"'),' | ') AS q FROM benchmark")
def _(t: Tables):
    return t.benchmark.select("item_id", F.array_join(F.transform(F.array_sort(T.content_terms(c("text"))), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " | ").alias("q"))


@query("x7_embedding_space_guard", "SELECT vec_id FROM embeddings WHERE label = (SELECT min(label) FROM embeddings)")
def _(t: Tables):
    # Vectors are compared within one model only: here the least label stands for the configured model.
    model = t.embeddings.agg(F.min("label").alias("label"))
    return t.embeddings.join(F.broadcast(model), "label", "left_semi").select("vec_id")  # one row


@query("x8_ngram_embedding")
def _(t: Tables):
    return t.benchmark.select("item_id", R.each(R.ngram_vector, "array<double>")(c("text")).alias("v")).select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).alias("used"))


@query("x23_name_search_with_path", "SELECT 'root/'||r_name||'/'||n_name||'/'||s_name AS path FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE s_name ILIKE '%7%'")
def _(t: Tables):
    n = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    return t.supplier.filter(c("s_name").ilike("%7%")).join(n, c("s_nationkey") == c("n_nationkey")).select(F.concat_ws("/", F.lit("root"), "r_name", "n_name", "s_name").alias("path"))


@query("x24_topic_carry_over", "SELECT a.conv_id, a.turn, CASE WHEN len(regexp_extract_all(a.text,'[^ \\t\\n\\r]+'))<=10 THEN (SELECT arg_max(b.turn,b.turn) FROM conversations b WHERE b.conv_id=a.conv_id AND b.turn<a.turn AND b.role='user' AND len(regexp_extract_all(b.text,'[^ \\t\\n\\r]+'))>10) ELSE a.turn END AS topic FROM conversations a WHERE a.role='user'")
def _(t: Tables):
    long = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))) > 10
    x = joins.as_of_last(t.conversations, ["conv_id"], "turn", long & (c("role") == "user"), c("turn"), "topic")
    return x.filter("role = 'user'").select("conv_id", "turn", "topic")


@query("x29_primary_source", "SELECT o_orderkey, arg_min(l_linenumber, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, -l_extendedprice, l_linenumber)) AS line FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1")
def _(t: Tables):
    rank = F.when(c("l_returnflag") == "R", 0).when(c("l_returnflag") == "A", 1).otherwise(2)
    first = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_linenumber", F.struct(rank, -c("l_extendedprice"), "l_linenumber")).alias("line"))
    return t.orders.select("o_orderkey").join(first, "o_orderkey")


@query("x30_inventory_seed", "SELECT doc_id, CAST(len(regexp_extract_all(text,'[0-9]{5,}')) AS INT) AS n FROM documents WHERE len(regexp_extract_all(text,'[0-9]{5,}'))>=2 ORDER BY n DESC, doc_id LIMIT 12")
def _(t: Tables):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[0-9]{5,}")).alias("n")).filter("n >= 2").orderBy(F.desc("n"), "doc_id").limit(12)


@query("c2_sentence_split")
def _(t: Tables):
    split = R.each(lambda x: sequence.sentences(x or "", 60), "array<string>")
    return t.benchmark.select("item_id", F.posexplode(split(c("text"))).alias("pos", "part")).select("item_id", "pos", F.size(F.split("part", " ")).alias("words"))


@query("c5_structured_chunks", "SELECT c_custkey, c_name||': '||coalesce(CAST(o.k AS VARCHAR),'none') AS text, o.k IS NOT NULL AS citable FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey,(o_orderdate,o_orderkey)) AS k FROM orders GROUP BY 1) o ON o_custkey=c_custkey")
def _(t: Tables):
    last = joins.top_one(t.orders, ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])
    return t.customer.join(last, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.concat("c_name", F.lit(": "), F.coalesce(c("top").cast("string"), F.lit("none"))).alias("text"), c("top").isNotNull().alias("citable"))


@query("c9_nearest_centroid", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v,1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1,2), d AS (SELECT u.vec_id, m.label, sum(u.x*m.x) AS dot FROM u JOIN m USING(i) GROUP BY 1,2), n AS (SELECT label, sqrt(sum(x*x)) AS n FROM m GROUP BY 1) SELECT vec_id, arg_max(label,(round(dot/n,6),-label)) AS speaker FROM d JOIN n USING(label) GROUP BY 1")
def _(t: Tables):
    u = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", c("x").cast("double"))
    mean = u.groupBy("label", "i").agg(F.avg("x").alias("m"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(c("m") * c("m"))).alias("norm"))
    dot = u.select("vec_id", "i", "x").join(mean, "i").groupBy("vec_id", "label").agg(F.sum(c("x") * c("m")).alias("dot")).join(norm, "label")
    return dot.groupBy("vec_id").agg(F.max_by("label", F.struct(F.round(c("dot") / c("norm"), 6), -c("label"))).alias("speaker"))


@query("l4_process_links", "SELECT * FROM (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS target, 'precedes' AS kind, 0.7::DOUBLE AS confidence FROM events) WHERE target IS NOT NULL UNION ALL SELECT * FROM (SELECT e.event_id, (SELECT arg_max(p.event_id,(p.ts,p.event_id)) FROM events p WHERE p.user_id=e.user_id AND p.event_type='view' AND p.ts<=e.ts) AS target, 'responds_to', 0.6::DOUBLE FROM events e WHERE e.event_type='click') WHERE target IS NOT NULL")
def _(t: Tables):
    pre = t.events.select(c("event_id").alias("source"), F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("target"), F.lit("precedes").alias("kind"), F.lit(0.7).alias("confidence"))
    res = joins.as_of_by_type(t.events, ["user_id"], "ts", "event_id", "event_type", {"click": ["view"]}).select(c("event_id").alias("source"), "target", F.lit("responds_to").alias("kind"), F.lit(0.6).alias("confidence"))
    return pre.union(res).filter("target is not null")


@query("l8_people_by_role", "WITH u AS (SELECT c_name AS name, 0 AS p FROM customer WHERE c_mktsegment='BUILDING' UNION ALL SELECT s_name, 1 FROM supplier WHERE s_acctbal>0) SELECT name, CAST(min(p) AS INT) AS p FROM u GROUP BY 1 ORDER BY p, name LIMIT 15")
def _(t: Tables):
    u = t.customer.filter("c_mktsegment = 'BUILDING'").select(c("c_name").alias("name"), F.lit(0).alias("p")).union(t.supplier.filter("s_acctbal > 0").select("s_name", F.lit(1)))
    return u.groupBy("name").agg(F.min("p").alias("p")).orderBy("p", "name").limit(15)


@query("l10_role_suggestion", f"WITH {NAMES} SELECT a.p_name, arg_max(b.p_name, (len(list_intersect(a.s,b.s)), length(b.p_name), b.p_name)) AS suggestion FROM x a JOIN x b ON a.p_name<>b.p_name WHERE len(list_intersect(a.s,b.s))>1 GROUP BY 1")
def _(t: Tables):
    p = linkage.token_pairs(names(t), "p_name", "s", common=2).select("p_name", "other", F.size(F.array_intersect("s", "z")).alias("n")).filter("n > 1")
    both = p.union(p.select("other", "p_name", "n"))
    return both.groupBy("p_name").agg(F.max_by("other", F.struct("n", F.length("other"), "other")).alias("suggestion"))


@query("l12_fuzzy_upsert")
def _(t: Tables):
    names = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("a"), F.substring("c_name", 10, 8).alias("k"))
    new = t.supplier.select(c("s_suppkey").alias("new_id"), F.regexp_replace("s_name", "Supplier", "Customer").alias("b"), F.substring("s_name", 10, 8).alias("k"))
    return new.join(names, "k").filter(R.each(R.same_name, "boolean")(c("a"), c("b"))).groupBy("new_id").agg(F.min("id").alias("id"))


@query("l14_contradiction_match", f"WITH b AS (SELECT item_id, {D.terms('text')} AS d FROM benchmark), q AS (SELECT doc_id, {D.terms('text')} AS q FROM documents), s AS (SELECT doc_id, item_id, round(len(list_intersect(q,d))/len(d)::DOUBLE,6) AS score FROM q, b WHERE len(d)>0) SELECT doc_id, arg_max(item_id,(score,-item_id)) AS item_id FROM s WHERE score>=0.1 GROUP BY 1")
def _(t: Tables):
    # Only pairs that share a term: counts by an equi-join on terms.
    b = t.benchmark.select("item_id", T.content_terms(c("text")).alias("d")).withColumn("n", F.size("d"))
    q = t.documents.select("doc_id", F.explode(T.content_terms(c("text"))).alias("w"))
    s = q.join(b.select("item_id", "n", F.explode("d").alias("w")), "w").groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("k")).withColumn("score", F.round(c("k") / c("n"), 6))
    return s.filter("score >= 0.1").groupBy("doc_id").agg(F.max_by("item_id", F.struct("score", -c("item_id"))).alias("item_id"))


@query("v3_name_support", "SELECT conv_id, turn, round(len(list_filter(['the','and','tion'], lambda w: contains(lower(text),w)))/3.0::DOUBLE,6) >= 0.66 AS supported FROM conversations")
def _(t: Tables):
    hits = sum((F.lower("text").contains(w).cast("int") for w in ("the", "and", "tion")), F.lit(0))
    return t.conversations.select("conv_id", "turn", (F.round(hits / 3, 6) >= 0.66).alias("supported"))


_DENIED = "list_bool_or(list_transform(['no ','nunca','sin ','falta','carece','tampoco'], lambda n: contains(substr(low, greatest(1,i-45), i-greatest(1,i-45)), n)))"


@query("k12_forbidden_phrase", f"WITH l AS (SELECT conv_id, turn, lower(coalesce(text,'')) AS low FROM conversations) SELECT conv_id, turn, len(list_filter(range(1,length(low)+1), lambda i: substr(low,i,3)='the' AND NOT {_DENIED}))>0 AS hit FROM l")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", R.each(R.forbidden, "boolean")(c("text"), F.lit("the ")).alias("hit"))


@query("z4_present_speakers", "SELECT DISTINCT role FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.role=a.role AND b.conv_id=3)")
def _(t: Tables):
    return t.conversations.select("role").distinct().join(t.conversations.filter("conv_id = 3").select("role"), "role", "left_semi")


@query("z5_job_items", "WITH j AS (SELECT o_custkey AS job, list(o_orderkey) AS ids FROM orders GROUP BY 1), u AS (SELECT job, unnest(ids) AS id FROM j) SELECT job, count(DISTINCT id) AS items, count(l_linenumber) AS lines FROM u LEFT JOIN lineitem ON l_orderkey=id GROUP BY 1")
def _(t: Tables):
    per = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.join(per, "o_orderkey", "left").groupBy(c("o_custkey").alias("job")).agg(F.countDistinct("o_orderkey").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


@query("z6_session_list", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1")
def _(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"))


@query(
    "z12_proportional_split",
    "WITH a AS (SELECT item_id, text, length(text) AS n, floor(length(text)*0.4::DOUBLE)::INT AS cut, greatest(3,floor(length(text)*0.2::DOUBLE)::INT) AS reach FROM benchmark),"
    " s AS (SELECT item_id, unnest(range(0,n)) AS p FROM a), h AS (SELECT item_id, arg_min(p, (abs(p-cut), p)) AS p FROM s JOIN a USING(item_id) WHERE substr(text,p+1,1)=' ' AND p>=cut-reach AND p<cut+reach GROUP BY 1)"
    " SELECT item_id, length(trim(left(text,coalesce(p,cut)))) AS head, length(trim(substr(text,coalesce(p,cut)+1))) AS tail FROM a LEFT JOIN h USING(item_id)",
)
def _(t: Tables):
    return t.benchmark.select("item_id", T.split_near(c("text"), 0.4).alias("p")).select("item_id", F.length(F.get("p", F.lit(0))).cast("long").alias("head"), F.length(F.get("p", F.lit(1))).cast("long").alias("tail"))


@query(
    "k6_profile_activation",
    "WITH m AS (SELECT user_id, count(*) FILTER (WHERE event_type='purchase') AS judged, count(*) FILTER (WHERE event_type='signup') AS exemplars, round(avg((value>20)::INT) FILTER (WHERE event_type='click'),6) AS rules, round(avg((value>20)::INT) FILTER (WHERE event_type='view'),6) AS profile, count(*) FILTER (WHERE value<1) AS fr, count(*) FILTER (WHERE value<0.5) AS fp FROM events GROUP BY 1)"
    " SELECT user_id, CASE WHEN exemplars=0 AND judged=0 THEN 'off' WHEN judged<10 AND exemplars=0 THEN 'off' WHEN judged<10 THEN 'shadow' WHEN profile IS NULL OR rules IS NULL THEN 'shadow' WHEN fp>fr THEN 'shadow' WHEN profile>=rules+0.1::DOUBLE THEN 'active' WHEN profile+0.1::DOUBLE<rules THEN 'off' ELSE 'shadow' END AS status FROM m",
)
def _(t: Tables):
    of = lambda kind, x: F.round(F.avg(F.when(c("event_type") == kind, x)), 6)
    m = t.events.groupBy("user_id").agg(
        F.count_if(c("event_type") == "purchase").alias("judged"),
        F.count_if(c("event_type") == "signup").alias("exemplars"),
        of("click", (c("value") > 20).cast("int")).alias("rules"),
        of("view", (c("value") > 20).cast("int")).alias("profile"),
        F.count_if(c("value") < 1).alias("fr"),
        F.count_if(c("value") < 0.5).alias("fp"),
    )
    return m.select("user_id", T.profile_status(*map(c, ("judged", "exemplars", "rules", "profile", "fr", "fp"))).alias("status"))


@query("z14_line_alignment")
def _(t: Tables):
    lines = F.split("text", r"\. ")
    pairs = R.each(lambda a, b: [f"{i}:{j}" for i, j in R.align(list(a), list(b))], "array<string>")
    return t.benchmark.select("item_id", F.array_join(pairs(lines, F.slice(lines, F.lit(2), F.size(lines))), ",").alias("pairs"))


@query("z17_token_share", f"SELECT item_id, len(list_intersect({D.stems('text')}, ['the','on','then','erth']))/4.0::DOUBLE >= 0.25 AS hit FROM benchmark")
def _(t: Tables):
    want = F.array(*map(F.lit, ("the", "on", "then", "erth")))
    return t.benchmark.select("item_id", (F.size(F.array_intersect(T.content_set(c("text")), want)) / 4 >= 0.25).alias("hit"))


@query("z18_verification_summary", "SELECT source, round(avg(quality),6) AS integrity, round(avg(toxic),6) AS unsupported, count(*) AS n FROM documents JOIN labels USING(doc_id) GROUP BY 1")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("integrity"), F.round(F.avg("toxic"), 6).alias("unsupported"), F.count("*").alias("n"))


@query("z19_golden_criteria", "WITH e AS (SELECT doc_id, 'not_toxic' AS rule, toxic=0 AS ok FROM labels UNION ALL SELECT doc_id, 'good', quality=1 FROM labels) SELECT rule, count(*) AS n, round(avg(ok::INT),6) AS passed FROM e GROUP BY 1")
def _(t: Tables):
    rules = F.array(F.struct(F.lit("not_toxic").alias("rule"), (c("toxic") == 0).alias("ok")), F.struct(F.lit("good").alias("rule"), (c("quality") == 1).alias("ok")))
    return t.labels.select(F.explode(rules).alias("x")).groupBy("x.rule").agg(F.count("*").alias("n"), F.round(F.avg(c("x.ok").cast("int")), 6).alias("passed"))


@query("j18_sequence_ratio")
def _(t: Tables):
    p = t.supplier.select("s_suppkey", "s_name", F.substring("s_name", 10, 8).alias("k"))
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, (c("a.k") == c("b.k")) & (c("a.s_suppkey") < c("b.s_suppkey"))).filter(R.each(R.same_name, "boolean")(c("a.s_name"), c("b.s_name"))).select(c("a.s_suppkey").alias("x"), c("b.s_suppkey").alias("y"))


@query("s6_s7_file_sniff", "SELECT page_id, CASE WHEN left(b,5)='%PDF-' THEN 'pdf' WHEN left(lower(ltrim(b)),5) IN ('<html','<!doc') THEN 'html' ELSE 'unknown' END AS kind, sha256(b) AS sha256, octet_length(encode(b)) AS bytes FROM (SELECT page_id, coalesce(html,'') AS b FROM pages)")
def _(t: Tables):
    from ..sources.files import sniff

    raw = F.coalesce("html", F.lit("")).cast("binary")
    return t.pages.select("page_id", sniff(raw).alias("kind"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes"))
