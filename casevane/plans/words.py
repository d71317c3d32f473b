"""Text functions applied to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import duck as D
from .registry import Tables, query

c = F.col
line = lambda a: F.array_join(F.array_sort(a), " ")


@query("t1_fold", f"SELECT doc_id, md5({D.fold('text')}) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(T.fold(c("text"))).alias("h"))


@query("t3_raw_tokens", f"SELECT doc_id, CAST(len({D.raw('text')}) AS INT) AS n, md5({D.joined(D.raw('text'))}) AS h FROM documents")
def _(t: Tables):
    raw = T.raw_tokens(c("text"))
    return t.documents.select("doc_id", F.size(raw).alias("n"), F.md5(line(raw)).alias("h"))


@query("t4_content_terms", f"SELECT item_id, {D.joined(D.terms('text'))} AS terms FROM benchmark")
def _(t: Tables):
    return t.benchmark.select("item_id", line(T.content_terms(c("text"))).alias("terms"))


@query("t5_search_terms", f"SELECT item_id, {D.joined(D.terms('text', False))} AS terms FROM benchmark")
def _(t: Tables):
    return t.benchmark.select("item_id", line(T.search_terms(c("text"))).alias("terms"))


@query("t6_stem", f"SELECT DISTINCT w, {D.stem('w')} AS stem FROM (SELECT unnest({D.terms('text')}) AS w FROM documents)")
def _(t: Tables):
    w = t.documents.select(F.explode(T.content_terms(c("text"))).alias("w")).distinct()
    return w.select("w", T.stem(c("w")).alias("stem"))


@query("t7_content_set", f"SELECT item_id, {D.joined(D.stems('text'))} AS stems FROM benchmark")
def _(t: Tables):
    return t.benchmark.select("item_id", line(T.content_set(c("text"))).alias("stems"))


_TURNS = f"a AS (SELECT conv_id, turn, {D.stems('text')} AS s FROM conversations)"


def turns(t: Tables):
    """Each turn's terms (a) with those of the next one (b)."""
    turn = lambda k, n: t.conversations.select("conv_id", (c("turn") - k).alias("turn"), T.content_set(c("text")).alias(n))
    return turn(0, "a").join(turn(1, "b"), ["conv_id", "turn"])


@query("t8_coverage", f"WITH {_TURNS} SELECT a.conv_id, a.turn, round({D.share('a.s', 'b.s')},6) AS coverage FROM a JOIN a b ON a.conv_id=b.conv_id AND b.turn=a.turn+1")
def _(t: Tables):
    return turns(t).select("conv_id", "turn", F.round(T.share_in(c("a"), c("b")), 6).alias("coverage"))


@query("t9_overlap_with_question", f"WITH {_TURNS} SELECT a.conv_id, a.turn, round({D.share('b.s', 'a.s')},6) AS overlap FROM a JOIN a b ON a.conv_id=b.conv_id AND b.turn=a.turn+1")
def _(t: Tables):
    return turns(t).select("conv_id", "turn", F.round(T.share_in(c("b"), c("a")), 6).alias("overlap"))


@query(
    "t10_missing_numbers",
    f"WITH d AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents) SELECT doc_id, array_to_string({D.numbers('text')},' ') AS numbers,"
    f" array_to_string(list_filter({D.numbers('text')}, lambda n: NOT list_contains({D.numbers('nxt')},n)),' ') AS missing FROM d WHERE len({D.numbers('text')})>0",
)
def _(t: Tables):
    from pyspark.sql import Window

    # Numbers are shuffled, not texts.
    d = t.documents.select("doc_id", "source", T.numbers(c("text")).alias("own")).withColumn("nxt", F.lead("own").over(Window.partitionBy("source").orderBy("doc_id")))
    lacking = F.filter("own", lambda x: ~F.array_contains(F.coalesce("nxt", F.array().cast("array<string>")), x))
    return d.filter(F.size("own") > 0).select("doc_id", F.array_join("own", " ").alias("numbers"), F.array_join(lacking, " ").alias("missing"))


@query("t11_mmss", "SELECT doc_id, CASE WHEN s//3600>0 THEN printf('%d:%02d:%02d', s//3600, (s%3600)//60, s%60) ELSE printf('%02d:%02d', s//60, s%60) END AS clock FROM (SELECT doc_id, n_chars*1500//1000 AS s FROM documents)")
def _(t: Tables):
    return t.documents.select("doc_id", T.mmss(c("n_chars") * 1500).alias("clock"))


@query("t16_name_tokens", f"SELECT s_suppkey, array_to_string(list_filter(regexp_extract_all(upper({D.fold('s_name')}),'[A-Z]+'), lambda x: length(x)>=3),' ') AS tokens, regexp_replace(upper({D.fold('s_name')}),'[^A-Z]','','g') AS compact FROM supplier")
def _(t: Tables):
    up = F.upper(T.fold(c("s_name")))
    return t.supplier.select("s_suppkey", F.array_join(F.filter(F.regexp_extract_all(up, F.lit("[A-Z]+"), F.lit(0)), lambda x: F.length(x) >= 3), " ").alias("tokens"), F.regexp_replace(up, "[^A-Z]", "").alias("compact"))


@query("t18_normal_name", f"SELECT c_custkey, regexp_replace(upper({D.fold('c_name')}),'[^A-Z0-9]','','g') AS name FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", T.normal_name(c("c_name")).alias("name"))


@query("t20_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, nxt) AS INT) AS d FROM (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part)")
def _(t: Tables):
    from pyspark.sql import Window

    nxt = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return t.part.withColumn("nxt", nxt).select("p_partkey", F.levenshtein("p_name", "nxt").alias("d"))


@query("t21_character_error", "WITH b AS (SELECT item_id, regexp_replace(text,'[^ -~]','','g') AS r, regexp_replace(lower(regexp_replace(text,'[^ -~]','','g')),'[aeiou]','','g') AS h FROM benchmark) SELECT item_id, round(CASE WHEN length(r)=0 THEN CASE WHEN length(h)=0 THEN 0 ELSE 1 END ELSE levenshtein(r,h)/length(r)::DOUBLE END,6) AS cer FROM b")
def _(t: Tables):
    text = F.regexp_replace("text", "[^ -~]", "")
    r, h = text, F.regexp_replace(F.lower(text), "[aeiou]", "")
    return t.benchmark.select("item_id", F.round(T.character_error(r, h), 6).alias("cer"))


@query(
    "t22_edit_confidence",
    f"WITH b AS (SELECT item_id, regexp_replace({D.fold('text')},'[^a-z0-9]','','g') AS a, regexp_replace({D.fold(chr(114)+'eplace(text,' + chr(39)+'th'+chr(39)+','+chr(39)+'t'+chr(39)+')')},'[^a-z0-9]','','g') AS z FROM benchmark)"
    " SELECT item_id, CASE WHEN length(a)=0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 0.9::DOUBLE - levenshtein(a,z)/greatest(length(a),length(z),1)::DOUBLE),5) END AS confidence FROM b",
)
def _(t: Tables):
    return t.benchmark.select("item_id", T.edit_confidence(F.lit(0.9), c("text"), F.replace(c("text"), F.lit("th"), F.lit("t"))).alias("confidence"))


@query("t23_tidy", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text,''),'[|~^_*#$%&<>]+',' ','g'),'[ \\t\\n\\r]+',' ','g'))) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(T.tidy(c("text"))).alias("h"))


@query("t24_date_parse", "SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day FROM orders")
def _(t: Tables):
    month = F.element_at(F.array(*map(F.lit, T.MONTHS)), F.month("o_orderdate"))
    said = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("Bogotá, "), F.dayofmonth("o_orderdate"), F.lit(" de "), month, F.lit(" de "), F.year("o_orderdate"))).otherwise(
        F.concat(F.lit("el "), F.dayofmonth("o_orderdate"), F.lit("/"), F.month("o_orderdate"), F.lit("/"), F.year("o_orderdate"), F.lit("."))
    )
    return t.orders.select("o_orderkey", T.spanish_date(said).cast("string").alias("day"))


@query("t25_document_date", "SELECT o_custkey, strftime(arg_max(d,(n,-first)),'%Y-%m-%d') AS day FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1,2) GROUP BY 1")
def _(t: Tables):
    from ..operators.joins import dominant

    days = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("d"))
    return dominant(days, ["o_custkey"], "d", "o_orderkey").select("o_custkey", c("value").alias("day"))


@query("t33_alias_dictionary", "SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'order' ELSE event_type END AS subtype FROM events")
def _(t: Tables):
    alias = t.spark.createDataFrame([("view", "read"), ("click", "read"), ("purchase", "order")], "event_type string, alias string")
    return t.events.join(F.broadcast(alias), "event_type", "left").select("event_id", F.coalesce("alias", "event_type").alias("subtype"))


@query("t34_number_validation", "SELECT doc_id, array_to_string(regexp_extract_all(text,'\\+?[0-9][0-9 ()-]{8,}[0-9]'),';') AS found FROM documents WHERE regexp_matches(text,'\\+?[0-9][0-9 ()-]{8,}[0-9]')")
def _(t: Tables):
    p = r"\+?[0-9][0-9 ()-]{8,}[0-9]"
    return t.documents.filter(c("text").rlike(p)).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), ";").alias("found"))


@query("t40_question_hash", f"SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace({D.fold('text')},'[^0-9a-z ]',' ','g'),' +',' ','g'))) AS h FROM conversations WHERE role='user'")
def _(t: Tables):
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", T.question_hash(c("text")).alias("h"))


@query("t41_idempotency_key", "SELECT event_id, sha256(concat_ws('|',user_id,event_type,CAST(CAST(ts AS DATE) AS VARCHAR))) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.sha2(F.concat_ws("|", c("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")), 256).alias("k"))


@query("t42_recency_weight", "SELECT event_id, round(pow(0.5, greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-01-20'),0)/90.0),6) AS w FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.round(T.recency_weight(F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts"))), 6).alias("w"))


@query("t43_cell_coercion", "SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS INT) AS k, TRY_CAST(event_type AS INT) AS bad FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), c("event_type").try_cast("int").alias("bad"))


@query("t44_dirty_json", "SELECT event_id, CASE WHEN event_id%3=0 THEN NULL ELSE CAST(json_extract_string(props,'$.k') AS INT) END AS k FROM events")
def _(t: Tables):
    dirty = F.when(c("event_id") % 3 == 0, F.concat(F.lit("{oops "), "props")).otherwise(c("props"))
    return t.events.select("event_id", F.from_json(dirty, "k int")["k"].alias("k"))


@query("t45_scalar_helpers", "SELECT c_custkey, CAST(nullif(regexp_replace(c_name,'[^0-9]','','g'),'') AS INT) AS num, round(c_acctbal,1) AS bal FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", F.nullif(F.regexp_replace("c_name", "[^0-9]", ""), F.lit("")).cast("int").alias("num"), F.round("c_acctbal", 1).alias("bal"))


@query("t47_token_estimate", "SELECT doc_id, CAST(greatest(1, length(coalesce(text,''))//4) AS INT) AS tokens FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.token_estimate(c("text")).alias("tokens"))


@query("t48_progress", "SELECT o_custkey, CAST(least(99, 100*count(*) FILTER (WHERE o_orderstatus='F')//count(*)) AS INT) AS progress FROM orders GROUP BY 1")
def _(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.count_if(c("o_orderstatus") == "F").alias("d"), F.count("*").alias("n"))
    return g.select("o_custkey", T.progress(c("d"), c("n")).alias("progress"))


@query("s10_html_to_text", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<(script|style)[^>]*>.*?</(script|style)>',' ','g'),'<[^>]+>',' ','g'),'[ \\t\\n\\r]+',' ','g'))) AS h FROM pages")
def _(t: Tables):
    from ..sources.files import plain_text

    return t.pages.select("page_id", F.md5(plain_text(c("html"))).alias("h"))


@query("z22_flag_removal", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE event_type NOT IN ('error','view'))),',') AS kept FROM events GROUP BY 1")
def _(t: Tables):
    packed = t.events.groupBy("user_id").agg(F.to_json(F.collect_set("event_type")).alias("flags"))
    return packed.select("user_id", F.array_join(F.array_sort(F.array_except(F.from_json("flags", "array<string>"), F.array(F.lit("error"), F.lit("view")))), ",").alias("kept"))


@query("z16_line_union", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS p FROM documents), d AS (SELECT doc_id, lower(line) AS k, min(p) AS p, arg_min(line,p) AS line FROM l WHERE trim(line)<>'' GROUP BY 1,2) SELECT doc_id, right(string_agg(line, chr(10) ORDER BY p), 200) AS summary FROM d GROUP BY 1")
def _(t: Tables):
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.trim("line") != "")
    d = l.groupBy("doc_id", F.lower("line").alias("k")).agg(F.min("p").alias("p"), F.min_by("line", "p").alias("line"))
    both = F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"])
    return d.groupBy("doc_id").agg(F.right(F.array_join(both, "\n"), F.lit(200)).alias("summary"))
