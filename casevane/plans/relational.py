"""Filters, joins, aggregates, windows, sorts and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins
from .registry import Tables, query

c = F.col


@query("f1_equality_in_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O','P') AND o_totalprice BETWEEN 1000 AND 50000")
def _(t: Tables):
    return t.orders.filter(c("o_orderstatus").isin("O", "P") & c("o_totalprice").between(1000, 50000)).select("o_orderkey", "o_orderstatus")


@query("f2_any_of_two_id_families", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (1,2,3,5,8) OR l_suppkey IN (1,4,9)")
def _(t: Tables):
    return t.lineitem.filter(c("l_partkey").isin(1, 2, 3, 5, 8) | c("l_suppkey").isin(1, 4, 9)).select("l_orderkey", "l_linenumber")


def optional(df, **wanted):
    """Predicates for the parameters that are given."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(c(name) == value)
    return df


@query("f3_optional_parameters", "SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def _(t: Tables):
    return optional(t.events, event_type="error", user_id=None).select("event_id", "event_type")


@query("f4_all_terms_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%and%'")
def _(t: Tables):
    return joins.all_terms(t.documents, "text", ["the", "and", "of"]).select("doc_id")


@query("f5_like_any", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%promo%' OR p_type ILIKE '%small%'")
def _(t: Tables):
    return t.part.filter(c("p_type").ilike("%promo%") | c("p_type").ilike("%small%")).select("p_partkey", "p_type")


@query("f6_word_regex", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\bthe\\b[^a-z]+\\bof\\b')")
def _(t: Tables):
    return t.documents.filter(F.lower("text").rlike(r"\bthe\b[^a-z]+\bof\b")).select("doc_id")


@query("f7_null_safe_equality", "SELECT count(*) AS n FROM documents a JOIN labels b ON a.doc_id = b.doc_id WHERE b.toxic IS NOT DISTINCT FROM b.quality")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id").filter(c("toxic").eqNullSafe(c("quality"))).agg(F.count("*").alias("n"))


@query("f8_null_safe_inequality", "SELECT count(*) AS n FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id WHERE b.toxic IS DISTINCT FROM 0")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").filter(~c("toxic").eqNullSafe(F.lit(0))).agg(F.count("*").alias("n"))


@query("f9_blank_aware_not_null", "SELECT conv_id, turn FROM conversations WHERE coalesce(trim(text),'') <> ''")
def _(t: Tables):
    return t.conversations.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("conv_id", "turn")


@query("f10_json_field_null_passes", "SELECT event_id FROM events WHERE json_extract_string(props,'$.mode') IS NULL AND CAST(json_extract_string(props,'$.k') AS INT) < 3")
def _(t: Tables):
    mode = F.get_json_object("props", "$.mode")
    return t.events.filter((mode.isNull() | (mode == "basico")) & (F.get_json_object("props", "$.k").cast("int") < 3)).select("event_id")


@query("f11_json_containment", "SELECT user_id, count(*) AS n FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) WHERE list_contains(kinds,'error') GROUP BY user_id")
def _(t: Tables):
    packed = t.events.groupBy("user_id").agg(F.to_json(F.collect_set("event_type")).alias("flags"))
    return packed.filter(F.array_contains(F.from_json("flags", "array<string>"), "error")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("f12_json_array_length", "SELECT conv_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 3")
def _(t: Tables):
    packed = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list("role")).alias("turns"))
    return packed.select("conv_id", F.json_array_length("turns").alias("n")).filter("n > 3")


@query("f13_literal_substring", "SELECT item_id, CAST(strpos(text, 'the') AS INT) AS at FROM benchmark WHERE strpos(text, 'the') > 0")
def _(t: Tables):
    return t.benchmark.select("item_id", F.instr("text", "the").alias("at")).filter("at > 0")


@query(
    "f14_composed_semi_predicates",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority LIKE '1%')",
)
def _(t: Tables):
    done = t.orders.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    urgent = t.orders.filter("o_orderpriority like '1%'").select(c("o_custkey").alias("c_custkey"))
    return t.customer.join(done, "c_custkey", "left_semi").join(urgent, "c_custkey", "left_semi").select("c_custkey")


@query("f15_effective_value", "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 'final' WHEN o_orderpriority LIKE '1%' THEN o_orderpriority ELSE 'base' END AS value FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", "final").when(c("o_orderpriority").like("1%"), c("o_orderpriority")).otherwise("base").alias("value"))


@query("f16_snippet", "SELECT doc_id, left(text, 80) AS snippet FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.left("text", F.lit(80)).alias("snippet"))


@query("f18_placeholder_names", "SELECT r_name FROM region WHERE NOT regexp_matches(lower(r_name), '^(asia|n/?a|desconocid[oa]|sin nombre)$')")
def _(t: Tables):
    return t.region.filter(~F.lower("r_name").rlike("^(asia|n/?a|desconocid[oa]|sin nombre)$")).select("r_name")


@query("f19_sentinel_dates", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (DATE '1992-01-01', DATE '1970-01-01') AND year(o_orderdate) BETWEEN 1993 AND 1997")
def _(t: Tables):
    day = F.to_date("o_orderdate")
    return t.orders.filter(~day.isin(F.lit("1992-01-01").cast("date"), F.lit("1970-01-01").cast("date")) & F.year("o_orderdate").between(1993, 1997)).select("o_orderkey")


@query(
    "f20_document_mention",
    "SELECT p_partkey FROM part WHERE length(regexp_replace(lower(p_name),'[^0-9a-z]','','g')) >= 5 AND strpos('whereisthesmallringorthebluebolt', regexp_replace(lower(p_name),'[^0-9a-z]','','g')) > 0 ORDER BY p_partkey LIMIT 3",
)
def _(t: Tables):
    name = F.regexp_replace(F.lower("p_name"), "[^0-9a-z]", "")
    return t.part.filter((F.length(name) >= 5) & F.lit("whereisthesmallringorthebluebolt").contains(name)).select("p_partkey").orderBy("p_partkey").limit(3)


@query(
    "j1_inner_chain",
    "SELECT n_name, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA' GROUP BY n_name",
)
def _(t: Tables):
    n = t.nation.join(t.region.filter("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(n, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "j2_left_coalesced_sides",
    "SELECT n_nationkey, coalesce(s.name, c.name, 'none') AS name FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS name FROM supplier GROUP BY 1) s ON s_nationkey=n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_name) AS name FROM customer GROUP BY 1) c ON c_nationkey=n_nationkey",
)
def _(t: Tables):
    s = t.supplier.groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("a"))
    k = t.customer.groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("b"))
    return t.nation.join(s, "n_nationkey", "left").join(k, "n_nationkey", "left").select("n_nationkey", F.coalesce("a", "b", F.lit("none")).alias("name"))


@query(
    "j3_polymorphic_left_joins",
    "SELECT l_orderkey, l_linenumber, o_orderstatus, p_brand, s_name, c_mktsegment, n_name FROM lineitem LEFT JOIN orders ON l_orderkey=o_orderkey LEFT JOIN part ON l_partkey=p_partkey LEFT JOIN supplier ON l_suppkey=s_suppkey LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey",
)
def _(t: Tables):
    x = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"), "left").join(t.part, c("l_partkey") == c("p_partkey"), "left")
    x = x.join(t.supplier, c("l_suppkey") == c("s_suppkey"), "left").join(t.customer, c("o_custkey") == c("c_custkey"), "left").join(t.nation, c("c_nationkey") == c("n_nationkey"), "left")
    return x.select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "s_name", "c_mktsegment", "n_name")


@query("j4_composite_key", "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1")
def _(t: Tables):
    after = t.conversations.select("conv_id", (c("turn") - 1).alias("turn"), c("role").alias("next_role"))
    return t.conversations.join(after, ["conv_id", "turn"]).select("conv_id", "turn", "next_role")


@query("j5_self_join", "SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey")
def _(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("source"), c("b.n_name").alias("target"))


@query(
    "j6_pair_join",
    "SELECT o_orderkey, x.p_name AS first_part, y.p_name AS second_part FROM orders JOIN lineitem a ON a.l_orderkey=o_orderkey AND a.l_linenumber=1 JOIN lineitem b ON b.l_orderkey=o_orderkey AND b.l_linenumber=2 JOIN part x ON x.p_partkey=a.l_partkey JOIN part y ON y.p_partkey=b.l_partkey",
)
def _(t: Tables):
    side = lambda k, name: t.lineitem.filter(c("l_linenumber") == k).join(t.part, c("l_partkey") == c("p_partkey")).select(c("l_orderkey").alias("o_orderkey"), c("p_name").alias(name))
    return t.orders.select("o_orderkey").join(side(1, "first_part"), "o_orderkey").join(side(2, "second_part"), "o_orderkey")


@query("j7_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT' AND o_orderstatus='F')")
def _(t: Tables):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query(
    "j8_semi_any_of",
    "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag='R' AND l_discount>0.09) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity>49)",
)
def _(t: Tables):
    hits = t.lineitem.filter(((c("l_returnflag") == "R") & (c("l_discount") > 0.09)) | (c("l_quantity") > 49)).select(c("l_partkey").alias("p_partkey"))
    return t.part.join(hits, "p_partkey", "left_semi").select("p_partkey")


@query("j9_lateral_top1", "SELECT c_custkey, o.o_orderkey AS last_order FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey=c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true")
def _(t: Tables):
    last = joins.top_one(t.orders, ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])
    return t.customer.join(last, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", c("top").alias("last_order"))


@query(
    "j10_as_of_backward",
    "SELECT a.conv_id, a.turn, (SELECT max(q.turn) FROM conversations q WHERE q.conv_id=a.conv_id AND q.role='user' AND q.turn<=a.turn) AS question_turn FROM conversations a WHERE a.role='assistant'",
)
def _(t: Tables):
    return joins.as_of_last(t.conversations, ["conv_id"], "turn", c("role") == "user", c("turn"), "question_turn").filter("role = 'assistant'").select("conv_id", "turn", "question_turn")


@query(
    "j11_as_of_by_type",
    "SELECT e.event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id=e.user_id AND p.event_type IN ('view','click') AND p.ts<=e.ts AND p.event_id<>e.event_id) AS responds_to FROM events e WHERE e.event_type='purchase'",
)
def _(t: Tables):
    return joins.as_of_by_type(t.events, ["user_id"], "ts", "event_id", "event_type", {"purchase": ["view", "click"]}).select("event_id", c("target").alias("responds_to"))


@query("j16_folded_text_join", "SELECT a.x AS claim, count(*) AS facts FROM (SELECT DISTINCT ' ' || upper(p_name) AS x FROM part) a JOIN part b ON lower(trim(a.x)) = lower(trim(b.p_name)) GROUP BY 1")
def _(t: Tables):
    k = lambda x: F.lower(F.trim(x)).alias("k")
    claims = t.part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("claim")).distinct().select("claim", k(c("claim")))
    return claims.join(t.part.select(k(c("p_name"))), "k").groupBy("claim").agg(F.count("*").alias("facts"))


@query("j20_array_membership", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT unnest([1,2,3,4,5,6,7,32,33]))")
def _(t: Tables):
    ids = t.spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 32, 33],)], "ids array<long>").select(F.explode("ids").alias("o_orderkey"))
    return t.orders.join(ids, "o_orderkey", "left_semi").select("o_orderkey")


@query("j21_ordinal_array_join", "SELECT u.pos AS pos, n_name FROM (SELECT unnest([7,3,9]) AS k, unnest([1,2,3]) AS pos) u JOIN nation ON n_nationkey=u.k")
def _(t: Tables):
    ids = t.spark.createDataFrame([([7, 3, 9],)], "ids array<int>").select(F.posexplode("ids").alias("p", "n_nationkey")).select((c("p") + 1).alias("pos"), "n_nationkey")
    return ids.join(t.nation, "n_nationkey").select("pos", "n_name")


@query("j22_scalar_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def _(t: Tables):
    return t.supplier.join(t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j23_update_from", "SELECT c_custkey, coalesce(x.first_day, 'none') AS first_day FROM customer LEFT JOIN (SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day FROM orders GROUP BY 1) x ON o_custkey=c_custkey")
def _(t: Tables):
    first = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).cast("string").alias("d"))
    return t.customer.join(first, "c_custkey", "left").select("c_custkey", F.coalesce("d", F.lit("none")).alias("first_day"))


@query(
    "j24_upsert",
    "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY src DESC) AS rn FROM (SELECT c_custkey AS k, c_mktsegment AS v, 0 AS src FROM customer UNION ALL SELECT s_suppkey*20 AS k, s_name AS v, 1 AS src FROM supplier)) WHERE rn=1",
)
def _(t: Tables):
    return joins.upsert(t.customer.select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v")), t.supplier.select((c("s_suppkey") * 20).alias("k"), c("s_name").alias("v")), ["k"])


@query("j25_inline_relation", "SELECT r_name, v.role AS role FROM region CROSS JOIN (VALUES ('actor'),('demandado'),('tercero')) v(role)")
def _(t: Tables):
    return t.region.withColumn("role", F.explode(F.array(*map(F.lit, ("actor", "demandado", "tercero"))))).select("r_name", "role")


@query("a1_basic_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity),2) AS qty, round(avg(l_extendedprice),4) AS price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1,2")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"))


@query("a2_filtered_aggregate", "SELECT user_id, count(*) FILTER (WHERE event_type='error') AS errors, count(*) FILTER (WHERE value>50) AS large FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.count_if(c("event_type") == "error").alias("errors"), F.count_if(c("value") > 50).alias("large"))


@query("a3_having_bool_or", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>5 AND bool_or(o_orderstatus='P')")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(c("o_orderstatus") == "P").alias("p")).filter("n > 5 and p").select("o_custkey", "n")


@query("a4_flag_by_max", "SELECT user_id, max(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS bought FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.when(c("event_type") == "purchase", 1).otherwise(0)).alias("bought"))


@query("a5_first_by_order", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(c("o_orderdate").isNull(), "o_orderdate", "o_orderkey")).alias("first_order"))


@query("a6_collect", "SELECT conv_id, array_to_string(list(role ORDER BY turn),',') AS roles FROM conversations GROUP BY 1")
def _(t: Tables):
    got = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(got, lambda x: x["role"]), ",").alias("roles"))


@query("a7_quoted_string_agg", "SELECT r_regionkey, string_agg('''' || n_name || '''', ' | ' ORDER BY n_name) AS q FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def _(t: Tables):
    return t.nation.groupBy(c("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), "n_name", F.lit("'")))), " | ").alias("q"))


@query("a8_dominant_value", "SELECT user_id, arg_max(event_type, (n, -first)) AS kind FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1,2) GROUP BY 1")
def _(t: Tables):
    return joins.dominant(t.events, ["user_id"], "event_type", "event_id").select("user_id", c("value").alias("kind"))


@query("a9_majority_vote", "SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY 1,2) WHERE n >= 0.3*total")
def _(t: Tables):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(W.partitionBy("user_id"))).filter("n >= 0.3 * total").select("user_id", "event_type")


@query(
    "a10_dominance_filter",
    "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1,2), u AS (SELECT user_id, sum(n) AS total FROM g GROUP BY 1), s AS (SELECT user_id, max(ts)-min(ts) >= INTERVAL 10 MINUTE AS wide FROM events GROUP BY 1) SELECT g.user_id, g.event_type FROM g JOIN u USING(user_id) JOIN s USING(user_id) WHERE NOT (wide AND n > 0.25*total)",
)
def _(t: Tables):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    w = W.partitionBy("user_id")
    g = g.withColumn("total", F.sum("n").over(w)).withColumn("wide", F.max("b").over(w) - F.min("a").over(w) >= F.expr("interval 10 minutes"))
    return g.filter(~(c("wide") & (c("n") > 0.25 * c("total")))).select("user_id", "event_type")


@query("a12_weighted_mean", "SELECT l_suppkey, round(sum(l_discount*l_quantity)/sum(l_quantity),6) AS mean FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(c("l_discount") * c("l_quantity")) / F.sum("l_quantity"), 6).alias("mean"))


@query(
    "a13_recursive_rollup",
    "SELECT r_name AS folder, (SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=r_regionkey) AS n FROM region UNION ALL SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) FROM nation UNION ALL SELECT 'root', (SELECT count(*) FROM customer)",
)
def _(t: Tables):
    tree = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent"), c("r_name").alias("name"))
    tree = tree.union(t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name"))
    tree = tree.union(t.spark.createDataFrame([("root", None, "root")], "id string, parent string, name string"))
    leaves = t.customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("id")).agg(F.count("*").alias("n"))
    return joins.rollup_tree(tree, leaves).select(c("name").alias("folder"), "n")


@query("a14_guarded_rate", "SELECT event_type, round(count(*) FILTER (WHERE value>90)/nullif(count(*),0),6) AS rate FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.try_divide(F.count_if(c("value") > 90), F.count("*")), 6).alias("rate"))


@query("a15_threshold_ladder", "SELECT o_custkey, CASE WHEN s>=1000000 THEN 100 WHEN s>=900000 THEN 90 WHEN s>=800000 THEN 80 ELSE 0 END AS level FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)")
def _(t: Tables):
    s = c("s")
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).select("o_custkey", F.when(s >= 1000000, 100).when(s >= 900000, 90).when(s >= 800000, 80).otherwise(0).alias("level"))


@query("a16_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("a17_percentiles", "SELECT event_type, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95 FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query(
    "a22_version_fingerprint",
    "SELECT sha256(concat_ws('|', (SELECT count(*) FROM documents), (SELECT max(doc_id) FROM documents), (SELECT count(*) FROM pages), (SELECT count(*) FROM labels), (SELECT count(*) FROM benchmark), (SELECT count(*) FROM conversations), (SELECT max(conv_id) FROM conversations), (SELECT count(*) FROM embeddings))) AS version",
)
def _(t: Tables):
    one = lambda df, e, i: df.agg(e.cast("string").alias("v")).select(F.lit(i).alias("i"), "v")
    n = F.count("*")
    parts = [(t.documents, n), (t.documents, F.max("doc_id")), (t.pages, n), (t.labels, n), (t.benchmark, n), (t.conversations, n), (t.conversations, F.max("conv_id")), (t.embeddings, n)]
    rows = [one(df, e, i) for i, (df, e) in enumerate(parts)]
    u = rows[0]
    for r in rows[1:]:
        u = u.union(r)
    return u.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]), "|"), 256).alias("version"))


@query("a23_inventory_density", "SELECT doc_id, CAST(len(regexp_extract_all(text,'[0-9]{5,}')) AS INT) AS n FROM documents WHERE len(regexp_extract_all(text,'[0-9]{5,}')) > 0")
def _(t: Tables):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[0-9]{5,}")).alias("n")).filter("n > 0")


@query("a24_count_and_first", "SELECT role, count(*) AS n, min(turn) AS first_turn FROM conversations GROUP BY 1")
def _(t: Tables):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("w1_stable_ordinal", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders")
def _(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("ord"))


@query("w2_lag_window", "SELECT conv_id, turn, lag(role) OVER w AS before, lag(role,2) OVER w AS before2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t: Tables):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lag("role", 2).over(w).alias("before2"))


@query("w3_gap_predicate", "SELECT event_id FROM (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap <= INTERVAL 10 MINUTE")
def _(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", (c("ts") - F.lag("ts").over(w)).alias("gap")).filter(c("gap") <= F.expr("interval 10 minutes")).select("event_id")


@query("w4_dense_code", "SELECT event_id, printf('EV-%04d', row_number() OVER (PARTITION BY user_id ORDER BY event_type, CAST(ts AS DATE) NULLS LAST, event_id)) AS code FROM events")
def _(t: Tables):
    w = W.partitionBy("user_id").orderBy("event_type", F.to_date("ts").asc_nulls_last(), "event_id")
    return t.events.select("event_id", F.format_string("EV-%04d", F.row_number().over(w)).alias("code"))


@query("w5_consecutive_pairs", "SELECT * FROM (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL")
def _(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(c("event_id").alias("source"), F.lead("event_id").over(w).alias("target")).filter("target is not null")


@query("w6_newest_page_ascending", "SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 10) ORDER BY ts, event_id")
def _(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).offset(10).limit(25).orderBy("ts", "event_id").select("event_id")


@query("w7_newest_per_user", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def _(t: Tables):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("user_id", "event_id")


@query("w8_best_per_key", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity, l_linenumber) AS rn FROM lineitem) WHERE rn=1")
def _(t: Tables):
    best = F.max_by("l_linenumber", F.struct("l_extendedprice", -c("l_quantity"), -c("l_linenumber")))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("l_linenumber"))


@query("o3_nulls_last", "SELECT conv_id, turn, before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) ORDER BY before NULLS LAST, conv_id LIMIT 20")
def _(t: Tables):
    x = t.conversations.select("conv_id", "turn", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))
    return x.orderBy(c("before").asc_nulls_last(), "conv_id").limit(20)


@query("o4_boolean_first", "SELECT o_orderkey FROM orders ORDER BY (o_orderstatus='P') DESC, o_orderkey LIMIT 15")
def _(t: Tables):
    return t.orders.orderBy((c("o_orderstatus") == "P").desc(), "o_orderkey").limit(15).select("o_orderkey")


@query("o5_case_priority", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 15")
def _(t: Tables):
    rank = F.when(c("o_orderstatus") == "P", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey")


@query("o7_paging", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def _(t: Tables):
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20).select("doc_id")


@query("o8_padded_union", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, NULL::INT AS size FROM customer UNION ALL SELECT 'part', p_partkey, p_name, p_size FROM part")
def _(t: Tables):
    a = t.customer.select(F.lit("customer").alias("kind"), c("c_custkey").alias("id"), c("c_name").alias("name"), F.lit(None).cast("int").alias("size"))
    return a.unionByName(t.part.select(F.lit("part").alias("kind"), c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_size").alias("size")))


@query("o9_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("o10_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t: Tables):
    return t.documents.select("lang", "source").distinct()


@query("o11_ordered_dedupe", "SELECT conv_id, array_to_string(list(role ORDER BY first),',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1,2) GROUP BY 1")
def _(t: Tables):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


@query("o12_scope_union", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING' UNION SELECT c_custkey FROM customer WHERE c_acctbal<0)")
def _(t: Tables):
    ids = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey").union(t.customer.filter("c_acctbal < 0").select("c_custkey")).distinct()
    return t.orders.join(ids, c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")


@query("x_extra_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag),(l_linestatus),())")
def _(t: Tables):
    flag, status = c("l_returnflag"), c("l_linestatus")
    return t.lineitem.groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n")).select("l_returnflag", "l_linestatus", "n")


@query("x_extra_full_outer", "SELECT coalesce(a.k,b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal<-900 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal>8000 GROUP BY 1) b ON a.k=b.k")
def _(t: Tables):
    a = t.customer.filter("c_acctbal < -900").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(t.supplier.filter("s_acctbal > 8000").groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full")


@query("x_extra_intersect_except", "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal<0 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey=0")
def _(t: Tables):
    both = t.customer.filter("c_acctbal < 0").select(c("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))
    return both.exceptAll(t.nation.filter("n_regionkey = 0").select("n_nationkey"))
