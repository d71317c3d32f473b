"""Evaluation, claim checks, integrity, operations and small API reads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import integrity as I  # noqa: E741
from ..operators import search, voices
from ..operators.common import spread
from . import duck as D
from .registry import Tables, query

c = F.col
GUESS = "g AS (SELECT doc_id, toxic AS truth, CASE WHEN regexp_matches(lower(text),'(loser|idiot|moron|scum|trash)') THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING(doc_id))"


def guesses(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", c("toxic").alias("truth"), F.when(F.lower("text").rlike("(loser|idiot|moron|scum|trash)"), 1).otherwise(0).alias("guess"))


@query("a18_confusion", f"WITH {GUESS} SELECT truth, guess, count(*) AS n FROM g GROUP BY 1,2")
def _(t: Tables):
    return E.confusion(guesses(t), "truth", "guess")


@query("a18_precision_recall_f1", f"WITH {GUESS}, l AS (SELECT DISTINCT truth AS label FROM g), m AS (SELECT label, count(*) FILTER (WHERE truth=label) AS support, count(*) FILTER (WHERE guess=label) AS said, count(*) FILTER (WHERE truth=label AND guess=label) AS tp FROM l,g GROUP BY 1) SELECT label, round(coalesce(tp/nullif(said,0)::DOUBLE,0),6) AS precision, round(tp/support::DOUBLE,6) AS recall, round(coalesce(2*tp/(said+support)::DOUBLE,0),6) AS f1, support FROM m")
def _(t: Tables):
    return E.per_label(guesses(t), "truth", "guess")


@query("a19_kappa", f"WITH {GUESS}, m AS (SELECT avg((truth=guess)::INT) AS po, avg(truth) AS x, avg(guess) AS y FROM g) SELECT round((po-(x*y+(1-x)*(1-y)))/(1-(x*y+(1-x)*(1-y))),6) AS kappa FROM m")
def _(t: Tables):
    return E.kappa(guesses(t), "truth", "guess")


@query("a20_threshold_sweep", "WITH s AS (SELECT quality AS y, floor(least(1.0::DOUBLE, n_chars/4000.0::DOUBLE)*100+1e-9::DOUBLE) AS b FROM documents JOIN labels USING(doc_id)), t AS (SELECT unnest(range(10,81)) AS t), f AS (SELECT t, sum(y) FILTER (WHERE b>=t) AS tp, count(*) FILTER (WHERE b>=t) AS said, sum(y) AS a FROM s,t GROUP BY 1), r AS (SELECT t/100.0::DOUBLE AS threshold, round(coalesce(2*coalesce(tp,0)/(said+a)::DOUBLE,0),6) AS f1 FROM f) SELECT threshold, f1 FROM r ORDER BY f1 DESC, round(abs(threshold-0.34),6), threshold LIMIT 1")
def _(t: Tables):
    x = t.documents.join(t.labels, "doc_id").select(c("quality").alias("y"), F.least(F.lit(1.0), c("n_chars") / 4000.0).alias("s"))
    return E.sweep(x, "s", "y")


@query("a21_panel_majority", "SELECT user_id, CASE WHEN 2*count(*) FILTER (WHERE value>50)>count(*) THEN 1 ELSE 0 END AS verdict FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.when(2 * F.count_if(c("value") > 50) > F.count("*"), 1).otherwise(0).alias("verdict"))


KNN = "n AS (SELECT a.vec_id AS query_id, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),9) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),9) DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id%100=0 AND a.vec_id<>b.vec_id), v AS (SELECT query_id, label, round(sum(s),9) AS score FROM n WHERE rn<=12 AND s>=0.1 GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS p, coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, label),0) AS second FROM v)"


def knn(t: Tables):
    q = t.embeddings.filter(c("vec_id") % 100 == 0).select(c("vec_id").alias("query_id"), "embedding")
    near = search.vector_top_k(t.embeddings, q, 13).filter("query_id <> vec_id")
    near = near.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter("rn <= 12 and score >= 0.1")
    return E.vote(near.drop("score").join(near.select("query_id", "vec_id", "score"), ["query_id", "vec_id"]).join(t.embeddings.select("vec_id", "label"), "vec_id"), "query_id", "label", c("score"))


@query("k4_knn_vote", f"WITH {KNN} SELECT query_id, label, score FROM r WHERE p=1")
def _(t: Tables):
    return knn(t).select("query_id", "label", "score")


@query("k5_vote_gate", f"WITH {KNN} SELECT query_id, CASE WHEN (score-second)/score>=0.15 THEN label ELSE -1 END AS label FROM r WHERE p=1")
def _(t: Tables):
    return knn(t).select("query_id", F.when(c("margin") >= 0.15, c("label")).otherwise(-1).alias("label"))


#: A user's questions: documents with a vector, by source.  Rules answer with the user's most frequent label; good documents weigh more.
_ASKED = (
    "asked AS (SELECT source AS user_id, vec_id AS id, md5(text) AS hash, e.embedding::DOUBLE[] AS v, label AS truth, CASE WHEN l.quality=1 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM embeddings e JOIN documents d ON d.doc_id=e.vec_id LEFT JOIN labels l ON l.doc_id=e.vec_id),"
    " freq AS (SELECT user_id, truth, count(*) AS n FROM asked GROUP BY 1,2), rule AS (SELECT user_id, arg_max(truth, (n, -truth)) AS rule FROM freq GROUP BY 1)"
)


def asked_questions(t: Tables):
    x = t.embeddings.join(t.documents.select(c("doc_id").alias("vec_id"), "source", F.md5("text").alias("hash")), "vec_id").join(t.labels.select(c("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    x = x.select(c("source").alias("user_id"), c("vec_id").alias("id"), "hash", c("embedding").alias("vector"), c("label").alias("truth"), F.when(c("quality") == 1, 1.0).otherwise(0.4).alias("weight"))
    freq = x.groupBy("user_id", "truth").agg(F.count("*").alias("n"))
    return x.join(freq.groupBy("user_id").agg(F.max_by("truth", F.struct("n", -c("truth"))).alias("rule")), "user_id")


def profile_answers(t: Tables):
    x = asked_questions(t)
    known = x.select("user_id", "hash", "vector", c("truth").alias("label"), "weight", c("id").alias("made_at"))
    return voices.without_itself(x.withColumn("guarded", c("hash").startswith("0")), known, user="user_id", least=0.2)


@query(
    "k9_leave_one_out",  # neighbours from 0.2 on: no two vectors of these tables are as near as the usual 0.55
    f"WITH {_ASKED}, ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC, hash, truth) AS rn FROM asked) WHERE rn<=200),"
    " n AS (SELECT a.user_id, a.id, a.hash, a.truth, e.truth AS label, e.weight, round(list_cosine_similarity(a.v,e.v),9) AS s, row_number() OVER (PARTITION BY a.user_id, a.id ORDER BY round(list_cosine_similarity(a.v,e.v),9) DESC, e.hash, e.truth::VARCHAR) AS k FROM asked a JOIN ex e ON e.user_id=a.user_id AND e.hash<>a.hash),"
    " v AS (SELECT user_id, id, label, round(sum(s*weight),9) AS score, count(*) AS used FROM n WHERE k<=12 AND s>=0.2 GROUP BY ALL),"
    " b AS (SELECT *, sum(used) OVER (PARTITION BY user_id, id) AS all_used, row_number() OVER o AS p, coalesce(lead(score) OVER o,0) AS second FROM v WINDOW o AS (PARTITION BY user_id, id ORDER BY score DESC, label::VARCHAR)),"
    " w AS (SELECT user_id, id, label FROM b WHERE p=1 AND all_used>=2 AND round((score-second)/score,4)>=0.15),"
    " f AS (SELECT a.user_id, a.truth, r.rule, CASE WHEN a.hash LIKE '0%' THEN r.rule ELSE coalesce(w.label, r.rule) END AS said FROM asked a JOIN rule r USING(user_id) LEFT JOIN w ON w.user_id=a.user_id AND w.id=a.id)"
    " SELECT user_id, count(*) AS judged, round(avg((rule=truth)::INT),4) AS rules_accuracy, round(avg((said=truth)::INT),4) AS profile_accuracy, count(*) FILTER (WHERE rule=0 AND truth<>0) AS fp_rules, count(*) FILTER (WHERE said=0 AND truth<>0) AS fp_profile FROM f GROUP BY 1",
)
def _(t: Tables):
    return voices.profile_metrics(profile_answers(t), "0", "user_id")


@query("c9_speaker_clusters")
def _(t: Tables):
    """Vectors as voices of recordings (sources); good documents are named by their language."""
    x = t.embeddings.select(c("vec_id").alias("doc_id"), "embedding").join(t.documents.select("doc_id", "source", "lang"), "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    x = x.select(c("source").alias("recording"), "doc_id", c("embedding").alias("vector"), F.when(c("quality") == 1, c("lang")).alias("name"))
    return voices.speakers(x, 0.75, group="recording", key="doc_id")


@query("c9_voices_without_names")
def _(t: Tables):
    x = t.embeddings.select(c("vec_id").alias("doc_id"), c("embedding").alias("vector")).join(t.documents.select("doc_id", c("source").alias("recording")), "doc_id")
    return voices.average_linkage(x, 0.7, group="recording", key="doc_id")


@query("k7_latest_verdict", "SELECT user_id, arg_max(event_type,(ts,event_id)) AS verdict FROM events GROUP BY 1 HAVING arg_max(event_type,(ts,event_id))<>'error'")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict")).filter("verdict <> 'error'")


@query("k8_counterfactual_pairs", "SELECT source, target FROM (SELECT lag(event_id) OVER w AS source, event_id AS target, event_type, lag(event_type) OVER w AS pt, ts-lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pt='error' AND event_type<>'error' AND gap<=INTERVAL 10 HOUR")
def _(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.select(F.lag("event_id").over(w).alias("source"), c("event_id").alias("target"), "event_type", F.lag("event_type").over(w).alias("pt"), (c("ts") - F.lag("ts").over(w)).alias("gap"))
    return x.filter((c("pt") == "error") & (c("event_type") != "error") & (c("gap") <= F.expr("interval 10 hours"))).select("source", "target")


@query("k10_retention", "SELECT event_id FROM events e WHERE ts >= TIMESTAMP '2024-01-20' OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id=e.user_id AND x.event_type='signup')")
def _(t: Tables):
    keep = t.events.filter("ts >= timestamp_ntz'2024-01-20 00:00:00'").select("event_id")
    return keep.union(t.events.filter("ts < timestamp_ntz'2024-01-20 00:00:00'").join(t.events.filter("event_type = 'signup'").select("user_id"), "user_id", "left_anti").select("event_id"))


FOUND = f"b AS (SELECT item_id, {D.fold('text')} AS head FROM benchmark), d AS (SELECT doc_id, {D.fold('text')} AS x FROM documents)"


def passages_found(t: Tables):
    """``item_id, doc_id``: documents that hold a passage of the benchmark whole, letters folded."""
    # Blocked on the first three words of the passage, then contained whole.
    head = T.fold(c("text"))
    words = lambda x: F.filter(F.split(x, "[^0-9a-z]+"), lambda w: F.length(w) > 0)
    first = lambda a: F.array_join(F.slice(a, 1, 3), " ")
    b = t.benchmark.select("item_id", head.alias("head"), first(words(head)).alias("k"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.array_join(F.slice(c("w"), i, 3), " "))
    # The first word of a passage may begin inside a word of the document, so its own first word is left out there.
    d = spread(t.documents.select("doc_id", "text")).select("doc_id", words(T.fold(c("text"))).alias("w")).select("doc_id", F.explode(F.array_distinct(grams)).alias("k"))
    met = d.join(b.select("item_id", "k"), "k").select("item_id", "doc_id").distinct()  # ids only; few pairs
    return met.join(t.documents.select("doc_id", "text"), "doc_id").join(b.select("item_id", "head"), "item_id").filter(T.fold(c("text")).contains(c("head"))).select("item_id", "doc_id")


@query("k11_retrieval_recall", f"WITH {FOUND} SELECT item_id, count(doc_id) AS found FROM b LEFT JOIN d ON contains(x, head) GROUP BY 1")
def _(t: Tables):
    return t.benchmark.select("item_id").join(passages_found(t), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("found"))


@query("k13_embedding_probe", "WITH p AS (SELECT a.label=b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id%100=0 AND a.vec_id<>b.vec_id) SELECT round(avg(s) FILTER (WHERE same),6) AS same, round(avg(s) FILTER (WHERE NOT same),6) AS different FROM p")
def _(t: Tables):
    # A mean of cosines to unit vectors is a cosine to their mean: one vector per label instead of pairs.
    pos = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", c("x").cast("double"))
    norm = pos.groupBy("vec_id").agg(F.sqrt(F.sum(c("x") * c("x"))).alias("norm"))
    unit = pos.join(norm, "vec_id").withColumn("x", c("x") / c("norm"))
    sums, sizes = unit.groupBy("label", "i").agg(F.sum("x").alias("sx")), t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    q = unit.filter(c("vec_id") % 100 == 0).select("vec_id", c("label").alias("ql"), "i", c("x").alias("qx"))
    dots = q.join(sums, "i").groupBy("vec_id", "ql", "label").agg(F.sum(c("qx") * c("sx")).alias("dot")).join(sizes, "label")
    own = c("ql") == c("label")
    agg = dots.agg(F.sum(F.when(own, c("dot") - 1)).alias("a"), F.sum(F.when(own, c("n") - 1)).alias("b"), F.sum(F.when(~own, c("dot"))).alias("d"), F.sum(F.when(~own, c("n"))).alias("e"))
    return agg.select(F.round(c("a") / c("b"), 6).alias("same"), F.round(c("d") / c("e"), 6).alias("different"))


PAIR = f"p AS (SELECT a.conv_id, {D.stems('a.text')} AS s, {D.stems('b.text')} AS e, a.turn FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1)"


@query("v1_grounding_ratio", f"WITH {PAIR} SELECT conv_id, turn, round({D.share('s', 'e')},6) AS ratio FROM p")
def grounding(t: Tables):
    a = t.conversations.select("conv_id", "turn", T.content_set(c("text")).alias("s"))
    b = t.conversations.select("conv_id", (c("turn") - 1).alias("turn"), T.content_set(c("text")).alias("e"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.share_in(c("s"), c("e")), 6).alias("ratio"))


@query("v2_claim_triage", f"WITH {PAIR}, x AS (SELECT conv_id, turn, round({D.share('s', 'e')},6) AS r FROM p) SELECT conv_id, turn, CASE WHEN turn=0 THEN 'invalid_citation' WHEN r>=0.34 THEN 'supported' WHEN r>=0.20 THEN 'review' ELSE 'unsupported' END AS status FROM x")
def _(t: Tables):
    return grounding(t).select("conv_id", "turn", E.triage(c("turn") != 0, c("ratio")).alias("status"))


@query("v9_proof_derivation", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus='F') THEN 'PROVEN' WHEN bool_or(o_orderpriority='1-URGENT') THEN 'ADMITTED' WHEN count(DISTINCT o_orderstatus)>1 THEN 'DISPUTED' WHEN count(*)>5 THEN 'SUPPORTED' ELSE 'ALLEGED' END AS proof FROM orders GROUP BY 1")
def _(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.bool_or(c("o_orderstatus") == "F").alias("a"), F.bool_or(c("o_orderpriority") == "1-URGENT").alias("b"), F.countDistinct("o_orderstatus").alias("d"), F.count("*").alias("n"))
    return g.select("o_custkey", F.when(c("a"), "PROVEN").when(c("b"), "ADMITTED").when(c("d") > 1, "DISPUTED").when(c("n") > 5, "SUPPORTED").otherwise("ALLEGED").alias("proof"))


@query("v10_fact_ledger", "SELECT c_custkey, count(DISTINCT o_orderkey) AS positions, count(l_linenumber) AS evidence FROM customer LEFT JOIN orders ON o_custkey=c_custkey LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1")
def _(t: Tables):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t.orders.join(per, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("p"), F.sum("n").alias("e"))
    return t.customer.join(o, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit(0)).alias("positions"), F.coalesce("e", F.lit(0)).alias("evidence"))


@query("v12_position_backfill", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'ACTOR' ELSE 'TERCERO' END AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')")
def _(t: Tables):
    rest = t.orders.join(t.lineitem.filter("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return rest.select("o_orderkey", F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "ACTOR").otherwise("TERCERO").alias("side"))


@query("v13_quality_diagnostics", "SELECT source, count(*) AS n, round(avg(quality),6) AS mean_quality, count(*) FILTER (WHERE toxic=1) AS review FROM documents JOIN labels USING(doc_id) GROUP BY 1")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.count_if(c("toxic") == 1).alias("review"))


@query("v14_reprocess_plan", "SELECT source, doc_id//100 AS part, 'other' AS target, array_to_string(list(doc_id ORDER BY doc_id),',') AS pages FROM documents JOIN labels USING(doc_id) WHERE quality=0 GROUP BY 1,2")
def _(t: Tables):
    # A request lists the pages of a hundred ids at most, so no list grows with its source.
    ids = F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")
    low = t.documents.select("doc_id", "source").join(t.labels.filter("quality = 0").select("doc_id"), "doc_id")
    return low.groupBy("source", F.floor(c("doc_id") / 100).alias("part")).agg(ids.alias("pages")).select("source", "part", F.lit("other").alias("target"), "pages")


@query("i1_tenant_rows", "SELECT doc_id FROM documents WHERE source='src3'")
def _(t: Tables):
    return I.tenant(t.documents, "src3", "source").select("doc_id")


@query("i2_orphans", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang='en')")
def _(t: Tables):
    return I.orphans(t.labels, t.documents.filter("lang = 'en'"), {"doc_id": "doc_id"}).select("doc_id")


@query("i3_append_only", "SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN 'deleted' ELSE 'changed' END AS change FROM orders WHERE o_orderstatus='P' OR o_orderpriority='1-URGENT'")
def _(t: Tables):
    after = t.orders.filter("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(c("o_orderpriority") == "1-URGENT", c("o_totalprice") + 1).otherwise(c("o_totalprice")))
    return I.changed_or_gone(t.orders, after, "o_orderkey", ["o_custkey", "o_totalprice", "o_orderstatus"])


@query("i4_hash_chain", "SELECT event_id FROM events WHERE value>95")
def _(t: Tables):
    # A log whose links are the hash of the payload before; some payloads are tampered with afterwards.
    w = W.partitionBy("user_id").orderBy("event_id")
    p = t.events.select("user_id", "event_id", "value", F.concat_ws("|", "event_type", "props").alias("payload"))
    log = p.withColumn("prev_hash", F.sha2(F.lag("payload").over(w), 256)).withColumn("hash", F.sha2("payload", 256))
    seen = log.withColumn("payload", F.when(c("value") > 95, F.concat("payload", F.lit("x"))).otherwise(c("payload")))
    ok = F.lag("hash").over(w).eqNullSafe(c("prev_hash")) & (c("hash") == F.sha2("payload", 256))
    return seen.withColumn("ok", ok).filter("not ok").select("event_id")


@query("i5_check_validation", "SELECT event_id, event_type IN ('view','click','purchase') AND value>=0 AS valid FROM events")
def _(t: Tables):
    return t.events.select("event_id", (c("event_type").isin("view", "click", "purchase") & (c("value") >= 0)).alias("valid"))


@query("i6_deferred_invariant", "SELECT o_orderkey FROM orders WHERE o_orderstatus='F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='A')")
def _(t: Tables):
    return I.orphans(t.orders.filter("o_orderstatus = 'F'"), t.lineitem.filter("l_returnflag = 'A'"), {"o_orderkey": "l_orderkey"}).select("o_orderkey")


@query("i7_retry_backoff", "SELECT event_id, CAST(30*pow(2, event_id%4)+least(event_id%20,15) AS DOUBLE) AS wait FROM events")
def _(t: Tables):
    return t.events.select("event_id", I.backoff(c("event_id") % 4, c("event_id") % 20).alias("wait"))


@query("i8_stale_reaper", "SELECT event_id FROM events WHERE event_type='click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 2 HOUR")
def _(t: Tables):
    return t.events.filter((c("event_type") == "click") & (c("ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00' - interval 2 hours"))).select("event_id")


_STATES = "['QUEUED','RUNNING','RETRYING','FAILED','SUCCEEDED','CANCELLED']"


@query(
    "i9_state_transitions",
    f"WITH e AS (SELECT user_id, ts, event_id, {_STATES}[event_id%6+1] AS target FROM events), p AS (SELECT lag(target) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS source, target FROM e)"
    " SELECT source, target, count(*) AS n FROM p WHERE source IS NOT NULL AND (source,target) NOT IN (('QUEUED','RUNNING'),('QUEUED','CANCELLED'),('RUNNING','SUCCEEDED'),('RUNNING','FAILED'),('RUNNING','RETRYING'),('RUNNING','CANCELLED'),('RUNNING','QUEUED'),"
    "('RETRYING','RUNNING'),('RETRYING','FAILED'),('RETRYING','CANCELLED'),('RETRYING','QUEUED'),('FAILED','RETRYING')) GROUP BY 1,2",
)
def _(t: Tables):
    # Jobs are users; the state of an event follows from its number.
    states = F.array(*map(F.lit, I.JOB_STEPS))
    e = t.events.select("user_id", "ts", "event_id", F.get(states, (c("event_id") % 6).cast("int")).alias("to"))
    s = e.select(F.lag("to").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("from"), "to").filter("`from` is not null").groupBy("from", "to").agg(F.count("*").alias("n"))
    return I.invalid_steps(s).select(c("from").alias("source"), c("to").alias("target"), "n")


@query("i10_rate_limit", "SELECT user_id, strftime(time_bucket(INTERVAL 6 HOUR, ts),'%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1,2 HAVING count(*)>3")
def _(t: Tables):
    return I.over_rate(t.events, "user_id", "ts", 6 * 3600, 3).select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("i11_purge", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='5-LOW')")
def _(t: Tables):
    gone = t.orders.filter("o_orderpriority = '5-LOW'").select(c("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(gone, "l_orderkey", "left_anti").agg(F.count("*").alias("n"))


@query("i12_budget_check", "SELECT source, sum(greatest(1,length(text)//4))*0.002 > 30 AS over FROM documents GROUP BY 1")
def _(t: Tables):
    return t.documents.groupBy("source").agg((F.sum(T.token_estimate(c("text"))) * 0.002 > 30).alias("over"))


@query("s14_manifest", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations")
def _(t: Tables):
    from ..sources.files import manifest

    return manifest({n: getattr(t, n) for n in ("documents", "pages", "labels", "conversations")})


@query("s18_histogram_metrics", "WITH b AS (SELECT unnest([10.0,25.0,50.0,100.0]::DOUBLE[]) AS le) SELECT event_type, le, count(*) FILTER (WHERE value<=le) AS n FROM events, b GROUP BY 1,2")
def _(t: Tables):
    g = t.events.groupBy("event_type").agg(*[F.count_if(c("value") <= le).alias(str(i)) for i, le in enumerate((10.0, 25.0, 50.0, 100.0))])
    return g.select("event_type", F.explode(F.array(*[F.struct(F.lit(le).alias("le"), c(str(i)).alias("n")) for i, le in enumerate((10.0, 25.0, 50.0, 100.0))])).alias("x")).select("event_type", "x.le", "x.n")


@query("z1_case_statistics", "SELECT source, count(*) AS pages, count(l.doc_id) FILTER (WHERE quality=0) AS review FROM documents d LEFT JOIN labels l USING(doc_id) GROUP BY 1")
def _(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("pages"), F.count_if(c("quality") == 0).alias("review"))


@query("z2_version_override", "SELECT d.doc_id, coalesce(l.quality, -1) AS confidence, l.doc_id IS NOT NULL AS has_version, n_chars FROM documents d LEFT JOIN labels l USING(doc_id)")
def _(t: Tables):
    l = t.labels.select("doc_id", "quality", F.lit(True).alias("v"))
    return t.documents.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("confidence"), F.coalesce("v", F.lit(False)).alias("has_version"), "n_chars")


@query("z3_counted_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def _(t: Tables):
    n = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("z20_proof_invariants", "SELECT 'order_without_line' AS rule, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'line_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size<40)")
def _(t: Tables):
    a = I.orphans(t.orders, t.lineitem, {"o_orderkey": "l_orderkey"}).agg(F.count("*").alias("n")).select(F.lit("order_without_line").alias("rule"), "n")
    return a.union(I.orphans(t.lineitem, t.part.filter("p_size < 40"), {"l_partkey": "p_partkey"}).agg(F.count("*").alias("n")).select(F.lit("line_without_part"), "n"))


@query("z21_token_cost", "SELECT lang, round(sum(greatest(1,length(text)//4)*CASE lang WHEN 'en' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END)/1000,4) AS cost FROM documents GROUP BY 1")
def _(t: Tables):
    price = t.spark.createDataFrame([("en", 0.5)], "lang string, price double")
    return t.documents.join(F.broadcast(price), "lang", "left").groupBy("lang").agg(F.round(F.sum(T.token_estimate(c("text")) * F.coalesce("price", F.lit(0.8))) / 1000, 4).alias("cost"))


@query("z23_manifest_checksum", "SELECT s_suppkey, sha256('{\"name\":\"'||s_name||'\",\"nation\":'||s_nationkey||'}') AS h FROM supplier")
def _(t: Tables):
    return t.supplier.select("s_suppkey", F.sha2(F.to_json(F.struct(c("s_name").alias("name"), c("s_nationkey").alias("nation"))), 256).alias("h"))


@query("z24_trigger_policy", "SELECT event_id, CASE WHEN user_id%4=0 THEN true WHEN user_id%4=1 THEN event_type='error' ELSE value>90 END AS fires FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.when(c("user_id") % 4 == 0, True).when(c("user_id") % 4 == 1, c("event_type") == "error").otherwise(c("value") > 90).alias("fires"))
