"""Interval joins, merging, chunking and other queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins, sequence
from . import duck as D
from .registry import Tables, query

c = F.col
TURNS = "turns AS (SELECT conv_id AS media_id, k*7000+500 AS t_start, (k+1)*7000+500 AS t_end, 'S'||(k%3) AS label FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(0,12)) AS k))"


def turns(t: Tables):
    k = t.conversations.select(c("conv_id").alias("media_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return k.select("media_id", (c("k") * 7000 + 500).alias("t_start"), ((c("k") + 1) * 7000 + 500).alias("t_end"), F.concat(F.lit("S"), c("k") % 3).alias("label"))


@query("j12_interval_point", f"WITH {D.SEGMENTS}, {TURNS} SELECT s.media_id, s.turn, t.label FROM seg s JOIN turns t ON s.media_id=t.media_id AND s.start_ms BETWEEN t.t_start AND t.t_end")
def _(t: Tables):
    return joins.interval_points(sequence.segments(t.conversations), turns(t), ["media_id"], "start_ms", "t_start", "t_end", 10000).select("media_id", "turn", "label")


@query(
    "j13_most_overlap",
    f"WITH {D.SEGMENTS}, {TURNS}, x AS (SELECT s.media_id, s.turn, t.label, row_number() OVER (PARTITION BY s.media_id, s.turn ORDER BY least(s.end_ms,t.t_end)-greatest(s.start_ms,t.t_start) DESC, t.t_start) AS rn FROM seg s JOIN turns t ON s.media_id=t.media_id AND least(s.end_ms,t.t_end)>greatest(s.start_ms,t.t_start)) SELECT s.media_id, s.turn, coalesce(x.label,'UNKNOWN') AS label FROM seg s LEFT JOIN x ON x.media_id=s.media_id AND x.turn=s.turn AND rn=1",
)
def _(t: Tables):
    return joins.most_overlap(sequence.segments(t.conversations), turns(t), ["media_id"], "turn", 10000).select("media_id", "turn", "label")


@query(
    "j14_containment_or_nearest",
    f"WITH {D.SEGMENTS}, x AS (SELECT media_id, turn, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN 15000 BETWEEN start_ms AND end_ms THEN 0 ELSE 1 END, abs(start_ms-15000), turn) AS rn FROM seg) SELECT media_id, turn FROM x WHERE rn=1",
)
def _(t: Tables):
    s = sequence.segments(t.conversations)
    near = F.struct(F.when(F.lit(15000).between(c("start_ms"), c("end_ms")), 0).otherwise(1), F.abs(c("start_ms") - 15000), "turn")
    return s.groupBy("media_id").agg(F.min_by("turn", near).alias("turn"))


@query("j15_range_overlap", f"WITH {D.SEGMENTS} SELECT media_id, turn FROM seg WHERE end_ms >= 12000 AND start_ms <= 34000")
def _(t: Tables):
    return sequence.segments(t.conversations).filter("end_ms >= 12000 and start_ms <= 34000").select("media_id", "turn")


@query(
    "c4_testimony_islands",
    f"WITH {D.SEGMENTS}, g AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR start_ms - lag(end_ms) OVER w > 3000 THEN 1 ELSE 0 END AS b FROM seg WINDOW w AS (PARTITION BY media_id ORDER BY turn)), i AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY turn) AS island FROM g) SELECT media_id, CAST(island AS BIGINT) AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY 1,2",
)
def _(t: Tables):
    k, o = ["media_id"], ["turn"]
    s = sequence.segments(t.conversations)
    breaks = ~sequence.previous("speaker", k, o).eqNullSafe(c("speaker")) | (c("start_ms") - sequence.previous("end_ms", k, o) > 3000)
    s = s.withColumn("b", F.coalesce(breaks, F.lit(True)))
    return sequence.islands(s, k, o, c("b")).groupBy("media_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@query(
    "c4_testimony_chunks",
    "WITH RECURSIVE s AS (SELECT conv_id AS media_id, role, len(regexp_extract_all(text,'[^ \\t\\n\\r]+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), r AS (SELECT media_id, role, n, rn, 0 AS chunk, n AS room FROM s WHERE rn=1 UNION ALL SELECT s.media_id, s.role, s.n, s.rn, CASE WHEN s.role<>r.role OR r.room+s.n>350 THEN r.chunk+1 ELSE r.chunk END, CASE WHEN s.role<>r.role OR r.room+s.n>350 THEN s.n ELSE r.room+s.n END FROM r JOIN s ON s.media_id=r.media_id AND s.rn=r.rn+1) SELECT media_id, CAST(chunk AS INT) AS chunk, CAST(sum(n) AS BIGINT) AS words FROM r GROUP BY 1,2",
)
def _(t: Tables):
    s = sequence.segments(t.conversations).withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))))
    s = s.withColumn("cut", F.coalesce(sequence.previous("speaker", ["media_id"], ["turn"]) != c("speaker"), F.lit(True)))
    return sequence.capped_runs(s.select("media_id", "turn", "n", "cut"), ["media_id"], ["turn"], "n", 350, "cut").groupBy("media_id", "chunk").agg(F.sum("n").alias("words"))


@query("c1_page_chunks")
def _(t: Tables):
    return sequence.chunk_pages(t.documents, ["doc_id"]).select("doc_id", "chunk", "words")


@query("c8_next_other_speaker", "SELECT a.conv_id, a.turn, (SELECT arg_min(b.role, b.turn) FROM conversations b WHERE b.conv_id=a.conv_id AND b.turn>a.turn AND b.role<>a.role) AS names FROM conversations a")
def _(t: Tables):
    # Runs of one speaker: the next run's speaker is the first other one.
    s = sequence.islands(t.conversations.withColumn("b", sequence.previous("role", ["conv_id"], ["turn"]) != c("role")), ["conv_id"], ["turn"], c("b"))
    runs = s.groupBy("conv_id", "island").agg(F.first("role").alias("role"))
    runs = runs.select("conv_id", "island", F.lead("role").over(W.partitionBy("conv_id").orderBy("island")).alias("names"))
    return s.join(runs, ["conv_id", "island"]).select("conv_id", "turn", "names")


@query("c10_batches_of_six", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id)-1)//6 AS BIGINT) AS batch FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.floor((F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1) / 6).alias("batch"))


@query("c12_drift_plan", "SELECT label AS model, count(*) AS n FROM embeddings GROUP BY 1 HAVING bool_or(embedding[1]>0.28)")
def _(t: Tables):
    return t.embeddings.groupBy(c("label").alias("model")).agg(F.count("*").alias("n"), F.bool_or(F.get("embedding", F.lit(0)) > F.lit(0.28)).alias("d")).filter("d").select("model", "n")


@query("x21_speaker_first_order", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, CASE WHEN role='assistant' THEN 0 ELSE 1 END, turn LIMIT 30")
def _(t: Tables):
    return t.conversations.orderBy("conv_id", F.when(c("role") == "assistant", 0).otherwise(1), "turn").limit(30).select("conv_id", "turn")


@query("z7_cross_session_history", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id%10 ORDER BY conv_id DESC, turn DESC) AS rn FROM conversations) WHERE rn<=4")
def _(t: Tables):
    w = W.partitionBy(c("conv_id") % 10).orderBy(F.desc("conv_id"), F.desc("turn"))
    return t.conversations.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("conv_id", "turn")


@query("z8_duplicate_submit", "SELECT event_id FROM (SELECT event_id, event_type, ts, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type=pt AND ts-pts < INTERVAL 120 SECOND")
def _(t: Tables):
    k, o = ["user_id"], ["ts", "event_id"]
    x = t.events.withColumn("pt", sequence.previous("event_type", k, o)).withColumn("pts", sequence.previous("ts", k, o))
    return x.filter((c("event_type") == c("pt")) & (c("ts") - c("pts") < F.expr("interval 120 seconds"))).select("event_id")


@query("z15_extractive_fallback", "SELECT conv_id, turn, left(array_to_string(string_split_regex(text,'[.!?] ')[1:2],' '),600) AS gist FROM conversations")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", F.left(F.array_join(F.slice(F.split("text", "[.!?] "), 1, 2), " "), F.lit(600)).alias("gist"))
