"""Mixing sources to target weights by Pareto order sampling.

1. *Targets.* A source's size is its words; the sources, by code point, carry repeating weights and share ``SHARE`` of all
   words.  A target stops at ``MOST`` times its source's size and its excess is shared again by weight until none is above.
   Each round is one aggregate over the table of sources, which stays distributed.
2. *Inclusion.* A document wants ``min(MOST, scale * preference)`` copies; the scale of a source follows from its words by
   preference, a few rows a source, so that the copies wanted add up to the target.  The whole part of it are *certain
   copies*, the rest is the *inclusion probability* of one more copy, unequal within a source.
3. *Pareto ranking.* A document's rank is its random odds ``u / (1 - u)`` divided by its inclusion odds; the sample are the
   first documents by rank, its fixed size given in words, what the certain copies leave of the target.  The last one is
   taken if the target is nearer with it.  A second ranking over documents that still fit fills what a long one left open.
4. *No sort of a source.* The place of the cut is found by digits of the rank: words by the first 12 bits of it, then by
   the next 12 within the bucket of the cut, then a window over the few rows of that bucket alone.  A source with a third of all
   rows is so summed where its rows are.

Only ids and numbers are shuffled.  The random number is a digest of seed, id and text, so reruns agree however the rows
are dealt; rows that agree in all (repeated rows) are counted first, ranked as one and given back one by one.

Edge cases: a null text has size 0, and documents of size 0 are returned with nothing taken; null sources are one source,
the last, other than ''; a null id is an id like others, before all; ties of rank go by id, then size; a source of few
long documents misses its target by half a document at most where nothing shorter fits; an empty table gives an empty
table; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Preferences are whole numbers from 1 to this.
CLASSES = 8
#: Tables of at most this many rows go to all executors; larger ones are joined by shuffle.
SMALL = 50_000
DIGITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_length(size: Column) -> Column:
    """Preference by binary digits of the size: 128 words and more are eight times as likely as one word."""
    return F.least(F.lit(CLASSES), F.length(F.bin(size)))


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; b's keys go."""
    b = b.select(*(F.col(c).alias(f"{c}_") if c in keys else F.col(c) for c in b.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return a.join(b, on, how).drop(*(f"{k}_" for k in keys))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size`` -> with ``target``."""
    spark = sizes.sparkSession
    kind = sizes.schema["source"].dataType.simpleString()
    ranked = sizes.orderBy(F.asc_nulls_last("source")).rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], float(weights[r[1] % len(weights)])))
    ranked = spark.createDataFrame(ranked, f"source {kind}, source_size long, weight double", verifySchema=False).checkpoint()
    most_of_it = F.lit(float(most)) * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    capped = F.lit(False)
    while True:
        now = ranked.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, most_of_it)), F.sum(F.when(~capped, F.col("weight")))).first()
        if now[0] == stopped or not now[2]:
            break
        stopped, level = now[0], (total - (now[1] or 0.0)) / now[2]
        capped = most_of_it <= F.lit(level) * F.col("weight")
    return ranked.select("source", "source_size", F.when(capped, most_of_it).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _wanted(classes: DataFrame, most: float) -> DataFrame:
    """``source, pref, words, source_size, target`` -> ``base`` certain copies and ``chance`` of one more, by source and preference."""
    down = Window.partitionBy("source").orderBy(F.desc("pref"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("pref") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    scale = F.when(F.col("rest") > 0, (F.col("target") - F.lit(float(most)) * F.col("before")) / F.col("rest"))
    able = F.col("scale") * F.col("pref") <= most
    of_source = F.max_by("scale", F.when(able, F.col("pref"))).over(Window.partitionBy("source"))
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("own") * F.col("pref"), F.lit(float(most))))
    out = classes.withColumn("before", before).withColumn("rest", rest).withColumn("scale", scale).withColumn("own", of_source).withColumn("copies", copies)
    base = F.floor("copies")
    return out.select("source", "pref", "words", "source_size", "target", base.alias("base"), (F.col("copies") - base).alias("chance"))


def _cut(rows: DataFrame, need: DataFrame) -> DataFrame:
    """``source, place, before``: the bucket of 24 bits in which the words reach ``need``, and the words before it."""
    found = need.select("source", "need", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("before"))
    for level in (1, 2):
        inside = rows if level == 1 else _same(rows, _small(found.select("source", F.col("place").alias("upper"))), ["source"]).where(F.shiftright("bucket", DIGITS) == F.col("upper"))
        words = inside.groupBy("source", F.shiftright("bucket", DIGITS * (2 - level)).alias("at")).agg(F.sum(F.col("size") * F.col("left")).alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("at"))  # 4,096 rows a source at most
        reached = _same(words.withColumn("to", run), found.drop("place"), ["source"]).where(F.col("before") + F.col("to") >= F.col("need"))
        found = reached.groupBy("source", "need").agg(F.min(F.struct("at", (F.col("before") + F.col("to") - F.col("words")).alias("before"))).alias("m"))
        found = found.select("source", "need", F.col("m.at").alias("place"), F.col("m.before").alias("before")).checkpoint()
    return found


def _choose(items: DataFrame, need: DataFrame) -> DataFrame:
    """``items`` with ``more``: how many of their ``left`` copies the words wanted of their source cover, by rank."""
    able = F.col("open")
    cut = _cut(items.where(able), need)
    wanted = _same(need.select("source"), cut, ["source"], "left")  # no cut: all are taken
    rows = _same(items, _small(wanted.withColumn("asked", F.lit(True)).checkpoint()), ["source"], "left")
    taking = able & F.coalesce("asked", F.lit(False))
    at_cut = F.coalesce(taking & (F.col("bucket") == F.col("place")), F.lit(False))
    away = rows.where(~at_cut).withColumn("more", F.when(taking & (F.col("place").isNull() | (F.col("bucket") < F.col("place"))), F.col("left")).otherwise(0))
    run = F.sum(F.col("size") * F.col("left")).over(Window.partitionBy("source").orderBy(F.asc_nulls_first("rank"), F.asc_nulls_first("doc_id"), "size"))
    room = F.col("need") - F.col("before") - (run - F.col("size") * F.col("left"))
    whole = F.greatest(F.lit(0), F.least(F.col("left"), F.floor(F.col("room") / F.col("size"))))
    nearer = (F.col("whole") < F.col("left")) & (2 * (F.col("room") - F.col("whole") * F.col("size")) >= F.col("size"))
    near = rows.where(at_cut).withColumn("room", room).withColumn("whole", whole).withColumn("more", F.col("whole") + F.when(nearer, 1).otherwise(0))
    names = [*items.columns, "more"]
    return away.select(names).unionByName(near.select(names))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    preference: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    seed: str = SEED,
) -> DataFrame:
    """``id_col, size, source_size, target, taken`` of every document: the words the mix takes of it, repeats counted.

    ``preference`` is a Column over docs, a whole number from 1 to ``CLASSES``; by default long documents are preferred.
    ``share`` is at most ``MOST``.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    size = n_words(F.col(text_col))
    told = F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    drawn = F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long")
    pref = F.greatest(F.lit(1), F.least(F.lit(CLASSES), (by_length(F.col("size")) if preference is None else F.col("preference")).cast("int")))
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), size.alias("size"), drawn.alias("drawn"), (F.lit(1) if preference is None else preference).alias("preference"))
    rows = rows.select("source", "doc_id", "size", "drawn", F.coalesce(pref, F.lit(1)).alias("pref"))
    counted = rows.groupBy("source", "doc_id", "size", "drawn", "pref").agg(F.count("*").alias("n")).checkpoint()

    classes = counted.groupBy("source", "pref").agg(F.sum(F.col("size") * F.col("n")).alias("words")).checkpoint()
    of = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share).checkpoint()
    plan = _wanted(_same(classes, of, ["source"]), MOST).checkpoint()
    need = plan.groupBy("source", "target").agg((F.col("target") - F.sum(F.col("base") * F.col("words"))).alias("need")).select("source", "need").where("need > 0").checkpoint()

    odds, u = F.col("chance") / (1 - F.col("chance")), (F.col("drawn") + 0.5) / float(1 << 52)
    rank = F.when(F.col("chance") > 0, (u / (1 - u)) / odds)
    items = _same(counted, _small(plan.drop("words")), ["source", "pref"]).withColumn("rank", rank / (1 + rank)).withColumn("bucket", F.floor(F.col("rank") * float(1 << 2 * DIGITS)))
    items = items.select("source", "doc_id", "size", "n", "source_size", "target", "base", "rank", "bucket", F.col("n").alias("left"), ((F.col("size") > 0) & F.col("rank").isNotNull()).alias("open"))
    first = _choose(items.checkpoint(), need).checkpoint()
    # What a long document at the cut left open, for those that fit.
    got = first.groupBy("source").agg(F.sum(F.col("more") * F.col("size")).alias("got"))
    short = _same(need, got, ["source"]).select("source", (F.col("need") - F.col("got")).alias("need")).where("need >= 1").checkpoint()
    again = _same(first.withColumn("left", F.col("left") - F.col("more")).withColumnRenamed("more", "before_more"), _small(short.withColumnRenamed("need", "rest")), ["source"], "left")
    again = again.withColumn("open", F.col("open") & (F.col("left") > 0) & F.coalesce(F.col("size") <= F.col("rest"), F.lit(False))).drop("rest")
    second = _choose(again.checkpoint(), short)

    # Repeated rows come back one by one, in runs that bound the arrays.
    run, many = 1 << 16, F.col("n")
    out = second.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), many - 1, F.lit(run).cast("long"))))
    out = out.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + run, many) - 1)))
    extra = F.when(F.col("k") < F.col("before_more") + F.col("more"), 1).otherwise(0)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", ((F.col("base") + extra) * F.col("size")).cast("long").alias("taken"))


def _chosen(items: str, need: str) -> str:
    """SQL: one ranking over whole sources."""
    return f"""
  SELECT *, CASE WHEN need IS NULL OR NOT open THEN 0 ELSE whole + (CASE WHEN whole < rest AND 2 * (room - whole * size) >= size THEN 1 ELSE 0 END) END AS more
  FROM (SELECT *, CASE WHEN open THEN greatest(0, least(rest, floor(room / size)))::BIGINT END AS whole
    FROM (SELECT i.*, d.need, d.need - (sum(CASE WHEN open THEN size * rest ELSE 0 END) OVER (
            PARTITION BY i.source ORDER BY rank NULLS FIRST, doc_id NULLS FIRST, size) - CASE WHEN open THEN size * rest ELSE 0 END) AS room
          FROM {items} i LEFT JOIN {need} d ON i.source IS NOT DISTINCT FROM d.source))"""


ORACLE = f"""
WITH sized AS (
  SELECT source, doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS drawn FROM documents),
counted AS (SELECT source, doc_id, size, drawn, least({CLASSES}, length(bin(size))) AS pref, count(*) AS n FROM sized GROUP BY ALL),
classes AS (SELECT source, pref, sum(size * n)::BIGINT AS words FROM counted GROUP BY ALL),
sizes AS (
  SELECT source, sum(words)::BIGINT AS s, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM classes GROUP BY source),
filled AS (
  SELECT *, ({SHARE}::DOUBLE * sum(s) OVER ()::DOUBLE - coalesce(sum(2 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c, row_number() OVER o AS k
  FROM sizes WINDOW o AS (ORDER BY s / w, source)),
level AS (SELECT min_by(c, k) AS c FROM filled WHERE c * w < 2 * s),
targets AS (SELECT source, s, CASE WHEN 2 * s <= level.c * w THEN 2.0::DOUBLE * s ELSE coalesce(level.c, 0) * w END AS target FROM sizes, level),
scaled AS (
  SELECT c.*, s, target, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / nullif(sum(pref * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS scale
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY pref DESC)),
wanted AS (
  SELECT *, least(2.0::DOUBLE, coalesce(max_by(scale, CASE WHEN scale * pref <= 2 THEN pref END) OVER (PARTITION BY source) * pref, 2.0::DOUBLE)) AS copies FROM scaled),
plan AS (SELECT source, pref, words, s, target, floor(copies)::BIGINT AS base, copies - floor(copies) AS chance FROM wanted),
need AS (SELECT * FROM (SELECT source, target - sum(base * words)::DOUBLE AS need FROM plan GROUP BY source, target) WHERE need > 0),
ranked AS (
  SELECT c.source, doc_id, size, n, s, target, base, n AS rest,
         CASE WHEN chance > 0 THEN (((drawn + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (1 - (drawn + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) / (chance / (1 - chance)) END AS q
  FROM counted c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source AND c.pref = p.pref),
items AS (SELECT * EXCLUDE q, q / (1 + q) AS rank, size > 0 AND q IS NOT NULL AS open FROM ranked),
once AS ({_chosen("items", "need")}),
short AS (
  SELECT n.source, n.need - got AS need
  FROM need n JOIN (SELECT source, sum(more * size)::DOUBLE AS got FROM once GROUP BY source) g ON n.source IS NOT DISTINCT FROM g.source WHERE n.need - got >= 1),
again AS (
  SELECT o.source, doc_id, size, n, s, target, base, rank, o.rest - more AS rest, more AS had, open AND o.rest > more AND coalesce(size <= d.need, false) AS open
  FROM once o LEFT JOIN short d ON o.source IS NOT DISTINCT FROM d.source),
twice AS ({_chosen("again", "short")})
SELECT doc_id, size, s AS source_size, target, ((base + CASE WHEN k < had + more THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM (SELECT *, unnest(range(n)) AS k FROM twice)"""
