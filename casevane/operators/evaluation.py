"""Classification quality, agreement, threshold sweeps, votes and claim checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def per_label(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``label, precision, recall, f1, support`` of labels that occur as truth."""
    long = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("x"), (F.col(truth) == F.col(guess)).alias("hit"))
    g = long.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.g").alias("said"), F.sum(F.when(F.col("hit") & (F.col("x.t") == 1), 1).otherwise(0)).alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return g.filter("support > 0").select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), "support")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two binary columns, one row."""
    x, y = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    m = df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), x.alias("x"), y.alias("y"))
    pe = F.col("x") * F.col("y") + (1 - F.col("x")) * (1 - F.col("y"))
    return m.select(F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def sweep(df: DataFrame, score: str, truth: str, steps: int = 71, first: int = 10, prefer: float = 0.34) -> DataFrame:
    """``threshold, f1`` with the best F1 of thresholds in hundredths; ties by nearness to ``prefer``.

    Scores are counted per hundredth first, so the sweep runs over at most a hundred rows whatever the input.
    """
    bins = df.groupBy(F.floor(F.col(score) * 100 + 1e-9).alias("b")).agg(F.sum(F.col(truth)).alias("pos"), F.count("*").alias("n"))
    grid = bins.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(first + steps - 1))))
    g = grid.groupBy("t").agg(F.sum(F.when(F.col("b") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("b") >= F.col("t"), F.col("n")).otherwise(0)).alias("said"), F.sum("pos").alias("all"))
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("all")), F.lit(0.0)), 6)
    best = g.select((F.col("t") / 100).alias("threshold"), f1.alias("f1"))
    return best.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.round(F.abs(F.col("threshold") - prefer), 6), -F.col("threshold"))).alias("x")).select("x.*")


def vote(neighbours: DataFrame, query: str, label: str, weight: Column) -> DataFrame:
    """``query, label, score, margin``: the heaviest label and its lead over the second."""
    s = neighbours.groupBy(query, label).agg(F.round(F.sum(weight), 9).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), label)
    two = s.withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return two.select(query, label, "score", F.round((F.col("score") - F.col("second")) / F.col("score"), 6).alias("margin"))


def triage(valid: Column, ratio: Column, support: float = 0.34, review: float = 0.20) -> Column:
    """Status of a claim from its citation and grounding (V2)."""
    return F.when(~valid, "invalid_citation").when(ratio >= support, "supported").when(ratio >= review, "review").otherwise("unsupported")


#: Milliseconds that the start of a cited segment may be off.
TOLERANCE = 1500


def _meets(a: str, b: str) -> Column:
    """Whether a cited source (alias a) is an expected one (alias b): every column that the expectation names agrees."""
    col = F.col
    same = lambda x: col(f"{b}.{x}").isNull() | col(f"{a}.{x}").eqNullSafe(col(f"{b}.{x}"))
    start = col(f"{b}.start_ms").isNull() | F.coalesce(F.abs(col(f"{a}.start_ms") - col(f"{b}.start_ms")) <= TOLERANCE, F.lit(False))
    return same("document_id") & same("page_number") & same("media_id") & same("segment_id") & start


def golden(cases: DataFrame, expected: DataFrame, evidence: DataFrame, case: str = "case_id") -> DataFrame:
    """``case, retrieval_recall, citation_recall, citation_precision, noise, coherent, abstention, kind_matches, passed``.

    cases: case, answer_kind, claims, occurrences (counts), expected_kind, expected_abstention, max_visible; expected: case,
    expectation (a number), must (false: must not be cited), document_id, page_number, media_id, segment_id, start_ms (null:
    any); evidence: case, place (a number), used and the same five columns.  Expectations are exploded sets that join their
    case's evidence; precision and noise are null without cited sources or a criterion, abstention without an expectation.
    """
    c = F.col
    e, x = evidence.alias("e"), expected.alias("x")
    met = e.join(x, (c(f"e.{case}") == c(f"x.{case}")) & _meets("e", "x")).select(c(f"e.{case}").alias(case), "place", "used", "expectation", "must")
    asked = expected.groupBy(case).agg(F.count_if("must").alias("musts"), F.count_if(~c("must")).alias("must_nots"))
    found = met.filter("must").groupBy(case).agg(F.countDistinct("expectation").alias("found"), F.countDistinct(F.when(c("used"), c("expectation"))).alias("cited"))
    hits = met.groupBy(case, "place").agg(F.bool_or("must").alias("wanted"), F.bool_or(~c("must")).alias("refused"))
    used = evidence.filter("used").join(hits, [case, "place"], "left").join(asked, case, "left")
    criterion = (F.coalesce("musts", F.lit(0)) + F.coalesce("must_nots", F.lit(0))) > 0
    relevant = F.when(F.coalesce("musts", F.lit(0)) > 0, F.coalesce("wanted", F.lit(False))).otherwise(~F.coalesce("refused", F.lit(False)))
    source = F.when(c("document_id").isNotNull(), F.struct(F.lit("doc").alias("k"), c("document_id").cast("string").alias("a"), c("page_number").cast("string").alias("b"))).otherwise(
        F.struct(F.lit("seg").alias("k"), F.coalesce("media_id", "segment_id").cast("string").alias("a"), F.coalesce("segment_id", "start_ms").cast("string").alias("b"))
    )
    visible = used.withColumn("source", source).groupBy(case).agg(
        F.count("*").alias("visible"), F.countDistinct(F.struct("source")).alias("sources"), F.count_if(criterion & relevant).alias("right"), F.count_if(criterion & ~relevant).alias("wrong"), F.bool_or(criterion).alias("judged")
    )
    all_of = cases.join(asked, case, "left").join(found, case, "left").join(visible, case, "left").fillna(0, ["musts", "found", "cited", "visible", "sources", "right", "wrong"])
    share = lambda n: F.when(c("musts") == 0, F.lit(1.0)).otherwise(F.round(c(n) / c("musts"), 6))
    judged = F.coalesce("judged", F.lit(False))
    silent, expects_none = c("answer_kind").eqNullSafe(F.lit("insufficient")), F.coalesce("expected_abstention", F.lit(False))
    faults = (
        (expects_none & ~silent)
        | (silent & ((c("claims") > 0) | (c("visible") > 0) | (c("occurrences") > 0)))
        | (c("answer_kind").eqNullSafe(F.lit("navigational")) & (c("claims") > 0))
        | F.coalesce(c("visible") > c("max_visible"), F.lit(False))
        | (c("visible") > c("sources"))
    )
    abstention = F.when(expects_none, silent & (c("visible") == 0)).when(c("expected_kind").isNull(), F.lit(None).cast("boolean")).when(c("expected_kind") == "insufficient", F.lit(False)).otherwise(~silent)
    kind = F.when(c("expected_kind").isNotNull(), c("expected_kind").eqNullSafe(c("answer_kind")))
    out = all_of.select(
        case, share("found").alias("retrieval_recall"), share("cited").alias("citation_recall"), F.when(judged, F.round(c("right") / c("visible"), 6)).alias("citation_precision"),
        F.when(judged, c("wrong")).alias("noise"), (~faults).alias("coherent"), abstention.alias("abstention"), kind.alias("kind_matches"),
    )
    passed = (c("retrieval_recall") >= 1) & (c("citation_recall") >= 1) & c("coherent") & F.coalesce("abstention", F.lit(True)) & F.coalesce("kind_matches", F.lit(True))
    return out.withColumn("passed", passed)
