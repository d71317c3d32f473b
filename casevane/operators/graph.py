"""Property graph of the tables and its traversal by frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def build(nodes: dict[str, DataFrame], edges: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (source, target, kind, provenance) from one projection per kind."""
    n = reduce(DataFrame.unionByName, [df.select("id", F.lit(kind).alias("kind"), "label") for kind, df in nodes.items()])
    e = reduce(DataFrame.unionByName, [df.select("source", "target", F.lit(kind).alias("kind"), F.lit("EXTRACTED").alias("provenance")) for kind, df in edges])
    return n, e


# Kinds of edges between the nodes of a case.
EDGE_KINDS = (
    "ASSERTS SUPPORTS CONTRADICTS REFUTES CITES PARTICIPATED_IN TESTIFIED_IN DECIDES APPLIES DERIVED_FROM MENTIONS ABOUT HAS_SPEAKER IS_PARTY PRECEDES CAUSES APPEALS RESPONDS_TO"
    " REFERS_TO ALLEGES DENIES ADMITS POSITION_ON DECISION_PROVES_FACT FACT_ABOUT_ISSUE"
).split()


def between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge of a known kind once, if both of its ends are nodes."""
    known = nodes.select("id").distinct()
    # Dealt by one end from the start, equal edges meet where that end meets its node; all edges move twice in all.
    kept = edges.filter(F.col("kind").isin(*EDGE_KINDS)).repartition("target").distinct()
    return kept.join(known.withColumnRenamed("id", "target"), "target", "left_semi").join(known.withColumnRenamed("id", "source"), "source", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """Every edge seen from both of its ends: id, other, kind, direction."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "kind", F.lit("in").alias("direction")))


def traverse(edges: DataFrame, start: DataFrame, depth: int, *, directed: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """``id, depth``: nodes reached and their least distance.  One join per level; what is reached is not expanded again."""
    used = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    step = used.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if not directed:
        step = step.union(step.select("b", "a"))
    step = cut(step.distinct())
    reached = start.select("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        frontier = reached.filter(F.col("depth") == d - 1).join(step, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        found = cut(frontier.join(reached, "id", "left_anti").withColumn("depth", F.lit(d)))
        if found.isEmpty():
            break
        reached = reached.union(found)
    return reached


def touching(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with an end among the reached nodes, leading outside too."""
    ids = reached.select("id").distinct()
    a = edges.join(ids, F.col("source") == F.col("id"), "left_semi")
    return a.union(edges.join(ids, F.col("target") == F.col("id"), "left_semi")).distinct()


def paths(tree: DataFrame, separator: str = "/", most: int = 20) -> DataFrame:
    """``id, path`` from the root for each node of (id, parent, name)."""
    level = tree.filter("parent is null").select("id", F.col("name").alias("path"))
    out = level
    for _ in range(most):
        level = tree.select("id", "parent", "name").join(level.select(F.col("id").alias("parent"), "path"), "parent").select("id", F.concat_ws(separator, "path", "name").alias("path"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.union(level)
    return out
