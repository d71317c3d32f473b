"""Packages of a case: index matching on import, manifest, JSON lines and Markdown on export, flat fact rows, labelled questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def leading_number(c: Column) -> Column:
    """The number that a name begins with, without leading zeros; null without one."""
    return F.nullif(F.regexp_extract(c, r"^\s*0*([0-9]+)", 1), F.lit("")).cast("long")


def match_index(files: DataFrame, index: DataFrame, name: str, title: str) -> DataFrame:
    """Files with the index entry of the same leading number (S11); files without one are left out."""
    return files.withColumn("_n", leading_number(F.col(name))).join(index.withColumn("_n", leading_number(F.col(title))), "_n").drop("_n")


def case_manifest(cases: DataFrame, tables: dict[str, DataFrame], key: str = "case_id") -> DataFrame:
    """A row per case with the number of rows of each table (S13, S14); one aggregate per table, joined on the case."""
    counts = [df.groupBy(key).agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "left"), counts, cases.select(key)).fillna(0, list(tables))


def write_package(cases: DataFrame, tables: dict[str, DataFrame], path: str, *, pages: DataFrame | None = None, timeline: DataFrame | None = None, key: str = "case_id") -> None:
    """A folder per kind and case (S13): manifest, JSON lines of each table, Markdown of pages, and the timeline in order.

    ``pages``: case, document_id, page_number, text.  ``timeline``: case, event_date and what else an event has.
    """
    case_manifest(cases, tables, key).write.mode("overwrite").partitionBy(key).json(f"{path}/manifest")
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(key).json(f"{path}/{name}")
    if pages is not None:
        block = F.concat(F.lit("## p. "), F.col("page_number").cast("string"), F.lit("\n\n"), T.markdown(F.col("text")))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", block.alias("b")))), lambda x: x["b"]), "\n\n")  # the pages of one document
        pages.groupBy(key, "document_id").agg(text.alias("value")).write.mode("overwrite").partitionBy(key, "document_id").text(f"{path}/markdown")
    if timeline is not None:
        timeline.repartition(key).sortWithinPartitions(key, F.col("event_date").asc_nulls_last()).write.mode("overwrite").partitionBy(key).json(f"{path}/timeline")


def fact_rows(facts: DataFrame) -> DataFrame:
    """A row per position of each fact (S15); facts without a position have none."""
    rest = [c for c in facts.columns if c != "positions"]
    return facts.select(*rest, F.explode("positions").alias("p")).select(*rest, "p.*")


def write_facts_csv(facts: DataFrame, path: str) -> None:
    fact_rows(facts).write.mode("overwrite").option("header", True).csv(path)


def write_questions(questions: DataFrame, path: str) -> None:
    """Labelled questions as JSON lines, one of each folded text, the last label wins."""
    key = T.question_hash(F.col("text"))
    questions.groupBy(key.alias("hash")).agg(F.max_by(F.struct("text", "label"), "made_at").alias("q")).select("hash", "q.*").write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV corpus of labelled questions: text, label."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("text string, label string").csv(path)


def replace_chunks(chunks: DataFrame, path: str, scope: str) -> None:
    """Chunks of the scopes at hand in place of the old ones (C11, S19): other scopes stay as they are."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def index_changes(old: DataFrame, new: DataFrame, scope: str, keys: list[str], text: str = "text", model: str = "model") -> DataFrame:
    """``scope, keys, action``: keep, drop or add each chunk, by the hash of its text and the model of its vector (C11).

    Only hashes are compared, so texts are not shuffled; a chunk whose text or model changed is dropped and added.  Equal
    chunks of one scope are one; a null model agrees with null.
    """
    mark = lambda df: df.select(scope, *keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_hash"), F.coalesce(F.col(model), F.lit("")).alias("_model")).distinct()
    both = mark(old).withColumn("_side", F.lit(1)).unionByName(mark(new).withColumn("_side", F.lit(2)))
    sides = both.groupBy(scope, *keys, "_hash", "_model").agg(F.sum("_side").alias("_s"))
    action = F.when(F.col("_s") == 3, "keep").when(F.col("_s") == 1, "drop").otherwise("add")
    return sides.select(scope, *keys, "_hash", action.alias("action"))


def reindexed(old: DataFrame, new: DataFrame, scope: str, keys: list[str], text: str = "text", model: str = "model", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The chunks of the scopes that changed, and of them those that need a vector.

    Chunks that stay bring their old vector (``vector`` of old), added ones have none yet; ``replace_chunks`` overwrites these
    scopes alone.  Scopes from which all chunks went are not in the result.
    """
    changes = index_changes(old, new, scope, keys, text, model)
    touched = changes.filter("action <> 'keep'").select(scope).distinct()
    hashed = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    kept = changes.filter("action = 'keep'").drop("action").join(old.select(scope, *keys, hashed.alias("_hash"), vector), [scope, *keys, "_hash"]).dropDuplicates([scope, *keys, "_hash"])
    fresh = new.join(touched, scope, "left_semi").withColumn("_hash", hashed).dropDuplicates([scope, *keys, "_hash"])
    rows = fresh.join(kept.select(scope, *keys, "_hash", vector, F.lit(True).alias("_kept")), [scope, *keys, "_hash"], "left").drop("_hash")
    return rows.drop("_kept"), rows.filter("_kept is null").drop("_kept", vector)


def resource(tables: dict[str, DataFrame], uri: str) -> DataFrame:
    """What a resource address names (S20): ``case://<id>/files``, ``case://<id>/graph`` or ``case://<id>/pages/<document>/<page>``."""
    parts = uri.removeprefix("case://").split("/")
    own = lambda name: tables[name].filter(F.col("case_id") == parts[0])
    match parts[1:]:
        case ["files"]:
            return own("files").select("file_id", "filename")
        case ["graph"]:
            return own("edges").groupBy("kind").agg(F.count("*").alias("n"))
        case ["pages", document, page]:
            return own("pages").filter((F.col("document_id") == document) & (F.col("page_number") == int(page))).select("text")
    raise ValueError(f"no resource {uri}")
