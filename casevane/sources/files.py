"""Readers and writers of the file formats around the tables; every path goes through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes of the file types.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("494433", "mp3"), ("52494646", "riff"), ("50415231", "parquet"))


def plain_text(html: Column) -> Column:
    """Markup out, scripts and styles with their content, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t\n\r]+", " "))


def sniff(content: Column) -> Column:
    """File type by leading bytes."""
    head = F.hex(F.substring(content, 1, 8))
    markup = F.lower(F.ltrim(F.substring(content, 1, 64).cast("string"))).rlike("^(<html|<!doc)")
    out = None
    for magic, kind in MAGIC:
        hit = head.startswith(magic)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.coalesce(out, F.when(markup, "html"), F.lit("unknown"))


def content_key(case: Column, content: Column, kind: str) -> Column:
    """Content-addressed place of an original."""
    return F.concat_ws("/", F.lit("cases"), case, F.lit(kind), F.sha2(content, 256))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with their type and SHA-256, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", sniff(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))


def write_case_tables(tables: dict[str, DataFrame], path: str, key: str) -> None:
    """Each table as JSON lines, a folder per case."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(key).json(f"{path}/{name}")


def read_case_table(spark: SparkSession, path: str, name: str, schema: str, key: str, value) -> DataFrame:
    """One case's rows of a written table; only its folder is read."""
    return spark.read.schema(schema).json(f"{path}/{name}").filter(F.col(key) == value)


def read_rules(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON documents, the last version of each key."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n``: the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out
