"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D separate words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session without one (tests) gets its own."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")


def whole(col: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def held_out(mod: int, rest: int, key: str = "doc_id"):
    """True for rows of the evaluation fold, which no model here learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


def batches_for(df: DataFrame, byte_col, per_batch: int) -> int:
    """How many groups of about ``per_batch`` bytes a column makes: one cheap distributed sum."""
    total = df.select(F.sum(byte_col).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // per_batch))
