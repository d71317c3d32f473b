"""Lineage cuts for iterative operators, small inputs dealt to all cores, and joins without broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so later steps survive lost executors and don't recompute.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without one (tests) gets its own.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores before costly work on each; a scan with as many partitions as cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data and is never broadcast.

    Spark goes by the size of the files that it reads, which says little of rows after an explode or of compressed texts.
    """
    return df.hint("merge")
