"""Bounded samples of labelled rows for the classifiers; everything else reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = 1 << 30


def sample_rows(rows: DataFrame, value: str, per_label: dict | int, total: int) -> list[tuple]:
    """``(id, y, value)`` of at most ``per_label`` ids for each value of ``y``, spread by a hash of the id.

    ``rows`` has the columns ``id``, ``y`` and the named value.  Every label is sampled: where labels are many, each
    gives fewer ids, so that ``total`` bounds the sample (one id a label at least).  ``per_label`` may name a bound for
    each label.  An id with several values gives the least.  Two jobs, whatever the number of labels: one counts ids
    by label, the other brings the rows below each label's threshold.  The result is the same on every run.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("id").isNotNull() & F.col("y").isNotNull())
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}  # a row per class of the model
    if not sizes:
        return []
    most = {y: max(1, min(per_label if isinstance(per_label, int) else per_label.get(y, 0), total // len(sizes))) for y in sizes}
    below = [(y, _SPREAD if n <= 1.2 * most[y] else int(_SPREAD * min(1.0, 1.5 * (most[y] + 8) / n))) for y, n in sizes.items()]
    kind = rows.schema["y"].dataType.simpleString()
    limits = spark.createDataFrame(below, f"y {kind}, below long")
    spread = F.pmod(F.xxhash64("id"), F.lit(_SPREAD))
    near = rows.join(F.broadcast(limits), "y").where(spread < F.col("below"))  # broadcast: a row per class
    got = near.groupBy("id", "y").agg(F.min(value).alias("v"), F.min(spread).alias("s")).collect()  # about 1.5 times the sample at most
    out: list[tuple] = []
    taken = dict.fromkeys(sizes, 0)
    for r in sorted(got, key=lambda r: (r["s"], r["id"])):
        if taken[r["y"]] < most[r["y"]]:
            taken[r["y"]] += 1
            out.append((r["id"], r["y"], r["v"]))
    return sorted(out, key=lambda r: (r[0], str(r[1])))
