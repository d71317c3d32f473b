"""Quality rules: base counts, then the distance of a text's histograms to language references.

Two histograms are taken of each text: its characters by class, and its words by membership in a list of common
words (one bin each, one for all others).  The references are the same histograms summed over all texts of each
language, to which ``PRIOR_CHARACTERS`` and ``PRIOR_WORDS`` shares of the whole table are added: a language of few texts has
a reference near that of the table, which becomes its own as texts are added, without a switch.  A text is kept if, for the nearest language, the Jensen-Shannon distance of both histograms stays below its
limit; texts under ``CLASS_WORDS`` or ``COMMON_WORDS`` words are not judged by the respective histogram, since short
texts lie far from any reference by chance.

DataFrame functions only.  The counts are written once (``checkpoint``), since the references need all of them before
the first verdict.

Edge cases: null text has no words and fails the base rule; null ``lang`` counts towards no reference; with no language
that has a text which passes the base rule, that rule alone decides; a null id is carried through; repeated rows are each
judged (equal rows alike) and each counts towards the references; very long texts are judged whole inside their row;
an empty table gives an empty table; columns of other names are not read, whatever they are called.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ensure_checkpoint_dir, whole

#: Common words of the languages.
COMMON = (
    "the of and to in is that it for on was with as by "  # English
    "de la le et les en des un du une que est pour "  # French
    "der die und den von zu das mit sich auf ist nicht "  # German
    "el y los se del las por con una para"  # Spanish
).split()

PRIOR_CHARACTERS = 10_000
PRIOR_WORDS = 2_000
CLASS_WORDS = 50
COMMON_WORDS = 150
CLASS_LIMIT = 0.30
COMMON_LIMIT = 0.30
REPEAT_WINDOW = 8


def _counts(text: Column) -> list[tuple[str, Column]]:
    """Columns in the order in which they build on each other."""
    c = F.col
    n = c("n_words")
    k = REPEAT_WINDOW
    window = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(c("_words"), i + j) for j in range(k)]))
    placed = F.sort_array(F.transform(c("_windows"), lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    key = lambda i: F.get(c("_placed"), i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_placed") - 1), lambda i: (F.coalesce(key(i) == key(i - 1), F.lit(False))) | F.coalesce(key(i) == key(i + 1), F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda i: F.get(c("_placed"), i)["p"]))
    # Words covered by the windows that start at the given places, in ascending order.
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + (p + k) - F.greatest(p, s["end"])).cast("long").alias("n"), (p + k).alias("end")),
        lambda s: s["n"],
    )
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    out = [
        ("_words", F.array_remove(F.split(text, SPACE), "")),
        ("n_words", F.size("_words")),
        ("_solid", F.array_join("_words", "")),
        ("word_chars", F.length("_solid").cast("long")),
        ("_lines", F.filter(F.split(text, "\n"), has_word)),
        ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        ("_windows", F.when(n >= k, window).otherwise(F.array().cast("array<bigint>"))),
        ("_distinct", F.size(F.array_distinct("_windows"))),
        ("_placed", F.when(c("_distinct") < F.size("_windows"), placed)),
        ("n_repeat_words", F.when(c("_placed").isNotNull(), covered).otherwise(F.lit(0)).cast("long")),
        # What is left of the solid text as one class after another is taken out.
        ("_a", F.regexp_replace("_solid", "[a-z]+", "")),
        ("_b", F.regexp_replace("_a", "[A-Z]+", "")),
        ("_c", F.regexp_replace("_b", "[0-9]+", "")),
        ("_d", F.regexp_replace("_c", r"[#*$%&|<>]+", "")),
        ("_e", F.regexp_replace("_d", r"[\x21-\x7E]+", "")),
        ("n_symbols", (F.length("_c") - F.length("_d")).cast("long")),
        (
            "_classes",
            F.array(
                *(x.cast("double") for x in (
                    F.length("_solid") - F.length("_a"),
                    F.length("_a") - F.length("_b"),
                    F.length("_b") - F.length("_c"),
                    F.length("_c") - F.length("_d"),
                    F.length("_d") - F.length("_e"),
                    F.length("_e"),
                ))
            ),
        ),
        ("_known", F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(*COMMON))),
        ("_string", F.concat(F.lit(" "), F.array_join("_known", "  "), F.lit(" "))),
        (
            "_common",
            F.array(
                *(((F.length("_string") - F.length(F.replace(F.col("_string"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double") for w in COMMON),
                (n - F.size("_known")).cast("double"),
            ),
        ),
    ]
    return out


def _share(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: x / F.greatest(total, F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; 0 to 1."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def references(counted: DataFrame) -> list[dict[str, list[float]]]:
    """Both histograms of each language, smoothed by those of the table: a row per language, all of them."""
    kinds = {"c": (6, PRIOR_CHARACTERS), "w": (len(COMMON) + 1, PRIOR_WORDS)}
    columns = {"c": "_classes", "w": "_common"}
    sums = [F.sum(F.get(columns[p], F.lit(i))).alias(f"{p}{i}") for p, (k, _) in kinds.items() for i in range(k)]
    rows = counted.where("_lang is not null and not base_failed").groupBy("_lang").agg(*sums).orderBy("_lang").collect()
    out = [{p: [r[f"{p}{i}"] for i in range(k)] for p, (k, _) in kinds.items()} for r in rows]
    table = {p: [sum(h[p][i] for h in out) for i in range(k)] for p, (k, _) in kinds.items()}
    return [{p: smoothed(h[p], table[p], prior) for p, (_, prior) in kinds.items()} for h in out]


def smoothed(own: list[float], table: list[float], prior: float) -> list[float]:
    """Shares of a histogram to which ``prior`` units are added as the table has them."""
    total = max(1.0, sum(table))
    mixed = [x + prior * t / total for x, t in zip(own, table, strict=True)]
    return [x / max(1.0, sum(mixed)) for x in mixed]


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, the base counts, ``base_failed``, ``kept`` and the two distances of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    counted = docs.select(F.col(id_col), F.col(lang_col).alias("_lang"), whole(text_col).alias("_text"))
    for name, column in _counts(F.col("_text")):
        counted = counted.withColumn(name, column)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = [id_col, F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = counted.select(*base, failed.alias("base_failed"), "_lang", "_classes", "_common").checkpoint(eager=True)
    refs = references(counted)
    shares = counted.withColumn("_classes", _share(F.col("_classes"))).withColumn("_common", _share(F.col("_common")))
    if refs:
        known = F.from_json(F.lit(json.dumps(refs)), "array<struct<c: array<double>, w: array<double>>>")  # one literal, folded by the optimizer

        def distance(ref: Column) -> Column:
            classes, common = js_distance(F.col("_classes"), ref["c"]), js_distance(F.col("_common"), ref["w"])
            return F.transform(F.array(F.struct(classes.alias("a"), common.alias("b"))), lambda d: F.struct((d["a"] + d["b"]).alias("sum"), d["a"].alias("classes"), d["b"].alias("common")))[0]

        apart = F.array_min(F.transform(known, distance))
    else:
        zero = F.lit(0.0)
        apart = F.struct(zero.alias("sum"), zero.alias("classes"), zero.alias("common"))
    far = ((F.col("n_words") >= CLASS_WORDS) & (F.col("_apart.classes") > CLASS_LIMIT)) | ((F.col("n_words") >= COMMON_WORDS) & (F.col("_apart.common") > COMMON_LIMIT))
    return shares.withColumn("_apart", apart).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.col("_apart.classes").alias("class_distance"), F.col("_apart.common").alias("common_distance")
    )
