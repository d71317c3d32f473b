"""Document fingerprints by order min hash.

Tokens are runs of up to 16 non-space characters; a k-mer is ``K`` consecutive tokens, numbered by its occurrence in
the text, so that repeats count.  The numbered k-mers are hashed and dealt into ``BINS`` by their top bits; each bin
keeps the ``TUPLE`` smallest, puts them back in text order and hashes that tuple.  Moving text changes tuples even if
the set of k-mers stays, so the share of equal tuples follows edit distance.

DataFrame functions only: everything about a text happens inside its row.  Rows meet three times, by key and never in
one task: with the text that precedes each in id order, with the head of the next text, and with the next fingerprint.

Edge cases: null text is empty; texts with fewer than ``K`` tokens have one k-mer, those without a token none (two such
fingerprints are alike by 1); rows are ordered by id, null last, then by a hash of the text; equal rows have the same
next row; a lone row is its own next; very long texts are taken whole (places are numbered modulo 2**24, so beyond 16
million tokens two k-mers that far apart may change places in a tuple; equal texts still have equal fingerprints); an
empty table gives an empty table; columns of other names are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, whole

K = 3
BINS = 32
TUPLE = 2
#: Smallest hashes looked at per place of a tuple, before a text is looked at whole.
SPARE = 6
LARGEST = (1 << 63) - 1

_PLACE = 24  # bits of a value that hold the place in the text
_LOW = (1 << _PLACE) - 1
_BIN = 58  # bits below the bin


def _steps(text: str, p: str) -> list[tuple[str, Column]]:
    """Columns from a text column to its tuples ``{p}fp`` (array of long), each built on those before."""
    c = lambda name: F.col(p + name)
    empty = F.array().cast("array<bigint>")
    n = F.size(c("t"))
    high = F.lit(((1 << 63) - 1) & ~_LOW)

    def packed(*parts: Column, place: Column) -> Column:
        return F.xxhash64(*parts).bitwiseAND(high).bitwiseOR((place.cast("bigint") % (_LOW + 1)))

    grams = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: packed(*[F.get(c("t"), i + j) for j in range(K)], place=i)))
    grams = grams.when(n > 0, F.array(packed(F.array_join(c("t"), " "), place=F.lit(0)))).otherwise(empty)
    name = lambda x: F.shiftright(x, _PLACE)
    item = lambda i: F.get(c("s"), i)
    place = lambda x: x.bitwiseAND(F.lit(_LOW))
    size = F.size(c("s"))
    # Sorted by k-mer, then place: the later ones of a k-mer stand in blocks, one after its first.
    later = F.when(size > 1, F.filter(F.sequence(F.lit(1), size - 1), lambda i: name(item(i)) == name(item(i - 1)))).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(F.transform(c("s"), lambda x, i: F.when((i == 0) | (name(x) != name(item(i - 1))), packed(name(x), F.lit(0), place=place(x)))), lambda x: x.isNotNull())
    at = lambda j: F.get(c("later"), j)
    m = F.size(c("later"))
    heads = F.when(m > 0, F.filter(F.sequence(F.lit(0), m - 1), lambda j: (j == 0) | (at(j) != at(j - 1) + 1))).otherwise(F.array().cast("array<int>"))
    numbered = F.flatten(
        F.transform(
            c("heads"),
            lambda j, h: F.transform(
                F.sequence(at(j), at(F.coalesce(F.get(c("heads"), h + 1), m) - 1)),
                lambda i: packed(name(item(i)), i - at(j) + 1, place=place(item(i))),
            ),
        )
    )
    below = F.lit((1 << _BIN) - 1)
    few = F.greatest(F.lit(1), F.size(c("v")))
    limit = F.least(F.lit(float(1 << _BIN)), F.lit(float(1 << _BIN)) * (SPARE * BINS * TUPLE) / few).cast("bigint")
    small = F.sort_array(F.filter(c("v"), lambda x: x.bitwiseAND(below) < c("limit")))
    bin_of = lambda x: F.shiftright(x, _BIN)
    got = lambda i: F.get(c("o"), i)

    def starts(arr: str) -> Column:
        e = lambda i: F.get(c(arr), i)
        return F.when(F.size(c(arr)) > 0, F.filter(F.sequence(F.lit(0), F.size(c(arr)) - 1), lambda i: (i == 0) | (bin_of(e(i)) != bin_of(e(i - 1))))).otherwise(F.array().cast("array<int>"))

    # Bins whose first TUPLE values are all there.
    sure = F.size(F.filter(starts("small"), lambda i: F.coalesce(bin_of(F.get(c("small"), i)) == bin_of(F.get(c("small"), i + TUPLE - 1)), F.lit(False))))
    whole_text = (c("limit") < (1 << _BIN)) & (c("sure") < BINS)

    def tuple_at(i: Column) -> Column:
        a, b = got(i), got(i + 1)
        alone = F.coalesce(bin_of(a) != bin_of(b), F.lit(True))
        ordered = F.when(alone, F.xxhash64(name(a))).when(place(a) <= place(b), F.xxhash64(name(a), name(b))).otherwise(F.xxhash64(name(b), name(a)))
        return F.shiftleft(bin_of(a), 32).bitwiseOR(ordered.bitwiseAND(F.lit(0xFFFFFFFF)))

    return [
        (p + "t", F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0))),
        (p + "s", F.sort_array(grams)),
        (p + "later", later),
        (p + "heads", heads),
        (p + "v", F.when(m > 0, F.concat(firsts, numbered)).otherwise(firsts)),
        (p + "limit", limit),
        (p + "small", small),
        (p + "sure", sure),
        (p + "o", F.when(whole_text, F.sort_array(c("v"))).otherwise(c("small"))),
        (p + "fp", F.transform(starts("o"), tuple_at)),
    ]


def with_fingerprint(df: DataFrame, text: str, p: str) -> DataFrame:
    """Adds ``{p}fp``: the tuples of a text column, as longs of bin and hash."""
    keep = df.columns
    for name, column in _steps(text, p):
        df = df.withColumn(name, column)
    return df.select(*keep, p + "fp")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def text_of(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def neighbours(keys: DataFrame) -> DataFrame:
    """``k, th, nk, nth, pk, pth, pn``: next and previous key of each, cyclic, by range partitions and their edges."""
    dealt = keys.repartitionByRange("k", "th").withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("part").orderBy("k", "th")
    this = F.struct("k", "th", "n")
    inside = dealt.withColumn("after", F.lead(this).over(w)).withColumn("before", F.lag(this).over(w))
    edges = dealt.groupBy("part").agg(F.min(this).alias("first"), F.max(this).alias("last"))  # a row per partition
    every = Window.orderBy("part")
    ends = edges.agg(F.min("first").alias("lowest"), F.max("last").alias("highest"))
    edges = edges.select("part", F.lead("first").over(every).alias("up"), F.lag("last").over(every).alias("down")).join(F.broadcast(ends))
    out = inside.join(F.broadcast(edges), "part")
    after, before = F.coalesce("after", "up", "lowest"), F.coalesce("before", "down", "highest")
    return out.select("k", "th", after["k"].alias("nk"), after["th"].alias("nth"), before["k"].alias("pk"), before["th"].alias("pth"), before["n"].alias("pn"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST))
    base = docs.select(key.alias("k"), F.xxhash64(whole(text_col)).alias("th"), whole(text_col).alias("text"))
    links = neighbours(base.select("k", "th", F.length("text").alias("n")).distinct())
    own = base.join(links, ["k", "th"])
    heads = own.select("pk", "pth", F.substring(F.col("text"), F.lit(1), F.floor(F.col("pn") / 4).cast("int")).alias("head")).dropDuplicates(["pk", "pth"])
    n = F.length("text")
    both = own.join(heads.withColumnsRenamed({"pk": "k", "pth": "th"}), ["k", "th"])
    both = both.select("k", "th", "nk", "nth", n.alias("n"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), "head").alias("edited"))
    marked = with_fingerprint(with_fingerprint(both.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)), "text", "x_"), "edited", "y_")
    marked = marked.select("k", "th", "nk", "nth", "n", "sha", "x_fp", "y_fp").checkpoint(eager=True)
    after = marked.select(F.col("k").alias("nk"), F.col("th").alias("nth"), F.col("x_fp").alias("z_fp")).dropDuplicates(["nk", "nth"])
    return marked.join(after, ["nk", "nth"]).select(
        F.when(F.col("k") != LARGEST, F.col("k")).cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        text_of(F.col("x_fp")).alias("fingerprint"),
        text_of(F.col("y_fp")).alias("edited_fingerprint"),
        likeness(F.col("x_fp"), F.col("y_fp")).alias("near_edited"),
        likeness(F.col("x_fp"), F.col("z_fp")).alias("near_next"),
    )
