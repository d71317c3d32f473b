"""Near-duplicate documents by an inverted join over signature coordinates.

1. *Signatures.* Each text gives the set of its 5-word shingles (64-bit hashes) and, for each of ``COORDINATES`` hash
   functions, the least hash.  Texts with equal sets are one class with a number of its own; ids come back at the end, so
   two texts under one id stay two classes until their links are known.
2. *Postings.* A class is posted under its (coordinate, value) pairs.  Two sets at the similarity limit agree in 0.85
   of the coordinates on average; fewer than ``MATCHES`` agreements of 64 have a chance of 3 in a million there, and
   less above.  So the join counts collisions up to ``MATCHES``: with postings in one global order, rarest first, two
   classes with that many in common meet within the first ``COORDINATES - MATCHES + 1`` of both, and only this prefix
   is posted; a pair that one class alone has meets nobody and is skipped.
3. *Groups.* In each posting list the most central class leads.  Lists with one leader merge into its group, so a
   pair is met once or a few times and not once per coordinate.  No pairs are emitted: a group is compared where it
   meets, with a union-find that skips what is joined already; agreements are counted first, then the whole sets are
   intersected.  Only the links of that union-find come out, at most one per member.
4. A group beyond ``CHUNK`` members is cut into chunks, each with the leader.  What the chunks have joined is labelled,
   and chunk pairs are compared only where their labels differ, so copies around one original need no second look.
5. Components of the links by alternating large-star and small-star steps; all tables stay distributed.

Edge cases: words are bytes between 0x20 and 0x09-0x0D, A-Z lower-cased; with fewer than five words the whole sequence
is the one shingle; null and blank texts have no shingle and are alone; rows with equal ids count as one document,
linked with whatever any of their texts is linked with (a blank text of that id stays alone, as every blank text); null
ids count as one document with the largest id (its component id is null if nothing smaller is linked); very long
texts are taken whole, their signature in slices; repeated rows are one document with as many rows in the result; an
empty table gives an empty table; columns of other names are not read, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_for, ensure_checkpoint_dir

WORDS = 5
COORDINATES = 64
MATCHES = 40
PREFIX = COORDINATES - MATCHES + 1
#: A link: 100 * intersection >= LIMIT * union.
LIMIT = 85
CHUNK = 512
CHUNK_SHINGLES = 1 << 20
TASK_BYTES = 2 << 20
MEMO = 1_000_000
LARGEST = (1 << 63) - 1

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


_A, _B = _coefficients()


class _Words(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    x = h[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        x = x * _STEP + h[k : n - width + 1 + k]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    out = None
    for a in range(0, len(s), 2048):
        m = (((s[a : a + 2048, None] * _A) + _B) >> np.uint64(32)).min(axis=0)
        out = m if out is None else np.minimum(out, m)
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(s):
        return 0, 0
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(s * _STEP ^ (s >> np.uint64(17))).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for a in range(0, rows.num_rows, size):
            yield rows.slice(a, size)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags = np.arange(COORDINATES, dtype=np.int64) << 32
    for rows in _slices(batches):
        out = ([], [], [], [])
        for text in rows.column(2):
            s = shingles(text.as_py())
            out[0].append(len(s))
            for column, k in zip(out[1:3], class_key(s), strict=True):
                column.append(k)
            out[3].append((signature(s).astype(np.int64) | tags) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.list_(pa.int64()))], names=["id", "print", "n", "k1", "k2", "tokens"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, k1, k2, text -> the set of each node; a text whose fingerprint is only like the node's gives nothing."""
    for rows in _slices(batches):
        nodes, sets = [], []
        for node, k1, k2, text in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            s = shingles(text)
            if class_key(s) == (k1, k2):
                nodes.append(node)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


class _Forest(dict):
    def root(self, x):
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _compare(nodes: list[int], sets: list[np.ndarray], labels: list[int], side: list[int] | None, first: int | None, forest: _Forest) -> None:
    """Join all members that are linked.  ``side``: compare only members of different sides."""
    sizes = np.array([len(s) for s in sets])
    sigs = np.stack([signature(s) for s in sets]).astype(np.uint32)
    sides = None if side is None else np.array(side)
    order = list(range(len(nodes)))
    if first is not None:
        order.remove(first)
        order.insert(0, first)
    left = np.array(order)
    for x in order:
        left = left[left != x]
        if not len(left):
            break
        root = forest.root(labels[x])
        able = left[(100 * np.minimum(sizes[left], sizes[x]) >= LIMIT * np.maximum(sizes[left], sizes[x]))]
        if sides is not None:
            able = able[sides[able] != sides[x]]
        if not len(able):
            continue
        able = able[(sigs[able] == sigs[x]).sum(axis=1) >= MATCHES]
        able = [y for y in able.tolist() if forest.root(labels[y]) != root]
        if not able:
            continue
        counts = np.array([len(sets[y]) for y in able])
        pool = np.concatenate([sets[y] for y in able])
        at = np.minimum(np.searchsorted(sets[x], pool), len(sets[x]) - 1)
        both = np.add.reduceat((sets[x][at] == pool).astype(np.int64), np.cumsum(counts) - counts)
        for y, common in zip(able, both.tolist(), strict=True):
            if 100 * common >= LIMIT * (sizes[x] + sizes[y] - common):
                forest.join(labels[x], labels[y])


def _links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Some groups with their members' sets -> (a, b), b the smallest label that a is joined with."""
    groups = defaultdict(list)
    t = table.to_pydict()
    for row in zip(t["leader"], t["c1"], t["c2"], t["node"], t["label"], t["side"], t["shingles"], strict=True):
        groups[row[:3]].append(row[3:])
    forest = _Forest()
    for (leader, a, b), members in groups.items():
        nodes = [m[0] for m in members]
        sets = [np.frombuffer(m[3], np.uint64) for m in members]
        first = nodes.index(leader) if leader in nodes else None
        _compare(nodes, sets, [m[1] for m in members], [m[2] for m in members] if a != b else None, first, forest)
    links = [(x, r) for x in list(forest) if (r := forest.root(x)) != x]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([r for _, r in links], pa.int64())})


def _checked(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links: the smallest node it is connected with."""
    edges = _checked(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        # Large star: larger neighbours go to the least neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself go to the least neighbour.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _checked(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _classes(sketches: DataFrame) -> DataFrame:
    """``node, k1, k2, id, print``: a number for each different set, its least id and the fingerprint of a text of that id."""
    one = sketches.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "print")).alias("m"))
    return _checked(one.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "m.id", "m.print"))


def _groups(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """``leader, node, n``: the members of every group that must be compared."""
    nodes = sketches.join(classes, ["k1", "k2", "id", "print"]).select("node", "n", "tokens").dropDuplicates(["node"])
    postings = nodes.select("node", "n", F.explode("tokens").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = postings.join(shared, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("p"), F.sum(F.log2("df")).alias("score"))
    # Postings that only this class has come first in the order and meet nobody.
    room = F.lit(PREFIX) - (F.lit(COORDINATES) - F.size("p"))
    prefix = posted.where(room > 0).select("node", "n", "score", F.explode(F.slice("p", F.lit(1), room)).alias("e")).select("node", "n", "score", F.col("e.token").alias("token"))
    prefix = _checked(prefix)
    leaders = prefix.groupBy("token").agg(F.max(F.struct("score", (-F.col("node")).alias("back"))).alias("top"), F.count("*").alias("df")).where("df > 1")
    return prefix.join(leaders.select("token", (-F.col("top.back")).alias("leader")), "token").select("leader", "node", "n").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST))
    texts = docs.select(key.alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).alias("text"))
    sketches = _checked(texts.mapInArrow(_sketch, "id long, print long, n long, k1 long, k2 long, tokens array<long>"))
    classes = _classes(sketches)
    groups = _checked(_groups(sketches, classes))

    sizes = groups.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    members = groups.join(sizes, "leader").withColumn("c", F.when(F.col("node") == F.col("leader"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    members = _checked(members)
    of_interest = classes.join(groups.select("node").distinct(), "node")
    sets = _checked(texts.join(of_interest, ["id", "print"]).select("node", "k1", "k2", "text").mapInArrow(_sets, "node long, shingles binary").distinct())

    def links(parts: DataFrame) -> DataFrame:
        """parts: leader, c1, c2, node, n, label, side."""
        tasks = batches_for(parts, F.col("n") * 8, TASK_BYTES)
        rows = parts.drop("n").join(sets, "node").withColumn("task", F.pmod(F.xxhash64("leader", "c1", "c2"), F.lit(tasks)).cast("int"))
        return rows.groupBy("task").applyInArrow(_links, "a long, b long")

    at_home = members.withColumn("c1", F.explode(F.when(F.col("c") < 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("c"))))
    found = _checked(links(at_home.select("leader", "c1", F.col("c1").alias("c2"), "node", "n", F.col("node").alias("label"), F.lit(0).alias("side"))))
    # An id with several texts is one document.
    own = sketches.select("id", "n", "k1", "k2").join(classes.select("node", "k1", "k2", F.col("id").alias("least")), ["k1", "k2"], "left")
    several = own.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top")
    found = found.union(own.join(several, "id").where("node <> b").select(F.col("node").alias("a"), "b"))
    roots = components(found)

    large = members.where("chunks > 1")
    if large.limit(1).count():
        label = F.coalesce("root", F.col("node"))
        labelled = _checked(large.join(roots, "node", "left").select("leader", "node", "n", label.alias("label")))
        # Chunks of one label where it is large; the members of small labels share chunks.
        by_label = labelled.groupBy("leader", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
        pieces = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("long")
        mixed = by_label.where(f"m < {CHUNK}").groupBy("leader").agg(F.greatest(F.ceil(F.sum("m") / CHUNK), F.ceil(F.sum("s") / CHUNK_SHINGLES)).cast("long").alias("mixed"))
        dealt = labelled.join(by_label, ["leader", "label"]).join(mixed, "leader", "left")
        dealt = dealt.withColumn("pure", F.col("m") >= CHUNK).withColumn(
            "c",
            F.when(F.col("pure"), F.concat_ws("/", "label", F.pmod(F.xxhash64("node"), pieces))).otherwise(F.concat_ws("/", F.lit("mixed"), F.pmod(F.xxhash64("label"), F.col("mixed")))),
        )
        dealt = _checked(dealt.select("leader", "node", "n", "label", "pure", "c"))
        chunks = dealt.groupBy("leader", "c").agg(F.first("pure").alias("pure"), F.min("label").alias("label"))
        a, b = chunks.alias("a"), chunks.alias("b")
        pairs = a.join(b, F.col("a.leader") == F.col("b.leader")).where(
            (F.col("a.c") <= F.col("b.c")) & ~(F.col("a.pure") & F.col("b.pure") & (F.col("a.label") == F.col("b.label"))) & ~(F.col("a.pure") & (F.col("a.c") == F.col("b.c")))
        )
        pairs = pairs.select(F.col("a.leader").alias("leader"), F.col("a.c").alias("c1"), F.col("b.c").alias("c2"))
        sides = pairs.withColumn("s", F.explode(F.when(F.col("c1") == F.col("c2"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).withColumn("c", F.when(F.col("s") == 0, F.col("c1")).otherwise(F.col("c2")))
        parts = dealt.join(sides, ["leader", "c"]).select("leader", "c1", "c2", "node", "n", "label", F.col("s").alias("side"))
        more = _checked(links(parts))
        roots = components(found.union(more))

    # The least id of each component, from its classes.
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(classes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("comp_id"))
    out = own.join(linked.join(least, "root").select("node", "comp_id"), "node", "left")  # the class of each document, then its component
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("comp_id", "least", "id"))
    back = lambda c: F.when(c != LARGEST, c)
    return out.withColumn("comp", component).select(
        back(F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), back(F.col("comp")).alias("component_id"), (F.col("id") == F.col("comp")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component: all rows whose id is the component's least."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST)).alias("key")
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select(key)
    rows = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of theirs meets one of ours
    return rows.join(kept, "key", "left_semi").select("row.*")
