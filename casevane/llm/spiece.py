"""SentencePiece encoding and decoding over a relational lattice.

Text is cut into words that no piece can cross (before each run of spaces, and around line and tab characters).  The
lattice of a word has an edge for each substring that is a piece: substrings of bounded length are exploded, equi-joined
to the piece table, and the edges are grouped by word.  A higher-order ``aggregate`` folds them:

* ``unigram`` models: Viterbi over the places of the word, keeping for each place the best score and way;
* ``bpe`` models: a Viterbi path is *not* what the library gives, so the fold replays the merges: the state has the
  piece boundaries and the edges that still can merge, and each step joins the adjacent pair whose edge has the best
  score, leftmost on ties.

Every different word of the corpus goes through the lattice once.  Texts are dealt into batches; a batch asks for each
of its words once, in a row per bucket of words; inside a bucket the distinct words are found, exploded, joined, grouped
and folded without another shuffle, and the answers go back to the batches that asked.  So a word that every text has
is one row per batch, a text crosses the network once (compressed), and nothing grows with the vocabulary of the corpus
but the number of buckets.

The fold of a word costs about the square of its length; a word beyond ``LONGEST`` characters (a text without a single
space, say) has its merges or its best path computed by a heap or a loop where the answers are written, exactly, in
n log n.

Edge cases: null and empty texts have no ids; characters without a piece become byte pieces (or the unknown piece
without byte fallback); a literal U+2581 is a space to the model, so such texts decode to spaces; very long texts are
encoded whole, like any other; a null id is carried through; repeated rows give repeated rows, equal rows equal ones;
an empty table gives an empty table; columns of other names are not read, whatever they are called.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_for

SPACE = "▁"
#: Characters of a word whose boundaries fit into the bits of a long; longer ones keep an array.
BITS = 61
LONGEST = 1000
#: Bytes of text in a batch, and for each bucket of words.
BATCH_BYTES = 24 << 20
BUCKET_BYTES = 4 << 20
#: Texts that are unpacked at a time.
ROWS = 500
#: Partitions of buckets, where the session asks for fewer; the lattice is many times what is read, so they stay small.
PARTITIONS = 2048
_CUT = re.compile(f"[\n\t]|{SPACE}*[^{SPACE}\n\t]+|{SPACE}+")


@dataclass
class Pieces:
    """The parts of a model that encoding needs."""

    kind: str  # "bpe" or "unigram"
    names: list[str]
    ids: dict[str, int]  # pieces that text can match
    scores: list[float]
    bytes_: list[int]  # id of each byte piece, or empty
    unknown: int
    dummy_prefix: bool
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ids))


def load(path: str | None = None, *, proto: bytes | None = None) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    if proto is None:
        with open(path, "rb") as f:
            proto = f.read()
    m.ParseFromString(proto)
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation and leading space marks are supported")
    kinds = {1: "unigram", 2: "bpe"}
    if m.trainer_spec.model_type not in kinds:
        raise ValueError("unigram and bpe models are supported")
    normal, user, byte, unknown = 1, 4, 6, 2
    ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (normal, user)}
    crossing = [p for p in ids if SPACE in p.lstrip(SPACE) or (len(p) > 1 and re.search("[\n\t]", p))]
    if crossing:
        raise ValueError(f"pieces cross words: {crossing[:3]}")
    return Pieces(
        kinds[m.trainer_spec.model_type],
        [p.piece for p in m.pieces],
        ids,
        [p.score for p in m.pieces],
        [i for i, p in enumerate(m.pieces) if p.type == byte],
        next(i for i, p in enumerate(m.pieces) if p.type == unknown),
        m.normalizer_spec.add_dummy_prefix,
    )


def spaced(text: str, dummy_prefix: bool) -> str:
    """The words of a text with spaces between; there may be empty ones among them, and none has a space."""
    if not text:
        return ""
    if "  " in text or SPACE in text or (dummy_prefix and text[0] == " "):
        return " ".join(_CUT.findall((SPACE if dummy_prefix else "") + text.replace(" ", SPACE)))
    # Single spaces only: each ends a word and marks the next.
    marked = (SPACE if dummy_prefix else "") + text.replace(" ", " " + SPACE)
    if "\n" in marked:
        marked = marked.replace("\n", " \n ")
    if "\t" in marked:
        marked = marked.replace("\t", " \t ")
    return marked


def words_of(text: str, dummy_prefix: bool) -> list[str]:
    """The words of a text; there may be empty ones among them."""
    return spaced(text, dummy_prefix).split(" ") if text else []


# ---- the lattice in Spark ----


def lattice(words: DataFrame, pieces: Pieces, word: str = "word") -> DataFrame:
    """The columns of some distinct words of at most ``LONGEST`` characters, and ``edges``: the pieces inside each.

    An edge is ``(rank, s, t)`` for merges, in order, and ``(t, s, cost)`` for paths.  The words may be grouped by any
    column of theirs: rows stay where they are.
    """
    spark, bpe = words.sparkSession, pieces.kind == "bpe"
    least = 2 if bpe else 1
    ranks = {x: r for r, x in enumerate(sorted({pieces.scores[i] for i in pieces.ids.values()}, reverse=True))}
    rows = [(p, ranks[pieces.scores[i]], -float(pieces.scores[i])) for p, i in pieces.ids.items() if len(p) >= least]
    table = spark.createDataFrame([*rows, ("", -1, 0.0)], "piece string, rank long, cost double")
    # Sizes of three characters and more are tried only where some piece of that size starts with the same three.
    short = list(range(least, 3))
    by_head: dict[str, set[int]] = defaultdict(lambda: set(short))
    for p, *_ in rows:
        if len(p) > 2:
            by_head[p[:3]].add(len(p))
    heads = spark.createDataFrame([(h, sorted(n)) for h, n in by_head.items()], "head string, sizes array<int>")
    w, n, keys = F.col(word), F.length(word), words.columns
    spots = words.select(*keys, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - least))).alias("s"))
    spots = spots.withColumn("head", F.substring(w, F.col("s") + 1, F.lit(3))).join(F.broadcast(heads), "head", "left")  # bounded by the vocabulary of the model
    sizes = F.coalesce("sizes", F.array(*map(F.lit, short)).cast("array<int>"))
    # The empty string at the start of each word is in the table too, so that no word is lost.
    spans = spots.select(*keys, "s", F.explode(F.when(F.col("s") == 0, F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes)).alias("size"))
    spans = spans.where(F.col("size") <= n - F.col("s")).withColumn("piece", F.substring(w, F.col("s") + 1, F.col("size")))
    hit = spans.join(F.broadcast(table), "piece")  # the vocabulary of the model
    s, t = F.col("s"), F.col("s") + F.col("size")
    # A long sorts faster than a struct; places are below 2**20 here.
    edge = F.shiftleft("rank", 40).bitwiseOR(F.shiftleft(s.cast("long"), 20)).bitwiseOR(t.cast("long")) if bpe else F.struct(t.alias("t"), s.alias("s"), "cost")
    grouped = hit.withColumn("wh", F.xxhash64(w)).groupBy("wh", *keys).agg(F.sort_array(F.collect_list(edge)).alias("e"))
    real = F.filter("e", lambda e: (e >= 0) if bpe else (e["t"] > e["s"]))
    return grouped.select(*keys, real.alias("edges"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _edge(e: Column) -> tuple[Column, Column]:
    low = F.lit((1 << 20) - 1).cast("long")
    return F.shiftright(e, 20).bitwiseAND(low).cast("int"), e.bitwiseAND(low).cast("int")


def _merged_bits(n: Column) -> Column:
    """Ends of the pieces after all merges; boundaries are the bits of a long."""

    def span(e: Column) -> Column:
        s, t = _edge(e)
        return F.struct((_bit(s) + _bit(t)).alias("ends"), (_bit(t + 1) - _bit(s)).alias("span"))

    def step(state: Column, _: Column) -> Column:
        mask, edges = state["mask"], state["edges"]
        pick = F.get(F.filter(edges, lambda e: F.bit_count(mask.bitwiseAND(e["span"])) == 3), 0)
        after = _let(pick, lambda p: F.coalesce(mask - mask.bitwiseAND(p["span"]) + p["ends"], mask))
        # An edge whose ends are no boundaries any more, or that is a piece now, is done with.
        alive = lambda m: F.filter(edges, lambda e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (m.bitwiseAND(e["span"]) != e["ends"]))
        return _let(after, lambda m: F.struct(m.alias("mask"), alive(m).alias("edges")))

    start = F.struct((_bit(n + 1) - 1).alias("mask"), F.transform("edges", span).alias("edges"))
    ends = lambda mask: F.filter(F.sequence(F.lit(1), n), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return F.when(F.size("edges") > 0, F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda x: _let(x["mask"], ends))).otherwise(F.sequence(F.lit(1), n))


def _merged_array(n: Column) -> Column:
    """The same with an array: at each place the end of the piece that starts there, or 0."""

    def span(e: Column) -> Column:
        s, t = _edge(e)
        return F.struct(s.alias("s"), t.alias("t"))

    def step(state: Column, _: Column) -> Column:
        ends, edges = state["ends"], state["edges"]
        able = lambda e: (F.get(ends, e["s"]) > 0) & (F.get(ends, F.get(ends, e["s"])) == e["t"])
        pick = F.get(F.filter(edges, able), 0)
        joined = lambda p: F.transform(ends, lambda x, i: F.when(i == p["s"], p["t"]).when(i == F.get(ends, p["s"]), 0).otherwise(x))
        after = _let(pick, lambda p: F.when(p.isNull(), ends).otherwise(joined(p)))
        alive = lambda m: F.filter(edges, lambda e: (F.get(m, e["s"]) > 0) & (F.get(m, e["s"]) < e["t"]))
        return _let(after, lambda m: F.struct(m.alias("ends"), alive(m).alias("edges")))

    start = F.struct(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, i + 1).otherwise(0)).alias("ends"), F.transform("edges", span).alias("edges"))
    return F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda x: F.filter(x["ends"], lambda e: e > 0))


def _best_path_ends(n: Column, unknown_cost: float) -> Column:
    """Ends of the pieces of the best path: for each place the least cost so far and the ends that lead there."""
    state = lambda cost, ends: F.struct(cost.cast("double").alias("cost"), ends.cast("array<int>").alias("ends"))

    def step(best: Column, t: Column) -> Column:
        here = F.filter(F.col("edges"), lambda e: e["t"] == t)
        ways = F.transform(here, lambda e: F.struct((F.get(best, e["s"])["cost"] + e["cost"]).alias("cost"), e["s"].alias("s")))
        # A character that is no piece costs more than any piece.
        alone = F.when(~F.exists(here, lambda e: e["s"] == t - 1), F.struct((F.get(best, t - 1)["cost"] + unknown_cost).alias("cost"), (t - 1).alias("s")))
        won = F.array_min(F.filter(F.concat(ways, F.array(alone)), lambda x: x.isNotNull()))
        return _let(won, lambda x: F.concat(best, F.array(state(x["cost"], F.concat(F.get(best, x["s"])["ends"], F.array(t))))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), F.array(state(F.lit(0.0), F.array())), step), -1)["ends"]


def fold(edges: DataFrame, pieces: Pieces, word: str = "word") -> DataFrame:
    """The columns before ``edges``, and ``ends``: where the pieces of each word end."""
    n = F.length(word)
    if pieces.kind == "bpe":
        ends = F.when(n <= BITS, _merged_bits(n)).otherwise(_merged_array(n))
    else:
        ends = _best_path_ends(n, -_unknown_score(pieces))
    return edges.select(*edges.columns[:-1], ends.alias("ends"))


def encode_words(words: DataFrame, pieces: Pieces, word: str = "word") -> DataFrame:
    """``word, ids`` for distinct words."""
    short = fold(lattice(words.where(F.length(word) <= LONGEST), pieces, word), pieces, word)
    rest = words.where(F.length(word) > LONGEST).select(word, F.lit(None).cast("array<int>").alias("ends"))

    def ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            got = [ids_of(w, e, pieces) for w, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32()))], names=[word, "ids"])

    return short.select(word, "ends").unionByName(rest).mapInArrow(ids, f"`{word}` string, ids array<int>")


def _unknown_score(pieces: Pieces) -> float:
    return min(pieces.scores[i] for i in pieces.ids.values()) - 10.0


def ids_of(word: str, ends, pieces: Pieces) -> list[int]:
    """Ids of the pieces that end at the given places; without places (a very long word) they are found here."""
    if ends is None:
        parts = _merges(word, pieces) if pieces.kind == "bpe" else _best_path(word, pieces)
    else:
        at, parts = 0, []
        for t in ends:
            parts.append(word[at:t])
            at = t
    out: list[int] = []
    for p in parts:
        i = pieces.ids.get(p)
        if i is not None:
            out.append(i)
        elif pieces.bytes_:
            out.extend(pieces.bytes_[b] for b in p.encode("utf-8", "replace"))
        else:
            out.append(pieces.unknown)
    return out


def _merges(word: str, pieces: Pieces) -> list[str]:
    """The merges of a very long word with a heap: n log n."""
    import heapq

    parts: list[str | None] = list(word)
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0:
            pair = parts[i] + parts[right[i]]
            if (k := pieces.ids.get(pair)) is not None:
                heapq.heappush(heap, (-pieces.scores[k], i, pair))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], right[i] = pair, None, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [p for p in parts if p is not None]


def _best_path(word: str, pieces: Pieces) -> list[str]:
    cost, back, alone = [0.0], [0], -_unknown_score(pieces)
    for t in range(1, len(word) + 1):
        ways = [(cost[s] - pieces.scores[k], s) for s in range(max(0, t - pieces.longest), t) if (k := pieces.ids.get(word[s:t])) is not None]
        if word[t - 1] not in pieces.ids:
            ways.append((cost[t - 1] + alone, t - 1))
        c, s = min(ways)
        cost.append(c)
        back.append(s)
    out, t = [], len(word)
    while t:
        out.append(word[back[t] : t])
        t = back[t]
    return out[::-1]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.names = [p.replace(SPACE, " ").encode() for p in pieces.names]
        for i, p in enumerate(pieces.names):
            if re.fullmatch("<0x[0-9A-F]{2}>", p):
                self.names[i] = bytes([int(p[3:5], 16)])
        self.dummy = pieces.dummy_prefix

    def decode(self, ids) -> str:
        raw = b"".join(map(self.names.__getitem__, ids))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


# ---- batches of texts and buckets of words ----


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _dealt(batches: int):
    """Rows of id and text -> batch, id and the compressed text; the batch follows from both."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in rows:
            for a in range(0, part.num_rows, ROWS):
                own = part.slice(a, ROWS)
                texts = [(t or "").encode("utf-8", "replace") for t in own.column(1).to_pylist()]
                keys = [xxhash.xxh64_intdigest(t, seed=zlib.crc32(str(i).encode())) % batches for i, t in zip(own.column(0).to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), own.column(0), pa.array(list(map(_zip, texts)), pa.binary())], names=["batch", "id", "raw"])

    return run


def _release() -> None:
    """A worker keeps what it has freed, and is idle beside the lattice for long: give it back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _numbered(column: pa.ChunkedArray, dummy_prefix: bool) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Where the words of each text end, the number of each word, and the different words by number.

    Some texts at a time are unpacked and cut, since strings and words of a whole batch are many times its bytes.
    """
    _release()  # the batch before
    counts, parts = [np.zeros(0, np.int64)], [pa.array([], pa.large_string()).dictionary_encode()]
    for a in range(0, len(column), ROWS):
        texts = pa.array([spaced(_unzip(raw.as_py()).decode(), dummy_prefix) for raw in column[a : a + ROWS]], pa.large_string())
        split = pc.split_pattern(texts, " ")
        counts.append(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        parts.append(split.flatten().dictionary_encode())
    words = pa.chunked_array(parts).unify_dictionaries()
    del parts
    numbers, names = np.concatenate([x.indices.to_numpy() for x in words.chunks]), words.chunk(0).dictionary
    del words
    _release()
    return np.cumsum(np.concatenate(counts)), numbers, names


def _by_bucket(words: pa.LargeStringArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words that aren't empty by bucket, in the order of their bytes, and the bucket of each."""
    raw = words.cast(pa.large_binary())
    bucket = np.fromiter((zlib.crc32(w) for a in range(0, len(raw), 10_000) for w in raw[a : a + 10_000].to_pylist()), np.int64, len(raw)) % buckets
    order = pc.sort_indices(raw).to_numpy()
    order = order[pc.binary_length(raw).to_numpy()[order] > 0]
    order = order[np.argsort(bucket[order], kind="stable")]
    return order, bucket[order]


def _asked(buckets: int, dummy_prefix: bool):
    """Batch of texts -> a row per bucket: the batch and its different words of the bucket, with spaces between."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *_, words = _numbered(table["raw"], dummy_prefix)
        order, bucket = _by_bucket(words, buckets)
        own, at = np.unique(bucket, return_index=True)
        dealt, ends = words.take(pa.array(order)), [*at[1:].tolist(), len(order)]
        batch = str(key[0].as_py())
        rows = [" ".join([batch, *dealt[a:b].to_pylist()]) for a, b in zip(at.tolist(), ends, strict=True)] if len(order) else []
        out = pa.table({"bucket": pa.array(own, pa.int32()), "words": pa.array(rows, pa.string())})
        del words, dealt, rows
        _release()
        return out

    return run


def _answered(pieces):
    """Bucket of requests and folded words -> for each batch the ids of its words, in the order in which it asked."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        own = pieces.value
        known = {w: np.array(ids_of(w, e, own), np.int32).tobytes() for w, e in zip(right["word"].to_pylist(), right["ends"].to_pylist(), strict=True)}
        out = {"batch": [], "bucket": [], "sizes": [], "ids": []}
        for asked in left["words"]:
            batch, *words = asked.as_py().split(" ")
            ids = [known[w] if w in known else np.array(ids_of(w, None, own), np.int32).tobytes() for w in words]
            out["batch"].append(int(batch))
            out["bucket"].append(key[0].as_py())
            out["sizes"].append(_zip(np.array(list(map(len, ids)), np.int32).tobytes()))
            out["ids"].append(_zip(b"".join(ids)))
        table = pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})
        del known, out
        _release()
        return table

    return run


def _encoded(pieces, buckets: int, id_type: pa.DataType, id_col: str):
    """Batch of texts and the ids of its words -> the rows of the result."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        own = pieces.value
        names = pa.array(Decoder(own).names, pa.large_binary())
        ends, numbers, words = _numbered(left["raw"], own.dummy_prefix)
        order, _ = _by_bucket(words, buckets)
        # Answers in order of buckets are the words in order; each word's ids are a stretch of them.
        answers = sorted(zip(right["bucket"].to_pylist(), right["sizes"].to_pylist(), right["ids"].to_pylist(), strict=True))
        each = np.frombuffer(b"".join(_unzip(x) for _, x, _ in answers), np.int32) // 4
        flat = np.frombuffer(b"".join(_unzip(x) for *_, x in answers), np.int32)
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[order], starts[order] = each, np.cumsum(each) - each
        parts = []
        for a in range(0, left.num_rows, ROWS):
            rows = left.slice(a, ROWS)
            raw = [_unzip(x.as_py()) for x in rows["raw"]]
            stops = ends[a : a + ROWS] - (first := ends[a - 1] if a else 0)
            w = numbers[first : first + stops[-1]]
            n = sizes[w]
            after = np.cumsum(n)
            ids = flat[np.repeat(starts[w] - after + n, n) + np.arange(after[-1])]
            at = np.array([0, *after[stops - 1]], np.int32)
            back = names.take(pa.array(ids))
            places = np.frombuffer(back.buffers()[1], np.int64)[at].tolist() if len(ids) else at.tolist()
            whole = back.buffers()[2].to_pybytes() if len(ids) else b""
            decoded = [whole[i + (own.dummy_prefix and whole[i:j][:1] == b" ") : j] for i, j in zip(places, places[1:], strict=False)]
            columns = [
                rows["id"].combine_chunks(),
                pa.array([len(x) for x in raw], pa.int64()),
                pa.array(np.diff(at).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(at), pa.array(ids)),
                pa.array([x == t or x.decode("utf-8", "replace") == t.decode() for x, t in zip(decoded, raw, strict=True)], pa.bool_()),
            ]
            parts.append(pa.table(columns, names=[id_col, "n_bytes", "n_tokens", "ids", "round_trip"]))
        del ends, numbers, words, order, answers, each, flat, sizes, starts
        _release()
        if parts:
            return pa.concat_tables(parts)
        kinds = [id_type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]
        return pa.table([pa.array([], k) for k in kinds], names=[id_col, "n_bytes", "n_tokens", "ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id_col, n_bytes, n_tokens, ids, round_trip`` of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = docs.sparkSession
    pieces = load(path)
    shared = spark.sparkContext.broadcast(pieces)  # the model
    batches = batches_for(docs, F.octet_length(text_col), batch_bytes)
    buckets = max(1, batches * batch_bytes // bucket_bytes)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(id_col, text_col).mapInArrow(_dealt(batches), f"batch int, id {id_type.simpleString()}, raw binary")
    asked = texts.groupBy("batch").applyInArrow(_asked(buckets, pieces.dummy_prefix), "bucket int, words string")
    asked = asked.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, PARTITIONS)), "bucket")
    words = asked.select("bucket", F.explode(F.split(F.expr("substring(words, instr(words, ' ') + 1)"), " ")).alias("word"))  # the batch comes first
    # All of this stays within the buckets.
    folded = fold(lattice(words.where(F.length("word") <= LONGEST).distinct(), pieces), pieces)
    folded = folded.select(F.col("bucket").alias("place"), "word", "ends")
    answers = asked.groupBy("bucket").cogroup(folded.groupBy("place")).applyInArrow(_answered(shared), "batch int, bucket int, sizes binary, ids binary")
    out = f"`{id_col}` {id_type.simpleString()}, n_bytes long, n_tokens long, ids array<int>, round_trip boolean"
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_encoded(shared, buckets, to_arrow_type(id_type), id_col), out)


def decode_documents(encoded: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of each array of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        d = Decoder(shared.value)
        return pd.Series([None if i is None else d.decode(i) for i in ids], dtype=object)

    return encoded.withColumn(out_col, decode(F.col(ids_col)))
