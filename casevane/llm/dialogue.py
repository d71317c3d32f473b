"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed, and no state of the product is built before it is reached:

* the *input acceptor*, a chain with one arc for each row of a conversation, in order;
* the *edit transducer*: keep (cost 0, label K), rerole to user or assistant (1, R), delete (2, D) and insert an empty
  turn of user or assistant (5, I, reads nothing); blank and repeated rows may only be deleted; a truncated row that
  stays costs 5 more;
* the *role grammar* over initials of roles, ``(s?(ua)+)?``, four states.

A weight is the pair (cost, label string), least first by cost and then by ASCII.  States are visited in topological
order: by position and, at one position, by inserts.  Of each state only the least weight is kept, which is exact: two
label strings that read the same rows and end with a row's label are never prefixes of one another, so what follows
cannot change their order.  That also lets strings be compared by the rank of the state they come from.  A label string
fixes the output roles, so each state carries the digest of its output, and no row is looked at twice.

Spark deals the rows: equal rows of a conversation are counted, a window over (conversation, role, text) marks all but the
first of equal rows, and one shuffle brings each conversation in order to one task, which streams it: the task keeps
four states, not the rows.  (The digest over a whole conversation is sequential, whatever its length.)

Edge cases: null role or text is one space, hence an initial outside the grammar or a blank row; a null ``turn`` sorts
first and has no part in gaps; a null ``conv_id`` is a conversation of its own; rows of one turn are in order of role,
then text, equal rows adjacent; an empty role has no initial: kept, it reads as nothing; a conversation without rows
after damage has zeros, an empty audit and the digest of nothing; very long texts and conversations are streamed; an
empty table gives an empty table; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The role grammar: state -> initial -> next state; a conversation may end in ENDS.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLES = ("user", "assistant")
LEGAL = ("su", "ua", "au")
#: The longest useful run of inserts: no state of the grammar comes twice.
RUN = len(GRAMMAR)

BLANK, REPEATED, CUT = 1, 2, 3
_STRIP = " \t\n\x0b\x0c\r"


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a row: blank, seen earlier, truncated; 0 without one."""
    body = text.rstrip(_STRIP)
    return BLANK if not body else REPEATED if seen else CUT if body[-1] not in ".!?" else 0


@dataclass(slots=True)
class _Path:
    """The least weight that reaches a state: cost, rank among the states at this position, labels and output."""

    cost: int
    rank: int
    base: tuple | None  # (strings before, a string of labels)
    labels: tuple | None  # (labels before, last labels), since base
    digest: object
    lines: int


def _edits(initial: str, fault: int) -> Iterator[tuple[int, str, str | None]]:
    """Arcs of the edit transducer that read one row: (cost, label, output role; '' is the row's own, None nothing)."""
    yield DELETE, "D", None
    if fault not in (BLANK, REPEATED):
        more = TRUNCATED if fault == CUT else 0
        yield KEEP + more, "K", ""
        for role in ROLES:
            yield REROLE + more, "R", role


def _inserted(state: int) -> Iterator[tuple[int, tuple[str, ...]]]:
    """States reached by inserts alone, in order of their number, with the roles inserted."""
    front, met = [(state, ())], {state}
    while front:
        yield from front
        after = []
        for s, roles in front:
            for role in ROLES:
                t = GRAMMAR[s].get(role[0])
                if t is not None and t not in met and len(roles) < RUN:
                    met.add(t)
                    after.append((t, (*roles, role)))
        front = after


_INSERTED = {s: tuple(_inserted(s)) for s in GRAMMAR}


def _told(node: tuple | None) -> list[str]:
    out = []
    while node is not None:
        out.append(node[1])
        node = node[0]
    return out[::-1]


@dataclass
class Repair:
    """Shortest path through the composition, fed row by row."""

    at: dict[int, _Path] = field(default_factory=lambda: {0: _Path(0, 0, None, None, hashlib.sha256(), 0)})
    rows: int = 0

    def read(self, role: str, text: str, fault: int) -> None:
        """One arc of the input acceptor."""
        best: dict[int, tuple] = {}
        own = role[:1]
        arcs = tuple(_edits(own, fault))
        for state, path in self.at.items():
            for middle, inserted in _INSERTED[state]:
                before = path.cost + INSERT * len(inserted)
                for cost, label, out in arcs:
                    initial = "" if out is None else out[0] if out else own
                    target = middle if initial == "" else GRAMMAR[middle].get(initial)
                    if target is None:
                        continue
                    weight = (before + cost, path.rank, "I" * len(inserted) + label)
                    if target not in best or weight < best[target][0]:
                        best[target] = (weight, path, inserted, None if out is None else out or role)
        order = {w: n for n, w in enumerate(sorted(b[0][1:] for b in best.values()))}
        self.at = {}
        for state, ((cost, *string), path, inserted, out) in best.items():
            lines = [f"{r}:" for r in inserted] + ([] if out is None else [f"{out}:{text}"])
            digest, n = path.digest, path.lines
            if lines:
                digest = digest.copy()
                digest.update((("\n" if n else "") + "\n".join(lines)).encode("utf-8", "replace"))
                n += len(lines)
            self.at[state] = _Path(cost, order[tuple(string)], path.base, (path.labels, string[1]), digest, n)
        self.rows += 1
        if self.rows % 4096 == 0:
            self._settle()

    def _settle(self) -> None:
        """The labels since the last call become one string a state: a byte a row."""
        for path in self.at.values():
            path.base, path.labels = (path.base, "".join(_told(path.labels))), None

    def finish(self) -> tuple[int, str, str]:
        """Cost, label string and digest of the cheapest path to an end of the grammar."""
        best = None
        for state, path in self.at.items():
            for middle, inserted in _INSERTED[state]:
                weight = (path.cost + INSERT * len(inserted), path.rank, "I" * len(inserted))
                if middle in ENDS and (best is None or weight < best[0]):
                    best = (weight, path, inserted)
        (cost, _, last), path, inserted = best
        digest = path.digest.copy()
        if inserted:
            digest.update((("\n" if path.lines else "") + "\n".join(f"{r}:" for r in inserted)).encode())
        return cost, "".join([*_told(path.base), *_told(path.labels), last]), digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that a checksum of conversation and turn deals out: 0 drops
    the row (no copies), 1 empties the text, 2 takes out ``[.!?]``, 3 doubles it, 4 makes it the user's."""
    space = F.lit(" ")
    told = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("fate"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _stream(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order -> one row each."""
    done: list[list] = [[] for _ in out]
    key = run = None

    def close() -> None:
        cost, audit, digest = run["repair"].finish()
        turns = run["last"] - run["first"] + 1 - run["turns"] if run["turns"] else 0
        for column, v in zip(done, (key, turns, run["n"][BLANK], run["n"][REPEATED], run["n"][CUT], run["illegal"], cost, audit, digest), strict=True):
            column.append(v)

    def batch() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, out, strict=True)], schema=out)
        for c in done:
            c.clear()
        return rows

    for rows in batches:
        for conv, turn, role, text, copies, first in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if run is None or conv != key:
                if run is not None:
                    close()
                key, run = conv, {"repair": Repair(), "n": [0] * 4, "illegal": 0, "before": None, "turns": 0, "first": None, "last": None}
            if not copies:
                continue
            if turn is not None and turn != run["last"]:
                run["turns"] += 1
                run["first"] = turn if run["first"] is None else run["first"]
                run["last"] = turn
            for k in range(copies):
                fault = fault_of(text, k > 0 or not first)
                run["n"][fault] += 1
                if run["before"] is not None and run["before"] + role[:1] not in LEGAL:
                    run["illegal"] += 1
                run["before"] = role[:1]
                run["repair"].read(role, text, fault)
        if len(done[0]) >= 1000:
            yield batch()
    if run is not None:
        close()
    if done[0]:
        yield batch()


def repair(rows: DataFrame, *, copies: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    ``copies`` says how often a row stands there; a row with 0 keeps its conversation in the result and nothing else.
    """
    space = F.lit(" ")
    key = rows.schema["conv_id"].dataType
    counted = (
        rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
        .withColumn("gone", F.col("copies") == 0)
        .select("conv_id", "copies", "gone", *(F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")))
        .groupBy("conv_id", "gone", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
    )
    # Blank rows need no look at earlier ones: only the others meet under their conversation, role and text.
    spread = F.when(F.col("gone") | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("turn"))
    equal = Window.partitionBy("conv_id", "role", F.sha2("text", 256), spread).orderBy(F.asc_nulls_first("turn"))
    marked = counted.withColumn("first", F.row_number().over(equal) == 1)
    ordered = marked.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("gone"), F.asc_nulls_first("turn"), "role", "text")
    longs = [pa.field(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = pa.schema([pa.field("conv_id", to_arrow_type(key)), *longs, pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
    names = ", ".join(f"{f.name} long" for f in longs)
    return ordered.select("conv_id", "turn", "role", "text", "copies", "first").mapInArrow(lambda b: _stream(b, out), f"conv_id {key.simpleString()}, {names}, audit string, repaired_sha256 string")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``repair`` of conversations after ``damage``; every conversation of the input has its row."""
    return repair(damage(rows), copies=F.col("copies"))
