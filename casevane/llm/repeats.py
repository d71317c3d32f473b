"""Removal of repeated passages by prefix-free parsing.

A byte is removed when a string of ``match`` bytes that covers it also starts in a text with a smaller id.

*Parse.* A trigger is the position whose rolling hash of ``GRAM`` bytes is the least within some window of ``match``
bytes.  Triggers cut each text into phrases: the run of windows that share a trigger, so that neighbours overlap by
``match - 1`` bytes and every window lies in exactly one phrase.  Triggers depend on a window's own bytes only, hence
equal windows have equal triggers at equal places, wherever they occur.

*Dictionary.* Phrases whose trigger occurs in one text only can't hold a repeated window; the triggers alone (8 bytes
for about 17 of text, each once per batch of texts) are shuffled to find that out.  The other phrases, each once per
batch and with its least id, meet by trigger.  Each meeting place builds the suffix array of its part of the
dictionary: all suffixes of at least ``match`` bytes in the order of their first ``match`` bytes (a
suffix is never compared further).  Neighbours with a common prefix of ``match`` bytes form a run.

*Combination.* The suffix array of the parse (occurrences by phrase, then by text) says which texts have a phrase, the
first of them first.  Combined with the dictionary's runs it gives the windows of the corpus in order, by bytes and then
by text; the first text of a run is all that is needed, and only that is taken.  Where it is below a text's own id, the
window's bytes go from that text.

Shuffles: the texts once (the three passes over them reuse one exchange), triggers, the suspicious phrases, and the
answers.  Equal texts are met as hashes before the texts are shuffled; a trigger that very many texts share sends its
windows one by one, dealt by the window's own hash, so that no key gathers its neighbours in one task.  A batch sends a
phrase once, so a window that every text has is one row of 75 bytes per batch in its task; batches grow with the root of
the input (from ``BATCH_BYTES`` to ``LARGEST_BATCH``), which keeps rows between batches and buckets in proportion.

Edge cases: null text is empty; texts shorter than ``match`` lose nothing; rows with one id don't remove each other's
bytes unless a smaller id has them; of equal texts the smallest id is judged against other texts and the rest lose
everything; a null id counts as larger than all others; very long texts are parsed in parts that overlap, with the same
result; repeated rows are judged each, equal rows alike; an empty table gives an empty table; columns of other names
are not read (``remove_repeats`` carries them along), whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_for, whole

MATCH = 50
GRAM = 16
BATCH_BYTES = 4 << 20
LARGEST_BATCH = 32 << 20
#: Bytes of text behind a bucket of triggers, and behind one of phrases.
TRIGGER_BYTES = 16 << 20
PHRASE_BYTES = 2 << 20
CHUNK = 1 << 16
#: Texts that share a trigger, by estimate, from which its windows travel one by one.
HOT = 4096
LARGEST = (1 << 63) - 1

_MASK = (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 18)}
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _MIX2
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


_CODES = _byte_codes()


def rolling(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Polynomial hashes modulo 2**64 of the strings of 1, 2, 4 ... ``upto`` bytes at each place, by doubling."""
    h, n = {1: _CODES[data]}, 1
    while n < upto:
        a = h[n]
        out = a[:-n] * _POWERS[n]
        out += a[n:]
        h[2 * n] = out
        n *= 2
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x


def _named(least: np.ndarray) -> np.ndarray:
    """Names of triggers.  A trigger's hash is a minimum, hence small; its name is spread evenly over the buckets."""
    x = least * _MIX2
    x ^= x >> np.uint64(29)
    return _mixed(x)


def window_hash(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hash of the 50 bytes at each given place."""
    x = h[32][at] * _POWERS[16]
    x += h[16][at + 32]
    x *= _POWERS[2]
    x += h[2][at + 48]
    return _mixed(x)


class Phrases:
    """The parse of some texts: arrays with an entry for each phrase."""

    def __init__(self, doc, start, windows, trigger, data, at, hashes):
        self.doc, self.start, self.windows, self.trigger, self.data, self.at, self.hashes = doc, start, windows, trigger, data, at, hashes

    def keys(self, which=slice(None)) -> np.ndarray:
        """64-bit names of phrases: their first and last window cover them."""
        at, more = self.at[which], self.windows[which] - 1
        x = window_hash(self.hashes, at) * _MIX2
        x ^= window_hash(self.hashes, at + more)
        return _mixed(x + more.astype(np.uint64))

    def split(self, which: np.ndarray) -> Phrases:
        """Those phrases as phrases of one window each."""
        n = self.windows[which]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rep = lambda a: np.repeat(a[which], n)
        return Phrases(rep(self.doc), rep(self.start) + inside, np.ones(len(inside), np.int64), rep(self.trigger), self.data, rep(self.at) + inside, self.hashes)

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases(self.doc[which], self.start[which], self.windows[which], self.trigger[which], self.data, self.at[which], self.hashes)


def parse(texts: list[bytes], named: bool = True, chunk: int = CHUNK) -> Iterator[Phrases]:
    """Phrases of whole texts, some tens of KB at a time; very long texts go in parts that overlap."""
    part, room = [], 0
    for d, text in enumerate(texts):
        n = len(text) - MATCH + 1
        for a in range(0, n, chunk):
            w = min(chunk, n - a)
            if part and room + w > chunk:
                yield _parse_part(texts, part, named)
                part, room = [], 0
            part.append((d, a, w))
            room += w
    if part:
        yield _parse_part(texts, part, named)


def _parse_part(texts: list[bytes], part: list[tuple[int, int, int]], named: bool) -> Phrases:
    data = np.frombuffer(b"".join([texts[d][a : a + w + MATCH - 1] for d, a, w in part]), np.uint8)
    docs, starts, counts = (np.array(x, np.int64) for x in zip(*part, strict=True))
    ends = np.cumsum(counts + MATCH - 1)
    h = rolling(data, 32 if named else GRAM)
    gram = _mixed(h[GRAM])
    key = gram & _HIGH
    key |= np.arange(len(key), dtype=np.uint64)
    reach, n = MATCH - GRAM + 1, 1
    while 2 * n <= reach:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < reach:
        key = np.minimum(key[: len(key) - (reach - n)], key[reach - n :])
    valid = np.ones(len(key), bool)
    valid[(ends[:-1, None] - np.arange(1, MATCH)).ravel()] = False
    at = np.flatnonzero(valid)
    trigger = (key[at] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
    windows = np.diff(np.append(first, len(at)))
    at = at[first]
    piece = np.searchsorted(ends, at, side="right")
    return Phrases(docs[piece], at - (ends - counts - MATCH + 1)[piece] + starts[piece], windows, _named(gram[trigger[first]]), data, at, h)


def _distinct(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """The different texts of a batch in the order of their hashes, with the least id of each."""
    ids: dict[bytes, int] = {}
    texts: dict[bytes, bytes] = {}
    for h, i, text in zip(table["h"].to_pylist(), table["id"].to_pylist(), table["text"].to_pylist(), strict=True):
        ids[h] = min(i, ids.get(h, i))
        if text is not None:
            texts[h] = text
    names = sorted(texts)
    return [texts[h] for h in names], np.array([ids[h] for h in names], np.int64), names


def _buckets(values: np.ndarray, count: int) -> np.ndarray:
    """Bucket of each 64-bit value: equal ranges, so sorted values have sorted buckets."""
    return ((values >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_groups):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])))
    return first, np.append(first[1:], len(sorted_groups))


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


def _triggers(count: int, chunk: int):
    """Batch of texts -> its triggers, once each; the two low bits say in how many of its texts, roughly."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts, _, _ = _distinct(table)
        got = [(p.trigger, p.doc) for p in parse(texts, False, chunk)]
        if not got:
            return pa.table({"bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        trigger, doc = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(trigger, kind="stable")  # within a trigger, texts stay in order
        trigger, doc = trigger[order], doc[order]
        start, end = _cuts(trigger)
        new = np.ones(len(doc), np.int64)
        new[1:] = (doc[1:] != doc[:-1]) | (trigger[1:] != trigger[:-1])
        n = np.add.reduceat(new, start)
        level = (n >= 2).astype(np.uint64) + (n >= 16).astype(np.uint64) + (n >= 256).astype(np.uint64)
        trigger = trigger[start]
        sent = (trigger & np.uint64(_MASK - 3)) | level
        bucket = _buckets(trigger, count)
        a, b = _cuts(bucket)
        return pa.table(
            {
                "bucket": pa.array(bucket[a], pa.int32()),
                "batch": pa.array([key[0].as_py()] * len(a), pa.int32()),
                "blob": pa.array([sent[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()),
            }
        )

    return run


def _repeated(hot: int):
    """Bucket of triggers -> for each batch those that occur in more than one text; bit 0 marks the hot ones."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in table["blob"].to_pylist()]
        sizes = np.array([len(x) for x in blobs])
        sent = np.concatenate(blobs)
        batch = np.repeat(np.array(table["batch"].to_pylist(), np.int64), sizes)
        name = sent & np.uint64(_MASK - 3)
        order = np.argsort(name, kind="stable")
        name, batch = name[order], batch[order]
        texts = np.array([1, 2, 16, 256])[(sent[order] & np.uint64(3)).astype(np.int64)]
        start, end = _cuts(name)
        total = np.add.reduceat(texts, start)
        total = np.repeat(total, end - start)
        keep = total >= 2
        name, batch = name[keep] | (total[keep] >= hot).astype(np.uint64), batch[keep]
        order = np.argsort(batch, kind="stable")
        name, batch = name[order], batch[order]
        a, b = _cuts(batch)
        return pa.table({"batch": pa.array(batch[a], pa.int32()), "blob": pa.array([name[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())})

    return run


def _find(sorted_names: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each name in a sorted array without repeats, and whether it is there."""
    if not len(sorted_names):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return at, sorted_names[at] == names


PHRASE_FIELDS = "bucket int, batch int, keys binary, low binary, high binary, sizes binary, bytes binary, hot binary"


def _suspects(count: int, chunk: int):
    """Batch of texts and its repeated triggers -> its suspicious phrases, once each, with least and largest id."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "batch", "keys", "low", "high", "sizes", "bytes", "hot")}
        texts, ids, _ = _distinct(left)
        known = np.sort(_joined(right["blob"], np.uint64))
        hot = known[(known & np.uint64(1)) == 1]
        known &= np.uint64(_MASK - 1)
        got = []
        for p in parse(texts, chunk=chunk):
            at, there = _find(known, p.trigger & np.uint64(_MASK - 3))
            if not there.any():
                continue
            p = p.take(np.flatnonzero(there))
            dealt = p.trigger
            if len(hot):
                _, is_hot = _find(hot & np.uint64(_MASK - 1), p.trigger & np.uint64(_MASK - 3))
                if is_hot.any():
                    one = p.split(np.flatnonzero(is_hot))
                    rest = p.take(np.flatnonzero(~is_hot))
                    got.append(_sent(one, ids, None))
                    p, dealt = rest, rest.trigger
            if len(p.doc):
                got.append(_sent(p, ids, dealt))
        if got:
            dealt, name, doc, n, data = (np.concatenate(x) for x in zip(*((g[0], g[1], g[2], g[3], g[4]) for g in got), strict=True))
            place = np.cumsum(n) - n
            order = np.lexsort((name, dealt))
            start, end = _cuts(name[order])  # a name has one trigger
            low, high = np.minimum.reduceat(doc[order], start), np.maximum.reduceat(doc[order], start)
            order = order[start]
            dealt, name, n, place = dealt[order], name[order], n[order], place[order]
            bucket = _buckets(dealt, count)
            for a, b in zip(*_cuts(bucket), strict=True):
                size, at = n[a:b], place[a:b]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                for k, v in zip(out, (int(bucket[a]), key[0].as_py(), name[a:b].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), size.astype(np.uint8).tobytes(), data[np.repeat(at, size) + inside].tobytes(), hot.tobytes() if a == 0 and len(hot) else None), strict=True):
                    out[k].append(v)
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return run


def _sent(p: Phrases, ids: np.ndarray, dealt: np.ndarray | None) -> tuple[np.ndarray, ...]:
    name = p.keys()
    size = p.windows + MATCH - 1
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return (name if dealt is None else dealt), name, ids[p.doc], size, p.data[np.repeat(p.at, size) + inside]


def dictionary_array(data: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the dictionary: the given suffixes in the order of their first ``MATCH`` bytes, and where the runs
    of suffixes begin that share all of them (a neighbour's common prefix of ``MATCH`` bytes or more).

    Sorted by the first 8 bytes at once, then by four more at a time among those still equal; the last step overlaps the
    one before.  ``data`` has 8 bytes or more after the last suffix.
    """
    raw = data.tobytes()
    key = np.ndarray((len(data) - 7,), ">u8", raw, strides=(1,))[suffix].astype(np.uint64)
    four = np.ndarray((len(data) - 3,), ">u4", raw, strides=(1,))
    order = np.argsort(key)
    first = _starts(key[order])
    for at in range(8, MATCH, 4):
        tied = np.flatnonzero(~first | ~np.append(first[1:], True))
        if not len(tied):
            break
        group = np.cumsum(first[tied], dtype=np.uint64) << np.uint64(32)
        key = group | four[suffix[order[tied]] + min(at, MATCH - 4)].astype(np.uint64)
        inner = np.argsort(key)
        order[tied] = order[tied[inner]]
        first[tied] = _starts(key[inner])
    return order, np.flatnonzero(first)


def _starts(key: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array differs from the one before."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


def parse_array(phrase: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the parse: the occurrences of phrases ordered by phrase, then by text, and where each phrase begins.

    It is truncated after one phrase: every window lies inside one, so what follows never decides.
    """
    order = np.lexsort((text, phrase))
    return order, _cuts(phrase[order])[0]


def corpus_order(data: np.ndarray, suffix: np.ndarray, owner: np.ndarray, phrase: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the corpus in order: (place in ``suffix``, occurrence of its phrase), by bytes and then by text."""
    order, start = dictionary_array(data, suffix)
    parse, _ = parse_array(phrase, text)
    begin, end = (np.searchsorted(phrase[parse], np.arange(owner.max() + 1), side) for side in ("left", "right"))
    many = (end - begin)[owner[order]]
    which = np.repeat(order, many)
    found = parse[np.repeat(begin[owner[order]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    run = np.repeat(np.cumsum(np.isin(np.arange(len(order)), start)), many)
    merged = np.lexsort((text[found], run))
    return which[merged], found[merged]


def _resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Bucket of phrases -> for each batch the windows of its phrases that a smaller id has."""
    name, low, high = _joined(table["keys"], np.uint64), _joined(table["low"], np.int64), _joined(table["high"], np.int64)
    size = _joined(table["sizes"], np.uint8).astype(np.int64)
    data = np.frombuffer(b"".join(table["bytes"].to_pylist()) + bytes(8), np.uint8)
    counts = np.array([len(x) // 8 for x in table["keys"].to_pylist()])
    batch = np.repeat(np.array(table["batch"].to_pylist(), np.int64), counts)
    place = np.cumsum(size) - size
    # The dictionary: each phrase once.
    name, sample, entry = np.unique(name, return_index=True, return_inverse=True)
    place, size = place[sample], size[sample]
    # The parse: an occurrence for each batch that has the phrase; its first is the one that counts.
    parse, head = parse_array(entry, low)
    least = low[parse[head]]
    begin = np.cumsum(size) - size
    data = np.append(data[np.repeat(place - begin, size) + np.arange(size.sum())], np.zeros(8, np.uint8))
    place = begin
    # Its suffixes of at least MATCH bytes.
    n = size - MATCH + 1
    base = np.cumsum(n) - n
    inside = np.arange(n.sum()) - np.repeat(base, n)
    suffix = np.repeat(place, n) + inside
    order, start = dictionary_array(data, suffix)
    owner = np.repeat(np.arange(len(n)), n)
    # Both together: in a run of equal windows, the first text that the parse has for any of its phrases.
    gained = np.minimum.reduceat(least[owner[order]], start)
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(gained, np.diff(np.append(start, len(order))))
    # Runs of windows of a phrase with one least id.
    first = np.ones(len(smallest), bool)
    first[1:] = (smallest[1:] != smallest[:-1]) | (owner[1:] != owner[:-1])
    seg = np.flatnonzero(first)
    seg_owner, seg_at, seg_id = owner[seg], inside[seg], smallest[seg]
    seg_n = np.diff(np.append(seg, len(smallest)))
    seg_first = np.searchsorted(seg_owner, np.arange(len(n)))
    seg_count = np.bincount(seg_owner, minlength=len(n))
    # Back to the batches.
    many = seg_count[entry]
    pick = np.repeat(seg_first[entry], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    to, top = np.repeat(batch, many), np.repeat(high, many)
    useful = seg_id[pick] < top
    pick, to = pick[useful], to[useful]
    order = np.argsort(to, kind="stable")
    pick, to = pick[order], to[order]
    out = {"batch": [], "keys": [], "at": [], "n": [], "ids": [], "hot": []}
    for a, b in zip(*_cuts(to), strict=True):
        s = pick[a:b]
        for k, v in zip(out, (int(to[a]), name[seg_owner[s]].tobytes(), seg_at[s].astype(np.uint8).tobytes(), seg_n[s].astype(np.uint8).tobytes(), seg_id[s].tobytes(), None), strict=True):
            out[k].append(v)
    for b, hot in zip(table["batch"].to_pylist(), table["hot"].to_pylist(), strict=True):
        if hot:
            for k, v in zip(out, (b, None, None, None, None, hot), strict=True):
                out[k].append(v)
    return pa.table({"batch": pa.array(out["batch"], pa.int32())} | {k: pa.array(out[k], pa.binary()) for k in list(out)[1:]})


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that touch or overlap."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def cut(text: bytes, starts, ends) -> bytes:
    """What is left of a text without the given runs."""
    at, kept = 0, []
    for a, b in zip(starts, ends, strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


SPANS = "h binary, least_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _apply(chunk: int):
    """Batch of texts and the answers for its phrases -> the removed runs of each text."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids, names = _distinct(left)
        phrase, at, n, least = (_joined(right[c], t) for c, t in (("keys", np.uint64), ("at", np.uint8), ("n", np.uint8), ("ids", np.int64)))
        order = np.argsort(phrase, kind="stable")
        phrase, at, n, least = phrase[order], at[order].astype(np.int64), n[order].astype(np.int64), least[order]
        start, end = _cuts(phrase)
        known = phrase[start]
        hot = np.unique(_joined(right["hot"], np.uint64)) & np.uint64(_MASK - 1)
        found = []

        def look(p: Phrases) -> None:
            place, there = _find(known, p.keys())
            which = np.flatnonzero(there)
            if not len(which):
                return
            a, many = start[place[which]], (end - start)[place[which]]
            seg = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            doc, begin = np.repeat(p.doc[which], many), np.repeat(p.start[which], many) + at[seg]
            go = least[seg] < ids[doc]
            found.append((doc[go], begin[go], (begin + n[seg] - 1 + MATCH)[go]))

        if len(known):
            for p in parse(texts, chunk=chunk):
                look(p)
                if len(hot):
                    _, is_hot = _find(hot, p.trigger & np.uint64(_MASK - 3))
                    if is_hot.any():
                        look(p.split(np.flatnonzero(is_hot)))
        doc, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(doc, kind="stable")
        doc, a, b = doc[order], a[order], b[order]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = {k: [] for k in ("h", "least_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends")}
        for i, text in enumerate(texts):
            s, e = _merge(a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]])
            s, e = s.tolist(), e.tolist()
            kept = hashlib.sha256(cut(text, s, e)).hexdigest() if s else names[i].hex()
            for k, v in zip(out, (names[i], int(ids[i]), len(text), sum(e) - sum(s), len(s), kept, s, e), strict=True):
                out[k].append(v)
        types = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return run


def _first_copies(count: int):
    """Partition of texts -> (batch, hash, id, text), the text only where the partition shows it first."""

    def part_of(rows: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
        out = ([], [], [], [])
        for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            if len(raw) < MATCH:
                continue
            h = hashlib.sha256(raw).digest()
            new = h not in seen
            seen.add(h)
            for o, v in zip(out, (int.from_bytes(h[:8], "little") % count, h, LARGEST if i is None else i, raw if new else None), strict=True):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["batch", "h", "id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows in batches:
            for a in range(0, rows.num_rows, 256):
                yield part_of(rows.slice(a, 256), seen)

    return run


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """A row for each different text of at least ``MATCH`` bytes: its hash, least id and removed runs.

    ``batch_bytes``: text in a batch; by default it follows from the input.
    """
    total = batches_for(docs, F.octet_length(text_col), 1)
    own = batch_bytes or min(LARGEST_BATCH, max(BATCH_BYTES, 2 * math.isqrt(total)))
    count, for_triggers, for_phrases = (max(1, -(-total // n)) for n in (own, *((TRIGGER_BYTES, PHRASE_BYTES) if batch_bytes is None else (own, own / 2))))
    for_phrases = int(for_phrases)
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_first_copies(count), "batch int, h binary, id long, text binary")
    by_batch = lambda df: df.groupBy("batch")
    triggers = by_batch(texts).applyInArrow(_triggers(int(for_triggers), chunk), "bucket int, batch int, blob binary")
    repeated = triggers.groupBy("bucket").applyInArrow(_repeated(hot), "batch int, blob binary")
    suspects = by_batch(texts).cogroup(by_batch(repeated)).applyInArrow(_suspects(for_phrases, chunk), PHRASE_FIELDS)
    answers = suspects.groupBy("bucket").applyInArrow(_resolve, "batch int, keys binary, at binary, n binary, ids binary, hot binary")
    return by_batch(texts).cogroup(by_batch(answers)).applyInArrow(_apply(chunk), SPANS)


def _with_spans(docs: DataFrame, extra: list[str], id_col: str, text_col: str, batch_bytes: int | None, **sizes: int) -> DataFrame:
    """``row`` (a struct of the named columns), ``n`` and ``h`` of each row, ``copy`` and what is removed."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, batch_bytes=batch_bytes, **sizes).drop("n_bytes")
    text = whole(text_col)
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("row"),  # no name of theirs meets one of ours
        F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST)).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"),
        F.octet_length(text).cast("long").alias("n"),
    )
    return own.join(spans, "h", "left").withColumn("copy", F.coalesce((F.col("n") >= MATCH) & (F.col("id") > F.col("least_id")), F.lit(False)))


def repeat_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None, **sizes: int) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    got = _with_spans(docs, [id_col], id_col, text_col, batch_bytes, **sizes)
    nothing = hashlib.sha256(b"").hexdigest()
    return got.select(
        F.col("row")[id_col].alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("h")))).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None) -> DataFrame:
    """The rows with repeated bytes taken out of their text; parts of a character that are left over go too."""
    got = _with_spans(docs, docs.columns, id_col, text_col, batch_bytes)

    @F.pandas_udf("string")
    def kept(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if not len(s) else cut(t.encode("utf-8", "replace"), s, e).decode("utf-8", "ignore") for t, s, e in zip(text, starts, ends, strict=True)], dtype=object)

    empty = F.array().cast("array<long>")
    less = kept(F.coalesce(F.col("row")[text_col], F.lit("")), F.coalesce("starts", empty), F.coalesce("ends", empty))
    cleaned = F.when(F.col("copy"), F.lit("")).when(F.col("n_removed") > 0, less).otherwise(F.col("row")[text_col])
    return got.withColumn("clean", cleaned).select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
