import hashlib
import random
import re
import struct

import xxhash

from casevane.llm import orderhash as O


def xx(*parts):
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<q", p)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def plain(text):
    """Tuples of a text: all numbered k-mers, the two smallest of each bin, in text order."""
    low = (1 << 24) - 1
    pack = lambda h, place: (h & (((1 << 63) - 1) & ~low)) | (place % (low + 1))
    t = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    if not t:
        return []
    grams = [pack(xx(*t[i : i + O.K]), i) for i in range(len(t) - O.K + 1)] if len(t) >= O.K else [pack(xx(" ".join(t)), 0)]
    count, v = {}, []
    for g in sorted(grams):
        name = g >> 24
        k = count.get(name, 0)
        count[name] = k + 1
        v.append(pack(xx(name, (k,)), g & low))
    out = []
    for b in range(O.BINS):
        two = sorted(x for x in v if x >> 58 == b)[: O.TUPLE]
        if two:
            names = [x >> 24 for x in sorted(two, key=lambda x: (x & low))] if len(two) < 2 or (two[0] & low) != (two[1] & low) else [x >> 24 for x in two]
            out.append((b << 32) | (xx(*names) & 0xFFFFFFFF))
    return out


def like(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / max(len(a), len(b))


def hexed(fp):
    return "".join(f"{x:010x}" for x in fp)


def test_against_plain_version(spark):
    r = random.Random(5)
    words = ["alpha", "be", "gamma", "d" * 40, "été", "x"]
    rows = [(i * 2, " ".join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.5 else "") for _ in range(r.choice([1, 2, 3, 5, 40, 300, 1500])))) for i in range(40)]
    rows += [(101, ""), (102, None), (103, " \n "), (104, "same same " * 400), (105, rows[7][1]), rows[9], rows[9], (None, "last one here \U0001f600 now")]
    got = O.fingerprints(spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, fingerprint string")).collect()
    big = O.LARGEST
    norm = sorted({(big if i is None else i, xx_signed(t or ""), t or "") for i, t in rows})
    nxt = {(i, t): norm[(k + 1) % len(norm)][2] for k, (i, _, t) in enumerate(norm)}
    want = []
    for i, t in rows:
        t = t or ""
        after = nxt[(big if i is None else i, t)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain(t), plain(edited), plain(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(like(a, b), 9), round(like(a, c), 9)))
    key = repr
    assert sorted(((*x[:5], round(x[5], 9), round(x[6], 9)) for x in map(tuple, got)), key=key) == sorted(want, key=key)


def xx_signed(t):
    h = xxhash.xxh64_intdigest(t.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def test_very_long_text(spark):
    text = " ".join(f"w{i % 9000}" for i in range(30_000))
    got = {x.doc_id: x for x in O.fingerprints(spark.createDataFrame([(1, text), (2, "next one")], "doc_id long, text string")).collect()}
    assert got[1].n_chars == len(text) and got[1].fingerprint == hexed(plain(text))


def test_order_matters(spark):
    a = [f"w{i}" for i in range(200)]
    swapped = a[100:] + a[:100]
    rows = [(1, " ".join(a)), (2, " ".join(swapped)), (3, " ".join(a[:195] + ["zz"] * 5))]
    df = O.with_fingerprint(spark.createDataFrame(rows, "i long, t string"), "t", "p_")
    fp = {x.i: set(x.p_fp) for x in df.collect()}
    assert len(fp[1] & fp[2]) < len(fp[1] & fp[3])


def test_lone_and_empty(spark):
    one = O.fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert O.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = O.fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
