import itertools
import re
from collections import Counter

import duckdb
import pandas as pd

from casevane.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_audit(docs, labels):
    """Every order applied to the documents one after the other; docs are (id, text, source)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for who, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": who is not None and any(o is not None and o < who and (x or "") == t for o, x, _ in docs),
        }
        fails.append((source or "", {k for k, v in f.items() if v}, who in good, who in toxic))
    out = set()
    for part in {p for p, *_ in fails}:
        rows, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            alive = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                redundant = sum(1 for x in fails if x[0] == part and f in x[1] and x[1] & set(order[: step - 1]))
                unique = sum(1 for x in fails if x[0] == part and x[1] == {f})
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step, len(alive), len(gone), redundant, unique, sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out |= {(*r[:-1], shapley[r[-1]]) for r in rows}
    return out


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "s1"), (2, LONG, "s1"), (3, LONG, None), (4, "SHOUT and #tag", "s2"), (5, "SHOUT and #tag", "s1"), (6, "same " * 300, "s2"), (7, None, None), (8, "", ""),
    (9, None, "s1"), (None, LONG, "s1"), (None, "", "s2"), (5, "SHOUT and #tag", "s1"), (5, "another text", "s1"), (10, LONG + "\x0b" + LONG.upper(), "s2"),
    (11, "é ñ %" + LONG * 30, "s3"), (-1, "a\x0bb\x1cc", "s3"), (12, "a\x0bb\x1cc", "s3"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, 0, 1), (5, 1, 1), (12, 1, None), (99, 1, 1), (None, 1, 1)]


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, source string, mask int")
    return d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")


def test_audit_against_applying_all_orders(spark, monkeypatch):
    docs, labels = frames(spark, DOCS, LABELS)
    want = slow_audit(DOCS, LABELS)
    got = audit.audit(docs.repartition(3), labels).collect()
    assert len(got) == 600 * 4 and set(map(tuple, got)) == want
    monkeypatch.setattr(audit, "CHAIN_BYTES", 1)  # chains are written on after each text
    assert set(map(tuple, audit.audit(docs.repartition(2), labels).collect())) == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(DOCS, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(LABELS, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    sql = con.execute(audit.ORACLE)
    names = [c[0] for c in sql.description]
    assert set(sql.fetchall()) == {tuple(r[n] for n in names) for r in got}


def test_equal_fingerprints_of_different_texts():
    chains = audit.Chains()
    moved = []
    for who, text in [(5, b"x"), (3, b"y"), (4, b"x"), (6, b"y"), (4, b"x")]:
        moved += [i for i, _ in chains.add(1, text, who, Counter({("p", 0): 1}))]
    assert moved == [5, 6]
    assert {(t, w, sum(r.values())) for _, t, w, r in chains.drain()} == {(b"x", 4, 2), (b"y", 3, 1)}


def test_empty_tables(spark):
    docs, labels = frames(spark, DOCS[:3], [])
    assert set(map(tuple, audit.audit(docs, labels).collect())) == slow_audit(DOCS[:3], [])
    docs, labels = frames(spark, [], LABELS)
    assert audit.audit(docs, labels).collect() == []
