import random
import re

import numpy as np
import pytest

from casevane.llm import neardup

SCHEMA = "doc_id long, text string"


def brute(rows):
    def bag(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    big = neardup.LARGEST
    rows = [(big if i is None else i, bag(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    null = lambda x: None if x == big else x
    return [(null(i), len(s), null(root(i) if s else i), (root(i) if s else i) == i) for i, s in rows]


def corpus(seed, copies=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    rows, base = [], [[word() for _ in range(r.randint(40, 220))] for _ in range(6)]
    for i in range(copies):
        w = list(base[0] if i % 2 else r.choice(base))
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word()
        rows.append((i * 3 + 1, " ".join(w) if i % 5 else "\n ".join(w).upper()))
    rows += [(900 + i, " ".join(word() for _ in range(r.randint(1, 30)))) for i in range(30)]
    rows += [(2, ""), (3, None), (5, "  \n"), (6, "One two"), (8, "one  TWO"), (None, rows[1][1]), (None, "alone here"), rows[4], rows[4], (9, "é É"), (10, "É É")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 512), (2, 4), (3, 9)])
def test_against_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = corpus(seed)
    got = [tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def told(rows):
    return sorted((tuple(x) for x in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_several_texts_under_one_id(spark, seed):
    """Repeated and null ids with different texts of equal set size: every link is found."""
    r = random.Random(seed)
    a, b, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abd")
    rows = [(1, a + " zz"), (2, b + " yy"), (5, a), (5, b), (7, d), (None, d + " x"), (None, "w " + a), (8, "one two"), (8, "two one"), (9, "two one"), (5, ""), (4, None)]
    rows += [(r.randint(20, 30), " ".join([k + str(i) for i in range(56)] + [f"e{j}" for j in range(4)])) for k in "pqrs" for j in range(3)]
    r.shuffle(rows)
    assert told(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == told(brute(rows))
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert told(kept) == told(x for x, y in zip(rows, brute(rows)) if x[0] in {z[0] for z in brute(rows) if z[3]})


@pytest.mark.parametrize("both,union", [(6, 7), (17, 20), (85, 100), (340, 400)])
def test_recall_of_the_signature_filter(both, union):
    """Pairs exactly at the limit or just over it: the share whose signatures agree in fewer than MATCHES coordinates."""
    r = np.random.default_rng(both)
    missed, pairs = 0, 1500
    for _ in range(pairs):
        s = r.integers(0, 1 << 63, union, dtype=np.uint64)
        mine = (union - both) // 2
        a, b = np.concatenate((s[:both], s[both : both + mine])), np.concatenate((s[:both], s[both + mine :]))
        missed += int((neardup.signature(a) == neardup.signature(b)).sum()) < neardup.MATCHES
    assert missed <= 1


def test_clashing_columns_and_long_text(spark):
    text = " ".join(f"w{i % 5000}-{i}" for i in range(40_000))
    rows = [(1, text, 1, 2, "x", 5), (2, text + " more", 3, 4, "y", 6), (3, None, 5, 6, "z", 7), (3, None, 5, 6, "z", 7)]
    docs = spark.createDataFrame(rows, SCHEMA + ", id int, n int, key string, __kept int")
    got = sorted((tuple(r) for r in neardup.drop_near_duplicates(docs).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3]], key=repr)
    by = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert by[2].component_id == 1 and by[1].n_shingles == 40_000 - 4 and by[3].kept


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (9, 7)], "a long, b long")
    from casevane.llm.common import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    got = {r.node: r.root for r in neardup.components(links).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[7] == got[9] == 3


def test_empty_and_filter(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(4, text, "x"), (2, text + " end", "y"), (7, "other", "z")], SCHEMA + ", n string")
    assert {r.n for r in neardup.drop_near_duplicates(docs).collect()} == {"y", "z"}
