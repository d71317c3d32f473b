import hashlib
import random

import numpy as np
import pytest

from casevane.llm import repeats

SCHEMA = "doc_id long, text string, starts string"


def brute(rows, m=repeats.MATCH):
    """The contract, literally."""
    key = lambda i: repeats.LARGEST if i is None else i
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - m + 1):
            w = b[p : p + m]
            least[w] = min(key(i), least.get(w, key(i)))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - m + 1):
            if least[b[p : p + m]] < key(i):
                gone[p : p + m] = [True] * m
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma", "été", "x", "--------", "lorem ipsum"]
    passage = [" ".join(r.choice(words) for _ in range(n)) for n in (9, 12, 30, 60)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(passage) if r.random() < 0.4 else "".join(r.choice("abcdef \n") for _ in range(r.randint(1, 150))))
        rows.append((r.randint(0, 40), "".join(parts), "s"))
    rows += [(7, "", "s"), (8, None, "s"), (None, passage[3] + "q" * 30, "s"), (99, "a" * 500, "s"), (98, "a" * 300, "s"), rows[3], rows[3], (1000, rows[5][1] * 3, "s")]
    return rows


@pytest.mark.parametrize("seed,batch,hot", [(1, 1 << 20, 4096), (2, 900, 4096), (3, 900, 2)])
def test_against_brute_force(spark, seed, batch, hot):
    rows = corpus(seed)
    got = [tuple(r) for r in repeats.repeat_report(spark.createDataFrame(rows, SCHEMA), batch_bytes=batch, hot=hot, chunk=200).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_cleaned_rows_keep_their_columns(spark):
    rows = [(1, "é" * 40 + "tail of one", "a"), (2, "head " + "é" * 40, "b"), (3, None, "c")]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == rows[0][1] and got[3].text is None and got[2].starts == "b"
    assert got[2].text == "head "


def test_empty_table(spark):
    assert repeats.repeat_report(spark.createDataFrame([], SCHEMA)).count() == 0


def phrases(seed):
    """Some phrases, one after another, their suffixes of MATCH bytes and more, and their occurrences in texts."""
    r = random.Random(seed)
    pick = {"".join(r.choice("ab" if i % 3 else "ab\xe9 ") for _ in range(r.randint(50, 90))) for i in range(30)} | {"a" * n for n in (50, 57, 80)}
    parts = [p.encode()[: repeats.MATCH + 40] for p in sorted(pick, key=lambda p: r.random())]
    data, suffix, owner = b"".join(parts), [], []
    at = 0
    for k, p in enumerate(parts):
        suffix += range(at, at + len(p) - repeats.MATCH + 1)
        owner += [k] * (len(p) - repeats.MATCH + 1)
        at += len(p)
    found = [(r.randrange(len(parts)), r.randint(0, 20)) for _ in range(70)]
    return data, np.array(suffix), np.array(owner), np.array([k for k, _ in found]), np.array([t for _, t in found])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dictionary_array_is_the_sorted_list_of_suffixes(seed):
    data, suffix, *_ = phrases(seed)
    order, start = repeats.dictionary_array(np.frombuffer(data + bytes(8), np.uint8), suffix)
    prefix = [data[s : s + repeats.MATCH] for s in suffix]
    got = [prefix[i] for i in order]
    assert sorted(order.tolist()) == list(range(len(suffix))) and got == sorted(prefix)
    assert start.tolist() == [i for i in range(len(got)) if not i or got[i] != got[i - 1]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_corpus_order_is_the_sorted_list_of_all_windows(seed):
    data, suffix, owner, phrase, text = phrases(seed)
    which, found = repeats.corpus_order(np.frombuffer(data + bytes(8), np.uint8), suffix, owner, phrase, text)
    got = [(data[suffix[i] : suffix[i] + repeats.MATCH], int(text[k])) for i, k in zip(which, found)]
    want = [(data[s : s + repeats.MATCH], int(t)) for s, o in zip(suffix, owner) for k, t in zip(phrase, text) if k == o]
    assert got == sorted(want)
    assert all(owner[i] == phrase[k] for i, k in zip(which, found))


def test_names_of_columns_do_not_meet(spark):
    schema = "doc_id long, text string, h string, n int, copy string, clean string, row int, id string, least_id long, __h string, __n int"
    rows = [(1, "x" * 70, "h", 1, "c", "d", 5, "i", 6, "u", 7), (2, "y" + "x" * 60 + "z", "h", 1, "c", "d", 5, "i", 6, "u", 7)]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert got[2].text == "yz" and tuple(got[2])[2:] == rows[1][2:] and repeats.remove_repeats(docs).columns == docs.columns
    assert {r.doc_id: r.n_removed for r in repeats.repeat_report(docs).collect()} == {1: 0, 2: 60}


def test_very_long_text(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long[1000:1200], "s"), (2, long, "s"), (3, long[250_000:250_060], "s")]
    got = {x.doc_id: x for x in repeats.repeat_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2].n_removed, got[2].n_spans) == (200, 1) and (got[3].n_removed, got[1].n_removed) == (60, 0)
