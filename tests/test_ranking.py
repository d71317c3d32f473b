"""Rank functions against plain versions over literal texts."""

import itertools
import random
import re

import pytest

from casevane.operators import ranking, search


def places(text):
    """Every word in order with its place; the test texts have no stop words, accents or plurals."""
    return [(w.lower(), i) for i, w in enumerate(re.findall(r"[0-9A-Za-z]+", text or ""), 1) if len(w) >= 3]


def slow_density(text, groups):
    """All intervals between occurrences that answer every group and cannot shrink at either end."""
    wanted = set().union(*groups)
    at = [(p, w) for w, p in places(text) if w in wanted]
    full = lambda xs: all(any(w in g for _, w in xs) for g in groups)
    total = 0.0
    for i, j in itertools.combinations_with_replacement(range(len(at)), 2):
        inside = at[i : j + 1]
        if full(inside) and not full(inside[1:]) and not full(inside[:-1]):
            total += 0.1 / (1 + (inside[-1][0] - inside[0][0]) - (len(inside) - 1))
    return total


WORDS = "alfa bravo carbon delta echo foxtrot golf hotel".split()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS + ["xx", "ab"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "alfa"), (103, "alfa, bravo! alfa bravo"), (104, "carbon " * 30 + "alfa" + " xx" * 500 + " bravo")]


QUERIES = {1: [{"alfa"}, {"bravo"}], 2: [{"alfa", "golf"}, {"bravo"}, {"carbon", "delta"}], 3: [{"hotel"}], 4: [{"alfa"}, {"nowhere"}], 5: [{"echo"}, {"echo", "golf"}]}


def frames(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs, spark.createDataFrame([(q, g, t) for q, gs in QUERIES.items() for g, ts in enumerate(gs) for t in ts], "query_id long, grp int, term string")


def test_positions(spark):
    docs = spark.createDataFrame([(1, "Las Cosas de la casa, y 12.500 casas ab"), (2, None)], "doc_id long, text string")
    got = {r.term: r.places for r in ranking.positions(docs, "doc_id").collect()}
    assert got == {"cosa": [2], "casa": [5, 8], "12.500": [7]}


def test_density_of_all(spark, texts):
    docs, queries = frames(spark, texts)
    got = {(r.query_id, r.doc_id): r.score for r in ranking.density_of_all(docs, queries, "doc_id").collect()}
    want = {(q, i): s for q, gs in QUERIES.items() for i, t in texts if (s := slow_density(t, gs)) > 0}
    assert got == pytest.approx(want) and len(want) > 60
    assert not any(q == 4 for q, _ in got)
    assert got[1, 103] == pytest.approx(0.1 * 3) and got[1, 104] == pytest.approx(0.1 / 501)


def test_density_of_any_and_plain_rank(spark, texts):
    docs, queries = frames(spark, texts)
    words = {i: [w for w, _ in places(t)] for i, t in texts}
    terms = {q: set().union(*gs) for q, gs in QUERIES.items()}
    counts = {(q, i): {t: ws.count(t) for t in ts if t in ws} for q, ts in terms.items() for i, ws in words.items()}
    got = {(r.query_id, r.doc_id): r.score for r in ranking.density_of_any(docs, queries, "doc_id").collect()}
    assert got == pytest.approx({k: 0.1 * sum(c.values()) for k, c in counts.items() if c})
    got = {(r.query_id, r.doc_id): r.score for r in ranking.plain_rank(docs, queries, "doc_id").collect()}
    worth = lambda n: 0.1 * sum(1 / j**2 for j in range(1, n + 1)) / 1.64493406685
    assert got == pytest.approx({(q, i): sum(map(worth, c.values())) / len(terms[q]) for (q, i), c in counts.items() if c})


@pytest.mark.parametrize("block", [2048, 2])
def test_bm25_where_the_documents_are(spark, texts, block, monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 25)
    docs, queries = frames(spark, texts)
    for k in (1, 7, 500):
        got = ranking.bm25_top_k(docs.repartition(3), queries, "doc_id", k, block=block).collect()
        want = search.ranked(search.bm25(docs, queries.select("query_id", "term").distinct(), "doc_id"), "query_id", "doc_id", k, 6).collect()
        told = lambda rows: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in rows)
        assert told(got) == told(want)
    assert ranking.bm25_top_k(docs.limit(0), queries, "doc_id", 3).collect() == []


def test_retrieval_stops_at_the_gate(spark):
    frame = spark.createDataFrame
    coverage = frame([(1, 0.8), (2, 0.0), (3, None), (4, 0.5)], "query_id long, coverage double")
    lexical = frame([(q, d, r) for q in (1, 2, 3) for r, d in enumerate((10, 11, 12), 1)], "query_id long, doc_id long, rank int")
    vector = frame([(1, 12, 1), (1, 13, 2), (2, 13, 1)], "query_id long, doc_id long, rank int")
    citable = frame([(10,), (12,), (13,), (30,)], "doc_id long")
    extra = frame([(1, 30, 1), (1, 12, 2), (2, 30, 1), (4, 31, 1)], "query_id long, doc_id long, rank int")
    seen = []

    def score(rows):
        seen.extend((r.query_id, r.doc_id, r.rank) for r in rows.collect())
        return rows.select("query_id", "doc_id", "rank", (1.0 - (rows.doc_id == 10).cast("int") * 0.5).alias("score"))

    got = [(r.query_id, r.doc_id, r.handle) for r in ranking.retrieve(coverage, [lexical, vector], citable, extra, score, "doc_id", 3).orderBy("query_id", "place").collect()]
    assert got == [(1, 12, "E1"), (1, 13, "E2"), (1, 30, "E3"), (3, 12, "E1"), (3, 10, "E2"), (4, 31, "E1")]
    assert sorted(seen) == [(1, 10, 2), (1, 12, 1), (1, 13, 4), (1, 30, 31), (3, 10, 1), (3, 12, 3), (4, 31, 31)]
    few = ranking.retrieve(coverage, [lexical, vector], citable, extra, score, "doc_id", 1, least=0.5).collect()
    assert {r.query_id for r in few} == {1, 3} and all(r.handle == "E1" for r in few)


def test_case_search_by_way_found(spark):
    pages = spark.createDataFrame([(1, "pago del banco central"), (2, "banco y pago"), (3, "pago pago pago"), (4, None)], "id long, text string")
    segments = spark.createDataFrame([(1, "el banco central dijo", "A"), (2, "nada", "Banco"), (3, "pago, banco central", "B")], "id long, text string, speaker string")
    got = [(r.kind, r.id, r.found) for r in ranking.case_search(pages, segments, "banco central", 9).orderBy("place").collect()]
    assert got == [("page", 1, "exact"), ("segment", 1, "exact"), ("segment", 3, "exact"), ("segment", 2, "transcript"), ("page", 2, "hybrid")]
    assert ranking.case_search(pages, segments, "banco central", 2).count() == 2
