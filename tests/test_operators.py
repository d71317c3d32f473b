"""Operators on small literal frames."""

from pyspark.sql import functions as F

from casevane.operators import evaluation, graph, integrity, joins, linkage, search, sequence
from casevane.sources import files
from casevane.streaming import events as S


def test_sequence_rules():
    assert sequence.sentences("Uno dos. Tres cuatro cinco. " + "x " * 9, 5) == ["Uno dos. Tres cuatro cinco.", "x x x x x", "x x x x"]
    text = "TITULO\n" + "w " * 190 + "\nSEGUNDO TITULO\n" + "v " * 20 + "\nSOLO"
    got = sequence.page_chunks(text, overlap=0)
    assert len(got) == 2 and got[1].startswith("SEGUNDO") and got[1].endswith("SOLO")
    assert sequence.page_chunks(text)[1].split()[:30] == ["w"] * 30


def test_seed_based_clusters_do_not_chain(spark):
    rows = [(1, 1, "t", 10, None, ["a", "b", "c", "d"]), (2, 1, "t", 10, None, ["b", "c", "d", "e"]), (3, 1, "t", 10, None, ["c", "d", "e", "f"]), (4, 1, "t", None, 7, ["z"]), (5, 1, "t", None, 7, ["y"]), (6, 2, "t", 10, None, ["a", "b", "c", "d"])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, day int, page int, terms array<string>")
    got = {r.event_id: r.duplicate_of for r in linkage.consolidate_events(df, ["user_id", "event_type"], "event_id", "day", "page", "terms").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: 4, 6: None}


def test_selection_respects_quotas(spark):
    rows = [(1, k, 1.0 - k / 100, [f"t{k}", "x"], f"f{k % 2}", f"p{k}", k % 3 == 0) for k in range(20)]
    df = spark.createDataFrame(rows, "query_id long, key long, rank_score double, terms array<string>, file string, page string, is_document boolean")
    got = search.select_diverse(df, "query_id", k=6, per_file=2, reserve=0.5).collect()
    assert len(got) == 4 and len({r.key for r in got}) == 4 and sum(r.key % 2 for r in got) == 2


def test_fusion_ties_keep_first_list_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, d long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2)], "q long, d long, rank int")
    assert [r.d for r in search.fuse([a, b], "q", "d", 4).orderBy("rank").collect()] == [10, 12, 11, 13]


def test_cosine_edge_cases(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])]
    got = [r.v for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(search.cosine(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [1.0, None, None]


def test_overlap_join_keeps_first_of_equal_turns(spark):
    s = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 5000, 5000)], "m long, i long, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 0, 500, "A"), (1, 500, 1000, "B")], "m long, t_start long, t_end long, label string")
    assert {r.i: r.label for r in joins.most_overlap(s, t, ["m"], "i", 300).collect()} == {1: "A", 2: "UNKNOWN"}


def test_traversal_in_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k"), ("c", "d", "other")], "source string, target string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.traverse(e, start, 5, directed=True).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.id for r in graph.traverse(e, start, 1, kinds=["k"]).collect()} == {"a", "b", "c"}


def test_hash_chain(spark):
    rows, prev = [], None
    import hashlib

    for i in range(5):
        h = hashlib.sha256(f"{prev or ''}|p{i}".encode()).hexdigest()
        rows.append((1, i, prev, h, f"p{i}"))
        prev = h
    rows[3] = (*rows[3][:4], "tampered")
    df = spark.createDataFrame(rows, "org long, id long, prev_hash string, hash string, payload string")
    assert [r.id for r in integrity.broken_links(df, ["org"], "id").collect()] == [3]
    assert integrity.tenant(df, None, "org").count() == 0


def test_kappa_and_sweep(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (1, 1, 0.8), (0, 0, 0.2)], "a int, b int, s double")
    assert evaluation.kappa(df, "a", "b").first().kappa == 1.0
    r = evaluation.sweep(df, "s", "a").first()
    assert (r.threshold, r.f1) == (0.34, 1.0)


def test_files_and_case_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"zzzz")
    assert {r.path.split("/")[-1]: r.kind for r in files.read_files(spark, str(tmp_path)).collect()} == {"a.pdf": "pdf", "b.bin": "unknown"}
    df = spark.createDataFrame([("c1", 1, "x"), ("c2", 2, "y")], "case_id string, n long, t string")
    files.write_case_tables({"facts": df}, str(tmp_path / "out"), "case_id")
    assert [tuple(r) for r in files.read_case_table(spark, str(tmp_path / "out"), "facts", "n long, t string, case_id string", "case_id", "c2").collect()] == [(2, "y", "c2")]
    html = spark.createDataFrame([("<p>a<br>b</p><script>x()</script> c",)], "h string")
    assert html.select(files.plain_text(F.col("h")).alias("v")).first().v == "a b c"


def test_streams(spark, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(src))
    batch = spark.read.parquet(str(src))
    out = S.drain(S.windowed_counts(S.read_events(spark, str(src), 10)), "casevane_w", "complete", str(tmp_path / "c1"))
    assert out.agg(F.sum("n")).first()[0] == batch.count()
    got = S.drain(S.once_only(S.read_events(spark, str(src), 10), ["event_id"]), "casevane_o", "append", str(tmp_path / "c2"))
    assert got.count() == batch.select("event_id").distinct().count()
    done = S.drain(S.sessions(S.read_events(spark, str(src), 10)), "casevane_s", "append", str(tmp_path / "c3"))
    assert done.count() > 0


def test_edges_move_once_for_each_end(spark):
    """Edges are dealt by target, then by source: equal ones meet there, and are not dealt by all their columns before."""
    edges = [("a", "b", "CITES"), ("a", "b", "CITES"), ("a", "b", "DENIES"), ("a", "x", "CITES"), ("x", "b", "CITES"), ("b", "a", "UNKNOWN"), ("b", "b", "CITES"), (None, "b", "CITES"), ("a", None, "CITES")]
    nodes = spark.createDataFrame([("a", "Fact", ""), ("b", "Fact", ""), ("b", "Claim", ""), (None, "Claim", "")], "id string, kind string, label string")
    g = graph.between(nodes, spark.createDataFrame(edges, "source string, target string, kind string"))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r[c] for c in ("source", "target", "kind")) for r in g.collect()) == [("a", "b", "CITES"), ("a", "b", "DENIES"), ("b", "b", "CITES")]
    assert all(plan.count(f"hashpartitioning({end}#") == 1 for end in ("source", "target"))
    assert not any(f"hashpartitioning({a}#" in line and f"{b}#" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() for a, b in (("source", "target"), ("target", "source")))
