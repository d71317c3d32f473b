"""Citations, support, golden evaluation, parties, index changes and scoped tables on literal rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from casevane.operators import citing, evaluation, extraction
from casevane.sources import packages
from casevane.sources.tenants import Catalogue

CITATION = "citation_id long, case_id string, source_type string, document_id long, page_number int, char_start int, char_end int, quote_hash string, media_id long, segment_id long, start_ms long, end_ms long"


def test_validity(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    pages = spark.createDataFrame([("a", 1, 1, "éxito en la audiencia"), ("a", 2, 1, None)], "case_id string, document_id long, page_number int, text string")
    segments = spark.createDataFrame([("a", 9, 90, 1000, 2000)], "case_id string, media_id long, segment_id long, start_ms long, end_ms long")
    page = lambda i, case="a", d=1, n=1, s=None, e=None, h=None: (i, case, "document_page", d, n, s, e, h, None, None, None, None)
    said = lambda i, case="a", m=9, s=90, a=1000, b=2000: (i, case, "transcript_segment", None, None, None, None, None, m, s, a, b)
    rows = [
        page(1), page(2, s=0, e=5, h=sha("éxito")), page(3, s=0, e=5, h=sha("exito")), page(4, s=0, e=99, h="x"), page(5, "b", s=0, e=5, h="x"), page(6, n=2), page(7, d=2, s=0, e=1), page(8, s=0, e=5, h=" "),
        said(11), said(12, m=8), said(13, "b", a=999), said(14, s=91), said(15, b=2001), page(16, None),
    ]
    got = {r.citation_id: ",".join(r.reasons) for r in citing.validity(spark.createDataFrame(rows, CITATION), pages, segments).collect()}
    assert got == {
        1: "", 2: "", 3: "quote_hash_mismatch", 4: "offset_out_of_range", 5: "case_mismatch,quote_hash_mismatch", 6: "page_not_found", 7: "offset_out_of_range", 8: "",
        11: "", 12: "media_mismatch", 13: "case_mismatch,timestamp_out_of_segment", 14: "segment_not_found", 15: "timestamp_out_of_segment", 16: "case_mismatch",
    }
    assert all(r.valid == (not r.reasons) for r in citing.validity(spark.createDataFrame(rows, CITATION), pages, segments).collect())


def test_support_on_primary_text(spark):
    claims = [(1, 1, "pago contrato vehiculo"), (1, 2, "embargo notaria pago 500"), (1, 3, "luna marte venus"), (1, 4, "pago luna marte venus"), (1, 5, " "), (1, 6, "embargo"), (1, 7, "pago 777 contrato"), (2, 1, "embargo")]
    cites = [(1, 1, "A"), (1, 1, "A"), (1, 2, "A"), (1, 3, "A"), (1, 4, "A"), (1, 6, "X"), (1, 7, "A"), (2, 1, "B")]
    items = [(1, "A", "consta el pago del contrato", True), (1, "B", "embargo en notaria por pago de 500", True), (1, "C", "embargo en notaria por pago de 500", True), (1, "X", "embargo", False), (2, "B", "embargo", True)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    claims, cites = frame(claims, "case_id int, claim_id int, text string"), frame(cites, "case_id int, claim_id int, handle string")
    items = frame(items, "case_id int, handle string, text string, citable boolean")
    got = {(r.case_id, r.claim_id): (r.status, r.handles) for r in citing.support(claims, cites, items).collect()}
    assert got == {
        (1, 1): ("supported", ["A"]), (1, 2): ("reassigned", ["B"]), (1, 3): ("not_grounded", ["A"]), (1, 4): ("review", ["A"]), (1, 6): ("invalid_citation", []), (1, 7): ("not_grounded", ["A"]), (2, 1): ("supported", ["B"]),
    }
    strict = citing.support(claims, cites, items, required=lambda claim, source: F.contains(source, F.lit("embargo")))
    assert {r.status for r in strict.filter("case_id = 1 and claim_id = 1").collect()} == {"not_grounded"}


def test_golden(spark):
    five = "document_id long, page_number int, media_id long, segment_id long, start_ms long"
    cases = spark.createDataFrame([
        (1, "direct", 1, 0, "direct", False, None), (2, "insufficient", 0, 0, None, True, None), (3, "direct", 1, 0, None, True, 1), (4, "navigational", 1, 2, "navigational", None, 9), (5, None, 0, 0, None, None, None), (6, "insufficient", 1, 0, "insufficient", False, None),
    ], "case_id int, answer_kind string, claims int, occurrences int, expected_kind string, expected_abstention boolean, max_visible int")
    expected = spark.createDataFrame([(1, 1, True, 7, 2, None, None, None), (1, 2, True, None, None, 5, None, 10_000), (1, 3, False, 8, None, None, None, None), (4, 1, False, 8, None, None, None, None)], f"case_id int, expectation int, must boolean, {five}")
    evidence = spark.createDataFrame([
        (1, 1, True, 7, 2, None, None, None), (1, 2, False, None, None, 5, 50, 11_400), (1, 3, True, 8, 1, None, None, None), (3, 1, True, 1, 1, None, None, None), (3, 2, True, 1, 1, None, None, None), (4, 1, True, 9, 1, None, None, None), (4, 2, True, 8, 1, None, None, None),
    ], f"case_id int, place int, used boolean, {five}")
    got = {r.case_id: tuple(r)[1:] for r in evaluation.golden(cases, expected, evidence).collect()}
    assert got == {
        1: (1.0, 0.5, 0.5, 1, True, True, True, False),
        2: (1.0, 1.0, None, None, True, True, None, True),
        3: (1.0, 1.0, None, None, False, False, None, False),  # should have abstained, two places of one source, too many shown
        4: (1.0, 1.0, 0.5, 1, False, True, True, False),  # navigation that claims
        5: (1.0, 1.0, None, None, True, None, None, True),
        6: (1.0, 1.0, None, None, False, False, True, False),
    }


def test_parties_of_headings(spark):
    pages = spark.createDataFrame([
        (1, 10, "b.pdf", 2, "DEMANDANTE: Juan Pérez Gómez, mayor de edad\nEjecutado - Banco Azul S.A. con NIT"),
        (1, 11, "a.pdf", 7, "  JUAN PEREZ GOMEZ, DEMANDANTE\n"),
        (1, 12, "c.pdf", 1, "demandante: el señor\nejecutantes: Uno\naccionante: A1 B2\nACTOR CIVIL: Ana María de la Cruz"),
        (2, 13, None, 1, None),
    ], "case_id int, document_id int, filename string, page_number int, text string")
    got = {(r.case_id, r.key): (r.name, r.role, r.entity_type, r.mentions, r.document_id, r.page_number) for r in extraction.parties(pages).collect()}
    assert got == {(1, "JUANPEREZGOMEZ"): ("JUAN PEREZ GOMEZ", "claimant", "person", 2, 11, 7), (1, "BANCOAZULSA"): ("Banco Azul S.A", "defendant", "organization", 1, 10, 2)}


def slow_votes(text, names):
    """The rule in the words of its description, over every place of every surname."""
    votes = {"c": 0, "d": 0}
    for n in names:
        for i in [m.start() for m in re.finditer(f"(?={n})", text)]:
            w = text[max(0, i - 280) : i + 340]
            for m in re.finditer("APODERAD[OA]", w):
                seg = w[m.end() :][:80]
                if not any(x in seg for x in names):
                    continue
                found = sorted((s.start(), k) for k, p in (("c", r"\b(DEMANDANTE|ACTORA|EJECUTANTE|ACCIONANTE)"), ("d", r"\b(DEMANDAD[OA]|EJECUTAD[OA])")) if (s := re.search(p, seg)))
                if found:
                    votes[found[0][1]] += 2
    for m in re.finditer(r"APODERAD[OA]\s*:\s*([^\n]{0,90})", text):
        if any(n in m.group(1) for n in names):
            labels = sorted((text[: m.start()].rfind(x), k) for k, x in (("c", "DEMANDANTE:"), ("d", "DEMANDADO:")))
            if labels[0][0] != labels[1][0]:
                votes[labels[1][1]] += 2
    return votes["c"], votes["d"]


def test_votes_against_every_place():
    r = random.Random(6)
    parts = ["APODERADO", "APODERADA", "PEREZ", "GOMEZ", "DEMANDANTE", "DEMANDADO", "EJECUTADA", "DEMANDANTE:", "DEMANDADO:", "APODERADO: PEREZ", "\n", "Y SU", "X" * 60, "PEREZPEREZ"]
    some = 0
    for _ in range(400):
        text = " ".join(r.choice(parts) for _ in range(r.randint(1, 60)))
        names = r.choice([["PEREZ", "GOMEZ"], ["GOMEZ"]])
        assert extraction.votes_of(text, names) == slow_votes(text, names)
        some += extraction.votes_of(text, names) != (0, 0)
    assert some > 100


def test_sides_of_attorneys(spark):
    attorneys = spark.createDataFrame([(1, 1, "Luis Pérez Gómez"), (1, 2, "Ana Ruiz"), (1, 3, "X"), (2, 4, "Luis Pérez Gómez"), (1, 5, None)], "case_id int, party_id int, name string")
    texts = spark.createDataFrame([(1, "la apoderada Ana Ruiz del demandado"), (1, "Apoderado Pérez de la actora"), (1, "el apoderado Gómez del ejecutado y del demandante"), (2, None), (3, "apoderado Pérez de la actora")], "case_id int, text string")
    got = {r.party_id: (r.claimant, r.defendant, r.role) for r in extraction.attorney_sides(attorneys, texts).collect()}
    assert got == {1: (2, 2, "attorney"), 2: (0, 4, "attorney_defendant"), 3: (0, 0, "attorney"), 4: (0, 0, "attorney"), 5: (0, 0, "attorney")}


def test_index_changes(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x", "m", [1.0]), ("a", 2, "y", "m", [2.0]), ("b", 1, "z", "m", [3.0]), ("c", 1, None, None, [4.0])], "source string, id int, text string, model string, embedding array<double>")
    new = spark.createDataFrame([("a", 1, "x", "m"), ("a", 2, "y2", "m"), ("a", 3, "w", "m"), ("b", 1, "z", "m"), ("c", 1, None, "m2")], "source string, id int, text string, model string")
    got = sorted((r.source, r.id, r.action) for r in packages.index_changes(old, new, "source", ["id"]).collect())
    assert got == [("a", 1, "keep"), ("a", 2, "add"), ("a", 2, "drop"), ("a", 3, "add"), ("b", 1, "keep"), ("c", 1, "add"), ("c", 1, "drop")]
    rows, fresh = packages.reindexed(old, new, "source", ["id"])
    assert sorted((r.source, r.id, r.text or "", r.embedding) for r in rows.collect()) == [("a", 1, "x", [1.0]), ("a", 2, "y2", None), ("a", 3, "w", None), ("c", 1, "", None)]
    assert sorted((r.source, r.id) for r in fresh.collect()) == [("a", 2), ("a", 3), ("c", 1)]
    path = str(tmp_path / "chunks")
    old.write.partitionBy("source").parquet(path)
    packages.replace_chunks(rows.select("id", "text", "model", "embedding", "source"), path, "source")
    stored = sorted((r.source, r.id, r.text or "") for r in spark.read.parquet(path).collect())
    assert stored == [("a", 1, "x"), ("a", 2, "y2"), ("a", 3, "w"), ("b", 1, "z"), ("c", 1, "")]


def test_no_table_without_its_tenant(spark, tmp_path):
    for name, column in (("files", "org"), ("claims", "organization_id")):
        spark.createDataFrame([("o1", 1), ("o2", 2), (None, 3), ("", 4)], f"{column} string, v int").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(1,)], "v int").write.parquet(str(tmp_path / "rules.parquet"))
    all_of = Catalogue(spark, str(tmp_path), {"files": "org", "claims": "organization_id"}, shared=("rules",))
    assert all_of.names == ["claims", "files", "rules"]
    for name in ("files", "claims"):
        rows = all_of.of("o1").table(name)
        assert [r.v for r in rows.collect()] == [1]
        assert "EqualTo" in rows._jdf.queryExecution().executedPlan().toString()  # the filter reaches the scan
        assert all_of.of(None).table(name).count() == all_of.of("").table(name).count() == all_of.of("o3").table(name).count() == 0
    assert all_of.of(None).table("rules").count() == 1
    with pytest.raises(KeyError):
        all_of.of("o1").table("users")
    assert not hasattr(all_of, "table")
