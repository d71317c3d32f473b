"""Rules of legal text, intents and the guard on literal rows."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from casevane.functions import intents as N
from casevane.functions import legal as L
from casevane.operators import corrections, guard, search, sequence
from casevane.sources import packages

c = F.col


def one(spark, rows, *columns, kind="string"):
    """The value of each column expression for each row of texts."""
    names = "abcd"[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {kind}" for n in names))
    return [list(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_article_lists(spark):
    cases = {
        "839-01": ["839-01"],
        "784-5": ["784-5"],
        "10-16": [str(n) for n in range(10, 17)],
        "10 a 12": ["10", "11", "12"],
        "10 al 12 y 20": ["10", "11", "12", "20"],
        "10 y 16": ["10", "16"],
        "10, 11, 13": ["10", "11", "13"],
        "100-120": ["100-120"],
        "100 a 102": ["100", "101", "102"],
        "839 - 01": ["839-01"],
        "16 a 10": ["16", "10"],
        "1 a 900": ["1", "900"],
        "5A y 6": ["5A", "6"],
    }
    got = one(spark, [(k,) for k in cases], L.articles(c("a")))
    assert [g[0] for g in got] == list(cases.values())


def test_norms_and_keys(spark):
    text = "Según la Ley 1564 de 2012 y el artículo 422, los arts. 10 a 12 y el Decreto N. 806; artículos 839-01 y 422."
    got = one(spark, [(text,), ("sin normas",), (None,)], F.transform(L.norms(c("a")), lambda n: F.concat_ws(":", n["kind"], n["identifier"])))
    assert got[0][0] == ["law:1564 de 2012", "law:806", "article:422", "article:10", "article:11", "article:12", "article:839-01"] and got[1][0] == got[2][0] == []
    keys = one(spark, [("839-01",), ("83901",), ("839-1",)], L.identifier_key(c("a")))
    assert keys[0] == keys[1] != keys[2]


@pytest.mark.parametrize(
    "value,context,ok",
    [
        ("5 de marzo de 2020", "Acta del 05/03/2020", True),
        ("5 de marzo de 2020", "acta del 5 de abril de 2020", False),
        ("5 de marzo de 2020", "solo 2020", False),
        ("13/12/2024", "Audiencia_13Dic2024.mp4", True),
        ("4 de abril de 2008", "Bogotá ABRIL 4 de 2008", True),
        ("4/4/08", "2008-04-04", True),
        ("4 de septiembre de 2008", "4 setiembre 2008", True),
        ("ayer", "lo dijo ayer mismo", True),
        ("ayer", "", False),
        ("", "algo", False),
    ],
)
def test_date_support(spark, value, context, ok):
    assert one(spark, [(value, context)], L.date_supported(c("a"), c("b")))[0][0] is ok


NAMES = [
    ("Jorge Hernán Rojas Melo", "JORGE H. ROJAS M.", True),
    ("Jorge Hernán Rojas Melo", "Rojas Melo", True),
    ("Juan Carlos Garzón Gutiérrez", "Carlos Alfonso Garzón Gutiérrez", False),
    ("Inverfast S.A.S.", "INVERFAST", True),
    ("Ana", "Ana Rojas", False),
    ("", "Ana", False),
    ("Comercial Norte Ltda", "Comercial Norte S.A.", True),
]


def test_names(spark):
    got = one(spark, [(a, b) for a, b, _ in NAMES], L.name_compatible(c("a"), c("b")), L.name_compatible(c("b"), c("a")))
    assert got == [[ok, ok] for *_, ok in NAMES]
    said = [("a favor de Rojas Melo firmó", "Jorge Hernán Rojas Melo", True), ("El señor JORGE H. ROJAS M. declaró", "Jorge Hernán Rojas Melo", True), ("nadie firmó", "Jorge Hernán Rojas Melo", False), ("Juan C. Garzón pagó", "Carlos Garzón", False), ("", "Ana Rojas", False)]
    assert [g[0] for g in one(spark, [(a, b) for a, b, _ in said], L.mentions(c("a"), c("b")))] == [ok for *_, ok in said]


def test_authorities(spark):
    same = ["Juzgado 21 Civil del Circuito de Bogotá", "Juzgado Veintiuno (21) Civil del Circuito de Bogotá D.C.", "JUZGADO 021 Civil del Circuito"]
    got = [g[0] for g in one(spark, [(x,) for x in same] + [("Tribunal Superior",), ("Juzgado Cuarenta y Cinco Penal Municipal",), ("",), (None,)], L.authority_signature(c("a")))]
    assert set(got[:3]) == {"JUZGADO|21|CIRCUITO,CIVIL"} and got[3:5] == ["TRIBUNAL||SUPERIOR", "JUZGADO|45|MUNICIPAL,PENAL"] and got[5] == got[6] == "OTRO||"


def test_intents(spark):
    asked = [("¿y en la página 12?",), ("Necesito comparar la demanda y la contestación",), ("",), ("¿Cuántas obligaciones hay?",)]
    got = one(spark, asked, N.rule_intent(c("a"))["intent"], N.leans_back(c("a")))
    assert got[0][1] and got[1][0] == "analisis" and got[2][0] == "dato" and got[3][0] == "analisis"
    read = one(spark, [("mira",)], N.rule_intent(c("a"), F.lit(True)))[0][0]
    assert (read.intent, read.confidence) == ("lectura", 0.85)


def frames(spark, claims, cites, evidence, parties=(), rules=(), decisions=(), contradictions=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return (
        make(claims, "case_id int, claim_id int, text string"),
        make(cites, "case_id int, claim_id int, handle string, quote_hash string"),
        make(evidence, "case_id int, handle string, text string, context string, confidence double, quote string"),
        make(parties, "case_id int, name string"),
        make(rules, "identifier string, source string, text string"),
        make(decisions, "case_id int"),
        make(contradictions, "case_id int, text_a string, text_b string"),
    )


RULE = "Artículo 422. Pueden demandarse ejecutivamente las obligaciones expresas, claras y exigibles que consten en documentos que provengan del deudor."


def test_audit(spark):
    page = "El pagaré 001 por 500 pesos fue firmado el 5 de marzo de 2020 por Ana Rojas. Ver Ley 45 de 1990, artículo 77."
    digest = hashlib.sha256(b"firmado").hexdigest()
    claims = [
        (1, 1, "El pagaré 001 es por 500 pesos"),
        (1, 2, "El pagaré 001 es por 900 pesos"),
        (1, 3, "Se firmó el 6 de marzo de 2020"),
        (1, 4, "Lo firmó Pedro Casas Vega"),
        (1, 5, "Está probado el pago"),
        (1, 6, "Aplica el artículo 77"),
        (1, 7, "Aplica el artículo 78"),
        (1, 8, "El artículo 422 permite demandar ejecutivamente obligaciones claras del deudor"),
        (1, 9, "El artículo 422 declara la nulidad"),
        (1, 10, "El artículo 422 del Código Civil permite demandar ejecutivamente obligaciones claras"),
        (2, 1, "La bodega principal fue entregada vacía por la sociedad"),
        (3, 1, "La bodega principal fue entregada vacía por la sociedad"),
        (3, 2, "La bodega principal fue entregada llena de cajas por la sociedad"),
    ]
    cites = [(k, i, "D1", digest if i == 1 and k == 1 else None) for k, i, _ in claims]
    evidence = [(1, "D1", page, page + " pagare.pdf", 0.9, "firmado"), (2, "D1", "bodega", "bodega", 0.4, None), (3, "D1", "bodega", "bodega", None, None)]
    both = "La bodega principal fue entregada vacía", "La bodega principal fue entregada llena de cajas"
    data = frames(spark, claims, cites, evidence, [(1, "Pedro Casas Vega"), (1, "Ana Rojas")], [("422", "Código General del Proceso", RULE)], [(9,)], [(2, *both), (3, *both)])
    found = guard.audit(*data)
    got = {(r.case_id, r.claim_id, r.code, r.severity) for r in found.collect()}
    assert got == {
        (1, 2, "NUMBER_MISMATCH", "CRITICAL"),
        (1, 3, "NUMBER_MISMATCH", "CRITICAL"),
        (1, 3, "DATE_MISMATCH", "CRITICAL"),
        (1, 4, "PARTY_MISMATCH", "HIGH"),
        (1, 5, "DECISION_MISSING", "CRITICAL"),
        (1, 6, "LEGAL_RULE_MISSING", "HIGH"),
        (1, 7, "LEGAL_RULE_MISSING", "CRITICAL"),
        (1, 9, "LEGAL_CONSEQUENCE_UNSUPPORTED", "CRITICAL"),
        (1, 10, "LEGAL_ARTICLE_SOURCE_MISMATCH", "CRITICAL"),
        (2, 1, "LOW_OCR_CONFIDENCE", "HIGH"),
        (2, 1, "CONTRADICTION_OMITTED", "HIGH"),
    }
    status = {(r.case_id, r.claim_id): r.status for r in guard.claim_status(data[0], found).collect()}
    assert status[1, 1] == status[1, 8] == "SUPPORTED" and status[1, 2] == "UNSUPPORTED" and status[1, 4] == "NEEDS_REVIEW"
    assert {r.case_id: r.status for r in guard.final_status(data[0], found).collect()} == {1: "WARNING", 2: "WARNING", 3: "PASSED"}
    assert {r.case_id: r.status for r in guard.final_status(data[0], found, "STRICT").collect()}[2] == "NEEDS_REVIEW"


def test_compose(spark):
    rows = [
        (1, 1, "evidence", ["D1"], ["p1"], False),
        (1, 2, "direct", ["D2", "D1"], ["p2", "p1"], False),
        (1, 3, "direct", ["D3", "D4"], ["p3", "p4"], False),  # doesn't fit into the budget whole
        (1, 4, "limit", ["D1"], ["p1"], False),
        (1, 5, "audio", ["D5"], ["p2"], False),  # a second number for one place
        (1, 6, "evidence", [], [], False),
        *[(2, i, "evidence", [f"D{i}"], [f"p{i}"], False) for i in range(1, 7)],
        (3, 1, "evidence", ["D1"], ["p1"], True),
        (4, 1, "limit", ["D1"], ["p1"], False),
    ]
    df = spark.createDataFrame(rows, "question_id int, claim_id int, kind string, handles array<string>, places array<string>, insufficient boolean")
    got = sorted((r.question_id, r.claim_id or 0, r.kind, r.markers, r.answer_kind) for r in guard.compose(df, budget=3).collect())
    assert got == [(1, 1, "evidence", [2], "direct"), (1, 2, "direct", [1, 2], "direct"), (2, 1, "evidence", [1], "partial"), (2, 2, "evidence", [2], "partial"), (2, 3, "evidence", [3], "partial"), (3, 0, None, [], "insufficient"), (4, 0, None, [], "insufficient")]
    deep = guard.compose(df.filter("question_id in (2, 3)"), budget=10, deep=True)
    assert deep.filter("question_id = 2").count() == 6 and deep.filter("question_id = 3").first().answer_kind == "partial"


def test_speech_and_layout(spark):
    rows = [(1, "A", 0, 400, "incidente 2018-", 0.5), (1, "A", 700, 1000, "13-61,", 1.0), (1, "B", 1100, 1200, "no", 0.9), (1, "A", 1300, 1500, "sigue", 0.9), (1, "A", 2200, 2300, "tarde", 0.9), (2, "A", 0, 29_900, "largo", 0.9), (2, "A", 30_000, 30_500, "no cabe", 0.9)]
    df = spark.createDataFrame(rows, "media_id int, speaker string, start_ms long, end_ms long, text string, confidence double")
    got = sorted((tuple(r) for r in sequence.merge_segments(df, ["media_id"]).collect()), key=lambda r: (r[0], r[2]))
    assert [g[4] for g in got] == ["incidente 2018-13-61,", "no", "sigue", "tarde", "largo", "no cabe"] and abs(got[0][5] - (0.5 * 400 + 300) / 700) < 1e-9
    words = [[("URISDICCIÓN:", 0.0, 20.0, 40.0, 10.0), ("Juzgado", 0.0, 0.0, 30.0, 10.0), ("Civil", 80.0, 21.0, 20.0, 10.0), ("21", 33.0, 3.0, 8.0, 10.0), ("fin", 0.0, 60.0, 9.0, 10.0)]]
    page = spark.createDataFrame([(w,) for w in words], "w array<struct<text:string,x:double,y:double,w:double,h:double>>").select(sequence.layout(c("w")).alias("t")).first().t
    assert page == "Juzgado 21\nURISDICCIÓN:        Civil\n\nfin"
    assert [tuple(r.p) if r.p else None for r in spark.createDataFrame([([("a", 0), ("b", 60)], 60), ([("a", 0)], 0), ([("a", 0)], 9)], "w array<struct<word:string,start_ms:int>>, b int").select(sequence.split_words(c("w"), c("b")).alias("p")).collect()] == [("a", "b"), None, None]


def test_ranking_rules(spark):
    got = one(spark, [("¿Qué firmó Ana Rojas con Banco Andino?",), ("Pagos de Ana",), ("El Juez",)], search.proper_nouns(c("a")))
    assert [g[0] for g in got] == [["ana rojas", "banco andino"], ["ana"], ["juez"]]


def test_corrections(spark):
    pages = spark.createDataFrame([(1, "old", 0.3), (2, "same", 0.4)], "id int, text string, confidence double")
    fixes = spark.createDataFrame([(1, "first", "r", 1), (1, "new", "r2", 2), (2, "same", "r", 1), (2, " ", "r", 2), (9, "x", "r", 1)], "id int, new_text string, reason string, made_at int")
    fixed, reviews = corrections.correct_texts(pages, fixes, ["id"], "page")
    assert {(r.id, r.text, r.confidence, r.human_corrected) for r in fixed.collect()} == {(1, "new", 1.0, True), (2, "same", 0.4, False)}
    assert [(r.entity_id, r.before, r.after, r.reason) for r in reviews.collect()] == [("1", "old", "new", "r2")]
    merges = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "d", "d")], "media_id int, keep_id string, drop_id string")
    segments = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "d"), (2, 0, "a")], "media_id int, i int, speaker_id string")
    moved, left, _ = corrections.merge_speakers(segments, segments.select("media_id", "speaker_id").distinct(), merges)
    assert {(r.media_id, r.i, r.speaker_id) for r in moved.collect()} == {(1, 0, "c"), (1, 1, "c"), (1, 2, "d"), (2, 0, "a")} and left.count() == 2


def test_packages(spark, tmp_path):
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    docs = spark.createDataFrame([(1, "d1"), (1, "d2")], "case_id int, id string")
    pages = spark.createDataFrame([(1, "d1", 2, "HECHOS"), (1, "d1", 1, "uno")], "case_id int, document_id string, page_number int, text string")
    packages.write_package(cases, {"documents": docs}, str(tmp_path / "p"), pages=pages, timeline=spark.createDataFrame([(1, "2020-01-02"), (1, None), (1, "2019-01-01")], "case_id int, event_date string"))
    assert {r.case_id: r.documents for r in spark.read.json(f"{tmp_path}/p/manifest").collect()} == {1: 2, 2: 0}
    assert spark.read.text(f"{tmp_path}/p/markdown", wholetext=True).first().value.strip() == "## p. 1\n\nuno\n\n## p. 2\n\n### HECHOS"
    facts = spark.createDataFrame([(1, "a, b", [("DEMANDANTE", "ALLEGES"), ("DEMANDADO", "DENIES")]), (2, "c", [])], "id int, proposition string, positions array<struct<side:string,position:string>>")
    packages.write_facts_csv(facts, str(tmp_path / "f"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/f").collect()] == [("1", "a, b", "DEMANDANTE", "ALLEGES"), ("1", "a, b", "DEMANDADO", "DENIES")]
    packages.write_questions(spark.createDataFrame([("¿Qué?", "dato", 1), ("que", "lectura", 2)], "text string, label string, made_at int"), str(tmp_path / "q"))
    assert [r.label for r in spark.read.json(f"{tmp_path}/q").collect()] == ["lectura"]
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "case_id int, text string")
    packages.replace_chunks(chunks, str(tmp_path / "c"), "case_id")
    packages.replace_chunks(spark.createDataFrame([(2, "z")], "case_id int, text string"), str(tmp_path / "c"), "case_id")
    assert {(r.case_id, r.text) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {(1, "x"), (2, "z")}
    tables = {"pages": pages, "files": docs.select("case_id", F.col("id").alias("file_id"), F.lit("n").alias("filename"))}
    assert packages.resource(tables, "case://1/pages/d1/2").first().text == "HECHOS" and packages.resource(tables, "case://1/files").count() == 2
    files = spark.createDataFrame([("007 - acta.pdf",), ("acta.pdf",)], "name string")
    index = spark.createDataFrame([("7. Acta", "x")], "title string, e string")
    assert [r.e for r in packages.match_index(files, index, "name", "title").collect()] == ["x"]


def test_speakers_merged_in_circles_and_chains(spark):
    merges = [(1, b, a) for a, b in ["ab", "ba"]] + [(2, b, a) for a, b in ["ab", "bc", "ca", "xa", "yx"]] + [(3, f"s{i + 1:02}", f"s{i:02}") for i in range(20)] + [(4, "a", "a"), (4, "z", "b"), (4, "c", "b")]
    names = {(m, x) for m, k, d in merges for x in (k, d)}
    segments = spark.createDataFrame([(m, x, f"{m}{x}") for m, x in names], "media_id int, speaker_id string, text string")
    moved, left, reviews = corrections.merge_speakers(segments, segments.select("media_id", "speaker_id"), spark.createDataFrame(merges, "media_id int, keep_id string, drop_id string"))
    got = {(r.media_id, r.text[1:]): r.speaker_id for r in moved.collect()}
    assert {x for k, x in got.items() if k[0] == 1} == {"a"} and {x for k, x in got.items() if k[0] == 2} == {"a"}
    assert {x for k, x in got.items() if k[0] == 3} == {"s20"}
    assert (got[4, "a"], got[4, "b"], got[4, "c"], got[4, "z"]) == ("a", "c", "c", "z")
    assert {tuple(r) for r in left.collect()} == {(1, "a"), (2, "a"), (3, "s20"), (4, "a"), (4, "c"), (4, "z")}
    assert reviews.count() == len(names) - 6


def test_earlier_corrections_stay_marked(spark):
    pages = spark.createDataFrame([(1, "old", 0.5, True), (2, "old", 0.5, False), (3, "old", 0.5, None)], "id int, text string, confidence double, human_corrected boolean")
    fixes = spark.createDataFrame([(2, "b", "r", 1), (2, "a", "r", 1), (3, "old", "same", 1)], "id int, new_text string, reason string, made_at int")
    got = {r.id: (r.text, r.human_corrected) for r in corrections.correct_texts(pages, fixes, ["id"], "page")[0].collect()}
    assert got == {1: ("old", True), 2: ("b", True), 3: ("old", False)}


def test_audit_of_laws_aliases_and_policy(spark):
    claims = [
        (1, 1, "Lo dice la Ley 45 de 1990", None), (1, 2, "Lo dice la Ley 9999 de 1990", None), (1, 3, "La Ley 1564 de 2012 impone la condena", None), (1, 4, "La Ley 1564 de 2012 existe", None),
        (1, 5, "Lo firmó J. Rojas", None), (1, 6, "Está probado el pago", "PARTY_ALLEGATION"), (1, 7, "Lo dice la Ley 80 de 1993", None), (2, 1, "Lo dice la Ley 45 de 1990", None), (1, 8, "Rige el artículo 12 del acta", None),
    ]
    cites = [(k, i, "S1" if i == 4 else "D1", None) for k, i, *_ in claims] + [(1, 4, "D2", None)]
    evidence = [(1, "D1", "acta", "acta sobre la ley 80 de 1993", 0.9, None, "page"), (1, "D2", "x", "x", 0.5, None, "page"), (1, "S1", "y", "y", 0.5, None, "segment"), (2, "D1", "acta", "acta", 0.9, None, "page")]
    rules = [("45", "Ley 45 de 1990", "Intereses", None, "co", None, False), ("CGP", "Código", "Ley 1564 de 2012", "procesos", "co", None, True), ("R1", "Código Viejo", None, "El artículo 12 trata del acta antigua", "co", datetime.date(1990, 1, 1), False),
             ("R2", "Código Nuevo", "Artículo 12", "El acta rige desde su firma para todas las partes del proceso y sus apoderados, en los plazos que fija el juez.", "co", datetime.date(2020, 1, 1), False)]
    frame = spark.createDataFrame
    data = (
        frame(claims, "case_id int, claim_id int, text string, claim_type string"), frame(cites, "case_id int, claim_id int, handle string, quote_hash string"),
        frame(evidence, "case_id int, handle string, text string, context string, confidence double, quote string, kind string"), frame([(1, "Juan Rojas Melo", ["J. Rojas"])], "case_id int, name string, aliases array<string>"),
        frame(rules, "identifier string, source string, title string, text string, jurisdiction string, version_date date, law_level_only boolean"),
        frame([], "case_id int"), frame([], "case_id int, text_a string, text_b string"), frame([(1, "co"), (2, "mx")], "case_id int, jurisdiction string"),
    )
    told = lambda policy: {(r.case_id, r.claim_id, r.code, r.severity) for r in guard.audit(*data, policy).collect()}
    want = {
        (1, 2, "LEGAL_RULE_MISSING", "CRITICAL"), (1, 3, "LEGAL_ARTICLE_MISSING", "CRITICAL"), (1, 4, "LOW_OCR_CONFIDENCE", "HIGH"), (1, 5, "PARTY_MISMATCH", "HIGH"),
        (1, 7, "LEGAL_RULE_MISSING", "HIGH"), (2, 1, "LEGAL_RULE_MISSING", "CRITICAL"),
    }
    assert told(None) == want
    assert told({"allowed_jurisdictions": ("co",)}) == want | {(2, None, "JURISDICTION_MISMATCH", "CRITICAL")}
    assert told({"require_legal_norm": False, "block_on_parties": False, "min_ocr_confidence": 0.1}) == {(1, 4, "LOW_ASR_CONFIDENCE", "HIGH")}
    article = guard.rules_for(frame([(1, 8, "article", "12", "co", "Rige el artículo 12 del acta")], "case_id int, claim_id int, kind string, identifier string, jurisdiction string, text string"), data[4], ["case_id", "claim_id"]).first()
    assert article.r.source == "Código Nuevo"


def test_rules_with_long_numbers(spark):
    """A title of five digits or more names that article, not the one of its first four."""
    rules = spark.createDataFrame([("19999", "Artículo 20000", "a"), ("7", "Artículo 123456-78901", "b"), ("8", "artículo 839-01.", "c")], "identifier string, title string, text string").withColumn("source", F.lit("Código"))
    norms = spark.createDataFrame([(i, "article", x, "", "") for i, x in enumerate(["20000", "2000", "123456-78901", "1234", "83901", "19999"])], "k int, kind string, identifier string, jurisdiction string, text string")
    assert {r.identifier: r.r.rule for r in guard.rules_for(norms, rules, ["k"]).collect()} == {"20000": "a", "123456-78901": "b", "83901": "c", "19999": "a"}


def test_compose_streams_questions(spark):
    """Many questions share a task, and a question's claims may lie in several batches; questions without an id are one."""
    rows = [(q, i, ["audio", "evidence", "direct", None][i % 4], [f"D{i}"] if i != 6 else [], [f"p{i}"] if i != 6 else [], q == 2) for q in (None, 1, 2, 3) for i in range(7) if q != 2 or i % 4 != 2]
    df = spark.createDataFrame(rows, "question_id long, claim_id int, kind string, handles array<string>, places array<string>, insufficient boolean")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = guard.compose(df, budget=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {(r.question_id, r.claim_id, r.kind, tuple(r.markers), r.answer_kind) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = [(2, "direct", (1,), "direct"), (1, "evidence", (2,), "direct"), (5, "evidence", (3,), "direct"), (0, "audio", (4,), "direct")]
    assert rows == {(q, *x) for q in (None, 1, 3) for x in one} | {(2, None, None, (), "insufficient")}
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
