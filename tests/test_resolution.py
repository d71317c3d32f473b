"""The cascade of sources on literal rows: one fact for each step."""

from casevane.operators import resolution

PAGE, SEG = "page_id long, document_id long, page_number long, text string", "segment_id long, media_id long, start_ms long, text string"


def test_first_found(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id int")
    seen = []

    def step(wanted):
        def run(rest):
            seen.append(sorted(r.id for r in rest.collect()))
            return rest.filter(f"id % {wanted} = 0")

        return run

    got = {r.id: r.step for r in resolution.first_found(rows, ["id"], [step(4), step(2), step(3)]).collect()}
    assert got == {0: 1, 4: 1, 2: 2, 3: 3} and seen == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 5], [1, 3, 5]]


def test_named_days(spark):
    df = spark.createDataFrame([("Firma del 7 de marzo de 2024 y 15 de Setiembre 2023", "Audiencia_15Sep2023 y 07Mar2024.mp4")], "fact string, name string")
    r = df.select(resolution._days(df.fact).alias("d"), resolution._named_days(df.name).alias("n")).first()
    assert r.d == ["7mar2024", "15sep2023"] and {"15sep2023", "5sep2023", "07mar2024", "7mar2024"} <= set(r.n)


def test_each_step_of_the_cascade(spark):
    q = "contrato pagare embargo vehiculo notaria banco"
    questions = spark.createDataFrame([(1, q), (2, "contrato"), (3, None), (4, "notaria desconocida pagare")], "question_id long, text string")
    facts = [
        (10, "El contrato firmado el 7 de marzo de 2024 en notaria", "ALLEGED"),
        (20, "El contrato y el pagare constan", "ALLEGED"),
        (30, "El pagare y el embargo constan", "ADMITTED"),
        (40, "El embargo del vehiculo consta", None),
        (50, "El vehiculo y el banco constan", "DISPUTED"),
        (60, "La notaria y el vehiculo azul", "EVIDENCE_SUPPORTED"),
        (70, "El banco y la notaria verde", "ALLEGED"),
        (80, "El pagare lunar inexistente jamas", "ALLEGED"),
        (90, "contrato", "JUDICIALLY_PROVEN"),
    ]
    facts = spark.createDataFrame(facts, "fact_id long, text string, proof_status string")
    pages = spark.createDataFrame([
        (1, 100, 1, "nada sobre el tema"), (2, 100, 2, "embargo del vehiculo ordenado"), (3, 101, 1, "vehiculo azul inscrito en notaria"), (4, 102, 9, "contrato contrato contrato contrato"), (5, 103, 1, None),
    ], PAGE)
    segments = spark.createDataFrame([(1, 200, 5000, "firmado el contrato ante notaria en marzo"), (2, 200, 1000, "contrato sin mas"), (3, 201, 0, "el vehiculo del banco"), (4, 202, 70, "banco verde y notaria abierta")], SEG)
    media = spark.createDataFrame([(200, "Audiencia 07Mar2024.mp4"), (201, "otra.mp4"), (202, None)], "media_id long, filename string")
    citations = spark.createDataFrame([
        (1, 20, 100, 7, None, None, None), (2, 20, 100, 3, None, None, None), (3, None, None, None, 201, 3, 0), (4, 10, 100, 1, None, None, None), (5, 60, None, None, None, None, None),
    ], "citation_id long, fact_id long, document_id long, page_number long, media_id long, segment_id long, start_ms long")
    positions = spark.createDataFrame([(30, 3), (30, 3), (40, None)], "fact_id long, citation_id long")
    links = spark.createDataFrame([(40, 100, None), (50, None, 201), (50, 102, None)], "fact_id long, document_id long, media_id long")
    got = resolution.facts_for_questions(questions, facts, pages, segments, media, citations, positions, links, limit=9).collect()
    mine = {r.fact_id: (r.step, r.document_id, r.page_number, r.segment_id) for r in got if r.question_id == 1}
    assert mine == {
        10: (1, None, None, 1),  # named after the day, though it has a citation
        20: (2, 100, 3, None),  # the least page of its citations
        30: (3, None, None, 3),
        40: (4, 100, 2, None),
        # 50 resolves to segment 3 (step 5), which fact 30 has already; 60 has a citation without a source
        70: (7, None, None, 4),
    }
    order = [r.fact_id for r in sorted(got, key=lambda r: r.place) if r.question_id == 1]
    assert order[0] == 30 and [r.place for r in sorted(got, key=lambda r: r.place) if r.question_id == 1] == list(range(1, len(order) + 1))
    assert not any(r.question_id in (2, 3) for r in got)
    few = resolution.facts_for_questions(questions.limit(1), facts.filter("fact_id in (50, 60)"), pages, segments, media, citations.filter("fact_id <> 60"), positions, links).collect()
    assert {r.fact_id: (r.step, r.document_id, r.segment_id) for r in few} == {50: (5, None, 3), 60: (6, 101, None)}
