"""Legal text, guard and intent queries.

Their inputs are sentences made from the rows of a table by plain string building, the same for Spark and for the oracle;
the oracle then says by arithmetic what each rule must find, without repeating the rule.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intents as N
from ..functions import legal as L
from ..operators import guard, joins, search
from ..operators.common import cut
from .registry import Tables, query

c = F.col


def pick(words: str, n: str) -> str:
    """The n-th (from 0) of some words, in both dialects."""
    return f"split_part('{words}','|',CAST({n} AS INT)+1)"


MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
O = "o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)"


def made(t: Tables, **columns: str):
    """Orders as k and d, with columns of built text."""
    x = t.orders.select(c("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    return x.select("k", "d", *[F.expr(sql).alias(name) for name, sql in columns.items()])


def written(form: str, d: str) -> str:
    """A date in one of five ways of writing."""
    day, month, year = f"CAST(day({d}) AS STRING)", f"CAST(month({d}) AS STRING)", f"CAST(year({d}) AS STRING)"
    name = pick(MONTHS, f"month({d})-1")
    return (
        f"CASE {form} WHEN 0 THEN {day}||' de '||{name}||' de '||{year} WHEN 1 THEN {name}||' '||{day}||' de '||{year} WHEN 2 THEN {day}||{name}||{year}"
        f" WHEN 3 THEN {year}||'-'||lpad({month},2,'0')||'-'||lpad({day},2,'0') ELSE {day}||'/'||{month}||'/'||lpad(CAST(year({d})%100 AS STRING),2,'0') END"
    )


# ---- norms, consequences, dates, names ----


@query(
    "t36_norms",
    f"WITH {O} SELECT k, 'law:'||(k%2000+1)||' de '||(1990+k%30)||' article:'||(k%400+11)||CASE k%3 WHEN 0 THEN ' article:'||(k%400+12)||' article:'||(k%400+13) WHEN 1 THEN ' article:'||(k%400+19) ELSE '' END AS norms FROM o",
)
def _(t: Tables):
    text = "'Segun los articulos '||(k%400+11)||CASE k%3 WHEN 0 THEN ' a '||(k%400+13) WHEN 1 THEN ' y '||(k%400+19) ELSE '' END||' de la Ley '||(k%2000+1)||' de '||(1990+k%30)||', y el artículo '||(k%400+11)||'.'"
    found = F.transform(L.norms(c("x")), lambda n: F.concat_ws(":", n["kind"], n["identifier"]))
    return made(t, x=text).select("k", F.array_join(found, " ").alias("norms"))


@query(
    "t35_range_expansion",
    f"WITH {O}, a AS (SELECT k, k%60+10 AS n, 100+k%800 AS m FROM o) SELECT k, CASE k%6 WHEN 0 THEN m||'-01' WHEN 1 THEN array_to_string(range(n,n+4),',') WHEN 2 THEN array_to_string(range(n,n+4),',') WHEN 3 THEN n||','||(n+6)||','||(n+9) WHEN 4 THEN m||'-01' ELSE n||'A,'||array_to_string(range(n+1,n+4),',') END AS articles FROM a",
)
def _(t: Tables):
    n, m = "(k%60+10)", "(100+k%800)"
    text = f"CASE k%6 WHEN 0 THEN {m}||'-01' WHEN 1 THEN {n}||'-'||({n}+3) WHEN 2 THEN {n}||' a '||({n}+3) WHEN 3 THEN {n}||' y '||({n}+6)||', '||({n}+9) WHEN 4 THEN {m}||' - 01' ELSE {n}||'A, '||({n}+1)||' al '||({n}+3) END"
    return made(t, x=text).select("k", F.array_join(L.articles(c("x")), ",").alias("articles"))


EFFECTS = "nulidad|prescribe|caducado|embargados|condena|cosa juzgada|multas|revocado|responsabilidad|inexistente"
FAMILIES = "nulidad|prescripcion|caducidad|embargo|condena|cosa_juzgada|multa|revocacion|responsabilidad|inexistencia"


@query("t37_consequences", f"WITH {O}, f AS (SELECT k, {pick(FAMILIES, 'k%10')} AS a, {pick(FAMILIES, '(k+3)%10')} AS b FROM o) SELECT k, least(a,b)||','||greatest(a,b) AS families FROM f")
def _(t: Tables):
    return made(t, x=f"'El auto declara '||{pick(EFFECTS, 'k%10')}||' y '||{pick(EFFECTS, '(k+3)%10')}||' del acto.'").select("k", F.array_join(L.consequences(c("x")), ",").alias("families"))


@query("t27_date_support", f"WITH {O} SELECT k, k%4<>0 AS supported FROM o")
def _(t: Tables):
    other = "(CASE WHEN k%4=0 THEN d + INTERVAL 1 DAY ELSE d END)"
    x = made(t, value=written("k%5", "d"), context=f"'Consta en el acta del '||{written('(k DIV 5)%5', other)}||', a las 10 horas.'")
    return x.select("k", L.date_supported(c("value"), c("context")).alias("supported"))


GIVEN, SECOND, SURNAME, MOTHER = "Juan|Carlos|Diego|Laura|Marta|Elena", "Hernán|Felipe|Rocío|Tomás", "Rojas|Garzón|Mejía|Torres|Vega|Prieto|Lozano", "Melo|Gutiérrez|Salas|Quintero|Ibarra"
_FULL = f"{pick(GIVEN, 'k%6')}||' '||{pick(SECOND, 'k%4')}||' '||{pick(SURNAME, 'k%7')}||' '||{pick(MOTHER, 'k%5')}"


@query("t29_name_compatible", f"WITH {O} SELECT k, (k//6)%6 IN (0,1,2,5) AS same FROM o")
def _(t: Tables):
    form = (
        f"CASE (k DIV 6)%6 WHEN 0 THEN upper({_FULL})||' S.A.S.' WHEN 1 THEN left({pick(GIVEN, 'k%6')},1)||'. '||left({pick(SECOND, 'k%4')},1)||'. '||{pick(SURNAME, 'k%7')}||' '||{pick(MOTHER, 'k%5')}"
        f" WHEN 2 THEN {pick(SURNAME, 'k%7')}||' '||{pick(MOTHER, 'k%5')} WHEN 3 THEN {pick(GIVEN, '(k+1)%6')}||' '||{pick(SECOND, 'k%4')}||' '||{pick(SURNAME, 'k%7')}||' '||{pick(MOTHER, 'k%5')} WHEN 4 THEN {pick(GIVEN, 'k%6')} ELSE {pick(GIVEN, 'k%6')}||' '||{pick(SURNAME, 'k%7')} END"
    )
    return made(t, a=_FULL, b=form).select("k", L.name_compatible(c("a"), c("b")).alias("same"))


TENS, UNITS = "Cuarenta|Cincuenta|Sesenta|Setenta|Ochenta", "Uno|Dos|Tres|Cuatro|Cinco|Seis|Siete|Ocho|Nueve"


@query("t17_authority_signature", f"WITH {O} SELECT k, 'JUZGADO|'||((k%5+4)*10+k%9+1)||'|CIRCUITO,CIVIL,EJECUCION' AS signature FROM o")
def _(t: Tables):
    number = "((k%5+4)*10+k%9+1)"
    name = f"CASE k%3 WHEN 0 THEN 'JUZGADO '||lpad(CAST({number} AS STRING),3,'0') WHEN 1 THEN 'Juzgado '||{pick(TENS, 'k%5')}||' y '||{pick(UNITS, 'k%9')} ELSE 'Juez '||upper({pick(TENS, 'k%5')})||' Y '||upper({pick(UNITS, 'k%9')})||' ('||{number}||')' END||' Civil del Circuito de Ejecución de Bogotá D.C.'"
    return made(t, x=name).select("k", L.authority_signature(c("x")).alias("signature"))


@query("t26_folio", f"WITH {O} SELECT k, CASE WHEN k%6=5 THEN 'none' ELSE CAST(k%900+1 AS VARCHAR) END AS folio FROM o")
def _(t: Tables):
    n = "(k%900+1)"
    page = f"CASE k%6 WHEN 0 THEN 'Folio: '||{n}||' del cuaderno 2' WHEN 1 THEN 'fol '||{n} WHEN 2 THEN 'Pag. '||{n} WHEN 3 THEN 'hoja '||{n}||' vuelta' WHEN 4 THEN 'texto'||chr(10)||'  '||{n}||' '||chr(10)||'sigue' ELSE 'sin numero' END"
    return made(t, x=page).select("k", F.coalesce(L.folio(c("x")), F.lit("none")).alias("folio"))


_PAGES = "SE RESUELVE negar|Anexo: SE RESUELVE|Ver anexos adjuntos|HECHOS de la parte|JUZGADO de reparto|texto sin marca"
_PARTS = "decision|decision|anexos|cuerpo|encabezado|cuerpo"


@query("t31_segment_class", f"WITH {O} SELECT k, {pick(_PARTS, 'k%6')} AS kind FROM o")
def _(t: Tables):
    return made(t, x=pick(_PAGES, "k%6")).select("k", L.segment(c("x")).alias("kind"))


_DOCS = "La demanda inicial|Mandamiento ejecutivo|El auto admite|La sentencia firme|Escrito de apelación|Se ordena el embargo|Acta de audiencia|El dictamen rendido|Póliza de seguro|otra cosa"
_TYPES = "demand|payment_order|ruling|judgment|appeal|injunction|hearing_record|expert_report|policy|other/unknown"


@query("t32_type_by_hints", f"WITH {O} SELECT k, {pick(_TYPES, 'k%10')} AS kind FROM o")
def _(t: Tables):
    return made(t, x=pick(_DOCS, "k%10")).select("k", L.document_type(c("x")).alias("kind"))


@query("t19_entity_type", f"WITH {O} SELECT k, {pick('organization|organization|person|organization|person', 'k%5')} AS kind FROM o")
def _(t: Tables):
    return made(t, x=pick("Banco Andino|Comercial Norte S.A.S.|Ana Rojas|Inversiones del Valle Ltda.|Pedro Casas", "k%5")).select("k", L.entity_type(c("x")).alias("kind"))


@query("t38_role_side", f"WITH {O} SELECT k, {pick('DEMANDANTE|DEMANDADO|DEMANDADO|TERCERO|DEMANDANTE', 'k%5')} AS side FROM o")
def _(t: Tables):
    return made(t, x=pick("Claimant|defendant|EJECUTADO|witness|ejecutante", "k%5")).select("k", L.side(c("x")).alias("side"))


_SAID = "Niego los hechos|Reconozco la deuda|Ana Rojas niega todo|El testigo niega todo|Alegamos el pago|Yo no niego nada|Admite la firma|No acepto la suma|Ana Rojas sostiene eso"
_STANCES = "DENIES|ADMITS|DENIES|UNKNOWN|ALLEGES|UNKNOWN|ADMITS|DENIES|ALLEGES"


@query("t39_stance", f"WITH {O} SELECT k, CASE WHEN k%7=0 THEN 'UNKNOWN' ELSE {pick(_STANCES, 'k%9')} END AS stance FROM o")
def _(t: Tables):
    x = made(t, x=pick(_SAID, "k%9"), speaker="CASE WHEN k%14=0 THEN NULL WHEN k%7=0 THEN 'p2' ELSE 'p1' END")
    return x.select("k", L.stance(c("x"), F.lit("Ana Rojas"), c("speaker"), F.lit("p1")).alias("stance"))


_RULE = "CASE WHEN k%4=3 THEN 'Artículo '||(k%90+400)||'.' ELSE 'Artículo '||(k%90+400)||'. La nulidad y el embargo de los bienes del deudor se decretan por el juez cuando exista mandamiento de pago contra el deudor moroso.' END"
_BORNE = "'El artículo '||(k%90+400)||CASE k%4 WHEN 1 THEN ' impone la condena del deudor' WHEN 2 THEN ' permite viajes turisticos internacionales gratuitos' ELSE ' decreta el embargo de los bienes del deudor' END"


@query("v7_article_support", f"WITH {O} SELECT k, {pick('OK|LEGAL_CONSEQUENCE_UNSUPPORTED|LEGAL_ARTICLE_LOW_OVERLAP|LEGAL_ARTICLE_TEXT_MISSING', 'k%4')} AS finding, {pick('OK|CRITICAL|HIGH|HIGH', 'k%4')} AS severity FROM o")
def _(t: Tables):
    x = made(t, rule=_RULE, claim=_BORNE).select("k", L.article_support(c("rule"), c("claim")).alias("s"))
    return x.select("k", F.coalesce("s.code", F.lit("OK")).alias("finding"), F.coalesce("s.severity", F.lit("OK")).alias("severity"))


# ---- the audit ----

_DATE = f"CAST(day(d) AS STRING)||' de '||{pick(MONTHS, 'month(d)-1')}||' de '||CAST(year(d) AS STRING)"
_OTHER = f"CAST(day(d) AS STRING)||' de '||{pick(MONTHS, 'month(d)%12')}||' de '||CAST(year(d) AS STRING)"
_CLAIM = (
    "'El radicado '||(k+1000)||CASE k%15 WHEN 2 THEN ' por la suma de 7654321' WHEN 3 THEN ' del '||" + _DATE + " WHEN 4 THEN ' fue firmado por Juan Hernán Rojas Melo'"
    " WHEN 6 THEN ' cumple el artículo 42-9 del expediente' WHEN 8 THEN ' es un hecho probado' WHEN 9 THEN ' segun el artículo 500 impone la condena'"
    " WHEN 10 THEN ' consta segun la Ley '||(k%900+20000)||' de 2001' WHEN 11 THEN ' tiene responsabilidad por la Ley 1564 de 2012' ELSE ' consta en el acta' END"
)
_SOURCE = "'Radicado '||(k+1000)||' del acta'||CASE WHEN k%15=3 THEN ' del '||" + _OTHER + " ELSE '' END"
_CODES = (
    "CITATION_MISSING|CITATION_UNRESOLVED|NUMBER_MISMATCH|DATE_MISMATCH|PARTY_MISMATCH|LOW_OCR_CONFIDENCE|LEGAL_RULE_MISSING|QUOTE_MISMATCH|DECISION_MISSING|LEGAL_CONSEQUENCE_UNSUPPORTED"
    "|LEGAL_RULE_MISSING|LEGAL_ARTICLE_MISSING|JURISDICTION_MISMATCH|LOW_ASR_CONFIDENCE|CONTRADICTION_OMITTED"
)
_SEVERITIES = "CRITICAL|CRITICAL|CRITICAL|CRITICAL|HIGH|HIGH|CRITICAL|CRITICAL|CRITICAL|CRITICAL|CRITICAL|CRITICAL|CRITICAL|HIGH|HIGH"
#: An order is a case with one claim; every eleventh has nothing wrong, nor has what is said to be proven where an even order has a decision.
FOUND = f"{O}, f AS (SELECT k AS case_id, {pick(_CODES, 'k%15')} AS code, {pick(_SEVERITIES, 'k%15')} AS severity FROM o WHERE k%11<>0 AND NOT (k%15=8 AND k%2=0))"


def audited(t: Tables):
    """The claims, and what the audit finds."""
    x = made(t, text=f"CASE WHEN k%11=0 THEN 'El radicado '||(k+1000)||' consta en el acta' ELSE {_CLAIM} END", source=_SOURCE).withColumn("bad", F.when(c("k") % 11 == 0, -1).otherwise(c("k") % 15)).withColumn("case_id", c("k"))
    claims = x.select("case_id", F.lit(1).alias("claim_id"), "text")
    cites = x.filter("bad <> 0").select("case_id", F.lit(1).alias("claim_id"), F.when(c("bad") == 1, "D9").otherwise("D1").alias("handle"), F.when(c("bad") == 7, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("source", 256)).alias("quote_hash"))
    evidence = x.select(
        "case_id", F.lit("D1").alias("handle"), c("source").alias("text"), F.concat("source", F.lit(" acta.pdf")).alias("context"), F.when(c("bad").isin(5, 13), 0.4).otherwise(0.9).alias("confidence"),
        c("source").alias("quote"), F.when(c("bad") == 13, "segment").otherwise("page").alias("kind"),
    )
    parties = x.select("case_id", F.lit("Juan Hernán Rojas Melo").alias("name"), F.array(F.lit("Melo Pinto"), F.lit("Rojas Melo")).alias("aliases"))
    rules = t.spark.createDataFrame([
        ("500", "Codigo Civil", "Artículo 500. El embargo de los bienes del radicado y del acta se decreta por el juez cuando exista mandamiento de pago.", "co", False),
        ("CGP", "Ley 1564 de 2012", "Código General del Proceso", "co", True), ("42-9", "Otra parte", "Artículo 42-9. De otro lugar.", "mx", False),
    ], "identifier string, source string, text string, jurisdiction string, law_level_only boolean")
    decisions = x.filter("k % 2 = 0").select("case_id")
    contradictions = x.filter("bad = 14").select("case_id", c("text").alias("text_a"), F.lit("Ninguna firma aparece sobre aquel papel amarillo").alias("text_b"))
    cases = x.select("case_id", F.when(c("bad") == 12, "mx").otherwise("co").alias("jurisdiction"))
    return claims, guard.audit(claims, cites, evidence, parties, rules, decisions, contradictions, cases, {"allowed_jurisdictions": ("co",)})


@query("v6_guard_findings", f"WITH {FOUND} SELECT case_id, code, severity FROM f")
def _(t: Tables):
    return audited(t)[1].select("case_id", "code", "severity")


@query("v8_final_status", f"WITH {FOUND} SELECT k AS case_id, CASE WHEN code IS NULL THEN 'PASSED' WHEN severity='CRITICAL' AND code<>'JURISDICTION_MISMATCH' THEN 'BLOCKED' ELSE 'WARNING' END AS status FROM o LEFT JOIN f ON case_id=k")
def _(t: Tables):
    claims, found = audited(t)
    return guard.final_status(claims, cut(found))


_KINDS = "limit|direct|direct|evidence|audio|direct"


@query("v11_claim_kind", f"WITH {O} SELECT k, {pick(_KINDS, 'k%6')} AS kind FROM o")
def _(t: Tables):
    x = made(
        t,
        question=pick("¿Cuánto se pagó?|¿Qué dice el contrato de arriendo?|¿Quiénes firmaron?|¿Qué dice el contrato?|¿Hubo fraude contable?|¿Cuándo se firmó?", "k%6"),
        claim=pick("Se pagaron 500 pesos|El contrato de arriendo fija el canon|Ana Rojas estuvo presente|La bodega quedó vacía|Bueno, nosotros fuimos temprano|Ocurrió en marzo de 1998", "k%6"),
        context=pick("Se pagaron 400 pesos|El contrato de arriendo fija el canon|Ana Rojas estuvo presente|La bodega quedó vacía|Bueno, nosotros fuimos temprano|Ocurrió en marzo de 1998", "k%6"),
    )
    speech = c("k") % 6 == 4
    return x.select("k", guard.claim_kind(c("question"), c("claim"), c("context"), speech, speech, F.lit(False)).alias("kind"))


@query(
    "v11_compose",
    "WITH l AS (SELECT l_orderkey AS q, l_linenumber AS i, CASE WHEN (l_orderkey+l_linenumber)%3=0 THEN 0 WHEN (l_orderkey+l_linenumber)%3=1 THEN 1 ELSE 2 END AS kind FROM lineitem), m AS (SELECT q, i, min(kind) AS kind FROM l GROUP BY 1,2),"
    " d AS (SELECT q, min(kind)=0 AS direct FROM m GROUP BY 1), a AS (SELECT m.*, direct, row_number() OVER (PARTITION BY m.q, kind ORDER BY i) AS nth FROM m JOIN d USING(q)),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY kind, i) AS pos FROM a WHERE direct OR kind<>1 OR nth<=3)"
    " SELECT q AS question_id, i AS claim_id, ['direct','evidence','audio'][kind+1] AS kind, CAST(pos AS VARCHAR) AS markers, CASE WHEN direct THEN 'direct' ELSE 'partial' END AS answer_kind FROM b WHERE pos<=4",
)
def _(t: Tables):
    # Lines of an order are claims with a source of their own; the budget is four sources.
    kind = (c("l_orderkey") + c("l_linenumber")) % 3
    x = t.lineitem.select(c("l_orderkey").alias("question_id"), c("l_linenumber").alias("claim_id"), F.when(kind == 0, "direct").when(kind == 1, "evidence").otherwise("audio").alias("kind"))
    x = x.repartition("question_id").distinct()  # dealt once: a question's claims are together from here on
    own = F.concat(F.lit("D"), c("claim_id").cast("string"))
    x = x.select("*", F.array(own).alias("handles"), F.array(F.concat(F.lit("p"), own)).alias("places"), F.lit(False).alias("insufficient"))
    return guard.compose(x, budget=4).select("question_id", "claim_id", "kind", F.array_join(c("markers").cast("array<string>"), ",").alias("markers"), "answer_kind")


# ---- intents ----

_ASKED = (
    "Corrige el nombre del testigo|¿Dónde aparece el pagaré 001?|¿Cuántos testigos declararon?|¿Por qué se llegó a la sentencia?|Compara las versiones|¿Qué pagarés se firmaron?|Resume este documento"
    "|¿Cuál es el monto?|¿Dónde está la contradicción?|Localiza la fecha|documentos y audiencias del lunes|Corrige mi duda|¿Quién es el perito de las audiencias y pruebas?|¿Dónde aparece la nulidad?"
)
_INTENTS = "correccion|navegar|agregacion|procedimental|analisis|analisis|lectura|dato|analisis|dato|analisis|dato|dato|navegar"
_SURE = "0.9|0.9|0.9|0.9|0.9|0.85|0.9|0.45|0.9|0.45|0.8|0.45|0.45|0.62"


@query("k1_rule_intent", f"WITH {O} SELECT k, {pick(_INTENTS, 'k%14')} AS intent, CAST({pick(_SURE, 'k%14')} AS DOUBLE) AS confidence FROM o")
def _(t: Tables):
    return made(t, x=pick(_ASKED, "k%14")).select("k", N.rule_intent(c("x")).alias("i")).select("k", "i.intent", "i.confidence")


@query("k2_multi_source", f"WITH {O} SELECT k, k%14 IN (10) AS escalates FROM o")
def _(t: Tables):
    return made(t, x=pick(_ASKED, "k%14")).select("k", N.crosses_sources(c("x")).alias("escalates"))


@query(
    "k3_follow_up",
    f"WITH {O}, i AS (SELECT k, {pick(_INTENTS, 'k%14')} AS intent FROM o), p AS (SELECT k, lag(intent) OVER (PARTITION BY k%50 ORDER BY k) AS before FROM i) SELECT k, CASE WHEN k%4 IN (0,2) THEN coalesce(before,'own') ELSE 'own' END AS mode FROM p",
)
def _(t: Tables):
    # A conversation is a fiftieth of the orders; a short turn that leans back takes over the intent of the one before.
    x = made(t, asked=pick(_ASKED, "k%14"), now="CASE k%4 WHEN 0 THEN '¿y eso?' WHEN 1 THEN '¿Cuál es el monto?' WHEN 2 THEN 'ahora en la página 12' ELSE 'Y una pregunta larga que no cabe en tan pocas palabras como las de antes' END")
    x = x.withColumn("intent", N.rule_intent(c("asked"))["intent"]).withColumn("before", F.lag("intent").over(W.partitionBy(c("k") % 50).orderBy("k")))
    return x.select("k", F.when(N.leans_back(c("now")), F.coalesce("before", F.lit("own"))).otherwise("own").alias("mode"))


@query(
    "x26_retrieval_plan",
    f"WITH {O}, i AS (SELECT k, {pick(_INTENTS, 'k%14')} AS intent FROM o) SELECT k, CASE WHEN intent='analisis' THEN 240 ELSE 80 END AS candidate_k, CASE WHEN intent='analisis' THEN 40 ELSE 18 END AS final_k, CASE WHEN intent='analisis' THEN 8 ELSE 4 END AS max_per_file,"
    " intent='analisis' OR k%14 IN (0,2,12) AS wants_speech, intent IN ('dato','analisis','lectura') AS expand_neighbors FROM i",
)
def _(t: Tables):
    x = made(t, x=pick(_ASKED, "k%14")).select("k", N.plan_of(c("x"), N.rule_intent(c("x"))["intent"]).alias("p"))
    return x.select("k", "p.candidate_k", "p.final_k", "p.max_per_file", "p.wants_speech", "p.expand_neighbors")


# ---- ranking rules over made items ----


@query("r5_entity_score", f"WITH {O} SELECT k, CAST({pick('1.0|0.6|0.4|0.0|0.0', 'k%5')} AS DOUBLE) AS score FROM o")
def _(t: Tables):
    x = made(t, question=pick("¿Qué firmó Ana Rojas ayer?|¿Qué dice la bodega?|¿Qué dice la bodega?|Pagos de la bodega|¿Qué firmó?", "k%5"), text=pick("firma de ana rojas|acta|acta|acta|acta", "k%5"), entity=pick("otro|bodega|bodegas del norte|finca|finca", "k%5"))
    return x.select("k", search.entity_score(c("question"), c("text"), F.array("entity")).alias("score"))


@query("r6_source_prior", f"WITH {O} SELECT k, CASE WHEN (k%2=0) = (k%3=0) THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS prior FROM o")
def _(t: Tables):
    x = made(t, question="CASE WHEN k%3=0 THEN '¿Qué dijo el testigo?' ELSE '¿Cuál es el monto?' END")
    return x.select("k", search.source_prior(c("k") % 2 == 0, c("question"), F.lit(False)).alias("prior"))


@query(
    "r3_page_dedupe",
    "SELECT l_orderkey, arg_max(l_linenumber, (round(l_extendedprice,9), l_linestatus='O', -l_linenumber)) AS line FROM lineitem GROUP BY 1",
)
def _(t: Tables):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(c("l_linestatus") == "O", "document_ai").otherwise("basico").alias("mode"))
    return search.dedupe_pages(x, ["l_orderkey"], "l_extendedprice", "mode", "l_linenumber").select("l_orderkey", c("l_linenumber").alias("line"))


_SPEECH = "s AS (SELECT l_orderkey AS media_id, l_linestatus AS speaker, l_linenumber*1500+(l_partkey%3)*400 AS start_ms, l_linenumber*1500+(l_partkey%3)*400+600 AS end_ms, repeat('x', l_suppkey%9+1) AS text, l_extendedprice AS score FROM lineitem)"


@query(
    "r4_transcript_dedupe",
    f"WITH {_SPEECH}, b AS (SELECT media_id, speaker, start_ms//2000 AS slot, arg_max({{'a':start_ms,'e':end_ms,'t':text,'s':score}}, (score,-start_ms)) AS r FROM s GROUP BY 1,2,3), u AS (SELECT media_id, speaker, r.a AS a, r.e AS e, r.t AS t, r.s AS sc FROM b),"
    " g AS (SELECT *, sum(CASE WHEN a-p BETWEEN 0 AND 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id, speaker ORDER BY a) AS run FROM (SELECT *, lag(e) OVER (PARTITION BY media_id, speaker ORDER BY a) AS p FROM u))"
    " SELECT media_id, speaker, min(a) AS start_ms, max(e) AS end_ms, max(length(t)) AS longest, round(max(sc),2) AS score FROM g GROUP BY media_id, speaker, run",
)
def _(t: Tables):
    start = c("l_linenumber") * 1500 + (c("l_partkey") % 3) * 400
    x = t.lineitem.select(c("l_orderkey").alias("media_id"), c("l_linestatus").alias("speaker"), start.alias("start_ms"), (start + 600).alias("end_ms"), F.repeat(F.lit("x"), (c("l_suppkey") % 9 + 1).cast("int")).alias("text"), c("l_extendedprice").alias("score"))
    return search.dedupe_speech(x).select("media_id", "speaker", "start_ms", "end_ms", F.length("text").cast("long").alias("longest"), F.round("score", 2).alias("score"))


@query("r9_neighbours", "SELECT o_custkey, array_to_string((list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey))[1:2], ',') AS near FROM orders GROUP BY 1")
def _(t: Tables):
    near = t.orders.withColumn("rn", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("rn <= 3")
    listed = near.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("a"))  # three at most
    return listed.select("o_custkey", F.array_join(search.neighbours(c("a")), ",").alias("near"))


# ---- names of speech from events and introductions ----


@query(
    "z9_event_window_naming",
    "WITH s AS (SELECT l_orderkey AS m, l_linenumber AS i, min(l_partkey%40)*10000 AS a FROM lineitem GROUP BY 1,2), e AS (SELECT l_orderkey AS m, l_suppkey%60*10000 AS t, min(l_suppkey) AS n FROM lineitem GROUP BY 1,2)"
    " SELECT m, i, arg_max(n, t) AS name FROM s JOIN e USING(m) WHERE t<=a+5000+20000 AND t>=a-150000 GROUP BY 1,2",
)
def _(t: Tables):
    s = t.lineitem.groupBy(c("l_orderkey").alias("m"), c("l_linenumber").alias("i")).agg((F.min(c("l_partkey") % 40) * 10000).alias("a"))
    e = t.lineitem.groupBy(c("l_orderkey").alias("m"), (c("l_suppkey") % 60 * 10000).alias("t")).agg(F.min("l_suppkey").alias("n"))
    return joins.last_event(s, e, "m", "i", "a", c("a") + 5000, "t", "n", after=20_000, before=150_000).select("m", "i", "name")


@query(
    "z10_block_naming",
    "WITH s AS (SELECT l_orderkey AS m, l_linenumber AS i, min(l_partkey%40)*1000 AS a FROM lineitem GROUP BY 1,2), e AS (SELECT l_orderkey AS m, l_suppkey%60*1000 AS t, min(l_suppkey) AS n FROM lineitem GROUP BY 1,2)"
    " SELECT m, i, arg_max(n, t) AS name FROM s JOIN e USING(m) WHERE t<=a+3000 GROUP BY 1,2",
)
def _(t: Tables):
    s = t.lineitem.groupBy(c("l_orderkey").alias("m"), c("l_linenumber").alias("i")).agg((F.min(c("l_partkey") % 40) * 1000).alias("a"))
    e = t.lineitem.groupBy(c("l_orderkey").alias("m"), (c("l_suppkey") % 60 * 1000).alias("t")).agg(F.min("l_suppkey").alias("n"))
    return joins.last_event(s, e, "m", "i", "a", c("a"), "t", "n", after=3_000).select("m", "i", "name")
