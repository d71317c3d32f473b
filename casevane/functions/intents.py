"""What a question asks for: rule families, guard rails, escalation, follow-ups and the retrieval plan, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, fold

# People and roles that a question may count.
ROLE = (
    "(juez|jueza|jueces|juezas|magistrad[oa]s?|apoderad[oa]s?|testig[oa]s?|perit[oa]s?|secretari[oa]s?|partes?|demandant[ea]s?|demandad[oa]s?|fiscal(es)?|abogad[oa]s?"
    "|defensor(es|a|as)?|representantes?|intervinientes?|accionant[ea]s?|accionad[oa]s?|trabajador(es|a|as)?|emplead[oa]s?|soci[oa]s?|accionistas?|hereder[oa]s?)"
)
INVENTORY = "(pagares|titulos(?: valores)?|obligaciones|demandas|inmuebles|bodegas|cheques)"
# Patterns over folded questions by family, in order of precedence; each row is one pattern.
FAMILIES = (
    (
        "correccion",
        "correction_phrase",
        (
            r"\b(corrige|corregir|corrigelo|corrigela|corrijas|correccion|corrigeme|rectifica|rectificar|rectificacion)\b",
            r"\bel hablante es\b",
            r"\bcambia (el|la|de) hablante\b",
            r"\bno es\b[^?]{0,40}\bsino\b",
            r"\ben realidad (es|era|fue)\b",
            r"\b(estoy|estaba|estabas|estabamos) equivocad",
            r"\bconfirmo la correccion\b",
            r"\bactualiza(r)? (la )?(data|informacion|nombre|ficha)\b",
            r"\b(no|nop),? (el|ella) se llama\b",
        ),
    ),
    (
        "navegar",
        "explicit_location_signal",
        (
            r"\bdonde\b[^?]{0,70}\b(aparece|aparecen|se habla|se menciona|se dice|se trata|se registra|se encuentra|se discute|se debate|se analiza|se revisa|esta|estan|consta|quedo|quedan)\b",
            r"\ben que (minuto|minutos|pagina|paginas|archivo|archivos|parte|partes|folio|folios|seccion|momento|timestamp|video|audio|grabacion|documento|documentos)\b",
            r"\ba que (minuto|minutos|hora|pagina|altura)\b",
            r"\ben cual (pagina|minuto|archivo|parte|folio)\b",
            r"\bmomento exacto\b",
            r"\b(localiza|localizar|localizame|localiceme|localice|ubica|ubicame|ubicar|ubicacion)\b",
            r"\btimestamp",
            r"\bbusca la palabra\b|\bbuscar la palabra\b",
            r"\bbusca el termino\b|\bbuscar el termino\b|\bbusca la frase\b",
            r"\bdonde dice\b|\bdonde figuran?\b",
        ),
    ),
    (
        "agregacion",
        "count_or_who_role",
        (
            rf"\b(cuantos|cuantas)\b[^?]{{0,50}}\b{ROLE}",
            rf"\b{ROLE}\b[^?]{{0,50}}\b(cuantos|cuantas)\b",
            r"\bquienes son\b",
            r"\bquienes\b[^?]{0,50}\b(son|intervinieron|participaron|declararon|comparecieron|actuaron|firmaron|suscribieron|aparecen)\b",
            r"\b(cuales|que) (son )?(los|las) (roles|partes|intervinientes|apoderados|jueces|testigos|peritos|nombres)\b",
            r"\b(cuantos|cuantas)\b[^?]{0,50}\b(documentos|anexos|archivos)\b",
            r"\b(cuantos|cuantas)\b[^?]{0,50}\b(medidas|actuaciones|audiencias|declaraciones|hechos)\b",
            r"\b(lista|listado|relacion) de (los |las )?(peritos|testigos|partes|intervinientes|jueces|documentos)\b",
            r"\b(dame|necesito|quiero|hazme)\b[^?]{0,30}\b(lista|listado|nombres|relacion)\b",
            r"\bnombres de\b[^?]{0,30}\b(declararon|intervinieron|comparecieron|participaron)\b",
            r"\bque (intervinientes|partes|testigos|peritos)\b[^?]{0,40}\b(comparecieron|declararon|intervinieron|participaron|firmaron)\b",
            r"\bcuantos son\b",
        ),
    ),
    (
        "procedimental",
        "procedural_cause",
        (
            r"\bpor que\b[^?]{0,70}\b(se llego|llegaron|llego|se profirio|se dicto|se tomo|se decidio|se presento|se interpuso|se origino|se causo|se tramito)\b",
            r"\bque (causo|origino|motivo|condujo|llevo a|genero)\b",
            r"\bque actuacion(es)?\b",
            r"\bactuacion(es)? (que )?(origino|precedio|antecedio)\b",
            r"\bantecedentes\b",
            r"\bcadena procesal\b|\bhistoria procesal\b|\btrazabilidad procesal\b",
            r"\bcomo se llego\b",
            r"\bpor que se\b[^?]{0,40}\b(fallo|sentencio|resolvio|decidio)\b",
            r"\bsecuencia (de )?(actuaciones|actos|hechos)\b",
            r"\bque paso antes\b",
            r"\brecorrido (del|de) proceso\b",
        ),
    ),
    (
        "analisis",
        "analysis_verb",
        (
            r"\bcontradic",
            r"\bcompar(a|ar|alo|ala|alos|alas|acion|ando|ativo|ativa|ado|ada|ados|adas)\b",
            r"\brelacion(a|ar|ado|ada|adas|ados|an|ando)?\b",
            r"\bimplica\b|\bimplicacion(es)?\b",
            r"\bconsecuencia(s)?\b",
            r"\banaliza|\banalizar|\banalisis\b",
            r"\bevalua|\bevaluar|\bevaluacion\b",
            r"\bfortalezas?\b|\bdebilidades?\b",
            r"\bcoherencia\b|\bconsistencia\b",
            r"\bque tan (solido|solida|fuerte|creible|consistente)\b",
            r"\bcomo (se relaciona|impacta|afecta)\b",
            r"\bque dice (cada|la|el) parte\b",
            r"\bposicion (de la|de las|del|de) (cada )?partes?\b",
            r"\bversion (de|del)\b",
            r"\balega\b|\balegan\b|\balego\b|\balegaron\b",
            r"\bexcepcion(es)?\b",
            r"\bdeterminar\b|\bestablecer\b|\bverificar\b|\bcomprobar\b|\bdemostrar\b",
            r"\brevisa(r)?\b|\bindaga(r)?\b|\bexplica(r)? a fondo\b",
            r"\bbusca(r)? en\b",
            r"\busura\b|\bcapitalizacion\b|\banatocismo\b|\bdoble cobro\b",
            r"\bcobro de lo no debido\b|\bespacios en blanco\b|\bprescripcion\b|\bnulidad\b",
            r"\bintereses de (plazo|mora|usura)\b|\bse cobraron\b|\bse pagaron\b",
        ),
    ),
    (
        "analisis",
        "substantive_inventory",
        (
            rf"\b(cuantos|cuantas|cuales|que|lista|listado|inventario)\b[^?]{{0,40}}\b{INVENTORY}",
            rf"\b(busca|buscar|busqueme|encuentra|encuentre)\b[^?]{{0,40}}\b{INVENTORY}",
        ),
    ),
    (
        "lectura",
        "read_document_request",
        (
            r"(?:^|[¿¡]\s*|por favor\s+|puedes\s+|podrias\s+|me\s+)(lee|lees|leer|leeme|leeselo|resume|resumes|resumir|resumeme|sintetiza|sintetizar)\b[^?]{0,50}\b(documento|documentos|archivo|archivos|pdf|adjunto|adjuntos|contrato|demanda|escrito|transcripcion|grabacion|video|audio|caso|esto|eso)\b",
            r"(?:^|[¿¡]\s*)(lee|resume|resumeme|sintetiza)\b[^?]{0,40}\b(este|esta|estos|estas|el|la|los|las|mi|mis)\b",
            r"\b(hazme|hacer|dame|necesito|quiero)\b[^?]{0,25}\bun (resumen|sintesis)\b",
            r"\b(necesito|quiero) entender\b[^?]{0,40}\b(archivo|documento|pdf|escrito|contrato|demanda|grabacion|video)\b",
        ),
    ),
)
# A place that is no place, a fact asked for as a place, a correction of one's own mind.
ABSTRACT_PLACE = r"\bdonde\b[^?]{0,50}\b(contradiccion|contradicciones|diferencia|diferencias|problema|problemas|relacion|relaciones|error|errores|inconsistencia|inconsistencias|sentido|fundamento|motivo)\b"
FACT_PLACE = r"\b(localiza|localizar|localizame|ubica|ubicame)\s+(el|la|los|las)\s+(fecha|monto|valor|nombre|nombres|cifra|numero|precio|plazo)\b"
OWN_MIND = r"\bcorrige\b[^?]{0,20}\b(mi|mi propio)\s+(entendimiento|duda|interpretacion|lectura|conclusion)\b"
# Questions of identity, sources that a question names, and words that join two questions.
IDENTITY = r"\bquien es\b|\bquien fue\b|\bnombre del\b|\bnombre de la\b|\ba que se dedica\b"
SOURCES = r"\b(documentacion|documentos|interrogatorios|hechos|audiencias|pruebas|demanda|contestacion|pagares|transcripcion|grabacion|declaraciones)\b"
CONNECTORS = r"\bque lleve a\b|\by adicional\b|\badicionalmente\b|\bademas\b|\basi como\b|\bjunto con\b"
LONG_WORDS, LEAST_SOURCES = 14, 2
# What leans on the turn before; at most this many words.
FOLLOW_UP = (
    r"^(y|e|pero|entonces|ademas|tambien|ahora)\b"
    r"|\b(eso|esto|esos|esas|aquel|aquella|aquellos|aquellas|el mismo|la misma|los mismos|las mismas|lo mismo|ahi|alli|de esos|de esas|del mismo|de la misma)\b"
    r"|\b(y|ahora) (en|el|la|los|las|con|para|sobre|segun)\b"
)
FOLLOW_UP_WORDS = 10
# Limits of the retrieval plan, usual and deep; words that ask for speech.
USUAL = {"candidates": 80, "final": 18, "documents": 0.6, "per_file": 4, "per_page": 3}
DEEP = {"candidates": 240, "final": 40, "documents": 0.4, "per_file": 8, "per_page": 3}
SPEECH_HINTS = "interrogatorio audiencia declaracion testigo grabacion transcripcion parte version".split()


def rule_intent(c: Column, attachments: Column | None = None) -> Column:
    """``intent, confidence, reason``: the first family that matches, subject to its guard rails.

    One family gives 0.9, several 0.62, an inventory 0.85; attachments without a family are read; else a look-up at 0.45.
    A look-up that crosses sources becomes an analysis (K2).
    """
    q = F.trim(fold(c))
    guard = {"navegar": ~q.rlike(ABSTRACT_PLACE) & ~q.rlike(FACT_PLACE), "correccion": ~q.rlike(OWN_MIND)}
    hit = [F.when(q.rlike("|".join(patterns)) & guard.get(name, F.lit(True)), F.struct(F.lit(name).alias("intent"), F.lit(reason).alias("reason"))) for name, reason, patterns in FAMILIES]

    def decided(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        confidence = F.when(first["reason"] == "substantive_inventory", 0.85).when(F.size(found) == 1, 0.9).otherwise(0.62)
        row = lambda i, k, r: F.struct(i.alias("intent"), k.cast("double").alias("confidence"), r.alias("reason"))
        lit = lambda i, k, r: row(F.lit(i), F.lit(k), F.lit(r))
        read = F.coalesce(attachments, F.lit(False)) if attachments is not None else F.lit(False)
        return F.when(F.size(found) > 0, row(first["intent"], confidence, first["reason"])).when(read, lit("lectura", 0.85, "attachments_present")).when(crosses_sources(c), lit("analisis", 0.8, "multi_source_escalation")).otherwise(lit("dato", 0.45, "default_lookup"))

    return bound(F.filter(F.array(*hit), lambda x: x.isNotNull()), decided)


def crosses_sources(c: Column) -> Column:
    """Two named sources, or a long question with a joining word; never a question of identity (K2)."""
    q = F.trim(fold(c))
    sources = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(SOURCES), F.lit(1))))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return (q != "") & ~q.rlike(IDENTITY) & ((sources >= LEAST_SOURCES) | ((words > LONG_WORDS) & q.rlike(CONNECTORS)))


def leans_back(c: Column) -> Column:
    """A short question that doesn't stand alone (K3)."""
    q = F.trim(fold(c))
    return (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= FOLLOW_UP_WORDS) & q.rlike(FOLLOW_UP)


# Names under which a caller may ask for an intent beside the intent's own.
HINTS = {
    "navigate": "navegar",
    "lookup": "dato",
    "analysis": "analisis",
    "procedural": "procedimental",
    "aggregation": "agregacion",
    "read": "lectura",
    "correction": "correccion",
}


def known_intent(name: Column) -> Column:
    """The intent that a name stands for, in any case; null if it is none."""
    x = F.trim(F.trim(fold(name)), F.lit("."))
    return F.coalesce(F.when(x.isin(*HINTS.values()), x), F.try_element_at(F.create_map(*[F.lit(v) for pair in HINTS.items() for v in pair]), x))


def asks_place(c: Column) -> Column:
    """Whether a question asks for a place in the files, and not for a fact or an idea."""
    q = fold(c)
    return ~q.rlike(ABSTRACT_PLACE) & ~q.rlike(FACT_PLACE) & q.rlike("|".join(next(patterns for name, _, patterns in FAMILIES if name == "navegar")))


def intent_of_turn(c: Column, attachments: Column, correction: Column, hints: Column, previous: Column) -> Column:
    """``intent, confidence, reason`` of a question within its conversation (K1 to K3).

    A correction that the caller declares stands above all rules.  Where no family matches and nothing is attached, the first
    hint that is exactly the name of an intent counts 0.6; hints of other words are passed over.  A question that crosses
    sources doesn't stay a look-up.  A short one that leans back takes over the intent of the last answer with 0.72, unless a
    rule is sure of it, something is attached or hinted, that intent was a correction, or it was a place and this one names none.
    """
    hinted = F.get(F.filter(F.transform(F.coalesce(hints, F.array().cast("array<string>")), known_intent), lambda x: x.isNotNull()), F.lit(0))
    row = lambda intent, confidence, reason: F.struct(intent.alias("intent"), F.lit(confidence).cast("double").alias("confidence"), F.lit(reason).alias("reason"))
    before = known_intent(previous)

    def within(own: Column) -> Column:
        unmatched = own["reason"].isin("default_lookup", "multi_source_escalation")
        asked_for = F.when(crosses_sources(c) & (hinted == "dato"), row(F.lit("analisis"), 0.8, "multi_source_escalation")).otherwise(row(hinted, 0.6, "caller_hint"))
        said = F.when(unmatched & hinted.isNotNull(), asked_for).otherwise(own)

        def inherited(now: Column) -> Column:
            sure = (now["confidence"] >= 0.9) | (now["reason"] == "caller_hint") | F.coalesce(attachments, F.lit(False))
            able = before.isNotNull() & (before != "correccion") & ((before != "navegar") | asks_place(c))
            return F.when(F.coalesce(able & ~sure & leans_back(c), F.lit(False)), row(before, 0.72, "followup_inherit")).otherwise(now)

        return bound(said, inherited)

    return F.when(F.coalesce(correction, F.lit(False)), row(F.lit("correccion"), 1.0, "explicit_correction_flag")).otherwise(bound(rule_intent(c, attachments), within))


def plan_of(c: Column, intent: Column) -> Column:
    """Limits and flags of the retrieval for a question of some intent."""
    deep = intent == "analisis"
    of = lambda k: F.when(deep, F.lit(DEEP[k])).otherwise(F.lit(USUAL[k]))
    speech = deep | reduce(lambda a, b: a | b, [F.contains(fold(c), F.lit(w)) for w in SPEECH_HINTS])
    return F.struct(
        F.greatest(of("candidates"), 4 * of("final")).alias("candidate_k"),
        of("final").alias("final_k"),
        of("documents").alias("doc_quota"),
        of("per_file").alias("max_per_file"),
        of("per_page").alias("max_per_page"),
        speech.alias("wants_speech"),
        intent.isin("dato", "analisis", "lectura").alias("expand_neighbors"),
        intent.isin("dato", "analisis").alias("use_graph"),
    )
