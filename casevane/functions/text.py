"""Text functions as Column expressions: folding, tokens, stems, coverage, numbers, dates and signatures."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that ``unaccent`` replaces, each by the letter at the same place.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def _decomposed() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and marks, and those letters."""
    pairs = []
    for cp in (*range(0xA0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000), *range(0xFF10, 0xFF5B)):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(cp).lower()) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_COMPOSED, _BASE = _decomposed()

# Words that carry no topic, in the folded form in which they are compared.
STOP_WORDS = (
    "a al algo algun alguna alguno algunos ante antes aquel aquella aquello aun bajo cabe cada casi como con contra cual cuales cuando cuanta cuanto cuantos"
    " de debe del desde despues donde durante e el ella ello ellos en entre era eran es esa ese eso esos esta estan estar este esto estos fue fueron ha haber"
    " habia han has hasta hay haya he hubo la las le les lo los mas me mi mia mio muy nada ni no nos nosotros o os otra otro otros para pero podeis poder podria"
    " por porque pudo pueda puede pueden pues que quien quienes se sea sean segun ser sera si sin sobre son su sus tambien tan tanto te tenia tener ti tiene"
    " tienen todo todos tras tu tus un una uno unos vosotros vuestra vuestro y ya yo"
).split()
QUESTION_WORDS = (
    "que quien quienes cual cuales cuanto cuanta cuantos cuantas como cuando donde porque para por cuyo cuya el la los las un una unos unas del de al a en con"
    " sin sobre entre desde hasta hacia es son fue fueron ser esta estan este esto estos estas ese esa esos esas hay tiene tienen hace hacen me te se le les lo"
    " mi tu su sus nos puedes podrias decir dime cuentame resume resumen explica explicar dame muestra muestrame sabes saber conocer informacion trata consta"
    " obra ver listar lista encontrar busca buscar encuentra localiza ubicar aparece aparecen menciona mencionan menciono habla hablan hablo dice dicen dijo"
    " dijeron senala senalar indica indican registra registran figura figuran existe existen contiene presenta presentan solicita solicitan realiza realizan tramita"
).split()
REPORT_WORDS = (
    "evidencia evidencias prueba pruebas probatorio probatoria documento documentos archivo archivos expediente expedientes carpeta caso casos hecho hechos dato"
    " datos soporte soportes informacion detalle detalles resumen resumenes pagina paginas folio folios anexo anexos video videos audio audios grabacion"
    " grabaciones audiencia audiencias transcripcion minuto minutos segundo segundos hora horas momento momentos parte partes seccion apartado capitulo doctor"
    " doctora senor senora dicho dicha"
).split()

# Fixed value: what a word is.
WORD = r"[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+(?:[.,][0-9]+)*"
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


# Words too general to be looked up alone.
GENERIC = (
    "oficio numero num radicado proceso procesal ejecutiva ejecutivo acumulada acumulado cautelar cautelares medidas demanda contestacion"
    " sentencia auto providencia recurso apelacion audiencia diligencia"
).split()
# Headings that count as such whatever their length, and ordinals that begin one.
KNOWN_HEADINGS = (
    "HECHOS|PRETENSIONES|PETICIONES|FUNDAMENTOS|FUNDAMENTOS DE DERECHO|CONTESTACIÓN|CONTESTACION|RESUELVE|RESUELVO|CONSIDERANDO|CONSIDERACIONES|ANTECEDENTES|DECIDE"
    "|DECISIÓN|DECISION|RESUMEN|ASUNTO|PARTES|PRUEBAS|ANEXOS|DECLARACIONES|NOTIFICACIÓN|NOTIFICACION|APELACIÓN|APELACION|ANTECEDENTES PROCESALES|ACTUACIÓN PROCESAL"
    "|ACTUACION PROCESAL|COMPETENCIA|LEGITIMACIÓN|LEGITIMACION|PROCEDIMIENTO|CONCLUSIONES|SOLICITUD|PODER"
).split("|")
ORDINALS = "PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[ÉE]PTIMO|OCTAVO|NOVENO|D[ÉE]CIMO"
# Fixed value: what begins a list item.
LIST_MARK = r"^(?:[-•*·▪◦]|[0-9]{1,3}[.)])\s+"


def fold(c: Column) -> Column:
    """Lower case without accents: the base letters of the compatibility decomposition; null as empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), _COMPOSED, _BASE), r"\p{M}+", "")


def unaccent(c: Column) -> Column:
    """Lower case, then exactly the letters of the fixed table; null as empty."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)


def raw_tokens(c: Column, least: int = 2) -> Column:
    """Words, and numbers with inner separators, of at least ``least`` characters."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= least)


def _terms(c: Column, drop: list[str], least: int) -> Column:
    keys = F.transform(raw_tokens(c, least), fold)
    return F.array_distinct(F.filter(keys, lambda t: (F.length(t) >= least) & ~t.isin(*drop)))


def content_terms(c: Column, least: int = 3) -> Column:
    """Distinct folded tokens without stop, question and report words, in order (T4)."""
    return _terms(c, [*STOP_WORDS, *QUESTION_WORDS, *REPORT_WORDS], least)


def search_terms(c: Column, least: int = 3) -> Column:
    """As content terms, with report words kept (T5)."""
    return _terms(c, [*STOP_WORDS, *QUESTION_WORDS], least)


def stem(w: Column) -> Column:
    """Plural endings off a folded word."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(n <= 4, w)
        .when(w.endswith("ces") & (n > 5), F.concat(cut(3), F.lit("z")))
        .when(w.endswith("es") & (n > 5), F.when(F.substring(w, n - 2, F.lit(1)).isin(*"lrndz"), cut(2)).otherwise(cut(1)))
        .when(w.endswith("s"), cut(1))
        .otherwise(w)
    )


def content_set(c: Column) -> Column:
    """Distinct stems of the content terms."""
    return F.array_distinct(F.transform(content_terms(c), stem))


def share_in(terms: Column, pool: Column, if_empty: float = 1.0) -> Column:
    """Share of the terms that the pool has."""
    return F.when(F.size(terms) == 0, F.lit(if_empty)).otherwise(F.size(F.array_intersect(terms, pool)) / F.size(terms))


def tolerant_share(terms: Column, pool: Column) -> Column:
    """As ``share_in``, where long terms also match by prefix with up to two letters more or less; 0.5 without terms (R2)."""

    def near(t: Column) -> Column:
        return F.exists(
            pool, lambda o: (F.length(t) >= 4) & (F.length(o) >= 4) & (F.abs(F.length(o) - F.length(t)) <= 2) & (F.startswith(o, t) | F.startswith(t, o))
        )

    hits = F.size(F.filter(terms, lambda t: F.array_contains(pool, t) | near(t)))
    return F.when(F.size(terms) == 0, F.lit(0.5)).otherwise(hits / F.size(terms))


def numbers(c: Column) -> Column:
    """Digit runs without their separators."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9][0-9.,]*"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, "[.,]", ""))


def missing_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of the claim that the evidence lacks, repeats kept."""
    known = numbers(evidence)
    return F.filter(numbers(claim), lambda x: ~F.array_contains(known, x))


def mmss(ms: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from an hour on."""
    s = F.floor(ms / 1000).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def normal_name(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]", "")


def character_error(reference: Column, other: Column) -> Column:
    """Edit distance per reference character; an empty reference gives 0 or 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(other) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, other) / F.length(reference))


def content_signature(c: Column) -> Column:
    """Letters and digits of the folded text."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def edit_confidence(base: Column, old: Column, new: Column) -> Column:
    """Confidence less the changed share of the content; 0 for an empty old text."""
    a, b = content_signature(old), content_signature(new)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(F.length(a) == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), base - F.levenshtein(a, b) / longest), 5))


def tidy(c: Column) -> Column:
    """Stray glyphs out, white space collapsed."""
    glyphs = F.regexp_replace(F.coalesce(c, F.lit("")), "[|~^_*#$%&<>]+", " ")
    return F.trim(F.regexp_replace(glyphs, r"[ \t\n\r]+", " "))


def spanish_date(c: Column) -> Column:
    """First long or numeric date as a date; impossible ones are null."""
    text = fold(c)
    long = rf"([0-9]{{1,2}}) de ({'|'.join(MONTHS)}) (?:de|del) ([0-9]{{4}})"
    month = reduce(lambda acc, m: acc.when(F.regexp_extract(text, long, 2) == m[1], m[0] + 1), enumerate(MONTHS), F.when(F.lit(False), 0))
    part = lambda pattern, i: F.expr("1").cast("int") * F.regexp_extract(text, pattern, i).try_cast("int")
    iso, dmy = r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"

    def made(y: Column, m: Column, d: Column) -> Column:
        text_date = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull() & y.between(1800, 2100), F.try_to_date(text_date, "yyyy-MM-dd"))

    return F.coalesce(
        made(part(long, 3), month, part(long, 1)), made(part(iso, 1), part(iso, 2), part(iso, 3)), made(part(dmy, 3), part(dmy, 2), part(dmy, 1))
    )


def question_hash(c: Column) -> Column:
    """SHA-256 of the folded question without punctuation."""
    return F.sha2(F.trim(F.regexp_replace(F.regexp_replace(fold(c), "[^0-9a-z ]", " "), " +", " ")), 256)


def recency_weight(days: Column, half_life: float = 90.0) -> Column:
    """Halves every ``half_life`` days; future counts as today, null as 1."""
    return F.when(days.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / half_life))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def progress(done: Column, total: Column) -> Column:
    """Whole per cent, 99 at most while running."""
    return F.when(total > 0, F.least(F.lit(99), F.floor(100 * done / total))).otherwise(0).cast("int")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def specific_term(c: Column) -> Column:
    """What to look up (T12): a quoted phrase; else the best content term, an identifier together with its noun.

    Terms with a digit gain 4 and a fifth of their length (10 at most), general words lose 4, and each place towards the
    end of the question adds a tenth.
    """
    quoted = F.regexp_extract(F.coalesce(c, F.lit("")), "[\"“«']([^\"”»']{2,80})[\"”»']", 1)
    digit = lambda t: t.rlike("[0-9]")
    general = lambda t: t.isin(*GENERIC)
    worth = lambda t, i: F.struct((F.when(digit(t), 4 + 0.2 * F.least(F.length(t), F.lit(10))).otherwise(0.0) - F.when(general(t), 4).otherwise(0) + 0.1 * i).alias("score"), i.alias("at"))

    def chosen(terms: Column) -> Column:
        return bound(F.array_max(F.transform(terms, worth))["at"], lambda at: named(terms, at))

    def named(terms: Column, at: Column) -> Column:
        term = F.get(terms, at)
        nouns = F.filter(F.slice(terms, F.lit(1), at), lambda t: ~digit(t) & ~general(t))
        numbered = F.rlike(fold(c), F.concat(F.lit("\\boficio\\s+"), F.replace(term, F.lit("."), F.lit("\\.")), F.lit("\\b")))
        with_noun = F.when(numbered | (F.size(nouns) == 0), term).otherwise(F.concat(stem(F.try_element_at(nouns, F.lit(-1))), F.lit(" "), term))
        return F.when(digit(term), with_noun).otherwise(stem(term))

    return F.when(F.trim(quoted) != "", stem(fold(F.trim(quoted)))).otherwise(bound(content_terms(c), lambda ts: F.when(F.size(ts) > 0, chosen(ts))))


def split_near(c: Column, share: float) -> Column:
    """Two parts: cut at the space nearest to a share (15 to 85 %) of the text, a fifth of it away at most."""
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)
    cut = F.floor(n * F.lit(min(0.85, max(0.15, share)))).cast("int")
    reach = F.greatest(F.lit(3), F.floor(n * F.lit(0.2))).cast("int")
    low, high = F.greatest(F.lit(0), cut - reach), F.least(n, cut + reach)
    left = F.instr(F.reverse(F.substring(text, low + 1, cut - low)), " ")
    right = F.instr(F.substring(text, cut + 1, high - cut), " ")
    place = F.when((left > 0) & ((right == 0) | (left < right)), cut - left).when(right > 0, cut + right - 1).otherwise(cut)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.array(bare(F.substring(text, F.lit(1), place)), bare(F.substring(text, place + 1, n)))


def is_heading(line: Column) -> Column:
    """Short lines of capitals, known titles, ordinals, and half-capital lines before a colon."""
    n, letters = F.length(line), F.regexp_count(line, F.lit(r"\p{L}"))
    capitals = F.coalesce(F.try_divide(F.regexp_count(line, F.lit(r"\p{Lu}")), letters), F.lit(0.0))
    title = F.btrim(F.upper(line), F.lit(":")).isin(*KNOWN_HEADINGS) | line.rlike(rf"(?i)^(?:{ORDINALS})\b")
    shape = ((capitals >= 0.85) & (n >= 4)) | (line.endswith(":") & (n <= 60) & (capitals >= 0.5))
    return n.between(2, 90) & ~line.rlike("[.;,]$") & (letters > 0) & (title | shape)


def markdown(c: Column) -> Column:
    """Headings, list items and paragraphs of joined lines.

    Every line gets its kind; what stands before it follows from the kinds of its neighbours: text goes on with a
    space, an item is followed by a line break, headings and paragraphs by a blank line.
    """
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    item = lambda x: F.concat(F.when(x.rlike("^[0-9]"), F.lit("1. ")).otherwise("- "), F.regexp_replace(x, LIST_MARK, ""))
    row = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    kind_of = lambda x: F.when(x == "", row("blank", x)).when(is_heading(x), row("heading", F.concat(F.lit("### "), x))).when(x.rlike(LIST_MARK), row("item", item(x))).otherwise(row("text", x))

    def joined(rows: Column) -> Column:
        seen = F.filter(F.transform(rows, lambda x, i: F.struct(x["kind"].alias("kind"), x["body"].alias("body"), F.coalesce(F.get(rows, i - 1)["kind"] == "text", F.lit(False)).alias("goes_on"))), lambda x: x["kind"] != "blank")
        return bound(seen, lambda xs: F.array_join(F.transform(xs, lambda x, j: F.concat(gap(F.get(xs, j - 1)["kind"], x), x["body"])), ""))

    def gap(before: Column, x: Column) -> Column:
        return F.when(before.isNull(), "").when(before == "item", "\n").when((x["kind"] == "text") & x["goes_on"], " ").otherwise("\n\n")

    return bound(F.transform(lines, kind_of), joined)


def profile_status(judged: Column, exemplars: Column, rules: Column, profile: Column, false_rules: Column, false_profile: Column, semantic: bool = True, least: int = 10, gain: float = 0.10) -> Column:
    """Whether learned votes replace the rules (K6): active on a measured gain, off on a measured loss or without data, else shadow.

    Measured: real embeddings, ``least`` judged answers, both accuracies known, and no more false positives than the rules.
    """
    measured = F.lit(semantic) & (judged >= least) & rules.isNotNull() & profile.isNotNull() & (false_profile <= false_rules)
    no_data = (exemplars == 0) & ((judged == 0) | (F.lit(semantic) & (judged < least)))
    return F.when(no_data | (measured & (profile + gain < rules)), "off").when(measured & (profile >= rules + gain), "active").otherwise("shadow")
