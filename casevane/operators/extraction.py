"""Parties from headings, and the side of attorneys from windows of text around their names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as T

c = F.col

# Words of role, and the role of each.
ROLE_WORDS = "demandantes?|demandadas?|ejecutantes?|ejecutados?|denunciantes?|denunciados?|accionantes?|actores?"
ROLES = {
    "demandante": "claimant", "demandantes": "claimant", "demandada": "claimant", "demandadas": "claimant",
    "ejecutante": "claimant", "ejecutantes": "claimant", "denunciante": "claimant", "denunciantes": "claimant",
    "accionante": "claimant", "accionantes": "claimant", "actor": "claimant", "actores": "claimant",
    "demandado": "defendant", "demandados": "defendant", "denunciado": "defendant", "denunciados": "defendant",
    "ejecutado": "defendant", "ejecutados": "defendant",
}
#: A heading with the role before the name, and a line with the name before the role.
AFTER = rf"(?iu)\b({ROLE_WORDS})\b\s*[:.\-–]\s*([^\n;|]{{3,90}})"
BEFORE = rf"(?imu)^\s*([^\n;:|]{{3,80}}?)\s*,?\s*\b({ROLE_WORDS})\b\s*[:.\-–]?\s*$"
# Words that are no part of a name.
NO_NAME = (
    "EL LA LOS LAS DE DEL Y EN POR CON SEÑOR SEÑORA SR SRA PARTE PARTES DEMANDANTE DEMANDADO DEMANDADOS DEMANDADAS EJECUTANTE EJECUTADO ACTOR ACCIONANTE JUDICIAL"
    " CALIDAD COMO OBRA ACTUANDO FIRMA CORRESPONDIENTE EXTREMO PROCESO EXPEDIENTE RADICADO JUZGADO DESPACHO CIRCUITO MUNICIPAL AUTOS AUTO REF REFERENCIA DEMANDA"
    " PROCESAL DOCTOR DOCTORA ABOGADO ABOGADA APODERADO APODERADA REPRESENTANTE REPRESENTANTES MEDIANTE DENTRO CONTRA FAVOR SEGUNDO TERCERO PRIMERO RESPECTO SOBRE"
    " SEÑALA INFORMA NO SI PRUEBA PRINCIPAL IDENTIFICADO IDENTIFICADA IDENTIFICACION DOMICILIADO DOMICILIADA PORTADOR PORTADORA MAYOR MENOR EDAD"
).split()
#: Characters before and after a surname that a vote looks at, after the word for an attorney, and what a vote counts.
BACK, AHEAD, NEAR, VOTE = 280, 340, 80, 2
# What names an attorney and the sides.
ATTORNEY, BLOCK = re.compile(r"APODERAD[OA]"), re.compile(r"APODERAD[OA]\s*:\s*([^\n]{0,90})")
CLAIMS, DEFENDS = re.compile(r"\b(DEMANDANTE|ACTORA|EJECUTANTE|ACCIONANTE)"), re.compile(r"\b(DEMANDAD[OA]|EJECUTAD[OA])")


def party_name(raw: Column) -> Column:
    """The name with which a text begins: up to five words in capitals that are no words of office; null without one of two to four words."""
    bare = lambda t: F.regexp_replace(t, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")
    words = F.filter(F.split(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^[\s,;.:\-–·]+", ""), r"\s+"), lambda t: t != "")
    is_name = lambda t: T.bound(bare(t), lambda b: (F.length(b) >= 2) & ~F.upper(b).isin(*NO_NAME) & b.rlike("^[A-ZÁÉÍÓÚÜÑ0-9]"))

    def first_run(ws: Column) -> Column:
        stop = F.array_position(F.transform(ws, is_name), False)
        return F.transform(F.slice(ws, F.lit(1), F.least(F.lit(5), F.when(stop == 0, F.size(ws)).otherwise(stop - 1).cast("int"))), bare)

    def named(ws: Column) -> Column:
        whole = F.array_join(ws, " ")
        real = F.exists(ws, lambda t: (F.length(t) >= 3) & t.rlike(r"^\p{L}"))
        return F.when(F.size(ws).between(2, 4) & (F.length(whole) >= 5) & real, whole)

    return T.bound(words, lambda ws: T.bound(first_run(ws), named))


def parties(pages: DataFrame) -> DataFrame:
    """``case_id, key, name, role, entity_type, mentions, document_id, page_number`` of the parties that headings name.

    pages: case_id, document_id, filename, page_number, text.  Names are one party by their letters; role, spelling and
    citation are those of the first mention by file and page; on one page headings come before lines that end in a role.
    """
    text = F.coalesce("text", F.lit(""))
    groups = lambda pattern, i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    found = lambda kind, pattern, name, role: F.transform(F.arrays_zip(groups(pattern, name).alias("raw"), groups(pattern, role).alias("role")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["raw"].alias("raw"), x["role"].alias("role")))
    hits = pages.select("case_id", "document_id", "filename", "page_number", F.explode(F.concat(found(0, AFTER, 2, 1), found(1, BEFORE, 1, 2))).alias("m"))
    named = hits.withColumn("name", party_name(c("m.raw"))).withColumn("key", T.normal_name(c("name"))).filter((c("name").isNotNull()) & (c("key") != ""))
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ROLES.items() for x in p]), F.lower("m.role")), F.lit("third_party"))
    first = F.min(F.struct("filename", "page_number", "m.kind", "m.i", "name", role.alias("role"), "document_id"))
    grouped = named.groupBy("case_id", "key").agg(first.alias("f"), F.count("*").alias("mentions"))
    return grouped.select("case_id", "key", "f.name", "f.role", L.entity_type(c("f.name")).alias("entity_type"), "mentions", "f.document_id", "f.page_number")


def surnames(name: Column) -> Column:
    """The last two words of a name, folded to capitals; the only one if there is one."""
    words = F.filter(F.regexp_extract_all(F.upper(T.fold(name)), F.lit("[A-Z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3)
    return F.when(F.size(words) >= 2, F.slice(words, -2, 2)).otherwise(words)


def _places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def votes_of(text: str, names: list[str]) -> tuple[int, int]:
    """Votes for claimant and defendant of one attorney in one folded text.

    Around each place of a surname, every word for an attorney that a surname follows closely votes for the side named first
    after it; a labelled block votes for the last party label before it.
    """
    own = [0, 0]
    for name in names:
        for at in _places(text, name):
            window = text[max(0, at - BACK) : at + AHEAD]
            for m in ATTORNEY.finditer(window):
                near = window[m.end() : m.end() + NEAR]
                if any(n in near for n in names):
                    sides = [p.search(near) for p in (CLAIMS, DEFENDS)]
                    starts = [s.start() if s else len(near) for s in sides]
                    if starts[0] != starts[1]:
                        own[starts[0] > starts[1]] += VOTE
    for m in BLOCK.finditer(text):
        if any(n in m.group(1) for n in names):
            last = [text.rfind(label, 0, m.start()) for label in ("DEMANDANTE:", "DEMANDADO:")]
            if last[0] != last[1]:
                own[last[0] < last[1]] += VOTE
    return own[0], own[1]


def _vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = [], [], []
        for text, people in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            for p in people:
                if any(n in text for n in p["names"]):
                    got = votes_of(text, p["names"])
                    for column, v in zip(out, (p["party_id"], *got), strict=True):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["party_id", "claimant", "defendant"])


def attorney_sides(attorneys: DataFrame, texts: DataFrame) -> DataFrame:
    """``party_id, claimant, defendant, role`` of each attorney: the votes of all texts of the case, and the side of a clear majority.

    attorneys: case_id, party_id, name; texts: case_id, text (pages and segments).  Texts without a word for an attorney leave
    before the join; a text meets its case's few attorneys once and only votes leave the task.
    """
    people = attorneys.select("case_id", c("party_id").cast("long").alias("party_id"), surnames(c("name")).alias("names")).filter(F.size("names") > 0)
    of_case = people.groupBy("case_id").agg(F.collect_list(F.struct("party_id", "names")).alias("people"))  # attorneys of one case
    folded = texts.select("case_id", F.upper(T.fold(c("text"))).alias("t")).filter(c("t").contains("APODERAD"))
    votes = folded.join(of_case, "case_id").select("t", "people").mapInArrow(_vote, "party_id long, claimant long, defendant long")
    total = votes.groupBy("party_id").agg(F.sum("claimant").alias("claimant"), F.sum("defendant").alias("defendant"))
    all_of = attorneys.select(c("party_id").cast("long").alias("party_id")).distinct().join(total, "party_id", "left").fillna(0, ["claimant", "defendant"])
    role = F.when((c("claimant") >= VOTE) & (c("claimant") > c("defendant")), "attorney_claimant").when((c("defendant") >= VOTE) & (c("defendant") > c("claimant")), "attorney_defendant").otherwise("attorney")
    return all_of.select("party_id", "claimant", "defendant", role.alias("role"))
