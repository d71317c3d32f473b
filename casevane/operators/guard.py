"""Claims against their sources: findings of the audit, status of claims and answers, composition of an answer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as T

c = F.col
#: Kinds of claims in the order of an answer.
ORDER = {"direct": 0, "evidence": 1, "audio": 2}
#: The number of an article as rules name their own, of any length.
WHOLE_ARTICLE = r"\d+[A-Za-z]?(?:-\d+)?(?:\.\d+)*"
#: What the audit asks for; a case's own policy may change each: fixed values.
POLICY = {
    "require_legal_norm": True,
    "block_on_parties": True,
    "block_on_legal_conclusion": True,
    "min_ocr_confidence": 0.55,
    "min_asr_confidence": 0.55,
    "allowed_jurisdictions": (),
}


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns that it lacks."""
    for name, value in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def rules_for(norms: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The rule of each cited norm, if there is one: ``keys, kind, identifier`` with ``r``.

    norms: keys, kind (article or law), identifier, jurisdiction, text of the claim; rules: identifier, source, title, text,
    jurisdiction, version_date, law_level_only.  An article is a rule whose identifier is the same without separators, or whose
    title or text names that article; a law one whose identifier, title, text or source has its number as words.  Rules of
    another jurisdiction than the case's don't count.  The body of law that the claim names comes first, then the rule with
    the very identifier, then the newest.  Rules meet norms by the keys found in them, not by a search of each text.
    """
    text = "string"
    rules = _with(rules, title=F.lit(None).cast(text), jurisdiction=F.lit(None).cast(text), version_date=F.lit(None).cast("date"), law_level_only=F.lit(False))
    whole = F.concat_ws(" \n", "identifier", "title", "text", "source")
    articles = F.regexp_extract_all(F.concat_ws(" \n", "title", "text"), F.lit(rf"(?iu)art[ií]culo\s+({WHOLE_ARTICLE})"), F.lit(1))
    laws = F.regexp_extract_all(whole, F.lit(r"(?iu)\b(\d{1,5}(?:\s+de\s+\d{4})?)\b"), F.lit(1))
    number = lambda x: F.regexp_replace(x, r"\s+de\s+\d{4}$", "")
    spaced = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    own = L.identifier_key(c("identifier"))
    named = F.array_union(F.array(F.struct(F.lit("article").alias("kind"), own.alias("key"))), F.array_distinct(F.concat(
        F.transform(articles, lambda x: F.struct(F.lit("article").alias("kind"), L.identifier_key(x).alias("key"))),
        F.transform(F.concat(laws, F.transform(laws, number)), lambda x: F.struct(F.lit("law").alias("kind"), spaced(x).alias("key"))),
        F.array(F.struct(F.lit("law").alias("kind"), spaced(c("identifier")).alias("key"))),
    )))
    keyed = rules.select(c("identifier").alias("rule_id"), "source", c("text").alias("rule"), c("jurisdiction").alias("rule_in"), "version_date", "law_level_only", own.alias("own"), F.explode(named).alias("k")).select("*", "k.kind", "k.key").drop("k")
    key = F.when(c("kind") == "article", L.identifier_key(c("identifier"))).otherwise(spaced(c("identifier")))
    asked = norms.withColumn("key", key)
    met = asked.join(keyed, ["kind", "key"]).filter((F.coalesce("jurisdiction", F.lit("")) == "") | F.coalesce(c("rule_in") == c("jurisdiction"), F.lit(False)) | c("rule_in").isNull())
    exact = F.when(c("kind") == "article", c("own") == c("key")).otherwise(spaced(c("rule_id")) == c("key"))
    agrees = L.source_agrees(F.coalesce("source", F.lit("")), c("text"))
    best = F.max_by(F.struct("rule", "source", "law_level_only", agrees.alias("agrees")), F.struct(agrees.alias("a"), exact.alias("b"), c("version_date").isNotNull().alias("c"), c("version_date").alias("d"), "rule"))
    return met.groupBy(*keys, "kind", "identifier").agg(best.alias("r"))


def rules_named(rules: DataFrame, asked: DataFrame, jurisdiction: str = "", source: str = "") -> DataFrame:
    """All rules that bear one of the numbers or names asked for, with ``exact``: identifier, source, title, text, version_date.

    asked: identifier, a few rows; rules: see ``rules_for``.  A rule bears it anywhere in its identifier, title, text or source,
    in any letter case; a null field bears nothing, a blank identifier finds nothing.  An empty jurisdiction or source leaves
    that open.  A rule that several rows name is one row, exact if its identifier is one of them.
    """
    rules = _with(rules, title=F.lit(None).cast("string"), jurisdiction=F.lit(None).cast("string"), version_date=F.lit(None).cast("date"))
    for column, value in (("jurisdiction", jurisdiction), ("source", source)):
        rules = rules if value == "" else rules.filter(c(column) == value)
    names = asked.select(F.lower(F.trim("identifier")).alias("name")).filter("name <> ''").agg(F.collect_set("name").alias("names"))  # one row: the question
    bears = lambda x: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), x), F.lit(False)) for f in ("identifier", "title", "text", "source")])
    own = L.identifier_key(c("identifier"))
    exact = (own != "") & F.exists("names", lambda x: L.identifier_key(x) == own)
    met = rules.crossJoin(F.broadcast(names)).filter(F.exists("names", bears) | exact)
    return met.select("identifier", "source", "title", "text", "version_date", exact.alias("exact"))


def audit(
    claims: DataFrame,
    citations: DataFrame,
    evidence: DataFrame,
    parties: DataFrame,
    rules: DataFrame,
    decisions: DataFrame,
    contradictions: DataFrame,
    cases: DataFrame | None = None,
    policy: dict | None = None,
) -> DataFrame:
    """``case_id, claim_id, code, severity``: what is wrong with each claim (V6); a finding on a whole case has no claim.

    claims: case_id, claim_id, text (and claim_type); citations: case_id, claim_id, handle, quote_hash; evidence: case_id,
    handle, text, context, confidence, quote (and kind: page, the default, or segment); parties: case_id, name (and aliases);
    rules: see ``rules_for``; decisions: case_id; contradictions: case_id, text_a, text_b; cases: case_id, jurisdiction.  One
    frame per check, all joined on case, claim or identifier; a claim cites a handful of sources, so its context is a short
    list.  ``policy`` overrides ``POLICY``.
    """
    told = {**POLICY, **(policy or {})}
    claims = _with(claims, claim_type=F.lit(None).cast("string"))
    evidence = _with(evidence, kind=F.lit("page"))
    parties = _with(parties, aliases=F.array().cast("array<string>"))
    if cases is None:
        cases = claims.select("case_id", F.lit(None).cast("string").alias("jurisdiction")).distinct()
    cited = citations.join(evidence, ["case_id", "handle"])
    context = cited.groupBy("case_id", "claim_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("context"))).alias("context"))  # the sources of one claim
    known = claims.join(context, ["case_id", "claim_id"], "left")
    backed = known.filter("context is not null").withColumn("facts", L.without_norms(c("text")))
    keys = ["case_id", "claim_id"]
    finding = lambda df, code, severity: df.select(*keys, F.lit(code).alias("code"), F.lit(severity).alias("severity")).distinct()

    own_numbers, dated = T.missing_numbers(c("facts"), c("context")), F.regexp_extract_all("text", F.lit(L.CLAIM_DATE), F.lit(0))
    quoted = cited.select(*keys, "text", "quote", "quote_hash").filter("quote_hash is not null")
    changed = (F.sha2("quote", 256) != c("quote_hash")) | ~F.contains(T.fold(c("text")), T.fold(c("quote")))

    parts = [
        finding(claims.join(citations.select(*keys), keys, "left_anti"), "CITATION_MISSING", "CRITICAL"),
        finding(citations.join(evidence.select("case_id", "handle"), ["case_id", "handle"], "left_anti"), "CITATION_UNRESOLVED", "CRITICAL"),
        finding(quoted.filter(c("quote").isNotNull() & changed), "QUOTE_MISMATCH", "CRITICAL"),
        finding(quoted.filter("quote is null"), "QUOTE_HASH_UNVERIFIED", "HIGH"),
        finding(backed.filter(F.size(own_numbers) > 0), "NUMBER_MISMATCH", "CRITICAL"),
        finding(backed.filter(F.exists(dated, lambda d: ~L.date_supported(d, c("context")))), "DATE_MISMATCH", "CRITICAL"),
        finding(one_sided(claims, contradictions), "CONTRADICTION_OMITTED", "HIGH"),
    ]
    if told["block_on_parties"]:
        # Every name of a party, aliases too, that the claim uses must be in its sources.
        names = parties.select("case_id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")).filter(F.trim("name") != "")
        parts.append(finding(backed.join(names, "case_id").filter(L.mentions(c("text"), c("name")) & ~L.mentions(c("context"), c("name"))), "PARTY_MISMATCH", "HIGH"))

    spoken = c("kind") == "segment"
    low = c("confidence") < F.when(spoken, F.lit(told["min_asr_confidence"])).otherwise(F.lit(told["min_ocr_confidence"]))
    weak = cited.filter(low).groupBy(*keys).agg(F.min_by(F.when(spoken, "LOW_ASR_CONFIDENCE").otherwise("LOW_OCR_CONFIDENCE"), "handle").alias("code"))  # the first of a claim
    parts.append(weak.select(*keys, "code", F.lit("HIGH").alias("severity")))

    if told["require_legal_norm"]:
        normed = known.select(*keys, "text", "context", F.explode(L.norms(c("text"))).alias("norm")).select(*keys, "text", "context", "norm.kind", "norm.identifier").join(cases.select("case_id", "jurisdiction"), "case_id", "left")
        found = normed.join(rules_for(normed, rules, keys), [*keys, "kind", "identifier"], "left")
        # Norms that aren't loaded: an invention, unless the cited source itself names them.
        stated = F.coalesce(F.contains(T.fold(c("context")), T.fold(c("identifier"))), F.lit(False))
        gone, present = found.filter("r is null"), found.filter("r is not null")
        article = present.filter("kind = 'article'")
        support = article.withColumn("s", L.article_support(c("r.rule"), c("text"))).filter("s.code is not null")
        parts += [
            finding(gone.filter(~stated), "LEGAL_RULE_MISSING", "CRITICAL"),
            finding(gone.filter(stated), "LEGAL_RULE_MISSING", "HIGH"),
            finding(present.filter((c("kind") == "law") & F.coalesce("r.law_level_only", F.lit(False)) & c("text").rlike(L.CONCLUSION)), "LEGAL_ARTICLE_MISSING", "CRITICAL"),
            finding(article.filter("not r.agrees"), "LEGAL_ARTICLE_SOURCE_MISMATCH", "CRITICAL"),
            support.select(*keys, c("s.code").alias("code"), c("s.severity").alias("severity")).distinct(),
        ]
    if told["block_on_legal_conclusion"]:
        provable = ~F.coalesce(F.upper("claim_type"), F.lit("FACT")).isin("PROCEDURAL", "PARTY_ALLEGATION", "INFERENCE")
        proven = known.filter(c("text").rlike(L.PROBATIVE) & provable).join(decisions.select("case_id").distinct(), "case_id", "left_anti")
        parts.append(finding(proven, "DECISION_MISSING", "CRITICAL"))
    if told["allowed_jurisdictions"]:
        abroad = cases.filter((F.coalesce("jurisdiction", F.lit("")) != "") & ~c("jurisdiction").isin(*told["allowed_jurisdictions"])).join(claims.select("case_id").distinct(), "case_id", "left_semi")
        parts.append(abroad.select("case_id", F.lit(None).cast(claims.schema["claim_id"].dataType).alias("claim_id"), F.lit("JURISDICTION_MISMATCH").alias("code"), F.lit("CRITICAL").alias("severity")).distinct())
    return reduce(DataFrame.unionByName, parts)


def one_sided(claims: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Claims that give one side of an open contradiction whose other side no claim of the case gives.

    Two texts are one proposition from half of their terms on, three terms at least.
    """
    pairs = contradictions.select("case_id", F.xxhash64("text_a", "text_b").alias("pair"), F.explode(F.array(F.struct(F.lit(0).alias("side"), c("text_a").alias("said")), F.struct(F.lit(1).alias("side"), c("text_b").alias("said")))).alias("v"))
    pairs = pairs.select("case_id", "pair", "v.side", T.content_set(c("v.said")).alias("s"))
    own = claims.select("case_id", "claim_id", T.content_set(c("text")).alias("t"))
    alike = (F.size("s") >= 3) & (F.size("t") >= 3) & (F.size(F.array_intersect("s", "t")) >= 0.5 * F.size(F.array_union("s", "t")))
    hit = own.join(pairs, "case_id").filter(alike).select("case_id", "claim_id", "pair", "side")
    single = hit.groupBy("case_id", "pair").agg(F.countDistinct("side").alias("sides")).filter("sides = 1")
    return hit.join(single, ["case_id", "pair"]).select("case_id", "claim_id")


def claim_status(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """``case_id, claim_id, status``: UNSUPPORTED, NEEDS_REVIEW or SUPPORTED by the worst finding."""
    worst = findings.groupBy("case_id", "claim_id").agg(F.max((c("severity") == "CRITICAL").cast("int")).alias("critical"), F.count("*").alias("n"))
    status = F.when(c("critical") == 1, "UNSUPPORTED").when(c("n") > 0, "NEEDS_REVIEW").otherwise("SUPPORTED")
    return claims.select("case_id", "claim_id").join(worst, ["case_id", "claim_id"], "left").select("case_id", "claim_id", status.alias("status"))


def final_status(claims: DataFrame, findings: DataFrame, mode: str = "BALANCED") -> DataFrame:
    """``case_id, status`` of each answer (V8)."""
    approved = claim_status(claims, findings).groupBy("case_id").agg(F.count_if(c("status") == "SUPPORTED").alias("approved"))
    worst = findings.groupBy("case_id").agg(F.count_if(c("severity") == "CRITICAL").alias("critical"), F.count_if(c("severity") == "HIGH").alias("high"))
    bad = approved.join(worst, "case_id", "left").fillna(0, ["critical", "high"])
    strict = (c("approved") == 0) & F.lit(mode == "STRICT")
    status = F.when((c("critical") > 0) & (c("approved") == 0), "BLOCKED").when((c("critical") + c("high") > 0) & strict, "NEEDS_REVIEW").when(c("critical") + c("high") > 0, "WARNING").otherwise("PASSED")
    return bad.select("case_id", status.alias("status"))


# What a question asks for and what answers it; words with which talk begins.
SLOTS = (
    (r"\b(quien|quienes|nombre|nombres|firmo|firmaron|suscribio)\b", r"\b[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]{2,}\s+[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]{2,}\b"),
    (
        r"\b(cuando|fecha|fechas|dia|dias|mes|meses|ano|anos|plazo)\b",
        r"(?i)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)\b|\b(?:19|20)\d{2}\b",
    ),
    (r"\b(cuanto|cuanta|cuantos|cuantas|monto|valor|suma|cuantia|total)\b", r"[$€]\s*\d|\b\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?\b"),
)
TALK = ("perdon", "mire", "bueno", "eh", "o sea", "este ", "esto es", "digamos", "verdad", "entonces")
LEAST_OVERLAP, COPIED, ASKED = 0.34, 0.85, 0.20


def overlap(question: Column, claim: Column) -> Column:
    """Share of the question's terms that a claim has; below the limit, words that share a beginning count too."""
    q, own = T.content_set(question), T.content_set(claim)
    close = lambda a, b: (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & ((F.left(a, F.lit(4)) == F.left(b, F.lit(4))) | F.startswith(a, b) | F.startswith(b, a)))

    def value(qs: Column, cs: Column) -> Column:
        exact = F.when(F.size(qs) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(qs, cs)) / F.size(qs))
        loose = F.size(F.filter(qs, lambda t: F.exists(cs, lambda o: close(t, o)))) / F.size(qs)
        return F.when((exact >= LEAST_OVERLAP) | (F.size(qs) == 0), exact).otherwise(F.greatest(exact, loose))

    return T.bound(q, lambda qs: T.bound(own, lambda cs: value(qs, cs)))


def claim_kind(question: Column, claim: Column, context: Column, speech_only: Column, has_speech: Column, counting: Column) -> Column:
    """``direct``, ``evidence``, ``audio``, or ``limit`` for a claim whose numbers its sources lack."""
    asked = T.fold(question)
    slot = reduce(lambda a, b: a | b, [asked.rlike(q) & claim.rlike(a) for q, a in SLOTS]) | (counting & (F.size(T.numbers(claim)) > 0))
    plain = T.bound(T.content_set(question), lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, T.content_set(claim))) / F.size(q)))
    copied = speech_only & (T.share_in(T.content_set(claim), T.content_set(context)) > COPIED) & (plain < ASKED)
    folded = F.ltrim(T.fold(claim), F.lit("«\"'¡¿ "))
    talk = has_speech & (F.length(claim) < 220) & (plain == 0) & reduce(lambda a, b: a | b, [F.startswith(folded, F.lit(w)) for w in TALK])
    answers = (overlap(question, claim) >= LEAST_OVERLAP) | slot
    return F.when(F.size(T.missing_numbers(claim, context)) > 0, "limit").when(copied | talk, "audio").when(answers, "direct").otherwise("evidence")


def compose(claims: DataFrame, budget: int = 12, related: int = 3, deep: bool = False) -> DataFrame:
    """``question_id, claim_id, kind, markers, answer_kind``: what an answer shows, in order.

    claims: question_id, claim_id, kind, handles and places (arrays of equal length), insufficient (boolean: the
    question is badly covered, or asks for numbers that no evidence has).  Direct claims come before evidence and speech;
    a source gets one number at its first place; a claim whose sources don't all fit into the budget is left out; without
    a direct claim at most ``related`` evidence claims are shown, or none where the evidence is insufficient.  An answer
    has a few claims, so a task streams its questions, in order, and holds the claims of one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = f"question_id {claims.schema['question_id'].dataType.simpleString()}, claim_id {claims.schema['claim_id'].dataType.simpleString()}, kind string, markers array<int>, answer_kind string"
    ids = [to_arrow_type(claims.schema[x].dataType) for x in ("question_id", "claim_id")]
    out = pa.schema([("question_id", ids[0]), ("claim_id", ids[1]), ("kind", pa.string()), ("markers", pa.list_(pa.int32())), ("answer_kind", pa.string())])

    def choose(rows: list[tuple]) -> list[tuple]:
        """What is shown of one question's claims (question_id, claim_id, kind, handles, places, insufficient), which come in order."""
        able = [r for r in rows if r[2] in ORDER and r[3]]
        direct = any(r[2] == "direct" for r in able)
        if not direct:
            first = [r for r in able if r[2] == "evidence"][: 12 if deep else related]
            able = first + [r for r in able if r[2] == "audio"]
        numbers: dict[str, int] = {}
        taken: set[str] = set()
        shown = []
        for _, claim, kind, handles, places, _ in able:
            new = {h: p for h, p in zip(handles, places, strict=True) if h not in numbers}
            if len(numbers) + len(new) > budget or len(set(new.values())) < len(new) or taken & set(new.values()):
                continue
            for h, p in new.items():
                numbers[h] = len(numbers) + 1
                taken.add(p)
            shown.append((claim, kind, [numbers[h] for h in handles]))
        has_direct = any(k == "direct" for _, k, _ in shown)
        answer = "direct" if has_direct else "partial" if shown and (deep or not rows[0][5]) else "insufficient"
        return [(rows[0][0], *x, answer) for x in (shown if answer != "insufficient" else [(None, None, [])])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(got: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

        own: list[tuple] = []
        for rows in batches:
            got = []
            for place, *r in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                if place == 1 and own:
                    got += choose(own)
                    own = []
                own.append(tuple(r))
            if got:
                yield batch(got)
        if own:
            yield batch(choose(own))

    rank = F.coalesce(*[F.when(c("kind") == k, n) for k, n in ORDER.items()], F.lit(len(ORDER)))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(rank, "claim_id"))
    return claims.select(place.alias("place"), "question_id", "claim_id", "kind", "handles", "places", "insufficient").mapInArrow(run, kinds)
