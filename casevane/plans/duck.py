"""Text rules as DuckDB expressions, for the oracle SQL only."""

from __future__ import annotations

from ..functions.text import QUESTION_WORDS, REPORT_WORDS, STOP_WORDS


def words(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


WORD = "[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+(?:[.,][0-9]+)*"


def fold(x: str) -> str:
    return f"strip_accents(lower(coalesce({x},'')))"


def unaccent(x: str) -> str:
    return f"translate(lower(coalesce({x},'')),'áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ','aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC')"


def raw(x: str, least: int = 2) -> str:
    return f"list_filter(regexp_extract_all(coalesce({x},''),'{WORD}'), lambda t: length(t)>={least})"


def terms(x: str, report: bool = True) -> str:
    drop = words([*STOP_WORDS, *QUESTION_WORDS, *(REPORT_WORDS if report else [])])
    return f"list_distinct(list_filter(list_transform({raw(x, 3)}, lambda t: {fold('t')}), lambda t: length(t)>=3 AND NOT list_contains({drop},t)))"


def search_terms(x: str) -> str:
    return terms(x, report=False)


def ordered_terms(x: str) -> str:
    """Content terms in order of first appearance."""
    drop = words([*STOP_WORDS, *QUESTION_WORDS, *REPORT_WORDS])
    all_terms = f"list_filter(list_transform({raw(x, 3)}, lambda t: {fold('t')}), lambda t: length(t)>=3 AND NOT list_contains({drop},t))"
    return f"list_filter({all_terms}, lambda t, i: list_position({all_terms}, t) = i)"


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w})<=4 THEN {w} WHEN {w} LIKE '%ces' AND length({w})>5 THEN left({w},-3)||'z' WHEN {w} LIKE '%es' AND length({w})>5 THEN"
        f" CASE WHEN substr({w},length({w})-2,1) IN ('l','r','n','d','z') THEN left({w},-2) ELSE left({w},-1) END WHEN {w} LIKE '%s' THEN left({w},-1) ELSE {w} END"
    )


def stems(x: str) -> str:
    return f"list_distinct(list_transform({terms(x)}, lambda w: {stem('w')}))"


def joined(arr: str) -> str:
    return f"array_to_string(list_sort({arr}),' ')"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a})=0 THEN 1.0::DOUBLE ELSE len(list_intersect({a},{b}))/len({a})::DOUBLE END"


def numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x},''),'[0-9][0-9.,]*'), lambda n: regexp_replace(n,'[.,]','','g'))"


#: Segments of speech over conversations: turn t starts at 10 s * t and lasts 60 ms a word.
SEGMENTS = (
    "seg AS (SELECT conv_id AS media_id, turn, role AS speaker, text, turn*10000 AS start_ms,"
    " turn*10000 + 60*len(regexp_extract_all(text,'[^ \\t\\n\\r]+')) AS end_ms FROM conversations)"
)
