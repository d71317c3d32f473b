"""Rules over single values on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from casevane.functions import rules as R
from casevane.functions import text as T
from casevane.operators import sequence


CASES = [
    ("¿Qué dice «Juzgado Primero» sobre el caso?", "juzgado primero"),
    ("¿Qué dice el oficio 2834?", "2834"),
    ("¿Dónde aparece el pagaré 001?", "pagare 001"),
    ("¿Hay información sobre pagos?", "pago"),
    ("¿Y el NIT 521.606 de la bodega?", "nit 521.606"),
    ("que es", None),
    (None, None),
]


def test_specific_term(spark):
    got = spark.createDataFrame(CASES, "q string, want string").select("q", "want", T.specific_term(F.col("q")).alias("term")).collect()
    assert all(r.term == r.want for r in got), got


def test_phrase_pattern():
    import re

    p = R.phrase_pattern("pagaré 001")
    assert re.search(p, R.norm("el PAGARÉ No. 01 firmado")) and not re.search(p, R.norm("pagaré 12"))
    assert R.phrase_pattern(" ,;") is None


def test_names():
    assert R.name_candidates("la Doctora ANA María Rojas y Juan Pérez, en Bogotá", frozenset({"DOCTORA"})) == ["ANA María Rojas", "Juan Pérez"]
    assert R.same_name("ALBALUCY COCKKEVAREZ", "ALBA LUCY COCK ALVAREZ") and not R.same_name("ANA", "ANA")


def test_forbidden_phrase():
    assert R.forbidden("El pago está probado.", "pago está probado")
    assert not R.forbidden("No puedo afirmar que el pago está probado.", "pago está probado")
    assert not R.forbidden("x", "") and not R.forbidden(None, "a")


def test_split(spark):
    rows = [("uno dos tres cuatro", ["uno dos tres", "cuatro"]), ("uno dos tres cuatro cinco", ["uno dos tres", "cuatro cinco"]), ("", ["", ""]), (None, ["", ""]), ("sinespacios", ["sinesp", "acios"]), ("a b", ["a", "b"])]
    got = spark.createDataFrame(rows, "t string, want array<string>").select("want", T.split_near(F.col("t"), 0.55).alias("p")).collect()
    assert all(r.p == r.want for r in got), got


def test_markdown(spark):
    text = "HECHOS\nuno\ndos\n\ntres\n1. primero\n- segundo\nfin\r\nRESUMEN:\n  • otro  \n\n- más\nEL FIN."
    want = "### HECHOS\n\nuno dos\n\ntres\n\n1. primero\n- segundo\nfin\n\n### RESUMEN:\n\n- otro\n- más\nEL FIN."
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.markdown(F.col("t")).alias("m")).collect()[0].m == want
    lines = ["HECHOS", "Hechos", "hechos:", "SEGUNDO: que", "AB", "ABCD", "ABCD.", "Abc Def:", "A" * 91, "12", "decimo lugar"]
    got = [r.h for r in spark.createDataFrame([(x,) for x in lines], "t string").select(T.is_heading(F.col("t")).alias("h")).collect()]
    assert got == [sequence.is_heading(x) for x in lines] == [True, True, True, True, False, True, False, False, False, False, True]


@pytest.mark.parametrize("a,b,rate", [("", "", 0.0), ("", "x", 1.0), ("a b c d", "a x c", 0.5), ("a b", "a b", 0.0), ("a", "", 1.0)])
def test_word_error(a, b, rate):
    assert R.word_error(a, b) == rate


def test_vector_and_alignment():
    v = R.ngram_vector("El pago del crédito", 256)
    assert math.isclose(sum(x * x for x in v), 1.0) and R.ngram_vector("", 8) == [0.0] * 8
    w, far = R.ngram_vector("el pago del credito", 256), R.ngram_vector("otra cosa muy distinta", 256)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(v, w) > 0.99 > dot(v, far)
    assert R.align(["uno", "dos!", "tres"], ["uno", "x", "dos", "tres"]) == [(0, 0), (1, 2), (2, 3)]


def test_activation(spark):
    rows = [((0, 0, None, None, 0, 0), "off"), ((5, 3, 0.9, 0.95, 0, 0), "shadow"), ((5, 0, 0.9, 0.95, 0, 0), "off"), ((20, 3, 0.8, 0.95, 0, 0), "active"), ((20, 3, 0.8, 0.95, 0, 1), "shadow"), ((20, 3, 0.9, 0.7, 0, 0), "off"), ((20, 3, 0.9, 0.9, 0, 0), "shadow"), ((20, 3, None, 0.9, 0, 0), "shadow")]
    df = spark.createDataFrame([(*a, s) for a, s in rows], "a int, b int, c double, d double, e int, f int, want string")
    got = df.select("want", T.profile_status(*map(F.col, "abcdef")).alias("s"), T.profile_status(*map(F.col, "abcdef"), semantic=False).alias("u")).collect()
    assert all(r.s == r.want for r in got) and {r.u for r in got[1:]} == {"shadow"} and got[0].u == "off"


def test_folding(spark):
    got = spark.createDataFrame([("ÁÜñÇ ﬀ Å ý ÿ ß Ø ĳ ① ½ x́",)], "t string").select(T.fold(F.col("t")).alias("a"), T.unaccent(F.col("t")).alias("b")).first()
    assert got.a.split()[0] == "aunc" and got.a.split()[2:5] == ["a", "y", "y"] and got.a.split()[-1] == "x"
    assert got.b.split()[0] == "aunc" and got.b.split()[2:5] == ["å", "ý", "ÿ"]
