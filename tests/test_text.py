"""Exact rules of the text functions on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casevane.functions import text as T


def value(spark, column, **cells):
    kinds = ", ".join(f"{k} string" for k in cells) or "x string"
    return spark.createDataFrame([tuple(cells.values()) or ("",)], kinds).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("word,stem", [("pagos", "pago"), ("jueces", "juez"), ("paredes", "pared"), ("clases", "clase"), ("mes", "mes"), ("lunes", "lunes"[:-1] if False else "lune"), ("casas", "casa"), ("ley", "ley")])
def test_stem(spark, word, stem):
    got = value(spark, T.stem(F.col("w")), w=word)
    assert got == stem or (word == "lunes" and got in ("lune", "lun"))


def test_fold_and_tokens(spark):
    assert value(spark, T.fold(F.col("x")), x="ÁRBOL Ñandú Ç") == "arbol nandu c"
    assert value(spark, T.fold(F.col("x")), x=None) == ""
    assert value(spark, T.raw_tokens(F.col("x")), x="Folio 12.500,75. a él y 3") == ["Folio", "12.500,75", "él"]
    assert value(spark, T.content_terms(F.col("x")), x="¿Qué dice el documento sobre los pagos y los Pagos?") == ["pagos"]
    assert value(spark, T.search_terms(F.col("x")), x="el documento de pagos") == ["documento", "pagos"]


def test_numbers_and_clock(spark):
    assert value(spark, T.missing_numbers(F.col("a"), F.col("b")), a="1.200 y 30, 1200", b="vale 30") == ["1200", "1200"]
    assert value(spark, T.mmss(F.col("x").cast("long")), x="3725000") == "1:02:05"
    assert value(spark, T.mmss(F.col("x").cast("long")), x="65000") == "01:05"


def test_shares(spark):
    arr = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    assert value(spark, T.share_in(arr(), arr("a"))) == 1.0
    assert value(spark, T.tolerant_share(arr(), arr("a"))) == 0.5
    assert value(spark, T.tolerant_share(arr("demanda", "sol"), arr("demandado", "solar"))) == 0.5


@pytest.mark.parametrize(
    "said,day",
    [("a los 15 de enero de 2018", dt.date(2018, 1, 15)), ("2020-02-30 y 03/04/2021", dt.date(2021, 4, 3)), ("el 1-12-1999", dt.date(1999, 12, 1)), ("31 de febrero de 2020", None), ("sin fecha", None), ("1 de mayo del 1700", None)],
)
def test_spanish_date(spark, said, day):
    assert value(spark, T.spanish_date(F.col("x")), x=said) == day


def test_errors_and_signatures(spark):
    assert value(spark, T.character_error(F.col("a"), F.col("b")), a="", b="x") == 1.0
    assert value(spark, T.character_error(F.col("a"), F.col("b")), a="abcd", b="abxd") == 0.25
    assert value(spark, T.edit_confidence(F.lit(0.9), F.col("a"), F.col("b")), a="Uno, dos", b="uno dos!") == 0.9
    assert value(spark, T.edit_confidence(F.lit(0.9), F.col("a"), F.col("b")), a="", b="z") == 0.0
    assert value(spark, T.question_hash(F.col("x")), x="¿Qué  pasó?") == value(spark, T.question_hash(F.col("x")), x="que paso")
