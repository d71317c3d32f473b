"""Read tools on literal rows."""

from types import SimpleNamespace

from casevane.operators import guard
from casevane.plans.tools import TOOLS

PARTS = [(12, "hot bolt", "Brand#3", 1), (11, "blue ring", "Brand#4", 7), (112, "gear", "Brand#5", 3), (40, "nut", "Brand#12", 9), (41, None, None, None), (50, "kit 12", "Brand#6", 9), (7, "pin", "Brand#7", 50), (None, None, "Brand#12", 2)]


def test_rule_lookup_gives_every_rule(spark):
    """The very article first, then all that bear its number, newest first; neither one row nor five."""
    part = spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_size int")
    t = SimpleNamespace(spark=spark, part=part)
    found = lambda *a, **b: [r.identifier for r in TOOLS["lookup_legal_rule"](t, *a, **b).collect()]
    want = ["12", "40", "50", "11", "112", None]
    assert found("Art. 12") == found("12") == want
    assert found("12", k=2) == want[:2] and found("12", source="Brand#12") == ["40", None]
    assert found(" BOLT ") == ["12"] and found("%") == found(" ") == found("12", jurisdiction="co") == []
    assert [r.exact for r in TOOLS["lookup_legal_rule"](t, "Arts. 12 y 40").limit(3).collect()] == [True, True, False]


def test_rules_named_keeps_jurisdictions(spark):
    rules = spark.createDataFrame([("839-01", "Código", "t", "co"), ("83901", "Código", "t", "pe"), ("1", "Código", None, None)], "identifier string, source string, text string, jurisdiction string")
    asked = spark.createDataFrame([("839-01",), (None,)], "identifier string")
    assert {(r.identifier, r.exact) for r in guard.rules_named(rules, asked).collect()} == {("839-01", True), ("83901", True)}
    assert [r.identifier for r in guard.rules_named(rules, asked, "pe").collect()] == ["83901"]


def test_find_person_gives_everybody(spark):
    """More than a thousand people bear the name; k is a limit only where it is given."""
    supplier = spark.range(1200).selectExpr("id AS s_suppkey", "concat('Ana ', id) AS s_name", "int(id % 25) AS s_nationkey")
    nation = spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int")
    t = SimpleNamespace(spark=spark, supplier=supplier, nation=nation, region=spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string"))
    assert {tuple(r) for r in TOOLS["find_person"](t, "ANA").collect()} == {(f"s{i}", f"n{i % 25}") for i in range(1200)}
    assert [tuple(r) for r in TOOLS["find_person"](t, "ana", k=2).collect()] == [("s0", "n0"), ("s1", "n1")]
