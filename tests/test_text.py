import pytest
from pyspark.sql import functions as F

from tessel.functions import text as tx
from tessel.operators.evaluation import vbyte_decode, vbyte_encode
from tessel.operators.suggest import snippet

STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "matting": "mat", "mating": "mate", "meeting": "meet", "running": "run", "sized": "size", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "hopeful": "hope", "goodness": "good", "triplicate": "triplic", "formative": "form", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "probate": "probat", "cease": "ceas", "": "", "a": "a", "the": "the",
    "generalization": "gener", "algorithms": "algorithm", "learning": "learn", "tree": "tre", "free": "fre", "coffee": "coffe", "microservices": "microservic", "microservic": "microserv",
}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert tx.stem(word) == STEMS[word]


def test_normalize(spark):
    cases = {"micro-services": "microservices", "Café": "caf", "K": "", "  a \t b\x0bc ": "a b c", "": "", "?!": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.normalize(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases


def test_bigrams(spark):
    got = spark.createDataFrame([(["abc", "def", "x", "ghi", "jkl"],), ([],), (["abc"],)], "t array<string>").select(tx.bigrams(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in got] == [["abc def", "ghi jkl"], [], []]


def test_vbyte():
    values = [3, 9, 200, 201, 5000, 5001, 1048576]
    assert [len(vbyte_encode([v])) for v in (0, 127, 128, 1048576)] == [1, 1, 2, 3]
    assert vbyte_decode(vbyte_encode(values, True), True) == values
    assert len(vbyte_encode(values, True)) <= 12


def test_snippet():
    text = "The first words say nothing. " * 10 + "Neural networks learn from data and neural nets generalise well."
    got = snippet(text, ["neural", "networks"], 60, "html")
    assert "<b>Neural</b> <b>networks</b>" in got and got.startswith("…")
    assert snippet("", ["a"]) == "" and snippet("short", ["a"]) == "short"
    assert snippet("x" * 200 + " y", [], 140) == "x" * 140 + "…"
    assert snippet("a" * 50 + " b", ["zzz"], 10) == "a" * 50 + "…"
