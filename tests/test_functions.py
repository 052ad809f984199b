"""Exact goldens for the scalar functions (strip, cosine, padding, keys,
cleaning rules, hash draws)."""

import math

from pyspark.sql import functions as F

from lexmesh.functions import text as T
from lexmesh.functions.hashing import hash_u
from lexmesh.functions.rules import DEFAULT_RULES
from lexmesh.functions.vectors import cosine, linear_combination, pad_list


def test_strip_wildcards(spark):
    df = spark.createDataFrame([("Ufer*",), ("am * langen Steg*",), ("****",), ("*Schilf",)],
                               "t string")
    got = [r[0] for r in df.select(T.strip_wildcards("t")).collect()]
    assert got == ["Ufer", "am  langen Steg", "", "Schilf"]


def test_cosine_goldens(spark):
    rows = [([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]),
            ([1.0, 0.0, 0.0], [1.0, 1.0, 1.0]), ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]),
            ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got[0] == 0 and got[1] == 1
    assert math.isclose(got[2], 0.5773502691896257, rel_tol=1e-12)
    assert math.isclose(got[3], 0.7142857142857143, rel_tol=1e-12)
    assert got[4] == 0  # zero vector -> 0


def test_pad_list(spark):
    df = spark.createDataFrame([(["1", "2", "3"],)], "a array<string>")
    assert df.select(pad_list("a", 5)).first()[0] == ["1", "2", "3", None, None]
    assert df.select(pad_list("a", 2)).first()[0] == ["1", "2"]


def test_split_key(spark):
    df = spark.createDataFrame([("Werkzeug:a:b",), ("Wetter:Nebel",)], "k string")
    cat, term = T.split_key("k")
    assert [tuple(r) for r in df.select(cat, term).collect()] == [("Werkzeug", "a:b"), ("Wetter", "Nebel")]


def test_linear_combination(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [0.5, 0.25, 0.25])],
                               "v array<array<double>>, w array<double>")
    assert df.select(linear_combination("v", "w")).first()[0] == [0.75, 0.5]


def test_capitalize_matches_python(spark):
    words = ["ßach", "äpfel", "hAUS", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(T.capitalize("w")).collect()]
    assert got == [w.capitalize() for w in words]


def test_clean_rules_literal_sentences(spark):
    rows = [("Angela Merkel trifft Trump in NRW",), ("Das kostet 5 Mrd. und die GroKo",),
            ("Seine Frau fährt einen SUV mit 5 km/h",), ("Lesen: https://www.example.org/x",),
            ("Borussia gegen FC Bayern, bvbFCB",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(T.apply_rules(F.col("t"), DEFAULT_RULES)).collect()]
    assert got[0] == "Kanzlerin trifft Präsident in Bundesland"
    assert got[1] == "Das kostet 5 Milliarden und die Koalition"
    assert got[2].startswith("Ehefrau") and "Auto" in got[2] and "Geschwindigkeit" in got[2]
    assert "<URL>" in got[3] and "www." not in got[3]
    assert got[4] == "Verein gegen Verein, VereinVerein"


def test_hash_draw_matches_duckdb_golden(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    assert df.select(hash_u("x", "y")).first()[0] == 225584429


def test_german_stopwords():
    sw = T.german_stopwords()
    assert len(sw) == 231 and "aber" in sw and "und" in sw
