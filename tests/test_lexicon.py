"""Lexicon sources and algebra on small lexica with umlauts and ragged lists."""

import json

import pytest

from lexmesh.operators import lexicon as L
from lexmesh.sources import lexicon_io as IO

MYLEX2 = {"Wetter": ["Nebel", "Hagel", "Böe", "boeig", "Sturm", "stürmisch", "Tau", "Reif", "Dürre"],
          "Werkzeug": ["Zange", "Säge", "Amboss"]}


def _as_dict(df):
    return {r["category"]: r["terms"] for r in L.lexicon_to_map(df).collect()}


def test_from_dict_and_to_map(spark):
    lex = IO.lexicon_from_dict(spark, MYLEX2)
    assert _as_dict(lex) == MYLEX2
    shape = L.lexicon_shape(lex).first()
    assert (shape["n_categories"], shape["max_rows"]) == (2, 9)


def test_json_round_trip(spark, tmp_path):
    p = tmp_path / "wetter.json"
    p.write_text(json.dumps(MYLEX2), encoding="utf-8")
    assert _as_dict(IO.lexicon_from_json(spark, str(p))) == MYLEX2


def test_csv_wide_latin1(spark, tmp_path):
    p = tmp_path / "lex.csv"
    p.write_bytes("Wasser;Schule\nUfer;Tafel\nBöschung;Kreide\nSegel;\n".encode("latin1"))
    lex = IO.lexicon_from_csv(spark, str(p), sep=";", encoding="latin1")
    assert _as_dict(lex) == {"Wasser": ["Ufer", "Böschung", "Segel"],
                             "Schule": ["Tafel", "Kreide"]}


def test_merge_keeps_existing_categories(spark):
    a = IO.lexicon_from_dict(spark, {"A1": ["Ufer"], "A2": ["Zange"]})
    b = IO.lexicon_from_dict(spark, {"A2": ["Säge"], "B1": ["Tafel", "Kreide"]})
    merged = _as_dict(L.merge_lexica([a, b]))
    assert merged == {"A1": ["Ufer"], "A2": ["Zange"], "B1": ["Tafel", "Kreide"]}
    assert _as_dict(a) == {"A1": ["Ufer"], "A2": ["Zange"]}  # inputs unchanged (Q19)


def test_select_keys_overlap_is_main_only(spark):
    main = IO.lexicon_from_dict(spark, {"A1": ["x"], "A2": ["y"]})
    sup = IO.lexicon_from_dict(spark, {"B1": ["z"], "B2": ["w"]})
    roles = {r["category"]: r["role"] for r in
             L.select_keys(main, sup, support_keys=["A2", "B1", "B2"]).collect()}
    assert roles == {"A1": "main", "A2": "main", "B1": "support", "B2": "support"}


def test_polarity_inputs_equal_and_last_duplicate_wins(spark):
    d = {"hell": 0.8, "warm": 0.6, "kalt": -0.6, "rau": -0.8}
    a = IO.polarity_from_pairs(d, spark)
    pairs = spark.createDataFrame(list(d.items()), "w string, v double")
    b = IO.polarity_from_pairs(pairs)
    assert sorted(map(tuple, a.select("term", "weight").collect())) == \
        sorted(map(tuple, b.select("term", "weight").collect()))
    dup = IO.polarity_from_pairs({"warm": 0.6, "hell": 0.8}, spark).unionByName(
        spark.createDataFrame([(5, "warm", 0.2)], L.POLARITY_SCHEMA))
    got = {r["term"]: r["weight"] for r in L.dedupe_last_weight(dup).collect()}
    assert got == {"warm": 0.2, "hell": 0.8}


def test_load_lexicon_wrong_kind(spark, tmp_path):
    lex = IO.lexicon_from_dict(spark, {"A": ["x"]})
    IO.save_lexicon(lex, str(tmp_path / "l"), kind="category")
    with pytest.raises(ValueError):
        IO.load_lexicon(spark, str(tmp_path / "l"), kind="polarity")


def test_missing_weights_are_null_or_end_the_job(spark):
    import pytest
    from lexmesh.operators import lexicon as L
    polarity = spark.createDataFrame([(0, "hell", .8), (1, "kalt", -.6), (2, "hell", .9)], "pos int, term string, weight double")
    words = spark.createDataFrame([("hell",), ("nie",)], "word string")
    assert {r.word: r.weight for r in L.polarity_weight(polarity, words).collect()} == {"hell": .9, "nie": None}
    known = words.where("word = 'hell'")
    assert L.polarity_weight(polarity, known, missing="error").first().weight == .9
    with pytest.raises(Exception, match="no weight for the word nie"):
        L.polarity_weight(polarity, words, missing="error").collect()
    with pytest.raises(ValueError):
        L.polarity_weight(polarity, words, missing="zero")
