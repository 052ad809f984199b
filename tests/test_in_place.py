"""Counts stay with their documents, and written steps leave no shuffle files or dead tables."""

import os

import pytest
from pyspark.sql import functions as F

from lexmesh.operators import counts as CN
from lexmesh.operators import tokens as TK
from lexmesh.operators import util
from lexmesh.operators.processor import fit_processor
from lexmesh.session import discard, materialize, shuffles_dropped, CLEANUP


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "Haus Garten haus " + " ".join(f"Wort{'abcdefghij'[(k * j) % 10]}{'xyz'[k % 3]}" for j in range(4)) + (" Rest" * (k % 2)))
            for k in range(40)]
    return spark.createDataFrame([*rows, (3, "Haus Baum"), (None, "Haus"), (50, None)], "doc_id long, text string").cache()


def exchanged(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("== Initial Plan")] if "== Initial Plan" in plan else plan
    return plan


@pytest.mark.parametrize("most", [1, 900, 1 << 20])
def test_counts_of_rare_words_move_only(spark, docs, monkeypatch, most):
    """All counts moved to their words and back where the words were more than could be sent."""
    surfaces = CN.surface_counts(docs)
    annotations = TK.derive_annotations(CN.distinct_surfaces(surfaces))
    want = sorted(TK.analyzed_term_frequency(TK.clean_docs(docs), annotations, TK.stopword_list(spark)).collect(), key=str)
    monkeypatch.setattr(util, "SMALL_BYTES", most)
    written, write = [], CN.write_bucketed
    monkeypatch.setattr(CN, "write_bucketed", lambda df, *a, **k: written.append(df) or write(df, *a, **k))
    got = CN.term_counts(surfaces, annotations, TK.stopword_list(spark))
    assert sorted(got.collect(), key=str) == want and len(want) > 40
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the rest is too many to be sent
    try:
        plan = exchanged(written[0].select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the sum by document moves nothing; some words, not none or all, are sent if they are too many
    assert not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x and "ENSURE_REQUIREMENTS" in x]
    assert ("Union" in plan) == (most == 900)


def test_annotations_repeat_a_surface(spark, docs, monkeypatch):
    surfaces = CN.surface_counts(docs)
    twice = TK.derive_annotations(CN.distinct_surfaces(surfaces))
    twice = twice.unionByName(twice.where("surface = 'Haus'").withColumns({"lemma": F.lit("Bau"), "upos": F.lit("NOUN")}))
    found = []
    for most in (1 << 20, 1):
        monkeypatch.setattr(util, "SMALL_BYTES", most)
        found.append(sorted(CN.term_counts(surfaces, twice, TK.stopword_list(spark)).collect(), key=str))
    assert found[0] == found[1] and any(r.word == "Bau" for r in found[0])


def test_processor_with_rare_words_moved(spark, docs, monkeypatch):
    annotations = TK.derive_annotations(CN.distinct_surfaces(CN.surface_counts(docs)))
    wv = spark.createDataFrame([("Haus", [1.0, 2.0]), ("haus", [0.5, 1.0])], "word string, vec array<double>")
    found = []
    for most in (1 << 20, 900, 1):
        monkeypatch.setattr(util, "SMALL_BYTES", most)
        p = fit_processor(docs, wv, annotations, TK.stopword_list(spark), min_df=2, max_df=1.0)
        found.append((sorted(p.tfidf.vocab.collect(), key=str),
                      sorted(((r.doc_id, r.word, r.tf, round(r.weight, 9)) for r in p.weights(docs).collect()), key=str)))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 40


def test_written_steps_leave_no_shuffle_files(spark, monkeypatch):
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].toString()

    def held():
        return sum(f.startswith("shuffle_") and f.endswith(".data") for _, _, fs in os.walk(folder) for f in fs)

    before = held()
    kept = spark.range(1000).repartition(3, "id")
    kept.write.format("noop").mode("overwrite").save()
    assert held() > before
    before, set_before = held(), spark.conf.get(CLEANUP, None)
    df = materialize(spark.range(1000).repartition(3, "id"))
    assert held() <= before and df.count() == 1000 and spark.conf.get(CLEANUP, None) == set_before
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        1 / 0
    assert spark.conf.get(CLEANUP, None) == set_before


def test_discard_deletes_own_tables_only(spark, tmp_path):
    own = materialize(spark.range(5))
    files = [f.removeprefix("file:").replace("//", "") if f.startswith("file://") else f for f in own.inputFiles()]
    discard(own)
    assert not any(os.path.exists("/" + f.lstrip("/")) for f in files)
    spark.range(5).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    discard(given)
    assert given.count() == 5
