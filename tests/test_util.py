"""Scale helpers: distributed row numbers, one partitioning by document, shared folder."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmesh.operators.util import global_row_number, spread, text_parts


def test_global_row_number_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"),
                                     (F.col("id") % 13).alias("g")).repartition(7)
    got = global_row_number(df, [F.desc("g"), F.asc("k")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("g"), F.asc("k"))) - 1)
    assert sorted(map(tuple, got.select("k", "g", "rn").collect())) == \
        sorted(map(tuple, want.select("k", "g", "rn").collect()))


def test_global_row_number_keeps_wide_rows(spark):
    """Complete and dense for many wide rows, whatever AQE does to the partitions."""
    df = spark.range(0, 50_000).select((F.col("id") * 7919 % 50_021).alias("k"), F.transform(
        F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3) + i).alias("vec"))
    for aqe in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            got = global_row_number(df, [F.col("k")], "rn")
            r = got.where(F.size("vec") == 64).agg(F.count("rn").alias("n"), F.countDistinct("rn").alias("d"),
                                                   F.min("rn").alias("a"), F.max("rn").alias("b")).first()
            assert tuple(r) == (50_000, 50_000, 0, 49_999)
            w = Window.orderBy("rn")
            wrong = got.select("k", "rn").withColumn("p", F.lag("k").over(w)).where("p >= k")
            assert wrong.count() == 0
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_spread_clusters_by_document(spark):
    """Aggregates per document need no further exchange."""
    from lexmesh.operators.tokens import count_tokens
    docs = spread(spark.createDataFrame([(1, ["a", "a"]), (2, ["b"])], "doc_id long, words array<string>"), "doc_id")
    counted = count_tokens(docs.select("doc_id", F.explode("words").alias("word")))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_tasks_hold_a_bounded_share_of_the_text(spark):
    """Adaptive execution joined partitions up to 64 MB of packed text, whose tokens take some twenty times that."""
    docs = spark.createDataFrame([(k, "wort " * 40) for k in range(300)] + [(None, None)], "doc_id long, text string")
    parts = text_parts(docs, task_bytes=1000)
    assert parts == 300 * 200 // 1000
    assert text_parts(docs.unionByName(docs), task_bytes=1000) == 2 * parts
    assert text_parts(docs) is None and text_parts(docs.where("false")) is None
    sizes = spread(docs, "doc_id", parts=parts).groupBy(F.spark_partition_id()).agg(
        F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(sizes) > parts / 2 and max(r.n or 0 for r in sizes) < 4000


def test_cluster_sessions_need_a_shared_folder():
    import pytest
    from lexmesh.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_small_tables_are_sent_and_large_ones_are_not(spark):
    from lexmesh.operators.util import sent_if_small
    df = spark.createDataFrame([("a", 1, [1.0] * 10), (None, None, None)], "word string, n long, vec array<double>")
    hint = "strategy=broadcast"
    assert hint in sent_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert hint not in sent_if_small(df, 200)._jdf.queryExecution().analyzed().toString()
    assert hint in sent_if_small(df.limit(0), 0)._jdf.queryExecution().analyzed().toString()


def test_counts_and_cluster_rows_stay_with_their_documents(spark):
    """A small vocabulary and the clustered words' vectors go to the documents, whatever
    Spark's own limit: no exchange by word."""
    from lexmesh.operators.clusters import doc_clusters
    from lexmesh.operators.tfidf import tfidf_transform
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tf = spark.createDataFrame([(d, w, 1) for d in range(6) for w in ("a", "b", "c")][:-2], "doc_id long, word string, tf long")
        vocab = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "word string, idf double")
        weights = tfidf_transform(tf, vocab, counted=True)
        wv = spark.createDataFrame([(w, [float(k), 1.0]) for k, w in enumerate("abc")], "word string, vec array<double>")
        clusters = spark.createDataFrame([("a", 0), ("b", 0)], "word string, cluster_id long")
        found = doc_clusters(weights, clusters, wv)
        for df in (weights, found):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(word" not in plan and "BroadcastHashJoin" in plan
        rows = {r.doc_id: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(rows) == list(range(6)) and rows[5].vec == [0.0, 1.0]
    assert rows[0].vec[0] == pytest.approx(1 / 3) and rows[0].weight == pytest.approx(1)
