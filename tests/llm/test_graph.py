"""Components against plain search, and joins that Spark may split where a key is hot."""

import random

from pyspark.sql import functions as F

from lexmesh.llm import graph as op
from lexmesh.session import materialize


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_components_equal_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)]
    edges += [(200, k) for k in range(201, 260)] + [(300, 300), (5, 5)] + [(7, 8)] * 9
    got = op.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == brute(edges)


def test_no_edges(spark):
    assert op.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hot_node_is_split(spark):
    """The stars' joins of a node with most of all edges run with split partitions."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        star = spark.range(1, 200_000).select((F.col("id") + 10).alias("a"), F.lit(1).cast("long").alias("b"))
        rest = spark.range(300_000, 302_000).select(F.col("id").alias("a"), (F.col("id") - 1000).alias("b"))
        edges = materialize(star.unionByName(rest).repartition(8), "edges")
        assert op._large_star(edges).count() > 0
        least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
        hot = edges.join(least, "b")
        hot.collect()
        assert "skew=true" in hot._jdf.queryExecution().executedPlan().toString()
        own = edges.join(edges.groupBy("b").agg(F.min("a").alias("m")), "b")
        own.collect()
        assert "skew=true" not in own._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
