import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.llm import ann as op
from lexmesh.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, vector string, rank int"


def brute(rows, k=10, every=100):
    clean = sorted({(i, tuple(np.float32(v).tolist())) for i, v, *_ in rows if i is not None and usable(v)})
    ids = np.array([i for i, _ in clean])
    data = np.array([v for _, v in clean], float)
    out = {}
    for i, v in clean:
        if i % every == 0:
            d = np.sqrt(((data - np.array(v)) ** 2).sum(axis=1))
            order = [n for n in np.lexsort((ids, d)) if ids[n] != i][:k]
            out[i] = [(int(ids[n]), float(d[n])) for n in order]
    return out


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def rows(n=1500, seed=14):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 1) for _ in range(8)], "x", 1) for i in range(n)]
    same = out[3][1]
    out += [(n + i, same, "x", 1) for i in range(500)]
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 9]
    out += [(100 * (n + k), v, None, None) for k, v in enumerate(bad)] + [(None, same, "", 0), out[0], out[0]]
    return out


def test_a_full_visit_is_exact(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 50)
    monkeypatch.setattr(op, "QUERIES", 7)
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {}
    for r in op.neighbours(df, F.col("vec_id") % 100 == 0, leaf=100, visit=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows())
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [x[:2] for x in sorted(found)] == [(k + 1, i) for k, (i, _) in enumerate(want[q])]
        assert np.allclose([x[2] for x in sorted(found)], [d for _, d in want[q]])


def test_recall_with_production_parameters(spark, sf):
    data = table(spark, sf.replace("0.001", "0.1"), "embeddings")
    got = op.neighbours(data, F.col("vec_id") % 100 == 0).collect()
    local = data.collect()
    ids, x = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        want = {int(ids[n]) for n in np.lexsort((ids, d)) if ids[n] != q} if len(ids) < 12 else \
            {int(i) for i in ids[np.lexsort((ids, d))][:11] if i != q}
        found = {r.vec_id for r in got if r.query_id == q}
        assert len(found) == 10
        hits += len(found & want)
        total += 10
    assert hits >= 0.9 * total


@pytest.mark.parametrize("n", [0, 1, 5])
def test_small_tables(spark, n):
    df = spark.createDataFrame([(i * 100, [1.0 + i, 2.0], "", 0) for i in range(n)], SCHEMA)
    assert op.neighbours(df, F.col("vec_id") % 100 == 0).count() == n * (n - 1)
