import hashlib
import random

import numpy as np

from lexmesh.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, n_bytes int, kept string"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], set()
    for i, t, *_ in rows:
        t = t or ""
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep and (t, i) not in seen,
                    hashlib.sha256(t.encode()).hexdigest()))
        seen.add((t, i))
    return sorted(out, key=str)


def rows():
    rng = random.Random(1)
    long = "".join(rng.choice("abc é") for _ in range(60_000))
    texts = ["", None, "a", "b", "a\n", long, long[:-1] + "x", "é" * 9000]
    out = [(i, rng.choice(texts), i, "x") for i in range(120)]
    return out + [(7, "twice", 0, None), (7, "twice", 0, None), (None, "a", 1, "y"), (None, "only null", 1, "y")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(map(tuple, op.duplicate_classes(df).collect()), key=str)
    assert got == brute(rows())


def test_collisions_are_told_apart(spark):
    weak = op.Fingerprint(moduli=(2, 2, 2, 2), bases=(1, 1, 1, 1))
    data = [(i, x, 0, "") for i, x in enumerate(["ab", "ba", "ab", "cd", "ce", "xyz", "zyx", "xyz"])]
    df = spark.createDataFrame(data, SCHEMA)
    groups = op.fingerprints(df, weak).groupBy(*op.FP).count().withColumnRenamed("count", "group_size")
    assert op.collided(df, groups, weak).count() >= 1
    assert op.collided(df, op.fingerprints(df).groupBy(*op.FP).count()
                       .withColumnRenamed("count", "group_size")).isEmpty()
    got = sorted(map(tuple, op.duplicate_classes(df, weak).collect()), key=str)
    assert got == brute(data)


def test_drop_keeps_one_row_and_all_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = op.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t, *_ in rows()})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.duplicate_classes(df).count() == 0
    assert op.drop_duplicates(df).count() == 0


def test_chunk_hashes_compose():
    h, data = op.Fingerprint(chunk=16), np.frombuffer(random.Random(2).randbytes(1000), np.uint8)
    for cut in (0, 1, 15, 16, 500, 999, 1000):
        assert h.join(h.of(data[:cut]), h.of(data[cut:])) == h.of(data)


def test_equal_chunks_are_folded_before_the_shuffle(spark, monkeypatch):
    data = [(i, "one text of a group", 0, "") for i in range(5000)] + [(-i, f"text {i}", 0, "") for i in range(1, 500)]
    random.Random(4).shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    sent = op.chunk_rows(df)
    assert sent.count() == 500 and sent.distinct().count() == 500
    # with room for few, equal ones may be sent again, but none is lost
    monkeypatch.setattr(op, "FOLD_BYTES", 2000)
    again = op.chunk_rows(spark.createDataFrame([(i, f"text {i % 50}", 0, "") for i in range(200)], SCHEMA).coalesce(1))
    assert again.count() == 200 and again.distinct().count() == 50 and op.chunk_rows(df).count() == 500
    # texts of one fingerprint are all sent
    weak = op.Fingerprint(moduli=(2, 3), bases=(1, 1), chunk=4)
    assert op.chunk_rows(df, weak).select("chunk").distinct().count() == 500
