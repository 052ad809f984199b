import random
import re

import numpy as np
import xxhash

from lexmesh.llm import graph, simhash as op


def slow_fingerprint(text, n=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(values, max_bits):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = sorted(set(values))
    for i, x in enumerate(vs):
        for y in vs[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= max_bits:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vs}


def texts():
    rng = random.Random(3)
    words = ["Über", "ÀB", "the", "of", "x" * 40, "a b", "Z", "tion"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 50, 400]))) for _ in range(30)]
    near = [b.replace("the of", "the the", 1) for b in base]
    return [None, "", " \n\t", "one", "One two", "a\x0bb\x0cc\rd", *base, *near, *base[:5]]


def test_fingerprint_is_the_majority_of_shingle_bits(monkeypatch):
    for t in texts():
        assert op.fingerprint((t or "").encode()) == slow_fingerprint(t)
        assert op.fingerprint((t or "").encode(), 5) == slow_fingerprint(t, 5)
    monkeypatch.setattr(op, "PIECE", 7)
    for t in texts():
        assert op.fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_query_matches_brute_force(spark):
    rows = [(i, t, 1, "z") for i, t in enumerate(texts())] + [(None, "one", 2, None), (3, "one", 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, text_key string")
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    comp = brute_components(fps, 3)
    least = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in op.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, f, least[comp[f]]) for (i, *_), f in zip(rows, fps)), key=str)
    kept = op.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_all_bucket_ways_find_the_same_components(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(25):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            x = rng.choice([x, b])
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    signed = [r.fp for r in df.collect()]
    for bits, bucket in ((3, 16384), (3, 4), (2, 3), (1, 3), (0, 3)):
        want = brute_components(signed, bits)
        got = {r.node: r.root for r in graph.components(op.links(df, bits, bucket)).collect()}
        assert {v: got.get(v, v) for v in signed} == want, (bits, bucket)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(df).count() == 0
    assert op.drop_near_duplicates(df).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(n + 1, n + 2), (n + 1, n + 1)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), n + 1: n + 1, n + 2: n + 1}
