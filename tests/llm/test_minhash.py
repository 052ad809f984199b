import math
import random
import re

import numpy as np

from lexmesh.llm import minhash as op

SCHEMA = "doc_id long, text string, key string, id int, signature string"


def brute_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[k:k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def brute(rows, share=(85, 100)):
    sets = [brute_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    out = []
    for k, r in enumerate(rows):
        c = least.get(find(k)) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


def rows(seed=5, clusters=12, size=25):
    draw = random.Random(seed)
    vocab = [f"w{k}" if k % 7 else f"Ä{k}é" for k in range(3000)]
    out = []
    for c in range(clusters):
        words = draw.choices(vocab, k=draw.choice([4, 30, 80, 300]))
        for _ in range(size):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            if draw.random() < .3:
                words = copy  # chains of copies of copies
            out.append((len(out) + 1, draw.choice([" ", "\n", " \t "]).join(copy), "clash", 0, ""))
    out += [(None, "one two", "", 0, ""), (None, "One\ttwo ", "", 0, ""), (900, "one two", "", 0, ""), (901, "one", "", 0, ""),
            (902, "", "", 0, ""), (903, None, "", 0, ""), (904, " \n", "", 0, ""), (None, None, "", 0, ""),
            (None, "no id has this text", "", 0, ""), (905, "lang " * 300_000 + "x" * 3_000_000, "", 0, "")]
    return out + out[:5] + [(-3, out[0][1].upper(), "", 0, "")]


def test_components_equal_brute_force(spark):
    data = rows()
    got = op.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(7))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_small_blocks_change_nothing(spark):
    """Buckets and candidate groups over many blocks, which meet two by two."""
    data = rows(seed=8, clusters=3, size=60)
    got = op.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3), bucket=7, hashes=500)
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    none = [(1, "", "", 0, ""), (2, None, "", 0, "")]
    assert sorted(map(tuple, op.near_duplicates(spark.createDataFrame(none, SCHEMA)).collect())) == brute(none)


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    draw = random.Random(3)
    text = " ".join(draw.choice(["a", "bb", "Ab", "c" * 40]) for _ in range(900)).encode()
    whole = op.Shingles(3)(text)
    assert len(whole) == len(brute_set(text.decode()))
    monkeypatch.setattr(op, "PIECE", 10)
    assert np.array_equal(op.Shingles(3)(text), whole)
    assert len(op.Shingles(3)(b"a b")) == 1 and len(op.Shingles(3)(b" \n")) == 0


def test_cutoffs_are_posterior_bounds():
    """The chance of a similarity at or above the threshold, by numeric integration."""
    grid = np.linspace(0, 1, 200_001)
    for a, b, least in op.cutoffs(160, .85, 1e-6):
        assert b == a + 32

        def above(m):
            density = grid ** m * (1 - grid) ** (b - m)
            return density[grid >= .85].sum() / density.sum()
        assert above(least) >= 1e-6 * .99 and (least == 0 or above(least - 1) < 1e-6 * 1.01)


def test_pruning_keeps_pairs_at_the_threshold():
    draw, kept = np.random.default_rng(1), 0
    steps = op.cutoffs(160, .85, 1e-9)
    for _ in range(300):
        pool = draw.integers(0, 1 << 63, 1085, dtype=np.uint64)
        one, two = np.unique(pool[:1000]), np.unique(pool[85:])
        found = np.array([op.signature(one, 160), op.signature(two, 160)])
        assert math.isclose((found[0] == found[1]).mean(), 915 / 1085, abs_tol=.16)
        kept += len(op.survivors(found[0], found, np.array([1]), steps))
    assert kept == 300
