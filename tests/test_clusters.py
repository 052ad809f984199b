"""The pruned similarity join and the dendrogram against plain single linkage on data with clusters."""

import numpy as np
import pytest

from lexmesh.operators import clusters as C


def clustered(n_groups=30, size=12, dim=16, seed=4, spread=.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_groups, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vecs = np.repeat(centres, size, axis=0) + rng.normal(size=(n_groups * size, dim)) * spread / np.sqrt(dim) * \
        rng.choice([.5, 1, 3, 6], size=(n_groups * size, 1))
    vecs *= rng.uniform(.1, 9, size=(len(vecs), 1))
    vecs[7] = vecs[8]  # equal vectors
    vecs[9] = 0.0
    return [f"w{k:04d}" if k % 5 else f"ä{k:04d}" for k in range(len(vecs))], vecs


@pytest.fixture(scope="module")
def data(spark):
    names, vecs = clustered()
    order = sorted(names)
    words = spark.createDataFrame([(w, order.index(w)) for w in names], "word string, idx long")
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in zip(names, vecs)] + [("other", [1.0] * 16)],
                                    "word string, vec array<double>")
    return names, vecs, words, vectors


def cosines(vecs):
    norm = np.linalg.norm(vecs, axis=1)
    unit = np.where(norm[:, None] == 0, 0, vecs / np.where(norm == 0, 1, norm)[:, None])
    return unit @ unit.T


def single_linkage(names, vecs, threshold):
    """Plain merging of the nearest clusters until they are too far apart."""
    sims, label = cosines(vecs), list(range(len(names)))
    pairs = sorted(((1 - sims[i, j], i, j) for i in range(len(names)) for j in range(i)))
    for d, i, j in pairs:
        if d > threshold:
            break
        a, b = label[i], label[j]
        if a != b:
            label = [a if x == b else x for x in label]
    return {frozenset(n for n, x in zip(names, label) if x == k) for k in set(label)}


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster_id"], set()).add(r["word"])
    return {frozenset(v) for v in out.values()}


def test_cuts_equal_single_linkage_at_five_thresholds(spark, data):
    names, vecs, words, vectors = data
    forest = C.similarity_forest(words, vectors, 0.5, block_size=40).persist()
    edges = forest.collect()
    assert len(edges) < len(names) and len({frozenset((r.word_a, r.word_b)) for r in edges}) == len(edges)
    sizes = set()
    for threshold in (0.5, 0.35, 0.2, 0.1, 0.02):
        want = single_linkage(names, vecs, threshold)
        assert groups(C.cut_forest(words, forest, threshold).collect()) == want
        sizes.add(len(want))
    assert len(sizes) == 5 and max(map(len, single_linkage(names, vecs, .35))) > 10
    # the forest's cosines are those of the dendrogram: as heavy as any spanning forest
    sims, tree, best = cosines(vecs), {n: n for n in names}, []
    for s, i, j in sorted(((sims[i, j], i, j) for i in range(len(names)) for j in range(i)), reverse=True):
        a, b = names[i], names[j]
        while tree[a] != a:
            a = tree[a]
        while tree[b] != b:
            b = tree[b]
        if a != b and s >= .5:
            tree[a] = b
            best.append(s)
    assert np.allclose(sorted(r.cosine for r in edges), sorted(best))


def test_pairs_equal_brute_force_with_few_blocks_compared(spark, data):
    names, vecs, words, vectors = data
    sims, order = cosines(vecs), {w: k for k, w in enumerate(sorted(names))}
    want = {tuple(sorted((names[i], names[j]), key=order.get)) for i in range(len(names)) for j in range(i) if sims[i, j] >= .5}
    got = C.similar_word_pairs(words, vectors, 0.5, block_size=30).collect()
    assert len(got) == len(want) and {(r.word_a, r.word_b) for r in got} == want
    assert all(abs(r.cosine - sims[names.index(r.word_a), names.index(r.word_b)]) < 1e-9 for r in got[:200])


def test_pruning_leaves_few_block_pairs(spark):
    names, vecs = clustered(n_groups=60, size=20, dim=8, spread=.02, seed=6)
    words = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(names))], "word string, idx long")
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in zip(names, vecs)], "word string, vec array<double>")
    rep = C.block_pairs(words, vectors, 0.02, block_size=10)
    compared = rep.select("bi", "bj").distinct().count()
    blocks = -(-len(names) // 10)
    assert compared < blocks * (blocks + 1) / 2 / 10
    sims = cosines(vecs)
    want = sum(sims[i, j] >= .98 for i in range(len(names)) for j in range(i))
    assert C.similar_word_pairs(words, vectors, 0.02, block_size=10).count() == want > 1000


def test_spanning_forest_with_ties_and_repeats(spark):
    words = spark.createDataFrame([(c, k) for k, c in enumerate("abcdefgh")], "word string, idx long")
    edges = [("a", "b", .5), ("b", "c", .5), ("c", "a", .5), ("d", "c", .5), ("d", "a", .5), ("b", "a", .5), ("e", "f", .9),
             ("f", "g", .4), ("g", "e", .4), ("h", "h", 1.0)]
    got = C.spanning_forest(words, spark.createDataFrame(edges, "word_a string, word_b string, cosine double")).collect()
    assert len(got) == 5 and sorted(r.cosine for r in got) == [.4, .5, .5, .5, .9]
    assert {r.cluster_id for r in C.cut_forest(words, spark.createDataFrame(got), 0.55).collect()} == {0, 4, 6, 7}


def test_nothing_to_cluster(spark):
    words = spark.createDataFrame([], "word string, idx long")
    vectors = spark.createDataFrame([], "word string, vec array<double>")
    assert C.similarity_forest(words, vectors).count() == 0 and C.similar_word_pairs(words, vectors).count() == 0
    one = spark.createDataFrame([("x", 0)], "word string, idx long")
    lone = spark.createDataFrame([("x", [1.0, 0.0])], "word string, vec array<double>")
    forest = C.similarity_forest(one, lone)
    assert forest.count() == 0 and C.cut_forest(one, forest, .5).first()["cluster_id"] == 0


def test_words_move_once_for_each_of_few_blocks(spark):
    """In all directions nothing is pruned: a word moved up to 65 times."""
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(2500, 32))
    words = spark.createDataFrame([(f"w{k:04d}", k) for k in range(len(vecs))], "word string, idx long")
    vectors = spark.createDataFrame([(f"w{k:04d}", v.tolist()) for k, v in enumerate(vecs)], "word string, vec array<double>")
    assert C.block_pairs(words, vectors, 0.5).count() <= len(vecs) * (C.BLOCKS + 1)
    sims = cosines(vecs)
    want = {(f"w{i:04d}", f"w{j:04d}") for i, j in zip(*np.nonzero(np.triu(sims >= .5, 1)))}
    assert {(r.word_a, r.word_b) for r in C.similar_word_pairs(words, vectors, 0.5).collect()} == want and len(want) > 100
