"""Word clustering and cluster tf-idf.

Semantics (ours; the reference delegates to an external package): single
linkage agglomerative clustering of the top ``n_words`` vocabulary words,
cut at cosine distance ``distance_threshold`` = connected components of the
graph of word pairs with ``1 - cos <= threshold``.

C1 is an exact, distributed similarity join.  Words are dealt to blocks by
their nearest pivot (a bounded sample of the words) and the angle to it.  For
each block the least and greatest angle to every pivot are known; by the
triangle inequality on angles two blocks whose ranges lie further apart than
the threshold's angle hold no pair, and are never compared.  A word is
replicated to the block pairs that are left (an equi-join key, never a cross
join), and each is one ``applyInPandas`` group that multiplies two bounded
unit-vector blocks with numpy.

C2 is the dendrogram of single linkage, which is a minimum spanning forest of
the pairs.  A block pair gives the forest of its own pairs only (what a cycle
within a block closes is in no forest of the whole), so no row count is
quadratic; Boruvka rounds over those edges give the forest of all words, and
any threshold up to the fitted one is a cut of it, without a refit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.vectors import zeros
from lexmesh.operators.counts import by_key, write_bucketed
from lexmesh.operators.util import global_row_number, is_small, sent_if_small
from lexmesh.session import materialize

PAIR_SCHEMA = "word_a string, word_b string, cosine double"


def vocab_top_n_words(vocab: DataFrame, word_vectors: DataFrame, n_words: int = 40000,
                      col: str = "word") -> DataFrame:
    """The ``n_words`` most frequent vocabulary words that have a vector
    (N7), numbered 0.. in word order (``idx``).  The limit is the feature."""
    cand = vocab.join(word_vectors.select(F.col("word").alias(col)), col, "left_semi")
    top = cand.orderBy(F.desc("df"), F.asc(col)).limit(n_words).select(col)
    return global_row_number(top, [F.col(col)], name="idx")


def _cosines(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, bool]:
    """The two blocks of a pair in order of their words, and their cosines."""
    same = bool(pdf["bi"].iloc[0] == pdf["bj"].iloc[0])
    left = pdf[pdf["role"] == "L"].sort_values("idx")
    right = left if same else pdf[pdf["role"] == "R"].sort_values("idx")
    if left.empty or right.empty:
        return left, right, np.zeros((len(left), len(right))), same
    return left, right, np.vstack(left["unit"].to_numpy()) @ np.vstack(right["unit"].to_numpy()).T, same


def _block_pairs_fn(min_cos: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, sims, same = _cosines(pdf)
        keep = sims >= min_cos
        if same:
            keep &= np.tri(len(left), k=-1, dtype=bool).T
        r, c = np.nonzero(keep)
        one = left[["idx", "word"]].to_numpy()[r]
        two = right[["idx", "word"]].to_numpy()[c]
        swap = one[:, 0] > two[:, 0]
        return pd.DataFrame({"word_a": np.where(swap, two[:, 1], one[:, 1]),
                             "word_b": np.where(swap, one[:, 1], two[:, 1]), "cosine": sims[r, c].astype("float64")})
    return fn


def nearest_tree(sims: np.ndarray, min_cos: float, same: bool) -> list[tuple[int, int, float]]:
    """A maximum spanning forest of the pairs with a cosine of at least ``min_cos``:
    between the rows and columns of ``sims``, or among the rows if both are the
    ``same`` words.  Prim's method on the dense block; columns count on from the rows."""
    n_rows, n_cols = sims.shape
    n = n_rows if same else n_rows + n_cols
    best, via = np.full(n, -np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    out = []
    for _ in range(n):
        k = int(np.argmax(np.where(left, best, -np.inf)))
        if not left[k] or best[k] < min_cos:
            k = int(np.argmax(left))  # a tree of its own
        else:
            out.append((int(via[k]), k, float(best[k])))
        left[k] = False
        if same:
            near, at = sims[k], slice(0, n)
        elif k < n_rows:
            near, at = sims[k], slice(n_rows, n)
        else:
            near, at = sims[:, k - n_rows], slice(0, n_rows)
        closer = near > best[at]
        best[at] = np.where(closer, near, best[at])
        via[at] = np.where(closer, k, via[at])
    return out


def _block_forest_fn(min_cos: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, sims, same = _cosines(pdf)
        words = [*left["word"]] if same else [*left["word"], *right["word"]]
        edges = nearest_tree(sims, min_cos, same)
        return pd.DataFrame({"word_a": np.array([words[a] for a, _, _ in edges], object),
                             "word_b": np.array([words[b] for _, b, _ in edges], object),
                             "cosine": np.array([c for *_, c in edges], "float64")})
    return fn


#: Digits by which cluster weights of a document are ranked.
TIE_DIGITS = 9
#: Pivots that blocks are told apart by, and the most blocks whose pairs are looked at.
PIVOTS, MAX_BLOCKS = 64, 2048
#: Blocks that words are dealt to, and the words of one: without pruning, a word moves once for each block.
BLOCKS, BLOCK_WORDS = 24, (64, 2048)


def live_pairs(low: np.ndarray, high: np.ndarray, angle: float) -> list[tuple[int, int]]:
    """Pairs ``i <= j`` of blocks that may hold words within ``angle``, given each
    block's least and greatest angle to every pivot.  Rounding is allowed for."""
    out = []
    for i in range(len(low)):
        gap = np.maximum(low[i:] - high[i], low[i] - high[i:]).max(axis=1, initial=0.0)
        out += [(i, i + int(j)) for j in np.flatnonzero(gap <= angle + 1e-6)]
    return out


def block_pairs(words: DataFrame, word_vectors: DataFrame, distance_threshold: float, block_size: int | None = None,
                pivots: int = PIVOTS) -> DataFrame | None:
    """``(bi, bj, role, word, idx, unit)``: the words of every pair of blocks that the
    pivots can't rule out; None without words.  ``words`` has ``(word, idx)``."""
    from lexmesh.functions.vectors import unit
    wv = materialize(words.join(word_vectors, "word").select("word", "idx", unit("vec").alias("unit")), "units")
    n = wv.count()
    if not n:
        return None
    sample = wv.orderBy(F.xxhash64("word"), "word").limit(pivots).select("unit").collect()  # a bounded sample
    at = np.vstack([r["unit"] for r in sample])

    def angles(batches):
        for pdf in batches:
            found = np.arccos(np.clip(np.vstack(pdf["unit"].to_numpy()) @ at.T, -1.0, 1.0)) if len(pdf) else np.zeros((0, len(at)))
            yield pdf.assign(angles=list(found), pivot=found.argmin(axis=1) if len(pdf) else [],
                             nearest=found.min(axis=1) if len(pdf) else [])

    told = wv.mapInPandas(angles, "word string, idx long, unit array<double>, angles array<double>, pivot int, nearest double")
    ranked = global_row_number(told, [F.col("pivot"), F.col("nearest"), F.col("word")], "at")
    size = block_size or min(BLOCK_WORDS[1], max(BLOCK_WORDS[0], -(-n // BLOCKS)))
    size = max(size, -(-n // MAX_BLOCKS))
    blk = materialize(ranked.withColumn("block", F.floor(F.col("at") / size).cast("int")), "blocks")
    ends = blk.groupBy("block").agg(*(f(F.col("angles")[k]).alias(f"{name}{k}") for name, f in (("l", F.min), ("h", F.max))
                                      for k in range(len(at)))).orderBy("block").collect()  # MAX_BLOCKS rows at most
    low, high = (np.array([[r[f"{name}{k}"] for k in range(len(at))] for r in ends]) for name in "lh")
    # a word of norm 0 is at a right angle to all pivots and similar to nothing
    partners = {}
    for i, j in live_pairs(low, high, float(np.arccos(np.clip(1.0 - distance_threshold, -1.0, 1.0)))):
        partners.setdefault(i, []).append((i, j, "L"))
        if i != j:
            partners.setdefault(j, []).append((i, j, "R"))
    rows = [(b, i, j, role) for b, found in partners.items() for i, j, role in found]
    pairs = words.sparkSession.createDataFrame(rows, "block int, bi int, bj int, role string")
    return blk.select("word", "idx", "unit", "block").join(pairs, "block").drop("block")


def similar_word_pairs(words: DataFrame, word_vectors: DataFrame,
                       distance_threshold: float = 0.5, block_size: int | None = None) -> DataFrame:
    """Pairs ``(word_a, word_b)``, in order of ``idx``, with cosine distance <= threshold.

    ``words`` has ``(word, idx)`` (from :func:`vocab_top_n_words`)."""
    rep = block_pairs(words, word_vectors, distance_threshold, block_size)
    if rep is None:
        return words.sparkSession.createDataFrame([], PAIR_SCHEMA)
    return rep.groupBy("bi", "bj").applyInPandas(_block_pairs_fn(1.0 - distance_threshold), schema=PAIR_SCHEMA)


def similarity_forest(words: DataFrame, word_vectors: DataFrame, distance_threshold: float = 0.5,
                      block_size: int | None = None) -> DataFrame:
    """The dendrogram of single linkage up to ``distance_threshold`` (C2):
    ``(word_a, word_b, cosine)``, fewer rows than words.  Merging them in order of
    falling cosine is the clustering; :func:`cut_forest` stops at any threshold."""
    rep = block_pairs(words, word_vectors, distance_threshold, block_size)
    if rep is None:
        return words.sparkSession.createDataFrame([], PAIR_SCHEMA)
    edges = rep.groupBy("bi", "bj").applyInPandas(_block_forest_fn(1.0 - distance_threshold), schema=PAIR_SCHEMA)
    return spanning_forest(words, edges)


def spanning_forest(words: DataFrame, edges: DataFrame) -> DataFrame:
    """A maximum spanning forest of ``edges(word_a, word_b, cosine)`` by Boruvka rounds.

    In each round every tree takes its best edge to another tree (equal cosines
    by the words, so all agree on one order and no cycle can close), the trees at
    the two ends merge, and edges inside a tree go.  Trees at least halve, so the
    rounds grow with the log of the words; every round is written."""
    of = materialize(words.select("word", F.col("idx").alias("tree")), "trees")
    a, b = F.least("word_a", "word_b").alias("a"), F.greatest("word_a", "word_b").alias("b")
    left = materialize(edges.groupBy(a, b).agg(F.max("cosine").alias("cosine")).where("a <> b"), "edges")
    found = None
    while True:
        ends = left.join(of.select(F.col("word").alias("a"), F.col("tree").alias("ta")), "a") \
                   .join(of.select(F.col("word").alias("b"), F.col("tree").alias("tb")), "b").where("ta <> tb")
        ends = materialize(ends.select("a", "b", "cosine", "ta", "tb"), "edges")
        if ends.isEmpty():
            break
        order = F.struct((-F.col("cosine")).alias("d"), "a", "b")
        both = ends.select(F.col("ta").alias("tree"), F.col("tb").alias("other"), order.alias("edge")).unionByName(
            ends.select(F.col("tb").alias("tree"), F.col("ta").alias("other"), order.alias("edge")))
        best = materialize(both.groupBy("tree").agg(F.min(F.struct("edge", "other")).alias("m"))
                           .select("tree", "m.other", "m.edge"), "best")
        taken = best.select(F.col("edge.a").alias("word_a"), F.col("edge.b").alias("word_b"),
                            (-F.col("edge.d")).alias("cosine")).distinct()
        found = materialize(taken if found is None else found.unionByName(taken), "forest")
        of = materialize(_merged_trees(of, best), "trees")
        left = ends.select("a", "b", "cosine")
    return found if found is not None else words.sparkSession.createDataFrame([], PAIR_SCHEMA)


def _merged_trees(of: DataFrame, best: DataFrame) -> DataFrame:
    """``of(word, tree)`` after every tree has joined the one its best edge leads to.
    Two trees may take the same edge; the smaller one is then the root.  The
    others reach it by pointer jumping."""
    back = best.select(F.col("tree").alias("other"), F.col("other").alias("theirs"))
    to = best.join(back, "other", "left").select(
        "tree", F.when((F.col("theirs") == F.col("tree")) & (F.col("tree") < F.col("other")), F.col("tree"))
        .otherwise(F.col("other")).alias("root"))
    to = materialize(to, "roots")
    while True:
        up = to.select(F.col("tree").alias("root"), F.col("root").alias("above"))
        now = materialize(to.join(up, "root", "left").select("tree", F.coalesce("above", "root").alias("root"),
                                                             (F.coalesce("above", "root") != F.col("root")).alias("moved")), "roots")
        to = now.drop("moved")
        if now.where("moved").isEmpty():
            break
    return of.join(to, "tree", "left").select("word", F.coalesce("root", "tree").alias("tree"))


def cut_forest(words: DataFrame, forest: DataFrame, distance_threshold: float) -> DataFrame:
    """``(word, cluster_id)`` at a threshold up to the one the forest was built with."""
    return cluster_words(words, forest.where(F.col("cosine") >= 1.0 - distance_threshold))


def cluster_words(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Connected components of the similarity graph (C2).  ``cluster_id`` =
    smallest ``idx`` in the component.

    Each round takes the minimum label over the neighbours, then jumps
    pointers (a word takes the label of its label's word), so the number of
    rounds grows with the log of the component diameter.  Labels only
    decrease and stay inside the component, so the fixed point is the
    component minimum.  Every round is written to the shared folder
    (lineage cut, restartable); the loop ends only when no label changes."""
    edges = pairs.select(F.col("word_a").alias("src"), F.col("word_b").alias("dst")).unionByName(
        pairs.select(F.col("word_b").alias("src"), F.col("word_a").alias("dst")))
    edges = materialize(edges, "cluster-edges")
    idx_of = words.select(F.col("idx").alias("label"), F.col("word").alias("root"))
    labels = materialize(words.select("word", F.col("idx").alias("label")), "cluster-labels")
    while True:
        cand = (edges.join(labels.withColumnRenamed("word", "src"), "src")
                     .groupBy("dst").agg(F.min("label").alias("cand"))
                     .withColumnRenamed("dst", "word"))
        hop = (labels.join(cand, "word", "left")
                     .select("word", F.least("label", F.coalesce("cand", "label")).alias("label")))
        # pointer jumping: label <- label of the word that carries the label
        jump = (hop.join(idx_of, "label")
                   .join(hop.select(F.col("word").alias("root"), F.col("label").alias("l2")), "root")
                   .select("word", F.least("label", "l2").alias("label")))
        new = materialize(jump, "cluster-labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "word") \
                     .where(F.col("label") < F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    return labels.withColumnRenamed("label", "cluster_id")


def doc_clusters(tfidf: DataFrame, clusters: DataFrame, word_vectors: DataFrame,
                 n_top_clusters: int | None = 3, cluster_share: float | None = None,
                 id_col: str = "doc_id", col: str = "word") -> DataFrame:
    """Per document and cluster: weight = Σ tf-idf of the document's words
    in the cluster, vector = tf-idf-weighted mean of those words' vectors
    (C3); top ``n_top_clusters`` by weight (N6; ties, to ``TIE_DIGITS``, -> smaller cluster id);
    optional share filter (C5); weights renormalised to sum 1.

    Ranking needs only the scalar weight sums, so clusters are ranked and
    cut first and vectors are fetched for the survivors only (at most
    ``n_top_clusters`` per document).  The weighted mean is Spark ML's
    ``Summarizer`` (fixed-size partial aggregates), so a large cluster in a
    long document is never gathered into one row."""
    # joined once, written with one partitioning by document: the sums, the
    # ranks and the members of the kept clusters are read from it in place.  Weights
    # come by document, and stay so unless clusters are too large to be sent
    clusters = materialize(clusters.select(col, "cluster_id"), "clusters")
    sent = is_small(clusters)
    rows = tfidf.select(id_col, col, "weight").join(F.broadcast(clusters) if sent else clusters, col)
    rows = write_bucketed(rows if sent else by_key(rows, id_col), "cluster_rows", id_col)
    agg = rows.groupBy(id_col, "cluster_id").agg(F.sum("weight").alias("weight"))
    # sums of the same numbers in another order differ in their last digits, which must not rank
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round("weight", TIE_DIGITS)), F.asc("cluster_id"))
    ranked = agg.withColumn("rank", F.row_number().over(w))
    if n_top_clusters is not None:
        ranked = ranked.where(F.col("rank") <= n_top_clusters)
    if cluster_share is not None:
        ranked = ranked.withColumn(
            "_share", F.col("weight") / F.sum("weight").over(Window.partitionBy(id_col)))
        ranked = ranked.where((F.col("_share") >= cluster_share) | (F.col("rank") == 1)) \
                       .drop("_share")
    total = F.sum("weight").over(Window.partitionBy(id_col))
    kept = ranked.withColumn("weight", F.col("weight") / total)
    # vectors for the kept (document, cluster) pairs only; those of the clustered words, a
    # number that the fit limits, go to the documents instead of the rows to the words
    vectors = materialize(word_vectors.withColumnRenamed("word", col).join(clusters.select(col), col, "left_semi"),
                          "cluster-vectors")
    members = (rows.join(kept.select(id_col, "cluster_id"), [id_col, "cluster_id"], "left_semi")
                   .join(sent_if_small(vectors), col))
    vecs = members.groupBy(id_col, "cluster_id").agg(
        Summarizer.mean(array_to_vector("vec"), F.col("weight")).alias("_m"))
    vecs = vecs.select(id_col, "cluster_id", vector_to_array("_m").alias("vec"))
    return kept.join(vecs, [id_col, "cluster_id"])


def doc_vectors_clusters(doc_clusters_df: DataFrame, id_col: str = "doc_id",
                         docs: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Aggregated form (C4): Σ weight × cluster vector per document (the
    weights sum to 1, so this is the weighted mean).  With ``docs`` and
    ``dim`` given, documents without a cluster get a zero vector."""
    agg = doc_clusters_df.groupBy(id_col).agg(
        Summarizer.mean(array_to_vector("vec"), F.col("weight")).alias("_m"))
    vecs = agg.select(id_col, vector_to_array("_m").alias("vec"))
    if docs is not None:
        if dim is None:
            raise ValueError("dim is required to give documents without a cluster a zero vector")
        vecs = docs.select(id_col).join(vecs, id_col, "left").withColumn("vec", F.coalesce("vec", zeros(dim)))
    return vecs
