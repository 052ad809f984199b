"""Latent semantic scaling: polarity of words, vectors and documents
(R1, R2, A9-A12, A17, F6, M14, X1).

R1 (axis rewrite): pol(v) = (1/|L|) Σ_s p_s cos(v_s, v) = û · a with
a = (1/|L|) Σ_s p_s û_s.  The seeds collapse to one dim-sized axis, fitted
like a Spark ML model parameter, so there is no words x seeds join at all.
A zero-norm seed adds 0 to ``a`` but counts in |L|; a zero-norm word scores 0.

R2: document scores are averages of linear functions of the word scores,
so words are scored once per *vocabulary* word and tokens join a scalar.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import WHITESPACE_SPLIT
from lexmesh.functions.vectors import dot_literal, norm, unit
from lexmesh.operators.util import sent_if_small
from lexmesh.session import materialize


#: Bytes of word scores that are sent to every executor; words with a vector, one number each.
SCORE_BYTES = 96 << 20


@dataclass
class PolarityAxis:
    axis: list
    n_seeds: int

    @property
    def dim(self) -> int:
        return len(self.axis)

    def score(self, vec) -> Column:
        """Polarity of a vector column (A10): ``(v · a) / ||v||``, 0 for a
        zero vector (same value as ``unit(v) · a`` without building the
        normalised copy of every vector)."""
        c = F.col(vec) if isinstance(vec, str) else vec
        n = norm(c)
        return F.when(n == 0, F.lit(0.0)).otherwise(dot_literal(c, self.axis) / n)


def fit_polarity_axis(seeds: DataFrame, weight_col: str = "weight", vec_col: str = "vec",
                      missing: str = "zero") -> PolarityAxis:
    """Fit the axis from seed rows ``(weight, vec)`` (vec may be null when
    the seed has no vector).  ``missing="zero"`` keeps such seeds in |L|
    (zero vector), ``"drop"`` removes them.  Returns dim-sized driver state."""
    if missing == "drop":
        seeds = seeds.where(F.col(vec_col).isNotNull())
    n_seeds = seeds.count()
    rows = (seeds.where(F.col(vec_col).isNotNull())
                 .select(F.col(weight_col).cast("double").alias("w"),
                         F.posexplode(unit(vec_col)).alias("pos", "x"))
                 .groupBy("pos").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
                 .collect())
    if not rows:
        raise ValueError("no seed has a vector")
    dim = max(r["pos"] for r in rows) + 1
    axis = [0.0] * dim
    for r in rows:
        axis[r["pos"]] = r["s"] / n_seeds
    return PolarityAxis(axis=axis, n_seeds=n_seeds)


def word_scores(word_vectors: DataFrame, axis: PolarityAxis) -> DataFrame:
    """``(word, polarity)`` for every word that has a vector (A9 unscaled)."""
    return word_vectors.select("word", axis.score("vec").alias("polarity"))


def word_polarity(words: DataFrame, word_vectors: DataFrame, axis: PolarityAxis,
                  col: str = "word") -> DataFrame:
    """Polarity of requested words (A9); a word without a vector scores 0
    (zero vector, as after vocabulary filtering)."""
    scores = word_scores(word_vectors, axis).withColumnRenamed("word", col)
    return (words.join(scores, col, "left")
                 .withColumn("polarity", F.coalesce(F.col("polarity"), F.lit(0.0))))


def vector_polarity(vectors: DataFrame, axis: PolarityAxis, vec_col: str = "vec") -> DataFrame:
    """Polarity of given vectors (A10)."""
    return vectors.withColumn("polarity", axis.score(vec_col))


def doc_polarity_allwords(docs: DataFrame, word_vectors: DataFrame, axis: PolarityAxis,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mean polarity of a document's whitespace tokens that have a vector,
    duplicates counted; no such token -> null (A11).

    One pass: tokens are exploded in place (``explode_outer`` keeps empty
    documents) and counted per (document, word), so a word costs the join
    to its scalar one row per document; a weighted mean per document ends
    it.  The scores are written and sent to the documents (bounded bytes, else
    counts move to their words): Spark itself goes by the files of the vectors
    that the scores come from, and would move every count twice."""
    tokens = F.filter(F.split(F.col(text_col), WHITESPACE_SPLIT), lambda t: t != "")
    toks = docs.select(F.col(id_col), F.explode_outer(tokens).alias("word"))
    counted = toks.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum(F.when(F.col("polarity").isNotNull(), F.col("n")))
    scores = sent_if_small(materialize(word_scores(word_vectors, axis), "scores"), SCORE_BYTES)
    return (counted.join(scores, "word", "left")
                   .groupBy(id_col).agg((F.sum(F.col("polarity") * F.col("n")) / n).alias("polarity")))


def doc_polarity_vectors(doc_vectors: DataFrame, axis: PolarityAxis,
                         id_col: str = "doc_id", vec_col: str = "vec") -> DataFrame:
    """tf-idf path without clusters: polarity of the tf-idf-weighted
    document vector (A5 · axis); a document without a vector -> null."""
    return doc_vectors.select(id_col, axis.score(vec_col).alias("polarity"))


def doc_polarity_clusters(doc_clusters: DataFrame, axis: PolarityAxis,
                          id_col: str = "doc_id") -> DataFrame:
    """Σ cluster_weight × polarity(cluster_vector) per document."""
    return (doc_clusters.withColumn("p", F.col("weight") * axis.score("vec"))
                        .groupBy(id_col).agg(F.sum("p").alias("polarity")))


@dataclass
class Scaler:
    kind: str
    center: float
    scale: float

    def apply(self, col) -> Column:
        """(x - center) / scale; a zero scale counts as 1."""
        c = F.col(col) if isinstance(col, str) else col
        s = self.scale if self.scale not in (0, 0.0, None) else 1.0
        return (c - F.lit(self.center)) / F.lit(s)

    def as_frame(self, spark):
        return spark.createDataFrame([(self.kind, float(self.center), float(self.scale))],
                                     "kind string, center double, scale double")


def fit_scaler(scores: DataFrame, col: str = "polarity", kind="standard") -> Scaler:
    """Fit a scaler on non-null scores (A17).  ``standard``: mean and
    population std; ``minmax``: min and max - min; a callable ``kind``
    receives the scores DataFrame and returns (center, scale) Columns (X1)."""
    s = scores.where(F.col(col).isNotNull())
    if callable(kind):
        center, scale = kind(s)
        row = s.agg(center.alias("c"), scale.alias("s")).first()
        return Scaler("custom", row["c"], row["s"])
    if kind == "standard":
        row = s.agg(F.avg(col).alias("c"), F.stddev_pop(col).alias("s")).first()
    elif kind == "minmax":
        row = s.agg(F.min(col).alias("c"), (F.max(col) - F.min(col)).alias("s")).first()
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return Scaler(kind, row["c"], row["s"])


def scale_scores(scores: DataFrame, scaler: Scaler | None, col: str = "polarity") -> DataFrame:
    """Apply a fitted scaler; identity when scaling is off."""
    if scaler is None:
        return scores
    return scores.withColumn(col, scaler.apply(col))


@dataclass
class ScalingModel:
    axis: PolarityAxis
    scaler: Scaler | None
    word_vectors: DataFrame
    method: str
    extras: dict = field(default_factory=dict)

    def predict_words(self, words: DataFrame, col: str = "word") -> DataFrame:
        return scale_scores(word_polarity(words, self.word_vectors, self.axis, col), self.scaler)

    def predict_vectors(self, vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
        return scale_scores(vector_polarity(vectors, self.axis, vec_col), self.scaler)

    def predict_docs_unscaled(self, docs: DataFrame, id_col: str = "doc_id",
                              text_col: str = "text") -> DataFrame:
        if self.method == "allwords":
            return doc_polarity_allwords(docs, self.word_vectors, self.axis, id_col, text_col)
        scorer = self.extras.get("doc_scorer")
        if scorer is None:
            raise ValueError(f"method {self.method!r} needs a fitted document scorer")
        return scorer(docs, self.axis)

    def predict_docs(self, docs: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
        return scale_scores(self.predict_docs_unscaled(docs, id_col, text_col), self.scaler)

    def save(self, path: str) -> None:
        """Axis, scaler, vectors and the fitted processor, as tables."""
        from lexmesh.sources.store import save_tables
        tables = {"vectors": self.word_vectors}
        params = {"kind": "scaling", "axis": self.axis.axis, "n_seeds": self.axis.n_seeds, "method": self.method,
                  "scaler": [self.scaler.kind, self.scaler.center, self.scaler.scale] if self.scaler else None}
        processor = self.extras.get("processor")
        if processor is not None:
            tables |= processor.tables()
            params["processor"] = processor.params()
        elif self.method != "allwords":
            raise ValueError("a model with a scorer of its own can't be saved; fit it with a processor")
        save_tables(self.word_vectors.sparkSession, path, tables, params | {"tables": sorted(tables)})


def load_scaling(spark, path: str) -> "ScalingModel":
    """The model that :meth:`ScalingModel.save` wrote, ready to score documents."""
    import json
    from lexmesh.operators.processor import load_processor
    from lexmesh.sources.store import load_tables
    params = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
    if params.get("kind") != "scaling":
        raise ValueError(f"no saved scaling model at {path}")
    tables, params = load_tables(spark, path, params["tables"])
    extras = {}
    if "processor" in params:
        extras["processor"] = load_processor(spark, tables, params["processor"])
        extras["doc_scorer"] = extras["processor"].polarity
    scaler = Scaler(*params["scaler"]) if params["scaler"] else None
    return ScalingModel(PolarityAxis(params["axis"], params["n_seeds"]), scaler, tables["vectors"],
                        params["method"], extras)


class LatentSemanticScaling:
    """Estimator (M14): ``fit(polarity_lexicon, docs)`` embeds the seeds,
    scores the training corpus unscaled and fits the scaler on it.  An
    unfitted estimator has no ``predict_*`` (P11)."""

    def __init__(self, word_vectors: DataFrame, method: str = "allwords",
                 scaler: str | Callable | None = "standard",
                 doc_scorer: Callable[[DataFrame, PolarityAxis], DataFrame] | None = None,
                 processor=None):
        """``processor``: a fitted ``DocumentProcessor``; its method (top words
        or clusters) then scores the documents.  ``doc_scorer``: any scorer."""
        self.word_vectors = word_vectors
        self.method = processor.settings["method"] if processor is not None else method
        self.scaler = scaler
        self.doc_scorer = processor.polarity if processor is not None else doc_scorer
        self.processor = processor

    def fit(self, polarity_lexicon: DataFrame, docs: DataFrame, id_col: str = "doc_id",
            text_col: str = "text") -> ScalingModel:
        from lexmesh.operators.lexicon import dedupe_last_weight
        from lexmesh.operators.vectors import embed_lexicon
        seeds = embed_lexicon(dedupe_last_weight(polarity_lexicon), self.word_vectors)
        axis = fit_polarity_axis(seeds)
        model = ScalingModel(axis=axis, scaler=None, word_vectors=self.word_vectors,
                             method=self.method,
                             extras={"doc_scorer": self.doc_scorer, "processor": self.processor})
        # the training scores are written once: the scaler is fitted on them
        # and fit_transform returns them scaled without a second corpus pass
        scores = materialize(model.predict_docs_unscaled(docs, id_col, text_col))
        model.extras["training_scores"] = scores
        if self.scaler is not None:
            model.scaler = fit_scaler(scores, kind=self.scaler)
        return model

    def fit_transform(self, polarity_lexicon: DataFrame, docs: DataFrame,
                      id_col: str = "doc_id", text_col: str = "text"):
        model = self.fit(polarity_lexicon, docs, id_col, text_col)
        return model, scale_scores(model.extras["training_scores"], model.scaler)
