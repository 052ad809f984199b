"""The lexicon classifier: one estimator over training rows, augmentation,
tuning, ensembles and document vectors (M4-M13, S13).

``LexiconClassifier.fit`` learns from lexica (main and support categories) and
word vectors; with ``hp_tuning`` it searches parameters by cross-validation and
refits the ``n_best_params`` sets of each category, whose probabilities are
averaged.  The result is a ``ClassifierModel`` with ``predict_vectors_proba``,
``predict_words``, ``predict_docs`` and their ``_proba`` forms.  Only a fitted
model has them.  ``save`` writes everything that scoring needs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.operators import augment as AU
from lexmesh.operators import ensemble as EN
from lexmesh.operators import tuning as TU
from lexmesh.operators.lexicon import threshold_predictions, wide_predictions
from lexmesh.operators.processor import DocumentProcessor, load_processor
from lexmesh.operators.vectors import lookup_vectors
from lexmesh.session import materialize
from lexmesh.sources.store import load_tables, save_tables


@dataclass
class ClassifierModel:
    members: DataFrame
    main_keys: list[str]
    processor: DocumentProcessor | None
    word_vectors: DataFrame
    dim: int
    cutoff: float = 0.5
    test_rows: DataFrame | None = None
    tuning: DataFrame | None = None

    def predict_vectors_proba(self, vectors: DataFrame, id_cols: Sequence[str] = ("id",)) -> DataFrame:
        """``(*ids, category, proba)`` of given vectors (M7)."""
        return EN.predict_proba(vectors, self.members, id_cols=id_cols)

    def predict_words_proba(self, words: DataFrame) -> DataFrame:
        """``(word, category, proba)``; a word without a vector has a zero one (M8)."""
        vecs = lookup_vectors(words, self.word_vectors, dim=self.dim, missing="zero")
        return self.predict_vectors_proba(vecs, ("word",))

    def predict_words(self, words: DataFrame) -> DataFrame:
        return self._flags(self.predict_words_proba(words), "word")

    def predict_docs_proba(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, category, proba)``, all categories for each document (M9)."""
        if self.processor is None:
            raise ValueError("the classifier was fitted without a document processor")
        return self.predict_vectors_proba(self.processor.vectors(docs), ("doc_id",))

    def predict_docs(self, docs: DataFrame) -> DataFrame:
        return self._flags(self.predict_docs_proba(docs), "doc_id")

    def _flags(self, proba: DataFrame, id_col: str) -> DataFrame:
        return wide_predictions(threshold_predictions(proba, self.cutoff), self.main_keys, id_col=id_col)

    def test_scores(self) -> DataFrame:
        """``(category, score)``: F1 on the rows that the fit left out."""
        if self.test_rows is None:
            raise ValueError("fitted without a test share")
        rows = self.test_rows.select(F.col("row_id").alias("id"), F.col("category").alias("own"), "inside", "vec")
        proba = EN.predict_proba(rows, self.members, id_cols=("id", "own", "inside")).where("category = own")
        return TU.f1_score(proba.withColumn("prediction", F.col("proba") > self.cutoff), "inside", "prediction",
                           ("category",))

    def save(self, path: str) -> None:
        """Members, vectors, vocabulary, clusters and settings as tables."""
        tables = {"members": self.members, "vectors": self.word_vectors}
        params = {"kind": "classifier", "main_keys": self.main_keys, "dim": self.dim, "cutoff": self.cutoff}
        if self.processor is not None:
            tables |= self.processor.tables()
            params["processor"] = self.processor.params()
        save_tables(self.members.sparkSession, path, tables, params | {"tables": sorted(tables)})


def load_classifier(spark: SparkSession, path: str) -> ClassifierModel:
    params = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
    if params.get("kind") != "classifier":
        raise ValueError(f"no saved classifier at {path}")
    tables, params = load_tables(spark, path, params["tables"])
    processor = load_processor(spark, tables, params["processor"]) if "processor" in params else None
    return ClassifierModel(tables["members"], params["main_keys"], processor, tables["vectors"], params["dim"],
                           params["cutoff"])


class LexiconClassifier:
    """Unfitted; ``fit`` gives the model."""

    def __init__(self, word_vectors: DataFrame, processor: DocumentProcessor | None = None, n_models: int = 10,
                 multiplier: int = 5, multiplier_outside: int = 5, cutoff: float = 0.5,
                 test_size: float | None = None, seed: int = 0):
        self.word_vectors, self.processor = word_vectors.select("word", "vec"), processor
        self.n_models, self.multiplier, self.multiplier_outside = n_models, multiplier, multiplier_outside
        self.cutoff, self.test_size, self.seed = cutoff, test_size, seed

    def fit(self, lexicon: DataFrame, support: DataFrame | None = None, main_keys: Sequence[str] = (),
            support_keys: Sequence[str] = (), hp_tuning: bool = False, param_grid: Sequence[dict] = (),
            fixed_params: dict | None = None, n_best_params: int = 3, n_iter: int = 150, cv: int = 5
            ) -> ClassifierModel:
        """Without tuning, every category is fitted with ``fixed_params``; with it,
        with its ``n_best_params`` best sets of ``param_grid``."""
        embedded = AU.embedded_lexicon(lexicon, self.word_vectors, support)
        rows = materialize(AU.train_test_split(AU.training_rows(embedded, main_keys, support_keys),
                                               self.test_size, self.seed), "training")
        train = rows.where("NOT is_test").drop("is_test")
        ranked, params = None, {0: dict(fixed_params or {})}
        fit_rows = train.withColumn("param_id", F.lit(0))
        if hp_tuning:
            grid = [{**{k: [v] for k, v in (fixed_params or {}).items()}, **g} for g in param_grid]
            _, ranked, best, params = TU.tune_params(
                train, grid, n_iter, cv, n_best_params, self.n_models, self.multiplier, self.multiplier_outside,
                self.seed)
            ranked = materialize(ranked, "ranked")
            best = TU.best_params(ranked, n_best_params, ("category",))
            fit_rows = train.join(best.select("category", "param_id"), "category")
        sets = AU.ensemble_training_set(fit_rows, self.n_models, self.multiplier, self.multiplier_outside,
                                        seed=self.seed, group_cols=("param_id",), spans=True)
        members = AU.member_rows(sets, self.n_models)
        n_of = F.create_map(*[F.lit(x) for pid, p in params.items()
                              for x in (int(pid), int(p.get("n_models", self.n_models)))])
        members = members.where(F.col("model_ix") < n_of[F.col("param_id")])
        fitted = materialize(EN.fit_ensemble(members, params, self.seed, fit_rows, self.n_models), "members")
        dim = self.word_vectors.agg(F.max(F.size("vec"))).first()[0]
        test = rows.where("is_test").drop("is_test") if self.test_size else None
        return ClassifierModel(fitted, [str(k) for k in main_keys], self.processor, self.word_vectors, dim,
                               self.cutoff, test, ranked)
