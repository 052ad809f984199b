"""Imports every query module so that the registry is complete."""

from lexmesh.plans import q_clusters, q_io, q_lexicon, q_models, q_scaling, q_tfidf  # noqa: F401

LOADED = True
