"""Training rows, hash splits and augmentation.

All categories are handled in one table (R5): there is no per-category
loop.  Every random choice is a hash draw (:mod:`lexmesh.functions.hashing`)
of the sample's coordinates, so a recomputed or retried task draws the
same values and the oracle can replay them.  Sizes are lexicon-sized times
the augmentation multipliers, independent of the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.functions.hashing import hash_slices, hash_u
from lexmesh.functions.text import strip_wildcards
from lexmesh.operators.draws import DRAWS_PER_NUMBER, POOL_INSIDE, POOL_OUTSIDE, WEIGHT_LEVELS, vector_rows
from lexmesh.operators.lexicon import merge_lexica
from lexmesh.operators.parts import is_large, vectors_by_parts
from lexmesh.operators.util import apart, global_row_number
from lexmesh.operators.vectors import embed_lexicon

SPAN = 1 << 14          # rows that are numbered together
PART_ROWS = 1 << 17     # rows of a member whose vectors are made together


def embedded_lexicon(main: DataFrame, word_vectors: DataFrame,
                     support: DataFrame | None = None) -> DataFrame:
    """Main ∪ support lexicon with stripped wildcards (P1 before J1, Q7),
    embedded; rows without a vector are dropped (Q8).  ``row_id`` numbers
    the rows by (category, pos)."""
    full = merge_lexica([main, support]) if support is not None else main
    full = full.withColumn("term", strip_wildcards("term"))
    emb = embed_lexicon(full, word_vectors).where(F.col("vec").isNotNull())
    return global_row_number(emb, [F.col("category"), F.col("pos"), F.col("term")], "row_id")


def training_rows(embedded: DataFrame, main_keys: Sequence[str],
                  support_keys: Sequence[str] = ()) -> DataFrame:
    """X/y for every main category in one table (J5):
    ``(category, row_id, term, inside, src_category, vec)``.

    Inside rows: the category's own terms.  Outside rows: rows of the other
    main/support categories (J4), minus terms that are also inside (anti
    join).  Each row fans out to the main categories it is an outside row
    for with ``explode`` over the (small) key list, not with a join."""
    mains = [str(k) for k in main_keys]
    roles = mains + [str(k) for k in support_keys if k not in mains]
    rel = embedded.where(F.col("category").isin(roles))
    inside = rel.where(F.col("category").isin(mains)).select(
        "category", "row_id", "term", F.lit(True).alias("inside"),
        F.lit(None).cast("string").alias("src_category"), "vec")
    others = F.filter(F.array(*[F.lit(k) for k in mains]), lambda k: k != F.col("category"))
    outside = rel.select(F.explode(others).alias("target"), "row_id", "term",
                         F.col("category").alias("src_category"), "vec")
    outside = outside.join(inside.select(F.col("category").alias("target"), "term"),
                           ["target", "term"], "left_anti")
    outside = outside.select(F.col("target").alias("category"), "row_id", "term",
                             F.lit(False).alias("inside"), "src_category", "vec")
    return inside.unionByName(outside)


def outside_terms(training: DataFrame) -> DataFrame:
    """Terms of the other categories for each main category."""
    return training.where(~F.col("inside")).select("category", "term", "src_category")


def train_test_split(training: DataFrame, test_size: float | None = 0.2,
                     seed: int = 0) -> DataFrame:
    """Adds ``is_test`` by a hash of (seed, category, row_id) (M10); a
    deterministic, per-category split.  ``None`` -> everything is train."""
    if not test_size:
        return training.withColumn("is_test", F.lit(False))
    u = hash_u(F.lit(seed), "category", "row_id", F.lit("split"))
    return training.withColumn("is_test", (u % 1000000) < F.lit(int(round(test_size * 1000000))))


# --- augmentation ------------------------------------------------------------------

def draw_weights(n_draw: int, seed: int) -> F.Column:
    """``n_draw`` integer weights 0..10 that are not all 0, from hash draws.

    A weight vector is the digits of a number to the base 11.  The last
    number is drawn from 1 on unless an earlier one is above 0 already, so
    the vector is never all zero, without redrawing."""
    digits, before = [], F.lit(False)
    for k in range(0, n_draw, DRAWS_PER_NUMBER):
        here = min(DRAWS_PER_NUMBER, n_draw - k)
        span = WEIGHT_LEVELS ** here
        u = hash_u(F.lit(seed), "sample_key", F.lit("w"), F.lit(k))
        code = u % span
        if k + here == n_draw:
            code = F.when(before, code).otherwise(u % (span - 1) + 1)
        before = before | (code > 0)
        digits += [F.floor(code / WEIGHT_LEVELS ** i).cast("bigint") % WEIGHT_LEVELS for i in range(here)]
    return F.array(*digits)


def augment_samples(requests: DataFrame, n_draw: int = 3, seed: int = 0) -> DataFrame:
    """Draws of convex combinations (M1).  ``requests`` has one row per synthetic
    sample with ``sample_key`` (unique string) and ``n_pool``, the rows of its
    pool; each sample draws ``n_draw`` pool rows with replacement (place = u %
    n_pool) and integer weights 0..10 (:func:`draw_weights`).  Output: the
    request columns plus ``draws``, which hold ``place * 11 + weight``."""
    # one md5 gives the places of four draws of the sample
    ix = hash_slices(min(n_draw, 4), F.lit(seed), "sample_key", F.lit("ix"))
    for k in range(4, n_draw, 4):
        ix += hash_slices(min(n_draw - k, 4), F.lit(seed), "sample_key", F.lit("ix"), F.lit(k))
    w = draw_weights(n_draw, seed)
    draws = F.array(*[ix[i] % F.col("n_pool") * WEIGHT_LEVELS + w[i] for i in range(n_draw)])
    return requests.withColumn("draws", draws)


def _spans(counts: DataFrame, n: Column) -> DataFrame:
    """``n`` rows for each row of ``counts``, ``SPAN`` at a time: from ``_from`` on, of ``_n`` in all."""
    return counts.withColumn("_n", n.cast("bigint")).where("_n > 0") \
                 .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(SPAN).cast("bigint"))))


def _numbered(counts: DataFrame, n: Column, keys: Sequence[str]) -> DataFrame:
    """``n`` rows, numbered by ``sample_id``, for each row of ``counts``.  They are made
    ``SPAN`` at a time by all tasks, however few rows ``counts`` has."""
    spans = _spans(counts, n)
    n_parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = spans.repartition(n_parts, *keys, "_from")
    last = F.least(F.col("_from") + SPAN, F.col("_n")) - 1
    return spans.withColumn("sample_id", F.explode(F.sequence(F.col("_from"), last))).drop("_n", "_from")


def _pool_counts(training: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, n_in, n_out, n_by_src)``: the training rows that samples are drawn from."""
    by_src = training.groupBy(*keys, "src_category").agg(
        F.sum(F.col("inside").cast("int")).alias("n_in"), F.sum((~F.col("inside")).cast("int")).alias("n_out"))
    return by_src.groupBy(*keys).agg(
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"),
        # rows of each outside source category, in order of their names
        F.transform(F.array_sort(F.collect_list(F.when(F.col("n_out") > 0, F.struct("src_category", "n_out")))),
                    lambda s: s["n_out"]).alias("n_by_src"))


def _ensemble_spans(training: DataFrame, n_models: int, multiplier: int, multiplier_outside: int, n_draw: int,
                    seed: int, group_cols: Sequence[str]) -> DataFrame:
    """The rows of :func:`ensemble_training_set` as spans of numbers that are drawn where
    they are used (:func:`lexmesh.operators.draws.span_draws`)."""
    keys = [*group_cols, "category"]
    counts = _pool_counts(training, keys)
    n_in = F.col("n_in")
    shared = counts.withColumn("model_ix", F.lit(-1))
    members = counts.where((F.col("n_out") > 0) & (n_in > 0)).withColumn(
        "model_ix", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))))

    def rows(df, n, inside: bool, kind: str, name: str):
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "model_ix")], F.lit(name))
        return _spans(df, n).select(
            *keys, F.col("model_ix").cast("int").alias("model_ix"), F.lit(inside).alias("inside"), F.lit(kind).alias("kind"),
            F.col("_from").alias("sample_id"), F.least(F.col("_n") - F.col("_from"), F.lit(SPAN)).cast("int").alias("n"),
            key.alias("key"), n_in.cast("bigint").alias("n_in"), F.col("n_out").cast("bigint").alias("n_out"),
            F.transform("n_by_src", lambda x: x.cast("bigint")).alias("n_by_src"),
            F.lit(n_draw).alias("n_draw"), F.lit(str(seed)).alias("seed"))

    return rows(shared, n_in * multiplier, True, "sample", "in") \
        .unionByName(rows(members, n_in * multiplier * multiplier_outside, False, "sample", "out")) \
        .unionByName(rows(shared, n_in, True, "original", "")) \
        .unionByName(rows(members, n_in, False, "original", "orig"))


def _ensemble_draws(training: DataFrame, n_models: int, multiplier: int, multiplier_outside: int, n_draw: int,
                    seed: int, group_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`ensemble_training_set` as draws, and ``(*group_cols, category,
    parts_in, parts_out)``, the parts in which a member's vectors are made."""
    keys = [*group_cols, "category"]
    counts = _pool_counts(training, keys)
    n_in, n_out_samples = F.col("n_in"), F.col("n_in") * multiplier * multiplier_outside
    counts = counts.withColumns({
        "parts_in": F.ceil(n_in * (multiplier + 1) / PART_ROWS).cast("int"),
        "parts_out": F.ceil((n_out_samples + n_in) / PART_ROWS).cast("int")})

    def key(*extra):
        return F.concat_ws("|", *[F.col(c).cast("string") for c in keys], *extra)

    def rows(df, inside: bool, kind: str):
        return df.select(*keys, F.col("model_ix").cast("int").alias("model_ix"), F.lit(inside).alias("inside"),
                         F.lit(kind).alias("kind"), "sample_id", F.col("pool").cast("int").alias("pool"),
                         F.pmod("sample_id", F.col("parts_in" if inside else "parts_out")).cast("int").alias("part"),
                         "draws")

    def original(place):
        return F.array(place * WEIGHT_LEVELS + 1, *[F.lit(0).cast("bigint")] * (n_draw - 1))

    shared = counts.withColumn("model_ix", F.lit(-1))
    members = counts.where((F.col("n_out") > 0) & (n_in > 0)).withColumn(
        "model_ix", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))))
    # inside samples (model_ix = -1: shared) and all inside rows
    in_req = _numbered(shared, n_in * multiplier, keys).withColumns({
        "sample_key": key(F.lit("-1"), F.lit("in"), F.col("sample_id").cast("string")),
        "n_pool": n_in, "pool": F.lit(POOL_INSIDE)})
    orig_in = _numbered(shared, n_in, keys).withColumns({"pool": F.lit(POOL_INSIDE), "draws": original(F.col("sample_id"))})
    # outside samples: per member, one chosen source category each
    ix = F.col("model_ix").cast("string")
    out_req = _numbered(members, n_out_samples, [*keys, "model_ix"]).withColumn(
        "sample_key", key(ix, F.lit("out"), F.col("sample_id").cast("string")))
    out_req = out_req.withColumn("pool", (hash_u(F.lit(seed), "sample_key", F.lit("cat")) % F.size("n_by_src")).cast("int"))
    out_req = out_req.withColumn("n_pool", F.col("n_by_src")[F.col("pool")])
    # ... and n_in outside rows per member, drawn with replacement
    orig_out = _numbered(members, n_in, [*keys, "model_ix"]).withColumns({
        "pool": F.lit(POOL_OUTSIDE), "draws": original(hash_u(
            F.lit(seed), key(ix, F.lit("orig"), F.col("sample_id").cast("string"))) % F.col("n_out"))})
    out = rows(augment_samples(in_req, n_draw, seed), True, "sample") \
        .unionByName(rows(augment_samples(out_req, n_draw, seed), False, "sample")) \
        .unionByName(rows(orig_in, True, "original")).unionByName(rows(orig_out, False, "original"))
    return out, counts.select(*keys, "parts_in", "parts_out")


def ensemble_training_set(training: DataFrame, n_models: int = 10, multiplier: int = 5,
                          multiplier_outside: int = 5, n_draw: int = 3, seed: int = 0,
                          group_cols: Sequence[str] = (), vectors: bool = True, spans: bool = False) -> DataFrame:
    """Rows for every ensemble member (M2, M3, U3):
    ``(*group_cols, category, model_ix, inside, kind, sample_id, vec)``.

    Inside (shared by members): n₁·m convex samples of the category's own
    rows + all originals.  Outside (per member): n₁·m·m_out samples, each
    from ONE hash-chosen non-empty other category (Q24), + n₁ originals
    drawn with replacement from all outside rows.  ``group_cols`` (e.g.
    ``param_id, fold``) are carried through as further group keys.

    With ``vectors=False`` rows have ``pool, draws`` instead of ``vec``: what they
    draw from ``training``, some 60 bytes whatever the dimension, from which
    :class:`~lexmesh.operators.draws.Drawn` makes the vectors (an inside original's
    ``sample_id`` is then its place in its pool).  No form joins vectors:
    a category's rows meet the draws of one member, or, where a class has more than
    ``parts.GROUP_ROWS``, are read by the tasks that make parts of a member's vectors
    (:mod:`lexmesh.operators.parts`).

    With ``spans=True`` a row stands for ``n`` of those rows, from ``sample_id`` on, and
    holds what their draws are hashed from; the same draws are then made in the task
    that uses them, so what moves is one row for each ``SPAN``."""
    if spans:
        return _ensemble_spans(training, n_models, multiplier, multiplier_outside, n_draw, seed, group_cols)
    if vectors and is_large(training, [*group_cols, "category"]):
        return vectors_by_parts(_ensemble_spans(training, n_models, multiplier, multiplier_outside, n_draw, seed, group_cols),
                                training, [*group_cols, "category"])
    drawn, parts = _ensemble_draws(training, n_models, multiplier, multiplier_outside, n_draw, seed, group_cols)
    if not vectors:
        return drawn.drop("part")
    keys = [*group_cols, "category"]
    pools = training.select(*keys, "row_id", "inside", "src_category", "vec").join(parts, keys)
    ix = F.when(F.col("inside"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(n_models - 1)))
    pools = pools.withColumn("model_ix", F.explode(ix)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("parts_in")).otherwise(F.col("parts_out")) - 1)))
    by = [*keys, "model_ix", "part"]
    out = T.StructType([*(f for f in drawn.schema.fields if f.name not in ("pool", "part", "draws")),
                        T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return drawn.groupBy(*by).cogroup(apart(pools.drop("parts_in", "parts_out")).groupBy(*by)).applyInArrow(
        vector_rows([f.name for f in out.fields]), out)


def member_rows(ensemble_set: DataFrame, n_models: int) -> DataFrame:
    """Expand shared inside rows (``model_ix = -1``) to every member."""
    shared = ensemble_set.where(F.col("model_ix") == -1).drop("model_ix").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias("model_ix"))
    own = ensemble_set.where(F.col("model_ix") >= 0)
    return own.unionByName(shared.select(*own.columns))
