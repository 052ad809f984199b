"""Vectors of augmented rows from what they draw (M1).

An augmented row is a convex combination of a few training rows of its
category.  It travels as its draws (``pool``, and ``place * WEIGHT_LEVELS +
weight`` for each) or, some thousands of rows together, as the span of their numbers,
from which the same draws are hashed; the category's training rows travel once for each
member, and vectors are made a block at a time where they are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WEIGHT_LEVELS = 11      # integer weights 0..10
POOL_INSIDE, POOL_OUTSIDE = -1, -2   # all inside, all outside rows; from 0 on: outside rows of one source category
BLOCK_ROWS = 8192       # rows whose vectors are made at once
DRAWS_PER_NUMBER = 7    # 11 ** 7 weight vectors fit into one 32-bit draw


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of numbers as rows."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros((0, 0))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if lists.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must be present and equally long")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), int(lengths[0]))


def plain(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def hashed(ids: range, before: str, after: str = "") -> np.ndarray:
    """Four 32-bit draws for each id, as :func:`lexmesh.functions.hashing.hash_slices`
    makes them; the first one is that of ``hash_u``."""
    md5 = hashlib.md5
    found = b"".join([md5(f"{before}|{k}{after}".encode()).digest() for k in ids])
    return np.frombuffer(found, ">u4").reshape(-1, 4).astype(np.int64)


def span_weights(ids: range, before: str, n_draw: int) -> np.ndarray:
    """:func:`lexmesh.operators.augment.draw_weights` of a span."""
    out = np.empty((len(ids), n_draw), np.int64)
    above = np.zeros(len(ids), bool)
    for k in range(0, n_draw, DRAWS_PER_NUMBER):
        here = min(DRAWS_PER_NUMBER, n_draw - k)
        span = WEIGHT_LEVELS ** here
        u = hashed(ids, before, f"|w|{k}")[:, 0]
        code = u % span
        if k + here == n_draw:
            code = np.where(above, code, u % (span - 1) + 1)
        above |= code > 0
        for i in range(here):
            out[:, k + i] = code // WEIGHT_LEVELS ** i % WEIGHT_LEVELS
    return out


def span_draws(span: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool, places and weights of the rows of a span, the same as
    :func:`lexmesh.operators.augment.augment_samples` and its callers draw."""
    ids, n_draw = range(span["sample_id"], span["sample_id"] + span["n"]), span["n_draw"]
    before = f"{span['seed']}|{span['key']}"
    pool = np.full(len(ids), POOL_INSIDE if span["inside"] else POOL_OUTSIDE, np.int64)
    if span["kind"] == "original":
        place, weights = (np.zeros((len(ids), n_draw), np.int64) for _ in range(2))
        place[:, 0] = np.asarray(ids) if span["inside"] else hashed(ids, before)[:, 0] % span["n_out"]
        weights[:, 0] = 1
        return pool, place, weights
    n_pool = np.full(len(ids), span["n_in"], np.int64)
    if not span["inside"]:
        by_src = np.asarray(span["n_by_src"], np.int64)
        pool = hashed(ids, before, "|cat")[:, 0] % len(by_src)
        n_pool = by_src[pool]
    slices = [hashed(ids, before, "|ix" + (f"|{k}" if k else ""))[:, :min(4, n_draw - k)] for k in range(0, n_draw, 4)]
    return pool, np.hstack(slices) % n_pool[:, None], span_weights(ids, before, n_draw)


def counted(rows: pa.Table, name: str) -> np.ndarray:
    """A column's value for each row that ``rows``, spans or not, stands for."""
    values = plain(rows.column(name))
    return np.repeat(values, plain(rows.column("n"))) if "n" in rows.column_names else values


class Rows:
    """Rows given as an array."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __len__(self) -> int:
        return len(self.x)

    def blocks(self, size: int = BLOCK_ROWS) -> Iterator[tuple[slice, np.ndarray]]:
        for k in range(0, len(self), size):
            yield slice(k, k + size), self.x[k:k + size]


class Drawn:
    """Rows that are made from their draws, a block at a time.

    ``rows`` has ``kind, pool, draws``, or is spans of rows, and ``training`` has ``row_id,
    inside, src_category, vec``, both with ``group_cols``, which part the pools.  A pool is
    in order of ``row_id``; source categories are in order of their names.  Of spans no
    draws are held but the rows they name and the weights, some 15 bytes a row."""

    def __init__(self, rows: pa.Table, training: pa.Table, group_cols: Sequence[str] = ()):
        self.vecs, self.row_ids = matrix(training.column("vec")), plain(training.column("row_id"))
        mine, pools = self._pools(rows, training, group_cols)
        if "n" in rows.column_names:
            spans = rows.select(["inside", "kind", "sample_id", "n", "key", "n_in", "n_out", "n_by_src", "n_draw", "seed"]).to_pylist()
            ends = np.cumsum([0, *(s["n"] for s in spans)])
            n_draw = spans[0]["n_draw"]
            self.at, self.weights = np.zeros((ends[-1], n_draw), np.int32), np.zeros((ends[-1], n_draw), np.int8)
            self.original = np.repeat([s["kind"] == "original" for s in spans], [s["n"] for s in spans])
            for span, g, start, end in zip(spans, mine, ends, ends[1:]):
                pool, place, self.weights[start:end] = span_draws(span)
                self._place(slice(start, end), pools[g], pool, place)
            return
        draws = matrix(rows.column("draws"))
        self.weights = (draws % WEIGHT_LEVELS).astype(np.int8)
        self.original = pc.equal(rows.column("kind"), "original").to_numpy()
        place, pool = draws // WEIGHT_LEVELS, plain(rows.column("pool"))
        self.at = np.zeros(place.shape, np.int32)
        for g in np.unique(mine):
            here = np.flatnonzero(mine == g)
            self._place(here, pools[g], pool[here], place[here])

    def _place(self, here, pools: dict, pool: np.ndarray, place: np.ndarray) -> None:
        at = np.zeros(place.shape, np.int32)
        for k in np.unique(pool):
            some = pool == k
            at[some] = pools[int(k)][place[some]]
        self.at[here] = at

    def _pools(self, rows: pa.Table, training: pa.Table, group_cols: Sequence[str]) -> tuple[np.ndarray, dict]:
        """Each row's group, and the places in ``training`` of every pool of a group."""
        inside = plain(training.column("inside")).astype(bool)
        src = training.column("src_category").dictionary_encode().combine_chunks()
        src = src.chunk(0) if isinstance(src, pa.ChunkedArray) else src
        names = src.dictionary.to_pylist()
        code = src.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        order = np.argsort(self.row_ids, kind="stable")
        mine, theirs = self._groups(rows, training, group_cols)
        found = {}
        for g in np.unique(mine):
            own = order[(theirs == g)[order]]
            outside = own[~inside[own]]
            pools = {POOL_INSIDE: own[inside[own]], POOL_OUTSIDE: outside}
            present = sorted(set(code[outside].tolist()),
                             key=lambda c: (c < len(names), names[c].encode() if c < len(names) else b""))
            found[g] = pools | {k: outside[code[outside] == c] for k, c in enumerate(present)}
        return mine, found

    @staticmethod
    def _groups(rows: pa.Table, training: pa.Table, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's group, equal in both tables."""
        found = [np.zeros(rows.num_rows, np.int64), np.zeros(training.num_rows, np.int64)]
        for c in cols:
            both = pa.chunked_array([*rows.column(c).chunks, *training.column(c).chunks], rows.schema.field(c).type)
            codes = both.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            n = int(codes.max(initial=0)) + 1
            found = [found[0] * n + codes[:rows.num_rows], found[1] * n + codes[rows.num_rows:]]
        return found[0], found[1]

    def __len__(self) -> int:
        return len(self.at)

    def of(self, here) -> np.ndarray:
        weights = self.weights[here].astype("float64")
        weights /= weights.sum(axis=1, keepdims=True)
        at = self.at[here]
        out = np.einsum("nk,nkd->nd", weights, self.vecs[at])
        as_is = self.original[here]
        out[as_is] = self.vecs[at[as_is, 0]]
        return out

    def blocks(self, size: int = BLOCK_ROWS) -> Iterator[tuple[slice, np.ndarray]]:
        for k in range(0, len(self), size):
            yield slice(k, k + size), self.of(slice(k, k + size))


def vector_rows(names: Sequence[str]):
    """Cogroup body of ``ensemble_training_set``: ``names`` of a part's rows, with their ``vec``."""
    def fn(rows: pa.Table, training: pa.Table) -> pa.Table:
        kept = [n for n in names if n != "vec"]
        if not rows.num_rows:
            return pa.table([*(rows.column(n) for n in kept), pa.array([], pa.list_(pa.float64()))], names=[*names])
        made = Drawn(rows, training)
        # an inside original is known by its row's id
        ids = plain(rows.column("sample_id")).copy()
        own = made.original & plain(rows.column("inside")).astype(bool)
        ids[own] = made.row_ids[made.at[own, 0]]
        rows = rows.set_column(rows.schema.get_field_index("sample_id"), "sample_id", pa.array(ids, pa.int64()))
        dim = made.vecs.shape[1]
        parts = []
        for here, x in made.blocks():
            ends = pa.array(np.arange(0, (len(x) + 1) * dim, dim, dtype=np.int32)[:len(x) + 1] if dim else np.zeros(len(x) + 1, np.int32))
            vec = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            some = rows.slice(here.start, len(x)).combine_chunks()
            parts.append(pa.table([*(some.column(n) for n in kept), vec], names=[*names]))
        return pa.concat_tables(parts)
    return fn
