"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks.  Each chunk is hashed on its own as a polynomial
over its bytes, under four moduli at once; all whole chunks of a text are one
matrix product.  Chunk hashes combine by shifting what is to the left by the
length of what is to the right, ``H(a + b) = H(a) * B ** len(b) + H(b)``, so a
huge text needs no pass in order and no state but four numbers.

Equal fingerprints and lengths only nominate a group.  Its texts are then
compared chunk by chunk: every task drops a chunk that equals, byte by byte, the
one it last sent for the same (fingerprint, chunk number), as long as that is among
the last ``FOLD_BYTES`` of chunks it met, before anything is shuffled.  So a group
that holds a third of all rows sends about one copy for each task, and no group
more than one for each ``FOLD_BYTES`` of text and one for each task.  A position with
two different chunks proves a collision.  Texts of a collided fingerprint are
grouped by the text itself.

Defined results: a null text counts as empty; empty texts form one group;
null ids never win a group that has an id, and one of them stays in a group
without; of rows repeated with the same id and text one is kept.  An empty
table gives an empty result.  Other columns are neither read nor returned by
``duplicate_classes`` and pass through ``drop_duplicates`` as they are.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import NO_ID, given, row_hash, text_or_empty, unused, utf8
from lexmesh.session import materialize

#: Bytes of a hashed chunk: 256 * 2**31 * 2**13 < 2**53, so sums in doubles are exact.
HASH_CHUNK = 8192
#: Bytes of a compared chunk.
COMPARE_CHUNK = 1 << 20
#: Bytes of chunks that a task keeps to fold equal ones, and of each one's entry besides.
FOLD_BYTES, FOLD_ENTRY = 32 << 20, 400
#: Four primes below 2**31 and a base for each: 124 bits together.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525 * 331, 134775813, 69069 * 4099)

FP = ["n_bytes", "fp_a", "fp_b"]


class Fingerprint:
    """Polynomial hashes of byte strings under several moduli."""

    def __init__(self, moduli=MODULI, bases=BASES, chunk: int = HASH_CHUNK):
        self.moduli, self.bases, self.chunk = tuple(moduli), tuple(bases), chunk
        powers = np.empty((chunk, len(moduli)))
        for k, (p, b) in enumerate(zip(moduli, bases, strict=True)):
            x = 1
            for i in range(chunk - 1, -1, -1):
                powers[i, k], x = x, x * b % p
        self.powers = powers

    def chunks(self, data: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
        """``(hashes, length)`` of each chunk; every chunk stands alone."""
        whole = len(data) // self.chunk
        out = []
        if whole:
            rows = data[:whole * self.chunk].reshape(whole, self.chunk)
            for a in range(0, whole, 512):  # at most 32 MB of doubles at once
                part = (rows[a:a + 512].astype(np.float64) + 1) @ self.powers
                out += [(self._mod(h), self.chunk) for h in part]
        if rest := len(data) - whole * self.chunk:
            h = (data[whole * self.chunk:].astype(np.float64) + 1) @ self.powers[-rest:]
            out.append((self._mod(h), rest))
        return out

    def _mod(self, sums) -> tuple[int, ...]:
        return tuple(int(s) % p for s, p in zip(sums, self.moduli))

    def join(self, left: tuple[tuple[int, ...], int], right: tuple[tuple[int, ...], int]):
        """Fingerprint of two neighbours: the left one shifted by the right one's length."""
        (a, n), (b, m) = left, right
        return tuple((x * pow(g, m, p) + y) % p
                     for x, y, g, p in zip(a, b, self.bases, self.moduli)), n + m

    def of(self, data: np.ndarray) -> tuple[tuple[int, ...], int]:
        parts = self.chunks(data)
        while len(parts) > 1:  # any order of joining gives the same value; halve each time
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0] if parts else ((0,) * len(self.moduli), 0)

    def longs(self, data: np.ndarray) -> tuple[int, int, int]:
        """``(n_bytes, fp_a, fp_b)``: the hashes packed two to a long."""
        h, n = self.of(data)
        h = (*h, 0, 0, 0, 0)
        return n, h[0] << 31 | h[1], h[2] << 31 | h[3]


def fingerprints(docs: DataFrame, hasher: Fingerprint | None = None) -> DataFrame:
    """``(doc_id, n_bytes, fp_a, fp_b, text_sha256)``, a row for each row."""
    given = (hasher or Fingerprint()).__dict__.copy()
    settings = {k: given[k] for k in ("moduli", "bases", "chunk")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Fingerprint(**settings)
        for batch in batches:
            data, at = utf8(batch.column(1))
            rows = [h.longs(data[a:b]) for a, b in zip(at[:-1], at[1:])]
            sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
            n, fa, fb = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fa, pa.int64()),
                 pa.array(fb, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", *FP, "text_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, fp_a long, fp_b long, text_sha256 string")


def chunk_rows(docs: DataFrame, hasher: Fingerprint | None = None) -> DataFrame:
    """``(n_bytes, fp_a, fp_b, chunk_no, chunk)`` of every text, for the comparison;
    equal rows are folded in each task."""
    given = (hasher or Fingerprint()).__dict__.copy()
    settings = {k: given[k] for k in ("moduli", "bases", "chunk")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Fingerprint(**settings)
        recent: OrderedDict[tuple, bytes] = OrderedDict()
        kept = 0
        for batch in batches:
            data, at = utf8(batch.column(0))
            cols: list[list] = [[], [], [], [], []]
            held = 0
            for a, b in zip(at[:-1], at[1:]):
                key = h.longs(data[a:b])
                for k, x in enumerate(range(a, max(b, a + 1), COMPARE_CHUNK)):
                    piece = data[x:min(b, x + COMPARE_CHUNK)].tobytes()
                    place = (*key, k)
                    sent = recent.pop(place, None)
                    recent[place] = piece
                    if sent == piece:
                        continue
                    kept += len(piece) + FOLD_ENTRY - (0 if sent is None else len(sent) + FOLD_ENTRY)
                    while kept > FOLD_BYTES:
                        kept -= len(recent.popitem(last=False)[1]) + FOLD_ENTRY
                    for col, v in zip(cols, (*key, k, piece)):
                        col.append(v)
                    held += len(piece)
                    if held > 8 * COMPARE_CHUNK:
                        yield _chunk_batch(cols)
                        cols, held = [[], [], [], [], []], 0
            yield _chunk_batch(cols)

    return docs.select(text_or_empty().alias("text")).mapInArrow(
        run, "n_bytes long, fp_a long, fp_b long, chunk_no long, chunk binary")


def _chunk_batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
        [*FP, "chunk_no", "chunk"])


def collided(docs: DataFrame, groups: DataFrame, hasher: Fingerprint | None = None) -> DataFrame:
    """Fingerprints that different texts share: chunks, folded by content in each
    task, of nominated groups are compared by position."""
    nominated = groups.where("group_size > 1").select(*FP).hint("shuffle_hash")
    chunks = chunk_rows(docs, hasher).join(nominated, FP, "left_semi")
    different = chunks.groupBy(*FP, "chunk_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return different.groupBy(*FP, "chunk_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select(*FP).distinct()


def duplicate_classes(docs: DataFrame, hasher: Fingerprint | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row."""
    rows = materialize(fingerprints(docs, hasher), "fingerprints")
    # Rows repeated with one id count together, so that one of them is kept.
    rows = rows.groupBy("doc_id", *FP, "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    groups = rows.groupBy(*FP).agg(F.sum("times").alias("group_size"), F.max("doc_id").alias("keep_id"))
    groups = materialize(groups, "groups")
    clash = materialize(collided(docs, groups, hasher), "collided")
    if clash.isEmpty():
        out = rows.join(groups, FP)
    else:
        out = rows.join(clash, FP, "left_anti").join(groups, FP) \
            .unionByName(_by_text(docs, clash, hasher), allowMissingColumns=True)
    first = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")
    return out.select("doc_id", "keep_id", "group_size", "text_sha256", first).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def _by_text(docs: DataFrame, clash: DataFrame, hasher: Fingerprint | None) -> DataFrame:
    """Rows of collided fingerprints, grouped by the text itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shas = fingerprints(docs, hasher).join(clash, FP, "left_semi").select("text_sha256").distinct()
    rows = rows.withColumn("text_sha256", F.sha2("text", 256)).join(shas, "text_sha256", "left_semi")
    rows = rows.groupBy("doc_id", "text_sha256", "text").agg(F.count(F.lit(1)).alias("times"))
    groups = rows.groupBy("text").agg(F.sum("times").alias("group_size"), F.max("doc_id").alias("keep_id"))
    return rows.join(groups, "text").drop("text")


def drop_duplicates(docs: DataFrame, hasher: Fingerprint | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as given,
    whatever their names."""
    key, sha, nth = unused(docs, "_id", "_sha", "_nth")
    kept = duplicate_classes(docs, hasher).where("kept").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_sha256").alias(sha))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                             sha: F.sha2(text_or_empty(), 256)})
    rows = rows.join(kept, [key, sha], "left_semi")
    number = F.row_number().over(Window.partitionBy(key, sha).orderBy(row_hash(docs)))
    return rows.withColumn(nth, number).where(F.col(nth) == 1).select(*given(docs))
