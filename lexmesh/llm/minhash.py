"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds 64-bit hashes of its distinct word shingles.  Equal sets
are folded first; what follows works on distinct sets.

1. *Banded candidates.*  A signature has ``bands * rows`` minima.  Sets that
   agree on a whole band share a bucket; a pair at the threshold of 0.85 misses
   all 32 bands of 5 rows once in 10^8.
2. *Sequential comparison.*  Members of a bucket are walked breadth first.  A
   pair's signatures are compared a batch of minima at a time; with m of n
   minima equal, the similarity is Beta(m + 1, n - m + 1) distributed (uniform
   prior), and the pair is dropped as soon as the chance that it lies at or
   above the threshold is below ``miss``.  Each bucket gives a forest of
   survivors, never all pairs; their components are the candidate groups.
3. *Exact verification.*  Sets of the candidate groups are made again from the
   texts.  A group is walked breadth first: whoever survives the sequential
   comparison with a member is compared with it on the full sets.  All links
   within a group are respected, whichever bucket they came from.

Buckets and groups beyond a task's bound are cut into blocks by a hash, and
every two blocks meet in one cell, so no row of links is lost and no task holds
more than two blocks.  Bounds choose among equal ways only.

Defined results: only A-Z are lower-cased; null and empty texts, and those
without words, have the empty set, linked with nothing; fewer words than a
shingle count as one; texts of any length are read in pieces; repeated rows are
returned each.  A component's id is its smallest non-null id, and null where it
has none; a null id is never kept.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import text_or_empty, utf8, worker_cache
from lexmesh.llm.graph import components
from lexmesh.session import materialize

WORDS, THRESHOLD = 3, (85, 100)
BANDS, ROWS = 32, 5
#: Minima compared at a time, and the chance at which a true link may be dropped.
BATCH, MISS = 32, 1e-9
#: Members of a bucket, and hashes of a candidate group, that one task walks.
BUCKET, HASHES = 4096, 4_000_000
#: Bytes of text whose shingles are held at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * ODD + np.uint64(seed))


class Shingles:
    """Hashes of all word shingles of a text by differences of one running
    polynomial, so a shingle costs the same however long its words are."""

    def __init__(self, words: int):
        self.words = words
        self.of_byte = numbers(256, 1)
        self.base = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, self.base))))
        self.back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, self.inverse))))

    def _hashes(self, found: list[bytes], words: int) -> np.ndarray:
        joined = np.frombuffer(b" ".join(found), np.uint8)
        if len(joined) >= len(self.power):
            self._grow(len(joined))
        run = np.concatenate(([np.uint64(0)], np.cumsum(self.of_byte[joined] * self.power[:len(joined)])))
        space = np.flatnonzero(joined == 0x20)
        start = np.concatenate(([0], space + 1))[:len(found) - words + 1]
        end = np.concatenate((space, [len(joined)]))[words - 1:]
        return mixed((run[end] - run[start]) * self.back[start])

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted distinct hashes."""
        text, tail, at, out = text.lower(), [], 0, []  # bytes: A-Z only
        while at < len(text):
            end = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = end.start() if end else len(text)
            found = tail + text[at:end].split()
            if len(found) >= self.words:
                out = [np.unique(np.concatenate([*out, self._hashes(found, self.words)]))]
                tail = found[len(found) - self.words + 1:]
            else:
                tail = found
            at = end
        if out:
            return out[0]
        return self._hashes(tail, len(tail)) if tail else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima as unsigned 32-bit numbers."""
    add, by = numbers(n, 2), numbers(n, 3) | np.uint64(1)
    least = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[k:k + 256, None] ^ add) * by).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def cutoffs(n: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int, int]]:
    """``(from, to, least)`` for each batch: with fewer than ``least`` of the first
    ``to`` minima equal, the chance of a similarity at or above the threshold is
    below ``miss``.  That chance is the one of ``m`` or fewer successes in
    ``to + 1`` trials."""
    out = []
    for a in range(0, n, batch):
        b, chance, m = min(a + batch, n), 0.0, 0
        while True:
            chance += math.comb(b + 1, m) * threshold ** m * (1 - threshold) ** (b + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((a, b, m))
    return out


def survivors(one: np.ndarray, others: np.ndarray, among: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the rows ``among`` of the signatures ``others`` may be linked with ``one``."""
    equal = np.zeros(len(among), np.int64)
    for a, b, least in steps:
        equal = equal + (others[among, a:b] == one[a:b]).sum(axis=1)
        keep = equal >= least
        among, equal = among[keep], equal[keep]
    return among


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """``(member, root)`` for each member of a tree; ``near`` gives the linked ones of some."""
    left, out = np.arange(n), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            found = near(front.pop(), left)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                front += found.tolist()
                out += [(k, root) for k in found.tolist()]
    return out


def linked(sets: list[np.ndarray], signatures: np.ndarray, steps, share: tuple[int, int]):
    """``near`` of ``forest`` on full sets, after the sequential comparison."""
    per, of = share
    sizes = np.array(list(map(len, sets)), np.int64)

    def near(one: int, left: np.ndarray) -> np.ndarray:
        n = sizes[left]
        fit = left[of * np.minimum(n, sizes[one]) >= per * np.maximum(n, sizes[one])]
        some = survivors(signatures[one], signatures, fit, steps)
        if not len(some):
            return some
        mine, theirs = sets[one], np.concatenate([sets[k] for k in some.tolist()])
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        common = np.add.reduceat((mine[at] == theirs).astype(np.int64), starts)
        return some[of * common >= per * (sizes[some] + sizes[one] - common)]

    return near


def _u64(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def shingle_sets(docs: DataFrame, words: int, n: int) -> DataFrame:
    """``(doc_id, text_key, n_shingles, key, signature)``; key is a digest of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = worker_cache(f"shingles {words}", lambda: Shingles(words))
        for batch in batches:
            data, at = utf8(batch.column(2))
            sizes, keys, signatures = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                found = shingles(data[a:b].tobytes())
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append(signature(found, n).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signatures, pa.binary())], ["doc_id", "text_key", "n_shingles", "key", "signature"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, key binary, signature binary")


def buckets(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(bucket, id)``, one row for each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = numbers(rows, 4) | np.uint64(1)
        for batch in batches:
            found = np.array([np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()], np.uint64)
            found = found.reshape(-1, bands, rows)
            key = mixed(mixed(found * by).sum(axis=2, dtype=np.uint64) + numbers(bands, 5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)),
                 pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands))], ["bucket", "id"])

    return sets.select("id", "signature").mapInArrow(run, "bucket long, id long")


def cells(members: DataFrame) -> DataFrame:
    """``(cell, id)`` for ``members(key, id, blocks)``: one cell for a key of one
    block, else one for every two blocks."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(1))),
                               lambda x: x != F.col("block")))
    split = members.withColumn("block", block).select("key", "id", "block", "blocks", other.alias("other"))
    pair = [F.when(F.col("blocks") > 1, f("block", "other")).otherwise(0) for f in (F.least, F.greatest)]
    return split.select(F.xxhash64("key", *pair).alias("cell"), "id")


def candidate_groups(sets: DataFrame, bands: int, rows: int, threshold: float, miss: float, bucket: int) -> DataFrame:
    """``(node, root)`` of the sets that may be linked with another one."""
    keyed = buckets(sets, bands, rows)
    busy = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                       .select("bucket", F.ceil(F.col("n") / bucket).alias("blocks")), "buckets")
    dealt = cells(keyed.join(busy, "bucket").withColumnRenamed("bucket", "key"))
    # the same members often meet in several bands: each list is walked once
    lists = dealt.groupBy("cell").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    lists = materialize(lists.withColumn("cell", F.monotonically_increasing_id()), "lists")
    met = lists.select("cell", F.explode("ids").alias("id")).join(sets.select("id", "signature"), "id")
    steps = cutoffs(bands * rows, threshold, miss)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column(0):
                ids, found = members.values.flatten()
                ids = ids.to_pylist()
                signatures = np.array([np.frombuffer(x, "<u4") for x in found.to_pylist()])
                out += [(ids[a], ids[b]) for a, b in forest(
                    len(ids), lambda one, left: survivors(signatures[one], signatures, left, steps))]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = met.groupBy("cell").agg(F.collect_list(F.struct("id", "signature")).alias("members"))
    return components(met.select("members").mapInArrow(walk, "a long, b long"))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted`` (id, doc_id, text_key, key, ...) with the full ``hashes``, made again from the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = worker_cache(f"shingles {words}", lambda: Shingles(words))
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                found = shingles(data[a:b].tobytes()).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(found, digest_size=16).digest()]), pa.array([found])], ["key", "hashes"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("id_of"), F.xxhash64(text).alias("text_of"), text.alias("text"))
    chosen = wanted.select("doc_id", "text_key")
    rows = rows.join(chosen, F.col("id_of").eqNullSafe(F.col("doc_id")) & (F.col("text_of") == F.col("text_key")),
                     "left_semi")
    found = rows.select("text").mapInArrow(run, "key binary, hashes binary")
    return wanted.join(found, "key").dropDuplicates(["id"])


def links(docs: DataFrame, sets: DataFrame, words: int = WORDS, share: tuple[int, int] = THRESHOLD,
          bands: int = BANDS, rows: int = ROWS, miss: float = MISS, bucket: int = BUCKET,
          hashes: int = HASHES) -> DataFrame:
    """Edges ``(a, b)`` between distinct sets with the same components as all pairs
    whose intersection is ``share`` of the union or more."""
    threshold = share[0] / share[1]
    groups = candidate_groups(sets, bands, rows, threshold, miss, bucket)
    wanted = materialize(groups.withColumnRenamed("node", "id").join(sets, "id"), "candidates")
    full = materialize(sets_of(docs, wanted, words).select("id", "root", "n_shingles", "signature", "hashes"), "sets")
    sizes = materialize(full.groupBy("root").agg(F.ceil(F.sum("n_shingles") / hashes).alias("blocks")), "groups")
    dealt = cells(full.join(sizes, "root").select(F.col("root").alias("key"), "id", "blocks"))
    met = dealt.join(full.select("id", "signature", "hashes"), "id") \
        .groupBy("cell").agg(F.collect_list(F.struct("id", "signature", "hashes")).alias("members"))
    steps = cutoffs(bands * rows, threshold, miss)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column(0):
                ids, found, full_sets = members.values.flatten()
                ids = ids.to_pylist()
                signatures = np.array([np.frombuffer(x, "<u4") for x in found.to_pylist()])
                out += [(ids[a], ids[b]) for a, b in forest(
                    len(ids), linked(_u64(full_sets), signatures, steps, share))]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.select("members").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = THRESHOLD, bands: int = BANDS,
                    rows: int = ROWS, miss: float = MISS, bucket: int = BUCKET, hashes: int = HASHES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row."""
    found = materialize(shingle_sets(docs, words, bands * rows), "minhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f")
    sets = found.where("n_shingles > 0").groupBy("key", "n_shingles").agg(first, F.first("signature").alias("signature"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("id"), "key", "n_shingles", "signature",
                                   "f.doc_id", "f.text_key"), "distinct")
    roots = components(links(docs, sets, words, share, bands, rows, miss, bucket, hashes))
    named = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.select("key", "root").join(names, "root").select("key", "component_id")
    some = F.col("n_shingles") > 0
    return found.join(named, "key", "left") \
        .withColumn("component_id", F.when(some, F.col("component_id")).otherwise(F.col("doc_id"))) \
        .select("doc_id", "n_shingles", "component_id",
                F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
