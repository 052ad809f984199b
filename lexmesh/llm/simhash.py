"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint takes, for each of 64 bits, the majority among the
XXH64 values of its word shingles.  Equal fingerprints are folded first.  The
64 bits are cut into ``2 * max_bits`` blocks: two fingerprints that differ in
at most ``max_bits`` bits agree in at least half of the blocks, so they share
the key of one of the ``C(2k, k)`` choices of ``k`` blocks (20 keys of about 32
bits for 3 differing bits).  Whoever shares a key is verified by Hamming
distance:

* a bucket of two is one comparison of its least and greatest value;
* a bucket of up to ``bucket`` fingerprints is walked breadth first in one
  row, giving one edge to its root for each member, never all pairs;
* a larger bucket is linked by meeting points: every member goes to all
  values that differ from it by at most ``ceil(k / 2)`` of the bits free in
  this bucket, and is tied to the least one that is at most ``floor(k / 2)``
  away from there.  Rows grow in proportion to the members.

Edges end in ``graph.components``.  All three ways are exact; ``bucket`` only
chooses among them.

Defined results: only A-Z are lower-cased; a null text counts as empty; a text
without words has fingerprint zero and links like any other; repeated rows
are returned each; null ids never name a component that has an id, and a
component without any id has a null one.  Texts of any length are read in
pieces.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import NO_ID, given, row_hash, text_or_empty, unused, utf8
from lexmesh.llm.graph import components
from lexmesh.session import materialize

SEED = 42
#: Bytes of text whose words are held at once; longer texts go piece by piece.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text, as an unsigned number."""
    counts, total, tail, at = np.zeros(64, np.int64), 0, [], 0
    hashed = xxhash.xxh64_intdigest
    text = text.lower()  # bytes: A-Z only
    while True:
        end = SPACE.search(text, at + PIECE)
        end = end.start() if end else len(text)
        found = tail + text[at:end].split()
        if len(found) >= words:
            joined = b" ".join(found)
            stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            start = np.concatenate(([0], stop[:-1] + 1))
            h = np.array([hashed(joined[i:j], SEED) for i, j in
                          zip(start[:len(found) - words + 1].tolist(), stop[words - 1:].tolist())], "<u8")
            for k in range(0, len(h), 1 << 16):
                bits = np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            total += len(h)
            found = found[len(found) - words + 1:] if words > 1 else []
        tail, at = found, end
        if at >= len(text):
            break
    if not total:
        return hashed(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)``, a row for each row; text_key is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            fp = np.array([fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1], at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def masks(max_bits: int) -> list[int]:
    """The bits of every choice of ``max_bits`` of ``2 * max_bits`` blocks, as signed longs."""
    if max_bits == 0:
        return [-1]
    edges = [64 * i // (2 * max_bits) for i in range(2 * max_bits + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(blocks, max_bits)]


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """An edge to its root for each member of a bucket that has links."""
    left, out = fps, []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                rest = np.flatnonzero(~near)
                apart = np.bitwise_count((front[k:k + 64, None] ^ left[rest][None, :]).view(np.uint64))
                near[rest[(apart <= max_bits).any(axis=0)]] = True
            front, left = left[near], left[~near]
            out += [(int(x), int(root)) for x in front]
    return out


def links(fps: DataFrame, max_bits: int = 3, bucket: int = 16384) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fps(fp)`` with the same
    components as all pairs at ``max_bits`` or fewer differing bits."""
    keys = masks(max_bits)
    fp = F.col("fp")
    keyed = fps.select("fp", F.posexplode(F.array(*(fp.bitwiseAND(F.lit(m)) for m in keys))).alias("way", "key"))
    sizes = materialize(keyed.groupBy("way", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = sizes.where("n = 2").where(near).select("a", "b")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for x in batch.column(0) for e in _forest(x.values.to_numpy(zero_copy_only=False), max_bits)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    some = sizes.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("way", "key")
    walked = keyed.join(some, ["way", "key"]).groupBy("way", "key").agg(F.collect_list("fp").alias("fps")) \
        .select("fps").mapInArrow(walk, "a long, b long")
    edges = pairs.unionByName(walked)
    many = sizes.where(F.col("n") > bucket).select("way", "key")
    if not many.isEmpty():
        edges = edges.unionByName(_meetings(keyed.join(many, ["way", "key"]), keys, max_bits))
    return edges


def _meetings(members: DataFrame, keys: list[int], max_bits: int) -> DataFrame:
    """Links within the largest buckets by values that lie between their members."""
    low, high = max_bits // 2, max_bits - max_bits // 2

    def flips(mask: int) -> tuple[np.ndarray, np.ndarray]:
        free = [b for b in range(64) if not mask >> b & 1]
        by = [[sum(1 << b for b in c) for c in combinations(free, r)] for r in range(high + 1)]
        close = [r <= low for r in range(high + 1) for _ in by[r]]
        return np.array([x for part in by for x in part], np.uint64).view(np.int64), np.array(close)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for way, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if way not in known:
                    known[way] = flips(keys[way])
                xor, close = known[way]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(xor ^ np.int64(fp)), pa.array(np.full(len(xor), fp, np.int64)), pa.array(close)],
                    ["point", "fp", "close"])

    points = members.select("way", "fp").mapInArrow(spread, "point long, fp long, close boolean")
    points = points.groupBy("point", "fp").agg(F.max("close").alias("close"))
    points = materialize(points, "points")
    # written first: joined with an aggregate of its own, a hot point would not be split
    least = materialize(points.where("close").groupBy("point").agg(F.min("fp").alias("b")), "least")
    return points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, bucket: int = 16384) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)``, a row for each row."""
    rows = materialize(fingerprints(docs, words), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct, max_bits, bucket)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with the row of the smallest id of each component, all columns
    as given, whatever their names.  A component without any id keeps its rows."""
    found = near_duplicates(docs, words, max_bits).where("component_id IS NULL OR doc_id = component_id")
    key, text, nth = unused(docs, "_id", "_key", "_nth")
    kept = found.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(key),
                         F.when(F.col("doc_id").isNull(), F.col("text_key")).alias("alone")) \
        .agg(F.min("text_key").alias(text)).select(key, text)
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                             text: F.xxhash64(text_or_empty())})
    rows = rows.join(kept, [key, text], "left_semi")
    number = F.row_number().over(Window.partitionBy(key, text).orderBy(row_hash(docs)))
    return rows.withColumn(nth, number).where((F.col(nth) == 1) | (F.col(key) == NO_ID)).select(*given(docs))
