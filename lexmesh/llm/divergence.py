"""Source divergence audit by in-mapper stripes.

How far apart are the sources of a language in the terms they use, and which
terms set a source off?  Every task folds whole documents into hash stripes: a
term of a language has the number of its documents and its count in each
source.  A task that holds more than ``held`` entries writes them out and goes
on (spill); stripes with the same key are merged by one shuffle on (language,
term), to which a hot source or term sends a row for each task and source, not
one for each occurrence.

Merged stripes give the divergences directly.  A term that a group lacks has
the group's floor ``p0``, so a pair's sum over all kept terms is

* the number of terms times the divergence of the floors,
* what each group's own terms change against the other's floor (a histogram of
  the group's ``p`` and a row for each other source), and
* for the terms both have, what remains; a stripe of k sources gives its pairs
  in k - 1 shifted steps over all stripes of a batch, added up in the task.

All numbers are integers: ``p`` is divided as a decimal, everything else fits a
long.

Defined results: a null text, language or source is ''; a repeated row is a
document of its own; ids are not read and may be null; texts of any length are
read in pieces; a group without a term still has its pairs; an empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import utf8
from lexmesh.session import materialize

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Entries of the stripes that a task holds before it writes them out.
HELD = 300_000
#: Bytes of text whose terms are held at once.
PIECE = 1 << 20
#: Rows of an Arrow batch of spilled stripes.
ROWS = 50_000
#: Letters stay, A-Z as a-z, with all bytes of other characters; the rest parts terms.
TO_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
                 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece."""
    text, at = text.translate(TO_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = end if end >= 0 else len(text)
        yield text[at:end].split()
        at = end


def stripes(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Merged entries ``(lang, term, source, n, docs, lang_docs)``: occurrences and
    documents of a term in a source, and its documents in the language."""
    def spill(counts: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), count in counts.items():
            terms, of = list(count), seen[lang, source]
            for k in range(0, len(terms), ROWS):
                part = terms[k:k + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()),
                     pa.array([source] * len(part), pa.string()), pa.array([count[t] for t in part], pa.int64()),
                     pa.array([of[t] for t in part], pa.int64())], ["lang", "term", "source", "n", "docs"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            data, at = utf8(batch.column(2))
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, a, b in zip(groups, at[:-1].tolist(), at[1:].tolist()):
                count, terms = counts[key], set()
                size -= len(count)
                for found in term_lists(data[a:b].tobytes()):
                    count.update(found)
                    terms.update(found)
                seen[key].update(terms)
                size += len(count)
                if size > held:
                    yield from spill(counts, seen)
                    counts.clear()
                    seen.clear()
                    size = 0
        yield from spill(counts, seen)

    empty = F.lit("")
    entries = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text"))) \
        .mapInArrow(fold, "lang string, term binary, source string, n long, docs long") \
        .withColumn("term", F.col("term").cast("string"))
    merged = entries.repartition("lang", "term").groupBy("lang", "term", "source") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return merged.withColumn("lang_docs", F.sum("docs").over(Window.partitionBy("lang", "term")))


def share(n: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))``; null without any term."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) "
                  f"div nullif(cast({total} + 2 * {terms} as decimal(20,0)), 0)")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For stripes of ``(gid, p, p0)``: what the terms of both groups add to each pair."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.asarray(lists.value_lengths())
        gid, p, p0 = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, int(sizes.max(initial=0))):
            i = np.flatnonzero(row[step:] == row[:-step])
            j = i + step
            part = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
            pairs, at = np.unique(np.stack([np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j])]),
                                  axis=1, return_inverse=True)
            total = np.zeros(pairs.shape[1], np.int64)
            np.add.at(total, at.ravel(), part)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(total)],
                                             ["g", "h", "value"])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, held: int = HELD) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each source of a language
    every other one by divergence, and its ``top`` terms above the language."""
    kept = materialize(stripes(docs, held).where(F.col("lang_docs") >= min_docs)
                       .select("lang", "term", "source", "n"), "stripes")
    empty = F.lit("")
    occurring = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"),
                            F.coalesce(F.col("source").cast("string"), empty).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.countDistinct("term").alias("terms"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left") \
        .fillna(0, ["total", "lang_total", "terms"]) \
        .withColumn("p0", share("0", "total", "terms"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")

    entries = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    entries = materialize(entries.select("lang", "source", "term", "n", "lang_total", "terms", "gid", "p", "p0"),
                          "entries")
    common = entries.groupBy("lang", "term") \
        .agg(F.collect_list(F.struct("gid", "p", "p0")).alias("stripe")).select("stripe") \
        .mapInArrow(_common, "g long, h long, value long")

    other = groups.select("lang", F.col("gid").alias("h"), F.col("p0").alias("q0"))
    floors = groups.join(other, "lang").where("gid < h") \
        .select(F.col("gid").alias("g"), "h", F.coalesce(F.col("terms") * apart("p0", "q0"), F.lit(0)).alias("value"))
    own = entries.groupBy("lang", "gid", "p", "p0").agg(F.count(F.lit(1)).alias("k")).join(other, "lang") \
        .where("gid <> h").select(F.least("gid", "h").alias("g"), F.greatest("gid", "h").alias("h"),
                                  (F.col("k") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    sums = floors.unionByName(own).unionByName(common).groupBy("g", "h").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select(F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    named = groups.select("lang", "source", F.col("gid").alias("g"))
    pairs = both.join(named, "g").join(groups.select(F.col("gid").alias("h"), F.col("source").alias("item")), "h") \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    whole = entries.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    terms = entries.join(whole, ["lang", "term"]).withColumn("q", share("lang_n", "lang_total", "terms")) \
        .where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                               apart("p", "q").alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).unionByName(
        terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
