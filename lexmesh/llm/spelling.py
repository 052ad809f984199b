"""Spelling variants by asymmetric q-chunks.

Words are counted in one pass: tasks fold whole texts into hash tables and write
them out when they are large.  Two words are near if one inserted, deleted or
replaced code point turns one into the other.  The shorter word (either one, if
equally long) contributes two disjoint chunks, its halves; the other one its
positional grams of a chunk's length.  An edit touches one half only, so the
other half is a gram of the longer word at the same place or one further.
Grams that no chunk could meet there are left out, which keeps very long words
linear: a word has two chunks and at most six grams, each as one 64-bit key.
Whoever shares a key is verified by edit distance inside the join; only near
pairs leave it.  Where chunks times grams of a key are many (short words), its
chunks are dealt to several salts and its grams go to each of them.

A word's form is its near word of largest count, if that is ``ratio`` times its
own at least.  Counts grow along forms, so they are trees; roots are found by
pointer jumping, each round written to the shared folder.

Defined results: a null text has no words; a null id counts as an empty one in
the hash; repeated rows count each; texts and words of any length are read
whole; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import text_or_empty, utf8
from lexmesh.session import materialize

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Of the hashes of document and run, one in this many loses a code point.
DAMAGE = 97
#: Words that a task holds before it writes their counts out.
HELD = 400_000
#: Characters of text whose runs are held at once.
PIECE = 1 << 20
LETTERS = "a-zÀ-ÿ"
#: Comparisons of one key that a task makes; the chunks of a key with more are dealt out.
COMPARED = 1 << 20


def runs(text: str, min_chars: int) -> Iterator[list[str]]:
    """The maximal runs of ``min_chars`` or more letters, piece by piece."""
    run, gap, at = re.compile(f"[{LETTERS}]{{{min_chars},}}"), re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        end = gap.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = end.start() if end else len(text)
        yield run.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, damage: int = DAMAGE, held: int = HELD) -> DataFrame:
    """``(word, n)`` over all texts."""
    def spill(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for k in range(0, len(words), 50_000):
            part = words[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()),
                                              pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, crc = Counter(), zlib.crc32
        for batch in batches:
            data, at = utf8(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                before = crc(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                text = data[a:b].tobytes().lower().decode("utf-8", "replace")  # bytes: A-Z only
                for found in runs(text, min_chars):
                    for word, n in Counter(found).items():
                        h = crc(word.encode(), before)
                        if not h % damage:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < min_chars:
                                continue
                        counts[word] += n
                if len(counts) > held:
                    yield from spill(counts)
                    counts.clear()
        yield from spill(counts)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(fold, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _half(length: str, half: int, start: str = "0") -> tuple[str, str]:
    """Position (from ``start``) and size of one half of a word of ``length`` code points."""
    return (start, f"{length} div 2") if half == 0 else (f"{start} + {length} div 2", f"{length} - {length} div 2")


def _key(length: str, half: int, shift: int = 0) -> str:
    at, size = _half(length, half, str(shift))
    return f"xxhash64({length}, {half}, substr(word, cast({at} + 1 as int), cast({size} as int)))"


def near_pairs(words: DataFrame, compared: int = COMPARED) -> DataFrame:
    """``(a, a_n, b, b_n)``: pairs of ``words(word, n)`` exactly one edit apart, each once."""
    sized = words.withColumn("len", F.length("word").cast("long"))
    chunks = sized.select(F.col("word").alias("a"), F.col("n").alias("a_n"),
                          F.explode(F.array(*(F.expr(_key("len", half)) for half in (0, 1)))).alias("key"))
    same = [_key("len", half) for half in (0, 1)]
    longer = [_key("(len - 1)", half, shift) for half in (0, 1) for shift in (0, 1)]
    grams = sized.select(F.col("word").alias("b"), F.col("n").alias("b_n"),
                         F.explode(F.array_distinct(F.array(*map(F.expr, same + longer)))).alias("key"))
    met = chunks.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("c")) \
        .join(grams.groupBy("key").agg(F.count(F.lit(1)).alias("g")), "key")
    hot = met.select("key", F.least(F.ceil(F.col("c") * F.col("g") / compared), F.ceil("c")).alias("salts")).where("salts > 1")
    hot = materialize(hot, "hot")
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    chunks = chunks.join(hot, "key", "left").select("a", "a_n", "key", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    grams = grams.join(hot, "key", "left").select(
        "b", "b_n", "key", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    # the work is in the comparisons, not in the bytes that partitions are merged by
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, grams = (side.repartition(n, "key", "salt") for side in (chunks, grams))
    once = (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    return chunks.join(grams, ["key", "salt"]).where(once & (F.levenshtein("a", "b", 1) == 1)) \
        .select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``, whose links make trees."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        now = materialize(now.join(up, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def _ratio(n: str, other: str, ratio: int) -> Column:
    return F.col(other) >= ratio * F.col(n)


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO,
             damage: int = DAMAGE, held: int = HELD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the corpus."""
    words = materialize(word_counts(docs, min_chars, damage, held).where(F.col("n") >= min_count), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.toDF("word", "n", "near", "near_n").unionByName(pairs.toDF("near", "near_n", "word", "n"))
    best = both.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")) \
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    found = words.join(best, "word", "left")
    formed = _ratio("n", "near_n", ratio)
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(formed, F.col("near")).alias("form"),
                                     F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
