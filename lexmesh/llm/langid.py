"""Language ID by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is filled with text of a
bounded sample of labelled documents.  A text is lower-cased, everything but
letters and their marks becomes one space, and its blocks are compressed with the dictionary of
each language in turn; the language whose dictionary leaves the fewest bytes in
all is predicted.  The relative distance to the runner-up is the margin; where
it is narrow the row is marked as rejected (the prediction stays).

The sample is fixed by two parameters: at most ``SAMPLE_DOCS`` documents of each
language (rows with the smallest hash of their id) and ``DICTIONARY_BYTES`` of
their text in turn.  Prediction reads every text whole, and nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score 0
and rejected; ties go to the first language in order of its code; a row with a
null id is never held out and never learned from.  Without any learned
language every row is ``und``.  Repeated rows are returned each; an empty table
gives an empty result; texts of any length are compressed block by block; other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.llm.common import given, unused

SAMPLE_DOCS = 300
#: Characters taken of one sampled document, so that many fill a dictionary.
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 1 << 15
BLOCK = 4096
#: Narrower margins than this share of the best size are rejected.
MIN_MARGIN = 0.002
UNKNOWN = "und"
#: Runs of anything but letters and the marks on them (vowel signs, accents).
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
NOT_ASCII_LETTERS = re.compile("[^a-z]+")


def plain(text: str) -> str:
    """The text's words in lower case; empty if no character is a letter."""
    if text.isascii():
        return NOT_ASCII_LETTERS.sub(" ", text.lower()).strip()
    return NOT_LETTERS.sub(" ", text.lower()).strip() if any(map(str.isalpha, text)) else ""


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def sample(docs: DataFrame, n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(lang, text)`` of the bounded sample to learn from: at most ``n_docs``
    starts of texts for each language.  The ids are chosen without reading any text."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where(F.col("lang").isNotNull() & (remainder() != 2)).select("doc_id", "lang") \
        .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_docs) \
        .select("doc_id", "lang").distinct()
    texts = docs.where(F.col("lang").isNotNull() & (remainder() != 2)).select(
        "doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    # bounded: n_docs ids for each language, and, as ids may repeat, n_docs rows
    texts = texts.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").where("text IS NOT NULL")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return texts.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n_docs) \
        .orderBy("lang", "nth").select("lang", "text")


def dictionaries(labelled: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language of a bounded ``(lang, text)`` sample."""
    found: dict[str, list[str]] = {}
    for lang, text in labelled.collect():  # SAMPLE_DOCS * SAMPLE_CHARS for each language at most
        if clean := plain(text):
            found.setdefault(lang, []).append(clean)
    return {lang: "\n".join(texts).encode()[:size] for lang, texts in sorted(found.items())}


class Classifier:
    """Compressors with each language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=16, chain_log=16,
            search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.with_lang = {}
        for lang, data in content.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            self.with_lang[lang] = zstandard.ZstdCompressor(compression_params=settings, dict_data=d)

    def sizes(self, clean: str) -> list[tuple[int, str]]:
        data = clean.encode()
        blocks = [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.with_lang.items())

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        """``(lang_pred, score, rejected)``; score is the margin, from 0 to 1."""
        clean = plain(text) if text else ""
        if not clean or not self.with_lang:
            return UNKNOWN, 0.0, True
        best, *rest = self.sizes(clean)
        margin = (rest[0][0] - best[0]) / rest[0][0] if rest else 1.0
        return best[1], margin, margin < min_margin


def predictions(docs: DataFrame, min_margin: float = MIN_MARGIN,
                names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the prediction, its score and whether it is rejected appended
    under ``names``; one pass, no shuffle."""
    content = dictionaries(sample(docs))
    n = len(docs.columns)
    # the Arrow pass takes plain names only
    columns = [f"c{k}" for k in range(n + 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_dictionaries = Classifier(content)
        for batch in batches:
            found = [with_dictionaries.predict(t.as_py(), min_margin) for t in batch.column(n)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], columns)

    kinds = [*(f.dataType for f in docs.schema.fields), T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([T.StructField(c, kind) for c, kind in zip(columns, kinds)])
    return docs.select(*given(docs), F.col("text")).toDF(*columns[:n + 1]).mapInArrow(run, schema) \
        .toDF(*docs.columns, *names)


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, a row for each row."""
    found = predictions(docs.select("doc_id", "text", "lang"), min_margin)
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` without the rows that are rejected, all columns as given, whatever their names."""
    names = unused(docs, "_lang_pred", "_score", "_rejected")
    return predictions(docs, min_margin, tuple(names)).where(~F.col(names[2])).select(*given(docs))
