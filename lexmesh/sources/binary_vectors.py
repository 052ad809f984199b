"""Binary word vectors as a Spark data source (S7): word2vec and fastText files.

``spark.read.format("binary_vectors").option("kind", ...)`` reads a file, or the files
of a folder, in partitions by byte range; no task reads more than its range.

* ``word2vec``: a text header ``count dim``, then entries ``word``, a space, ``dim``
  32-bit floats, with or without a line feed after each.  Entries have no marks
  to start from, but a chain of them does: read from a wrong place it breaks
  within a few entries, and read from inside a word it is right from the next
  entry on.  So a range seeks a chain a few entries before it.
* ``fasttext``: magic and settings, a dictionary, then a matrix with a row for each
  word and for each bucket of character n-grams.  Rows have one size.

A fastText word's vector is the mean of its own row and those of its n-grams; a
word that is not in the dictionary has the mean of its n-grams' rows, so every
word with an n-gram has a vector (:func:`fasttext_vectors`).  Rows meet words in
a join, so neither the matrix nor the words pass one task.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("word2vec", "fasttext")
#: Bytes of a partition.
RANGE_BYTES = 64 << 20
#: Longest word in bytes, and entries of a chain that settles where entries start.
MAX_WORD, CHAIN = 1024, 24

# Fixed values of the fastText file format.
FASTTEXT_MAGIC, FASTTEXT_VERSION = 793712314, 12
SETTINGS = ("dim", "ws", "epoch", "min_count", "neg", "word_ngrams", "loss", "model", "bucket", "minn", "maxn", "lr_rate")
FNV_START, FNV_PRIME = 2166136261, 16777619


def _open(path: str):
    """``(filesystem, path in it)`` of a path or URI that all tasks see."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> list[str]:
    """The path itself, or the files in it whose names don't start with ``_`` or ``.``."""
    from pyarrow import fs
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(os.path.join(path, f.base_name) for f in found
                  if f.type == fs.FileType.File and f.base_name[0] not in "._")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    base: int    # first byte of entries or rows
    size: int    # of the file
    dim: int
    row: int = 0     # fastText: first row, its first word's place, words in the dictionary
    words_at: int = 0
    n_words: int = 0


class Source:
    """A file with a forward read of bytes at any place."""

    def __init__(self, path: str):
        system, at = _open(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def at(self, start: int, n: int) -> bytes:
        if start >= self.size or n <= 0:
            return b""
        self.file.seek(start)
        return self.file.read(min(n, self.size - start))

    def until(self, start: int, mark: bytes, most: int) -> bytes:
        found = self.at(start, most)
        k = found.find(mark)
        if k < 0:
            raise ValueError(f"no end of the entry at byte {start}")
        return found[:k]


# --- word2vec -----------------------------------------------------------------------------

def word2vec_header(source: Source) -> tuple[int, int, int]:
    """``(count, dim, first byte of the entries)``."""
    line = source.until(0, b"\n", 128)
    try:
        count, dim = map(int, line.split())
    except ValueError:
        raise ValueError("not a binary word2vec file: its first line is no count and dimension") from None
    return count, dim, len(line) + 1


def entry_at(data: bytes, at: int, dim: int) -> tuple[int, int, int] | None:
    """``(first byte of the word, of the vector, after the vector)`` of what may be an entry."""
    if data[at:at + 1] == b"\n":
        at += 1
    space = data.find(b" ", at, at + MAX_WORD + 1)
    if space <= at or b"\n" in data[at:space]:
        return None
    try:
        data[at:space].decode("utf-8")
    except UnicodeDecodeError:
        return None
    return at, space + 1, space + 1 + 4 * dim


def first_entry(data: bytes, dim: int, whole: bool) -> int | None:
    """A place in ``data`` from which a chain of entries follows; the first of them may
    start inside its word.  ``whole``: the data end with the file."""
    for start in range(min(len(data), 2 * (MAX_WORD + 4 * dim))):
        at, n = start, 0
        while n < CHAIN and (found := entry_at(data, at, dim)) and found[2] <= len(data):
            at, n = found[2], n + 1
        if n == CHAIN or n and whole and data[at:] in (b"", b"\n"):
            return start
    return None


def word2vec_ranges(path: str, range_bytes: int) -> list[Range]:
    source = Source(path)
    count, dim, base = word2vec_header(source)
    if not count:
        return []
    cuts = [*range(base, source.size, max(range_bytes, 1)), source.size]
    return [Range(path, a, b, base, source.size, dim) for a, b in zip(cuts, cuts[1:])]


def word2vec_rows(part: Range) -> Iterator[tuple[str, np.ndarray]]:
    """The entries whose first byte (or the line feed before it) lies in the range."""
    source, size = Source(part.path), MAX_WORD + 4 * part.dim + 2
    at = part.start
    if at > part.base:
        back = max(part.base, at - 3 * size)
        data = source.at(back, 3 * size + (CHAIN + 2) * size)
        if back == part.base:
            at = back
        else:
            start = first_entry(data, part.dim, back + len(data) == part.size)
            if start is None:
                raise ValueError(f"no entries found around byte {at} of {part.path}")
            at = back + entry_at(data, start, part.dim)[2]
    held, data, here = 0, b"", at  # data lie at byte held
    while here < part.end:
        if here + size > held + len(data):
            data, held = source.at(here, max(1 << 20, 2 * size)), here
        if data[here - held:] in (b"", b"\n"):
            return
        found = entry_at(data, here - held, part.dim)
        if found is None or found[2] > len(data):
            raise ValueError(f"broken entry at byte {here} of {part.path}")
        if here >= part.start:
            yield data[found[0]:found[1] - 1].decode(), np.frombuffer(data[found[1]:found[2]], "<f4")
        here = held + found[2]


# --- fastText ------------------------------------------------------------------------------

def fasttext_settings(source: Source) -> tuple[dict, int]:
    """Settings with the dictionary's sizes, and the dictionary's first byte."""
    head = source.at(0, 8 + 4 * len(SETTINGS) + 8)
    if len(head) < 64 or struct.unpack("<ii", head[:8]) != (FASTTEXT_MAGIC, FASTTEXT_VERSION):
        raise ValueError("not a fastText model of version 12")
    out = dict(zip(SETTINGS, struct.unpack(f"<{len(SETTINGS)}i", head[8:8 + 4 * len(SETTINGS)])))
    size, n_words, n_labels, _, pruned = struct.unpack("<iiiqq", source.at(len(head), 28))
    if pruned > 0:
        raise ValueError("quantised fastText models are not read")
    return out | {"entries": size, "n_words": n_words, "n_labels": n_labels}, len(head) + 28


def dictionary(source: Source, at: int, n: int) -> Iterator[tuple[int, bytes]]:
    """``(place, word)`` of ``n`` entries from byte ``at`` on, and then the byte after them."""
    data, held = b"", at
    for _ in range(n):
        while (end := data.find(b"\0", at - held)) < 0 or end + 10 > len(data):
            more = source.at(held + len(data), 1 << 20)
            if not more:
                raise ValueError("the fastText dictionary ends early")
            data, held = data[at - held:] + more, at
        yield at, data[at - held:end]
        at = held + end + 10  # the zero byte, a 64-bit count and a type
    yield at, b""


def fasttext_ranges(path: str, range_bytes: int) -> list[Range]:
    """Ranges of matrix rows, each with the place of its first word.  The dictionary is
    read through once, without keeping it."""
    source = Source(path)
    said, at = fasttext_settings(source)
    per = max(1, range_bytes // (4 * said["dim"]))
    places = {}
    for k, (place, _) in enumerate(dictionary(source, at, said["entries"])):
        if k % per == 0 and k < said["n_words"]:
            places[k] = place
        end = place
    quantised, rows, dim = struct.unpack("<?qq", source.at(end, 17))
    if quantised or dim != said["dim"] or rows < said["n_words"]:
        raise ValueError("quantised or inconsistent fastText matrix")
    base = end + 17
    return [Range(path, base + 4 * dim * r, base + 4 * dim * min(r + per, rows), base, source.size, dim, r,
                  places.get(r, 0), said["n_words"]) for r in range(0, rows, per)]


def fasttext_rows(part: Range) -> Iterator[tuple[int, str | None, np.ndarray]]:
    """``(row, word, vector)``; rows of n-gram buckets have no word."""
    source = Source(part.path)
    n = (part.end - part.start) // (4 * part.dim)
    words = dictionary(source, part.words_at, min(n, part.n_words - part.row)) if part.row < part.n_words else iter(())
    per = max(1, (1 << 20) // (4 * part.dim))
    for k in range(0, n, per):
        count = min(per, n - k)
        data = source.at(part.start + 4 * part.dim * k, 4 * part.dim * count)
        for j, vec in enumerate(np.frombuffer(data, "<f4").reshape(count, part.dim)):
            row = part.row + k + j
            yield row, next(words)[1].decode("utf-8", "replace") if row < part.n_words else None, vec


class BinaryVectors(DataSource):
    """``binary_vectors``: options ``path``, ``kind`` and ``range_bytes``; columns ``row``
    (fastText's matrix row, else null), ``word`` and ``vec``."""

    @classmethod
    def name(cls) -> str:
        return "binary_vectors"

    def schema(self) -> str:
        return "row long, word string, vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        return BinaryReader(dict(self.options))


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "word2vec")
        if self.kind not in KINDS:
            raise ValueError(f"invalid embedding type {self.kind!r}, enter one of {KINDS}")
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        ranges = word2vec_ranges if self.kind == "word2vec" else fasttext_ranges
        return [r for f in files_of(self.path) for r in ranges(f, self.range_bytes)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # without any partition Spark reads this one
            return
        rows = ((None, w, v) for w, v in word2vec_rows(part)) if self.kind == "word2vec" else fasttext_rows(part)
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 2000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list) -> pa.RecordBatch:
    ids, words, vecs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()),
                                       pa.array([v.astype("f8") for v in vecs], pa.list_(pa.float64()))], ["row", "word", "vec"])


def read_binary(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(row, word, vec)`` of a binary file or folder of files."""
    if kind not in KINDS:
        raise ValueError(f"invalid embedding type {kind!r}, enter one of {KINDS}")
    spark.dataSource.register(BinaryVectors)
    return spark.read.format("binary_vectors").option("path", path).option("kind", kind) \
        .option("range_bytes", range_bytes).load()


def vectors_from_word2vec(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(word, vec)`` of a binary word2vec file."""
    return read_binary(spark, path, "word2vec", range_bytes).select("word", "vec")


# --- fastText words ----------------------------------------------------------------------------

def ngram_hash(ngram: bytes) -> int:
    """32-bit FNV-1a over signed bytes, as the file format has it."""
    h = FNV_START
    for b in ngram:
        h = ((h ^ (b if b < 128 else b | 0xFFFFFF00)) * FNV_PRIME) & 0xFFFFFFFF
    return h


def ngram_rows(word: str, n_words: int, bucket: int, minn: int, maxn: int) -> list[int]:
    """Matrix rows of a word's character n-grams, the word in angle brackets; single
    brackets are no n-grams."""
    text, out = f"<{word}>", []
    for i in range(len(text)):
        for n in range(minn, min(maxn, len(text) - i) + 1):
            if n > 1 or 0 < i < len(text) - 1:
                out.append(n_words + ngram_hash(text[i:i + n].encode()) % bucket)
    return out


def fasttext_vectors(spark: SparkSession, path: str, words: DataFrame | None = None,
                     range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(word, vec)`` of every word of a fastText model, or of ``words(word)``, known
    or not.  Words without any n-gram and not in the dictionary have no row."""
    said, _ = fasttext_settings(Source(path))
    matrix = read_binary(spark, path, "fasttext", range_bytes)
    known = matrix.where("word IS NOT NULL").select("word", F.col("row").alias("own"))
    wanted = known if words is None else words.select("word").where("word IS NOT NULL").distinct().join(known, "word", "left")
    n_words, bucket, minn, maxn = (said[k] for k in ("n_words", "bucket", "minn", "maxn"))

    @F.arrow_udf("array<long>")
    def subwords(column: pa.Array) -> pa.Array:
        return pa.array([ngram_rows(w, n_words, bucket, minn, maxn) if bucket and maxn > 0 else []
                         for w in column.to_pylist()], pa.list_(pa.int64()))

    own = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array().cast("array<long>"))
    rows = wanted.select("word", F.explode(F.concat(own, subwords("word"))).alias("row"))
    met = rows.join(matrix.select("row", "vec"), "row")
    mean = met.groupBy("word").agg(Summarizer.mean(array_to_vector("vec")).alias("mean"))
    return mean.select("word", vector_to_array("mean").alias("vec"))


def load_vectors(spark: SparkSession, path: str, embedding_type: str, words: DataFrame | None = None) -> DataFrame:
    """``(word, vec)`` of a pretrained binary file by its type; with ``words``, theirs only
    (fastText makes vectors for unknown ones)."""
    if embedding_type == "fasttext":
        return fasttext_vectors(spark, path, words)
    if embedding_type != "word2vec":
        raise ValueError(f"invalid embedding type {embedding_type!r}, enter one of {KINDS}")
    found = vectors_from_word2vec(spark, path)
    return found if words is None else found.join(words.select("word").distinct(), "word", "left_semi")


def write_word2vec(word_vectors: DataFrame, path: str) -> None:
    """``word_vectors(word, vec)`` as a folder of binary word2vec files, one for each
    partition.  A task writes under a name of its own and reports it; only reported
    files get their final names, so a repeated task leaves no second copy."""
    system, at = _open(path)
    system.create_dir(os.path.join(at, "_written"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        rows = [(w, np.array(v, "<f4")) for b in batches for w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if rows:
            here, folder = _open(path)
            name = f"{uuid.uuid4().hex}.bin"
            with here.open_output_stream(os.path.join(folder, "_written", name)) as out:
                out.write(f"{len(rows)} {len(rows[0][1])}\n".encode())
                for w, v in rows:
                    out.write(w.encode() + b" " + v.tobytes() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    written = word_vectors.select("word", "vec").mapInArrow(write, "name string").collect()  # a name for each partition
    for r in written:
        system.move(os.path.join(at, "_written", r["name"]), os.path.join(at, r["name"]))
    system.delete_dir(os.path.join(at, "_written"))
