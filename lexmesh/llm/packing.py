"""Best-fit packing of tokenised documents.

A document is its token ids and an end id.  Only documents longer than a
sequence are cut; the first piece takes the remainder.  Pieces are dealt by a
hash to groups of about ``GROUP`` pieces.  Each group is packed on its own by
best-fit decreasing: a segment tree over remaining capacities holds the open
sequences, and a descent finds the tightest one that fits in logarithmic time.
What a group wastes beyond the whole is less than one sequence in thousands,
and no group grows with the data.  Only numbers are shuffled, never text or ids.

The vocabulary is the public byte-level BPE whose path is a parameter.

Defined results: a null text is an empty one, which has the end id alone; a
repeated row is packed each time; null ids are packed like others.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.llm.common import text_or_empty, worker_cache
from lexmesh.session import materialize

LENGTH = 1024
END_ID = 2
#: Pieces packed together.
GROUP = 1 << 15
#: Characters of text in hand at once.
PORTION = 1 << 20
# The pattern that byte-level vocabularies cut texts by.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which every library has the same classes: ASCII, Latin, punctuation, currency, pictures.
COMMON = "\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\U0001f300-\U0001f64f"
RARE = re.compile(f"[^{COMMON}]")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def stand_ins() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it
    is printable in Latin-1, else they count on from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts as packed little-endian 32-bit numbers.

    The vocabulary file belongs to ``tokenizers``.  If it is byte-level BPE whose ids
    count its merges, the same merges are run by ``tiktoken``, which gives the same
    ids several times faster; texts with a special token's string or with characters
    outside ``COMMON`` go to ``tokenizers``, as all do with any other file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self._merges(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _merges(said: dict):
        import tiktoken
        model, before = said["model"], said["pre_tokenizer"] or {}
        if said["normalizer"] or said["truncation"] or said["padding"] or model["type"] != "BPE" \
                or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") \
                or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        byte, ids = stand_ins(), model["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        if any(ids.get("".join(pair)) != 256 + k for k, pair in enumerate(pairs)) or sorted(ids.get(c, -1) for c in byte) != [*range(256)]:
            return None
        own = [*byte, *("".join(pair) for pair in pairs)]
        return tiktoken.Encoding("merges", pat_str=PRE_TOKENS, special_tokens={},
                                 mergeable_ranks={bytes(map(byte.__getitem__, t)): ids[t] for t in own})

    def _same(self, text: str) -> bool:
        return self.merges is not None and not RARE.search(text) and not any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [
            self.merges.encode_to_numpy(t).astype("<u4", copy=False).tobytes() if self._same(t) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and with ``with_ids`` the ids themselves."""
    path = path or tokenizer_path()
    end, whole = struct.pack("<I", end_id), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held > PORTION:
                    yield _cut(ids, encoder.encode(texts))
                    ids, texts, held = [], [], 0
            yield _cut(ids, encoder.encode(texts))

    def _cut(ids: list, encoded: list[bytes]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, data in zip(ids, encoded):
            data += end
            first = len(data) % whole or min(whole, len(data))
            cuts = [0, *range(first, len(data) + 1, whole)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = data[a:b]
                rows.append((doc_id, k, a // 4, (b - a) // 4, zlib.crc32(part),
                             list(struct.unpack(f"<{len(part) // 4}I", part)) if with_ids else None))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if with_ids else 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else ""))


class OpenSequences:
    """A segment tree over remaining capacities 0 to ``length``: each leaf has the
    open sequences with that much room, each inner node how many lie below."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A sequence with the least room that holds ``need``, and its room."""
        count, k = self.count, need + self.leaves
        while not count[k]:  # climb until something lies to the right
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:  # descend to the leftmost leaf in use
            k *= 2
            if not count[k]:
                k += 1
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return self.open[room].pop(), room


def best_fit(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """``(sequence, offset)`` for pieces in order of decreasing length."""
    tree, used, out = OpenSequences(length), 0, []
    for n in lengths:
        found = tree.take(n) if n < length else None
        if found is None:
            sequence, room = used, length
            used += 1
        else:
            sequence, room = found
        out.append((sequence, length - room))
        if room > n:
            tree.add(room - n, sequence)
    return out


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``cut`` (as from ``pieces``) with ``sequence_id`` and ``offset``."""
    columns = cut.columns
    cut = materialize(cut, "pieces")
    groups = max(1, -(-cut.count() // group))
    # Equal rows are told apart by their number, so that no group grows with a repeated row.
    dealt = cut.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    keys = [c for c in columns if c != "ids"]
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64(*keys, "_nth"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), *((c, "ascending") for c in keys if c != "length"),
                       ("_nth", "ascending")])
        placed = best_fit(t.column("length").to_pylist(), length)
        sequence, offset = zip(*placed) if placed else ((), ())
        base = t.column("_group")[0].as_py() << 32
        t = t.append_column("sequence_id", pa.array([base + s for s in sequence], pa.int64()))
        return t.append_column("offset", pa.array(offset, pa.int64())).drop(["_group", "_nth"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return dealt.groupBy("_group").applyInArrow(run, schema)
