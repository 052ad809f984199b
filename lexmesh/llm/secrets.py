"""Secret scans with multipart credential linking.

Base findings are strong by themselves: assigned values of 12 or more
characters, access identifiers of 18 or more, hexadecimal runs of 16 or more.
Beside them a text has weak parts, which say nothing alone:

* ``id``: a shorter access identifier, or a value assigned to a user, client or
  key id;
* ``key``: a value of 4 to 11 characters assigned to a secret's name;
* ``endpoint``: the address of a service (a URL with a host, or a value
  assigned to host, endpoint or server).

Parts of one credential stand close together.  Each part has a scope, its span
widened by ``SCOPE`` code points on both sides, and parts whose scopes meet are
joined: sorted starts and running ends tell for every part whether a part of
another kind lies in its scope, without pairs.  A weak id is reported if a
secret (weak or strong) is in scope, a weak key if an identifier or an endpoint
is, an endpoint if both an identifier and a secret are.

Everything of a document is decided within its row: one pass, no shuffle.

Defined results: a null text counts as empty and has no spans; spans are in code
points with exclusive ends; an added span that overlaps a base span or an earlier
added one is dropped; repeated rows are scanned each.  Null ids are returned as
they are.  Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import text_or_empty, utf8

#: Kinds in the order of equal starts; the first three are the base ones.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: Code points on both sides of a part that belong to its scope.
SCOPE = 200

# The base patterns (on UTF-8; all of them match ASCII only).
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS = 12, 18
# The weak parts.
WEAK_KEY = 4
IDENTIFIER = re.compile(rb"(user_?name|user|login|client_?id|access_?key_?id|key_?id|account)[\"']?\x20*[:=]\x20*[\"']?"
                        rb"([A-Za-z0-9+/_.@-]{3,})", re.I)
IDENTIFIER_WORDS = (b"user", b"login", b"client", b"key", b"account")
ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@-]+(?:/[A-Za-z0-9._~/-]*)?"
                      rb"|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:-]{3,}", re.I)
ENDPOINT_WORDS = (b"://", b"host", b"endpoint", b"server")

Span = tuple[int, int, str]


def base_spans(data: bytes) -> tuple[list[Span], list[Span]]:
    """Base spans and weak parts of the same patterns, in bytes."""
    base: list[Span] = []
    weak: list[Span] = []
    low = data.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(data):
            n = len(m[2])
            if n >= MIN_ASSIGN:
                base.append((m.start(), m.end(), "assign"))
            elif n >= WEAK_KEY:
                weak.append((m.start(), m.end(), "key"))
    for m in ACCESS.finditer(data):
        if m.end() - m.start() >= MIN_ACCESS:
            base.append((m.start(), m.end(), "access"))
        else:
            weak.append((m.start(), m.end(), "id"))
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(data)]
    if weak or base:  # endpoints and identifiers count only beside a secret
        if any(w in low for w in IDENTIFIER_WORDS):
            weak += [(m.start(), m.end(), "id") for m in IDENTIFIER.finditer(data)]
        if any(w in low for w in ENDPOINT_WORDS):
            weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(data)]
    return base, weak


class Near:
    """Whether a span of one role lies within a scope: spans sorted by start,
    with the greatest end so far."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, *_ in spans]
        self.ends = np.maximum.accumulate([e for _, e, _ in spans]).tolist() if spans else []

    def meets(self, start: int, end: int, scope: int) -> bool:
        k = bisect_left(self.starts, end + scope)
        return k > 0 and self.ends[k - 1] > start - scope


def link(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts that stand beside their complements, without overlaps."""
    identifiers = Near([s for s in base if s[2] == "access"] + [s for s in weak if s[2] == "id"])
    secrets = Near([s for s in base if s[2] in ("assign", "hex")] + [s for s in weak if s[2] == "key"])
    endpoints = Near([s for s in weak if s[2] == "endpoint"])

    def complete(start: int, end: int, kind: str) -> bool:
        if kind == "id":
            return secrets.meets(start, end, scope)
        if kind == "key":
            return identifiers.meets(start, end, scope) or endpoints.meets(start, end, scope)
        return identifiers.meets(start, end, scope) and secrets.meets(start, end, scope)

    taken, out = Near(base), []
    last = -1
    for start, end, kind in sorted(weak, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= last and not taken.meets(start, end, 0) and complete(start, end, kind):
            out.append((start, end, kind))
            last = end
    return out


def in_code_points(data: np.ndarray, spans: list[Span]) -> list[Span]:
    if not spans:
        return spans
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(before[s]), int(before[e]), kind) for s, e, kind in spans]


def find(data: np.ndarray, scope: int = SCOPE) -> list[Span]:
    """All spans of a UTF-8 text in code points, by start and then by kind."""
    base, weak = base_spans(data.tobytes())
    base, weak = in_code_points(data, base), in_code_points(data, weak)
    return sorted(base + link(base, weak, scope), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)``, a row for each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find(data[a:b], scope)]
                     for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
