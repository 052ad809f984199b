"""WARC archives with a two-level capture index.

``write`` stores a gzip member per page in archives below a shared folder and
returns a capture row for each record.  Of records with equal payloads of at
least ``MIN_REVISIT`` bytes the one with the smallest page_id is a response, the
others are revisits that name it; smaller payloads are always responses.

``build_index`` sorts the captures by reversed-host URL key over the cluster.
Every task writes one index file of compressed blocks of ``BLOCK`` captures,
followed by a sparse directory, which has the first entry of each block.
``Index`` looks entries up: a binary search over the files (as many as the sort
had tasks), one over the file's directory, a range read of one block, a search
in it, and then a range read of the record itself.  ``read`` does this for a
table of keys at any size: wanted entries are sorted, so that each task walks
through neighbouring blocks; the captures found go to the task of their
archive and are read in order of their offsets.

Files are written through ``pyarrow.fs`` below the folder in
``spark.checkpoint.dir``.  Every attempt of a task takes new file names, and only
the rows of attempts that ended well reach the written capture tables, so a
lost executor or a repeated task leaves unused files at worst.

Defined results: null html is an empty payload; a null url is an empty one;
repeated rows with the smallest id of a group are responses each; a null id is
greater than all others, and a response if its group has no other.  Empty
tables give empty archives and results.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.session import materialize, scratch_path

MIN_REVISIT = 100
#: Bytes of an archive after which the next one begins; captures of a block.
ARCHIVE, BLOCK = 64 << 20, 3000
#: The records' date; a crawl has its own.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "entry string, page_id long, archive string, offset long, length long"


def filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def url_key(url: Column) -> Column:
    """``https://www.example.org:80/a?b#c`` as ``org,example,www:80)/a?b``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://(?:[^/?#@]*@)?([^/?#:]*)([^/?#]*))?([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(host, F.regexp_extract(url, parts, 2), F.lit(")"), F.regexp_extract(url, parts, 3))


def entry(url: Column, page_id: Column) -> Column:
    """What the index is sorted by: the key, then the page."""
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the rows that are revisits, by digests
    of payloads; equal payloads are folded in each task first."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")) \
        .where(F.col("n") >= MIN_REVISIT).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "digests")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("ids")) \
        .where("ids > 1 AND refers_to IS NOT NULL").drop("ids")
    return rows.join(firsts, "digest").where("page_id IS NULL OR page_id > refers_to") \
        .select("page_id", "digest", "refers_to")


def _header_text(value: str) -> str:
    """A header value on one line: what is not printable ASCII is percent-encoded."""
    return re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(block)}"]
    if url:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says: type, ids, digest, and the payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: int(fields[name]) if name in fields else None
    out = {"page_id": number("X-Page-Id"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"),
           "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": size, "payload": None}
    if out["record_type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
        out["payload"] = payload
    return out


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the captures ``(entry, page_id, archive, offset, length)``,
    written as a table themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = archive = None
        try:
            for batch in batches:
                rows = []
                for name, page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or out.tell() > ARCHIVE:
                        if out:
                            out.close()
                        archive = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{archive}", compression=None)
                    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packed.compress(record(page_id, url, html, digest, refers_to)) + packed.flush()
                    rows.append((name, page_id, archive, out.tell(), len(data)))
                    out.write(data)
                yield _batch(rows)
        finally:
            if out:
                out.close()

    html = F.coalesce("html", F.lit(""))
    page_id = F.col("page_id").cast("long")
    rows = pages.select(entry(F.col("url"), page_id).alias("entry"), page_id.alias("page_id"),
                        F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    marks = mark_revisits(pages)
    on = rows.page_id.eqNullSafe(marks.page_id) & (rows.digest == marks.digest)
    rows = rows.join(marks, on, "left").select(rows.entry, rows.page_id, rows.url, F.encode(rows.html, "UTF-8"),
                                               rows.digest, marks.refers_to)
    return materialize(rows.mapInArrow(run, CAPTURE), "captures")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      ["entry", "page_id", "archive", "offset", "length"])


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> list[tuple[str, str, int, int]]:
    """Write the capture index; ``(first entry, file, directory offset, length)`` of
    each index file in order, as many as the sort has tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, out, held, directory = f"{uuid.uuid4().hex}.idx", None, [], []

        def flush() -> None:
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            directory.append((held[0][0], out.tell(), len(data)))
            out.write(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                held.append(row)
                if len(held) == block:
                    flush()
        if out:
            if held:
                flush()
            at, data = out.tell(), zlib.compress(json.dumps(directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([directory[0][0]]), pa.array([name]), pa.array([at], pa.int64()),
                 pa.array([len(data)], pa.int64())], ["first", "file", "offset", "length"])

    ordered = captures.repartitionByRange("entry", "archive", "offset").sortWithinPartitions("entry", "archive", "offset")
    files = materialize(ordered.mapInArrow(run, "first string, file string, offset long, length long"), "index")
    return sorted((r.first, r.file, r.offset, r.length) for r in files.select("first", "file", "offset", "length").collect())


class Index:
    """Look-ups in a capture index; keeps the directory and the block read last."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.fs, self.root = filesystem(folder)
        self.files, self.firsts = files, [f[0] for f in files]
        self.directories: tuple[str, list] = ("", [])
        self.block: tuple[tuple[str, int], list] = (("", -1), [])

    def _range(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return zlib.decompress(f.read_at(length, offset))

    def _directory(self, k: int) -> list:
        _, name, offset, length = self.files[k]
        if self.directories[0] != name:
            self.directories = name, json.loads(self._range(name, offset, length))
        return self.directories[1]

    def _captures(self, name: str, offset: int, length: int) -> list:
        if self.block[0] != (name, offset):
            lines = self._range(name, offset, length).decode().split("\n")
            self.block = (name, offset), [json.loads(x) for x in lines]
        return self.block[1]

    def find(self, wanted: str) -> Iterator[list]:
        """Captures ``[entry, page_id, archive, offset, length]`` of an entry, however
        many blocks they fill."""
        for k in range(max(0, bisect_left(self.firsts, wanted) - 1), bisect_right(self.firsts, wanted)):
            directory = self._directory(k)
            heads = [d[0] for d in directory]
            for _, offset, length in directory[max(0, bisect_left(heads, wanted) - 1):bisect_right(heads, wanted)]:
                rows = self._captures(self.files[k][1], offset, length)
                at = bisect_left(rows, wanted, key=lambda r: r[0])
                while at < len(rows) and rows[at][0] == wanted:
                    yield rows[at]
                    at += 1


def read_record(fs, path: str, offset: int, length: int) -> dict:
    with fs.open_input_file(path) as f:
        return parse(zlib.decompress(f.read_at(length, offset), 31))


def read(spark: SparkSession, wanted: DataFrame, folder: str, files: list, payloads: bool = False) -> DataFrame:
    """Records of ``wanted(entry)`` by way of the index: page_id, payload_bytes,
    payload_digest, record_type, refers_to and, if asked for, the payload (null
    for a revisit)."""
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, files)
        for batch in batches:
            yield _batch([tuple(c) for x in batch.column(0).to_pylist() for c in index.find(x)])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, f = "", None
        for batch in batches:
            found, held = [], 0
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if archive != name:
                    if f:
                        f.close()
                    name, f = archive, fs.open_input_file(f"{root}/{archive}")
                found.append(parse(zlib.decompress(f.read_at(length, offset), 31)))
                held += found[-1]["payload_bytes"] if payloads else 0
                if held > 32 << 20:
                    yield _records(found, payloads)
                    found, held = [], 0
            yield _records(found, payloads)
        if f:
            f.close()

    # equal entries are one look-up, which finds all their captures
    ordered = wanted.select("entry").distinct().repartitionByRange("entry").sortWithinPartitions("entry")
    captures = ordered.mapInArrow(look_up, CAPTURE)
    # an archive holds ARCHIVE bytes at most, whatever a key or host holds
    captures = captures.repartition("archive").sortWithinPartitions("archive", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return captures.mapInArrow(fetch, schema + (", payload binary" if payloads else ""))


def _records(found: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in kinds.items()], list(kinds))


def archive_and_read(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write, index and read back all ``pages``, a row for each row."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = build_index(write(pages, folder), folder)
    wanted = pages.select(entry(F.col("url"), F.col("page_id").cast("long")).alias("entry"))
    return read(spark, wanted, folder, files, payloads)
