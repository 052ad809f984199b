import gzip
import hashlib
import random

import pytest

from lexmesh.llm import warc as op

SCHEMA = "page_id long, url string, html string, entry string, refers_to int"


def rows():
    rng = random.Random(11)
    bodies = [None, "", "x" * 99, "x" * 100, "é" * 60, "<p>line\r\n\r\nWARC/1.1\r\n</p>" * 20, "y" * 400_000]
    urls = [None, "", "https://www.Example.org:80/a?b=1#c", "http://b.example.net/ü x\n", "http://same.example.org/", "not a url"]
    out = [(i, rng.choice(urls), rng.choice(bodies), "e", 1) for i in range(200)]
    return out + [(3, "http://twice/", "x" * 100, None, None)] * 2 + [(None, "http://none/", "x" * 100, "", 0),
                                                                     (None, None, "only here " * 20, "", 0)]


def brute(data):
    first = {}
    for i, _, h, *_ in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, *_ in data:
        b, f = (h or "").encode(), first.get(h or "")
        revisit = len(b) >= 100 and f is not None and (i is None or i > f)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip_matches_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = op.archive_and_read(df, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows())
    full = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h, *_ in rows()}
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or bytes(r.payload) == full[r.payload_digest]


def test_archives_and_index_stand_alone(spark, tmp_path):
    data = [(i, f"http://h{i % 7}.example.org/{i % 40}", f"<p>{i % 90}</p>" * 30, "", 0) for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA)
    folder = f"file://{tmp_path}"
    captures = op.write(df, folder)
    files = op.build_index(captures, folder, block=7)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == 500
    index = op.Index(folder, files)
    fs, root = op.filesystem(folder)
    for r in captures.collect():
        found = list(index.find(r.entry))
        assert [c[1] for c in found] == [r.page_id]
        assert op.read_record(fs, f"{root}/{found[0][2]}", *found[0][3:])["page_id"] == r.page_id
    assert list(index.find("org,example,h9)/none 0")) == [] and list(index.find("")) == [] and list(index.find("~")) == []


def test_equal_entries_over_many_blocks(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "z", "", 0)] * 50 + [(2, "http://a/", "z", "", 0)], SCHEMA)
    folder = f"file://{tmp_path}"
    files = op.build_index(op.write(df, folder), folder, block=3)
    wanted = df.select(op.entry(df.url, df.page_id).alias("entry"))
    assert op.read(spark, wanted, folder, files).count() == 51


def test_a_broken_payload_is_noticed():
    data = op.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert op.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        op.parse(data.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty_table(spark):
    assert op.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0
