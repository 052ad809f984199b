"""Binary word vectors: every byte range, odd entries, and fastText subwords by hand."""

import struct

import numpy as np
import pytest

from lexmesh.sources import binary_vectors as B
from lexmesh.sources.store import vectors_from_text


def vectors(n=300, dim=7, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" if k % 3 else f"größe-{k}" + "x" * (k % 40) for k in range(n)]
    vecs = rng.normal(size=(n, dim)).astype("<f4")
    # floats whose bytes look like spaces, line feeds and letters
    vecs[::5] = np.frombuffer(b" \nab" * dim, "<f4")
    vecs[1::7] = np.frombuffer(b"    " * dim, "<f4")
    return words, vecs


def word2vec(path, words, vecs, feed):
    with open(path, "wb") as f:
        f.write(f"{len(words)} {vecs.shape[1]}\n".encode())
        for w, v in zip(words, vecs):
            f.write(w.encode() + b" " + v.tobytes() + (b"\n" if feed else b""))


@pytest.mark.parametrize("feed", [True, False])
@pytest.mark.parametrize("range_bytes", [33, 500, 4096, 1 << 20])
def test_every_entry_is_in_one_range(tmp_path, monkeypatch, feed, range_bytes):
    monkeypatch.setattr(B, "MAX_WORD", 64)
    words, vecs = vectors()
    path = str(tmp_path / "v.bin")
    word2vec(path, words, vecs, feed)
    got = [r for part in B.word2vec_ranges(path, range_bytes) for r in B.word2vec_rows(part)]
    assert [w for w, _ in got] == words
    assert all(np.array_equal(a.view("i4"), b.view("i4")) for (_, a), b in zip(got, vecs))


def test_word2vec_source_equals_the_text_form(spark, tmp_path):
    words, vecs = vectors(900, 16)
    vecs = np.nan_to_num(vecs)
    word2vec(str(tmp_path / "v.bin"), words, vecs, True)
    (tmp_path / "v.txt").write_text("".join(w + " " + " ".join(map(repr, map(float, v))) + "\n" for w, v in zip(words, vecs)))
    got = B.vectors_from_word2vec(spark, str(tmp_path / "v.bin"), range_bytes=6000)
    assert got.rdd.getNumPartitions() > 5
    want = vectors_from_text(spark, str(tmp_path / "v.txt"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    picked = B.load_vectors(spark, str(tmp_path / "v.bin"), "word2vec", spark.createDataFrame([("w1",), ("none",)], "word string"))
    assert [r.word for r in picked.collect()] == ["w1"]


def test_written_folder_reads_back(spark, tmp_path):
    rows = [(f"wort{k}", [float(k), .5, -2.0]) for k in range(50)]
    df = spark.createDataFrame(rows, "word string, vec array<double>").repartition(4)
    B.write_word2vec(df, str(tmp_path / "out"))
    B.write_word2vec(df.limit(0), str(tmp_path / "none"))
    assert len(B.files_of(str(tmp_path / "out"))) == 4
    assert sorted(map(tuple, B.vectors_from_word2vec(spark, str(tmp_path / "out")).collect())) == sorted(rows)
    assert B.vectors_from_word2vec(spark, str(tmp_path / "none")).count() == 0


def fasttext(path, words, labels, matrix, bucket=20, minn=2, maxn=3):
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", 793712314, 12))
        f.write(struct.pack("<12i", matrix.shape[1], 5, 5, 1, 5, 1, 1, 1, bucket, minn, maxn, 100) + struct.pack("<d", 1e-4))
        f.write(struct.pack("<iiiqq", len(words) + len(labels), len(words), len(labels), 999, -1))
        for k, w in enumerate(words + labels):
            f.write(w.encode() + b"\0" + struct.pack("<qb", 10 - k % 9, k >= len(words)))
        f.write(struct.pack("<?qq", False, *matrix.shape) + matrix.astype("<f4").tobytes())
        f.write(struct.pack("<?qq", False, 0, 0))


def test_fasttext_words_known_and_unknown(spark, tmp_path):
    words, bucket, dim = ["haus", "häuser", "</s>", "a"] + [f"w{k}" for k in range(40)], 20, 3
    matrix = np.random.default_rng(1).normal(size=(len(words) + bucket, dim)).astype("<f4").astype("f8")
    path = str(tmp_path / "m.bin")
    fasttext(path, words, ["__label__x"], matrix, bucket)
    rows = sorted(map(tuple, B.read_binary(spark, path, "fasttext", range_bytes=90).select("row", "word", "vec").collect()))
    assert [r[1] for r in rows] == words + [None] * bucket and np.allclose([r[2] for r in rows], matrix)

    def by_hand(word):
        text = f"<{word}>"
        grams = [text[i:i + n] for i in range(len(text)) for n in (2, 3) if i + n <= len(text)]
        hashes = []
        for g in grams:
            h = np.uint32(2166136261)
            with np.errstate(over="ignore"):
                for b in g.encode():
                    h = np.uint32(h ^ np.uint32(np.int8(np.uint8(b)).astype(np.int32).view(np.uint32))) * np.uint32(16777619)
            hashes.append(len(words) + int(h) % bucket)
        return np.mean([matrix[k] for k in ([words.index(word)] if word in words else []) + hashes], axis=0)

    known = {r.word: r.vec for r in B.load_vectors(spark, path, "fasttext").collect()}
    assert sorted(known) == sorted(words) and all(np.allclose(known[w], by_hand(w)) for w in words)
    asked = spark.createDataFrame([("haus",), ("Unbekannt",), ("ß",), (None,), ("haus",)], "word string")
    got = {r.word: r.vec for r in B.load_vectors(spark, path, "fasttext", asked).collect()}
    assert sorted(got) == ["Unbekannt", "haus", "ß"] and all(np.allclose(got[w], by_hand(w)) for w in got)


def test_hash_of_the_empty_text_and_of_one_byte():
    assert B.ngram_hash(b"") == 2166136261 and B.ngram_hash(b"a") == 0xE40C292C


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"no vectors here\n" * 9)
    for kind in B.KINDS:
        with pytest.raises(Exception, match="not a"):
            B.read_binary(spark, str(tmp_path / "x"), kind).collect()
    with pytest.raises(ValueError):
        B.load_vectors(spark, str(tmp_path / "x"), "glove")
    with pytest.raises(Exception, match="FileNotFound"):
        B.read_binary(spark, str(tmp_path / "missing"), "word2vec").collect()
