import random
import struct
import zlib

from tokenizers import Tokenizer

from lexmesh.llm import packing as op

SCHEMA = "doc_id long, text string, length int, piece string"


def texts():
    rng = random.Random(6)
    words = ["the", "Ünder", "12,5", "it's", "a\nb", "", " ", " x", "<|endoftext|>", "x<|endoftext|>y", "日本 語", "\x1c", "\t"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 400, 3000]))) for _ in range(60)]
    return [None, "", " ", "  two  gaps ", " lead", "trail ", "a" * 70_000 + " <|endoftext|>" + "b1" * 40_000, *out]


def test_ids_equal_the_tokenizer():
    path = op.tokenizer_path()
    t, e = Tokenizer.from_file(path), op.Encoder(path)
    plain = [x or "" for x in texts()]
    want = [x.ids for x in t.encode_batch(plain, add_special_tokens=False)]
    for _ in range(2):
        got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in e.encode(plain)]
        assert got == want


def test_ids_equal_the_tokenizer_on_any_text():
    path = op.tokenizer_path()
    t, e, rng = Tokenizer.from_file(path), op.Encoder(path), random.Random(31)
    assert e.merges is not None
    common = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x20A0, 0x20C0),
                               0x1F600, 0x1F64F]]
    assert not op.RARE.search("".join(common))
    plain = ["".join(rng.choices(common, k=rng.choice([1, 3, 30]))) for _ in range(20_000)]
    letters = "etaoinshrdlucmfwypvbgkqjxzéüß'  .,\n"
    plain += ["".join(rng.choices(letters, k=rng.choice([2, 12, 200]))) for _ in range(20_000)]
    plain += ["".join(rng.choices(letters[:8], k=9)) for _ in range(20_000)]
    plain += [w for w in t.get_vocab() if not op.RARE.search(w)]  # vocabulary entries as texts
    plain += ["a\u00a0b \u0085 \x1c\x0b x\u3000y हिन्दी 漢字 ١٢ \u200b", "\ud7ff", "<|endoftext|>", "a <|endoftext|>b"]
    want = [x.ids for x in t.encode_batch_fast(plain, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in e.encode(plain)] == want


def test_other_vocabularies_go_to_the_tokenizer(tmp_path):
    import json
    said = json.load(open(op.tokenizer_path()))
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(said))
    e = op.Encoder(str(tmp_path / "t.json"))
    assert e.merges is None
    assert list(struct.unpack("<1I", e.encode(["the"])[0])) == e.tokenizer.encode(" the", add_special_tokens=False).ids


def test_pieces_and_places(spark):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts())] + [(None, "one", 1, None), (5, "again", 1, ""), (5, "again", 1, "")]
    cut = op.pieces(spark.createDataFrame(rows, SCHEMA), with_ids=True)
    t = Tokenizer.from_file(op.tokenizer_path())
    want = {}
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[i, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] = ids
    docs = {}
    packed = op.pack(cut, group=40).collect()
    assert len(packed) == cut.count()
    seen = {}
    for r in packed:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.piece), []).append(r)
    for spans in seen.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for (i, _), ids in want.items():
        mine = sorted((r for (d, _), rs in docs.items() if d == i for r in rs), key=lambda r: r.piece)
        if i not in (5, None):
            assert [x for r in mine for x in r.ids] == ids
            assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
            assert all(r.length == 1024 for r in mine[1:])


def test_best_fit_matches_a_plain_search():
    rng = random.Random(7)
    lengths = sorted((rng.randint(1, 1024) for _ in range(3000)), reverse=True)
    room, plain = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            k = min(fits)[1]
        else:
            room.append(1024)
            k = len(room) - 1
        room[k] -= n
        plain.append(k)
    placed = op.best_fit(lengths)
    assert len({s for s, _ in placed}) == len(room)
    used = {}
    for n, (s, at) in zip(lengths, placed):
        assert at == used.get(s, 0)
        used[s] = at + n
    assert sorted(1024 - u for u in used.values()) == sorted(room)


def test_empty_table(spark):
    assert op.pack(op.pieces(spark.createDataFrame([], SCHEMA))).count() == 0
