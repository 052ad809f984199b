import random
import zlib

from lexmesh.llm import langid as op
from lexmesh.llm.common import table

SCHEMA = "doc_id long, text string, lang string, score string"


def rows(n=400):
    rng = random.Random(8)
    words = {"aa": ["lorum", "ipsen", "dolar", "sittam"], "bb": ["krach", "wumms", "zisch", "bumm"], "cc": ["élan", "où", "çave", "été"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(words))
        out.append((i, " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.randint(3, 200))), lang, "x"))
    return out


def test_learns_and_defines_every_row(spark):
    data = rows() + [(1001, None, "aa", ""), (1002, "", "bb", ""), (1003, "12 !? 3", "cc", ""), (None, "krachwumms " * 9, None, None)]
    got = op.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i in (1001, 1002, 1003):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[None].lang_pred == "bb" and not by[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    right = [by[i].lang_pred == lang for i, _, lang, _ in data[:400] if by[i].held_out]
    assert sum(right) > 0.97 * len(right)


def test_held_out_rows_teach_nothing(spark):
    data = [(i, "abc " * 20, "en", "") for i in range(40)]
    taught = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = op.sample(spark.createDataFrame(data, SCHEMA)).count()
    assert got == len(taught)


def test_margin_rejects_and_keep_passes_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert op.identify(df, min_margin=1.1).where("NOT rejected").count() == 0
    assert op.keep_identified(df, 1.1).count() == 0
    kept = op.keep_identified(df)
    assert kept.columns == df.columns and kept.count() > 380


def test_accuracy_on_held_out_documents(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = op.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    total = got.count()
    assert total > 100 and got.where("lang = lang_pred").count() >= 0.95 * total


def test_empty_table_and_no_labels(spark):
    assert op.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "word", None, "")], SCHEMA)
    assert op.identify(df).first().lang_pred == "und"


def test_sample_is_bounded_by_rows_of_repeated_ids(spark):
    data = [(i % 4, f"words of text {i}", "en", "") for i in range(3000)] + [(i, f"mots du texte {i}", "fr", "") for i in range(40)]
    got = op.sample(spark.createDataFrame(data, SCHEMA), 20).collect()
    assert [sum(r.lang == x for r in got) for x in ("en", "fr")] == [20, 20]


def test_und_is_for_texts_without_a_letter(spark):
    for text in ("½ ² ①", "Ⅷ", "12 ٣", "\u0301\u0301", "_ - 😀", ""):
        assert op.plain(text) == ""
    assert op.plain("हिन्दी भाषा") == "हिन्दी भाषा" and op.plain("कि½तु") == "कि तु"
    assert op.plain("A1b É_ß ١ق") == "a b é ß ق"
    texts = ["½ ² ①", "Ⅷ", "हिन्दी भाषा", "e"]
    df = spark.createDataFrame(rows() + [(5000 + k, t, None, "") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in op.identify(df).collect()}
    assert got[5000] == got[5001] == "und" and "und" not in (got[5002], got[5003])


def test_sizes_equal_plain_compression():
    """Each block compressed on its own with each language's raw dictionary."""
    import zstandard
    content = {"aa": b"lorum ipsen dolar " * 300, "bb": b"krach wumms zisch " * 300, "cc": "élan où çave ".encode() * 200}
    classifier, rng = op.Classifier(content), random.Random(2)
    for n in (1, 50, 700, 30_000):  # the last one spans many blocks
        clean = op.plain(" ".join(rng.choice(["lorum", "krach", "élan", "zisch", "dolar"]) for _ in range(n)))
        data, want = clean.encode(), []
        for lang, words in content.items():
            settings = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=3,
                write_content_size=False, write_checksum=False, write_dict_id=False)
            total, at = 0, 0
            while at < len(data):
                d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=settings)
                total += len(zstandard.ZstdCompressor(compression_params=settings, dict_data=d).compress(data[at:at + op.BLOCK]))
                at += op.BLOCK
            want.append((total, lang))
        assert classifier.sizes(clean) == sorted(want)


def test_very_long_text(spark):
    df = spark.createDataFrame(rows() + [(7000, "krachwumms zischbumm " * 200_000, None, "")], SCHEMA)
    assert op.identify(df).where("doc_id = 7000").first().lang_pred == "bb"
