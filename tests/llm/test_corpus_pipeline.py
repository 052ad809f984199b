import corpus_pipeline as P
from lexmesh.llm import langid, mixing
from lexmesh.llm.common import table
from test_packing import op as packing
from test_simhash import brute_components, slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(10_000 + r[0], r[1], r[2], r[3], r[4]) for r in rows[:20]]
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "src0", 0), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA)
    names, stages = zip(*P.STAGES)
    assert names == ("language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing")

    now = stages[0](spark, docs, sf).persist()
    classifier = langid.Classifier(langid.dictionaries(langid.sample(docs)))
    want = [r for r in rows if not classifier.predict(r[1])[2]]
    assert now.columns == docs.columns and sorted(map(tuple, now.collect())) == sorted(want)
    assert len(want) > 0.95 * (len(rows) - 2)

    now = stages[1](spark, now, sf).persist()
    best = {}
    for r in want:
        best[r[1]] = max(best.get(r[1], r), r)
    want = list(best.values())
    assert now.columns == docs.columns and sorted(map(tuple, now.collect())) == sorted(want)

    now = stages[2](spark, now, sf).persist()
    fps = {r[0]: slow_fingerprint(r[1]) for r in want}
    root = brute_components(fps.values(), 3)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    want = [r for r in want if r[0] in least.values()]
    assert now.columns == docs.columns and sorted(map(tuple, now.collect())) == sorted(want)

    copies = {r.doc_id: r.copies for r in mixing.copies(now).collect()}
    now = stages[3](spark, now, sf).persist()
    want = [r for r in want for _ in range(copies[r[0]])]
    assert now.columns == docs.columns and sorted(map(tuple, now.collect())) == sorted(want)

    packed = stages[4](spark, now, sf).collect()
    encoder = packing.Encoder(packing.tokenizer_path())
    ids = [len(x) // 4 + 1 for x in encoder.encode([r[1] for r in want])]
    assert sum(r.length for r in packed) == sum(ids)
    assert len(packed) == sum(-(-n // 1024) for n in ids)
    assert len({r.sequence_id for r in packed}) <= 1.05 * sum(ids) / 1024 + 2


def test_run_goes_through_all_stages(spark, tmp_path):
    words = ["zwei drei vier", "uno dos tres", "one two three"]
    rows = [(i, f"{words[i % 3]} " * (5 + i), ["de", "es", "en"][i % 3], f"s{i % 4}", 0) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_any_name(spark):
    """Names that the stages use themselves, in either case, and names with signs."""
    extra = ["_id", "_KEY", "_row", "_times", "_Source", "_text", "_sha", "_nth", "_lang_pred", "_score", "_REJECTED",
             "alone", "text_key", "copies", "a.b", "c`d", "component_id", "kept"]
    words = ["zwei drei vier", "uno dos tres", "one two three"]
    rows = [(i, f"{words[i % 3]} " * (5 + i // 2), ["de", "es", "en"][i % 3], f"s{i % 4}", 0) for i in range(60)]
    rows += [rows[5], rows[5], (None, "no id here " * 9, "en", None, 0)]
    schema = SCHEMA + "".join(f", `{c.replace('`', '``')}` string" for c in extra) + ", tags map<string,int>"
    full = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in extra), {"k": 1}) for r in rows], schema)
    bare = spark.createDataFrame(rows, SCHEMA)
    for name, stage in P.STAGES[:-1]:
        got, plain = stage(spark, full, ""), stage(spark, bare, "")
        assert got.columns == full.columns, name
        found = [r.asDict() for r in got.collect()]
        for r in found:
            assert all(r[c] == f"{c} {r['doc_id']}" for c in extra) and r["tags"] == {"k": 1}, name
        assert sorted(r["doc_id"] or -1 for r in found) == sorted(r.doc_id or -1 for r in plain.collect()), name
    P.STAGES[-1][1](spark, full, "").count()
