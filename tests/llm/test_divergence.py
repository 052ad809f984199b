import re
from collections import Counter, defaultdict

from lexmesh.llm import divergence as op

SCHEMA = "doc_id long, text string, lang string, source string, term string, gid int"


def brute(rows, min_docs=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum((ps[s][t] - ps[o][t]) ** 2 // (ps[s][t] + ps[o][t]) for t in kept), o.encode(), o)
                     for o in sources if o != s]
            terms = [(-((ps[s][t] - q[t]) ** 2 // (ps[s][t] + q[t])), t.encode(), t)
                     for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def rows():
    words = "Haus haus HAUS maison Ärger ärger it's a-b x1y ñandú × 東京 dog cat".split()
    out = []
    for i in range(240):
        text = " ".join(words[(i * k * k + k) % len(words)] for k in range(i * 7 % 30))
        out.append((i, text, ["de", "fr", None][i % 3], ["s1", "ß", None, "Z", ""][i * i % 5], "clash", i))
    out += [(1, None, "de", "s1", None, 0), (None, "", "xx", "only", None, 0), (None, "haus dog", "zz", "a", "b", 1),
            (7, "rare words once", "zz", "b", "b", 1), (9, "cat " * 400_000 + "verylong" * 200_000, "de", "Z", "x", 2)]
    return out + out[:20]


def test_divergences_equal_brute_force(spark):
    got = op.divergences(spark.createDataFrame(rows(), SCHEMA).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows())


def test_spills_change_nothing(spark):
    df = spark.createDataFrame(rows()[:120], SCHEMA).repartition(3)
    assert sorted(map(tuple, op.divergences(df, min_docs=2, top=3, held=4).collect())) == brute(rows()[:120], 2, 3)


def test_empty_table_and_no_kept_term(spark):
    assert op.divergences(spark.createDataFrame([], SCHEMA)).collect() == []
    few = [(1, "a b", "de", "x", "", 0), (2, "c", "de", "y", "", 0)]
    assert sorted(map(tuple, op.divergences(spark.createDataFrame(few, SCHEMA)).collect())) == brute(few)


def test_term_pieces_cut_between_terms():
    text = b"aB c" * 700_000 + b"\xc3\xa4" * 900_000 + b" end"
    assert [t for part in op.term_lists(text) for t in part] == text.lower().split()


def test_shares_are_exact_beyond_a_long(spark):
    big = [(0, 10**13, 5), (8 * 10**12, 10**13, 10**7), (123456789012, 15 * 10**12, 10**6)]
    got = spark.createDataFrame(big, "n long, total long, terms long").select(op.share("n", "total", "terms")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in big]
