import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmesh.llm import spelling as op

SCHEMA = "doc_id long, text string, word string, n int, root string"


def brute_counts(rows, min_chars=5, damage=97):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, damage=97):
    n = {w: k for w, k in brute_counts(rows, damage=damage).items() if k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def rows(seed=1):
    draw = random.Random(seed)
    base = ["straße", "houses", "banane", "maison", "forêt", "bananen", "abcde", "lettre", "Garçon", "naïveté"]
    words = []
    for w in base:
        words += [w] * 40
        for _ in range(25):
            k, c = draw.randrange(len(w)), draw.choice("abeé×ÿZ")
            v = draw.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])
            words += [v] * draw.choice([1, 2, 3, 4, 9])
            if draw.random() < .3:
                words += [v[:k] + c + v[k:]] * 3
    draw.shuffle(words)
    out = [(i, " ".join(words[i * 7:i * 7 + 7]) + "-", "clash", i, None) for i in range(len(words) // 7)]
    huge = "xy" * 3_000
    out += [(None, "bananen, bananen; bananeN", None, 0, ""), (4, None, "", None, ""), (5, "", "", 0, ""),
            (6, "maison " * 300_000, "", 0, "")]
    out += [(70 + k, huge + ("z" if k > 4 else ""), "", 0, "") for k in range(9)]
    return out + out[:9]


def test_variants_equal_brute_force(spark):
    data = rows()
    for damage in (97, 5):
        got = op.variants(spark.createDataFrame(data, SCHEMA).repartition(6), damage=damage)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        got = sorted(map(tuple, got.collect()), key=lambda r: r[0])
        assert got == brute(data, damage)
    assert any(r[2] not in (r[0], r[1]) for r in got), "a chain of forms is among the data"


def test_spills_change_nothing(spark):
    df = spark.createDataFrame(rows(2), SCHEMA).repartition(3)
    small = {r.word: r.n for r in op.word_counts(df, held=3).collect()}
    assert small == {w: n for w, n in brute_counts(rows(2)).items()}


def test_empty_table(spark):
    assert op.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs_on_dense_words(spark):
    """A small alphabet, so that many words share each key."""
    words = sorted({"".join(random.Random(k).choices("ab", k=5 + k % 3)) for k in range(400)})
    for compared in (op.COMPARED, 50):  # the second one salts every key
        got = op.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), compared).collect()
        assert len(got) == len({frozenset((r.a, r.b)) for r in got})
        assert {frozenset((r.a, r.b)) for r in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


@settings(max_examples=200, deadline=None)
@given(st.text("abÀ- .Z×", max_size=60))
def test_runs_are_maximal(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    want = [r for r in re.findall("[a-zÀ-ÿ]+", low) if len(r) >= 3]
    old, op.PIECE = op.PIECE, 4
    try:
        assert [r for part in op.runs(low, 3) for r in part] == want
    finally:
        op.PIECE = old
