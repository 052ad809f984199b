import math
import re

from lexmesh.llm import mixing as op


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the cap, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows():
    out = []
    for s, n in (("a", 300), ("b", 40), ("ä", 90), ("Z", 5), (None, 60), ("z", 200)):
        out += [(len(out) + i, " ".join(["w x"] * (i * 37 % 90)), s, "other", i) for i in range(n)]
    out += [(None, "two words", "a", "x", 1), (None, None, "b", None, 2), (3, "same", "a", "x", 1), (3, "same", "a", "x", 1),
            (9000, "", "empty", "x", 0), (9001, None, "empty", "x", 0), (9002, "long " * 5000, "z", "x", 0)]
    return out


SCHEMA = "doc_id long, text string, source string, key string, size int"


def test_copies_follow_targets(spark):
    data = rows()
    got = op.copies(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    size = {}
    for _, t, s, *_ in data:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(size)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and math.isclose(r.target, want[s], abs_tol=1e-6) for r in mine)
        longest = max(r.size for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - want[s]) <= longest + 1e-6
        rate = want[s] / size[s] if size[s] else 0
        assert all(math.floor(rate) <= r.copies <= math.ceil(rate) <= 3 for r in mine)


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    mixed, taken = op.mix(df), op.copies(df)
    assert mixed.columns == df.columns
    assert mixed.count() == taken.agg({"copies": "sum"}).first()[0]
    again = op.copies(df.repartition(7)).agg({"copies": "sum"}).first()[0]
    assert again == mixed.count()
    count = mixed.where("doc_id = 9002").count()
    assert count == taken.where("doc_id = 9002").first().copies


def test_runs_no_python(spark):
    plan = op.copies(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.copies(df).count() == 0 and op.mix(df).count() == 0


def test_many_sources_and_repeated_rows_need_no_single_task(spark):
    sizes = spark.createDataFrame([(f"s{k:04}", f"{k:04}", (k * 7919) % 1000) for k in range(700)],
                                  "key string, source string, source_size long")
    found = op.targets(sizes)
    got = {r.key: r.target for r in found.collect()}
    want = brute_targets({f"{k:04}": (k * 7919) % 1000 for k in range(700)})
    assert all(abs(got["s" + k] - v) < 1e-6 * max(1, v) for k, v in want.items()) and len(got) == 700
    row = (1, "one two three", "a")
    df = spark.createDataFrame([row] * 3000 + [(2, "four", "b")], "doc_id long, text string, source string")
    mixed = op.mix(df)
    assert mixed.count() == op.copies(df).agg({"copies": "sum"}).first()[0]
    for plan in (found, mixed):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in text
    # windows without partition see a row for each range, not for each source
    for w in re.findall(r"Window \[.*", found._jdf.queryExecution().optimizedPlan().toString()):
        assert "_part#" in w
