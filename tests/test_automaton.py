"""The one-pass cleaner gives what the chain of replacements gives, for any rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmesh.functions import automaton as A
from lexmesh.functions.rules import DEFAULT_RULES
from lexmesh.functions.text import apply_rules, chain_rules, plain_rules

SMALL = "ab-."
LITERALS = st.tuples(st.just("literal"), st.text(SMALL, min_size=0, max_size=4), st.text(SMALL, max_size=4))
PATTERNS = st.sampled_from(["a+b", "[ab]-", "(ab)?-a", "^a", r"\.{2}", "a|b", "[^a]b", "ab{1,2}", "b?a-", "(a|b)-"])
REGEXES = st.tuples(st.just("regex"), PATTERNS, st.text(SMALL, max_size=3))


def chain(rules, text):
    for kind, find, to in rules:
        if kind == "literal":
            text = text.replace(find, to) if find else text
        else:
            text = re.sub(find, lambda _: to, text)
    return text


@settings(max_examples=1500, deadline=None)
@given(st.lists(LITERALS | REGEXES, max_size=12), st.lists(st.text(SMALL, max_size=24), max_size=4))
def test_one_pass_equals_the_chain(rules, texts):
    assert all(A.portable(r) for r in rules)
    apply = A.RulePass(rules)
    for text in texts:
        assert apply(text) == chain(rules, text)


@settings(max_examples=500, deadline=None)
@given(PATTERNS, st.text(SMALL, max_size=20))
def test_needle_is_part_of_every_match(pattern, text):
    needle = A.needle(("regex", pattern, ""))
    assert all(needle in m[0] for m in re.finditer(pattern, text))


def test_needles_of_the_default_rules():
    found = {r[1]: A.needle(r) for r in plain_rules(DEFAULT_RULES) if r[0] == "regex"}
    assert found["[Aa]+ber"] == "ber" and found[r"^\.{3}"] == "..." and found[r"5 [Mm]rd\.?"] == "5 "
    assert [len(run) for ok, run in A.passes(plain_rules(DEFAULT_RULES)) if ok] == [len(plain_rules(DEFAULT_RULES))]


def test_patterns_that_dialects_read_differently_stay_in_spark():
    for find in (r"\d", r"\bx", "(?i)x", "a.c", "x$", "x*", "(a)?", "", "[a&&b]", "a++", "(?=x)", r"\p{L}", "[[a]b]", "a{2"):
        assert not A.portable(("regex", find, "")), find
    assert not A.portable(("regex", "a(b)", "$1")) and not A.portable(("regex", "a", "\\\\"))
    assert A.portable(("literal", "a.c$", "$1"))


def test_column_equals_the_chain_in_spark(spark):
    rules = [("literal", "<NUM>", "5"), ("regex", r"5 [Mm]rd\.?", "5 Milliarden"), ("urls", "", ""), ("literal", "CDU", "Partei"),
             ("regex", r"\d+", "#"), ("literal", "ParteiCSU", "x"), ("literal", "", "never"), ("literal", "ä", "ae"),
             ("regex", "(P)artei", "$1"), ("literal", "-", " ")] + list(DEFAULT_RULES)
    texts = ["...<NUM> Mrd. CDUCSU 12-13", "www.x.de ... <a href=\"y\" rel=\"z\">t</a>", "", None, "Aaaber äöü D-Mark",
             "Angela Merkel, GroKo xcx", "ÖCDUDP", "a\x00b " * 50_000 + "AFD", "  5 mrd 5\\xc5\\x5 ", "Ihr Mann 😀 CDU"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, clean string")
    for n in (1, 3, 8, 1000):
        rows = df.select(apply_rules("text", rules, n).alias("one"), chain_rules("text", rules).alias("many")).collect()
        assert [r.one for r in rows] == [r.many for r in rows]
    assert rows[3].one is None


def test_column_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seeded = docs.withColumn("text", F.concat_ws(" CDU-", "text", "text"))
    wrong = seeded.where(~apply_rules("text", DEFAULT_RULES).eqNullSafe(chain_rules("text", DEFAULT_RULES)))
    assert wrong.count() == 0


def test_rule_kinds_are_checked():
    try:
        plain_rules([("other", "a", "b")])
    except ValueError as e:
        assert "other" in str(e)
    else:
        raise AssertionError
