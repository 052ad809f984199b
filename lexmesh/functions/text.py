"""String expressions: wildcard strip, URL removal, rule-table cleaning, keys."""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions.automaton import RulePass, passes

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# Token pattern used for the letter tokenizer (Java regex; RE2 accepts it too).
LETTER_SPLIT = r"[^\p{L}]+"
# Whitespace separators used by the whitespace tokenizer.
WHITESPACE_SPLIT = r"[ \t\n\r\f\x0b]+"
# Characters removed from lemmas before normalisation.
LEMMA_PUNCT = r"""[-.,#'"+~*=?!$§%&/()\[\]{}<>|^°_:\\;]"""
# Substrings that make a token unusable.
BAD_TOKEN_PARTS = ["xcx", "Xcx", "5"]
# Entity types dropped by the token filter.
DROPPED_ENTITIES = ["PER", "LOC"]
# Default part-of-speech tags kept by the token filter.
RELEVANT_POS = ["ADJ", "ADV", "NOUN", "VERB"]
# URL and HTML-anchor patterns of the URL cleaner (F1), applied in this order:
#   leading "..." dropped, other "..." -> ".", anchor dropped, url -> "<URL>", "</a>" dropped.
URL_PATTERN = r"(https?://)?www[1-9]?\.[^ ]"
URL_PATTERN_WHOLE = r"(https?://)?www[1-9]?\.[^ ]*"
ANCHOR_PATTERN = r'(<?a )?href="[^"]*"( rel="[^"]*")?( target="[^"]*")?>'
# ---------------------------------------------------------------------------

#: Runs of fewer rules stay a chain of Spark expressions.
ONE_PASS_FROM = 8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_wildcards(term) -> Column:
    """Remove every literal ``*``."""
    return F.regexp_replace(_c(term), r"\*", "")


def to_text(col) -> Column:
    """Force a value to a string."""
    return _c(col).cast("string")


def url_rules(whole_url: bool = False) -> list[tuple[str, str, str]]:
    """URL / anchor removal (F1) as rules."""
    return [("regex", r"^\.{3}", ""), ("regex", r"\.{3}", "."), ("regex", ANCHOR_PATTERN, ""),
            ("regex", URL_PATTERN_WHOLE if whole_url else URL_PATTERN, "<URL>"), ("literal", "</a>", "")]


def remove_urls(text, whole_url: bool = False) -> Column:
    """URL / anchor removal (F1); ``whole_url`` also drops the URL tail."""
    return chain_rules(text, url_rules(whole_url))


def plain_rules(rules) -> list[tuple[str, str, str]]:
    """The rules with ``urls`` written out; each is a ``literal`` or a ``regex``."""
    out = []
    for kind, find, repl in rules:
        if kind not in ("literal", "regex", "urls"):
            raise ValueError(f"unknown rule kind {kind!r}")
        out += url_rules() if kind == "urls" else [(kind, find, repl)]
    return out


def chain_rules(text, rules) -> Column:
    """An ordered rule list as a chain of Spark expressions, one read of the
    text for each rule."""
    t = _c(text)
    for kind, find, repl in plain_rules(rules):
        t = F.replace(t, F.lit(find), F.lit(repl)) if kind == "literal" else F.regexp_replace(t, find, repl)
    return t


def apply_rules(text, rules, one_pass_from: int = ONE_PASS_FROM) -> Column:
    """An ordered rule list as one Column expression (F2).

    ``rules`` is a sequence of ``(kind, find, replace)`` with kind ``literal``
    (substring replace), ``regex`` or ``urls``.  Each rule sees the previous
    output.  Runs of ``one_pass_from`` or more rules are applied in one pass per
    text by an automaton (see :mod:`lexmesh.functions.automaton`), in Arrow
    batches; the result is that of :func:`chain_rules`."""
    t = _c(text)
    for one_pass, run in passes(plain_rules(rules)):
        t = _one_pass(run)(t) if one_pass and len(run) >= one_pass_from else chain_rules(t, run)
    return t


def _one_pass(rules):
    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        apply = RulePass(rules)
        return pa.array([None if t is None else apply(t) for t in texts.to_pylist()], pa.string())
    return clean


def split_key(key) -> tuple[Column, Column]:
    """``"cat:term"`` -> (cat, term), split at the first ``:`` only."""
    parts = F.split(_c(key), ":", 2)
    return parts.getItem(0), parts.getItem(1)


def capitalize(word) -> Column:
    """Python ``str.capitalize``: first character title-cased, rest lower.
    Title case differs from upper case for a leading ``ß`` (-> ``Ss``)."""
    w = _c(word)
    first = F.substring(w, 1, 1)
    head = F.when(first == "ß", F.lit("Ss")).otherwise(F.upper(first))
    return F.concat(head, F.lower(F.substring(w, 2, 1 << 30)))


@lru_cache(maxsize=None)
def german_stopwords() -> tuple[str, ...]:
    """The German stopword list of Apache Spark ML (the words of
    ``StopWordsRemover.loadDefaultStopWords("german")``), shipped as a data
    file of this package so that Spark and the oracle SQL read the same list
    without a JVM.  Read on first use, on the driver only."""
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "german_stopwords.txt")
    with open(path, encoding="utf-8") as f:
        return tuple(w.strip() for w in f if w.strip())
