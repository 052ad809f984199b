"""Ordered replacement rules in one pass per text (F2).

A chain of replacements reads the text once for every rule, though most rules
never occur in it.  Here an Aho-Corasick automaton over the rules' needles (the
text of a literal rule, the longest text that every match of a pattern holds)
reads a text once and tells which rules can act at all.  Those are applied in
order of the list.  A replacement may bring about the needle of a later rule;
which rules can do that to which is worked out once from the rule list, and
they join the ones still to be applied.  So the result is that of the chain
for every rule list:

* a rule whose needle does not occur when its turn comes changes nothing;
* a needle that was not in the text before overlaps a replacement made since,
  so the rule that made it has the needle's rule among its successors.

Patterns run here only if both regular-expression dialects (Java's, which
Spark has, and Python's) read them alike; ``portable`` decides.  Any others
stay Spark expressions at their place in the order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

Rule = tuple[str, str, str]

#: Parts of a portable pattern: an escaped sign, a class of plain characters and
#: ranges, a group's ends, an alternative, the start, or a plain character; then its count.
PART = re.compile(r"(?P<atom>\\[^A-Za-z0-9\s]|\[\^?(?:[^\\\[\]&^-]-[^\\\[\]&^-]|[^\\\[\]&^-])+\]|\((?!\?)|\)|\||\^|[^\\\[\](){}|^$.?*+])"
                  r"(?P<count>\{\d+(?:,\d*)?\}|[?*+])?")


def parts(pattern: str) -> list[tuple[str, str]] | None:
    """``(atom, count)`` of a pattern in the common subset, or None."""
    out, at = [], 0
    while at < len(pattern):
        found = PART.match(pattern, at)
        if found is None or found["count"] and found["atom"] in ("(", "|", "^"):
            return None
        out.append((found["atom"], found["count"] or ""))
        at = found.end()
    return out


def portable(rule: Rule) -> bool:
    """Both dialects give the same result; patterns that match nothing at all
    and replacements with references differ and are left out."""
    kind, find, to = rule
    if kind != "regex":
        return True
    if parts(find) is None or "\\" in to or "$" in to:
        return False
    try:
        return re.compile(find).search("") is None
    except re.error:
        return False


def needle(rule: Rule) -> str:
    """A text that is part of every match, as long as can be told; '' if none can."""
    kind, find, _ = rule
    if kind != "regex":
        return find
    best, run, depth = "", "", 0
    for atom, count in [*parts(find), (")", "")]:
        if atom == "|" and depth == 0:
            return ""
        depth += (atom == "(") - (atom == ")")
        plain = depth == 0 and (len(atom) == 1 and atom not in "()|^" or atom[0] == "\\")
        least = int(re.match(r"\{(\d+)", count)[1]) if count.startswith("{") else int(count in ("", "+"))
        if plain and least:
            run += atom[-1] * least
        if len(run) > len(best):
            best = run
        if not plain or count in ("?", "*") or count.startswith("{") and count != f"{{{least}}}":
            run = ""
        elif count == "+":
            run = atom[-1]
    return best


def may_make(to: str, wanted: str) -> bool:
    """Putting ``to`` into a text can bring about ``wanted`` where it was not."""
    if len(wanted) < 2:
        return wanted in to
    if wanted in to or to in wanted:
        return True
    return any(to.endswith(wanted[:k]) or to.startswith(wanted[-k:]) for k in range(1, len(wanted)))


class RulePass:
    """A rule list compiled for one pass; call it with a text."""

    def __init__(self, rules: Sequence[Rule]):
        import ahocorasick
        rules = [r for r in rules if r[1]]
        self.steps = [(re.compile(f).sub if kind == "regex" else None, f, to) for kind, f, to in rules]
        needles = [needle(r) for r in rules]
        # a set of rules is the bits of a number
        self.successors = [sum(1 << j for j in range(i + 1, len(rules)) if may_make(rules[i][2], needles[j]))
                           for i in range(len(rules))]
        self.always, self.short, of = 0, [], {}
        for i, text in enumerate(needles):
            if not text:
                self.always |= 1 << i
            elif len(text) == 1:
                self.short.append((text, 1 << i))
            else:
                of[text] = of.get(text, 0) | 1 << i
        self.automaton = ahocorasick.Automaton() if of else None
        for text, bits in of.items():
            self.automaton.add_word(text, bits)
        if of:
            self.automaton.make_automaton()

    def live(self, text: str) -> int:
        """The rules whose needles the text holds."""
        found = self.always
        if self.automaton is not None:
            for _, bits in self.automaton.iter(text):
                found |= bits
        for sign, bits in self.short:
            if sign in text:
                found |= bits
        return found

    def __call__(self, text: str) -> str:
        live = self.live(text)
        while live:
            i = (live & -live).bit_length() - 1
            live &= live - 1
            sub, find, to = self.steps[i]
            # a function gives the replacement as it stands, without escapes
            new = text.replace(find, to) if sub is None else sub(lambda _: to, text)
            if new != text:
                text = new
                live |= self.successors[i]
        return text


def passes(rules: Iterable[Rule]) -> Iterator[tuple[bool, list[Rule]]]:
    """Runs of rules in their order: ``(True, rules)`` for one pass, ``(False, [rule])``
    for a rule that only Spark's dialect may read."""
    run: list[Rule] = []
    for rule in rules:
        if portable(rule):
            run.append(rule)
            continue
        if run:
            yield True, run
        yield False, [rule]
        run = []
    if run:
        yield True, run
