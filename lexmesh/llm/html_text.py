"""HTML main-text extraction by a linear-chain conditional random field.

A page is read into leaf blocks: runs of text between block-level tags, in page
order, with the tags and the class, id and role words around them.  Scripts,
styles, comments, titles, form controls and other text that is not shown make
no block.  A block's features are its ancestors' tags, the sense of the innermost
telling ancestor, and its text (length, links, ending, digits, telling words).
A two-state chain (main or not) over the blocks of a page scores features and
transitions; Viterbi finds the best labelling, and main blocks are the text.

The chain is trained on labelled pages of the table itself.  A page counts as
labelled if it marks its article (one ``article`` or ``main`` element, or one of each
with one in the other); a block is main if it lies there, in the inner one of two, and
in nothing that the page marks as other.  The sample is bounded by ``SAMPLE_PAGES``
such pages, chosen by hash.
Each is learned from as it is, without its article marks, and without any marks,
so that pages without marks are judged by what is left.

A slash at the end of a tag closes it in SVG and MathML only, as in HTML; scripts and
other raw text end at their end tag.  Quoted attribute values are read whole, however long.  If a tag's quoted values
reach the page's end, it and all later tags end at their next ``>``.

Defined results: null html is an empty page; a page without main blocks gives an
empty text; without any labelled page nothing is main.  Character references are
decoded; white space inside a block becomes one space; blocks are joined by two
line feeds.  Repeated rows are returned each.  Null ids are returned as they are.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import smallest_hashes

SAMPLE_PAGES = 300
SAMPLE_CHARS = 200_000
STEPS, RATE, DECAY = 60, 0.3, 1e-4

# Tags, by what they do to the text.
UNSEEN = {"script", "style", "noscript", "template", "title", "iframe", "object", "svg", "math", "canvas", "textarea",
          "select", "button", "audio", "video", "map", "datalist"}
#: Of these, elements without tags inside: what has no end tag reaches the page's end.
RAW = {"script", "style", "title", "iframe", "textarea"}
#: One ends an open one of its kind.
SINGLE = {"select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag ends open elements of these kinds before it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Ends are sought no further out than these.
WALLS = {"table", "ul", "ol", "dl", "div", "section", "article", "body", "html"}

# Words of tags, classes, ids and roles, by what they tell of the text inside.
MAIN_SENSE = {"article", "main", "content", "post", "entry", "story", "body", "text"}
OTHER_SENSE = {"nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "header", "banner", "masthead", "footer",
               "contentinfo", "aside", "sidebar", "complementary", "widget", "notice", "cookie", "cookies", "consent",
               "popup", "modal", "alert", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo",
               "banner", "form", "search", "login", "signup", "subscribe", "newsletter", "comment", "comments", "reply",
               "replies", "respond", "disqus", "discussion", "share", "social", "related", "recommended", "pagination",
               "pager", "toolbar", "tags", "meta", "copyright", "legal", "fieldset"}
TELLING = re.compile(r"\b(cookies?|subscribe|sign (?:in|up)|log ?in|advertisement|sponsored|newsletter|all rights reserved|"
                     r"copyright|privacy policy|terms of|share this|related (?:posts|articles)|repl(?:y|ies)|comments?|"
                     r"posted by|read more|click here|menu|search)\b|©", re.I)

#: A comment (``<!-->`` is an empty one), or the start of a tag or declaration.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))", re.S)
#: The rest of a tag.  Quotes count after an equals sign only and hold a value of any length;
#: a quote that is never closed is a character like others.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
#: Elements in whose content a slash before the end of a tag closes it; elsewhere it means nothing.
FOREIGN = {"svg", "math"}
TOLD = {"class", "id", "role", "hidden", "style", "aria-hidden"}
WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")

#: An article's mark, and one of each kind with one in the other; read alike by Python and Spark.
MARK = r"(?i)<(?:article|main)[ \t\r\n\f>]"
NESTED = (r"(?is)<main[ \t\r\n\f>].*<article[ \t\r\n\f>].*</article.*</main|"
          r"<article[ \t\r\n\f>].*<main[ \t\r\n\f>].*</main.*</article")

Block = tuple[str, tuple[str, ...], tuple[str, ...], float]


def _words(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in TOLD:
            continue
        value = value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words.update(WORD.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return frozenset(words), hidden


def _slashed(attributes: str) -> bool:
    """A slash ends the tag, and is no part of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    *_, last = [None, *ATTRIBUTE.finditer(attributes)]
    return last is None or last.end() < len(attributes)


def _sense(tag: str, words: frozenset[str]) -> str:
    if tag in OTHER_SENSE or words & OTHER_SENSE:
        return "other"
    return "main" if tag in ("article", "main") or words & MAIN_SENSE else ""


def blocks(page: str) -> list[Block]:
    """``(text, ancestor tags, ancestors' senses, share of text in links)`` of each leaf block."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, sense, hidden
    held: list[str] = []
    linked = hidden = links = 0
    unseen: list[int] = []  # places of open unseen elements on the stack

    def flush() -> None:
        nonlocal linked
        if held:
            text = SPACES.sub(" ", html.unescape("".join(held))).strip()
            if text:
                total = sum(map(len, held))
                shown = stack[:unseen[0]] if unseen else stack
                out.append((text, tuple(t for t, *_ in shown), tuple(s for _, s, _ in shown if s), linked / total))
            held.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not hidden:
            held.append(s)
            linked += len(s) if links else 0

    def pop() -> None:
        nonlocal hidden, links
        tag, _, hid = stack.pop()
        hidden -= hid
        links -= tag == "a"
        if unseen and unseen[-1] == len(stack):
            unseen.pop()

    at, quotes, last = 0, True, page.rfind(">")
    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[0].startswith("<!--"):
            continue
        if at > last:  # no tag ends any more
            text(m[0])
            continue
        tag = (m[2] or "").lower()
        if not tag:
            at = page.index(">", at) + 1
            continue
        rest = REST.match(page, at) if quotes else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:  # its quoted values reach the page's end: from here on quotes mean nothing
            quotes, end = False, page.index(">", at)
            attributes, at = page[at:end], end + 1
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            # what lies in an unseen element doesn't end the block around it
            if tag in BLOCKS and not (unseen and (k < 0 or k > unseen[0])):
                flush()
            while 0 <= k < len(stack):
                pop()
            continue
        if tag in VOID:
            if tag in BLOCKS and not unseen:
                flush()
            elif tag == "br":
                text(" ")
            continue
        if attributes.endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, *_ in stack)) and _slashed(attributes):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in UNSEEN:
            while tag in SINGLE and any(stack[k][0] == tag for k in unseen):
                pop()
            unseen.append(len(stack))
            stack.append((tag, "", True))
            hidden += 1
            continue
        if tag in BLOCKS:
            if not unseen:
                flush()
            wall = unseen[-1] if unseen else -1
            tags = [t for t, *_ in stack[wall + 1:]]
            if "p" in tags:  # a block ends an open paragraph and what is in it
                while stack[-1][0] != "p":
                    pop()
                pop()
            for k in range(len(stack) - 1, wall, -1):
                if stack[k][0] in ENDS.get(tag, ()):
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in WALLS:
                    break
        words, hid = _words(attributes) if attributes else (frozenset(), False)
        stack.append((tag, _sense(tag, words), hid))
        hidden += hid
        links += tag == "a"
    flush()
    return out


def features(page: list[Block], main_marks: bool = True, other_marks: bool = True) -> list[list[str]]:
    """Names of each block's features; marks can be left out to learn without them."""
    out = []
    for k, (text, tags, senses, linked) in enumerate(page):
        words = text.split()
        n = len(words)
        seen = [s for s in senses if (s != "main" or main_marks) and (s != "other" or other_marks)]
        marked = [t for t in tags if _sense(t, frozenset()) == ""]
        f = ["bias", f"sense {seen[-1] if seen else 'none'}", f"senses {' '.join(sorted(set(seen)))}",
             f"leaf {next((t for t in reversed(marked) if t in BLOCKS), 'none')}",
             f"words {min(int(math.log2(n + 1)), 8)}", f"linked {int(linked * 3.99)}",
             f"ends {text[-1] if text[-1] in '.!?:,;' else 'other'}", f"first {k == 0}", f"last {k == len(page) - 1}",
             f"digits {min(int(8 * sum(map(str.isdigit, text)) / len(text)), 4)}"]
        f += [f"in {t}" for t in set(marked) & {"li", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "p", "dl"}]
        if TELLING.search(text):
            f.append("telling" if n < 30 else "telling long")
        out.append(f)
    return out


class Chain:
    """A linear chain of two states over the blocks of a page."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def scores(self, page: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for k, f in enumerate(page):
            known = [self.names[x] for x in f if x in self.names]
            if known:
                out[k] = self.weights[known].sum(axis=0)
        return out

    def viterbi(self, page: list[list[str]]) -> list[int]:
        """The labelling with the highest score; equal scores go to the lower state."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0]
        back = []
        for u, v in s[1:]:
            back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 >= b + m11 else 1))
            a, b = max(a + m00, b + m10) + u, max(a + m01, b + m11) + v
        state = 0 if a >= b else 1
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]

    def gradient(self, s: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of labelled pages, padded to one length (scores
        ``s[page, block, state]``, labels ``y[page, block]``, lengths ``n``), and
        expected minus seen states and moves, by the forward-backward recursion
        over all of the pages at once."""
        length, moves = s.shape[1], self.moves
        inside = np.arange(length)[None, :] < n[:, None]
        fore, aft = np.empty_like(s), np.zeros_like(s)
        fore[:, 0] = s[:, 0]
        for k in range(1, length):
            into = np.logaddexp(fore[:, k - 1, 0, None] + moves[0], fore[:, k - 1, 1, None] + moves[1])
            fore[:, k] = np.where(inside[:, k, None], into + s[:, k], fore[:, k - 1])
        for k in range(length - 2, -1, -1):
            into = moves[None] + (s[:, k + 1] + aft[:, k + 1])[:, None, :]
            aft[:, k] = np.where(inside[:, k + 1, None], np.logaddexp(into[:, :, 0], into[:, :, 1]), 0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        one = np.eye(2)[y]
        state = (np.exp(fore + aft - total[:, None, None]) - one) * inside[:, :, None]
        pair = np.exp(fore[:, :-1, :, None] + moves + (s[:, 1:] + aft[:, 1:])[:, :, None, :]
                      - total[:, None, None, None])
        seen = one[:, :-1, :, None] * one[:, 1:, None, :]
        pair = ((pair - seen) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        like = (s * one * inside[:, :, None]).sum() + (seen * moves * inside[:, 1:, None, None]).sum() - total.sum()
        return float(like), state, pair


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, together: int = 64) -> Chain:
    """Maximum likelihood with decay by AdaGrad over whole passes; pages of like
    length are worked on together."""
    names = {x: k for k, x in enumerate(sorted({x for page, _ in pages for f in page for x in f}))}
    chain = Chain(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    if not pages:
        return chain
    groups = []
    for a in range(0, len(pages), together):
        part = pages[a:a + together]
        n = np.array([len(page) for page, _ in part])
        y = np.zeros((len(part), n.max()), int)
        for k, (_, labels) in enumerate(part):
            y[k, :len(labels)] = labels
        flat = [f for page, _ in part for f in page]
        ids = np.array([names[x] for f in flat for x in f])
        of = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        groups.append((n, y, ids, of, np.arange(n.max())[None, :] < n[:, None]))
    blocks_in_all = sum(int(g[0].sum()) for g in groups)
    gw, gm = np.full_like(chain.weights, 1e-8), np.full_like(chain.moves, 1e-8)
    for _ in range(steps):
        dw, dm = np.zeros_like(chain.weights), np.zeros_like(chain.moves)
        for n, y, ids, of, inside in groups:
            s = np.zeros((*y.shape, 2))
            sums = np.stack([np.bincount(of, chain.weights[ids, c]) for c in (0, 1)], axis=1)
            s[inside] = sums
            _, state, pair = chain.gradient(s, y, n)
            mine = state[inside][of]
            for c in (0, 1):
                dw[:, c] += np.bincount(ids, mine[:, c], minlength=len(names))
            dm += pair
        dw, dm = dw / blocks_in_all + DECAY * chain.weights, dm / blocks_in_all + DECAY * chain.moves
        gw, gm = gw + dw * dw, gm + dm * dm
        chain.weights -= RATE * dw / np.sqrt(gw)
        chain.moves -= RATE * dm / np.sqrt(gm)
    return chain


def labelled(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and their labels, if the page marks one article."""
    marks = len(re.findall(MARK, page))
    if marks != 1 and not (marks == 2 and re.search(NESTED, page)):
        return None
    found = blocks(page)
    labels = [int(len({"article", "main"} & set(b[1])) == marks and b[2][-1] == "main") for b in found]
    return (found, labels) if found else None


def sample(pages: DataFrame, n: int = SAMPLE_PAGES) -> list[str]:
    """Html of at most ``n`` pages that mark their article, each of bounded length."""
    marks = F.regexp_count("html", F.lit(MARK))
    marked = pages.select(F.col("page_id"), F.col("html")).where(
        (F.length("html") <= SAMPLE_CHARS) & ((marks == 1) | (marks == 2) & F.col("html").rlike(NESTED)))
    rows = smallest_hashes(marked, n, "page_id", "html")
    return [r.html for r in rows.select("html").collect()]  # SAMPLE_PAGES * SAMPLE_CHARS at most


def learn(pages: list[str], steps: int = STEPS) -> Chain:
    """Train on labelled pages as they are, without article marks, and without any."""
    known = [x for x in map(labelled, pages) if x]
    views = [(features(found, main, other), labels) for found, labels in known
             for main, other in ((True, True), (False, True), (False, False))]
    return train(views, steps)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, y in zip(found, chain.viterbi(features(found))) if y)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row."""
    chain = learn(sample(pages))
    parts = chain.names, chain.weights, chain.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = Chain(*parts)
        for batch in batches:
            texts = [main_text(x.as_py(), trained) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
