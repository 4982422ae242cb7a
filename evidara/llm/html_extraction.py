"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Every tag scores below zero, by the share of its kind that labelled pages have
outside their content. A word scores 1 where nothing speaks against it, down to -1: 1 - 2 * s, with s the greatest share
outside content of what encloses it, by element, class, id or role. Below zero the words of one text count by their
logarithm, so that the scan passes over an advert inside an article. One linear scan finds the contiguous run of tokens
with the greatest sum, the content region; its words that score above zero are the text.

The shares are learnt from labelled pages, those of a bounded sample that mark their content with one article or main
element; each word outside or inside counts for the outermost element around it that has a name or a kind. They begin
with the pseudo-counts of ``PRIOR``, so that what no labelled page shows is judged too. A name of several parts counts
only if every part is known: "comment-list" does, "notice-period" does not. An element is not believed to be chrome if it
holds the page's main heading with more prose than all that reads as content elsewhere, as a form around an article
does, nor, if it is named, if it holds more words than that, times the odds of its name: a "page-header-wrap" around the
whole page is passed through. Readers' comments and hidden elements are believed.

Null and empty html gives an empty text, as does a page without words of content. A page of unclosed, broken or very
long markup is scanned like any other, in linear time. Repeated rows are all returned; other columns are not looked at.
Ties go to the earliest run. Without labelled pages the prior serves.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# Elements whose content is no text, elements that end a block, elements without an end tag.
RAW = frozenset("script style noscript template svg textarea title iframe math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element on the left ends where one on the right begins.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
ENDING = frozenset().union(*ENDS.values())
#: What those implied ends do not reach across.
HOLDERS = frozenset("article aside blockquote body div dl footer form header main nav ol section table td th ul".split())
COMMENTS = frozenset((".comment", ".comments", ".commentlist"))
CONTENT, NEUTRAL = ("article", "main"), frozenset("html body article main".split())
# Pseudo-counts of words (inside, outside) that learning starts from, by element, and by part of a name.
PRIOR_TAGS = dict.fromkeys("nav aside footer form button select dialog menu object canvas head".split(), (1, 30)) | {"header": (2, 20), "header within": (20, 1), "a": (6, 2)} | dict.fromkeys("p h1 h2 h3 h4 h5 h6 li b i em strong br blockquote pre td th tr table figure figcaption ul ol dl dt dd code span sup sub".split(), (20, 1))
PRIOR_NAMES = (
    dict.fromkeys("comment comments commentlist reply replies respond disqus hidden".split(), (1, 500))
    | dict.fromkeys(
        "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
        "promotion recommended related search share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget alert".split(), (1, 30),
    )
    | {"header": (2, 20)}
    | dict.fromkeys("article body content entry story post main text title headline prose with has no without".split(), (500, 1))
)
#: Parts of names that say nothing by themselves.
PLAIN = frozenset("area bar block bottom box button buttons container inner item items left links list main outer page panel posts region right row section site slot small top unit wrap wrapper x".split())
UNKNOWN = (4, 1)
#: What a tag costs that is never seen in content; the words that a page is taken to hold of content at least, and those of
#: prose that speak for an element with the main heading; from which odds on a name is believed in any case.
TAG_SCORE, LEAST_READ, LEAST_PROSE, CERTAIN = 0.2, 3, 20, 100


@dataclass
class Weights:
    """Words inside and outside content by kind of element and name, and how often tags stand there."""

    words: dict[str, tuple[float, float]] = field(default_factory=dict)
    tags: dict[str, tuple[float, float]] = field(default_factory=dict)

    def counts(self, feature: str) -> tuple[float, float]:
        """Words inside and outside, prior ones included, of a tag ("nav") or a name (".ad")."""
        prior = PRIOR_TAGS.get(feature, UNKNOWN)
        if feature[0] == ".":
            parts = [x for x in re.split(r"[^a-z0-9]+", feature) if x and not x.isdigit()]
            known = [PRIOR_NAMES[x] for x in parts if x in PRIOR_NAMES]
            prior = UNKNOWN
            if known and all(x in PRIOR_NAMES or x in PLAIN for x in parts):
                prior = max(known, key=lambda x: x[0])  # what speaks for content counts before what does not
        a, b = self.words.get(feature, (0, 0))
        return prior[0] + a, prior[1] + b

    def outside(self, feature: str) -> float:
        a, b = self.counts(feature)
        return b / (a + b)

    def tag(self, name: str) -> float:
        a, b = PRIOR_TAGS.get(name, UNKNOWN)
        c, d = self.tags.get(name, (0, 0))
        return -TAG_SCORE * (b + d) / (a + b + c + d)


@dataclass
class Token:
    """A tag by name, or a text (name empty) with its number of words, and the innermost element around it, -1 if none."""

    name: str
    text: str = ""
    words: int = 0
    inside: int = -1
    labelled: bool = False
    prose: bool = False

    @property
    def kind(self) -> str:
        return _kind(self.name, self.labelled)


@dataclass
class Element:
    """Features, the next element outwards that counts (-1 if none), the outermost, and the element it stands in for."""

    features: list[str]
    up: int = -1
    top: int = 0
    of: int = -1

    @property
    def comment(self) -> bool:
        return not COMMENTS.isdisjoint(self.features)


def _kind(name: str, inside: bool) -> str:
    return f"{name} within" if name == "header" and inside else name


def _features(name: str, attributes: str, inside: bool) -> list[str]:
    """Names of an element in class, id or role; if it has none, its kind."""
    found = []
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            found.append(".hidden")
        elif key in ("class", "id", "role"):
            found += ["." + x for x in value.split()]
    kind = _kind(name, inside)
    return [*found, kind] if found and kind in PRIOR_TAGS and PRIOR_TAGS[kind][1] > 2 else found or [kind]


def parse(page: str) -> tuple[list[Token], list[Element]]:
    """The page's tokens, and the elements around them; an element comes after those that enclose it."""
    tokens: list[Token] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []  # open elements, and what was around each
    enders: list[int] = []  # places in the stack of those that may end where others begin, and of their holders
    opened: Counter = Counter()
    inside = -1
    content, at, text = 0, 0, 0

    def say(upto: int) -> None:
        if upto > text:
            part = page[text:upto]
            tokens.append(Token("", part, len(part.split()), inside, content > 0, bool(opened["p"] and not opened["a"])))

    def close(depth: int) -> None:
        nonlocal inside, content
        inside = stack[depth][1]
        for name, _ in stack[depth:]:
            content -= name in CONTENT
            opened[name] -= 1
        del stack[depth:]
        while enders and enders[-1] >= depth:
            enders.pop()

    def enter(features: list[str], up: int, of: int = -1) -> int:
        elements.append(Element(features, up, elements[up].top if up >= 0 else len(elements), of))
        return len(elements) - 1

    def comments_around(k: int) -> int:
        """Stand-ins for the comment elements at and around k, one inside the other, without what is between them."""
        found = []
        while k >= 0:
            if elements[k].comment:
                found.append(k)
            k = elements[k].up
        up = -1
        for k in reversed(found):
            up = enter(elements[k].features, up, k)
        return up

    while (at := page.find("<", at)) >= 0:
        m = TAG.match(page, at)
        if not m:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                end = len(page) if end < 0 else end + 1
            else:
                at += 1
                continue
            say(at)
            at = text = end
            continue
        say(at)
        at = text = m.end()
        closing, name = m[1] == "/", m[2].lower()
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at)
                at = text = end.end() if end else len(page)
            continue
        if closing:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            tokens.append(Token(name, inside=inside, labelled=content > 0))
            continue
        if name in ENDING:
            # The outermost that ends here; of one kind no second is open before a holder, so these are few.
            ended = None
            for i in reversed(enders):
                if name in ENDS.get(stack[i][0], ()):
                    ended = i
                if stack[i][0] in HOLDERS:
                    break
            if ended is not None:
                close(ended)
        tokens.append(Token(name, inside=inside, labelled=content > 0))
        if name not in VOID and not m[3].endswith("/"):
            if name in HOLDERS or name in ENDS:
                enders.append(len(stack))
            stack.append((name, inside))
            opened[name] += 1
            features = [f for f in _features(name, m[3], content > 0) if f not in NEUTRAL]
            if name in CONTENT:
                content += 1
                # What encloses its words begins anew, but for readers' comments.
                inside = comments_around(inside)
            if features:
                inside = enter(features, inside)
    say(len(page))
    return tokens, elements


def learn(pages: list[str]) -> Weights:
    """Counts over those of the pages that mark their content with one article or main element."""
    words, tags = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for page in pages:
        if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
            continue
        tokens, elements = parse(page)
        for t in tokens:
            if t.name:
                tags[t.labelled][t.kind] += t.labelled or t.inside < 0  # what a menu holds is the menu's
            elif t.words and t.inside >= 0:
                words[t.labelled].update(dict.fromkeys(elements[elements[t.inside].top].features, t.words))
    both = lambda c: {k: (c[True][k], c[False][k]) for k in c[True] | c[False]}
    return Weights(both(words), both(tags))


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the greatest sum above zero; of several the earliest; else (0, 0)."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def believed(tokens: list[Token], elements: list[Element], weights: Weights) -> list[float]:
    """The share outside content of each element, 0 for those that hold too much of the page to be chrome."""
    share = [max((weights.outside(f) for f in e.features), default=0.0) for e in elements]
    chrome = [s > 0.5 for s in share]
    under = []  # whether an element or one around it is chrome
    for k, e in enumerate(elements):
        under.append(chrome[k] or e.up >= 0 and under[e.up])
    held, prose, titled, read = [0] * len(elements), [0] * len(elements), [False] * len(elements), 0
    for t in tokens:
        if t.words:
            read += t.words if t.inside < 0 or not under[t.inside] else 0
            if t.inside >= 0:
                held[t.inside] += t.words
                prose[t.inside] += t.words * t.prose
        elif t.name == "h1" and t.inside >= 0:
            titled[t.inside] = True
    least = max(read, LEAST_READ)
    for k in reversed(range(len(elements))):
        e = elements[k]
        passes = not chrome[k]
        if chrome[k]:
            counts = [weights.counts(f) for f in e.features]
            odds = max(b / a for a, b in counts)
            named = any(f[0] == "." for f in e.features)
            passes = named and held[k] > odds * least or odds < CERTAIN and titled[k] and prose[k] > max(read, LEAST_PROSE)
            if passes:
                share[k] = 0.0
        # All words count for what is around, prose only through what is content itself.
        out = e.of if e.of >= 0 else e.up
        if out >= 0:
            held[out] += held[k] if e.of < 0 else 0
            if passes and e.of < 0:
                prose[out] += prose[k]
                titled[out] |= titled[k]
    for k, e in enumerate(elements):
        if e.of >= 0:
            share[k] = share[e.of]
    return share


def scores_of(tokens: list[Token], elements: list[Element], weights: Weights) -> list[float]:
    """The score of each token: of a tag below zero, of a text its words' sum."""
    worst = believed(tokens, elements, weights)
    for k, e in enumerate(elements):
        worst[k] = max(worst[k], worst[e.up] if e.up >= 0 else 0.0)
    kind, out = {}, []
    for t in tokens:
        if t.name:
            if t.kind not in kind:
                kind[t.kind] = weights.tag(t.kind)
            out.append(kind[t.kind])
        else:
            one = 1 - 2 * (worst[t.inside] if t.inside >= 0 else 0.0)
            out.append(one * (t.words if one > 0 else math.log2(1 + t.words)))
    return out


def extract(page: str, weights: Weights) -> str:
    """The blocks of the best run of tokens, one to a line."""
    tokens, elements = parse(page)
    scores = scores_of(tokens, elements, weights)
    low, high = best_run(scores)
    # The rest of the first and last block belongs to them.
    while low and tokens[low - 1].name not in BLOCKS and low < high:
        low -= 1
    while high < len(tokens) and tokens[high].name not in BLOCKS and low < high:
        high += 1
    blocks, parts = [], []
    for t, score in zip(tokens[low:high], scores[low:high], strict=True):
        if not t.name:
            if score > 0 or not t.words:
                parts.append(t.text)
        elif t.name in BLOCKS:
            blocks.append("".join(parts))
            parts = []
        elif t.name in ("br", "td", "th", "img"):
            parts.append(" ")
    blocks.append("".join(parts))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _work(weights: Weights) -> Callable:
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(page or "", weights) for page in batch], dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return work


def sample_weights(pages: DataFrame, max_pages: int = 400, max_chars: int = 100_000) -> Weights:
    """Weights from at most max_pages pages of at most max_chars characters, picked by hash."""
    fit = pages.where(F.length("html").between(1, max_chars)).withColumn("h", F.xxhash64("page_id", "url"))
    rows = fit.select("h", "html").join(F.broadcast(fit.select("h").orderBy("h").limit(max_pages).distinct()), "h").orderBy("h", "html").limit(max_pages)
    return learn([r["html"] for r in rows.collect()])


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""
    udf = F.pandas_udf(_work(sample_weights(pages) if weights is None else weights), "string")
    return pages.select("page_id", "url", udf("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
