"""Main text of web pages by tag-path ratios.

Blocks of text that stand at the same path from the root belong together: an article's
paragraphs share one path, however short some are. Text length and punctuation are
summed per path, put in relation to the blocks there, smoothed along the page, fused
to one score and cut at a threshold. Every block whose path passes is text of the
article, wherever it stands; short blocks come along if they stand beside such blocks.
What a page's markup names as something else never takes part, unless it is a class, id
or role of an element that holds the article or most of its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp".split())
_ASIDE = frozenset("head nav header footer aside menu button select option dialog".split())
#: Elements that may hold a form, or a page that is sent as one: they go unless they hold the article or most of the text.
_FORMS = frozenset("form fieldset".split())
#: Words in a class, id or role that may name something beside the article.
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside side rail footer footers header masthead topbar "
    "toolbar comment comments commentlist respond reply replies disqus discussion share sharing social related recommended "
    "newsletter subscribe subscription signup login search widget widgets toc skip copyright complementary contentinfo "
    "form".split())
#: Words beside those in such a name that say nothing; with any other word a name is not taken to mean one of them.
_FILLERS = frozenset(
    "area bar block body bottom box btn button buttons col column container content entry global group head icon icons inner "
    "item items left link links list main media module outer page panel post primary right row secondary section site slot "
    "text title top unit wrap wrapper".split())
#: An element of the first kind ends an open one of the second, up to one of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Elements that hold text of an article, so that a passing block on one side is enough for them.
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption blockquote pre".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Runs of blocks of one path over which a passing block is near.
_NEAR = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?…。、，！？；：]")
_SPACES = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links
    beside: bool  # inside something that is not the article
    named: bool = False  # inside something that is named like what stands beside an article
    within: tuple[int, ...] = ()  # numbers of the elements with such names, and of articles and mains


@dataclass
class _Open:
    tag: str
    step: str
    beside: bool
    number: int  # from 1 where the element has such a name or is an article or main, else 0


@dataclass
class _Page:
    """The open elements and the blocks so far."""

    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    marked: list[tuple[str, bool, tuple[int, ...]]] = field(default_factory=list)  # tag, named, and those around it

    def flush(self) -> None:
        if self.parts:
            text = _SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                path = tuple(e.step for e in self.open if e.tag not in _INLINE)
                self.blocks.append(Block(path, text, self.linked, any(e.beside for e in self.open),
                                         within=self.around()))
            self.parts, self.linked = [], 0

    def around(self) -> tuple[int, ...]:
        return tuple(e.number for e in self.open if e.number)

    def say(self, text: str) -> None:
        self.parts.append(text)
        if any(e.tag == "a" for e in self.open):
            self.linked += len(text.strip())

    def close(self, tags: set[str], within: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in tags:
                self.flush()
                del self.open[k:]
                return
            if self.open[k].tag in within:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self.flush()
            self.close({"p"}, {"table", "td", "th", "body", "article", "section", "div"})
            if tag in _CLOSES:
                self.close(*_CLOSES[tag])
        if tag not in _VOID:
            beside, named, step = _meaning(tag, attributes)
            number = 0
            if named or tag in ("article", "main"):
                self.marked.append((tag, named, self.around()))
                number = len(self.marked)
            self.open.append(_Open(tag, step, beside, number))

    def end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                if any(e.tag not in _INLINE for e in self.open[k:]):
                    self.flush()
                del self.open[k:]
                return


def _meaning(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element stands beside the article, whether its name says so, and its step in a path."""
    beside, named, step = tag in _ASIDE, tag in _FORMS, tag
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in _NAMED.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("hidden",) or name == "aria-hidden" and value.lower() == "true":
                beside = True
            elif name == "style":
                beside |= "display:none" in value.replace(" ", "").lower()
            elif value:
                names = [w for w in value.split() if not w.lower().startswith(("has-", "with-", "no-"))]
                named |= any(_says_aside([w.lower() for w in _WORD.findall(part)]) for part in names)
                if name == "class":
                    step = f"{tag}.{value.split()[0]}" if value.split() else tag
    return beside, named, step


def _says_aside(words: list[str]) -> bool:
    """Whether a name means something beside the article: ``ad-slot`` does, ``side-effects`` does not."""
    return any(w in _ASIDE_WORDS for w in words) and all(w in _ASIDE_WORDS or w in _FILLERS for w in words)


def blocks(page: str) -> list[Block]:
    """All blocks of text in page order, references decoded, white space as one space."""
    state, at, n = _Page(), 0, len(page)
    while at < n:
        token = _TOKEN.match(page, at)
        slash, tag, attributes, text = token.groups()
        loose = _LOOSE.match(page, at) if text == "<" else None
        if loose:  # a tag with a quote that never ends
            token, (slash, tag, attributes), text = loose, loose.groups(), None
        at = token.end()
        if text is not None:
            state.say(html.unescape(text))
        elif tag:
            tag = tag.lower()
            if slash:
                state.end(tag)
            elif tag in _RAW and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            elif tag == "br":
                state.say("\n")
            else:
                state.start(tag, attributes)
    state.flush()
    _name(state)
    return state.blocks


def _name(state: _Page) -> None:
    """Mark the blocks inside a named element, unless it holds the article or most of its text.

    The article is the longest article element, else the longest main, if it is the only
    one or has a quarter of the page's text; without one it is the whole page.
    """
    held = [0] * (len(state.marked) + 1)
    for b in state.blocks:
        if not b.beside:
            held[0] += len(b.text)
            for k in b.within:
                held[k] += len(b.text)
    wraps, scope = set(), 0
    for tag in ("main", "article"):
        own = [k for k, m in enumerate(state.marked, 1) if m[0] == tag and held[k]]
        longest = max(own, key=lambda k: held[k], default=0)
        if longest and (len(own) == 1 or 4 * held[longest] >= held[0]):
            wraps |= set(state.marked[longest - 1][2])
            scope = longest
    for k, (_, _, around) in enumerate(state.marked, 1):
        if (not scope or scope in around) and 2 * held[k] > held[scope]:
            wraps.add(k)
    aside = {k for k, (_, named, _) in enumerate(state.marked, 1) if named} - wraps
    for b in state.blocks:
        b.named = any(k in aside for k in b.within)


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weighted with the neighbours on either side (1, 2, 1); the ends repeat themselves."""
    wide = np.pad(values, 1, mode="edge")
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


def content_paths(found: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose fused ratio of text length and punctuation is over the spread of all paths."""
    paths = list(dict.fromkeys(b.path for b in found))
    place = {p: k for k, p in enumerate(paths)}
    sums = np.zeros((len(paths), 4))  # blocks, characters, punctuation, linked characters
    for b in found:
        sums[place[b.path]] += 1, len(b.text), len(_MARKS.findall(b.text)), min(b.linked, len(b.text))
    per_block = sums[:, 1] / sums[:, 0]
    marks = sums[:, 2] / sums[:, 0]
    plain = 1 - sums[:, 3] / np.maximum(sums[:, 1], 1)
    fused = _smooth(per_block) * (1 + _smooth(marks)) * plain ** 2 * np.sqrt(sums[:, 1])
    limit = min(fused.std(), fused.max() / 2)
    return {p for p, f in zip(paths, fused) if f > 0 and f >= limit}


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by a line break; empty if there is none."""
    found = [b for b in blocks(page or "") if not b.beside and not b.named]
    if not found:
        return ""
    content = content_paths(found)
    kept = _near_passing(found, [b.path in content for b in found])
    return "\n".join(b.text for b, stays in zip(found, kept) if stays)


def _near_passing(found: list[Block], passes: list[bool]) -> list[bool]:
    """Passing blocks, and short ones beside them.

    Neighbours of one path are a run, so that a long list counts once. A run that fails
    must stand in the common ancestor of all passing blocks, or in the article or main
    element around that, and have a passing run near on either side (on both sides
    directly, if its element is not one for text). Without such an element, headings and
    paragraphs close before the first passing block come along from one level up.
    """
    inner = [b.path[:-1] for b, ok in zip(found, passes) if ok]
    if not inner:
        return passes
    common = min(inner, key=len)
    while any(i[:len(common)] != common for i in inner):
        common = common[:-1]
    outer = max((k + 1 for k, step in enumerate(common) if step in ("article", "main")), default=None)
    wide = common[:len(common) - 1] if outer is None else common[:outer]
    runs: list[list[int]] = []
    for k, b in enumerate(found):
        if runs and found[runs[-1][0]].path == b.path:
            runs[-1].append(k)
        else:
            runs.append([k])
    good = [passes[run[0]] for run in runs]  # blocks of one path pass or fail together
    first = good.index(True)
    kept = list(passes)
    for at, run in enumerate(runs):
        if good[at]:
            continue
        path = found[run[0]].path
        tag = path[-1].split(".")[0] if path else ""
        if path[:len(common)] == common or outer is not None and path[:outer] == wide:
            if tag in _TEXTUAL:
                fits = any(good[max(0, at - _NEAR):at + _NEAR + 1])
            else:
                fits = 0 < at < len(runs) - 1 and good[at - 1] and good[at + 1]
        else:
            fits = outer is None and path[:len(wide)] == wide and tag in _HEADS and first - _NEAR <= at < first
        for k in run:
            kept[k] = fits and 2 * found[k].linked <= len(found[k].text)
    return kept


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` (the main text) and ``n_chars`` (its code points) to every page.

    A null or empty page has an empty text. Columns of ``pages`` with these names are
    replaced; each page is read whole and by itself, repeated rows each time.
    """

    @F.pandas_udf("string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series([main_text(p) for p in found], dtype=object)

    return pages.withColumn("text", told(F.col(html_col).cast("string"))).withColumn(
        "n_chars", F.length("text").cast("long"))
