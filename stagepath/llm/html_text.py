"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagepath.llm.common import ship_code

# Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    # English
    "a about all also an and are as at be been but by can do for from had has have he her his i if"
    " in into is it its me more my no not of on one or our out she so some than that the their them"
    " then there they this to up us was we were what when which who will with would you your"
    # French
    " au aux avec ce cette dans de des du elle en est et eux il ils je la le les leur lui mais ne"
    " nous on ou par pas plus pour qu que qui sa se ses son sont sur tu un une vous y"
    # German
    " aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen"
    " einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so und"
    " von vor war wie wir zu zum zur"
    # Spanish
    " al así como con de del el ella en es esta este la las le lo los más me mi muy no o para pero"
    " por que se si sin sobre su sus también un una y ya".split()
)
# Elements of the page format.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p"
    " pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BESIDE = frozenset(
    "aside button canvas dialog footer form head header iframe menu nav noscript object select svg"
    " template textarea title video audio".split()
)
RAW = ("script", "style")
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that name what stands beside the text.
BESIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent"
    " cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation"
    " newsletter notice overlay popup promo promotion related sharing share sidebar signup"
    " skyscraper social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Those of them that no text of a page is in, however much of the page they hold.
NEVER_TEXT = frozenset("comment comments consent cookie cookies disqus gdpr".split())

# Every part is possessive and stops at the next tag, so no start of a tag is gone through to the
# end of the page in vain. A tag may have a stray quote, and one cut off by the next tag is left out
# if it has an attribute; otherwise a sign that no ">" follows is text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)"
    r"(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,512}+)>"
    r"|</?[a-zA-Z][^<>]*+>|<[!?][^<>]*+>"
    r"|</?[a-zA-Z][^\s<>]*+\s[^<>=]*+=[^<>]*+(?=<|\Z)",
    re.DOTALL,
)
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: A class or id of readers' comments, and not of a page that allows them.
_COMMENTS = re.compile(
    r"(?!(?:allow|has|hide|no|with)[-_])(?:[a-z]+[-_])?(?:comments?|disqus)"
    r"(?:[-_](?!open|closed|enabled|disabled|o[nf]).*)?"
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Lengths in code points, densities as shares."""

    short: int = 70
    long: int = 200
    max_links: float = 0.33
    low_stop_words: float = 0.10
    high_stop_words: float = 0.20


@dataclass
class Block:
    text: str
    linked: int
    beside: bool
    main: bool
    label: str = ""


@dataclass
class Named:
    """An element whose class, id or role names what stands beside the text."""

    outer: int
    never_text: bool
    comments: int
    size: int = 0
    beside: bool = True


def _names(rest: str) -> str:
    return " ".join(m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(rest)).lower()


def _settle(found: list[Block], marks: list[int], named: list[Named]) -> None:
    """Marks the blocks of named elements, unless such an element holds most of the page's text.

    Where an article or main element has text, or other text outweighs it, the name stands; names
    of comments and consent stand while there is any other text. What lies in an
    element of another name inside it is judged for itself.
    """
    if not named:
        return
    whole = 0
    in_article = False
    for block, mark in zip(found, marks, strict=True):
        if not block.beside:
            whole += len(block.text)
            in_article |= block.main and mark < 0
            if mark >= 0:
                named[mark].size += len(block.text)
    for one in reversed(named):
        if one.outer >= 0:
            named[one.outer].size += one.size
    for one in named:
        most = one.size == whole if one.never_text else 2 * one.size > whole
        one.beside = in_article or not most or (one.outer >= 0 and named[one.outer].beside)
    for block, mark in zip(found, marks, strict=True):
        block.beside |= mark >= 0 and named[mark].beside


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order, with their linked characters and surroundings.

    An end tag closes the nearest open element of its name and all inside it; without one
    it is passed over. The start of an article or main element leaves behind elements beside
    the text that were never closed; an article of readers' comments stays beside the text.
    The names of html and body say nothing of what stands in them.
    """
    found: list[Block] = []
    parts: list[str] = []
    linked, n_links = 0, 0
    marks: list[int] = []
    named: list[Named] = []
    # Open elements: name, whether it and what surrounds it are beside the text and in it, and the
    # innermost named element, or -1.
    root = ("", False, False, -1)
    stack: list[tuple[str, bool, bool, int]] = []
    is_open: Counter[str] = Counter()

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            _, beside, main, mark = stack[-1] if stack else root
            found.append(Block(text, linked, beside, main))
            marks.append(mark)
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if n_links:
                linked += len(text.strip())

    def is_beside(one: tuple[str, bool, bool, int]) -> bool:
        return one[1] or one[3] >= 0

    at = 0
    while (match := _TOKEN.search(page, at)) is not None:
        add(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not match["end"]:
                over = _RAW_END[tag].search(page, at)
                at = over.end() if over else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        beside = tag in BESIDE
        if match["end"]:
            open_at = None
            if is_open[tag]:
                open_at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            if tag in BLOCKS or beside or (
                open_at is not None and is_beside(stack[open_at]) != is_beside(stack[-1])
            ):
                close_block()
            if open_at is not None:
                n_links -= sum(one[0] == "a" for one in stack[open_at:])
                is_open.subtract(one[0] for one in stack[open_at:])
                del stack[open_at:]
            continue
        outer = stack[-1] if stack else root
        names = "" if tag in ("html", "body") else _names(match["rest"])
        words = BESIDE_NAMES.intersection(re.split(r"[^a-z]+", names)) if names else frozenset()
        if tag in BLOCKS or beside or words:
            close_block()
        if tag in VOID:
            continue
        if tag == "body":
            n_links, stack[:] = 0, []
            is_open.clear()
            outer = root
        main = outer[2]
        if tag == "p" and outer[0] == "p":
            stack.pop()
            is_open["p"] -= 1
            outer = stack[-1] if stack else root
        mark = outer[3]
        of_comments = any(_COMMENTS.fullmatch(name) for name in names.split()) if words else False
        if tag in MAIN:
            # Only comments that an article is of or in keep it beside the text.
            mark = named[mark].comments if tag == "article" and mark >= 0 else -1
            outer, beside, main = root, False, True
        if words and (tag not in MAIN or (tag == "article" and of_comments)):
            named.append(Named(mark, not NEVER_TEXT.isdisjoint(words), -1 if mark < 0 else named[mark].comments))
            mark = len(named) - 1
            if of_comments:
                named[mark].comments = mark
        stack.append((tag, outer[1] or beside, main, mark))
        is_open[tag] += 1
        n_links += tag == "a"
    add(page[at:])
    close_block()
    _settle(found, marks, named)
    return found


def classify(found: list[Block], rules: Rules = Rules()) -> None:
    """Labels every block good or bad, in two passes.

    First each for itself: what stands beside the text or is mostly links is bad; a block long
    enough, with few links and with stop words (or in the page's article) is good; a long one
    without stop words outside of it is bad, unless the page has no good block and hardly a
    stop word, being in another language; the others are ambiguous. Then each
    ambiguous block takes the label of the nearest decided block of the same surroundings, of
    two as near the one before. Where none is decided, an article's blocks are good, others
    take the label of the nearest of all, and a page without a decided block is good.
    """
    n_words, n_stop = 0, 0
    without: list[Block] = []
    for block in found:
        size = len(block.text)
        links = block.linked / size
        words = _WORD.findall(block.text.lower())
        listed = sum(word in STOP_WORDS for word in words)
        stop = listed / len(words) if words else 0.0
        if not block.beside:
            n_words, n_stop = n_words + len(words), n_stop + listed
        if block.beside or links > 0.5:
            block.label = "bad"
        elif size < rules.short or links > rules.max_links:
            block.label = ""
        elif block.main or stop >= rules.high_stop_words:
            block.label = "good"
        elif size >= rules.long and stop < rules.low_stop_words:
            block.label = "bad"
            without.append(block)
    if n_stop < rules.low_stop_words * n_words and all(block.label != "good" for block in found):
        for block in without:
            block.label = ""

    def inherit(same_surroundings: bool) -> None:
        groups = {True: [i for i, b in enumerate(found) if b.main],
                  False: [i for i, b in enumerate(found) if not b.main]} if same_surroundings else {
                  None: list(range(len(found)))}
        for members in groups.values():
            decided = [(i, found[i].label) for i in members if found[i].label and not found[i].beside]
            if not decided:
                continue
            after = 0
            for i in members:
                while after < len(decided) and decided[after][0] < i:
                    after += 1
                if found[i].label:
                    continue
                near = decided[max(0, after - 1) : after + 1]
                taken[i] = min(near, key=lambda one: (abs(one[0] - i), one[0]))[1]

    taken: dict[int, str] = {}
    inherit(True)
    for i, label in taken.items():
        found[i].label = label
    for block in found:
        if not block.label and block.main:
            block.label = "good"
    taken = {}
    inherit(False)
    for i, label in taken.items():
        found[i].label = label
    for block in found:
        block.label = block.label or "good"


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The good blocks of a page, one per line."""
    found = blocks(page or "")
    classify(found, rules)
    return "\n".join(block.text for block in found if block.label == "good")


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The main text of every page.

    NULL and empty html give an empty text. Rows with equal ids are each taken for
    themselves, NULL ids and URLs are kept, other columns are left aside; an
    empty table gives no rows. A page is one row's work, whatever its length.
    """
    ship_code(pages.sparkSession)
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), rules) for page in batch.column(2)]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], schema=schema
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        take, "page_id long, url string, text string, n_chars long"
    )
