"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. First every block is judged alone by
length, link density and stop-word density: good, bad or ambiguous. Then ambiguous
blocks inherit the label of the nearest decided neighbours. Tags and roles that say what a
block is (navigation, footers, forms) decide before the rules. Class and id names are a
feature of the rules: a name of boilerplate words alone makes a block bad, as long as
the page has a good block elsewhere; where all its prose is so named, names tell nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import frugal, lean_batches

# Tags that cut blocks, tags whose content is never text, and tags and name parts that mark boilerplate.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template svg math iframe object embed canvas textarea select button head title audio video".split())
RAW_TAGS = frozenset("script style textarea title".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disclaimer disqus footer footnav form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popular promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tagcloud tags toolbar topbar widget widgets".split()
)
#: Words that may stand beside a boilerplate word in a name that says what an element holds; any other word (tags-politics, market-share-report) makes it a name of something else.
HOLDER_NAMES = frozenset("area articles bar block body bottom box button buttons col column container content count cta entry footer group heading icon icons inner item items label left link links list main media module msg message outer page panel post posts primary right row secondary section site slot stories story text thread title top unit wrap wrapper".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a head may hold; any other start tag ends it. Tags of HTML that end an unclosed drawing or formula, unless inside one of its text parts.
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
DRAWING_TAGS, DRAWING_TEXT = frozenset("svg math".split()), frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split()
)
STOP_WORDS = frozenset(
    (
        "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so than that the their them there they this to up was we were what when which who will with would you your "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui ma mais me ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
        "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und vom von vor war wie wir wird zu zum zur "
        "al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una y ya "
        "al che come con da dal del della di e gli il io la le lo ma nel non o per più si sono un una "
        "aan als bij dat de die een en er het in is met niet om op te uit van voor wordt zijn "
        "ao as com da das do dos e em mais na nas no nos o os ou para pela pelo por que se uma"
    ).split()
)
#: Characters below which a block is ambiguous, and from which a plausible block is good at once.
SHORT, LONG = 70, 200
#: Share of characters inside links from which a block is bad.
MOST_LINKED = 0.5
#: Good characters of a page whose prose all has boilerplate names from which the names are not believed.
MISNAMED = 600
#: Share of a page's good characters that its article and main elements must hold to be all that is kept.
MOST_INSIDE = 0.5
#: Shares of stop words: plausible, and good at once.
STOP_LOW, STOP_HIGH = 0.12, 0.25

#: What ends a sentence, in any script, with what may close behind it, and signs that are a word or half of one.
_ENDS = re.compile(r"[.!?\u2026](?=[\"'\u2019\u201d\u00bb)\]]*(?:\s|\Z))|[\u0589\u061f\u06d4\u0700\u0964\u0965\u104b\u1362\u1367\u17d4\u3002\uff01\uff1f\uff0e\uff61]")
_SIGNS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
#: Characters that a sign of such a script counts for, and characters of prose in which a sentence ends.
SIGN, SENTENCE = 3, 400

# Group 4 is what ended the scan of a tag; without > it is text, and what was scanned is not scanned again.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    """Text of one block, its linked characters, whether tags or names call it boilerplate, and whether it lies in an article."""

    __slots__ = ("text", "linked", "out", "named", "inside", "rule")

    def __init__(self, text: str, linked: int, out: bool, named: bool, inside: bool):
        self.text, self.linked, self.out, self.named, self.inside = text, linked, out, named, inside
        self.rule = None


def _says(name: str) -> bool:
    """Whether one class or id is made of boilerplate and holder words alone."""
    words = [w.lower() for w in _PART.findall(name)]
    return name.lower() in BOILERPLATE_NAMES or bool(words) and any(w in BOILERPLATE_NAMES for w in words) and all(w in BOILERPLATE_NAMES or w in HOLDER_NAMES for w in words)


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether roles and states of a tag, and whether its names, say that its content is not the article."""
    out = named = False
    if not attributes:
        return out, named
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        low = value.lower()
        out |= name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and "display:none" in low.replace(" ", "") or name == "role" and low in BOILERPLATE_ROLES
        named |= name in ("class", "id") and any(map(_says, value.split()))
    return out, named


class _Open:
    """Open elements by depth: those that count for blocks, with their marks, and between them the others."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate by tag, by name, article
        self.inline: list[Counter] = [Counter()]
        self.count: Counter = Counter()  # of all open tags

    def push(self, *entry) -> None:
        self.stack.append(entry)
        self.inline.append(Counter())
        self.count[entry[0]] += 1

    def add(self, tag: str) -> None:
        self.inline[-1][tag] += 1
        self.count[tag] += 1

    def here(self, tag: str) -> bool:
        """Whether an end tag closes something around the current place."""
        return bool(self.count[tag]) and (bool(self.inline[-1][tag]) or any(x[0] == tag for x in self.stack))

    def drop(self, tag: str) -> None:
        """Closes the innermost other element of a tag."""
        for held in reversed(self.inline) if self.count[tag] else ():
            if held[tag]:
                held[tag] -= 1
                self.count[tag] -= 1
                return

    def close(self, tag: str) -> int | None:
        """The depth of the innermost block element of a tag."""
        return next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None) if self.count[tag] else None

    def cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.count[x[0]] -= 1
        for held in self.inline[k + 1 :]:
            self.count.subtract(held)
        del self.stack[k:], self.inline[k + 1 :]

    def marks(self) -> tuple[bool, bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False, False)


def blocks(page: str) -> list[Block]:
    """Blocks in page order. An end tag closes the nearest open tag of its name; unclosed ones end with their parent.

    So do unclosed skipped tags; a head also ends at what cannot be in it. Only an unclosed script, style, textarea or
    title of the body hides the rest of the page, as in HTML.
    """
    found: list[Block] = []
    opened = _Open()
    inner: list[str] = []  # open tags inside what is skipped
    parts: list[tuple[str, bool]] = []
    at, skip, links = 0, "", 0
    out = named = inside = False
    endless: set[str] = set()  # raw tags that no end tag follows

    def close():
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(p).strip()) for p, is_link in parts if is_link)
                found.append(Block(text, linked, out, named, inside))
            parts.clear()

    def raw_end(tag: str) -> int:
        """Where the content of a raw tag ends, 0 if nowhere."""
        if tag not in endless:
            m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if m:
                return m.end()
            endless.add(tag)
        return 0

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        tag = (m[2] or "").lower()
        if tag and not m[4]:
            continue
        if m.start() > at:
            if skip == "head" and not inner and page[at : m.start()].strip():
                skip = ""
            if not skip:
                parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if not tag:
            continue
        if skip:
            if m[1]:
                if tag in inner:
                    while inner.pop() != tag:
                        pass
                    continue
                if tag == skip:
                    skip = ""
                    inner.clear()
                    continue
                if not opened.here(tag) and not (skip == "head" and tag in ("body", "html")):
                    continue
            elif skip == "head" and tag not in HEAD_TAGS and "template" not in inner or skip in DRAWING_TAGS and tag in BREAKOUT_TAGS and DRAWING_TEXT.isdisjoint(inner):
                pass
            else:
                raw = raw_end(tag) if tag in RAW_TAGS and not m[3].endswith("/") else 0
                if raw:
                    at = raw
                elif tag == skip == "select":  # acts as its end tag
                    skip = ""
                    inner.clear()
                elif tag not in VOID_TAGS and not m[3].endswith("/") and not tag == skip == "button":
                    inner.append(tag)
                continue
            skip = ""
            inner.clear()
        if tag in BLOCK_TAGS:
            close()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in BLOCK_TAGS:
                opened.drop(tag)
            k = opened.close(tag)
            if k is not None:
                close()
                opened.cut(k)
                out, named, inside = opened.marks()
            continue
        if tag in SKIPPED_TAGS and tag not in VOID_TAGS and not m[3].endswith("/"):
            if tag in RAW_TAGS:
                at = raw_end(tag) or len(page)
            else:
                skip = tag
            continue
        if tag == "a":
            links += 1
            opened.add(tag)
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        marked, says = (False, False) if tag in ("html", "body", "main", "article") else _marked(m[3])
        now_out = out or marked or tag in BOILERPLATE_TAGS or tag == "header" and not inside
        now_named, now_inside = named or says, inside or tag in ("article", "main")
        if tag in BLOCK_TAGS or (now_out, now_named) != (out, named):
            close()
            opened.push(tag, now_out, now_named, now_inside)
            out, named, inside = now_out, now_named, now_inside
            if tag in BLOCK_TAGS:
                links = 0
        else:
            opened.add(tag)
    if at < len(page) and (not skip or skip == "head" and not inner and page[at:].strip()):
        parts.append((page[at:], links > 0))
    close()
    return found


GOOD, BAD, OPEN = 1, -1, 0


def alone(b: Block) -> int:
    """First pass: the label of a block by itself."""
    if b.out or b.named:
        return BAD
    if b.rule is None:
        b.rule = _rule(b)
    return b.rule


def _rule(b: Block) -> int:
    if b.linked > MOST_LINKED * len(b.text):
        return BAD
    if len(b.text) < SHORT:
        return OPEN
    stops, n = _density(b.text)
    density = stops / n if n else 0.0
    if density >= STOP_HIGH or density >= STOP_LOW and len(b.text) >= LONG:
        return GOOD
    if density >= STOP_LOW or b.inside:
        return OPEN
    return BAD


def _density(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _LETTERS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def _listed(found: list[Block]) -> bool:
    """Whether the stop words are those of a page's language: they are as frequent as in plausible prose in what could be such."""
    counts = [_density(b.text) for b in found if not b.out and not b.named and b.linked <= MOST_LINKED * len(b.text) and len(b.text) >= SHORT]
    return sum(s for s, _ in counts) >= STOP_LOW * max(1, sum(n for _, n in counts))


def _unlisted_rule(b: Block) -> int:
    """First pass for languages without stop words: length and links as ever, and sentences in place of density."""
    if b.linked > MOST_LINKED * len(b.text):
        return BAD
    size = len(b.text) + (SIGN - 1) * len(_SIGNS.findall(b.text))
    if size < SHORT:
        return OPEN
    ends = len(_ENDS.findall(b.text))
    letters = sum(map(str.isalpha, b.text))
    return GOOD if ends and ends * SENTENCE >= size and 2 * letters >= len(b.text) else OPEN if ends or b.inside else BAD


def judge(found: list[Block]) -> list[bool]:
    """Second pass: an ambiguous block takes the label its nearest decided neighbours agree on.

    Where they differ the nearer one wins, and good wins a tie. Marked boilerplate is no neighbour of article text, and inside an
    article without any decided block everything unmarked is good.
    """
    labels = [alone(b) for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, tuple[int, int]] = {}
        for i in order:
            b = found[i]
            into[i] = last.get(b.inside)
            if labels[i] != OPEN and not b.out and not b.named:
                last[b.inside] = (i, labels[i])
    keep = []
    for i, b in enumerate(found):
        label = labels[i]
        if label == OPEN:
            near = [x for x in (before[i], after[i]) if x]
            if not near:
                label = GOOD if b.inside else BAD
            elif len({x[1] for x in near}) == 1:
                label = near[0][1]
            else:
                gaps = [abs(i - x[0]) for x in near]
                label = near[int(np.argmin(gaps))][1] if gaps[0] != gaps[1] else GOOD
        keep.append(label == GOOD)
    return keep


def _good(found: list[Block]) -> int:
    return sum(len(b.text) for b in found if alone(b) == GOOD)


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space.

    Where the page marks an article, only that is kept, unless most of the good text is
    elsewhere, as with a teaser. Names are not believed where they cover all the prose.
    Stop words are not asked where no block has enough of them to be good and the page as
    a whole has fewer than prose of their languages has.
    """
    found = blocks(page or "")
    if not _good(found):
        unnamed = [Block(b.text, b.linked, b.out, False, b.inside) for b in found]
        if _good(unnamed) >= MISNAMED:
            found = unnamed
    if not _good(found) and not _listed(found):
        for b in found:
            b.rule = _unlisted_rule(b)
    inside = [b for b in found if b.inside]
    if any(not b.out and not b.named for b in inside) and _good(inside) >= MOST_INSIDE * _good(found):
        found = inside
    return " ".join(b.text for b, good in zip(found, judge(found), strict=True) if good)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; a null or empty page has an empty text.

    Repeated rows have a result each; other columns are not read.
    """

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    lean_batches(pages.sparkSession)
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[page].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
