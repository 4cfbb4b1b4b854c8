"""What a whole web page says: a scan of its tags with a stack of open elements."""

from __future__ import annotations

import html
import re

# Elements that never hold anything, that hold text without tags, and that no reader sees or that are not the page's own text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
APART = frozenset("script style noscript template svg math iframe object canvas textarea select button head title nav footer aside form dialog menu noembed noframes".split())
MAIN = frozenset("main article".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose text stands by itself.
BLOCKS = (
    frozenset(
        "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
    )
    | APART
)
#: Start tags that end open elements, which those are, and what an end does not reach beyond.
_P = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul"
_ROWS, _CELLS = "tbody thead tfoot", "td th"
ENDS = [
    (_P.split(), {"p"}, set("button td th caption table object template select li".split())),
    (["li"], {"li"}, set("ul ol menu dir table".split())),
    (["dt", "dd"], {"dt", "dd"}, {"dl", "table"}),
    (["option"], {"option"}, {"select"}),
    (["optgroup"], {"option", "optgroup"}, {"select"}),
    (_CELLS.split(), set(_CELLS.split()), {"tr", "table"}),
    (["tr"], {*_CELLS.split(), "tr"}, {"table"}),
    (_ROWS.split(), {*_CELLS.split(), "tr", *_ROWS.split(), "caption"}, {"table"}),
]
_ENDED_BY: dict[str, list[tuple[set, set]]] = {}
for _tags, _open, _stop in ENDS:
    for _t in _tags:
        _ENDED_BY.setdefault(_t, []).append((_open, _stop))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>?|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LANG = re.compile(r"""(?:^|\s)(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})\b""")
_ALT = re.compile(r"""(?:^|\s)alt\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_BLANK = re.compile(r"\s+")
#: Share of a page's visible characters from which its main and article elements are all of its text.
MOST = 0.5


def _clean(text: str) -> str:
    return _BLANK.sub(" ", html.unescape(text)).strip()


def parse(page: str | None) -> dict:
    """title, lang, text and alts of a page; a null or empty page has none.

    The text are the visible blocks, a line each: not what lies in a head, navigation,
    footer, aside, form or anything else that is APART, however deep, and only what lies
    in main or article elements where those hold most of it. An end tag closes the nearest
    open element of its name with all that is open in it, one without such an element
    nothing; list items, paragraphs, cells and rows end where the next begins. Time is in
    proportion to the page.
    """
    page = page or ""
    stack: list[str] = []
    count = dict.fromkeys(BLOCKS, 0)
    apart = main = 0
    title: list[str] = []
    lang, alts = "", []
    blocks: list[tuple[str, bool]] = []
    held: list[str] = []

    def close() -> None:
        if held:
            if text := _clean("".join(held)):
                blocks.append((text, main > 0))
            held.clear()

    def pop(to: int) -> None:
        nonlocal apart, main
        close()
        for tag in stack[to:]:
            count[tag] -= 1
            apart -= tag in APART
            main -= tag in MAIN
        del stack[to:]

    def up(names, stop=()) -> None:
        """Closes the outermost of the open elements of these names that no `stop` is above."""
        found = None
        if any(count.get(n) for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in stop:
                    break
                if stack[i] in names:
                    found = i
                elif found is not None or stack[i] not in BLOCKS:
                    break
        if found is not None:
            pop(found)

    def said(text: str) -> None:
        if count["head"] and stack[-1] == "head" and text.strip():
            pop(stack.index("head"))
        if not apart and text:
            held.append(text)

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                said(html.escape(m[0][9 : -3 if m[0].endswith("]]>") else None]))
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                pop(len(stack) - 1 - stack[::-1].index(tag))
            elif tag in BLOCKS:
                close()
            continue
        if tag not in IN_HEAD and count["head"]:
            pop(stack.index("head"))
        for names, stop in _ENDED_BY.get(tag, ()):
            up(names, stop)
        if tag == "html" and not lang:
            lang = (_LANG.search(m[3]) or ("", ""))[1].lower()
        if tag == "img" and not apart and (alt := _ALT.search(m[3])) and (words := _clean(alt[1].strip("\"'"))):
            alts.append(words)
        if tag in ("br", "hr"):
            held.append(" ") if tag == "br" else close()
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "title" and not title and not (count["svg"] or count["math"]):
                title.append(_clean(page[at : end.start() if end else len(page)]))
            if tag == "xmp" and not apart:
                held.append(html.escape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag in BLOCKS and tag not in VOID and tag not in RAW:
            if tag in ("html", "body", "head") and count[tag]:
                continue
            close()
            if tag in ("svg", "math") and m[3].rstrip().endswith("/"):
                continue
            stack.append(tag)
            count[tag] += 1
            apart += tag in APART
            main += tag in MAIN
    close()
    inside = [t for t, x in blocks if x]
    every = sum(len(t) for t, _ in blocks)
    kept = inside if sum(map(len, inside)) >= MOST * every and inside else [t for t, _ in blocks]
    return {"title": title[0] if title else "", "lang": lang[:2], "text": "\n".join(kept), "alts": alts}
