"""The scan of pages against a tree that another parser builds."""

import html
import random
import re
from html.parser import HTMLParser

import pytest

from lodestar.functions import pages
from lodestar.operators import extraction


class _Tree(HTMLParser):
    """Nodes [tag, children, parent]; text nodes are strings."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ["", [], None]
        self.at, self.title, self.first, self.lang = self.root, None, None, ""

    def _path(self):
        node, out = self.at, []
        while node is not None:
            out.append(node)
            node = node[2]
        return out

    def _leave(self, node):
        self.at = node[2]

    def handle_starttag(self, tag, attrs):
        if tag not in pages.IN_HEAD:
            for n in self._path():
                if n[0] == "head":
                    self._leave(n)
        for tags, opened, stop in pages.ENDS:
            if tag in tags:
                last = None
                for n in self._path():
                    if n[0] in stop:
                        break
                    if n[0] in opened:
                        last = n
                    elif last is not None and n[0] in pages.BLOCKS:
                        break
                if last is not None:
                    self._leave(last)
        if tag == "html" and not self.lang:
            self.lang = dict(attrs).get("lang") or ""
        if tag in pages.VOID:
            self.at[1].append([tag, [], self.at])
            return
        if tag in ("html", "body", "head") and any(n[0] == tag for n in self._path()):
            return
        node = [tag, [], self.at]
        self.at[1].append(node)
        if tag in pages.BLOCKS:
            self.at = node
        else:
            self.at[1].pop()  # an inline element is its content

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for n in self._path():
            if n[0] == tag:
                self._leave(n)
                return
        if tag in pages.BLOCKS:
            self.at[1].append(["cut", [], self.at])

    def _text(self, x):
        if self.at[0] == "head" and x.strip():
            self._leave(self.at)
        self.at[1].append(x)
        if self.at[0] == "title" and self.first in (None, self.at):
            self.first, self.title = self.at, (self.title or "") + x

    def handle_data(self, x):
        self._text(x)

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")


def _tree_text(page):
    tree = _Tree()
    tree.feed(page)
    tree.close()
    blocks, line = [], []

    def flush(main):
        text = re.sub(r"\s+", " ", html.unescape("".join(line))).strip()
        if text:
            blocks.append((text, main))
        line.clear()

    def walk(node, main):
        for child in node[1]:
            if isinstance(child, str):
                line.append(child)
            elif child[0] == "br":
                line.append(" ")
            elif child[0] in pages.VOID and child[0] != "hr":
                pass
            elif child[0] in pages.RAW:
                pass
            elif child[0] in pages.APART:
                flush(main)
            else:
                flush(main)
                walk(child, main or child[0] in pages.MAIN)
                flush(main or child[0] in pages.MAIN)

    walk(tree.root, False)
    flush(False)
    inside = [t for t, m in blocks if m]
    return "\n".join(inside if inside and 2 * sum(map(len, inside)) >= sum(len(t) for t, _ in blocks) else [t for t, _ in blocks]), tree


def test_all_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    assert len(rows) == 250
    for r in rows:
        text, tree = _tree_text(r["html"])
        got = pages.parse(r["html"])
        assert got["text"] == text and got["lang"] == tree.lang[:2] and got["title"] == re.sub(r"\s+", " ", html.unescape(tree.title or "")).strip()


def _random_page(r):
    tags = "p div ul li nav aside section table tr td b i a span h2 footer form article dl dt dd".split()
    out, opened = [], []
    for _ in range(r.randint(5, 80)):
        k = r.random()
        if k < 0.35:
            t = r.choice(tags)
            out.append(f'<{t}{r.choice(["", " class=x", " title=" + chr(34) + "a>b" + chr(34)])}>')
            opened.append(t)
        elif k < 0.55 and opened:
            t = opened.pop() if r.random() < 0.8 else r.choice(tags)
            out.append(f"</{t}>")
        elif k < 0.6:
            out.append(r.choice(["<!-- <nav>x</nav> -->", "<br>", "<hr>", '<img src=a alt="p q">', "<script>if (a<b) '</nav>'</script>", "<style>p{}</style>"]))
        else:
            out.append(r.choice([" w%d ", "w%d &amp; v ", "\n w%d&nbsp;é ", "w%d. "]) % r.randint(0, 99))
    return "".join(out)


@pytest.mark.parametrize("seed", range(300))
def test_random_pages(seed):
    page = _random_page(random.Random(seed))
    assert pages.parse(page)["text"] == _tree_text(page)[0], page


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav>a<nav>b</nav>c</nav>d", "d"),
        ("<aside><div>a<aside>b</aside></div>c</aside>d", "d"),
        ("<div><nav>a<ul><li>b</div>c", "c"),
        ("<head><title>t<p>x</title><body>a", "a"),
        ("<head><meta x>text", "text"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<p>a<p>b</p></p>c", "a\nb\nc"),
        ("a<!-- b --> c<!-- d", "a c"),
        ("<script>x</scriptx></script>a<script>b", "a"),
        ("a &lt;b&gt; &eacute;&#233;", "a <b> éé"),
        ("<table><tr><td>a<td>b<tr><td>c<nav>n</table>d", "a\nb\nc\nd"),
        ("<aside>x</aside><main>long main text</main><p>p", "long main text"),
        ("x < y <3 <a href=>z", "x < y <3 z"),
        ("", ""),
        (None, ""),
    ],
)
def test_odd_markup(page, text):
    assert pages.parse(page)["text"] == text


def test_pages_as_rows(spark):
    body = "This is the text of the page and it is not short at all, as all can see."
    rows = [(1, "u", f"<html lang=fr><title>T</title><p>{body}<img alt=pic>", "x"), (2, "u", f"<p>{body}", "x"), (3, "u", "<p>short", "x"), (4, "u", None, "x"), (None, "u", f"<p>{body}", "x"), (1, "u", f"<html lang=fr><title>T</title><p>{body}<img alt=pic>", "x")]
    got = extraction.page_contents(spark.createDataFrame(rows, "page_id long, url string, html string, title string")).collect()
    assert sorted((r["page_id"] or 0, r["language"], r["title"], r["text"], tuple(r["alts"])) for r in got) == sorted([(1, "fr", "T", body, ("pic",))] * 2 + [(2, "en", "", body, ()), (0, "en", "", body, ())])
    assert extraction.page_contents(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
