"""HTML to markdown: the article's elements, each written as its mark."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an element puts before and after its content.
MARKS = {
    "h1": ("\n\n# ", "\n\n"), "h2": ("\n\n## ", "\n\n"), "h3": ("\n\n### ", "\n\n"), "h4": ("\n\n#### ", "\n\n"), "h5": ("\n\n#### ", "\n\n"), "h6": ("\n\n#### ", "\n\n"),
    "p": ("\n\n", "\n\n"), "div": ("\n\n", "\n\n"), "strong": ("**", "**"), "b": ("**", "**"), "em": ("_", "_"), "i": ("_", "_"), "ul": ("\n", "\n"), "ol": ("\n", "\n"), "li": ("\n- ", ""),
    "sup": ("<sup>", "</sup>"), "sub": ("<sub>", "</sub>"), "tr": ("", "\n"), "td": ("", " | "), "th": ("", " | "), "br": ("\n", ""),
}
#: Elements that are left out with all they hold.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "link", "meta"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "blockquote", "pre", "footer", "header", "nav", "aside", "main", "form"}


class _Writer(HTMLParser):
    """Writes every candidate root at once; a root is (rank, number of its opening)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.skip = 0
        self.best: tuple[int, list[str]] | None = None
        self.current: list[tuple[int, int, list[str]]] = []

    @staticmethod
    def rank(tag: str, attributes: dict) -> int | None:
        if tag == "article":
            return 0
        if tag == "main":
            return 1
        if attributes.get("id") == "article-body":
            return 2
        if "article-body" in (attributes.get("class") or "").split():
            return 3
        return 4 if tag == "body" else None

    def put(self, text: str) -> None:
        for _, _, out in self.current:
            out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        if tag == "li" and any(t == "li" for t, _ in self.open):
            depth = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in ("li", "ul", "ol"))
            if self.open[depth][0] == "li":
                self.handle_endtag("li")
        dropped = tag in SKIPPED
        if not self.skip and not dropped:
            self.put(MARKS.get(tag, ("", ""))[0])
        if tag in VOID:
            return
        self.open.append((tag, dropped))
        self.skip += dropped
        rank = self.rank(tag, dict(attrs))
        if rank is not None and not any(r <= rank for r, _, _ in self.current) and (self.best is None or rank < self.best[0]):
            self.current.append((rank, len(self.open), []))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            last, dropped = self.open.pop()
            self.skip -= dropped
            for root in [r for r in self.current if r[1] == len(self.open) + 1]:
                self.current.remove(root)
                if self.best is None or root[0] < self.best[0]:
                    self.best = (root[0], root[2])
            if not self.skip and not dropped:
                self.put(MARKS.get(last, ("", ""))[1])
            if last == tag:
                return

    def handle_data(self, data):
        if not self.skip:
            self.put(data.strip())

    def result(self) -> str:
        while self.open:
            self.handle_endtag(self.open[-1][0])
        return "".join(self.best[1]) if self.best else ""


def to_markdown(html: str) -> str:
    """Markdown of the first article, main, #article-body, .article-body or body; at most two blank lines in a row."""
    writer = _Writer()
    if "<body" not in html.lower():
        html = "<body>" + html
    writer.feed(html)
    writer.close()
    lines, blank = [], 0
    for line in writer.result().split("\n"):
        blank = blank + 1 if not line.strip() else 0
        if blank == 0:
            lines.append(line)
        elif blank <= 2:
            lines.append("")
    return "\n".join(lines).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(pages: pd.Series) -> pd.Series:
    """Arrow batches of pages; null stays null."""
    return pages.map(lambda h: None if h is None else to_markdown(h))
