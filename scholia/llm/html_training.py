"""Labelled pages for the block model, made from a few dozen layouts.

Every page says which blocks are its main text.  Layouts vary the container of the
article, the order and the names of what stands around and inside it, and how carefully
tags are closed.  The number of pages is a parameter, so the sample is bounded.
"""

from __future__ import annotations

import random

from scholia.llm.html_blocks import HEADINGS

#: Begins the text of each block that belongs to the article.
MARK = "\u0001"

#: How articles write their paragraphs.
LAYOUTS = ["p"] * 8 + ["div"] * 4 + ["section", "br", "br", "span", "deep", "boxed"]
#: Names that speak of no kind.
PLAIN_NAMES = ["box", "row", "col", "left", "right", "inner", "block", "group", "text1", "c1", "x", "body2", "unit", "cell", "item"]

_SYLLABLES = "ka lo mi ter an el os ri va ne sto pra un de le gra ti on er in".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def sentence(self, low: int = 4, high: int = 20) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?", "", " |", ".***"])

    def prose(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def linked(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def wrap(self, choices: list[tuple[str, str]], inner: str) -> str:
        tag, attributes = self.r.choice(choices)
        return f"<{tag}{' ' + attributes if attributes else ''}>{inner}</{tag}>"

    def menu(self, choices: list[tuple[str, str]]) -> str:
        items = [self.linked(self.words(1, 3)) for _ in range(self.r.randint(2, 8))]
        return self.wrap(choices, "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items))

    def name(self) -> str:
        """An attribute that says nothing."""
        r = self.r
        made = r.choice([lambda: "css-" + "".join(r.choices("0123456789abcdef", k=6)), lambda: "".join(r.choices(_SYLLABLES, k=2)), lambda: r.choice(PLAIN_NAMES)])()
        return r.choice(["", f' class="{made}"', f' class="{made}"', f' id="{made}"'])

    def paragraph(self, kind: str, text: str) -> str:
        """A paragraph as the page's kind of layout writes it."""
        name = self.name() if self.r.random() < 0.3 else ""
        if kind == "br":
            return text + "<br><br>"
        if kind == "span":
            return f"<div{name}><span>{text}</span></div>"
        if kind == "boxed":
            return f"<div{name}><p>{text}</p></div>"
        if kind == "deep":
            return f"<div{name}><div>{text}</div></div>"
        return f"<{kind}{name}>{text}</{kind}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{MARK}{self.words(3, 10).capitalize()}{r.choice(['', '.'])}</h1>")
        close = r.random() < 0.8
        layout = r.choice(LAYOUTS)
        bare = layout == "br"
        tiny = r.random() < 0.2
        for _ in range(r.randint(1, 2 if tiny else 14)):
            kind = r.random()
            if tiny:
                out.append(self.paragraph(layout, (MARK if not bare or not out else "") + self.sentence(1, 5)))
                continue
            text = (MARK if not bare or not out or not out[-1].endswith("<br><br>") else "") + self.prose(1, 5)
            if kind < 0.7 or (bare and 0.78 <= kind):
                if r.random() < 0.2:
                    text = text.replace(" ", " <b>", 1) + ("</b>" if close else "")
                if r.random() < 0.2:
                    text += " " + self.linked(self.words(1, 4)) + " " + self.sentence()
                out.append(f"<p>{text}" + "</p>" * close if layout == "p" else self.paragraph(layout, text))
            elif kind < 0.78:
                out.append(f"<h2>{MARK}{self.words(1, 6).capitalize()}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.91:
                out.append(f"<table><tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr></table>")
            elif kind < 0.94:
                out.append(self.paragraph(layout, f"{MARK}{self.words(1, 3).capitalize()}."))
            elif kind < 0.97:
                out.append(self.advert())
            else:
                out.append(self.aside())
        if r.random() < 0.15 and not bare:
            # parts of an article in sections of their own
            cut = r.randint(0, len(out))
            out = [f"<section{self.name()}>{''.join(x)}</section>" for x in (out[:cut], out[cut:]) if x]
        return "".join(out)

    def advert(self) -> str:
        names = [("div", 'class="ad"'), ("div", 'class="advert-box"'), ("div", 'id="sponsored"'), ("aside", 'class="promo"'), ("div", 'class="banner top"'), ("ins", 'class="adsense"')]
        return self.wrap(names[:5], f"<p>{self.prose(1, 2)}</p>" if self.r.random() < 0.4 else self.sentence())

    def aside(self) -> str:
        names = [("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar"'), ("div", 'id="side"'), ("div", 'class="widget related"'), ("section", 'class="related-posts"'), ("div", 'class="share-links"')]
        inner = f"<h3>{self.words(1, 3)}</h3>" + (f"<p>{self.prose(1, 2)}</p>" if self.r.random() < 0.5 else "")
        return self.wrap(names, inner + "<ul>" + "".join(f"<li>{self.linked(self.words(2, 8))}</li>" for _ in range(self.r.randint(0, 5))) + "</ul>")

    def comments(self) -> str:
        r = self.r
        names = [("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("div", 'class="replies"'), ("ol", 'class="commentlist"')]
        told = r.random() < 0.5
        tag = r.choice(["p", "p", "div", "li"])
        heading = r.choice([f"{r.randint(1, 99)} {{}}", "{}", "Leave a {}", "{} (" + str(r.randint(1, 50)) + ")"]).format(r.choice(HEADINGS["comment"]).capitalize())
        body = ""
        for _ in range(r.randint(1, 6)):
            by = r.choice(["", "", f"<b>{self.words(1, 2).capitalize()}</b> ", f"<div>{self.words(1, 2).capitalize()} {r.randint(1, 30)} {r.choice(['hours', 'days', 'minutes'])} ago</div>"])
            item = f"<{tag}{' class=comment' if told and r.random() < 0.5 else ''}>{self.prose(1, 4)}</{tag}>"
            body += r.choice(["{}", f"<div{self.name()}>{{}}</div>"]).format(by + item + r.choice(["", "", f"<div>{self.linked('Reply')}</div>"]))
        head = r.choice(["h2", "h3", "h3", "h4", "div", "b"])
        # what no name tells mostly has a heading that does
        body = f"<{head}>{heading if not told or r.random() < 0.5 else self.words(1, 3)}</{head}>" * (r.random() < 0.75) + body
        return self.wrap(names, body) if told else f"<{'div' if r.random() < 0.8 else 'section'}{self.name()}>{body}</div>"

    def notice(self) -> str:
        names = [("div", 'class="cookie-notice"'), ("div", 'id="consent"'), ("div", 'class="notice"'), ("div", 'class="alert alert-info"'), ("div", 'class="newsletter"'), ("div", 'role="alert"'), ("dialog", "")]
        return self.wrap(names, f"<p>{self.prose(1, 2)}</p>" + "<button>OK</button>" * (self.r.random() < 0.5))

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name='x'>" for _ in range(self.r.randint(1, 4)))
        return f"<form action='/x'>{f'<p>{self.sentence()}</p>' * (self.r.random() < 0.5)}{fields}<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button></form>"

    def header(self) -> str:
        return self.wrap([("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("header", 'class="site-header"')], f"<div>{self.words(1, 4)}</div>" + f"<p>{self.sentence()}</p>" * (self.r.random() < 0.5))

    def footer(self) -> str:
        text = self.r.choice(["&copy; ", "Copyright ", ""]) + self.words(1, 3) + self.r.choice([" &middot; ", ". ", " "]) + self.prose(1, 2)
        return self.wrap([("footer", ""), ("div", 'class="footer"'), ("div", 'id="footer"'), ("footer", 'class="site-footer"')], text if self.r.random() < 0.6 else f"<p>{text}</p>")

    def page(self) -> str:
        r = self.r
        nav = [("nav", ""), ("nav", 'class="menu"'), ("div", 'class="nav"'), ("div", 'id="menu"'), ("div", 'class="breadcrumbs"'), ("ul", 'class="navbar"')]
        around = [("article", "")] * 5 + [("article", 'class="post"'), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", 'class="post-body"'), ("main", ""), ("main", 'id="main"'), ("div", ""), ("section", ""), ("td", "")]
        if r.random() < 0.35:
            around = [(r.choice(["div", "div", "section"]), self.name().strip())]
        tag, names = r.choice(around)
        inner = self.article()
        if r.random() < 0.15:
            inner += self.comments()
        if r.random() < 0.1:
            inner = f"<header><p>{self.words(2, 5)}</p></header>" + inner if tag != "article" else inner
        # an article may stand in the page's body itself
        body = f"<{tag}{' ' + names if names else ''}>{inner}</{tag}>" if r.random() < 0.93 else inner
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        if r.random() < 0.2:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        before, after = [], []
        for chance, make, place in (
            (0.6, self.header, before), (0.8, lambda: self.menu(nav), before), (0.35, self.advert, before), (0.3, self.notice, before), (0.2, self.form, before), (0.15, self.aside, before),
            (0.3, self.aside, after), (0.3, self.comments, after), (0.25, self.advert, after), (0.2, self.form, after), (0.2, self.notice, after), (0.2, lambda: self.menu(nav), after), (0.85, self.footer, after),
        ):
            if r.random() < chance:
                place.append(make())
        tail = after[-1:]
        rest = after[:-1]
        r.shuffle(rest)
        parts = before + [body] + rest + tail
        head = f"<head><meta charset='utf-8'><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>" + r.choice(["", "\n"]).join(parts) + r.choice(["</body></html>", ""])


def labelled_page(seed: int) -> str:
    """One page; the blocks of its article begin with MARK."""
    return _Page(seed).page()
