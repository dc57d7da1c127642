"""Labelled pages for training the extractor, made from templates.

``labelled_pages`` gives HTML whose main-text elements carry the attribute data-main. The
templates vary in how sites mark up articles, menus, notices and the rest; the words are
invented, so that a model learns structure and the look of text, not a vocabulary.
"""

from __future__ import annotations

import random

# How sites commonly name the parts of a page.
CONTENT = ["article", "main", "div class='content'", "div id='content'", "div class='post-content'", "div class='entry-content'", "section class='article-body'", "div class='story'", "div class='post'", "div id='main'", "section", "div", "div class='page'", "div class='container'", "div role='main'", "article class='post'"]
MENUS = ["nav", "div class='menu'", "div id='nav'", "ul class='navigation'", "div class='navbar'", "div class='breadcrumbs'", "div role='navigation'", "nav class='main-menu'", "div class='pagination'", "div class='tags'", "div class='toc'"]
HEADERS = ["header", "div id='header'", "div class='site-header'", "div class='masthead'", "div class='topbar'", "div role='banner'", "header class='page-header'"]
FOOTERS = ["footer", "div id='footer'", "div class='site-footer'", "div class='copyright'", "div class='legal'", "div role='contentinfo'"]
SIDES = ["aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related'", "section class='related-posts'", "div class='recommended'", "div role='complementary'", "aside class='sidebar'", "div class='popular'", "div class='author-box'"]
NOTICES = ["div class='cookie-notice'", "div id='cookie-banner'", "div class='consent'", "div class='notice'", "div class='popup'", "div class='modal'", "div class='alert'", "div class='gdpr'", "div class='banner'", "section class='cookies'", "div role='dialog'", "div role='alert'", "dialog", "div class='paywall'", "div class='disclaimer'"]
ADVERTS = ["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div id='ad-slot'", "div class='sponsored'", "div class='promo'", "aside class='ad'", "section class='sponsor'", "p class='ad'", "ins class='adsbygoogle'", "div class='ad-banner'", "div class='promoted'"]
FORMS = ["form", "form class='search'", "div class='newsletter'", "div class='subscribe'", "form id='login'", "div class='signup'", "fieldset"]
COMMENTS = ["div class='comments'", "div id='comments'", "section class='comments'", "section id='comments'", "ol class='comment-list'", "div class='comment'", "div class='replies'", "div id='disqus_thread'", "div class='discussion'", "section class='reader-comments'", "div class='responses'", "div class='user-comments'"]
SHARES = ["div class='share'", "div class='social'", "ul class='social-links'", "div class='meta'"]
SYLLABLES = "an be co de er fi gu ha in jo ka le mi no or pa qu re st tion un ver wo xi ya zu ment eau sch ung cion lich ado".split()


def tag(spec: str, body: str) -> str:
    return f"<{spec}>{body}</{spec.split()[0]}>"


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, n: int) -> str:
        out = [self.word() for _ in range(max(1, n))]
        style = self.r.random()
        if style < 0.06:
            out = [w + self.r.choice(["%%%", "***", "$$$", "&amp;&amp;", "###"]) for w in out]
        elif style < 0.1:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.14:
            out = " | ".join(out).split(" ")
        return " ".join(out)

    def sentence(self, n: int) -> str:
        text = self.words(n)
        return text[:1].upper() + text[1:] + self.r.choice([".", ".", ".", "?", "!", ""])

    def text(self, longest: int = 6) -> str:
        return " ".join(self.sentence(self.r.choice([1, 3, 6, 10, 18, 30])) for _ in range(self.r.randint(1, longest)))

    def links(self, n: int) -> str:
        item = self.r.choice(["li", "li", "a", "div", "span"])
        a = [f"<a href='/{i}'>{self.words(self.r.randint(1, 3))}</a>" for i in range(n)]
        body = "".join(a) if item == "a" else "".join(tag(item, x) for x in a)
        return tag("ul", body) if item == "li" else body

    def other(self, kinds: list[str]) -> str:
        """A part that is not main text."""
        spec, r = self.r.choice(kinds), self.r
        inner = [self.links(r.randint(2, 8)) if kinds in (MENUS, SHARES) or r.random() < 0.3 else "", self.sentence(r.randint(1, 25)) if kinds not in (MENUS,) and r.random() < 0.6 else ""]
        if kinds is FORMS or r.random() < 0.1:
            inner.append(f"<label>{self.words(2)}</label><input type='text'><button>{self.words(1)}</button>")
        if kinds is HEADERS and r.random() < 0.4:
            inner.append(tag(r.choice(["h1", "h1", "div class='logo'", "p class='site-title'"]), self.sentence(r.randint(1, 4))))
        if kinds in (COMMENTS, SIDES, NOTICES, ADVERTS, FORMS) and r.random() < 0.7 or kinds is HEADERS and r.random() < 0.3:
            inner += [tag(r.choice(["p", "div", "h3", "p"]), self.text(3)) for _ in range(r.randint(1, 5 if kinds is COMMENTS else 2))]
        if kinds is COMMENTS and r.random() < 0.5:
            inner = [tag("div class='comment'", tag("span class='author'", self.word()) + tag("p", self.text(4))) for _ in range(r.randint(1, 6))]
        body = "".join(inner) or self.sentence(4)
        return tag(spec, body)

    def main(self, wrap: bool = True) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1 data-main>{self.sentence(r.randint(1, 12))}</h1>"
            if wrap and r.random() < 0.25:
                title = tag(r.choice(["header", "header class='entry-header'", "div class='title'", "div class='post-header'", "div class='headline'"]), title)
            out.append(title)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                inline = self.text()
                if r.random() < 0.3:
                    inline = f"<b>{inline}" + ("</b>" if r.random() < 0.5 else "<br>")
                if r.random() < 0.2:
                    inline += f" <a href='/x'>{self.words(2)}</a> {self.words(3)}."
                out.append(f"<p data-main>{inline}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.78:
                out.append(tag(f"{r.choice(['h2', 'h3', 'h4'])} data-main", self.sentence(r.randint(1, 6))))
            elif kind < 0.86:
                out.append(tag(r.choice(["ul", "ol"]), "".join(f"<li data-main>{self.sentence(r.randint(1, 14))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6)))))
            elif kind < 0.9:
                out.append(tag("blockquote data-main", tag("p", self.text(3)) if r.random() < 0.5 else self.text(3)))
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td data-main>{self.words(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(tag(r.choice(["pre", "figcaption", "div", "div class='text'"]) + " data-main", self.text(3)))
            else:
                out.append(tag("section", f"<h2 data-main>{self.sentence(3)}</h2><p data-main>{self.text()}</p>"))
            if r.random() < 0.08:
                out.append(self.other(r.choice([ADVERTS, ADVERTS, SHARES, SIDES, FORMS, NOTICES])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        bare = 0.0 if r.random() < 0.06 else 1.0  # a page of main text alone
        some = lambda p, kinds: self.other(kinds) if r.random() < p * bare else ""
        top = [some(0.4, NOTICES), some(0.4, HEADERS), some(0.7, MENUS), some(0.4, ADVERTS), some(0.2, FORMS)]
        r.shuffle(top)
        spec = r.choice(CONTENT)
        loose = r.random() < 0.1  # main text right in the body
        inner = some(0.1, SHARES) + some(0.1, MENUS) + self.main(not loose) + some(0.2, SHARES) + some(0.15, ADVERTS) + some(0.12, COMMENTS) + some(0.1, FOOTERS)
        content = inner if loose else tag(spec, inner)
        if r.random() < 0.3:
            content = tag(r.choice(["div class='wrapper'", "main", "div id='page'", "div"]), content + some(0.3, SIDES))
        end = [some(0.35, SIDES), some(0.4, COMMENTS), some(0.15, FORMS), some(0.15, ADVERTS), some(0.2, NOTICES)]
        r.shuffle(end)
        head = f"<head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{content}{''.join(end)}{some(0.6, FOOTERS)}</body></html>"


def labelled_pages(n: int = 900, seed: int = 11) -> list[str]:
    return [Writer(seed * 100_003 + i).page() for i in range(n)]
