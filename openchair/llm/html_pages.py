"""Labelled pages for training: layouts drawn from a grammar of common page parts, with invented sentences.

Which texts belong to the article is known from the drawing. Parts stand in different orders and under different tags and
class names, some tags are left open, so that a model must weigh ancestors, texts and neighbours against each other.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ar ble da de el en er fo ga in is ka la le lo ma mi na ne no or pa ra re ri sa se si so ta te ti to ur ve".split()


class _Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.main: set[str] = set()

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.phrase(3, 18) + self.rng.choice("....?!") for _ in range(self.rng.randint(low, high)))

    def pick(self, options: str) -> str:
        return self.rng.choice(options.split("|"))

    def wrap(self, options: str, inner: str) -> str:
        """options: tags with an optional class, as `tag` or `tag.class` or `tag#id`."""
        chosen = self.pick(options)
        for mark, name in ((".", "class"), ("#", "id")):
            if mark in chosen:
                tag, value = chosen.split(mark)
                return f'<{tag} {name}="{value}">{inner}</{tag}>'
        return f"<{chosen}>{inner}</{chosen}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/{self.word()}">{self.phrase(1, 3)}</a></li>' for _ in range(self.rng.randint(low, high))]
        return f"<ul>{''.join(items)}</ul>"

    def menu(self) -> str:
        return self.wrap("nav|div.menu|div.navbar|div#nav|nav.main-nav|div.breadcrumbs", self.links(3, 8))

    def header(self) -> str:
        return self.wrap("header|div.header|div#masthead|div.site-header", f"<a href='/'>{self.phrase(1, 3)}</a><p>{self.phrase(2, 6)}</p>")

    def notice(self) -> str:
        inner = f"<p>{self.sentences(1, 2)}</p><button>{self.phrase(1, 2)}</button>"
        return self.wrap("div.cookie-notice|div.notice|div.alert|div#consent|div.banner|div.popup", inner)

    def advert(self) -> str:
        text = self.sentences(1, 2)
        return self.wrap("div.ad|div.ads|div.advert|div.sponsored|aside.promo|div#ad-top", self.pick(f"{text}|<p>{text}</p>"))

    def sidebar(self) -> str:
        inner = f"<h3>{self.phrase(1, 3)}</h3>{self.links(2, 6)}<p>{self.sentences(1, 2)}</p>"
        return self.wrap("aside|div.sidebar|div#sidebar|div.widget|div.related", inner)

    def form(self) -> str:
        fields = "".join(f"<label>{self.phrase(1, 2)}</label><input type=text>" for _ in range(self.rng.randint(1, 3)))
        return f"<form>{self.phrase(2, 6)} {fields}<button>{self.phrase(1, 2)}</button></form>"

    def comments(self) -> str:
        texts = "".join(
            self.wrap("div.comment|li.comment|article.comment", f"<span>{self.phrase(1, 2)}</span><p>{self.sentences(1, 4)}</p>")
            for _ in range(self.rng.randint(1, 5))
        )
        return self.wrap("section#comments|div.comments|div#comments|div.comment-list|ol.commentlist", f"<h3>{self.phrase(1, 2)}</h3>{texts}")

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.word()}.example {self.sentences(1, 1)}|<p>&copy; {self.phrase(2, 5)}</p>{self.links(2, 5)}")
        return self.wrap("footer|div.footer|div#footer|footer.site-footer", inner)

    def own(self, text: str) -> str:
        self.main.add(text)
        return text

    def article(self) -> str:
        parts = [f"<h1>{self.own(self.phrase(3, 12))}</h1>"]
        for _ in range(self.rng.randint(2, 9)):
            rows = " | ".join(self.word() for _ in range(self.rng.randint(4, 20)))
            text = self.own(self.rng.choice([self.sentences(1, 6)] * 4 + [self.phrase(1, 2) + ".", self.phrase(4, 25), rows]))
            tag = self.rng.choice(["p"] * 8 + ["h2", "blockquote", "pre", "div", "list", "cell", "open"])
            if tag == "list":
                parts.append(f"<ul><li>{text}</li><li>{self.own(self.sentences(1, 2))}</li></ul>")
            elif tag == "cell":
                parts.append(f"<table><tr><td>{text}</td></tr></table>")
            elif tag == "open":
                parts.append(f"<p><b>{text}<br>")
            else:
                parts.append(f"<{tag}>{text}</{tag}>")
        for part in (self.advert, self.form, self.sidebar):
            if self.rng.random() < 0.15:
                parts.insert(self.rng.randint(1, len(parts)), part())
        options = "article|article|article.post|main|div.content|div#content|div.post-body|div.entry-content|section.story|div.article-text|td"
        whole = self.wrap(options, "".join(parts))
        return self.rng.choice([whole, f"<main>{whole}</main>", f'<div class="wrapper">{whole}</div>'])

    def draw(self) -> str:
        before = [part() for part in (self.header, self.menu, self.notice, self.advert, self.sidebar) if self.rng.random() < 0.55]
        after = [part() for part in (self.sidebar, self.advert, self.comments, self.form, self.menu, self.footer) if self.rng.random() < 0.5]
        self.rng.shuffle(before)
        end = self.rng.choice(["</body></html>", "", "</html>"])
        return f"<html><head><title>{self.phrase(2, 6)}</title></head><body>{''.join(before)}{self.article()}{''.join(after)}{end}"


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, set[str]]]:
    """(html, texts of its article's blocks) of n pages."""
    out = []
    for i in range(n):
        page = _Page(seed * 1_000_003 + i)
        out.append((page.draw(), page.main))
    return out
