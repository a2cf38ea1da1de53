"""Labelled training pages: layouts drawn at random, with the label of every text.

Each page puts an article (headline, paragraphs, lists, quotes, tables) and what
surrounds it (menus, headers, side bars, notices, adverts, forms, comments,
footers) into containers that are named by their tag, their class or id, their role, or not at
all. Words are made up, so a model learns from structure and from the form of a
text, not from a language.
"""

from __future__ import annotations

import random

MAIN_NAMES = ["content", "article", "article-body", "post", "post-content", "entry-content", "story", "story-body", "main", "main-content", "page-content", "text", "body-copy", "articleBody", "blog-post", "news-text"]
OTHER_NAMES = {
    "menu": ["nav", "menu", "navbar", "top-menu", "main-nav", "breadcrumb", "breadcrumbs", "toolbar", "tabs", "site-navigation"],
    "header": ["header", "site-header", "masthead", "top", "topbar", "branding", "logo", "banner"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "foot"],
    "side": ["sidebar", "side", "aside", "rail", "right-column", "widget", "widgets", "related", "related-posts", "popular", "trending", "tags", "recommended", "more-stories"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "ad-slot", "partner"],
    "notice": ["cookie", "cookie-banner", "notice", "alert", "consent", "popup", "modal", "overlay", "paywall", "message", "gdpr", "toast", "disclaimer"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "poll"],
    "comment": ["comments", "comment", "comment-list", "discussion", "responses", "replies", "disqus", "reader-comments", "reviews"],
    "share": ["share", "social", "share-buttons", "follow", "meta-links", "pagination", "pager", "skip-link"],
}
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "notice": "alert", "form": "search"}


class Page:
    def __init__(self, rnd: random.Random):
        self.rnd, self.labels = rnd, {}

    def word(self) -> str:
        return "".join(self.rnd.choice("bcdfghklmnprstvw") + self.rnd.choice("aeiouyéöó") for _ in range(self.rnd.randint(1, 4)))

    def text(self, low: int, high: int, main: bool, sentence: bool) -> str:
        """A text that no other block of the page equals."""
        while True:
            words = [self.word() for _ in range(self.rnd.randint(low, high))]
            if sentence:
                for k in range(len(words)):
                    if self.rnd.random() < 0.12:
                        words[k] += self.rnd.choice([",", ".", ".", ";"])
                words[-1] = words[-1].rstrip(",;.") + "."
                r = self.rnd.random()
                if r < 0.08:  # sloppy writing
                    words = [w + self.rnd.choice(["***", "%%%", "###", "$$$", "!!", ""]) for w in words]
                elif r < 0.16:
                    words = " | ".join(words).split(" ")
                elif r < 0.24:
                    words[-1] = words[-1].rstrip(".")
            else:
                words = [w.title() if self.rnd.random() < 0.5 else w for w in words]
            out = " ".join(words)
            out = out[0].upper() + out[1:]
            if out not in self.labels:
                self.labels[out] = main
                return out

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def named(self, names: list[str], tag: str, role: str | None, inner: str) -> str:
        """``inner`` in a container: by tag, class, id or role."""
        r = self.rnd.random()
        if tag != "div" and r < 0.45:
            return f"<{tag}>{inner}</{tag}>"
        if role and r < 0.55:
            return f'<div role="{role}">{inner}</div>'
        how = self.rnd.choice(["class", "class", "id"])
        extra = f" {self.word()}" if self.rnd.random() < 0.3 else ""
        outer = self.rnd.choice(["div", "div", "section"])
        return f'<{outer} {how}="{self.rnd.choice(names)}{extra}">{inner}</{outer}>'

    def other(self, kind: str) -> str:
        rnd, t = self.rnd, lambda a, b, s=False: self.text(a, b, False, s)
        links = lambda n: "<ul>" + "".join(f"<li>{self.link(t(1, 3))}</li>" for _ in range(n)) + "</ul>"
        if kind == "menu":
            inner = links(rnd.randint(3, 8)) if rnd.random() < 0.7 else " ".join(f"<div>{self.link(t(1, 2))}</div>" for _ in range(rnd.randint(2, 6)))
        elif kind == "header":
            inner = f"<h1>{self.link(t(1, 3))}</h1>" * (rnd.random() < 0.4) + f"<p>{t(2, 9)}</p>" + (links(3) if rnd.random() < 0.4 else "")
        elif kind == "footer":
            inner = f"<p>&copy; {t(2, 8)}</p>" if rnd.random() < 0.5 else f"{t(3, 30, True)}"
            inner += links(rnd.randint(0, 4)) + (f"<p>{t(5, 40, True)}</p>" if rnd.random() < 0.4 else "")
        elif kind == "side":
            inner = f"<h3>{t(1, 3)}</h3>" + links(rnd.randint(2, 6)) + (f"<p>{t(5, 30, True)}</p>" if rnd.random() < 0.5 else "")
        elif kind == "ad":
            inner = rnd.choice([f"{t(2, 25, True)}", f"<p>{t(4, 30, True)}</p>", f"<p>{self.link(t(2, 10))}</p>", f"<h4>{t(2, 5)}</h4><p>{t(5, 25, True)}</p>"])
        elif kind == "notice":
            inner = f"<p>{t(6, 40, True)}</p>" + (f"<button>{t(1, 2)}</button>" if rnd.random() < 0.5 else "")
        elif kind == "form":
            inner = f"<p>{t(3, 20, True)}</p><label>{t(1, 3)}</label><input name=q><button>{t(1, 2)}</button>"
            return f'<form action="/x">{inner}</form>' if rnd.random() < 0.6 else self.named(OTHER_NAMES["form"], "form", "search", f"<form>{inner}</form>")
        elif kind == "comment":
            one = lambda: f'<{rnd.choice(["div", "li", "article"])} class="{rnd.choice(["comment", "reply", "comment-body", "response"])}"><h4>{t(1, 2)}</h4><p>{t(3, 60, True)}</p></div>'
            inner = f"<h3>{t(1, 3)}</h3>" + "".join(one() for _ in range(rnd.randint(1, 5)))
        else:
            inner = "".join(f"<div>{self.link(t(1, 2))}</div>" for _ in range(rnd.randint(1, 4)))
        return self.named(OTHER_NAMES[kind], TAGS.get(kind, "div"), ROLES.get(kind), inner)

    def main(self, inside: list[str]) -> str:
        rnd, t = self.rnd, lambda a, b, s=True: self.text(a, b, True, s)
        head = f"<h1>{t(2, 12, False)}</h1>"
        out = [f"<header>{head}</header>" if rnd.random() < 0.15 else head]
        if rnd.random() < 0.25:
            out.append(f"<p><b>{t(3, 15)}<br>")
        for _ in range(rnd.randint(1, 9)):
            r = rnd.random()
            if r < 0.62:
                p = t(1, 6) if rnd.random() < 0.25 else t(6, 90)
                if rnd.random() < 0.2:
                    words = p.split(" ")
                    k = rnd.randrange(len(words))
                    words[k] = rnd.choice([f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", self.link(words[k])])
                    p = " ".join(words)
                out.append(f"<p>{p}" + ("</p>" if rnd.random() < 0.85 else ""))
            elif r < 0.72:
                out.append(f"<h2>{t(1, 8, False)}</h2><p>{t(5, 60)}</p>")
            elif r < 0.82:
                out.append("<ul>" + "".join(f"<li>{t(1, 14, rnd.random() < 0.5)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif r < 0.9:
                out.append(f"<blockquote>{t(5, 40)}</blockquote>" if rnd.random() < 0.5 else f"<pre>{t(4, 30)}</pre>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{t(1, 3, False)}</td><td>{t(1, 8)}</td></tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
        for kind in inside:
            out.insert(rnd.randint(1, len(out)) if kind != "comment" else len(out), self.other(kind))
        inner = "".join(out)
        r = rnd.random()
        if r < 0.45:
            return f"<article>{inner}</article>"
        if r < 0.55:
            return f"<main>{inner}</main>"
        if r < 0.6:
            return f'<div role="main">{inner}</div>'
        if r < 0.67:
            return f"<div>{inner}</div>"
        body = f'<{rnd.choice(["div", "section", "td"])} {rnd.choice(["class", "id"])}="{rnd.choice(MAIN_NAMES)}">{inner}</div>'
        return f"<main>{body}</main>" if rnd.random() < 0.3 else body

    def html(self) -> str:
        rnd = self.rnd
        some = lambda kinds, share: [k for k in kinds if rnd.random() < share]
        before = [self.other(k) for k in some(["notice", "header", "menu", "ad", "share", "form", "side"], 0.45)]
        after = [self.other(k) for k in some(["ad", "share", "side", "comment", "form", "notice", "menu"], 0.4)] + [self.other("footer") for _ in range(rnd.random() < 0.8)]
        body = "".join([*before, self.main(some(["ad", "share", "side", "form", "comment"], 0.12)), *after])
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[str, dict[str, bool]]]:
    """``n`` pages: (html, label of each text: part of the article or not)."""
    out = []
    for k in range(n):
        page = Page(random.Random(f"{seed}:{k}"))
        out.append((page.html(), page.labels))
    return out
