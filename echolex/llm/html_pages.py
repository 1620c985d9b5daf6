"""Labelled training pages, made by rule from a seed: articles in many layouts among menus, notices, adverts, comments."""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an er in on ul est and ing ent tion que mar del chen ver".split()
MAIN, OTHER = 1, 0


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(1, 18)).capitalize() + r.choice("....?!") for _ in range(n))


def labelled_page(r: random.Random) -> list[tuple[str, int | None]]:
    """Pieces of markup in page order; a piece that makes a block has its label."""
    out: list[tuple[str, int | None]] = []
    add = lambda markup, label=None: out.append((markup, label))
    cls = lambda *names: f' class="{r.choice(names)}"' if r.random() < 0.85 else f' id="{r.choice(names)}"'

    def links(label: int = OTHER) -> None:
        add("<ul>")
        for _ in range(r.randint(2, 7)):
            add(f'<li><a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))}</a>{r.choice(["</li>", ""])}', label)
        add("</ul>")

    def aside(kind: str) -> None:
        if kind == "menu":
            tag = r.choice(["<nav>", f"<div{cls('nav', 'menu', 'navbar', 'breadcrumb', 'navigation')}>", f"<nav{cls('main-nav', 'menu')}>"])
            add(tag)
            links()
        elif kind == "header":
            tag = r.choice(["<header>", f"<div{cls('header', 'site-header', 'masthead', 'top-bar')}>"])
            add(tag)
            add(f"<{(h := r.choice(['p', 'div', 'h2', 'h1']))}>{_words(r, r.randint(1, 4))}</{h}>", OTHER)
            if r.random() < 0.4:
                links()
        elif kind == "footer":
            tag = r.choice(["<footer>", f"<div{cls('footer', 'site-footer', 'bottom')}>"])
            add(tag)
            if r.random() < 0.4:
                links()
            add(r.choice(["", "<p>"]) + r.choice(["&copy; ", "Copyright ", ""]) + f"{_words(r, 1)}.example.com &middot; {_sentences(r, r.randint(1, 4))}", OTHER)
        elif kind == "sidebar":
            tag = r.choice(["<aside>", f"<div{cls('sidebar', 'widget', 'related', 'side', 'recommended', 'popular')}>"])
            add(tag)
            add(f"<h3>{_words(r, 2)}</h3>", OTHER)
            if r.random() < 0.5:
                links()
            else:
                add(f"<p>{_sentences(r, r.randint(1, 3))}</p>", OTHER)
        elif kind == "notice":
            tag = f"<div{cls('cookie', 'cookie-notice', 'notice', 'banner', 'consent', 'gdpr', 'alert', 'popup', 'newsletter', 'subscribe')}>"
            add(tag)
            add(f"<p>{_sentences(r, r.randint(1, 3))}", OTHER)
            if r.random() < 0.4:
                add(f"<button>{_words(r, 1)}</button>", OTHER)
        elif kind == "advert":
            tag = r.choice([f"<div{cls('ad', 'ads', 'advert', 'advertisement', 'promo', 'sponsored', 'banner-ad', 'ad-slot')}>", f"<aside{cls('ad', 'promo')}>"])
            add(tag)
            add(r.choice(["", "<p>"]) + _sentences(r, r.randint(1, 4)), OTHER)
        elif kind == "form":
            tag = f"<form{cls('search', 'login', 'contact', 'subscribe') if r.random() < 0.6 else ''}>"
            add(tag)
            for _ in range(r.randint(1, 3)):
                add(f"<p><label>{_words(r, r.randint(1, 3))}</label> <input type=text>", OTHER)
        else:
            tag = r.choice([f"<section{cls('comments', 'comment-list', 'responses', 'discussion', 'replies')}>", f"<div{cls('comments', 'comments-area', 'disqus')}>"])
            add(tag)
            add(f"<h3>{_words(r, 2)}</h3>", OTHER)
            for _ in range(r.randint(1, 4)):
                add(f"<div{cls('comment', 'reply', 'comment-body')}>")
                add(f"<p>{_sentences(r, r.randint(1, 4))}</p>", OTHER)
                add("</div>")
        name = tag[1:].split(">")[0].split()[0]
        add(f"</{name}>")

    add(f'<!DOCTYPE html><html lang="{r.choice(["en", "de", "fr"])}"><head><meta charset="utf-8">')
    add(f"<title>{_words(r, 6)}</title>", OTHER)
    add("</head><body>")
    for kind in r.sample(["menu", "header", "notice", "advert", "form", "sidebar"], r.randint(0, 5)):
        aside(kind)
    opening = r.choice(["<article>", "<article>", "<article>", f"<article{cls('post', 'entry')}>", "<main>", "<main><article>", f"<div{cls('content', 'article', 'post', 'entry-content', 'story', 'article-body', 'main-content', 'post-content')}>"])
    add(opening)
    if r.random() < 0.9:
        add(f"<h1>{_sentences(r, 1)}</h1>", MAIN)
    for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
        x = r.random()
        if x < 0.7:
            add(f"<p>{r.choice(['', '', '<b>'])}{_sentences(r, r.choice([1, 1, 2, 4, 8]))}{r.choice(['</p>', '</p>', '<br>', ''])}", MAIN)
        elif x < 0.78:
            add(f"<{(h := r.choice(['h2', 'h3']))}>{_words(r, r.randint(1, 6))}</{h}>", MAIN)
        elif x < 0.83:
            add(f"<blockquote>{_sentences(r, 2)}</blockquote>", MAIN)
        elif x < 0.88:
            add(f'<p><a href="/x">{_words(r, 3)}</a> {_sentences(r, 2)}</p>', MAIN)
        elif x < 0.93:
            add("<ul>")
            for _ in range(r.randint(1, 4)):
                add(f"<li>{_sentences(r, 1)}</li>", MAIN)
            add("</ul>")
        elif x < 0.96:
            aside(r.choice(["advert", "sidebar", "form", "notice", "menu"]))
        else:
            add(f"<table><tr><td>{_words(r, 3)}</td></tr></table>" if r.random() < 0.5 else f"<pre>{_words(r, 8)}</pre>", MAIN)
    if r.random() < 0.3:
        aside("comments")
    for name in reversed([x.split()[0] for x in opening[1:-1].split("><")]):
        add(f"</{name}>")
    for kind in r.sample(["comments", "sidebar", "advert", "notice", "form", "menu"], r.randint(0, 3)):
        aside(kind)
    if r.random() < 0.9:
        aside("footer")
    if r.random() < 0.8:
        add("</body></html>")
    return out


def training_pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages, each with (its text without markup, label) of its labelled pieces in order."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        pieces = labelled_page(r)
        pages.append(("".join(m for m, _ in pieces), [(m, y) for m, y in pieces if y is not None]))
    return pages
