"""Extraction by the template alone: pages without any telling names."""

import random

import pytest

from fieldloom.llm import html_extract
from fieldloom.llm.html_extract import extract_group

WORDS = "sea sky stone over under light water never iron wood field harbour winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def plain_pages(n, seed=1):
    """Pages of divs: a menu, an advert that varies, the text, a visitor's note that varies, a footer; and the text."""
    rng, out = random.Random(seed), []
    for k in range(n):
        text = [f"Head {k} {prose(rng, 4)}", *[prose(rng, rng.randint(15, 40)) for _ in range(rng.randint(2, 6))]]
        menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rng.sample(WORDS, 5))
        body = f"<div><ul>{menu}</ul></div><div>{prose(rng, 6)}</div><div><h2>{text[0]}</h2>{''.join(f'<p>{t}</p>' for t in text[1:])}</div><div>Logged in {k}</div><div>Copyright 2020 by the site</div>"
        out.append((f"<html><head><title>{k}</title></head><body>{body}</body></html>", "\n\n".join(text)))
    return out


@pytest.mark.parametrize("n", [2, 3, 7, 12, 64])
def test_the_template_finds_the_text(n):
    pages = plain_pages(n)
    assert extract_group([p for p, _ in pages]) == [t for _, t in pages]


def test_without_a_template_every_page_changes(monkeypatch):
    pages = plain_pages(20)
    monkeypatch.setattr(html_extract, "template", lambda pages: None)
    got = extract_group([p for p, _ in pages])
    assert all(g != t and t in g for g, (_, t) in zip(got, pages))


def test_odd_pages_cost_the_others_nothing():
    pages = plain_pages(20)
    odd = [None, "", "<html><body><h1>404</h1></body></html>", pages[3][0][:90], "plain"]
    assert extract_group([*odd, *[p for p, _ in pages]])[len(odd) :] == [t for _, t in pages]


@pytest.mark.parametrize("name", ["layout with-sidebar", "has-sidebar", "page no-header", "content-share-enabled", "site-header-wrap sidebar"])
def test_a_layout_named_after_its_neighbours_keeps_its_article(name):
    pages = [f"<body><nav>Home</nav><div class='{name}'><article><h1>Head {k}</h1><p>story {k}</p></article><aside>aside {k}</aside></div></body>" for k in range(9)]
    for n in (1, 2, 9):
        assert extract_group(pages[:n]) == [f"Head {k}\n\nstory {k}" for k in range(n)]


def test_comments_that_are_articles_are_no_article():
    page = "<body><article><h1>Head {k}</h1><p>story {k}</p></article><section class=comments><article><p>reader {k} says</p></article><article class=comment>more {k}</article></section></body>"
    for n in (1, 3):
        assert extract_group([page.format(k=k) for k in range(n)]) == [f"Head {k}\n\nstory {k}" for k in range(n)]


@pytest.mark.parametrize("n", [7, 12])
def test_table_pages_of_small_and_large_hosts_agree(n):
    rng = random.Random(3)
    stories = [prose(rng, 60) for _ in range(n)]
    pages = [f"<table><tr><td>Site name<td>Home | About<tr><td>{s}<tr><td>Copyright 2020</table>" for s in stories]
    assert extract_group(pages) == stories
