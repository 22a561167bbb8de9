"""Extraction loses no main text to names, to shared lines, to links or to the size of a host; and its cost follows the page's length."""

import random
import time

import pytest

from fieldloom.llm.html_extract import Page, extract_group

from .test_template import plain_pages, prose


@pytest.mark.parametrize("n", [1, 2, 12])
@pytest.mark.parametrize("name", ["related", "share", "promo", "social", "notice", "post-header", "comments-wrap"])
def test_a_name_never_empties_a_page(name, n):
    rng = random.Random(5)
    stories = [[prose(rng, 30), prose(rng, 20)] for _ in range(n)]
    pages = [f"<html><body><nav>Home News</nav><div class='{name}'><p>{a}</p><p>{b}</p></div><footer>Site {k}</footer></body></html>" for k, (a, b) in enumerate(stories)]
    assert extract_group(pages) == [f"{a}\n\n{b}" for a, b in stories]


@pytest.mark.parametrize("n", [2, 6, 12, 40])
def test_a_marked_article_keeps_what_many_pages_share(n):
    rng = random.Random(6)
    pages, want = [], []
    for k in range(n):
        rows = [(f"Label {r}", prose(rng, 3)) for r in range(20)]
        pages.append(f"<body><nav>Home</nav><article><h1>Head {k}</h1><table>{''.join(f'<tr><td>{a}</td><td>{b}</td></tr>' for a, b in rows)}</table><p>All prices are in coins.</p><p>End of {k}</p></article></body>")
        want.append("\n\n".join([f"Head {k}", *[x for r in rows for x in r], "All prices are in coins.", f"End of {k}"]))
    assert extract_group(pages) == want


@pytest.mark.parametrize("n", [4, 12, 40])
def test_a_closing_line_of_some_pages_stays_in_a_marked_article(n):
    rng = random.Random(9)
    texts = [[prose(rng, 30), "A passage that others have as well" if k else prose(rng, 5)] for k in range(n)]
    page = "<body><nav>Home</nav><article><p>{}</p><p>{}</p></article><footer>Site</footer></body>"
    assert extract_group([page.format(*t) for t in texts]) == ["\n\n".join(t) for t in texts]
    texts = [[a, "It stands on all of them."] for a, _ in texts]
    assert extract_group([page.format(*t) for t in texts]) == ["\n\n".join(t) for t in texts]


@pytest.mark.parametrize("n", [3, 12])
def test_shared_lines_between_main_text_stay_in_unmarked_pages(n):
    rng = random.Random(7)
    texts = [[prose(rng, 30), "What we found", prose(rng, 30)] for _ in range(n)]
    pages = [f"<body><div><ul><li><a href=/>Home</a></ul></div><div><p>{a}</p><p>{b}</p><p>{c}</p></div><div>Copyright 2020</div></body>" for a, b, c in texts]
    assert extract_group(pages) == ["\n\n".join(t) for t in texts]


def test_a_page_of_one_link_keeps_it():
    rng = random.Random(8)
    texts = [prose(rng, 25) for _ in range(12)]
    pages = [f"<body><div>Site name</div><div><p><a href=/x>{t}</a></p></div><div>Copyright 2020</div></body>" for t in texts]
    assert extract_group(pages) == texts


@pytest.mark.parametrize("tag", ["div", "article", "section class=x"])
def test_deep_nesting_is_linear(tag):
    name = tag.split()[0]
    pages = ["<body>" + f"<{tag}>" * n + f"story {n}" + f"</{name}>" * n + "</body>" for n in (100_000, 99_999)]
    begin = time.process_time()
    got = extract_group(pages)
    assert [g.strip() for g in got] == ["story 100000", "story 99999"]
    assert time.process_time() - begin < 20


def test_many_odd_tokens_are_linear():
    pages = ["<body>" + "".join(f"<p id=a{(k * 7 + p) % 9000}>t{k % 5}</p><section class=c{(k + p) % 7000}>" for k in range(9000)) + f"<p>story {p}</p></body>" for p in range(6)]
    begin = time.process_time()
    assert all(f"story {p}" in t for p, t in enumerate(extract_group(pages)))
    assert time.process_time() - begin < 20


def test_larger_hosts_change_nothing():
    for n in (2, 7, 8, 9, 30):
        pages = plain_pages(n, seed=n)
        assert extract_group([p for p, _ in pages]) == [t for _, t in pages]


def test_boxes_below_a_region():
    page = Page("<div class=related><div class=share>a</div><p>b</p></div>")
    inside = [False, True, True]
    assert page.apart == [False, True, True]
    above = [not i or not inside[page.parent[b]] for b, i in enumerate(inside)]
    assert page.apart_below(above, True) == [False, False, True]
