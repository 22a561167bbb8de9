"""Extraction over groups that hold a few odd pages."""

import pytest

from fieldloom.llm.html_extract import extract_group

NOTE = "Thank you for reading this page"
PAGE = "<html><body><div class=top><p>The daily host</p></div><div class=x><h1>Head {n}</h1><p>text number {n}</p><p>" + NOTE + "</p></div></body></html>"
ODD = {"null": None, "empty": "", "error": "<html><body><h1>404</h1></body></html>", "cut off": PAGE.format(n=99)[:80], "repeated": PAGE.format(n=98).replace(NOTE, NOTE + "</p><p>" + NOTE)}


@pytest.mark.parametrize("name", [*ODD, "all"])
def test_odd_pages_leave_the_template_to_the_others(name):
    odd = list(ODD.values()) if name == "all" else [ODD[name]]
    texts = extract_group([*odd, *[PAGE.format(n=i) for i in range(20)]])
    assert texts[len(odd) :] == [f"Head {i}\n\ntext number {i}" for i in range(20)]


def test_text_of_few_pages_is_no_template():
    texts = extract_group([PAGE.format(n=i).replace(NOTE, "shared by some" if i < 9 else f"own {i}") for i in range(20)])
    assert all("shared by some" in t for t in texts[:9])
