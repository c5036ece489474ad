"""Main text of layouts labelled by hand: words of main text start with ``m``, all others with ``x``."""

import time

import pytest

from barloom.llm import html_text


def m(n):
    return " ".join(f"m{i}" for i in range(n))


def x(n):
    return " ".join(f"x{i}" for i in range(n))


TITLE, LONG, SHORT = f"<h1>{m(3)}</h1>", f"<p>{m(30)}</p>", f"<p>{m(4)}</p>"
LINK = f'<a href="/">{x(30)}</a>'
LAYOUTS = {
    "page named after its sidebar": f'<div class="layout sidebar-left"><article>{TITLE}{LONG}</article></div>',
    "article in a part called sidebar": f'<div class="sidebar-left"><article>{TITLE}{LONG}</article></div><div>{x(2)}</div>',
    "has comments": f'<div class="post has-comments">{TITLE}{LONG}{SHORT}</div>',
    "article about law": f'<article class="legal">{TITLE}{LONG}</article><div>{x(20)}</div>',
    "no container": f"{TITLE}{LONG}{SHORT}{LONG}<ul><li><a href='/'>{x(2)}</a></li></ul>",
    "no container, one paragraph": f"<nav><a href='/'>{x(1)}</a></nav>{TITLE}{LONG}<footer>{x(9)}</footer>",
    "remarks of readers": f'<article>{TITLE}{LONG}<div class="reader-remarks"><p>{x(40)}</p></div></article>',
    "articles as comments": f'<article>{LONG}</article><section class="comments"><article>{x(40)}</article></section>',
    "links in a row": f"<div>{LINK} {LINK}</div><div>{m(60)}</div>",
    "whole page in a form": f"<form id='f'><main>{LONG}</main><div>{x(5)}</div></form>",
    "form in an article": f"<article>{LONG}<form><p>{x(30)}</p></form>{SHORT}</article>",
    "empty comment": f"<!--><article>{LONG}</article><!---><p>{x(1)}</p>",
    "article in an aside": f"<article>{LONG}</article><aside><article>{x(30)}</article></aside>",
    "no main text": f"<nav><a href='/'>{x(2)}</a></nav><footer>{x(5)}</footer>",
    "link as a paragraph": f"<main>{TITLE}{LONG}<p><a href='/'>{m(5)}</a></p></main><div>{x(8)}</div>",
}


@pytest.fixture(scope="module")
def tree():
    return html_text.trained_tree()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(tree, layout):
    page = LAYOUTS[layout]
    got = " ".join(html_text.main_blocks(f"<html><body>{page}</body></html>", tree)).split()
    wanted = [w for w in page.replace("<", " <").replace(">", "> ").split() if w[0] == "m" and w[1:].isdigit()]
    assert got == wanted


def test_tree_splits_on_links_of_block_and_neighbours(tree):
    def used(node):
        return {html_text.COLUMNS[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert {"words", "link density", "words before", "link density before"} <= used(tree)


def test_held_out_layouts(tree):
    right = count = 0
    for page, mark in html_text.labelled_pages(seed=11):
        found = html_text.blocks(page)
        for block, row in zip(found, html_text.features(found)):
            right += html_text.classify(tree, row) == block[0].startswith(mark)
            count += 1
    assert right >= 0.97 * count


def test_references_end_at_tags():
    assert html_text.blocks("<p>&am<b>p;</b> a&amp;b &lt;i&gt;</p>")[0][0] == "&amp; a&b <i>"


def test_deep_pages_take_linear_time(tree):
    start = time.perf_counter()
    assert html_text.main_blocks("<div>" * 60_000 + "</p>" * 120_000 + f"<article>{m(5)}</article>", tree) == [m(5)]
    assert html_text.main_blocks(f"<article>{m(5)}</article>" + "<i>" * 60_000 + "</div>" * 60_000, tree) == [m(5)]
    assert time.perf_counter() - start < 8
