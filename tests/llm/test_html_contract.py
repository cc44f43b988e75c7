"""Faults of the contract that were found once, and wrappers against a brute-force matcher."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from corpusloom.llm import extract as E

TEXT = "This is the text of the article, and it is long enough to be one. " * 4


def texts(pages):
    """The text of each page with the wrapper of them all."""
    made = E.folded(E.parse(pages[0]))
    for page in pages[1:]:
        made = E.aligned(made, E.folded(E.parse(page)))
    rules = E.Rules(E.rules_of(E.fitted(made)))
    return [E.read(E.parse(p), rules) for p in pages]


def both(page_of):
    """What pages say with a host of five and alone."""
    pages = [page_of(k) for k in range(5)]
    return [texts(pages), [E.read(E.parse(p), E.Rules(None)) for p in pages]]


@pytest.mark.parametrize("form", ["<form action='x'>{}</form>", "<form action='/search'><input name='q'>{}"])
def test_form_around_the_page(form):
    for found in both(lambda k: "<body>" + form.format(f"<article><p>{k} {TEXT}</p><p>more {k}</p></article>") + "</body>"):
        assert found == [f"{k} {TEXT.strip()}\nmore {k}" for k in range(5)]


def test_form_beside_and_in_the_article():
    page = lambda k: f"<body><form><label>Find it</label><input></form><article><p>{k} {TEXT}</p><form><p>Sign up now</p><input></form></article></body>"
    for found in both(page):
        assert found == [f"{k} {TEXT.strip()}" for k in range(5)]


@pytest.mark.parametrize("within", ["<svg/>", "<svg><path/></svg>", "<button>x</button>", "<script>var a</script>", "<input>", "<select><option>a</option></select>"])
def test_dropped_elements_within_a_line(within):
    for found in both(lambda k: f"<article><p>{k} One {within} two</p><p>{TEXT}{k}</p></article>"):
        assert found == [f"{k} One two\n{TEXT}{k}" for k in range(5)]


@pytest.mark.parametrize("same", ["<ul><li>Boil the water</li><li>Add the salt</li></ul>", "<table><tr><td>Boil the water</td></tr><tr><td>Add the salt</td></tr></table>", "<ol><li><div>Boil the water</div></li><li><div>Add the salt</div></li></ol>"])
def test_lists_that_all_pages_have_stay(same):
    for found in both(lambda k: f"<nav><a href='/'>Home</a></nav><article><p>{k} {TEXT}</p>{same}</article><footer>Foot</footer>"):
        assert found == [f"{k} {TEXT.strip()}\nBoil the water\nAdd the salt" for k in range(5)]


@pytest.mark.parametrize("name", ["div class='discussion'", "div class='replies-box'", "div class='responses'", "ol class='commentlist'"])
def test_reader_comments_go(name):
    said = lambda k, j: f"<div class='one'><b>Reader {j}</b><p>I think {k} {j} that {TEXT}</p></div>"
    page = lambda k: f"<article><p>{k} {TEXT}</p><{name}>{said(k, 1)}{said(k, 2)}{said(k, 3)}</{name.split()[0]}></article>"
    for found in both(page):
        assert found == [f"{k} {TEXT.strip()}" for k in range(5)]


@pytest.mark.parametrize("name", ["notice-board-history", "menu-planning", "discussion", "sidebar-design"])
def test_names_of_subjects_stay(name):
    for found in both(lambda k: f"<article><p>{k} {TEXT}</p><div class='{name}'><p>{k} {TEXT}</p></div></article>"):
        assert found == [f"{k} {TEXT.strip()}\n{k} {TEXT.strip()}" for k in range(5)]


@pytest.mark.parametrize("name", ["notice", "site-menu", "sidebar-left", "ad-slot", "cookie-banner", "ads_top".replace("_", "-")])
def test_names_of_template_go(name):
    for found in both(lambda k: f"<body><div class='{name}'><span>Things {k}</span></div><article><p>{k} {TEXT}</p></article></body>"):
        assert found == [f"{k} {TEXT.strip()}" for k in range(5)]


def test_wrappers_find_the_article_without_names():
    """Pages of a table with their elements' names made meaningless: the host's wrapper finds the text of all of them."""
    rows = duckdb.sql("SELECT url, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()

    def renamed(html):
        for tag, name in (("nav", "qa"), ("article", "qb"), ("footer", "qc")):
            html = re.sub(rf"<{tag}\b", f'<div class="{name}"', html).replace(f"</{tag}>", "</div>")
        return html.replace('class="ad"', 'class="qd"')

    hosts = {}
    for url, html in rows:
        hosts.setdefault(re.match(r"\w+://([^/?#:]*)", url)[1], []).append(html)
    right = alone = 0
    for pages in hosts.values():
        want, other = texts(pages), [renamed(p) for p in pages]
        right += sum(a == b for a, b in zip(want, texts(other), strict=True))
        alone += sum(a == E.read(E.parse(p), E.Rules(None)) for a, p in zip(want, other, strict=True))
    assert right >= 0.85 * len(rows) and right > alone, (right, alone)


def accepts(wrapper, node):
    """Whether a wrapper describes a tree, by trying all ways to read its children."""
    if wrapper[E.S] != node.signature:
        return False
    inner = [c for c in node.children if not isinstance(c, str) and c.tag not in E.VOID and c.tag not in E.DROPPED]

    def fits(k, at):
        if k == len(wrapper[E.CHILDREN]):
            return at == len(inner)
        child = wrapper[E.CHILDREN][k]
        if child[E.OPTIONAL] and fits(k + 1, at):
            return True
        if at == len(inner) or not accepts(child, inner[at]):
            return False
        return fits(k + 1, at + 1) or child[E.REPEATED] and fits(k, at + 1)

    return fits(0, 0)


@pytest.mark.parametrize("seed", range(30))
def test_wrappers_describe_all_their_pages(seed):
    rng = random.Random(seed)

    def tree(depth):
        tags = rng.choices(["div", "p", "ul", "b"], k=rng.randint(0, 3))
        return "".join(f"<{t}>{rng.choice(['', 'x', 'y'])}{tree(depth - 1) if depth else ''}</{t}>" for t in tags)

    pages = [E.parse(f"<body>{tree(2)}</body>") for _ in range(4)]
    made = E.folded(pages[0])
    for page in pages[1:]:
        made = E.aligned(made, E.folded(page))
    assert all(accepts(made, page) for page in pages)
    assert not accepts(E.folded(E.parse("<body><div>a</div></body>")), E.parse("<body><p>a</p></body>"))
