"""Operator 6: pages keep their whole text (no Spark: wrappers are merged as its tasks merge them)."""

from __future__ import annotations

from corpusloom.llm import extract


def rules_of(*pages):
    wrapper, *more = [extract.folded(extract.parse(page)) for page in pages]
    for other in more:
        wrapper = extract.aligned(wrapper, other)
    return extract.Rules(extract.rules_of(extract.loaded(extract.dumped(extract.fitted(wrapper)))))


def texts(*pages):
    """Texts of the pages of one host."""
    known = rules_of(*pages)
    return [extract.read(extract.parse(page), known) for page in pages]


def alone(*pages):
    """Texts of pages, each read with its own tree only."""
    return [extract.read(extract.parse(page), extract.Rules(None)) for page in pages]


def words(n, k=60):
    return f"start{n} " + f"word{n} " * k + f"end{n}"


def test_each_template_of_a_host_is_read():
    kinds = ["article", "main", 'div class="post-content"', 'div class="x"']
    pages = [f'<html><body><p class="nav">menu</p><{k}><h1>T{n}</h1><p>{words(n)}</p></{k.split()[0]}></body></html>' for n, k in enumerate(kinds * 3)]
    assert texts(*pages) == [f"T{n}\n{words(n)}" for n in range(12)]


def test_small_templates_and_lead_paragraphs_of_unnamed_hosts_are_read():
    big = [f"<body><div class=k><i>All rights</i></div><h1>Head {n}</h1><p>Lead {n}</p><div class=a><p>{words(n, 500)}</p><p>{words(-n, 500)}</p></div></body>" for n in range(1, 10)]
    small = "<body><section class=b><h1>Few</h1><p>Short text of another template.</p></section></body>"
    got = texts(*big, small)
    assert got[:9] == [f"Head {n}\nLead {n}\n{words(n, 500)}\n{words(-n, 500)}" for n in range(1, 10)]
    assert got[9] == "Few\nShort text of another template."


def test_hosts_with_more_kinds_of_articles_than_the_bound():
    slug = lambda n: f"{chr(97 + n // 26)}q{chr(97 + n % 26)}"
    pages = [f'<body><main><div class="s-{slug(n)}"><em>All rights</em><article class="c-{slug(n)} hentry"><p>{words(n)}</p></article></div></main></body>' for n in range(80)]
    assert texts(*pages) == [words(n) for n in range(80)]
    many = "".join(f'<article class="k{slug(n)}"><p>{words(n, 3)}</p></article><hr>' for n in range(80))
    assert texts(f"<body>{many}</body>", f"<body>{many}<p>x</p></body>")[0] == "\n".join(words(n, 3) for n in range(80))


def test_names_that_tell_of_something_else_drop_no_article():
    for outer, inner in (('body class="has-sidebar no-comments"', "article"), ("body", 'main class="with-sidebar"'), ("body", 'article class="category-social tag-search promoted"'), ("body", 'div class="post category-social"'), ('div class="social"', "section")):
        pages = [f'<{outer}><div class="site-nav-wrapper"><i>menu {n}</i></div><{inner}><p>{words(n)}</p><div class="share-buttons">Share {n}</div></{inner.split()[0]}><section class="comments"><p>Nice {n}</p></section></{outer.split()[0]}>' for n in range(4)]
        assert texts(*pages) == [words(n) for n in range(4)], (outer, inner)
        assert texts(pages[0]) == [words(0)], (outer, inner)


def test_long_comments_stay_out_beside_an_article():
    assert texts(*[f'<body><article><p>{words(n, 9)}</p></article><div id="comments"><article class="comment"><p>{words(n, 50)}</p></article></div></body>' for n in range(3)]) == [words(n, 9) for n in range(3)]


def test_roles_come_from_all_names():
    utility = "bg-white border flex gap-2 mb-4 p-6 rounded"
    pages = [f'<body><div class="{utility} sidebar"><p>Side {n} {words(n, 50)}</p></div><div class="{utility} xl post-content"><p>{words(n)}</p></div><div class="{utility} text-sm widget"><p>Tags {n}</p></div></body>' for n in range(4)]
    assert texts(*pages) == [words(n) for n in range(4)]
    a, b = (extract.parse(f'<div class="{utility} {x}">').children[0].signature for x in ("sidebar", "story"))
    assert a != b and a.startswith("div.") and len(extract.parse(f'<p class="{" ".join(f"name-{chr(97 + k)}" for k in range(20))}">').children[0].signature) < 20


def test_deep_nests_neither_close_what_is_outside_nor_leak():
    deep = "<div>" * 400 + "deep" + "</div>" * 400
    page = f"<body><div><article><p>{words(1)}</p>{deep}<p>{words(2)}</p></article></div></body>"
    assert texts(page, page.replace("start", "begin"))[0] == f"{words(1)}\ndeep\n{words(2)}"
    unclosed = "<body><article>" + "".join(f"<font>f{n} " for n in range(300)) + f'<div class="comments"><p>bad</p></div><p>{words(3)}</p></article></body>'
    assert texts(unclosed) == [" ".join(f"f{n}" for n in range(300)) + f"\n{words(3)}"]
    wrapper = extract.folded(extract.parse("<div>" * 20000 + "deep"))
    text = extract.dumped(extract.aligned(wrapper, wrapper))
    assert extract.dumped(extract.loaded(text)) == text and alone("<div>" * 20000 + "deep") == ["deep"]


def test_copies_of_a_page_erase_nothing():
    page = "<h1>Title</h1><p>Short.</p><div>Also short.</div>"
    assert texts(page) == ["Title\nShort.\nAlso short."] and texts(page, page) == texts(page) * 2 and texts(*[page] * 5) == texts(page) * 5
    # a copy's texts are slots even where other pages of the host have constants
    other = "<section><i>Legal text</i><p>{}</p></section><section><i>Legal text</i></section>"
    got = texts(page, page, other.format("One."), other.format("Two."))
    assert got[:2] == texts(page) * 2 and got[2:] == ["One.", "Two."]


def test_constants_take_no_other_text_of_their_path():
    pages = [f"<div>All rights</div><h1>Head {n}</h1>{f'<div>Other {n}</div>' if n == 3 else '<div>All rights</div>'}<p>{words(n)}</p>" for n in range(4)]
    constant = extract.Rules([4, [[-1, "#", 0.0, True, []], [0, "div", 10.0, False, [extract.hash_of("All rights")]], [0, "h1", 6.0, True, []], [0, "p", 400.0, True, []]]])
    assert extract.read(extract.parse(pages[0]), constant) == f"Head 0\n{words(0)}"
    assert "Other 3" in texts(*pages)[3] and "All rights" not in "".join(texts(*pages[:3]))


def test_raw_elements_that_are_empty_or_never_closed_cut_nothing():
    for raw in ("<svg class='icon'/>", '<svg class="icon" />', "<math/>", "<canvas>", "<object data=x>", "<svg class='icon'>", "<iframe src=x>", "<noscript>"):
        page = f"<body>{raw}<article>{raw}<p>{words(1)}</p>{raw}<p>{words(2)}</p></article></body>"
        assert texts(page) == [f"{words(1)}\n{words(2)}"], raw
    icons = f"<article><svg/><p>{words(1)}</p><svg><text>no</text></svg><p>{words(2)}</p><script>let a = 1"
    assert texts(icons) == [f"{words(1)}\n{words(2)}"]


LEGAL = "This service may show what others wrote, and none of it is ours to answer for; " * 12


def hashed_page(n):
    """A page whose names mean nothing, without elements that tell: a menu, a box of few texts
    that come back, the article, links to other pages, and a long notice."""
    menu = "".join(f'<span class="k3"><a href="/{x}">{x}</a></span>' for x in ("start", "about us", "contact"))
    links = "".join(f'<span class="k9"><a href="/{n}{x}">See also number {n} {x} of these</a></span>' for x in range(6))
    lead = f'<p class="q">Lead of {n}.</p>' if n % 2 else ""
    body = "".join(f"<p>{words(n * 10 + k, 3)}</p>" for k in range(1 + n % 3))
    return f'<html><body><div class="a1">{menu}</div><div class="b2"><b>Buy number {n % 2} now</b></div><div class="c3"><h1>Head {n}</h1>{lead}{body}</div><div class="d4">{links}</div><div class="e5"><p>{LEGAL}</p></div></body></html>'


def article_of(n):
    lead = [f"Lead of {n}."] if n % 2 else []
    return "\n".join([f"Head {n}", *lead, *(words(n * 10 + k, 3) for k in range(1 + n % 3))])


def test_the_wrapper_decides_where_names_tell_nothing():
    pages = [hashed_page(n) for n in range(12)]
    assert texts(*pages) == [article_of(n) for n in range(12)]
    # a page's own tree can't tell the notice from the article
    assert all(got != article_of(n) and "none of it is ours" in got for n, got in enumerate(alone(*pages)))
    # copies of one page, however many, change nothing
    assert texts(*pages, *[pages[3]] * 200)[:12] == [article_of(n) for n in range(12)]


def test_short_pages_are_read_by_what_the_host_has():
    foot = "Telling at some length what the site is for, as on no other page: "
    page = lambda n, body: f'<body><div class="x1"><h1>T{n}</h1><div class="x2">{body}</div></div><div class="x3"><i>{foot * 3}</i></div></body>'
    pages = [page(n, f"<p>{words(n)}</p><p>{words(-n)}</p>") for n in range(1, 8)] + [page(8, "<p>Short.</p>")]
    assert texts(*pages)[7] == "T8\nShort." and foot.strip() in alone(pages[7])[0]


def test_copies_of_an_article_are_no_template():
    same = "".join(f"<p>{words(k)}</p>" for k in range(4))
    pages = [f'<html><body><div class="r1">Offer of the day {n * 37 % 11}</div><div class="r2"><h1>One text</h1>{same}</div></body></html>' for n in range(3)]
    assert all("\n".join(["One text", *(words(k) for k in range(4))]) in got for got in texts(*pages))


def test_the_host_wrapper_changes_no_named_article():
    """Constants in headings and paragraphs of an article stay; constant groups in it go."""
    pages = [f'<body><article><h1>T{n}</h1><h2>Summary</h2><p>{words(n)}</p><p>Licensed as usual.</p><div class="u7"><span>Rate this</span></div></article></body>' for n in range(6)]
    assert texts(*pages) == [f"T{n}\nSummary\n{words(n)}\nLicensed as usual." for n in range(6)]


def test_names_of_subjects_and_of_many_names():
    history = '<article><h1>T</h1><p>{}</p><section class="social history"><p>How people lived in the towns of that time.</p></section></article>'
    assert texts(history.format(words(1))) == [f"T\n{words(1)}\nHow people lived in the towns of that time."]
    many = '<article><div class="a b c d e f sidebar"><p>Side</p></div><p>{}</p></article>'
    assert texts(many.format(words(1))) == [words(1)]
    deep = "<article><p>{}</p>" + "<div>" * 200 + "<nav>menu</nav>" + "</div>" * 200 + "</article>"
    assert texts(deep.format(words(1))) == [words(1)]


def test_large_wrappers_are_bounded_without_loss():
    wide = "".join(f'<x-{k} class="c{k}"><p>{words(k, 2)}</p></x-{k}><hr>' for k in range(300))
    wrapper = extract.folded(extract.parse(wide))
    assert sum(map(len, extract._levels(wrapper))) < 200
    pages = [f"<body>{wide}<p>{words(n)}</p></body>" for n in range(3)]
    assert all(words(299, 2) in got and words(n) in got for n, got in enumerate(alone(*pages)))
    tall = extract.folded(extract.parse("<div>" * 500 + "deep"))
    assert sum(map(len, extract._levels(extract.fitted(tall, 100)))) <= 100
    assert sum(map(len, extract._levels(extract.fitted(extract.folded(extract.parse("".join(f"<p>a<i>{k}</i><u><b>{k}</b></u></p><div></div>" for k in range(50)))), 5)))) <= 6
