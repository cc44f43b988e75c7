"""Main text of web pages by union-free wrapper inference.

Pages become trees of tags and texts. A wrapper is a regular expression without
unions over such a tree: each node holds an ordered list of children, each child
is plain, optional, repeated or both, and each text is a constant or a slot. A
page's own tree is first folded (equal neighbours become a repeated group); then
wrappers of the same host are aligned again and again: equal signatures are
matched in order, what one side lacks becomes optional, what one side repeats
becomes repeated, texts that differ become slots. Folding is done for each task
first, then for a bounded number of these at a time, until there is one wrapper a
host, so that a hot host is never gathered.

A node also keeps how much text it holds on an average page, and a bottom-k sample
of its texts, each with some of the pages that have it. From these the wrapper says
of every place of a host what it is: a constant (one text on different pages),
recurring (few texts that come back on page after page: adverts, notices), a slot,
or a group of links; and how much new text a page has there. Each page is read so:

- the region is what holds the new text: the page's ``article`` or ``main`` (or what
  is named so) where that has half of it at least, else the deepest node with nearly
  all of it, and around it headings, paragraphs and bare text; where no node has nearly
  all, the slots;
- groups of constants, of recurring texts and of links are template, in the region
  and around it; headings, paragraphs, lists and tables of the region stay, whatever
  they say;
- a form is template unless it holds the main text; what readers write (a row of alike
  elements in one that is named so) is template however long it is;
- how much a place matters is what the host's pages have there, not what this page
  has, so the article of a page with two words is found beside a long footer.

Names decide where the wrapper leaves it open. Elements that HTML itself calls menu,
footer, aside or form are dropped; names of adverts, menus, sidebars, notices and
comments drop their element unless it holds the host's main text; vaguer names
(``WEAK``) only what has little text of its own. Where a host has one page, or only
copies of one, there is nothing to compare, and the page's own sizes stand for the
host's. With fewer than ``ENOUGH`` different pages the wrapper is not believed where
it would drop most of a page. A page that would be left without text keeps what it has.

A text counts as one of several pages only where what stands beside it differs. Pages
are told from each other by three of their texts, drawn by hash with a chance in
proportion to length, the text in question left out: copies of an article, exact or
(mostly) near, count as one page, so what they share is not taken for template.

Bounded memory: a node with more than ``MOST_KINDS`` kinds of children drops their
names, so that they fold into fewer kinds; a wrapper of more than ``MOST_NODES``
nodes does so with lower bounds and in the end gives up its deepest nodes. Nothing of
a page's text is lost by it: pages are read from their own trees.

Defined results: null and empty html give an empty text; a null url, or one
without a host, belongs to the host with the empty name; markup that never closes
is closed at the end; equal pages of a host have equal texts; further columns are
ignored, and those of ``keep`` may have any names.
"""

from __future__ import annotations

import heapq
import html as entities
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Generator, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import plainly_named, sliced, written

MOST_KINDS = 48
MOST_NODES = 20_000
#: Wrappers of one host that are united in one task.
FAN = 64
#: Texts that a node samples, and pages that it keeps of each.
TEXTS_KEPT, PAGES_KEPT = 8, 4
#: Texts by which a page is told from others.
DRAWN = 3
#: Different pages from which on a wrapper is believed against most of a page.
ENOUGH = 3
#: Pages of a host above which its rules are dealt over several tasks, and rules (bytes) up to which they are broadcast.
HOT_PAGES, BROADCAST_BYTES = 200_000, 64 << 20

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title".split())
#: Those of RAW that last to the end of the page where they are never closed.
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav aside footer script style noscript template iframe svg math object canvas textarea title head button select option input dialog menu audio video".split())
#: Those of DROPPED and others that stand within a line and don't end it.
WITHIN = frozenset("script style noscript template iframe svg math object canvas textarea button select option input audio video label".split())
#: What holds text of an article wherever it stands.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Groups that are the article's even if all pages have the same.
LISTS = frozenset("ul ol dl table tbody figure details".split())
#: Words in class, id and role of what readers write, where it is a row of alike elements.
READERS = frozenset("discussion reply replies response responses thread feedback".split())
#: Words in class, id and role that name what is not the article.
NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored commentlist cookie cookies consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside comment comments respond disqus footer foot masthead".split())
#: Words that may name such things, or what an article is about: they drop only what has little text of its own.
WEAK = frozenset("promo promoted promotion banner notification alert popup modal overlay paywall subscribe subscription newsletter signup widget widgets related recommended share sharing social reply replies discussion topbar toolbar login search pagination pager copyright disclaimer".split())
#: Non-link characters that make an element with a weak name content: where the name stands alone, and beside other names.
PLAIN_TEXT = (80, 20)
#: The same for names as a whole.
NAMED_WHOLE = frozenset("header site-header page-header global-header top bottom legal hidden toc".split())
#: Words before a name of NAMED or WEAK in one compound that make it tell of something else.
TELLING = frozenset("has have no not without with is hide hides in category categories cat tag tags topic topics type format".split())
#: Words after such a name that only say what form it has.
FORMS = frozenset("area banner bar block body bottom box button buttons container content form group header inner item items left link links list panel right row section slot sticky text title top unit widget wrap wrapper primary secondary main desktop mobile 0".split())
#: Elements that are never dropped for their names.
KEPT = frozenset("# html body main article".split())
#: Elements that group others: such groups can be template within the region.
GROUPS = frozenset("div section span ul ol dl table tbody figure center details fieldset".split())
ARTICLE = frozenset("article post entry story content main body articlebody post-body post-content entry-content article-body article-content main-content maincontent".split())
#: What an opening tag of these closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Node:
    __slots__ = ("children", "fixed", "hidden", "level", "mark", "seal", "signature", "size", "tag", "weak")

    def __init__(self, tag: str, signature: str, template: bool = False, weak: int = 0, level: int = 0):
        self.tag, self.signature, self.hidden, self.weak, self.level = tag, signature, template, weak, level
        self.children: list[Node | str] = []
        self.size = self.seal = self.mark = 0
        self.fixed = False


def _element(tag: str, attributes: str) -> Node:
    """A node; its role comes from all its names, which the signature holds, or a hash of them."""
    names = frozenset()
    if attributes and "=" in attributes:
        names = frozenset(w for m in ATTRIBUTE.finditer(attributes) for w in re.sub(r"\d+", "0", (m[2] or m[3] or m[4] or "").lower()).split())
    return Node(tag, *_role(tag, names))


@lru_cache(1 << 14)
def _role(tag: str, names: frozenset[str]) -> tuple[str, bool, int, int]:
    """Signature, whether it is template, how much text its weak name gives way to, and how far it is an article."""
    signature = ".".join([tag, *sorted(names)])
    if len(signature) > 80:
        signature = f"{tag}.#{hash_of(signature):08x}"
    vague = [n for n in names if _names_template(n, WEAK) or _begins_with_template(n)]
    weak = tag not in KEPT and bool(vague)
    alone = not any(n not in FORMS and n not in vague for n in names)
    return signature, template_words(tag, names), (PLAIN_TEXT[0] if alone else PLAIN_TEXT[1]) if weak else 0, _is_article(tag, names)


def parse(html: str | None) -> Node:
    """The tree of a page; text stays as it is written, each run one string."""
    root = Node("#", "#")
    stack = [root]
    #: how many elements of each tag are open, so that none is looked for in vain
    opened: Counter[str] = Counter()
    #: RAW elements without a further end tag
    endless: set[str] = set()
    place, text = 0, html or ""

    def words(raw: str) -> None:
        if raw:
            stack[-1].children.append(raw)

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while m := TOKEN.search(text, place):
        words(text[place : m.start()])
        place = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    cut(depth)
                    break
                if stack[depth].tag in ("article", "main", "body", "table") and tag in INLINE:
                    break
            continue
        closing = CLOSES.get(tag)
        if opened["p"] and tag not in INLINE and tag not in VOID | RAW | WITHIN or closing and any(opened[t] for t in closing):
            # a block ends an open paragraph, with the inline elements left open in it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" and tag not in INLINE | WITHIN or closing and stack[depth].tag in closing:
                    cut(depth)
                    break
                if stack[depth].tag not in INLINE and stack[depth].tag not in ("td", "th", "dd", "dt"):
                    break
        node = _element(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            if tag in ("svg", "math") and m[3].endswith("/") or tag in endless:
                continue
            if end := re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, place):
                place = end.end()
            elif tag in TO_THE_END:
                place = len(text)
            else:
                # never closed: an empty element, and what follows is the page's
                endless.add(tag)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    words(text[place:])
    return root


def _clean(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def own_text(node: Node) -> str:
    """A node's own text, without that of its elements."""
    return " ".join([t for c in node.children if isinstance(c, str) and (t := _clean(c))])


def weighed(root: Node) -> tuple[list[Node], list[int]]:
    """Elements that may hold text, in the page's order, and the places of their
    parents; sets ``size`` and ``seal`` (a hash) of their own texts."""
    nodes, up, stack = [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        at = len(nodes)
        nodes.append(node)
        up.append(parent)
        if own := own_text(node):
            node.size, node.seal = len(own), hash_of(own)
        stack += [(c, at) for c in reversed(node.children) if not isinstance(c, str) and c.tag not in VOID and c.tag not in DROPPED]
    return nodes, up


def page_draws(nodes: list[Node]) -> list[int]:
    """The hashes of a few of a page's texts, drawn by hash with a chance in proportion
    to their length: pages that share most of their text mostly draw the same."""
    drawn = heapq.nsmallest(DRAWN + 1, {(-math.log((n.seal + 1) / (1 << 32)) / n.size, n.seal) for n in nodes if n.size})
    return [seal for _, seal in drawn]


def beside(drawn: list[int], seal: int = 0) -> int:
    """What tells a page from others, the text ``seal`` left out of account."""
    return hash_of(str([x for x in drawn if x != seal][:DRAWN]))


# A wrapper node is [signature, optional, repeated, pages, chars, texts, children]: pages that have
# it, own characters on all of them, and a sample of its texts: [hash, hashes of some pages that have
# it], those of the least hashes. The root's only text is 0, so that it holds some of the host's pages.
S, OPTIONAL, REPEATED, PAGES, CHARS, TEXTS, CHILDREN = range(7)


Steps = Generator["Steps", list, list]


def _run(steps: Steps) -> list:
    """The result of steps that yield further ones and go on with their results: recursion without a bound of depth."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def folded(root: Node) -> list:
    """The wrapper of one page's tree."""
    drawn = page_draws(weighed(root)[0])
    made = _run(_folding(root, drawn))
    made[TEXTS] = [[0, [beside(drawn)]]]
    return made


def aligned(a: list, b: list) -> list:
    """The least wrapper of both."""
    return _run(_aligning(a, b))


def _folding(node: Node, drawn: list[int]) -> Steps:
    children: list[list] = []
    for child in node.children:
        if isinstance(child, str) or child.tag in VOID or child.tag in DROPPED:
            continue
        made = yield _folding(child, drawn)
        if children and children[-1][S] == made[S]:
            children[-1] = yield _aligning(children[-1], made, 1)
        else:
            children.append(made)
    children = yield _bounding(children, 1)
    return [node.signature, False, False, 1, node.size, [[node.seal, [beside(drawn, node.seal)]]] if node.size else [], children]


def _sampled(a: list, b: list) -> list:
    """Both samples as one."""
    if not a or not b:
        return a or b
    found = dict(a)
    for text, pages in b:
        if text in found:
            if found[text] != pages:
                found[text] = sorted({*found[text], *pages})[:PAGES_KEPT]
        else:
            found[text] = pages
    return [[text, found[text]] for text in sorted(found)[:TEXTS_KEPT]]


def _aligning(a: list, b: list, most: int = 0) -> Steps:
    """most: both are neighbours under a node of so many pages."""
    pages = min(a[PAGES] + b[PAGES], most or 1 << 62)
    children: list[list] = []
    if a[CHILDREN] or b[CHILDREN]:
        children = yield _sequence(a[CHILDREN], b[CHILDREN])
        children = yield _bounding(children, pages)
    return [a[S], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or most > 0, pages, a[CHARS] + b[CHARS], _sampled(a[TEXTS], b[TEXTS]), children]


def _sequence(a: list[list], b: list[list]) -> Steps:
    """Children of both sides in order: matched ones aligned, others optional."""
    out = []
    if [x[S] for x in a] == [x[S] for x in b]:
        for x, y in zip(a, b, strict=True):
            out.append((yield _aligning(x, y)))
        return out
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][S] == b[j][S] else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][S] == b[j][S]:
            out.append((yield _aligning(a[i], b[j])))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][S], True, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([b[j][S], True, *b[j][REPEATED:]])
            j += 1
    return out


def _general(signature: str) -> str:
    """The tag alone, marked as standing for all names."""
    return signature if signature.endswith("*") else signature.split(".")[0] + "*"


def _bounding(children: list[list], pages: int, most: int = MOST_KINDS) -> Steps:
    """Neighbours of one signature fold into a repeated group; too many kinds lose
    their names and, if the bound is lower than their tags are many, these as well.
    Names once lost stay so for what comes later; beyond the bound order is given up."""
    wide = {c[S] for c in children if c[S].endswith("*")}
    if "*" in wide:
        children = [["*", *c[OPTIONAL:]] for c in children]
    elif wide:
        children = sorted(([g if (g := _general(c[S])) in wide else c[S], *c[OPTIONAL:]] for c in children), key=lambda c: c[S])
    for general in (None, _general, lambda _: "*"):
        if general:
            if len(children) <= most:
                break
            children = sorted(([general(c[S]), *c[OPTIONAL:]] for c in children), key=lambda c: c[S])
        out: list[list] = []
        for c in children:
            if out and out[-1][S] == c[S]:
                out[-1] = yield _aligning(out[-1], c, pages)
                out[-1][OPTIONAL] = out[-1][OPTIONAL] or c[S].endswith("*")
            else:
                out.append(c)
        children = out
    return children


def _lowering(node: list, most: int) -> Steps:
    children = []
    for c in node[CHILDREN]:
        children.append((yield _lowering(c, most)))
    return [*node[:CHILDREN], (yield _bounding(children, node[PAGES], most))]


def fitted(wrapper: list, most: int = MOST_NODES) -> list:
    """The wrapper with at most ``most`` nodes (of their kinds, see :func:`_bounding`;
    what is still too deep is cut off)."""
    for kinds in (16, 4, 1):
        levels = _levels(wrapper)
        if sum(map(len, levels)) <= most:
            return wrapper
        wrapper = _run(_lowering(wrapper, kinds))
    levels = _levels(wrapper)
    held = 0
    for level, below in zip(levels, [*levels[1:], []], strict=True):
        held += len(level)
        if held + len(below) > most:
            for node in level:
                node[CHILDREN] = []
            break
    return wrapper


def _levels(wrapper: list) -> list[list[list]]:
    levels = [[wrapper]]
    while below := [c for node in levels[-1] for c in node[CHILDREN]]:
        levels.append(below)
    return levels


def dumped(wrapper: list) -> str:
    """A wrapper as JSON: its nodes in order, each with the count of its children, so that depth is no nesting."""
    flat, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        flat.append([*node[:CHILDREN], len(node[CHILDREN])])
        stack += reversed(node[CHILDREN])
    return json.dumps(flat, ensure_ascii=False, separators=(",", ":"))


def loaded(text: str) -> list:
    """The wrapper that :func:`dumped` gave."""
    built: list[list] = []
    for *node, count in reversed(json.loads(text)):
        children = built[len(built) - count :][::-1] if count else []
        del built[len(built) - count :]
        built.append([*node, children])
    return built[0]


def template_words(tag: str, names: Iterable[str]) -> bool:
    """Whether an element's names tell that it is not the article. A form may be laid
    around a whole page, so it gives way to the main text (see :func:`_show`)."""
    return tag in DROPPED or tag == "form" or tag not in KEPT and any(name in NAMED_WHOLE or _names_template(name) for name in names)


def _names_template(name: str, words_of: frozenset[str] = NAMED) -> bool:
    """Whether a class, id or role has one of the words for the thing itself: it is one, or ends
    with one (and its form), and does not tell of a state or subject."""
    if name in words_of:
        return True
    words = re.split(r"[-_:]+", name)
    while len(words) > 1 and words[-1] in FORMS and words[-1] not in words_of:
        words.pop()
    return words[-1] in words_of and not TELLING.intersection(words)


def _begins_with_template(name: str) -> bool:
    """Whether a name begins with a word of NAMED and goes on with others: it may be a part of
    such a thing, or what an article is about."""
    words = re.split(r"[-_:]+", name)
    return len(words) > 1 and words[0] in NAMED


def _is_article(tag: str, names: Iterable[str]) -> int:
    """3 article, 2 main, 1 something named so, 0 neither."""
    return 3 if tag == "article" else 2 if tag == "main" or "main" in names else 1 if any(n in ARTICLE for n in names) else 0


def rules_of(wrapper: list) -> list:
    """What a host's wrapper says of its places: how many different pages stand behind
    it (up to PAGES_KEPT), and for each place, parents first, [parent, signature, own
    characters on a page that has it, whether its texts are new, hashes of constants].
    Nodes of one signature under one parent are one place."""
    support = len(wrapper[TEXTS][0][1]) if wrapper[TEXTS] else 0
    places: list[list] = []
    known: dict[tuple[int, str], int] = {}
    stack = [(wrapper, -1)]
    while stack:
        node, parent = stack.pop()
        at = known.setdefault((parent, node[S]), len(places))
        if at == len(places):
            places.append([parent, node[S], 0.0, False, []])
        place = places[at]
        if parent < 0:
            place[2:4] = [round(node[CHARS] / node[PAGES], 1), True]
        elif node[TEXTS]:
            place[2] += round(node[CHARS] / node[PAGES], 1)
            again = sum(len(p) > 1 for _, p in node[TEXTS])
            if again == len(node[TEXTS]) == 1:
                place[4].append(node[TEXTS][0][0])
            elif support < ENOUGH or 2 * again <= len(node[TEXTS]):
                place[3] = True
        stack += [(c, at) for c in node[CHILDREN]]
    return [support, places]


class Rules:
    """A host's places, ready for reading: ``at`` by parent and signature."""

    def __init__(self, found: list | None):
        self.support, places = found or (0, [])
        if self.support < 2:
            places = []
        self.at = {(p, s): k for k, (p, s, *_) in enumerate(places)}
        self.chars = [p[2] for p in places]
        self.new = [p[3] for p in places]
        self.constants = [frozenset(p[4]) for p in places]


def _readers(node: Node) -> bool:
    """Whether an element that is named so is a row of alike elements, each with elements of its
    own: what readers write, however long it is."""
    if node.tag in KEPT or not any(READERS.intersection(re.split(r"[-_:]+", name)) for name in node.signature.split(".")[1:]):
        return False
    inner = [c for c in node.children if not isinstance(c, str)]
    while len(inner) == 1 and inner[0].tag in GROUPS:
        inner = [c for c in inner[0].children if not isinstance(c, str)]
    alike = Counter(c.signature for c in inner if sum(not isinstance(x, str) for x in c.children) > 1)
    return bool(alike) and max(alike.values()) > 1


def _sums(own: list, up: list[int]) -> list:
    out = list(own)
    for at in range(len(out) - 1, 0, -1):
        out[up[at]] += out[at]
    return out


def _placed(nodes: list[Node], up: list[int], rules: Rules) -> list[int]:
    """The place of each element among the host's; -1 where there is none."""
    out: list[int] = []
    for at, node in enumerate(nodes):
        parent = out[up[at]] if at else -1
        out.append(-1 if at and parent < 0 else next((rules.at[k] for s in (node.signature, node.tag + "*", "*") if (k := (parent, s)) in rules.at), -1))
    return out


def _mark(nodes: list[Node], up: list[int], rules: Rules) -> None:
    """Set ``mark`` (2 all text is read, 1 all but constant and recurring texts, 0
    nothing), ``fixed`` (the own text is such) and ``hidden`` of a page's elements."""
    n = range(len(nodes))
    place = _placed(nodes, up, rules)
    for at in n:
        node, p = nodes[at], place[at]
        node.mark, node.fixed = 0, p >= 0 and node.size > 0 and (not rules.new[p] or node.seal in rules.constants[p])
    if rules.support < ENOUGH and 2 * sum(x.size for x in nodes if x.fixed) > sum(x.size for x in nodes):
        # few pages, and they would take most of this one: they are copies of each other
        place = [-1] * len(nodes)
        for node in nodes:
            node.fixed = False
    linked = [False] * len(nodes)
    for at in n:
        linked[at] = nodes[at].tag in ("a", "button") or at > 0 and linked[up[at]]
    # what a page of the host has here, new texts and all of them
    shared: Counter[int] = Counter(place)
    usual = [rules.chars[p] / shared[p] if p >= 0 else float(x.size) for x, p in zip(nodes, place, strict=True)]
    new = [0.0 if x.fixed or p >= 0 and not rules.new[p] else u for x, p, u in zip(nodes, place, usual, strict=True)]
    # a weak name gives way to text of the element's own
    plain = _sums([0.0 if k else max(u, x.size) for x, u, k in zip(nodes, new, linked, strict=True)], up)
    bound = _sums([max(u, x.size) if k else 0.0 for x, u, k in zip(nodes, usual, linked, strict=True)], up)
    for at in n:
        node = nodes[at]
        if node.weak and (plain[at] < node.weak or plain[at] < bound[at]) or _readers(node):
            node.hidden = True
    _show(nodes, up, new)
    outside = [False] * len(nodes)
    for at in n:
        node = nodes[at]
        node.hidden = node.hidden or at > 0 and nodes[up[at]].hidden
        outside[at] = node.hidden or node.tag == "header" or at > 0 and outside[up[at]]
    slots = [0.0 if o or k else u for u, o, k in zip(new, outside, linked, strict=True)]
    if not any(slots):
        # constants or links alone: the page keeps them
        for node in nodes:
            node.fixed = False
        new = usual = [float(x.size) for x in nodes]
        slots = [0.0 if o else u for u, o in zip(new, outside, strict=True)]
        place = [-1] * len(nodes)
    text, slot = _sums([0 if x.hidden else x.size for x in nodes], up), _sums(slots, up)
    level = [x.level if t and x.tag not in ("html", "body") and not o else 0 for x, t, o in zip(nodes, text, outside, strict=True)]
    best = list(level)
    for at in range(len(nodes) - 1, 0, -1):
        best[up[at]] = max(best[up[at]], best[at])
    # the outermost named elements, in them what is named best
    top = [-1] * len(nodes)
    held, rest = 0.0, slot[0]
    around: set[int] = set()
    for at in n:
        top[at] = top[up[at]] if at else -1
        if level[at]:
            if top[at] < 0:
                top[at] = at
                held += max(slot[at], text[at])
                rest -= slot[at]
            nodes[at].mark = 2 if level[at] == best[top[at]] else 1
    if max(level) == 0 or held < rest:
        # no name holds the main text: the slots are read, and the whole of the
        # deepest node, itself without text and not repeated, with nearly all of them
        kinds = [Counter(c.signature for c in x.children if not isinstance(c, str)) for x in nodes]
        core = 0
        for at in n[1:]:
            if slot[0] and slot[at] >= 0.9 * slot[0] and not slots[at] and kinds[up[at]][nodes[at].signature] == 1:
                core = at
        nodes[0].mark = max(nodes[0].mark, 1)
        if core:
            nodes[core].mark = 2
            # around it headings, paragraphs and bare text are read, but no other elements
            at = core
            while at:
                at = up[at]
                around.add(at)
                nodes[at].mark = 1
            for at in n[1:]:
                if nodes[at].tag in CONTENT and not linked[at]:
                    nodes[at].mark = max(nodes[at].mark, 1)
    if rules.support >= ENOUGH:
        _drop_groups(nodes, up, place, usual, new, linked)
    for at in n[1:]:
        if up[at] not in around or nodes[at].tag in INLINE:
            nodes[at].mark = max(nodes[at].mark, nodes[up[at]].mark)


def _drop_groups(nodes: list[Node], up: list[int], place: list[int], usual: list[float], new: list[float], linked: list[bool]) -> None:
    """Hide groups whose texts are all constant or recurring on the host, and groups
    of links; never what holds a marked element."""
    all_of, fresh = _sums(usual, up), _sums(new, up)
    links = _sums([u if k else 0.0 for u, k in zip(new, linked, strict=True)], up)
    holds = [x.mark == 2 for x in nodes]
    for at in range(len(nodes) - 1, 0, -1):
        holds[up[at]] |= holds[at]
    # lists and tables of the region, with all in them, are the article's
    region, own = [False] * len(nodes), [False] * len(nodes)
    for at, node in enumerate(nodes):
        region[at] = node.mark == 2 or at > 0 and region[up[at]]
        own[at] = at > 0 and own[up[at]] or region[at] and node.tag in LISTS and 2 * links[at] < all_of[at]
    for at, node in enumerate(nodes):
        if place[at] >= 0 and node.tag in GROUPS and not holds[at] and not own[at] and all_of[at] > 0:
            if fresh[at] == 0 or node.tag in ("div", "section") and links[at] >= 0.8 * fresh[at]:
                node.hidden = True


def _show(nodes: list[Node], up: list[int], size: list[float]) -> None:
    """Clear ``hidden`` of the elements that are named as template where such a name
    would take the main text: more than all that is left, and ten times what named
    articles still hold."""
    if not any(n.hidden for n in nodes):
        return
    whole = _sums(size, up)
    while True:
        top, article = [-1] * len(nodes), [False] * len(nodes)
        left = held = 0.0
        for at, node in enumerate(nodes):
            top[at] = top[up[at]] if at and top[up[at]] >= 0 else at if node.hidden else -1
            article[at] = at > 0 and article[up[at]] or node.tag not in ("html", "body") and node.level > 0
            if top[at] < 0:
                left += size[at]
                held += size[at] if article[at] else 0
        most = max({at for at in top if at >= 0}, key=lambda at: (whole[at], -at), default=-1)
        if most < 0 or whole[most] <= left or 10 * held >= whole[most]:
            return
        nodes[most].hidden = False


def read(root: Node, rules: Rules) -> str:
    """The article's blocks, one a line."""
    nodes, up = weighed(root)
    named = [n.hidden for n in nodes]
    _mark(nodes, up, rules)
    if text := _blocks(root):
        return text
    # nothing is left: the page's whole text, first without what is named as template
    for unhide in (False, True):
        for node, was in zip(nodes, named, strict=True):
            node.mark, node.hidden = 2, was and not unhide
        if text := _blocks(root):
            return text
    return ""


def _blocks(root: Node) -> str:
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        if open_block:
            if line := " ".join(entities.unescape("".join(open_block)).split()):
                blocks.append(line)
            open_block.clear()

    # an explicit stack: (node, next child)
    stack = [[root, 0]]
    while stack:
        node, at = stack[-1]
        if at >= len(node.children):
            stack.pop()
            if node.tag not in INLINE and node.tag not in WITHIN:
                close()
            continue
        stack[-1][1] += 1
        child = node.children[at]
        if isinstance(child, str):
            if node.mark == 2 or node.mark == 1 and not node.fixed:
                open_block.append(child)
            continue
        if child.tag in VOID:
            if node.mark:
                if child.tag in INLINE or child.tag in WITHIN:
                    open_block.append(" " if child.tag != "wbr" else "")
                else:
                    close()
            continue
        if child.tag in DROPPED or child.hidden or child.tag == "header" and node.mark < 2:
            if child.tag not in INLINE and child.tag not in WITHIN:
                close()
            continue
        if child.tag not in INLINE and child.tag not in WITHIN:
            close()
        stack.append([child, 0])
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merged(wrappers: list[str]) -> str:
    out = loaded(wrappers[0])
    for more in wrappers[1:]:
        out = fitted(aligned(out, loaded(more)))
    return dumped(out)


def wrappers(pages: DataFrame, html: str = "html", fan: int = FAN) -> DataFrame:
    """host, wrapper (JSON) for pages with columns host and ``html``. A task folds its
    own pages of a host; of these wrappers at most about ``fan`` meet in one task, and
    rounds of that go on until a host has so few."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [dumped(fitted(w)) for w in held.values()]}, schema=_FOLDED)
            held.clear()
            return made

        for batch in sliced(batches, "html"):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = folded(parse(html))
                held[host] = aligned(held[host], made) if host in held else made
                count += 1
                if count % 256 == 0:
                    held[host] = fitted(held[host])
            if len(held) > 2000:
                yield flush()
        if held:
            yield flush()

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [_merged(sorted(group["wrapper"]))]})

    parts = written(pages.select("host", F.col(html).alias("html")).mapInArrow(fold, "host string, wrapper string"), "folded")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > fan:
        dealt = parts.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // fan))))
        parts = written(dealt.groupBy("host", "share").applyInPandas(unite, "host string, wrapper string"), "united")
    return parts.groupBy("host").applyInPandas(unite, "host string, wrapper string")


_FOLDED = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _with_rules(hosted: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosted`` with its host's rules: by broadcast where these are small, else by a
    join in which a hot host's pages and rules are dealt over several tasks."""
    size = rules.agg(F.sum(F.octet_length("rules") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return hosted.join(F.broadcast(rules.select("host", "rules")), "host", "left")
    # at most one host in HOT_PAGES pages is hot
    hot = rules.where(F.col("pages") > HOT_PAGES).select("host", F.ceil(F.col("pages") / HOT_PAGES).cast("int").alias("parts"))
    parts = hosted.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("html", *[c for c in hosted.columns if c.startswith("k")]), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    dealt = rules.select("host", "rules", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("pages") / HOT_PAGES).cast("int"), F.lit(1)) - 1)).alias("part"))
    return parts.join(dealt, ["host", "part"], "left").drop("part")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", url: str = "url") -> DataFrame:
    """``keep`` columns with text."""
    plain, names = plainly_named(pages)
    hosted = plain.select(*[F.col(names[c]).alias(f"k{i}") for i, c in enumerate(keep)], F.col(names[html]).alias("html"), host_of(F.col(names[url])).alias("host"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [loaded(w) for w in rows["wrapper"]]
            yield pd.DataFrame({"host": rows["host"], "pages": [w[PAGES] for w in found], "rules": [json.dumps(rules_of(w), ensure_ascii=False, separators=(",", ":")) for w in found]})

    rules = written(wrappers(hosted).mapInPandas(told, "host string, pages long, rules string"), "wrappers")
    joined = _with_rules(hosted, rules).select(*[f"k{i}" for i in range(len(keep))], "rules", "html")
    schema = ", ".join([*(f"k{i} {hosted.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Rules] = {}
        n = len(keep)
        for batch in sliced(batches, "html"):
            texts = []
            for rule, body in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if rule not in known:
                    known.clear() if len(known) > 500 else None
                    known[rule] = Rules(json.loads(rule) if rule else None)
                texts.append(read(parse(body), known[rule]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(texts, pa.string())], names=[*(f"k{i}" for i in range(n)), "text"])

    return joined.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
