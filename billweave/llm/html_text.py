"""Main text of web pages by composite text density.

A page is read into a small tree of elements (arrays of parents, tags and counts; no markup is kept).
Boilerplate is left out by what its tag or its class, id and role say: menus, headers and footers of the
page, sidebars, notices, adverts, forms, scripts, styles, reader comments. A class or id that has other words
besides (``social-history``), or one that page builders put around anything (``widget``), only tells so of
elements that hold neither the largest density sum nor most of the characters where that is found. A form is
left out if it has less than ``FORM_CHARS`` characters for each of its fields, and else treated alike. No name
rules out what holds a ``main`` element, or, comments apart, ten times the text of all that would stay.
For every element that stays,
its composite density is the characters per tag, adjusted by the share of characters and tags in links.
An element's density sum is that of its children; the container with the largest sum is the main text.
An enclosing ``article`` or ``main`` widens it. Where there is none, other blocks follow if they are at
least as dense as the thinnest element on the way from the main text up to the body.

Blocks are the runs of text between block elements. Character references are decoded, white space within
a block becomes one blank, and the blocks are joined by two line breaks in the order of the page.

Work is linear in the length of a page; nesting is kept in arrays, so its depth does not matter. Rows stay
where they are; nothing is shuffled.

Edge cases: a null or empty page, or one without any text that stays, has the text "". Text without markup
is one block. Unclosed elements, comments and quotes end where a browser would end them, at the latest with
the page. Repeated rows are read alike. An empty table gives an empty table; a column named like a new one
is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from billweave.llm.common import map_batches, texts

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: An opening tag ends open elements of these kinds, up to the nearest element of the second kind.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ol ul menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}

# What is not main text, by tag and by the words of class, id and role.
DROPPED = frozenset(
    "script style noscript template title head iframe object embed applet svg canvas audio video map nav footer aside button "
    "select textarea input datalist dialog menu noembed noframes xmp search".split()
)
CHROME = frozenset(
    "nav navbar navbars navigation menu menus menubar mainnav mainmenu topnav subnav sidenav sidemenu megamenu topbar "
    "footer footers sitefooter pagefooter contentinfo sidebar sidebars aside complementary rail "
    "ad ads advert adverts advertisement advertisements advertising adbox adsbygoogle adsense adslot adspace adunit banner banners "
    "promo promos promotion sponsor sponsored cookie cookies cookiebanner cookiebar cookienotice consent gdpr notice notices sitenotice "
    "notification notifications alert alerts popup popups modal overlay dialog newsletter subscribe subscription signup login "
    "search searchbox searchform form comment comments commentlist commentbox commentform commentarea commentsection commentthread "
    "commentbody commenttext respond reply replies disqus discussion share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager toolbar widget widgets skip skiplink disclaimer".split()
)
#: Like the ``header`` element: part of the text inside an article.
HEADS = frozenset("header headers masthead siteheader pageheader".split())
#: A class with one of these describes what is inside or next to the element (``has-sidebar``).
AROUND = frozenset("has with no not without".split())
#: Words that leave a name with one of ``CHROME`` what it is (``comment-list``, ``sidebar-left``).
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons col column container content cta global group holder icon icons inner item items "
    "left link links list main outer page panel primary right row secondary section site slot text top unit wrap wrapper".split()
)
#: Of ``CHROME``, what a longer name may well have as its topic (``category-search``).
TOPICS = frozenset(
    "ad ads advertising alert alerts consent discussion form login notice notices notification notifications promo promotion "
    "recommended related reply replies respond search share sharing signup social sponsored subscribe subscription widget widgets".split()
)
#: Of ``CHROME``, what says little even alone.
WEAK = frozenset("discussion widget widgets".split())
#: Names of reader comments, which may well be longer than the text.
COMMENTS = frozenset(
    "comment comments commentlist commentbox commentform commentarea commentsection commentthread commentbody commenttext "
    "respond reply replies disqus".split()
)
#: A form with less text for each field is one to be filled in; one with more is a wrapper of the page.
FORM_CHARS = 300
FIELDS = frozenset("input textarea select button".split())
#: Names are not believed if what they rule out has so many times the text of what is left.
TOO_MUCH = 10
KEEPS = frozenset("html body article main".split())
CONTAINERS = frozenset("html body article main section div td th center blockquote table tbody tr details figure dl ul ol font span".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]*))*+)>"
    r"|</?([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_OPENING = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])")
_MARKS = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_NO_FIELD = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def is_hidden(attributes: str) -> bool:
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def is_chrome(attributes: str, inside: bool) -> bool | None:
    """Whether class, id or role tells that an element is not main text; None if only weak names, or names
    with other words besides, do. ``inside``: it is in an article, which may have a head of its own."""
    found: bool | None = False
    unwanted = CHROME if inside else CHROME | HEADS
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for one in value.split():
                words = _WORD.findall(_CAMEL.sub("-", one).lower())
                if AROUND.isdisjoint(words) and not unwanted.isdisjoint(words):
                    core = [w for w in words if w not in NEUTRAL and not w.isdigit()] or words
                    if not WEAK.issuperset(core) and (unwanted.issuperset(core) or core[-1] in unwanted - TOPICS):
                        return True
                    found = None
    return found


class Page:
    """The elements of a page in the order of their opening tags; 0 is the page itself."""

    def __init__(self, html: str, by_class: bool = True) -> None:
        self.by_class = by_class
        self.tags, self.parents, self.dropped = ["html"], [0], [False]
        self.named: list[int] = []  # elements dropped by their names
        self.comments: set[int] = set()  # of these, reader comments
        self.unsure: list[int] = []  # elements to be dropped unless they hold the main text
        self.weak: list[int] = []  # of these, forms
        self.fields: list[int] = []
        self.opened: Counter[str] = Counter()
        self.runs: list[tuple[int, str | None]] = []  # element and text; None: a block begins or ends
        self.open = [0]
        at, last = 0, html.rfind(">") + 1
        while at < last and (token := _TOKEN.search(html, at, last)):
            self._text(html[at : token.start()])
            at = token.end()
            if token[0].startswith("<!--") and not token[0].endswith(("-->", "--!>")):
                return
            name = token[1] or token[3]
            if name is None:
                continue
            name = name.lower()
            if html[token.start() + 1] == "/":
                self._close(name)
                continue
            self._start(name, token[2] or token[4] or "")
            if name in RAW:
                end = _CLOSING[name].search(html, at)
                at = end.start() if end else len(html)
        # A tag or comment that the page does not end is no text.
        rest = _OPENING.search(html, at)
        self._text(html[at : rest.start()] if rest else html[at:])

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self.open[-1], text))

    def _start(self, name: str, attributes: str) -> None:
        tags, stack = self.tags, self.open
        if name == "html" or name == "body" and self.opened["body"]:
            return
        if name in ENDS_P:
            self._end_up_to(frozenset(["p"]), frozenset("article section div td th li table button main body form aside".split()))
        if name in ENDS:
            self._end_up_to(*ENDS[name])
        if name in BLOCKS or name == "br":
            self.runs.append((stack[-1], None if name in BLOCKS else " "))
        parent = stack[-1]
        drop = name in DROPPED
        inside = bool(self.opened["article"] or self.opened["main"])
        if name in FIELDS and not (name == "input" and _NO_FIELD.search(attributes)):
            self.fields.append(len(tags))
        if name == "form":
            self.weak.append(len(tags))
        if not drop:
            if name == "header":
                drop = not inside
            elif attributes and self.by_class and (name not in KEEPS or name == "article" and "comment" in attributes.lower()):
                drop = is_hidden(attributes)
                chrome = not drop and is_chrome(attributes, inside)
                if chrome:
                    self.named.append(len(tags))
                    if not COMMENTS.isdisjoint(_WORD.findall(_CAMEL.sub("-", attributes).lower())):
                        self.comments.add(len(tags))
                elif chrome is None:
                    self.unsure.append(len(tags))
        tags.append(name)
        self.parents.append(parent)
        self.dropped.append(drop)
        if name not in VOID:
            stack.append(len(tags) - 1)
            self.opened[name] += 1

    def _end_from(self, k: int) -> None:
        self.opened.subtract(self.tags[i] for i in self.open[k:])
        del self.open[k:]

    def _end_up_to(self, kinds: frozenset, borders: frozenset) -> None:
        """End the open element of one of these kinds that is furthest out, below the nearest border."""
        if not any(self.opened[kind] for kind in kinds):
            return
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[k]]
            if tag in borders:
                break
            if tag in kinds:
                found = k
        if found is not None:
            self.runs.append((self.open[-1], None))
            self._end_from(found)

    def _close(self, name: str) -> None:
        if name in ("html", "body") or not self.opened[name]:
            return
        inline = name not in BLOCKS
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[k]]
            if tag == name:
                if not inline:
                    self.runs.append((self.open[-1], None))
                self._end_from(k)
                return
            if inline and tag in BLOCKS:
                return


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Composite text density: characters per tag, weighted by how few of both are links."""
    if chars <= 0:
        return 0.0
    tags, links, anchors = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + e)
    return chars / tags * max(0.0, log(chars / links * tags / anchors) / log(base)) if base > 1 else 0.0


def main_text(html: str | None) -> str:
    """The main text of a page. Where classes rule all text out, only tags count."""
    if not html:
        return ""
    return _main_text(Page(html)) or _main_text(Page(html, by_class=False))


def _measured(page: Page) -> tuple[int, list[float], list[int]] | None:
    """The element with the largest density sum, and density and characters of each; None for a page without text."""
    n, parents, tags = len(page.tags), page.parents, page.tags
    own = [0] * n
    for element, text in page.runs:
        if text is not None and not page.dropped[element]:
            own[element] += len("".join(text.split()))
    chars, count, in_links, anchors = own[:], [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.dropped[i]:
            continue
        p = parents[i]
        if tags[i] == "a":
            in_links[i], anchors[i] = chars[i], anchors[i] + 1
        chars[p] += chars[i]
        count[p] += count[i] + 1
        in_links[p] += in_links[i]
        anchors[p] += anchors[i]
    if not chars[0]:
        return None
    share = in_links[0] / chars[0]
    dense = [0.0 if page.dropped[i] else density(chars[i], count[i] + (i > 0), in_links[i], anchors[i], share) for i in range(n)]
    total = [density(own[i], 1, own[i] if tags[i] == "a" else 0, 0, share) for i in range(n)]
    for i in range(n - 1, 0, -1):
        total[parents[i]] += dense[i]
    best = max((i for i in range(n) if not page.dropped[i] and tags[i] in CONTAINERS), key=lambda i: (total[i], -i))
    return best, dense, chars


def _below(page: Page, counts: list[int]) -> list[int]:
    """The sum of ``counts`` over each element and all that it holds."""
    out = counts[:]
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] += out[i]
    return out


def _rule_out(page: Page) -> None:
    """Settle what is dropped by tags, forms and names, and all inside it."""
    n, parents, tags = len(page.tags), page.parents, page.tags

    def inherited(own: list[bool]) -> list[bool]:
        out = own[:]
        for i in range(1, n):
            out[i] |= out[parents[i]]
        return out

    plain = inherited(page.dropped)
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tags[i] == "a" or in_link[parents[i]]
    own, prose = [0] * n, [0] * n
    for element, text in page.runs:
        if text is not None and not plain[element]:
            size = len("".join(text.split()))
            own[element] += size
            prose[element] += 0 if in_link[element] else size
    chosen = page.dropped[:]
    forms: list[int] = []
    if page.weak:
        fields, at = _below(page, own), [0] * n
        for i in page.fields:
            at[i] = 1
        held = _below(page, at)
        for i in page.weak:
            if fields[i] < FORM_CHARS * held[i]:
                chosen[i] = True
            else:
                forms.append(i)
    page.weak = forms
    mains = _below(page, [int(t == "main") for t in tags])
    named = {i for i in page.named if not mains[i]}
    for i in named:
        chosen[i] = True
    page.dropped = inherited(chosen)
    if not named:
        return
    left = sum(c for i, c in enumerate(prose) if not page.dropped[i])
    holds = _below(page, prose)
    most = max(named - page.comments, key=lambda i: (holds[i], -i), default=0)
    articles = any(c and not page.dropped[i] for i, c in enumerate(_below(page, own)) if tags[i] in ("article", "main"))
    if most and holds[most] > TOO_MUCH * left and not articles:
        # Names inside it still count, those around it do not.
        i = most
        while i:
            chosen[i] &= i not in named
            i = parents[i]
        page.dropped = inherited(chosen)


def _main_text(page: Page) -> str:
    _rule_out(page)
    n, parents, tags = len(page.tags), page.parents, page.tags
    measured = _measured(page)
    if measured is not None and (page.unsure or page.weak):
        best, _, chars = measured
        holds, i = {0}, best
        while i:
            holds.add(i)
            i = parents[i]
        unsure, inside = {*page.unsure, *page.weak}, [not best] * n
        # An article or main element elsewhere speaks against a form.
        keeps = [int(chars[i] > 0 and not page.dropped[i] and tags[i] in ("article", "main")) for i in range(n)]
        in_it, outside = _below(page, keeps), keeps[:]
        for i in range(1, n):
            outside[i] += outside[parents[i]]
        unfit = {i for i in page.weak if in_it[0] > in_it[i] + outside[parents[i]]}
        for i in range(1, n):
            inside[i] = i == best or inside[parents[i]]
            main = i not in unfit and (i in holds or inside[i] and 2 * chars[i] > chars[best])
            page.dropped[i] |= page.dropped[parents[i]] or i in unsure and not main
        measured = _measured(page)
    if measured is None:
        return ""
    best, dense, _ = measured
    path = [best]
    while path[-1]:
        path.append(parents[path[-1]])
    around = [i for i in path if tags[i] in ("article", "main")]
    chosen = [False] * n
    if around:
        chosen[around[-1]] = True
    else:
        chosen[best] = True
        threshold = min(dense[i] for i in path)
        for i in range(1, n):
            if tags[i] in BLOCKS and not page.dropped[i] and i not in path and dense[i] >= threshold > 0:
                chosen[i] = True
    for i in range(1, n):
        chosen[i] |= chosen[parents[i]]
    blocks, block = [], []
    for element, text in [*page.runs, (0, None)]:
        if text is None:
            if block and (whole := " ".join("".join(block).split())):
                blocks.append(whole)
            block = []
        elif not page.dropped[element] and chosen[element]:
            # A reference doesn't go on behind a tag.
            block.append(unescape(text))
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points."""

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [main_text(h) for h in texts(batch, html)]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return map_batches(pages, [("text", "string"), ("n_chars", "bigint")], function)
