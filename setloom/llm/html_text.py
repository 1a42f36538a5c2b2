"""Operator 2, HTML extraction: flat text blocks, classified by a decision tree over them and their neighbours.

A page is cut into flat blocks of text at every tag that is not inline; scripts, styles, titles and the like give
none. A block has its word count, its link density (share of words in links), the same of the block before and
after, and what stands around it: whether an element of boilerplate does (navigation, footer, aside, form, hidden),
whether a class or id does that names boilerplate outright or only in part, whether an article, a class or id that names content, and a
paragraph, heading, list or quotation do. A decision tree, grown by Gini impurity from the labelled pages below, says which
blocks are main text; none of these marks decides alone.

Names are read word by word: "share-buttons" is boilerplate outright, as all of its words are known; "share-price" names
it in part only; "has-sidebar" or "menu-open" is a state of the page and names nothing.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by one space. Pages are mapped over one by one; nothing is shuffled and nothing dropped or capped.

Defined results: a null, empty or all-boilerplate page has the empty text and 0 characters; broken markup is read
as it stands (an unclosed comment, script or style runs to the end); null ids and urls stay; equal rows repeat.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from setloom.shipping import ship

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|</[^a-zA-Z][^>]*+>|<([a-zA-Z/!?])")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPACE = re.compile(r"\s+")
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a further one of the kind closes.
SELF_CLOSING = frozenset("p li td th tr dt dd option thead tbody".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select header figcaption".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Words of class names and ids: of boilerplate, of content, of arrangement, and of states.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promos promotion sponsor sponsored sidebar sidebars side nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer foot masthead topbar comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription social share sharing related recommended widget widgets toolbar pagination pager login signup copyright".split()
)
CONTENT_WORDS = frozenset("content article story entry body main text prose".split())
PLAIN_WORDS = frozenset("site page global top bottom left right list lists links link buttons button posts post box bar wrap wrapper container section sections item items area block blocks inner outer row col column panel primary secondary header form icon icons title mobile desktop sticky fixed floating new more stories articles news thread card cards group".split())
STATE_WORDS = frozenset("has is with no without open opened closed active enabled disabled show shown visible js".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool  # in an element of boilerplate
    named: bool  # in an element named as boilerplate
    hinted: bool  # in an element whose name has a word of boilerplate
    article: bool
    content: bool  # in an element named as content
    prose: bool  # a paragraph, heading, item, quotation, cell or preformatted text


@cache
def name_marks(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names boilerplate outright, in part, or content."""
    named = hinted = content = False
    for token in value.split():
        words = {w.lower() for w in _WORDS.findall(token)}
        if not words or words & STATE_WORDS:
            continue
        rest = {w for w in words if not w.isdigit()} - BOILER_WORDS - CONTENT_WORDS - PLAIN_WORDS
        if words & BOILER_WORDS:
            named |= not rest
            hinted |= bool(rest)
        elif words & CONTENT_WORDS and not rest:
            content = True
    return named, hinted, content


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool, bool, bool]:
    """Of an element: boilerplate, named so, hinted at so, article, content."""
    boiler = tag in BOILER_TAGS and not (tag in ("header", "figcaption") and in_article)
    article = tag in ("article", "main")
    named = hinted = content = False
    if attrs and attrs.strip(" /"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id") and tag not in ("body", "html"):
                marks = name_marks(value) if len(value) < 200 else name_marks.__wrapped__(value)
                named |= marks[0] and tag not in ("article", "main")
                hinted |= marks[1] and tag not in ("article", "main")
                content |= marks[2]
            elif name == "role":
                boiler |= value.lower() in BOILER_ROLES
                article |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                boiler = True
    return boiler, named, hinted, article, content


PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th".split())


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []  # of the block so far
    links: list[str] = []  # its text in links
    stack: list[tuple[str, tuple[bool, ...]]] = []
    opened: Counter = Counter()  # tags on the stack
    depth = [0] * 5  # marks on the stack
    unclosed: set[str] = set()  # raw tags that nothing closes from here on
    link = 0

    def text(a: int, b: int) -> None:
        if b > a:
            parts.append(page[a:b])
            if link:
                links.append(page[a:b])

    def flush() -> None:
        if parts:
            own = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if own:
                linked = len(html.unescape(" ".join(links)).split()) if links else 0
                n = len(own.split())
                prose = next((t in PROSE for t, _ in reversed(stack) if t not in INLINE), False)
                boiler, named, hinted, article, content = (d > 0 for d in depth)
                out.append(Block(own, n, min(n, linked), boiler, named, hinted, article, content, prose))
            parts.clear()
            links.clear()

    def push(tag: str, marks: tuple[bool, ...]) -> None:
        stack.append((tag, marks))
        opened[tag] += 1
        for i, x in enumerate(marks):
            depth[i] += x

    def pop() -> str:
        tag, marks = stack.pop()
        opened[tag] -= 1
        for i, x in enumerate(marks):
            depth[i] -= x
        return tag

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if m[0] == "<!--":
            to = page.find("-->", at)
            at = end if to < 0 else to + 3
            continue
        if m[4]:  # quotes that never close: the tag ends at the next bracket
            to = page.find(">", m.start())
            at = end if to < 0 else to + 1
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if m[3].endswith("/") and tag in ("svg", "math", "object"):
                continue
            to = None if tag in unclosed else _closing(tag).search(page, at)
            if to is None:
                unclosed.add(tag)
                if tag in ("svg", "math", "object", "noscript", "template"):
                    continue
            at = end if to is None else to.end()
            if tag not in ("title", "script", "style", "template"):
                flush()
            continue
        if tag == "a":
            link = 0 if m[1] else 1
        inline = tag in INLINE
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if m[1]:
            if opened[tag]:
                if not inline or any(stack[-1][1]):
                    flush()
                while pop() != tag:
                    pass
            elif not inline:
                flush()
            continue
        marks = _marks(tag, m[3], depth[3] > 0)
        if inline and not (marks[0] or marks[1]):
            continue
        flush()
        if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
            pop()
        if not (m[3] or "").endswith("/"):
            push(tag, marks)
    flush()
    return out


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


FEATURES = ("boiler", "named", "hinted", "article", "content", "prose", "density", "density_before", "density_after", "words", "words_before", "words_after")
#: Pages whose blocks are labelled by hand: a block that begins with + is main text, one that begins with - is not; a number after
#: a word repeats it, and LENGTHS times that, so that no length is particular to a page.
LABELLED = (
    "<nav><ul><li><a>-Home</a><li><a>-World</a><li><a>-Sport today</a></ul></nav><div class=ad>-Buy two lamps and get one free this week only</div><article><h1>+Rain fills the southern reservoirs</h1><p>+After months of drought word*40<p>+The council word*120<p>+Why?<p>+Engineers said <a>in a report</a> word*30"
    "<blockquote>+We are not out of danger word*20</blockquote><ul><li>+Water levels rose<li>+Farms reopened</ul><p><a>+Read the full report of the river board</a><p>+Yes.</article><footer>-Copyright River Press, all rights reserved</footer>",
    "<header><a>-The Daily Shore</a><form>-Search the archive</form></header><main><h1>+Bread</h1><div>+Flour, water and salt word*50</div><div>+Leave it to rise word*15</div><div class='related'><a>-Ten soups</a> <a>-Cakes</a></div><p>+Bake it word*12</main><div class=comments><p>-I loved this bread word*30<p>-Mine was flat</div><footer><p>-Contact us word*8<p><a>-Imprint</a></footer>",
    "<body><div id=menu><a>-Start</a><a>-About me</a></div><p>+I moved here in spring word*35<p>+It rained.<p>+Then summer came word*22<div class=footer>-Written with care by hand</div>",
    "<body><p>+Short note.<p>+Nothing else to say.<p>+Bye.",
    "<p>+First thoughts<p>+Second thoughts",
    "<body><h1>+A walk</h1><p>+We set out at nine word*9<p>+The hill was steep.<p>+Home by four.",
    "<article><h2>+Medicine leaflet</h2><section class=side-effects><p>+Headache word*14<p>+Rarely a rash</section><div class=related-work><p>+Earlier trials word*25</div><p class=share-price>+The shares fell by a tenth word*6<p>+Ask your doctor.<div class=share><a>-Post</a><a>-Mail</a></div></article>",
    "<article><div class=menu-of-the-day>+Soup, fish and plums word*11</div><p id=notice-period>+Three months word*7<div class=comment-on-the-law><p>+The law says word*33</div><p class=side-note>+See the annex</article>",
    "<div id=content class='has-sidebar menu-open'><h1>+The old mill</h1><p>+It stands word*28<div>+Built of oak word*45</div><div>+Sold twice since word*7</div><p>+Closed now.</div><div id=sidebar><h3>-Archive</h3><ul><li><a>-March</a><li><a>-April</a></ul><p>-Follow our letters word*10</div>",
    "<div class=post-content><p>+Notes word*18<p><a>+The slides of my talk</a><ul><li><a>+Part one</a><li>+Part two to come</ul><div>+Thanks for reading</div></div><div class=pagination><a>-Older</a> <a>-Newer</a></div>",
    "<div class=cookie-banner>-We use cookies to make this site better for you word*20 <button>-Accept</button></div><div class=entry><p>+Bees word*70<p>+Honey word*33</div><aside><p>-More from this author word*12<a>-All posts</a></aside>",
    "<div class=wrapper><div class=nav><a>-Home</a> | <a>-Shop</a></div><div class=col>+The workshop opens on Mondays and word*40</div><div class=col>+Tools word*90</div><div>-Share this</div><div><a>-Next</a></div></div>",
    "<table><tr><td><a>-News</a><td><a>-Weather</a><td><a>-Maps</a></table><table><tr><td>+Harbour times word*25<tr><td>+High tide at noon word*10<tr><td>+Low tide later word*8</table><div><a>-Back to top</a></div>",
    "<article><header><h1>+On keys</h1><p>+By a locksmith</header><p>+Every lock word*50<figure><figcaption>+A key from the river</figcaption></figure><div class=newsletter><p>-Get our letter every Friday word*9<form>-Your address</form></div><p>+Keep spares.<section class=comments><h3>-Two comments</h3><p>-Great piece word*40<p>-Thanks!</section></article>",
    "<article><p>+One word*20<div hidden>-Draft of a paragraph word*20</div><p>+Two word*8<span class=ad>-Sale</span><ul class=tags><li>+rivers<li>+mills</ul><div role=alert>-Your session has expired</div><p>+Three.</article>",
    "<div><a>-Login</a></div><div><h2>+Notice of works</h2><p>+The bridge closes word*16<p>+Use the ferry.</div><div class=social-links><a>-Feed</a><a>-Mail</a></div><div>-All prices in crowns</div><div><a>-Terms</a> <a>-Privacy</a> <a>-Help</a></div>",
    "<div><ul><li><a>-Home</a><li><a>-Rooms</a><li><a>-Prices</a><li><a>-Contact</a></ul></div><p>+Our house has eight rooms word*24<p>+Dogs are welcome.<p><a>+Write to us about your stay in autumn</a> or call.<div><ul><li><a>-Imprint</a><li><a>-Data</a></ul></div>",
    "<div class=breadcrumbs><a>-Home</a> / <a>-Garden</a></div><div class=article-body>+Prune in winter word*60</div><div class=article-body>+Cut low word*5</div><div class=widget><p>-Popular this week word*6<ol><li><a>-Ten roses</a><li><a>-Moss</a></ol></div><div class=copyright>-Garden Press</div>",
    "<main><p>+Minutes of the meeting word*11<ol><li>+Roof word*9<li>+Money<li><a>+Appendix with all the figures</a></ol><p>+Closed at ten.<nav><a>-Previous</a><a>-Next</a></nav></main>",
    "<div class=sponsored><p>-This lamp changes everything word*35</div><div class=story><p>+The storm came at night word*44<p>+Nobody slept.</div><div class=recommended-stories><p>-Another storm word*15<p>-Fog word*12</div><div class=signup>-Join for free word*9</div>",
    "<section id=login-form>-Name and password</section><section><h1>+How locks work</h1><p>+A pin word*30<pre>+turn key</pre><p>+Done.</section><section class=replies><p>-My lock is older word*25</section>",
)
_REPEAT = re.compile(r"(\w+)\*(\d+)")
LENGTHS = (0.25, 1, 4)


def written_out(page: str, length: float = 1) -> str:
    return _REPEAT.sub(lambda m: " ".join([m[1]] * max(1, int(int(m[2]) * length))), page)


def features(found: list[Block]) -> list[tuple]:
    """The features of a page's blocks."""
    size = [(b.words, b.linked / b.words) for b in found]
    none = (0, 0.0)
    out = []
    for i, b in enumerate(found):
        (n, d), (n0, d0), (n1, d1) = size[i], size[i - 1] if i else none, size[i + 1] if i + 1 < len(size) else none
        out.append((b.boiler, b.named, b.hinted, b.article, b.content, b.prose, d, d0, d1, n, n0, n1))
    return out


@cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    x, y = [], []
    for page, length in itertools.product(LABELLED, LENGTHS):
        found = blocks(written_out(page, length))
        for b, row in zip(found, features(found), strict=True):
            if b.text[0] in "+-":  # a stroke between links has no label
                x.append(row)
                y.append(b.text[0] == "+")
    return np.array(x, float), np.array(y, int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> tuple:
    """A decision tree: (label,) or (feature, threshold, tree at most, tree over)."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return (int(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            gini = sum(len(z) * (p := z.mean()) * (1 - p) for z in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t))
    if best is None:
        return (int(2 * y.sum() >= len(y)),)
    _, f, t = best
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@cache
def tree() -> tuple:
    return grow(*labelled())


def decide(node: tuple, row: tuple) -> bool:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node[0])


def main_blocks(page: str | None) -> list[str]:
    """The texts of a page's blocks that the tree takes for main text."""
    found = blocks(page or "")
    return [b.text for b, row in zip(found, features(found), strict=True) if decide(tree(), row)]


def extract(pages: DataFrame, *, column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    ship(pages.sparkSession)
    slim = pages.select("page_id", "url", column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(main_blocks(x.as_py())) for x in b.column(column)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
