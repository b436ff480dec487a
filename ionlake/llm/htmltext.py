"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph earns points for its length and commas and passes them to its
ancestors, in full to its parent and less to those above; names of elements add or take some, and an
ancestor's points are discounted by the share of its text that is in links. The best container is
kept, with those of its siblings that have points, read like paragraphs or headings of the same
article, or stand between such.

Before that, what a page itself calls something else is cut off: scripts, menus, forms, adverts,
notices and comments by tag or role, or by a class or id that says nothing else (``comment-body``,
``mainMenu``). A name that says something more (``side-effects``, ``related-work``) only casts doubt:
such an element stays if it has paragraphs, few links and no form. An id may come from a heading
(``<section id="comments">`` of a manual): alone it never cuts a heading or what is in one, nor inside
an article a paragraph or list item, and a section only if it doesn't read like one: ``comments`` that
are repeated, signed or have a form, others without paragraphs. Discussions, threads and reviews are
cut where they are a minority of the page made of two or more short items of one shape. What holds the
page's article or first heading isn't cut by a name. Nothing inside the chosen article is dropped for its links; only
menus without a name at the very ends of a container that isn't called an article are.

A block is the text between the bounds of block elements. Character references are decoded, white
space inside a block becomes one space, and blocks are joined by a line break in page order.

Nulls and ties: null or empty html, and a page without main text, give an empty text. Of equal
containers the first in the page wins. page_id and url are carried through, null or not, and
repeated rows each get their row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.DOTALL)
OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_ITSELF = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th"}
#: An element that closes itself doesn't close one beyond these.
SCOPE = frozenset("ul ol dl table body html article section div td".split())

#: Elements and roles of what isn't main text.
CUT_TAGS = frozenset("nav footer aside form button dialog menu".split())
CUT_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
#: Words of classes and ids: of readers' comments, of other things that aren't main text, of main text, and that say nothing by themselves.
COMMENTS = frozenset("comment comments commenter commenting disqus reply replies respond".split())
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs consent cookie cookies copyright disclaimer facebook footer gdpr instagram linkedin login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination pinterest popup promo promos promotion promotions recommended related share shares sharing side sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription toolbar twitter whatsapp widget widgets".split()
)
#: Words that may name a thread of readers' texts, what is in a text that somebody signed, and names of what only screen readers get.
THREADS = frozenset("discussion discussions thread threads review reviews responses feedback opinions".split())
SIGNED = frozenset("author avatar byline date nick posted reviewer time timestamp user username".split())
UNSEEN = frozenset("sr-only visually-hidden screen-reader-text".split())
ARTICLE = frozenset("article articles body content contents entry main page post posts stories story text".split())
PLAIN = frozenset(
    "area author avatar bar block blocks bottom box btn button buttons card cards center col column container fixed footer form global group header heading holder icon icons inline inner item items label large layer left line link links list lists meta mobile module nested new news panel primary right row secondary section site small sticky sub template thread title top unit wrap wrapper zone".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W_]+")
START = {"article": 10, "main": 8, "div": 5, "section": 4, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "th": -5}
#: Most characters of an item of a thread, on average.
ITEM_LENGTH = 1000
#: Points for what an element's names call it.
NAMED = {"article": 5, "doubtful": -5}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside an article that an id alone never cuts, and those that an item of a thread can be.
NAMED_BY_ID = frozenset("p li a span dt dd figure figcaption pre blockquote code em strong b i".split())
ITEMS = frozenset("div li article section blockquote dd".split())
PARAGRAPH = frozenset("p pre blockquote td li dd figcaption".split())
#: Least length of text that earns points, and the characters that earn one point each, at most LENGTH_POINTS.
SHORT, PER_POINT, LENGTH_POINTS = 20, 100, 30
#: Share of the best score that makes a sibling part of the article; share of text in links, and links, that make a menu.
SIBLING_SHARE, LINK_LIMIT, MENU_LINKS = 0.2, 0.5, 3
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
ENDS = re.compile(r"[.!?…:;\"”»)\u3002\uff01\uff1f]\s*$")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    attributes: str = ""
    children: list[Element | str] = field(default_factory=list)
    score: float = 0.0
    length: int = 0
    linked: int = 0
    links: int = 0
    paragraphs: int = 0
    fields: int = 0
    inside: bool = False

    def density(self) -> float:
        return self.linked / self.length if self.length else 0.0


def tree(page: str) -> Element:
    """The page's elements; unclosed and misplaced tags are put right as browsers do it."""
    root = at = Element("html", None)
    position, end = 0, len(page)
    while position < end:
        m = TOKEN.search(page, position)
        text = page[position : m.start() if m else end]
        if text:
            at.children.append(text)
        if not m:
            break
        position = m.end()
        tag = (m[2] or "").lower()
        if not tag or not page.endswith(">", m.start(), position):
            continue
        if m[1]:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, position) if not m[3].rstrip().endswith("/") else None
            if close:
                position = close.end()
            elif tag in ("script", "style", "textarea", "title"):
                position = end
            continue
        if tag in ("html", "body", "head") and tag != "body":
            continue
        if tag in BLOCK:
            at = _closed(at, "p", {"button", "td", "th", "table"} if tag != "table" else {"button", "td", "th"})
        if tag in CLOSES_ITSELF:
            at = _closed(at, CLOSES_ITSELF[tag], SCOPE - set(CLOSES_ITSELF[tag].split()))
        element = Element(tag, at, m[3])
        at.children.append(element)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            at = element
    return root


def _closed(at: Element, tags: str, stop: set[str] | frozenset[str]) -> Element:
    """Where the next element goes once the outermost open one of ``tags`` in reach is closed."""
    wanted, up, found = tags.split(), at, None
    while up is not None and up.tag not in stop:
        if up.tag in wanted:
            found = up
        up = up.parent
    return found.parent if found is not None and found.parent is not None else at


def _says(word: str) -> bool | None:
    """Whether a word of a name says that an element isn't main text; None if it is unknown."""
    if word in COMMENTS or word in OTHERS:
        return True
    if word in ARTICLE or word in PLAIN or word.isdigit() or len(word) == 1:
        return False
    for i in range(2, len(word) - 1):  # two words written as one
        parts = word[:i], word[i:]
        if all(p in COMMENTS or p in OTHERS or p in ARTICLE or p in PLAIN for p in parts) and any(p in COMMENTS or p in OTHERS for p in parts):
            return True
    return None


@lru_cache(50_000)
def _name(name: str) -> str:
    """What a class or id calls its element: comments, other, doubtful, article, or nothing known."""
    words = [w.lower() for w in WORDS.findall(name)]
    said = [_says(w) for w in words]
    if True not in said:
        return "article" if ARTICLE.intersection(words) and None not in said else ""
    if None in said:
        return "doubtful"
    return "comments" if any(x and any(c in w for c in COMMENTS) for w, x in zip(words, said, strict=True)) else "other"


class Called(NamedTuple):
    """What attributes say of an element: its role, hidden being one; what its names call it; whether
    only its id calls it so; the words of its names; and its class."""

    role: str
    kind: str
    by_id: bool
    words: frozenset[str]
    shape: str


@lru_cache(50_000)
def _called(attributes: str) -> Called:
    role, shape, words = "", "", set()
    kinds: dict[str, set[str]] = {"class": set(), "id": set()}
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            role = "hidden"
        elif name == "role":
            role = role or value.lower()
        elif name in kinds:
            names = value.split()
            if name == "class":
                shape = value
                role = "hidden" if UNSEEN.intersection(names) else role
            kinds[name] |= set(map(_name, names))
            words |= {w.lower() for n in names for w in WORDS.findall(n)}
    both = kinds["class"] | kinds["id"]
    if "other" in both and "article" in both:
        both = both - {"other"} | {"doubtful"}
    kind = next((k for k in ("comments", "other", "doubtful", "article") if k in both), "")
    return Called(role, kind, kind not in kinds["class"], frozenset(words), shape)


def _is_main(e: Element) -> bool:
    role, kind = _called(e.attributes)[:2]
    return (e.tag in ("article", "main") or role in ("article", "main")) and kind not in ("comments", "other")


def _prune(root: Element) -> None:
    """Cuts off what isn't main text by tag, role or name."""
    order = _measured(root)
    holds: set[int] = set()  # elements that hold the page's article or first heading
    first = next((e for e in order if e.tag == "h1" and not _within(e, CUT_TAGS | {"header"})), None)
    for e in [*(e for e in order if _is_main(e)), *([first] if first else [])]:
        up = e.parent
        while up is not None:
            if e is not first or up.paragraphs and 2 * up.paragraphs >= root.paragraphs:
                holds.add(id(up))
            up = up.parent
    for e in order:
        inside = e.tag in ("section", "article", "main") or _called(e.attributes)[1] == "article" or e.inside
        keep: list[Element | str] = []
        for c in e.children:
            if isinstance(c, str):
                keep.append(c)
            elif not _is_cut(c, inside, id(c) in holds, root.paragraphs):
                c.inside = inside
                keep.append(c)
        e.children = keep


def _within(e: Element, tags: frozenset[str]) -> bool:
    while e.parent is not None:
        e = e.parent
        if e.tag in tags:
            return True
    return False


def _is_cut(e: Element, in_article: bool, holds: bool, paragraphs: int) -> bool:
    """``paragraphs``: those of the whole page."""
    role, kind, by_id, words, shape = _called(e.attributes)
    if role == "hidden" or e.tag in CUT_TAGS - {"form"}:
        return True
    if e.tag == "form" or role == "form":  # some pages are one form
        return not holds and not _reads(e, 3)
    if by_id and kind in ("comments", "other", "doubtful"):
        if e.tag in HEADING or e.parent is not None and e.parent.tag in HEADING or in_article and e.tag in NAMED_BY_ID:
            kind = ""
        elif in_article and (e.tag == "section" or "section" in shape.split()):
            kind = "doubtful" if kind != "comments" or not (e.fields or _is_thread(e)) else kind
    if role in CUT_ROLES or kind == "comments" and e.tag not in ("html", "body"):
        return not (holds and kind != "comments")
    if holds or e.tag in ("html", "body"):
        return False
    if e.tag == "header" and not in_article or kind == "other":
        return True
    if words & THREADS and e.tag not in HEADING and 2 * e.paragraphs <= paragraphs and _is_thread(e):
        return True
    return kind == "doubtful" and (not _reads(e, 1) or e.fields > 0)


def _is_thread(e: Element) -> bool:
    """Whether an element is made of two or more short items of one shape, without headings, or of
    some that are signed."""
    within = e
    while len(inner := [c for c in within.children if isinstance(c, Element) and c.tag not in HEADING]) == 1 and inner[0].tag in BLOCK - PARAGRAPH:
        within = inner[0]
    items = [c for c in inner if c.tag in ITEMS and c.length]
    if not items:
        return False
    shape, n = Counter((c.tag, _called(c.attributes).shape) for c in items).most_common(1)[0]
    alike = [c for c in items if (c.tag, _called(c.attributes).shape) == shape]
    if sum(c.length for c in alike) > ITEM_LENGTH * n or any(x.tag in HEADING for c in alike for x in _all(c)):
        return False
    return n > 1 or any(x.tag == "time" or SIGNED & _called(x.attributes).words for x in _all(alike[0]))


def _all(e: Element) -> Iterator[Element]:
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in x.children if isinstance(c, Element)]


def _reads(e: Element, least: int) -> bool:
    """Whether an element has so many paragraphs and few links."""
    return e.paragraphs >= least and e.density() < 1 / 3


def _measured(root: Element) -> list[Element]:
    """All elements in page order, with the length of their text and of that in links, their
    paragraphs with text outside links, and the fields of forms."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        e.length = e.linked = e.links = e.paragraphs = e.fields = 0
        order.append(e)
        stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    for e in reversed(order):
        for c in e.children:
            if isinstance(c, str):
                e.length += len(c.strip())
            else:
                e.length += c.length
                e.linked += c.linked
                e.links += c.links
                e.paragraphs += c.paragraphs
                e.fields += c.fields
        if e.tag == "a":
            e.linked, e.links = e.length, e.links + 1
        elif e.tag in PARAGRAPH and e.length > e.linked:
            e.paragraphs += 1
        elif e.tag in ("input", "button", "form"):
            e.fields += 1
    return order


def _own_text(e: Element) -> str:
    """Text of an element that isn't in a block inside it."""
    out, stack = [], [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is e or x.tag not in BLOCK:
            stack += reversed(x.children)
    return "".join(out)


def _score(order: list[Element]) -> list[Element]:
    """Lets paragraphs pass points to their ancestors; those that got some, in page order."""
    got: dict[int, Element] = {}
    for e in order:
        if e.tag not in BLOCK or e.tag in HEADING:
            continue
        text = _own_text(e)
        if len(text.strip()) < SHORT:
            continue
        points = 1 + text.count(",") + min(len(text) / PER_POINT, LENGTH_POINTS)
        up, level = (e.parent, 0) if e.tag in PARAGRAPH and e.parent is not None else (e, 0)
        while up is not None and level < 5:
            if id(up) not in got:
                got[id(up)] = up
                up.score += START.get(up.tag, 0) + NAMED.get(_called(up.attributes)[1], 0)
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    found = [e for e in order if id(e) in got]
    for e in found:
        e.score *= 1 - e.density()
    return found


def _chosen(root: Element) -> list[Element | str]:
    """What the text is made of, in page order: the best container, or its children and those of its
    parent that belong to it."""
    order = _measured(root)
    found = _score(order)
    if not found:
        return _without_menus(root.children)
    top = max(found, key=lambda e: e.score)
    while top.parent is not None and not _is_main(top) and sum(isinstance(c, Element) and c.tag != "head" or isinstance(c, str) and bool(c.strip()) for c in top.parent.children) == 1:
        top = top.parent
    up = top
    while up is not None and not _is_main(up):
        up = up.parent
    if up is not None and up.score >= 0.5 * top.score:  # what the page itself calls the article, with its headings
        top = up
    own = _is_main(top)
    if top.parent is None:
        return [top] if own else _without_menus(top.children)
    least = max(10.0, SIBLING_SHARE * top.score)
    around = top.parent.children
    if own:
        return [c for c in around if c is top or isinstance(c, Element) and c.score >= least]
    belongs = [c is top or isinstance(c, Element) and (c.score >= least or c.tag in HEADING or _is_text(c)) for c in around]
    first, last = belongs.index(True), len(belongs) - 1 - belongs[::-1].index(True)
    kept = around[first : last + 1]  # and all that stands between them
    return _without_menus(top.children) if kept == [top] else _without_menus(kept)


def _is_text(e: Element) -> bool:
    """Whether a sibling of the article reads like part of it: sentences outside links."""
    if e.tag not in BLOCK or e.density() >= LINK_LIMIT or not e.paragraphs:
        return False
    return e.length > 80 or bool(ENDS.search(_own_text(e) if e.tag in PARAGRAPH else _last_text(e)))


def _last_text(e: Element) -> str:
    while True:
        last = next((c for c in reversed(e.children) if not isinstance(c, str) or c.strip()), "")
        if isinstance(last, str):
            return last
        e = last


def _without_menus(items: list[Element | str]) -> list[Element | str]:
    """Without blocks of links before the first and after the last text. Links under a heading aren't
    a menu, and nothing further in is judged."""

    def is_menu(x: Element | str) -> bool:
        return isinstance(x, Element) and x.tag in ("ul", "ol", "div", "section", "table", "td") and x.links >= MENU_LINKS and x.density() > LINK_LIMIT

    def is_blank(x: Element | str) -> bool:
        return not x.strip() if isinstance(x, str) else not x.length

    while len(whole := [x for x in items if not is_blank(x)]) == 1 and isinstance(whole[0], Element) and whole[0].tag in BLOCK and not _is_main(whole[0]) and not is_menu(whole[0]):
        items = whole[0].children  # wrappers
    a, b = 0, len(items)
    while a < b and (is_menu(items[a]) or is_blank(items[a])):
        a += 1
    while b > a and (is_blank(items[b - 1]) or is_menu(items[b - 1]) and not _headed(items, b - 1)):
        b -= 1
    return items[a:b] if a < b else [x for x in items if not is_menu(x)]


def _headed(items: list[Element | str], at: int) -> bool:
    before = next((x for x in reversed(items[:at]) if not isinstance(x, str) or x.strip()), None)
    return isinstance(before, Element) and before.tag in HEADING


def _blocks(chosen: list[Element | str]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    stack: list[Element | str | None] = [None, *reversed(chosen)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    root = tree(OPEN_END.sub("", page or "")) if page else Element("html", None)
    _prune(root)
    return "\n".join(_blocks(_chosen(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(per_batch(run), "page_id long, url string, text string, n_chars long")
