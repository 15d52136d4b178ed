"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks at block-level tags.  A linear classifier over a block's words, links, element names, place
in the element tree and distance from the element that holds most of the text gives its probability of being content;
the costs of the two labels are its capacities to the source and the sink.  Neighbouring blocks, and next blocks of one
parent, are joined by edges that are stronger the closer they lie in the tree.  The minimum cut separates content from
boilerplate.  Names of classes are evidence only where their element holds the smaller part of a page's text, and none
if a page would have no content by them alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that break text into blocks, that hold no content, that never have an end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
BOILER_TAGS = frozenset("nav footer aside head title menu dialog".split())
#: Controls inside a line: their text is left out, and the block goes on after them.
CONTROLS = frozenset("button select option optgroup datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|textarea|iframe|object|audio|video|canvas"
#: Start tags that end a drawing (svg) whose end tag is missing.
ENDS_DRAWING = (BLOCK_TAGS - {"title"}) | frozenset("b big br code em embed hr i img meta nobr ruby s small span strong strike sub sup tt u var".split())
#: Start tags that end an open element of these names.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: Words of class, id and role that speak against content, and for it.
BOILER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent "
    "contentinfo cookie cookies copyright disclaimer discussion disqus feedback footer footnav form gdpr header legal login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion promotions reader "
    "recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toolbar toc topbar trending widget widgets warning alert complementary".split()
)
#: Those of them that say so at the beginning of a longer name too.
LEADING_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu nav "
    "navbar navigation newsletter pagination promo promoted promotion sidebar sponsor sponsored subscribe".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text maincontent postbody".split())

_RAW = rf"<(?P<raw>{RAW_TAGS})(?=[\s>/])[^>]*+>(?s:.*?)(?:</(?P=raw)\s*+>|\Z)"
_COMMENT = r"(?P<comment><!--(?s:.*?)(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?)"
_TAGS = (
    r"|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/)?(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
)
_TOKEN = re.compile(f"{_COMMENT}|{_RAW}{_TAGS}", re.IGNORECASE)
#: Inside a drawing, where raw elements may close themselves or miss their end, and only their start is looked for.
_DRAWN = re.compile(f"{_COMMENT}{_TAGS}", re.IGNORECASE)
_IS_RAW = re.compile(RAW_TAGS, re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CLOSED = re.compile(r"(?<!/)/\s*$")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>][^\s\"'>]*$")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:\s|^)hidden(?:[\s=/]|$)|display\s*:\s*none", re.IGNORECASE)

#: Headings that begin the readers' part of a page, in the languages of the corpus.
_READERS = re.compile(
    r"(?:\d+\s+)?(?:(?:reader |all |latest )?comments?|responses?|replies|discussion|join the (?:discussion|conversation)|leave a (?:comment|reply)"
    r"|commentaires?|réactions?|kommentare?|leserkommentare|comentarios?|respuestas)(?:\s*\(?\d+\)?)?\s*:?",
    re.IGNORECASE,
)

#: Edge weights: adjacent blocks, next blocks of one parent, and the share that each tree step leaves.
ADJACENT, SIBLING, STEP = 0.8, 0.8, 0.6
NEVER = 1e6
#: Open elements that a block's place is told by; deeper ones share the last one's place, and keep what they say of their text.
MAX_DEPTH = 512
#: Evidence: a name that speaks against content, one of which only a part does, a form, a block outside the element
#: that holds most of the text, one outside any article element, one after a heading of the readers' part.
NAMED, PARTLY_NAMED, FORM, OUTSIDE, NOT_ARTICLE, READERS = 9.0, 2.0, 20.0, 2.0, 2.0, 9.0
#: Shares of a page's words from which an element's name, and a form, are no evidence; share that the main element holds.
NAME_SHARE, FORM_SHARE, MAIN_SHARE = 0.5, 0.8, 0.6


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    cost_content: float  # what it costs to call the block content
    cost_boiler: float


class _Element(NamedTuple):
    tag: str
    number: int
    never: bool  # inside an element that holds no content
    content: float  # evidence for content, this element's and those around it


class _Piece(NamedTuple):
    text: str
    words: int
    path: tuple[int, ...]
    tag: str
    never: bool
    base: float  # score without names and place


def _named(words: list[str]) -> float:
    """Evidence against content of one class, id or role name, by its parts."""
    if not words or any(w in CONTENT_WORDS for w in words):
        return 0.0
    if all(w in BOILER_WORDS for w in words) or words[0] in LEADING_WORDS:
        return NAMED
    return PARTLY_NAMED if any(w in BOILER_WORDS for w in words) else 0.0


def _evidence(tag: str, rest: str, around: _Element) -> tuple[bool, float, float]:
    """(never content, evidence against by name or form, evidence for content with that around)."""
    never, against, favour = around.never, 0.0, around.content
    if tag == "header":  # an article's own header holds its headings
        against += 6.0 if not favour else 1.0
    elif tag in BOILER_TAGS:
        never = True
    elif tag in ("form", "fieldset"):
        against += FORM
    if tag in ("article", "main"):
        favour = max(favour, 3.0)
    if rest and not rest.isspace():
        names = [
            _PART.findall(_CAMEL.sub("-", name).lower())
            for m in _ATTRIBUTE.finditer(rest)
            for name in (m[1] or m[2] or m[3] or "").split()
        ]
        if tag not in ("body", "html", "article", "main"):
            against += max(map(_named, names), default=0.0)
        if any(w in CONTENT_WORDS for name in names for w in name):
            favour = max(favour, 2.0)
        if _HIDDEN.search(rest):
            never = True
    return never, against, favour


def _self_closing(rest: str) -> bool:
    """Whether a start tag ends in a slash that is not part of an unquoted value."""
    return bool(_CLOSED.search(rest)) and not _UNQUOTED.search(rest)


def blocks(page: str, named: bool = True) -> list[Block]:
    """Blocks with text, in page order; without ``named``, names are no evidence.

    Text of a drawing (svg) is left out, up to its end tag or to a tag that cannot be inside it; formulas are text.
    Text of controls is left out, up to their end or to the next block.
    """
    found, against, articles = _parse(page)
    return _scored(found, against if named else {k: v for k, v in against.items() if v >= FORM}, articles)


def _parse(page: str) -> tuple[list[_Piece], dict[int, float], set[int]]:
    """The page's blocks, evidence against elements by name or form, and the numbers of its article and main elements."""
    stack = [_Element("", 0, False, 0.0)]
    count, at = 0, 0
    pieces: list[str] = []
    linked, in_link, muted = 0, False, ""
    out: list[_Piece] = []
    against: dict[int, float] = {}
    articles: set[int] = set()
    held: Counter[str] = Counter()  # open elements by tag
    drawings = 0  # open svg elements
    foreign: list[str] = []  # open elements from a drawing's foreignObject on

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(_piece(text, linked, stack))
        pieces, linked = [], 0

    known: dict[str, tuple[int, int, int]] = {}

    def following(mark: str, start: int) -> tuple[int, int]:
        """Where the next match begins and ends, -1 if there is none; what one search passed over isn't searched again."""
        begun, begins, stop = known.get(mark, (len(page) + 1, -1, -1))
        if not (begun <= start and (begins < 0 or begins >= start)):
            met = re.compile(mark, re.IGNORECASE).search(page, start)
            begins, stop = met.span() if met else (-1, -1)
            known[mark] = start, begins, stop
        return begins, stop

    def close_from(k: int) -> None:
        for e in stack[k:]:
            held[e.tag] -= 1
        del stack[k:]

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not muted:
            pieces.append(piece)
            if in_link:
                linked += len(piece)

    def token() -> re.Match | None:
        return (_DRAWN if drawings and not foreign else _TOKEN).search(page, at)

    for found in iter(token, None):
        if not drawings:
            take(page[at : found.start()])
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(found["end"] or found["end2"])
        rest = found["rest"] or found["rest2"] or ""
        if drawings and not foreign and not ends and _IS_RAW.fullmatch(tag) and not _self_closing(rest):
            _, close = following(f"</{tag}\\s*+>", at)  # its text goes, if it ends inside the drawing
            if close >= 0 and not 0 <= following("</svg", at)[0] < close:
                at = close
            continue
        if tag == "svg":
            if ends:
                drawings = max(0, drawings - 1)
            elif not _self_closing(rest):
                drawings += 1
            if not drawings:
                foreign = []
            continue
        if drawings:
            if not ends and (foreign or tag == "foreignobject"):
                if tag not in VOID_TAGS and not _self_closing(rest):
                    foreign.append(tag)
                continue
            if ends and tag in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(tag) :]
                continue
            if not (held[tag] if ends else tag in ENDS_DRAWING):
                continue
            drawings, foreign = 0, []
        if tag == "a":
            in_link = not ends
        elif tag in CONTROLS:
            if not ends and not muted:
                take(" ")
                muted = tag
            elif ends and tag == muted:
                muted = ""
        elif tag == "br" or tag == "annotation":
            take(" ")
        elif tag in BLOCK_TAGS or (tag in BOILER_TAGS):
            muted = ""
            flush()
            if ends:
                if held[tag]:
                    close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                continue
            closes = CLOSES.get(tag) or ({"p"} if stack[-1].tag == "p" else ())
            while len(stack) > 1 and stack[-1].tag in closes:
                close_from(len(stack) - 1)
            if tag in VOID_TAGS:
                continue
            never, own, favour = _evidence(tag, rest, stack[-1])
            if len(stack) < MAX_DEPTH:
                count += 1
                number = count
                if own:
                    against[count] = own
                if tag in ("article", "main"):
                    articles.add(count)
            else:  # placed with the last numbered one; what its name says counts for its text at once
                number, favour = stack[-1].number, favour - own
            held[tag] += 1
            stack.append(_Element(tag, number, never, favour))
    if not drawings:
        take(page[at:])
    flush()
    return out, against, articles


def _piece(text: str, linked: int, stack: list[_Element]) -> _Piece:
    top = stack[-1]
    words = text.count(" ") + 1
    share = min(1.0, linked / max(1, len(text)))
    score = -0.8 + 0.9 * math.log2(1 + words / 6) - 4.0 * share + top.content
    score += 1.0 if top.tag in ("p", "pre", "blockquote", *_HEADINGS) else -0.5 if top.tag in ("li", "td", "") else 0.0
    score += 0.5 if text[-1] in ".!?:\"'" else 0.0
    return _Piece(text, words, tuple(e.number for e in stack[:MAX_DEPTH]), top.tag, top.never, score)


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _scored(found: list[_Piece], against: dict[int, float], articles: set[int]) -> list[Block]:
    """Blocks with the costs of their labels."""
    words: dict[int, int] = {}  # of an element, outside elements without content
    count: dict[int, int] = {}  # its blocks
    told: dict[int, int] = {}  # its words in article elements
    good: dict[int, int] = {}  # its words in blocks that look like content by themselves, but for a block's own element
    depth: dict[int, int] = {}
    for b in found:
        if b.never:
            continue
        in_article = b.words if articles.intersection(b.path) else 0
        for k, e in enumerate(b.path):
            words[e] = words.get(e, 0) + b.words
            count[e] = count.get(e, 0) + 1
            told[e] = told.get(e, 0) + in_article
            if b.base > 0 and (k < len(b.path) - 1 or not k):
                good[e] = good.get(e, 0) + b.words
                depth[e] = k
    total, best = words.get(0, 0), good.get(0, 0)

    def stands(e: int, v: float) -> bool:
        """Whether an element's name or form is evidence: it has the smaller part of the page, or one block, or an article is elsewhere."""
        small = words.get(e, 0) < (FORM_SHARE if v >= FORM else NAME_SHARE) * total
        return small or count[e] < 2 or bool(told[0] and not told[e])

    held = {e: v for e, v in against.items() if words.get(e) and stands(e, v)}
    main = max((e for e, n in good.items() if n >= MAIN_SHARE * best), key=lambda e: depth[e], default=0)
    inside = {e for e in articles if words.get(e, 0) >= 0.3 * best}
    readers: set[int] = set()  # elements whose readers' part has begun
    out = []
    for b in found:
        score = b.base - sum(held.get(e, 0.0) for e in b.path)
        score -= OUTSIDE * (main not in b.path) + NOT_ARTICLE * bool(inside and not inside & set(b.path))
        if b.tag in _HEADINGS and _READERS.fullmatch(b.text):
            readers.add(b.path[-2] if len(b.path) > 1 else 0)
        score -= READERS * bool(readers and readers & set(b.path))
        if b.never:
            out.append(Block(b.text, b.path, NEVER, 0.0))
            continue
        score = max(-12.0, min(12.0, score))
        out.append(Block(b.text, b.path, math.log1p(math.exp(-score)), math.log1p(math.exp(score))))
    return out


def _proximity(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    shared = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        shared += 1
    return STEP ** max(0, len(a) + len(b) - 2 * shared - 2)


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness weights between blocks."""
    out: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            out[k - 1, k] = ADJACENT * _proximity(found[k - 1].path, b.path)
        parent = b.path[-2] if len(b.path) > 1 else b.path[-1]
        before = last_of.get(parent)
        if before is not None and before < k:
            out[before, k] = out.get((before, k), 0.0) + SIBLING * _proximity(found[before].path, b.path)
        last_of[parent] = k
    return out


def minimum_cut(content: list[float], boiler: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """For each node whether the least-cost labelling calls it content.

    A node whose own costs differ by more than all its open edges has its label in any minimum cut; such nodes
    are folded into their neighbours' costs first, and augmenting paths settle what is left.
    """
    n = len(content)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in links.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    gain = [boiler[k] - content[k] for k in range(n)]  # positive: content is cheaper
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(gain[k]) > sum(near[k].values()):
            label[k] = gain[k] > 0
            for j, w in near[k].items():
                gain[j] += w if label[k] else -w
                del near[j][k]
                todo.append(j)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        side = _max_flow({k: gain[k] for k in rest}, {k: near[k] for k in rest})
        for k in rest:
            label[k] = k in side
    return [bool(x) for x in label]


def _max_flow(gain: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source's side after shortest augmenting paths in levels (source -1, sink -2)."""
    left: dict[int, dict[int, float]] = {k: dict(v) for k, v in near.items()} | {-1: {}, -2: {}}
    for k, g in gain.items():
        left[k] |= {-1: 0.0, -2: max(0.0, -g)}
        left[-1][k], left[-2][k] = max(0.0, g), 0.0
    tiny = 1e-9
    while True:
        level, queue = {-1: 0}, deque([-1])
        while queue:
            a = queue.popleft()
            for b, w in left[a].items():
                if w > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if -2 not in level:
            return {k for k in level if k >= 0}
        turn = {k: iter(left[k]) for k in level}
        path = [-1]
        while path:
            a = path[-1]
            if a == -2:
                push = min(left[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    left[x][y] -= push
                    left[y][x] += push
                cut = next(i for i, (x, y) in enumerate(zip(path, path[1:], strict=False)) if left[x][y] <= tiny)
                del path[cut + 1 :]
                continue
            b = next((b for b in turn[a] if left[a][b] > tiny and level.get(b) == level[a] + 1), None)
            if b is None:
                path.pop()
                if path:  # nothing more goes through a
                    level.pop(a)
            else:
                path.append(b)


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by blank lines; "" for null, empty or all-boilerplate pages.

    Where names alone leave a page without content, they are no evidence.
    """
    kept = _kept(blocks(page or ""))
    return "\n\n".join(kept or _kept(blocks(page or "", named=False)))


def _kept(found: list[Block]) -> list[str]:
    if not found:
        return []
    keep = minimum_cut([b.cost_content for b in found], [b.cost_boiler for b in found], edges(found))
    return [b.text for b, k in zip(found, keep, strict=True) if k]


def extract_pages(df: DataFrame, page: str = "html", output: str = "text") -> DataFrame:
    """The other columns and the main text of each whole page, extracted where the page is read.

    A column named as the output, or the page's own, is not kept.  Null and empty pages have the text "", an empty table
    no rows.
    """
    kept = [c for c in df.columns if c not in (page, output)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{output}` string"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], [*kept, output])

    return df.select(*[f"`{c}`" for c in kept], page).mapInArrow(extract, schema)
