"""Main text of web pages by tag-path ratios.

A page is scanned once into text blocks, each under its root-to-leaf path of
block-level tags. What the class, id, role and tag of an element say of its part
in the page is a feature of the path, worth some bits. Then, page by page:

1. Aggregate: per path, text length without links, punctuation and blocks; the
   ratio of a path is mean length times mean punctuation of its blocks. Text of
   menus is link text.
2. Smooth: a block's ratio is averaged with its neighbours' in its container,
   the nearest element around it that is no paragraph, heading, list or table.
3. Fuse: a path takes the mean of its blocks' smoothed ratios; then paths inside
   a root, which holds the content, mostly take the mean ratio of the root's
   text. So headings, captions and items stay with the paragraphs around them.
   Roots are the outermost ``article`` and ``main`` elements; in pages without,
   the deepest element that holds most of the text above the threshold, and
   those of its path that hold a path above the threshold which it holds too.
4. Threshold: a path's score is the logarithm of its ratio and the bits of its
   names. Blocks of all paths within ``SPREAD`` bits of the best are the text.
   It is a little more than ``article`` is worth: a plain path goes only if its
   ratio is lower too.

Every pass is linear in the page, damaged markup and deep nesting included.

Defined cases: a null or empty page, or one with no text, gives an empty text;
damaged markup is read as browsers do as far as block structure goes (omitted
end tags, unclosed inline tags, a cut-off tail); hidden elements have no text;
repeated rows are extracted each; a very long page is one task's work; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishear.llm._arrow import slices, tidy

# Element names by their role, and words of class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg".split())
BLOCK = set(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where an element of the second kinds begins.
ENDS_BEFORE = {
    "p": BLOCK - {"html", "body", "head"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "head": {"body"},
} | {h: HEADINGS for h in HEADINGS}
#: Elements whose text is that of links, of other parts of the page, and not shown at all.
MENU_TAGS, OTHER_TAGS, UNSEEN_TAGS = {"nav", "menu"}, set("footer aside form button select option dialog".split()), set("head object canvas".split())
#: Elements that hold a piece of text, no container of several.
LEAVES = HEADINGS | set("p li ul ol dl dt dd table tbody thead tfoot tr td th caption pre blockquote details summary figcaption figure hgroup".split())
OTHER_WORDS = set(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup "
    "promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola toolbar topbar warning widget widgets alert".split()
)
MENU_ROLES = {"navigation", "menu", "menubar", "toolbar"}
OTHER_ROLES = set("banner complementary contentinfo search form dialog alert alertdialog".split())
#: Words that a class or id may add to one of these and still mean the same.
PLAIN_WORDS = set("area bar block box button buttons icons item items link links list posts".split())
MAIN_WORDS = set("articlebody article-body entry-content post-content story-body".split())

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*")
RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9-])", re.I | re.A) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Weights of a block and its neighbours, and the share that a path in a root takes from the root.
SMOOTHING, SHARED = (0.25, 0.5, 0.25), 0.9
#: Bits that an article's path and one of another part of the page are worth, and how far below the best content reaches.
MAIN_BITS, OTHER_BITS, SPREAD = 1.5, -8.5, 1.51
#: Share of the text above the threshold that a root holds, and of links in a list that takes nothing from such a root.
MOST_TEXT, LINK_SHARE = 0.75, 0.6


class Element:
    """An open block-level element. ``path`` numbers its root-to-leaf path; ``bits`` is what that path's names are worth."""

    __slots__ = ("name", "parent", "path", "depth", "bits", "main", "outer_main", "menu", "unseen")

    def __init__(self, name: str, parent: "Element | None", path: int, bits: float, main: bool, menu: bool, unseen: bool):
        self.name, self.parent, self.path, self.bits, self.main = name, parent, path, bits, main
        self.depth = 0 if parent is None else parent.depth + 1
        self.menu, self.unseen = menu or parent is not None and parent.menu, unseen or parent is not None and parent.unseen
        self.outer_main = parent.outer_main if parent is not None and parent.outer_main is not None else self if main else None


class Block:
    __slots__ = ("element", "text", "links", "marks")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links, self.marks = element, text, links, len(PUNCTUATION.findall(text))


def attributes(rest: str) -> dict[str, str]:
    return {n.lower(): html.unescape(a or b or c or "") for n, a, b, c in ATTRIBUTE.findall(rest)}


def named_other(label: str) -> bool:
    """Whether a whole class or id token, not just a part of it, names something else."""
    for token in label.split():
        words = {w.lower() for w in WORDS.findall(token)}
        if words & OTHER_WORDS and words <= OTHER_WORDS | PLAIN_WORDS:
            return True
    return False


def said(name: str, rest: str, in_main: bool) -> tuple[float, bool, bool, bool]:
    """What an element says of itself: bits, and whether it is an article, a menu or not shown."""
    main, menu, unseen = name in ("article", "main"), name in MENU_TAGS, name in UNSEEN_TAGS
    other = name in OTHER_TAGS or name == "header" and not in_main
    if rest and not rest.isspace():
        own = attributes(rest)
        if "class" in own or "id" in own:
            label = f"{own.get('class', '')} {own.get('id', '')}"
            if main and any(w.lower() in OTHER_WORDS for w in WORDS.findall(label)):  # the article of a comment
                main, other = False, True
            elif name not in ("html", "body"):
                other = other or named_other(label)
                main = main or not other and bool(MAIN_WORDS & set(label.lower().split()))
        role = own.get("role", "").lower()
        other, menu = other or role in OTHER_ROLES, menu or role in MENU_ROLES
        main = main or role == "main" or own.get("itemprop", "").lower() == "articlebody"
        style = own.get("style", "").replace(" ", "").lower()
        unseen = unseen or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in style
    main = main and not other
    return (MAIN_BITS if main and not in_main else 0.0) + (OTHER_BITS if other else 0.0), main, menu, unseen


class Scanner:
    """Reads a page into blocks."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        self.here = Element("", None, 0, 0.0, False, False, False)
        self.open: Counter[str] = Counter()
        self.paths: dict[tuple, int] = {}
        self.parts: list[str] = []
        self.links, self.in_link = 0, False
        self.skip, self.skip_depth, self.skip_all = "", 0, False  # an inline element without text, and whether blocks in it have none
        self.quotes = True

    def add(self, text: str, coded: bool = True) -> None:
        if text and not self.skip:
            text = html.unescape(text) if coded and "&" in text else text
            self.parts.append(text)
            if self.in_link or self.here.menu:
                self.links += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not self.here.unseen:
                self.blocks.append(Block(self.here, text, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def leave(self, to: Element) -> None:
        """Closes elements up to ``to``, and that one."""
        while self.here is not to:
            self.open[self.here.name] -= 1
            self.here = self.here.parent
        self.open[to.name] -= 1
        self.here = to.parent

    def run(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0:
                self.add(page[at:])
                break
            self.add(page[at:start])
            at = self.markup(start)
            if at < 0:
                break
        self.flush()
        return self.blocks

    def markup(self, start: int) -> int:
        """Reads what begins with the ``<`` at ``start``; where it ends, -1 if the page ends in it."""
        page = self.page
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return -1 if end < 0 else end + 3
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            self.add(page[start + 9 : end if end >= 0 else len(page)], coded=False)
            return -1 if end < 0 else end + 3
        if page.startswith(("<!", "<?"), start):
            return page.find(">", start) + 1 or -1
        match = TAG.match(page, start)
        if match is None:
            self.add("<")
            return start + 1
        name, closing = match[1].lower(), page[start + 1] == "/"
        stop = REST.match(page, match.end()).end() if self.quotes else page.find(">", match.end())
        if stop < 0 or stop >= len(page) or page[stop] != ">":
            self.quotes = False  # a quote that never ends: from here on quotes are like other characters
            stop = page.find(">", match.end())
            if stop < 0:
                return -1
        if closing:
            self.close(name)
            return stop + 1
        if name in RAW:
            end = RAW_END[name].search(page, stop)
            return -1 if end is None else page.find(">", end.end()) + 1 or -1
        self.start(name, page[match.end() : stop])
        return stop + 1

    def close(self, name: str) -> None:
        if self.skip:
            if name == self.skip:
                self.skip_depth -= 1
                self.skip = self.skip if self.skip_depth else ""
            if self.skip_all and self.skip:
                return
        if name == "a":
            self.in_link = False
        elif self.open[name] > 0:
            self.flush()
            found = self.here
            while found.name != name:
                found = found.parent
            self.leave(found)

    def start(self, name: str, rest: str) -> None:
        if self.skip:
            if name == self.skip:
                self.skip_depth += 1
            if self.skip_all or name not in BLOCK:
                return
            self.skip = ""  # a named inline element that holds blocks: its name says nothing
        if name in ("br", "math", "annotation"):
            self.add(" ")
        elif name == "a":
            self.in_link = True
        elif name in BLOCK or name in OTHER_TAGS or name in UNSEEN_TAGS:
            self.flush()
            while name in ENDS_BEFORE.get(self.here.name, ()):
                self.leave(self.here)
            if name != "hr" and not rest.endswith("/"):
                parent = self.here
                bits, main, menu, unseen = said(name, rest, parent.outer_main is not None)
                path = self.paths.setdefault((parent.path, name, bits, menu), len(self.paths) + 1)
                self.here = Element(name, parent, path, parent.bits + bits, main, menu, unseen)
                self.open[name] += 1
        elif name not in VOID and rest and not rest.isspace() and not rest.endswith("/"):
            bits, _, _, unseen = said(name, rest, True)
            if unseen or bits < 0:
                self.skip, self.skip_depth, self.skip_all = name, 1, unseen


def scan(page: str) -> list[Block]:
    """Text blocks in page order, those of other parts of the page included."""
    return Scanner(page).run()


def container(element: Element) -> Element:
    while element.name in LEAVES and element.parent is not None:
        element = element.parent
    return element


def ratios(blocks: list[Block]) -> dict[int, float]:
    """Aggregates by path, smooths along containers and fuses by path: the ratio of each path."""
    paths: defaultdict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in blocks:
        own = paths[b.element.path]
        own[0] += max(0, len(b.text) - b.links)
        own[1] += b.marks
        own[2] += 1
    raw = {p: (length / n) * (1 + marks) / n for p, (length, marks, n) in paths.items()}
    held: dict[int, list[Block]] = {}
    for b in blocks:
        held.setdefault(id(container(b.element)), []).append(b)
    fused: defaultdict[int, list[float]] = defaultdict(list)
    before, own, after = SMOOTHING
    for group in held.values():
        values = [raw[b.element.path] for b in group]
        last = len(values) - 1
        for i, b in enumerate(group):
            fused[b.element.path].append(before * values[max(0, i - 1)] + own * values[i] + after * values[min(last, i + 1)])
    return {p: sum(v) / len(v) for p, v in fused.items()}


def score(ratio: float, bits: float) -> float:
    return math.log2(1 + ratio) + bits


def _list_of(block: Block) -> object:
    """The outermost list or table around a block, else the block."""
    element, found = block.element, block
    while element is not None and element.name in LEAVES:
        found = element if element.name in ("ul", "ol", "dl", "table") else found
        element = element.parent
    return found


def roots_of(blocks: list[Block], fused: dict[int, float]) -> list[Element | None]:
    """The root that each block is in."""
    mains = [b.element.outer_main for b in blocks]
    if any(m is not None for m in mains):
        return mains
    scores = [score(fused[b.element.path], b.element.bits) for b in blocks]
    best = max(scores)
    above = [s >= best - SPREAD for s in scores]
    weight: Counter[int] = Counter()
    holders: dict[int, Element] = {}
    total = 0
    for b, ok in zip(blocks, above):  # text of each element; elements add it to their parents, the deepest first
        if ok:
            holders[id(b.element)] = b.element
            weight[id(b.element)] += len(b.text)
            total += len(b.text)
    levels: defaultdict[int, dict[int, Element]] = defaultdict(dict)
    for e in holders.values():
        levels[e.depth][id(e)] = e
    deep = None
    for depth in range(max(levels), -1, -1):
        for key, e in levels[depth].items():
            if weight[key] >= MOST_TEXT * total:
                deep = e
                break
            if e.parent is not None:
                weight[id(e.parent)] += weight[key]
                levels[depth - 1][id(e.parent)] = e.parent
        if deep is not None:
            break
    if deep.parent is not None and len(blocks) > 1:
        deep = container(deep)

    def at_root(e: Element | None) -> Element | None:
        while e is not None and e.depth > deep.depth:
            e = e.parent
        return e if e is not None and e.path == deep.path else None

    places = {id(e): at_root(e) for e in {id(b.element): b.element for b in blocks}.values()}
    own = [places[id(b.element)] for b in blocks]
    content = {b.element.path for b, e, ok in zip(blocks, own, above) if e is deep and ok}
    kept = {id(deep)} | {id(e) for b, e, ok in zip(blocks, own, above) if e is not None and ok and b.element.path in content}
    return [e if e is not None and id(e) in kept else None for e in own]


def content(page: str | None) -> list[str]:
    """The blocks of the main text."""
    blocks = scan(page or "")
    if not blocks:
        return []
    fused = ratios(blocks)
    roots = roots_of(blocks, fused)
    sums: defaultdict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    linked: defaultdict[int, list[int]] = defaultdict(lambda: [0, 0])
    lists = [id(_list_of(b)) for b in blocks]
    for b, root, own in zip(blocks, roots, lists):
        linked[own][0] += b.links
        linked[own][1] += len(b.text)
        if root is not None and b.element.bits >= root.bits:  # text of the root, weighted by its length
            sums[root.path][0] += len(b.text) * fused[b.element.path]
            sums[root.path][1] += len(b.text)
    scores = []
    for b, root, own in zip(blocks, roots, lists):
        ratio = fused[b.element.path]
        links, size = linked[own]
        if root is not None and sums[root.path][1] and (root.main or b.element.name in HEADINGS or b.element.name == "p" or links <= LINK_SHARE * size):
            whole, length = sums[root.path]
            ratio = max(ratio, (1 - SHARED) * ratio + SHARED * whole / length)
        scores.append(score(ratio, b.element.bits))
    least = max(scores) - SPREAD
    return [b.text for b, s in zip(blocks, scores) if s >= least and s > 0]


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", content_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = pa.array(["\n\n".join(content(x)) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), texts, pc.utf8_length(texts).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(content_column).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
