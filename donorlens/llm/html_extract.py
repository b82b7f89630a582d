"""Main text of web pages by wrappers: union-free regular expressions over the tag streams of a host's pages.

A page becomes a stream of containers and text slots. Aligning the streams of one host turns what they share into the
wrapper's sequence, what some lack into optional items, and what recurs side by side into repeated items; how much text a
slot holds, how much of it links, and whether it is the same text all over add up over the pages. Wrappers align with each
other just as pages do, so they are formed inside partitions, then in salted groups of a host, then for each host. The
wrapper's container with the host's main text is what is taken from each page, without the containers in it that the wrapper
has as constant or as lists of links; a page that lacks it is taken for a wrapper of its own.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.skew import attach
from donorlens.llm.store import shuffle_partitions, written
from donorlens.llm.url_filter import host_and_path

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!?\?[^>]*>?|<![^>]*>?"
    r"|<(script|style)(?![\w:-]).*?(?:</\1\s*>|\Z)"
    # These end where they close, before another of their kind opens; one that doesn't close hides nothing.
    r"""|<(noscript|template|svg|iframe|textarea|select|button|title)(?![\w:-])(?:[^>"']|"[^"]*"|'[^']*')*(?<!/)>"""
    r"(?:(?!<\2(?![\w:-])).)*?</\2\s*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)>?""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
#: Elements that bound a block of text; all of them look alike in a wrapper.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl pre blockquote table tr td th caption figure figcaption address hr".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form center details fieldset dialog menu".split())
#: Elements that end an open paragraph, or an open element of their own kind.
ENDS_ITSELF = frozenset("p li dt dd tr td th".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Parts of a page that are not its text, by element or by a word of class, id or role.
NOT_TEXT = frozenset("nav footer aside form menu dialog head fieldset".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo cookie cookies consent notice notices "
    "comment comments disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social "
    "related newsletter subscribe signup popup modal toolbar widget search pagination complementary contentinfo".split()
)
#: A class, id or role with one of these words says that the other word is lacking, or is a topic.
OTHER_WORDS = frozenset("no not non without with has have hide hidden category tag topic format template layout".split())
#: With one of these, it tells of a state of the page; but inside an article, of the element itself.
STATE_WORDS = OTHER_WORDS | frozenset("is show open opened closed enabled disabled allowed active status".split())
#: Articles under these words are replies or other articles.
REPLIES = frozenset("comment comments disqus related".split())
#: Elements that no word makes less than text. Words don't hide an article longer than all others either.
ALWAYS_TEXT = frozenset("html body main".split())
#: Elements nested deeper than this leave their blocks to the one above; their end tags are still their own.
MAX_DEPTH = 100
#: A slot is a list of links from this share of characters in links on, and constant from this share of one text on, if it
#: was seen on so many pages.
LINKED, CONSTANT, CONSTANT_PAGES = 0.8, 0.9, 3
#: Items of one wrapper node; the rarest of more than these are put together.
MOST_ITEMS = 200
#: Where all slots of a host are constant, though its pages differ, a container goes on to its child beside other containers
#: while the child holds this share of the text.
MOST = 0.9


class Link(str):
    """Text inside a link."""

    __slots__ = ()


class Element:
    """A node of a page: children are elements and texts. `label` is what wrappers compare, `by_word` whether only a word
    of class, id or role has it skipped."""

    __slots__ = ("by_word", "children", "label", "skipped", "tag")

    def __init__(self, tag: str, label: str, skipped: bool, by_word: bool = False):
        self.tag, self.label, self.skipped, self.by_word, self.children = tag, label, skipped, by_word, []


def _element(tag: str, attributes: str, inside_text: bool, by_words: bool) -> Element:
    words, marked = [], False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            own = re.findall(r"[a-z]+|[0-9]+", name)
            undone = OTHER_WORDS if inside_text else STATE_WORDS
            marked = marked or (not NOT_TEXT_WORDS.isdisjoint(own) and undone.isdisjoint(own))
            words += own
    skipped = tag in NOT_TEXT or (tag == "header" and not inside_text)
    by_word = by_words and marked and not skipped and tag not in ALWAYS_TEXT
    names = sorted({w for w in words if not w.isdigit()})
    return Element(tag, ".".join([tag, *names]) if tag in CONTAINERS else "block", skipped or by_word, by_word)


def _size_of(element: Element) -> int:
    """Characters of an element's text, without skipped parts inside it."""
    return sum(len(c.strip()) if isinstance(c, str) else 0 if c.skipped else _size_of(c) for c in element.children)


def _unhide(root: Element) -> None:
    """No word hides the body or the main element, nor the page's longest article unless another text is there, nor what these
    stand in. A hidden article counts as the page's text if no article is visible and less other text than a quarter of it;
    one under the words of replies only if there is no other text."""
    visible, articles = 0, []
    todo: list[tuple[Element, list[Element]]] = [(root, [])]
    while todo:
        element, hidden = todo.pop()
        if element.tag in ("body", "main"):
            for e in hidden:
                e.skipped = e.by_word = False
            hidden = []
        if element.tag == "article":
            articles.append((element, hidden))
        if not hidden:
            visible += sum(len(c.strip()) for c in element.children if isinstance(c, str))
        for child in element.children:
            if not isinstance(child, str) and (child.by_word or not child.skipped):
                todo.append((child, [*hidden, child] if child.by_word else hidden))
    sizes = [(_size_of(element), hidden) for element, hidden in articles]
    if any(size and not hidden for size, hidden in sizes):
        return
    for size, hidden in sorted((x for x in sizes if x[0]), key=lambda x: -x[0])[:1]:
        reply = any(not REPLIES.isdisjoint(re.findall("[a-z]+", e.label)) for e in hidden)
        if visible == 0 or (not reply and 4 * visible < size):
            for e in hidden:
                e.skipped = e.by_word = False


def parse(page: str, by_words: bool = True) -> Element:
    """The page as a tree of containers, blocks and texts; inline elements leave only their text. Without `by_words`, only
    elements tell what is no text."""
    root, hides, texts = Element("", "", False), False, False
    # Open elements as (tag, the element that takes what is inside); their places by tag, and the places of containers.
    open_: list[tuple[str, Element]] = [("", root)]
    places: dict[str, list[int]] = {}
    containers = [0]
    at, in_text, depth, link = 0, 0, 0, 0

    def close(index: int) -> None:
        nonlocal in_text, depth, link
        # A link ends with the element that it began in. The root holds all links, but stays open.
        if link > index:
            link = 0
        while len(open_) > index:
            tag, inside = open_.pop()
            places[tag].pop()
            if containers[-1] == len(open_):
                containers.pop()
            in_text -= tag in ("article", "main")
            if inside is not open_[-1][1]:
                depth -= 1
            elif inside.children:
                inside.children.append(Element(tag, "block", False))  # what follows is another block

    for m in TOKEN.finditer(page):
        if m.start() > at:
            open_[-1][1].children.append(Link(page[at : m.start()]) if link else page[at : m.start()])
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if tag in ("br", "img", "wbr"):
            open_[-1][1].children.append(" ")
        if tag == "a":
            link = 0 if m[3] else len(open_)
        if tag not in BLOCKS and tag not in CONTAINERS and tag != "head":
            continue
        if m[3]:
            # The end tag of a block doesn't reach beyond the container it stands in.
            if places.get(tag) and (tag not in BLOCKS or places[tag][-1] > containers[-1]):
                close(places[tag][-1])
            continue
        if open_[-1][0] in ("p", "head") or (tag in ENDS_ITSELF and open_[-1][0] == tag):
            close(len(open_) - 1)
        element = _element(tag, m[5], in_text > 0, by_words)
        hides, texts = hides or element.by_word, texts or tag in ("body", "main", "article")
        above = open_[-1][1]
        # Below the depth an element is an empty block between texts of the one above, unless it is skipped: that one opens
        # and takes all inside it.
        deep = depth >= MAX_DEPTH
        if deep:
            element = Element(tag, "block", element.skipped, element.by_word)
        if not (deep and above.skipped):
            above.children.append(element)
        if tag not in VOID:
            shared = deep and (above.skipped or not element.skipped)
            depth += not shared
            places.setdefault(tag, []).append(len(open_))
            if tag in CONTAINERS:
                containers.append(len(open_))
            open_.append((tag, above if shared else element))
            in_text += tag in ("article", "main")
    if at < len(page):
        open_[-1][1].children.append(page[at:])
    if hides and texts:
        _unhide(root)
    return root


# A wrapper node is [label, characters, optional, repeated, items, [seen, texts in links, characters in links, words, digest
# of its most common text, how often that was seen more than others]]. The last figure is a lower bound (Misra-Gries).


def wrapper_of(element: Element) -> list:
    """The wrapper of one page: skipped parts have no slots, neighbours of one label are one repeated item."""
    items: list[list] = []
    size = links = linked = words = digest = 0
    for child in element.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                size += len(text)
                words += text.count(" ") + 1
                digest = zlib.crc32(text.encode("utf-8", "replace"), digest)
                if isinstance(child, Link):
                    links, linked = links + 1, linked + len(text)
        elif not child.skipped:
            item = wrapper_of(child)
            if item[0] == "block":
                item[4] = []
            size, about = size + item[1], item[5]
            links, linked, words = links + about[1], linked + about[2], words + about[3]
            digest = zlib.crc32(about[4].to_bytes(4, "big"), digest) if item[1] else digest
            items.append(item)
    items = _folded(items)
    return [element.label, size, False, False, items, [1, links, linked, words, digest, 1]]


def _together(a: list, b: list) -> list:
    digest, more = (a[4], a[5] + b[5]) if a[4] == b[4] else max((a[5], a[4]), (b[5], b[4]))[::-1]
    if a[4] != b[4]:
        more -= min(a[5], b[5])
    return [*(x + y for x, y in zip(a[:4], b[:4], strict=True)), digest, more]


def _bounded(items: list[list]) -> list[list]:
    """Of more than MOST_ITEMS items those that the fewest pages have become one optional item without a label of its own."""
    least = 1
    while len(items) > MOST_ITEMS:
        rare = [i for i in items if i[5][0] <= least or i[0] == "*"]
        if rare:
            about = rare[0][5]
            for other in rare[1:]:
                about = _together(about, other[5])
            first = next(k for k, i in enumerate(items) if i is rare[0])
            kept = [i for i in items if not (i[5][0] <= least or i[0] == "*")]
            before = sum(not (i[5][0] <= least or i[0] == "*") for i in items[:first])
            items = [*kept[:before], ["*", sum(i[1] for i in rare), True, True, [], about], *kept[before:]]
        least *= 2
    return items


def _folded(items: list[list]) -> list[list]:
    """Runs that recur side by side (of one to three items) become repeated items."""
    for period in (1, 2, 3):
        out: list[list] = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * period and all(out[-k][0] == out[-k - period][0] for k in range(1, period + 1)):
                tail = out[-period:]
                del out[-period:]
                for k, again in enumerate(tail):
                    merged = merge(out[-period + k], again)
                    merged[3] = True
                    out[-period + k] = merged
        items = out
    return _bounded(items)


def merge(a: list, b: list) -> list:
    """Align two wrappers of one label. Items that only one of them has become optional."""
    pairs = _aligned([i[0] for i in a[4]], [i[0] for i in b[4]])
    items = []
    for i, j in pairs:
        if i is not None and j is not None:
            items.append(merge(a[4][i], b[4][j]))
        else:
            own = a[4][i] if j is None else b[4][j]
            items.append([own[0], own[1], True, *own[3:]])
    return [a[0], a[1] + b[1], a[2] or b[2], a[3] or b[3], _folded(items), _together(a[5], b[5])]


def _aligned(a: list[str], b: list[str]) -> list[tuple]:
    """Longest common subsequence of labels, with the rest of both sides in between."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and table[i + 1][j] >= table[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _is_constant(node: list) -> bool:
    seen, most = node[5][0], node[5][5]
    return seen >= CONSTANT_PAGES and most >= CONSTANT * seen


def _is_boilerplate(node: list) -> bool:
    """Constant text, a list of links, or a container of one word that not all pages have (a label or a button)."""
    seen, links, linked, words = node[5][:4]
    label = node[2] and node[0] != "block" and words <= seen
    return label or _is_constant(node) or (links > seen and linked >= LINKED * node[1])


def _own_size(node: list) -> int:
    """Characters that stand in a container itself."""
    return 0 if node[0] == "block" else node[1] - sum(i[1] for i in node[4])


def _has_text(node: list) -> bool:
    if not node[1] or _is_boilerplate(node):
        return False
    return node[0] == "block" or _own_size(node) > 0 or any(_has_text(i) for i in node[4])


def main_path(wrapper: list) -> list[str]:
    """Labels from the root to the container of the main text: the article or main element with most text, else the
    lowest container with all slots that are no boilerplate."""
    best: dict[str, tuple[int, list[str]]] = {}
    todo = [(wrapper, [])]
    while todo:
        node, path = todo.pop()
        for item in node[4]:
            here = [*path, item[0]]
            tag = item[0].split(".")[0]
            if tag in ("article", "main") and item[1] > best.get(tag, (0, []))[0]:
                best[tag] = (item[1], here)
            todo.append((item, here))
    if best:
        article, whole = best.get("article", (0, [])), best.get("main", (0, []))
        return article[1] if 2 * article[0] >= whole[0] else whole[1]
    marked = any(_has_text(i) for i in wrapper[4])
    # Copies of one page can't tell what is constant, a host of some pages and many copies of one can't well.
    shares = not marked and _is_constant(wrapper) and wrapper[5][5] < wrapper[5][0]
    node, path = wrapper, []
    while not _own_size(node):
        inside = [i for i in node[4] if (_has_text(i) if marked else i[1])]
        if shares and inside and all(i[0] != "block" for i in inside):
            inside = [i for i in inside if i[1] >= MOST * node[1]] or inside
        # Containers of one label side by side are at one path.
        if not inside or inside[0][0] == "block" or any(i[0] != inside[0][0] for i in inside):
            break
        node, path = max(inside, key=lambda i: i[1]), [*path, inside[0][0]]
        if len(inside) > 1:
            break
    return path


def cut_paths(wrapper: list, path: list[str]) -> list[str]:
    """Containers below the main text that are boilerplate: constant while what they stand in is not, or lists of links. Each
    is a path of labels from the main text on, joined by spaces."""
    node = wrapper
    for label in path:
        node = next((i for i in node[4] if i[0] == label), None)
        if node is None:
            return []
    out, todo = [], [(node, "")]
    while todo:
        node, at = todo.pop()
        for item in node[4]:
            if item[0] in ("block", "*") or not item[1]:
                continue
            here = f"{at} {item[0]}".strip()
            seen, links, linked = item[5][:3]
            constant = _is_constant(item) and not _is_constant(node)
            # A label that recurs stands for several slots, of which one may hold text.
            alone = sum(i[0] == item[0] for i in node[4]) == 1
            if alone and (constant or (links > seen and linked >= LINKED * item[1])):
                out.append(here)
            else:
                todo.append((item, here))
    return sorted(out)


def _at(element: Element, path: list[str]) -> list[Element]:
    """The elements at a path; at one level all that have the label."""
    found = [element]
    for label in path:
        found = [c for e in found for c in e.children if not isinstance(c, str) and c.label == label and not c.skipped]
    return found


def blocks(element: Element, cuts: frozenset[str] = frozenset()) -> list[str]:
    """The texts of an element's blocks, in order, without skipped parts and without the containers at the paths `cuts`."""
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(inline)).split())
        if text:
            out.append(text)
        inline.clear()

    def walk(e: Element, at: str | None) -> None:
        """`at`: the path of labels that leads here, None below a block."""
        for child in e.children:
            if isinstance(child, str):
                inline.append(child)
            elif not child.skipped:
                here = None if at is None or child.label == "block" else f"{at} {child.label}".strip()
                flush()
                if here is None or here not in cuts:
                    walk(child, here)
                flush()

    walk(element, "")
    flush()
    return out


def main_text(page: str | None, path: list[str] | None, cuts: list[str] | None = None) -> str:
    """`path` and `cuts`: where the host's wrapper has the main text, and what of it is boilerplate."""
    if not page:
        return ""
    root = parse(page)
    found = _at(root, path) if path else []
    if not any(blocks_of := [blocks(e, frozenset(cuts or ())) for e in found]) and not any(blocks_of := [blocks(e) for e in found]):
        # The host's wrapper has another place for the text: the page is its own wrapper.
        blocks_of = [blocks(e) for e in _at(root, main_path(wrapper_of(root)))]
    if not any(blocks_of):
        # Words may have hidden all of the text.
        root = parse(page, by_words=False)
        blocks_of = [blocks(e) for e in _at(root, main_path(wrapper_of(root)))]
    return "\n\n".join(b for part in blocks_of for b in part)


def _host_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper for each host among a partition's pages. Pages of one structure differ in sizes only."""
    found: dict[str, list] = {}
    pages: dict[str, int] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = wrapper_of(parse(page or ""))
            found[host] = merge(found[host], own) if host in found else own
            pages[host] = pages.get(host, 0) + 1
        # Hosts that a partition has many of go on early; their wrappers meet again in the next step.
        if len(found) > 20_000:
            yield _wrapper_rows(found, pages)
            found, pages = {}, {}
    yield _wrapper_rows(found, pages)


def _wrapper_rows(found: dict[str, list], pages: dict[str, int]) -> pa.RecordBatch:
    columns = [pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([pages[h] for h in found], pa.int64())], names=["host", "wrapper", "n_pages"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of each host among a partition's wrappers, merged one by one."""
    found: dict[str, list] = {}
    pages: dict[str, int] = {}
    for batch in batches:
        for host, text, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found[host] = merge(found[host], json.loads(text)) if host in found else json.loads(text)
            pages[host] = pages.get(host, 0) + n
    yield _wrapper_rows(found, pages)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """`pages`: (host, html). One row per host: host, wrapper (as JSON), n_pages."""
    schema = "host string, wrapper string, n_pages long"
    parts = shuffle_partitions(pages.sparkSession)
    local = pages.select("host", "html").mapInArrow(_host_wrappers, schema)
    # Wrappers of a host that all partitions have: first in salted groups, then one for each group.
    salted = local.withColumn("salt", F.spark_partition_id() % 16).repartition(parts, "host", "salt").drop("salt")
    return salted.mapInArrow(_merged, schema).repartition(parts, "host").mapInArrow(_merged, schema)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrappers = [json.loads(w) for w in batch.column(1).to_pylist()]
        paths = [main_path(w) for w in wrappers]
        cuts = [cut_paths(w, p) for w, p in zip(wrappers, paths, strict=True)]
        lists = [pa.array(x, pa.list_(pa.string())) for x in (paths, cuts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2)], names=["host", "path", "cuts", "n_pages"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(*given) for given in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
        )


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Blocks are joined by an empty line, white space inside a block is one space, character references are decoded. Null and
    empty pages have an empty text. Null and malformed addresses share the host "". Ids may be null or repeat: each row
    stands for itself. Other columns are not read. An empty table gives an empty result.
    """
    host, _ = host_and_path(df[url_col])
    pages = df.select(df[id_col].alias("page_id"), df[url_col].alias("url"), df[html_col].alias("html"), host.alias("host"))
    paths = written(
        infer_wrappers(pages).mapInArrow(_paths, "host string, path array<string>, cuts array<string>, n_pages long"), "html-paths"
    )
    total = paths.agg(F.sum("n_pages")).first()[0] or 0
    rows = attach(pages, paths, "host", "n_pages", total).select("page_id", "url", "html", "path", "cuts")
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
