"""Main text of pages by wrappers: the union-free regular expression that the pages of a host share.

A page becomes a tree of elements (its markup) and texts. Blocks of text that stand on most pages of
a host (``SHARE`` of them, of at least ``SEVERAL`` pages) are counted first: they are literals of the
expression, all other texts are slots. Pages of one host are then aligned iteratively, level by level,
with the literals as anchors: an element whose texts are all literal matches only the same one.
Elements that match are merged, elements that only one side has become optional, neighbours that
repeat (alone or in groups of two or three) become one repeated part; a literal is never folded into
what varies. Slots know how much text they held. The result is the host's wrapper. Alignment runs as
partial aggregation: pages with the same shape are counted together in their task, and wrappers are
merged in a tree of ``FAN`` at a time whose height follows the number of shapes, so a host with a
third of all pages is spread.

A wrapper marks the parts that hold the main text: the article (or main) elements without what their
tags, roles and class names call menus, headers, footers, sidebars, notices, adverts, forms, scripts
or comments. Where no element is named so, the slots decide: the deepest element that holds most of
the varying text outside links, without parts that are mostly links, and without literals. Inside an
element that calls itself the article literals stay: there a sentence that many pages share is text.
The text of a page is read through the wrapper of its host; a page in which the wrapper finds nothing
is read through a wrapper of its own.

Text: character references are decoded, white space inside a block becomes one space, ends are
trimmed, and blocks are joined in page order by a line feed. ``br`` and inline elements do not end a
block. Nothing else is dropped or cut.

Defined results: null markup is empty and gives the empty text; null addresses form one host; markup
that is cut off or not closed is read as far as it goes, in time in proportion to its length;
elements below ``LEVELS`` levels belong, in wrappers, to the last of them; rows that repeat give the
same text each; an empty table gives no rows; columns other than the key, address and markup are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

#: Shapes (and block counts) a task holds before it hands them on; shapes or wrappers merged at a time.
SHAPES, COUNTS, FAN = 2_000, 200_000, 64
#: A block that stands on this share of a host's pages, of at least so many, is a literal of its wrapper.
SHARE, SEVERAL = 0.8, 5
#: Cells up to which two sequences are aligned by the exact table of common subsequences.
CELLS = 250_000
#: Levels of elements a wrapper tells apart; what lies deeper belongs to the last of them.
LEVELS = 100

# Fixed by the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: What an element closes when it begins, up to the nearest of the elements that bound it.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

# Names for what is not main text.
SKIP_TAGS = RAW | frozenset("head nav footer aside form button select option input dialog menu fieldset object canvas audio video".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
SKIP_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu menus breadcrumb
    breadcrumbs sidebar sidebars aside widget widgets comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal
    overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendation recommendations footer header masthead
    topbar toolbar copyright search form pagination pager toc skip side""".split()
)
MAIN_TAGS = ("article", "main")

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.DOTALL
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")
TEXT = "#text"
#: Stands between the symbol of a node and the digest of its literal text.
LITERAL = "\x1f"


def events(markup: str) -> Iterator[tuple[str, str, str]]:
    """('open', tag, symbol), ('close', tag, '') and ('text', raw text, '') in page order.

    Elements that end others implicitly are closed, raw elements lose their content.
    """
    at, size, stack = 0, len(markup), []
    # Depths of the open elements by tag, and of those that are not inline: no search through the stack.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def close(back: int) -> Iterator[tuple[str, str, str]]:
        for depth in range(len(stack) - 1, back - 1, -1):
            open_tag = stack.pop()
            places[open_tag].pop()
            if blocks and blocks[-1] == depth:
                blocks.pop()
            yield "close", open_tag, ""

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while at < size:
        found = TOKEN.search(markup, at)
        if found is None:
            yield "text", markup[at:], ""
            break
        if found.start() > at:
            yield "text", markup[at : found.start()], ""
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, ending = tag.lower(), found[1] or found[4]
        if ending:
            back = nearest((tag,))
            # An inline end tag does not reach across the block around it.
            if back >= 0 and not (tag in INLINE and blocks and blocks[-1] > back):
                yield from close(back)
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]] == "p":
            yield from close(blocks[-1])
        elif tag in SIBLINGS:
            same, bounds = SIBLINGS[tag]
            back = nearest(same)
            if back > nearest(bounds - same):
                yield from close(back)
        rest = found[3] or found[6] or ""
        symbol = tag
        if "=" in rest and (named := ATTRIBUTE.findall(rest)):
            symbol = " ".join([tag, *sorted(f"{n.lower()}={DIGITS.sub('0', (a or b or c).lower())}" for n, a, b, c in named)]).replace(LITERAL, " ")
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(markup, at)
                at = end.end() if end else size
            continue
        yield "open", tag, symbol
        if tag in VOID:
            yield "close", tag, ""
        else:
            if tag not in INLINE:
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
    yield from close(0)


def normal(text: str) -> str:
    """A block's text: references decoded, white space as one space."""
    return " ".join(html.unescape(text).split())


def block_digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def block_digests(markup: str) -> set[int]:
    """Digests of the texts of a page's blocks."""
    found, current = set(), []
    for kind, name, _ in events(markup):
        if kind == "text":
            current.append(name)
        elif name == "br":
            current.append(" ")
        elif name not in INLINE and current:
            found.add(normal("".join(current)))
            current = []
    found.add(normal("".join(current)))
    return {block_digest(t) for t in found if t}


def plain(symbol: str) -> str:
    """The symbol without the digest of its literal text."""
    return symbol.partition(LITERAL)[0]


# A wrapper node is [symbol, repeated, optional, children, statistics]; the statistics of a text slot
# are [pages, code points, smallest digest, largest digest], other nodes have None.


def _node(symbol: str) -> list:
    return [symbol, False, False, [], None]


def merge(a: list, b: list) -> list:
    """The node that matches whatever ``a`` or ``b`` match (same symbol)."""
    if plain(a[0]) == TEXT:
        x, y = a[4], b[4]
        return [a[0], a[1] or b[1], a[2] or b[2], [], [x[0] + y[0], x[1] + y[1], min(x[2], y[2]), max(x[3], y[3])]]
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3]), None]


def align(x: list, y: list) -> list:
    """Children that match either sequence: common ones merged, others optional, repeats folded."""
    if [n[0] for n in x] == [n[0] for n in y]:
        return [merge(a, b) for a, b in zip(x, y)]
    out, i, j = [], 0, 0
    for k, m in [*matched([n[0] for n in x], [n[0] for n in y]), (len(x), len(y))]:
        out += [[*n[:2], True, *n[3:]] for n in (*x[i:k], *y[j:m])]
        if k < len(x):
            out.append(merge(x[k], y[m]))
        i, j = k + 1, m + 1
    return folded(out)


def matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: equal ends, then symbols that either side has once as anchors, then the parts between.

    Between anchors the longest one is taken from a table of at most ``CELLS`` cells; in longer parts
    the n-th occurrences of a symbol are matched, as many as keep their order.
    """
    out: list[tuple[int, int]] = []
    parts = [(0, len(x), 0, len(y), True)]
    while parts:
        i, k, j, m, anchors = parts.pop()
        while i < k and j < m and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and x[k - 1] == y[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if anchors:
            once = [{s: at for at, s in enumerate(z[a:b], a) if n[s] == 1} for z, a, b in ((x, i, k), (y, j, m)) for n in [Counter(z[a:b])]]
            chain = _rising([(at, once[1][s]) for s, at in once[0].items() if s in once[1]])
            if chain:
                out += chain
                ends = [(i - 1, j - 1), *chain, (k, m)]
                parts += [(a + 1, c, b + 1, d, True) for (a, b), (c, d) in zip(ends, ends[1:])]
                continue
        if (k - i) * (m - j) <= CELLS:
            out += [(i + a, j + b) for a, b in _longest(x[i:k], y[j:m])]
        else:
            numbered = []
            for z, a, b in ((x, i, k), (y, j, m)):
                seen: Counter = Counter()
                places = {}
                for at in range(a, b):
                    places[z[at], seen[z[at]]] = at
                    seen[z[at]] += 1
                numbered.append(places)
            out += _rising([(at, numbered[1][s]) for s, at in numbered[0].items() if s in numbered[1]])
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs whose second places rise; the first ones do already."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, place) in enumerate(pairs):
        at = bisect_left(ends, place)
        before[n] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(place)
            last.append(n)
        else:
            ends[at], last[at] = place, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def folded(children: list) -> list:
    """Neighbours that repeat become one repeated node; so do repeated groups of two or three, as a group node."""
    out: list = []
    for node in children:
        if out and out[-1][0] == node[0]:
            out[-1] = merge(out[-1], node)
            out[-1][1] = True
            continue
        out.append(node)
        for width in (2, 3):
            group = out[-width:]
            name = "#group " + " | ".join(n[0] for n in group)
            if len(out) > width and out[-width - 1][0] == name:
                last = out[-width - 1]
                out[-width - 1 :] = [[name, True, last[2], [merge(a, b) for a, b in zip(last[3], group)], None]]
                break
            if len(out) >= 2 * width and [n[0] for n in out[-2 * width : -width]] == [n[0] for n in group]:
                out[-2 * width :] = [[name, True, False, [merge(a, b) for a, b in zip(out[-2 * width : -width], group)], None]]
                break
    return out


def page_tree(markup: str, literals: frozenset | set = frozenset()) -> list:
    """The wrapper of one page; ``literals`` are digests of blocks that are the same on the host's pages."""
    root = _node("#page")
    stack, texts, current = [root], [], []
    # Of each open block: whether a text of its own varies, and the digests of its literal ones.
    held: list[list] = [[False, []]]

    def flush() -> None:
        text = normal("".join(current)) if current else ""
        if text:
            digest = block_digest(text)
            if digest in literals:
                held[-1][1].append(digest)
                for slot in texts:
                    slot[0] = f"{TEXT}{LITERAL}{digest}"
            else:
                held[-1][0] = True
        current.clear()
        texts.clear()

    for kind, name, symbol in events(markup):
        if kind == "text":
            current.append(name)
            if not name.isspace():
                size, digest = len(name), zlib.crc32(name.encode("utf-8", "surrogatepass"))
                slot = [TEXT, False, False, [], [1, size, digest, digest]]
                texts.append(slot)
                stack[-1][3].append(slot)
            continue
        block = name not in INLINE
        if name == "br":
            current.append(" ")
        elif block:
            flush()
        if kind == "open":
            stack.append(_node(symbol) if len(stack) < LEVELS else stack[-1])
            if block:
                held.append([False, []])
            continue
        varies, same = held.pop() if block else (True, [])
        if block:
            held[-1][0] = held[-1][0] or varies
            held[-1][1] += same
        node = stack.pop()
        if node is not stack[-1]:
            node[3] = folded(node[3])
            if same and not varies:
                node[0] += f"{LITERAL}{block_digest(str(same))}"
            stack[-1][3].append(node)
    flush()
    root[3] = folded(root[3])
    return root


def shape(node: list) -> list:
    """The node without statistics."""
    return [node[0], node[1], node[2], [shape(c) for c in node[3]]]


def slots(node: list) -> list[list]:
    """Statistics of the text slots in page order."""
    return [node[4]] if plain(node[0]) == TEXT else [s for c in node[3] for s in slots(c)]


def filled(form: list, stats: Iterator[list]) -> list:
    """The wrapper of a shape and the statistics of its slots."""
    children = [filled(c, stats) for c in form[3]]
    return [form[0], form[1], form[2], children, list(next(stats)) if plain(form[0]) == TEXT else None]


def skipped(symbol: str, inside_main: bool = False) -> bool:
    """Whether tag, role, class or id name something that is not main text."""
    tag, *names = plain(symbol).split(" ")
    if tag in SKIP_TAGS or (tag == "header" and not inside_main):
        return True
    for word in " ".join(names).split(" "):
        name, _, value = word.rpartition("=")
        if name == "role" and value in SKIP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name not in ("role", "itemprop") and any(w in SKIP_WORDS and not (inside_main and w == "header") for w in WORDS.findall(value)):
            return True
    return False


def _weights(node: list, in_link: bool = False) -> tuple[float, float, float]:
    """Code points of text, of them in links, and of them the same on all of several pages."""
    if plain(node[0]) == TEXT:
        pages, size, low, high = node[4]
        return size, size * in_link, size * (LITERAL in node[0] or pages >= SEVERAL and low == high)
    total = [0.0, 0.0, 0.0]
    for child in node[3]:
        if not skipped(child[0]):
            for i, value in enumerate(_weights(child, in_link or plain(child[0]).split(" ")[0] == "a")):
                total[i] += value
    return total[0], total[1], total[2]


def _container(symbol: str) -> bool:
    """Whether an element holds blocks rather than the text of one."""
    tag = plain(symbol).split(" ")[0]
    return tag not in INLINE and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "dt", "dd", "pre", "blockquote", TEXT)


def _is_main(symbol: str) -> bool:
    symbol = plain(symbol)
    return symbol.split(" ")[0] in MAIN_TAGS or " role=main" in symbol or " itemprop=articlebody" in symbol


def _named(node: list, found: list[tuple[int, ...]], path: tuple[int, ...] = ()) -> None:
    """Paths of elements that call themselves article or main."""
    for i, child in enumerate(node[3]):
        if skipped(child[0]):
            continue
        if _is_main(child[0]) and _weights(child)[0] > 0:
            found.append((*path, i))
        _named(child, found, (*path, i))


def marks(wrapper: list) -> list:
    """The wrapper as nested [symbol, mark, children]: mark 1 begins main text, 0 leaves things as they are, -1 ends it."""
    found: list[tuple[int, ...]] = []
    _named(wrapper, found)
    at = lambda path: _descend(wrapper, path)
    if found:
        # The innermost ones, unless what stands around them holds most of the text.
        inner = [p for p in found if not any(q != p and q[: len(p)] == p for q in found)]
        outer = [p for p in found if not any(q != p and p[: len(q)] == q for q in found)]
        held, around = (sum(_weights(at(p))[0] for p in paths) for paths in (inner, outer))
        chosen = set(inner if held >= 0.5 * around else outer)
        return _marked(wrapper, chosen, (), named=True)
    path: tuple[int, ...] = ()
    while True:
        node = at(path)
        good = [(w[0] - w[1] - w[2], i) for i, c in enumerate(node[3]) if plain(c[0]) != TEXT and not skipped(c[0]) for w in [_weights(c)]]
        total = _weights(node)
        top = max(good, default=(0, 0))
        child = node[3][top[1]] if good else None
        if child is None or not _container(child[0]) or top[0] < 0.6 * (total[0] - total[1] - total[2]) or top[0] <= 0 or child[1]:
            return _marked(wrapper, {path}, (), named=False)
        path = (*path, top[1])


def _descend(node: list, path: tuple[int, ...]) -> list:
    for i in path:
        node = node[3][i]
    return node


def _marked(node: list, chosen: set, path: tuple[int, ...], named: bool, inside: bool = False) -> list:
    mark = 0
    if path in chosen:
        mark, inside = 1, True
    elif path and skipped(node[0], inside and named):
        mark = -1
    elif inside and not named and path:
        size, links, same = _weights(node)
        if size and _container(node[0]) and (links > 0.5 * size or same == size):
            mark = -1
    return [node[0], mark, [_marked(c, chosen, (*path, i), named, inside) for i, c in enumerate(node[3]) if plain(c[0]) != TEXT]]


def compiled(marked: list) -> dict:
    """Nested look-up: symbol to (mark, look-up of the children); groups stand for their parts."""
    out: dict = {}
    for symbol, mark, children in marked[2]:
        for one in children if symbol.startswith("#group") else [[symbol, mark, children]]:
            inner, name = compiled(one), plain(one[0])
            if name in out:  # the same element elsewhere under this one
                before, known = out[name]
                out[name] = (max(before, one[1], key=lambda m: (m == 1, m == 0)), _joined(known, inner))
            else:
                out[name] = (one[1], inner)
    return out


def _joined(a: dict, b: dict) -> dict:
    out = dict(a)
    for symbol, (mark, inner) in b.items():
        if symbol in out:
            out[symbol] = (max(out[symbol][0], mark, key=lambda m: (m == 1, m == 0)), _joined(out[symbol][1], inner))
        else:
            out[symbol] = (mark, inner)
    return out


def read_through(markup: str, table: dict, whole: bool, literals: frozenset | set = frozenset()) -> str:
    """Text of the parts of a page that a compiled wrapper marks, without blocks that are its literals.

    ``whole``: the page itself is such a part.
    """
    blocks, current = [], []
    stack = [(table, whole, False)]  # look-up, inside main text, inside something skipped
    for kind, name, symbol in events(markup):
        if kind == "text":
            _, inside, off = stack[-1]
            if inside and not off:
                current.append(name)
            continue
        if kind == "open":
            here, inside, off = stack[-1]
            mark, inner = here.get(symbol, (None, {}))
            if mark == 1:
                stack.append((inner, True, off))
            else:
                off = off or mark == -1 or mark is None and skipped(symbol, inside)
                stack.append((inner, inside, off))
        else:
            stack.pop()
        if name == "br":
            current.append(" ")
        elif name not in INLINE and current:
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    texts = (normal(b) for b in blocks)
    return "\n".join(t for t in texts if t and not (literals and block_digest(t) in literals))


def main_text(markup: str, table: dict | None, whole: bool, literals: frozenset | set = frozenset()) -> str:
    if not markup or markup.isspace():
        return ""
    text = read_through(markup, table, whole, literals) if table is not None else ""
    if text:
        return text
    own = marks(page_tree(markup))
    return read_through(markup, compiled(own), own[1] == 1)


def host_of(url):
    """Lower-cased host of an address (empty if there is none)."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def literals(pages: DataFrame) -> DataFrame:
    """``host`` and ``literals``: digests of the blocks that stand on ``SHARE`` of its pages, if these are ``SEVERAL``.

    Pages are counted per host and block, added up in the task first; a host has at most
    ``1 / SHARE`` times as many literals as its pages have blocks on average.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def packed() -> pa.RecordBatch:
            columns = [[h for h, _ in held], [b for _, b in held], list(held.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()])], ["host", "block", "n"])

        for batch in batches:
            for host, markup in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[host, None] += 1
                held.update((host, b) for b in block_digests(markup.as_py() or ""))
                if len(held) > COUNTS:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    counts = pages.select("host", "markup").mapInArrow(count, "host string, block long, n long")
    found = staged(counts.groupBy("host", "block").agg(F.sum("n").alias("n")).where(F.col("block").isNull() | (F.col("n") >= SHARE * SEVERAL)), "blocks")
    sizes = found.where(F.col("block").isNull() & (F.col("n") >= SEVERAL)).select("host", F.col("n").alias("pages"))
    common = found.where("block is not null").join(sizes, "host").where(F.col("n") >= SHARE * F.col("pages"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("block")).alias("literals"))


_SLOTS = pa.list_(pa.list_(pa.int64()))


def _shapes(pages: DataFrame) -> DataFrame:
    """``host``, ``shape`` and the statistics of its text slots, added up in the task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[list]] = {}

        def packed() -> pa.RecordBatch:
            columns = [[h for h, _ in held], [s for _, s in held], list(held.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), _SLOTS])], ["host", "wrapper", "slots"])

        for batch in batches:
            for host, markup, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                tree = page_tree(markup.as_py() or "", frozenset(known.as_py() or ()))
                key, stats = (host, json.dumps(shape(tree), separators=(",", ":"))), slots(tree)
                known_stats = held.get(key)
                if known_stats is None:
                    held[key] = stats
                else:
                    for a, b in zip(known_stats, stats):
                        a[:] = [a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])]
            if len(held) > SHAPES:
                yield packed()
                held = {}
        if held:
            yield packed()

    return pages.select("host", "markup", "literals").mapInArrow(learn, "host string, wrapper string, slots array<array<bigint>>")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of all in a group, in an order that does not depend on how they arrive."""
    pairs = sorted((text, [list(map(int, s)) for s in stats]) for text, stats in zip(rows["wrapper"], rows["slots"]))
    wrapper = None
    for text, stats in pairs:
        node = filled(json.loads(text), iter(stats))
        wrapper = node if wrapper is None else merge(wrapper, node)
    text = json.dumps(shape(wrapper), separators=(",", ":"))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [text], "slots": [slots(wrapper)]})


def wrappers(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``host`` and ``marks``: the marked wrapper and its literals as JSON, from all pages (``host``, ``markup``)."""
    found = staged(_shapes(pages.join(known, "host", "left")), "shapes")
    schema = found.schema
    most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        groups = math.ceil(most / FAN)
        spread = found.withColumn("group", F.pmod(F.xxhash64("wrapper", "slots"), F.lit(groups)))
        merged = spread.groupBy("host", "group").applyInPandas(lambda rows: _merged(rows[["host", "wrapper", "slots"]]), schema)
        # A level is written before the next one merges it: its results are read, not made again.
        found, most = staged(merged, "wrappers"), groups
    one = found.groupBy("host").applyInPandas(_merged, schema).join(known, "host", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, stats, known in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                wrapper = filled(json.loads(text), iter(stats))
                named: list = []
                _named(wrapper, named)
                out.append(json.dumps([marks(wrapper), [] if named else known or []], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "marks"])

    return one.select("host", "wrapper", "slots", "literals").mapInArrow(finish, "host string, marks string")


def _extract(markup: pa.Array, marked: pa.Array) -> pa.Array:
    tables: dict[str, tuple[dict, bool, frozenset]] = {}
    out = []
    for page, text in zip(markup, marked):
        text = text.as_py()
        if text is not None and text not in tables:
            form, known = json.loads(text)
            tables[text] = (compiled(form), form[1] == 1, frozenset(known))
        out.append(main_text(page.as_py() or "", *(tables[text] if text is not None else (None, False))))
    return pa.array(out, pa.string())


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", aligned: bool = True) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every row.

    The wrappers, one row a host, are written first: their size is then known, and the join ships
    them to the pages only if they are small; else both sides are shuffled and hot hosts split.
    ``aligned=False`` reads every page through a wrapper of its own, to see what the host's tell.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(markup).alias("markup"), host_of(F.col(url)).alias("host"))
    if aligned:
        known = staged(literals(rows), "literals")
        marked = staged(wrappers(rows, known), "wrappers")
        rows = rows.join(marked, "host", "left")
    else:
        rows = rows.withColumn("marks", F.lit(None).cast("string"))
    _extract.__annotations__ = {"markup": pa.Array, "marked": pa.Array, "return": pa.Array}
    text = F.arrow_udf(_extract, "string")("markup", "marks")
    found = rows.select(F.col("k").alias(key), F.col("u").alias(url), text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
