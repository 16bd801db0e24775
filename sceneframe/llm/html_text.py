"""Main text of web pages: flat text blocks judged by a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import in_pieces, record, text_bytes

# Elements whose content is never text of the page.
_RAW = frozenset(["script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "select", "button", "audio", "video"])
# Those whose content is text to the browser: without an end tag they run to the end of the page.
_TO_END = frozenset(["script", "style", "textarea", "title"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
_INLINE = frozenset(
    ["a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
     "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rp", "picture", "nobr"])
_MAIN = frozenset(["article", "main"])
_SIDE = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "fieldset"])
# Boilerplate whatever it holds; the other kinds may be wrapped around a whole page.
_ALWAYS = frozenset(["nav", "footer", "aside", "menu", "dialog"])
_TALK = re.compile(r"(?:^|[\s_\-])(?:comment|comments|reply|replies|disqus|related|recommended)(?:$|[\s_\-])", re.I)
# Names that say what a wrapper has beside its text; and a heading inside of an article.
_BESIDE = re.compile(r"(?:^|(?<=[\s_\-]))(?:has|with|no|without)[_\-][^\s]*", re.I)
_HEADER = re.compile(r"(?:^|(?<=[\s_\-]))header(?=$|[\s_\-])", re.I)
_HINT = re.compile(
    r"(?:^|[\s_\-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notification|alert"
    r"|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|sidebar|side|widget|footer|header|masthead|comment|comments|reply|replies|disqus|discussion|related|recommended"
    r"|share|sharing|social|newsletter|subscribe|subscription|signup|popup|modal|overlay|login|search|pagination|pager|legal|copyright)(?:$|[\s_\-])", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"])
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^<>]*\Z", re.S)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    side: bool
    heading: bool
    item: bool


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; broken mark-up is read as far as it makes sense."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    # Open elements: name, starts main text, starts boilerplate, and its number if that may be a wrapper.
    stack: list[tuple[str, bool, bool, int]] = []
    under: list[tuple[int, ...]] = []  # of each block: the wrappers around it, if nothing else makes it boilerplate
    wrappers = 0

    def main_at() -> int:
        """Where the outermost article or main element is open that boilerplate around it does not reach."""
        for i, (name, main, _, _) in enumerate(stack):
            if main and (name == "main" or not any(s[2] and not s[3] for s in stack[:i])):
                return i
        return 0

    def end_block(heading: bool = False, item: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            names = [s[0] for s in stack]
            around = stack[main_at() :]
            under.append(() if any(s[2] and not s[3] for s in around) else tuple(s[3] for s in around if s[2]))
            out.append(Block(
                text, n, min(linked, n), any(s[1] for s in stack), any(s[2] for s in around),
                bool(names) and len(names[-1]) == 2 and names[-1][0] == "h" and names[-1][1].isdigit(), bool(names) and names[-1] in ("li", "dt", "dd", "td", "th"),
            ))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.split())

    ends: dict[str, dict[int, int]] = {}

    def end_of(name: str, start: int) -> int | None:
        """Where the element that opens at ``start`` ends; an end tag belongs to the last one open."""
        if name not in ends:
            of, opened = ends.setdefault(name, {}), []
            for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).finditer(page, start):
                if not tag[1]:
                    if not tag[0].endswith("/>"):
                        opened.append(tag.start())
                elif opened:
                    of[opened.pop()] = tag.end()
        return ends[name].get(start)

    at = 0
    while True:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                add(html.escape(found[0][9:-3]))
            continue
        closing, rest = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in _RAW and not closing:
            if not rest.endswith("/"):
                if name in _TO_END:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                    at = stop.end() if stop else len(page)
                else:
                    # Without an end tag of its own it hides nothing: the page goes on after it.
                    at = max(at, end_of(name, found.start()) or at)
            if name not in ("button", "svg", "math"):
                continue
            parts.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if name in _VOID:
            if name == "hr":
                end_block()
            elif name == "br":
                parts.append(" ")
            continue
        end_block()
        if name == "head":
            if not closing:
                stop = re.compile(r"</head\b[^>]*>?|<body\b", re.I).search(page, at)
                if stop:
                    at = stop.start() if stop[0].lower().startswith("<body") else stop.end()
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            in_link = 0
            continue
        # A paragraph ends where the next block begins.
        while stack and (stack[-1][0] == "p" or name == "li" == stack[-1][0]):
            stack.pop()
        values = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if rest else ""
        inside = any(s[1] for s in stack)
        hints = _BESIDE.sub("", values)
        if inside:
            hints = _HEADER.sub("", hints)
        if name in _MAIN:
            side, always = name == "article" and bool(_TALK.search(hints)), True
        else:
            role = not _ROLES.isdisjoint(values.lower().split())
            side = name in _SIDE or name == "header" and not inside or name not in ("html", "body") and (bool(_HINT.search(hints)) or role)
            always = name in _ALWAYS or name == "header" or bool(_TALK.search(hints))
        if side and not always:
            wrappers += 1
        stack.append((name, name in _MAIN, side, wrappers if side and not always else 0))
    end_block()
    # A form or a marked wrapper with more than half of the words that are no links holds the page's text.
    words = [b.words - b.linked for b in out]
    held: dict[int, int] = {}
    for n, of in zip(words, under):
        for w in of:
            held[w] = held.get(w, 0) + n
    whole = sum(words)
    for block, of in zip(out, under):
        if of and all(2 * held[w] > whole for w in of):
            block.side = False
    return out


#: What a block looks like to the tree.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_main", "page_has_main", "in_side", "heading", "item")

# Labelled blocks: the features in the order above, then 1 for main text and 0 for the rest.
# Written for this module by looking at what pages of many kinds hold.
LABELLED = np.array([
    # Inside an article or main element: text of any length, headings, lists.
    (9, 0.0, 8, 0.0, 40, 0.0, 1, 1, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 60, 0.1, 1, 1, 0, 1, 0, 1), (1, 0.0, 30, 0.0, 90, 0.0, 1, 1, 0, 0, 0, 1),
    (2, 0.0, 120, 0.0, 3, 0.0, 1, 1, 0, 0, 0, 1), (35, 0.0, 9, 0.0, 50, 0.0, 1, 1, 0, 0, 0, 1), (80, 0.1, 60, 0.0, 12, 0.0, 1, 1, 0, 0, 0, 1),
    (12, 0.3, 40, 0.0, 20, 0.0, 1, 1, 0, 0, 1, 1), (6, 0.0, 12, 0.0, 7, 0.0, 1, 1, 0, 0, 1, 1), (250, 0.0, 1, 0.0, 1, 1.0, 1, 1, 0, 0, 0, 1),
    (20, 0.0, 30, 0.0, 8, 0.4, 1, 1, 0, 0, 0, 1), (7, 0.4, 50, 0.0, 50, 0.0, 1, 1, 0, 0, 0, 1), (3, 0.0, 2, 1.0, 2, 1.0, 1, 1, 0, 0, 0, 1),
    (5, 1.0, 60, 0.0, 45, 0.0, 1, 1, 0, 0, 0, 1), (8, 1.0, 30, 0.0, 30, 0.0, 1, 1, 0, 1, 0, 1), (2, 1.0, 40, 0.0, 80, 0.1, 1, 1, 0, 0, 1, 1),
    # Inside it but marked as menu, advert, comments, form, notice.
    (25, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1, 0, 0, 0), (40, 0.0, 20, 0.0, 35, 0.0, 1, 1, 1, 0, 1, 0), (3, 1.0, 80, 0.0, 3, 1.0, 1, 1, 1, 0, 1, 0),
    (2, 0.0, 90, 0.0, 30, 0.0, 1, 1, 1, 1, 0, 0), (90, 0.0, 40, 0.0, 40, 0.0, 1, 1, 1, 0, 0, 0),
    # Outside of it on a page that has one.
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0, 0), (12, 0.0, 80, 0.0, 0, 0.0, 0, 1, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 1, 0),
    (40, 0.0, 70, 0.0, 10, 0.0, 0, 1, 0, 0, 0, 0), (6, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0, 0), (120, 0.0, 10, 0.0, 5, 0.0, 0, 1, 0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 60, 0.0, 0, 1, 0, 1, 0, 0), (15, 0.2, 30, 0.0, 2, 1.0, 0, 1, 0, 0, 1, 0), (2, 1.0, 3, 0.5, 4, 1.0, 0, 1, 0, 0, 0, 0),
    # Pages without such an element: length, links and neighbours decide.
    (60, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1), (30, 0.1, 70, 0.0, 20, 0.0, 0, 0, 0, 0, 0, 1), (18, 0.0, 40, 0.0, 35, 0.1, 0, 0, 0, 0, 0, 1),
    (140, 0.2, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 1), (25, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1, 0, 1), (4, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 1), (10, 0.0, 1, 1.0, 25, 0.0, 0, 0, 0, 1, 0, 1),
    (3, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1), (8, 0.0, 30, 0.1, 28, 0.0, 0, 0, 0, 0, 1, 1), (5, 0.2, 60, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 1),
    (14, 0.0, 20, 0.0, 18, 0.0, 0, 0, 0, 0, 1, 1), (22, 0.3, 16, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (9, 0.0, 22, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (4, 1.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 1, 0),
    (6, 0.8, 5, 0.9, 5, 1.0, 0, 0, 0, 0, 0, 0), (20, 0.9, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (45, 0.8, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 0.5, 3, 0.0, 0, 0, 0, 0, 1, 0), (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1, 0, 0), (6, 0.3, 4, 0.5, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (30, 0.0, 20, 0.0, 30, 0.0, 0, 0, 1, 0, 0, 0), (8, 0.0, 40, 0.0, 2, 0.0, 0, 0, 1, 0, 0, 0), (90, 0.1, 60, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0),
    (4, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1, 0, 0), (1, 1.0, 70, 0.0, 2, 1.0, 0, 0, 1, 0, 1, 0),
], float)

# The same two judgements between neighbours of every kind: text of any length inside the
# main element is main text unless it is marked otherwise, text outside of it is not.
_NEIGHBOURS = [(0, 0.0), (2, 1.0), (9, 0.0), (60, 0.0)]
LABELLED = np.vstack([LABELLED, np.array([
    (n, 0.0, *before, *after, inside, 1, 0, 0, 0, inside)
    for inside, lengths in ((1, (1, 3, 6, 14, 70)), (0, (1, 4, 8, 16, 50)))
    for n in lengths for before in _NEIGHBOURS for after in _NEIGHBOURS
] + [
    # Menus, adverts, comments, forms and notices, wherever they stand.
    (n, 0.0, *before, *after, inside, has_main, 1, 0, 0, 0)
    for inside, has_main in ((0, 0), (0, 1), (1, 1)) for n in (2, 12, 30, 90) for before in _NEIGHBOURS for after in _NEIGHBOURS
], float)])


def grow_tree(rows: np.ndarray, least: int = 1):
    """A decision tree by Gini impurity: (feature, threshold, low branch, high branch) or a label."""
    y = rows[:, -1]
    if len(rows) <= least or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            p, q = y[low].mean(), y[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut), low
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, grow_tree(rows[low], least), grow_tree(rows[~low], least)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    has_main = any(b.main for b in found)
    size = [(b.words, b.linked / b.words) for b in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    return [
        (*size[i], *around[i], *around[i + 2], b.main, has_main, b.side, b.heading, b.item)
        for i, b in enumerate(found)
    ]


def main_text(page: str, tree) -> str:
    found = blocks(page)
    kept = []
    for block, x in zip(found, features(found)):
        node = tree
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append(block.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: np.ndarray = LABELLED) -> DataFrame:
    """One row per page: its id, ``url``, ``text``, ``n_chars``.

    The whole html is cut into flat blocks; the tree grown on ``labelled`` sees each block's
    words and link density, those of its neighbours, and the kind of element around it.
    Kept blocks are joined by one newline in page order. Null html is empty and gives an
    empty text; null and repeated ids give one row each; broken or cut mark-up never fails;
    other columns are ignored; an empty table gives an empty result.
    """
    tree = grow_tree(labelled)
    fields = [("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_pieces(whole, 2):
                texts = [main_text(raw.decode("utf-8", "replace"), tree) for raw in batch.column(2).to_pylist()]
                yield record(fields, [batch.column(0), batch.column(1), texts, [len(t) for t in texts]])

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(F.col(html_col)).alias("html"))
    return rows.mapInArrow(extract, "id bigint, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
