"""HTML main-text extraction by wrapper inference.

Pages are token streams of elements and texts.  A union-free regular
expression over them is a tree whose children are in order and are plain,
optional or repeated, repeated groups of several labels included, with slots
for text.  A host's wrapper is inferred from all of its pages: their different
expressions are aligned one after the other, in an order of their own, and
mismatches become optional children, stretches that come again repeated
groups.  A text slot is variable if its text differs from page to page, and
constant if nearly all pages have the same text there: then it is part of the
template.  What a slot holds is counted over all pages, so neither the order
nor the partitions of pages matter.

The main region is an article or main element of the wrapper, or else the
element that holds most of the variable text outside of menus, forms and the
like.  A page's main text is the region's, without its constant slots.  Names
of classes are looked at last, for what tags and slots can't tell from an
article: adverts, comments, share buttons.  Elements with such a name go if
the rest of the wrapper has a quarter of their variable text or more; an
element that holds nearly all of it is the article, whatever its name.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise, released
from .urls import host_of

#: Elements without content, whose content is no text, that end a block, and that are no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp svg math object canvas audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
OUTSIDE = frozenset("head nav footer aside form menu dialog input fieldset".split())
#: Elements that are no text of their own, but may stand in a sentence.
CONTROLS = frozenset("button label".split())
SENTENCES = frozenset("p li td th dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of parts that are no main text, and names that only say what kind of element it is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " cookie cookies consent notice notices popup modal overlay newsletter subscribe share sharing social related recommended comment comments"
    " commentlist replies reply respond disqus footer masthead topbar toolbar pagination pager widget widgets".split()
)
KINDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content cta first footer form group header holder icon icons inner item"
    " items last left link links list main media module outer page panel post posts primary right row secondary section site slot small thread title"
    " top unit wrap wrapper x".split()
)


def marked(names: str) -> bool:
    """Whether a class, id or role says that an element is no main text.

    One of its names must be made of marks and kinds alone, with a mark, and
    all others of kinds or marks: "ad-slot" and "share buttons" are, while
    "related-work", "social history" or "share price" name a subject.
    """
    found = False
    for name in names.split():
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+", name)]
        if not all(x in MARKS or x in KINDS for x in parts):
            return False
        found = found or any(x in MARKS for x in parts)
    return found


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
#: An element that opens closes these, if one is open within the nearest block that may hold it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = ("ul", "ol", "dl", "table", "tbody", "thead", "select")


class Element:
    __slots__ = ("children", "label", "outside", "path", "tag")

    def __init__(self, tag: str, label: str, outside: bool, path: int) -> None:
        self.tag, self.label, self.outside, self.path, self.children = tag, label, outside, path, []


_PATHS: dict[tuple[int, str], int] = {}


def below(path: int, label: str) -> int:
    """The number of the path of labels that continues ``path`` by ``label``."""
    got = _PATHS.get((path, label))
    if got is None:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        got = _PATHS[path, label] = xxhash.xxh3_64_intdigest(f"{path}/{label}") - (1 << 63)
    return got


_DIGITS = re.compile("[0-9]+")


def tree(page: str) -> Element:
    """A tolerant parse: children are elements and texts, which are still escaped.

    Labels of elements whose names say that they are no main text begin with "!".
    """
    root = Element("", "", False, 0)
    stack, at = [root], 0
    #: Where in the stack the open elements of a tag are, and the open blocks.
    places: dict[str, list[int]] = {}
    blocks = [0]

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(piece)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(html.escape(m[1], False))
        name = m[3] or m[6]
        if not name:
            continue
        tag, rest = name.lower(), m[4] or m[7] or ""
        if m[2] or m[5]:
            k = last(tag)
            if k and (tag in BLOCK or blocks[-1] < k):  # an inline end tag doesn't close blocks
                close(k)
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in BLOCK and last("p") and blocks[-1] == last("p"):
            close(last("p"))
        for old in _CLOSES.get(tag, ()):
            if last(old) > max(map(last, _HOLDS)):
                close(last(old))
        marks = {a.lower(): (x or y or z) for a, x, y, z in _ATTRIBUTE.findall(rest)} if rest else {}
        inside = last("article") or last("main")
        outside = tag in OUTSIDE or (tag == "header" and not inside) or (tag in CONTROLS and stack[blocks[-1]].tag not in SENTENCES)
        label = f"{tag}.{_DIGITS.sub('#', marks['class'].split()[0])}" if marks.get("class", "").split() else tag
        if marks and tag not in ("html", "body", "article", "main") and any(marked(v) for v in marks.values() if v):
            label = f"!{label}"
        own = Element(tag, label, outside, below(stack[-1].path, label))
        stack[-1].children.append(own)
        if tag not in VOID and not rest.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(own)
    return root


# A node of an expression is [label, flags, children]; flags: 1 optional, 2 repeated.  A group of several labels has the label "".
# Pages may nest to any depth, so nothing here recurses but over the depth of groups and of alignment, by a stack of generators.


def skeleton(element: Element) -> list:
    """The expression of an element: its elements but those outside of the main text, stretches that come again folded."""
    order = [element]
    for e in order:
        order.extend(c for c in e.children if not isinstance(c, str) and c.tag not in VOID and not c.outside)
    made: dict[int, list] = {}
    for e in reversed(order):
        children = [made.pop(id(c)) for c in e.children if not isinstance(c, str) and c.tag not in VOID and not c.outside]
        made[id(e)] = [e.label, 0, folded(children)]
    return made[id(element)]


def _run(steps) -> list:
    """What a generator returns that yields the pairs it needs aligned."""
    stack, value = [steps], None
    while stack:
        try:
            pair = stack[-1].send(value)
            stack.append(_aligned(*pair))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def _names(node: list) -> tuple:
    """What a node must share with another to be aligned with it: its label, for a group the labels of its children."""
    return (node[0],) if node[0] else ("", *(c[0] for c in node[2]))


def folded(children: list[list]) -> list[list]:
    return _run(_folded(children)) if len(children) > 1 else children


def _tandem(names: list[tuple], start: int) -> int:
    """The least period from ``start`` on with which a stretch comes again at once; 0 for none."""
    kinds: dict[tuple, int] = {}
    a = np.array([kinds.setdefault(n, len(kinds)) for n in names], np.int32)
    for period in range(start, len(a) // 2 + 1):
        breaks = np.flatnonzero(a[:-period] != a[period:])
        if np.diff(breaks, prepend=-1, append=len(a) - period).max() > period:
            return period
    return 0


def _folded(children: list[list]):
    """Neighbours of one label become one repeated child, then stretches of labels that come again repeated groups, short ones first."""
    out: list[list] = []
    for c in children:
        if out and _names(out[-1]) == _names(c):
            out[-1] = yield out[-1], c
            out[-1][1] |= 2
        else:
            out.append(c)
    # groups are of plain labels: a group already made is like no other child
    plain = lambda: [n if len(n) == 1 else (k,) for k, n in enumerate(map(_names, out))]
    period = _tandem(plain(), 2)
    while period:
        names, made, k = plain(), [], 0
        while k < len(out):
            same = names[k : k + period]
            if len(same) == period and names[k + period : k + 2 * period] == same:
                group = ["", 2, out[k : k + period]]
                k += period
                while names[k : k + period] == same:
                    group = yield group, ["", 2, out[k : k + period]]
                    k += period
                made.append(group)
            else:
                made.append(out[k])
                k += 1
        out = made
        period = _tandem(plain(), period + 1)
    return out


def aligned(a: list, b: list) -> list:
    """The expression that covers two of one label: children that match in order stay, others become optional."""
    return _run(_aligned(a, b))


def _aligned(a: list, b: list):
    x, y = a[2], b[2]
    names, others = [_names(c) for c in x], [_names(c) for c in y]
    children: list[list] = []
    i = j = 0
    for k, m in [*common(names, others), (len(x), len(y))]:
        children += [[c[0], c[1] | 1, c[2]] for c in (*x[i:k], *y[j:m])]
        if k < len(x):
            children.append((yield x[k], y[m]))
        i, j = k + 1, m + 1
    if names != others:
        children = yield from _folded(children)
    return [a[0], a[1] | b[1], children]


def _lengths(p: list, q: list) -> np.ndarray:
    """Lengths of the longest common subsequences of p and each beginning of q.

    A row of the table is a whole number with a bit for each place of q, so a
    step is a few operations on it: n * m / 64 word operations and m bits.
    """
    places: dict = {}
    for k, c in enumerate(q):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(q)) - 1
    row = full
    for c in p:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(p: list, q: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory linear in the lengths (Hirschberg's division)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        low, high, left, right = todo.pop()
        back: list[tuple[int, int]] = []
        while low < high and left < right and p[low] == q[left]:
            out.append((low, left))
            low, left = low + 1, left + 1
        while low < high and left < right and p[high - 1] == q[right - 1]:
            high, right = high - 1, right - 1
            back.append((high, right))
        if low == high or left == right:
            pass
        elif high - low == 1:
            at = next((k for k in range(left, right) if q[k] == p[low]), None)
            if at is not None:
                out.append((low, at))
        else:
            mid = (low + high) // 2
            begins = _lengths(p[low:mid], q[left:right])
            ends = _lengths(p[mid:high][::-1], q[left:right][::-1])[::-1]
            cut = left + int((begins + ends).argmax())
            todo.append((mid, high, cut, right))
            todo.append((low, mid, left, cut))
        out += back
    return sorted(out)


def packed(node: list) -> str:
    """JSON of an expression: the nodes in order, each with the number of its children instead of them."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append([*n[:2], len(n[2])])
        todo.extend(reversed(n[2]))
    return json.dumps(out)


def unpacked(text: str) -> list:
    nodes: list[list] = []
    for label, flags, n in reversed(json.loads(text)):
        children = [nodes.pop() for _ in range(n)]
        nodes.append([label, flags, children])
    return nodes[0]


def region(wrapper: list, chars: dict[int, int]) -> tuple[list[str], set[int]]:
    """Labels from the root down to the main region of a wrapper, and the paths of elements that stay in spite of their names.

    ``chars`` are the variable characters of each path's slot.
    """
    order: list[tuple[list, int, int]] = []
    todo = [(wrapper, -1, 0)]
    while todo:
        node, parent, path = todo.pop()
        todo.extend((c, len(order), below(path, c[0]) if c[0] else path) for c in reversed(node[2]))
        order.append((node, parent, path))
    own = [chars.get(path, 0) if node[0] or parent < 0 else 0 for node, parent, path in order]
    excused: set[int] = set()
    while True:
        inside = [0] * len(order)  # the outermost element with a name that hasn't been excused
        held: dict[int, int] = {}
        for k, (node, parent, path) in enumerate(order):
            inside[k] = (inside[parent] if parent >= 0 else 0) or (k if node[0].startswith("!") and path not in excused else 0)
            held[inside[k]] = held.get(inside[k], 0) + own[k]
        masses = [0 if k else n for k, n in zip(inside, own, strict=True)]
        for k in range(len(order) - 1, 0, -1):
            masses[order[k][1]] += masses[k]
        mains = [k for k, (node, _, _) in enumerate(order) if not inside[k] and node[0].split(".")[0] in ("article", "main")]
        rest = held.pop(0)
        largest = max(held, key=lambda k: (held[k], -k), default=0)
        if not largest or held[largest] <= 4 * rest or any(masses[k] for k in mains):
            break
        excused.add(order[largest][2])
    best = max(mains, key=lambda k: (masses[k], -k), default=0)
    labels: list[str] = []
    while best:
        if order[best][0][0]:
            labels.append(order[best][0][0])
        best = order[best][1]
    if labels:
        return labels[::-1], excused
    mass = {id(node): m for (node, _, _), m in zip(order, masses, strict=True)}
    node = wrapper
    while True:
        inner = max(node[2], key=lambda c: mass[id(c)], default=None)
        if inner is None or inner[1] & 2 or not mass[id(inner)] or mass[id(inner)] < 0.6 * mass[id(node)] or inner[0].removeprefix("!").split(".")[0] not in BLOCK - SENTENCES:
            return labels, excused
        node = inner
        labels.append(inner[0])


def located(root: Element, labels: list[str]) -> list[Element]:
    """The elements of a page at a path of labels, in page order."""
    found = [root]
    for label in labels:
        found = [c for e in found for c in e.children if not isinstance(c, str) and c.label == label and not c.outside]
    return found


def blocks(elements: list[Element], excused: Container[int] | None = None) -> list[tuple[int, str, str]]:
    """Path, tag and text of the blocks of elements, in page order; a block is of the nearest block element.

    Elements with the name of no main text are left out unless their path is excused; without ``excused`` all are there.
    """
    out: list[tuple[int, str, str]] = []
    open_: list[str] = []
    owners: list[Element] = []

    def out_of(e: Element) -> bool:
        return e.outside or (excused is not None and e.label[0] == "!" and e.path not in excused)

    def end() -> None:
        text = " ".join(html.unescape("".join(open_)).split())
        if text:
            out.append((owners[-1].path, owners[-1].tag, text))
        open_.clear()

    for top in elements:
        owners.append(top)
        todo: list = [None, *reversed(top.children)]  # None ends the innermost block
        while todo:
            e = todo.pop()
            if e is None:
                end()
                owners.pop()
            elif isinstance(e, str):
                open_.append(e)
            elif e.tag in BLOCK:
                end()
                if not out_of(e):
                    owners.append(e)
                    todo.append(None)
                    todo.extend(reversed(e.children))
            elif not out_of(e):
                if e.tag == "br":
                    open_.append(" ")
                todo.extend(reversed(e.children))
    return out


def slots(found: list[tuple[int, str, str]]) -> dict[int, tuple[int, int]]:
    """What the slot of each path holds on a page: a hash of its texts in order, and their characters."""
    texts: dict[int, list[str]] = {}
    for path, _, text in found:
        texts.setdefault(path, []).append(text)
    return {p: (xxhash.xxh3_64_intdigest("\n".join(t).encode("utf-8", "surrogatepass")) - (1 << 63), sum(map(len, t))) for p, t in texts.items()}


def main_text(page: str, labels: list[str], constant: dict[int, int] | None = None, excused: Container[int] = frozenset()) -> str:
    """The text at a path of labels without constant slots; if the page has nothing there, that of its own main region.

    A slot is dropped if it holds what ``constant`` says.  Headings stay, and
    slots that hold half of the text or more: then the pages are copies of an
    article, not of a template.
    """
    root = tree(page)
    found = blocks(located(root, labels), excused) if labels else []
    if not found:
        own = slots(blocks([root]))
        labels, excused = region(skeleton(root), {p: n for p, (h, n) in own.items() if (constant or {}).get(p) != h})
        found = blocks(located(root, labels), excused)
    if constant:
        held = slots(found)
        same = {p for p, (h, _) in held.items() if constant.get(p) == h}
        kept = [b for b in found if b[0] not in same or b[1] in HEADINGS]
        if 2 * sum(len(b[2]) for b in kept) > sum(len(b[2]) for b in found):
            found = kept
    return "\n".join(b[2] for b in found)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's pages: the different expressions of each host, and what the slots hold, with numbers of pages."""
    for batch in batches:
        shapes: dict[tuple, int] = {}
        held: dict[tuple, list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            root = tree(page.as_py() or "")
            shape = (host, packed(skeleton(root)))
            shapes[shape] = shapes.get(shape, 0) + 1
            for path, (content, chars) in slots(blocks([root])).items():
                n = held.setdefault((host, path, content), [0, 0])
                n[0] += 1
                n[1] += chars
        rows = [(h, shape, None, None, n, 0) for (h, shape), n in shapes.items()] + [(h, None, p, c, n, m) for (h, p, c), (n, m) in held.items()]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["host", "shape", "path", "content", "pages", "chars"])


def _merged(group: pa.Table) -> pa.Table:
    total = None
    for text in sorted(group.column("wrapper").to_pylist()):
        total = aligned(total, unpacked(text)) if total else unpacked(text)
    return pa.table({"host": [group.column("host")[0].as_py()], "wrapper": [packed(total)]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", support: int = 5, agreement: float = 0.95, fan: int = 64) -> DataFrame:
    """``host``, ``wrapper`` (JSON of the expression) and ``slots``, an array of (path, chars, constant), from all pages.

    A slot is constant if at least ``support`` pages of the host have it and
    ``agreement`` of them hold the same there; ``constant`` is then a hash of
    that, else null.  A host's different expressions meet in a tree: groups of
    about ``fan`` by their hash, then groups of what these became.
    """
    rows = pages.select(host_of(F.coalesce(F.col(url_col), F.lit(""))).alias("host"), F.col(html_col).alias("html"))
    seen = materialise(rows.mapInArrow(released(_seen), "host string, shape string, path long, content long, pages long, chars long"), "seen")
    whole = materialise(seen.filter("shape is not null").select("host", F.col("shape").alias("wrapper")).distinct(), "shapes")
    most = whole.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        sizes = whole.groupBy("host").agg(F.ceil(F.count("*") / fan).cast("int").alias("groups"))
        dealt = whole.join(sizes, "host").withColumn("group", F.pmod(F.xxhash64("wrapper"), F.col("groups")))
        merged = materialise(dealt.groupBy("host", "group").applyInArrow(_merged, "host string, wrapper string"), "shapes")
        discard(whole)
        whole, most = merged, merged.groupBy("host").count().agg(F.max("count")).first()[0]
    held = seen.filter("path is not null").groupBy("host", "path", "content").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    slot = held.groupBy("host", "path").agg(F.sum("pages").alias("n"), F.sum("chars").alias("chars"), F.max(F.struct("pages", "content")).alias("top"))
    steady = (F.col("n") >= support) & (F.col("top.pages") >= agreement * F.col("n"))
    slot = slot.select("host", F.struct("path", "chars", F.when(steady, F.col("top.content")).alias("constant")).alias("slot"))
    return whole.join(slot.groupBy("host").agg(F.collect_list("slot").alias("slots")), "host", "left")


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path to each wrapper's main region, its constant slots, and what stays in spite of its name."""
    for batch in batches:
        labels, constant, excused = [], [], []
        for wrapper, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            path, stays = region(unpacked(wrapper), {s["path"]: s["chars"] for s in held or [] if s["constant"] is None})
            labels.append(" ".join(path))
            excused.append(sorted(stays))
            constant.append([(s["path"], s["constant"]) for s in held or [] if s["constant"] is not None])
        columns = [batch.column(0), pa.array(labels, pa.string()), pa.array(constant, pa.map_(pa.int64(), pa.int64())), pa.array(excused, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "labels", "constant", "excused"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(page.as_py() or "", labels.split(" ") if labels else [], dict(constant or []), frozenset(excused or ()))
            for page, labels, constant, excused in zip(batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = 5, agreement: float = 0.95) -> DataFrame:
    """``id_col``, ``url``, ``text``, ``n_chars`` of every page.

    Null and empty pages give an empty text; very long ones and such of any
    depth are read whole.  Pages without a host (a null URL, or one without
    ://) share a wrapper.  A row in gives a row out, repeated ones too, and
    each counts for the wrapper; of two regions with as many characters the
    first in the wrapper is taken.  Other columns are not read.  No rows give
    no rows.  The table of regions has a row for each host; Spark joins it by
    broadcast under its threshold and by sorted merge beyond.
    """
    regions = wrappers(pages, url_col, html_col, support, agreement).select("host", "wrapper", "slots")
    regions = materialise(regions.mapInArrow(released(_regions), "host string, labels string, constant map<long,long>, excused array<long>"), "regions")
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.coalesce(F.col("url"), F.lit(""))))
    joined = rows.join(regions, "host", "left").select("id", "url", "html", "labels", "constant", "excused")
    return joined.mapInArrow(released(_extracted), f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
