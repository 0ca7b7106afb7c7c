"""Main text of pages by wrapper induction.

Every page is parsed into a tree of elements. Pages of a host with the same layout (the set of paths of their sectioning
elements) are aligned with one of them, their reference, by simple tree matching: nodes meet if a heaviest order-keeping,
top-down match of equal labels pairs them with the same reference node. Across layouts, and where a node has no partner,
nodes meet by the labels from the top down. All pages of a host bear witness: per place it is counted how many different
pages have it and in how many a text stands there. A text that stands in nearly all of them is the host's template and
goes; slots that vary are content and stay. Of the rest, elements whose role is known (menu, header, footer, sidebar,
notice, advert, form, comments) go as well, and an article or main element bounds the text where a page has one. Inside
those the same counts decide, over different articles and only where template is at most half of their text: an article
that a host repeats is not lost.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import is_small, join_unique, materialize, shuffle_parts, small

#: Pages with a path from which on its texts are judged, and the share of them in which a text of the template stands.
LEAST_PAGES, CONSTANT_SHARE = 3, 0.8
#: Elements whose paths make the layout of a page.
LAYOUT = frozenset("body div section header footer nav aside main article form table".split())
#: Most characters of a reference that goes along with each page, and of the larger ones that go to each worker. Beyond, one goes ahead of each lot of its pages.
REF_CHARS, HELD_CHARS = 16_000, 1 << 20
#: Characters of the pages in a lot: so many times those of the reference, and so many at least. Bytes of a task of lots.
LOT_TIMES, LOT_CHARS, LOTS_BYTES = 16, 4 << 20, 128 << 20
#: Cells of a table of children that is made of plain numbers; larger ones are made a row at a time by numpy, and TABLE_CELLS of them are held at once.
PLAIN_CELLS, TABLE_CELLS = 4_000, 1_000_000
#: Pairs of nodes beyond which those that can meet at all are told first; weights of pairs that are kept (others are taken again).
SPARSE_PAIRS, KEPT_WEIGHTS = 100_000, 1_000_000
#: References, and nodes of them, that a worker keeps parsed; others are parsed again.
KEPT_TREES, KEPT_NODES = 200, 250_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("script style noscript template head title iframe object svg math nav footer aside form button select textarea input dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option", "optgroup", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Containers may be boilerplate by a class or id all of whose parts are such words or NEUTRAL ones; inside an article, by the first kind alone.
CONTAINERS = frozenset("div section ul ol dl table details".split())
EXTRA = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo newsletter subscribe comment comments disqus replies respond share sharing social related recommended recommendations".split())
FRAME = EXTRA | frozenset("banner cookie cookies consent gdpr notice popup modal signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead topbar pagination pager skip".split())
NEUTRAL = frozenset("site page main global top bottom left right list area section container box wrapper block bar links inner content thread form posts articles".split())
#: Elements that show a form or a container around them to be the page's own frame.
WHOLE = frozenset("article main header nav footer".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")


class Node:
    __slots__ = ("core", "drop", "kids", "label", "live", "most", "parts", "size", "soft", "tag")

    def __init__(self, tag: str, label: str, drop: bool, soft: bool = False):
        self.tag, self.label, self.drop, self.soft, self.parts = tag, label, drop, soft, []
        self.kids: list[Node] = []

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def boilerplate(names: str, inside: bool) -> bool:
    """Whether a class or id word names boilerplate: as a whole, not by a part of it."""
    words = EXTRA if inside else FRAME
    for name in names.split():
        parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
        if any(p in words for p in parts) and all(p in words or p in NEUTRAL for p in parts):
            return True
    return False


def parse(page: str | None) -> Node:
    """Tree of a page's elements; any string has one. Unclosed elements end where HTML lets them, all at the end."""
    root = Node("#root", "#root", False)
    stack, at, source = [root], 0, page or ""
    if not source:
        return root
    for m in iter(lambda: _TOKEN.search(source, at), None):
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m.group(2):
            tag, attrs = m.group(2).lower(), m.group(3) or ""
            if tag in CLOSES_P:
                _close(stack, {"p"}, {"table", "td", "th", "button", "article", "section", "li", "blockquote", "div", "body"})
            if tag in SIBLINGS:
                _close(stack, SIBLINGS[tag], LIMITS[tag])
            inside = lambda: any(n.tag in ("article", "main") for n in stack)
            names, drop, soft = "", tag in DROP or (tag == "header" and not inside()), tag == "form"
            if attrs and not attrs.isspace():
                known = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
                names = f"{known.get('class', '')} {known.get('id', '')}".strip().lower()
                drop = drop or "hidden" in known or known.get("aria-hidden") == "true" or known.get("role", "").lower() in ROLES
                drop = drop or bool(re.search(r"display\s*:\s*none", known.get("style", "")))
                if not drop and names and tag in CONTAINERS:
                    drop = soft = boilerplate(names, inside())
            if tag in WHOLE and not (drop and tag == "header"):
                for above in stack:
                    above.drop = above.drop and not above.soft
            node = Node(tag, " ".join(f"{tag}.{names}".split()) if names else tag, drop, soft)
            stack[-1].parts.append(node)
            stack[-1].kids.append(node)
            if tag in RAW and not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(source, at)
                node.parts.append(source[at : close.start() if close else len(source)])
                at = close.end() if close else len(source)
            elif tag not in VOID:
                stack.append(node)
        elif m.group(1):
            tag = m.group(1).lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
    if at < len(source):
        stack[-1].parts.append(entities.unescape(source[at:]))
    return root


def _close(stack: list[Node], tags: set[str], limits: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in limits:
            return


def _outermost(root: Node, tags: tuple[str, ...]) -> list[Node]:
    """Elements of these tags in page order, without those inside each other or inside a dropped element. No recursion: trees may be deep."""
    found, todo = [], root.kids[::-1]
    while todo:
        node = todo.pop()
        if node.tag in tags and not node.drop:
            found.append(node)
        elif not node.drop:
            todo.extend(reversed(node.kids))
    return found


def main_nodes(root: Node) -> list[Node]:
    """Outermost article or main elements that are not themselves dropped; articles inside main go first if there is one."""
    found = _outermost(root, ("article", "main"))
    inner = [a for n in found if n.tag == "main" for a in _outermost(n, ("article",))]
    return inner or found


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def content(root: Node) -> tuple[list[Node], bool, int, list[tuple[Node, int, str]]]:
    """Top nodes of a page's text, whether they are articles, the page's layout, and (node, path, text) of each shown node with own text. Paths inside articles begin at the article."""
    parts = main_nodes(root)
    tops, places, layout = {id(n) for n in parts}, [], set()
    todo = [(root, 0, not parts)]
    while todo:
        node, above, inside = todo.pop()
        start = id(node) in tops
        path = xxh64_intdigest(node.label, 1 if start else above)
        if node.tag in LAYOUT and (not inside or not parts):
            layout.add(xxh64_intdigest(node.label, above))
        inside = inside or start
        if node.drop and not start:
            continue
        if inside and (text := node.own_text()):
            places.append((node, path, text))
        todo.extend((kid, path, inside) for kid in reversed(node.kids))
    return parts or [root], bool(parts), _signed(xxh64_intdigest(",".join(map(str, sorted(layout))))), places


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo.extend(reversed(node.kids))
    return out


def outline(root: Node) -> str:
    """The labels of a page's tree with their depths, a line each."""
    lines, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        lines.append(f"{depth} {node.label}")
        todo.extend((kid, depth + 1) for kid in reversed(node.kids))
    return "\n".join(lines)


def rank(lines: str) -> tuple[int, str, int | None]:
    """What an outline is judged by, the largest of a layout being its reference: its last line's number, itself if it may go along with each page, else a hash."""
    nodes = lines.count("\n")
    return (nodes, lines, None) if len(lines) < REF_CHARS else (nodes, "", _signed(xxh64_intdigest(lines)))


def tree_of(lines: str) -> Node | None:
    """The tree of an outline()."""
    path: list[Node] = []
    for line in lines.split("\n") if lines else ():
        depth, _, label = line.partition(" ")
        node = Node("", label, False)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0] if path else None


def _measure(root: Node) -> None:
    """Sets size, and core (equal for equal trees of labels), live (children in it) and most (nodes in it) to those of the whole trees."""
    for node in reversed(_preorder(root)):
        node.live = node.kids
        node.core = hash((node.label, *(k.core for k in node.kids)))
        node.size = node.most = 1 + sum(k.size for k in node.kids)


def _prune(a: Node, b: Node) -> None:
    """Sets core, live and most to those of the trees without nodes whose labels from the root down the other tree does not have: these cannot pair."""
    trees = []
    for root in (a, b):
        trees.append(found := [])
        todo = [(root, hash(root.label))]
        while todo:
            node, path = todo.pop()
            found.append((node, path))
            todo.extend((kid, hash((path, kid.label))) for kid in reversed(node.kids))
    both = {path for _, path in trees[0]} & {path for _, path in trees[1]}
    for found in trees:
        paths = {id(node): path for node, path in found}
        for node, _ in reversed(found):
            node.live = [k for k in node.kids if paths[id(k)] in both]
            node.core = hash((node.label, *(k.core for k in node.live)))
            node.most = 1 + sum(k.most for k in node.live)


def _ends(x: Node, y: Node) -> tuple[int, int]:
    """How many children are equal trees at the beginning and at the end of two lists."""
    xs, ys = x.live, y.live
    n = min(len(xs), len(ys))
    head = next((i for i in range(n) if xs[i].core != ys[i].core), n)
    return head, next((i for i in range(n - head) if xs[-1 - i].core != ys[-1 - i].core), n - head)


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of a heaviest match of two trees, in which roots and, below paired nodes, children of equal label pair in order.

    Children that are equal trees at both ends of two lists pair at once, which costs no weight, and equal pairs of trees
    are weighed once. Lists of any length are aligned whole; a long one in memory that grows with its length only. No
    recursion over nodes: trees may be deep.
    """
    if getattr(a, "size", None) is None:  # a reference is measured once
        _measure(a)
    _measure(b)
    if a.label != b.label:
        return []
    if a.size * b.size > SPARSE_PAIRS:
        _prune(a, b)
    elif a.most != a.size:
        _measure(a)
    known: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    # Generators ask for the weights of pairs of nodes by yielding them.
    def weight(p: Node, q: Node):
        if p.core == q.core:
            return p.most
        if not p.live or not q.live:
            return 1
        return known.get((p.core, q.core)) or (yield p, q)

    def plain(xs: list[Node], ys: list[Node]):
        """(weight, pairs of indexes) of a heaviest match of two lists."""
        table, weights = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)], {}
        for i, p in enumerate(xs):
            for j, q in enumerate(ys):
                best = max(table[i][j + 1], table[i + 1][j])
                if p.label == q.label:
                    weights[i, j] = w = p.most if p.core == q.core else (yield from weight(p, q))
                    best = max(best, table[i][j] + w)
                table[i + 1][j + 1] = best
        i, j, pairs = len(xs), len(ys), []
        while i and j:
            if (w := weights.get((i - 1, j - 1))) and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return table[-1][-1], pairs[::-1]

    def long(xs: list[Node], ys: list[Node], paired: bool):
        """The same as plain(), for long lists; without the pairs unless they are asked for."""
        if turned := len(xs) > len(ys):  # the shorter list makes the rows
            xs, ys = ys, xs
        kinds: dict[str, dict[int, tuple[int, Node]]] = {}  # label: core: its number, a node
        numbers = np.array([kinds.setdefault(q.label, {}).setdefault(q.core, (k, q))[0] for k, q in enumerate(ys)])
        rows: dict[int, np.ndarray | None] = {}

        def row(i: int):
            """Weights of xs[i] and each of ys; None if all are zero."""
            p = xs[i]
            if p.label not in kinds:
                return None
            if p.core not in rows:
                if len(rows) * len(ys) > TABLE_CELLS:
                    rows.clear()
                of = np.zeros(len(ys), np.int64)
                for k, q in kinds[p.label].values():
                    of[k] = yield from (weight(q, p) if turned else weight(p, q))
                rows[p.core] = of[numbers]
            return rows[p.core]

        def after(last, w):
            if w is None:
                return last
            line = last.copy()
            np.maximum(last[1:], last[:-1] + w[: len(last) - 1], out=line[1:])
            return np.maximum.accumulate(line, out=line)

        pairs = []

        def back(low: int, high: int, first, j: int):
            """Pairs of rows low to high, backwards from column j; first is the line of the table before them. Returns the column where it ends."""
            if not j:
                return 0
            step = 1 if (high - low) * (j + 1) <= TABLE_CELLS else -(-(high - low) // 16)
            starts = range(low, high, step)
            line = first[: j + 1]
            lines = [line]
            for i in range(low, high if step == 1 else starts[-1]):
                line = after(line, (yield from row(i)))
                if (i + 1 - low) % step == 0:
                    lines.append(line)
            if step > 1:
                for start, line in zip(reversed(starts), reversed(lines), strict=True):
                    j = yield from back(start, min(start + step, high), line, j)
                return j
            i = high
            while i > low and j:
                w = yield from row(i - 1)
                here, above = lines[i - low], lines[i - low - 1]
                if w is not None and w[j - 1] and here[j] == above[j - 1] + w[j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((j, i) if turned else (i, j))
                elif (here[j] != here[j - 1]) if turned else (here[j] == above[j]):
                    i -= 1
                else:
                    j -= 1
            return j

        line = np.zeros(len(ys) + 1, np.int64)
        if paired:
            yield from back(0, len(xs), line, len(ys))
            return None, pairs[::-1]
        for i in range(len(xs)):
            line = after(line, (yield from row(i)))
        return int(line[-1]), None

    def middle(x: Node, y: Node, paired: bool):
        head, tail = _ends(x, y)
        xs, ys = x.live[head : len(x.live) - tail], y.live[head : len(y.live) - tail]
        if not xs or not ys:
            found = 0, []
        elif len(xs) * len(ys) <= PLAIN_CELLS:
            found = yield from plain(xs, ys)
        else:
            found = yield from long(xs, ys, paired)
        return head, tail, *found

    def below(x: Node, y: Node):
        """The weight of a pair of nodes."""
        head, tail, best, pairs = yield from middle(x, y, False)
        if pairs is not None:
            chosen[x.core, y.core] = pairs
        return 1 + best + sum(p.most for p in [*x.live[:head], *x.live[len(x.live) - tail :]])

    def solved(work):
        stack, value = [(None, work)], None
        while stack:
            try:
                p, q = stack[-1][1].send(value)
                value = known.get((p.core, q.core))
                if value is None:
                    stack.append(((p.core, q.core), below(p, q)))
            except StopIteration as end:
                value = end.value
                pair = stack.pop()[0]
                if pair:
                    if len(known) >= KEPT_WEIGHTS:
                        known.clear()
                        chosen.clear()
                    known[pair] = value
        return value

    out, todo = [], [(a, b)]
    if a.core != b.core:
        solved(below(a, b))
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        xs, ys = x.live, y.live
        if x.core == y.core:
            pairs = list(zip(xs, ys, strict=True))
        else:
            (head, tail), inner = _ends(x, y), chosen.get((x.core, y.core))
            if inner is None:
                inner = solved(middle(x, y, True))[3]
            pairs = [*zip(xs[:head], ys[:head], strict=True), *((xs[head + i], ys[head + j]) for i, j in inner), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)]
        todo.extend(reversed(pairs))
    return out


_references: dict[str, tuple[Node | None, dict[int, int]]] = {}


def _reference(lines: str) -> tuple[Node | None, dict[int, int]]:
    if lines not in _references:
        nodes = _preorder(tree_of(lines)) if lines else []
        if len(_references) >= KEPT_TREES or sum(len(n) for _, n in _references.values()) + len(nodes) > KEPT_NODES:
            _references.clear()
        _references[lines] = nodes[0] if nodes else None, {id(n): i for i, n in enumerate(nodes)}
    return _references[lines]


def marked(root: Node, places: list[tuple[Node, int, str]], reference: str) -> list[tuple[int, int, int, int, int]]:
    """(path, its key, name within the layout, its key, size) of each place. A name is the reference node's, else the path; a key stands for a place, a text and how often the page had both before."""
    tree, numbers = _reference(reference)
    names = {id(y): xxh64_intdigest(str(numbers[id(x)]), 2) for x, y in match(tree, root)} if tree else {}
    seen: dict[int, int] = {}
    out = []
    for node, path, text in places:
        found = []
        for place in (path, names.get(id(node), path) ^ 1):
            key = xxh64_intdigest(text, place)
            seen[key] = again = seen.get(key, -1) + 1
            found += [_signed(place), _signed(xxh64_intdigest(str(again), key))]
        out.append((*found, len(text)))
    return out


def witness(page: str | None, reference: str) -> dict:
    """What a page tells of its host: article, layout, id (equal for equal texts at equal places), and places with the keys and sizes at them, by path (kind 0) and by name within the layout (kind 1); first marks one row of each place."""
    root = parse(page)
    _, article, layout, places = content(root)
    found = marked(root, places, reference)
    marks, seen = [], set()
    for k in (0, 1):
        for m in found:
            first = (k, m[2 * k]) not in seen
            seen.add((k, m[2 * k]))
            marks.append({"kind": k, "place": m[2 * k], "key": m[2 * k + 1], "size": m[4], "first": int(first)})
    return {"article": article, "layout": layout, "id": _signed(xxh64_intdigest(",".join(str(m[1]) for m in found))), "marks": marks}


def induce(pages: list[str]) -> tuple[dict[int, str], dict[int, list[int]]]:
    """(reference, template keys) by layout, of the pages of one host. main_texts does the same by aggregates."""
    largest: dict[int, tuple] = {}
    for page in pages:
        root = parse(page)
        lines = outline(root)
        layout = content(root)[2]
        nodes, kept, mark = rank(lines)
        largest[layout] = max(largest.get(layout, (-1,)), (nodes, kept, mark is not None, mark or 0, lines))
    references = {layout: of[-1] for layout, of in largest.items()}
    found = {}
    for page in pages:
        w = witness(page, references[content(parse(page))[2]])
        known = found.setdefault((w["article"], w["id"]), w)
        if w["layout"] < known["layout"]:
            found[w["article"], w["id"]] = w
    counts: dict[tuple, list[int]] = {}
    pages_at: dict[tuple, int] = {}
    for (article, _), w in found.items():
        for m in w["marks"]:
            place = (w["layout"] if m["kind"] else None, article, m["place"])
            n = counts.setdefault((*place, m["key"]), [0, m["size"]])
            n[0] += 1
            pages_at[place] = pages_at.get(place, 0) + m["first"]
    whole, constant = {}, {}
    for (layout, article, place, key), (n, size) in counts.items():
        whole[layout, article] = whole.get((layout, article), 0) + n * size
        if n >= LEAST_PAGES and n >= CONSTANT_SHARE * pages_at[layout, article, place]:
            constant.setdefault((layout, article), []).append((key, n * size))
    kept: dict[int | None, set[int]] = {}
    for (layout, article), keys in constant.items():
        if not article or 2 * sum(n for _, n in keys) <= whole[layout, article]:
            kept.setdefault(layout, set()).update(k for k, _ in keys)
    return references, {layout: sorted(kept.get(layout, set()) | kept.get(None, set())) for layout in references}


def extract(page: str | None, template=(), reference: str = "") -> str:
    """Content blocks of a page in order, one line each, without nodes whose key is in template (a set of a layout's keys)."""
    root = parse(page)
    gone: set[int] = set()
    if template:
        parts, _, _, places = content(root)
        for (node, _, _), (_, key, _, name_key, _) in zip(places, marked(root, places, reference), strict=True):
            if key in template or name_key in template:
                gone.add(id(node))
    else:
        parts = main_nodes(root) or [root]
    blocks: list[list[str]] = [[]]

    def walk(top: Node) -> None:
        todo: list[Node | str | None] = [top]  # None ends a block
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                blocks[-1].append(part)
            elif part is None:
                blocks.append([])
            else:
                if part.tag in BLOCK:
                    blocks.append([])
                    todo.append(None)
                elif part.tag == "br":
                    blocks[-1].append(" ")
                shown = id(part) not in gone
                todo.extend(p for p in reversed(part.parts) if (shown if isinstance(p, str) else not p.drop))

    for part in parts:
        blocks.append([])
        walk(part)
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


LAID = "layout bigint, nodes int, lines string, mark bigint, chars int"


def layout_batches(batches):
    """Adds each page's layout, the rank() of its outline and its characters."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for page in batch.column(2).to_pylist():
            root = parse(page)
            rows.append((content(root)[2], *rank(outline(root)), len(page)))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["page_id", "url", "html", "host", "layout", "nodes", "lines", "mark", "chars"])


def outline_batches(batches):
    """Outlines in place of pages."""
    import pyarrow as pa

    for batch in batches:
        lines = [outline(parse(page)) for page in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), *batch.columns[1:]], names=["ref", "host", "layout", "pages", "chars"])


def _given(ref: str, keys, held) -> tuple[str, set[int]]:
    """The outline and the template that a row brings along, or those held by a worker that it names."""
    if ref.startswith("#"):
        ref, keys = held.value[int(ref[1:])]
    return ref, keys if isinstance(keys, frozenset) else frozenset(keys or ())


WITNESS = "host string, article boolean, id bigint, layout bigint, marks array<struct<kind: tinyint, place: bigint, key: bigint, size: int, first: tinyint>>"


def witness_batches(batches, held=()):
    import pyarrow as pa

    lines = ""
    marks = pa.list_(pa.struct([("kind", pa.int8()), ("place", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("first", pa.int8())]))
    for batch in batches:
        rows, hosts = [], []
        for host, page, ref in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if ref is not None:
                lines, _ = _given(ref, None, held)
            if page is not None:
                hosts.append(host)
                rows.append(witness(page, lines))
        columns = [pa.array(hosts, pa.string())] + [pa.array([r[c] for r in rows], t) for c, t in (("article", pa.bool_()), ("id", pa.int64()), ("layout", pa.int64()), ("marks", marks))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "article", "id", "layout", "marks"])


def extract_batches(batches, held=()):
    import pyarrow as pa

    lines, template = "", frozenset()
    for batch in batches:
        texts, kept = [], []
        for i, (page, ref, keys) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
            if ref is not None:
                lines, template = _given(ref, keys, held)
            if page is not None:
                kept.append(i)
                texts.append(extract(page, template, lines))
        ids = batch.select([0, 1]).take(pa.array(kept, pa.int32()))
        yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def laid_out(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), host, layout, the rank of the outline, characters and a number (row) of every row, written."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    laid = rows.mapInArrow(layout_batches, f"page_id {kind}, url string, html string, host string, {LAID}")
    return materialize(laid.withColumn("row", F.monotonically_increasing_id()), "pages", compression="zstd")


def references(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """host, layout, ref, pages: of each layout the outline of its largest page, null if it is too large to go along with each; those too large, with the number of lots of their pages."""
    largest = F.max(F.struct("nodes", "lines", "mark", "row"))
    found = rows.groupBy("host", "layout").agg(largest.alias("_l"), F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))
    found = materialize(found.select("host", "layout", F.expr("if(_l.mark is null, _l.lines, null)").alias("ref"), "pages", "_l.row", "chars"), "references")
    refs = found.select("host", "layout", "ref", "pages")
    wide = found.where("ref is null").drop("ref")
    if wide.isEmpty():
        return refs, None
    large = rows.select("row", "html").join(small(wide), "row").select("html", "host", "layout", "pages", "chars").mapInArrow(outline_batches, "ref string, host string, layout bigint, pages bigint, chars bigint")
    return refs, materialize(large.withColumn("lots", F.expr(f"cast(ceil(chars / greatest({LOT_TIMES} * length(ref), {LOT_CHARS})) as bigint)")), "large-references", compression="zstd")


def with_references(rows: DataFrame, refs: DataFrame, large: DataFrame | None, columns: list[str], of_ref: list[str], work, schema: str) -> DataFrame:
    """The columns of rows, html among them, and those of their layout's reference through `work`.

    A row of `refs` goes along with each of its pages. Those of `large` go to each worker if they are few. Else each goes
    ahead of every lot of its pages, a row without html before rows without a reference: its copies are at most one part
    in LOT_TIMES of its pages and one more.
    """
    on, spark, held = ["host", "layout"], rows.sparkSession, ()
    refs = refs.select(*on, *of_ref, "pages")
    if large is not None:
        keys = F.size("keys") if "keys" in of_ref else F.lit(0)
        chars, width = large.agg(F.sum("chars"), F.sum(F.length("ref") + 20 * keys + 200)).first()
        if (width or 0) <= HELD_CHARS:
            found = large.select(*on, "pages", *of_ref).collect()
            held = spark.sparkContext.broadcast([(r.ref, frozenset(r["keys"] if "keys" in of_ref else ())) for r in found])
            names = spark.createDataFrame([(r.host, r.layout, f"#{i}", r.pages) for i, r in enumerate(found)], "host string, layout bigint, ref string, pages bigint")
            refs, large = refs.unionByName(names, allowMissingColumns=True), None
    out = join_unique(rows, refs, on, "pages").select(*columns, *of_ref).mapInArrow(lambda batches: work(batches, held), schema)
    if large is None:
        return out
    dealt = join_unique(rows, large.select(*on, "lots", "pages"), on, "pages").withColumn("lot", F.expr("pmod(xxhash64(row), lots)"))
    turn = [*on, "lot", "turn"]
    dealt = dealt.select(*(F.col(c) for c in dict.fromkeys([*on, "lot", *columns])), F.lit(1).alias("turn"))
    ahead = large.select(*on, *of_ref, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("turn"))
    lots = dealt.unionByName(ahead, allowMissingColumns=True).repartition(max(shuffle_parts(spark), chars // LOTS_BYTES), *turn[:3]).sortWithinPartitions(*turn)
    return out.unionByName(lots.select(*columns, *of_ref).mapInArrow(work, schema))


def templates(rows: DataFrame, refs: DataFrame, large: DataFrame | None) -> DataFrame:
    """host, layout, keys: of each layout with a template, its keys. Every page is read; only hashes and counts are dealt, and the pages of large references."""
    seen = with_references(rows.where("html <> ''"), refs.where("ref is not null"), large, ["host", "html"], ["ref"], witness_batches, WITNESS)
    once = seen.groupBy("host", "article", "id").agg(F.min(F.struct("layout", "marks")).alias("_w")).select("host", "article", "_w.layout", F.explode("_w.marks").alias("_m"))
    by_layout = once.groupBy("host", "article", "layout", "_m.kind", "_m.place", "_m.key").agg(F.count(F.lit(1)).alias("n"), F.sum("_m.first").alias("first"), F.max("_m.size").alias("size"))
    by_layout = materialize(by_layout.select("host", "article", "layout", "kind", "place", "key", "n", "first", "size"), "template-counts", compression="zstd")
    wide = by_layout.where("kind = 0").groupBy("host", "article", "place", "key").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.max("size").alias("size"))
    counts = by_layout.where("kind = 1").drop("kind").unionByName(wide.withColumn("layout", F.lit(None).cast("bigint")))
    group = ["host", "article", "at"]
    counts = counts.select("host", "article", F.coalesce(F.col("layout").cast("string"), F.lit("")).alias("at"), "layout", "place", "key", "n", "first", "size")
    paths = counts.groupBy(*group, "place").agg(F.sum("first").alias("_pages"))
    held = counts.where(f"n >= {LEAST_PAGES}").join(paths, [*group, "place"]).where(F.col("n") >= CONSTANT_SHARE * F.col("_pages"))
    constant = materialize(held.select(*group, "layout", "key", (F.col("n") * F.col("size")).alias("_c")), "template-keys")
    whole = counts.groupBy(*group).agg(F.sum(F.col("n") * F.col("size")).alias("_whole"))
    kept = constant.groupBy(*group).agg(F.sum("_c").alias("_c")).join(whole, group).where("not article or 2 * _c <= _whole").select(*group)
    keys = constant.join(materialize(kept, "template-groups"), group, "left_semi")
    anywhere = keys.where("layout is null").select("host", "key")
    of_layouts = by_layout.where("kind = 0").select("host", "layout", "key").join(anywhere, ["host", "key"], "left_semi")
    lists = keys.where("layout is not null").select("host", "layout", "key").unionByName(of_layouts)
    return materialize(lists.groupBy("host", "layout").agg(F.collect_set("key").alias("keys")), "templates")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty page gives an empty text. Hosts with too few different pages have no template; their text is found
    by the roles of elements alone. Rows may repeat (equal pages bear witness once); other columns are not read.
    """
    rows = laid_out(pages)
    refs, large = references(rows)
    found = templates(rows, refs, large)
    known = refs.join(F.broadcast(found) if is_small(found) else found, ["host", "layout"], "left").select("host", "layout", F.when(F.col("keys").isNotNull(), F.col("ref")).otherwise("").alias("ref"), "keys", "pages")
    known = materialize(known, "wrappers")
    if large is not None:
        large = materialize(large.join(known.where("ref is null").select("host", "layout", "keys"), ["host", "layout"]), "large-wrappers", compression="zstd")
    kind = pages.schema["page_id"].dataType.simpleString()
    return with_references(rows, known.where("ref is not null"), large, ["page_id", "url", "html"], ["ref", "keys"], extract_batches, f"page_id {kind}, url string, text string, n_chars bigint")
