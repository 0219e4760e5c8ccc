"""HTML extraction by union-free regular-expression wrappers.

For each host a wrapper is inferred: a union-free regular expression over
block-level tags and text slots, kept as a tree. An element's children are an
expression of their own: a child is required, optional (``?``), repeated
(``+``) or both (``*``), and a sequence of children that recurs is a group,
written ``(a b)``.

* A page's token stream is parsed into such an expression; neighbouring
  children of one kind, and sequences that follow themselves, fold into repeats.
* Expressions are aligned (longest common subsequence of the children's kinds).
  What only one of them has becomes optional, what one repeats becomes repeated,
  texts become slots; children that match are aligned in turn.
* Spark reduces the pages of a host to distinct expressions first and folds these
  in streams, as a tree over salts, so a host with very many pages is never
  collected anywhere.

The pages are then read along their host's wrapper and each slot's texts are
summed up over the host: pages, whether the text ever varies, characters outside
and inside links. These decide the parts' roles (:func:`roles`):

* The main containers are all outermost article-like elements of the wrapper (a
  host may have several templates), or else the deepest part whose slots hold
  most of the text that varies and isn't linked.
* Template are parts named as menus, headers, footers, sidebars, notices,
  adverts, forms or reader comments, parts inside a container whose text is the
  same on every page and mostly linked (unnamed menus), and, where no element
  says what the article is, every slot whose text never varies.
* The slots of the containers that aren't template are content.

A page's blocks are the texts of the content slots it meets. A page that meets
no container of its host is read by a wrapper of its own.

Defined results: null or empty html, and pages without content, give an empty
text; a page that is nothing but a fragment (a bare paragraph) is its own
content; null and malformed urls count as one host
of their own, with as many templates as it takes; pages cut off anywhere are
read as far as they go; elements may be nested to any depth; repeated pages are
extracted each for themselves; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, partitions, table

SALTS = (256, 16, 1)  # streams of a host's expressions on each level of the fold
PERIOD = 8  # longest sequence of children that is looked for as a repeated group; longer ones stay as they are
CELLS = 1_000_000  # size up to which alignments are the longest ones; above, each child takes the next of its kind
SAME = 3  # pages that a text must be the same on, to count as one that never varies
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|noscript|style|template|iframe|svg|textarea|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Fixed list: HTML elements that start a block.
BLOCKS = frozenset("html head body title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd section article main header footer nav aside form fieldset table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center dialog menu".split())
#: Fixed list: elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Fixed list: elements that an opening tag closes (HTML's optional end tags).
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head", "title"}} | {b: {"p"} for b in "div h1 h2 h3 h4 h5 h6 ul ol dl section article main header footer nav aside form table blockquote pre figure address hr".split()}
#: Fixed list: elements that are never content.
OUTSIDE = frozenset("head title nav header footer aside form fieldset dialog menu".split())
#: Fixed list: words in class, id and role names that mark such elements.
MARKS = re.compile(r"(?:^|[-_\s])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|disqus|respond|replies|share|sharing|social|newsletter|subscribe|signup|related|recommend\w*|popup|modal|widget|toolbar|pagination|pager|login|search)(?:$|[-_\s])", re.I)
_MAIN = re.compile(r"(?:^|[-_\s])(article|article-?body|articlebody|main|post-?content|entry-?content|content-?body|story|main-?content)(?:$|[-_\s])", re.I)


class Node:
    __slots__ = ("kind", "kids")

    def __init__(self, kind: str):
        self.kind, self.kids = kind, []  # kids: Node, or a list of raw text and link parts


def parse(html: str) -> Node:
    """Tree of block elements; a text kid is a list of (raw text, inside a link)."""
    root = Node("")
    stack, names, run, link, opened = [root], [""], None, 0, Counter()
    for m in _TOKEN.finditer(html):
        t = m.group(0)
        if t[0] != "<" or len(t) == 1:
            if run is None:
                run = []
                stack[-1].kids.append(run)
            run.append((t, link > 0))
            continue
        tag = _TAG.match(t)
        if m.group(1) or not tag:  # scripts, styles, comments, declarations
            if tag and run is not None:
                run.append((" ", False))
            continue
        end, name = tag.group(1), tag.group(2).lower()
        if name not in BLOCKS:
            if name == "a":
                link = max(0, link + (-1 if end else 1))
            if name == "br" and run is not None:
                run.append((" ", False))
            continue
        run, link = None, 0
        if end:
            while opened[name]:
                stack.pop()
                last = names.pop()
                opened[last] -= 1
                if last == name:
                    break
            continue
        shut = CLOSES.get(name)
        while shut and len(stack) > 1 and names[-1] in shut:
            stack.pop()
            opened[names.pop()] -= 1
        marks = sorted({x.lower() for a in _ATTR.finditer(t) for x in (a.group(2) or a.group(3) or a.group(4) or "").split() if not any(c.isdigit() for c in x)}) if len(t) > len(name) + 2 else ()
        node = Node(".".join([name, *marks]))
        stack[-1].kids.append(node)
        if name not in VOID:
            stack.append(node)
            names.append(name)
            opened[name] += 1
    return root


def block_text(run: list) -> str:
    return " ".join(html_lib.unescape("".join([t for t, _ in run])).split())


def _blank(run: list) -> bool:
    return not any(t.strip() for t, _ in run)


# Wrappers.
_FOLD = {("1", "1"): "1", ("?", "?"): "?", ("1", "?"): "?", ("?", "1"): "?"}


def _either(a: str, b: str) -> str:
    return _FOLD.get((a, b)) or ("*" if a in "?*" or b in "?*" else "+")


def _again(a: str) -> str:
    return "*" if a in "?*" else "+"


def _maybe(a: str) -> str:
    return "*" if a in "+*" else "?"


class Part:
    """An element, group or slot (``#``) of a wrapper; ``todo`` holds what its children are yet to be aligned from."""

    __slots__ = ("kind", "mult", "kids", "todo", "id", "role")

    def __init__(self, kind: str, mult: str, todo: list):
        self.kind, self.mult, self.kids, self.todo, self.id, self.role = kind, mult, [], todo, -1, ""


def fold(kids: list) -> list:
    """Children of a page's element as [kind, members]; a group's members are the folded children of each of its turns."""
    items: list = []
    for k in kids:
        if isinstance(k, list):
            if _blank(k):
                continue
            kind = "#"
        else:
            kind = k.kind
        if items and items[-1][0] == kind:
            items[-1][1].append(k)
        else:
            items.append([kind, [k]])
    if len(items) < 4:
        return items
    kinds, out, i, n = [x[0] for x in items], [], 0, len(items)
    while i < n:
        for p in range(2, min(PERIOD, (n - i) // 2) + 1):
            if kinds[i] == kinds[i + p] and kinds[i : i + p] == kinds[i + p : i + 2 * p]:
                z = i + 2 * p
                while kinds[z : z + p] == kinds[i : i + p]:
                    z += p
                out.append([f"({' '.join(kinds[i : i + p])})", [items[a : a + p] for a in range(i, z, p)]])
                i = z
                break
        else:
            out.append(items[i])
            i += 1
    return out


def _parts(source: list) -> list[Part]:
    """Parts of an element's raw children, of folded ones, or of a finished wrapper's."""
    if source and isinstance(source[0], Part):
        return [Part(x.kind, x.mult, [x.kids] if x.kids else []) for x in source]
    folded = source if source and isinstance(source[0], list) and isinstance(source[0][0], str) else fold(source)
    out = []
    for kind, members in folded:
        if kind == "#":
            out.append(Part(kind, "1" if len(members) == 1 else "+", []))
        elif kind[0] == "(":
            out.append(Part(kind, "+", members))
        else:
            plain, todo = False, []
            for k in members:  # paragraphs of nothing but text count once
                text = len(k.kids) == 1 and isinstance(k.kids[0], list)
                if not (text and plain):
                    todo.append(k.kids)
                plain = plain or (text and not _blank(k.kids[0]))
            out.append(Part(kind, "1" if len(members) == 1 else "+", todo))
    return out


def match(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a common subsequence of two lists of kinds: a longest one up to CELLS."""
    n, m, k = len(a), len(b), 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    e = 0
    while e < min(n, m) - k and a[n - 1 - e] == b[m - 1 - e]:
        e += 1
    pairs, x, y = [(i, i) for i in range(k)], a[k : n - e], b[k : m - e]
    if x and y:
        at: dict[str, list[int]] = {}
        for i, kind in enumerate(x):
            at.setdefault(kind, []).append(i)
        pos, found = 0, []
        for j, kind in enumerate(y):  # each child of b takes the next of its kind
            spots = at.get(kind, ())
            s = bisect_left(spots, pos)
            if s < len(spots):
                found.append((spots[s], j))
                pos = spots[s] + 1
        if len(found) < min(len(y), len(x)) and len(x) * len(y) <= CELLS:
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(len(x) - 1, -1, -1):
                row, below = best[i], best[i + 1]
                for j in range(len(y) - 1, -1, -1):
                    row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
            found, i, j = [], 0, 0
            while i < len(x) and j < len(y):
                if x[i] == y[j]:
                    found.append((i, j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        pairs += [(k + i, k + j) for i, j in found]
    return pairs + [(n - e + i, m - e + i) for i in range(e)]


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """Children that both allow: matches merged (their own children later), the rest optional, neighbours of one kind folded."""
    out: list[Part] = []

    def put(x: Part) -> None:
        if out and out[-1].kind == x.kind:
            out[-1].mult = _again(_either(out[-1].mult, x.mult))
            out[-1].todo += x.todo
        else:
            out.append(x)

    i = j = 0
    for p, q in [*match([x.kind for x in a], [x.kind for x in b]), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            x.mult = _maybe(x.mult)
            put(x)
        if p < len(a):
            a[p].mult = _either(a[p].mult, b[q].mult)
            a[p].todo = a[p].todo + b[q].todo
            put(a[p])
        i, j = p + 1, q + 1
    return out


def infer(sources: list[list]) -> Part:
    """The wrapper of pages (their roots' children) and wrappers (their roots' parts)."""
    root = Part("", "1", sources)
    stack = [root]
    while stack:
        part = stack.pop()
        kids: list[Part] | None = None
        for source in part.todo:
            new = _parts(source)
            kids = new if kids is None else align(kids, new)
        part.kids, part.todo = kids or [], []
        stack += part.kids
    return root


def dump(root: Part) -> str:
    """A wrapper as text: (depth, multiplicity, kind) of its parts in order."""
    rows, stack = [], [(x, 0) for x in reversed(root.kids)]
    while stack:
        x, depth = stack.pop()
        rows.append((depth, x.mult, x.kind))
        stack += [(k, depth + 1) for k in reversed(x.kids)]
    return json.dumps(rows, separators=(",", ":"))


def load(text: str) -> Part:
    """The wrapper of :func:`dump`; parts are numbered in order."""
    root = Part("", "1", [])
    path = [root]
    for i, (depth, mult, kind) in enumerate(json.loads(text)):
        part = Part(kind, mult, [])
        part.id = i
        del path[depth + 1 :]
        path[-1].kids.append(part)
        path.append(part)
    return root


def along(kids: list, part: Part | None) -> list[tuple]:
    """(child, its part or None) of a page's element, in order, by aligning its children with those of its part."""
    out: list[tuple] = []
    items, parts = fold(kids), part.kids if part else []
    to = _matched(parts, items)
    for j, (kind, members) in enumerate(items):
        if kind[0] == "(":  # each turn of a group is aligned with the group
            for turn in members:
                at = _matched(to[j].kids if j in to else [], turn)
                out += [(k, at.get(i)) for i, (_, ks) in enumerate(turn) for k in ks]
        else:
            out += [(k, to.get(j)) for k in members]
    return out


def _matched(parts: list[Part], items: list) -> dict[int, Part]:
    return {j: parts[i] for i, j in match([x.kind for x in parts], [x[0] for x in items])} if parts else {}


def _named_outside(kind: str) -> bool:
    name, *marks = kind.split(".")
    return name in OUTSIDE or any(MARKS.search(m) for m in marks)


def _is_main(kind: str) -> bool:
    name, *marks = kind.split(".")
    return name in ("article", "main") or any(_MAIN.search(m) for m in marks)


def slot_texts(root: Node, wrapper: Part) -> dict[int, tuple[int, int, int]]:
    """Per slot of the wrapper that the page meets: checksum of its texts, characters outside and inside links."""
    found: dict[int, list] = {}
    stack = [(root, wrapper)]
    while stack:
        node, part = stack.pop()
        for k, p in along(node.kids, part):
            if p is None:
                continue
            if isinstance(k, list):
                s = found.setdefault(p.id, [0, 0, 0])
                for t, linked in k:
                    s[1 + linked] += len(t.strip())
                s[0] = crc32(block_text(k).encode("utf-8", "replace"), s[0])
            else:
                stack.append((k, p))
    return {i: tuple(s) for i, s in found.items()}


_BLOCKISH = ("p", "li", "td", "blockquote", "pre", "h1", "h2", "h3")


def roles(wrapper: Part, stats: dict[int, tuple[int, bool, int, int]]) -> Part:
    """Give each part its role: ``in`` (a container's content), ``out`` (template) or none.

    ``stats``: per slot the pages that have it, whether its text varies, and its
    characters outside and inside links.
    """
    order, stack = [], [(wrapper, None, False)]
    while stack:
        part, above, gone = stack.pop()
        gone = gone or (_named_outside(part.kind) and part.kind.split(".")[0] != "form")
        order.append((part, above, gone))
        stack += [(k, part, gone) for k in reversed(part.kids)]
    text: dict[Part, int] = {}  # varying text outside links, less that inside
    mass: dict[Part, int] = {}  # the same for all text
    size: dict[Part, int] = {}  # all text, links too
    known = any(x[1] for x in stats.values())  # copies of one page tell nothing
    fixed: dict[Part, bool] = {}  # no text varies
    linked: dict[Part, int] = {}
    for part, above, gone in reversed(order):
        if part.kind == "#":
            pages, varies, plain, link = stats.get(part.id, (0, True, 0, 0))
            still = not varies and pages >= SAME and known
            text[part], mass[part], fixed[part], linked[part] = (0 if still else plain - link), plain - link, still or not pages, link - plain
            size[part] = plain + link
        if above is not None:
            if not gone:
                text[above] = text.get(above, 0) + text.get(part, 0)
                mass[above] = mass.get(above, 0) + mass.get(part, 0)
                size[above] = size.get(above, 0) + size.get(part, 0)
            fixed[above] = fixed.get(above, True) and fixed.get(part, True)
            linked[above] = linked.get(above, 0) + linked.get(part, 0)
    named = [part for part, _, gone in order if not gone and part.kind and part.kind[0] not in "#(" and _is_main(part.kind)]
    # Where no named container holds more plain than linked text (lists of sources, say), one with any text will do.
    mains = {part for part in named if mass.get(part, 0) > 0} or {part for part in named if size.get(part, 0) > 0}
    deepest = None
    if not mains:
        total, deepest = text.get(wrapper, 0), wrapper
        while total > 0:
            below = [k for k in deepest.kids if text.get(k, 0) >= 0.7 * total and k.kind != "#" and k.kind.split(".")[0] not in _BLOCKISH and not _named_outside(k.kind)]
            if not below:
                break
            deepest = max(below, key=lambda k: text[k])
        if total <= 0:
            deepest = None
    wrapper.role = "in" if deepest is wrapper else ""
    for part, above, _ in order[1:]:
        inside, name = above.role == "in", part.kind.split(".")[0]
        holds = name == "form" and any(x in mains for x in _below(part))  # a form around the whole article
        if above.role == "out" or (_named_outside(part.kind) and not holds and not (inside and name == "header")):
            part.role = "out"
        elif inside and part.kind != "" and fixed.get(part, False) and (linked.get(part, 0) > 0 or (part.kind == "#" and not mains)):
            part.role = "out"  # an unnamed menu; or, with nothing that names the article, a text that never varies
        else:
            part.role = "in" if inside or part in mains or part is deepest else ""
    return wrapper


def _below(part: Part) -> Iterator[Part]:
    stack = [part]
    while stack:
        x = stack.pop()
        yield x
        stack += x.kids


def read_page(root: Node, wrapper: Part | None) -> str:
    """Blocks of the content slots of a wrapper with roles, in page order; None, or meeting no container, means a wrapper of the page's own."""
    for shape in (wrapper, None):
        if shape is None:
            shape = load(dump(infer([root.kids])))
            shape = roles(shape, {i: (1, True, plain, link) for i, (_, plain, link) in slot_texts(root, shape).items()})
        out: list[str] = []
        met = shape.role == "in"
        stack: list[tuple] = [(root, shape, shape.role)]
        while stack:
            node, part, role = stack.pop()
            if isinstance(node, list):
                if role == "in" and (text := block_text(node)):
                    out.append(text)
                continue
            met = met or role == "in"
            if role == "out":
                continue
            for k, p in reversed(along(node.kids, part)):
                kind = "#" if isinstance(k, list) else k.kind
                if p is not None:
                    stack.append((k, p, p.role))
                elif kind != "#" and _named_outside(kind) and not (role == "in" and kind.split(".")[0] == "header"):
                    continue
                else:  # unknown to the wrapper: as what it stands in, or by its own name
                    stack.append((k, None, "in" if role == "in" or (kind != "#" and _is_main(kind)) else role))
        if met:
            return "\n".join(out)
    return ""


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct expressions of each host in a batch."""
    for b in batches:
        shapes = sorted({(host, dump(infer([parse(page or "").kids]))) for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist())})
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in shapes], pa.string()) for i in (0, 1)], ["host", "shape"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the sorted stream of (host, salt, shape) into one wrapper per (host, salt)."""
    key, wrapper = None, None
    schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("shape", pa.string())])

    def done():
        return pa.RecordBatch.from_pylist([{"host": key[0], "salt": key[1], "shape": dump(wrapper)}], schema)

    for b in batches:
        for host, salt, shape in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "shape"))):
            if (host, salt) != key:
                if key is not None:
                    yield done()
                key, wrapper = (host, salt), load(shape)
            else:
                wrapper = infer([wrapper.kids, load(shape).kids])
    if key is not None:
        yield done()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of ``pages`` (host, html): one row per host."""
    n = partitions(pages.sparkSession)
    shapes = pages.select("host", "html").mapInArrow(_expressions, "host string, shape string").distinct()
    for salts in SALTS:
        shapes = shapes.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(salts)).cast("int"))
        shapes = shapes.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "shape").mapInArrow(_fold, "host string, salt int, shape string")
    return shapes.select("host", F.col("shape").alias("wrapper"))


def _wrapped(read):
    """mapInArrow over (host, html, wrapper, ...) with each host's wrapper made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Part | None] = {}
        for b in batches:
            hosts = b.column("host").to_pylist()
            wrappers, stats = b.column("wrapper"), b.column("slots") if "slots" in b.schema.names else None
            for i, h in enumerate(hosts):
                if h not in made:
                    if len(made) > 2_000:
                        made.clear()
                    text = wrappers[i].as_py()
                    made[h] = load(text) if text else None
                    if stats is not None and made[h]:
                        roles(made[h], {x["slot"]: (x["pages"], x["varies"], x["plain"], x["linked"]) for x in stats[i].as_py() or []})
            yield read(b, [made[h] for h in hosts] if len(made) else [])

    return run


_SLOT = "host string, slot int, pages long, low long, high long, plain long, linked long"


def _count_slots(b: pa.RecordBatch, wrappers: list) -> pa.RecordBatch:
    sums: dict[tuple, list] = {}
    for host, page, w in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), wrappers):
        for slot, (crc, plain, linked) in slot_texts(parse(page or ""), w).items() if w else ():
            s = sums.setdefault((host, slot), [0, crc, crc, 0, 0])
            s[0] += 1
            s[1], s[2] = min(s[1], crc), max(s[2], crc)
            s[3] += plain
            s[4] += linked
    cols = [[h for h, _ in sums], [i for _, i in sums], *([s[j] for s in sums.values()] for j in range(5))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), *[pa.int64()] * 5))], ["host", "slot", "pages", "low", "high", "plain", "linked"])


def _extract(b: pa.RecordBatch, wrappers: list) -> pa.RecordBatch:
    texts = [read_page(parse(page or ""), w) for page, w in zip(b.column("html").to_pylist(), wrappers)]
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


WRAPPER_BYTES = 64 << 20  # size of all wrappers up to which they are broadcast; beyond, they are joined by shuffle


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages`` (page_id, url, html)."""
    p = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))

    def with_wrapper(side: DataFrame, size: int) -> DataFrame:
        return p.join(F.broadcast(side) if size <= WRAPPER_BYTES else side, "host", "left")

    wrappers = materialize(infer_wrappers(p), "html-wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    slots = with_wrapper(wrappers, size).select("host", "html", "wrapper").mapInArrow(_wrapped(_count_slots), _SLOT)
    slots = slots.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), (F.min("low") < F.max("high")).alias("varies"), F.sum("plain").alias("plain"), F.sum("linked").alias("linked"))
    # One entry per slot of the host's wrapper, whatever its number of pages.
    per = slots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "pages", "varies", "plain", "linked"))).alias("slots"))
    known = materialize(wrappers.join(per, "host", "left"), "html-roles")
    return with_wrapper(known, 2 * size).select("page_id", "url", "host", "html", "wrapper", "slots").mapInArrow(_wrapped(_extract), "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
