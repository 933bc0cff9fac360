"""HTML extraction by inferring wrappers: union-free regular expressions from aligning the token streams of a host's pages.

A page is a tree of block elements (tags with id and class, numbers in them left out) and texts; notices, menus, adverts,
forms and comments are told by element, role, id or class and leave the tree. What stands in an element is an expression:
siblings that repeat side by side are a repeated group. A wrapper is inferred for each template of a host, from all its
pages: their expressions are aligned one after another, what only some have becomes optional, a group meets the stretch
that it repeats, and what is in the elements that meet is aligned in turn. Pages are of one template if their texts stand
in the same upper containers.

Then every page is matched with its wrapper, which gives each of its texts a place in the expression. A text that nine in
ten of the template's pages (three at least) have at a place is a constant and falls out; all other texts fill slots. The
main container is the deepest element of the expression in which nearly all slots' text stands (an article or main
element with half of it comes first), and a page's text is that of the slots in it, block by block in page order.

A page is read by itself where the wrapper doesn't fit: if most of its text is constants (copies of one page), they
count as slots, and if the container holds less than half of its slots' text, the container is the one that the page
itself suggests by the same rule. A page alone in its template is read so too.

Defined results: null html counts as empty and gives an empty text; pages without a url or host share one wrapper; rows
that repeat are extracted alike; an empty table gives an empty result; other columns take no part. An unclosed element
ends with its parent; character references are decoded once, with or without their semicolon. Pages of any length are
read whole, each in the memory of one worker; elements nested deeper than DEEPEST count as their ancestor there.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_or_shuffled, stored

#: Elements without an end tag, elements whose content isn't markup, and elements within a line (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split())
#: Elements that never hold main text, and words in class or id that say so (fixed values).
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe textarea title select option button svg embed audio video canvas menu map noembed noframes".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login footer header masthead widget widgets toolbar pagination pager skip hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose id and class hint nothing.
UNHINTED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_MARK = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"[\s ]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): open and close with name and attributes, text. Comments and raw content are left out."""
    at = 0
    while m := _MARK.search(page, at):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "xmp":  # shown as it is written
                yield "text", "", page[at : end.start() if end else len(page)].replace("&", "&amp;")
            at = end.end() if end else len(page)
            yield "close", name, ""
    if at < len(page):
        yield "text", "", page[at:]


def element(name: str, rest: str) -> tuple[str, bool, bool]:
    """The element's key (name, id and class), whether it is outside any main text, and whether its id or class only
    hints so."""
    attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
    marks = [attributes.get("id", ""), attributes.get("class", "")]
    said = {w for x in marks if x for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower())}
    out = name in OUTSIDE or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    hint = not out and bool(said & HINTS) and name not in UNHINTED
    marks = [re.sub(r"[0-9]{2,}", "0", x) for x in marks]
    return name + "".join(f"#{x}" if i == 0 else f".{x}" for i, x in enumerate(marks) if x), out, hint


class Hinted:
    """An element that its id or class hints to be outside, and what it holds."""

    __slots__ = ("within", "main", "chars")

    def __init__(self, within: bool):
        self.within, self.main, self.chars = within, False, 0


class Text:
    """A block's text with the elements around it, as (serial number, key), outermost first."""

    __slots__ = ("around", "outside", "text", "hints", "marked")

    def __init__(self, around: tuple[tuple[int, str], ...], outside: bool, text: str, hints: tuple[Hinted, ...] = (), marked: bool = False):
        self.around, self.outside, self.text, self.hints, self.marked = around, outside, text, hints, marked


def _weigh_hints(blocks: list[Text]) -> None:
    """A hint counts unless its element holds an article, a main or an h1 element or, where no article or main element
    has text beside it, most of the page's text."""
    total = 0
    for b in blocks:
        if not b.outside:
            total += len(b.text)
            for h in b.hints:
                h.chars += len(b.text)
    marked = any(b.marked and not b.outside and not b.hints for b in blocks)
    for b in blocks:
        b.outside = b.outside or any(not h.main and (marked or 2 * h.chars <= total) for h in b.hints)


#: Elements nested deeper than this count as their ancestor at that depth.
DEEPEST = 100


def read(page: str) -> list[Text]:
    """The page's blocks of text, by a stack of open elements (name, key, outside, hint, serial number)."""
    stack: list[tuple[str, str, bool, Hinted | None, int]] = []
    serial = 0
    blocks: list[Text] = []
    parts: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            hints = tuple(e[3] for e in stack if e[3] is not None)
            around = tuple((e[4], e[1]) for e in stack if e[0] not in INLINE)[:DEEPEST]
            blocks.append(Text(around, any(e[2] for e in stack), text, hints, any(e[0] in ("article", "main") for e in stack)))

    def pop(to: int) -> None:
        while len(stack) > to:
            name, _, out, hint, _ = stack[-1]
            if name not in INLINE or out or hint:
                flush()
            stack.pop()

    for kind, name, rest in tokens(page):
        if kind == "text":
            parts.append(rest)
        elif kind == "close":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                pop(at)
            elif name not in INLINE:
                flush()
        else:
            key, out, hinted = element(name, rest)
            within = any(e[0] in ("article", "main") for e in stack)
            if name == "header" and not within:
                out = True
            if name not in INLINE or out or hinted:
                flush()
            if name in _CLOSES_P and (at := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)) is not None:
                pop(at)
            if name in _LIKE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _FENCE[name]:
                        break
                    if stack[i][0] in _LIKE[name]:
                        pop(i)
                        break
            if name in ("article", "main", "h1"):
                for e in stack:  # an article in a hinted element of an article may be a comment
                    if e[3] is not None and (name == "h1" or not e[3].within):
                        e[3].main = True
            if name in VOID:
                parts.append(" " if name == "br" else "")
            elif not rest.rstrip().endswith("/") or name not in ("svg", "math"):
                serial += 1
                stack.append((name, key, out, Hinted(within) if hinted else None, serial))
    pop(0)
    flush()
    _weigh_hints(blocks)
    return blocks


def tree(page: str) -> list:
    """The page's elements that hold main text or may hold it: a node is [key, *children], a child a node or a text."""
    root: list = [""]
    open_: list[tuple[int, list]] = [(0, root)]
    for b in read(page):
        if b.outside:
            continue
        depth = 1
        while depth < len(open_) and depth <= len(b.around) and open_[depth][0] == b.around[depth - 1][0]:
            depth += 1
        del open_[depth:]
        for serial, key in b.around[depth - 1 :]:
            node = [key]
            open_[-1][1].append(node)
            open_.append((serial, node))
        open_[-1][1].append(b.text)
    return root


# A wrapper is a union-free regular expression: for each element the sequence of what stands in it. It is a tuple of
# groups (optional, repeated, members); a member is (key, optional, repeated, the expression of what is in it), and a
# text has the key '#'. Most groups have one member; several are a stretch of siblings that repeats as a whole.

TEXT = "#"
#: Longest stretch of different siblings that is sought as a repeated group.
STRETCH = 4
#: A sequence that aligning makes longer than this becomes one repeated group of optional members, so that an
#: expression is bounded by the keys and not by the pages that it was made from.
LONGEST = 48

Expression = tuple


def fold(keys: list[str]) -> list[tuple[bool, list[tuple[str, bool, list[int]]]]]:
    """Sequences of siblings as groups: (repeated, [(key, repeated, places)]). Equal neighbours are one member, and a
    stretch of members that follows itself is one group."""
    runs: list[tuple[str, list[int]]] = []
    for i, key in enumerate(keys):
        if runs and runs[-1][0] == key:
            runs[-1][1].append(i)
        else:
            runs.append((key, [i]))
    names = [r[0] for r in runs]
    out: list = []
    i = 0
    while i < len(runs):
        for size in range(2, STRETCH + 1):
            group, n = names[i : i + size], 1
            if len(set(group)) == size:
                while names[i + n * size : i + (n + 1) * size] == group:
                    n += 1
            if n > 1:
                met = [runs[i + k : i + n * size : size] for k in range(size)]
                out.append((True, [(m[0][0], any(len(x[1]) > 1 for x in m), [p for x in m for p in x[1]]) for m in met]))
                i += n * size
                break
        else:
            out.append((False, [(runs[i][0], len(runs[i][1]) > 1, runs[i][1])]))
            i += 1
    if len(out) > LONGEST:
        met = {}
        for key, _, places in (m for _, members in out for m in members):
            met.setdefault(key, []).extend(places)
        return [(True, [(key, True, places) for key, places in met.items()])]
    return out


def pairs(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> list[tuple[int, int, int, int]]:
    """Two sequences of groups (by their keys) aligned: which stretches a[i:k] and b[j:l] are the same. Groups with equal
    keys are, and a group of several members is the same as a stretch of groups that has no other keys. The alignment is
    the one with the most keys, the first such from the left."""
    n, m = len(a), len(b)
    if a == b:
        return [(i, j, i + 1, j + 1) for i, j in zip(range(n), range(m), strict=True)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    move: list[list[tuple[int, int] | None]] = [[None] * (m + 1) for _ in range(n + 1)]

    def stretch(group: tuple[str, ...], other: list[tuple[str, ...]], at: int) -> int:
        end = at
        while end < len(other) and set(other[end]) <= set(group):
            end += 1
        return end

    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            options: list[tuple[float, tuple[int, int]]] = []
            if a[i] == b[j]:
                options.append((len(a[i]) + best[i + 1][j + 1], (i + 1, j + 1)))
            else:
                if len(a[i]) > 1 and (end := stretch(a[i], b, j)) > j:
                    options.append((len({k for g in b[j:end] for k in g}) - 0.5 + best[i + 1][end], (i + 1, end)))
                if len(b[j]) > 1 and (end := stretch(b[j], a, i)) > i:
                    options.append((len({k for g in a[i:end] for k in g}) - 0.5 + best[end][j + 1], (end, j + 1)))
            top = max((o[0] for o in options), default=-1.0)
            best[i][j] = max(top, best[i + 1][j], best[i][j + 1])
            if options and top >= best[i][j]:
                move[i][j] = next(to for score, to in options if score == top)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if (to := move[i][j]) is not None:
            out.append((i, j, *to))
            i, j = to
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _keys(expression: Expression) -> list[tuple[str, ...]]:
    return [tuple(m[0] for m in members) for _, _, members in expression]


def _joined(some: Expression) -> tuple:
    """Several groups, and what they are as one: by key the members, optional where a group lacks them."""
    met: dict[str, tuple] = {}
    for _, _, members in some:
        for key, optional, repeated, inner in members:
            old = met.get(key)
            met[key] = (key, old[1] or optional, True, align(old[3], inner)) if old else (key, optional, repeated, inner)
    return tuple(met.values())


def align(a: Expression, b: Expression) -> Expression:
    """The expression that reads what either reads: what only one has becomes optional, a group meets the stretch that it
    repeats, and what is in elements is aligned in turn."""
    if a == b:
        return a
    out: list[tuple] = []
    i = j = 0
    optional = lambda groups: [(True, repeated, members) for _, repeated, members in groups]
    for i0, j0, i1, j1 in [*pairs(_keys(a), _keys(b)), (len(a), len(b), len(a), len(b))]:
        out += optional(a[i:i0]) + optional(b[j:j0])
        if i0 < len(a):
            one, two = a[i0:i1], b[j0:j1]
            left, right = _joined(one), _joined(two)
            held = {m[0]: m for m in (left if len(left) < len(right) else right)}
            members = []
            for key, lacks, repeated, inner in right if len(left) < len(right) else left:
                other = held.get(key)
                members.append((key, lacks or other[1], repeated or other[2], align(inner, other[3])) if other else (key, True, repeated, inner))
            whole = len(one) == len(two) == 1
            out.append((any(g[0] for g in (*one, *two)), any(g[1] for g in (*one, *two)) or not whole, tuple(members)))
        i, j = i1, j1
    if len(out) > LONGEST:
        return ((True, True, tuple((key, True, True, inner) for key, _, _, inner in _joined(tuple(out)))),)
    return tuple(out)


def expression_of(node: list) -> Expression:
    """What is in one page's element."""
    keys = [TEXT if isinstance(x, str) else x[0] for x in node[1:]]
    out = []
    for repeated, members in fold(keys):
        found = []
        for key, several, places in members:
            inner: Expression | None = None
            for p in places if key != TEXT else ():
                own = expression_of(node[1 + p])
                inner = own if inner is None else align(inner, own)
            found.append((key, repeated and len(places) < 2, several, inner or ()))
        out.append((False, repeated, tuple(found)))
    return tuple(out)


def shown(expression: Expression) -> str:
    """The expression as text."""
    mark = lambda optional, repeated: "*" if optional and repeated else "?" if optional else "+" if repeated else ""
    part = lambda key, inner: key if key == TEXT else f"<{key}>{shown(inner)}</{key}>"
    out = []
    for optional, repeated, members in expression:
        said = [f"({part(key, inner)}){q}" if (q := mark(o, r)) else part(key, inner) for key, o, r, inner in members]
        out.append(f"({''.join(said)}){q}" if (q := mark(optional, repeated)) else "".join(said))
    return "".join(out)


Place = tuple[str, ...]


def match(node: list, expression: Expression, at: Place = ()) -> list[tuple[Place, str]]:
    """The page's texts in order, each with its place in the wrapper: the keys of the elements around it, each with the
    number of its group. What the wrapper doesn't read has no number."""
    kids = node[1:]
    groups = fold([TEXT if isinstance(x, str) else x[0] for x in kids])
    found: list[tuple[str, Expression] | None] = [None] * len(kids)
    for i0, j0, i1, j1 in pairs(_keys(expression), [tuple(m[0] for m in members) for _, members in groups]):
        for _, members in groups[j0:j1]:
            for key, _, places in members:
                g, inner = next((g, m[3]) for g in range(i0, i1) for m in expression[g][2] if m[0] == key)
                for p in places:
                    found[p] = (f"{key}|{g}", inner)
    out = []
    for child, where in zip(kids, found, strict=True):
        name, inner = where or (TEXT if isinstance(child, str) else child[0], ())
        if isinstance(child, str):
            out.append(((*at, name), child))
        else:
            out += match(child, inner, (*at, name))
    return out


#: Elements that can be a main container.
CONTAINERS = frozenset("html body article main section div td".split())


def _tag(key: str) -> str:
    return re.split(r"[.#|]", key)[0]


def main_container(volumes: Iterable[tuple[Place, int]], share: float = 0.9) -> Place:
    """The deepest element that holds at least `share` of the text, or an article or main element with half of it.
    volumes: places of texts with their characters."""
    volume: Counter[Place] = Counter()
    total = 0
    for place, chars in volumes:
        total += chars
        for k in range(1, len(place)):
            if _tag(place[k - 1]) in CONTAINERS:
                volume[place[:k]] += chars
    marked = [p for p, n in volume.items() if n >= 0.5 * total and _tag(p[-1]) in ("article", "main")]
    held = marked or [p for p, n in volume.items() if n >= share * total]
    return max(held, key=lambda p: (len(p), volume[p], p), default=())


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def template(node: list, depth: int = 4) -> int:
    """Pages are of one template if their texts stand in the same upper containers, as far as `depth`."""
    found = set()

    def walk(x: list, path: tuple[str, ...]) -> None:
        for child in x[1:]:
            if isinstance(child, list) and len(path) < depth and _tag(child[0]) in CONTAINERS:
                walk(child, (*path, child[0]))
            else:
                found.add(path)

    walk(node, ())
    return _hash(json.dumps(sorted(found)))


def extract(node: list, wrapper: Expression | None = None, main: Place = (), constants: frozenset[int] = frozenset()) -> str:
    """A page's texts as its template's wrapper reads them, one block a line."""
    chars = lambda some: sum(len(t) for _, t in some)
    texts = found = match(node, expression_of(node) if wrapper is None else wrapper)
    if constants:
        found = [(p, t) for p, t in texts if _hash(json.dumps(p), t) not in constants]
        if 2 * chars(found) < chars(texts):
            found = texts
    inside = [(p, t) for p, t in found if p[: len(main)] == main] if main else []
    if 2 * chars(inside) < chars(found) or not inside:
        own = main_container((p, len(t)) for p, t in found)
        inside = [(p, t) for p, t in found if p[: len(own)] == own]
    return "\n".join(t for _, t in inside)


def _load(packed: str) -> Expression:
    """An expression from JSON."""

    def tuples(x):
        return tuple(map(tuples, x)) if isinstance(x, list) else x

    return tuples(json.loads(packed))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as trees, with their template and expression, as JSON."""
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            batch = whole.slice(i, 500)
            trees = [tree(x or "") for x in batch.column("html").to_pylist()]
            kinds = pa.array([template(t) for t in trees], pa.int64())
            said = [json.dumps(t, ensure_ascii=False, separators=(",", ":")) for t in trees]
            read_as = [json.dumps(expression_of(t), separators=(",", ":")) for t in trees]
            columns = [*(batch.column(c) for c in ("page_id", "url", "host")), kinds, pa.array(said, pa.string()), pa.array(read_as, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "template", "tree", "expression"])


#: Shares into which the expressions of a template are dealt to be aligned.
SHARES = 64


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, template, share and expression in; per share the expression that reads all of them, and
    their pages, out. One expression is held at a time."""
    held: tuple | None = None
    pages, reads = 0, ()

    def row() -> pa.RecordBatch:
        columns = [pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32()), pa.array([json.dumps(reads)], pa.string()), pa.array([pages], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "template", "share", "expression", "pages"])

    for batch in batches:
        for *key, packed, n in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "share", "expression", "pages")), strict=True):
            if held != tuple(key):
                if held:
                    yield row()
                held, pages, reads = tuple(key), 0, _load(packed)
            pages += n
            reads = align(reads, _load(packed))
    if held:
        yield row()


def _one_wrapper(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("share")
    reads = _load(group["expression"].iloc[0])
    for packed in group["expression"].iloc[1:]:
        reads = align(reads, _load(packed))
    return pd.DataFrame({"host": group["host"].iloc[:1], "template": group["template"].iloc[:1], "expression": [json.dumps(reads)], "pages": [int(group["pages"].sum())]})


def infer(parsed: DataFrame) -> DataFrame:
    """parsed: host, template, expression. Per host and template the wrapper: host, template, expression, pages.

    Equal expressions are counted before the shuffle. Those of a template are dealt into shares, each aligned one after
    another in their own order while they stream by, and then the shares; so the result doesn't depend on how rows are
    dealt, and no task holds more than a share's expression and SHARES of them."""
    counted = parsed.groupBy("host", "template", "expression").agg(F.count("*").alias("pages"))
    counted = counted.withColumn("share", F.pmod(F.xxhash64("expression"), F.lit(SHARES)).cast("int"))
    dealt = counted.repartition("host", "template", "share").sortWithinPartitions("host", "template", "share", "expression")
    shares = dealt.select("host", "template", "share", "expression", "pages").mapInArrow(_aligned, "host string, template long, share int, expression string, pages long")
    return shares.groupBy("host", "template").applyInPandas(_one_wrapper, "host string, template long, expression string, pages long")


class _Known:
    """Wrappers read from JSON, remembered within a batch."""

    def __init__(self) -> None:
        self.held: dict[str | None, Expression | None] = {None: None}

    def __call__(self, packed: str | None) -> Expression | None:
        if packed not in self.held:
            self.held[packed] = _load(packed)
        return self.held[packed]


_COUNTED = pa.schema([("host", pa.string()), ("template", pa.int64()), ("place", pa.string()), ("key", pa.int64()), ("text", pa.int64()), ("pages", pa.int64()), ("chars", pa.int64())])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their wrapper in; per place of a wrapper its characters, and per place and text (place null) its pages
    and characters."""
    for batch in batches:
        counts: dict[tuple, list[int]] = {}
        known = _Known()

        def add(key: tuple, pages: int, chars: int, counts=counts) -> None:
            held = counts.setdefault(key, [0, 0])
            held[0] += pages
            held[1] += chars

        for host, kind, packed, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "tree", "wrapper")), strict=True):
            met: Counter[tuple[Place, str]] = Counter(match(json.loads(packed), known(wrapper)))
            names = {p: json.dumps(p) for p in {p for p, _ in met}}
            keys = {p: _hash(host, str(kind), name) for p, name in names.items()}
            for (place, text), n in met.items():
                add((host, kind, names[place], keys[place], None), 0, n * len(text))
                add((None, None, None, keys[place], _hash(names[place], text)), 1, n * len(text))
        if counts:
            columns = [*zip(*counts, strict=True), *zip(*counts.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTED.types, strict=True)], schema=_COUNTED)


def _decide(group: pd.DataFrame) -> pd.DataFrame:
    """The main container and the constants of one wrapper, from its places (text null) and constant texts."""
    total: Counter[str] = Counter()
    varied: Counter[str] = Counter()
    constants = []
    for place, text, chars in zip(group["place"], group["text"], group["chars"], strict=True):
        if text:
            varied[place] -= chars
            constants.append(int(text))
        else:
            total[place] += chars
            varied[place] += chars
    used = varied if any(n > 0 for n in varied.values()) else total
    main = main_container((tuple(json.loads(p)), n) for p, n in used.items() if n > 0)
    return pd.DataFrame({"host": group["host"].iloc[:1], "template": group["template"].iloc[:1], "decided": [json.dumps({"main": main, "constants": sorted(constants)})]})


def decide(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """parsed pages and their templates' wrappers (host, template, wrapper, n). Per wrapper: host, template, decided."""
    met = parsed.select("host", "template", "tree").join(small_or_shuffled(found.select("host", "template", "wrapper"), SMALL), ["host", "template"])
    counted = met.mapInArrow(_statistics, "host string, template long, place string, key long, text long, pages long, chars long")
    counted = counted.groupBy("host", "template", "place", "key", "text").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    counted = stored(counted.filter("text is null or pages > 2"))
    places = counted.filter("text is null").join(found.select("host", "template", "n"), ["host", "template"])
    texts = counted.filter("text is not null").select("key", "text", "pages", F.col("chars").alias("said"))
    constants = places.select("host", "template", "place", "n", "key").join(texts, "key").filter("10 * pages >= 9 * n")
    # as text, for pandas has no whole numbers beside nulls
    rows = places.select("host", "template", "place", F.lit("").alias("text"), "chars").unionByName(constants.select("host", "template", "place", F.col("text").cast("string").alias("text"), F.col("said").alias("chars")))
    return rows.groupBy("host", "template").applyInPandas(_decide, "host string, template long, decided string")


#: Wrappers are broadcast up to this number of templates (counted before).
SMALL = 20_000


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known, decisions = _Known(), {None: ((), frozenset())}
        out = []
        for packed, wrapper, decided in zip(*(batch.column(c).to_pylist() for c in ("tree", "wrapper", "decided")), strict=True):
            if decided not in decisions:
                read_in = json.loads(decided)
                decisions[decided] = tuple(read_in["main"]), frozenset(read_in["constants"])
            out.append(extract(json.loads(packed), known(wrapper), *decisions[decided]))
        n = pa.array([len(x) for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    kind = source.schema["page_id"].dataType.simpleString()
    parsed = stored(source.mapInArrow(_parsed, f"page_id {kind}, url string, host string, template long, tree string, expression string"))
    found = stored(infer(parsed.select("host", "template", "expression")).filter("pages > 1"))
    found = found.select("host", "template", F.col("expression").alias("wrapper"), F.col("pages").alias("n"))
    decided = decide(parsed, found)
    table = stored(found.join(decided, ["host", "template"], "left").select("host", "template", "wrapper", "decided"))
    joined = parsed.select("page_id", "url", "host", "template", "tree").join(small_or_shuffled(table, SMALL), ["host", "template"], "left")
    return joined.select("page_id", "url", "tree", "wrapper", "decided").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
