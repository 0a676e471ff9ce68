"""HTML main text by wrapper induction.

Pages become trees of their block elements; runs of equal siblings fold into one repeated node. The most frequent tree of
a host is its reference, and simple tree matching aligns every other tree of the host with it. Over all pages of the host, an aligned
node whose text never changes belongs to the template, a varying one is a slot; nodes that align with none of the
reference are judged within their own tree. A text that stands at one path of element keys on more than two thirds of
the host's pages with that path is template as well, beside varying siblings and across layouts. Slots become content unless their
place says otherwise (navigation, page header and footer, asides, forms, notices, adverts, reader comments, by element,
role, class or id); where pages mark an article or main element, content is what lies inside it, and all text of an
article that is not furniture by its place stays, also where it is the same on many pages.

Each page's statistics are added up per (host, tree) before the shuffle; trees are aligned once for each pair that
occurs; the pages are then parsed again and joined with their tree's kept nodes, a join that Spark broadcasts or shuffles by size.

Defined results: null and empty html, and pages without content, give an empty text; very deep and very wide pages cost no more
a node than others, but for children of two trees that differ, which are compared pair by pair of their distinct subtrees; of
equally frequent trees of a host the one of the largest key is the reference; a host of one page, or of copies of
one page, has no template, and a template text stands on at least two different pages; a null url is a host of its own; pages repeated whole each get their row; broken markup is closed as browsers do for
paragraphs, list items and table cells; formulas, drawings and embedded objects are text of their block, buttons and other
controls are not; empty tables give empty tables; extra columns are dropped, whatever their names."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, small_batches

_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>)""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|[\s/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul template select button".split()
)
#: Elements that never hold main text: menus, footers, sidebars, forms and their controls, notices, and what is not shown.
DROPPED = set("head nav footer aside form fieldset menu template select button dialog".split())
#: Words of class, id or role that name page furniture.
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus replies respond widget toolbar pagination pager search copyright disclaimer hidden complementary contentinfo".split()
)
#: Words that name the content root.
ROOT = {"main", "article"}
TELLING = FURNITURE | ROOT | {"header", "topbar"}
#: Characters of a class, id or role that stand in a node's key as they are.
LONGEST_VALUE = 60
_CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_NO_P_CLOSE = {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "template", "select", "button"}


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=8).digest()


def _number(data: bytes) -> int:
    return int.from_bytes(_digest(data), "big", signed=True)


def names_in(value: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", value)}


def short(value: str) -> str:
    """An attribute's value for a key: long ones as their telling words and a number that stands for the whole value."""
    if len(value) <= LONGEST_VALUE:
        return value
    return " ".join([*sorted(names_in(value) & TELLING), str(int.from_bytes(blake2b(value.encode(), digest_size=8).digest(), "big"))])


class Node:
    __slots__ = ("tag", "key", "children", "slot", "form", "size", "path")

    def __init__(self, tag: str, key: str, above: bytes = b""):
        self.tag, self.key, self.children = tag, key, []
        self.path = _digest(above + key.encode())  # the keys from the root down


def parse(html: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The block tree, and the blocks of text (node, text, characters inside links) in page order."""
    root = Node("html", "html")
    stack, blocks, buf, links, in_link, pos = [root], [], [], 0, 0, 0
    opened: Counter = Counter()  # elements on the stack, so that a tag that is not open is not looked for

    def flush() -> None:
        nonlocal links
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                blocks.append((stack[-1], text, min(links, len(text))))
            buf.clear()
            links = 0

    def say(piece: str) -> None:
        nonlocal links
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            buf.append(piece)
            if in_link:
                links += len(piece)

    def pop_to(i: int) -> None:
        flush()
        while len(stack) > i:
            opened[stack.pop().tag] -= 1

    def find(tags: set[str], stop: set[str]) -> int:
        if not any(opened[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    search = _TAG.search
    while m := search(html, pos):
        say(html[pos : m.start()])
        pos = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            if end == "a":
                in_link = max(0, in_link - 1)
            elif end == "br":
                buf.append(" ")
            elif end in BLOCK and end not in ("html", "body"):
                if i := find({end}, set() if end != "p" else {"button", "td", "th", "table", "object"}):
                    in_link = 0
                    pop_to(i)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if raw := _RAW_END.get(tag):
            close = raw.search(html, pos)
            pos = close.end() if close else len(html)
        elif tag in ("br", "hr"):
            if tag == "br":
                buf.append(" ")
            else:
                flush()
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK:
            flush()
            in_link = 0
            if tag in ("html", "body"):
                continue
            if tag in _CLOSED_BY and (i := find(_CLOSED_BY[tag], _SCOPE[tag])):
                pop_to(i)
            if tag not in _NO_P_CLOSE and (i := find({"p"}, {"button", "td", "th", "table", "object"})):
                pop_to(i)
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                pop_to(len(stack) - 1)
            if stack[-1].tag == "head" and tag != "template":
                pop_to(len(stack) - 1)
            key = tag
            if m[3] and "=" in m[3]:
                found = sorted((a.lower(), re.sub(r"\d+", "0", x or y or z)) for a, x, y, z in _ATTR.findall(m[3]))
                key += "".join(f"[{a}={short(re.sub(r'[^0-9A-Za-z_ -]', '_', v))}]" for a, v in found)
            node = Node(tag, key, stack[-1].path)
            stack[-1].children.append(node)
            stack.append(node)
            opened[tag] += 1
    say(html[pos:])
    flush()
    return root, blocks


def fold(node: Node) -> str:
    """The skeleton: keys of block elements, equal neighbouring siblings folded into one. A node's form is a number of its key and
    its children's forms, so that a deep tree costs no more per node than a flat one."""
    todo, order = [node], []
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    for n in reversed(order):
        n.size, forms, last = 1, [n.key.encode()], None
        for c in n.children:
            if c.form != last:
                last = c.form
                forms.append(last)
                n.size += c.size
        n.form = blake2b(b"\0".join(forms), digest_size=16).digest()
    out: list[str] = []
    walk: list[Node | None] = [node]
    while walk:
        n = walk.pop()
        if n is None:
            out.append(")")
            continue
        out += [n.key, "("]
        walk.append(None)
        walk += [c for c, left in zip(reversed(n.children), [*reversed(n.children[:-1]), None], strict=True) if left is None or c.form != left.form] if n.children else []
    return "".join(out)


def number(node: Node) -> None:
    """Slots: places of the skeleton in order; folded siblings share theirs."""
    node.slot, todo = 0, [node]
    while todo:
        n = todo.pop()
        at, last, start = n.slot + 1, None, 0
        for c in n.children:
            if c.form != last:
                last, start = c.form, at
                at += c.size
            c.slot = start
            todo.append(c)


def read(html: str | None) -> tuple[str, list[tuple[int, str, int, int, int]]]:
    """The skeleton, and of each block slot, text, link characters and the numbers of its path and of path and text."""
    root, blocks = parse(html or "")
    form = fold(root)
    number(root)
    return form, [(n.slot, text, links, int.from_bytes(n.path, "big", signed=True), _number(n.path + text.encode("utf-8", "surrogatepass"))) for n, text, links in blocks]


def tree_of(form: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Keys, children and parents by slot of a skeleton."""
    keys, kids, parents, stack, at = [], [], [], [], 0
    for m in re.finditer(r"([^()]+)\(|\)", form):
        if m[1] is None:
            stack.pop()
            continue
        keys.append(m[1])
        kids.append([])
        parents.append(stack[-1] if stack else -1)
        if stack:
            kids[stack[-1]].append(at)
        stack.append(at)
        at += 1
    return keys, kids, parents


def gains(w: np.ndarray) -> np.ndarray:
    """The most that children up to each column can match with all rows, in order; w: what each pair matches."""
    best = np.zeros(w.shape[1] + 1, np.int64)
    for row in w:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
    return best


def paired(w: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, both ascending, of the largest sum, in memory linear in the sides: rows are halved, and the columns
    are cut where both halves together match most."""
    out, todo = [], [(0, w.shape[0], 0, w.shape[1])]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if j - i == 1:
            at = int(w[i, k:m].argmax())
            if w[i, k + at]:
                out.append((i, k + at))
            continue
        half = (i + j) // 2
        upper, lower = gains(w[i:half, k:m]), gains(w[half:j, k:m][::-1, ::-1])[::-1]
        cut = k + int((upper + lower).argmax())
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return out


def match(a: str, b: str) -> list[int]:
    """Simple tree matching of skeleton a with b: for each slot of b the aligned slot of a, or -1.

    Subtrees are known by number, equal ones by the same, and a pair of numbers is matched once: equal subtrees match whole,
    and children that are equal at both ends of two lists match each other before the rest is compared pair by pair."""
    (ka, ca, pa_), (kb, cb, pb) = tree_of(a), tree_of(b)
    if a == b:
        return list(range(len(kb)))
    known: dict[tuple, int] = {}
    keys, kids, sizes = [], [], []

    def numbered(own: list[str], below: list[list[int]]) -> list[int]:
        names = [0] * len(own)
        for n in range(len(own) - 1, -1, -1):  # children stand behind their parent
            form = (own[n], *(names[c] for c in below[n]))
            if (name := known.setdefault(form, len(keys))) == len(keys):
                keys.append(own[n])
                kids.append([names[c] for c in below[n]])
                sizes.append(1 + sum(sizes[k] for k in kids[-1]))
            names[n] = name
        return names

    na, nb = numbered(ka, ca), numbered(kb, cb)
    memo: dict[tuple[int, int], int] = {}

    def ends(x: list[int], y: list[int]) -> tuple[int, int]:
        """Equal children at the beginning and at the end of two lists."""
        most, i, j = min(len(x), len(y)), 0, 0
        while i < most and x[i] == y[i]:
            i += 1
        while j < most - i and x[-1 - j] == y[-1 - j]:
            j += 1
        return i, j

    def weights(x: list[int], y: list[int]) -> np.ndarray | None:
        """What each pair of children matches; None while some pair below is not known yet, which then is put on the list."""
        ux, ix = np.unique(np.array(x, np.int64), return_inverse=True)
        uy, iy = np.unique(np.array(y, np.int64), return_inverse=True)
        w, need = np.zeros((len(ux), len(uy)), np.int64), []
        for i, u in enumerate(ux.tolist()):
            for j, v in enumerate(uy.tolist()):
                if u == v:
                    w[i, j] = sizes[u]
                elif keys[u] == keys[v]:
                    if (u, v) in memo:
                        w[i, j] = memo[u, v]
                    else:
                        need.append((u, v))
        if need:
            todo.extend(need)
            return None
        return w[ix][:, iy]

    def inner(u: int, v: int) -> tuple[list[int], list[int], int, int]:
        i, j = ends(kids[u], kids[v])
        return kids[u][i : len(kids[u]) - j], kids[v][i : len(kids[v]) - j], i, j

    if keys[na[0]] != keys[nb[0]]:
        return [-1] * len(kb)
    todo = [(na[0], nb[0])]
    while todo:
        u, v = todo[-1]
        if (u, v) in memo:
            todo.pop()
            continue
        x, y, i, j = inner(u, v)
        if not x or not y:
            w = np.zeros((1, 1), np.int64)
        elif (w := weights(x, y)) is None:
            continue
        memo[u, v] = int(gains(w)[-1]) + 1 + sum(sizes[k] for k in [*kids[u][:i], *kids[u][len(kids[u]) - j :]])
        todo.pop()
    out = [-1] * len(kb)
    pairs = [(0, 0)]
    while pairs:
        p, q = pairs.pop()
        out[q] = p
        if na[p] == nb[q]:  # equal subtrees: slot by slot
            for k in range(1, sizes[na[p]]):
                out[q + k] = p + k
            continue
        x, y, i, j = inner(na[p], nb[q])
        left, right = ca[p], cb[q]
        pairs += zip(left[:i], right[:i], strict=True)
        pairs += zip(left[len(left) - j :], right[len(right) - j :], strict=True)
        if x and y:
            pairs += [(left[i + s], right[i + t]) for s, t in paired(weights(x, y))]
    return out


def words_of(key: str) -> set[str]:
    return names_in(" ".join(re.findall(r"\[\w+=([^\]]*)\]", key)))


def places(form: str) -> list[tuple[bool, bool, bool]]:
    """For each slot: inside page furniture; inside a content root; inside an article."""
    keys, _, parents = tree_of(form)
    out: list[tuple[bool, bool, bool]] = []
    for key, p in zip(keys, parents, strict=True):
        tag = key.split("[")[0]
        drop, root, article = out[p] if p >= 0 else (False, False, False)
        names = words_of(key)
        role = names & ROOT if "role=" in key else set()
        if tag in ROOT or role:
            root, article = True, article or tag == "article" or "article" in role
        elif tag in DROPPED or tag != "html" and names & FURNITURE or tag == "header" and not root or not root and names & {"header", "topbar"}:
            drop = True
        out.append((drop, root, article))
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_TALLY = [
    ("host", "string"), ("form_key", "string"), ("form", "string"), ("slot", "int"), ("path", "bigint"), ("item", "bigint"), ("pages", "bigint"),
    ("first", "bigint"), ("last", "bigint"), ("least", "bigint"), ("greatest", "bigint"), ("chars", "bigint"), ("links", "bigint"),
]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (host, skeleton, slot): pages, least and greatest page hash, least and greatest text hash, characters and link characters;
    per (host, path) and (host, path, text): pages and page hashes; added up while memory is small."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}

    def out(sums: dict) -> pa.RecordBatch:
        rows = []
        for (h, f, *key), v in sums.items():
            rows.append((h, f and md5(f.encode()).hexdigest(), None if key[0] else f, *key, *v))
        cols = list(zip(*rows, strict=True)) or [[]] * len(_TALLY)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, _TALLY, strict=True)], names=[n for n, _ in _TALLY])

    sums: dict = {}
    texts: dict = {}

    def add(to: dict, key: tuple, page: int, text: int = 0, chars: int = 0, links: int = 0) -> None:
        old = to.get(key)
        to[key] = (1, page, page, text, text, chars, links) if old is None else (
            old[0] + 1, min(old[1], page), max(old[2], page), min(old[3], text), max(old[4], text), old[5] + chars, old[6] + links
        )

    for b in batches:
        for url, html in zip(b.column(0), b.column(1), strict=True):
            host = host_of(url.as_py())
            form, blocks = read(html.as_py())
            page = _number("\n".join(text for _, text, _, _, _ in blocks).encode("utf-8", "surrogatepass"))
            slots: dict[int, list] = {0: [[], 0, 0]}
            for slot, text, links, _, _ in blocks:
                t = slots.setdefault(slot, [[], 0, 0])
                t[0].append(text)
                t[1] += len(text)
                t[2] += links
            for slot, (parts, chars, links) in slots.items():
                add(sums, (host, form, slot, None, None), page, _number("\n".join(parts).encode("utf-8", "surrogatepass")), chars, links)
            for path, item in {(x[3], i) for x in blocks for i in (None, x[4])}:
                add(texts, (host, None, -1, path, item), page)
            if len(sums) > 50_000:
                yield out(sums)
                sums = {}
            if len(texts) > 100_000:
                yield out(texts)
                texts = {}
    yield out(sums)
    yield out(texts)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, form, reference) -> one row per slot."""
    memo: dict = {}
    for b in batches:
        rows = []
        for host, key, form, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (form, ref) not in memo:
                if len(memo) > 5000:
                    memo.clear()
                memo[form, ref] = [(i, r, *at) for i, (r, at) in enumerate(zip(match(ref, form), places(form), strict=True))]
            rows += [(host, key, *x) for x in memo[form, ref]]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "form_key", "slot", "ref_slot", "furniture", "rooted", "article"])


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, form_key, keep, common): for each tree of each host, which slots are content (0 no, 1 unless the text is common
    on the host, 2 always); its host's template texts by path. Tables that are joined by host or tree are
    plain sides of their joins, so that a host with very many pages can be split."""
    small_batches(pages.sparkSession)
    tally = pages.select("url", "html").mapInArrow(lean(_tally), ", ".join(f"{n} {k}" for n, k in _TALLY))
    sums = tally.groupBy("host", "form_key", "slot", "path", "item").agg(
        F.max("form").alias("form"), F.sum("pages").alias("pages"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    # texts of one page alone, most of them, end here; the rest is used several times below and the pages are parsed for it once
    sums = checkpointed(sums.where("item is null or first != last"))
    places_ = sums.where("path is not null")
    of_path = places_.where("item is null").select("host", "path", F.col("pages").alias("all_pages"))
    common = places_.where("item is not null").join(of_path, ["host", "path"]).where(F.col("pages") * 3 > F.col("all_pages") * 2)
    common = common.groupBy("host").agg(F.collect_set("item").alias("common"))
    sums = sums.where("path is null").drop("path", "item")
    trees = sums.where("slot = 0").select("host", "form_key", "form", "pages")
    refs = checkpointed(trees.groupBy("host").agg(F.max_by("form", F.struct("pages", "form_key")).alias("ref")))
    slots = trees.select("host", "form_key", "form").join(refs, "host").mapInArrow(lean(_align), "host string, form_key string, slot int, ref_slot int, furniture boolean, rooted boolean, article boolean")
    slots = checkpointed(slots.join(sums.drop("form"), ["host", "form_key", "slot"], "left"))
    # per aligned node of the host: sums that are added up before any shuffle, a row for each node of the reference
    same = slots.where("ref_slot >= 0").groupBy("host", "ref_slot").agg(
        F.sum("pages").alias("n"), (F.min("least") == F.max("greatest")).alias("one_text"), (F.min("first") != F.max("last")).alias("several"), F.sum("chars").alias("all_chars"), F.sum("links").alias("all_links"), F.min("furniture").alias("always_furniture")
    )
    same = checkpointed(same.withColumn("constant", F.coalesce(F.col("one_text") & F.col("several"), F.lit(False))))
    # a host varies if the text of some node does; copies of one page say nothing about its template
    some = same.where(~F.col("one_text") & ~F.col("always_furniture")).select("host").unionByName(slots.where(~F.col("furniture") & (F.col("least") != F.col("greatest"))).select("host"))
    varies = checkpointed(some.distinct().withColumn("varies", F.lit(True)))
    slots = slots.join(same.drop("always_furniture", "several"), ["host", "ref_slot"], "left").join(varies, "host", "left")
    own = (F.col("least") == F.col("greatest")) & (F.col("first") != F.col("last"))  # of nodes that align with none of the reference
    share = F.coalesce(F.try_divide(F.coalesce("all_links", "links"), F.coalesce("all_chars", "chars")), F.lit(0.0))
    has_root = F.max(F.col("rooted") & ~F.col("furniture") & (F.coalesce("chars", F.lit(0)) > 0)).over(Window.partitionBy("host", "form_key"))
    template = F.coalesce(F.coalesce("constant", own) & F.col("varies"), F.lit(False))
    keep = ~F.col("furniture") & F.when(has_root, F.col("rooted") & (F.col("article") | ~template)).otherwise(~template & (share < 0.5))
    level = F.when(~keep, 0).when(has_root & F.col("article"), 2).otherwise(1)
    told = slots.withColumn("keep", level).groupBy("host", "form_key").agg(F.array_sort(F.collect_list(F.struct("slot", "keep"))).alias("k"))
    common = checkpointed(common.join(varies.select("host"), "host"))
    return checkpointed(told.join(common, "host", "left").select("host", "form_key", F.transform("k", lambda x: x["keep"]).alias("keep"), "common"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("item", pa.int64())]))
    for b in batches:
        step = 200
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            hosts, keys, blocks = [], [], []
            for url, html in zip(part.column(1), part.column(2), strict=True):
                form, found = read(html.as_py())
                hosts.append(host_of(url.as_py()))
                keys.append(md5(form.encode()).hexdigest())
                blocks.append([{"slot": s, "text": t, "item": i} for s, t, _, _, i in found])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(blocks, block)], names=["page_id", "url", "host", "form_key", "blocks"])


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, blocks): the kept blocks and their text, joined by one space."""
    kinds = dict(pages.dtypes)
    small_batches(pages.sparkSession)
    seen = pages.select("page_id", "url", "html").mapInArrow(lean(_read), f"page_id {kinds['page_id']}, url {kinds['url']}, host string, form_key string, blocks array<struct<slot:int,text:string,item:bigint>>")
    out = seen.join(wrappers(pages), ["host", "form_key"], "left")
    level = lambda x: F.element_at("keep", x["slot"] + 1)
    kept = F.filter("blocks", lambda x: (level(x) == 2) | (level(x) == 1) & ~F.coalesce(F.array_contains("common", x["item"]), F.lit(False)))
    return out.select("page_id", "url", F.transform(kept, lambda x: x["text"]).alias("blocks")).withColumn("text", F.coalesce(F.array_join("blocks", " "), F.lit("")))
