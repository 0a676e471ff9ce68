"""Suffix-array dedup: remove every byte that lies in a string of `length` bytes which also starts in a document of a smaller id.

Suffixes are compared by their longest common extension, found by binary search over prefix polynomial hashes, so a
comparison takes about six steps whatever the texts; a mergesort by these comparisons brings equal ones together, and
what the hashes call equal is confirmed on the bytes. So that each suffix need not be sent with its `length` bytes, every
window of `length` bytes names one anchor inside itself, the smallest-hashed k-gram (k = length // 2): equal windows name equal
anchors. Neighbouring windows with one anchor make a run (at most length - k + 1 windows); about one anchor falls on 13 bytes.

1. Each bucket of documents tells the anchors' parts its anchors: hash, smallest id, whether there are more, number of runs.
2. A part answers which anchors stand in documents of different ids. Nothing is removed by this answer.
3. The runs of these anchors go to the part with their bytes. It sorts the runs as suffixes, confirms equal ones byte
   by byte, and where an anchor has different runs sorts their windows as suffixes and confirms equal ones again. Each
   class of equal windows keeps its smallest id; windows of larger ids go.
4. Each bucket cuts the bytes out of its documents. Runs that are repeated inside a bucket are sent once, after
   their bytes were compared there.

A passage with ever new surroundings has an anchor with as many runs as documents at each of its ends. An anchor with
more than HOT_RUNS runs in a bucket, or HOT_TOTAL in all, is hot: its runs are sent window by window to parts
named by the window itself, so that they spread.

Rows that travel are blobs of one bucket for one part, never empty, so there are at most as many as anchors; all steps
work on what a bucket or part holds, and are one query: lost work is recomputed from the input. Buckets are dealt by id and text;
rows that are repeated whole are one row until the end.

Defined results: null and empty texts have 0 bytes; documents of equal id do not remove from each other; a null id counts as the
largest one, 2**63 - 1; ids of any size stay as they are; ties between windows of one id remove nothing; repeated rows
each get their row; texts shorter than `length` stay whole, and very long ones are one document of a bucket; empty tables give
empty tables; columns other than doc_id and text are not read and not returned."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import INVERSE, buffers, mixed, powers, prefix_hashes, span_hashes
from .common import checkpointed, lean_group, small_batches, text_slices

BUCKET_BYTES = 4 << 20
#: Bytes worked on at once inside a bucket or part.
BLOCK_BYTES = 1 << 20
LARGEST = np.iinfo(np.int64).max
#: Runs of one anchor in a bucket, and in all buckets, beyond which the anchor is hot.
HOT_RUNS, HOT_TOTAL = 16, 4096
#: How the bytes of runs are packed.
CODEC = "zstd"
#: Answers for an anchor: in documents of one id alone; in several; in several and hot.
FREE, SHARED, HOT = 0, 1, 2


def runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of one block: first window, last window, anchor, anchor hash and run hash of each run."""
    k = length // 2
    n, w = len(data), length - k + 1
    if n < length:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    h = prefix_hashes(data)
    gram = h[k:] - h[:-k]
    gram *= powers(INVERSE, n - k + 1)
    gram = mixed(gram)
    least = gram & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)  # the leftmost of equal ones
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    m = n - length + 1
    anchor = np.minimum(least[:m], least[w - span : w - span + m]) & np.uint64(0xFFFFFFFF)
    cut = np.zeros(m + 1, np.int32)
    ends = off[1:]
    np.add.at(cut, np.minimum(np.maximum(off[:-1], ends - length + 1), m), 1)
    np.add.at(cut, np.minimum(ends, m), -1)
    whole = np.cumsum(cut[:-1]) == 0  # windows inside one document
    edge = np.ones(m, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], m) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    a = anchor[first].astype(np.int64)
    form = ((a - first) * 64 + (last - first)).astype(np.uint64)
    return first, last, a, gram[a], mixed(span_hashes(h, first, last + length) ^ (form * np.uint64(0x9E3779B97F4A7C15)))


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from x on are those from y on."""
    out = np.ones(len(x), bool)
    if not len(x):
        return out
    wide = int(size.max())
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(wide, np.uint8))), wide)
    step = max(1, (4 << 20) // wide)
    for i in range(0, len(x), step):
        k = slice(i, i + step)
        out[k] = ((view[x[k]] == view[y[k]]) | (np.arange(wide) >= size[k, None])).all(axis=1)
    return out


def part_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes: names in order are parts in order."""
    return ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


#: What of a hash travels beside the part: the last five bytes.
FIVE = np.uint64((1 << 40) - 1)


class Bucket:
    """The documents of a bucket in order of id, their runs, the distinct runs, and the anchors in order of part and hash."""

    def __init__(self, table: pa.Table, length: int, parts: int):
        table = table.combine_chunks()
        column = table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id")
        null = np.asarray(column.is_null())
        key = np.asarray(pc.fill_null(column.cast(pa.int64()), int(LARGEST)))
        text = table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text")
        order = np.argsort(key, kind="stable")
        if len(np.unique(key)) < len(key):  # equal ids: by text, so that each pass sees one order
            order = np.array(sorted(range(len(key)), key=lambda i: (key[i], null[i], text[i].as_py() or "")), np.int64)
        self.rows, self.ids, self.null = order, key[order], null[order]
        self.off, self.data = buffers(text.take(pa.array(order)))
        blocks = [[] for _ in range(5)]
        for i, j in text_slices(text.take(pa.array(order)), BLOCK_BYTES):
            lo, hi = self.off[i], self.off[j]
            for at, x in enumerate(runs(self.data[lo:hi], self.off[i : j + 1] - lo, length)):
                blocks[at].append(x + lo if at < 3 else x)
        if not blocks[0]:
            blocks = [[np.zeros(0, np.int64)]] * 3 + [[np.zeros(0, np.uint64)]] * 2
        self.first, self.last, self.anchor, gram, run = map(np.concatenate, blocks)
        # anchors are the smallest by their first four bytes, which are small numbers; the last four are even and come first here
        self.hash = (gram << np.uint64(32)) | (gram >> np.uint64(32))
        self.doc = np.searchsorted(self.off, self.first, "right") - 1
        self.part = part_of(self.hash, parts)
        while True:
            by = np.argsort(self.hash, kind="stable")  # documents stay in order
            g = self.hash[by]
            several = np.flatnonzero(np.append(g[1:] == g[:-1], False) | np.insert(g[1:] == g[:-1], 0, False)) if len(g) else by
            by[several] = by[several][np.lexsort((run[by[several]], g[several]))]
            g, r = self.hash[by], run[by]
            new = np.insert((g[1:] != g[:-1]) | (r[1:] != r[:-1]), 0, True) if len(by) else np.zeros(0, bool)
            #: Position of each distinct run's first occurrence, and the distinct run of each run.
            self.lead = by[new]
            self.of = np.empty(len(by), np.int64)
            self.of[by] = np.cumsum(new) - 1
            again = by[~new]
            lead = self.lead[self.of[again]]
            size = self.last - self.first + length
            differ = again[(size[again] != size[lead]) | ~same_bytes(self.data, self.first[again], self.first[lead], size[again])]
            if not len(differ):
                break
            for i in differ:  # another run of the same hash: named by its bytes
                run[i] = int.from_bytes(hashlib.blake2b(self.data[self.first[i] : self.last[i] + length].tobytes(), digest_size=8).digest(), "little")
        #: The anchors: where the distinct runs of each begin, smallest id, whether there are several ids, number of runs.
        g = self.hash[self.lead]
        self.opens = np.flatnonzero(np.insert(g[1:] != g[:-1], 0, True)) if len(g) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(self.opens, len(g)))
        self.anchor_part = self.part[self.lead[self.opens]]
        at = np.flatnonzero(np.insert(self.hash[by][1:] != self.hash[by][:-1], 0, True)) if len(by) else self.opens
        ids = self.ids[self.doc[by]]
        self.least = np.minimum.reduceat(ids, at) if len(at) else ids
        self.several = (np.maximum.reduceat(ids, at) > self.least) if len(at) else np.zeros(0, bool)
        #: A run of a larger id than its first is known from that.
        self.known = self.ids[self.doc] > self.ids[self.doc[self.lead]][self.of] if len(by) else np.zeros(0, bool)


def five(x: np.ndarray) -> bytes:
    """Five bytes a number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unfive(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").reshape(-1)


SEND = "part bigint, bucket bigint, gram binary, runs binary, ids binary"
ANSWER = "bucket bigint, part bigint, code binary"
BYTES = "part bigint, bucket bigint, entry binary, shift binary, gram binary, lead binary, size binary, ids binary, bytes binary"
WINDOWS = "bucket bigint, entry binary, shift binary, mask binary"


def packed(ids: np.ndarray) -> bytes:
    """The ids in as few bytes each as the largest asks for, eight where one is negative."""
    wide = 8 if ids.min() < 0 else max(1, -(-int(ids.max()).bit_length() // 8))
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpacked(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    raw = np.frombuffer(b, np.uint8).reshape(n, -1)
    out[:, : raw.shape[1]] = raw
    return out.view("<i8").reshape(-1)


def rows(schema: str, columns: list[list]) -> pa.Table:
    kinds = [(c.split()[0], pa.int64() if c.split()[1] == "bigint" else pa.binary()) for c in schema.split(", ")]
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def ranges(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of a sorted array of parts: only those that occur."""
    at = np.flatnonzero(np.insert(part[1:] != part[:-1], 0, True)) if len(part) else part
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)] if len(at) else [], strict=True))


def send(table: pa.Table, length: int, parts: int) -> pa.Table:
    b = Bucket(table, length, parts)
    bucket, out = table.column("bucket")[0].as_py(), [[] for _ in range(5)]
    gram = (b.hash[b.lead[b.opens]] & FIVE) if len(b.opens) else np.zeros(0, np.uint64)
    runs_ = (np.minimum(b.count, 127) | np.where(b.several, 128, 0)).astype(np.uint8)
    for p, i, j in ranges(b.anchor_part):
        for c, x in zip(out, (p, bucket, five(gram[i:j]), runs_[i:j].tobytes(), packed(b.least[i:j])), strict=True):
            c.append(x)
    return rows(SEND, out)


def answer(table: pa.Table) -> pa.Table:
    """Of each anchor whether it stands in documents of different ids; buckets without any such anchor get no row."""
    buckets = table.column("bucket").to_pylist()
    runs_ = [np.frombuffer(x, np.uint8) for x in table.column("runs").to_pylist()]
    ids = np.concatenate([unpacked(x, len(n)) for x, n in zip(table.column("ids").to_pylist(), runs_, strict=True)])
    gram = unfive(b"".join(table.column("gram").to_pylist()))
    each, runs_ = [len(n) for n in runs_], np.concatenate(runs_)
    by = np.argsort(gram, kind="stable")
    at = np.flatnonzero(np.insert(gram[by][1:] != gram[by][:-1], 0, True))
    size = np.diff(np.append(at, len(by)))
    shared = (np.bitwise_or.reduceat(runs_[by], at) >= 128) | (np.minimum.reduceat(ids[by], at) < np.maximum.reduceat(ids[by], at))
    n = (runs_ & 127).astype(np.int64)[by]
    hot = (np.maximum.reduceat(n, at) > HOT_RUNS) | (np.add.reduceat(n, at) > HOT_TOTAL)
    code = np.empty(len(by), np.uint8)
    code[by] = np.repeat(np.where(shared, np.where(hot, HOT, SHARED), FREE).astype(np.uint8), size)
    cuts = np.concatenate(([0], np.cumsum(each)))
    part = table.column("part")[0].as_py()
    told = [(b, part, code[i:j].tobytes()) for b, i, j in zip(buckets, cuts[:-1], cuts[1:], strict=True) if code[i:j].any()]
    return rows(ANSWER, [list(c) for c in zip(*told, strict=True)] or [[], [], []])


def codes(b: Bucket, answers: pa.Table) -> np.ndarray:
    """The answer to the anchor of each distinct run."""
    code, at = np.zeros(len(b.opens), np.uint8), {p: (i, j) for p, i, j in ranges(b.anchor_part)}
    for p, c in zip(answers.column("part").to_pylist(), answers.column("code").to_pylist(), strict=True):
        i, j = at[p]
        code[i:j] = np.frombuffer(c, np.uint8)
    return np.repeat(code, b.count)


def send_bytes(docs: pa.Table, answers: pa.Table, length: int, parts: int) -> pa.Table:
    if not len(docs) or not len(answers):
        return rows(BYTES, [[] for _ in range(9)])
    b = Bucket(docs, length, parts)
    code, out = codes(b, answers), [[] for _ in range(9)]
    bucket = docs.column("bucket")[0].as_py()
    # runs of shared anchors go as they are; those of hot ones as single windows, named and dealt by their own hash
    entry = np.flatnonzero(code == SHARED)
    lead = b.lead[entry]
    first, size, anchor = b.first[lead], b.last[lead] - b.first[lead], b.anchor[lead] - b.first[lead]
    part, gram, shift, doc = b.part[lead], b.hash[lead] & FIVE, np.zeros(len(lead), np.int64), b.doc[lead]
    if len(hot := np.flatnonzero(code == HOT)):
        lead = b.lead[hot]
        n = b.last[lead] - b.first[lead] + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(b.first[lead], n) + nth
        name = np.fromiter((int.from_bytes(hashlib.blake2b(b.data[i : i + length].tobytes(), digest_size=8).digest(), "little") for i in start), np.uint64, len(start))
        zero = np.zeros(len(start), np.int64)
        entry, shift, first = np.concatenate((entry, np.repeat(hot, n))), np.concatenate((shift, nth)), np.concatenate((first, start))
        size, anchor, doc = np.concatenate((size, zero)), np.concatenate((anchor, zero)), np.concatenate((doc, np.repeat(b.doc[lead], n)))
        part = np.concatenate((part, part_of(name, parts)))
        gram = np.concatenate((gram, name & FIVE))
    by = np.argsort(part, kind="stable")
    for p, i, j in ranges(part[by]):
        at = by[i:j]
        text = b"".join(b.data[i : i + k + length].tobytes() for i, k in zip(first[at], size[at], strict=True))
        small = lambda x: x[at].astype(np.uint8).tobytes()  # noqa: E731, B023
        row = (p, bucket, entry[at].astype("<u4").tobytes(), small(shift), five(gram[at]), small(anchor), small(size), packed(b.ids[doc[at]]), pa.compress(text, CODEC, asbytes=True))
        for col, x in zip(out, row, strict=True):
            col.append(x)
    return rows(BYTES, out)


class SuffixOrder:
    """Suffix comparison by hashes over one buffer."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.h, self.inv = prefix_hashes(data), powers(INVERSE, len(data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """Longest common extension up to length, by binary search over the prefix hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64) if length is None else length.copy()
        hx, hy, ix, iy = self.h[x], self.h[y], self.inv[x], self.inv[y]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.h[x + mid] - hx) * ix == (self.h[y + mid] - hy) * iy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, x: np.ndarray, y: np.ndarray, tie: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether suffix y stands before x; tie where they are equal over length."""
        n = self.common(x, y, length)
        full = n >= length
        n = np.minimum(n, length - 1)
        return np.where(full, tie, self.data[y + n] < self.data[x + n])

    def sort(self, at: np.ndarray, seg: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """Bottom-up mergesort inside each segment (seg is ascending, length one for each segment); every element finds its place in
        the other half by binary search. The suffixes in order."""
        return at[self.order(at, seg, np.full(len(at), self.length) if length is None else length)]

    def order(self, at: np.ndarray, seg: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.insert(seg[1:] != seg[:-1], 0, True)) if len(seg) else seg
        size = np.diff(np.append(first, len(seg)))
        base, n = np.repeat(first, size), np.repeat(size, size)
        i = np.arange(len(at)) - base
        width, by = 1, np.arange(len(at))
        while len(size) and width < size.max():
            live = np.flatnonzero(n > width)
            block = i[live] // width
            lo = np.minimum((block ^ 1) * width, n[live])
            hi = np.minimum(lo + width, n[live])
            start, x, right = lo.copy(), by[live], (block & 1).astype(bool)
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                less = self.before(at[x[open_]], at[by[base[live[open_]] + mid]], right[open_], length[x[open_]])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = base[live] + (block & ~1) * width + i[live] - block * width + lo - start
            by[to] = x
            width *= 2
        return by

    def classes(self, at: np.ndarray, seg: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of suffixes inside their segments, and which of them, in that order, begin a class of equal ones. Neighbours
        that the hashes call equal are compared by their bytes."""
        by = self.order(at, seg, length)
        head = np.ones(len(by), bool)
        near = np.flatnonzero(seg[1:] == seg[:-1])
        x, y, n = at[by[near]], at[by[near + 1]], length[by[near]]
        maybe = self.common(x, y, n) >= n
        maybe[maybe] = same_bytes(self.data, x[maybe], y[maybe], n[maybe])
        head[near[maybe] + 1] = False
        return by, head


def edges_of(*keys: np.ndarray) -> np.ndarray:
    """Segment numbers of rows that are sorted by these keys."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.cumsum(np.insert(new, 0, False)) if len(keys[0]) else np.zeros(0, np.int64)


def removed(data: np.ndarray, start: np.ndarray, gram: np.ndarray, lead: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each run a mask of its windows that also start in a document of a smaller id. Runs are sorted by gram."""
    order = SuffixOrder(data, length)
    # classes of equal runs: same anchor, same place of it, same size, same bytes
    form = np.lexsort((size, lead, gram))
    by, head = order.classes(start[form], edges_of(gram[form], lead[form], size[form]), size[form] + length)
    by = form[by]
    opens = np.flatnonzero(head)
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(head) - 1
    least, rep = np.minimum.reduceat(ids[by], opens), by[opens]
    mask = np.zeros(len(rep), np.uint32)
    # windows of the classes whose anchor has several
    g = gram[rep]
    same = g[1:] == g[:-1]
    mixed_ = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    if len(mixed_):
        n = size[rep[mixed_]] + 1
        cls = np.repeat(mixed_, n)
        nth = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
        before_anchor = lead[rep[cls]] - nth
        w = np.lexsort((before_anchor, g[cls]))
        cls, nth, before_anchor = cls[w], nth[w], before_anchor[w]
        at = start[rep[cls]] + nth
        w, head = order.classes(at, edges_of(g[cls], before_anchor), np.full(len(at), length))
        cls, nth, opens = cls[w], nth[w], np.flatnonzero(head)
        first = np.repeat(np.minimum.reduceat(least[cls], opens), np.diff(np.append(opens, len(cls))))
        gone = least[cls] > first
        np.bitwise_or.at(mask, cls[gone], np.uint32(1) << nth[gone].astype(np.uint32))
    whole = ((np.uint64(1) << (size + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    return np.where(ids > least[of], whole, mask[of])


def windows(table: pa.Table, length: int) -> pa.Table:
    """Which windows of the sent runs also start in a document of a smaller id; anchor by anchor, about BLOCK_BYTES at once."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    join = lambda c, kind: np.frombuffer(b"".join(cols[c]), kind)
    each = [len(x) for x in cols["size"]]
    lead, size = join("lead", np.uint8).astype(np.int64), join("size", np.uint8).astype(np.int64)
    total, cuts = np.concatenate(([0], np.cumsum(size + length))), np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
    raw = np.diff(total[cuts]).tolist()
    data = np.frombuffer(b"".join(pa.decompress(x, n, CODEC, asbytes=True) for x, n in zip(cols["bytes"], raw, strict=True)), np.uint8)
    gram = unfive(b"".join(cols["gram"]))
    if not len(gram):
        return rows(WINDOWS, [[] for _ in range(4)])
    ids = np.concatenate([unpacked(x, n) for x, n in zip(cols["ids"], each, strict=True)])
    mask = np.zeros(len(gram), np.uint32)
    by = np.argsort(gram, kind="stable")
    opens = np.flatnonzero(np.insert(gram[by][1:] != gram[by][:-1], 0, True))
    sofar = np.concatenate(([0], np.cumsum((size + length)[by])))
    i = 0
    while i < len(by):
        later = opens[np.searchsorted(opens, np.searchsorted(sofar, sofar[i] + BLOCK_BYTES), "left") :]
        j = int(later[0]) if len(later) else len(by)
        j = j if j > i else len(by)
        at = by[i:j]
        n = size[at] + length
        start = np.concatenate(([0], np.cumsum(n)))[:-1]
        here = data[np.repeat(total[at] - start, n) + np.arange(n.sum())]
        mask[at] = removed(here, start, gram[at], lead[at], size[at], ids[at], length)
        i = j
    out: list[list] = [[] for _ in range(4)]
    for k, (b, e, s) in enumerate(zip(cols["bucket"], cols["entry"], cols["shift"], strict=True)):
        m = mask[cuts[k] : cuts[k + 1]]
        if hit := np.flatnonzero(m).tolist():
            for col, v in zip(out, (b, np.frombuffer(e, "<u4")[hit].tobytes(), np.frombuffer(s, np.uint8)[hit].tobytes(), m[hit].tobytes()), strict=True):
                col.append(v)
    return rows(WINDOWS, out)


def cut(docs: pa.Table, answers: pa.Table, length: int, parts: int, digests: bool = False) -> pa.Table:
    """The final rows of a bucket, with the digests of the whole texts if asked for."""
    if not len(docs):
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()} | ({"digest": pa.binary()} if digests else {})
        return pa.table({n: pa.array([], k) for n, k in kinds.items()})
    b = Bucket(docs, length, parts)
    mask = np.zeros(len(b.lead), np.uint32)
    for e, s, m in zip(*(answers.column(c).to_pylist() for c in ("entry", "shift", "mask")), strict=True):
        np.bitwise_or.at(mask, np.frombuffer(e, "<u4"), np.frombuffer(m, np.uint32) << np.frombuffer(s, np.uint8).astype(np.uint32))
    delta = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(delta, b.first[b.known], 1)
    np.add.at(delta, b.last[b.known] + length, -1)
    rest = np.flatnonzero(~b.known & (mask[b.of] > 0)) if len(b.of) else b.of
    for k in range(int((b.last - b.first)[rest].max(initial=-1)) + 1):
        gone = rest[(mask[b.of[rest]] >> np.uint32(k) & np.uint32(1)).astype(bool)]
        np.add.at(delta, b.first[gone] + k, 1)
        np.add.at(delta, b.first[gone] + k + length, -1)
    gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    starts = b.off[:-1][np.diff(b.off) > 0]
    opens[starts] = gone[starts]
    total, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(opens)))
    kept = []
    for i, j in zip(b.off[:-1], b.off[1:], strict=True):
        kept.append((b.data[i:j][~gone[i:j]] if total[j] > total[i] else b.data[i:j]).tobytes())
    count = lambda x: pa.array((x[b.off[1:]] - x[b.off[:-1]]).astype(np.int64))
    told = {
        "doc_id": pa.array(b.ids, mask=b.null),
        "n_bytes": pa.array(np.diff(b.off)),
        "n_removed": count(total),
        "n_spans": count(spans),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        "kept": pa.array(kept, pa.binary()),
    }
    if digests:
        told["digest"] = pa.array([hashlib.sha256(b.data[i:j]).digest() for i, j in zip(b.off[:-1], b.off[1:], strict=True)], pa.binary())
    return pa.table(told)


def once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text, digest) with one of the rows that are repeated whole, and the keys of these, None if there are none."""
    repeated = checkpointed(docs.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_")))
    if not repeated.head(1):
        return docs, None
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
    return docs.join(repeated, same, "left_anti").unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "digest"])), repeated


def dedup(docs: DataFrame, length: int = 50, bucket_bytes: int = BUCKET_BYTES, with_bytes: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept bytes]) of documents (doc_id integer, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // bucket_bytes) + 1
    single, repeated = once(docs)
    dealt = single.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n)).cast("long").alias("bucket"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["digest"] * (repeated is not None) + ["kept"] * with_bytes
    kinds = {"doc_id": "bigint", "kept_sha256": "string", "digest": "binary", "kept": "binary"}
    small_batches(docs.sparkSession)

    def first(t: pa.Table) -> pa.Table:
        return send(t, length, n)

    def third(d: pa.Table, a: pa.Table) -> pa.Table:
        return send_bytes(d, a, length, n)

    def fourth(t: pa.Table) -> pa.Table:
        return windows(t, length)

    def last(d: pa.Table, a: pa.Table) -> pa.Table:
        return cut(d, a, length, n, "digest" in names).select(names)

    sent = dealt.groupBy("bucket").applyInArrow(lean_group(first), SEND)
    told = sent.groupBy("part").applyInArrow(lean_group(answer), ANSWER)
    runs_ = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lean_group(third), BYTES)
    seen = runs_.groupBy("part").applyInArrow(lean_group(fourth), WINDOWS)
    out = dealt.groupBy("bucket").cogroup(seen.groupBy("bucket")).applyInArrow(lean_group(last), ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names))
    if repeated is None:
        return out
    # every row that was repeated gets the result of the one
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
    again = docs.select("doc_id", "digest").join(repeated, same, "left_semi").select(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_"))
    out = checkpointed(out)
    return out.join(repeated, same, "left_anti").drop("digest").unionByName(again.join(out, same).drop("id_", "digest_", "digest"))
