"""Benchmark decontamination with suffix arrays of the training documents.

Each slice of documents (a shard: whole documents, a few MB) gets a word-level suffix array by prefix doubling. Every
suffix of every test item is looked up by binary search; the range of array entries that share its window is the list
of locations, and neighbouring windows join to the longest verbatim matches. Words are compared by 64-bit hash and
every match is confirmed on the words themselves. Documents never leave their partition, so there is no shuffle; the
test items are sent to all shards in blocks of bounded size.

Defined results: null or empty texts have no words and no hits; an item without words matches nothing; items of the same id
count once; items with a null id count as one item without a name, a null at the end of the items, in
scan and not in decontaminate, which leaves them out; rows that are repeated, and ties of one window in several
items, each count; a very long text is a shard of its own; an empty table gives an empty table; extra columns pass, but for
those named as the results of scan, which are replaced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import Words
from .common import arrow_columns, fresh

#: Bytes of text in one suffix array, and of test items sent at once.
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 16 << 20


class Items:
    """A block of test items: the words of all, and each suffix that can begin a window."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.string()))
        self.ids, self.hash = ids, words.hash
        length = np.diff(words.first)
        item = np.repeat(np.arange(len(ids)), length)
        width = np.minimum(length, window)[item]
        at = np.arange(len(item))
        opens = at + width <= words.first[1:][item]
        self.at, self.item, self.width = at[opens], item[opens], width[opens]
        self.start, self.end, self.low = words.start, words.end, words.low

    def bytes_of(self, i: int, j: int) -> bytes:
        return b" ".join(self.low[self.start[k] : self.end[k]].tobytes() for k in range(i, j))


def suffix_array(hashes: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Word positions ordered by the words that follow up to the text's end, as far as depth words."""
    n = len(hashes)
    sa = np.argsort(hashes, kind="stable")
    ends = np.repeat(first[1:], np.diff(first))
    rank = np.empty(n, np.int64)
    s = hashes[sa]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(new, at, 0))
    rank[sa] = group
    open_ = np.flatnonzero(~new | np.append(~new[1:], False)) if n else at
    h = 1
    while h < depth and len(open_):
        u = sa[open_]
        nxt = u + h
        inside = nxt < ends[u]
        follow = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = (rank[u] << 32) | follow
        order = np.argsort(key, kind="stable")
        key, u = key[order], u[order]
        sa[open_] = u
        new = np.ones(len(u), bool)
        new[1:] = key[1:] != key[:-1]
        rank[u] = open_[np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))]
        open_ = open_[~new | np.append(~new[1:], False)]
        h *= 2
    return sa


def bounds(sa: np.ndarray, hashes: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of the array whose entries begin with its window."""
    n, q = len(sa), len(items.at)

    def side(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(q, np.int64), np.full(q, n, np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            p, a, w = sa[mid], items.at[open_], items.width[open_]
            less = np.full(len(open_), upper)  # equal in the whole window
            left = np.arange(len(open_))
            for d in range(int(w.max())):
                left = left[d < w[left]]
                if not len(left):
                    break
                over = p[left] + d >= ends[p[left]]
                x = hashes[np.minimum(p[left] + d, n - 1)]
                y = items.hash[a[left] + d]
                differs = over | (x != y)
                less[left[differs]] = (over | (x < y))[differs]
                left = left[~differs]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    return side(False), side(True)


def matches(words: Words, sa: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """Longest verbatim matches (item, word of the block, word of the shard, words), confirmed on the words."""
    ends = np.repeat(words.first[1:], np.diff(words.first))
    lo, hi = bounds(sa, words.hash, ends, items)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    if not len(found):
        return []
    q = np.repeat(found, count)
    p = sa[np.repeat(lo[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(q))]
    a, width = items.at[q], items.width[q]
    order = np.lexsort((p, p - a))
    a, p, width, item = a[order], p[order], width[order], items.item[q][order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p - a) != 0) | (np.diff(p) != 1) | (np.diff(item) != 0) | (ends[p][1:] != ends[p][:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(p)) - 1
    out = []
    for b, e in zip(begin, last, strict=True):
        n = int(p[e] - p[b] + width[e])
        if words.bytes_of(p[b], p[b] + n) == items.bytes_of(a[b], a[b] + n):
            out.append((int(item[b]), int(a[b]), int(p[b]), n))
        else:  # two words of one hash: window by window
            for k in range(b, e + 1):
                if words.bytes_of(p[k], p[k] + width[k]) == items.bytes_of(a[k], a[k] + width[k]):
                    out.append((int(item[k]), int(a[k]), int(p[k]), int(width[k])))
    return out


ADDED = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("longest", "bigint"), ("spans", "array<struct<item:string,start:bigint,words:bigint>>")]


def item_blocks(benchmark: DataFrame, window: int) -> list:
    """The test items as broadcasts, each of about BLOCK_BYTES at most, cut by a hash of the item id, or of the text where that is null."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    blocks = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(F.coalesce("i", "t")), F.lit(n)) == k)
        got = sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        blocks.append(spark.sparkContext.broadcast(Items([i for i, _ in got], [t for _, t in got], window)))
    return blocks


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, names: list[str] | None = None) -> DataFrame:
    """docs with words, hit words, items found (sorted ids), the longest match and all matches (document word offsets)."""
    blocks = item_blocks(benchmark, window)

    def compute(column: pa.Array) -> list[pa.Array]:
        words = Words(column)
        n = len(column)
        hit = np.zeros(len(words.hash) + 1, np.int64)
        longest = np.zeros(n, np.int64)
        items: list[set] = [set() for _ in range(n)]
        spans: list[list] = [[] for _ in range(n)]
        if len(words.hash):
            sa = suffix_array(words.hash, words.first, window)
            for block in blocks:
                test = block.value
                if len(test.at):
                    for item, _, p, m in matches(words, sa, test):
                        d = int(np.searchsorted(words.first, p, "right")) - 1
                        hit[p] += 1
                        hit[p + m] -= 1
                        longest[d] = max(longest[d], m)
                        items[d].add(test.ids[item])
                        spans[d].append({"item": test.ids[item], "start": int(p - words.first[d]), "words": m})
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # one block in memory at a time
        covered = np.concatenate(([0], np.cumsum(np.cumsum(hit)[:-1] > 0)))
        n_hit = covered[words.first[1:]] - covered[words.first[:-1]]
        kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
        return [pa.array(np.diff(words.first)), pa.array(n_hit), pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string())), pa.array(longest), pa.array(spans, kind)]

    names = names or [n for n, _ in ADDED]
    return arrow_columns(docs, "text", list(zip(names, [t for _, t in ADDED], strict=True)), compute, SHARD_BYTES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that hold any window of any item; the columns of docs."""
    names = [fresh(docs, f"decontam_{n}") for n, _ in ADDED]
    named = benchmark.where("item_id is not null")  # as the tests of odd inputs have it
    return scan(docs, named, window, names).where(F.col(names[1]) == 0).select(*docs.columns)


_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_DOWN}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_DOWN}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
