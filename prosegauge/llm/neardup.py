"""N-gram Jaccard join: a MinHash LSH forest over shingles of five words, exact verification at 0.8.

Words are those of the decontamination operator (ASCII lower-cased). Texts of one word sequence are one node. A node has in each
of TREES trees a signature of LONGEST MinHash labels. The signatures of all trees are range-sorted, which makes them
prefix tries: neighbours in the order share the longest prefixes, and nodes under one prefix are a run of neighbours. Matched prefixes
are shortened label by label, in all trees at once, until two recalls reach the target: the expected one at the
threshold, 1 - (1 - t**depth)**TREES, and that measured on AUDITED hash-drawn nodes whose links to all documents are counted
exactly from their shingles. Neighbours that still share a prefix of that depth are joined; the join's recall on the
audited links is returned beside the result.

What the prefixes join are components, not pairs. Each component's exact shingle sets are compared by block products (large
ones as pairs of blocks, dealt to different tasks), so every pair of the component is checked and links are counted, while
only labels and counts leave a task. Every shuffle is by a node, a range of signatures or a block; the joins in which one
node, class or row can be frequent stand between two plain shuffles, which Spark splits.

Defined results: null, empty and word-less texts link with nothing; texts of one to four words are one shingle; a text that is
repeated inside another, or very long, is one set of shingles of whatever size; repeated rows and copies count as links
of one another; class_id is the smallest doc_id of the class, a null id standing after all others and replaced by the
text's hash; ties cannot occur, since a class has one smallest id; empty tables give empty tables; the audit draws among
nodes of at most AUDITED_WORDS words. classes reads doc_id and text alone, whatever other columns there are; keep_one
returns all columns as they came."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .bytegrid import Words, mixed
from .common import arrow_columns, checkpointed, fresh, lean, small_batches, text_slices
from .components import components

SHINGLE, THRESHOLD, TREES, LONGEST, TARGET = 5, 0.8, 24, 8, 0.9999
#: Nodes whose links are counted exactly to measure recall, and the words that such a node may have.
AUDITED, AUDITED_WORDS = 512, 4000
#: Nodes and bytes of shingles in a block of the exact comparison; bytes of small components that go to one task.
BLOCK_NODES, BLOCK_BYTES, SHARD_BYTES = 768, 12 << 20, 8 << 20
#: Bits of a shingle's hash that the audit looks up before it searches.
SIEVE = 22


def expected_recall(threshold: float, trees: int, depth: int) -> float:
    """Chance that a pair at the threshold shares a prefix of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(threshold: float, trees: int, longest: int, target: float, measured: dict[int, float] | None = None) -> int:
    """Shorten the matched prefix from the longest until the expected and the measured recall reach the target."""
    for depth in range(longest, 0, -1):
        if min(expected_recall(threshold, trees, depth), (measured or {}).get(depth, 1.0)) >= target:
            return depth
    return 1


class Shingles:
    """Hashes of all shingles of many texts; first: where each text's begin."""

    def __init__(self, column: pa.Array, n: int = SHINGLE):
        words = Words(column)
        self.n_words = np.diff(words.first)
        h, at = words.hash, np.arange(len(words.hash))
        size = np.repeat(np.minimum(self.n_words, n), self.n_words)
        last = np.repeat(words.first[1:], self.n_words)
        opens = np.flatnonzero(at + size <= last)
        total = mixed(size[opens].astype(np.uint64))
        for k in range(n):
            inside = size[opens] > k
            total = np.where(inside, total * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(opens + k, len(h) - 1)], total) if len(h) else total
        self.hash = mixed(total)
        self.first = np.searchsorted(opens, words.first)
        # two sums over the word sequence name the text
        along = at - np.repeat(words.first[:-1], self.n_words)
        self.name = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            mark = mixed(h ^ mixed((along.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mark, dtype=np.uint64)))
            self.name.append(mixed(sums[words.first[1:]] - sums[words.first[:-1]] + self.n_words.astype(np.uint64)))

    def nodes(self) -> list[bytes | None]:
        raw = np.stack(self.name, axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)
        return [raw[i].tobytes() if n else None for i, n in enumerate(self.n_words)]


def signatures(s: Shingles, trees: int, longest: int, only: np.ndarray | None = None) -> np.ndarray:
    """For each text (of only) the MinHash labels of each tree, two bytes a label; zeros for texts without words."""
    rng = np.random.default_rng(20240607)
    which = np.arange(len(s.n_words)) if only is None else only
    out = np.zeros((len(which), trees, longest), ">u2")
    have = np.flatnonzero(s.n_words[which] > 0)
    if len(have):
        first, last = s.first[:-1][which[have]], s.first[1:][which[have]]
        if only is None:
            h, at = s.hash, first
        else:
            h = np.concatenate([s.hash[i:j] for i, j in zip(first, last, strict=True)])
            at = np.concatenate(([0], np.cumsum(last - first)))[:-1]
        h = (h >> np.uint64(32)).astype(np.uint32)
        for tree in range(trees):
            for depth in range(longest):
                flip, odd = rng.integers(0, 1 << 32, 2, dtype=np.uint32)
                label = np.minimum.reduceat((h ^ flip) * (odd | np.uint32(1)), at)
                out[have, tree, depth] = (label ^ (label >> np.uint32(16))).astype(np.uint16)
    return out


def row_id() -> Column:
    """Of a row: whether the id is null, the id or the text's hash, and the text's hash."""
    text = F.xxhash64("text")
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), text).alias("rid"), text.alias("text_hash"))


def signed(docs: DataFrame, trees: int, longest: int) -> DataFrame:
    """Rows (columns of docs less text, id, node, n_words, signatures)."""
    rows = docs.withColumn("id", row_id())

    def compute(column: pa.Array) -> list[pa.Array]:
        s = Shingles(column)
        raw = signatures(s, trees, longest).tobytes()
        size = 2 * trees * longest
        return [pa.array(s.nodes(), pa.binary()), pa.array(s.n_words), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())]

    return arrow_columns(rows, "text", [("node", "binary"), ("n_words", "bigint"), ("signatures", "binary")], compute, 1 << 19).drop("text")


def named() -> Column:
    """A node's name, in the order of its least row: null flag, id, hash of the words."""
    rid = F.lpad(F.hex(F.col("least.rid").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.when(F.col("least.none"), "01").otherwise("00")), F.unhex(rid), "hash")


def id_of(name: Column) -> Column:
    """The id in a node's name, whose first bit is turned so that negative ids stand first."""
    return (F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


# --- the audit ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Audit:
    """Links of the audited nodes, by the depth of the longest prefix that a pair shares in any tree."""

    links: dict[int, int]

    def recall(self) -> dict[int, float]:
        total = sum(self.links.values())
        return {d: sum(n for k, n in self.links.items() if k >= d) / total for d in range(1, LONGEST + 1)} if total else {}


class Queries:
    """The audited nodes as an inverted index of their shingles."""

    def __init__(self, texts: list[str], trees: int, longest: int):
        s = Shingles(pa.array(texts, pa.string()))
        sets = [np.unique(s.hash[i:j]) for i, j in zip(s.first[:-1], s.first[1:], strict=True)]
        self.names, self.size = s.nodes(), np.array([len(x) for x in sets], np.int64)
        self.signatures = signatures(s, trees, longest)
        flat, of = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        flat, self.query = flat[order], of[order]
        new = np.insert(flat[1:] != flat[:-1], 0, True) if len(flat) else np.zeros(0, bool)
        self.shingle, self.first = flat[new], np.append(np.flatnonzero(new), len(flat))
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.shingle >> np.uint64(64 - SIEVE)] = True

    def links(self, s: Shingles, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(text, query) of all pairs at the threshold."""
        maybe = np.flatnonzero(self.sieve[s.hash >> np.uint64(64 - SIEVE)])
        place = np.minimum(np.searchsorted(self.shingle, s.hash[maybe]), len(self.shingle) - 1)
        sure = self.shingle[place] == s.hash[maybe]
        text = np.searchsorted(s.first, maybe[sure], "right") - 1
        hit = np.unique(text * len(self.shingle) + place[sure])  # a shingle counts once in a text
        text, place = hit // len(self.shingle), hit % len(self.shingle)
        many = self.first[place + 1] - self.first[place]
        at = np.repeat(self.first[place] - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())
        pair, common = np.unique(np.repeat(text, many) * len(self.size) + self.query[at], return_counts=True)
        text, query = pair // len(self.size), pair % len(self.size)
        # the number of all shingles of a text bounds that of its distinct ones from above
        near = common >= threshold * self.size[query] - 1e-6
        text, query, common = text[near], query[near], common[near]
        which, back = np.unique(text, return_inverse=True)
        own = np.array([len(np.unique(s.hash[s.first[i] : s.first[i + 1]])) for i in which], np.int64)[back] if len(which) else np.zeros(0, np.int64)
        ok = common >= threshold * (own + self.size[query] - common) - 1e-6
        return text[ok], query[ok]


def audit(docs: DataFrame, threshold: float, trees: int, longest: int, size: int) -> Audit:
    """Counts all links between hash-drawn nodes and all rows of docs (doc_id, text) in one pass; only counts come back."""
    spark, total = docs.sparkSession, docs.count()
    share = min(1.0, size / total) if total else 1.0
    short = F.regexp_count("text", F.lit(r"\s+")) < AUDITED_WORDS
    place = F.pmod(F.xxhash64("text", F.lit("audit")), F.lit(1 << 30))
    texts = docs.where((place < F.lit(share) * (1 << 30)) & short).select("text").groupBy(F.xxhash64("text")).agg(F.min("text").alias("text"))
    texts = sorted(r.text for r in texts.select("text").collect())
    queries = Queries(texts, trees, longest)
    if not len(queries.shingle):
        return Audit({})
    sent = spark.sparkContext.broadcast(queries)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, counts = sent.value, np.zeros(longest + 1, np.int64)
        for part in (b.column(0).slice(i, j - i) for b in batches for i, j in text_slices(b.column(0), 1 << 19)):
            s = Shingles(part)
            if not len(s.hash):
                continue
            text, query = q.links(s, threshold)
            if len(text):
                names = s.nodes()
                other = np.array([names[t] != q.names[k] for t, k in zip(text, query, strict=True)], bool)
                text, query = text[other], query[other]
                which, back = np.unique(text, return_inverse=True)
                same = signatures(s, trees, longest, which)[back] == q.signatures[query] if len(text) else np.zeros((0, trees, longest), bool)
                counts += np.bincount(np.cumprod(same, axis=2).sum(axis=2).max(axis=1, initial=0), minlength=longest + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(longest + 1)), pa.array(counts)], names=["depth", "n"])

    found = docs.select("text").mapInArrow(lean(run), "depth bigint, n bigint").groupBy("depth").agg(F.sum("n").alias("n")).collect()
    return Audit({r.depth: r.n for r in found})


# --- the tries ---------------------------------------------------------------------------------------------------------


def shared_labels(key: np.ndarray) -> np.ndarray:
    """Of neighbouring rows (a byte of the tree, then two bytes a label): the labels that they share from the first on."""
    same = key[1:, 1:] == key[:-1, 1:]
    labels = same[:, 0::2] & same[:, 1::2]
    return np.cumprod(labels, axis=1).sum(axis=1) * (key[1:, 0] == key[:-1, 0])


def neighbours(nodes: DataFrame, trees: int, longest: int, depth: int) -> DataFrame:
    """Edges (a, b) between nodes (name, signatures) that follow one another in a tree's sorted signatures and share a prefix of
    `depth` labels: nodes under one prefix are a chain of them. Neighbours across a border between two ranges are joined from
    the first and last entry of each range."""
    spark, size = nodes.sparkSession, 2 * longest
    keys = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring("signatures", t * size + 1, F.lit(size))))
    entries = nodes.select(F.explode(keys).alias("key"), "name").repartitionByRange("key", "name").sortWithinPartitions("key", "name")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        part = TaskContext.get().partitionId()

        def out(a: list, b: list, at: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([at] * len(a), pa.int64())], names=["a", "b", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if last is None:
                yield out([raw[0]], [names[0]], 2 * part)
            else:
                raw.insert(0, last[0])
                names.insert(0, last[1])
            key = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), size + 1)
            at = np.flatnonzero(shared_labels(key) >= depth)
            yield out([names[i] for i in at], [names[i + 1] for i in at], None)
            last = (raw[-1], names[-1])
        if last is not None:
            yield out([last[0]], [last[1]], 2 * part + 1)

    found = checkpointed(entries.mapInArrow(lean(run), "a binary, b binary, at bigint"))
    # two entries of each range of the sort, whatever the table
    borders = sorted((r["at"], bytes(r.a), bytes(r.b)) for r in found.where("at is not null").collect())
    across = []
    for (at, key, name), (_, then, other) in zip(borders, borders[1:], strict=False):
        if at % 2 and shared_labels(np.frombuffer(key + then, np.uint8).reshape(2, -1))[0] >= depth:
            across.append((bytearray(name), bytearray(other)))
    return found.where("at is null").select("a", "b").unionByName(spark.createDataFrame(across, "a binary, b binary"))


# --- verification ------------------------------------------------------------------------------------------------------


def linked(payloads: list[bytes], side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets (sorted hashes) reach the threshold; side: only pairs of different sides."""
    sets = [np.frombuffer(x, np.uint64) for x in payloads]
    m = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    if m == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, np.float64)
        both[1] = both[0][::-1]
    else:
        row = np.repeat(np.arange(m), size.astype(np.int64))
        _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(n > 1) - 1
        keep = n[col] > 1
        row, col = row[keep], common[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((m, m), np.float32)
        wide = max(256, (8 << 20) // (4 * m))
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
            i, j = np.searchsorted(col, (c, c + wide))
            x = np.zeros((m, wide), np.float32)
            x[row[i:j], col[i:j] - c] = 1
            both += x @ x.T
    ok = both >= threshold * (size[:, None] + size[None] - both) - 1e-6
    np.fill_diagonal(ok, False)
    if side is not None:
        ok &= side[:, None] != side[None]
    return ok


def shingle_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (name, hash, rid, text_hash, ...) with the sorted shingle hashes of its row of docs (doc_id, text)."""
    texts = docs.select(row_id().alias("id"), "text").select("id.rid", "id.text_hash", "text").join(placed, ["rid", "text_hash"])
    at = ["name", *[c for c in placed.columns if c not in ("name", "rid", "text_hash", "hash")]]
    kinds = ", ".join(f"{n} {dict(placed.dtypes)[n]}" for n in at)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows that are repeated whole leave a task once
        for batch in batches:
            s = Shingles(batch.column(0))
            keep = []
            for i, (name, own, asked) in enumerate(zip(batch.column(2).to_pylist(), s.nodes(), batch.column(1).to_pylist(), strict=True)):
                if own == asked and name not in seen:
                    seen.add(name)
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            sets = [np.unique(s.hash[s.first[i] : s.first[i + 1]]).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(sets, pa.binary())], names=[*at, "payload"])

    return texts.select("text", "hash", *at).mapInArrow(lean(run), f"{kinds}, payload binary")


@dataclass(frozen=True)
class Joined:
    """rows: those of docs less text, with id, name and label of the class (null without words), n_links; depth of the prefixes;
    share of the audited links that they find, None without audited links."""

    rows: DataFrame
    depth: int
    recall: float | None


def joined(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target: float = TARGET, audited: int = AUDITED) -> Joined:
    """The join of docs (doc_id, text, and columns that are carried along)."""
    texts = docs.select("doc_id", "text")
    recall = audit(texts, threshold, trees, longest, audited).recall() if audited else {}
    depth = prefix_depth(threshold, trees, longest, target, recall)
    rows = checkpointed(signed(docs, trees, longest), scanned=True)
    nodes = rows.where("node is not null").groupBy(F.col("node").alias("hash")).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.max("n_words").alias("n_words"), F.min("signatures").alias("signatures"))
    nodes = checkpointed(nodes.withColumn("name", named()))
    comps = components(neighbours(nodes.select("name", "signatures"), trees, longest, depth)).select(F.col("node").alias("name"), F.col("label").alias("comp"))
    members = nodes.select("name", "hash", "least.rid", "least.text_hash", "copies", (F.col("n_words") * 8).alias("weight")).join(comps, "name")
    placed, shards = blocks.place(checkpointed(members), BLOCK_NODES, BLOCK_BYTES, SHARD_BYTES)
    sets = shingle_sets(texts, placed.drop("weight")).withColumnRenamed("name", "node")
    found = checkpointed(blocks.compare(sets, shards, lambda payloads, side: linked(payloads, side, threshold)))
    links = found.groupBy(F.col("node").alias("name")).agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "name")
    told = nodes.select("name", "hash", "copies").join(links, "name", "left").join(labels, "name", "left")
    told = checkpointed(told.select(F.col("hash").alias("node"), F.coalesce("label", "name").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = [c for c in docs.columns if c != "text"]
    with_words = rows.where("node is not null").select(*own, "id", "node").join(told, "node").select(*own, "id", "label", "n_links")
    none = rows.where("node is null").select(*own, "id", F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("n_links"))
    return Joined(with_words.unionByName(none), depth, recall.get(depth))


def classes(docs: DataFrame, **how) -> DataFrame:
    """Rows (doc_id, class_id, n_links, recall), one for each row of docs (doc_id, text)."""
    got = joined(docs.select("doc_id", "text"), **how)
    class_id = F.coalesce(id_of(F.col("label")), F.col("id.rid")).cast("long")
    return got.rows.select("doc_id", class_id.alias("class_id"), "n_links", F.lit(got.recall).cast("double").alias("recall"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: that of the smallest id, then of the smallest hash of text and of all its columns; the
    columns of docs. Rows without words are all kept, less whole copies."""
    rid, mark = fresh(docs, "neardup_rid"), fresh(docs, "neardup_mark")
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant")) and "map<" not in kind]
    marked = docs.withColumns({rid: row_id(), mark: F.xxhash64(*[F.col(f"`{c}`") for c in plain])})
    found = joined(marked.select("doc_id", "text", F.col(mark).alias("mark_")), **how).rows
    of = F.coalesce("label", F.encode(F.concat_ws("/", F.lit("none"), F.col("id.rid").cast("string"), F.col("mark_").cast("string")), "UTF-8"))
    kept = found.groupBy(of.alias("label")).agg(F.min(F.struct("id", "mark_")).alias("least"), F.count("*").alias("n"))
    kept = checkpointed(kept.select(F.col("least.id").alias(rid), F.col("least.mark_").alias(mark), "n"))
    one = marked.join(kept.drop("n"), [rid, mark], "left_semi")
    several = kept.where("n > 1")
    if not several.head(1):
        return one.select(*docs.columns)
    # whole copies of a kept row: one of each
    lone = marked.join(kept.where("n = 1").drop("n"), [rid, mark], "left_semi")
    return lone.unionByName(marked.join(several.drop("n"), [rid, mark], "left_semi").dropDuplicates([rid, mark])).select(*docs.columns)
