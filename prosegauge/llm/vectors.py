"""Embedding near-dedup by NN-descent.

Vectors are compared only inside a label (and dimension). Copies collapse to one node. Lists start from neighbours in
several orders by random hyperplanes; then neighbours of neighbours are joined: every node brings its forward and
reverse neighbours together, their cosines are taken in double precision and improve one another's lists, until a round
changes little. Nodes whose list is full of links get lists twice as long, up to MOST; longer neighbourhoods are left to the last
step. Edges at the threshold make components. A list pushes links out only where MOST closer ones stand in it, so a lost
link lies between components of more than MOST nodes: those whose balls around a pivot come close enough for a link are put
together. An audit compares a hash-drawn set of nodes with all others; while it misses any link, more orders and longer
lists follow, and labels that still miss some after the last repeat are compared whole. Then all pairs of each of these
sets are checked exactly by blocks, and the links found there make the counts and the components.

Defined results: null or zero vectors and those with null or non-finite components, and rows without a label, link with
nothing and are their own component; copies of a vector link with each other; a null vec_id stays null, and is its own component unless
linked; repeated rows each get their row; of equally near neighbours the one of the smaller hash stands in a list first;
vectors of any length are read whole; empty tables give empty tables; columns other than vec_id, embedding and
label are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import checkpointed, lean, small_batches
from .components import components

THRESHOLD = 0.98
#: Starting and longest lists, orders of the start, neighbours taken on each side of an order, members joined at once.
LIST, MOST, ORDERS, REACH, CHUNK = 8, 32, 8, 3, 32
#: The audit's query nodes at least; for large tables they grow with the root of the nodes.
AUDITED = 1024
BLOCK_NODES, BLOCK_BYTES, SHARD_BYTES = 1024, 4 << 20, 2 << 20


def unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; a vector's bytes are floats or doubles, as its last byte says."""
    kind = "<f4" if raw[0][-1] == 4 else "<f8"
    x = np.frombuffer(b"".join(r[:-1] for r in raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, node, grp, vec) of usable vectors, the rest with null node."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    bad = F.col("label").isNull() | F.col("embedding").isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(~F.coalesce(bad, F.lit(True)), v).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, grp = [], []
            for label, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                a = np.asarray(x.values, np.float64) if x.is_valid else np.zeros(0)
                size = float(np.abs(a).max()) if len(a) else 0.0
                if single:  # half the bytes, and their squares are safe in double precision
                    raw.append(a.astype("<f4").tobytes() + b"\x04" if size else None)
                else:
                    a = a / size if size else a  # squares neither overflow nor vanish
                    raw.append(a.astype("<f8").tobytes() + b"\x08" if size else None)
                grp.append(f"{len(a)}:{label}" if size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grp, pa.string()), pa.array(raw, pa.binary())], names=["vec_id", "grp", "vec"])

    kind = dict(vectors.dtypes)["vec_id"]
    out = rows.mapInArrow(lean(run), f"vec_id {kind}, grp string, vec binary")
    return out.withColumn("node", F.when(F.col("vec").isNotNull(), F.unhex(F.md5(F.concat(F.encode("grp", "UTF-8"), F.lit(b"|"), "vec")))))


def start(nodes: DataFrame, orders: int, seed: int, bits: int) -> DataFrame:
    """Directed edges (u, v, sim) between neighbours in random orders: by the signs of hyperplanes, then by one more projection."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, grp, vec = (b.column(i).to_pylist() for i in range(3))
            parts = []
            for size in sorted({len(x) for x in vec}):
                at = [i for i, x in enumerate(vec) if len(x) == size]
                x = unit([vec[i] for i in at])
                dim = x.shape[1]
                for t in range(orders):
                    p = x @ np.random.default_rng((seed, t, dim)).normal(size=(dim, bits + 1))
                    key = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    parts += [(node[i], grp[i], vec[i], t, int(k), float(z)) for i, k, z in zip(at, key, p[:, bits], strict=True)]
            cols = list(zip(*parts, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["node", "grp", "vec", "t", "key", "z"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list = []
        for b in batches:
            rows = tail + list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            tail = rows[-REACH:]
            us, vs, sims = [], [], []
            for d in range(1, REACH + 1):
                pairs = [(x, y) for x, y in zip(rows, rows[d:], strict=False) if x[1] == y[1] and x[3] == y[3]]
                for dim in sorted({len(x[2]) for x, _ in pairs}):
                    p = [(x, y) for x, y in pairs if len(x[2]) == dim]
                    s = np.einsum("ij,ij->i", unit([x[2] for x, _ in p]), unit([y[2] for _, y in p]))
                    us += [x[0] for x, _ in p] + [y[0] for _, y in p]
                    vs += [y[0] for _, y in p] + [x[0] for x, _ in p]
                    sims.append(np.concatenate((s, s)))
            sim = np.concatenate(sims) if sims else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary()), pa.array(sim)], names=["u", "v", "sim"])

    rows = nodes.select("node", "grp", "vec").mapInArrow(lean(keyed), "node binary, grp string, vec binary, t int, key bigint, z double")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "grp", "t", "key", "z").sortWithinPartitions("grp", "t", "key", "z").select("node", "grp", "vec", "t")
    return rows.mapInArrow(lean(neighbours), "u binary, v binary, sim double")


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node, twice as many for nodes whose k are all links, up to MOST."""
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    links = F.sum((F.col("sim") >= THRESHOLD).cast("int")).over(Window.partitionBy("u"))
    room = F.lit(k)
    size = k
    while size < MOST:
        room = F.when(links >= size, F.lit(2 * size)).otherwise(room)
        size *= 2
    return ranked.withColumn("room", room).where("r <= room").select("u", "v", "sim")


def joined(nodes: DataFrame, graph: DataFrame, turn: int) -> DataFrame:
    """New candidate edges: all pairs among each node's neighbours in both directions, in chunks of at most about CHUNK."""
    both = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(graph.select(F.col("v").alias("c"), F.col("u").alias("m"))).distinct()
    degree = both.groupBy("c").agg(F.count("*").alias("n"))
    least = graph.groupBy(F.col("u").alias("m")).agg(F.min("sim").alias("worst"))
    both = both.join(degree, "c").withColumn("chunk", F.pmod(F.xxhash64("m", F.lit(turn)), F.ceil(F.col("n") / CHUNK)))
    lists = both.join(least, "m").join(nodes.select(F.col("node").alias("m"), "vec"), "m")
    lists = lists.groupBy("c", "chunk").agg(F.collect_list(F.struct("m", "vec", "worst")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            flat = col.flatten()
            names, vecs, worst = flat.field("m").to_pylist(), flat.field("vec").to_pylist(), np.asarray(flat.field("worst"))
            us, vs, sims, at = [], [], [], 0
            for n in col.value_lengths().to_pylist():
                if n > 1:
                    x = unit(vecs[at : at + n])
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    i, j = np.nonzero(s > worst[at : at + n][:, None])
                    us += [names[at + k] for k in i]
                    vs += [names[at + k] for k in j]
                    sims.append(s[i, j])
                at += n
            sim = np.concatenate(sims) if sims else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary()), pa.array(sim)], names=["u", "v", "sim"])

    return lists.mapInArrow(lean(run), "u binary, v binary, sim double")


def audit(nodes: DataFrame, placed: DataFrame, size: int, turn: int) -> tuple[int, int, list[str]]:
    """Links of the audited nodes with any node, how many of them lie inside a set of placed (node, comp), and the groups of the others."""
    drawn = nodes.select("node", "grp", "vec").orderBy(F.xxhash64("node", F.lit(99 + turn))).limit(size).collect()
    if not drawn:
        return 0, 0, []
    query = nodes.sparkSession.sparkContext.broadcast([(bytes(r.node), r.grp, bytes(r.vec)) for r in drawn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_grp: dict = {}
        for q in query.value:
            by_grp.setdefault(q[1], []).append(q)
        packed = {g: ([q[0] for q in qs], unit([q[2] for q in qs])) for g, qs in by_grp.items()}
        for b in batches:
            node, grp, vec = (b.column(i).to_pylist() for i in range(3))
            out: list = []
            for g in {*grp} & {*packed}:
                at = [i for i, x in enumerate(grp) if x == g]
                names, x = packed[g]
                i, j = np.nonzero(unit([vec[k] for k in at]) @ x.T >= THRESHOLD)
                out += [(names[b_], node[at[a]], g) for a, b_ in zip(i, j, strict=True) if names[b_] != node[at[a]]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.string()))], names=["a", "b", "grp"])

    true = nodes.select("node", "grp", "vec").mapInArrow(lean(run), "a binary, b binary, grp string")
    with_a = true.join(placed.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
    both = with_a.join(placed.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    found = both.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("long")).alias("inside")).collect()
    return sum(r.n for r in found), sum(r.inside for r in found), [r.grp for r in found if r.inside < r.n]


def cosines(payloads: list[bytes], side: np.ndarray | None, threshold: float) -> np.ndarray:
    x = unit(payloads)
    ok = x @ x.T >= threshold
    np.fill_diagonal(ok, False)
    return ok if side is None else ok & (side[:, None] != side[None])


def put_together(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (node, comp) of labels (node, label): components of more than MOST nodes share a comp if a link between them is possible.

    A component lies in the ball around its label's vector that reaches its farthest node, and angles obey the triangle inequality."""
    large = checkpointed(labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("label"))
    if len(large.head(2)) < 2:
        return labels.select("node", F.col("label").alias("comp"))
    pivots = checkpointed(nodes.select(F.col("node").alias("label"), "grp", F.col("vec").alias("pivot")).join(large, "label"))
    members = nodes.select("node", "vec").join(labels, "node").join(pivots.drop("grp"), "label").select("label", "vec", "pivot")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, pivot = b.column(1).to_pylist(), b.column(2).to_pylist()
            angle = np.zeros(len(vec))
            for size in {len(x) for x in vec}:
                at = [i for i, x in enumerate(vec) if len(x) == size]
                angle[at] = np.arccos(np.clip(np.einsum("ij,ij->i", unit([vec[i] for i in at]), unit([pivot[i] for i in at])), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(angle)], names=["label", "angle"])

    radius = members.mapInArrow(lean(angles), "label binary, angle double").groupBy("label").agg(F.max("angle").alias("radius"))
    balls = pivots.join(radius, "label").select(
        F.col("label").alias("node"), F.unhex(F.md5(F.encode("grp", "UTF-8"))).alias("comp"), F.lit(1).cast("long").alias("copies"),
        F.concat("pivot", F.encode(F.format_string("%.12f", "radius"), "UTF-8")).alias("payload"), (F.octet_length("pivot") + 14).alias("weight"),
    )
    placed, shards = blocks.place(balls, BLOCK_NODES, BLOCK_BYTES, SHARD_BYTES)
    met = blocks.compare(placed, shards, meeting).select(F.col("node").alias("a"), F.col("label").alias("b"))
    joint = components(met).select(F.col("node").alias("label"), F.col("label").alias("joint"))
    return labels.join(joint, "label", "left").select("node", F.coalesce("joint", "label").alias("comp"))


def meeting(payloads: list[bytes], side: np.ndarray | None) -> np.ndarray:
    """Which balls (a vector's bytes, then its radius in 14 characters) are so close that they may hold a link."""
    radius = np.array([float(p[-14:]) for p in payloads])
    x = unit([p[:-14] for p in payloads])
    ok = np.arccos(np.clip(x @ x.T, -1, 1)) <= radius[:, None] + radius[None] + np.arccos(THRESHOLD) + 1e-6
    np.fill_diagonal(ok, False)
    return ok if side is None else ok & (side[:, None] != side[None])


def neardup(vectors: DataFrame, rounds: int = 4, repeats: int = 3) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows (vec_id, n_links, component_id, kept), and the audits' (links, links found): the last one finds all, or what it missed
    was compared whole."""
    small_batches(vectors.sparkSession)
    rows = checkpointed(nodes_of(vectors), scanned=True)
    nodes = checkpointed(rows.where("node is not null").groupBy("node").agg(F.min("grp").alias("grp"), F.min("vec").alias("vec"), F.count("*").alias("copies")))
    largest, total = nodes.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, audited = largest or 0, max(AUDITED, int(4 * (total or 0) ** 0.5))
    bits = max(4, int(largest).bit_length() - 5)
    graph, k, audits, sets = None, LIST, [], None
    for repeat in range(repeats):
        first = start(nodes, ORDERS, repeat, bits)
        graph = checkpointed(best(first if graph is None else graph.unionByName(first), k))
        count = lambda: graph.agg(F.sum((F.col("sim") >= THRESHOLD).cast("long"))).first()[0] or 0
        before = count()
        for turn in range(rounds):
            graph = checkpointed(best(graph.unionByName(joined(nodes, graph, 10 * repeat + turn)), k))
            now = count()
            if now <= 1.001 * before:
                break  # lists of links have settled
            before = now
        labels = checkpointed(components(graph.where(F.col("sim") >= THRESHOLD).select(F.col("u").alias("a"), F.col("v").alias("b"))))
        sets = checkpointed(put_together(nodes, labels))
        *seen, missing = audit(nodes, sets, audited, repeat)
        audits.append(tuple(seen))
        if not missing:
            break
        k *= 2
    else:  # what the lists could not find is compared whole
        whole = F.when(F.col("grp").isin(missing), F.unhex(F.md5(F.encode("grp", "UTF-8"))))
        sets = nodes.select("node", "grp").join(sets, "node", "left").select("node", F.coalesce(whole, "comp").alias("comp")).where("comp is not null")
    members = nodes.join(sets, "node").withColumn("weight", F.octet_length("vec")).withColumnRenamed("vec", "payload")
    placed, shards = blocks.place(members, BLOCK_NODES, BLOCK_BYTES, SHARD_BYTES)
    found = checkpointed(blocks.compare(placed, shards, lambda p, side: cosines(p, side, THRESHOLD)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    told = nodes.select("node", "copies").join(labels, "node", "left").join(links, "node", "left")
    told = told.select("node", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # what is joined by node or label stands by, so that a vector of very many rows, or a large component, can be split
    linked, alone = rows.where("node is not null").select("vec_id", "node"), rows.where("node is null").select("vec_id")
    out = checkpointed(linked.join(checkpointed(told), "node"))
    least = checkpointed(out.groupBy("label").agg(F.min("vec_id").alias("component_id")))
    out = out.join(least, "label").select("vec_id", "n_links", "component_id")
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), audits
