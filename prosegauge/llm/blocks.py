"""Exact all-pairs comparison inside components, as blocks of bounded size.

Small components share a task; a large one is cut into blocks, and each pair of blocks is a task of its own. Every pair
is compared once; only a label and a link count of each node leave a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean_group, small_batches


def place(members: DataFrame, block_nodes: int, block_bytes: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """members (node, comp, weight in bytes, ...) with the number of blocks of each component; the number of shared tasks."""
    sizes = checkpointed(members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")))  # a plain side of the join: a large component can be split
    blocks = F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("bytes") / block_bytes), F.lit(1))
    total = members.agg(F.sum("weight")).first()[0] or 0
    return members.join(sizes.select("comp", blocks.cast("long").alias("blocks")), "comp"), int(total // shard_bytes) + 1


def compare(placed: DataFrame, shards: int, linked: Callable[[list[bytes], np.ndarray | None], np.ndarray]) -> DataFrame:
    """Rows (node, label, links) of placed (node, comp, copies, payload, blocks): links weighted by copies, from each task
    that found some for the node, and the smallest node linked to it in that task."""
    own = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    dealt = dealt.select(
        "node", "comp", "copies", "payload", "block",
        F.when(one, F.pmod(F.xxhash64("comp"), F.lit(shards))).otherwise(F.lit(-1)).alias("shard"),
        F.when(one, F.lit(b"")).otherwise(F.col("comp")).alias("big"),
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
    )
    small_batches(placed.sparkSession)

    def run(task: pa.Table) -> pa.Table:
        return _task(task, linked)

    return dealt.groupBy("shard", "big", "bi", "bj").applyInArrow(lean_group(run), "node binary, label binary, links bigint")


def settle(ok: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links."""
    label = np.arange(len(ok))
    while True:
        new = np.minimum(label, np.where(ok, label[None], len(ok)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _task(table: pa.Table, linked: Callable) -> pa.Table:
    node, comp, copies, load, block, bi, bj = (table.column(c).to_pylist() for c in ("node", "comp", "copies", "payload", "block", "bi", "bj"))
    groups: dict = {}
    for i, c in enumerate(comp):
        groups.setdefault(c, {})[node[i]] = i  # a node that came twice counts once
    out: list[tuple] = []
    for members in groups.values():
        at = [members[k] for k in sorted(members)]
        if len(at) > 1:
            side = np.array([block[i] for i in at]) if bi[at[0]] != bj[at[0]] else None
            ok = linked([load[i] for i in at], side)
            links = ok @ np.array([copies[i] for i in at], np.int64)
            out += [(node[i], node[at[k]], int(n)) for i, k, n in zip(at, settle(ok), links, strict=True) if n]
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"node": pa.array(a, pa.binary()), "label": pa.array(b, pa.binary()), "links": pa.array(c, pa.int64())})
