"""Operator 3: near-duplicate vectors by a forest of random-projection trees.

* Equal vectors of a label are one class; trees hold classes, so a very common vector is one row.
* A tree's levels have a random direction each and its nodes a threshold, the median of the projections that reach it.
  The top is fitted on a bounded sample (`sample` classes, by hash of the id) down to nodes of about `leaf` classes as
  estimated; every class is routed. Inside the leaf's group the recursion goes on over all its classes.
* Spill: a class whose projection is near the threshold goes both ways. The width is the standard deviation, over random
  directions, of the projection of a pair at the similarity bound, times `spill`; a pair is parted in a tree only if its
  projections differ by more than twice that around the threshold.
* Where a node's points mostly fall into the spill (a dense cluster), splitting ends. If such a leaf is large, its
  classes are dealt into blocks and every two blocks are compared in a task of their own.
* Inside a leaf all pairs are compared by cosine in double precision, so a pair found is a link; trees are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Scratch
from larchway.llm.components import connected_components


def directions(tree: int, levels: int, size: int) -> np.ndarray:
    d = np.random.default_rng([tree, size]).standard_normal((size, levels))
    return d / np.linalg.norm(d, axis=0)


def split(p: np.ndarray, width: float) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Threshold and who goes left and right; None where the spill leaves either child nearly as large as the node."""
    at = float(np.median(p))
    left, right = p <= at + width, p >= at - width
    return None if max(left.sum(), right.sum()) > 0.75 * len(p) else (at, left, right)


def links_among(x: np.ndarray, rows: np.ndarray, least: float, tree: int, level: int, width: float, leaf: int, out: list) -> None:
    """Appends (i, j) of linked rows below a node; x: unit vectors in double precision."""
    if len(rows) > leaf:
        d = directions(1000 + tree, level + 1, x.shape[1])[:, level]
        found = split(x[rows] @ d, width)
        if found and level < 40:
            for side in found[1:]:
                links_among(x, rows[side], least, tree, level + 1, width, leaf, out)
            return
    for at in range(0, len(rows), 512):
        i, j = np.nonzero(x[rows[at : at + 512]] @ x[rows[at:]].T >= least)
        ahead = j > i
        out.append(np.stack([rows[at + i[ahead]], rows[at + j[ahead]]]))


def fit_top(sample: list, trees: int, scale: float, leaf: int, width_of) -> dict:
    """Nodes of all trees: for (tree, label, size) the root; arrays of threshold, left, right, blocks (0: an inner node)."""
    groups: dict = {}
    for label, vector in sample:
        groups.setdefault((label, len(vector)), []).append(vector)
    roots, thr, kids, blocks = {}, [], [], []

    def node(p: np.ndarray, rows: np.ndarray, level: int, width: float) -> int:
        me = len(thr)
        thr.append(0.0)
        kids.append((-1, -1))
        size = len(rows) * scale
        blocks.append(1)
        found = split(p[rows, level], width) if size > leaf and len(rows) >= 32 and level < p.shape[1] else None
        if found:
            thr[me], blocks[me] = found[0], 0
            kids[me] = tuple(node(p, rows[s], level + 1, width) for s in found[1:])
        elif size > 8 * leaf:
            blocks[me] = int(np.ceil(size / (2 * leaf)))
        return me

    for (label, size), vectors in groups.items():
        x = np.array(vectors)
        for t in range(trees):
            roots[t, label, size] = node(x @ directions(t, 24, size), np.arange(len(x)), 0, width_of(size))
    return {"roots": roots, "thr": np.array(thr), "kids": np.array(kids).reshape(-1, 2), "blocks": np.array(blocks)}


def unit(batch_column, size: int) -> np.ndarray:
    x = np.array([np.frombuffer(v.as_buffer(), "<f8") for v in batch_column]).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, least: float = 0.98, trees: int = 6, leaf: int = 512, small: int = 128, sample: int = 20_000, spill: float = 1.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of `vectors(key, vector, label, ...)`; other columns are ignored.

    Rows link when their labels are equal and not null and the cosine is at least `least`. Vectors that are null or
    zero, hold null or non-finite components, or have no id link with nothing; vectors of different sizes never link.
    Such rows have no links and are their own component. Repeated rows are vectors of their own and link with each
    other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    kind = vectors.schema[label].dataType.simpleString()
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([np.array(v, "<f8").tobytes() for v in b.column(2).to_pylist()], pa.binary())], names=["vec_id", "label", "v"])

    rows = scratch.table(base.where(usable).mapInArrow(packed, f"vec_id bigint, label {kind}, v binary"), "rows")
    classes = scratch.table(rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    width_of = lambda size: spill * (2 - 2 * least) ** 0.5 / size**0.5 / 2
    whole = [(r["label"], np.frombuffer(r["v"], "<f8")) for r in picked]
    top = spark.sparkContext.broadcast(fit_top([(a, v / np.linalg.norm(v)) for a, v in whole], trees, max(1.0, n / max(1, len(picked))), leaf, width_of))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top.value
        for batch in batches:
            labels, lens = batch.column(1).to_pylist(), np.array([len(v.as_buffer()) // 8 for v in batch.column(2)])
            for size in np.unique(lens):
                own = np.nonzero(lens == size)[0]
                x = unit(batch.column(2).take(pa.array(own)), size)
                for tree in range(trees):
                    p = x @ directions(tree, 24, size)
                    at, i = np.array([t["roots"].get((tree, labels[k], size), -1) for k in own]), np.arange(len(own))
                    ends, level = [(at[at < 0], i[at < 0])], 0
                    at, i = at[at >= 0], i[at >= 0]
                    while len(at):
                        done = t["blocks"][at] > 0
                        ends.append((at[done], i[done]))
                        at, i = at[~done], i[~done]
                        q, thr, w = p[i, min(level, 23)], t["thr"][at], width_of(size)
                        go = [q <= thr + w, q >= thr - w]
                        at, i = (np.concatenate([t["kids"][at[g], s] for s, g in enumerate(go)]), np.concatenate([i[g] for g in go])) if len(at) else (at, i)
                        level += 1
                    at, i = (np.concatenate(c) for c in zip(*ends, strict=True))
                    n_blocks = np.where(at >= 0, t["blocks"][at], 1) if len(t["blocks"]) else np.ones(len(at), int)
                    block = own[i] * 0 + np.array([hash(v.as_py()) for v in batch.column(0).take(pa.array(own[i]))], np.int64) % n_blocks
                    again = np.repeat(np.arange(len(at)), n_blocks)
                    other = np.concatenate([np.arange(b) for b in n_blocks]) if len(at) else np.zeros(0, np.int64)
                    at, i, block = at[again], i[again], block[again]
                    taken = batch.take(pa.array(own[i]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in (np.full(len(at), tree), at, np.minimum(block, other), np.maximum(block, other))), *taken.columns], names=["tree", "leaf", "low", "high", "id", "label", "v"])

    def compared(table: pa.Table) -> pa.Table:
        ids, out = table.column("id").to_numpy(), []
        raw = table.column("v").combine_chunks()
        lens = np.array([len(v.as_buffer()) // 8 for v in raw])
        tree = table.column("tree")[0].as_py()
        for size in np.unique(lens):
            own = np.nonzero(lens == size)[0]
            found: list[np.ndarray] = []
            links_among(unit(raw.take(pa.array(own)), size), np.arange(len(own)), least, tree, 0, width_of(size), small, found)
            pairs = ids[own[np.concatenate(found, axis=1)]] if found else np.zeros((2, 0), np.int64)
            out.append(np.unique(np.stack([pairs.min(0), pairs.max(0)]), axis=1))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = classes.select("id", "label", "v").mapInArrow(routed, f"tree int, leaf int, low int, high int, id bigint, label {kind}, v binary")
    pairs = dealt.groupBy("tree", "label", "leaf", "low", "high").applyInArrow(lambda _, t: compared(t), "a bigint, b bigint")
    links = scratch.table(pairs.distinct(), "links")
    groups = connected_components(links, scratch)

    copies = classes.select("id", "copies")
    both = links.select(F.col("a").alias("id"), F.col("b").alias("o")).union(links.select("b", "a"))
    reached = both.join(copies.withColumnsRenamed({"id": "o", "copies": "m"}), "o").groupBy("id").agg(F.sum("m").alias("others"))
    found = classes.join(reached, "id", "left").join(groups, "id", "left")
    found = found.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.join(found, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
