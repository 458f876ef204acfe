"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

A graph's layers are flat arrays of neighbours, one row per vector. Vectors are
inserted in groups: a group is searched for in the graph so far, all of it at
once, and then linked. Shards are searched separately and their results merged.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import ready, stored

LINKS = 16  # neighbours of a vector on the upper layers; the lowest has twice as many
BEAM_BUILD = 64
BEAM_SEARCH = 96
SHARD_ROWS = 8192  # vectors of a shard, about
GROUP = 256  # vectors that are searched for at once
QUERY_BLOCK = 512


class Graph:
    """Over unit vectors; nearness is the inner product."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BEAM_BUILD, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.links, self.beam = links, beam
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum(np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(np.int64), 8)
        if n:
            self.level[0] = self.level.max()  # the entry is on every layer
        self.layers = [np.full((n, links * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max()) + 1 if n else 0)]
        at, size = 1, 1
        while at < n:  # groups as large as the graph so far at most
            group = np.arange(at, min(n, at + min(size, GROUP)))
            self._insert(group)
            at, size = int(group[-1]) + 1, at + len(group)

    def _near(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("qd,qkd->qk", queries, self.x[ids])

    def _search(self, queries: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries side by side; ids and nearness, best first, -1 where none."""
        q, links = len(queries), self.layers[layer]
        ids = np.full((q, beam), -1, np.int64)
        near = np.full((q, beam), -np.inf, np.float32)
        width = start.shape[1]
        ids[:, :width] = start
        near[:, :width] = np.where(start >= 0, self._near(queries, start), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        opened = ids < 0
        seen = np.zeros((q, len(self.x)), bool)
        rows = np.arange(q)
        seen[rows[:, None], np.maximum(start, 0)] = True
        live = rows
        while len(live):
            todo = ~opened[live]
            live = live[todo.any(axis=1)]
            if not len(live):
                break
            at = (~opened[live]).argmax(axis=1)
            opened[live, at] = True
            found = links[ids[live, at]].astype(np.int64)
            fresh = (found >= 0) & ~seen[live[:, None], np.maximum(found, 0)]
            safe = np.where(fresh, found, 0)
            seen[np.broadcast_to(live[:, None], found.shape)[fresh], found[fresh]] = True
            score = np.where(fresh, self._near(queries[live], safe), -np.inf)
            all_ids = np.concatenate([ids[live], np.where(fresh, found, -1)], axis=1)
            all_near = np.concatenate([near[live], score], axis=1)
            all_open = np.concatenate([opened[live], ~fresh], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            near[live] = np.take_along_axis(all_near, order, 1)
            opened[live] = np.take_along_axis(all_open, order, 1)
        return ids, near

    def _enter(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """The nearest vector found by greedy steps from the top to the layer above ``down_to``."""
        start = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, down_to, -1):
            start = self._search(queries, start, layer, 1)[0]
        return start

    def _pick(self, centre: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """For each row up to ``most`` neighbours, best first, that are nearer to it than to one picked before; then the best of the rest."""
        q, k = ids.shape
        out = np.full((q, most), -1, np.int32)
        safe = np.maximum(ids, 0)
        between = np.einsum("qad,qbd->qab", self.x[safe], self.x[safe])
        picked = np.zeros((q, k), bool)
        for c in range(k):
            blocked = (picked & (between[:, c, :] > near[:, c : c + 1])).any(axis=1)
            picked[:, c] = (ids[:, c] >= 0) & ~blocked & (picked.sum(axis=1) < most)
        order = np.argsort(np.where(ids < 0, 2, ~picked), axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(ids, order, 1)
        out[:, : best.shape[1]] = best
        return out

    def _insert(self, group: np.ndarray) -> None:
        q = self.x[group]
        start = np.zeros((len(group), 1), np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            on = self.level[group] >= layer
            beam = self.beam if on.any() else 1
            ids, near = self._search(q, start, layer, beam)
            # The group's own members are near each other as well.
            if on.any():
                mates = group[on]
                own = q[on] @ q[on].T
                np.fill_diagonal(own, -np.inf)
                k = min(len(mates) - 1, self.links)
                order = np.argsort(-own, axis=1, kind="stable")[:, :k]
                all_ids = np.concatenate([ids[on], mates[order]], axis=1)
                all_near = np.concatenate([near[on], np.take_along_axis(own, order, 1)], axis=1)
                best = np.argsort(-all_near, axis=1, kind="stable")[:, : self.beam]
                all_ids, all_near = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_near, best, 1)
                self.layers[layer][mates] = self._fit(self._pick(q[on], all_ids, all_near, self.links), layer)
                self._link_back(mates, layer)
            start = ids[:, :1]

    def _fit(self, picked: np.ndarray, layer: int) -> np.ndarray:
        out = np.full((len(picked), self.layers[layer].shape[1]), -1, np.int32)
        out[:, : picked.shape[1]] = picked
        return out

    def _link_back(self, mates: np.ndarray, layer: int) -> None:
        """Neighbours link to the new vectors too; who has too many picks anew."""
        links = self.layers[layer]
        to = links[mates]
        target, source = to[to >= 0].astype(np.int64), np.broadcast_to(mates[:, None], to.shape)[to >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first = np.unique(target, return_index=True)
        for node, new in zip(nodes.tolist(), np.split(source, first[1:]), strict=True):
            old = links[node][links[node] >= 0]
            both = np.concatenate([old, new[~np.isin(new, old)]])
            if len(both) <= links.shape[1]:
                links[node, : len(both)] = both
                continue
            near = self.x[both] @ self.x[node]
            best = np.argsort(-near, kind="stable")
            links[node] = self._pick(self.x[node][None], both[best][None], near[best][None], links.shape[1])[0]

    def find(self, queries: np.ndarray, k: int, beam: int = BEAM_SEARCH) -> np.ndarray:
        """Places of up to ``k`` near vectors for each query, -1 where none."""
        if not len(self.x):
            return np.full((len(queries), k), -1, np.int64)
        return self._search(queries, self._enter(queries, 0), 0, max(k, beam))[0][:, :k]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"x": self.x, "level": self.level, **{f"layer{k}": a for k, a in enumerate(self.layers)}}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.x, graph.level, graph.links, graph.beam = arrays["x"], arrays["level"], LINKS, BEAM_BUILD
        graph.layers = [arrays[f"layer{k}"] for k in range(sum(a.startswith("layer") for a in arrays))]
        return graph


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    wide = vector.cast("array<double>")
    return F.coalesce(F.forall(wide, finite) & F.exists(wide, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # first, as squares of extreme components leave the range
    x = x / top
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Double precision; each row's value depends on the two vectors only."""
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * math.sqrt(float((query * query).sum())))


def build(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per shard and dimension: the distinct vectors' ids, components and graph, as flat arrays in ``data``.

    Takes ``vec_ids`` (the smallest ids of equal vectors) and ``vector``.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table["vector"].to_pylist(), np.float64)
        ids = table["vec_ids"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        x, ids = x[order], [ids[k] for k in order]
        graph = Graph(_unit(x))
        flat, ends = np.array([i for g in ids for i in g], np.int64), np.cumsum([len(g) for g in ids])
        data = _packed(raw=x, ids=flat, ends=ends, **graph.arrays())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.element_at("vec_ids", 1)), F.lit(shards)))
    return dealt.groupBy("shard", F.size("vector").alias("dim")).applyInArrow(run, "shard long, dim int, data binary")


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row, all rows but itself being candidates.

    Nearness is the cosine in double precision of the vectors as given; ties go
    to the smaller id. Equal vectors are one node of a graph, whose k + 1
    smallest ids can be results, so copies neither crowd a graph nor cost rows.
    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without id; vectors are compared with those of their own
    length. A query gets all candidates if they are fewer than ``k``; repeated
    rows are one, as query and as candidate, and an id with several vectors is
    as near as the nearest of them. An empty table gives no rows.
    """
    ready(embeddings.sparkSession)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    first = Window.partitionBy("vector").orderBy("id")
    least = rows.select("id", "vector").withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1)
    distinct = stored(least.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("vec_ids")), "vectors")
    shards = max(1, math.ceil(distinct.count() / shard_rows))
    index = stored(build(distinct, shards), "graphs")

    def block(key: tuple, table: pa.Table) -> pa.Table:
        data = _packed(ids=np.array(table["id"].to_pylist(), np.int64), x=np.array(table["vector"].to_pylist(), np.float64))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([data], pa.binary())})

    asked = stored(rows.where(F.coalesce(F.col("asked"), F.lit(False))).select("id", "vector").distinct(), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    dealt = asked.groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    blocked = stored(dealt.applyInArrow(block, "dim int, block binary"), "query_blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_data, data in zip(batch.column("block"), batch.column("data"), strict=True):
                asked, shard = _unpacked(block_data.as_py()), _unpacked(data.as_py())
                graph, starts = Graph.of(shard), np.concatenate([[0], shard["ends"]])
                found = np.concatenate([graph.find(_unit(asked["x"][a : a + GROUP]), 2 * k + 2) for a in range(0, len(asked["x"]), GROUP)])
                out: list[tuple[int, int, float]] = []
                for own, q, at in zip(asked["ids"].tolist(), asked["x"], found, strict=True):
                    at = at[at >= 0]
                    scores = cosine(q, shard["raw"][at])
                    best: dict[int, float] = {}
                    for p, s in zip(at, scores.tolist(), strict=True):
                        best.update((i, max(s, best.get(i, s))) for i in shard["ids"][starts[p] : starts[p + 1]].tolist() if i != own)
                    out.extend((own, i, -s) for s, i in sorted((-s, i) for i, s in best.items())[:k])
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    # Each block of queries meets every shard in a task that reads some of both. Blocks repeated for each shard may not be
    # joined by a key: Spark takes them for as large as the blocks alone and broadcasts them, and a shuffle writes them all.
    pairs = index.hint("shuffle_replicate_nl").join(blocked, "dim").select("block", "data")
    hits = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
