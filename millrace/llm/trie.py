"""Prefix tries of conversations by splitters and a skeleton.

A turn is a key of 32 hexadecimal digits (a hash of role and text, and the
text's words), a conversation the text of its keys, its path: paths sort as a
depth-first walk through the trie. Splitters deal sorted paths into shards.
Only prefixes of splitters, the skeleton, have members in several shards; every
other node is finished by one walk over its shard, which holds the nodes on the
current path. Of skeleton nodes each shard hands on what it has, Spark adds it
up, and one walk of the same kind over the skeleton ends it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import WHITE, ready, stored

BLOCK = 20  # conversations that share the beginning of the first of them
HEADS = 4  # different numbers of shared turns, from 0
KEY = 32  # digits of a turn's key
SHARD_TURNS = 50_000
SAMPLES = 8  # paths a shard that splitters are chosen from
PIECE = 1 << 20  # bytes of joined ids that a task holds
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """24 digits of a SHA-256 over role and text, and the number of words of the text in 8."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    words = F.size(F.array_remove(F.split(text, WHITE), ""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, KEY - 8), F.lower(F.lpad(F.hex(words), 8, "0")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id and path of every conversation, with the beginning that it shares with the first of its block."""
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", turn_key(F.col("role"), F.col("text")).alias("key")).alias("t"))
    keys = own.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["key"]).alias("keys"))
    keys = stored(keys, "turns")
    first = keys.where(F.col("conv_id") % BLOCK == 0).select("conv_id", F.slice("keys", 1, HEADS - 1).alias("head"))
    steps = F.array(*(F.lit(k).cast("long") for k in range(1 - BLOCK, BLOCK)))
    near = first.select(F.col("conv_id").alias("base"), F.explode(F.transform(steps, lambda k: F.try_add("conv_id", k))).alias("conv_id"), "head")
    near = near.where(F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("base")).drop("base")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), shared)
    return keys.join(near, "conv_id", "left").select("conv_id", F.array_join(F.concat(head, F.slice("keys", shared + 1, F.size("keys"))), "").alias("path"))


def joined_ids(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """cid, ends: SHA-256 of each class's ids in order, joined by commas.

    Ids are sorted by ranges, so a class of any size is spread; each task joins
    its ids to pieces of about ``piece`` bytes at most, and the pieces of one class
    pass one after another through one task.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, size, held = None, None, 0, []
        out: tuple[list, list, list] = ([], [], [])

        def end() -> None:
            if now is not None:
                for column, value in zip(out, (now, start, ",".join(held)), strict=True):
                    column.append(value)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["cid", "start", "ids"])

        for batch in batches:
            for cid, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if cid != now or size > piece:
                    end()
                    now, start, size, held = cid, conv, 0, []
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out[0]) >= 10_000 or size > piece // 2:
                yield rows()
                out = ([], [], [])
        end()
        yield rows()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for cid, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if cid != now:
                    if state:
                        out[0].append(now)
                        out[1].append(state.hexdigest())
                    now, state = cid, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["cid", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["cid", "ends"])

    ordered = members.select("cid", "conv_id").repartitionByRange("cid", "conv_id").sortWithinPartitions("cid", "conv_id")
    cut = ordered.mapInArrow(pieces, "cid string, start long, ids string")
    return cut.repartition("cid").sortWithinPartitions("cid", "start").select("cid", "ids").mapInArrow(hashed, "cid string, ends string")


def _shared(a: str, b: str) -> int:
    """The number of turns in which two paths begin alike."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * KEY] == b[: mid * KEY] else (low, mid - 1)
    return low


def splitters(paths: list[str], shards: int) -> list[str]:
    """Borders of about so many shards from sorted sampled paths, each no longer than to tell it from the path before."""
    step = max(1, len(paths) // shards)
    ends = [paths[k][: (_shared(paths[k - 1], paths[k]) + 1) * KEY] for k in range(step, len(paths), step)]
    return sorted(set(ends))


def skeleton(borders: list[str]) -> dict[str, int]:
    """All prefixes of the splitters, the root included, numbered in their order."""
    return {p: k for k, p in enumerate(sorted({b[: k * KEY] for b in borders for k in range(len(b) // KEY + 1)} | {""}))}


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
NODE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


class Walk:
    """A depth-first walk over sorted paths that holds one frame per turn of the current path.

    A frame is [least id, members, children, leaves, saved, ends, finished
    children, mark]. ``shared`` names the skeleton nodes that a shard can't
    finish: their frames go to ``open``, all other nodes to ``done`` when their
    parent is known, those below the skeleton with their parent's number.
    Without ``shared`` every node is finished and keeps its own mark.
    """

    def __init__(self, shared: dict[str, int] | None) -> None:
        self.shared, self.path, self.stack = shared, None, []
        self.done: list[tuple] = []
        self.open: list[tuple] = []

    def _in_skeleton(self, depth: int) -> bool:
        return self.shared is not None and self.path[: depth * KEY] in self.shared

    def _leave(self) -> None:
        depth = len(self.stack) - 1
        frame = self.stack.pop()
        least, n, children, leaves, saved, ends, kids, mark = frame
        if depth <= self.fixed:
            at = self.shared[self.path[: depth * KEY]]
            self.done += [(*kid[:-1], at) for kid in kids]
            self.open.append((at, least, n, children, leaves, saved, ends))
            self.fixed = depth - 1
            return
        self.done += [(kid[0], kid[1], least, *kid[3:]) for kid in kids]
        leaves = leaves if children else 1
        saved += (n - 1) * int(self.path[depth * KEY - 8 : depth * KEY], 16) if depth else 0
        node = (least, depth, None, n, children, leaves, saved, ends or EMPTY, mark)
        if not self.stack:
            self.done.append(node)
            return
        above = self.stack[-1]
        above[0] = least if above[0] is None else min(above[0], least)
        above[1] += n
        above[2] += 1
        above[3] += leaves
        above[4] += saved
        above[6].append(node)

    def visit(self, path: str, least: int | None, n: int, children: int, leaves: int, saved: int, ends: str | None, mark: int | None = None) -> None:
        depth = len(path) // KEY
        keep = 0 if self.path is None else _shared(self.path, path)
        while len(self.stack) > keep + 1:
            self._leave()
        self.path = path
        if not self.stack:
            self.fixed = -1
        while len(self.stack) <= depth:
            here = len(self.stack)
            self.stack.append([None, 0, 0, 0, 0, None, [], None])
            if self.fixed == here - 1 and self._in_skeleton(here):
                self.fixed = here
        top = self.stack[-1]
        top[0] = least if top[0] is None else top[0] if least is None else min(top[0], least)
        top[1] += n
        top[2] += children
        top[3] += leaves
        top[4] += saved
        top[5], top[7] = ends or top[5], mark

    def close(self) -> None:
        while self.stack:
            self._leave()
        self.path = None


def _walked(shared: dict[str, int] | None, per_shard: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of nodes: finished ones with ``at`` of a skeleton parent, and the parts of skeleton nodes (``part`` true)."""

    def rows(walk: Walk) -> pa.RecordBatch:
        done, parts = walk.done, walk.open
        walk.done, walk.open = [], []
        both = [(*d, False) for d in done] + [(least, None, None, n, children, leaves, saved, ends, at, True) for at, least, n, children, leaves, saved, ends in parts]
        columns = list(zip(*both, strict=True)) or [()] * (len(NODE) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*NODE_TYPES, pa.int64(), pa.bool_()], strict=True)], [*NODE, "at", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now = Walk(shared), None
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # row by row along the path
                if per_shard and shard != now:
                    walk.close()
                    now = shard
                walk.visit(*row)
            if len(walk.done) + len(walk.open) > 5_000:
                yield rows(walk)
        walk.close()
        yield rows(walk)

    return run


NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, at long, part boolean"
ROW = ["shard", "path", "least", "n", "children", "leaves", "saved", "ends"]


def nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text. Turns go by number, null first,
    ties by role and then by a hash of role and text; repeated rows are turns
    each. Null role or text is empty. Rows without conv_id belong to no
    conversation. Turns are compared by 96 bits of a SHA-256 and their number
    of words. Other columns are not looked at; an empty table gives no nodes. A
    conversation's keys are one row (32 bytes a turn); equal conversations are
    one row before paths are sorted. To the driver go ``SAMPLES`` paths a shard.
    """
    spark = turns.sparkSession
    ready(spark)
    convs = rebuilt(turns.select("conv_id", "turn", "role", "text")).withColumn("cid", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 32))
    convs = stored(convs, "rebuilt")
    classes = convs.groupBy("cid", "path").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.join(joined_ids(convs), "cid"), "classes")

    length = F.length("path") / KEY
    distinct, total = classes.agg(F.count("*"), F.sum(length)).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((total or 0) // shard_turns) + 1)
    share = min(1.0, SAMPLES * shards / max(distinct, 1))
    sampled = F.conv(F.substring("cid", 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    borders = splitters(sorted(r[0] for r in classes.where(sampled).select("path").collect()), shards)
    shared = skeleton(borders)
    known = spark.sparkContext.broadcast((borders, shared))

    @F.arrow_udf("long")
    def shard_of(path: pa.Array) -> pa.Array:
        return pa.array([bisect_right(known.value[0], p) for p in path.to_pylist()], pa.int64())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walked(known.value[1], True)(batches)

    zero = F.lit(0).cast("long")
    dealt = classes.select(shard_of("path").alias("shard"), "path", "least", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path").select(ROW)
    found = stored(dealt.mapInArrow(local, NODE_SCHEMA), "nodes")

    # Parts of skeleton nodes: as many rows as there are nodes in the skeleton, which the splitters bound.
    parts = found.where("part").groupBy("at").agg(F.min("conv_id").alias("least"), *(F.sum(c).alias(n) for c, n in (("n_convs", "n"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"))), F.max("ends").alias("ends"))
    names = spark.createDataFrame([(k, p) for p, k in shared.items()], "at long, path string")
    parts = parts.join(F.broadcast(names), "at").select(zero.alias("shard"), *ROW[1:], "at")
    ended = stored(parts.coalesce(1).sortWithinPartitions("path").mapInArrow(_walked(None, False), NODE_SCHEMA), "skeleton")
    above = F.broadcast(ended.select("at", F.col("conv_id").alias("above")))
    below = found.where("NOT part").join(above, "at", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    every = below.select(NODE).unionByName(ended.select(NODE))
    return every.withColumnRenamed("ends", "ends_sha256")
