"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics come from whole texts and are written once, for training and scores
alike. Equal statistics with equal labels are one weighted row, of which at
most about ``SAMPLE_ROWS`` are learned from. Every tree is a complete binary
tree in flat arrays (feature, border, leaf), so that a batch of documents walks
down all trees by numpy indexing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import id_crc, ready, stored

SAMPLE_ROWS = 50_000  # expected number of different labelled rows that are learned from
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
L2 = 1.0
LEAST_HESSIAN = 2.0  # in a leaf
PREDICT = 0.3  # least score of predicted quality 1

MARKS = b"#*$%&|<>~^=+_@\\/{}[]"  # symbols that prose has hardly any of
_OF = np.zeros((256, 7), np.int64)  # what a byte counts as
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!", MARKS, b" \t\n\x0b\x0c\r")):
    _OF[list(_set), _k] = 1

FEATURES = (
    "log_words", "word_length", "longest_word", "distinct", "commonest", "entropy", "again", "longest_run", "repeated_windows",
    "line_words", "duplicate_lines", "short_lines", "upper", "digits", "stops", "shouts", "symbols", "symbol_words", "short_words",
    "foreign", "byte_entropy", "long_words",
)


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a whole text; all zero without words."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, stops, shouts, symbols, white = (seen @ _OF).tolist()
    chars = len(raw) - white
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    lengths = np.fromiter(map(len, place), np.int64, len(place))
    same = ids[1:] == ids[:-1]
    ends = np.flatnonzero(np.append(~same, True))
    run = int(np.diff(np.append(-1, ends)).max())
    windows = 0
    if n > 2 and len(place) < n:
        # the ids of three words in one number, or else in pairs numbered anew
        two = ids[:-1] * len(place) + ids[1:]
        _, two = np.unique(two, return_inverse=True)
        _, at, times = np.unique(two[:-1] * len(place) + ids[2:], return_inverse=True, return_counts=True)
        windows = int((times[at] > 1).sum())
    lines = [x for x in (line.strip() for line in raw.split(b"\n")) if x]
    marked = sum(int(counts[k]) for w, k in place.items() if len(w.translate(None, MARKS)) < len(w))
    return [
        math.log(n + 1), chars / n, math.log(int(lengths.max()) + 1), len(place) / n, int(counts.max()) / n, _entropy(counts) / math.log2(n + 1),
        int(same.sum()) / n, run / n, windows / n, math.log(n / len(lines) + 1), 1 - len(set(lines)) / len(lines),
        sum(len(x.split(None, 4)) < 4 for x in lines) / len(lines), upper / max(upper + lower, 1), digits / chars, stops / n, shouts / n,
        symbols / chars, marked / n, int(counts[lengths < 3].sum()) / n, int(seen[128:].sum()) / chars, _entropy(seen), int(counts[lengths > 12].sum()) / n,
    ]


class Forest:
    """Trees in flat arrays: ``feature`` and ``border`` of the inner nodes, level by level, and ``leaf`` values."""

    def __init__(self, edges: list[np.ndarray], base: float, depth: int) -> None:
        self.edges, self.base, self.depth = edges, base, depth
        self.feature: list[np.ndarray] = []
        self.border: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Each value's bin: the number of borders below it."""
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def leaves(self, bins: np.ndarray, tree: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        feature, border = self.feature[tree], self.border[tree]
        for _ in range(self.depth):
            at = 2 * at + 1 + (bins[rows, feature[at]] > border[at])
        return at - (2**self.depth - 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k in range(len(self.leaf)):
            out += self.leaf[k][self.leaves(bins, k)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.binned(x))))


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, border and leaf values of one tree, and each row's leaf; a node without gain sends all rows left."""
    n, width = bins.shape
    feature, border = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
    at = np.zeros(n, np.int64)
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        best = np.full(nodes, 1e-9)
        for f in range(width):
            key = (at - first) * BINS + bins[:, f]
            gs, hs = (np.bincount(key, v, nodes * BINS).reshape(nodes, BINS) for v in (g, h))
            left_g, left_h = gs.cumsum(1), hs.cumsum(1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
            at_bin = gain.argmax(1)
            value = gain[np.arange(nodes), at_bin]
            better = value > best
            best[better] = value[better]
            feature[first : first + nodes][better], border[first : first + nodes][better] = f, at_bin[better]
        at = 2 * at + 1 + (bins[np.arange(n), feature[at]] > border[at])
    at -= 2**depth - 1
    gs, hs = (np.bincount(at, v, 2**depth) for v in (g, h))
    return feature, border, -RATE * gs / (hs + L2), at


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for the probability of ``y`` (0 to 1); without rows every score is one half."""
    if not len(x):
        return Forest([np.zeros(0)] * len(FEATURES), 0.0, depth)
    edges = []
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        reached = np.cumsum(weight[order]) / weight.sum()
        edges.append(np.unique(x[order, k][np.minimum(np.searchsorted(reached, np.arange(1, BINS) / BINS), len(x) - 1)]))
    mean = np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    forest = Forest(edges, float(np.log(mean / (1 - mean))), depth)
    bins, margin = forest.binned(x), np.full(len(x), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        feature, border, leaf, at = _grow(bins, weight * (p - y), weight * p * (1 - p), depth)
        forest.feature.append(feature)
        forest.border.append(border)
        forest.leaf.append(leaf)
        margin += leaf[at]
    return forest


def score(docs: DataFrame, labels: DataFrame, held: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (score of at least ``PREDICT``).

    ``held`` marks rows whose labels aren't learned from; by default those whose
    id's crc32 is divisible by 5. Labels are 0 or 1; several of one id count by
    their mean, null ones and null ids not at all. Only statistics of the whole
    text are inputs. Null and empty texts have all statistics zero and get the
    score of such. Repeated rows are scored each and add weight. Without any
    label every score is one half. Other columns are not looked at; an empty
    table gives no rows. Of different labelled rows about ``rows`` are learned
    from, chosen by a hash, and these alone reach the driver.
    """
    spark = docs.sparkSession
    ready(spark)
    held = F.coalesce(id_crc(doc_id) % 5 == 0 if held is None else held, F.lit(False))
    kind = docs.schema[doc_id].dataType

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(2)], np.float32).reshape(batch.num_rows, len(FEATURES))
            stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], ["doc_id", "held_out", "x"])

    own = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    stats = stored(own.mapInArrow(measured, f"doc_id {kind.simpleString()}, held_out boolean, x array<float>"), "statistics")

    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = stats.where("NOT held_out").join(marks, "doc_id").groupBy("x", "y").agg(F.count("*").cast("double").alias("w"))
    known = stored(known, "labelled")
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 32)) < int(share * (1 << 32))).orderBy("x", "y").toArrow()
    x = chosen["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if chosen.num_rows else np.zeros((0, len(FEATURES)))
    forest = spark.sparkContext.broadcast(train(x, chosen["y"].to_numpy(), chosen["w"].to_numpy()))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = forest.value.score(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            columns = [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= PREDICT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(judged, f"doc_id {kind.simpleString()}, held_out boolean, score double, predicted int")
