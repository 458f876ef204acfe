"""Brown class-based bigrams: exchange clustering assigns words to classes.

A text's probability is the product over its tokens of the class's probability
after the class before, times the word's probability in its class. Classes are
found in two steps. Of the words with ``MIN_COUNT`` uses or more, the ``HEADS`` most
frequent, and the last two bytes of all other words, are exchanged one after
another on the driver, which holds nothing that grows with the input. Then each
other word with ``MIN_COUNT`` uses or more is a unit of its own, a row of a table: it starts in its ending's class and moves
to the class that raises the likelihood most, given the class totals of all.
Rarer words keep their ending's class. Counts of words, units and classes come
from all training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import id_crc, ready, stored, words_of

CLASSES = 64
PASSES = 3
HEADS = 16_384  # words that are exchanged on the driver, one after another
MIN_COUNT = 20  # uses of a word that is exchanged by itself, among these or not
TAIL_PASSES = 1  # of the other words
GROUP_BLOCKS = 1000  # blocks whose places of a word share a row, on average
SMOOTH = 0.1
BLOCK_TOKENS = 2_000_000  # of documents that share one list of words
NO_CLASS = 255


def _squeezed(x: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes: the upper ones are nearly empty."""
    return zlib.compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i4")


def _names(words: bytes) -> list[bytes]:
    return zlib.decompress(words).split()


def encode(docs: DataFrame, held: Column, doc_id: str, text: str) -> DataFrame:
    """One row per block of documents: its words with their training counts, and the tokens as places in that list."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids_type = TaskContext.get().partitionId(), pa.list_(to_arrow_type(kind))
        blocks = count(part << 30)
        ids: list = []
        held_out: list[bool] = []
        tokens: list[np.ndarray] = []
        places: dict[bytes, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, held_out, tokens, places, size
            if not ids:
                return
            lengths = np.array([len(t) for t in tokens], np.int32)
            flat = np.concatenate(tokens)
            learned = flat[np.repeat(~np.array(held_out), lengths)]
            counts = np.bincount(learned, minlength=len(places)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([next(blocks)], pa.int64()),
                    pa.array([ids], ids_type),
                    pa.array([held_out], pa.list_(pa.bool_())),
                    pa.array([lengths.tobytes()], pa.binary()),
                    pa.array([_squeezed(flat)], pa.binary()),
                    pa.array([zlib.compress(b" ".join(places), 1)], pa.binary()),
                    pa.array([counts.tobytes()], pa.binary()),
                ],
                ["block", "ids", "held", "lengths", "tokens", "words", "counts"],
            )
            ids, held_out, tokens, places, size = [], [], [], {}, 0

        for batch in batches:
            for own, out, value in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = words_of(value.as_py())
                for w in words:
                    if w not in places:
                        places[w] = len(places)
                tokens.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                ids.append(own.as_py())
                held_out.append(out.as_py())
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(doc_id).alias("id"), held.alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """block, place, word, n for every word of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(k) for k in range(3)), strict=True):
                names, n = _names(words.as_py()), np.frombuffer(counts.as_py(), np.int32)
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block.as_py())), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.binary()), pa.array(n[at : at + 50_000].astype(np.int64))],
                        ["block", "place", "word", "n"],
                    )

    return blocks.select("block", "words", "counts").mapInArrow(run, "block long, place int, word binary, n long")


class Units:
    """Words with a unit of their own and word endings, numbered; the last number is the end of a text."""

    def __init__(self, words: list[bytes], endings: list[bytes]) -> None:
        self.words = {w: k for k, w in enumerate(words)}
        self.endings = {e: k + len(words) for k, e in enumerate(endings)}
        self.end = len(words) + len(endings)
        self.unknown = self.end - 1 if endings else self.end  # an ending that no training word has

    def of(self, names: list[bytes]) -> np.ndarray:
        word, ending, unknown = self.words.get, self.endings.get, self.unknown
        found = (word(w, -1) for w in names)
        out = np.fromiter(found, np.int32, len(names))
        for k in np.flatnonzero(out < 0).tolist():
            out[k] = ending(names[k][-2:], unknown)
        return out

    def __reduce__(self) -> tuple:
        return _units, (self.__dict__,)


def _units(state: dict) -> Units:
    """The units as they were before pickling, which goes by this name and not by that of the class."""
    units = Units([], [])
    units.__dict__.update(state)
    return units


def _sequence(units: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """All units of the documents in turn, with an end before the first and after each."""
    stops = np.cumsum(lengths) + np.arange(len(lengths)) + 1
    out = np.empty(len(units) + len(lengths) + 1, np.int32)
    mask = np.ones(len(out), bool)
    mask[0] = False
    mask[stops] = False
    out[mask], out[~mask] = units, end
    return out


def _learned(row: dict, units: Units) -> np.ndarray:
    lengths, tokens = np.frombuffer(row["lengths"], np.int32), _opened(row["tokens"])
    own = units.of(_names(row["words"]))
    kept = ~np.array(row["held"], bool)
    return _sequence(own[tokens[np.repeat(kept, lengths)]], lengths[kept], units.end)


def neighbours(spark: SparkSession, blocks: DataFrame, units: Units, classes: np.ndarray) -> np.ndarray:
    """[unit, side, class]: how often a unit's left and right neighbour has a class.

    Each task adds up its blocks; rows of (unit, class, left, right) are summed
    by Spark. The result has units x 2 x classes numbers, whatever the input.
    """
    width = int(classes.max()) + 1
    shared = spark.sparkContext.broadcast((units, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = shared.value
        left, right = (np.zeros(len(of) * width, np.int64) for _ in range(2))
        for batch in batches:
            for row in batch.to_pylist():
                s = _learned(row, own)
                c = of[s]
                left += np.bincount(s[1:].astype(np.int64) * width + c[:-1], minlength=len(left))
                right += np.bincount(s[:-1].astype(np.int64) * width + c[1:], minlength=len(right))
        at = np.flatnonzero(left + right)
        for k in range(0, len(at), 100_000):
            p = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p // width, pa.int32()), pa.array(p % width, pa.int32()), pa.array(left[p]), pa.array(right[p])], ["unit", "class", "l", "r"])

    rows = blocks.select("lengths", "tokens", "words", "held").mapInArrow(run, "unit int, class int, l long, r long")
    got = rows.groupBy("unit", "class").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).toArrow()
    out = np.zeros((len(classes), 2, width), np.int64)
    unit, cls = got["unit"].to_numpy(), got["class"].to_numpy()
    out[unit, 0, cls], out[unit, 1, cls] = got["l"].to_numpy(), got["r"].to_numpy()
    return out


def _pair_counts(classes: np.ndarray, width: int) -> np.ndarray:
    return np.bincount(classes[:-1].astype(np.int64) * width + classes[1:], minlength=width * width)


def class_pairs(coded: DataFrame, width: int) -> np.ndarray:
    """[before, after]: how often a class follows a class in the training texts of coded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width * width, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, kept = np.frombuffer(row["lengths"], np.int32), ~np.array(row["held"], bool)
                of_word = np.frombuffer(zlib.decompress(row["classes"]), np.uint8)
                tokens = _opened(row["tokens"])[np.repeat(kept, lengths)]
                n += _pair_counts(_sequence(of_word[tokens], lengths[kept], width - 1), width)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    rows = coded.select("lengths", "tokens", "held", "classes").mapInArrow(run, "pair long, n long")
    return _square(rows.groupBy("pair").agg(F.sum("n").alias("n")).collect(), width)


def _square(rows: list, width: int) -> np.ndarray:
    out = np.zeros(width * width)
    for pair, n in rows:
        out[pair] = n
    return out.reshape(width, width)


def per_block(places: DataFrame, column: str, dtype: str, missing: int) -> DataFrame:
    """block, ``column``: the values of (block, place, column) as one packed array per block."""

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        at = group["place"].to_numpy()
        out = np.full(int(at.max()) + 1, missing, dtype)
        out[at] = group[column].to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), column: pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    return places.groupBy("block").applyInArrow(pack, f"block long, {column} binary")


def _block_classes(row: dict, units: Units, of: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, their units, their classes, and their training counts."""
    names = _names(row["words"])
    unit = units.of(names)
    classes = of[unit].astype(np.uint8)
    if row.get("own"):
        own = np.frombuffer(zlib.decompress(row["own"]), np.uint8)
        classes[: len(own)] = np.where(own < NO_CLASS, own, classes[: len(own)])
    known = np.zeros(len(names), np.int64)
    if row["known"]:
        got = np.frombuffer(zlib.decompress(row["known"]), np.int64)
        known[: len(got)] = got
    return names, unit, classes, known


def tail_around(joined: DataFrame, model, heads: int, least: int, width: int) -> DataFrame:
    """word, class, l, r: how often a tail word's left and right neighbour has a class; of the null word, all class pairs by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = model.value
        total = np.zeros(width * width, np.int64)
        fields = ["word", "class", "l", "r"]
        for batch in batches:
            for row in batch.to_pylist():
                names, unit, classes, known = _block_classes(row, units, of)
                lengths, kept = np.frombuffer(row["lengths"], np.int32), ~np.array(row["held"], bool)
                s = _sequence(_opened(row["tokens"])[np.repeat(kept, lengths)], lengths[kept], len(names))
                c = np.append(classes, np.uint8(width - 1))[s].astype(np.int64)
                total += _pair_counts(c, width)
                at = np.flatnonzero(np.append((known >= least) & (unit >= heads), False)[s])
                word = s[at].astype(np.int64) * width
                keys, which = np.unique(np.concatenate([word + c[at - 1], word + c[at + 1]]), return_inverse=True)
                left, right = (np.bincount(x, minlength=len(keys)) for x in (which[: len(at)], which[len(at) :]))
                for k in range(0, len(keys), 50_000):
                    p = slice(k, k + 50_000)
                    own = [names[w] for w in (keys[p] // width).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(keys[p] % width, pa.int32()), pa.array(left[p]), pa.array(right[p])], fields)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(total[at]), pa.array(np.zeros(len(at), np.int64))], fields)

    rows = joined.mapInArrow(run, "word binary, class int, l long, r long")
    return rows.groupBy("word", "class").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def tail_exchange(around: DataFrame, now: DataFrame | None, model, pairs: np.ndarray) -> DataFrame:
    """word, first, class: each tail word's class by its ending, and after its move. Words move at once, each against the same class totals."""
    width = len(pairs)
    rows = around.where("word IS NOT NULL").groupBy("word").agg(F.collect_list(F.struct("class", "l", "r")).alias("near"))  # a row per class at most
    rows = rows.withColumn("now", F.lit(None).cast("int")) if now is None else rows.join(now.select("word", F.col("class").alias("now")), "word", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = model.value
        totals = Totals(pairs)
        for batch in batches:
            words = batch.column("word").to_pylist()
            first = of[units.of(words)].tolist()
            was = [e if n is None else n for e, n in zip(first, batch.column("now").to_pylist(), strict=True)]
            to = []
            for near, a in zip(batch.column("near").to_pylist(), was, strict=True):
                left, right = np.zeros(width), np.zeros(width)
                for x in near:
                    left[x["class"]], right[x["class"]] = x["l"], x["r"]
                totals.add(a, left, right, -1)
                to.append(totals.best(a, left, right))
                totals.add(a, left, right, 1)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(first, pa.int32()), pa.array(to, pa.int32())], ["word", "first", "class"])

    return rows.select("word", "near", "now").mapInArrow(run, "word binary, first int, class int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


class Totals:
    """Counts of class pairs, and how far moving a unit between classes raises the likelihood."""

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs = pairs.astype(float)
        self.before, self.after = self.pairs.sum(axis=1), self.pairs.sum(axis=0)

    def add(self, unit_class: int, left: np.ndarray, right: np.ndarray, sign: int) -> None:
        self.pairs[:, unit_class] += sign * left
        self.pairs[unit_class, :] += sign * right
        self.before[unit_class] += sign * right.sum()
        self.after[unit_class] += sign * left.sum()

    def best(self, now: int, left: np.ndarray, right: np.ndarray) -> int:
        """The class for a unit that has been taken out of ``now``, which it keeps if no other is better. The last class holds the end alone."""
        free = slice(0, len(self.before) - 1)
        li, ri, n_l, n_r = np.flatnonzero(left), np.flatnonzero(right), left.sum(), right.sum()
        into, out = np.maximum(self.pairs[li, free], 0), np.maximum(self.pairs[free, ri], 0)
        gain = (_xlogx(into + left[li, None]) - _xlogx(into)).sum(axis=0) + (_xlogx(out + right[ri]) - _xlogx(out)).sum(axis=1)
        before, after = self.before[free], self.after[free]
        gain -= _xlogx(before + n_r) - _xlogx(before) + _xlogx(after + n_l) - _xlogx(after)
        return now if gain[now] >= gain.max() - 1e-9 else int(gain.argmax())


def exchange(classes: np.ndarray, around: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One pass: each unit, frequent ones first, moves to the class that raises the likelihood of class bigrams most.

    Counts of classes follow each move; what a unit's neighbours are counts as
    at the start of the pass. The last class holds the end alone and stays.
    """
    width = around.shape[2]
    classes = classes.copy()
    pairs = np.zeros((width, width))
    np.add.at(pairs.T, classes, around[:, 0].astype(float))
    totals = Totals(pairs)
    for unit in np.argsort(-weights[:-1], kind="stable").tolist():
        left, right = around[unit].astype(float)
        if left.any():
            totals.add(classes[unit], left, right, -1)
            classes[unit] = totals.best(int(classes[unit]), left, right)
            totals.add(classes[unit], left, right, 1)
    return classes


def score(
    docs: DataFrame,
    held: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    classes: int = CLASSES,
    passes: int = PASSES,
    tail_passes: int = TAIL_PASSES,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    ``held`` marks rows that aren't learned from; by default those whose id's
    crc32 is divisible by 10. Null text is the empty text, whose only token is the end.
    Rows stand for themselves: repeated rows and null ids are learned from and
    scored each. Without training rows both models give all tokens the same
    share. An empty table gives no rows. ``classes`` may be 254 at most.
    """
    spark = docs.sparkSession
    ready(spark)
    if not 0 < classes < NO_CLASS:
        raise ValueError(f"classes must lie between 1 and {NO_CLASS - 1}: {classes}")
    held = F.coalesce(id_crc(doc_id) % 10 == 0 if held is None else held, F.lit(False))
    blocks = stored(encode(docs, held, doc_id, text), "blocks")
    ended, n_blocks = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x))), F.count("*")).first()
    ended = ended or 0
    # A word's places in some thousand blocks are one row, so that a common word has many rows and not a long one.
    part = F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks // GROUP_BLOCKS) or 1)).alias("part")
    held_in = F.collect_list(F.struct("block", "place")).alias("places")
    places = stored(block_words(blocks).groupBy("word", part).agg(F.sum("n").alias("n"), held_in), "places")
    vocab = stored(places.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    total, distinct = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n_all, v_all = (total or 0) + ended, (distinct or 0) + (ended > 0)

    # HEADS words and 65,792 endings at most reach the driver.
    heads = vocab.where(F.col("c") >= MIN_COUNT).orderBy(F.desc("c"), "word").limit(HEADS).toArrow().to_pylist()
    is_head = F.lit(False)
    if heads:
        word, c = F.lit(heads[-1]["word"]), F.lit(heads[-1]["c"])
        is_head = (F.col("c") > c) | ((F.col("c") == c) & (F.col("word") <= word))
    ending = F.substring("word", F.greatest(F.octet_length("word") - 1, F.lit(1)), F.lit(2))
    rest = vocab.where("c > 0").where(~is_head).groupBy(ending.alias("ending"))
    sums = sorted(rest.agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow().to_pylist(), key=lambda r: (-r["n"], r["ending"]))
    units = Units([r["word"] for r in heads], [r["ending"] for r in sums])
    weights = np.array([r["c"] for r in heads] + [r["n"] for r in sums] + [ended], float)
    kinds = np.array([1] * len(heads) + [r["v"] for r in sums] + [1], float)
    of = np.append(np.argsort(np.argsort(-weights[:-1], kind="stable")) % classes, classes).astype(np.int32)
    for _ in range(passes):
        of = exchange(of, neighbours(spark, blocks, units, of), weights)
    width = classes + 1
    model = spark.sparkContext.broadcast((units, of))

    counted = places.join(vocab.where("c > 0"), "word").select(F.inline("places"), "c").withColumnRenamed("c", "known")
    known = stored(per_block(counted, "known", "<i8", 0), "known")
    tail = None
    joined = blocks.drop("counts").join(known, "block", "left")
    for _ in range(tail_passes):
        around = stored(tail_around(joined.drop("ids", "block"), model, len(heads), MIN_COUNT, width), "around")
        pairs = _square(around.where("word IS NULL").select("class", "l").collect(), width)
        tail = stored(tail_exchange(around, tail, model, pairs), "tail")
        of_place = places.join(tail.select("word", F.col("class").alias("own")), "word").select(F.inline("places"), "own")
        own = stored(per_block(of_place, "own", "u1", NO_CLASS), "own")
        joined = blocks.drop("counts").join(known, "block", "left").join(own, "block", "left")

    kind = docs.schema[doc_id].dataType

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = model.value
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                _, _, own, c = _block_classes(row, units, of)
                packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (c, own)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 1) for k in ("ids", "held", "lengths", "tokens")), *packed], [*"ids held lengths tokens known classes".split()])

    coded = stored(joined.drop("block").mapInArrow(code, f"ids array<{kind.simpleString()}>, held array<boolean>, lengths binary, tokens binary, known binary, classes binary"), "coded")
    pairs = class_pairs(coded, width)
    # What follows a class leans on what follows any, by as many counts as there are classes.
    any_class = (pairs.sum(axis=0) + SMOOTH) / (pairs.sum() + SMOOTH * width)
    follow = np.log10((pairs + classes * any_class) / (pairs.sum(axis=1, keepdims=True) + classes))
    mass, members = np.bincount(of, weights, width), np.bincount(of, kinds, width)
    if tail is not None:  # tail words count in their own class, no longer in their ending's
        for was, to, n, v in tail.join(vocab, "word").groupBy("first", "class").agg(F.sum("c"), F.count("*")).collect():
            mass[was] -= n
            mass[to] += n
            members[was] -= v
            members[to] += v
    mass[-1], members[-1] = ended, 1
    chances = spark.sparkContext.broadcast((follow, mass + SMOOTH * (members + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow, share = chances.value
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            for at, row in enumerate(batch.select(["lengths", "tokens", "known", "classes"]).to_pylist()):
                c = np.frombuffer(zlib.decompress(row["known"]), np.int64)
                of_word = np.frombuffer(zlib.decompress(row["classes"]), np.uint8)
                lengths, tokens = np.frombuffer(row["lengths"], np.int32), _opened(row["tokens"])
                emit = np.log10((c + SMOOTH) / share[of_word])
                # With an end after each text; its word comes last in these arrays.
                c, emit, of_word = np.append(c, ended), np.append(emit, 0.0), np.append(of_word, np.uint8(classes))
                base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
                s = _sequence(tokens, lengths, len(c) - 1)
                cls = of_word[s]
                value = emit[s[1:]] + follow[cls[:-1], cls[1:]]
                starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
                sums = [np.add.reduceat(x, starts) for x in ((c[s[1:]] > 0).astype(np.int64), base[s[1:]], value)]
                own = [batch.column(k).slice(at, 1).flatten() for k in ("ids", "held")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in (lengths.astype(np.int64) + 1, sums[0], np.full(len(lengths), n_all, np.int64), *sums[1:]))], names)

    shape = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.mapInArrow(run, shape).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
