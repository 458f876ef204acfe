"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two texts are linked if theirs differ in at most
``radius`` bits. Bit i belongs to a vector phi(i) over GF(2) of radius + 1
dimensions, and table v, for every non-zero vector v, keeps the bits with
<phi(i), v> = 1. Whatever bits a pair within the radius differs in, some v is
orthogonal to all their vectors, so that the pair meets in table v: no pair is
missed, and 2**(radius + 1) - 1 tables are enough.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import free_name, ready, stored, words_of
from millrace.llm.components import components

BITS = 64
RADIUS = 2
WIDTH = 3  # words in a shingle
SMALL = 64  # fingerprints in a bucket up to which its members are compared one by one


def fingerprint(words: list[bytes], width: int = WIDTH, seed: int = 42) -> int:
    """The majority of the bits of all shingles' XXH64, repeats included; zero without words."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(joined, seed)]
    else:
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the unpacked bits of very long texts are large
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint_of(text: Column, width: int = WIDTH) -> Column:
    """Fingerprint of each whole text as a signed long; null has no words."""

    @F.arrow_udf("long")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint(words_of(x.as_py()), width) for x in batch], pa.int64())

    return run(text)


def masks(radius: int = RADIUS) -> list[int]:
    """For each table the bits that it keeps, as unsigned numbers."""
    vectors = range(1, 2 ** (radius + 1))
    phi = [vectors[i % len(vectors)] for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _meetings(prints: DataFrame, radius: int) -> DataFrame:
    """``t, key, fp, mask, n``: the distinct fingerprints ``fp`` in each table's buckets of ``n`` members, two at least."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks(radius))))
    keyed = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    counted = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return stored(keyed.join(counted, ["t", "key"]), "buckets")


def points(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, point``: what the distinct fingerprints ``fp`` that meet another one in a table visit, all within half the radius.

    Two within the radius of each other share a point, and all that visit one
    are within the radius of each other. The radius must be even.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    bits = F.array(*(F.lit(_signed(1 << i)) for i in range(BITS)))
    met = _meetings(prints, radius).select("fp").distinct()
    return met.select("fp", F.explode(_sums(bits, radius // 2)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that join the distinct fingerprints ``fp`` exactly as the radius does.

    In a bucket of up to ``SMALL`` fingerprints every linked pair comes out. In
    a larger one each fingerprint visits all points within half the radius of
    it, in the bits that the table drops. Two that are linked meet halfway, and
    all that visit one point are within the radius of each other, so each is
    linked to the least of them. Both ways lose no link, and the larger buckets
    need no pairs. The radius must be even.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    met = _meetings(prints, radius)

    few = met.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    each = few.select("all", F.explode("all").alias("a"))
    near = F.filter("all", lambda b: (b < F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= radius))
    pairs = each.select("a", F.explode(near).alias("b"))

    free = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("mask", i) == 0)
    flips = F.transform(free, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    many = met.where(F.col("n") > SMALL)
    around = many.select("fp", "t", F.explode(_sums(flips, radius // 2)).alias("flip"))
    point = F.col("fp").bitwiseXOR(F.col("flip"))
    visits = stored(around.select("t", point.alias("point"), "fp"), "visits")
    least = visits.groupBy("t", "point").agg(F.min("fp").alias("b"))
    starred = visits.join(least, ["t", "point"]).where("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(starred).distinct()


def _sums(flips: Column, steps: int) -> Column:
    """All masks of up to so many of the single bits ``flips``."""
    out = F.array(F.lit(0).cast("long"))
    for _ in range(steps):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda x: F.transform(flips, lambda y: x.bitwiseOR(y))))))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed long) and component_id, the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with one fingerprint are one node, so a group of copies costs one row
    in all that follows. Null ids get the component of their fingerprint; they
    are nobody's smallest id unless the whole component has none, which then is
    null. An empty table gives no rows; other columns are not looked at.
    """
    ready(docs.sparkSession)
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text), width).alias("fp")), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = stored(components(links(classes.select("fp"), radius)), "roots").withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stored(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "members")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; of rows with one id, one stays.

    Rows without an id stay: nothing tells them apart from each other.
    """
    found = near_duplicates(docs, doc_id, text, width, radius)
    first = stored(found.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    mark = free_name(docs, "kept_id")
    kept = docs.join(first.withColumnRenamed("doc_id", mark), F.col(doc_id) == F.col(mark), "left_semi")
    return kept.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
