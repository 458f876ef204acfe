"""Near-duplicate documents: SimHash covering tables and shingle bands propose pairs, exact similarity decides.

Texts with equal words are one class. Two classes are candidates if their fingerprints differ in at most two bits, or if
they agree on all ``ROWS`` minima of one of ``BANDS`` bands. A candidate pair is
a link if the Jaccard similarity of the sets of five-word shingles is at least
``SIMILAR``; shingles are compared by 32 bits of their hash. Linked documents and
copies form groups. No candidate pair is passed over unless other links join it,
or its sets can't be similar (``_rest``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import simhash
from millrace.llm.common import free_name, ready, stored, words_of
from millrace.llm.components import components

WIDTH = 5
SIMILAR = 0.8
BANDS = 16  # of ROWS minima each: a pair of similarity 0.8 agrees on one at least with probability 0.99
ROWS = 6
SMALL = 8  # members of a bucket up to which all pairs are candidates
STARS = 4  # rounds in which the members of a larger one are compared with one of them
CHUNK = 4096  # shingles that are hashed at once
SLICE = 256  # texts whose sketches go back together

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The different shingles' XXH64; a shorter text is one shingle, one without words none."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), np.uint64, len(parts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's minima. The hashes are mixed first, as products keep their order too well."""
    x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), CHUNK):
        y = x[at : at + CHUNK, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, (y ^ (y >> np.uint64(31))).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _sketch(words: list[bytes]) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    """A hash of all words in turn, the fingerprint, 32 bits of each shingle's hash, and the bands."""
    own = shingles(words)
    keys = bands(own) if len(own) else np.zeros(0, np.int64)
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return digest, simhash.fingerprint(words, WIDTH), np.unique(own.astype(np.uint32)).view(np.int32), keys


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One text's words are held at a time: they take many times the room of the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            words, prints, sets, keys = zip(*(_sketch(words_of(t.as_py())) for t in part.column(1)), strict=True)
            columns = [
                part.column(0),
                pa.array(words, pa.binary()),
                pa.array(prints, pa.int64()),
                pa.array(sets, pa.list_(pa.int32())),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "fp", "set", "keys"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose shingles are similar enough."""
    one, two = (sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= SIMILAR * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _met(members: DataFrame, sets: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Links among the members ``rep`` of buckets ``bucket`` of ``n`` members: they join whatever links of all pairs join.

    In a bucket of up to ``SMALL`` every pair is compared. In a larger one all
    are compared with the member that meets most others over all buckets, which
    is the middle of what lies around it; those that are not similar to it
    remain, and so on for ``STARS`` rounds or until the bucket is small. Then
    ``_rest`` looks at the pairs that were passed over, and at those in the
    buckets ``bucket, rep`` of ``others``.
    """
    weights = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    members, found, crowd = members.select("bucket", "rep").join(weights, "rep"), None, others
    for turn in range(STARS):
        lead = F.max_by("rep", F.struct("weight", "rep")).alias("lead")
        sized = members.groupBy("bucket").agg(F.count("*").alias("n"), lead).where("n > 1")
        sized = stored(members.join(sized, "bucket"), "buckets")
        few = sized.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("rep")).alias("all"))
        pairs = few.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda b: b > F.col("a"))).alias("b"))
        large = sized.where(F.col("n") > SMALL)
        many = large.where("rep != lead")
        starred = many.select(F.col("lead").alias("a"), F.col("rep").alias("b"))
        links = stored(_similar(pairs.unionByName(starred).distinct(), sets), "similar")
        found = links if found is None else found.unionByName(links)
        if many.isEmpty():
            break
        if not turn:
            crowd = large.select("bucket", "rep") if crowd is None else crowd.unionByName(large.select("bucket", "rep"))
        near = links.select(F.col("a").alias("lead"), F.col("b").alias("rep"))
        members = stored(many.join(near, ["lead", "rep"], "left_anti").select("bucket", "rep", "weight"), "left")
    return found if crowd is None else found.unionByName(_rest(crowd, found, sets))


def _rest(crowd: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members ``rep`` of a ``bucket`` that the links found so far don't join.

    An exact join of the members of buckets in which components meet: of two
    sets of similarity ``SIMILAR`` each shares so many elements with the other
    that, in any order, their first ones can't all differ; the order is from
    rare to frequent. Only pairs of different components are compared.
    """
    roots = stored(components(found), "reached").withColumnRenamed("node", "rep")
    parts = crowd.select("bucket", "rep").join(roots, "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    torn = parts.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    apart = stored(parts.join(torn, "bucket").select("rep", "root").distinct().join(sets, "rep"), "apart")
    elements = apart.select("rep", "root", F.size("set").alias("size"), F.explode("set").alias("element"))
    ranked = elements.join(elements.groupBy("element").agg(F.count("*").alias("n")), "element")
    ranked = ranked.groupBy("rep").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "element"))).alias("all"))
    least = F.ceil(SIMILAR * F.col("size") - 1e-9).cast("int")
    firsts = ranked.select("rep", "root", "size", F.posexplode(F.slice("all", F.lit(1), F.col("size") - least + 1)).alias("at", "e"))
    firsts = stored(firsts.where("e.n > 1").select("rep", "root", "size", (F.col("size") - F.col("at")).alias("left"), "e.element"), "firsts")

    # Of each element's largest component, members are only looked at from outside.
    counts = firsts.groupBy("element", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("element").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
    y = stored(firsts.join(main.where("parts > 1").drop("parts"), "element"), "sides")
    x = y.where("root != main").select("element", *(F.col(c).alias(f"x_{c}") for c in ("rep", "root", "size", "left")))
    other = (F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("main")) | (F.col("x_root") < F.col("root")))
    # From the first element that both have on, enough must be left of both.
    able = F.least("left", "x_left") >= SIMILAR / (1 + SIMILAR) * (F.col("size") + F.col("x_size")) - 1e-9
    pairs = x.join(y, "element").where(other & able).select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b"))
    return stored(_similar(pairs.distinct(), sets), "rest")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row with an id: doc_id and group, the smallest doc_id reachable over links and equal words.

    A-Z count as small letters. Null and empty texts have no words, and are
    copies of each other. Texts of fewer than five words are near-duplicates
    only if their words are equal. An empty table gives no rows; other columns
    are not looked at.
    """
    ready(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    rows = stored(rows.mapInArrow(_sketched, f"doc_id {kind}, words binary, fp long, set array<int>, keys array<long>"), "sketches")
    classes = rows.groupBy("words").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumnRenamed("words", "rep"), "classes")

    # Only classes that meet another one are looked at further. Fingerprints within the radius of each other share a point.
    banded = classes.select("rep", F.posexplode("keys").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("bucket"))
    prints = classes.where(F.size("keys") > 0).select("rep", "fp")
    buckets = banded.unionByName(prints.select("rep", F.xxhash64(F.lit(-1), "fp").alias("bucket")))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(buckets.join(sizes, "bucket"), "met")
    visits = prints.join(simhash.points(prints.select("fp").distinct()), "fp").select("rep", F.col("point").alias("bucket"))
    visits = stored(visits.join(visits.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket"), "visits")

    seen = met.select("rep").unionByName(visits.select("rep")).distinct().join(classes, "rep").select(F.col("rep").alias("words"), F.col("least").alias("doc_id"))
    sets = rows.join(seen, ["words", "doc_id"]).select(F.col("words").alias("rep"), "set").dropDuplicates(["rep"])
    sets = stored(sets, "shingles")
    links = _met(met, sets, visits)

    roots = stored(components(links), "roots").select(F.col("node").alias("rep"), "root")
    rooted = classes.select("rep", "least").join(roots, "rep", "left").select("rep", "least", F.coalesce("root", "rep").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("group"))
    member = stored(rooted.join(smallest, "root").select(F.col("rep").alias("words"), "group"), "members")
    return rows.select("doc_id", "words").join(member, "words").select("doc_id", "group")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; of rows with one id, one stays.

    Rows without an id stay: nothing tells them apart from each other.
    """
    first = stored(groups(docs, doc_id, text).where("doc_id = group").select("doc_id").distinct(), "kept")
    mark = free_name(docs, "kept_id")
    kept = docs.join(first.withColumnRenamed("doc_id", mark), F.col(doc_id) == F.col(mark), "left_semi")
    return kept.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
