"""How far sources of a language diverge in their words: a translate-table tokenizer and sparse counts.

One ``bytes.translate`` lowers A-Z and blanks every separator, ``bytes.split``
cuts the terms, and a Counter per document yields counts and document
frequencies. Tasks add them up before Spark does, so a hot source costs one
row per term and task. Distances of sources are summed over blocks of terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import ready, stored

#: Letters A-Z become small; all other ASCII but letters is blank; bytes beyond ASCII stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST_DOCS = 30
ALPHA = 5
ONE = 1_000_000_000
TOP = 50
HELD = 200_000  # counters that a task adds up before it hands them on
SOURCES = 256  # in a block of sources
TERMS = 2048  # in a block of terms, about


def terms(text: str | None) -> Counter:
    """The terms of a whole text with their counts."""
    return Counter() if not text else Counter(text.encode("utf-8", "surrogatepass").translate(TABLE).split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: sums of the documents so far, whenever there are ``HELD`` of them."""
    sums: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sums.items():
            names = list(n)
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                size = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        sums.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            own = terms(text.as_py())
            if own:
                n, docs = sums[lang.as_py(), source.as_py()]
                n.update(own)
                docs.update(own.keys())
        if sum(len(n) for n, _ in sums.values()) >= HELD:
            yield from flush()
    yield from flush()


def _share(n: str, total: str, vocabulary: str) -> Column:
    """p = 1 + floor(ONE * (n + ALPHA) / (total + ALPHA * vocabulary)), in decimals that hold any count exactly."""
    big = "cast({} as decimal(20,0))".format
    return F.expr(f"1 + (cast({ONE} as decimal(10,0)) * ({big(n)} + {ALPHA})) div ({big(total)} + {ALPHA} * {big(vocabulary)})")


def _distances(key: tuple, cells: pa.Table, per_block: int) -> pa.Table:
    """For one block of terms and two blocks of sources: lang, i < j, and the sum over these terms of |p - q| beyond that of unseen terms.

    A cell without a term holds the p that a source gives to what it has not seen.
    """
    lang, left, right = (k.as_py() for k in key[:3])
    term, idx, p = cells["term"].to_pylist(), cells["idx"].to_numpy(), cells["p"].to_numpy()
    places: dict[str | None, int] = {}
    row = np.fromiter((places.setdefault(t, len(places)) for t in term), np.int64, len(term))
    unseen = row == places[None]
    sides = []
    for block in (left, right):
        inside = idx // per_block == block
        dims = np.flatnonzero(inside & unseen)
        dims = dims[np.argsort(idx[dims])]
        full = np.repeat(p[dims][None, :], len(places), axis=0)
        seen = inside & ~unseen
        full[row[seen], np.searchsorted(idx[dims], idx[seen])] = p[seen]
        sides.append((idx[dims], p[dims], full))
    (a, a0, x), (b, b0, y) = sides
    out = [np.abs(y - x[:, k : k + 1]).sum(axis=0) - len(places) * np.abs(b0 - a0[k]) for k in range(len(a))]
    i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    keep = i < j
    sums = np.concatenate(out)[keep] if out else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "i": i[keep], "j": j[keep], "d": sums})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, per_block: int = SOURCES, term_block: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how a source's words differ from other sources and from its language.

    Null language, source and text are read as empty texts. A language keeps the
    terms of at least ``least_docs`` of its documents; p of a group or language
    and a kept term is smoothed by ``ALPHA``, in integers of 1 / ``ONE``. Part
    ``pair`` has every other source of the language with the summed |p - q|
    (zero if no term is kept), part ``term`` the ``top`` terms that the source
    has more of than its language. Ranks go by value, ties by item. Repeated
    rows are documents each; groups without terms take part; an empty table
    gives no rows. Other columns are not looked at. A task compares at most
    ``per_block`` sources with as many, over about ``term_block`` terms.
    """
    spark = docs.sparkSession
    ready(spark)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).alias("text"))
    parts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    cells = stored(counts.drop("docs").join(kept, ["lang", "term"]), "cells")

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n_lang").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = stored(groups.withColumn("unseen", F.when(F.col("vocabulary") > 0, _share("0", "total", "vocabulary"))), "groups")

    seen = cells.join(groups.drop("unseen"), ["lang", "source"])
    seen = seen.withColumns({"p": _share("n", "total", "vocabulary"), "q": _share("n_lang", "total_lang", "vocabulary")})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = seen.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # Each source's block meets every block of its language; the smaller number comes first.
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_sources") - 1) / per_block))
    salts = F.ceil(F.col("vocabulary") / term_block)
    n_sources = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    mine = F.floor(F.col("idx") / per_block)
    meets = lambda df: df.select("*", F.explode(blocks).alias("other")).withColumns({"left": F.least(mine, "other"), "right": F.greatest(mine, "other")})
    shape = ["lang", "left", "right", "salt", "term", "idx", "p"]
    filled = meets(seen.join(n_sources, "lang").withColumn("salt", F.pmod(F.xxhash64("term"), salts))).select(shape)
    dims = groups.where("vocabulary > 0").join(n_sources, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    dims = meets(dims.withColumns({"term": F.lit(None).cast("string"), "p": F.col("unseen")})).select(shape)
    sums = filled.unionByName(dims).groupBy("lang", "left", "right", "salt").applyInArrow(lambda key, cells: _distances(key, cells, per_block), "lang string, i long, j long, d long")
    sums = stored(sums.groupBy("lang", "i", "j").agg(F.sum("d").alias("d")), "distances")

    a = groups.select("lang", "source", F.col("idx").alias("a"), F.col("unseen").alias("a0"), "vocabulary")
    b = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("b"), F.col("unseen").alias("b0"))
    pairs = a.join(b, "lang").where("a != b").withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(sums, ["lang", "i", "j"], "left")
    base = F.when(F.col("vocabulary") > 0, F.col("vocabulary") * F.abs(F.col("a0") - F.col("b0"))).otherwise(0)
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("d", F.lit(0))).alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(best))
    return pair.unionByName(over).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
