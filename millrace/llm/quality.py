"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Only DataFrame functions: the text statistics are expressions over one row, and
each concentration step is two aggregations over the table of statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import WHITE, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of the words

DIMS = 4
#: Least standard deviation of each transformed statistic: most clean texts have no symbols or repeats at all,
#: and a spread of zero would make every other text an outlier. On the order of clean texts' own spread, so that each
#: statistic alone can pass the cutoff: in a group without any at 2.5 % symbols, 4.5 % duplicate lines or 28 % repeats.
FLOORS = (0.10, 0.03, 0.04, 0.10)
SHARE = 0.75  # of a group's rows that the estimate rests on
STEPS = 4  # concentration steps
MIN_ROWS = 40  # rows of a group that is estimated by itself
CUTOFF = 27.86  # chi-square with four degrees of freedom, at a tail of 1.3e-5
BINS = 64  # distances are ranked in bins of 1/64 of a doubling


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(raw, WHITE), "")
    lines = F.filter(F.split(raw, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    bare = F.translate(raw, " \t\n\x0b\x0c\r", "")
    first = docs.select(
        *keep,
        words.alias("words_"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(bare, lambda x: F.array(F.length(x), F.length(x) - F.length(F.translate(x, SYMBOLS, "")))).alias("chars_"),
    )
    kept = [c for c in first.columns if c not in ("words_", "n_dup_lines", "chars_")]
    count = F.size("words_")
    at = F.sequence(F.lit(0), count - 3)
    window = F.transform(at, lambda i: F.xxhash64(F.get("words_", i), F.get("words_", i + 1), F.get("words_", i + 2)))
    hashed = first.select(*kept, "n_dup_lines", "chars_", count.cast("long").alias("n_words"), F.when(count >= 3, window).alias("windows_"))
    again = F.size(F.array_distinct("windows_")) < F.size("windows_")
    return hashed.select(
        *kept,
        "n_words",
        F.get("chars_", F.lit(0)).cast("long").alias("word_chars"),
        F.get("chars_", F.lit(1)).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.when(again, _covered(F.col("windows_"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """How many words lie in windows of three words that are there twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        # get() beyond either end is null
        twin = lambda x, k, step: F.coalesce(F.get(p, k + step)["h"] == x["h"], F.lit(False))
        marked = F.filter(p, lambda x, k: twin(x, k, -1) | twin(x, k, 1))
        return F.sort_array(F.transform(marked, lambda x: x["i"]))

    def cover(q: Column) -> Column:
        return F.aggregate(
            q,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return _let(placed, lambda p: _let(repeated(p), cover))


def _transformed() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _consistency() -> float:
    """What the spread of the inner ``SHARE`` of a normal sample in four dimensions is too small by."""
    cdf4 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf4(mid) < SHARE else (low, mid)
    return SHARE / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def _shape(moments: DataFrame, scale: float) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant from sums; each variance gets its floor."""
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIMS)})
    cov = {(i, j): scale * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) for i, j in _pairs()}
    out = out.withColumns({f"c{i}{j}": F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c for (i, j), c in cov.items()})
    for j in range(DIMS):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(FLOORS[j] ** 2 * 1e-6))))
        cross = {i: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)) for i in range(j + 1, DIMS)}
        if cross:
            out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - c) / F.col(f"l{j}{j}") for i, c in cross.items()})
    out = out.withColumns({f"v{j}{j}": 1 / F.col(f"l{j}{j}") for j in range(DIMS)})
    for step in range(1, DIMS):  # the inverse of the lower triangle, diagonal by diagonal
        below = {}
        for j in range(DIMS - step):
            i = j + step
            below[f"v{i}{j}"] = -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
        out = out.withColumns(below)
    logdet = sum((2 * F.log(f"l{j}{j}") for j in range(DIMS)), F.lit(0.0))
    return out.withColumn("logdet", logdet)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the inverse factor v."""
    z = [sum((F.col(f"v{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    return sum((F.pow(c, F.lit(2)) for c in z), F.lit(0.0))


SHAPE = [f"m{i}" for i in range(DIMS)] + [f"v{i}{j}" for i, j in _pairs()]


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(DIMS)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)] + [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in _pairs()]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def estimates(points: DataFrame) -> DataFrame:
    """Per group ``g`` the location and shape of least determinant, from points ``g, x0..x3``.

    Two deterministic starts: the classical estimate of all rows, and the
    coordinate-wise medians with the floors as spread. Each step keeps the
    ``SHARE`` nearest rows of a group and estimates anew from them. Nearest is
    decided by bins of the distance, so that a group's ranking is a count per
    bin and not a sort of its rows; the bin that crosses the share stays whole.
    """
    medians = points.groupBy("g").agg(*(F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in range(DIMS)))
    for i, j in _pairs():
        medians = medians.withColumn(f"v{i}{j}", F.lit(1 / FLOORS[i] if i == j else 0.0))
    classical = _shape(_moments(points, "g"), 1.0).select("g", F.lit(1).alias("start"), *SHAPE)
    state = stored(medians.select("g", F.lit(0).alias("start"), *SHAPE).unionByName(classical), "shape")
    scale = _consistency()
    for step in range(STEPS):
        far = points.join(state, "g").select("g", "start", *(f"x{i}" for i in range(DIMS)), F.floor(F.log2(_distance() + 1e-9) * BINS).alias("bin"))
        counts = far.groupBy("g", "start", "bin").agg(F.count("*").alias("k"))
        upto = Window.partitionBy("g", "start").orderBy("bin")
        total = F.sum("k").over(Window.partitionBy("g", "start"))
        inner = counts.select("g", "start", "bin", (F.sum("k").over(upto) - F.col("k")).alias("before"), total.alias("total"))
        edge = inner.where(F.col("before") < F.col("total") * SHARE).groupBy("g", "start").agg(F.max("bin").alias("edge"))
        near = far.join(stored(edge, "edge"), ["g", "start"]).where("bin <= edge")
        shape = _shape(_moments(near, "g", "start"), scale)
        state = stored(shape.select("g", "start", *SHAPE, *(["logdet"] if step == STEPS - 1 else [])), "shape")
    best = Window.partitionBy("g").orderBy("logdet", "start")
    return state.withColumn("best", F.row_number().over(best)).where("best = 1").select("g", *SHAPE)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", whole: bool = False) -> DataFrame:
    """Per row: doc_id, the five statistics, base_failed, distance2 and kept; with ``whole`` also the row as struct ``row``.

    base_failed: under 50 words, or over half the words in repeated windows of
    three words. Of the rest, a row is rejected if its squared distance from
    its language's and source's estimate is over ``CUTOFF``. Groups under
    ``MIN_ROWS`` rows share their language's estimate, and what is still too few
    that of all such rows; if these are too few as well, distance2 is null and
    the rows are kept. Null text: no words. Null language or source: a group
    like any other. Windows are compared by a 64-bit hash.
    """
    keep = [F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang_"), F.col(source).cast("string").alias("source_")]
    if whole:
        keep.append(F.struct(*docs.columns).alias("row"))
    counted = statistics(docs, text, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    scored = stored(counted.select("*", *(x.alias(f"x{i}") for i, x in enumerate(_transformed()))), "statistics")

    # Groups, smallest first: lang and source, lang, all. A row belongs to exactly one.
    sizes = scored.where("NOT base_failed").groupBy("lang_", "source_").agg(F.count("*").alias("n_own"))
    by_lang = Window.partitionBy("lang_")
    few = F.when(F.col("n_own") < MIN_ROWS, F.col("n_own")).otherwise(0)
    sizes = sizes.withColumn("n_lang", F.sum(few).over(by_lang))
    own = F.when(F.col("n_own") >= MIN_ROWS, F.struct(F.lit(2).alias("level"), F.col("lang_").alias("a"), F.col("source_").alias("b")))
    mid = F.when(F.col("n_lang") >= MIN_ROWS, F.struct(F.lit(1).alias("level"), F.col("lang_").alias("a"), F.lit(None).cast("string").alias("b")))
    rest = F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    group = F.to_json(F.coalesce(own, mid, rest))
    groups = stored(sizes.select(F.col("lang_").alias("gl"), F.col("source_").alias("gs"), group.alias("g")), "groups")
    same = F.col("lang_").eqNullSafe(F.col("gl")) & F.col("source_").eqNullSafe(F.col("gs"))
    xs = [f"x{i}" for i in range(DIMS)]
    points = stored(scored.where("NOT base_failed").join(groups, same).select("g", *xs), "points")
    enough = points.groupBy("g").count().where(F.col("count") >= MIN_ROWS).select("g")
    shapes = stored(estimates(points.join(stored(enough, "enough"), "g", "left_semi")), "estimates")

    judged = scored.join(groups.join(shapes, "g", "left"), same, "left")
    far = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(far <= CUTOFF, F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *counts, far.alias("distance2"), kept.alias("kept"), *(["row"] if whole else []))


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return judge(docs, whole=True, **columns).where("kept").select("row.*").select(*docs.columns)

