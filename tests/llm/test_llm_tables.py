"""Boosted trees, source divergence and the prefix trie."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import checks, divergence, queries, trees, trie

SF = "/root/testdata/sf0.01"


def collected(df):
    return [r.asDict() for r in df.collect()]


# -- boosted trees ---------------------------------------------------------------------------------


def walked(forest, bins):
    """One row at a time, node by node."""
    total = forest.base
    for k in range(len(forest.leaf)):
        node = 0
        while node < len(forest.feature[k]):
            node = 2 * node + (2 if bins[forest.feature[k][node]] > forest.border[k][node] else 1)
        total += forest.leaf[k][node - len(forest.feature[k])]
    return total


def drawn(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(trees.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    return x, y, rng.integers(1, 4, n).astype(float)


def test_flat_arrays_walk_like_nodes():
    x, y, w = drawn()
    forest = trees.train(x, y, w, trees=12, depth=3)
    bins = forest.binned(x)
    assert np.allclose(forest.margin(bins), [walked(forest, b) for b in bins])
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_a_split_is_the_best_of_all():
    x, y, w = drawn(120, 2)
    forest = trees.train(x, y, w, trees=1, depth=1)
    bins = forest.binned(x)
    p = (y * w).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p)
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + trees.L2)
    gains = {}
    for f in range(bins.shape[1]):
        for b in range(trees.BINS):
            left = bins[:, f] <= b
            if min(h[left].sum(), h[~left].sum()) >= trees.LEAST_HESSIAN:
                gains[f, b] = value(left) + value(~left)
    found = int(forest.feature[0][0]), int(forest.border[0][0])
    assert gains[found] == pytest.approx(max(gains.values()))
    left = bins[:, found[0]] <= found[1]
    assert forest.leaf[0] == pytest.approx([-trees.RATE * g[m].sum() / (h[m].sum() + trees.L2) for m in (left, ~left)])


def test_statistics_of_texts():
    of = lambda text: dict(zip(trees.FEATURES, trees.statistics(text), strict=True))
    assert set(trees.statistics(None)) == set(trees.statistics("")) == set(trees.statistics(" \n\t")) == {0.0}
    x = of("a a b\nA$ b a b a b\nx\nx")
    assert x["distinct"] == pytest.approx(4 / 11) and x["commonest"] == pytest.approx(4 / 11)
    assert x["again"] == pytest.approx(2 / 11) and x["longest_run"] == pytest.approx(2 / 11)
    assert x["duplicate_lines"] == pytest.approx(1 / 4) and x["short_lines"] == pytest.approx(3 / 4)
    assert x["symbol_words"] == pytest.approx(1 / 11) and x["upper"] == pytest.approx(1 / 11) and x["symbols"] == pytest.approx(1 / 12)
    rng = random.Random(3)
    for _ in range(40):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        assert of(" ".join(words))["repeated_windows"] == pytest.approx(sum(n for n in seen.values() if n > 1) / len(words))


def test_held_out_quality(spark):
    out = queries.op11_boosted_quality(spark, SF)
    found = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (good >= trees.PREDICT).mean() > 0.97
    every = out.toPandas()
    assert len(every) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert every.score.between(0, 1).all() and (every.predicted == (every.score >= 0.3)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in every.itertuples())


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r["doc_id"]: r["score"] for r in collected(trees.score(docs, x))} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "q"), (2, 0, "q"), (2, 1, "q"), (3, None, "q"), (None, 1, "q"), (8, 0, "q")], "doc_id long, quality int, text string")
    out = collected(trees.score(docs, labels))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    same = {r["score"] for r in out if r["doc_id"] in (4, 5)}
    assert len(same) == 1  # null and empty text
    assert {r["score"] for r in collected(trees.score(docs, labels.where("false")))} == {0.5}
    assert trees.score(no_docs, labels).count() == 0
    bounded = collected(trees.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), rows=60))
    assert len(bounded) == 1000


# -- divergence of sources -------------------------------------------------------------------------


def plain_audit(rows, least, top):
    """Dictionaries and loops; rows are lang, source, text."""
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    words = [(g or "", s or "", [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for g, s, t in rows]
    docs, n = Counter(), Counter()
    for g, s, w in words:
        docs.update({(g, t) for t in w})
        n.update((g, s, t) for t in w)
    out = []
    for lang in {g for g, _, _ in words}:
        kept = sorted(t for (g, t), c in docs.items() if g == lang and c >= least)
        sources = sorted({s for g, s, _ in words if g == lang})
        total = lambda counts: sum(counts.values())

        def shares(counts, kept=kept, total=total):
            return {t: 1 + 10**9 * (counts[t] + 5) // (total(counts) + 5 * len(kept)) for t in kept}

        own = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -f, k + 1) for k, (f, _, o) in enumerate(far)]
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -f, k + 1) for k, (f, _, t) in enumerate(more)]
    return sorted(out)


ODD = [
    ("en", "a", "The THE the cat,cat\x00dog É é"), ("en", "b", "the cow! it's 12 é x ß"), ("en", "b", None), ("en", None, "dog dog the"),
    (None, "a", "the"), (None, None, ""), ("fr", "a", "..."), ("fr", "z", None), ("en", "c", "word " * 5000 + "ẞ K İ"), ("en", "b", "the cow! it's 12 é x ß"),
]


@pytest.mark.parametrize(("least", "top", "block", "terms"), [(1, 50, 256, 2048), (2, 2, 2, 3), (1, 3, 1, 1), (99, 5, 2, 2)])
def test_divergence_by_brute_force(spark, least, top, block, terms):
    rng = random.Random(7)
    texts = [(rng.choice(["en", "de"]), rng.choice("abcdefg"), " ".join(rng.choice(["ab", "Cd", "e-f", "gh", "ij", "ö", "kl", "zz"]) for _ in range(rng.randint(0, 20)))) for _ in range(60)]
    rows = [*ODD, *texts]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = divergence.audit(df, least_docs=least, top=top, per_block=block, term_block=terms)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least, top)


def test_divergence_of_odd_rows(docs, no_docs):
    out = collected(divergence.audit(docs))
    assert {r["value"] for r in out if r["part"] == "pair"} == {0} and not any(r["part"] == "term" for r in out)  # nothing is in 30 documents
    assert divergence.audit(no_docs).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    got = spark.range(1).select(F.lit(big).alias("n"), F.lit(big).alias("t"), F.lit(3).alias("v")).select(divergence._share("n", "t", "v")).first()[0]
    assert got == 1 + 10**9 * (big + 5) // (big + 15)


# -- prefix trie -----------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role is not None, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda t: t[:3])] for c, v in turns.items()}
    members, last = defaultdict(set), defaultdict(list)
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + seq[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        last[path].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len([w for w in re.split("[ \t-\r]+", q[-1][1]) if w]) for q in below if q)
        ends = hashlib.sha256(",".join(map(str, sorted(last[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, ends))
    return sorted(out, key=str)


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-45, n):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None]) if turn == 0 else turn, rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there", "", None, "a b  c"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_turns", [3, 20, 100_000])
def test_trie_by_brute_force(spark, shard_turns):
    rows = conversations(160, shard_turns)
    rows += [(400, k, "user", f"deep {k}") for k in range(120)] + [(401, k, "user", f"deep {k}") for k in range(119)]
    rows += [(c, 0, "system", "the same") for c in range(1000, 1100)]  # exact copies
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash")).withColumn("shard", F.lit("clash"))
    got = trie.nodes(df, shard_turns=shard_turns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (21, 0, None, None), (22, None, "user", "last? no, first"), (22, 0, "user", "x"), (22, 0, "user", "x"), (20, 0, "user", "word " * 20000), (20, 1, "", "")]
    assert sorted((tuple(r) for r in trie.nodes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain_trie(rows)
    assert trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = trie.nodes(spark.createDataFrame([(2, 0, "a", "b")], SCHEMA)).collect()  # nothing is left after the shared turns
    assert [tuple(r) for r in lone] == plain_trie([(2, 0, "a", "b")])


def test_ids_are_joined_in_pieces(spark):
    members = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("cid"), (F.col("id") * 7919 % 5000).alias("conv_id"))
    expected = defaultdict(list)
    for r in members.collect():
        expected[r["cid"]].append(r["conv_id"])
    got = {r["cid"]: r["ends"] for r in trie.joined_ids(members, piece=50).collect()}
    assert got == {c: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for c, v in expected.items()}


def test_skeleton_has_every_prefix_of_the_splitters():
    key = lambda *k: "".join(f"{x:032x}" for x in k)
    paths = sorted(key(*p) for p in [(1, 2, 3), (1, 2, 4), (1, 2, 5, 6), (2,), (3, 1), (3, 2)])
    borders = trie.splitters(paths, 3)
    assert borders == [key(1, 2, 5), key(3)]
    assert set(trie.skeleton(borders)) == {"", key(1), key(1, 2), key(1, 2, 5), key(3)}


def test_checks_are_registered():
    assert queries.CHECKS["op13_prefix_trie"] == checks.PREFIX_TRIE
