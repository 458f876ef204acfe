"""Quality rules, near-duplicates, class bigrams, licences, and the pipeline."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import brown, components, licences, packing, quality, simhash

xxhash = pytest.importorskip("xxhash")
SF = "/root/testdata/sf0.001"


def collected(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def base_statistics(text):
    w, raw = words(text), text or ""
    lines = [x for x in raw.split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", raw)), len(lines) - len(set(lines)), len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_by_brute_force(spark, docs):
    odd = ["a b c a b c a b c", "x\nx\n \n\ny\nx", "a a a a a", "é ß 🙂 #|<>\x1c z", "one\r\none\r\n", " \t\n"]
    texts = odd + [r.text for r in docs.collect()] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for r in collected(quality.judge(rows)):
        expected = base_statistics(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == expected, texts[r["doc_id"]]
        n, *_, repeat = expected
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(500)]
    clean = [" ".join(rng.choice(vocabulary, 80)) for _ in range(120)]
    junk = [" ".join(w + "###" for w in rng.choice(vocabulary, 80)) for _ in range(12)]
    rows = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in collected(quality.judge(rows)) if r["kept"]}
    assert kept == set(range(120))


def test_each_statistic_alone_rejects(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    draw = lambda n: list(rng.choice(vocabulary, n, replace=False))
    lines = lambda w: "\n".join(" ".join(w[k : k + 10]) for k in range(0, len(w), 10))
    clean = [lines(draw(100)) for _ in range(117)]
    few = draw(3)
    clean += ["\n".join([lines(draw(100)), few[0], " ".join(draw(9)), few[0]]), lines([*draw(90), *few, *draw(4), *few]), lines(draw(99)) + " $5"]
    phrase, line = draw(4), draw(10)
    long_words = [a + b + c for a, b, c in zip(draw(100), draw(100), draw(100), strict=True)]
    symbols = [w + "#" * (k % 4 == 0) for k, w in enumerate(draw(100))]
    repeats = [*draw(30), *phrase, *draw(10), *phrase, *draw(10), *phrase, *draw(5), *phrase, *draw(5), *phrase, *draw(5), *phrase, *draw(5), *phrase, *draw(5), *phrase]
    duplicates = "\n".join(x for k, w in enumerate(draw(90)) for x in ([w, "yes"] if k % 5 == 0 else [w]))
    copied = "\n".join(x for k in range(5) for x in (" ".join(draw(10)), " ".join(line)))
    junk = [lines(long_words), lines(symbols), lines(repeats), duplicates, copied]
    for k, text in enumerate(junk):  # each is one kind only, but for the last
        _, _, s, d, p = base_statistics(text)
        assert (s > 0, d > 0, p > 0) == ((False,) * 3, (True, False, False), (False, False, True), (False, True, False), (False, True, True))[k]
    rows = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    out = collected(quality.judge(rows))
    assert {r["doc_id"] for r in out if r["kept"]} == set(range(120)) and not any(r["base_failed"] for r in out)


def test_estimates_are_those_of_concentration_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, [0.3, 0.2, 0.5, 0.4], (400, 4)) + [1.5, 0.2, 0.3, 0.2]
    x[:60] += 5
    points = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    got = quality.estimates(points).first()

    def shape(rows, scale):
        return rows.mean(axis=0), scale * np.cov(rows.T, bias=True) + np.diag(np.square(quality.FLOORS))

    best = None
    for mean, cov in ((np.percentile(x, 50, axis=0, method="inverted_cdf"), np.diag(np.square(quality.FLOORS))), shape(x, 1.0)):
        for _ in range(quality.STEPS):
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(np.log2(d + 1e-9) * quality.BINS)
            values, counts = np.unique(bins, return_counts=True)
            edge = values[(np.cumsum(counts) - counts) < quality.SHARE * len(x)].max()
            mean, cov = shape(x[bins <= edge], quality._consistency())
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mean, cov
    assert np.allclose([got[f"m{i}"] for i in range(4)], best[1])
    low = np.array([[got[f"v{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose(low.T @ low, np.linalg.inv(best[2]))


def test_quality_of_odd_rows(docs, no_docs):
    out = collected(quality.judge(docs))
    assert len(out) == docs.count() and not any(r["kept"] for r in out if r["n_words"] < 50)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def print_of(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_brute_force(prints, radius=2):
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_fingerprints_and_components(spark):
    texts = ["The cat sat on the mat", "the CAT sat on\tthe mat", "", None, "one", "A b", "é É x y", "one two three four five six seven"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in collected(simhash.near_duplicates(rows))}
    prints = [print_of(t) for t in texts]
    root = by_brute_force(prints)
    for k in range(len(texts)):
        assert out[k]["fp"] & (1 << 64) - 1 == prints[k] and out[k]["component_id"] == root[k]


def test_masks_cover_every_pair():
    masks = simhash.masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            flip = 1 << i | 1 << j
            assert any(not m & flip for m in masks)


@pytest.mark.parametrize("small", [64, 1])
def test_links_by_brute_force(spark, monkeypatch, small):
    """Both ways through a bucket, the pairs and the points halfway, give the components of the definition."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(8)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63, 30)}
    for x in list(prints)[:6]:
        near = x
        for _ in range(25):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            near ^= int(np.array(sum(1 << int(b) for b in bits), np.uint64).view(np.int64))
            prints.add(near)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(frame)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in collected(edges))
    found = {r["node"]: r["root"] for r in collected(components.components(edges))}
    root = by_brute_force([p & (1 << 64) - 1 for p in prints])
    assert [found.get(p, p) for p in prints] == [prints[k] for k in root]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (7, 6)]
    got = {r["node"]: r["root"] for r in collected(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(docs, no_docs):
    out = collected(simhash.near_duplicates(docs))
    assert len(out) == docs.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (4, 5)} == {4}
    kept = collected(simhash.keep_one(docs))
    ids = [r["doc_id"] for r in kept]
    assert set(kept[0]) == set(docs.columns) and sorted(i for i in ids if i) == [1, 3, 4, 7, 8, 9] and None in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_class_bigrams_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    texts = {r.doc_id: [w.lower() for w in (r.text or "").encode().split()] for r in docs.collect()}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in learned for w in texts[i])
    total, distinct = sum(counts.values()) + len(learned), len(counts) + 1
    out = {r["doc_id"]: r for r in collected(brown.score(docs))}
    assert set(out) == set(texts)
    for i, w in texts.items():
        c = [counts[x] for x in w] + [len(learned)]
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((n + 0.1) / (total + 0.1 * (distinct + 1))) for n in c))
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(c), sum(n > 0 for n in c), total)
        assert out[i]["held_out"] == (i not in learned)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_model_by_brute_force(spark, monkeypatch):
    """Scores from the classes found, and each tail word's move against the likelihood of all classes it could take."""
    for name, value in (("BLOCK_TOKENS", 700), ("HEADS", 40), ("MIN_COUNT", 4), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(brown, name, value)
    seen: dict = {}
    keep, swap, units = brown.stored, brown.exchange, brown.Units
    monkeypatch.setattr(brown, "stored", lambda df, label: seen.setdefault(label, keep(df, label)))
    monkeypatch.setattr(brown, "exchange", lambda *a: seen.__setitem__("of", swap(*a)) or seen["of"])
    monkeypatch.setattr(brown, "Units", lambda *a: seen.setdefault("units", units(*a)))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    out = {r["doc_id"]: r for r in collected(brown.score(docs, classes=6))}

    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in learned for w in texts[i])
    moved = {bytes(r["word"]): (r["first"], r["class"]) for r in seen["tail"].collect()}
    heads = set(sorted((w for w in counts if counts[w] >= 4), key=lambda w: (-counts[w], w))[:40])
    assert len(heads) == 40 and set(moved) == {w for w in counts if counts[w] >= 4} - heads
    assert any(a != b for a, b in moved.values())

    def start(w):
        return int(seen["of"][seen["units"].of([w])[0]])

    def pairs(of):
        found = Counter()
        for i in learned:
            c = [6, *map(of, texts[i]), 6]
            found.update(zip(c, c[1:]))
        return found

    def likelihood(found):
        before, after = Counter(), Counter()
        for (a, b), n in found.items():
            before[a] += n
            after[b] += n
        return sum(n * math.log(n / before[a] / after[b]) for (a, b), n in found.items())

    first = {w: start(w) for w in counts}
    assert all(first[w] == a for w, (a, _) in moved.items())
    lone = [w for w in sorted(moved) if not any(x == y == w for i in learned for x, y in zip(texts[i], texts[i][1:]))]
    for w in lone[:25]:
        tried = [likelihood(pairs({**first, w: k}.__getitem__)) for k in range(6)]
        assert tried[moved[w][1]] >= max(tried) - 1e-6

    def of(w):
        return moved[w][1] if w in moved else start(w)

    found, mass, members = pairs(of), Counter({6: len(learned)}), Counter({6: 1})
    for w, n in counts.items():
        mass[of(w)] += n
        members[of(w)] += 1
    before, after, total = Counter(), Counter(), sum(found.values())
    for (a, b), n in found.items():
        before[a] += n
        after[b] += n
    for i, words in texts.items():
        c, value = [6, *map(of, words), 6], 0.0
        for a, b in zip(c, c[1:]):
            value += math.log10((found[a, b] + 6 * (after[b] + 0.1) / (total + 0.7)) / (before[a] + 6))
        value += sum(math.log10((counts[w] + 0.1) / (mass[of(w)] + 0.1 * (members[of(w)] + 1))) for w in words)
        assert out[i]["score"] == pytest.approx(value)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(6)
    units = rng.integers(0, 2, 4000)
    units = np.where(np.arange(4000) % 2, 10, 0) + rng.integers(0, 10, 4000)  # two kinds of words that alternate
    classes = np.append(np.arange(20) % 2, 2)

    def around(of):
        out = np.zeros((21, 2, 3), np.int64)
        np.add.at(out, (units[1:], 0, of[units[:-1]]), 1)
        np.add.at(out, (units[:-1], 1, of[units[1:]]), 1)
        return out

    weights = np.append(np.bincount(units, minlength=20), 0).astype(float)
    for _ in range(6):
        classes = brown.exchange(classes, around(classes), weights)
    assert len(set(classes[:10])) == 1 and len(set(classes[10:20])) == 1 and classes[0] != classes[10]


def test_class_bigrams_of_odd_rows(docs, no_docs):
    out = collected(brown.score(docs))
    assert len(out) == docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (4, 5)} == {1}
    assert brown.score(no_docs).count() == 0
    nothing = collected(brown.score(docs, held=F.lit(True)))
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in nothing)


@functools.cache
def plain_df(files):
    return Counter(t for f in files for t in {x for x in re.split("[^a-z0-9]+", f.lower()) if x})


def plain_cosines(text, files):
    """The best cosine of a text per licence."""
    terms = lambda x: [t for t in re.split("[^a-z0-9]+", x.lower()) if t]
    df = plain_df(tuple(files))
    known = {t for _, counts in licences.templates() for t in counts}
    idf = lambda t: math.log((1 + len(files)) / (1 + (df[t] if t in known else 0))) + 1
    own = {t: n * idf(t) for t, n in Counter(terms(text)).items()}
    out = {}
    for name, counts in licences.templates():
        other = {t: n * idf(t) for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in own.values()) * sum(v * v for v in other.values()))
        out[name] = max(out.get(name, 0), sum(v * other.get(t, 0) for t, v in own.items()) / norm if norm else 0)
    return out


def test_nothing_near_a_template_is_passed_over(spark):
    """The terms that a text must have are a bound, not a guess: pieces of templates with other words mixed in."""
    rng = np.random.default_rng(8)
    texts = ["of the in a word"] * 1500
    for name, counts in licences.templates():
        every = list(counts.elements())
        for share in (0.3, 0.6, 0.9, 1.0):
            part = [str(w) for w in rng.choice(every, max(1, int(share * len(every))), replace=False)]
            texts.append(" ".join(part + ["blah"] * int((1 - share) * 20)))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, raw string")
    model = licences.model_of(rows)
    may = {r["k"]: r["may"] for r in rows.select("k", model.may_match(licences._terms(F.col("raw"))).alias("may")).collect()}
    cosines = {t: max(plain_cosines(t, texts).values()) for t in set(texts)}
    best = [cosines[t] for t in texts]
    assert all(may[k] for k, c in enumerate(best) if c >= licences.NEAR) and not may[0]
    found = licences.match_blocks(spark, rows.select(F.col("k").alias("block"), F.col("raw").alias("text")), model).collect()
    assert {r["block"] for r in found} == {k for k, c in enumerate(best) if c >= licences.NEAR}
    assert all(abs(r["cosine"] - best[r["block"]]) < 1e-8 for r in found)


def test_vocabulary_is_looked_up_and_not_hashed_for_each_text(spark):
    """An intersection with a literal array puts the whole vocabulary into a set for each text and each line."""
    model = licences.Model({}, 10)
    rows = spark.createDataFrame([("the the licensed Licensed zzz",), ("",)], "raw string")
    plan = rows.select(model.may_match(licences._terms(F.col("raw"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "INSET" in plan.upper()
    assert licences.model_of(rows).idf["licensed"] < licences.model_of(rows).idf["software"]


def test_real_licence_texts(spark):
    read = lambda name: (licences.TEXTS / f"{name}.txt").read_text()
    fill = lambda text: text.replace("<year>", "2021").replace("<copyright holders>", "Ann Example and others")
    comment = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    code = "\n\nint main(void) {\n  return compute(argc, argv) ? run() : stop();\n}\n" * 20
    gnu = licences.GNU[1].format(what="program", name="General", version="3")
    wrapped = re.sub(r"(.{1,60})(?: |$)", r"\1\n", gnu)
    apache = re.sub(r"(.{1,50})(?: |$)", r"\1\n", licences.HEADERS["Apache-2.0"][2])
    names = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "Zlib", "CC0-1.0"]
    files = [(f"{n}/LICENSE", fill(read(n)), n, "file") for n in names]
    files += [(f"{n}/src/deep/a.c", "int x;\nreturn x;", n, "inherited") for n in names]
    files += [
        ("h/mit.c", "/*\n" + comment(fill(read("MIT")), " *") + "\n */" + code, "MIT", "header"),
        ("h/gpl.py", "#!/usr/bin/env python\n#\n" + comment(wrapped, "#") + code, "GPL-3.0", "header"),
        ("h/apache.java", "/*\n * Copyright 2020 The Authors\n *\n" + comment(apache, " *") + " */" + code, "Apache-2.0", "header"),
        ("h/spdx.rs", "// SPDX-License-Identifier: MIT" + code, "MIT", "header"),
        ("h/spdx2.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code, "GPL-2.0", "header"),
        ("h/spdx3.c", "# SPDX-License-Identifier: WTFPL" + code, "WTFPL", "header"),
        ("h/mpl.js", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */" + code, "MPL-2.0", "header"),
        ("n/talk.txt", "We talked about the licence of the software and the warranty of my car, and of copyright." + code, None, None),
    ]
    rows = spark.createDataFrame([(p, t) for p, t, _, _ in files] + [(f"x/{k}", f"words of the day in file {k} to be read") for k in range(60)], "path string, text string")
    out = {r["path"]: (r["licence"], r["via"]) for r in collected(licences.scan(rows, F.col("path")))}
    wrong = {p: out[p] for p, _, name, via in files if out[p] != (name, via)}
    assert len(wrong) <= 0.05 * len(files), wrong


def test_licences_by_brute_force(spark):
    files = [
        ("p/LICENSE", "Released under the MIT License."),
        ("p/a.txt", "Some text.\nMore of it."),
        ("p/q/b.txt", "x " * 30 + "\nLicensed under the Apache License, Version 2.0.\nend"),
        ("p/q/r/c.txt", "nothing"),
        ("z/c.txt", "no licence far and wide, not one that would matter to anyone"),
        ("top.txt", None),
        (None, "Licensed under CC BY-NC 4.0."),
        ("w/s/NOTICE", "This work is licensed under the GNU General Public License, version 3."),
        ("w/s/t/u/d.txt", ""),
        ("w/d.txt", "Copyright of nobody"),
    ]
    rows = spark.createDataFrame(files, "path string, text string")
    out = {r["path"]: r for r in collected(licences.scan(rows, F.col("path")))}
    via = {p: (r["licence"], r["via"], r["origin"]) for p, r in out.items()}
    assert via["p/LICENSE"] == ("MIT", "file", "p/LICENSE")
    assert via["p/a.txt"] == via["p/q/r/c.txt"] == ("MIT", "inherited", "p/LICENSE")
    assert via["p/q/b.txt"] == ("Apache-2.0", "header", "p/q/b.txt")
    assert via["w/s/t/u/d.txt"] == ("GPL-3.0", "inherited", "w/s/NOTICE")
    assert via["z/c.txt"] == via["top.txt"] == via["w/d.txt"] == (None, None, None)
    assert via[None][:2] == ("CC-BY-NC-4.0", "file")
    every = [t or "" for _, t in files]
    for p, x in files:
        best = max((plain_cosines(line, every) for line in (x or "").split("\n")), key=lambda c: max(c.values()))
        if out[p]["via"] in ("file", "header"):
            assert abs(out[p]["cosine"] - max(best.values())) < 1e-8 and best[out[p]["licence"]] == max(best.values())
        else:
            assert max(best.values()) < licences.NEAR


def test_licences_of_odd_rows(docs, no_docs):
    path = F.concat_ws("/", "source", "doc_id")
    assert licences.scan(docs, path, keep=("doc_id", "shard")).count() == docs.count()
    assert licences.scan(no_docs, path).count() == 0


def shingled(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        assert after.items() <= before.items()
        if name == "near_duplicates":
            # each text removed is like a smaller one, or like one that is, and none that stays is like another
            sets = {i: frozenset(shingled(t)) for i, t in before.items()}
            like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
            assert all(any(j != i and like(sets[i], sets[j]) for j in before) for i in before.keys() - after.keys())
            stay = [sets[i] for i in after]
            assert not any(like(a, b) for k, a in enumerate(stay) for b in stay[:k])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id").dropDuplicates(["text"]).where(F.size(F.split("text", " ")) > 60)
    lost = clean.join(kept.select("text"), "text", "left_anti")
    assert lost.count() <= 0.05 * clean.count()


def test_pipeline_runs_as_a_whole(spark, docs, no_docs):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.WINDOW).isEmpty()
    for odd in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            odd = stage(spark, odd, SF)
        assert odd.count() >= 0
