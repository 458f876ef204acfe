"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random
import re

import pyarrow as pa

from millrace.llm import near, simhash


def shingle_set(text):
    w = re.findall("[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return tuple(w), frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(rows):
    """Union of all pairs that are similar enough or have equal words."""
    own = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = own[a][1], own[b][1]
            if own[a][0] == own[b][0] or len(x & y) >= 0.8 * len(x | y) > 0:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["group"] for r in near.groups(docs).collect()}
    expected = plain_groups(rows)
    assert set(got) == set(expected)
    joined = [i for i, g in expected.items() if g != i]
    found = [i for i in joined if got[i] == expected[i]]
    assert len(joined) > 20 and len(found) >= 0.95 * len(joined)
    # whatever is grouped is similar to a member of its group
    assert all(expected[i] == expected[g] for i, g in got.items())


def test_large_groups_and_odd_rows(spark, docs, no_docs):
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = [(k, " ".join(base)) for k in range(500, 530)]
    for k in range(150):  # one or two words differ: buckets of more members than are compared pair by pair
        words = base[:]
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((k, "  ".join(words).upper() if k % 9 == 0 else "\n".join(words)))
    rows += [(900, "a b c"), (901, "A  b\tc"), (902, "a b d"), (903, None), (904, ""), (None, "a b c")]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, rep string, kept_id int")
    got = {r["doc_id"]: r["group"] for r in near.groups(table).collect()}
    assert got == plain_groups(rows)
    kept = near.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *sorted(set(got.values()))]
    assert near.keep_one(docs).columns == docs.columns and near.keep_one(no_docs).count() == 0


def test_a_large_bucket_keeps_links_beside_its_middle(spark):
    """``far`` is similar to ``bridge`` only, which is similar to the middle: both are found in one bucket of 15."""
    base = list(range(100))
    sets = {f"m{i:02}": [1000 + i, *base] for i in range(12)} | {"m99": base, "bridge": base[:90], "far": base[:78]}
    sets |= {"alone": base[:40]}
    table = spark.createDataFrame([(k.encode(), v) for k, v in sets.items()], "rep binary, set array<int>")
    members = spark.createDataFrame([(7, k.encode(), len(sets)) for k in sets], "bucket long, rep binary, n long")
    # the middle is the member of most weight: another bucket gives it to m99
    members = members.union(spark.createDataFrame([(8, b"m99", 2), (8, b"m00", 2)], members.schema))
    links = {(bytes(r.a), bytes(r.b)) for r in near._met(members, table).collect()}
    assert (b"bridge", b"far") in links
    assert {x for pair in links for x in pair} == {k.encode() for k in sets} - {b"alone"}


def test_equal_fingerprints_are_all_compared(spark):
    """Classes whose fingerprints lie within two bits are candidates, not only one class of each fingerprint."""
    prints = [0, 3, 12, -(1 << 63), -1, 5 << 40]
    rows = simhash.points(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    by_point = {}
    for r in rows:
        by_point.setdefault(r.point, set()).add(r.fp)
    met = {(a, b) for held in by_point.values() for a in held for b in held if a < b}
    close = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert met == close


def test_sketches_hold_one_text_at_a_time(monkeypatch):
    """A batch comes back in slices, so what is held doesn't grow with the rows of a batch."""
    monkeypatch.setattr(near, "SLICE", 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": ["a b c d e f", None, "", "A b  c d e f", "x", "y", "x", "z"]})
    out = list(near._sketched(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in out] == [3, 3, 2]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(8)) and rows[0]["words"] == rows[3]["words"] and rows[1]["set"] == rows[2]["set"] == []


def test_rest_is_exact_and_needs_no_pairs_of_strangers(spark, monkeypatch):
    """Sets around one another at similarities about the threshold: their components, without all their pairs."""
    rng = random.Random(4)
    sets = {k: sorted({*range(k % 3 * 7, 60 + k % 3 * 7), *(rng.randrange(200, 260) for _ in range(rng.randrange(2, 12)))}) for k in range(120)}
    sets |= {k: [*range(60), *range(1000 * k, 1000 * k + 40)] for k in range(120, 320)}  # 0.43 similar to each other
    table = spark.createDataFrame([(k, v) for k, v in sets.items()], "rep long, set array<int>")
    crowd = spark.createDataFrame([(1, k) for k in sets], "bucket long, rep long")
    seen, similar = [], near._similar
    monkeypatch.setattr(near, "_similar", lambda pairs, sets: seen.append(pairs.count()) or similar(pairs, sets))
    none = spark.createDataFrame([], "a long, b long")
    links = {(r.a, r.b) for r in near._rest(crowd, none, table).collect()}
    own = {k: set(v) for k, v in sets.items()}
    assert links == {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert links and seen[0] < 120 * 119 / 2  # none of the 200 that are alike in their common part only
