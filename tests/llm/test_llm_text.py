"""Language ID, BPE, packing and sharding."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, common, langid, packing, queries, sharding

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_words_split_at_ascii_white_space_only():
    assert common.words_of("A b\x1cC \t\x0bÉ") == ["a b\x1cc".encode(), "É".encode()]
    assert common.words_of(None) == []


def every_segmentation(word, pieces, probs):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(len(word), langid.MAX_PIECE) + 1):
        if word[:n] in pieces:
            total += probs[pieces[word[:n]]] * every_segmentation(word[n:], pieces, probs)
        elif n == 1:
            total += probs[-1] * every_segmentation(word[1:], pieces, probs)
    return total


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"])}
    probs = np.random.default_rng(1).random((2, len(pieces) + 1)) / 9
    words = ["", "a", "abab", "bbaaxab", "abaabbaabbaba"]
    got = langid.Segmenter(pieces, probs).score(words)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert np.isclose(np.exp(row[k]), every_segmentation("▁" + w, pieces, probs[k]))


def test_long_words_are_scored_like_short_ones():
    pieces = {p: i for i, p in enumerate(["▁", "a", "ab", "b"])}
    s = langid.Segmenter(pieces, np.array([[0.2, 0.3, 0.1, 0.4, 1e-9]]))
    word = "abba" * 5
    assert np.allclose(s._long("▁" + word), s.score([word])[0])
    assert np.isfinite(s.score(["abba" * 5000])).all()


def test_expected_uses_match_enumeration():
    pieces = {p: i for i, p in enumerate(["▁", "a", "ab", "b"])}
    probs = np.array([[0.25, 0.25, 0.25, 0.25, 1e-9]])
    # ▁ a b and ▁ ab: weights 1/64 and 1/16
    got = langid.Segmenter(pieces, probs).expected({"ab": 10})
    assert np.allclose(got[:4], [10, 2, 8, 2])


def test_no_piece_of_the_vocabulary_is_left_out():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.default_path())
    longest = max((model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)), key=len).lower()
    pieces = langid.vocabulary(langid.default_path())
    assert longest in pieces and max(map(len, pieces)) == langid.MAX_PIECE


def test_long_words_are_learned_whole():
    pieces = {p: i for i, p in enumerate(["▁", "a", "ab", "b", "abababab" * 2 + "ababa"])}
    s = langid.Segmenter(pieces, np.array([[0.2, 0.2, 0.2, 0.2, 0.2, 1e-9]]))
    short, long = np.zeros((2, len(pieces) + 1))
    for word in ("abba" * 5, "ab" * 11 + "a"):
        short += s.expected({word: 3})
        s._add_long(long, "▁" + word, 3)
    assert np.allclose(short, long)
    got = s.expected({"ab" * 600: 2})
    letters = got[1] + got[3] + 2 * got[2] + 21 * got[4]
    assert np.isclose(got[0], 2) and np.isclose(letters, 2400) and got[4] > 0  # one mark a word: it is not cut


def test_language_of_odd_rows(docs, no_docs):
    out = collected(langid.identify(docs).select("doc_id", "text", F.col("language.found.*")))
    assert len(out) == docs.count()
    for r in out:
        if r["text"] is None or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in collected(langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("language.found.*"))} == {"und"}


def test_language_accuracy_on_held_out(spark):
    out = queries.QUERIES["op7_segmented_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 0


ODD = [
    "", "a<|startoftext|>b <|endoftext|> c", "Ünïcode ΣΑΣ ΟΔΟΣ. x y", "'S don't I'LL ''t", "aaaaaaaa" * 60, "日本語🙂 12 ١٢",
    "é á", "\x1c a\x1cb", "½ ǅ İi", "!!??..,,", "\x00 \x07", " <|endoftext|><|endoftext|>", "  lead  double ", "\n\n x \n", None,
]


def test_bpe_is_that_of_the_library(spark):
    path = bpe.default_path()
    own = tokenizers.Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in collected(bpe.digests(rows)):
        ids = own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids), texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_verification_finds_what_greedy_gets_wrong():
    codec = bpe.codec(bpe.default_path())
    words = sorted({w for n in range(400) for w in (f"th{n:x}eresting", f"un{n:o}able", "ab" * (n % 9) + "cd")})
    words = [w for w in words if w.isalnum()]
    exact = [codec.merge(codec.symbols(w)) for w in words]
    assert codec.encode_words(words) == exact
    assert any(codec.propose(w) != e for w, e in zip(words, exact, strict=True))
    long = codec.symbols("abracadabra" * 60)
    assert codec._merge_long(long) == codec.merge(long, lambda *_: None)


def test_memory_keeps_what_is_used():
    memory = common.Memory(2)
    for key in "abcabdabe":
        for new in memory.missing([key]):
            memory.young[new] = key
        assert len(memory.young) + len(memory.old) <= 6
    assert memory.missing(["b"]) == []


def pieces_are_whole(rows, texts):
    path = packing.default_path()
    own = tokenizers.Tokenizer.from_file(path)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return windows


def test_packing_holds_every_id_once(spark):
    texts = {k: x for k, x in enumerate([*ODD, "word " * 5000])}
    rows = collected(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    pieces_are_whole(rows, texts)


def test_packing_of_odd_rows(docs, no_docs):
    rows = collected(packing.pack(docs))
    assert Counter(r["doc_id"] for r in rows)[2] >= 2 and None in {r["doc_id"] for r in rows}
    assert packing.pack(no_docs).count() == 0


def test_packing_fills_windows_with_neighbours():
    rng = np.random.default_rng(5)
    topics = [rng.integers(1000 * t, 1000 * t + 400, (30, 100)).astype("<u4") for t in range(1, 5)]
    docs = [np.append(d, 0).astype("<u4") for k in range(30) for d in (t[k] for t in topics)]
    windows = defaultdict(list)
    for k, _, n, sequence, _ in packing.pack_shard(docs):
        windows[sequence].append((k % 4, n))
    assert sum(n for w in windows.values() for _, n in w) == sum(map(len, docs))
    assert sum(sum(n for _, n in w) < packing.WINDOW for w in windows.values()) <= 1
    same = [max(Counter(t for t, _ in w).values()) / len(w) for w in windows.values()]
    assert np.mean(same) > 0.8  # by chance 0.3


def test_bm25_neighbours_by_brute_force():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 60, rng.integers(5, 40)), 0).astype("<u4") for _ in range(40)]
    index, n = packing.Index(docs), 40
    mean = np.mean([len(d) - 1 for d in docs])
    df = Counter(t for d in docs for t in set(d[:-1].tolist()))

    def weight(t, d):
        c = d[:-1].tolist().count(t)
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * (len(d) - 1) / mean))

    unused = np.ones(n, bool)
    unused[7] = False
    terms = [t for t in dict.fromkeys(docs[7][:-1].tolist()) if df[t] > 1]
    terms = sorted(sorted(terms), key=lambda t: -weight(t, docs[7]))[: packing.QUERY_TERMS]
    scores = np.array([sum(weight(t, d) for t in terms if t in d[:-1]) for d in docs]) * unused
    got = index.neighbours(7, unused)
    assert set(got) == set(np.flatnonzero(scores))
    assert np.allclose(scores[got], np.sort(scores[got])[::-1])


def test_windows_are_filled_by_all_shared_terms():
    """The first two share the 24 weightiest terms of the seed, the last two one lighter term with it."""
    lists = [[*range(1, 25), 100], [*range(1, 25)], [*range(200, 224)], [100, *range(300, 323)], [100, *range(400, 423)]]
    docs = [np.array([*x, packing.END], "<u4") for x in lists]
    windows = defaultdict(list)
    for k, _, _, sequence, _ in packing.pack_shard(docs, window=26 + 25 + 25):
        windows[sequence].append(k)
    assert windows[0] == [0, 1, 3]


def test_shards_are_exact(docs, no_docs):
    rows = collected(sharding.shuffle_into_shards(docs.repartition(3)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[4]["size"], by_id[4]["text_crc32"], by_id[5]["size"]) == (1, 0, 1)
    assert by_id[3]["text_crc32"] == zlib.crc32(docs.where("doc_id = 3").first().text.encode())
    assert sharding.shuffle_into_shards(no_docs).count() == 0


def test_communication_matrix_has_exact_margins():
    rows = [0, 5, 17, 1000, 3, 0, 250]
    m = np.array(sharding.communication_matrix(rows, 8))
    assert m.sum(axis=1).tolist() == rows and np.ptp(m.sum(axis=0)) <= 1
    # cell means over seeds are those of a uniform permutation
    mean = np.mean([np.array(sharding.communication_matrix([40, 60], 4, s))[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 10, atol=0.6)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(2)
    draws = [sharding._draw(rng, 2 * 10**9, 6 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 250) < 4 and 10 < np.std(draws) < 18


def test_shuffle_is_uniform(spark):
    rows = spark.range(4000, numPartitions=5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shuffle_into_shards(rows).select("doc_id", "shard", "slot").toPandas()
    assert abs(np.corrcoef(got.doc_id, got.shard * 500 + got.slot)[0, 1]) < 0.06
    counts = np.histogram2d(got.doc_id // 500, got.shard, bins=[8, 8])[0]
    assert ((counts - 62.5) ** 2 / 62.5).sum() < 100  # chi-square of about 49


def test_words_keep_their_marks():
    words = {"हिन्दी भाषा": ["हिन्दी", "भाषा"], "தமிழ்": ["தமிழ்"], "ภาษาไทย ที่นี่": ["ภาษาไทย", "ที่นี่"], "cafe\u0301 1st_x": ["cafe\u0301", "st", "x"], "\u0301a": ["a"], "\u0661 ٣": []}
    for text, expected in words.items():
        assert langid.LETTERS.findall(text.lower()) == expected
    import unicodedata

    import public_tokenizers

    for piece in langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")):
        bare = piece.lstrip(langid.MARK)
        if bare and all(unicodedata.category(c)[0] in "LM" for c in bare) and unicodedata.category(bare[0])[0] == "L":
            assert langid.LETTERS.fullmatch(bare), piece
