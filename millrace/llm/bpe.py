"""BPE encoding by speculation: greedy longest match, a check of all adjacent pairs, exact merging where it fails.

A sequence of tokens is the BPE encoding of a word if each token encodes
itself, and no merge ever joins symbols across the border of two neighbours.
While a token is built by merges, its last symbol changes at certain ranks, and
so does the first symbol of the token after it. A merge of rank r crosses the
border if it joins a last and a first symbol that are both there when r's turn
comes. This is so because merges of a trained vocabulary only use symbols of
lower rank, so that they are applied in the order of their ranks; vocabularies
for which that doesn't hold are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import Memory, ready

NEVER = 1 << 30
# Chunks of printable ASCII and the Latin-1 letters (all composed), cut as the vocabulary file says.
PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level characters: printable bytes stand for themselves, the others for the code points from 256 on, in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}
LONG = 256  # symbols of a word, from which merging keeps a heap
CACHE = 300_000  # chunks of text whose tokens a worker remembers
GROUP = 1_000_000  # characters of texts that are encoded together
PART = 20_000  # chunks whose borders are checked together


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """A vocabulary file of the tokenizers library: BPE with word ends over byte-level characters."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        own = Tokenizer.from_file(path)
        self.normalise, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.ranks: dict[tuple[int, int], int] = {}
        self.whole: list[int] = []  # by rank
        self.known = Memory(CACHE)  # tokens of words
        self.judged: dict[tuple[int, int], bool] = {}  # pairs whose border was checked
        made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = self.vocab[a + b]
            left, right = self.vocab[a], self.vocab[b]
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("a merge uses a symbol that is made later")
            made.setdefault(whole, rank)
            self.ranks[left, right] = rank
            self.whole.append(whole)
        keys = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([*self.ranks.values()], np.int64)[order]
        self.reach: dict[str, int] = {}  # characters of the longest token that begins with these two, or is this one
        for name in self.vocab:
            bare = name.removesuffix(self.suffix) if self.suffix else name
            self.reach[bare[:2]] = max(self.reach.get(bare[:2], 1), len(bare))
        self.right: dict[int, list] = {}  # token: its last symbols as (symbol, made at, used at); None if it doesn't encode itself
        self.left: dict[int, list] = {}

    def symbols(self, word: str) -> list[int]:
        """The characters' ids; the last one carries the word end."""
        ids = [self.vocab.get(c) for c in word[:-1]] + [self.vocab.get(word[-1] + self.suffix)]
        return [i for i in ids if i is not None]

    def merge(self, ids: list[int], seen: Callable[[int, list[int]], None] | None = None) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        if len(ids) > LONG and not seen:
            return self._merge_long(ids)
        ids, find, whole = list(ids), self.ranks.get, self.whole
        ranks = [find(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) != NEVER:
            k = ranks.index(rank)
            ids[k : k + 2] = [whole[rank]]
            del ranks[k]
            if k:
                ranks[k - 1] = find((ids[k - 1], ids[k]), NEVER)
            if k < len(ranks):
                ranks[k] = find((ids[k], ids[k + 1]), NEVER)
            if seen:
                seen(rank, ids)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over linked symbols."""
        n, ids = len(ids), list(ids)
        after, before, find = [*range(1, n), -1], [-1, *range(n - 1)], self.ranks.get
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := find((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = self.whole[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := find((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def _edges(self, token: int) -> None:
        """How the first and the last symbol of a token change as it is merged."""
        name = self.names[token]
        ends = bool(self.suffix) and name.endswith(self.suffix)
        bare = name[: -len(self.suffix)] if ends else name
        ids = self.symbols(bare) if ends else [self.vocab[c] for c in bare]
        first, last = [[ids[0], -1, NEVER]], [[ids[-1], -1, NEVER]]

        def seen(rank: int, now: list[int]) -> None:
            for edge, symbol in ((first, now[0]), (last, now[-1])):
                if edge[-1][0] != symbol:
                    edge[-1][2] = rank
                    edge.append([symbol, rank, NEVER])

        whole = self.merge(ids, seen) == [token]
        self.left[token], self.right[token] = (first, last) if whole else (None, None)

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if a character is not in the vocabulary."""
        marked, at, out = word + self.suffix, 0, []
        end, find, reach = len(word), self.vocab.get, self.reach.get
        while at < end:
            for upto in range(min(end, at + reach(word[at : at + 2], 1)), at, -1):
                token = find(marked[at:] if upto == end else marked[at:upto])
                if token is not None:
                    break
            else:
                return None
            out.append(token)
            at = upto
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each row (token, token): no merge crosses their border, and both encode themselves."""
        for token in np.unique(pairs).tolist():
            if token not in self.left:
                self._edges(token)
        rows: list[tuple[int, int, int, int, int, int]] = []
        good = np.ones(len(pairs), bool)
        for k, (a, b) in enumerate(pairs.tolist()):
            last, first = self.right[a], self.left[b]
            if last is None or first is None:
                good[k] = False
                continue
            rows.extend((k, (s << 32) | u, made_s, used_s, made_u, used_u) for s, made_s, used_s in last for u, made_u, used_u in first)
        if not rows:
            return good
        at, key, made_s, used_s, made_u, used_u = np.array(rows, np.int64).T
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank = np.where(self.keys[found] == key, self.key_ranks[found], -1)
        # Of equal ranks the leftmost pair is merged first: the symbol before the border is gone
        # if its own merge has the same rank, the one after it is still there.
        crosses = (rank > made_s) & (rank < used_s) & (rank > made_u) & (rank <= used_u)
        good[at[crosses]] = False
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word."""
        out = [self.propose(w) for w in words]
        judged = self.judged
        if len(judged) > 8 * CACHE:
            judged.clear()
        single = {t for x in out if x for t in x if t not in self.left}
        for token in single:
            self._edges(token)
        new = list({p for x in out if x for p in zip(x, x[1:], strict=False)} - judged.keys())
        judged.update(zip(new, self.compatible(np.array(new, np.int64).reshape(-1, 2)).tolist(), strict=True))
        done = []
        for word, x in zip(words, out, strict=True):
            fine = x is not None and (all(judged[p] for p in zip(x, x[1:], strict=False)) if len(x) > 1 else self.left[x[0]] is not None)
            done.append(x if fine else self.merge(self.symbols(word)))
        return done

    def chunk_words(self, chunk: str) -> list[str | int]:
        """A chunk's words in byte-level characters; an added token is its id."""
        parts: list[str | int] = [chunk]
        for content, token in self.added.items():
            if content in chunk:
                cut: list[str | int] = []
                for part in parts:
                    if isinstance(part, str):
                        for k, piece in enumerate(part.split(content)):
                            cut += [token] * (k > 0) + [piece]
                    else:
                        cut.append(part)
                parts = cut
        out: list[str | int] = []
        for part in parts:
            if isinstance(part, int):
                out.append(part)
            elif PLAIN.fullmatch(part):
                found = PLAIN_WORDS.findall(part.lower())
                out += found if part.isascii() else [w.encode().decode("latin-1").translate(BYTE_LEVEL) for w in found]
            elif part:
                out += [w for w, _ in self.cut(self.normalise(part)) if w]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Of pieces of text without white space: ids as little-endian numbers, and the tokens' names, a space after each."""
        cut = [self.chunk_words(c) for c in chunks]
        words = self.known.missing({w for x in cut for w in x})
        names, ids = self.names, self.known.young
        ranges = [[w] if isinstance(w, int) else None for w in words]
        plain = iter(self.encode_words([w for w in words if isinstance(w, str)]))
        for word, own in zip(words, ranges, strict=True):
            found = own or next(plain)
            ids[word] = (struct.pack(f"<{len(found)}I", *found), "".join([names[i] + " " for i in found]).encode())
        return [ids[x[0]] if len(x) == 1 else (b"".join([ids[w][0] for w in x]), b"".join([ids[w][1] for w in x])) for x in cut]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> Memory:
    return Memory(CACHE)


def encode(texts: list[str | None], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Whole texts' ids as little-endian unsigned 32-bit numbers, and the decoded texts in UTF-8.

    ASCII white space is part of no token, so the chunks between it are encoded
    by themselves, and a worker remembers those it has met. Decoding joins the
    tokens' names by spaces, as a vocabulary without decoder asks for.
    """
    memory, own = _memory(path), codec(path)
    chunks = [(x or "").encode("utf-8", "replace").split() for x in texts]
    new = memory.missing(dict.fromkeys(chain.from_iterable(chunks)))
    known = memory.young
    for at in range(0, len(new), PART):
        part = new[at : at + PART]
        known.update(zip(part, own.encode_chunks([c.decode() for c in part]), strict=True))
    for x in chunks:
        got = [known[c] for c in x]
        yield b"".join([g[0] for g in got]), b"".join([g[1] for g in got])[:-1]


def encode_batch(batch: pa.Array, path: str) -> Iterator[tuple[bytes, bytes]]:
    """All texts of an Arrow batch, some megabytes at a time."""
    group, held = [], 0
    for x in batch:
        group.append(text := x.as_py())
        held += len(text or "")
        if held > GROUP:
            yield from encode(group, path)
            group, held = [], 0
    yield from encode(group, path)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the whole text; null is the empty text.

    Rows stand alone: repeated rows and null ids are encoded like others.
    """
    ready(docs.sparkSession)
    path = path or default_path()
    result = StructType.fromDDL("n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    @F.arrow_udf(result)
    def run(batch: pa.Array) -> pa.Array:
        n, ids, decoded = [], [], []
        for a, b in encode_batch(batch, path):
            n.append(len(a) // 4)
            ids.append(hashlib.sha256(a).hexdigest())
            decoded.append(hashlib.sha256(b).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("x")).select("doc_id", "x.*")


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, ids and the decoded text, for users of the tokens themselves."""
    ready(docs.sparkSession)
    path = path or default_path()

    @F.arrow_udf(StructType.fromDDL("ids array<int>, decoded string"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = list(encode_batch(batch, path))
            ids = pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in got], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([ids, pa.array([b.decode() for _, b in got], pa.string())], ["ids", "decoded"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("x")).select("doc_id", "x.*")
