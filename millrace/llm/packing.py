"""Packing into fixed windows by lexical retrieval.

Documents are dealt to shards as they are read; each shard has a BM25 inverted
index of its documents. A seed document opens a window; the index returns its
nearest unused neighbours, which fill the window. What is too long for the rest
of a window is cut, and the cut-off part opens the next window, so that only the
last window of a shard has padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import ready

WINDOW = 1024
END = 0  # the id after each document
SHARD_TOKENS = 4_000_000  # tokens after which a shard is packed and its memory given back
QUERY_TERMS = 24  # the seed's weightiest terms that are asked for first
K1, B = 1.2, 0.75
CACHE = 300_000  # pieces of text whose ids a worker remembers
LOOSE = re.compile(r" (?=\s)| $")  # a space that does not lead a word


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words(dict):
    """ids of words with the space that leads them, in two generations: what is used stays."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = array("I", self.encode(" " + word)).tobytes()
        self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class Tokens:
    """ids of whole texts by a byte-level vocabulary file, which the rank file beside it holds as well.

    A space that leads a word always begins a new token, so texts are encoded
    word by word with what leads it, and a worker remembers the words it has met.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self.fast.encode_ordinary)

    def encode(self, text: str) -> np.ndarray:
        if any(m in text for m in self.marks):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        if LOOSE.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        self.words.trim()
        first, *parts = text.split(" ")
        ids = array("I", self.fast.encode_ordinary(first)).tobytes()
        return np.frombuffer(b"".join([ids, *map(self.words.__getitem__, parts)]), "<u4")


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


class Index:
    """BM25 postings of a shard's documents; a document that is used gets no more score."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        terms, counts, owners = [], [], []
        for k, ids in enumerate(docs):
            t, c = np.unique(ids[:-1], return_counts=True)
            terms.append(t)
            counts.append(c)
            owners.append(np.full(len(t), k))
        term, count = np.concatenate(terms), np.concatenate(counts).astype(float)
        self.owner = np.concatenate(owners)
        n, length = len(docs), np.array([len(d) - 1 for d in docs], float)
        mean = max(1.0, length.mean())
        order = np.argsort(term, kind="stable")
        self.term = term[order]
        self.names, starts = np.unique(self.term, return_index=True)
        self.starts = np.append(starts, len(term))
        df = np.diff(self.starts)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.df = df
        norm = count + K1 * (1 - B + B * length[self.owner] / mean)
        own = np.searchsorted(self.names, term)
        weight = self.idf[own] * count * (K1 + 1) / norm
        # A document's weightiest terms that another document has too, as places in ``names``.
        shared = df[own] > 1
        ranked = np.lexsort((-weight, self.owner))
        ranked = ranked[shared[ranked]]
        of = self.owner[ranked]
        first = np.searchsorted(of, np.arange(n))
        self.query = np.split(own[ranked], first[1:])
        self.weight, self.owner = weight[order], self.owner[order]
        self.n = n

    def related(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed: those that share one of its weightiest, then of the next, twice as many each time."""
        a, z = 0, QUERY_TERMS
        while a < len(self.query[seed]):
            for k in self.neighbours(seed, unused, a, z):
                yield int(k)
            a, z = z, z + 2 * (z - a)

    def neighbours(self, seed: int, unused: np.ndarray, a: int = 0, z: int = QUERY_TERMS) -> np.ndarray:
        """Unused documents that share one of the seed's terms from ``a`` up to ``z`` in order of weight, best first; ties by position."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.query[seed][a:z]]
        if not spans:
            return np.empty(0, np.int64)
        owner = np.concatenate([self.owner[s] for s in spans])
        score = np.bincount(owner, np.concatenate([self.weight[s] for s in spans]), self.n) * unused
        found = np.flatnonzero(score)
        if len(found) > WINDOW:  # a window holds no more documents than it has places
            found = found[np.argpartition(-score[found], WINDOW)[:WINDOW]]
            found.sort()
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece; every id lies in exactly one.

    Full windows at the head of a document are sequences of their own; the rest
    of it, or a whole short document, is what windows are filled with.
    """
    index = Index(docs)
    rest = np.array([len(d) for d in docs])
    done = np.zeros(len(docs), np.int64)
    sequence = 0
    for k in range(len(docs)):
        while rest[k] >= window:
            yield k, int(done[k]), window, sequence, 0
            done[k] += window
            rest[k] -= window
            sequence += 1
    unused = rest > 0
    room, at, seed, follow = window, 0, None, iter(())
    scan = 0
    while True:
        k = next((x for x in follow if unused[x]), None)
        if k is None:  # no neighbour is left: the next unused document in order of reading
            while scan < len(docs) and not unused[scan]:
                scan += 1
            if scan == len(docs):
                return
            k = scan
        if seed is None:
            seed, unused[k] = k, False
            follow = index.related(k, unused) if rest[k] < room else iter(())
        unused[k] = False
        n = int(min(room, rest[k]))
        yield k, int(done[k]), n, sequence, at
        done[k] += n
        rest[k] -= n
        room -= n
        at += n
        if not room:
            sequence += 1
            room, at, seed, follow = window, 0, None, iter(())
            if rest[k]:  # the cut-off part opens the next window
                seed, at, room = k, int(rest[k]), window - int(rest[k])
                yield k, int(done[k]), at, sequence, 0
                done[k] += at
                rest[k] = 0
                follow = index.related(k, unused)


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard long"


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Pieces of all documents' ids in sequences of at most ``WINDOW``.

    A document's ids are those of its whole text, and ``END``; null is the empty
    text, one id. Rows stand for themselves: repeated rows, null ids and equal
    texts are each packed. A shard is what one task reads until it has
    ``SHARD_TOKENS`` tokens, so no row moves, and a lost task packs the same rows
    again in the same way. A sequence's number holds the task's in its upper
    bits. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokens(path), TaskContext.get().partitionId()
        ids: list = []
        texts: list[np.ndarray] = []
        held = shard = base = 0
        end, id_type = np.array([END], "<u4"), to_arrow_type(kind)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, held, shard, base
            if not texts:
                return
            rows = list(pack_shard(texts))
            crc = [zlib.crc32(texts[k][a : a + n].tobytes()) for k, a, n, _, _ in rows]
            k, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            sizes = np.array([len(t) for t in texts])
            first = (part << 36) + base
            cols = [pa.array(ids, id_type).take(pa.array(k)), start, length, crc, sizes[k], sequence + first, offset, np.full(len(k), (part << 20) + shard)]
            base += int(sequence.max()) + 1
            ids, texts, held, shard = [], [], 0, shard + 1
            yield pa.RecordBatch.from_arrays([cols[0], *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "shard"]
        for batch in batches:
            ids_col = batch.column(0)
            for at, x in enumerate(batch.column(1)):
                got = np.concatenate([own.encode(x.as_py() or ""), end])
                ids.append(ids_col[at].as_py())
                texts.append(got)
                held += len(got)
                if held >= SHARD_TOKENS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES.format(id=kind.simpleString()))
