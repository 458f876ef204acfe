"""Language identification by unigrams over pieces of a fixed vocabulary, summed over all segmentations.

For each language every piece has a probability. A text's probability is the
sum over all ways to cut its words into pieces of the product of the pieces'
probabilities; a forward algorithm computes it. Training is one step of
expectation maximisation from equal probabilities: the expected number of uses
of each piece over all segmentations of the training words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import free_name, id_crc, ready

UNKNOWN = "und"
MAX_PIECE = 16  # characters of the longest piece of the default vocabulary; a Segmenter goes by its own pieces
SHORT = 24  # characters of a word, up to which words of one length are scored together
SMOOTH = 0.01  # uses of each piece that every language is given
LOST = 1e-9  # probability of a character that no piece covers
CACHE = 400_000  # words whose scores a worker remembers
BATCH = 20_000  # words that are scored at once
GROUP = 2_000_000  # characters of texts whose words are scored together
#: Letters with the marks that belong to them: words of many scripts and decomposed accents stay whole.
MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
LETTERS = re.compile(rf"[^\W\d_]+(?:(?=[\u0300-\U0010ffff])[{MARKS}]+[^\W\d_]*)*")  # no mark lies before U+0300
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no character is lost
MARK = "▁"  # begins each word in the vocabulary


@lru_cache(maxsize=1)
def vocabulary(path: str) -> dict[str, int]:
    """All pieces in lower case, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {p: i for i, p in enumerate(dict.fromkeys(pieces))}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: str) -> list[str]:
    """Runs of letters in lower case; all else says nothing about the language."""
    return LETTERS.findall(text.lower())


def _hash(piece: str) -> int:
    out = 1
    for c in piece:
        out = (out * int(FACTOR) + ord(c)) & (1 << 64) - 1
    return out


class Segmenter:
    """Sums over all segmentations; ``probs`` has a row per language and a last column for lost characters."""

    def __init__(self, pieces: dict[str, int], probs: np.ndarray) -> None:
        self.pieces, self.probs, self.none = pieces, probs, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        # Pieces are found by a 64-bit hash of their characters; the last key is greater than any.
        keys = np.array([*map(_hash, pieces), (1 << 64) - 1], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], np.array([*pieces.values(), self.none], np.int32)[order]
        self.joint = probs.copy()  # for arcs of several characters, which have to be pieces
        self.joint[:, -1] = 0

    def _arcs(self, marked: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of one length, each span and its piece in every word; spans that are a piece in none are left out."""
        none, n = self.none, len(marked[0])
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).T.astype(np.uint64)
        hashes: list[np.ndarray] = []  # of the spans that end here, by their beginning
        for j in range(1, n + 1):
            hashes = [h * FACTOR + codes[j - 1] for h in hashes[max(0, len(hashes) - self.longest + 1) :]] + [codes[j - 1] + FACTOR]
            for i, h in enumerate(hashes, j - len(hashes)):
                at = np.searchsorted(self.keys, h)
                ids = np.where(self.keys[at] == h, self.numbers[at], none)
                if j - i == 1 or (ids != none).any():
                    yield i, j, ids

    def _weights(self, i: int, j: int, ids: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
        """Probabilities by language and word; a lost character is an arc of one character."""
        return (self.probs if j - i == 1 else self.joint)[rows, ids]

    def score(self, batch: list[str]) -> np.ndarray:
        """log probability of each word (rows) in each language (columns)."""
        out = np.empty((len(batch), self.probs.shape[0]))
        by_length: dict[int, list[int]] = {}
        for at, w in enumerate(batch):
            by_length.setdefault(len(w) + 1, []).append(at)
        for n, at in by_length.items():
            if n > SHORT:
                for k in at:
                    out[k] = self._long(MARK + batch[k])
                continue
            alpha = [np.zeros((self.probs.shape[0], len(at))) for _ in range(n + 1)]
            alpha[0] += 1
            for i, j, ids in self._arcs([MARK + batch[k] for k in at]):
                alpha[j] += alpha[i] * self._weights(i, j, ids)
            out[at] = np.log(alpha[n]).T
        return out

    def _long(self, word: str) -> np.ndarray:
        """One word of any length, rescaled at each character."""
        recent, log = [np.ones(self.probs.shape[0])], np.zeros(self.probs.shape[0])
        for j in range(1, len(word) + 1):
            here = np.zeros_like(log)
            for back, before in enumerate(reversed(recent), 1):
                piece = self.pieces.get(word[j - back : j], self.none)
                if piece != self.none or back == 1:
                    here += before * self.probs[:, piece]
            recent = [a / here for a in [*recent, here]][-self.longest :]
            log += np.log(here)
        return log

    def expected(self, counts: dict[str, int]) -> np.ndarray:
        """Expected uses of each piece in words of one language, with the first row of ``probs``."""
        uses = np.zeros(self.none + 1)
        by_length: dict[int, list[str]] = {}
        for w in counts:
            by_length.setdefault(len(w) + 1, []).append(w)
        for n, group in by_length.items():
            for at in range(0, len(group), max(1, BATCH * 8 // n)):
                self._add(uses, group[at : at + max(1, BATCH * 8 // n)], counts, n)
        return uses

    def _add(self, uses: np.ndarray, group: list[str], counts: dict[str, int], n: int) -> None:
        if n > SHORT:
            for w in group:
                self._add_long(uses, MARK + w, counts[w])
            return
        arcs = [(i, j, ids, self._weights(i, j, ids, slice(0, 1))[0]) for i, j, ids in self._arcs([MARK + w for w in group])]
        alpha, beta = (np.zeros((n + 1, len(group))) for _ in range(2))
        alpha[0], beta[n] = 1, 1
        for i, j, _, p in arcs:
            alpha[j] += alpha[i] * p
        for i, j, _, p in reversed(arcs):
            beta[i] += p * beta[j]
        share = np.array([counts[w] for w in group]) / alpha[n]
        for i, j, ids, p in arcs:
            uses += np.bincount(ids, alpha[i] * p * beta[j] * share, len(uses))

    def _add_long(self, uses: np.ndarray, word: str, count: int) -> None:
        """One word of any length; both sums are rescaled at each character by the forward one."""
        n, probs = len(word), self.probs[0].tolist()
        alpha, scale, ending = [1.0], [1.0], []
        for j in range(1, n + 1):
            here, between, arcs = 0.0, 1.0, []
            for i in range(j - 1, max(-1, j - 1 - self.longest), -1):  # between: the scales of the characters inside the span
                piece = self.pieces.get(word[i:j], self.none)
                if piece != self.none or i == j - 1:
                    p = probs[piece] / between
                    here += alpha[i] * p
                    arcs.append((i, piece, p))
                between *= scale[i]
            alpha.append(1.0)
            scale.append(here)
            ending.append(arcs)
        beta = [0.0] * n + [1.0]
        for j in range(n, 0, -1):
            for i, piece, p in ending[j - 1]:
                share = p / scale[j] * beta[j]
                beta[i] += share
                uses[piece] += alpha[i] * share * count


def train(docs: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities by language; learned from all rows with text and language.

    Tasks turn their words into expected piece uses, and only sums of (language,
    piece) leave them. The driver gets vocabulary x languages numbers.
    """
    ready(docs.sparkSession)
    path = path or default_path()

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        even = np.full((1, len(pieces) + 1), 1 / len(pieces))
        even[0, -1] = LOST
        equal = Segmenter(pieces, even)
        found: dict[str, np.ndarray] = {}
        pending: dict[str, Counter] = {}

        def flush() -> None:
            for name, counts in pending.items():
                found[name] = found.get(name, 0) + equal.expected(counts)
            pending.clear()

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                counts = pending.setdefault(name.as_py(), Counter())
                counts.update(words(value.as_py()))
                if len(counts) > CACHE:
                    flush()
        flush()
        for name, sums in found.items():
            at = np.flatnonzero(sums[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], ["lang", "piece", "uses"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(uses, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    learned = sums.collect()  # at most vocabulary x languages rows
    names = sorted({r["lang"] for r in learned})
    probs = np.full((len(names), len(vocabulary(path)) + 1), SMOOTH)
    for r in learned:
        probs[names.index(r["lang"]), r["piece"]] += r["uses"]
    probs /= probs[:, :-1].sum(axis=1, keepdims=True)
    probs[:, -1] = LOST
    return names, probs


class Scorer:
    """Languages of texts; remembers the scores of words."""

    def __init__(self, names: list[str], segmenter: Segmenter) -> None:
        self.names, self.segmenter = names, segmenter
        self.places: dict[str, int] = {}
        self.table = np.empty((CACHE, max(1, len(names))))

    def _learn(self, texts: list[list[str]]) -> None:
        """Score the words that are new in these texts, all together."""
        different = dict.fromkeys(chain.from_iterable(texts))
        new = [w for w in different if w not in self.places]
        if len(self.places) + len(new) > len(self.table):
            self.places.clear()
            new = list(different)
            if len(new) > len(self.table):  # one text may have more words than are remembered
                self.table = np.empty((len(new), self.table.shape[1]))
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            first = len(self.places)
            self.table[first : first + len(part)] = self.segmenter.score(part)
            self.places.update(zip(part, range(first, first + len(part)), strict=True))

    def _judge(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        cut = [words(t) if t and self.names else [] for t in texts]
        self._learn(cut)
        for tokens in cut:
            if not any(map(str.isalpha, chain.from_iterable(tokens))):  # some numerals count as word characters
                yield UNKNOWN, 0.0
                continue
            total = self.table[np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))].sum(axis=0)
            best = int(total.argmax())
            yield self.names[best], float(1 / np.exp(total - total[best]).sum())

    def batch(self, column: pa.Array) -> Iterator[tuple[str, float]]:
        group, held = [], 0
        for x in column:
            group.append(text := x.as_py())
            held += len(text or "")
            if held > GROUP:
                yield from self._judge(group)
                group, held = [], 0
        yield from self._judge(group)


def predictor(names: list[str], probs: np.ndarray, path: str | None = None):
    """A column function: whole text to struct<lang_pred, score>; null or letterless texts are ``und`` with score 0.

    score is the posterior of the language under equal priors.
    """
    path = path or default_path()
    packed = np.asarray(probs)

    result = StructType.fromDDL("lang_pred string, score double")

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(names, Segmenter(vocabulary(path), packed))
        for batch in batches:
            found = list(scorer.batch(batch))
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 3 == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """``docs`` with a struct column of held_out, lang_pred and score; returns it under the name of its last column.

    Learns from rows that are not held out and have a language. With no such
    row every prediction is ``und``. Repeated rows are learned from and
    predicted each; an empty table gives no rows.
    """
    names, probs = train(docs.where(~held_out(doc_id)), text, lang, path)
    mark = free_name(docs, "language")
    found = predictor(names, probs, path)(F.col(text))
    return docs.select("*", F.struct(held_out(doc_id).alias("held_out"), found.alias("found")).alias(mark))


def keep_known(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` in which a language was found."""
    marked = identify(docs, **columns)
    mark = marked.columns[-1]
    return marked.where(F.col(mark)["found"]["lang_pred"] != UNKNOWN).select(*docs.columns)

