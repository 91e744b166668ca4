"""Lexical retrieval packing into sequences of at most ``LENGTH`` tokens.

Each task reads its documents into index shards of about ``SHARD_TOKENS`` tokens. A shard's inverted index holds BM25 weights; a seed
document asks it for its best unused neighbours, which fill the rest of the seed's window in order of score. The last one is cut where
the window ends and its rest seeds the next window, so windows are full. What a task has left at its end is cut into sequences of
powers of two, which need no padding. Nothing is shuffled and no task holds more than a shard.

Tokens: a word's ids depend on that word alone (the tokenizer splits at white space), so each task encodes a distinct word once.

Null or empty texts are the end id alone; repeated rows are packed like others; null doc_ids are kept; extra columns are ignored; an
empty table gives no rows. A document longer than a window fills windows of its own and its rest is a seed.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lintlake.llm.frames import give_back, tidy

LENGTH, SHARD_TOKENS, END_ID = 4096, 2_000_000, 2
TOKENIZER = "word_bpe_49k.json"
K1, B = 1.2, 0.75
#: Distinct words beyond which a worker's table is cut back before the next shard, and what is kept of it then and between tasks, when
#: the worker may serve other operators. The words met first are kept, mostly the frequent ones. Shards end by their own tokens only.
MAX_WORDS, KEPT_WORDS = 240_000, 80_000
_MARK, _START = "<|endoftext|>", "<|startoftext|>"
#: Latin text whose lower case and classes are the same everywhere, without white space and controls.
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Fixed value: the tokenizer's own pattern of pre-tokens.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: A worker's vocabulary by tokenizer file; only a cache of what the tokenizer gives.
_VOCABULARIES: dict[str, Vocabulary] = {}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Pieces(dict):
    """Packed ids of single pre-tokens of plain Latin text, straight from the BPE model."""

    def __init__(self, tokenizer: Tokenizer):
        self.model = tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE: these bytes are written as themselves
        other = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))
        self[piece] = ids = _packed([t.id for t in found])
        return ids


def _packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers: a tenth of a list's memory."""
    return array("I", ids).tobytes()


class Vocabulary(dict):
    """Words (bytes) to numbers; ``ids(numbers)`` gives their token ids. Number 0 is the end of a document."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)
        self.new: list[bytes] = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.flat[0] = END_ID
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.size[0] = 1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()  # exactly at \x20 and \x09-\x0D
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def _encoded(self) -> list[bytes]:
        """Token ids of the new words. Words of plain Latin letters, digits and marks go piece by piece, as the tokenizer would cut
        them (letters alone are one piece); all others go through the tokenizer as a whole."""
        out = []
        for raw in self.new:
            if raw.isalpha():  # of bytes: ASCII letters only
                out.append(self.pieces[raw.lower().decode()])
                continue
            word = raw.decode()
            if _PLAIN.fullmatch(word) and _MARK not in word and _START not in word:
                found = _PIECE.findall(word.lower())
                out.append(self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found)))
            else:
                out.append(_packed(self.tokenizer.encode(word, add_special_tokens=False).ids))
        return out

    def learn(self) -> None:
        parts, n = self._encoded(), len(self) + 1
        first, self.new = n - len(self.new), []
        if n > len(self.begin):
            self.begin, self.size = (np.concatenate((a, np.zeros(n, np.int64))) for a in (self.begin, self.size))
        sizes = np.array([len(p) for p in parts], np.int64) // 4
        self.size[first:n], self.begin[first:n] = sizes, self.used + np.cumsum(sizes) - sizes
        more = int(sizes.sum())
        if self.used + more > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(self.used + more, np.uint32)))
        if parts:
            self.flat[self.used : self.used + more] = np.frombuffer(b"".join(parts), np.uint32)
        self.used += more

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.begin[numbers], self.size[numbers])]

    def cut(self, most: int) -> None:
        """Forget all words and pieces but the first ``most``, whose numbers stay."""
        if len(self) > most:
            _keep_first(self, most)
            self.used = int(self.begin[most] + self.size[most])
            self.flat, self.begin, self.size = self.flat[: self.used].copy(), self.begin[: most + 1].copy(), self.size[: most + 1].copy()
        if len(self.pieces) > most:
            _keep_first(self.pieces, most)


def _keep_first(table: dict, most: int) -> None:
    first = list(islice(table.items(), most))
    table.clear()  # a table that only loses entries keeps its size
    table.update(first)


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary, cut back when it has grown too large. Ask only when no numbers of it are in use."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    if len(_VOCABULARIES[path]) > MAX_WORDS:
        _VOCABULARIES[path].cut(KEPT_WORDS)
    return _VOCABULARIES[path]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the ranges [begin, begin + size) in a row."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Shard:
    """A BM25 inverted index over the documents of a shard, given as arrays of term numbers."""

    def __init__(self, terms: list[np.ndarray]):
        n = len(terms)
        size = np.array([len(t) for t in terms], np.int64)
        flat = np.concatenate(terms) if n else np.zeros(0, np.int64)
        _, flat = np.unique(flat, return_inverse=True)
        doc = np.repeat(np.arange(n), size)
        key, tf = np.unique(flat.astype(np.int64) * max(n, 1) + doc, return_counts=True)
        term, doc = key // max(n, 1), key % max(n, 1)
        df = np.bincount(term)
        idf = np.log((n - df + 0.5) / (df + 0.5)).clip(0)  # a term in half of the documents tells nothing
        keep = (df[term] > 1) & (idf[term] > 0)
        term, self.doc, tf = term[keep], doc[keep], tf[keep]
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / max(size.mean(), 1) if n else 1))
        self.begin = np.searchsorted(term, np.arange(len(df) + 1))
        order = np.argsort(self.doc, kind="stable")
        self.own, self.first = term[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        self.unused = np.ones(n, bool)
        self.left, self.next = n, 0

    def take(self, doc: int) -> int:
        self.unused[doc] = False
        self.left -= 1
        return doc

    def seed(self) -> int:
        """The next unused document in the order of the input."""
        while not self.unused[self.next]:
            self.next += 1
        return self.take(self.next)

    def neighbours(self, doc: int):
        """Unused documents by falling BM25 score of ``doc``'s terms."""
        mine = self.own[self.first[doc] : self.first[doc + 1]]
        at = spans(self.begin[mine], self.begin[mine + 1] - self.begin[mine])
        score = np.bincount(self.doc[at], self.weight[at], minlength=len(self.unused))
        score[~self.unused] = 0
        tried = 16
        while True:
            best = np.argpartition(-score, min(tried, len(score) - 1))[:tried]
            best = best[np.lexsort((best, -score[best]))]
            for d in best[score[best] > 0].tolist():
                if self.unused[d]:
                    yield d
            if tried >= len(score) or not len(best) or score[best[-1]] <= 0:
                return
            tried *= 16


class Packer:
    """Windows of one task. ``window``: pieces (doc_id, ids, start, end, all ids) not yet given out."""

    def __init__(self, length: int, task: int):
        self.length, self.sequence, self.window, self.filled, self.out = length, task << 33, [], 0, []

    def add(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Put ids from ``start`` on into the window as far as they fit; gives where the rest begins."""
        end = min(len(ids), start + self.length - self.filled)
        self.window.append((doc_id, ids, start, end))
        self.filled += end - start
        if self.filled == self.length:
            self.give(self.window)
            self.window, self.filled = [], 0
        return end

    def give(self, pieces) -> None:
        offset = 0
        for doc_id, ids, start, end in pieces:
            crc = zlib.crc32(ids[start:end].astype("<u4").tobytes())
            self.out.append((doc_id, start, end - start, crc, len(ids), self.sequence, offset))
            offset += end - start
        self.sequence += 1

    def pack(self, docs: list[tuple], terms: list[np.ndarray]) -> None:
        shard = Shard(terms)
        while shard.left:
            queue = iter([shard.seed()])
            while (doc := next(queue, None)) is not None:
                if not self.window:
                    queue = shard.neighbours(doc)
                if shard.unused[doc]:
                    shard.take(doc)
                doc_id, ids = docs[doc]
                at = self.add(doc_id, ids, 0)
                while at < len(ids):  # the rest seeds the next window
                    queue = shard.neighbours(doc) if len(ids) - at < self.length else queue
                    at = self.add(doc_id, ids, at)
                if not self.window:
                    break

    def close(self) -> None:
        """Cut what is left into sequences of falling powers of two."""
        while self.filled:
            room, part = 1 << (self.filled.bit_length() - 1), []
            self.filled -= room
            while room:
                doc_id, ids, start, end = self.window.pop(0)
                cut = min(end, start + room)
                part.append((doc_id, ids, start, cut))
                room -= cut - start
                if cut < end:
                    self.window.insert(0, (doc_id, ids, cut, end))
            self.give(part)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset in it."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        words, packer = vocabulary(path), Packer(length, TaskContext.get().partitionId())
        docs, terms, total = [], [], 0
        for batch in batches:
            ids_of, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(texts), 256):
                numbers = [words.numbers((t or "").encode()) for t in texts.slice(lo, 256).to_pylist()]
                words.learn()
                for doc_id, own in zip(ids_of.slice(lo, 256).to_pylist(), numbers, strict=True):
                    ids = words.ids(np.append(own, 0))
                    docs.append((doc_id, ids))
                    terms.append(own)
                    total += len(ids)
                if total >= shard_tokens:
                    packer.pack(docs, terms)
                    docs, terms, total = [], [], 0
                    yield packer.batch()
                    words = vocabulary(path)
                    give_back()
        packer.pack(docs, terms)
        packer.close()
        yield packer.batch()
        docs, terms = [], []
        words.cut(KEPT_WORDS)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
