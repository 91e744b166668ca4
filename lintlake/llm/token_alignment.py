"""Alignment of two tokenizers' tokens of the same bytes, and how many documents link each pair of ids.

Both token sequences cut the bytes of a text; a token's end is a byte offset. Of the two end lists the shorter one drives a galloping
search (steps of doubling length, then a binary search) into the longer one: common ends slice both sequences into groups, and the ranks
of neighbouring ends differ by the range of tokens that a token overlaps. All ends of a slice of texts are searched at once with numpy.

Tokens: white space before a word always begins new tokens in both vocabularies (checked on the files given), so a worker encodes a
distinct unit, blanks and a word, once. Texts with other kinds of white space, and vocabularies without that property, are encoded whole.

Counts: ``CHUNK_BYTES`` of texts share one list of distinct linked pairs, so a frequent pair is one row a chunk and not one a document;
the corpus-wide counts come back to the chunks by two equi-joins. A chunk is never more than that many bytes, or one longer text.

Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens and zeros. Null doc_ids and repeated rows are
documents like others; ties for the highest count are all best; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from lintlake.llm.frames import stash
from lintlake.llm.text import flat, slices

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 24 << 20
#: Distinct units and ids that a worker keeps, then it starts anew; only a cache of what the tokenizers give.
MAX_UNITS, MAX_IDS = 600_000, 6_000_000
_UNIT = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space and marks that a pattern of pre-tokens may cut at, besides the three of a unit.
_ODD = re.compile("[\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]")
_MODELS: dict[tuple[str, str], Tokens] = {}

DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: plain ones stand for themselves, others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Tokens(dict):
    """Numbers of units; the arrays hold each unit's ids under both vocabularies and whether both give its bytes back."""

    def __init__(self, byte_model: str, piece_model: str):
        self.a = Tokenizer.from_file(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        letters = _byte_letters()
        words = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda kv: kv[1])
        self.a_bytes = [b""] * (words[-1][1] + 1)
        for word, i in words:
            self.a_bytes[i] = bytes(letters.get(c, 63) for c in word)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(p) for p in pieces]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        cut = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        self.by_unit = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and not any(re.search("[^▁\t\n][▁\t\n]", p) for p in pieces)
            and [pieces[i] for i in self.b.encode("\n")] == ["▁", "<0x0A>"]
        )
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.begin, self.size = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.exact, self.ids = np.zeros(0, bool), [np.zeros(0, np.int32)] * 2

    def add(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> int:
        """Append units with their ids; the first one's number."""
        first, exact = len(self.exact), np.ones(len(units), bool)
        for side, (of, ids) in enumerate(((self.a_bytes, a), (self.b_bytes, b))):
            size = np.array([len(x) for x in ids], np.int64)
            self.begin[side] = np.concatenate([self.begin[side], len(self.ids[side]) + np.cumsum(size) - size])
            self.size[side] = np.concatenate([self.size[side], size])
            self.ids[side] = np.concatenate([self.ids[side], np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
            exact &= [b"".join([of[i] for i in x]) == unit.encode() for unit, x in zip(units, ids, strict=True)]
        self.exact = np.concatenate([self.exact, exact])
        return first

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's units."""
        whole = [k for k, t in enumerate(texts) if t and (not self.by_unit or _ODD.search(t))]
        skip = set(whole)
        units = [[] if not t or k in skip else _UNIT.findall(" " + t) for k, t in enumerate(texts)]
        new = [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self]
        if new:
            # behind a line break the second vocabulary adds no space of its own
            first = self.add(new, self.encoded(new), [x[2:] for x in self.b.encode(["\n" + u for u in new], num_threads=1)])
            self.update(zip(new, range(first, first + len(new)), strict=True))
        found = [np.fromiter(map(self.__getitem__, u), np.int64, len(u)) for u in units]
        if whole:
            odd = [texts[k] for k in whole]
            first = self.add([" " + t for t in odd], self.encoded([" " + t for t in odd]), self.b.encode(odd, num_threads=1))
            for n, k in enumerate(whole, first):
                found[k] = np.array([n])
        return found

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of both sides of all texts in a row, and per side and text their number; a text that is not exact has none."""
        if len(self) > MAX_UNITS or len(self.ids[0]) > MAX_IDS:
            self.reset()
        found = self.numbers(texts)
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        unit = np.concatenate([*found, np.zeros(0, np.int64)])
        wrong = np.zeros(len(texts), bool)
        wrong[doc[~self.exact[unit]]] = True
        unit, doc = unit[~wrong[doc]], doc[~wrong[doc]]
        ids, counts = [], np.zeros((2, len(texts)), np.int64)
        for side in (0, 1):
            size = self.size[side][unit]
            ids.append(self.ids[side][_ranges(self.begin[side][unit], size)].astype(np.int64))
            np.add.at(counts[side], doc, size)
        return ids, counts


def tokens(byte_model: str, piece_model: str) -> Tokens:
    """The worker's own tokenizers of two files."""
    if (byte_model, piece_model) not in _MODELS:
        _MODELS[byte_model, piece_model] = Tokens(byte_model, piece_model)
    return _MODELS[byte_model, piece_model]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin+1, ... of each range in a row."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def gallop(values: np.ndarray, longer: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """How many of the sorted ``longer`` are below each value: from its ``guess`` steps of doubling length, either way, until they pass
    the value, then a binary search between the last two."""
    low, high = np.zeros(len(values), np.int64), np.full(len(values), len(longer), np.int64)
    at = np.clip(guess, 0, max(0, len(longer) - 1))
    open_, step = np.flatnonzero(high > 0), 1
    up = longer[at] < values if len(longer) else np.zeros(len(values), bool)
    low[up], high[~up] = at[up] + 1, at[~up]
    while len(open_):
        rising = up[open_]
        probe = np.where(rising, at[open_] + step, at[open_] - step)
        inside = (probe >= 0) & (probe < len(longer))
        open_, probe, rising = open_[inside], probe[inside], rising[inside]
        below = longer[probe] < values[open_]
        low[open_[below]] = probe[below] + 1
        high[open_[~below]] = probe[~below]
        open_, step = open_[below == rising], step * 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = longer[middle] < values[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


class Alignment:
    """Groups and links of the tokens of some texts.

    ``ids``/``counts``: as from ``Tokens.encode``; ``ends``: byte offsets over all texts in a row. ``cuts``: per side the indices of the
    tokens that end a group. ``link_a``/``link_b``/``link_doc``: every overlapping pair of tokens by index, and its text.
    """

    def __init__(self, ids: list[np.ndarray], counts: np.ndarray, lengths: list[np.ndarray]):
        self.ids, self.counts = ids, counts
        self.ends = [np.cumsum(lengths[s][ids[s]]) for s in (0, 1)]
        self.first = [np.concatenate(([0], np.cumsum(counts[s]))) for s in (0, 1)]
        drives_a = counts[0] <= counts[1]
        sides = [self._driven(0, 1, np.flatnonzero(drives_a)), self._driven(1, 0, np.flatnonzero(~drives_a))]
        self.cuts = [np.sort(np.concatenate([side["cuts"][s] for side in sides])) for s in (0, 1)]
        self.link_a, self.link_b, self.link_doc = (np.concatenate([side[k] for side in sides]) for k in (0, 1, "doc"))

    def _driven(self, short: int, long: int, docs: np.ndarray) -> dict:
        """Ranks of the shorter lists' ends in the longer ones; common ends and overlap ranges follow from them."""
        n = self.counts[short][docs]
        mine, doc = _ranges(self.first[short][docs], n), np.repeat(docs, n)
        ends, other = self.ends[short][mine], self.first[long][doc]
        share = self.counts[long][doc] / np.maximum(1, self.counts[short][doc])
        rank = gallop(ends, self.ends[long], other + ((mine - self.first[short][doc]) * share).astype(np.int64))
        equal = self.ends[long][rank] == ends  # the last end of a text is always common, so no rank is behind the list
        low = np.concatenate((other[:1], rank[:-1] + equal[:-1]))  # the first one that ends behind the token before
        low = np.where(mine == self.first[short][doc], other, low)
        links = rank - low + 1
        pair = {short: np.repeat(mine, links), long: _ranges(low, links), "doc": np.repeat(doc, links)}
        return {**pair, "cuts": {short: mine[equal], long: rank[equal]}}

    def groups(self) -> np.ndarray:
        """The number of groups of each text."""
        return np.diff(np.searchsorted(self.cuts[0], self.first[0]))

    def bounds(self, side: int) -> np.ndarray:
        """Index of each group's first token on a side, and the number of tokens at the end."""
        return np.concatenate(([0], self.cuts[side] + 1))

    def texts(self) -> list[bytes]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        bounds = [self.bounds(s) for s in (0, 1)]
        group = [np.repeat(np.arange(len(b) - 1), np.diff(b)) for b in bounds]
        at = [np.arange(len(group[0])) + bounds[1][:-1][group[0]], np.arange(len(group[1])) + bounds[0][1:][group[1]]]
        ids, marks = np.zeros(sum(map(len, group)), np.int64), np.full(sum(map(len, group)), ord(","), np.uint8)
        for s, mark in ((0, "|"), (1, ";")):
            ids[at[s]] = self.ids[s]
            marks[at[s][self.cuts[s]]] = ord(mark)
        digits = np.maximum(1, np.ceil(np.log10(ids + 1)).astype(np.int64))
        begin = np.cumsum(digits + 1) - digits - 1
        out, rest = np.zeros(int((digits + 1).sum()), np.uint8), ids.copy()
        out[begin + digits] = marks
        for place in range(int(digits.max(initial=0))):
            here = digits > place
            out[(begin + digits - 1 - place)[here]] = (rest[here] % 10 + ord("0")).astype(np.uint8)
            rest //= 10
        edges = np.concatenate((begin, [len(out)]))[self.first[0] + self.first[1]]
        whole = out.tobytes()
        return [whole[lo : max(lo, hi - 1)] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _aligned(texts: pa.Array, models: Tokens) -> Iterator[tuple[int, int, Alignment]]:
    _, offsets = flat(texts)
    for lo, hi in slices(offsets):
        yield lo, hi, Alignment(*models.encode(texts.slice(lo, hi - lo).to_pylist()), models.lengths)


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.astype(np.uint32).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint32).astype(np.int64).reshape(n, -1)


class _Chunk:
    """Digests of texts and, per text, its distinct links as places in the chunk's sorted list of pairs."""

    def __init__(self, number: int, width: int):
        self.number, self.width, self.rows, self.docs, self.keys, self.times, self.bytes = number, width, [], [], [], [], 0

    def add(self, doc_ids: list, found: Alignment, size: int) -> None:
        key = found.ids[0][found.link_a] * self.width + found.ids[1][found.link_b]
        order = np.lexsort((key, found.link_doc))
        doc, key = found.link_doc[order], key[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))[: len(key)])
        self.docs.append(doc[new] + len(self.rows))
        self.keys.append(key[new])
        self.times.append(np.diff(np.concatenate((new, [len(key)]))))
        links, groups = np.bincount(found.link_doc, minlength=len(doc_ids)), found.groups()
        for k, (i, text) in enumerate(zip(doc_ids, found.texts(), strict=True)):
            sha = hashlib.sha256(text).hexdigest() if text else ""
            self.rows.append((i, int(found.counts[0][k]), int(found.counts[1][k]), int(groups[k]), int(links[k]), sha))
        self.bytes += size

    def batch(self) -> pa.RecordBatch:
        doc, key, times = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (self.docs, self.keys, self.times))
        pairs, place, docs = np.unique(key, return_inverse=True, return_counts=True)
        edges = np.searchsorted(doc, np.arange(len(self.rows) + 1))
        packed = [_packed(np.diff(place[lo:hi], prepend=0), times[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        n = len(self.rows)
        columns = [*zip(*self.rows, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number] * (n + 1), pa.int64()), *(pa.array([*c, None], pa.string() if k == 5 else pa.int64()) for k, c in enumerate(columns)),
             pa.array([*packed, None], pa.binary()), pa.array([None] * n + [pairs], pa.list_(pa.int64())), pa.array([None] * n + [docs], pa.list_(pa.int64()))],
            ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "docs"],
        )


def _chunks(docs: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Rows of texts (``links`` set) and one row a chunk (``pairs``, and ``docs``: how many of its texts hold each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, number = tokens(byte_model, piece_model), TaskContext.get().partitionId() << 32
        width, chunk = len(models.b_bytes), None
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            sizes = np.diff(flat(texts)[1])
            for lo, hi, found in _aligned(texts, models):
                size = int(sizes[lo:hi].sum())
                if chunk is None or chunk.bytes + size > CHUNK_BYTES:
                    if chunk is not None:
                        yield chunk.batch()
                    number, chunk = number + 1, _Chunk(number, width)
                chunk.add(doc_ids[lo:hi], found, size)
        if chunk is not None:
            yield chunk.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"chunk long, {DIGEST}, links binary, pairs array<long>, docs array<long>")


def _pair_rows(chunks: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("pairs", "docs")
    return chunks.filter("pairs is not null").select("chunk", F.posexplode(zipped).alias("place", "z")).select("chunk", "place", "z.pairs", "z.docs")


def _counted(pairs: DataFrame, width: int) -> DataFrame:
    """(pairs, n_docs, best): documents that hold a pair, and whether no pair of its A id has more."""
    counts = pairs.groupBy("pairs").agg(F.sum("docs").alias("n_docs")).withColumn("a", F.expr(f"pairs div {width}"))
    tops = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counts.join(tops, "a").select("pairs", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def _models(byte_model: str | None, piece_model: str | None) -> tuple[str, str]:
    return byte_model or public_tokenizers.path(BYTE_MODEL), piece_model or public_tokenizers.path(PIECE_MODEL)


def _width(piece_model: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()


def align(docs: DataFrame, byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """Per document the numbers of tokens, groups and links, ``n_best``, ``count_sum`` and the hash of its groups."""
    byte_model, piece_model = _models(byte_model, piece_model)
    chunks = stash(_chunks(docs, byte_model, piece_model), "alignment")
    pairs = _pair_rows(chunks)
    known = pairs.join(_counted(pairs, _width(piece_model)), "pairs").select(F.col("chunk").alias("of_chunk"), "place", "n_docs", "best")
    texts = chunks.filter("links is not null").drop("pairs", "docs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        counts, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        counts[place], best[place] = right.column("n_docs").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for data in left.column("links").to_pylist():
            steps, times = _unpacked(data, 2)
            at = np.cumsum(steps)
            sums.append((int((best[at] * times).sum()), int((counts[at] * times).sum())))
        digest = left.drop_columns(["chunk", "links"])
        for k, name in enumerate(("n_best", "count_sum")):
            digest = digest.append_column(name, pa.array([x[k] for x in sums], pa.int64()))
        return digest

    return texts.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(run, f"{DIGEST}, n_best long, count_sum long")


def linked_ids(docs: DataFrame, byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """(a_id, b_id, n_docs, best): the pairs of ids that overlap somewhere, by the number of documents that hold them linked."""
    byte_model, piece_model = _models(byte_model, piece_model)
    width = _width(piece_model)
    counted = _counted(_pair_rows(stash(_chunks(docs, byte_model, piece_model), "alignment")), width)
    return counted.select(F.expr(f"pairs div {width}").alias("a_id"), (F.col("pairs") % width).alias("b_id"), "n_docs", "best")


def token_groups(docs: DataFrame, byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """One row a group: (doc_id, place, start, end, a_ids, b_ids); start and end are byte offsets in the space and the text."""
    byte_model, piece_model = _models(byte_model, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tokens(byte_model, piece_model)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, found in _aligned(batch.column("text"), models):
                groups = found.groups()
                doc, ends = np.repeat(np.arange(hi - lo), groups), found.ends[0][found.cuts[0]]
                base = np.concatenate(([0], found.ends[0]))[found.first[0][:-1]][doc]
                begin = np.concatenate(([0], ends))[:-1]
                lists = [pa.ListArray.from_arrays(pa.array(found.bounds(s), pa.int32()), pa.array(found.ids[s], pa.int64())) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[lo + k] for k in doc.tolist()], pa.int64()), pa.array(_ranges(np.zeros(hi - lo, np.int64), groups)),
                     pa.array(begin - base), pa.array(ends - base), *lists],
                    ["doc_id", "place", "start", "end", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, place long, start long, `end` long, a_ids array<long>, b_ids array<long>")
