"""Repeated passages by difference-cover anchors.

Short word windows are hashed only where the word's index modulo ``PERIOD`` lies in ``COVER``. Differences of the cover's members
give every residue, so two equal passages of ``WINDOW`` words always hold an equal short window at such a place of both, wherever
they begin. Anchors found in two documents are extended: every full window around them is hashed (95 bits) and compared exactly.
No pairs are made: an anchor or window keeps only the smallest and largest document it occurs in.

Null or wordless texts keep nothing and lose nothing; a null doc_id counts as larger than every id and is no smaller than another
null; repeated rows (one doc_id twice) are not copies of each other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import NO_ID, release, row_key, stash

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of the fixed-size filter that spares most unshared anchors the second shuffle; a full filter only spares less.
FILTER_BITS = 1 << 26
_OTHER = 0xA0761D6478BD642F


def _anchors(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the windows at cover places."""
    at = T.inside_text(words, ANCHOR)
    at = at[np.isin(words.place()[at] % PERIOD, COVER)]
    return at, T.window_hashes(words.hashes(), ANCHOR)[at]


def _extremes(doc: np.ndarray, *keys: np.ndarray):
    """A place, the smallest and the largest document of each distinct key, in the order of the places: rows of one document stay
    together, which compresses well."""
    order = np.lexsort((doc, *keys))
    change = np.zeros(max(0, len(order) - 1), bool)
    for key in keys:
        change |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(np.append(True, change)) if len(order) else order
    last = np.append(first[1:], len(order)) - 1 if len(order) else order
    at, low, high = order[first], doc[order[first]], doc[order[last]]
    back = np.argsort(at)
    return at[back], low[back], high[back]


def _anchor_rows(batches):
    """Each anchor once per batch, with the smallest and largest document (null: the same one)."""
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in T.slices(off):
            words = T.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            at, key = _anchors(words)
            keys.append(key)
            docs.append(ids[lo:hi][words.doc[at]])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        if not len(key):
            continue
        at, low, high = _extremes(doc, key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[at].view(np.int64)), pa.array(low), pa.array(high, mask=high == low)], ["anchor", "low", "high"]
        )


def _shared_rows(bits: np.ndarray):
    """(anchor, row, document, place) of the anchors that the filter lets through."""

    def run(batches):
        for batch in batches:
            data, off = T.flat(batch.column("text"))
            rows = batch.column("_row").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi in T.slices(off):
                words = T.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at, key = _anchors(words)
                slot = key % np.uint64(FILTER_BITS)
                hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                at, key = at[hit], key[hit]
                if len(at):
                    doc = words.doc[at]
                    columns = [key.view(np.int64), rows[lo:hi][doc], ids[lo:hi][doc], words.place()[at].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "_row", "doc", "place"])

    return run


def _marks(lists: pa.Array, n: int, first: np.ndarray) -> np.ndarray:
    """Word indices (over all texts of a slice) of lists of places per text."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return first[owner] + flat


def _windows(batch, places: str):
    """Full windows around the anchors at ``places`` of each slice: two hashes, the text's index in the batch and the place in it."""
    data, off = T.flat(batch.column("text"))
    for lo, hi in T.slices(off):
        words = T.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        marks = _marks(batch.column(places).slice(lo, hi - lo), hi - lo, words.first)
        near = T.covered(len(words) + PERIOD, marks, PERIOD)  # a window begins at most PERIOD - 1 words before its anchor
        at = T.inside_text(words, WINDOW)
        at = at[near[at + PERIOD - 1]]
        hashes = words.hashes()
        other = (T.window_hashes(hashes, WINDOW, _OTHER)[at] >> np.uint64(33)).astype(np.int32)
        yield T.window_hashes(hashes, WINDOW)[at].view(np.int64), other, lo + words.doc[at], words.place()[at].astype(np.int32)


def _window_extremes(batches):
    """Each window once per batch, with the smallest and largest document (null: the same one)."""
    for batch in batches:
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        parts = list(_windows(batch, "places"))
        if not parts:
            continue
        h1, h2, doc, _ = (np.concatenate(p) for p in zip(*parts, strict=True))
        at, low, high = _extremes(ids[doc], h1, h2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1[at]), pa.array(h2[at]), pa.array(low), pa.array(high, mask=high == low)], ["h1", "h2", "low", "high"]
        )


def _window_rows(batches):
    """Every window around an anchor that a smaller document has too, with its row, document and place."""
    for batch in batches:
        rows = batch.column("_row").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for h1, h2, doc, place in _windows(batch, "behind"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(rows[doc]), pa.array(ids[doc]), pa.array(place)], ["h1", "h2", "_row", "doc", "place"]
            )


def _cut_rows(batches):
    """Texts without the words of their copied windows."""
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        for lo, hi in T.slices(off):
            words = T.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            gone = T.covered(len(words), _marks(batch.column("copied").slice(lo, hi - lo), hi - lo, words.first), WINDOW)
            raw, kept = words.data.tobytes(), []
            for d in range(hi - lo):
                a, b = words.first[d], words.first[d + 1]
                keep = a + np.flatnonzero(~gone[a:b])
                kept.append(b" ".join(raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)))
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if hi > lo else np.zeros(0, np.int64)
            removed[words.counts() == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(words.counts().astype(np.int64)),
                    pa.array(removed),
                    pa.array([k.decode() for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def _filter_bits(shared: DataFrame) -> np.ndarray:
    """The fixed-size filter of shared anchors (8 MB whatever the input)."""
    slot = F.expr(f"anchor & {FILTER_BITS - 1}")
    words = shared.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(anchor & 63 as int))").alias("bit"))
    table = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bits


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 per row of ``docs`` (doc_id, text): every word covered by a window of
    ``WINDOW`` words that also begins in a document with a smaller doc_id is removed; windows are judged on the input."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    # the rows of a batch are already combined; repartitioning first keeps them in order and spares a second, fruitless combining
    anchors = docs.mapInArrow(_anchor_rows, "anchor long, low long, high long").repartition("anchor")
    sums = anchors.groupBy("anchor").agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"))
    shared = stash(sums.filter("low < high").select("anchor", "low"), "anchors")
    del anchors, sums
    release(spark)
    bits = spark.sparkContext.broadcast(_filter_bits(shared))
    keyed = docs.select("doc_id", "text", row_key().alias("_row"))

    def shared_rows(batches):
        return _shared_rows(bits.value)(batches)

    places = stash(
        keyed.mapInArrow(shared_rows, "anchor long, _row long, doc long, place int")
        .join(shared, "anchor").groupBy("_row")
        .agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("low") < F.col("doc"), F.col("place"))).alias("behind")), "places",
    )
    release(spark)
    near = keyed.join(places, "_row")
    first = (
        near.mapInArrow(_window_extremes, "h1 long, h2 int, low long, high long").repartition("h1", "h2")
        .groupBy("h1", "h2").agg(F.min("low").alias("first"), F.max(F.coalesce("high", "low")).alias("last")).filter("first < last")
    )
    copied = (
        near.filter(F.size("behind") > 0).mapInArrow(_window_rows, "h1 long, h2 int, _row long, doc long, place int")
        .join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter("first < doc")
        .groupBy("_row").agg(F.collect_set("place").alias("copied"))
    )
    return keyed.join(copied, "_row", "left").mapInArrow(
        _cut_rows, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )
