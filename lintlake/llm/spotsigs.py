"""SpotSigs fingerprints: chains of content words after common words.

An anchor is a common (stop) word; its signature hashes the anchor and the next ``CHAIN`` content words of the text. A text's
fingerprint is the sorted set of its 32-bit signatures (hexadecimal, eight digits each), so boilerplate without running text adds
little. Likeness is the Jaccard coefficient of two sets; a pair whose set sizes alone keep it under the asked level is not compared.

A text without any anchor followed by a content word is its own single signature (of all its words), so equal texts still match;
null and empty texts share the signature of no words. ``edited_and_next`` orders by doc_id downwards (ties by text, null ids last; the
first row follows the last). Repeated rows give equal fingerprints; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm import text as T

CHAIN, BUCKET_ROWS, MAX_BUCKETS = 3, 500, 4096
#: The anchors, common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with what "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au aux avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al con de del el en es esta la las los no para por que se su un una y"
).split()
#: Words are runs of letters, digits and bytes beyond ASCII; A-Z count as a-z.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _anchor_hashes() -> np.ndarray:
    data, off = T.flat(pa.array(sorted(set(ANCHORS))))
    return np.sort(T.span_hashes(data, off[:-1], off[1:]))


def signatures(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    anchors, out = _anchor_hashes(), []
    data, off = T.flat(column)
    for lo, hi in T.slices(off):
        words = T.Words(_LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], _SEPARATOR)
        hashes, n = words.hashes(), hi - lo
        common = anchors[np.minimum(np.searchsorted(anchors, hashes), len(anchors) - 1)] == hashes
        spots, content = np.flatnonzero(common), np.flatnonzero(~common)
        following, value, alive = np.searchsorted(content, spots), hashes[spots], np.zeros(len(spots), np.int64)
        for k in range(CHAIN):  # a chain at the end of a text may be shorter
            at = np.minimum(following + k, max(len(content) - 1, 0))
            there = (following + k < len(content)) & (words.doc[content[at]] == words.doc[spots]) if len(content) else alive > 0
            value = np.where(there, T.mix(value * np.uint64(3) + hashes[content[at]]) if len(content) else value, value)
            alive += there
        doc, value = words.doc[spots][alive > 0], value[alive > 0] >> np.uint64(32)
        key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | value)
        cut = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        weight = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(hashes + words.place().astype(np.uint64)), dtype=np.uint64)))
        whole = (T.mix(weight[words.first[1:]] - weight[words.first[:-1]]) >> np.uint64(32)).astype(np.uint32)
        out += [low[a:b] if b > a else whole[d : d + 1] for d, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    return out


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without comparing where the sizes alone keep it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_signatures per row of ``docs``."""

    def run(batches):
        for batch in batches:
            sets = signatures(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([to_text(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64())],
                ["doc_id", "fingerprint", "n_signatures"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


def length_bucket(n: Column, least: float) -> Column:
    """Partition of set lengths: two sets at least ``least`` alike lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / float(-np.log(least)) + 1e-9).cast("int")


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints at least ``least`` alike. ``prints``: fingerprint, n_signatures. Each set is
    indexed under the rarest signatures that any partner must share (its prefix by rising corpus count), within its length partition."""
    classes = prints.select("fingerprint", "n_signatures").distinct().withColumn("bucket", length_bucket(F.col("n_signatures"), least))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_signatures").cast("int") - 1), lambda i: F.substring("fingerprint", i * 8 + 1, F.lit(8)))
    each = classes.select("fingerprint", "n_signatures", "bucket", F.explode(parts).alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = each.join(counts.filter("n > 1"), "sig").groupBy("fingerprint", "n_signatures", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("rare"), F.count("*").alias("shared")
    )
    prefix = F.col("n_signatures") - F.ceil(F.col("n_signatures") * least) + 1 - (F.col("n_signatures") - F.col("shared"))
    index = ranked.filter(prefix >= 1).select(
        "fingerprint", "n_signatures", "bucket", F.explode(F.slice("rare", F.lit(1), prefix.cast("int"))["sig"]).alias("sig")
    )
    a = index.select(F.col("fingerprint").alias("a"), F.col("n_signatures").alias("na"), F.col("bucket").alias("ba"), "sig")
    b = index.select(
        F.col("fingerprint").alias("b"), F.col("n_signatures").alias("nb"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("ba"), "sig"
    )
    fits = (F.col("a") != F.col("b")) & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["ba", "sig"]).filter(fits & (F.col("na") >= F.lit(least) * F.col("nb"))).select("a", "b").distinct()

    def verify(batches):
        for batch in batches:
            sets = [[np.frombuffer(bytes.fromhex(x), ">u4") for x in batch.column(c).to_pylist()] for c in ("a", "b")]
            value = np.array([likeness(x, y, least) for x, y in zip(*sets, strict=True)], float)
            keep = pa.array(value >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value)], ["a", "b", "likeness"]).filter(keep)

    return pairs.mapInArrow(verify, "a string, b string, likeness double")


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id, sorted downwards, each range followed by a copy of the next range's first row."""
    n = docs.count()
    most = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    splits = docs.agg(F.percentile_approx("doc_id", [k / most for k in range(1, most)] or [1.0], 100_000)).first()[0] or []
    splits = sorted(set(splits), reverse=True)
    # range k holds the ids from splits[k] up to under splits[k - 1]; the last one the rest and null ids
    cuts = F.array(*[F.lit(-s).cast("long") for s in splits])
    last = F.lit(len(splits))
    bucket = F.when(F.col("doc_id").isNull(), last).otherwise(F.size(F.filter(cuts, lambda c: c < -F.col("doc_id"))) if splits else last)
    dealt = docs.select(bucket.cast("int").alias("bucket"), "doc_id", "text")
    heads = docs.select(bucket.cast("int").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return dealt.withColumn("halo", F.lit(0))
    before = {h["bucket"]: heads[k - 1]["bucket"] for k, h in enumerate(heads)}
    after = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ids = [h["head"] for h in heads if h["head"] is not None]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(h["head"] is None for h in heads):
        first = first | F.col("doc_id").isNull()
    halo = dealt.filter(first).withColumn("bucket", after[F.col("bucket")])
    both = dealt.withColumn("halo", F.lit(0)).unionByName(halo.withColumn("halo", F.lit(1)))
    return both.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def _edit_rows(batches):
    """Fingerprints of each text, of its edited text and their likeness, over rows in order."""
    held = None

    def pairs(rows):
        """(row, next row) of neighbours in one range; copies of a next range's first rows only follow."""
        nonlocal held
        for row in rows:
            if held is not None and held[0] == row[0] and not held[1]:
                yield held, row
            held = row

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        sets = signatures(pa.array(texts, pa.large_string()))
        rows = list(zip(batch.column("bucket").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), texts, sets, strict=True))
        found = list(pairs(rows))
        for lo in range(0, len(found), 512):
            part = found[lo : lo + 512]
            edited = []
            for (_, _, _, text, _), (_, _, _, following, _) in part:
                k = len(text) // 2
                edited.append(text[: len(text) - k] + following[:k])
            changed = signatures(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in part], pa.int64()),
                    pa.array([len(a[3]) for a, _ in part], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([to_text(a[4]) for a, _ in part]),
                    pa.array([to_text(c) for c in changed]),
                    pa.array([likeness(a[4], c) for (a, _), c in zip(part, changed, strict=True)]),
                    pa.array([likeness(a[4], b[4]) for a, b in part]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's."""
    return _ordered(docs.select("doc_id", "text")).mapInArrow(
        _edit_rows,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
