"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least ``SIMILAR``, found by SimHash and MinHash.

Texts with the same set are one entry. Each has a SimHash fingerprint of its shingles; fingerprints at most three bits apart meet
through their deletion variants (``simhash.near_edges``) and make candidates. Similar texts may lie further apart in bits, so ``BANDS``
keys of ``ROWS`` minima each make candidates too (a pair at 0.8 shares a key with probability 0.9998), and the exact Jaccard similarity
of the shingle sets decides over all. All pairs of a bucket of at most ``ALL_PAIRS``
entries are candidates. In a larger one each entry first meets ``HEADS`` entries of the bucket, which joins large groups of copies in
linear work. What entries of large buckets are still apart then is compared exactly, by prefixes: with the shingles of a set in a common
order, rarest first (by counts in ``SLOTS`` slots of hashes; any common order is exact), two sets of the similarity share one among the first few of both, at places that leave room for the rest. No link
between different components is lost to the size of a bucket. Components are those of the links.

Words are runs between blanks, A-Z in lower case; a text of fewer words is one shingle; null and wordless texts have the same empty
set; null doc_ids count as larger than every id; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import NO_ID, fresh, row_key, stash, tidy
from lintlake.llm.simhash import _LOWER, connected, near_edges

SHINGLE, SIMILAR, BANDS, ROWS, ALL_PAIRS, HEADS, SLOTS = 5, 0.8, 16, 4, 32, 4, 1 << 16
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of each text of a slice, sorted."""
    words = T.Words(_LOWER[data], off)
    at = T.inside_text(words, SHINGLE)
    doc, value = words.doc[at], T.window_hashes(words.hashes(), SHINGLE)[at]
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < SHINGLE))
    if len(short):
        raw, own = words.data.tobytes(), []
        for d in short.tolist():
            a, b = words.first[d], words.first[d + 1]
            own.append(xxhash.xxh64_intdigest(b" ".join(raw[s:e] for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True))))
        doc, value = np.append(doc, short), np.append(value, np.array(own, np.uint64))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _parts(batch):
    """Per slice of texts: (lo, hi, shingle values, each text's first shingle (one more than texts), hash of each text's set)."""
    data, off = T.flat(batch.column("text"))
    for lo, hi in T.slices(off):
        doc, value = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(value), dtype=np.uint64)))
        yield lo, hi, value, cut, total[cut[1:]] - total[cut[:-1]]


def _fingerprints(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each set of shingles: a bit is 1 if set in over half of them. ``first``: where each set begins; none is empty."""
    mixed, out = T.mix(value), np.zeros(len(first), np.uint64)
    n = np.diff(np.append(first, len(value)))
    for bit in range(64 if len(first) else 0):
        ones = np.add.reduceat((mixed >> np.uint64(bit)) & np.uint64(1), first).astype(np.int64)
        out |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out


@tidy
def _band_rows(batches):
    """The size of each text's set and its keys: ``BANDS`` of minima, then the fingerprint (none of an empty set)."""
    for batch in batches:
        for lo, hi, value, cut, sign in _parts(batch):
            some = np.flatnonzero(np.diff(cut))
            keys = np.zeros((len(some), BANDS + 1), np.uint64)
            for k in range(BANDS * ROWS if len(some) else 0):
                low = np.minimum.reduceat(value * _FACTORS[k], cut[some])
                keys[:, k // ROWS] = T.mix(keys[:, k // ROWS] + low + np.uint64(k + 1))
            keys[:, BANDS] = _fingerprints(value, cut[some])
            at = np.append(0, np.cumsum(np.where(np.diff(cut) > 0, BANDS + 1, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row_key")]
                + [pa.array(sign.view(np.int64)), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "row_key", "sign", "n", "bands"],
            )


@tidy
def _set_rows(batches):
    for batch in batches:
        for _, _, value, cut, sign in _parts(batch):
            sets = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), sets], ["sign", "shingles"])


def print_pairs(one: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of entries by their fingerprints: the same one (each with the smallest sign of it), or links of a forest
    that joins all fingerprints up to three bits apart. ``one``: sign, n, bands (distinct)."""
    some = one.filter("n > 0").select("sign", F.element_at("bands", BANDS + 1).alias("fp"))
    prints = stash(some.groupBy("fp").agg(F.min("sign").alias("node")), "prints")
    same = some.join(prints, "fp").filter("sign > node").select(F.col("node").alias("a"), F.col("sign").alias("b"))
    close = near_edges(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.union(close).distinct()


def candidates(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of entries that share a band and whose sizes allow the similarity, and the signs of the entries whose
    pairs were not all taken. ``one``: sign, n, bands (distinct)."""
    entries = stash(one.select("sign", "n", F.explode(F.slice("bands", 1, BANDS)).alias("band")), "bands")
    entry = F.struct("sign", "n")
    heads = [F.min_by(entry, F.xxhash64("sign", F.lit(k))).alias(f"h{k}") for k in range(HEADS)]
    buckets = stash(entries.groupBy("band").agg(F.count("*").alias("size"), *heads).filter("size > 1"), "buckets")
    small = entries.join(buckets.filter(F.col("size") <= ALL_PAIRS).select("band"), "band").groupBy("band").agg(F.collect_list(entry).alias("all"))
    met = small.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    large = buckets.filter(F.col("size") > ALL_PAIRS).select("band", F.array(*[f"h{k}" for k in range(HEADS)]).alias("all"))
    met = met.union(entries.join(large, "band").select(entry.alias("x"), F.explode("all").alias("y")))
    fits = F.least("x.n", "y.n") >= SIMILAR * F.greatest("x.n", "y.n")
    pairs = met.filter(fits & (F.col("x.sign") != F.col("y.sign"))).select(F.least("x.sign", "y.sign").alias("a"), F.greatest("x.sign", "y.sign").alias("b"))
    return pairs.distinct(), entries.join(large.select("band"), "band", "left_semi").select("sign").distinct()


def _least(share: float, n: Column) -> Column:
    """The least whole number that is no less than ``share`` of ``n``; rather one less than too many by rounding."""
    return F.ceil(F.lit(share) * n - 1e-9)


@tidy
def _slot_rows(batches):
    """(slot, n): how many shingles of a task's sets fall into each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column("shingles").flatten().to_numpy(zero_copy_only=False) % SLOTS, minlength=SLOTS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each slot (half a MB whatever the input)."""
    table = sets.select("shingles").mapInArrow(_slot_rows, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return counts


def _prefix_rows(counts: np.ndarray):
    """(token, sign, n, at, starts) of the first shingles of each set, by their slots' counts and then their values. A shingle alone in
    its slot is in no other set and left out. ``starts``: it is among the first that suffice for the smaller set of a pair."""

    def run(batches):
        for batch in batches:
            lists = batch.column("shingles")
            token, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            often = counts[token % SLOTS]
            order = np.lexsort((token, often, owner))
            at = np.arange(len(token)) - begin[owner]  # owner is in order
            size = n[owner]
            keep = (at <= size - np.ceil(SIMILAR * size - 1e-9)) & (often[order] > 1)
            starts = at <= size - np.ceil(2 * SIMILAR / (1 + SIMILAR) * size - 1e-9)
            sign = batch.column("sign").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (token[order], sign[owner], size, at, starts)], ["token", "sign", "n", "at", "starts"]
            )

    return run


def apart(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, among which are all pairs of ``sets`` (sign, shingles) of the similarity that are in different
    ``parts`` (node, component); a set without one is a part of its own.

    The smaller set's first shingles meet the larger set's, which are somewhat more. Shingles whose holders are all in one part are
    left out, and of the others the holders in the shingle's largest part meet those outside it only, so a large group costs no pairs.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_slot_counts(sets))

    def prefix_rows(batches):
        return tidy(_prefix_rows(counts.value))(batches)

    first = sets.mapInArrow(prefix_rows, "token long, sign long, n long, at long, starts boolean")
    first = first.join(parts.withColumnRenamed("node", "sign"), "sign", "left").select(
        "token", "sign", "n", "at", F.coalesce("component", "sign").alias("part"), "starts"
    )
    first = stash(first, "prefixes")
    held = first.groupBy("token", "part").agg(F.count("*").alias("held")).groupBy("token").agg(F.max_by("part", "held").alias("main"), F.count("*").alias("parts"))
    held = first.join(held.filter("parts > 1").select("token", "main"), "token")
    x, y = (held.select("token", F.struct("sign", "n", "at", "part").alias(c), (F.col("part") == F.col("main")).alias(f"{c}_main"), "starts") for c in ("x", "y"))
    x, y = x.filter("starts").drop("starts"), y.drop("starts")
    room = 1 + F.least(F.col("x.n") - 1 - F.col("x.at"), F.col("y.n") - 1 - F.col("y.at"))
    fits = (
        (F.col("x.part") != F.col("y.part")) & (F.struct("x.n", "x.sign") < F.struct("y.n", "y.sign")) & (F.col("x.n") >= SIMILAR * F.col("y.n"))
        & (room >= _least(SIMILAR / (1 + SIMILAR), F.col("x.n") + F.col("y.n")))
    )
    met = x.filter("NOT x_main").join(y, "token").filter(fits).select("x", "y").union(
        x.filter("x_main").join(y.filter("NOT y_main"), "token").filter(fits).select("x", "y")
    )
    return met.select(F.least("x.sign", "y.sign").alias("a"), F.greatest("x.sign", "y.sign").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""
    both = pairs.join(sets.select(F.col("sign").alias("a"), F.col("shingles").alias("p")), "a").join(
        sets.select(F.col("sign").alias("b"), F.col("shingles").alias("q")), "b"
    )
    common = F.size(F.array_intersect("p", "q"))
    return both.filter(common >= SIMILAR * (F.size("p") + F.size("q") - common)).select("a", "b")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): signs of sets with a Jaccard similarity of ``SIMILAR`` or more; between entries of large buckets enough of them to join
    every component. ``rows``: what ``_band_rows`` gives for ``docs``."""
    one = stash(rows.groupBy("sign").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    banded, hot = candidates(one)
    pairs, hot = stash(banded.union(print_pairs(one)).distinct(), "pairs"), stash(hot, "hot")
    met = pairs.select(F.explode(F.array("a", "b")).alias("sign")).union(hot).distinct()
    wanted = one.join(met, "sign", "left_semi").select("row_key")
    texts = docs.select(row_key().alias("row_key"), "text").join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"])
    sets = stash(texts.select("text").mapInArrow(_set_rows, "sign long, shingles array<long>"), "shingles")
    found = _similar(pairs, sets)
    if hot.isEmpty():
        return found
    found = stash(found, "links")
    further = apart(sets.join(hot, "sign", "left_semi"), connected(found))
    return found.union(_similar(stash(further, "pairs"), sets))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their groups of near copies: one row with the smallest doc_id."""
    rows = stash(docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(_band_rows, "doc_id long, row_key long, sign long, n long, bands array<long>"), "bands")
    parts = connected(links(docs, rows)).withColumnRenamed("node", "sign")
    grouped = rows.join(parts, "sign", "left").withColumn("component", F.coalesce("component", "sign"))
    row = fresh(docs, "_row")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "row_key")).alias("low")).select(F.col("low.row_key").alias(row))
    return docs.withColumn(row, row_key()).join(first, row, "left_semi").dropDuplicates([row]).select(*docs.columns)
