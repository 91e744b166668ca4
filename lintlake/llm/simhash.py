"""SimHash near-duplicates through deletion variants.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most three bits, one half differs in at most one, so
both hold the same half with one bit left out: each fingerprint is indexed under the 64 variants of its halves with one wildcard,
equal variants meet in a sorted shuffle and the whole fingerprints are verified there. Only distinct fingerprints are indexed, so
exact copies are one entry. A bucket yields the edges of a spanning forest, not its pairs. A bucket over ``MAX_BUCKET`` entries is
not compared in its task but split again the same way: its other half is cut into parts of 16 and then 8 bits, of which one again
differs by at most one bit; after the second split a bucket holds at most 2^11 fingerprints, so every task is bounded.

Null or wordless texts have fingerprint zero and link like any other; null doc_ids count as larger than every id (a component of
null ids alone has a null id; null ids with different fingerprints are different documents); repeated rows share a fingerprint and so a component; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import NO_ID, fresh, row_key, stash, tidy

SHINGLE, DISTANCE, MAX_BUCKET = 3, 3, 16384
#: Node numbers kept free above all doc_ids.
NAMELESS = 1 << 40
#: The parts of a fingerprint (lowest bit, width) that each level cuts into variants, by the half that the first level matched.
_LEVELS = {0: ((0, 32), (32, 32)), 1: ((0, 16), (16, 16)), 2: ((0, 8), (8, 8))}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shingle_hashes(raw: bytes, starts: list[int], ends: list[int]) -> list[int]:
    """XXH64 of each three words joined by spaces (fewer words: of all)."""
    words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    grams = zip(words, islice(words, 1, None), islice(words, 2, None))  # noqa: B905  ends with the shortest
    return [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]


def fingerprints_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a slice."""
    words = T.Words(_LOWER[data], off)
    raw, out = words.data.tobytes(), np.zeros(len(off) - 1, np.uint64)
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        hashes = np.array(_shingle_hashes(raw, starts[a:b], ends[a:b]), np.uint64)
        if len(hashes):
            bits = np.zeros(64, np.int64)
            for p in range(0, len(hashes), 65536):  # 64 bytes a shingle at a time
                part = hashes[p : p + 65536]
                bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[d] = np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint_rows(batches):
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        fps = [fingerprints_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in T.slices(off)]
        fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])


def _variant_rows(level: int):
    """(key, level's matched part, fp, node): one row for each wildcard position of each part."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            outer = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) if level else None
            parent = batch.column("path").to_numpy(zero_copy_only=False) if level else None
            rest = _rest(fp, parent, level)
            for which, (low, width) in enumerate(_LEVELS[level]):
                part = (rest >> np.uint64(low)) & np.uint64((1 << width) - 1)
                for bit in range(width):
                    masked = part & ~np.uint64(1 << bit)
                    tag = np.uint64((which << 5) | bit)
                    key = (masked << np.uint64(6)) | tag if not level else T.mix(outer * np.uint64(64) + tag) ^ T.mix(masked + np.uint64(1))
                    path = np.full(len(fp), which, np.int32) if not level else parent * 2 + which
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(path.astype(np.int32)), batch.column("fp"), batch.column("node")],
                        ["key", "path", "fp", "node"],
                    )

    return run


def _rest(fp: np.ndarray, path, level: int) -> np.ndarray:
    """The bits not yet matched: all, then the half, then the quarter that the path's levels left over."""
    if level == 0:
        return fp
    first = path if level == 1 else path // 2
    half = np.where(first == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
    if level == 1:
        return half
    return np.where(path % 2 == 0, half >> np.uint64(16), half & np.uint64(0xFFFF))


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs within ``DISTANCE`` bits that connect all that such pairs connect."""
    edges, left = [], np.arange(1, len(fp))
    queue, head = [0], 0
    while True:
        while head < len(queue) and len(left):
            a = queue[head]
            head += 1
            near = np.bitwise_count(fp[left] ^ fp[a]) <= DISTANCE
            if near.any():
                found = left[near].tolist()
                edges += [(a, b) for b in found]
                queue += found
                left = left[~near]
        if not len(left):
            return edges
        queue, head, left = [int(left[0])], 0, left[1:]


def _bucket_rows(last: bool, most: int):
    """Sorted (key, path, fp, node) rows to edges (a, b); entries of too large buckets come back with ``again`` set."""

    def run(batches):
        names = ["key", "path", "fp", "node"]
        held = {n: np.zeros(0, np.int64) for n in names}
        hot = None  # the key whose entries pass through

        def settle(rows, ends_here):
            nonlocal hot, held
            key = rows["key"]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            stops = np.append(new[1:], len(key))
            if not ends_here and len(new):  # the last run may go on
                held = {n: rows[n][new[-1] :] for n in names}
                new, stops = new[:-1], stops[:-1]
            else:
                held = {n: v[:0] for n, v in rows.items()}
            edges, passed = [], []
            size = stops - new
            two = new[size == 2]
            near = np.bitwise_count(rows["fp"][two].view(np.uint64) ^ rows["fp"][two + 1].view(np.uint64)) <= DISTANCE
            edges.append(np.stack([rows["node"][two[near]], rows["node"][two[near] + 1]], 1))
            for a, b in zip(new[size > 2].tolist(), stops[size > 2].tolist(), strict=True):
                if b - a > most and not last or key[a] == hot:
                    passed.append(np.arange(a, b))
                    continue
                pairs = np.array(forest(rows["fp"][a:b].view(np.uint64)), np.int64).reshape(-1, 2)
                edges.append(rows["node"][a:b][pairs])
            for a in new[size <= 2].tolist() if hot is not None else []:
                if key[a] == hot:
                    passed.append(np.arange(a, a + size[new == a][0]))
            if len(held["key"]) and (held["key"][0] == hot or len(held["key"]) > most and not last):
                hot = held["key"][0]
                passed.append(slice(len(key) - len(held["key"]), len(key)))
                held = {n: v[:0] for n, v in held.items()}
            edge = np.concatenate(edges)
            out = [_out(edge[:, 0], edge[:, 1], None, None)] if len(edge) else []
            for p in passed:
                out.append(_out(rows["node"][p], rows["node"][p], {n: rows[n][p] for n in names}, True))
            return out

        for batch in batches:
            new = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names}
            yield from settle({n: np.concatenate((held[n], new[n])) for n in names}, False)
        yield from settle(held, True)

    return run


def _out(a, b, rows, again) -> pa.RecordBatch:
    n = len(a)
    rest = [pa.array(rows[k]) if again else pa.nulls(n, pa.int64()) for k in ("key", "path", "fp")]
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), rest[0], rest[1].cast(pa.int32()), rest[2], pa.array(np.full(n, bool(again)))],
        ["a", "b", "key", "path", "fp", "again"],
    )


def near_edges(nodes: DataFrame, most: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) that connect all nodes whose fingerprints differ in at most ``DISTANCE`` bits. ``nodes``: node, fp (distinct)."""
    rows, found = nodes.select("node", "fp"), None
    for level in range(3):
        variants = rows.mapInArrow(tidy(_variant_rows(level)), "key long, path int, fp long, node long")
        sorted_rows = variants.repartition("key").sortWithinPartitions("key", "fp")
        out = stash(
            sorted_rows.mapInArrow(tidy(_bucket_rows(level == 2, most)), "a long, b long, key long, path int, fp long, again boolean"), f"near{level}"
        )
        edges = out.filter("not again").select("a", "b")
        found = edges if found is None else found.union(edges)
        rows = out.filter("again").select(F.col("a").alias("node"), "key", "path", "fp")
        if rows.isEmpty():
            break
    return found.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node. Alternates large-star and small-star
    steps, each a combined minimum and a join, until no edge changes; every round is a written table."""
    current = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        linked = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b")
        done = low.select("a", F.col("low").alias("b")).union(linked).distinct()
        following = stash(done, "edges")
        sums = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        if following.agg(*sums).first() == current.agg(*sums).first():
            return following.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                following.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        current = following


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links), row_key, component (never null) per
    row of ``docs``."""
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text")
    rows = stash(keyed.mapInArrow(_fingerprint_rows, "doc_id long, row_key long, fp long"), "fingerprints")
    # fingerprints of null ids alone become nodes of their own above all ids; repeated ids with several fingerprints are one node
    nameless = F.lit(NO_ID) - F.pmod(F.xxhash64("fp"), F.lit(NAMELESS))
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", F.coalesce("low", nameless).alias("node")), "nodes")
    parts = connected(near_edges(nodes))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component") <= NO_ID - NAMELESS, F.col("component")).alias("component_id"), "row_key", "component",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their components: one row with the smallest doc_id (of a component of null ids: any one)."""
    rows = near_duplicates(docs)
    row = fresh(docs, "_row")
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_key").alias(row))
    kept = docs.withColumn(row, row_key()).join(first, row, "left_semi")
    return kept.dropDuplicates([row]).select(*docs.columns)
