"""Mixing sources to target weights by blocks of words.

Each source's documents, in a pseudorandom order, form one stream of words that is cut into blocks of a fixed length. The mix consists
of shards of slots: in every shard the whole part of each source's expected slots is fixed and the rest is drawn multinomially, seeded
by the shard. A source's slots are numbered through all shards; number j takes block perm(j mod blocks) of round j div blocks, where
perm is a keyed permutation of the source's block numbers, so no block is taken twice before all were taken once. Slots and documents
meet by an equi-join on (source, block).

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a source stops at ``MOST`` times its words
and the excess is shared anew. Null texts have no words and are never taken; repeated rows are separate stretches of the stream; null
doc_ids are kept; extra columns are kept by ``mixed_documents``; an empty table gives no rows. One row per source (not per document)
is planned on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import fresh, row_key, stash, tidy

WEIGHTS, MOST, BLOCK_WORDS, LEAST_BLOCKS = (1, 2, 3), 3, 256, 128
SHARD_SLOTS, BUCKETS, SEED = 16384, 1024, 42
#: Rows whose texts a task holds several times over while it cuts them.
CUT_AT_ONCE = 1024


def targets(sizes: list[int]) -> list[float]:
    """Words to take of each source, given their words in the order of the sources."""
    total, weight = float(sum(sizes)), [float(WEIGHTS[k % len(WEIGHTS)]) for k in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = total - sum(MOST * sizes[k] for k in full)
        share = sum(w for k, w in enumerate(weight) if k not in full)
        out = [float(MOST * n) if k in full else rest * weight[k] / share for k, n in enumerate(sizes)]
        over = {k for k, n in enumerate(sizes) if k not in full and out[k] > MOST * n}
        if not over:
            return out
        full |= over


def permuted(j: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size): a Feistel network over the next even number of bits, walked until it lands in range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask, out = np.uint64((1 << int(half)) - 1), np.asarray(j, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (T.mix(right + np.uint64((key * 4 + turn + 1) % (1 << 62))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


@tidy
def _size_rows(batches):
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        counts = [T.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).counts() for lo, hi in T.slices(off)]
        size = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "doc_id", "source")), pa.array(size)], ["_row", "doc_id", "source", "size"])


class Mix:
    """A planned mix. ``sizes``: _row, doc_id, source, size, sid, begin (first word in the source's stream); ``sources``: one dict
    per source; ``pieces()``: which words of which documents the mix takes, and how often."""

    def __init__(self, docs: DataFrame, seed: int = SEED):
        self.spark, self.seed = docs.sparkSession, seed
        rows = docs.select(row_key().alias("_row"), "doc_id", "source", "text").mapInArrow(
            _size_rows, "_row long, doc_id long, source string, size long"
        )
        sizes = stash(rows, "sizes")
        words = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        names = sorted((n for n in words if n is not None)) + [n for n in words if n is None]
        self.sources = []
        for sid, (name, target) in enumerate(zip(names, targets([words[n] for n in names]) if names else [], strict=True)):
            length = int(np.clip(words[name] // LEAST_BLOCKS, 1, BLOCK_WORDS))
            blocks = -(-words[name] // length)
            slots = min(MOST * blocks, round(target * blocks / words[name])) if blocks else 0
            self.sources.append({"sid": sid, "name": name, "words": words[name], "target": target, "length": length, "blocks": blocks, "slots": slots})
        schema = "sid int, name string, words long, target double, length long, blocks long, slots long"
        self.table = self.spark.createDataFrame([tuple(s.values()) for s in self.sources], schema)
        known = sizes.join(F.broadcast(self.table), F.col("source").eqNullSafe(F.col("name"))).drop("name", "slots")
        # prefix sums of a hot source: within 1024 buckets, then over the buckets' sums
        dealt = known.withColumn("bucket", F.pmod(F.col("_row"), F.lit(BUCKETS)))
        sums = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
        own = Window.partitionBy("sid", "bucket").orderBy("_row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        within = dealt.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
        self.sizes = stash(
            within.join(offsets, ["sid", "bucket"]).withColumn("begin", F.col("from") + F.col("within")).drop("bucket", "from", "within"), "stream"
        )

    def slots(self) -> DataFrame:
        """One row per slot of the mix: shard, sid, block, turn (how often the source's blocks had been taken before)."""
        sources, seed = [s for s in self.sources if s["slots"]], self.seed
        total = sum(s["slots"] for s in sources)
        expected = np.array([s["slots"] for s in sources], float) / max(total, 1)

        def draw(batches):
            for batch in batches:
                for shard in batch.column("id").to_pylist():
                    room = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                    whole = np.floor(expected * room).astype(np.int64)
                    rest = expected * room - whole
                    more = np.random.default_rng([seed, shard]).multinomial(room - whole.sum(), rest / rest.sum()) if rest.sum() > 1e-9 else 0 * whole
                    n = whole + more
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int64()), pa.array([s["sid"] for s in sources], pa.int32()), pa.array(n)], ["shard", "sid", "n"])

        shards = self.spark.range(-(-total // SHARD_SLOTS)).mapInArrow(draw, "shard long, sid int, n long")
        before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        numbered = shards.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        blocks = {s["sid"]: s["blocks"] for s in sources}

        def place(batches):
            for batch in batches:
                for shard, sid, n, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "sid", "n", "first")), strict=True):
                    j = np.arange(first, min(first + n, MOST * blocks[sid]))  # never more than MOST rounds
                    if not len(j):
                        continue
                    block = permuted(j % blocks[sid], blocks[sid], seed * 1_000_003 + sid)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(j), pa.int64()), pa.array([sid] * len(j), pa.int32()), pa.array(block), pa.array((j // blocks[sid]).astype(np.int32))],
                        ["shard", "sid", "block", "turn"],
                    )

        # the window leaves all shards of a source in one task
        return numbered.repartition("shard").mapInArrow(place, "shard long, sid int, block long, turn int")

    def pieces(self) -> DataFrame:
        """sid, begin, _row, block, first and end (words of the document that lie in the block)."""
        length, end = F.col("length"), F.col("begin") + F.col("size")
        each = self.sizes.filter("size > 0").select(
            "sid", "begin", "_row", "size", "length",
            F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor((end - 1) / length))).alias("block"),
        )
        low = F.greatest(F.col("block") * length - F.col("begin"), F.lit(0))
        high = F.least((F.col("block") + 1) * length - F.col("begin"), F.col("size"))
        return each.select("sid", "begin", "_row", "block", low.alias("first"), high.alias("end"))


#: Both sides of the joins below grow with the documents; compressed tables look small enough to be broadcast, hence the hints.

def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words that the mix takes, repeats counted) per row of ``docs``."""
    mix = Mix(docs, seed)
    uses = mix.slots().groupBy("sid", "block").agg(F.count("*").alias("uses"))
    taken = mix.pieces().join(uses.hint("merge"), ["sid", "block"]).groupBy("sid", "begin").agg(F.sum((F.col("end") - F.col("first")) * F.col("uses")).alias("taken"))
    words = mix.sizes.withColumn("at", F.when(F.col("size") > 0, F.col("begin")))
    return words.join(taken.withColumnRenamed("begin", "at").hint("merge"), ["sid", "at"], "left").select(
        "doc_id", "size", F.col("words").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def _cut_rows(names: list[str], plan_name: str):
    def run(batches):
        for batch in (whole.slice(lo, CUT_AT_ONCE) for whole in batches for lo in range(0, whole.num_rows, CUT_AT_ONCE)):
            out: list[list] = []
            for k, (text, plan) in enumerate(zip(batch.column("text").to_pylist(), batch.column(plan_name).to_pylist(), strict=True)):
                data, off = T.flat(pa.array([text], pa.large_string()))
                words = T.Words(data, off)
                for first, end in _stretches(plan):
                    whole = first == 0 and end == len(words)
                    out.append([k, text if whole else data[words.starts[first] : words.ends[end - 1]].tobytes().decode()])
            rows = batch.take(pa.array([k for k, _ in out], pa.int64()))
            texts = [t for _, t in out]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names and pa.types.is_integer(rows.column("n_chars").type):
                new["n_chars"] = pa.array([len(t) for t in texts], rows.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in names], names)

    return run


def _stretches(plan: list[dict]) -> list[tuple[int, int]]:
    """Neighbouring pieces of one round (and one copy of the row) as one stretch."""
    out: list[list[int]] = []
    last = None
    for begin, turn, first, end in sorted((p["begin"], p["turn"], p["first"], p["end"]) for p in plan):
        if last == (begin, turn) and out[-1][1] == first:
            out[-1][1] = end
        else:
            out.append([first, end])
        last = (begin, turn)
    return [(a, b) for a, b in out]


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as rows with ``docs``' columns: each stretch of a document that lies in taken blocks of one round, its text unchanged
    (a whole text where all of it is taken)."""
    mix = Mix(docs, seed)
    piece = F.struct("begin", "turn", "first", "end")
    row, plan = fresh(docs, "_row"), fresh(docs, "_plan")
    taken = mix.pieces().join(mix.slots().hint("merge"), ["sid", "block"]).groupBy(F.col("_row").alias(row)).agg(F.collect_list(piece).alias(plan))
    names = docs.columns
    keyed = docs.withColumn(row, row_key()).dropDuplicates([row]).join(taken.hint("merge"), row).select(*names, plan)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return keyed.mapInArrow(tidy(_cut_rows(names, plan)), schema)
