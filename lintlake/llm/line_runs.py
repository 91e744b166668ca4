"""Line dedup over levelled sorted runs of line hashes.

Every line is hashed once, with numpy, into a table of (row, batch, place, hash); texts are read again only to take lines out.
``LineRuns`` keeps how many documents hold each line key, as sorted runs of (hash, documents) by level: once a level has ``FANOUT`` runs
they are merged into one run of the next level, so a key stands in few runs however many batches came. A new batch is merge-anti-joined
with the keys that the runs have seen in enough documents, which need no further count, and adds its others as a run of level 0.

Keys with over one in ``HOT_SHARE`` of all lines, so at most ``HOT_SHARE`` keys, are taken out of the lines by a broadcast set; all other
keys by a sort-merge join, in which none has more rows than that.

A null or empty text is one empty line; empty keys never count; a key repeated in one document counts once; repeated rows are
separate documents; null doc_ids are documents like others; extra columns are kept by ``drop_lines`` (its counts get other names where
a column is called n_lines or n_dropped); a text may have any number of lines; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import fresh, row_key, stash, tidy

MIN_DOCUMENTS, FANOUT, BATCHES, HOT_SHARE = 10, 2, 3, 5000
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Another value for every byte, so that the second hash is another sum.
_OTHER = (np.arange(256) * 167 + 13).astype(np.uint8)
_LINES = "row long, batch int, place int, h1 long, h2 int, first boolean"


@tidy
def _line_rows(batches):
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        rows, parts = batch.column("row").to_numpy(), batch.column("batch").to_numpy()
        for lo, hi in T.slices(off):
            bytes_, begins = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lines, solid = T.Words(bytes_, begins, _NEWLINE), np.flatnonzero(~T.SPACE[bytes_])
            begin, end = np.searchsorted(solid, lines.starts), np.searchsorted(solid, lines.ends)
            full = np.flatnonzero(end > begin)  # lines with something but blanks
            doc, starts, ends = lines.doc[full], solid[begin[full]], solid[end[full] - 1] + 1
            breaks = np.concatenate(([0], np.cumsum(bytes_ == 10)))
            low = _LOWER[bytes_]
            h1, h2 = T.span_hashes(low, starts, ends), T.span_hashes(_OTHER[low], starts, ends) >> np.uint64(32)
            first = np.zeros(len(doc), bool)
            first[np.unique(h1 ^ T.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[lo + doc]), pa.array(parts[lo + doc].astype(np.int32)), pa.array((breaks[starts] - breaks[begins[doc]]).astype(np.int32)),
                 pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(first)],
                [c.split()[0] for c in _LINES.split(", ")])


def hashed_lines(docs: DataFrame, batches: int = 1) -> DataFrame:
    """(row, batch, place, h1, h2, first): 96 bits of every line's key, and whether it is the key's first place in the document."""
    batch = F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)), F.lit(batches)).cast("int")
    return docs.select(row_key().alias("row"), batch.alias("batch"), "text").mapInArrow(_line_rows, _LINES)


class LineRuns:
    """Sorted runs of (h1, h2, n_docs) by level; ``levels[k]`` holds the tables of level k, newest last. With a ``limit`` a key that was
    found in so many documents is counted no further."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, limit: int | None = None):
        self.spark, self.fanout, self.limit, self.levels = spark, fanout, limit, [[]]

    def add(self, docs: DataFrame) -> None:
        self.add_lines(hashed_lines(docs))

    def add_lines(self, lines: DataFrame) -> None:
        counts = lines.filter("first").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        if self.limit is not None and any(self.levels):
            counts = counts.join(self.common(self.limit).hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)

    def _write(self, counts: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(stash(counts.sortWithinPartitions("h1", "h2"), f"run{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = _merged(self.levels[level])
            self.levels[level] = []
            self._write(merged, level + 1)

    def counts(self) -> DataFrame:
        runs = [run for level in self.levels for run in level]
        return _merged(runs) if runs else self.spark.createDataFrame([], "h1 long, h2 int, n_docs long")

    def common(self, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches so far."""
        return self._above(min_docs).select("h1", "h2")

    def _above(self, min_docs: int) -> DataFrame:
        return self.counts().filter(F.col("n_docs") >= min_docs)

    def places(self, lines: DataFrame, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
        """(row, gone): the places of the common lines of each document that has some."""
        above = stash(self._above(min_docs), "common")
        is_hot = F.col("n_docs") * HOT_SHARE > lines.count()  # counts add up to no more than the lines
        hot, rest = F.broadcast(above.filter(is_hot).select("h1", "h2")), above.filter(~is_hot).select("h1", "h2")
        slim = lines.select("row", "place", "h1", "h2")
        found = slim.join(hot, ["h1", "h2"], "left_semi").unionByName(
            slim.join(hot, ["h1", "h2"], "left_anti").join(rest.hint("merge"), ["h1", "h2"], "left_semi"))
        return found.groupBy("row").agg(F.collect_set("place").alias("gone"))

    def drop(self, docs: DataFrame, min_docs: int = MIN_DOCUMENTS, lines: DataFrame | None = None) -> DataFrame:
        """``docs`` with the common lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``."""
        row, gone = fresh(docs, "_row"), fresh(docs, "_gone")
        places = self.places(stash(hashed_lines(docs), "lines") if lines is None else lines, min_docs).withColumnsRenamed({"row": row, "gone": gone})
        return _without(docs.withColumn(row, row_key()).join(places, row, "left").drop(row), docs, gone)


def _merged(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for run in runs[1:]:
        both = both.union(run)
    return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def _without(keyed: DataFrame, docs: DataFrame, gone_name: str) -> DataFrame:
    names, counts_of = docs.columns, [fresh(docs, c) for c in ("n_lines", "n_dropped")]

    def run(batches):
        for batch in batches:
            texts, counts, dropped = [], [], []
            for text, places in zip(batch.column("text"), batch.column(gone_name), strict=True):
                lines, gone = (text.as_py() or "").split("\n"), set(places.as_py() or ())
                counts.append(len(lines))
                dropped.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text.as_py() or "")
            new = {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [new.get(c, batch.column(c)) for c in names] + [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                [*names, *counts_of],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return keyed.select(*names, gone_name).mapInArrow(tidy(run), f"{schema}, {counts_of[0]} long, {counts_of[1]} long")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """All of ``docs`` through the runs in ``batches`` batches, then cleaned."""
    lines = stash(hashed_lines(docs, batches), "lines")
    runs = LineRuns(docs.sparkSession, limit=min_docs)
    for k in range(batches):
        runs.add_lines(lines.filter(F.col("batch") == k))
    return runs.drop(docs, min_docs, lines)
