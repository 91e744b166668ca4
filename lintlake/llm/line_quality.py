"""Quality rules: text statistics, and lines that too many documents of one host share.

Every line with a word is normalised (trimmed, A-Z in lower case) and hashed; distinct documents are counted per host (``source``)
and line. Lines above the host's limit are boilerplate; a document left with under ``MIN_WORDS`` words or under ``MIN_SHARE`` of its
words is depleted and rejected. Texts are read once; the rest works on hashes.

Null texts have no words and fail the base rules; a null host is a host of its own; repeated rows are separate documents when lines
are counted; null doc_ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import row_key, stash
from lintlake.llm.stats import TextStats

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line is above its host's limit in more than this many documents. A share of the host's documents on top would let the limit grow
#: with the host until no line reaches it, so it is 0.
HOST_DOCUMENTS, HOST_SHARE = 20, 0.0
MIN_SHARE = 0.3

_SCHEMA = (
    "_row long, doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<long>, line_words array<long>"
)


def _stat_rows(batches):
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        for lo, hi in T.slices(off):
            s = TextStats(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            at = pa.array(np.searchsorted(s.line_doc, np.arange(hi - lo + 1)).astype(np.int32))
            counts = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("_row", "doc_id", "source")]
                + [pa.array(c.astype(np.int64)) for c in counts]
                + [
                    pa.ListArray.from_arrays(at, pa.array(s.line_hash.view(np.int64))),
                    pa.ListArray.from_arrays(at, pa.array(s.line_words.astype(np.int64))),
                ],
                [f.split()[0] for f in _SCHEMA.split(", ")],
            )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``n_common_words`` (in lines above the host's limit), ``base_failed`` and ``kept`` per row of ``docs``."""
    rows = stash(docs.select(row_key().alias("_row"), "doc_id", "source", "text").mapInArrow(_stat_rows, _SCHEMA), "stats")
    hosts = rows.groupBy("source").agg(F.count("*").alias("n_host"))
    line = rows.select("source", F.explode(F.array_distinct("lines")).alias("line"))
    counts = line.groupBy("source", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > HOST_DOCUMENTS)
    above = (
        counts.join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
        .filter(F.col("n_docs") > HOST_SHARE * F.col("n_host")).select("host", F.col("line").alias("common"))
    )
    each = rows.dropDuplicates(["_row"]).select("_row", "source", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    taken = (
        each.select("_row", "source", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
        .join(above, (F.col("line") == F.col("common")) & F.col("source").eqNullSafe(F.col("host")))
        .groupBy("_row").agg(F.sum("words").alias("n_common_words"))
    )
    left = F.col("n_words") - F.col("n_common_words")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (
        rows.drop("lines", "line_words").join(taken, "_row", "left").fillna(0, ["n_common_words"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= MIN_WORDS) & (left >= MIN_SHARE * F.col("n_words")))
        .drop("_row", "source")
    )
