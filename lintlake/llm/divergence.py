"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language as a whole.

Every (lang, source) group is a segment tree over its language's term ids, with counts as leaves. Trees are hash-consed: equal count
subtrees, of whichever groups and places, are one node. Two groups are compared by walking both trees at once, level by level; equal node
pairs met by the walk are one entry with a multiplicity, so each is expanded once and each pair of counts is priced once.

Terms are counted by DataFrame functions, combined before they are shuffled. The vocabulary of a language is dealt by hash into subtrees of
about ``BLOCK`` terms, ids by falling frequency; a task holds the subtrees of one block for two bundles of at most ``BUNDLE`` sources,
whatever the number of documents, terms or sources. Terms that neither bundle has are priced once and multiplied.

Shares are whole numbers out of ``SCALE``, all arithmetic is exact on integers. Null text, lang and source are ''; empty texts make a
group without terms; repeated rows count each time; ties are ranked by item; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lintlake.llm.frames import stash
from lintlake.llm.terms import words

MIN_DOCUMENTS, TOP_TERMS = 3, 200
SCALE_STEPS, SCALE_STEP = 3, 1000
BLOCK, BUNDLE = 2048, 32
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and documents of the group that hold the term."""
    read = docs.select(*_names(), F.sort_array(words(F.col("text"), BETWEEN)).alias("words"))
    places = read.withColumn("at", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))))
    term, before = F.get("words", F.col("at")), F.get("words", F.col("at") - 1)
    firsts = places.select("lang", "source", term.alias("term"), F.when(before == term, 0).otherwise(1).alias("first"))
    return firsts.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("n_docs"))


def _names() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total) of the terms in at least ``min_docs`` documents of the language; ``total`` is the language's count."""
    of_lang = W.partitionBy("lang", "term")
    both = counts.withColumns({"docs": F.sum("n_docs").over(of_lang), "total": F.sum("n").over(of_lang)})
    return both.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total")


def _groups(docs: DataFrame, kept: DataFrame, size: int) -> DataFrame:
    """(lang, source, number, bundles, size, terms, lang_size) of every group; ``number`` counts the sources of a language."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_size"))
    found = docs.select(*_names()).distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    bundles = F.ceil(F.count("*").over(W.partitionBy("lang")) / size)
    return found.withColumns({"number": number, "bundles": bundles})


def _div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def _share(count: Column, of: Column) -> Column:
    """1 + floor(10^9 * count / of) in steps that stay within 64 bits."""
    left, out = count.cast("long"), F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        left = left * SCALE_STEP
        out, left = out * SCALE_STEP + _div(left, of), left % of
    return out + 1


def _part(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms a group has more of than its language, by their part of the divergence."""
    sized = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n") + 1, F.col("size") + F.col("terms")).alias("p"),
        _share(F.col("total") + 1, F.col("lang_size") + F.col("terms")).alias("q"))
    valued = sized.filter("p > q").select("lang", "source", "item", _part(F.col("p"), F.col("q")).alias("value"))
    return _ranked(valued).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


class Trees:
    """Hash-consed segment trees of the rows of a count matrix (a power of two wide)."""

    def __init__(self, counts: np.ndarray):
        self.values, nodes = np.unique(counts, return_inverse=True)
        nodes, self.children = nodes.reshape(counts.shape), []
        while nodes.shape[1] > 1:
            # equal pairs of children are one node of the next level
            width = int(nodes.max()) + 1
            pairs, parent = np.unique(nodes[:, 0::2] * width + nodes[:, 1::2], return_inverse=True)
            self.children.append(np.stack([pairs // width, pairs % width]))
            nodes = parent.reshape(len(counts), -1)
        self.roots = nodes[:, 0]

    def walk(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All leaves of pairs of trees side by side: (pair, left count, right count, how often)."""
        pair, a, b, times = np.arange(len(left)), self.roots[left], self.roots[right], np.ones(len(left), np.int64)
        for low in reversed(self.children):
            width = int(low.max()) + 1
            key = np.concatenate([(pair * width + low[k][a]) * width + low[k][b] for k in (0, 1)])
            met, at = np.unique(key, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, times]), len(met)).astype(np.int64)
            pair, a, b = met // (width * width), met // width % width, met % width
        return pair, self.values[a], self.values[b], times


def _shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / of)."""
    left, out = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(SCALE_STEPS):
        left = left * SCALE_STEP
        out, left = out * SCALE_STEP + left // of, left % of
    return out + 1


def _parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _block_pairs(key: tuple, table: pa.Table, size: int) -> pa.Table:
    """The part of one block of terms in the divergences between the sources of two bundles."""
    lang, _, low, high = (x.as_py() for x in key)
    known = table.filter(pc.is_valid(table.column("term")))
    codes = pc.dictionary_encode(known.column("term").combine_chunks())
    code, n_terms = codes.indices.to_numpy(), len(codes.dictionary)
    totals = np.zeros(n_terms, np.int64)
    totals[code] = known.column("total").to_numpy()
    place = np.empty(n_terms, np.int64)
    place[np.argsort(-totals, kind="stable")] = np.arange(n_terms)
    numbers, first = np.unique(table.column("number").to_numpy(), return_index=True)
    of = table.column("of").to_numpy()[first]
    counts = np.zeros((len(numbers), 1 << max(0, int(n_terms - 1).bit_length())), np.int64)
    counts[:, n_terms:] = -1  # behind the last term
    counts[np.searchsorted(numbers, known.column("number").to_numpy()), place[code]] = known.column("n").to_numpy()
    trees = Trees(counts)
    if low == high:
        left, right = np.triu_indices(len(numbers), 1)
    else:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(numbers // size == low), np.flatnonzero(numbers // size == high), indexing="ij"))
    pair, a, b, times = trees.walk(left, right)
    real = a >= 0
    pair, a, b, times = pair[real], a[real], b[real], times[real]
    p, q = _shares(a, of[left[pair]]), _shares(b, of[right[pair]])
    sums = [np.zeros(len(left), np.int64) for _ in range(2)]
    np.add.at(sums[0], pair, times * _parts(p, q))
    np.add.at(sums[1], pair, times * _parts(q, p))
    n = 2 * len(left)
    return pa.table({
        "lang": pa.array([lang] * n, pa.string()), "number": np.concatenate([numbers[left], numbers[right]]).astype(np.int64),
        "other": np.concatenate([numbers[right], numbers[left]]).astype(np.int64), "part": np.concatenate(sums), "seen": np.full(n, n_terms, np.int64)})


def pair_divergences(kept: DataFrame, groups: DataFrame, block: int = BLOCK, size: int = BUNDLE) -> DataFrame:
    """(lang, source, item, value): of every source the divergence from each other source of its language."""
    mine = groups.select("lang", "source", "number", "bundles", "terms", (F.col("size") + F.col("terms")).alias("of"))
    blocks = F.ceil(F.col("terms") / block)
    bundle = F.floor(F.col("number") / size)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bundles") - 1))
    rows = kept.join(mine, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), bundle.alias("bundle"), other.alias("with"), "number", "of", "term", "n", "total")
    # a source without a term of the block has a tree too
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    bare = mine.filter("terms > 0").select("lang", bundle.alias("bundle"), "bundles", "number", "of", every.alias("block")).select(
        "lang", "block", "bundle", other.alias("with"), "number", "of", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    both = rows.unionByName(bare).withColumns({"low": F.least("bundle", "with"), "high": F.greatest("bundle", "with")})
    parts = both.select("lang", "block", "low", "high", "number", "of", "term", "n", "total").groupBy("lang", "block", "low", "high").applyInArrow(
        lambda key, table: _block_pairs(key, table, size), "lang string, number long, other long, part long, seen long")
    sums = parts.groupBy("lang", "number", "other").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    left = mine.select("lang", "number", "source", "terms", F.col("of").alias("p_of"))
    right = mine.select("lang", F.col("number").alias("other"), F.col("source").alias("item"), F.col("of").alias("q_of"))
    pairs = left.join(right, "lang").filter("number <> other").join(sums, ["lang", "number", "other"], "left")
    one = F.lit(1).cast("long")
    unseen = (F.col("terms") - F.coalesce("seen", F.lit(0))) * _part(_share(one, F.col("p_of")), _share(one, F.col("q_of")))
    value = F.when(F.col("terms") > 0, F.coalesce("part", F.lit(0)) + unseen).otherwise(0).cast("long")
    return pairs.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of a language, part `term` the group's own terms."""
    kept = stash(kept_counts(stash(term_counts(docs), "terms")), "kept")
    groups = stash(_groups(docs, kept, bundle), "groups")
    pairs, terms = _ranked(pair_divergences(kept, groups, block, bundle)), top_terms(kept, groups)
    parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, rows in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
