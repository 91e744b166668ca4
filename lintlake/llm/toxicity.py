"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The fit takes at most ``MAX_ROWS`` labelled rows (the lowest hashes of their ids) of together at most ``MAX_POSTINGS`` distinct terms.
Its vocabulary is every term of these but those in a single example or in over ``MAX_SHARE`` of them. A term weighs its inverse document
frequency times its relevance frequency, log2(2 + toxic examples / other examples with it): no term is left out for its label, but
neighbours are near by what they say about it. Examples are unit vectors (equal ones a single entry with their mean label) in blocks of
``BLOCK``; the index keeps, per term, its postings by block and the largest weight in each block that has it. A query adds up the bounds
of its blocks, visits the ``FIRST`` best, then those whose bound reaches its ``NEIGHBOURS``-th best cosine, which gives the exact nearest
examples. Their votes, weighted by cosine and shrunk to the base rate, are calibrated by an isotonic fit of leave-one-out votes of at
most ``CALIBRATION_ROWS`` entries.
The index is bounded by ``MAX_ROWS`` and ``MAX_POSTINGS`` and broadcast; texts are read once to fit and once to score.

Texts without a known term (null or empty ones too) have no neighbours and get the rate of toxic ones among such examples, shrunk to the
base rate; copies get equal scores; without labels to learn from all scores are 0; several labels of one id count as the highest; null
ids have no label; of equally near entries any may be left out; an example of more terms than are left of ``MAX_POSTINGS`` is no
example; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import stash, tidy
from lintlake.llm.quality_trees import held_out, learnable

MAX_ROWS, MAX_POSTINGS, MAX_SHARE = 4000, 4_000_000, 0.9
BLOCK, FIRST, NEIGHBOURS, SHRINK, EVIDENCE, CALIBRATION_ROWS = 64, 4, 15, 1.0, 3, 2000
#: Terms are runs of letters and digits; all other ASCII separates.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def _terms(column, limit=T.SLICE_BYTES):
    """(lo, hi, text index, term hash, count) of the distinct terms of each slice's texts."""
    data, off = T.flat(pc.utf8_lower(column))
    for lo, hi in T.slices(off, limit):
        words = T.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], _SEPARATOR)
        yield lo, hi, words.doc, words.hashes()


@tidy
def _example_rows(batches):
    """One row per (example, distinct term), one without a term for an example that has none."""
    for batch in batches:
        for lo, hi, doc, term in _terms(batch.column("text")):
            none = np.setdiff1d(np.arange(hi - lo), doc)
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
            first = np.flatnonzero(new)
            count = np.append(np.diff(np.append(first, len(doc))), np.zeros(len(none), np.int64))
            ids, y = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("doc_id", "y"))
            owner = np.append(doc[first], none)
            terms = pa.array(np.append(term[first].view(np.int64), np.zeros(len(none), np.int64)), mask=count == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(y[owner].astype(np.int32)), terms, pa.array(count.astype(np.int32))], ["doc_id", "y", "term", "n"]
            )


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The integers of all [first, last) in a row."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


@dataclass
class Examples:
    """The index. ``terms``: sorted term hashes; ``idf``: their weights; ``ids``/``y``: the examples; ``prior``: the base rate; ``none``:
    the score without neighbours; ``knots``: calibration (vote, score). Entries are (term, block) pairs in order: term t has those from
    ``at[t]`` to ``at[t + 1]``, each with its ``block``, its largest weight ``top`` and its postings from ``start[e]`` to ``start[e + 1]``
    in ``doc``, ``weight``."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    y: np.ndarray
    prior: float
    none: float = 0.0
    at: np.ndarray = None
    block: np.ndarray = None
    top: np.ndarray = None
    start: np.ndarray = None
    doc: np.ndarray = None
    weight: np.ndarray = None
    knots: tuple = ((0.0, 1.0), (0.0, 1.0))

    def index(self, doc, term, weight) -> Examples:
        order = np.lexsort((doc, term))
        doc, term, self.weight = doc[order], term[order], weight[order]
        new = np.ones(len(doc), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK)
        first = np.flatnonzero(new)
        self.doc, self.block, self.start = doc.astype(np.int32), (doc[first] // BLOCK).astype(np.int32), np.append(first, len(doc))
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.at = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        return self

    def vector(self, term, count) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector over the vocabulary of a text with these vocabulary terms (indices) and counts."""
        weight = (1 + np.log(count)) * self.idf[term]
        return term, weight / np.sqrt((weight**2).sum())

    def nearest(self, term, weight, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``NEIGHBOURS`` nearest with a positive cosine."""
        entry = _ranges(self.at[term], self.at[term + 1])
        share = np.repeat(weight, self.at[term + 1] - self.at[term])
        block = self.block[entry]
        upper = np.bincount(block, share * self.top[entry], minlength=-(-len(self.ids) // BLOCK))
        ahead = np.argsort(-upper, kind="stable")
        who, cosine = np.zeros(0, np.int64), np.zeros(0)
        for part in (ahead[:FIRST], ahead[FIRST:]):
            if len(who) == NEIGHBOURS:
                part = part[upper[part] > cosine[-1] - 1e-9]
            wanted = np.zeros(len(upper), bool)
            wanted[part[upper[part] > 0]] = True
            some = wanted[block]
            e = entry[some]
            posting = _ranges(self.start[e], self.start[e + 1])
            value = np.repeat(share[some], self.start[e + 1] - self.start[e]) * self.weight[posting]
            score = np.bincount(self.doc[posting], value, minlength=len(self.ids))
            if skip >= 0:
                score[skip] = 0
            found = np.flatnonzero(score > 0)
            if len(found) > NEIGHBOURS:
                found = found[score[found] >= np.partition(score[found], -NEIGHBOURS)[-NEIGHBOURS]]
            who, cosine = np.append(who, found), np.append(cosine, score[found])
            best = np.lexsort((who, -cosine))[:NEIGHBOURS]
            who, cosine = who[best], cosine[best]
        return who, cosine

    def vote(self, who, cosine) -> float:
        return float((cosine @ self.y[who] + SHRINK * self.prior) / (cosine.sum() + SHRINK))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def _isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, each counted n times (pooled neighbours)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b, c in zip(x[order], y[order], n[order], strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _within_bound(rows: DataFrame, most: int) -> np.ndarray:
    """Ids of the examples, by the hashes of their ids, whose terms fit into ``most`` postings."""
    sizes = rows.groupBy("doc_id").agg(F.count("term").alias("terms")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, ids = most, []
    for r in sizes:
        if r.terms <= left:
            left -= r.terms
            ids.append(r.doc_id)
    return np.array(ids, np.int64)


def fit(examples: DataFrame, most: int = MAX_POSTINGS) -> Examples | None:
    """``examples``: doc_id, y, text of labelled rows, at most ``MAX_ROWS`` of them."""
    rows = stash(examples.mapInArrow(_example_rows, "doc_id long, y int, term long, n int"), "examples")
    ids = _within_bound(rows, most)
    if not len(ids):
        return None
    kept = rows.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids)}))
    found = rows.join(F.broadcast(kept), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("term", "ascending")])
    doc_id, label, count = (found[c].to_numpy() for c in ("doc_id", "y", "n"))
    ids, first, doc = np.unique(doc_id, return_index=True, return_inverse=True)
    y = label[first].astype(float)
    n, prior = len(ids), float(y.mean())
    some = count > 0
    doc, count = doc[some], count[some]
    terms, term = np.unique(found["term"].drop_null().to_numpy().view(np.uint64), return_inverse=True)
    df, toxic = np.bincount(term, minlength=len(terms)), np.bincount(term, y[doc], minlength=len(terms))
    told = (df > 1) & (df <= max(MAX_SHARE * n, 2))
    some = told[term]
    doc, term, count = doc[some], (np.cumsum(told) - 1)[term[some]], count[some]
    terms, df, toxic = terms[told], df[told], toxic[told]
    weights = (np.log((n + 1) / (df + 1)) + 1) * np.log2(2 + toxic / np.maximum(df - toxic, 1))
    has = np.zeros(n, bool)
    has[doc] = True
    none = float((y[~has].sum() + SHRINK * prior) / ((~has).sum() + SHRINK))
    if not len(terms):
        return Examples(terms, weights, np.zeros(0, np.int64), np.zeros(0), prior, none)
    # examples with the same terms and counts are one entry with their mean label
    sign = np.zeros(n, np.uint64)
    np.add.at(sign, doc, T.mix(term.astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64)))
    owners = np.flatnonzero(has)
    _, head, entry, size = np.unique(sign[owners], return_index=True, return_inverse=True, return_counts=True)
    mean = np.bincount(entry, y[owners]) / size
    weight = (1 + np.log(count)) * weights[term]
    weight /= np.sqrt(np.bincount(doc, weight**2, minlength=n))[doc]
    # entries of like heaviest terms share blocks, which keeps the blocks' bounds low
    order = np.lexsort((-weight, doc))
    heaviest = np.full(n, -1)
    heaviest[doc[order][::-1]] = term[order][::-1]
    rank = np.lexsort((heaviest[owners[head]], mean))
    head, mean, size = owners[head][rank], mean[rank], size[rank]
    place = np.full(n, -1)
    place[head] = np.arange(len(head))
    one = place[doc] >= 0
    doc, term, weight = place[doc[one]], term[one], weight[one]
    model = Examples(terms, weights, ids[head], mean, prior, none).index(doc, term, weight)
    order = np.argsort(doc, kind="stable")
    term, weight, cut = term[order], weight[order], np.searchsorted(doc[order], np.arange(len(head) + 1))
    some = np.arange(0, len(head), -(-len(head) // CALIBRATION_ROWS))
    votes = np.array([model.vote(*model.nearest(term[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]], k)) for k in some])
    model.knots = _isotonic(votes, mean[some], size[some])
    return model


def _score_rows(model: Examples | None, names: list[str], score_name: str, examples_name: str):
    def run(batches):
        for batch in batches:
            for lo, hi, doc, term in _terms(batch.column("text")):
                n = hi - lo
                score, near = np.full(n, model.none if model else 0.0), [[]] * n
                if model and len(model.terms):
                    at = np.minimum(np.searchsorted(model.terms, term), len(model.terms) - 1)
                    hit = model.terms[at] == term
                    key, count = np.unique(doc[hit] * len(model.terms) + at[hit], return_counts=True)
                    owner = key // len(model.terms)
                    for a, b in _runs(owner):
                        who, cosine = model.nearest(*model.vector(key[a:b] % len(model.terms), count[a:b]))
                        score[owner[a]] = model.calibrated(model.vote(who, cosine))
                        near[owner[a]] = model.ids[who[:EVIDENCE]].tolist()
                own = [batch.column(c).slice(lo, n) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(score), pa.array(near, pa.list_(pa.int64()))], [*names, score_name, examples_name]
                )

    return run


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return list(zip(first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, texts: DataFrame | None = None, score: str = "score", examples: str = "examples"
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``examples`` (ids of the nearest labelled examples), under free names. ``texts``: the documents
    that labels speak of, if others than ``docs``."""
    sample = F.broadcast(learnable(labels, "toxic", MAX_ROWS))
    known = (docs if texts is None else texts).select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"])
    spread = known.repartition("doc_id")  # a few thousand texts, used twice
    model = docs.sparkSession.sparkContext.broadcast(fit(spread))
    names = docs.columns

    def run(batches):
        return tidy(_score_rows(model.value, names, score, examples))(batches)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score}` double, `{examples}` array<long>")


def flagged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence per row of ``docs``."""
    return score_toxicity(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "examples"
    )
