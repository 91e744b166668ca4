"""Registered queries of the subpackage on the smallest tables."""

import random

import numpy as np
import pytest
from oracle_compare import compare, connect

from lintlake.llm import near_copies
from lintlake.llm.frames import row_key, stash
from lintlake.llm.queries import ORACLES, QUERIES
from lintlake.llm.simhash import connected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok is not False, note


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = corpus_pipeline.stash(out, name)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 100


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    body = " ".join(f"w{k}" for k in range(200))
    rows = [(5, body, "en", "s", 1), (3, body, "en", "s", 1), (3, body, "en", "s", 1), (9, "quite another text of some words", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 9), (True, 0)]


def test_near_dedup_stage_finds_edited_copies(spark):
    """Pairs of texts at a five-word Jaccard similarity of 0.8 and more lose one side; pairs below 0.8 stay."""
    import random

    import corpus_pipeline

    rng = random.Random(4)
    rows, far = [], 0

    def grams(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        edited = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(1, 11)):
            edited[at] = f"x{rng.randrange(10**6)}"
        a, b = grams(words), grams(edited)
        far += len(a & b) < 0.8 * len(a | b)
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(edited), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()}
    assert 0 < far < 60 and kept >= {2 * k for k in range(120)} and len(kept) == 120 + far


def test_near_dedup_stage_joins_a_large_group(spark):
    import corpus_pipeline

    body = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*body[:k], f"x{k}", *body[k + 1 :]]), "en", "s", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()] == [0]


def test_stages_keep_the_types_and_values_of_other_columns(spark):
    """An int ``n_chars`` and columns called as the stages' own counts."""
    import corpus_pipeline

    rows = [(k, f"shared line\ntext number {k} of some words", "en", f"s{k % 3}", 7, f"x{k}", 1.5) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_lines string, n_dropped double")
    clean = corpus_pipeline.drop_common_lines(spark, docs, SF)
    assert clean.dtypes == docs.dtypes
    assert {(r.n_chars == len(r.text), r.n_lines == f"x{r.doc_id}", r.n_dropped) for r in clean.collect()} == {(True, True, 1.5)}
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    assert mixed.dtypes == docs.dtypes
    assert {r.n_chars == len(r.text) for r in mixed.collect()} == {True}


def test_near_copies_in_large_buckets_lose_no_link(spark):
    """A family of texts that share most of their shingles, so that all fall into the same buckets, with pairs of near copies in it."""
    rng = random.Random(2)
    common, texts = [f"c{k}" for k in range(170)], []
    for k in range(400):
        own = [f"o{k}x{j}" for j in range(30)]
        edited = list(own)
        for j in (4, 14, 24)[: 1 + k % 3]:
            edited[j + rng.randrange(3)] = f"e{k}x{j}"
        texts += [" ".join(common + own), " ".join(common + edited)]
    # copies that are all near to each other, of different lengths
    texts += [" ".join([f"d{j}" for j in range(60)] + [f"n{k}"] * (k % 4)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = stash(docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(near_copies._band_rows, "doc_id long, row_key long, sign long, n long, bands array<long>"), "bands")
    sets = {r.sign: set(r.shingles) for r in docs.select("text").mapInArrow(near_copies._set_rows, "sign long, shingles array<long>").collect()}
    signs, up = sorted(sets), {s: s for s in sets}

    def top(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(signs):
        for b in signs[:i]:
            common_ = len(sets[a] & sets[b])
            if common_ >= 0.8 * (len(sets[a]) + len(sets[b]) - common_):
                up[max(top(a), top(b))] = min(top(a), top(b))
    want = {s: top(s) for s in signs if any(top(o) == top(s) for o in signs if o != s)}
    linked = stash(near_copies.links(docs, rows), "links")
    assert {r.node: r.component for r in connected(linked).collect()} == want
    alone = spark.createDataFrame([], "node long, component long")
    pairs = {(r.a, r.b) for r in near_copies.apart(stash(docs.select("text").mapInArrow(near_copies._set_rows, "sign long, shingles array<long>").dropDuplicates(["sign"]), "s"), alone).collect()}
    exact = {(b, a) for i, a in enumerate(signs) for b in signs[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert exact <= pairs


def test_near_copies_meet_through_their_fingerprints(spark):
    """SimHash candidates: the bits are the majority's, and all fingerprints within three bits are joined."""
    rng = np.random.default_rng(4)
    texts = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        texts += [" ".join(words), " ".join([*words[:-1], f"other{k}"])]
    docs = spark.createDataFrame(list(enumerate([*texts, "", None, "one"])), "doc_id long, text string").repartition(4)
    rows = docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(near_copies._band_rows, "doc_id long, row_key long, sign long, n long, bands array<long>")
    one = stash(rows.dropDuplicates(["sign"]), "one")
    prints = {r.sign: r.bands[-1] % 2**64 for r in one.collect() if r.n}
    sets = {r.sign: np.array(r.shingles, np.int64) for r in docs.select("text").mapInArrow(near_copies._set_rows, "sign long, shingles array<long>").collect()}
    for sign, fp in prints.items():
        mixed = near_copies.T.mix(sets[sign].view(np.uint64)).tolist()
        assert fp == sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in mixed) > len(mixed))
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert len(prints) == 81 and len(near) >= 20 and {(r.a, r.b) for r in near_copies.print_pairs(one).collect()} == near


def test_prefixes_are_the_rarest_shingles(spark):
    sets = spark.createDataFrame([(k, [*range(50), *range(1000 + 10 * k, 1010 + 10 * k), 5000 + k // 2]) for k in range(40)], "sign long, shingles array<long>")
    counts = near_copies._slot_counts(sets)
    assert counts[0] == 40 and counts[1000] == 1 and counts[5000] == 2 and counts.sum() == 40 * 61
    rows = sets.mapInArrow(near_copies._prefix_rows(counts), "token long, sign long, n long, at long, starts boolean").collect()
    assert {(r.token, r.sign) for r in rows if r.at == 10} == {(5000 + k // 2, k) for k in range(40)}
    assert {r.at for r in rows} == {10, 11, 12} and not any(r.starts for r in rows)
