"""Operators over documents against plain versions: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintlake.llm import cover_dedup, line_quality, line_runs, mixing, packing, quality_trees, simhash, spotsigs, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, place int, y string, score string"


def fixture():
    rng = random.Random(5)
    names = [f"w{k}" for k in range(400)] + ["The", "of", "and", "Straße", "naïve", "日本語", "it's", "a b", "<|endoftext|>", "x|y", "#1"]

    def prose(n, every=9):
        return " ".join(rng.choice(names) + ("\n" if rng.random() < 1 / every else "") for _ in range(n))

    passage = " ".join(rng.choice(names) for _ in range(60))
    texts = [None, "", " ", "\n\n", "one", "two words", "The", "\t\x0b\x0cq\r", prose(5000), prose(30), "na " * 200, "é" * 5000]
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(6)] + [passage, passage + " tail"]
    base = [prose(80) for _ in range(12)]
    texts += base + [b.replace("w1 ", "w2 ", 1) for b in base] + base[:3] + ["Shared LINE here\n" + prose(12) + "\n  shared line HERE \t" for _ in range(12)]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    rows += [rows[9], rows[12], (None, base[0]), (None, None), (None, "lonely null id " + base[1][::-1]), (9_000_000_000, base[5] + " more")]
    rng.shuffle(rows)
    return [(i, t, "en", [None, "a", "b", "c"][k % 4] if k % 3 else "a", 1, "x", 1, "y", "s") for k, (i, t) in enumerate(rows)]


ROWS = fixture()
PAIRS = [r[:2] for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    found = [(i, int(len(brute.words(t)) > 25), int("w1" in brute.words(t))) for i, t in PAIRS]
    return spark.createDataFrame([*found, (None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_repeats(docs, empty):
    got = cover_dedup.remove_repeats(docs)
    assert plain(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == plain(brute.repeats(PAIRS))
    assert cover_dedup.remove_repeats(empty).count() == 0


def test_cover_meets_every_offset():
    have = {(a - b) % cover_dedup.PERIOD for a in cover_dedup.COVER for b in cover_dedup.COVER}
    assert have == set(range(cover_dedup.PERIOD))


def test_line_runs(docs, empty):
    got = line_runs.drop_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    hashed = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    assert plain(hashed.collect()) == plain(brute.common_lines(PAIRS, 10))
    assert line_runs.drop_lines(empty).count() == 0


def test_line_runs_of_batches(spark, docs):
    """A key that was found often enough is not counted again; the rows do not depend on the batches."""
    for batches in (1, 4, 7):
        got = line_runs.drop_lines(docs, 3, batches).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        assert plain(got.collect()) == plain(brute.common_lines(PAIRS, 3))
    runs = line_runs.LineRuns(spark, limit=3)
    runs.add(docs)
    seen = runs.common(3).count()
    runs.add(docs)
    assert seen and runs.levels[1][0].filter("n_docs >= 3").count() >= seen
    assert runs.counts().agg(F.max("n_docs")).first()[0] < 2 * brute_most(PAIRS)


def brute_most(pairs):
    from collections import Counter

    return max(Counter(k for _, t in pairs for k in {x.strip("\t\x0b\x0c\r ").lower() for x in (t or "").split("\n")} if k).values())


def test_line_runs_of_a_very_long_text(spark):
    """A million lines in one text; own columns called as the counts stay."""
    text = "\n".join(f"line {k % 600_000}" for k in range(1_000_000))
    rows = [(1, text, "mine")] + [(k, "line 5\nown " + str(k), "mine") for k in range(2, 14)]
    got = line_runs.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    found = {r.doc_id: (r.n_lines, r.n_lines_, r.n_dropped) for r in got.drop("text").collect()}
    assert found[1] == ("mine", 1_000_000, 2) and found[2] == ("mine", 2, 1)


def test_line_runs_are_levelled(spark, docs):
    runs = line_runs.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(docs.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == k))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    whole = line_runs.LineRuns(spark)
    whole.add(docs)
    assert plain(runs.counts().collect()) == plain(whole.counts().collect())


def test_simhash(docs, empty):
    fps = brute.simhash(PAIRS)
    big = float("inf")
    low, node = {}, {}
    for (i, _), f in zip(PAIRS, fps, strict=True):
        low[f] = min(low.get(f, big), big if i is None else i)
    keys = [("n", f) if low[f] == big else low[f] for f in fps]  # fingerprints of one smallest id are one node
    for k, key in enumerate(keys):
        node.setdefault(key, k)
    comp = brute.components([low[f] for f in fps], fps)
    want = [(i, format(f, "016x"), None if c == big else c) for (i, _), f, c in zip(PAIRS, fps, comp, strict=True)]
    got = simhash.near_duplicates(docs)
    assert plain(got.select("doc_id", "fingerprint", "component_id").collect()) == plain(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == got.select("component").distinct().count()


@pytest.mark.parametrize("most", [2, 16384])
def test_near_edges_of_dense_and_sparse_sets(spark, most):
    """Split buckets (a limit of 2) connect the same sets as whole ones."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = {int(c) for c in centre}
    for c in centre[:3]:
        for _ in range(40):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**63, 60)})
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >= 1 << 63 else f) for k, f in enumerate(fps)], "node long, fp long")
    found = dict(simhash.connected(simhash.near_edges(nodes, most)).collect())
    assert [found.get(k, k) for k in range(len(fps))] == brute.components(list(range(len(fps))), fps)


def test_connected_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3 + 1)]
    got = dict(simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {7} and got[4] == 3


def test_line_quality(docs, empty):
    got = line_quality.quality_rules(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert plain(got.select(*cols).collect()) == plain((i, *brute.line_stats(t)) for i, t in PAIRS)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got.collect())
    assert line_quality.quality_rules(empty).count() == 0


def test_line_quality_rejects_depleted_documents(spark):
    common = " ".join(f"menu{k}" for k in range(60))
    rows = [(k, "h", common + "\n" + f"own{k}") for k in range(60)] + [(100 + k, "h", " ".join(f"t{k}x{j}" for j in range(80))) for k in range(40)]
    got = {r.doc_id: (r.n_common_words, r.kept) for r in line_quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[k] == (60, False) for k in range(60)) and all(got[100 + k] == (0, True) for k in range(40))


def test_line_limit_does_not_grow_with_the_host(spark):
    common = " ".join(f"menu{k}" for k in range(60))
    rows = [(k, "h", common + "\n" + f"own{k}") for k in range(30)] + [(100 + k, "h", " ".join(f"t{k}x{j}" for j in range(40))) for k in range(970)]
    got = {r.doc_id: (r.n_common_words, r.kept) for r in line_quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[k] == (60, False) for k in range(30)) and all(got[100 + k] == (0, True) for k in range(970))


@pytest.mark.parametrize("score", [quality_trees.score_quality, toxicity.flagged])
def test_classifier_edges(spark, docs, empty, labels, score):
    got = score(docs, labels).collect()
    assert len(got) == len(PAIRS) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels).collect():
        by_text.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert score(empty, labels).count() == 0
    none = score(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    n, terms = 500, 40
    dense = np.where(rng.random((n, terms)) < 0.1, rng.integers(1, 5, (n, terms)), 0).astype(float)
    dense = dense[dense.any(1)]
    idf = rng.random(terms) + 0.5
    unit = np.where(dense > 0, 1 + np.log(np.maximum(dense, 1)), 0) * idf
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    doc, term = np.nonzero(unit)
    model = toxicity.Examples(np.arange(terms, dtype=np.uint64), idf, np.arange(len(unit)), rng.integers(0, 2, len(unit)).astype(float), 0.5)
    model.index(doc, term, unit[doc, term])
    for k in range(0, len(unit), 17):
        t = np.flatnonzero(dense[k])
        who, cosine = model.nearest(*model.vector(t, dense[k][t]))
        want = unit @ unit[k]
        best = np.lexsort((np.arange(len(want)), -np.round(want, 12)))[: toxicity.NEIGHBOURS]
        assert np.allclose(np.sort(cosine), np.sort(want[best][want[best] > 0]))


def test_toxicity_learns(spark):
    rng = random.Random(2)
    bad = ["dolt", "oaf", "knave"]
    rows, marks = [], []
    for k in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        toxic = k % 8 == 0
        if toxic:
            words[::20] = bad
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    got = toxicity.flagged(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in got.collect()}
    assert all((out[k].predicted == 1) == bool(t) for k, t in marks)
    assert any(r.held_out for r in out.values()) and all(out[k].examples for k, t in marks if t)


def test_toxicity_finds_evidence_for_all(spark):
    rng = random.Random(6)
    rows = [(k, " ".join([f"w{rng.randrange(300)}" for _ in range(80)] + ["dolt"] * (k % 10 == 0))) for k in range(300)]
    marks = spark.createDataFrame([(k, int(k % 10 == 0)) for k, _ in rows], "doc_id long, toxic int")
    texts = dict(rows)
    known = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1000 + k, t) for k, t in rows] + [(2000, ""), (2001, None), (2002, "unheard")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(asked, marks, known).collect()}
    held = {r.doc_id for r in toxicity.flagged(known, marks).collect() if r.held_out}
    for k in texts:
        assert len(got[1000 + k].examples) == toxicity.EVIDENCE
        assert k in held or texts[got[1000 + k].examples[0]] == texts[k]
    assert got[2000].examples == [] and got[2000].score == got[2001].score == got[2002].score
    assert got[2000].score < 0.5


def test_toxicity_postings_are_bounded(spark):
    rows = [(k, 0, " ".join(f"w{j}" for j in range(10))) for k in range(1, 9)] + [(0, 1, " ".join(f"w{j}" for j in range(1000)))]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, y int, text string"), most=80)
    assert len(model.terms) == 0 or len(model.doc) <= 80
    assert model.prior == 0  # the long text is no example
    assert toxicity.fit(spark.createDataFrame(rows[:0], "doc_id long, y int, text string")) is None


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_trees.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    assert len(quality_trees.fit(x[:5], np.ones(5)).score(x)) == 4000


def test_spotsigs_order_and_edit(docs, empty):
    rows = sorted(((i, t or "") for i, t in PAIRS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    # nulls sort first among equal ids; an empty text stands for null here
    want = []
    for k, (i, t) in enumerate(rows):
        following, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()))
    got = spotsigs.edited_and_next(docs).collect()
    assert plain(r[:3] for r in got) == plain(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert spotsigs.edited_and_next(empty).count() == 0


def test_spotsigs_pairs(spark, docs):
    rng = random.Random(8)
    names = [f"w{k}" for k in range(300)] + ["the", "of", "and", "in"] * 40
    base = [" ".join(rng.choice(names) for _ in range(200)) for _ in range(15)]
    rows = [(k, b) for k, b in enumerate(base)] + [(100 + k, b + " w1 w2") for k, b in enumerate(base)] + [(200, ""), (201, None), (202, "the")]
    prints = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).union(spotsigs.fingerprints(docs))
    sets = {r.fingerprint: {r.fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)} for r in prints.collect()}
    keys = sorted(sets)
    want = {frozenset((a, b)) for n, a in enumerate(keys) for b in keys[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {frozenset((r.a, r.b)) for r in spotsigs.near_classes(prints).collect()} == want and want


def test_mixing(docs, empty):
    got = mixing.mix_report(docs).toPandas()
    words = {}
    assert sorted(got["size"]) == sorted(len(brute.words(t)) for _, t in PAIRS)
    assert (got.taken <= 3 * got["size"]).all()
    for size, part in got.groupby("source_size"):
        words[size] = part["size"].sum()
        assert abs(part.taken.sum() - part.target.iloc[0]) <= max(8, 0.03 * part.target.iloc[0])
    again = mixing.mix_report(docs.repartition(2)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(brute.words(r.text)) for r in mixed.collect()) == got.taken.sum()
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100]) == [50.0, 100.0, 150.0]
    assert mixing.targets([1000, 10, 10]) == [960.0, 30.0, 30.0]
    assert mixing.targets([0, 5]) == [0.0, 5.0] and mixing.targets([]) == []


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_packing_round_trip(docs, empty):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for length, shard in ((4096, 4_000_000), (64, 3000)):
        got = packing.pack(docs, length=length, shard_tokens=shard).collect()
        ids = [np.array([*e.ids, 2], "<u4") for e in whole.encode_batch([t or "" for _, t in PAIRS], add_special_tokens=False)]
        assert sum(r.length for r in got) == sum(map(len, ids))
        known = {}
        for (i, _), own in zip(PAIRS, ids, strict=True):
            known.setdefault((i, len(own)), set()).add(own.tobytes())
        for r in got:
            texts = known[r.doc_id, r.doc_tokens]
            assert r.ids_crc32 in {zlib.crc32(t[4 * r.start : 4 * (r.start + r.length)]) for t in texts}
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at == length or at & (at - 1) == 0 and at <= length
    assert packing.pack(empty).count() == 0


def test_words_encode_alone_as_in_their_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    texts = ["a\x85b c d İstanbul ΣΑΣ 日本語 é <|endoftext|>x a<|startoftext|>b \x1cq it's IT'S don't² ¼ ǅ ß ẞ 12345 ﻿x k'll", "", "DE!! une,### Über-Straße"]
    words = packing.Vocabulary(path)
    numbers = [words.numbers(t.encode()) for t in texts]
    words.learn()
    for n, e in zip(numbers, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert words.ids(n).tolist() == e.ids


def test_a_worker_keeps_few_words_between_tasks(monkeypatch):
    from types import SimpleNamespace

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    texts = [" ".join(f"Ab{k * 7 % 97}c{k % 3}, é{k} the-{k} {chr(97 + k % 26) * (k % 9 + 1)}" for k in range(a, a + 40)) for a in range(0, 400, 20)]
    monkeypatch.setattr(packing, "_VOCABULARIES", {})
    monkeypatch.setattr(packing, "MAX_WORDS", 300)
    monkeypatch.setattr(packing, "KEPT_WORDS", 50, raising=False)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = packing.pack(SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda rows, schema: rows)), shard_tokens=500)
    whole = [len(e.ids) + 1 for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second task begins with what the first has kept
        parts = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
        rows = [r for batch in run(iter(parts)) for r in batch.to_pylist()]
        assert [sum(r["length"] for r in rows if r["doc_id"] == k) for k in range(len(texts))] == whole
        words = packing._VOCABULARIES[path]
        assert len(words) <= 50 and len(words.pieces) <= 50 and len(words.flat) < 1000 and len(words.begin) < 1000
    numbers = [words.numbers(t.encode()) for t in texts]
    words.learn()
    for n, e in zip(numbers, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert words.ids(n).tolist() == e.ids


def test_mixed_texts_are_cut_some_rows_at_a_time(monkeypatch):
    plan = [{"begin": 0, "turn": 0, "first": 1, "end": 3}, {"begin": 0, "turn": 1, "first": 0, "end": 4}]
    rows = pa.table({"doc_id": [1, 2, 3, 4, 5], "text": [f"a{k} b  c d" for k in range(5)], "_plan": [plan] * 5}).to_batches()
    want = [(k + 1, t) for k in range(5) for t in ("b  c", f"a{k} b  c d")]
    monkeypatch.setattr(mixing, "CUT_AT_ONCE", 2, raising=False)
    got = list(mixing._cut_rows(["doc_id", "text"], "_plan")(iter(rows)))
    assert [b.num_rows for b in got] == [4, 4, 2]
    assert [(r["doc_id"], r["text"]) for b in got for r in b.to_pylist()] == want


def test_free_memory_goes_back_after_a_task(monkeypatch):
    from lintlake.llm import frames, near_copies

    given = []
    monkeypatch.setattr(frames, "give_back", lambda: given.append(1))
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "row_key": [3, 4], "text": ["a b c d e f", None]})
    got = near_copies._band_rows(iter([rows]))
    assert next(got).num_rows == 2 and not given
    assert not list(got) and given == [1]
    monkeypatch.undo()
    frames.give_back()


def test_neighbours_come_by_score():
    terms = [np.array(t) for t in ([1, 2, 3, 9], [1, 2, 8, 9], [4, 5, 9], [4, 5, 6, 9], [7, 9], [1, 10])]
    shard = packing.Shard(terms)
    shard.take(0)
    assert next(shard.neighbours(0)) == 1
    shard.take(2)
    assert list(shard.neighbours(2)) == [3]


def test_slices_hold_whole_texts():
    from lintlake.llm import text as T

    data, off = T.flat(pa.array(["abc", None, "", "x" * 50, "y"]).slice(1))
    assert data.tobytes() == b"x" * 50 + b"y" and off.tolist() == [0, 0, 0, 50, 51]
    assert list(T.slices(off, 10)) == [(0, 2), (2, 3), (3, 4)] and list(T.slices(np.zeros(1, np.int64))) == []
