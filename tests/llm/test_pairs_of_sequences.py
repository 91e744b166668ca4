"""Token alignment, source divergence and benchmark decontamination against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lintlake.llm import decontamination, divergence, token_alignment as TA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row string, words int, _row string, spans string, chunk int"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    names = ["The", "the", "naïve", "Straße", "日本語", "it's", "x1", "don't", "ÉCOLE", "école", "K", "a", "b2b", "<|endoftext|>", "<s>", "<0x41>"]
    texts = [None, "", " ", "\n", "a▁b", "x  y", "\n\n a  b\t\tc \n", "foo\r\nbar", " lead", "trail   ", "　", "a b  c", "\x00z", "1" * 300, "word " * 3000]
    texts += [" ".join(rng.choice(names) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n", "."]) for _ in range(60)]
    texts += ["".join(rng.choice(" \n\ta1'sé’.,日") for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [texts[20], texts[20]]
    return [(None if k % 50 == 7 else k, t, [None, "en", "de"][k % 3], [None, "a", "b", "c", ""][k % 5], 1, "x", 2, "y", "s", 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- token alignment --------------------------------------------------------------------------------

def brute_alignment(rows):
    models = TA.Tokens(public_tokenizers.path(TA.BYTE_MODEL), public_tokenizers.path(TA.PIECE_MODEL))
    found, holders = [], Counter()
    for i, text, *_ in rows:
        a = models.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = models.b.encode(text) if text else []
        if any(b"".join(of[x] for x in ids) != (" " + (text or "")).encode() for of, ids in ((models.a_bytes, a), (models.b_bytes, b))):
            a, b = [], []
        ends_a, ends_b = (np.cumsum([len(of[x]) for x in ids]).tolist() for of, ids in ((models.a_bytes, a), (models.b_bytes, b)))
        links, q = [], 0
        for p, (end, x) in enumerate(zip(ends_a, a, strict=True)):
            begin = ends_a[p - 1] if p else 0
            while q and ends_b[q - 1] > begin:
                q -= 1
            while ends_b[q] <= begin:
                q += 1
            while q < len(b) and (ends_b[q - 1] if q else 0) < end:
                links.append((x, b[q]))
                q += 1
        groups, cut_a, cut_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[cut_a:to_a])) + "|" + ",".join(map(str, b[cut_b:to_b])))
            cut_a, cut_b = to_a, to_b
        holders.update(set(links))
        found.append((i, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    return [(i, n_a, n_b, len(groups), len(links), sha(";".join(groups)), sum(holders[x] == top[x[0]] for x in links), sum(holders[x] for x in links))
            for i, n_a, n_b, groups, links in found], holders


def test_alignment(docs, rows, empty):
    want, holders = brute_alignment(rows)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert plain(TA.align(docs).select(columns).collect()) == plain(want)
    assert TA.align(empty).count() == 0
    pairs = TA.linked_ids(docs).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in pairs} == dict(holders)
    groups = TA.token_groups(docs)
    assert groups.count() == sum(x[3] for x in want)
    assert groups.agg(F.sum(F.size("a_ids"))).first()[0] == sum(x[1] for x in want)


def test_many_chunks_and_caches_give_the_same(rows, monkeypatch):
    """Chunks end anywhere and a worker may forget its units at any time."""
    models = TA.Tokens(public_tokenizers.path(TA.BYTE_MODEL), public_tokenizers.path(TA.PIECE_MODEL))
    texts = [r[1] for r in rows]
    whole = models.encode(texts)
    monkeypatch.setattr(TA, "MAX_UNITS", 5)
    parts = [models.encode([t]) for t in texts]
    for side in (0, 1):
        assert np.concatenate([p[0][side] for p in parts]).tolist() == whole[0][side].tolist()


def test_gallop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 1000):
        longer = np.sort(rng.choice(5000, n, replace=False))
        values = rng.integers(-5, 5005, 300)
        for guess in (np.zeros(300, np.int64), np.full(300, max(0, n - 1)), rng.integers(0, n + 1, 300)):
            assert TA.gallop(values, longer, guess).tolist() == np.searchsorted(longer, values).tolist()


# --- source divergence ------------------------------------------------------------------------------

def brute_audit(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts, holders = defaultdict(Counter), Counter()
    groups = sorted({(r[2] or "", r[3] or "") for r in rows})
    for _, text, lang, source, *_ in rows:
        found = term.findall(low(text))
        counts[lang or "", source or ""].update(found)
        holders.update({(lang or "", t) for t in found})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in holders.items() if x == lang and n >= 3]
        mine = [g for g in groups if g[0] == lang]
        whole = Counter()
        for g in mine:
            whole.update(counts[g])

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        shares, of_lang = {g: share(counts[g]) for g in mine}, share(whole)
        part = lambda p, q: (p - q) ** 2 // q
        for g in mine:
            pairs = [(h[1], sum(part(shares[g][t], shares[h][t]) for t in kept)) for h in mine if h != g]
            terms = [(t, part(shares[g][t], of_lang[t])) for t in kept if counts[g][t] and shares[g][t] > of_lang[t]]
            for name, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, name, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return out


@pytest.mark.parametrize(("block", "bundle"), [(2048, 32), (3, 2), (1, 1)])
def test_divergence(docs, rows, empty, block, bundle):
    """Subtrees and bundles of any size give the same rows."""
    got = divergence.audit(docs, block, bundle)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert plain(got.collect()) == plain(brute_audit(rows))
    if block == 2048:
        assert divergence.audit(empty).count() == 0


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 2, 1, 2], [1, 2, 1, 2], [0, 0, 1, 2]])
    trees = divergence.Trees(counts)
    assert trees.roots[0] == trees.roots[1] != trees.roots[2]
    assert [level.shape[1] for level in trees.children] == [2, 2]  # (0,0), (1,2); then two roots
    pair, a, b, times = trees.walk(np.array([0]), np.array([1]))
    assert sorted(zip(a, b, times, strict=True)) == [(1, 1, 2), (2, 2, 2)]


# --- benchmark decontamination ----------------------------------------------------------------------

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (22, "five six seven eight nine ten eleven twelve thirteen fourteen"),
         (3, "Short  item"), (None, "no id here at all"), (4, ""), (5, None), (6, "..."), (7, "Short, ITEM!"), (8, "ÉCOLE naïve"), (9, "lonely")]
TEXTS = [None, "", "...", "one two three four five six seven eight nine ten", "One-Two; THREE four five six seven eight nine ten eleven twelve thirteen fourteen!",
         "before one two three four five six seven eight nine ten eleven after", "short item short item", "a short (item) b", "école naïve ÉCOLE naïve", "no id here at all",
         "lonely", "lonely " * 5000, "one two three four five six seven eight nine", "x", "short item " * 3 + "one two three four five six seven eight nine ten"]


def brute_hits(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for i, text in items:
        w = split(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[p : p + n])].add(i)
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found |= grams[tuple(w[p : p + n])]
        ids = sorted(str(x) for x in found - {None})
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def tainted(spark):
    pairs = [(None if k == 5 else k, t) for k, t in enumerate(TEXTS + TEXTS[3:6])]
    return pairs, spark.createDataFrame([(*p, "en", "s", 1, "x", 2, "y", "s", 3) for p in pairs], SCHEMA).repartition(2)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_contamination(spark, tainted, empty, most):
    """The broadcast set and the shuffled one find the same."""
    pairs, docs = tainted
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert plain(decontamination.contamination(docs, items, max_broadcast=most).collect()) == plain(brute_hits(pairs, ITEMS))
    assert decontamination.contamination(empty, items, max_broadcast=most).count() == 0
    assert decontamination.contamination(docs, items.limit(0), max_broadcast=most).filter("contaminated").count() == 0


def test_removal(spark, tainted):
    pairs, docs = tainted
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontamination.remove_spans(docs, items)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect() if r.doc_id is not None}
    assert texts[0] is None and texts[6] == "" and texts[7] == "a b" and texts[13] == "x" and texts[2] == "..."
    assert decontamination.contamination(clean, items).filter("contaminated").count() == 0
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 12, 13}
    assert 7 in {r.doc_id for r in decontamination.drop_contaminated(docs, items, max_share=0.5).collect()}
