"""Stored trees against a plain outer join; equal directories are not read."""

import random

import pytest

from lintlake.sources.trees import changed_directories, read_tree, store_tree, tree_changes

SCHEMA = "repo string, path string, content_hash string"


def plain(old, new):
    a, b = ({(r, p): h or "" for r, p, h in side if r is not None and p is not None} for side in (old, new))
    out = set()
    for key in a.keys() | b.keys():
        x, y = a.get(key), b.get(key)
        if x != y:
            out.add((*key, "added" if x is None else "removed" if y is None else "modified", x, y))
    return out


def test_changes_equal_a_plain_join(spark, tmp_path):
    rng = random.Random(4)
    names = ["a", "b", "", "c/d", "c/d/e/f/g", "/x"]
    files = sorted({(f"r{rng.randrange(3)}", f"{rng.choice(names)}/{rng.choice(names)}/f{rng.randrange(30)}".lstrip("/" * rng.randrange(2))) for _ in range(400)})
    old = [(r, p, f"h{rng.randrange(4)}") for r, p in files if rng.random() < 0.9] + [("r0", "top.py", None), (None, "x", "h"), ("r0", None, "h")]
    kept = [(r, p, h if rng.random() < 0.8 else "other") for r, p, h in old if rng.random() < 0.9]
    new = kept + [("r9", "new/one.py", "h")]
    for depth in (0, 1, 3):
        trees = [store_tree(spark.createDataFrame(rows, SCHEMA), str(tmp_path / f"{depth}{n}"), depth, 4) for n, rows in (("o", old), ("n", new))]
        assert {tuple(r) for r in tree_changes(*trees).collect()} == plain(old, new)
        assert tree_changes(trees[0], trees[0]).count() == 0


def test_only_changed_directories_are_read(spark, tmp_path):
    rows = [("r", f"d{k % 50}/s{k % 100}/f{k}.py", "same") for k in range(5000)]
    changed = [(r, p, "new" if p == "d7/s57/f57.py" else h) for r, p, h in rows]
    old = store_tree(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "o"))
    store_tree(spark.createDataFrame(changed[::-1], SCHEMA), str(tmp_path / "n"))
    new = read_tree(spark, str(tmp_path / "n"))
    spots = changed_directories(old, new)
    assert [tuple(r) for r in spots.collect()] == [("r", "d7/s57")]
    below = new.below(spots)
    assert below.count() == 50
    assert "part#" in below._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert [tuple(r) for r in tree_changes(old, new).collect()] == [("r", "d7/s57/f57.py", "modified", "same", "new")]


def test_empty_trees_and_unlike_trees(spark, tmp_path):
    none = store_tree(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    one = store_tree(spark.createDataFrame([("r", "p.py", "h")], SCHEMA), str(tmp_path / "f"))
    assert tree_changes(none, none).count() == 0
    assert [tuple(r) for r in tree_changes(none, one).collect()] == [("r", "p.py", "added", None, "h")]
    assert [tuple(r) for r in tree_changes(one, none).collect()] == [("r", "p.py", "removed", "h", None)]
    with pytest.raises(ValueError):
        changed_directories(one, store_tree(spark.createDataFrame([("r", "p.py", "h")], SCHEMA), str(tmp_path / "g"), depth=1))
