"""Stored snapshot trees (J1 on large trees): a snapshot's files under digests of their directories, compared from the root down.

A digest is the count and two sums of 64-bit hashes of the files below, so it does not depend on their order, a parent's is the sum
of its children's, and both are combined before they are shuffled. A comparison walks the levels: only children of nodes that differ are
read on, and only files of directories that differ are joined. Two snapshots that are equal but for one directory cost that directory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.session import materialise

DEPTH, PARTS, SPREAD = 3, 32, 8
NODE = ["repo", "node"]
_FILES = "repo string, path string, content_hash string, node string, part int"
_NODES = "repo string, node string, n long, a decimal(38,0), b decimal(38,0)"


def _directory(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a file's path; all of them where it has fewer."""
    name = F.substring_index(path, "/", -1)
    above = F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1)).otherwise("")
    return F.substring_index(above, "/", depth)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(*NODE), F.lit(parts)).cast("int")


@dataclass
class Tree:
    """A stored snapshot: ``files`` in folders by a hash of their directory, ``nodes`` per level (0 is the repository)."""

    spark: SparkSession
    path: str
    depth: int
    parts: int

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.schema(_NODES).parquet(f"{self.path}/nodes/level={level}")

    def files(self) -> DataFrame:
        """repo, path, content_hash, node (its directory), part."""
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/files")

    def below(self, spots: DataFrame) -> DataFrame:
        """The files of some directories; folders of other parts are not opened. ``spots``: repo, node."""
        held = [r.part for r in spots.select(_part(self.parts).alias("part")).distinct().collect()]  # at most ``parts`` numbers
        return self.files().filter(F.col("part").isin(held)).join(spots, NODE, "left_semi").select("repo", "path", "content_hash")


def store_tree(snapshot: DataFrame, path: str, depth: int = DEPTH, parts: int = PARTS) -> Tree:
    """Write ``snapshot(repo, path, content_hash)`` as a tree below a new ``path``.

    (repo, path) is unique; a null hash counts as an empty one, rows without repo or path are no files. A directory of many files
    is written by up to ``SPREAD`` tasks. The folder is a tree once its ``meta`` is there, which is written last.
    """
    if depth < 0 or parts < 1:
        raise ValueError("a tree has a depth of 0 or more and at least one part")
    spark = snapshot.sparkSession
    rows = snapshot.filter("repo IS NOT NULL AND path IS NOT NULL").select(
        "repo", "path", F.coalesce("content_hash", F.lit("")).alias("content_hash"), _directory(F.col("path"), depth).alias("node")
    ).withColumn("part", _part(parts))
    dealt = rows.repartition("part", F.pmod(F.xxhash64("path"), F.lit(SPREAD))).sortWithinPartitions("part", "repo", "node", "path")
    dealt.write.partitionBy("part").parquet(f"{path}/files")
    tree = Tree(spark, path, depth, parts)
    leaf = [F.xxhash64("repo", "path", "content_hash"), F.xxhash64("content_hash", "path", F.lit(depth), "repo")]
    below = tree.files().select(*NODE, F.lit(1).cast("long").alias("n"), *[h.cast("decimal(38,0)").alias(c) for h, c in zip(leaf, "ab", strict=True)])
    for level in range(depth, -1, -1):
        sums = [F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("a", "decimal(38,0)"), ("b", "decimal(38,0)"))]
        below.withColumn("node", F.substring_index("node", "/", level)).groupBy(*NODE).agg(*sums).write.parquet(f"{path}/nodes/level={level}")
        below = tree.nodes(level)
    spark.range(1).select(F.lit(depth).alias("depth"), F.lit(parts).alias("parts")).write.parquet(f"{path}/meta")
    return tree


def read_tree(spark: SparkSession, path: str) -> Tree:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Tree(spark, path, meta.depth, meta.parts)


def changed_directories(old: Tree, new: Tree) -> DataFrame:
    """(repo, node) of the deepest stored directories whose files differ in any way, on either side."""
    if (old.depth, old.parts) != (new.depth, new.parts):
        raise ValueError("trees of another depth or number of parts cannot be compared")
    spots = None
    for level in range(old.depth + 1):
        o, n = old.nodes(level), new.nodes(level)
        if spots is not None:
            parent = F.substring_index("node", "/", level - 1)
            above = spots.select("repo", F.col("node").alias("_above"))
            o, n = (side.withColumn("_above", parent).join(above, ["repo", "_above"], "left_semi").drop("_above") for side in (o, n))
        same = F.struct("o.n", "o.a", "o.b").eqNullSafe(F.struct("n.n", "n.a", "n.b"))
        spots = materialise(o.alias("o").join(n.alias("n"), NODE, "full_outer").filter(~same).select(*NODE), "spots")
        if spots.isEmpty():
            break
    return spots


def tree_changes(old: Tree, new: Tree) -> DataFrame:
    """repo, path, change (added, removed, modified), base_hash, cur_hash of every file that differs."""
    spots = changed_directories(old, new)
    o = old.below(spots).withColumnRenamed("content_hash", "base_hash")
    n = new.below(spots).withColumnRenamed("content_hash", "cur_hash")
    change = F.when(F.col("base_hash").isNull(), "added").when(F.col("cur_hash").isNull(), "removed").when(F.col("base_hash") != F.col("cur_hash"), "modified")
    return o.join(n, ["repo", "path"], "full_outer").select("repo", "path", change.alias("change"), "base_hash", "cur_hash").filter("change IS NOT NULL")
