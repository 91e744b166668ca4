"""Snapshot drift: changed and grown files, symbol diffs, named snapshots, drift scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lintlake.functions.scalars import content_hash, growth_advice, line_count

FILE = ["repo", "path"]
SUBSYSTEM_WORDS = ["manager", "engine", "bridge", "handler", "service", "provider", "agent"]  # fixed values


def snapshot(files: DataFrame) -> DataFrame:
    """(repo, path, content_hash, line_count) of every file."""
    return files.select(
        *FILE, content_hash(F.col("content")).alias("content_hash"), line_count(F.col("content")).alias("line_count")
    )


def changed_files(cur: DataFrame, base: DataFrame) -> DataFrame:
    """Files present in both with another hash."""
    old = base.select(*FILE, F.col("content_hash").alias("base_hash"))
    return cur.join(old, FILE).filter(F.col("content_hash") != F.col("base_hash")).select(
        *FILE, "base_hash", F.col("content_hash").alias("cur_hash")
    )


def _paired(cur: DataFrame, base: DataFrame) -> DataFrame:
    old = base.select(*FILE, F.col("line_count").alias("base_lines")).filter(F.col("base_lines") > 0)
    change = (F.col("line_count") - F.col("base_lines")) * 100.0 / F.col("base_lines")
    return cur.join(old, FILE).select(*FILE, "base_lines", F.col("line_count").alias("cur_lines"), change.alias("change_pct"))


def growth(cur: DataFrame, base: DataFrame) -> DataFrame:
    """Files grown by more than 50 % (medium) or 100 % (high), with advice."""
    pct = F.col("change_pct")
    return (
        _paired(cur, base).filter(pct > 50)
        .withColumn("level", F.when(pct > 100, "high").otherwise("medium"))
        .withColumn("advice", growth_advice(pct))
    )


def subsystems(files: DataFrame) -> DataFrame:
    """The first public class, in line order, of files whose name or directories carry a subsystem word."""
    words = F.lower(F.regexp_replace("path", r"\.[^./]*$", "")).rlike("|".join(SUBSYSTEM_WORDS))
    heads = F.filter(F.split("content", "\n"), lambda line: line.rlike(r"^\s*class [^_(][^(]*\("))
    name = F.regexp_extract(F.get(heads, F.lit(0)), r"class\s+([^(]+?)\s*\(", 1)
    private = F.element_at(F.split("path", "/"), -1).startswith("_")
    return files.filter(words & ~private).select(*FILE, name.alias("class_name")).filter("class_name <> ''")


def subsystem_spikes(files: DataFrame, cur: DataFrame, base: DataFrame) -> DataFrame:
    """Subsystem files whose line count moved by more than 50 % either way."""
    moved = _paired(cur, base).filter(F.abs("change_pct") > 50)
    return moved.join(subsystems(files), FILE)


def snapshot_totals(snap: DataFrame) -> DataFrame:
    """A27."""
    return snap.groupBy("repo").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("total_lines"))


def totals_drift(cur: DataFrame, base: DataFrame) -> DataFrame:
    """File count below 90 % or above 130 %, line count below 90 % of the base."""
    c = snapshot_totals(cur)
    b = snapshot_totals(base).withColumnsRenamed({"file_count": "base_files", "total_lines": "base_lines"})
    n, m = F.col("file_count"), F.col("base_files")
    kinds = F.array_compact(F.array(
        F.when(n < m * 0.9, "file_count_drop").when(n > m * 1.3, "file_count_surge"),
        F.when((F.col("base_lines") > 0) & (F.col("total_lines") < F.col("base_lines") * 0.9), "line_count_drop"),
    ))
    return c.join(b, "repo").select("repo", "file_count", "base_files", "total_lines", "base_lines", F.explode(kinds).alias("kind"))


def capped_report(rows: DataFrame, group: str, caps: dict[str, int], order: list[Column]) -> DataFrame:
    """The first k rows per class plus one "n more" row for the rest; the counts cover all rows.

    Each class is a distributed top-k, so a class with most of the rows needs no window.
    """
    out = None
    for name, k in caps.items():
        top = rows.filter(F.col(group) == name).orderBy(*order).limit(k).select(
            F.lit(name).alias(group), "path", F.lit(0).cast("long").alias("more")
        )
        out = top if out is None else out.unionByName(top)
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    rest = rows.filter(F.col(group).isin(*caps)).groupBy(group).agg(F.count("*").alias("n")).select(
        group, F.lit("").alias("path"), (F.col("n") - limit[F.col(group)]).alias("more")
    ).filter("more > 0")
    return out.unionByName(rest)


def drift_score(rows: DataFrame) -> DataFrame:
    """100 - 20·high - 10·medium - 5·hub - 2·changed per repo, floor 0, over ``rows(repo, kind)``."""
    penalty = {"high_entropy": 20, "medium_entropy": 10, "dependency_hub": 5, "file_content_changed": 2}
    cost = F.create_map(*[F.lit(x) for kv in penalty.items() for x in kv])
    return rows.groupBy("repo").agg(
        F.greatest(F.lit(100) - F.sum(F.coalesce(cost[F.col("kind")], F.lit(0))), F.lit(0)).cast("long").alias("score")
    )


# --- symbols ----------------------------------------------------------------------------------

def _both(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    o = old.select(*keys, F.lit(True).alias("_old"), *[F.col(v).alias(f"old_{v}") for v in values])
    n = new.select(*keys, F.lit(True).alias("_new"), *[F.col(v).alias(f"new_{v}") for v in values])
    return o.join(n, keys, "full_outer")


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Functions added, deleted, with another async-ness, or modified; (path, name) is unique per side."""
    values = ["is_async", "line_no", "body_hash"]
    kind = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("old_is_async") != F.col("new_is_async"), "async_signature")
        .when((F.col("old_line_no") != F.col("new_line_no")) | (F.col("old_body_hash") != F.col("new_body_hash")), "modified")
    )
    return _both(old, new, ["repo", "path", "name"], values).select(
        "repo", "path", "name", kind.alias("change_type")
    ).filter("change_type IS NOT NULL")


def diff_functions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Functions added, deleted, or modified in signature or else in body."""
    detail = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("old_signature") != F.col("new_signature"), "signature")
        .when(F.col("old_body_hash") != F.col("new_body_hash"), "body")
    )
    kind = F.when(F.col("detail").isin("signature", "body"), "modified").otherwise(F.col("detail"))
    return (
        _both(old, new, ["repo", "path", "name"], ["signature", "body_hash"])
        .withColumn("detail", detail).filter("detail IS NOT NULL")
        .select("repo", "path", "name", kind.alias("change_type"), "detail")
    )


def diff_names(old: DataFrame, new: DataFrame, detail: str) -> DataFrame:
    """Names added or deleted (globals)."""
    return _both(old, new, ["repo", "path", "name"], []).filter("_old IS NULL OR _new IS NULL").select(
        "repo", "path", "name", F.when(F.col("_old").isNull(), "added").otherwise("deleted").alias("change_type"),
        F.lit(detail).alias("detail"),
    )


def diff_imports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Imports of ``(repo, path, module, name, alias)``: new modules, new names in kept modules, lost modules."""
    module = ["repo", "path", "module"]
    pair = [*module, "name", "alias"]
    # both versions are read once and meet in one aggregate; a window holds one file's imports of one module
    sides = old.select(*pair, F.lit(True).alias("_o"), F.lit(False).alias("_n")).unionByName(new.select(*pair, F.lit(False).alias("_o"), F.lit(True).alias("_n")))
    each = sides.groupBy(*pair).agg(F.bool_or("_o").alias("_o"), F.bool_or("_n").alias("_n"))
    here = W.partitionBy(*module)
    known = each.select(
        "*", F.bool_or("_o").over(here).alias("_mo"), F.bool_or("_n").over(here).alias("_mn"), F.row_number().over(here.orderBy("name", "alias")).alias("_at")
    )
    # a null module is no module that is known on the other side, so its names are not new ones in a kept module
    named = F.col("repo").isNotNull() & F.col("path").isNotNull() & F.col("module").isNotNull()

    def row(cond: Column, kind: str, name: Column) -> Column:
        return F.when(cond, F.struct(name.alias("name"), F.lit(kind).alias("change_type"), F.lit("import").alias("detail")))

    first = F.col("_at") == 1
    found = F.array(
        row(first & F.col("_mn") & ~F.col("_mo"), "added", F.col("module")),
        row(first & F.col("_mo") & ~F.col("_mn"), "deleted", F.col("module")),
        row(F.col("_n") & ~F.col("_o") & F.col("_mo") & named, "added", F.concat("module", F.lit("."), "name")),
    )
    return known.select("repo", "path", F.inline(F.array_compact(found)))


def change_rollup(changes: DataFrame) -> DataFrame:
    """Counts by change type, affected files and the risk of many modifications."""
    modified = F.count_if(F.col("change_type") == "modified")
    return changes.groupBy("repo").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "modified", "deleted")],
        F.countDistinct("path").alias("affected_files"),
        F.when(modified > 10, "high").when(modified > 5, "medium").otherwise("low").alias("risk"),
    )


# --- diff statistics --------------------------------------------------------------------------

def read_numstat(lines: DataFrame) -> DataFrame:
    """``added<TAB>removed<TAB>path`` rows; ``-`` counts 0 and unchanged (binary) files drop out."""
    parts = F.split("line", "\t")

    def count(i: int) -> Column:
        return F.when(parts[i] == "-", 0).otherwise(parts[i].try_cast("long"))

    a, r = F.col("added"), F.col("removed")
    return (
        lines.filter(F.size(parts) == 3)
        .select(*[c for c in lines.columns if c != "line"], count(0).alias("added"), count(1).alias("removed"), parts[2].alias("path"))
        .filter((a > 0) | (r > 0))
        .withColumn("change_type", F.when(r == 0, "added").when(a == 0, "deleted").otherwise("modified"))
    )


def diff_size_gate(stats: DataFrame, max_files: int = 3, max_lines: int = 100) -> DataFrame:
    """Change sets with more than 3 files, and files with more than 100 changed lines."""
    total = F.col("added") + F.col("removed")
    many = stats.groupBy("change_id").agg(F.count("*").alias("n")).filter(F.col("n") > max_files).select(
        "change_id", F.lit("").alias("path"), F.lit("too_many_files").alias("kind"), "n"
    )
    large = stats.filter(total > max_lines).select("change_id", "path", F.lit("too_many_lines").alias("kind"), total.alias("n"))
    return many.unionByName(large)


# --- named snapshots --------------------------------------------------------------------------

def compare_named(snapshots: DataFrame, a: str, b: str) -> DataFrame:
    """M9: fields (score, passed, description) that differ between two named snapshots of each repo."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("score", "passed", "description")
    ])
    rows = snapshots.select("repo", "snapshot_id", F.inline(fields))
    left = rows.filter(F.col("snapshot_id") == a).select("repo", "field", F.col("value").alias("from_value"))
    right = rows.filter(F.col("snapshot_id") == b).select("repo", "field", F.col("value").alias("to_value"))
    return left.join(right, ["repo", "field"]).filter(~F.col("from_value").eqNullSafe(F.col("to_value")))
