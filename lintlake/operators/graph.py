"""Dependency graphs: edges, hubs, cycles, layers, callers and change impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.scalars import call_confidence
from lintlake.operators.lines import contains_any, let
from lintlake.operators.ranking import rank_within
from lintlake.operators.scans import top_dir
from lintlake.rules import code_rules, graph_rules as R
from lintlake.session import materialise

MODULE = ["repo", "module"]


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package's __init__ is the package."""
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


# --- G1/G2: edges -----------------------------------------------------------------------------

def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """G1: distinct (repo, src, dst) between internal modules.

    ``imports(repo, src, qualifier, name)``: ``import qualifier`` or ``from qualifier import name``; the longer
    module name wins when both exist.
    """
    statement = ["repo", "src", "qualifier", "name"]
    wanted = imports.select(*statement).distinct()
    full = F.concat_ws(".", "qualifier", "name")
    names = F.array(F.struct(F.lit(0).alias("_k"), full.alias("module")), F.struct(F.lit(1).alias("_k"), F.col("qualifier").alias("module")))
    found = wanted.select(*statement, F.inline(names)).join(modules.select(*MODULE).distinct(), MODULE, "left_semi")
    return found.groupBy(*statement).agg(F.min_by("module", "_k").alias("dst")).select("repo", "src", "dst").distinct()


def call_edges(calls: DataFrame) -> DataFrame:
    """(repo, src, dst, edge_type, confidence) of ``call`` facts, one per enclosing function."""
    owner = F.col("signature")
    dst = F.when(F.col("qualifier") == "attribute", F.concat_ws(".", owner, "name")).otherwise(F.col("name"))
    called = calls.filter(
        (F.col("enclosing") != "") & ((F.col("qualifier") == "name") | ((F.col("qualifier") == "attribute") & (owner != "")))
    )
    confidence = call_confidence(F.col("qualifier"))
    return called.select("repo", "path", F.explode(F.split("enclosing", "/")).alias("fn"), dst.alias("dst"), confidence.alias("confidence")).select(
        "repo", F.concat_ws("::", "path", "fn").alias("src"), "dst",
        F.when(F.col("confidence") >= 0.8, "direct_call").otherwise("indirect_call").alias("edge_type"), "confidence",
    )


def graph_stats(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """A38."""
    e = edges.groupBy("repo").agg(F.count("*").alias("edges"), F.avg("confidence").alias("mean_confidence"), F.countDistinct("src").alias("callers"))
    f = functions.groupBy("repo").agg(F.count("*").alias("functions"))
    return f.join(e, "repo", "left").select(
        "repo", "functions", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("callers", F.lit(0)).alias("callers"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
    )


# --- hubs and core modules --------------------------------------------------------------------

def hubs(statements: DataFrame, least: int = 5, top: int = 10) -> DataFrame:
    """The modules most import statements name, per repo, with rank; ``statements(repo, dst)``."""
    counted = statements.groupBy("repo", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.join(
        rank_within(counted, ["repo"], [("_b", -F.col("n")), ("_p", F.substring("dst", 1, 8))], [F.col("dst")]).select("repo", "dst", "rank"), ["repo", "dst"]
    ).filter(F.col("rank") <= top)


def core_modules(edges: DataFrame) -> DataFrame:
    """Per repo the max(3, n div 10) modules with most distinct importers; ties by name."""
    counted = edges.groupBy("repo", "dst").agg(F.countDistinct("src").alias("importers"))
    limits = counted.groupBy("repo").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 10)).alias("_k"))
    ranked = rank_within(
        counted, ["repo"], [("_b", -F.col("importers")), ("_p", F.substring("dst", 1, 8))], [F.col("dst")]
    )
    return ranked.join(limits, "repo").filter(F.col("rank") <= F.col("_k")).select("repo", F.col("dst").alias("module"), "importers")


def core_depends_on_edge(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Core modules importing a module that is not core."""
    marks = core.select("repo", F.col("module"))
    return (
        edges.join(marks.withColumnRenamed("module", "src"), ["repo", "src"], "left_semi")
        .join(marks.withColumnRenamed("module", "dst"), ["repo", "dst"], "left_anti")
        .select("repo", "src", "dst")
    )


# --- G3: cycles -------------------------------------------------------------------------------

def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose source is also reached and whose target also leads on; others are on no cycle."""
    src, dst = edges.select("src").distinct(), edges.select("dst").distinct()
    return edges.join(dst.withColumnRenamed("dst", "src"), "src", "left_semi").join(src.withColumnRenamed("src", "dst"), "dst", "left_semi")


def _ends(edges: DataFrame) -> DataFrame:
    """(node, f, b): the least of all nodes that lead to each node and the least that it leads to, itself included.

    A round sends labels along one edge, then takes those of two nodes that lead here: of the end of one way, whose length doubles, and of
    the label itself. Node numbers are in random order, so rounds grow by the logarithm of the longest way, whatever the names.
    """
    both = edges.select(F.inline(F.array(
        F.struct(F.lit(True).alias("ahead"), F.col("src").alias("node"), F.col("dst").alias("to")),
        F.struct(F.lit(False).alias("ahead"), F.col("dst").alias("node"), F.col("src").alias("to")),
    )))
    both = materialise(both, "ways")
    ends = both.select("ahead", "node", F.lit(None).cast("long").alias("way")).union(both.select("ahead", "to", "node"))
    own = ends.groupBy("ahead", "node").agg(F.min("way").alias("way"))
    labels = own.select("ahead", "node", F.col("node").alias("label"), F.coalesce("way", "node").alias("way"), F.col("node").alias("old"))
    nothing, changed = F.lit(None).cast("long"), True
    while changed:
        at = labels.select("ahead", "node", "label", "way", F.col("label").alias("old"))
        sent = both.join(at, ["ahead", "node"]).select("ahead", F.col("to").alias("node"), "label", nothing.alias("way"), nothing.alias("old"))
        least = at.unionByName(sent).groupBy("ahead", "node").agg(*[F.min(c).alias(c) for c in ("label", "way", "old")])
        of = least.select("ahead", F.col("node").alias("way"), F.col("label").alias("_label"), F.col("way").alias("_way"))
        further = least.join(of, ["ahead", "way"]).select("ahead", "node", F.least("label", "_label").alias("label"), F.col("_way").alias("way"), "old")
        of = least.select("ahead", F.col("node").alias("label"), F.col("label").alias("_label"))
        jumped = further.join(of, ["ahead", "label"]).select("ahead", "node", F.least("label", "_label").alias("label"), "way", "old")
        labels = materialise(jumped, "labels")
        changed = labels.agg(F.max(F.col("label") < F.col("old"))).first()[0]
    return labels.groupBy("node").agg(F.min(F.when(F.col("ahead"), F.col("label"))).alias("f"), F.min(F.when(~F.col("ahead"), F.col("label"))).alias("b"))


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(repo, module, cycle, modules): every module on a cycle of any length, the smallest module that it shares cycles with, and how
    many do (strongly connected parts).

    Modules get numbers in random order. Where the least number that leads to a module is also the least that the module leads to, its
    part is found; it leaves, and so do edges between modules that differ in one of the two, until no edge is left. Rounds are written
    tables of numbers; no path is listed and no group collected.
    """
    named = materialise(edges.select("repo", "src", "dst").distinct(), "named")
    modules = named.select("repo", F.col("src").alias("module")).union(named.select("repo", "dst")).distinct()
    # the hash of one long is a bijection, so the numbers stay distinct
    nodes = materialise(modules.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "nodes")
    by_src, by_dst = (nodes.select("repo", F.col("module").alias(c), F.col("node").alias(f"_{c}")) for c in ("src", "dst"))
    pairs = named.filter("src <> dst").join(by_src, ["repo", "src"]).join(by_dst, ["repo", "dst"])
    rest = materialise(_trim(pairs.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))), "edges")
    found = None
    while not rest.isEmpty():
        ends = materialise(_ends(rest), "ends")
        part = ends.filter("f = b").select("node", F.col("f").alias("part"))
        found = part if found is None else found.unionByName(part)
        open_ = ends.filter("f <> b")
        here, there = (open_.select(F.col("node").alias(c), "f", "b") for c in ("src", "dst"))
        left = rest.join(here, "src").join(there, ["dst", "f", "b"]).select("src", "dst")
        rest = materialise(_trim(left), "edges")
    loops = named.filter("src = dst").select("repo", F.col("src").alias("module"))
    alone = loops.select("repo", "module", F.col("module").alias("cycle"), F.lit(1).cast("long").alias("modules"))
    if found is None:
        return alone
    members = found.join(nodes, "node")
    sizes = members.groupBy("part").agg(F.count("*").alias("modules"), F.min("module").alias("cycle")).filter("modules > 1")
    shared = materialise(members.join(sizes, "part").select("repo", "module", "cycle", "modules"), "cycles")
    return shared.unionByName(alone.join(shared, MODULE, "left_anti"))


def cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Simple cycles, each once, starting at its smallest module; all of them, or those of at most ``max_len`` modules.

    Paths only grow to modules greater than their start and inside one strongly connected part, so every cycle has one rotation and no
    path leaves the cycles. The number of simple cycles can be exponential in a dense graph; ``cycle_groups`` needs no listing.
    """
    groups = cycle_groups(edges).select("repo", "module", "cycle")
    a, b = (groups.select("repo", F.col("module").alias(c), F.col("cycle").alias(f"_{c}")) for c in ("src", "dst"))
    inside = edges.select("repo", "src", "dst").distinct().join(a, ["repo", "src"]).join(b, ["repo", "dst"]).filter("_src = _dst")
    e = materialise(inside.select("repo", "src", "dst"), "edges")
    step = e.select("repo", F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = materialise(e.filter("dst >= src").select("repo", F.array("src").alias("path"), F.col("dst").alias("next")), "paths")
    found, length = None, 1
    while not paths.isEmpty():
        start = F.col("path")[0]
        closed = paths.filter(F.col("next") == start).select("repo", "path")
        found = closed if found is None else found.unionByName(closed)
        if length == max_len:
            break
        open_ = paths.filter((F.col("next") > start) & ~F.array_contains("path", F.col("next")))
        grown = open_.select("repo", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
        paths = materialise(grown.join(step, ["repo", "last"]).filter(F.col("next") >= F.col("path")[0]).select("repo", "path", "next"), "paths")
        length += 1
    found = paths.select("repo", "path").limit(0) if found is None else found
    return found.select("repo", F.concat_ws(">", "path").alias("cycle"), F.size("path").cast("long").alias("length"))


# --- callers and impact -----------------------------------------------------------------------

def callers(nodes: DataFrame, edges: DataFrame, name: str, language: str = "typescript") -> DataFrame:
    """Nodes calling any node called ``name``."""
    targets = nodes.filter((F.col("name") == name) & (F.col("language") == language)).select(F.col("id").alias("target"))
    calls = edges.filter("kind = 'calls'").join(targets, "target", "left_semi").select(F.col("source").alias("id"))
    return nodes.join(calls.distinct(), "id")


def impact(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers of each changed function by confidence, and the risk; ``edges(repo, src, dst, confidence)``."""
    calls = edges.groupBy("repo", "src", "dst").agg(F.max("confidence").alias("confidence"))
    direct = F.count_if(F.col("confidence") >= 0.8)
    total, weight = F.count("*"), F.sum("confidence")
    return (
        changes.select("repo", F.col("name").alias("dst")).distinct().join(calls, ["repo", "dst"])
        .groupBy("repo", "dst")
        .agg(
            direct.alias("direct_callers"), (total - direct).alias("indirect_callers"), total.alias("total_callers"),
            F.when((direct >= 5) | (weight >= 4.0), "high").when((direct >= 2) | (total >= 5), "medium").otherwise("low").alias("risk"),
        )
    )


def text_callers(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Code lines calling a changed name, definitions and lines with ``#`` left out; (repo, path, line_no, name)."""
    called = F.array_distinct(F.expr("regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)[(]', 1)"))
    words = lines.filter(F.col("line").contains("(") & ~F.col("line").contains("#")).select(
        "repo", "path", "line_no", "line", F.explode(called).alias("name")
    )
    hit = words.join(names.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    return hit.filter(
        ~F.col("line").contains(F.concat(F.lit("def "), "name")) & ~F.col("line").contains(F.concat(F.lit("class "), "name"))
    ).select("repo", "name", F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("caller"))


def preflight(changes: DataFrame, graph_callers: DataFrame, found_callers: DataFrame) -> DataFrame:
    """Risk of each change by its kind and number of callers, from the graph and from the text.

    Both caller tables are (repo, name, caller).  All text callers count; the counts only matter up to 6, so
    they are the risks of a list cut at 20.
    """
    both = graph_callers.select("repo", "name", "caller").unionByName(found_callers.select("repo", "name", "caller"))
    counts = both.groupBy("repo", "name").agg(F.countDistinct("caller").alias("n"))
    n, kind = F.coalesce("n", F.lit(0)), F.col("change_type")
    risk = (
        F.when((kind == "async_signature") & (n > 0), "critical").when(kind == "async_signature", "high")
        .when((kind == "deleted") & (n > 5), "critical").when(kind == "deleted", "high")
        .when(n > 3, "high").when(n > 0, "medium").otherwise("low")
    )
    return changes.join(counts, ["repo", "name"], "left").filter((n > 0) | (kind == "async_signature")).select(
        "repo", "name", "change_type", n.alias("callers"), risk.alias("risk")
    )


def impact_2hop(nodes: DataFrame, edges: DataFrame, name: str, language: str = "typescript") -> DataFrame:
    """Files calling ``name``, files calling the functions in those files, and the risk."""
    typed = nodes.filter(F.col("language") == language)
    calls = edges.filter("kind = 'calls'").select("source", "target").distinct()
    files = nodes.select(F.col("id").alias("source"), "file_path")

    def calling(targets: DataFrame) -> DataFrame:
        hit = calls.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
        return hit.join(files, "source").select("file_path").distinct()

    direct = calling(typed.filter(F.col("name") == name))
    names = nodes.filter(F.col("kind").isin("function", "method")).join(direct, "file_path", "left_semi").select("name").distinct()
    second = calling(typed.join(names, "name", "left_semi"))
    both = direct.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    total = F.col("direct_files") + F.col("indirect_files")
    return both.agg(F.count_if(F.col("hop") == 1).alias("direct_files"), F.count_if(F.col("hop") == 2).alias("indirect_files")).withColumn(
        "risk", F.when(total > 10, "high").when(total > 3, "medium").otherwise("low")
    )


def graph_filter(nodes: DataFrame, kind: str | None = None, name: str | None = None, file: str | None = None) -> DataFrame:
    """Nodes by kind and by text in name and file."""
    for column, text in (("name", name), ("file_path", file)):
        if text:
            nodes = nodes.filter(F.lower(F.col(column)).contains(text.lower()))
    return nodes.filter(F.col("kind") == kind) if kind else nodes


def edge_filter(edges: DataFrame, source=None, target=None, kind: str | None = None, cap: int | None = None) -> DataFrame:
    """Edges by source, target and kind; all of them, or the first ``cap`` by ids."""
    for column, value in (("source", source), ("target", target), ("kind", kind)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    return edges.orderBy("source", "target", "kind").limit(cap) if cap else edges


# --- layers -----------------------------------------------------------------------------------

def _in_layer(path: Column, dirs: list[str]) -> Column:
    cond = F.lit(False)
    for d in dirs:
        cond = cond | path.startswith(d) | path.contains(f"/{d}/")
    return cond


def _untested(imports: DataFrame) -> DataFrame:
    return imports.filter(~F.col("path").contains("/test") & ~F.col("path").startswith("test"))


def layer_violations(imports: DataFrame) -> DataFrame:
    """Imports a layer must not have, singular or plural, once per (file, layer, word)."""
    path, mod = F.col("path"), F.split("qualifier", "\\.")[0]
    rows = F.array_compact(F.array(*[
        F.when(
            _in_layer(path, dirs) & mod.isin(word, word.rstrip("s"), word + "s"),
            F.struct(F.lit(layer).alias("layer"), F.lit(word).alias("forbidden")),
        )
        for layer, dirs, words in R.LAYERS for word in words
    ]))
    return _untested(imports).select("repo", "path", F.inline(rows)).dropDuplicates(["repo", "path", "layer", "forbidden"])


def layer_crosstab(imports: DataFrame) -> DataFrame:
    """Imports from layer to layer."""
    path, mod = F.col("path"), F.split("qualifier", "\\.")[0]
    rows = F.array_compact(F.array(*[
        F.when(
            _in_layer(path, dirs) & mod.isin(*others, *[o.rstrip("s") for o in others]),
            F.struct(F.lit(src).alias("src_layer"), F.lit(dst).alias("dst_layer")),
        )
        for src, dirs, _ in R.LAYERS for dst, others, _ in R.LAYERS if src != dst
    ]))
    return _untested(imports).select(F.inline(rows)).groupBy("src_layer", "dst_layer").agg(F.count("*").alias("imports"))


def forbidden_import_lines(lines: DataFrame) -> DataFrame:
    """Import lines of api/services/repositories naming a module their directory must not import."""
    top, text = top_dir(F.col("path")), F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = F.array_compact(F.array(*[
        F.when(
            (top == d) & (text.contains(f"import {w}") | text.contains(f"from {w}")),
            F.struct(F.lit(d).alias("top_dir"), F.lit(w).alias("module")),
        )
        for d, words in code_rules.CANNOT_IMPORT.items() for w in words
    ]))
    return lines.filter(text.rlike("^(import |from )")).select("repo", "path", "line_no", F.inline(rows))


# --- names: missing imports, unused exports, async safety ---------------------------------------

FACT = ["repo", "path", "name"]


def _called_names(facts: DataFrame) -> DataFrame:
    calls = facts.filter("kind = 'call'")
    owner = F.col("signature")
    name = F.when(F.col("qualifier") == "name", F.col("name")).when(
        (F.col("qualifier") == "attribute") & (owner != "") & ~owner.isin("self", "cls", "super"), owner
    )
    return calls.select("repo", "path", name.alias("name"), "line_no").filter("name IS NOT NULL")


def missing_imports(facts: DataFrame) -> DataFrame:
    """Calls of names that are no builtin and that the file neither defines, assigns nor imports."""
    bound = facts.filter(F.col("kind").isin("def", "class", "arg", "assign", "import")).select(*FACT)
    packages = facts.filter("kind = 'import'").select("repo", "path", F.split("qualifier", "\\.")[0].alias("name"))
    builtin = F.col("name").isin(R.NEEDS_NO_IMPORT)
    return _called_names(facts).filter(~builtin).join(bound.unionByName(packages).distinct(), FACT, "left_anti")


def definition_hint(missing: DataFrame, facts: DataFrame) -> DataFrame:
    """For each missing name the first file of the same directory that defines it, by path."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    defined = (
        facts.filter(F.col("kind").isin("def", "class")).select("repo", folder.alias("_dir"), "name", F.col("path").alias("_at")).distinct()
    )
    place = ["repo", "_dir", "name"]
    # the two smallest paths decide: the second one serves the file that holds the first
    first = defined.groupBy(*place).agg(F.min("_at").alias("_first"))
    second = defined.join(first, place).filter("_at > _first").groupBy(*place).agg(F.min("_at").alias("_second"))
    wanted = missing.select(*FACT).distinct().withColumn("_dir", folder)
    return wanted.join(first, place, "left").join(second, place, "left").select(
        *FACT, F.when(F.col("_first") != F.col("path"), F.col("_first")).otherwise(F.col("_second")).alias("defined_in")
    )


def unused_exports_python(facts: DataFrame) -> DataFrame:
    """Names in ``__all__`` the file defines but never uses."""
    exports = facts.filter("kind = 'export'").select(*FACT, "line_no")
    defined = facts.filter(F.col("kind").isin("def", "class", "assign")).select(*FACT).distinct()
    used = facts.filter((F.col("kind") == "use") | ((F.col("kind") == "assign") & (F.col("qualifier") != "handler"))).select(*FACT).distinct()
    return exports.groupBy(*FACT).agg(F.min("line_no").alias("line_no")).join(defined, FACT, "left_semi").join(used, FACT, "left_anti")


def _tokens_but(line: Column, name: Column) -> Column:
    words = F.regexp_extract_all(line, F.lit(r"(\w+)"), F.lit(1))
    return F.when(name == "", words).otherwise(F.array_remove(words, name))


def unused_exports_text(files: DataFrame) -> DataFrame:
    """TypeScript and Go names exported but used on no other code line of the file (a map, no shuffle)."""
    def declared(line: Column) -> Column:
        go = F.concat(F.regexp_extract(line, R.GO_EXPORT, 1), F.regexp_extract(line, R.GO_EXPORT, 2))
        return F.when(F.col("ext") == "go", go).otherwise(F.regexp_extract(line, R.TS_EXPORT, 1))

    def unused(lines: Column) -> Column:
        code = F.filter(lines, lambda line: ~line.rlike(r"^\s*(//|/\*)"))
        # commented-out TypeScript exports are exports too, as the pattern reads the whole text
        source = F.when(F.col("ext") == "go", code).otherwise(lines)
        names = F.filter(F.transform(source, declared), lambda n: n != "")
        used = F.flatten(F.transform(code, lambda line: _tokens_but(line, declared(line))))

        def once(all_names: Column) -> Column:
            free = F.array_except(all_names, used)
            return F.filter(free, lambda n: (F.col("ext") != "go") | (F.size(F.filter(all_names, lambda m: m == n)) == 1))

        return let(names, lambda all_names: F.when(F.size(all_names) > 0, once(all_names)))

    rows = let(F.split("content", "\n"), unused)
    return files.filter(F.col("ext").isin("ts", "go")).select("repo", "path", F.explode(rows).alias("name"))


def unused_exports_repo(lines: DataFrame) -> DataFrame:
    """TypeScript exports no line of the repo uses but their own; ``lines(repo, path, ext, line_no, line)``."""
    ts = lines.filter("ext = 'ts'")
    name = F.when(~F.col("line").rlike(r"^\s*//"), F.regexp_extract("line", R.TS_EXPORT_WIDE, 1)).otherwise("")
    tagged = ts.withColumn("_name", name)
    exports = tagged.filter("_name <> ''").select("repo", F.col("_name").alias("name")).distinct()
    words = tagged.select("repo", F.explode(F.array_distinct(_tokens_but(F.col("line"), F.col("_name")))).alias("name"))
    # only the exported names among all words of the corpus go on
    used = words.join(exports.select("repo", "name").distinct(), ["repo", "name"], "left_semi").distinct()
    return exports.join(used, ["repo", "name"], "left_anti")


def async_safety(facts: DataFrame) -> DataFrame:
    """Dropped tasks, dropped fetch results, and async functions called unawaited in sync functions."""
    calls = facts.filter("kind = 'call'")
    dropped = F.col("body_hash") == "dropped"
    task = (F.col("qualifier") == "attribute") & (F.col("name") == "create_task") & dropped & ~F.col("is_awaited")
    fetched = F.col("is_awaited") & dropped & contains_any(F.lower("name"), R.FETCH_WORDS)
    simple = calls.withColumn("rule", F.when(task, "fire_and_forget").when(fetched, "discarded_await")).filter("rule IS NOT NULL")
    defs = facts.filter("kind = 'def'").select("repo", "path", "name", "is_async").distinct()
    coroutines = defs.filter("is_async").drop("is_async")
    sync = defs.filter("NOT is_async").select("repo", "path", F.col("name").alias("_fn"))
    unawaited = (
        calls.filter("NOT is_awaited AND enclosing <> '' AND qualifier IN ('name', 'attribute')")
        .join(coroutines, FACT, "left_semi")
        .withColumn("_fn", F.explode(F.split("enclosing", "/")))
        .join(sync, ["repo", "path", "_fn"], "left_semi")
        .withColumn("rule", F.lit("sync_calls_async"))
    )
    columns = ["repo", "path", "line_no", "name", "rule"]
    return simple.select(*columns).unionByName(unawaited.select(*columns))
