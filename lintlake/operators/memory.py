"""The issue-memory tables: statistics, upserts, retention and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lintlake.operators.ranking import rank_within
from lintlake.operators.lines import contains_any
from lintlake.operators.timeline import BLOCK, running
from lintlake.rules import scoring_rules as R
from lintlake.sources.pages import PagedTable
from lintlake.sources.store import KeyedTable, Store


def select_equal(table: DataFrame, **eq) -> DataFrame:
    """Rows equal to every given value."""
    for column, value in eq.items():
        table = table.filter(F.col(column) == value)
    return table


# --- statistics -------------------------------------------------------------------------------

def bug_stats(bugs: DataFrame) -> DataFrame:
    """A5."""
    return bugs.agg(
        F.count("*").alias("total"), F.avg("pain_score").alias("avg_pain"), F.max("pain_score").alias("max_pain"),
        F.min("pain_score").alias("min_pain"), F.sum("occurrence_count").alias("total_occurrences"),
        F.countDistinct("error_type").alias("unique_errors"), F.countDistinct("file_path").alias("affected_files"),
    )


def insight_stats(insights: DataFrame) -> DataFrame:
    """A6."""
    return insights.agg(
        F.count("*").alias("total"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("unapplied"),
        F.avg("confidence").alias("avg_confidence"),
    )


def top_recurring(bugs: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent (type, file) pairs, ties by name."""
    return (
        bugs.groupBy("error_type", "file_path").agg(F.count("*").alias("n"), F.avg("pain_score").alias("avg_pain"))
        .orderBy(F.desc("n"), "error_type", "file_path").limit(n)
    )


def daily_trend(bugs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """A8."""
    return (
        bugs.filter(F.col("first_seen") > now - F.make_interval(days=F.lit(days)))
        .groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("n"), F.avg("pain_score").alias("avg_pain"))
    )


def new_since(bugs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """A9."""
    return bugs.agg(F.count_if(F.col("first_seen") > now - F.make_interval(hours=F.lit(hours))).alias("pending"))


def quality_score(bug_row: DataFrame, insight_row: DataFrame) -> DataFrame:
    """A10: 50 + 20·apply rate and fixed steps, over the one-row results of A5 and A6."""
    b = bug_row.select("avg_pain", "total_occurrences", "unique_errors")
    i = insight_row.select("applied", F.col("total").alias("insights"))
    stacked = b.unionByName(i, allowMissingColumns=True)
    both = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])  # one row each, side by side
    score = (
        F.lit(50.0)
        + F.when(F.col("applied") > 0, F.col("applied") * 20.0 / F.greatest("insights", F.lit(1))).otherwise(0.0)
        + F.when(F.col("avg_pain") > 50, 10).otherwise(0)
        - F.when(F.col("total_occurrences") > 100, 10).otherwise(0)
        - F.when(F.col("unique_errors") > 50, 10).otherwise(0)
    )
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
    s = F.col("score")
    level = F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").otherwise("poor")
    return both.select(clamped.alias("score")).withColumn("level", level)


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def repeat_stats(bugs: DataFrame) -> DataFrame:
    """A12."""
    return bugs.agg(
        F.count("*").alias("total_memories"), F.count_if(F.col("occurrence_count") >= 2).alias("repeated_bugs"),
        F.coalesce(F.avg(F.when(F.col("status") == "active", F.col("avg_pain"))), F.lit(0.0)).alias("avg_pain"),
    )


def repeated_bugs(bugs: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """T3."""
    return bugs.filter((F.col("occurrence_count") >= min_occurrences) & (F.col("status") == "active")).orderBy(
        F.desc("occurrence_count"), F.desc("avg_pain"), "id"
    )


def severity_counts(redlines: DataFrame) -> DataFrame:
    """A51."""
    return redlines.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])


# --- mutations --------------------------------------------------------------------------------

def upsert_lessons(old: DataFrame, new: DataFrame) -> DataFrame:
    """M1: lessons with the same content hash add up; the newest row gives time and summary.

    Rows without a hash are kept as they are.  One map-side combined aggregate, however hot a hash is.
    """
    both = old.unionByName(new)
    newest = F.struct("captured_at", "id")
    merged = (
        both.filter("content_hash <> ''").groupBy("content_hash").agg(
            F.min_by("id", newest).alias("id"), F.min_by("title", newest).alias("title"),
            F.max_by("error_summary", newest).alias("error_summary"), F.sum("failure_count").alias("failure_count"),
            F.max("captured_at").alias("captured_at"),
        )
    )
    return merged.unionByName(both.filter("content_hash = ''"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """M2: insert or replace on ``keys``; the row with the greatest ``version`` column stays."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_row")
    return both.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def admit(errors: DataFrame, seconds: int = BLOCK) -> DataFrame:
    """M3: errors worth remembering: pain >= 50, and low-priority types only with 2 earlier ones in the window.

    The second error before this one is found by its running number, an equi-join on an almost unique key,
    so a hot (type, file) pair is no hot join key.
    """
    worth = errors.filter(F.col("pain") >= R.MIN_PAIN).withColumn("error_type", F.lower("error_type"))
    keys = ["error_type", "file_path"]
    numbered = running(worth, keys, ["ts", "id"], {"_no": F.lit(1).cast("long")}, seconds)
    low = contains_any(F.col("error_type"), R.LOW_PRIORITY_TYPES)
    before = numbered.filter(low).select(*keys, (F.col("_no") + R.MIN_REPEATS).alias("_no"), F.col("ts").alias("_ts"))
    limit = F.col("ts") - F.make_interval(hours=F.lit(R.WINDOW_HOURS))
    return (
        numbered.join(before, [*keys, "_no"], "left")
        .filter(~low | (F.col("_ts") >= limit))
        .select(*worth.columns)
    )


def remember(admitted: DataFrame) -> DataFrame:
    """M3: admitted errors as memories, one per (type, file)."""
    return admitted.groupBy("error_type", "file_path").agg(
        F.min("id").alias("id"), F.count("*").alias("occurrence_count"), F.avg("pain").alias("avg_pain"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def delete_containing(table: DataFrame, text: str, column: str = "id") -> DataFrame:
    """M4: the table without rows whose id contains ``text``."""
    return table.filter(F.col(column).isNull() | ~F.col(column).contains(text))


def expired(now: Column, ts: str, days: int, min_importance: int | None = None) -> Column:
    old = F.col(ts) < now - F.make_interval(days=F.lit(days))
    return old if min_importance is None else old & (F.col("importance") < min_importance)


def retain(table: DataFrame, now: Column, ts: str, days: int, min_importance: int | None = None) -> DataFrame:
    """M5: rows not older than ``days`` (with ``min_importance``, important old rows stay too)."""
    return table.filter(~F.coalesce(expired(now, ts, days, min_importance), F.lit(False)))


def retain_dry_run(table: DataFrame, now: Column, ts: str, days: int, min_importance: int | None = None) -> DataFrame:
    """M5: how many rows ``retain`` would drop."""
    return table.agg(F.count_if(expired(now, ts, days, min_importance)).alias("expired"))


# --- mutations of a stored table --------------------------------------------------------------

#: Lessons with the same content hash share a bucket; those without one need not and are spread.
LESSON_BUCKETS = "if(content_hash = '', concat('id ', id), content_hash)"


def lessons_table(store: Store, name: str = "lessons", buckets: int = 64) -> KeyedTable:
    return KeyedTable(store, name, LESSON_BUCKETS, buckets)


def store_lessons(table: KeyedTable, new: DataFrame, batch: int | None = None) -> bool:
    """M1 on a stored table: only the buckets of the new rows are read and rewritten; a batch that was stored before changes nothing."""
    return table.merge(new, upsert_lessons, batch)


def store_by_key(table: KeyedTable, new: DataFrame, keys: Sequence[str], version: str, batch: int | None = None) -> bool:
    """M2 on a stored table in buckets by (some of) ``keys``."""
    return table.merge(new, lambda old, rows: replace_by_key(old, rows, keys, version), batch)


def delete_stored(table: KeyedTable, text: str, column: str = "id") -> bool:
    """M4 on a stored table; whether a row was deleted."""
    return table.remove(F.col(column).contains(text))


def retain_stored(table: KeyedTable, now: Column, ts: str, days: int, min_importance: int | None = None) -> bool:
    """M5 on a stored table; whether a row was too old."""
    return table.remove(expired(now, ts, days, min_importance))


# --- lookups and reports ----------------------------------------------------------------------

def context_pack(redlines: DataFrame, lessons: DataFrame, templates: DataFrame, limits=(20, 5, 5)) -> DataFrame:
    """T5: the first redlines, lessons and templates as one ordered text (each list is a bounded top-n)."""
    parts = [
        (redlines.orderBy(F.desc("severity"), F.desc("created_at"), "id").limit(limits[0]), "redlines",
         [F.desc("severity"), F.desc("created_at"), F.col("id")], F.concat("title", F.lit(": "), "description")),
        (lessons.orderBy(F.desc("captured_at"), "id").limit(limits[1]), "lessons",
         [F.desc("captured_at"), F.col("id")], F.col("title")),
        (templates.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limits[2]), "templates",
         [F.desc("importance"), F.desc("created_at"), F.col("id")], F.concat(F.lit("["), "domain", F.lit("] "), "title")),
    ]
    out = None
    for top, section, order, text in parts:
        rows = top.select(
            F.lit(section).alias("section"), F.row_number().over(W.orderBy(*order)).alias("rank"), text.alias("text")
        )
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("section").agg(
        F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY rank)").alias("text")
    )


def search(
    proposals: DataFrame, text: str | None = None, limit: int = 20, offset: int = 0, **eq
) -> DataFrame:
    """Text in title, description or path (any case), facets equal, newest first, one page."""
    return (
        filtered(proposals, text, **eq).orderBy(F.desc("created_at"), F.desc("proposal_id")).offset(offset).limit(limit)
    )


def search_after(table: PagedTable, text: str | None = None, limit: int = 20, after: list | None = None, **eq) -> tuple[DataFrame, list | None]:
    """P11 on a table paged by created_at and proposal_id: the page behind a cursor (None: the first) and the next page's cursor.

    Where ``search`` orders all rows that the filters leave, this reads the parts that the page lies in.
    """
    return table.page(limit, after, lambda rows: filtered(rows, text, **eq))


def filtered(proposals: DataFrame, text: str | None = None, **eq) -> DataFrame:
    rows = select_equal(proposals, **eq)
    if text:
        hit = F.lit(False)
        for column in ("title", "description", "file_path"):
            hit = hit | F.lower(F.col(column)).contains(text.lower())
        rows = rows.filter(hit)
    return rows


def facets(proposals: DataFrame) -> DataFrame:
    """Counts by status, by category and in total, in one pass."""
    grouped = proposals.groupingSets([["status"], ["category"], []], "status", "category")
    return grouped.agg(F.grouping_id().alias("_g"), F.count("*").alias("n")).select(
        F.when(F.col("_g") == 1, "status").when(F.col("_g") == 2, "category").otherwise("total").alias("facet"),
        F.coalesce(F.when(F.col("_g") == 1, F.col("status")), F.when(F.col("_g") == 2, F.col("category")), F.lit("all")).alias("value"),
        "n",
    )


def infer_domain(changes: DataFrame) -> DataFrame:
    """The domain most path keywords of a change set vote for; ties go to the first one seen.

    ``changes(change_id, pos, path)``.  First seen = lowest (file position, keyword order).
    """
    path = F.lower("path")
    domains = list(dict.fromkeys(d for _, d in R.DOMAINS))
    # a vote is the number of its keyword; files that vote for nothing keep one empty row
    votes = F.array_compact(F.array(*[F.when(path.contains(word), F.lit(i)) for i, (word, _) in enumerate(R.DOMAINS)]))
    domain_of = F.array(*[F.lit(domains.index(d)) for _, d in R.DOMAINS])
    scored = (
        changes.select("change_id", "pos", F.explode_outer(votes).alias("vote"))
        .groupBy("change_id", F.coalesce(F.get(domain_of, F.col("vote")), F.lit(-1)).alias("d"))
        .agg(F.count("vote").alias("n"), F.min(F.col("pos").cast("long") * 100 + F.coalesce("vote", F.lit(99))).alias("first"))
    )
    best = scored.groupBy("change_id").agg(F.max_by("d", F.struct("n", -F.col("first"))).alias("d"))
    names = F.array(*[F.lit(d) for d in domains])
    return best.select("change_id", F.coalesce(F.get(names, F.col("d")), F.lit("general")).alias("domain"))


def infer_principles(message: Column, has_python: Column, has_tests: Column) -> Column:
    """Principles from the message's words and the mix of files."""
    text = F.lower(message)
    found = F.array_compact(F.array(
        *[F.when(contains_any(text, words), F.lit(name)) for words, name in R.PRINCIPLES],
        F.when(has_python & ~has_tests, F.lit("run_checks")),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("follow_style")))


def ordered_skills(skills: DataFrame) -> DataFrame:
    """T4: the active skills of each tool by falling priority, with rank."""
    active = skills.filter("is_active")
    return rank_within(active, ["tool"], [("_p", -F.col("priority"))], [F.col("id")])
