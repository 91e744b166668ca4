"""Risk scores, feedback calibration, metric windows and rule evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.scalars import glob_match, module_of
from lintlake.operators.lines import contains_any
from lintlake.rules import scoring_rules as R


def level_of(score: Column) -> Column:
    out = None
    for bound, level in R.LEVEL_BANDS:
        out = F.when(score >= bound, level) if out is None else out.when(score >= bound, level)
    return out.otherwise("LOW")


def _clamp(value: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def pain_factors(path: Column, kind: Column, message: Column, adaptive: bool = False) -> dict[str, Column]:
    """The conditions behind each weight, over lower-cased columns."""
    path, kind, message = F.lower(path), F.lower(kind), F.lower(message)

    def said(*words: str) -> Column:
        return contains_any(kind, words) | contains_any(message, words)

    core, critical = (R.ADAPTIVE_CORE, R.ADAPTIVE_CRITICAL) if adaptive else (R.CORE_WORDS, R.CRITICAL_WORDS)
    race, foreign = (R.ADAPTIVE_RACE, R.ADAPTIVE_THIRD_PARTY) if adaptive else (R.RACE_WORDS, R.THIRD_PARTY)
    factors = {
        "core_business": contains_any(path, core),
        "auth_payment": contains_any(path, critical) | said(*critical),
        "api_endpoint": said(*R.API_WORDS),
        "race_condition": said(*race),
        "syntax_error": contains_any(kind, ["syntax", "语法"]),
        "missing_doc": contains_any(kind, ["missing", "缺失"]) | message.contains("缺少"),
        "third_party": contains_any(path, foreign),
    }
    if not adaptive:
        factors["syntax_error"] = factors["syntax_error"] | message.contains("语法错误")
        factors |= {
            "async_signature_change": kind.contains("async_signature") | message.contains("签名变更"),
            "fire_and_forget": kind.contains("fire_and_forget") | message.contains("消防水带"),
            "function_deleted": contains_any(kind, ["deleted", "删除"]) | message.contains("被删除"),
            "high_caller_impact": kind.contains("caller_impact") | message.contains("调用方"),
        }
    return factors


def _weighted(factors: dict[str, Column], weights: dict[str, int]) -> Column:
    return sum((F.when(cond, weights[name]).otherwise(0) for name, cond in factors.items()), F.lit(0))


def pain_score(errors: DataFrame) -> DataFrame:
    """score 0..100, level and the factors of ``errors(error_type, file_path, message)``."""
    factors = pain_factors(F.col("file_path"), F.col("error_type"), F.col("message"))
    score = _clamp(_weighted(factors, R.PAIN_WEIGHTS).cast("double"))
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in factors.items()]))
    return errors.withColumn("pain_score", score).withColumn("pain_level", level_of(F.col("pain_score"))).withColumn(
        "factors", names
    )


def feedback_rates(feedback: DataFrame, *keys: str) -> DataFrame:
    """Share of each rating."""
    n = F.count("*")
    return feedback.groupBy(*keys).agg(
        n.alias("n"), *[(F.count_if(F.col("user_rating") == r) / n).alias(f"{r}_rate") for r in R.RATINGS]
    )


def calibrate(feedback: DataFrame, weights: DataFrame) -> DataFrame:
    """Calibrated weight per error type, always from the base ``weights(error_type, weight)``."""
    rates = feedback_rates(feedback, "error_type")
    enough = F.col("n") >= R.MIN_FEEDBACK
    base = F.coalesce("weight", F.lit(R.DEFAULT_TYPE_WEIGHT))
    factor = F.when((F.col("false_positive_rate") > 0.5) & enough, 0.7).when((F.col("confirmed_rate") > 0.8) & enough, 1.3)
    return (
        rates.join(weights, "error_type", "left")
        .filter(factor.isNotNull())
        .select("error_type", (base * factor).cast("int").cast("long").alias("weight"))
    )


def adaptive_pain_score(errors: DataFrame, calibrated: DataFrame) -> DataFrame:
    """base categories, with the calibrated weight of the error type added on top."""
    factors = pain_factors(F.col("file_path"), F.col("error_type"), F.col("message"), adaptive=True)
    extra = F.coalesce("weight", F.lit(0))
    score = _clamp((_weighted(factors, R.PAIN_WEIGHTS) + extra).cast("double"))
    joined = errors.join(calibrated, "error_type", "left")
    return joined.withColumn("pain_score", score).withColumn("pain_level", level_of(F.col("pain_score"))).drop("weight")


def total_pain(scored: DataFrame) -> DataFrame:
    """Mean score, worst level and its action."""
    rank = F.array_position(F.array(*[F.lit(v) for v in R.LEVELS]), F.col("pain_level"))
    out = scored.agg(F.count("*").alias("error_count"), F.sum("pain_score").alias("_s"), F.max(rank).alias("_r"))
    level = F.coalesce(F.get(F.array(*[F.lit(v) for v in R.LEVELS]), (F.col("_r") - 1).cast("int")), F.lit("LOW"))
    action = F.create_map(*[F.lit(x) for kv in R.ACTIONS.items() for x in kv])
    return out.select(
        "error_count",
        F.coalesce(F.try_divide(F.col("_s"), F.col("error_count")), F.lit(0.0)).alias("mean_score"),
        level.alias("overall_level"),
        action[level].alias("action"),
    )


def rule_false_positives(outcomes: DataFrame, flag_above: float = 10) -> DataFrame:
    """Share of ignored outcomes per rule of ``rule_outcomes(rule_id, outcome)``."""
    ignored = F.count_if(F.col("outcome") == "ignored")
    return outcomes.groupBy("rule_id").agg(
        F.count("*").alias("triggered"),
        F.count_if(F.col("outcome") == "fixed").alias("fixed"),
        ignored.alias("ignored"),
        (ignored * 100.0 / F.count("*")).alias("false_positive_rate"),
    ).withColumn("flagged", F.col("false_positive_rate") > flag_above)


# --- metric windows ---------------------------------------------------------------------------

def dimension_scores(metrics: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row with a 0..1 score per dimension, 0.5 where the window holds no metric, and the metric count."""
    window = metrics.filter((F.col("ts") >= now - F.make_interval(hours=F.lit(hours))) & (F.col("ts") <= now))

    def score(dim: str) -> Column:
        mean = F.avg(F.when(F.col("type") == dim, F.col("value")))
        return F.when(mean.isNull(), 0.5).otherwise(_clamp(mean, 0.0, 1.0))

    return window.agg(*[score(d).alias(d) for d in R.DIMENSION_WEIGHTS], F.count("*").alias("metrics_count"))


def evolution_total(scores: DataFrame, weights: dict[str, float] = R.DIMENSION_WEIGHTS) -> DataFrame:
    """A21."""
    return scores.withColumn("total_score", sum((F.col(d) * w for d, w in weights.items()), F.lit(0.0)))


def evolution_status(totals: DataFrame) -> DataFrame:
    """``evaluated`` with the total score, or ``insufficient_data`` with 0 where the window held no metric."""
    some = F.col("metrics_count") > 0
    return totals.select(
        F.when(some, "evaluated").otherwise("insufficient_data").alias("status"), F.when(some, F.col("total_score")).otherwise(0.0).alias("score"),
        "metrics_count",
    )


def fatigue(scores: DataFrame, weights: dict[str, float] = R.DIMENSION_WEIGHTS) -> DataFrame:
    """Share and weight of the high negative dimensions, and the status."""
    negative = {d: w for d, w in weights.items() if w < 0}
    high = sum((F.when(F.col(d) > 0.5, 1).otherwise(0) for d in negative), F.lit(0))
    dimension_ratio = high / len(weights)
    weight_ratio = sum((F.col(d) * abs(w) for d, w in negative.items()), F.lit(0.0)) / sum(abs(w) for w in weights.values())
    ratio = F.col("negative_ratio")
    return (
        scores.withColumn("dimension_ratio", dimension_ratio)
        .withColumn("weight_ratio", weight_ratio)
        .withColumn("negative_ratio", (F.col("dimension_ratio") + F.col("weight_ratio")) / 2)
        .withColumn(
            "status",
            F.when(ratio >= R.FATIGUE_CRITICAL, "critical").when(ratio >= R.FATIGUE_WARNING, "warning")
            .when(ratio <= R.ENCOURAGE_BELOW, "encourage").otherwise("normal"),
        )
    )


def recommendations(status: DataFrame) -> DataFrame:
    """Actions from the status and the dimensions."""
    s = F.col("status")
    table = [
        (s == "critical", "reduce_pain_threshold", "high"),
        (s == "critical", "increase_false_positive_tolerance", "high"),
        (s == "warning", "adjust_pain_weights", "medium"),
        (s == "encourage", "enable_innovation_mode", "low"),
        (F.col("false_positive_rate") > 0.5, "review_false_positives", "medium"),
        (F.col("dev_velocity") < 0.3, "optimize_check_speed", "medium"),
    ]
    rows = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(action).alias("action"), F.lit(priority).alias("priority")))
        for cond, action, priority in table
    ]))
    return status.select(F.inline(rows))


def metric_value(kind: Column) -> Column:
    """M7: metric value by event kind, over columns tests_passed, pain_before, pain_after, before, after, fix_seconds, pain."""
    c = F.col
    gain = (c("pain_before") - c("pain_after")) / c("pain_before") * 0.5
    refactor = F.when(c("tests_passed"), 0.5).otherwise(0.0) + F.when(
        c("pain_before") > 0, F.least(F.greatest(gain, F.lit(0.0)), F.lit(0.5))
    ).otherwise(0.0)
    perf = F.when(c("before") <= 0, 0.0).otherwise(_clamp((c("before") - c("after")) / c("before"), 0.0, 1.0))
    in_time = (
        F.when(c("fix_seconds") <= 3600, 1.0).when(c("fix_seconds") >= 86_400, 0.0)
        .otherwise(1.0 - (c("fix_seconds") - 3600) / F.lit(82_800.0))
    )
    fixed = F.least(in_time * (1.0 + c("pain") / 100.0), F.lit(1.0))
    return (
        F.when(kind == "refactor_success", refactor).when(kind == "performance_improvement", perf)
        .when(kind == "bug_fix_time", fixed).when(kind == "false_positive_rate", 1.0)
    )


def newest_metrics(metrics: DataFrame, keep: int = 1000) -> DataFrame:
    """M8."""
    return metrics.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


# --- lookups ----------------------------------------------------------------------------------

def core_areas(files: DataFrame) -> DataFrame:
    """Core areas a path's directories belong to, one row per (path, area)."""
    path = F.lower("path")
    rows = F.array_compact(F.array(*[
        F.when(
            contains_any(path, words),
            F.struct(F.lit(area).alias("area"), F.lit(level).alias("sensitivity"), F.lit(mult).alias("pain_multiplier")),
        )
        for area, words, level, mult in R.CORE_AREAS
    ]))
    return files.select("repo", "path", F.inline(rows))


def suggest_fix(errors: DataFrame) -> DataFrame:
    """The first strategy, in list order, by type or by a part of the message."""
    text = F.lower("message")
    strategy = F.coalesce(*[
        F.when(
            (F.col("error_type") == kind) | contains_any(text, parts),
            F.struct(F.lit(kind).alias("strategy"), F.lit(fixable).alias("auto_fixable"), F.lit(conf).alias("confidence")),
        )
        for kind, parts, fixable, conf in R.FIX_STRATEGIES
    ])
    return errors.withColumn("_s", strategy).filter("_s IS NOT NULL").select(*errors.columns, "_s.*")


def fix_statistics(suggested: DataFrame) -> DataFrame:
    """A54."""
    return suggested.agg(
        F.count("*").alias("processed"), F.count_if("auto_fixable").alias("auto_fixable"),
        F.count_if(~F.col("auto_fixable")).alias("suggested"),
    )


def impact_text(kind: Column, message: Column) -> Column:
    """F6."""
    text = F.lower(message)
    return F.coalesce(*[
        F.when(contains_any(kind, types) | contains_any(text, words), impact) for types, words, impact in R.IMPACTS
    ])


# --- evolved rules ----------------------------------------------------------------------------

def evolve(insights: DataFrame, newest: int = 50) -> DataFrame:
    """M6: rules from the newest unapplied insights; an empty module means any module."""
    kinds = F.create_map(*[F.lit(x) for kv in R.INSIGHT_RULES.items() for x in kv])
    recent = insights.filter(~F.col("applied")).orderBy(F.desc("generated_at"), F.desc("id")).limit(newest)
    return recent.select(
        F.concat(F.lit("rule_"), F.col("id").cast("string")).alias("id"),
        kinds[F.col("type")].alias("type"),
        F.coalesce("module", F.lit("")).alias("module"),
        F.coalesce("pattern", F.lit("")).alias("pattern"),
        "confidence",
        F.col("id").alias("source_insight_id"),
    ).filter("type IS NOT NULL")


def mark_applied(insights: DataFrame, rules: DataFrame) -> DataFrame:
    """M6: ``insights`` with those behind ``rules`` marked applied."""
    used = rules.select(F.col("source_insight_id").alias("id"), F.lit(True).alias("_used")).distinct()
    return insights.join(used, "id", "left").withColumn(
        "applied", F.col("applied") | F.coalesce("_used", F.lit(False))
    ).drop("_used")


def rescore(errors: DataFrame, rules: DataFrame) -> DataFrame:
    """``errors(error_type, file_path, pain_score)`` times the multipliers of all matching rules, clamped.

    Rules are matched to the distinct (module, type) pairs, by module or by "any module", so the join is an
    equi-join on few rows; the errors then pick up one multiplier each.
    """
    keyed = errors.withColumn("_module", module_of(F.col("file_path")))
    pairs = keyed.select("_module", "error_type").distinct().withColumn(
        "_key", F.explode(F.array(F.col("_module"), F.lit("")))
    )
    share = F.when(F.col("type") == "pain_weight", 0.5).when(F.col("type") == "check_priority", 0.3).otherwise(0.0)
    wanted = rules.select(F.col("module").alias("_key"), "pattern", (1.0 + F.col("confidence") * share).alias("_mult"))
    factor = (
        pairs.join(wanted, "_key")
        .filter((F.col("pattern") == "") | glob_match(F.col("error_type"), F.col("pattern")))
        .groupBy("_module", "error_type").agg(F.product("_mult").alias("_factor"))
    )
    out = keyed.join(factor, ["_module", "error_type"], "left")
    return out.select(
        *errors.columns, _clamp(F.col("pain_score") * F.coalesce("_factor", F.lit(1.0))).alias("rescored")
    )


def rule_set_summary(rules: DataFrame) -> DataFrame:
    """A50."""
    return rules.groupBy("type").agg(F.count("*").alias("rules"), F.countDistinct("module").alias("modules"))
