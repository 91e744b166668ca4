"""Weights, word lists and thresholds of the scoring operators.  Everything here is fixed values."""

from __future__ import annotations

PAIN_WEIGHTS = {
    "core_business": 30, "auth_payment": 40, "api_endpoint": 20, "race_condition": 25, "syntax_error": 15,
    "missing_doc": 5, "third_party": -50, "async_signature_change": 40, "fire_and_forget": 35,
    "function_deleted": 30, "high_caller_impact": 20,
}
CORE_WORDS = ["auth", "login", "session", "token", "payment", "checkout", "billing", "user", "account", "security"]
CRITICAL_WORDS = [
    "auth", "login", "session", "token", "password", "credential", "payment", "checkout", "billing", "stripe", "paypal",
]
API_WORDS = ["api", "endpoint", "route", "handler", "controller"]
RACE_WORDS = ["race", "pending", "lock", "mutex", "concurrent", "async", "await", "promise", "deferred"]
THIRD_PARTY = ["node_modules", ".venv", "venv", "site-packages", "third_party", "external"]
# the adaptive scorer knows fewer words
ADAPTIVE_CORE = ["auth", "login", "session", "token", "payment", "checkout", "billing"]
ADAPTIVE_CRITICAL = ["auth", "login", "session", "token", "password", "credential", "payment", "checkout", "billing"]
ADAPTIVE_RACE = ["race", "pending", "lock", "mutex", "concurrent", "async", "await"]
ADAPTIVE_THIRD_PARTY = ["node_modules", ".venv", "venv", "site-packages"]
LEVEL_BANDS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")]
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ACTIONS = {
    "CRITICAL": "fix now", "HIGH": "fix in this work cycle", "MEDIUM": "plan for the next iteration", "LOW": "optional",
}

# calibration from feedback
RATINGS = ["false_positive", "confirmed", "low_priority", "high_priority"]
DEFAULT_TYPE_WEIGHT = 20
MIN_FEEDBACK = 3

# metric dimensions
DIMENSION_WEIGHTS = {
    "refactor_success": 0.25, "performance_improvement": 0.20, "bug_fix_time": 0.20, "false_positive_rate": -0.15,
    "dev_velocity": 0.20,
}
FATIGUE_CRITICAL, FATIGUE_WARNING, ENCOURAGE_BELOW = 0.5, 0.3, 0.15

# (area, words, sensitivity, multiplier)
CORE_AREAS = [
    ("authentication", ["auth", "login", "session", "token", "credential", "permission"], "critical", 2.5),
    ("payment", ["payment", "checkout", "billing", "stripe", "paypal", "invoice"], "critical", 2.5),
    ("data core", ["database", "model", "repository", "dao", "entity", "schema"], "high", 2.0),
    ("api gateway", ["api", "router", "gateway", "middleware", "controller", "endpoint"], "high", 2.0),
    ("configuration", ["config", "setting", "env", "secret"], "high", 2.0),
    ("user core", ["user", "account", "profile", "member"], "medium", 1.5),
]
# (error type, message parts, fixable by a tool, confidence); the first match wins
FIX_STRATEGIES = [
    ("syntax_error", ["syntaxerror"], False, 0.9),
    ("import_error", ["importerror", "modulenotfounderror"], False, 0.95),
    ("undefined_variable", ["nameerror", "undefined"], False, 0.9),
    ("type_error", ["typeerror"], False, 0.85),
    ("indentation_error", ["indentationerror", "unexpected indent"], True, 0.95),
    ("ts_syntax_error", ["ts1005", "ts1128", "syntax error"], False, 0.85),
    ("ts_type_error", ["ts2345", "ts2349", "type.*incorrect"], False, 0.9),
    ("ts_undefined", ["ts2304", "ts2552", "ts2551", "undefined"], False, 0.9),
    ("race_condition", ["race condition", "pendingmessageref", "useeffect"], True, 0.8),
    ("code_duplication", ["duplicate", "similar code"], False, 0.7),
    ("unused_code", ["unused", "dead code"], True, 0.95),
    ("performance", ["slow", "performance", "n+1 query"], False, 0.8),
]
# (words in the type, words in the lower-cased message, impact); the first match wins
IMPACTS = [
    (["import"], ["import"], "modules may not load"),
    (["api"], ["endpoint"], "callers of the API may fail"),
    (["module"], ["class"], "a whole subsystem may be affected"),
    (["file"], ["missing"], "runtime errors or missing features"),
    (["syntax"], ["语法"], "the program cannot run"),
    (["race"], ["竞态", "race condition"], "inconsistent data or rare crashes"),
    (["dedup"], ["去重"], "duplicate requests or data"),
]
# memory admission
MIN_PAIN, MIN_REPEATS, WINDOW_HOURS = 50, 2, 168
LOW_PRIORITY_TYPES = ["syntax_error", "import_error", "doc_missing", "语法错误", "import", "文档缺失"]
INSIGHT_RULES = {
    "repeated_bug": "pain_weight", "architectural_weakness": "check_priority", "evolution_suggestion": "new_check",
}
# (keyword in the path, domain), in vote order
DOMAINS = [
    ("api", "api_design"), ("route", "api_design"), ("endpoint", "api_design"), ("controller", "api_design"),
    ("model", "data_model"), ("schema", "data_model"), ("db/", "data_access"), ("database", "data_access"),
    ("sql", "data_access"), ("migration", "data_access"), ("test", "testing"), ("spec", "testing"), ("mock", "testing"),
    ("config", "configuration"), ("setting", "configuration"), ("security", "security"), ("auth", "security"),
    ("middleware", "infrastructure"), ("error", "error_handling"), ("exception", "error_handling"),
    ("memory", "architecture"), ("log", "observability"), ("metric", "observability"), ("monitor", "observability"),
    ("docker", "deployment"), ("ci/", "deployment"), ("deploy", "deployment"),
]
# (words in the lower-cased message, principle)
PRINCIPLES = [
    (["fix", "bug", "修复", "错误", "issue", "hotfix"], "regression_test"),
    (["refactor", "重构", "clean", "清理", "重写"], "behaviour_kept"),
    (["add", "新增", "feature", "feat", "功能"], "docs_and_tests"),
    (["remove", "删除", "deprecate", "废弃"], "no_dependants"),
    (["upgrade", "升级", "migrate", "迁移", "version"], "compatibility"),
    (["perform", "性能", "optimize", "优化", "speed"], "benchmarks"),
    (["security", "安全", "vulnerability", "漏洞", "cve"], "merge_first"),
]
