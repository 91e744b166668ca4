"""Fixed values of the gates: advisories, sensitive names, monitored directories, thresholds."""

from __future__ import annotations

# (ecosystem, package, operator, version, severity, summary)
ADVISORIES = [
    ("python", "requests", "<=", "2.25.0", "HIGH", "CVE-2021-33503"),
    ("python", "requests", "<=", "2.19.0", "CRITICAL", "CVE-2018-18074"),
    ("python", "django", "<", "2.2.28", "HIGH", "CVE-2021-33203"),
    ("python", "django", "<", "3.2.0", "HIGH", "CVE-2021-33503"),
    ("python", "flask", "<", "2.0.0", "MEDIUM", "CVE-2019-1010083"),
    ("python", "pillow", "<", "8.3.0", "CRITICAL", "CVE-2022-30515"),
    ("python", "urllib3", "<", "1.26.5", "HIGH", "CVE-2021-33503"),
    ("python", "jinja2", "<", "2.11.3", "HIGH", "CVE-2020-28493"),
    ("python", "pyyaml", "<", "5.4", "CRITICAL", "CVE-2020-14343"),
    ("python", "cryptography", "<", "3.0", "HIGH", "CVE-2020-36242"),
    ("node", "axios", "<", "0.21.0", "HIGH", "CVE-2021-3749"),
    ("node", "lodash", "<", "4.17.21", "CRITICAL", "CVE-2021-23337"),
    ("node", "express", "<", "4.17.1", "HIGH", "CVE-2022-24999"),
    ("node", "minimist", "<", "1.2.5", "CRITICAL", "CVE-2020-7598"),
]
REQUIREMENT = r"^\s*([a-zA-Z0-9_-]+)([=<>!~]+)([\d.]+)"

SENSITIVE_DIRS = [
    ".ssh", ".aws", ".grok", ".claude", ".codex", ".kube", ".config", ".npmrc", ".docker", ".credentials", ".secret",
    "secrets", "credentials",
]
# names with a wildcard are not looked up
SENSITIVE_FILES = [
    ".env", ".env.local", ".env.prod", ".env.production", ".env.dev", "credentials.json", "service-account.json",
    "id_rsa", "id_ed25519", "config.json",
]
MUST_IGNORE = SENSITIVE_DIRS + [".env", ".env.local", ".env.prod", "credentials.json"]

MONITORED_DIRS = ["services", "core", "api", "repositories", "models"]
NO_BUSINESS_CODE = r"(^|/)tests/|__init__\.py$|/migrations/|alembic/"
COVERAGE_THRESHOLD, NEW_CODE_THRESHOLD = 80.0, 85.0
MAX_FILE_BYTES = 1_048_576
SUPPRESS_BEFORE, SUPPRESS_AFTER, SUPPRESS_HEADER = 4, 5, 10

SEVERITY_PENALTY = {"CRITICAL": 20, "ERROR": 10, "WARNING": 5, "INFO": 1}
ACCEPTANCE_PENALTY = {"CRITICAL": 20, "HIGH": 10, "RECOMMENDED": 5}
GRADES = [(80, "A"), (60, "B"), (40, "C")]

LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "tsx": "TSX", "jsx": "JSX", "json": "JSON", "yaml": "YAML",
    "yml": "YAML", "md": "Markdown", "css": "CSS", "html": "HTML", "sh": "Shell", "sql": "SQL", "go": "Go", "rs": "Rust",
    "java": "Java", "rb": "Ruby",
}
COUNTED_LANGUAGES = ["Python", "JavaScript", "TypeScript", "TSX", "JSX", "Go", "Rust", "Java", "Ruby", "Shell"]
PY_FRAMEWORKS = ["fastapi", "flask", "django"]
TS_FRAMEWORKS = ["react", "vue", "angular", "next", "nuxt"]
DEBT_CATEGORIES = [("[YAGNI-", "code_simplification"), ("[COMPLEX-", "complexity"), ("[STDLIB-", "standard_library"), ("[TS-", "standard_library")]

KNOWN_DIRS = ["api", "services", "repositories", "models", "schemas", "core"]
UNCLEAR_DIRS = ["misc", "other", "temp", "test"]
DIR_ROLES = {
    "api": "routes", "app": "routes", "routers": "routes", "services": "business logic", "service": "business logic",
    "repositories": "data access", "repository": "data access", "repos": "data access", "models": "data models",
    "schemas": "validation models", "core": "core modules", "config": "configuration", "utils": "utilities",
    "helpers": "utilities", "tests": "tests", "test": "tests", "migrations": "migrations", "static": "static files",
    "assets": "static files", "docs": "documents", "documentation": "documents", "scripts": "scripts",
}
CLARITY_RATIO = 0.6
