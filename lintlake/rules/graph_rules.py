"""Fixed values of the graph and fact operators."""

from __future__ import annotations

# (layer, directories, forbidden imports)
LAYERS = [
    ("entry", ["routes", "api", "handlers", "endpoints"], ["db", "repositories", "database", "sql"]),
    ("service", ["services", "service", "use_cases", "domain"], []),
    ("data", ["db", "repositories", "database", "sql"], ["routes", "api", "handlers", "services"]),
    ("model", ["models", "schemas", "entities"], ["routes", "api", "services", "db"]),
    ("util", ["utils", "helpers", "common", "core"], ["routes", "api", "services", "db"]),
]
FETCH_WORDS = ["get", "fetch", "load", "find", "read", "query", "retrieve", "collect"]
# Names that a Python file may call without importing them. Functions and types, then exceptions and
# constants, then names that test frameworks bring along.
NEEDS_NO_IMPORT = [
    "abs", "all", "any", "ascii", "bin", "bool", "bytearray", "bytes", "callable", "chr", "classmethod", "compile",
    "complex", "delattr", "dict", "dir", "divmod", "enumerate", "eval", "exec", "filter", "float", "format", "frozenset",
    "getattr", "globals", "hasattr", "hash", "hex", "id", "input", "int", "isinstance", "issubclass", "iter", "len",
    "list", "locals", "map", "max", "memoryview", "min", "next", "object", "oct", "open", "ord", "pow", "print",
    "property", "range", "repr", "reversed", "round", "set", "setattr", "slice", "sorted", "staticmethod", "str", "sum",
    "super", "tuple", "type", "vars", "zip", "__import__", "reduce", "breakpoint", "help", "exit", "quit",
    "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "ImportError", "RuntimeError",
    "StopIteration", "NotImplementedError", "OSError", "IOError", "FileNotFoundError", "ZeroDivisionError",
    "AssertionError", "NameError", "LookupError", "MemoryError", "SystemError", "SystemExit", "KeyboardInterrupt",
    "StopAsyncIteration", "GeneratorExit", "True", "False", "None", "Ellipsis", "NotImplemented",
    "pytest", "unittest", "mock", "patch", "fixture", "parametrize", "mark", "raises", "skip", "skipif", "xfail",
]
TS_EXPORT = r"export\s+(?:default\s+)?(?:function|const|class|interface|type)\s+(\w+)"
TS_EXPORT_WIDE = r"export\s+(?:const|let|var|function|class|interface|type)\s+(\w+)"
GO_EXPORT = r"^(?:func\s+([A-Z]\w*)\s*\(|type\s+([A-Z]\w*)\s+)"
