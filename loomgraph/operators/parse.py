"""Symbols, imports and calls of source files.

Python is parsed to a syntax tree. The other languages are read by patterns:
comments and strings are blanked, declarations found, and their ends taken from
matching braces (for Ruby, from ``end`` at the same indent). That finds
top-level and nested declarations of usual style; it is not a full grammar.
A file that fails yields its error and no symbols.
"""

from __future__ import annotations

import ast
import re
import signal
import threading
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph import schema

#: A file that takes longer is skipped with an error.
FILE_SECONDS = 30.0
_C_FUNC = r"^[ \t]*(?!(?:return|else|new|if|for|while|switch|case|throw|do|typedef|using)\b)(?:[\w:<>,\[\]~]++[ \t*&]++)+(?P<name>[\w:~]+)[ \t]*\([^;{}]*\)[^;{}=]*\{"
_JS = [
    ("Function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*\([^)]*\)[^{;]*\{"),
    ("Function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>\s*\{"),
    ("Class", r"\bclass\s+(?P<name>[\w$]+)[^{]*\{"),
    ("Interface", r"\binterface\s+(?P<name>[\w$]+)[^{]*\{"),
    ("Enum", r"\benum\s+(?P<name>[\w$]+)\s*\{"),
    ("Namespace", r"\bnamespace\s+(?P<name>[\w$.]+)\s*\{"),
    ("Method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|\*)\s+)*(?!(?:if|for|while|switch|catch|function|return|constructor\s*=)\b)(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;=]+)?\{"),
]
#: Declarations of each language; a group ``name`` holds the name.
RULES: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS,
    "typescript": _JS,
    "rust": [("Function", r"\bfn\s+(?P<name>\w+)[^;{]*\{"), ("Struct", r"\bstruct\s+(?P<name>\w+)[^;{(]*\{"), ("Enum", r"\benum\s+(?P<name>\w+)[^{]*\{"), ("Trait", r"\btrait\s+(?P<name>\w+)[^{]*\{"), ("Class", r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)[^{]*\{"), ("Module", r"\bmod\s+(?P<name>\w+)\s*\{")],
    "go": [("Method", r"^func\s*\([^)]*\)\s*(?P<name>\w+)[^{]*\{"), ("Function", r"^func\s+(?P<name>\w+)[^{]*\{"), ("Interface", r"^type\s+(?P<name>\w+)\s+interface\s*\{"), ("Struct", r"^type\s+(?P<name>\w+)\s+struct\s*\{")],
    "java": [("Interface", r"\binterface\s+(?P<name>\w+)[^{]*\{"), ("Enum", r"\benum\s+(?P<name>\w+)[^{]*\{"), ("Class", r"\b(?:class|record)\s+(?P<name>\w+)[^{]*\{"), ("Method", _C_FUNC)],
    "c": [("Struct", r"\bstruct\s+(?P<name>\w+)\s*\{"), ("Enum", r"\benum\s+(?P<name>\w+)\s*\{"), ("Function", _C_FUNC)],
    "php": [("Class", r"\bclass\s+(?P<name>\w+)[^{]*\{"), ("Interface", r"\binterface\s+(?P<name>\w+)[^{]*\{"), ("Trait", r"\btrait\s+(?P<name>\w+)[^{]*\{"), ("Function", r"\bfunction\s+&?(?P<name>\w+)\s*\([^)]*\)[^{;]*\{")],
    "swift": [("Class", r"\bclass\s+(?P<name>\w+)[^{]*\{"), ("Struct", r"\bstruct\s+(?P<name>\w+)[^{]*\{"), ("Enum", r"\benum\s+(?P<name>\w+)[^{]*\{"), ("Interface", r"\bprotocol\s+(?P<name>\w+)[^{]*\{"), ("Function", r"\bfunc\s+(?P<name>\w+)[^{]*\{")],
    "ruby": [("Module", r"^[ \t]*module\s+(?P<name>[\w:]+)"), ("Class", r"^[ \t]*class\s+(?P<name>[\w:]+)"), ("Function", r"^[ \t]*def\s+(?P<name>[\w.?!=]+)")],
}
RULES["cpp"] = [("Namespace", r"\bnamespace\s+(?P<name>[\w:]+)\s*\{"), ("Class", r"\bclass\s+(?P<name>\w+)[^;{]*\{"), *RULES["c"]]
RULES["csharp"] = [("Namespace", r"\bnamespace\s+(?P<name>[\w.]+)\s*\{"), ("Struct", r"\bstruct\s+(?P<name>\w+)[^{]*\{"), *RULES["java"]]
IMPORTS = {
    "javascript": r"^[ \t]*(?:import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?|export\b[^;\n]*\bfrom\b[^;\n]*;?)", "rust": r"^[ \t]*(?:pub\s+)?use\s+[^;]+;", "go": r"^import\s+(?:\([^)]*\)|[^\n]+)", "java": r"^[ \t]*import\s+[^;]+;",
    "c": r"^[ \t]*#[ \t]*include[^\n]*", "csharp": r"^[ \t]*using\s+[^;(]+;", "php": r"^[ \t]*(?:use|require(?:_once)?|include(?:_once)?)\b[^;]+;", "swift": r"^[ \t]*import\s+\w+", "ruby": r"^[ \t]*require(?:_relative)?\b[^\n]*",
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]
_CALL = re.compile(r"(?<![\w$.])((?:[\w$]+(?:\.|::|->))*[\w$]+!?)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function fn func def class new sizeof elif and or not in match with await typeof await do else until unless when".split())
_QUOTED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
LIMITS = {"Function": 4000, "Method": 4000, "Class": 4000, "Interface": 2000}


def _symbol(kind: str, name: str, path: str, first: int, last: int, content: str | None, exported: bool | None = None, params: int | None = None, returns: str | None = None) -> tuple:
    return (f"{kind}:{name}", name, kind, path, first, last, content[: LIMITS.get(kind, 4000)] if content is not None else None, exported, params, returns)


def parse_python(path: str, text: str) -> tuple[list, list, list]:
    tree, lines = ast.parse(text), text.split("\n")
    symbols, imports, calls = [], [], []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            inside = in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "Class" if is_class else "Method" if in_class else "Function"
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                params = None if is_class else len(child.args.posonlyargs + child.args.args + child.args.kwonlyargs)
                returns = None if is_class or child.returns is None else ast.unparse(child.returns)
                symbols.append(_symbol(kind, child.name, path, child.lineno, child.end_lineno, body, not child.name.startswith("_"), params, returns))
                inside = is_class
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                imports.append(("\n".join(lines[child.lineno - 1 : child.end_lineno]).strip(), child.lineno))
            elif isinstance(child, ast.Call):
                calls.append((ast.unparse(child.func), child.lineno))
            walk(child, inside)

    walk(tree, False)
    return symbols, imports, calls


def _closes(text: str) -> dict[int, int]:
    """The place of each opening brace to that of its closing one, in one pass."""
    out, waiting = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            waiting.append(m.start())
        elif waiting:
            out[waiting.pop()] = m.start()
    return out


def parse_braces(path: str, language: str, text: str) -> tuple[list, list, list]:
    bare = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    breaks, closes = [m.start() for m in re.finditer("\n", text)], _closes(bare)
    line = lambda at: bisect_left(breaks, at) + 1
    found: dict[int, tuple] = {}
    for kind, rule in RULES[language]:
        for m in re.finditer(rule, bare, re.M):
            at = m.start("name")
            if at in found or m["name"] in _NOT_CALLS:
                continue
            if language == "ruby":
                indent = len(m[0]) - len(m[0].lstrip())
                end = re.compile(rf"^[ \t]{{{indent}}}end\b", re.M).search(bare, m.end())
                stop = end.end() - 1 if end else len(text) - 1
            else:
                stop = closes.get(m.end() - 1, len(text) - 1)
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            found[at] = (kind, m["name"], begin, stop)
    symbols, holders = [], [(b, e) for k, _, b, e in found.values() if k in ("Class", "Interface", "Trait", "Struct")]
    for at in sorted(found):
        kind, name, begin, stop = found[at]
        nested = any(b < begin and stop <= e for b, e in holders)
        if kind in ("Function", "Method") and language != "go":
            if kind == "Method" and not nested and language in ("javascript", "typescript"):
                continue
            kind = "Method" if nested else "Function"
        symbols.append(_symbol(kind, name, path, line(begin), line(stop), text[begin : stop + 1]))
    imports = [(text[m.start() : m.end()].strip(), line(m.start() + len(m[0]) - len(m[0].lstrip()))) for m in re.finditer(IMPORTS[language], bare, re.M)]
    calls = [(m[1], line(m.start(1))) for m in _CALL.finditer(bare) if m[1] not in _NOT_CALLS and m.end(1) - len(m[1]) not in found and m.start(1) not in found]
    return symbols, imports, calls


@contextmanager
def _at_most(seconds: float) -> Iterator[None]:
    """TimeoutError after so long; only a main thread, as a Python worker's, can be interrupted."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse_file(path: str, language: str, text: str, seconds: float = FILE_SECONDS) -> tuple:
    """One row; a file that cannot be parsed, or not in ``seconds``, has no symbols and says why."""
    try:
        with _at_most(seconds):
            parts = parse_python(path, text) if language == "python" else parse_braces(path, language, text)
        return (path, language, *parts, None)
    except (SyntaxError, ValueError, RecursionError, KeyError, TimeoutError) as why:
        return (path, language, [], [], [], f"{type(why).__name__}: {why}")


def parse(files: DataFrame) -> DataFrame:
    """(path, language, content) to ``schema.PARSED``; nothing crosses files, so no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in schema.SYMBOL.fields]
        for batch in batches:
            rows = [parse_file(*r) for r in zip(batch["path"], batch["language"], batch["content"])]
            out = pd.DataFrame(rows, columns=[f.name for f in schema.PARSED.fields])
            out["symbols"] = [[dict(zip(names, s)) for s in x] for x in out["symbols"]]
            out["imports"] = [[{"source": a, "line": b} for a, b in x] for x in out["imports"]]
            out["calls"] = [[{"target": a, "line": b} for a, b in x] for x in out["calls"]]
            yield out

    return files.select("path", "language", "content").mapInPandas(run, schema.PARSED)
