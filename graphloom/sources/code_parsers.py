"""Entities of source files: Python by its own grammar, JSON, YAML and Dockerfiles by structure, Go, TypeScript and C# by patterns.

No grammar packages are at hand, so the last three read declarations line by
line and follow braces; text inside comments and strings may mislead them. A file
that can't be parsed gives no rows.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.operators.code_index import ENTITY
from graphloom.sources.shared import ship

COLUMNS = ["file_path", "language", "namespace", "entity_type", "name", "fqn", "parent_fqn", "line_start", "line_end", "modifiers", "base_types"]


class Found:
    def __init__(self, path: str, language: str, namespace: str):
        self.path, self.language, self.namespace = path, language, namespace
        self.rows: list[tuple] = []
        self.modules: list[str] = []

    def add(self, kind: str, name: str, line: int, end: int | None = None, parent: str | None = None, bases=(), modifiers=()) -> str:
        head = parent or self.namespace
        fqn = f"{head}.{name}" if head else name
        self.rows.append((self.path, self.language, self.namespace, kind, name, fqn, parent, line, end or line, list(modifiers), list(bases)))
        return fqn


def _module(path: str) -> str:
    parts = [p for p in re.sub(r"\.[A-Za-z0-9]+$", "", path).split("/") if p not in ("", ".", "src")]
    return ".".join(parts[:-1] if parts and parts[-1] == "__init__" else parts)


def python(text: str, path: str) -> Found:
    out = Found(path, "python", _module(path))
    tree = ast.parse(text)

    def walk(body, parent):
        for node in body:
            if isinstance(node, ast.ClassDef):
                bases = [b for b in map(ast.unparse, node.bases) if b != "object"]
                fqn = out.add("class", node.name, node.lineno, node.end_lineno, parent, bases, [ast.unparse(d) for d in node.decorator_list])
                walk(node.body, fqn)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.add("method" if parent else "function", node.name, node.lineno, node.end_lineno, parent, (), [ast.unparse(d) for d in node.decorator_list])

    walk(tree.body, None)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.modules += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.modules.append("." * node.level + (node.module or ""))
    return out


def json_(text: str, path: str) -> Found:
    """Resources of deployment templates, panels of dashboards, else the top-level keys."""
    out, data = Found(path, "json", ""), json.loads(text)
    if not isinstance(data, dict):
        return out
    lines = text.split("\n")
    at = lambda s: next((i for i, x in enumerate(lines, 1) if f'"{s}"' in x), 1)
    if isinstance(data.get("resources"), list) and "$schema" in data:
        for r in data["resources"]:
            if isinstance(r, dict) and r.get("name"):
                out.add("resource", str(r["name"]), at(r["name"]), bases=[str(r["type"])] if r.get("type") else [])
    elif isinstance(data.get("panels"), list):
        if data.get("title"):
            out.add("config", str(data["title"]), at(data["title"]))
        for p in data["panels"]:
            if isinstance(p, dict) and p.get("title"):
                out.add("panel", str(p["title"]), at(p["title"]), bases=[str(p["type"])] if p.get("type") else [])
    else:
        for k in data:
            out.add("config", k, at(k))
    return out


def yaml(text: str, path: str) -> Found:
    """Top-level keys; in pipelines also stages, jobs and steps that have names."""
    out = Found(path, "yaml", "")
    lines = text.split("\n")
    pipeline = any(re.match(r"(stages|jobs|steps|trigger|pool)\s*:", x) for x in lines)
    for i, line in enumerate(lines, 1):
        if m := re.match(r"([A-Za-z_][\w.-]*)\s*:", line):
            out.add("config", m[1], i)
        elif pipeline and (m := re.match(r"\s*-\s*(stage|job|deployment|task|script|bash|powershell|template)\s*:\s*(\S.*)", line)):
            kind = {"stage": "stage", "job": "job", "deployment": "job"}.get(m[1], "step")
            out.add(kind, m[2].strip().strip("'\"")[:80], i)
    return out


def dockerfile(text: str, path: str) -> Found:
    """Stages and images of FROM; what else a stage does becomes its modifiers."""
    out = Found(path, "dockerfile", "")
    joined, start, held = [], 0, ""
    for i, line in enumerate(text.split("\n"), 1):
        start = start or i
        if line.rstrip().endswith("\\"):
            held += line.rstrip()[:-1] + " "
            continue
        joined.append((start, held + line))
        start, held = 0, ""
    current: list | None = None
    for i, line in joined:
        if m := re.match(r"(?i)\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", line):
            current = []
            out.rows.append((path, "dockerfile", "", "stage" if m[2] else "image", m[2] or m[1], m[2] or m[1], None, i, i, current, [m[1]]))
        elif current is not None and (m := re.match(r"(?i)\s*(COPY|EXPOSE|CMD|ENTRYPOINT)\s+(.*)", line)):
            word, rest = m[1].upper(), m[2].strip()
            source = re.search(r"--from=(\S+)", rest)
            if word != "COPY":
                current.append(f"{word.lower()}:{rest}")
            elif source:
                current.append(f"copy-from:{source[1]}")
    return out


def _block_end(lines: list[str], i: int) -> int:
    """The line where the braces that open at or after line i (from 0) close, from 1."""
    depth, opened = 0, False
    for j in range(i, len(lines)):
        depth += lines[j].count("{") - lines[j].count("}")
        opened = opened or "{" in lines[j]
        if opened and depth <= 0 or not opened and lines[j].rstrip().endswith(";"):
            return j + 1
    return len(lines)


_NAMES = r"[A-Za-z_][\w.<>, ]*"
_TYPES = {
    "typescript": re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?((?:abstract\s+|const\s+)*)(class|interface|enum|type)\s+(\w+)[^{{=:]*?(?:extends\s+({_NAMES}?))?(?:\s*implements\s+({_NAMES}?))?\s*[{{=]"),
    "csharp": re.compile(rf"^\s*((?:public|private|protected|internal|static|abstract|sealed|partial|readonly)\s+)*(class|interface|struct|enum|record)\s+(\w+)[^:{{]*(?::\s*({_NAMES}))?()"),
}
_MEMBERS = {
    "typescript": re.compile(r"^\s*((?:public|private|protected|static|async|readonly|abstract|get|set)\s+)*(constructor|\w+)\s*(?:<[^>]*>)?\(([^;]*)\)\s*(?::\s*[^{;]+)?\s*\{"),
    "csharp": re.compile(r"^\s*((?:public|private|protected|internal|static|virtual|override|async|abstract|sealed|readonly)\s+)+(?:([\w<>\[\],.?]+)\s+)?(\w+)\s*(\(|\{\s*get|=>)"),
}
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new"}


def braces(text: str, path: str, language: str) -> Found:
    lines = text.split("\n")
    if language == "csharp":
        m = re.search(r"(?m)^\s*namespace\s+([\w.]+)", text)
        out = Found(path, language, m[1] if m else "")
        out.modules = re.findall(r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", text)
    else:
        out = Found(path, language, ".".join(p for p in path.split("/")[:-1] if p not in ("", ".")))
        out.modules = re.findall(r"""(?m)^\s*(?:import|export)\b[^'"\n]*?['"]([^'"]+)['"]""", text)
    key = "csharp" if language == "csharp" else "typescript"
    open_: list[tuple[str, str, int]] = []
    for i, line in enumerate(lines):
        while open_ and i >= open_[-1][2]:
            open_.pop()
        parent = open_[-1][0] if open_ else None
        if m := _TYPES[key].match(line):
            bases = [b.strip() for g in m.groups()[3:] if g for b in g.split(",") if b.strip()]
            end = _block_end(lines, i)
            fqn = out.add(m[2], m[3], i + 1, end, parent, bases, (m[1] or "").split())
            open_.append((fqn, m[3], end))
        elif parent and (m := _MEMBERS[key].match(line)):
            name = m[2] if key == "typescript" else m[3]
            if name in _WORDS:
                continue
            made = name == "constructor" or key == "csharp" and name == open_[-1][1]
            kind = "constructor" if made else "property" if key == "csharp" and m[4] != "(" else "method"
            out.add(kind, name, i + 1, _block_end(lines, i), parent, (), (m[1] or "").split())
        elif not parent and key == "typescript" and (m := re.match(r"^\s*(?:export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", line)):
            out.add("function", m[2] or m[3], i + 1, _block_end(lines, i), None, (), ["async"] if m[1] or m[4] else [])
    return out


def go(text: str, path: str) -> Found:
    m = re.search(r"(?m)^package\s+(\w+)", text)
    out, lines = Found(path, "go", m[1] if m else ""), text.split("\n")
    block = re.search(r"(?ms)^import\s*\((.*?)^\)", text)
    out.modules = re.findall(r'"([^"]+)"', block[1]) if block else re.findall(r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"', text)
    for i, line in enumerate(lines):
        if m := re.match(r"func\s+\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)\s*\(", line):
            out.add("method", m[2], i + 1, _block_end(lines, i), f"{out.namespace}.{m[1]}" if out.namespace else m[1])
        elif m := re.match(r"func\s+(\w+)\s*[\[(]", line):
            out.add("function", m[1], i + 1, _block_end(lines, i))
        elif m := re.match(r"type\s+(\w+)\s+(struct|interface)?", line):
            end = _block_end(lines, i) if m[2] else i + 1
            fqn = out.add(m[2] or "type", m[1], i + 1, end)
            if m[2] == "interface":
                for j in range(i + 1, end):
                    if n := re.match(r"\s+(\w+)\s*\(", lines[j]):
                        out.add("method", n[1], j + 1, j + 1, fqn)
    return out


PARSERS = {"python": python, "json": json_, "yaml": yaml, "dockerfile": dockerfile, "go": go, "csharp": lambda t, p: braces(t, p, "csharp"), "typescript": lambda t, p: braces(t, p, "typescript"), "tsx": lambda t, p: braces(t, p, "tsx")}


def parse(text: str | None, path: str, language: str) -> Found:
    if not text or language not in PARSERS:
        return Found(path, language, "")
    try:
        return PARSERS[language](text, path)
    except (SyntaxError, ValueError, RecursionError):
        return Found(path, language, "")


def parse_entities(files: DataFrame) -> DataFrame:
    """Entities of files (file_path, language, text), in the columns of code_index.ENTITY."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for f in part.itertuples(index=False) for r in parse(f.text, f.file_path, f.language).rows]
            yield pd.DataFrame(rows, columns=COLUMNS)

    ship(files.sparkSession)
    return files.select("file_path", "language", "text").mapInPandas(run, ENTITY)


def parse_imports(files: DataFrame) -> DataFrame:
    """file_path, module."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f.file_path, m) for f in part.itertuples(index=False) for m in parse(f.text, f.file_path, f.language).modules]
            yield pd.DataFrame(rows, columns=["file_path", "module"])

    ship(files.sparkSession)
    return files.select("file_path", "language", "text").mapInPandas(run, "file_path string, module string")
