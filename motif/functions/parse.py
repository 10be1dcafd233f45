"""Source files to code units: Python by its own parser, JavaScript and TypeScript by a scanner.

The scanner knows strings, templates, comments, regular expressions and brackets, not the whole grammar: JSX text with
unbalanced quotes or brackets can mislead it. Where it loses track, a file gives the units found up to there.
"""

from __future__ import annotations

import ast
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motif.functions.exprs import language_of
from motif.schema import UNIT, UNITS

COLUMNS = [c.split()[0] for c in UNIT.split(", ")]


def _python_calls(node: ast.AST) -> list[str]:
    found: dict[str, None] = {}
    for child in ast.walk(node):
        if isinstance(child, ast.Call):
            if isinstance(child.func, ast.Attribute):
                found[f"{ast.unparse(child.func.value)}.{child.func.attr}"] = None
            elif isinstance(child.func, ast.Name):
                found[child.func.id] = None
    return [*found]


def python_units(source: str) -> list[dict]:
    """Functions and classes at any depth, breadth first; none if the source can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, waiting = [], deque([tree])
    while waiting:
        node = waiting.popleft()
        waiting.extend(ast.iter_child_nodes(node))
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        out.append(
            {
                "name": node.name, "source_code": ast.get_source_segment(source, node) or "", "node_type": "class" if isinstance(node, ast.ClassDef) else "function",
                "decorators": [ast.unparse(d) for d in node.decorator_list], "calls": _python_calls(node), "exports": False,
                "line_start": node.lineno, "line_end": node.end_lineno, "n_lines": node.end_lineno - node.lineno,
            }
        )
    return out


WORD = re.compile(r"[A-Za-z_$][\w$]*")
CALLEE = re.compile(r"[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.)\s*[A-Za-z_$#][\w$]*)*\s*(?=\()")
NOT_CALLED = set("if for while switch catch function return typeof await new delete void in of super import with do else case throw yield instanceof".split())
BEFORE_REGEX = set("return typeof case in of delete void throw new else do yield await instanceof".split())
CLOSES = {")": "(", "]": "[", "}": "{"}


def mask(source: str) -> str:
    """The source with comments, strings and regular expressions blanked, so that what is left is structure."""
    out, i, n, last, templates = list(source), 0, len(source), "", []

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def template(i: int) -> int:
        """From inside a template: to its end, or into an expression of it."""
        start = i
        while i < n and source[i] != "`":
            if source[i] == "\\":
                i += 1
            elif source.startswith("${", i):
                blank(start, i + 2)
                templates.append(0)
                return i + 2
            i += 1
        blank(start, i + 1)
        return i + 1

    while i < n:
        c = source[i]
        if c == "/" and i + 1 < n and source[i + 1] in "/*":
            end = source.find("\n", i) if source[i + 1] == "/" else source.find("*/", i + 2)
            end = n if end < 0 else end + (2 if source[i + 1] == "*" else 0)
            blank(i, end)
            i = end
            continue
        if c in "'\"":
            j = i + 1
            while j < n and source[j] != c and source[j] != "\n":
                j += 2 if source[j] == "\\" else 1
            blank(i, j + 1)
            i, last = j + 1, '"'
            continue
        if c == "`":
            blank(i, i + 1)
            i, last = template(i + 1), '"'
            continue
        if c == "/" and (not last or last in "(,=:[!&|?{};+-*%~^<>" or last in BEFORE_REGEX):
            j, inside = i + 1, False
            while j < n and source[j] != "\n" and (inside or source[j] != "/"):
                if source[j] == "\\":
                    j += 1
                elif source[j] in "[]":
                    inside = source[j] == "["
                j += 1
            if j < n and source[j] == "/":
                blank(i, j + 1)
                i, last = j + 1, '"'
                continue
        if templates and c == "{":
            templates[-1] += 1
        elif templates and c == "}":
            if templates[-1] == 0:
                templates.pop()
                blank(i, i + 1)
                i, last = template(i + 1), '"'
                continue
            templates[-1] -= 1
        if m := WORD.match(source, i):
            i, last = m.end(), m.group()
            continue
        if not c.isspace():
            last = c
        i += 1
    return "".join(out)


def _close(text: str, at: int) -> int:
    """Where the bracket at a place ends (exclusive); the end of the text if it never does."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _statement_end(text: str, at: int) -> int:
    """The end of a declaration: its semicolon at depth zero, or a line end after which no operator continues it."""
    while at < len(text):
        c = text[at]
        if c in "([{":
            at = _close(text, at)
            continue
        if c == ";":
            return at + 1
        if c in ")]}":
            return at
        if c == "\n":
            rest, before = text[at:].lstrip(), text[:at].rstrip()
            if not re.match(r"[.,?:=&|+\-*/%<>\[(]", rest) and not re.search(r"(=>|[=,?:&|+\-*/%<(\[{.])$", before):
                return at
        at += 1
    return at


def _script_calls(text: str, masked: str, a: int, b: int) -> list[str]:
    found: dict[str, None] = {}
    for m in CALLEE.finditer(masked, a, b):
        if m.start() and masked[m.start() - 1] in ".$#" or re.search(r"(?:\bfunction\*?|\bnew)\s+$", masked[max(a, m.start() - 12) : m.start()]):
            continue
        name = text[m.start() : m.end()].rstrip()
        if name in NOT_CALLED:
            continue
        if re.match(r"\s*\{", masked[_close(masked, m.end()) : _close(masked, m.end()) + 3]) and "." not in name and _is_method(masked, m.start()):
            continue
        if len(name) > 60:
            name = ".".join(name.split(".")[-2:])
        found[name] = None
    return [*found]


def _is_method(masked: str, at: int) -> bool:
    return not masked[:at].rstrip() or masked[:at].rstrip()[-1] in "{};" or bool(re.search(r"\b(?:async|static|get|set|public|private|protected)\s*$", masked[:at]))


FUNCTION = re.compile(r"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)")
CLASS = re.compile(r"(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)")
VARIABLE = re.compile(r"(?:const|let|var)\s+")
NAMED = re.compile(r"([A-Za-z_$][\w$]*)\s*(?::[^=]+?)?=\s*(?=(?:async\b\s*)?(?:function\b|\(|[A-Za-z_$][\w$]*\s*=>|<))")
EXPORT = re.compile(r"export\s+(?:default\s+)?")


def _classify(name: str, text: str, kind: str) -> str:
    if re.match(r"use[A-Z]", name):
        return "hook"
    if name[:1].isupper() and any(x in text for x in ("<", "jsx", "React.createElement")):
        return "component"
    return "arrow_fn" if "=>" in text and kind != "function_declaration" else "function"


def _value_end(masked: str, at: int) -> tuple[str, int] | None:
    """Kind and end of a function value at a place; None if what stands there is no function."""
    if m := re.compile(r"(?:async\s+)?function\s*\*?\s*[\w$]*\s*(?:<[^>]*>)?\s*(?=\()").match(masked, at):
        body = masked.find("{", _close(masked, m.end()))
        return ("function_expression", _close(masked, body)) if body >= 0 else None
    if m := re.compile(r"(?:async\s+)?(?:<[^>]*>\s*)?(?=[\w$(])").match(masked, at):
        end = _close(masked, m.end()) if masked[m.end() : m.end() + 1] == "(" else (w.end() if (w := WORD.match(masked, m.end())) else m.end())
        if arrow := re.compile(r"\s*(?::[^={;]+)?=>\s*").match(masked, end):
            body = arrow.end()
            return "arrow_function", _close(masked, body) if masked[body : body + 1] in ("{", "(") else _statement_end(masked, body)
    return None


def script_units(source: str) -> list[dict]:
    """Functions, classes and function-valued variables of a script; what lies inside a unit is not a unit of its own."""
    masked, out, at, exported = mask(source), [], 0, False

    def add(name: str, a: int, b: int, kind: str, calls: list[str], marks: list[str]) -> None:
        first, last = source.count("\n", 0, a), source.count("\n", 0, b)
        out.append(
            {
                "name": name, "source_code": source[a:b], "node_type": kind, "decorators": marks, "calls": calls, "exports": exported,
                "line_start": first + 1, "line_end": last + 1, "n_lines": last - first,
            }
        )

    marks: list[str] = []
    while at < len(masked):
        c = masked[at]
        if at and (masked[at - 1].isalnum() or masked[at - 1] in "_$.") and (c.isalnum() or c in "_$"):
            at += 1
            continue
        if m := re.compile(r"@[\w$.]+").match(masked, at):
            end = _close(masked, m.end()) if masked[m.end() : m.end() + 1] == "(" else m.end()
            marks.append(source[at:end])
            at = end
        elif m := EXPORT.match(masked, at):
            exported, at = True, m.end()
            continue
        elif m := FUNCTION.match(masked, at):
            opens = masked.find("(", m.end())
            body = masked.find("{", _close(masked, opens)) if opens >= 0 else -1
            if body < 0:
                at = m.end()
            else:
                end = _close(masked, body)
                text = source[at:end]
                add(m[1], at, end, _classify(m[1], text, "function_declaration"), _script_calls(source, masked, opens, end), [])
                at = end
        elif (m := CLASS.match(masked, at)) and (body := masked.find("{", m.end())) >= 0:
            end = _close(masked, body)
            add(m[1], at, end, "class", _script_calls(source, masked, body, end), marks)
            at = end
        elif m := VARIABLE.match(masked, at):
            end, found = _statement_end(masked, at), None
            for n in NAMED.finditer(masked, m.end(), end):
                before = masked[m.end() : n.start()]
                if before.count("(") == before.count(")") and before.count("{") == before.count("}") and (value := _value_end(masked, n.end())):
                    found = n[1], n.end(), value
                    break
            if found:
                name, start, (kind, stop) = found
                end = max(end, stop)
                add(name, at, end, _classify(name, source[start:stop], kind), _script_calls(source, masked, start, stop), [])
                at = end
            else:
                at = m.end()
        else:
            at += 1
            if not c.isspace():
                exported = False
                marks = [] if c != "@" else marks
            continue
        exported = False
        if masked[at - 1 : at] == "}":
            marks = []
    return out


def units_of(language: str | None, source: str | None) -> list[dict]:
    if not source or not source.strip() or language is None:
        return []
    return python_units(source) if language == "python" else script_units(source)


def file_units(files: DataFrame) -> DataFrame:
    """(event_seq, path, units) of files (event_seq, path, source) that have units: a row for each file, so that a stream can
    take what concerns a whole file without gathering it. Blank, unknown and bad files give no row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for seq, path, language, source in b.itertuples(index=False):
                if units := [{"unit_pos": k, "language": language, **u} for k, u in enumerate(units_of(language, source))]:
                    rows.append((seq, path, units))
            yield pd.DataFrame(rows, columns=["event_seq", "path", "units"])

    known = files.select("event_seq", "path", language_of(F.col("path")).alias("language"), "source").where("language is not null and trim(source) != ''")
    fields = ", ".join(f"{n}: {t}" for n, t in (f.split() for f in UNIT.split(", ")))
    return known.mapInPandas(of, f"event_seq long, path string, units array<struct<{fields}>>")


def parse_files(files: DataFrame) -> DataFrame:
    """Units of files (event_seq, path, source): blank files and unknown extensions give none, a bad file gives none."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for seq, path, language, source in b.itertuples(index=False):
                for k, unit in enumerate(units_of(language, source)):
                    rows.append({"event_seq": seq, "path": path, "unit_pos": k, "language": language, **unit})
            yield pd.DataFrame(rows, columns=["event_seq", "path", *COLUMNS])

    known = files.select("event_seq", "path", language_of(F.col("path")).alias("language"), "source").where("language is not null and trim(source) != ''")
    return known.mapInPandas(of, UNITS)
