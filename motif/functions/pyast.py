"""Python source in Arrow batches: structural hash, complexity and validity in one pass over the syntax tree."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRANCHING = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.comprehension, ast.BoolOp)


def canonical(tree: ast.AST) -> str:
    """A text that is equal for trees that differ only in what a copy may rename.

    Names and parameters are numbered in order of first visit, constants stand by their types, functions and classes by
    their kinds. Attributes, keywords, imports, exception names and annotations of parameters stay as they are.
    """
    numbers: dict[str, int] = {}
    out: list[str] = []

    def number(name: str) -> str:
        return f"${numbers.setdefault(name, len(numbers))}"

    todo: list = [tree]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, ast.Name):
            out.append(f"Name({number(item.id)},{type(item.ctx).__name__})")
        elif isinstance(item, ast.arg):
            note = ast.dump(item.annotation) if item.annotation is not None else "-"
            out.append(f"arg({number(item.arg)},{note},{item.type_comment!r})")
        elif isinstance(item, ast.Constant):
            out.append(f"Constant({type(item.value).__name__},{item.kind!r})")
        elif isinstance(item, ast.AST):
            parts: list = [type(item).__name__ + "("]
            definition = isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            for name, value in ast.iter_fields(item):
                parts.append(f"{name}=")
                parts.append("*" if definition and name == "name" else value)
            parts.append(")")
            todo += reversed(parts)
        elif isinstance(item, list):
            todo += reversed(["[", *item, "]"])
        else:
            out.append(repr(item))
    return " ".join(out)


def describe(source: str | None) -> tuple[str, float, bool]:
    """Hash (empty if it can't be parsed), complexity (1 then), and whether it can be parsed."""
    try:
        tree = ast.parse(source or "")
        key = hashlib.sha256(canonical(tree).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "", 1.0, False
    return key, 1.0 + sum(isinstance(n, BRANCHING) for n in ast.walk(tree)), True


@F.pandas_udf(T.StructType([T.StructField("hash", T.StringType()), T.StructField("complexity", T.DoubleType()), T.StructField("valid", T.BooleanType())]))
def python_facts(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in sources:
        yield pd.DataFrame([describe(s) for s in batch], columns=["hash", "complexity", "valid"])


def facts(language: Column, source: Column, native_hash: Column, native_complexity: Column) -> tuple[Column, Column]:
    """Hash and complexity by language; sources of other languages are not sent to Python."""
    found = python_facts(F.when(language == "python", source))
    return (
        F.when(language == "python", found["hash"]).otherwise(native_hash),
        F.when(language == "python", found["complexity"]).otherwise(native_complexity),
    )
