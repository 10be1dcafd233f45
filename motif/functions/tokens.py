"""Token hashes of long texts in Arrow batches.

exprs.token_hash stays in the JVM and suits code units. It finds a name's number by going through the names before it, so
it takes quadratic time in the length of a text; here a dictionary does that. Over whole documents at sf0.1 on eight
cores the expression took 12 s, this 4 s, the start of Python workers included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motif.functions.exprs import KEYWORDS

LITERALS = tuple((re.compile(f"{q}[^{q}]*{q}"), f"{q}STR{q}") for q in "'\"`")
NUMBER = re.compile(r"\b\d+\.?\d*\b")
TOKEN = re.compile(r"[a-zA-Z_$][a-zA-Z0-9_$]*|\S")
NAME = re.compile(r"[a-zA-Z_$]")


class Numbers(dict):
    """What a token is shown as: names by number, in order of first appearance; the rest as it is."""

    fixed = frozenset(KEYWORDS)

    def __init__(self):
        self.names = 0

    def __missing__(self, token: str) -> str:
        if NAME.match(token) and token not in self.fixed:
            shown = f"_v{self.names}"
            self.names += 1
        else:
            shown = token
        self[token] = shown
        return shown


def token_hash(source: str | None) -> str:
    """The structural hash of a text's tokens; a null text counts as empty."""
    text = source or ""
    for literal, marker in LITERALS:
        text = literal.sub(marker, text)
    shown = " ".join(map(Numbers().__getitem__, TOKEN.findall(NUMBER.sub("NUM", text))))
    return hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest()[:16]


@F.pandas_udf(T.StringType())
def token_hashes(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sources:
        yield batch.map(token_hash, na_action=None).astype("object")
