"""Encoding and decoding of a column of texts with the word-level BPE of bpe.py."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from .bpe import WordBpe
from .common import map_texts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_column(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, ids array<int>, n_tokens long, decoded string of every row; a null text counts as empty."""

    def make() -> Callable[[list], dict]:
        bpe = WordBpe(path)

        def run(texts: list) -> dict:
            ids = list(bpe.encode_each(texts))
            return {"ids": [x.astype("int32") for x in ids], "n_tokens": [len(x) for x in ids], "decoded": [bpe.decode_bytes(x).decode() for x in ids]}

        return run

    return map_texts(docs, text, keep if keep is not None else ["doc_id"], make, "ids array<int>, n_tokens long, decoded string")


def token_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256 of every row, without moving ids or texts out of the workers.

    A null or blank text has no ids and decodes to an empty text. Repeated rows give equal rows; an empty table none.
    """

    def make() -> Callable[[list], dict]:
        bpe = WordBpe(path)

        def run(texts: list) -> dict:
            n, ids, decoded = [], [], []
            for x in bpe.encode_each(texts):
                n.append(len(x))
                ids.append(hashlib.sha256(x.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_bytes(x)).hexdigest())
            return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return run

    return map_texts(docs, text, keep if keep is not None else ["doc_id"], make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
