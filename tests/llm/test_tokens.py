import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from motif.llm import packing, tokens
from motif.llm.bpe import WordBpe

ALPHABET = ["a", "B", "é", "é", "İ", "Σ", "ς", "ß", "'s", "'LL", "'", " ", "\n", "\x1c", "\x85", "\xa0", " ", "1", "²", "½", "漢", "😀", "!", "...", "<|endoftext|>", "<|", "ǅ", "́", "ﬁ", "Å", "the", "ing", "\x00", "aaaa", "—", "’", "€"]


@pytest.fixture(scope="module")
def both():
    path = tokens.tokenizer_path()
    return WordBpe(path), Tokenizer.from_file(path)


def test_ids_and_decoding_equal_the_library(both):
    bpe, library = both
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(3000)]
    texts += [None, "", " ", "a" * 3000, "ab" * 2000 + "!", "".join(rng.choices("abcdefgh", k=5000))]
    for text, ids in zip(texts, bpe.encode_each(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert bpe.decode_bytes(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_slices_and_forgetting_change_nothing(both, monkeypatch):
    bpe, _ = both
    text = "some words, and 12 more! " * 40
    whole = next(bpe.encode_each([text])).tolist()
    monkeypatch.setattr("motif.llm.bpe.SLICE", 50)
    monkeypatch.setattr("motif.llm.bpe.KNOWN", 3)
    assert next(bpe.encode_each([text])).tolist() == whole


def test_digests(spark, make, both):
    _, library = both
    rows = [(1, "Hello world"), (2, None), (2, None), (None, ""), (3, "Hello world")]
    found = tokens.token_digests(make(rows), tokens.tokenizer_path()).collect()
    assert len(found) == len(rows)
    ids = library.encode("Hello world", add_special_tokens=False).ids
    want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    for r in found:
        assert tuple(r[1:]) == (want if r["doc_id"] in (1, 3) else (0, empty, empty))
    assert tokens.token_digests(make([]), tokens.tokenizer_path()).collect() == []
    encoded = tokens.encode_column(make(rows[:1]), tokens.tokenizer_path()).first()
    assert encoded["ids"] == ids and encoded["decoded"] == library.decode(ids)


def check_packing(placed, texts, library, size=2048):
    rest = {}
    for i, t in texts:
        rest.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = {}
    for r in placed:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(rest)
    for i, found in pieces.items():
        assert sorted(r["start"] for r in found) == sorted(a for ids in rest[i] for a, _ in packing.cuts(len(ids), size))
        if len(rest[i]) == 1:
            ids = np.array(rest[i][0], "<u4")
            for r in found:
                assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = {}
    for r in placed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(make, both):
    rng = random.Random(4)
    texts = [(i, "word " * rng.choice([0, 1, 5, 300, 1023, 1024, 2047, 2048, 5000])) for i in range(120)]
    texts += [(500, None), (501, ""), (502, "same text"), (502, "same text"), (None, "no id")]
    placed = packing.pack(make(texts), tokens.tokenizer_path()).collect()
    sequences = check_packing(placed, texts, both[1])
    total = sum(r["length"] for r in placed)
    assert len(sequences) <= total / 2048 * 1.03 + 2
    assert packing.pack(make([]), tokens.tokenizer_path()).collect() == []


def test_plans_hold_exactly_the_demand():
    rng = np.random.default_rng(1)
    for room in (4, 16, 64):
        for _ in range(20):
            demand = rng.integers(0, 40, room) * rng.integers(0, 2, room)
            made = packing.plan(demand, room)
            assert (sum((n * p for n, p in made), np.zeros(room, int)) == demand).all()
            assert all((p * np.arange(1, room + 1)).sum() <= room for _, p in made)


def test_knapsack_prices_against_all_patterns():
    values, weights = np.array([0.2, 0.5, 0.55]), np.array([1, 2, 3])
    best = max((a * 0.2 + b * 0.5 + c * 0.55) for a in range(8) for b in range(4) for c in range(3) if a + 2 * b + 3 * c <= 7)
    value, counts = packing.price(values, weights, 7)
    assert abs(value - best) < 1e-12 and (counts * weights).sum() <= 7
