"""Byte-pair encoding of many words at once, in numpy merge rounds.

The distinct words of a batch of texts lie in one flat array of symbols. A round looks up every adjacent pair by binary
search over the sorted pair keys, takes the lowest rank in each word, and merges all its non-overlapping occurrences from
the left. That equals merging one pair at a time, as long as a merge's parts stem from merges of lower rank: then no
pair that a merge creates can have a lower rank than that merge. Tables for which this does not hold are refused. Words
of very many symbols, which would need very many rounds, are merged with a heap instead; results are the same.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Longer words are merged with a heap.
LONG = 1000
#: So many distinct words are remembered by a task; then it starts again with none.
KNOWN = 400_000

# The word pattern of the tokenizer file, for lower-case ASCII and for Latin, most frequent kinds first.
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
ASCII_WORDS = rf"[a-z]+|{ENDINGS}|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+"
LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = rf"[{LETTERS}]+|{ENDINGS}|[{NUMBERS}]|[^ \t\n\r\x0b\x0c\x85\xa0{LETTERS}{NUMBERS}]+"
#: Texts with characters besides Latin, punctuation and currency go through the library's own normalizer and pattern.
OTHER = re.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]")

#: Characters whose words are held at once; longer texts are encoded in slices that end at white space.
SLICE = 1_000_000
SPACE = re.compile(r"[ \t\n\r]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Store(dict):
    """Numbers words as they are first looked up; new ones wait in a list."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordBpe:
    """Encoder and decoder for a tokenizer file: BPE over bytes with a suffix at word ends, lower case, no white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        self.of_symbol = {s: b for b, s in enumerate(symbols)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[m[0] + m[1]] for m in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        stems = np.full(self.size, -1)
        stems[made[::-1]] = np.arange(len(made))[::-1]  # of several merges with the same result, the first
        if len(np.unique(keys)) < len(keys) or (np.maximum(stems[left], stems[right]) >= np.arange(len(made))).any():
            raise ValueError("the merges are not in the order in which they build on each other")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ascii_words, self.latin_words = re.compile(ASCII_WORDS).findall, re.compile(LATIN_WORDS).findall
        text_of = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pieces = [text_of.get(i, "").encode() for i in range(self.size)]
        self.piece_bytes = np.frombuffer(b"".join(p + b" " for p in pieces), dtype=np.uint8)
        self.piece_sizes = np.array([len(p) + 1 for p in pieces])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.forget()

    def forget(self) -> None:
        """Starts with an empty store of words."""
        self.known = Store((s, i) for i, s in enumerate(self.special))
        self.known.new = []
        self.ids = np.array([*self.special.values()], dtype=np.int64)
        self.sizes = np.ones(len(self.special), dtype=np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text, as the library's normalizer and pattern give them."""
        if self.specials is not None and "<|" in text and self.specials.search(text):
            return [w for part in self.specials.split(text) if part for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text.lower())
        if OTHER.search(text) is None:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return self.latin_words(text.lower())
        back = self.of_symbol
        return [bytes(back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in self.split(self.normalize(text)) if w]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words of the given sizes in one flat array of symbols."""
        none, done = len(self.made), []
        word = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols):
            inside = word[1:] == word[:-1]
            rank = np.full(len(symbols), none)
            rank[:-1][inside] = self._rank(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.r_[True, ~inside])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbols)]))
            if (ended := least == none).any():  # words without any pair to merge leave
                done.append((word[ended], symbols[ended]))
                live = ~ended
                symbols, word, rank, least = symbols[live], word[live], rank[live], least[live]
                if not len(symbols):
                    break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # of overlapping occurrences, every other one counts from the left
                begins = hit & ~np.r_[False, hit[:-1]]
                at = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(begins, at, -1))
                hit &= (at - run) % 2 == 0
            symbols = symbols.copy()
            symbols[hit] = self.made[rank[hit]]
            stay = ~np.r_[False, hit[:-1]]
            symbols, word = symbols[stay], word[stay]
        words, out = (np.concatenate(x) for x in zip(*done)) if done else (word, symbols)
        order = np.argsort(words, kind="stable")
        return out[order], np.bincount(words, minlength=len(sizes))

    def merge_long(self, symbols: np.ndarray) -> list[int]:
        """One long word: pairs wait in a heap by rank and place."""
        ids, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = {}
        keys, ranks, made = self.keys, self.ranks, self.made

        def look(a: int, b: int) -> int:
            if (a, b) not in rank:
                at = int(np.searchsorted(keys, a * self.size + b))
                rank[a, b] = int(ranks[at]) if at < len(keys) and keys[at] == a * self.size + b else -1
            return rank[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(made[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (s := look(ids[i], ids[after[i]])) >= 0:
                    heapq.heappush(heap, (s, i, ids[i], ids[after[i]]))
            after[j] = -1
            if before[i] >= 0 and (s := look(ids[before[i]], ids[i])) >= 0:
                heapq.heappush(heap, (s, before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes the words that wait in the store."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[flat[ends]]
        if (long := sizes > LONG).any():
            parts: list = [None] * len(words)
            for i in np.flatnonzero(long):
                parts[i] = self.merge_long(symbols[ends[i] + 1 - sizes[i] : ends[i] + 1])
            ids, got = self.merge(symbols[np.repeat(~long, sizes)], sizes[~long])
            for i, p in zip(np.flatnonzero(~long), np.split(ids, np.cumsum(got)[:-1])):
                parts[i] = p
            ids, got = np.concatenate(parts), np.array([len(p) for p in parts])
        else:
            ids, got = self.merge(symbols, sizes)
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, got])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        lists = [self.words(t) for t in texts]
        if len(self.known) > KNOWN:
            self.forget()
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(counts.sum()))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        sizes = self.sizes[codes]
        ids = self.ids[_spread((np.cumsum(self.sizes) - self.sizes)[codes], sizes)].astype("<u4")
        return np.split(ids, np.r_[0, np.cumsum(sizes)][np.cumsum(counts)[:-1]])

    def encode_each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of one text after the other; a null text is empty. Memory is bounded by SLICE and the longest text."""
        waiting, held = [], 0
        for text in texts:
            if text and len(text) > SLICE:
                if waiting:
                    yield from self.encode(waiting)
                    waiting, held = [], 0
                yield np.concatenate([self.encode([part])[0] for part in slices(text)])
                continue
            waiting.append(text or "")
            held += len(waiting[-1])
            if held > SLICE or len(waiting) >= 5000:
                yield from self.encode(waiting)
                waiting, held = [], 0
        if waiting:
            yield from self.encode(waiting)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: without a decoder in the file, the tokens' strings joined by spaces."""
        sizes = self.piece_sizes[ids]
        return self.piece_bytes[_spread(self.piece_starts[ids], sizes)].tobytes()[:-1]


def slices(text: str) -> Iterator[str]:
    """A long text in parts of about SLICE characters; a part ends before white space, so no word is cut."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of the given size, one run after the other."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
