"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences without loss. Every run of at least `sentences` consecutive sentences with at least `words`
words is compared over all documents by its hash; the first place of a run, by document id and position, is the
original, and every sentence that another place of it covers is removed. Where a covered stretch holds whole sentences, by
marks and lines, only those go; else it lies inside one very long sentence, and its parts go.

Not every run needs a row. Of each sentence, the shortest run that begins with it and the shortest that ends with it are
hashed (96 bits). These cover all: in a longer run that repeats, every sentence begins a shortest run inside it, or lies in
the shortest run that ends where the longer one does; and where a longer run isn't the first, no run inside it is.

The join is one shuffle: places of equal runs are sorted, the first is left, the others are emitted. A place that comes
after one which the same task has seen can't be the first and is known without the shuffle. So a run in a third of all
documents comes as a few rows from each task, not one from each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, map_texts, small_batches

#: A sentence ends with a line, with a word that ends in MARKS (closing signs after them aside), at a wide mark, or with one
#: word in CHOSEN, chosen by its length and three of its bytes. Every text is cut by the same rule, whatever the length of its
#: sentences, so a passage that stands within other sentences is cut alike everywhere. The last rule only finds places: what
#: is removed goes from a real end to another where there is one.
MARKS, CLOSING = b".!?", b"\"')]"
WIDE = [x.encode() for x in "\u3002\uff01\uff1f"]
CHOSEN = 8
#: A task forgets the first places of runs when it knows those of so many; that only sends more rows.
SEEN = 100_000
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


WHITE, IS_MARK, IS_CLOSING = _table(b" \t\n\v\f\r"), _table(MARKS), _table(CLOSING)


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ x >> np.uint64(33)) * m
    return x ^ x >> np.uint64(33)


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change, so places stay


class Sentences:
    """The sentences of texts, as places in their bytes, which are strung together with line ends between them.

    first, after: where a sentence's first word begins and its last one ends. words: how many it has. text: which text it is
    of. real: whether a mark, a line or the text ends it, and not the rule for words alone. White space between sentences belongs to the one before; a text without a word has no sentence.
    """

    def __init__(self, texts: list[str]):
        parts = [_lowered(t) for t in texts]
        self.raw = b"\n".join(parts)
        self.offsets = np.cumsum([0] + [len(p) + 1 for p in parts])  # where each text begins
        b = np.frombuffer(self.raw, dtype=np.uint8)
        solid = ~WHITE[b]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        wide = np.zeros(0, dtype=np.int64)
        if any(w in self.raw for w in WIDE):
            third = b[2:]
            wide = np.flatnonzero((b[:-2] == 0xE3) & (b[1:-1] == 0x80) & (third == 0x82) | (b[:-2] == 0xEF) & (b[1:-1] == 0xBC) & ((third == 0x81) | (third == 0x9F))) + 2
            ends[wide] = True
            after = wide[wide + 1 < len(b)] + 1
            begins[after[solid[after]]] = True
        s, e = np.flatnonzero(begins), np.flatnonzero(ends)
        if not len(s):
            self.first = self.after = self.words = self.text = self.real = np.zeros(0, dtype=np.int64)
            return
        bare = e.copy()  # the last byte that is no closing sign
        k = np.arange(len(e))
        while len(k := k[IS_CLOSING[b[bare[k]]] & (bare[k] > s[k])]):
            bare[k] -= 1
        some = b[s].astype(np.uint64) | b[e].astype(np.uint64) << np.uint64(8) | b[(s + e) // 2].astype(np.uint64) << np.uint64(16) | (e - s).astype(np.uint64) << np.uint64(24)
        real = IS_MARK[b[bare]]
        real[np.searchsorted(e, wide)] = True
        line = np.searchsorted(e, np.flatnonzero(b == 10)) - 1
        real[line[line >= 0]] = True
        real[-1] = True
        z = np.flatnonzero(real | (_mixed(some) % np.uint64(CHOSEN) == 0))
        self.real = real[z]
        a = np.r_[0, z[:-1] + 1]
        self.first, self.after, self.words = s[a], e[z] + 1, z - a + 1
        self.text = np.searchsorted(self.offsets, self.first, side="right") - 1
        odd = np.r_[(s[1:] - e[:-1] != 2) | (b[np.minimum(e[:-1] + 1, len(b) - 1)] != 32), False]  # not one space after a word
        odd[z] = False
        self.odd = np.add.reduceat(odd, a) > 0

    def digests(self) -> np.ndarray:
        """Two words of 64 bits for each sentence, the same for other white space and case of A-Z."""
        raw, digest = self.raw, xxhash.xxh3_128_digest
        out = [digest(raw[a:b]) for a, b in zip(self.first.tolist(), self.after.tolist())]
        for k in np.flatnonzero(self.odd).tolist():
            out[k] = digest(b" ".join(raw[self.first[k] : self.after[k]].split()))
        return np.frombuffer(b"".join(out), dtype="<u8").reshape(-1, 2).astype(np.uint64)

    def runs(self, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, end (exclusive) and hash (64 and 32 bits) of each shortest run, in order of places."""
        n = len(self.first)
        if not n:
            return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32))
        sums, place = np.r_[0, np.cumsum(self.words)], np.arange(n)
        begin = np.searchsorted(self.text, self.text)  # of the sentence's text
        stop = np.searchsorted(self.text, self.text, side="right")
        end = np.maximum(np.searchsorted(sums, sums[:-1] + words), place + sentences)  # of the run that begins with each
        start = np.minimum(np.searchsorted(sums, sums[1:] - words, side="right") - 1, place + 1 - sentences)  # of the one that ends with each
        spans = np.unique(np.concatenate([(place << 32 | end)[end <= stop], (start << 32 | place + 1)[start >= begin]]))
        a, z = spans >> 32, spans & 0xFFFFFFFF
        powers = np.multiply.accumulate(np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64))
        inverse = np.multiply.accumulate(np.full(n, pow(0x9E3779B97F4A7C15, -1, 2**64), dtype=np.uint64))
        keys = []
        for d in self.digests().T:  # sums of hashes times powers: of a run, up to a power, the same wherever it stands
            p = np.r_[np.uint64(0), np.cumsum(d * powers)]
            keys.append(_mixed((p[z] - p[a]) * inverse[a]))
        return a, z, keys[0], (keys[1] >> np.uint64(32)).astype(np.uint32)


def split_sentences(text: str) -> list[str]:
    """The sentences of a text; joined, they are the text. A text without a word is one piece."""
    found, raw = Sentences([text]), text.encode("utf-8", "surrogatepass")
    at = [0, *found.first[1:].tolist(), len(raw)]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at, at[1:])] if raw else []


def _places(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """Rows (doc, tid, high, low, span, late) of runs: 96 bits of the hash, the first sentence and the end in one.

    late: the same task has seen a place of the run that comes before.
    """

    def make() -> Callable[[list], dict]:
        seen: dict[tuple, tuple] = {}  # the least place so far of runs that came twice or more in a batch
        known = np.zeros(0, dtype=np.uint64)

        def of(rows: list) -> dict:
            nonlocal known
            order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc"], rows[i]["tid"]))
            found = Sentences([rows[i]["text"] or "" for i in order])
            a, z, high, low = found.runs(sentences, words)
            text = found.text[a] if len(a) else a
            base = np.searchsorted(found.text, text)  # the first sentence of each text
            span = a - base << 32 | z - base
            # Texts with the same id and hash are one: their places are equal.
            same = [0] * len(order)
            for k in range(1, len(order)):
                x, y = rows[order[k - 1]], rows[order[k]]
                same[k] = same[k - 1] + ((x["doc"], x["tid"]) != (y["doc"], y["tid"]))
            whose = np.array(same, dtype=np.int64)[text]
            by = np.lexsort((a, low, high))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])
            heads = np.flatnonzero(new)
            first = by[np.repeat(heads, np.diff(np.r_[heads, len(by)]))]  # the group's first place, of each row in by
            late = np.zeros(len(by), dtype=bool)
            late[by] = (whose[by] != whose[first]) | (span[by] != span[first])
            sizes = np.diff(np.r_[heads, len(by)])
            head = by[heads]
            for g in np.flatnonzero((sizes > 1) | np.isin(high[head], known)).tolist():
                k = head[g]
                row = rows[order[text[k]]]
                key, place = (int(high[k]), int(low[k])), (row["doc"], row["tid"], int(span[k]))
                least = seen.get(key)
                if least is not None and least < place:
                    late[by[heads[g] : heads[g] + sizes[g]]] = True
                elif least is not None or sizes[g] > 1:
                    seen[key] = place
            if len(seen) > SEEN:
                seen.clear()
            known = np.sort(np.array([k[0] for k in seen], dtype=np.uint64))
            return {"_take": np.array(order, dtype=np.int64)[text], "high": high.view(np.int64), "low": low.view(np.int32), "span": span, "late": late}

        return of

    docs = docs.withColumn("_motif_row", F.struct("text", "doc", "tid"))
    return map_texts(docs, "_motif_row", ["doc", "tid"], make, "high long, low int, span long, late boolean")


def _repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key and place, those that are late or not the first place of their key."""
    last = np.zeros((0, 5), dtype=np.int64)  # key and first place of the last key that is not late
    for b in batches:
        late = b["late"].to_numpy()
        rows = np.concatenate([last, b.loc[~late, ["high", "low", "doc", "tid", "span"]].to_numpy(np.int64)])
        if len(rows):
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            more = rows[(rows[:, 2:] != rows[first, 2:]).any(axis=1)]
            if len(more):
                yield pd.DataFrame(more[:, 2:], columns=["doc", "tid", "span"])
            last = rows[first[-1:]]
        if late.any():
            yield b.loc[late, ["doc", "tid", "span"]]


def repeated_runs(docs: DataFrame, sentences: int = 2, words: int = 12) -> DataFrame:
    """(doc, tid, start, end): the places, in sentences, of every run that another place precedes."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tid"), "text")
    places = _places(rows, sentences, words)
    # Late places need no company: they are spread by place, the others meet by key.
    route = F.when(F.col("late"), F.xxhash64("doc", "tid", "span")).otherwise(F.xxhash64("high", "low"))
    met = places.repartition(route).sortWithinPartitions("high", "low", "doc", "tid", "span")
    found = met.mapInPandas(_repeats, "doc long, tid long, span long")
    return found.select("doc", "tid", F.shiftright("span", 32).cast("int").alias("start"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int").alias("end"))


def _cover(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole(spans: list[tuple[int, int]], real: list) -> list[tuple[int, int]]:
    """spans cut down to what lies between real ends; one without such a part stays as it is."""
    out = []
    for a, b in spans:
        begin = next((i for i in range(a, b) if i == 0 or real[i - 1]), b)
        end = next((i for i in range(b, begin, -1) if real[i - 1]), begin)
        out.append((begin, end) if begin < end else (a, b))
    return out


def _without(column: str, spans: str, df: DataFrame, keep: list[str]) -> DataFrame:
    def run(rows: list) -> dict:
        texts, removed, places = [], [], []
        found = Sentences([row["text"] or "" for row in rows])
        heads = np.searchsorted(found.text, np.arange(len(rows) + 1)).tolist()
        for k, row in enumerate(rows):
            gone = _whole(_cover([(s["start"], s["end"]) for s in row["spans"] or ()]), found.real[heads[k] : heads[k + 1]])
            texts.append(row["text"])
            removed.append(sum(b - a for a, b in gone))
            places.append([])
            if gone:
                raw = row["text"].encode("utf-8", "surrogatepass")
                first = (found.first[heads[k] : heads[k + 1]] - found.offsets[k]).tolist()
                cuts = [0, *first[1:], len(raw)]  # white space before the first sentence goes with it
                count = np.r_[0, np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)]  # code points
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at : cuts[a]])
                    at = cuts[b]
                    places[-1].append(f"{count[cuts[a]]}:{count[at]}")
                texts[-1] = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
        counts = np.diff(heads).tolist()
        return {"text": texts, "n_sentences": [None if t is None else n for t, n in zip(texts, counts)], "n_removed": removed, "removed": places}

    df = df.withColumn("_motif_pair", F.struct(F.col(column).alias("text"), F.col(spans).alias("spans")))
    return map_texts(df, "_motif_pair", keep, lambda: run, "text string, n_sentences int, n_removed int, removed array<string>")


def remove_repeats(docs: DataFrame, sentences: int = 2, words: int = 12) -> DataFrame:
    """Every row of docs with its text without repeated sentences, n_sentences, n_removed and removed (char spans).

    The order that makes a place the first is doc_id (missing ids last), then a hash of the text, then position. Rows that
    repeat both id and text are one document: none of them counts as a repetition of the other. Null texts stay null and
    have no sentences; texts shorter than a run stay as they are; other columns stay. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spans = repeated_runs(docs, sentences, words)
    spans = spans.groupBy("doc", "tid").agg(F.collect_set(F.struct("start", "end")).alias("_motif_spans"))
    keyed = docs.withColumn("_motif_doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_motif_tid", F.xxhash64("text"))
    joined = keyed.join(spans.withColumnsRenamed({"doc": "_motif_doc", "tid": "_motif_tid"}), ["_motif_doc", "_motif_tid"], "left")
    others = [c for c in docs.columns if c != "text"]
    return _without("text", "_motif_spans", joined, others)


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there, brought in line with the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
