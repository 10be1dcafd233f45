"""Packing of documents into sequences by cutting-stock column generation.

A document's ids and one closing id are cut at every `size` ids: full pieces, and a remainder, which is cut once more at
half of `size` if it is longer, since pieces of more than half can't share a sequence. Lengths are counted in units of
`grain` ids, rounded up. The histogram of lengths has size/grain classes at most, so it alone goes to the
driver, where a linear program covers it with patterns (how many pieces of each class share a sequence). A knapsack
dynamic program over the duals finds the pattern that the program lacks most, until none would help. Each pattern's
share is rounded down; what this leaves, fewer pieces than patterns times pieces in a pattern, is packed by first fit
decreasing into patterns used once.

Every piece gets its rank within its class, from counts by class and salt, so that a class that holds a third of all
rows is ranked by many tasks. Ranks are dealt out to the patterns in intervals, which fixes a piece's sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordBpe
from .common import map_texts, materialize


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Where the pieces of a document of n ids begin and end."""
    out = [(at, min(at + size, n)) for at in range(0, n, size)]
    at, end = out[-1]
    if size // 2 < end - at < size:
        out[-1:] = [(at, at + size // 2), (at + size // 2, end)]
    return out


def pieces(docs: DataFrame, path: str, size: int, close: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every row; a null text is empty."""

    def make() -> Callable[[list], dict]:
        bpe, closing = WordBpe(path), np.array([close], dtype="<u4")

        def run(texts: list) -> dict:
            take, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(bpe.encode_each(texts)):
                ids = np.concatenate([ids, closing])
                for at, end in cuts(len(ids), size):
                    part = ids[at:end]
                    take.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            return {"_take": take, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}

        return run

    return map_texts(docs, "text", ["doc_id"], make, "start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of that room with items of these values and (rising) weights: best value, counts."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        k = int(np.searchsorted(weights, c, side="right"))
        best[c] = best[c - 1]
        if k:
            sums = best[c - weights[:k]] + values[:k]
            w = int(np.argmax(sums))
            if sums[w] > best[c]:
                best[c], last[c] = sums[w], w
    counts, c = np.zeros(len(values), dtype=np.int64), room
    while c > 0:
        if last[c] >= 0:
            counts[last[c]] += 1
            c -= weights[last[c]]
        else:
            c -= 1
    return float(best[room]), counts


def cutting_stock(demand: np.ndarray, weights: np.ndarray, room: int, gap: float = 1e-3, max_columns: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row of counts for each, by weight) and how often each is used, fractional. demand is positive.

    The revised simplex method on: minimise the number of sequences so that all demand is covered. It starts with the
    patterns that hold one class alone, and stops when no pattern is worth more than 1 + gap sequences at the current
    duals: then no solution has fewer sequences than this one divided by 1 + gap.
    """
    m = len(demand)
    columns = np.diag(room // weights).astype(float)  # the basis, a column for each class
    inverse, cost = np.diag(1.0 / (room // weights)), np.ones(m)
    target = demand * (1 + 1e-4 * np.arange(1, m + 1) / m)  # no two alike, so the method doesn't stall
    x = inverse @ target
    for _ in range(max_columns):
        duals = cost @ inverse
        surplus = int(np.argmin(duals))
        if duals[surplus] < -1e-9:  # covering more than the demand is free
            column, price_of = np.zeros(m), 0.0
            column[surplus] = -1
        else:
            value, column = price(np.maximum(duals, 0), weights, room)
            price_of = 1.0
            if value <= 1 + gap:
                break
        entering = inverse @ column
        can = entering > 1e-9
        if not can.any():
            break
        ratios = np.where(can, x / np.where(can, entering, 1), np.inf)
        out = int(np.argmin(ratios))
        x = np.maximum(x - ratios[out] * entering, 0)
        x[out] = ratios[out]
        row = inverse[out] / entering[out]
        inverse -= np.outer(entering, row)
        inverse[out] = row
        columns[:, out], cost[out] = column, price_of
    real = cost > 0
    return columns[:, real].T.astype(np.int64), x[real]


def plan(demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """Whole patterns (times, counts) that hold exactly the demand: the program's, rounded down, and the rest."""
    left, out = demand.astype(np.int64).copy(), []
    patterns, times = [np.eye(room, dtype=np.int64)[-1]], [float(demand[-1])]  # full pieces need no program
    if len(used := np.flatnonzero(demand[:-1])):
        found, uses = cutting_stock(demand[used], used + 1, room)
        for f, t in zip(found, uses):
            patterns.append(np.zeros(room, dtype=np.int64))
            patterns[-1][used] = f
            times.append(t)
    for p, t in sorted(zip(patterns, times), key=lambda x: -x[1]):
        fits = min((int(left[k] // p[k]) for k in np.flatnonzero(p)), default=0)
        n = min(int(np.floor(t + 1e-6)), fits)
        if n > 0:
            out.append((n, p))
            left -= n * p
    bins: list[list] = []  # what remains, largest first, each into the first sequence with room
    rooms: list[int] = []
    for k in np.flatnonzero(left)[::-1]:
        n = int(left[k])
        if 2 * (k + 1) > room:  # no two of these share a sequence; they stay open for smaller ones
            bins += [[k] for _ in range(n)]
            rooms += [room - k - 1] * n
            continue
        at = 0
        while n:
            while at < len(bins) and rooms[at] < k + 1:
                at += 1
            if at == len(bins):
                bins.append([])
                rooms.append(room)
            take = min(n, rooms[at] // (k + 1))
            bins[at] += [k] * take
            rooms[at] -= take * (k + 1)
            n -= take
    for b in bins:
        out.append((1, np.bincount(b, minlength=len(demand))))
    return out


def pack(docs: DataFrame, path: str, size: int = 2048, grain: int = 8, close: int = 1, salts: int = 0) -> DataFrame:
    """Every piece of docs (doc_id, text, any more columns) with its sequence_id and its offset there.

    A null or empty text is one piece of the closing id alone. Rows with the same or without a doc_id are documents of
    their own. Equal lengths are dealt out by a hash of the piece, then by doc_id, so results don't depend on how rows are
    partitioned, but for the order among rows that are equal in every column. An empty table gives no pieces.
    salts: into how many parts a length class is cut for ranking; 0 takes four times the shuffle partitions.
    """
    spark = docs.sparkSession
    room = size // grain
    rows = materialize(pieces(docs, path, size, close).withColumn("class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("class", "salt").agg(F.count("*").alias("n"))
    below = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "salt", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    histogram = np.zeros(room, dtype=np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # room rows at most
        histogram[r["class"] - 1] = r["n"]
    # Intervals of ranks by class: where one begins, its first sequence, how many of the class a sequence takes.
    begins: list[list[int]] = [[] for _ in range(room)]
    firsts, takes = [[] for _ in range(room)], [[] for _ in range(room)]
    used, sequences = np.zeros(room, dtype=np.int64), 0
    for times, pattern in plan(histogram, room):
        for k in np.flatnonzero(pattern):
            begins[k].append(int(used[k]))
            firsts[k].append(sequences)
            takes[k].append(int(pattern[k]))
            used[k] += times * pattern[k]
        sequences += times
    tables = [tuple(np.array(x[k], dtype=np.int64) for x in (begins, firsts, takes)) for k in range(room)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, out = b["rank"].to_numpy(np.int64), np.zeros(len(b), dtype=np.int64)
            classes = b["class"].to_numpy()
            for k in np.unique(classes):
                mine = classes == k
                start, first, take = tables[k - 1]
                at = np.searchsorted(start, rank[mine], side="right") - 1
                out[mine] = first[at] + (rank[mine] - start[at]) // take[at]
            yield b.drop(columns=["class", "rank"]).assign(sequence_id=out)

    order = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.join(bases, ["class", "salt"]).select(
        "doc_id", F.col("doc_id").isNull().alias("no_id"), "start", "length", "ids_crc32", "doc_tokens", "class", (F.row_number().over(order) - 1 + F.col("base")).alias("rank")
    )
    ranked = ranked.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))  # a null would turn the column into floats
    placed = ranked.mapInPandas(place, "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    placed = placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
