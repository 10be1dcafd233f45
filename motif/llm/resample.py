"""Resampling of documents toward a target's distribution of word runs, by importance weights with Gumbel noise.

Features are hashed into buckets; each bucket's gain is the logarithm of how much more of the target than of the documents it
holds, and a document's weight is the sum over its features. Weights are array sums in the tasks that read the texts; only
counts by bucket and (id, score) rows leave them. The k greatest scores are found without a sort of all rows: counts of the key's
leading digits tell which cell holds the k-th key, then the next digits inside that cell, first of the score, then of the id.
Only the rows up to that key are sorted, by ranges, and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, map_texts, materialize, small_batches

BUCKETS = 10_000
#: Key bits that one counting pass settles: at most 65,537 counts come to the driver.
DIGIT = 16
#: Bytes of a text whose words are held at once.
PART = 1 << 20

# In UTF-8 with A-Z lowered, the bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, and all bytes of other characters.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def feature_buckets(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to 3 words that end in them) of each part of a text.

    A run's checksum goes on from that of the run without its last word, also across parts.
    """
    raw = text.encode("utf-8", "surrogatepass").lower()
    at, crc = 0, zlib.crc32
    last1 = last2 = None  # checksums of the last word and the last two words so far
    while at < len(raw):
        cut = GAP.search(raw, at + PART) if at + PART < len(raw) else None
        end = cut.start() if cut else len(raw)
        words = WORD.findall(raw, at, end)
        at = end
        if not words:
            continue
        after = [b" " + w for w in words]
        one = list(map(crc, words))
        two = list(map(crc, after, [last1, *one])) if last1 is not None else list(map(crc, after[1:], one))
        if last2 is not None:
            three = list(map(crc, after, [last2, *two]))
        else:
            three = list(map(crc, after[1 if last1 is not None else 2 :], two))
        last1, last2 = one[-1], two[-1] if two else last2
        yield len(words), np.array(one + two + three, dtype=np.int64) % BUCKETS


def bucket_counts(rows: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all rows fall into each bucket. A task sends a row for each bucket at most."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, buckets in feature_buckets(value.as_py() or ""):
                    total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = rows.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in counted.collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln of its share of the target over its share of the documents), each count plus one."""
    s_all, t_all = float(docs.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(docs.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id's digest; a missing id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def make() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            words, features, weights = [], [], []
            for text in texts:
                w = f = total = 0
                for n, buckets in feature_buckets(text or ""):
                    w, f, total = w + n, f + len(buckets), total + int(gain[buckets].sum())
                words.append(w)
                features.append(f)
                weights.append(total)
            return {"n_words": words, "n_features": features, "weight": weights}

        return run

    found = map_texts(docs, "text", ["doc_id"], make, "n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _settle(rows: DataFrame, key: str, low: int, high: int, k: int, descending: bool) -> tuple[int, int, bool]:
    """The k-th value of key among rows, all in [low, high]: (value, how many of that value are wanted, whether that is all of them).

    Each pass counts rows by their next DIGIT bits inside the cell that holds the k-th one. If a cell's rows are all wanted,
    its far end is the answer and no further pass is needed.
    """
    while True:
        shift = max(0, (high - low).bit_length() - DIGIT)
        cell = F.shiftright(key, shift) - F.lit(low >> shift)
        counts = rows.where(F.col(key).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()
        for row in sorted(counts, key=lambda r: r["cell"], reverse=descending):
            if k <= row["n"]:
                break
            k -= row["n"]
        begin = (row["cell"] + (low >> shift)) << shift
        low, high = max(low, begin), min(high, begin + (1 << shift) - 1)
        if k == row["n"] or low == high:
            return low if descending else high, k, k == row["n"]


def kth_key(rows: DataFrame, k: int) -> tuple[int, int]:
    """(score, id) of the k-th row of (score, id) by falling score, then rising id; k is between 1 and the number of rows."""
    least, most = rows.agg(F.min("score"), F.max("score")).first()
    score, k, whole = _settle(rows, "score", least, most, k, True)
    if whole:
        return score, NO_ID
    tied = rows.where(F.col("score") == score)
    least, most = tied.agg(F.min("id"), F.max("id")).first()
    return score, _settle(tied, "id", least, most, k, False)[0]


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows in the given order, dealt to tasks by ranges, with their rank from 1: a task numbers its rows, counts by task are added."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            places = np.arange(at + 1, at + 1 + len(b))
            at += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), task, dtype=np.int32)), pa.array(places)], names=[*b.schema.names, "task", "place"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, task int, place long")
    placed = materialize(placed, "ranked")
    before, offsets = 0, []
    for row in sorted(placed.groupBy("task").agg(F.max("place").alias("n")).collect()):  # a row for each task
        offsets.append((row["task"], before))
        before += row["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "task int, before long")
    return placed.join(F.broadcast(starts), "task").withColumn("rank", F.col("place") + F.col("before")).drop("task", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; rank numbers the drawn ones, others have none.

    Drawn are floor(percent N / 100) of the N documents with least_words words or more: the greatest scores, ties to smaller
    ids. Null and wordless texts have no features and weight 0; a missing id is the largest. Rows that repeat an id are
    documents of their own, with ranks of their own. An empty target makes all of its counts zero; an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = materialize(weighted(docs, gain, seed).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))), "weighted")
    drawable = F.col("n_words") >= least_words
    k = percent * scored.where(drawable).count() // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    score, last = kth_key(scored.where(drawable), k)
    taken = drawable & ((F.col("score") > score) | (F.col("score") == score) & (F.col("id") <= last))
    ranked = _numbered(scored.where(taken), [F.desc("score"), F.asc("id"), F.asc("weight"), F.asc("n_features")])
    # Rows that repeat the k-th key may be more than are wanted of it.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.select(*out).unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("long")).select(*out))
