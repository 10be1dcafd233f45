"""Fuzzy matching of sources by their token sequences.

similar_pairs is exact for its threshold: of two token multisets whose overlap reaches t/(2-t) of the smaller bound, the
rarest tokens of both must meet, so pairs come from an equality join on those tokens alone; then the size and overlap bounds
cut them, and only what is left goes to the sequence matcher.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motif.functions import exprs
from motif.storage import kept


@F.pandas_udf(T.DoubleType())
def ratio(left: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Similarity of two token arrays in a struct (a, b); 0 if one is empty. Not symmetric."""
    for batch in left:
        yield pd.Series([SequenceMatcher(None, list(a), list(b)).ratio() if len(a) and len(b) else 0.0 for a, b in zip(batch["a"], batch["b"])], dtype="float64")


def _tokens(rows: DataFrame, key: str, source: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), exprs.fuzzy_tokens(F.col(source)).alias("tokens")).where(F.size("tokens") > 0)


def overlap_bounds(rows: DataFrame, key: str, source: str, threshold: float) -> DataFrame:
    """(new_id, old_id, n_new, n_old, overlap) of pairs, the older id first seen, whose overlap allows the threshold."""
    toks = _tokens(rows, key, source)
    each = toks.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).groupBy("id", "n", "t").agg(F.count("*").alias("c"))
    # Element (t, i) stands for the i-th occurrence of t, so that multisets become sets.
    elements = each.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")), lambda i: F.concat_ws("\u0001", "t", i))).alias("e"))
    rarity = elements.groupBy("e").agg(F.count("*").alias("df"))
    share = threshold / (2 - threshold)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "e"))
    prefix = elements.join(rarity, "e").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1)
    a = prefix.where("df > 1").select(F.col("e"), F.col("id").alias("new_id"), F.col("n").alias("n_new"))
    b = prefix.where("df > 1").select(F.col("e"), F.col("id").alias("old_id"), F.col("n").alias("n_old"))
    sizes = F.least("n_new", "n_old") * 2 >= F.lit(threshold) * (F.col("n_new") + F.col("n_old"))
    pairs = a.join(b, "e").where((F.col("new_id") > F.col("old_id")) & sizes).select("new_id", "old_id", "n_new", "n_old").distinct()
    left = each.select(F.col("id").alias("new_id"), "t", F.col("c").alias("c1"))
    right = each.select(F.col("id").alias("old_id"), "t", F.col("c").alias("c2"))
    shared = pairs.join(left, "new_id").join(right, ["old_id", "t"]).groupBy("new_id", "old_id", "n_new", "n_old").agg(F.sum(F.least("c1", "c2")).alias("overlap"))
    return shared.where(F.col("overlap") * 2 >= F.lit(threshold) * (F.col("n_new") + F.col("n_old")))


def similar_pairs(rows: DataFrame, key: str, source: str, threshold: float) -> DataFrame:
    """(new_id, old_id, ratio) of pairs strictly above the threshold; the new one is compared with the old one."""
    toks = _tokens(rows, key, source)
    a, b = toks.select(F.col("id").alias("new_id"), F.col("tokens").alias("a")), toks.select(F.col("id").alias("old_id"), F.col("tokens").alias("b"))
    pairs = overlap_bounds(rows, key, source, threshold).select("new_id", "old_id").join(a, "new_id").join(b, "old_id")
    return pairs.select("new_id", "old_id", ratio(F.struct("a", "b")).alias("ratio")).where(F.col("ratio") > threshold)


def rekey(keyed: DataFrame, threshold: float) -> DataFrame:
    """keyed (structural_hash, seq, source_code, ...) with new_hash: that of the most similar pattern seen earlier, else its own.

    Order-free: a hash is represented by its first source, and may only join one that was first seen before. On equal
    similarity the earlier wins. Chains are not followed.
    """
    order = Window.partitionBy("structural_hash").orderBy("seq")
    firsts = keyed.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(F.col("seq").alias("id"), "structural_hash", "source_code")
    best = similar_pairs(firsts, "id", "source_code", threshold).groupBy("new_id").agg(F.max(F.struct("ratio", (-F.col("old_id")).alias("neg"))).alias("best"))
    best = best.select(F.col("new_id").alias("id"), (-F.col("best.neg")).alias("old_id"))
    names = firsts.select("id", "structural_hash")
    moved = best.join(names, "id").join(names.select(F.col("id").alias("old_id"), F.col("structural_hash").alias("new_hash")), "old_id").select("structural_hash", "new_hash")
    return keyed.join(moved, "structural_hash", "left").withColumn("new_hash", F.coalesce("new_hash", "structural_hash"))


def _labels(pairs: DataFrame) -> DataFrame:
    """(hash, part): hashes that pairs (a, b) connect share a part, the least of them. A round is a join and a minimum by hash."""
    both = kept(pairs.unionByName(pairs.select(F.col("a").alias("b"), F.col("b").alias("a"))).distinct(), "links")
    parts = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("part")).withColumnRenamed("a", "hash"), "parts")
    while True:
        around = both.join(parts.select(F.col("hash").alias("b"), F.col("part").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = parts.join(around, F.col("hash") == F.col("a")).select("hash", F.least("part", "other").alias("part"), (F.col("other") < F.col("part")).alias("moved"))
        step = kept(step, "parts")
        parts = step.drop("moved")
        if not step.where("moved").take(1):
            return parts


def _alike(versions: DataFrame, threshold: float) -> DataFrame:
    """(new_class, old_class, ratio) above the threshold of token sequences (class, tokens), in both directions, each with itself."""
    bounds = overlap_bounds(versions, "class", "source_code", threshold).select(F.col("new_id").alias("x"), F.col("old_id").alias("y"))
    found = bounds.unionByName(bounds.select(F.col("y").alias("x"), F.col("x").alias("y")))
    tokens = versions.select("class", exprs.fuzzy_tokens(F.col("source_code")).alias("tokens"))
    a, b = tokens.select(F.col("class").alias("x"), F.col("tokens").alias("a")), tokens.select(F.col("class").alias("y"), F.col("tokens").alias("b"))
    scored = found.join(a, "x").join(b, "y").select(F.col("x").alias("new_class"), F.col("y").alias("old_class"), ratio(F.struct("a", "b")).alias("ratio")).where(F.col("ratio") > threshold)
    same = tokens.where(F.size("tokens") > 0).select(F.col("class").alias("new_class"), F.col("class").alias("old_class"), F.lit(1.0).alias("ratio"))
    return scored.unionByName(same) if threshold < 1 else scored


def rekey_in_order(keyed: DataFrame, threshold: float, chunks: int = 1000) -> DataFrame:
    """keyed (structural_hash, seq, source_code, ...) with new_hash, as rekey_sequential gives it to the events in order of seq.

    An unseen hash joins the stored one whose latest source is most similar, if above the threshold, of equals the one
    stored first; it isn't stored itself, but its source becomes the other's latest. So who joins whom depends on what went
    before. That is solved in rounds: from everyone's keys, taken as they are, each event's key is found anew, until no key
    changes. An event depends on earlier ones only, so the first wrong one is right after a round, and the end is the
    sequential result; rounds are as many as absorptions depend on one another.

    Hashes without a similar one keep their keys and stay out. Equal token sequences are compared once. Within a connected
    part of similar hashes an event that repeats the one before it changes nothing and is left out as well, so a text in very
    many events is few of them. seq is unique; sources without tokens are similar to nothing. An empty table gives no rows.
    """
    order = keyed.select("seq", F.col("structural_hash").alias("hash"), F.coalesce("source_code", F.lit("")).alias("source_code"))
    order = order.withColumn("class", F.xxhash64(exprs.fuzzy_tokens(F.col("source_code"))))
    versions = kept(order.groupBy("class").agg(F.first("source_code").alias("source_code")), "versions")
    alike = kept(_alike(versions, threshold), "alike")
    events = kept(order.select("seq", "hash", "class"), "order")
    owners = kept(events.select("hash", "class").distinct(), "owners")
    # Hashes that share a token sequence, or have similar ones.
    hub = owners.groupBy("class").agg(F.min("hash").alias("hub"))
    joined = owners.join(hub, "class").where("hash != hub").select(F.col("hash").alias("a"), F.col("hub").alias("b"))
    linked = alike.where("new_class > old_class").join(hub.withColumnsRenamed({"class": "new_class", "hub": "a"}), "new_class").join(hub.withColumnsRenamed({"class": "old_class", "hub": "b"}), "old_class").select("a", "b")
    parts = _labels(joined.unionByName(linked).where("a != b"))
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    width = ((high or 0) - (low or 0)) // chunks + 1
    inside = events.join(parts, "hash").withColumn("chunk", F.floor((F.col("seq") - F.lit(low or 0)) / F.lit(width)))
    # A chunk is a stretch of time: it only splits the work of finding repeats.
    before = Window.partitionBy("part", "chunk").orderBy("seq")
    begins = F.coalesce((F.lag("hash").over(before) != F.col("hash")) | (F.lag("class").over(before) != F.col("class")), F.lit(True))
    inside = inside.withColumn("begins", begins).withColumn("head", F.last(F.when(F.col("begins"), F.col("seq")), True).over(before))
    inside = kept(inside.select("seq", "hash", "class", "part", "head"), "inside")
    now = inside.where("seq = head").select("seq", "hash", "class", "part", F.col("hash").alias("key"))
    while True:
        keys = now.groupBy("part", "key").agg(F.min("seq").alias("since"))
        own = keys.select("part", F.col("key").alias("hash"), F.col("since").alias("stored"))
        asking = now.join(own, ["part", "hash"], "left").where("stored is null or stored >= seq")
        grid = asking.select("part", "seq", F.col("class").alias("asks")).join(keys, "part").where("since < seq")
        # Each stored key's events and the questions to it, in order: a question sees the last event before it.
        line = grid.select("part", "key", "seq", "asks", "since", F.lit(None).cast("long").alias("class")).unionByName(now.select("part", "key", "seq", F.lit(None).cast("long").alias("asks"), F.lit(None).cast(now.schema["seq"].dataType).alias("since"), "class"))
        latest = F.last("class", True).over(Window.partitionBy("part", "key").orderBy("seq", F.col("asks").isNull()))
        seen = line.withColumn("latest", latest).where("asks is not null").join(alike.select(F.col("new_class").alias("asks"), F.col("old_class").alias("latest"), "ratio"), ["asks", "latest"])
        best = seen.groupBy("seq").agg(F.max_by("key", F.struct("ratio", -F.col("since"))).alias("best"))
        step = now.join(best, "seq", "left").select("seq", "hash", "class", "part", F.coalesce("best", "hash").alias("key"), (F.coalesce("best", "hash") != F.col("key")).alias("moved"))
        step = kept(step, "round")
        now = step.drop("moved")
        if not step.where("moved").take(1):
            break
    found = inside.select("seq", "head").join(now.select(F.col("seq").alias("head"), F.col("key").alias("new_hash")), "head").select("seq", "new_hash")
    return keyed.join(found, "seq", "left").withColumn("new_hash", F.coalesce("new_hash", "structural_hash"))


def rekey_sequential(rows: list[tuple], threshold: float) -> list[str]:
    """The arrival-order form, for small ordered inputs (hash, tokens): an unseen hash joins the stored one whose latest
    tokens are most similar, if above the threshold; an absorbed hash is not stored."""
    stored: dict[str, list[str]] = {}
    out = []
    for key, tokens in rows:
        if key not in stored:
            best, most = key, threshold
            for other, seen in stored.items():
                score = SequenceMatcher(None, tokens, seen).ratio() if tokens and seen else 0.0
                if score > most:
                    best, most = other, score
            key = best
        stored[key] = tokens
        out.append(key)
    return out
