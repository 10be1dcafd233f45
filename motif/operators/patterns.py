"""Patterns: eligible units, keys, and promotion of a key at its k-th event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motif.functions import exprs, pyast
from motif.schema import Settings


def eligible(units: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Units with structural_hash and complexity_score that pass all filters, the cheap ones first."""
    kept = units.where(F.col("n_lines") >= settings.min_lines)
    if not settings.detect_classes:
        kept = kept.where("node_type != 'class'")
    source = F.col("source_code")
    key, complexity = pyast.facts(F.col("language"), source, exprs.token_hash(source), exprs.branch_complexity(source))
    scored = kept.withColumns({"structural_hash": key, "complexity_score": complexity})
    return scored.where((F.col("complexity_score") >= settings.min_complexity) & (F.col("structural_hash") != ""))


def promote(events: DataFrame, key: str | list[str], order: list, k: int, first: dict[str, Column], kth: dict[str, Column], gathered: dict[str, Column]) -> DataFrame:
    """One row for each key with k events or more: `first` from event 1, `kth` from event k, `gathered` lists of events 1 to k.

    Events beyond the k-th are cut off by rank before the shuffle (a limit for each group and task), so a key that holds
    a third of all events brings k rows from each task.
    """
    keys = [key] if isinstance(key, str) else key
    ranked = events.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    at = lambda c, n: F.max(F.when(F.col("_rank") == n, c))
    lists = {n: F.transform(F.array_sort(F.collect_list(F.struct("_rank", c.alias("v")))), lambda s: s["v"]) for n, c in gathered.items()}
    grouped = ranked.groupBy(*keys).agg(
        F.count("*").alias("frequency"),
        *[at(c, 1).alias(n) for n, c in first.items()],
        *[at(c, k).alias(n) for n, c in kth.items()],
        *[c.alias(n) for n, c in lists.items()],
    )
    return grouped.where(F.col("frequency") == k)


def candidates(units: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Promoted patterns of parsed units: the k-th event of a structural hash, in order of event_seq, then place in the file."""
    kept = eligible(units, settings)
    signature = exprs.signature(F.col("node_type"), F.col("name"), F.col("calls"))
    return promote(
        kept,
        "structural_hash",
        ["event_seq", "path", "unit_pos"],
        settings.min_frequency,
        {"source_code": F.col("source_code"), "first_seen_file": F.col("path")},
        {
            "abstract_signature": signature, "language": F.col("language"), "complexity_score": F.col("complexity_score"), "node_type": F.col("node_type"),
            "decorators": F.col("decorators"), "calls": F.col("calls"),
        },
        {"contexts": F.col("path")},
    )
