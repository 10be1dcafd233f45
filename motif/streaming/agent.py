"""The running miner: saved files in, skills out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motif.api import Library
from motif.streaming import changes
from motif.streaming.mining import known_to, mine


def start(library: Library, dirs: list[str], checkpoint: str, backfill: bool = False, period: str = "1 second", quiet: float = 0.0):
    """Watches directories: each save is parsed, what recurs is crystallized and registered. Returns the running query.

    Patterns and, if wanted, compositions are looked for. Their counts and what the directories held are kept below checkpoint, so a
    restart goes on; what the library already holds is not made again, even if the checkpoint is lost. The directories are
    looked at once a period; a file counts as saved once it has been quiet for so many seconds.
    """
    saves = changes.saves(library.spark, dirs, backfill, quiet)

    def hand_over(promoted: DataFrame, batch: int) -> None:
        there = library.skills().select(F.col("pattern_hash").alias("structural_hash")).where("structural_hash is not null")
        library.crystallized(promoted.join(there, "structural_hash", "left_anti"))

    return mine(saves, library.settings, hand_over, checkpoint, period, known_to(library.skills()))
