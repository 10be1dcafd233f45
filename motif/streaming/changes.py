"""A stream of file saves: paths that are new or whose modification time changed since the last look.

A source lists the trees, by folders, in tasks; its offset is the time of a look. What was there at the last look is the state of
an operator keyed by parts of the paths, and what it gives is read in tasks too. The driver lists a few folders to share the trees, and goes through small trees to see that no look is needed.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from motif.functions import exprs
from motif.schema import Settings
from motif.sources.paths import opened

LISTED = "part int, path string, mtime double, look long, first boolean"
SAVED = "event_seq long, path string, mtime double"
#: Bytes of text a task holds before it hands them on.
HELD = 4 << 20
#: Folders that the driver opens at most to share the trees among tasks.
OPENED = 256
#: Files of a tree that the driver goes through at most to see that nothing has changed and no look is needed.
GLANCED = 20000


def _entries(folder: str, settings: Settings) -> tuple[list[str], Iterator[tuple[str, float]]]:
    """The folders in a folder that are not ignored, and (path, mtime) of its watched files. Folders that are links are left out."""
    system, at = opened(folder)
    try:
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    except OSError:
        found = []
    base = folder.rstrip("/")
    linked = lambda i: isinstance(system, fs.LocalFileSystem) and os.path.islink(i.path)
    folders = [f"{base}/{i.base_name}" for i in found if i.type == fs.FileType.Directory and i.base_name not in settings.ignored_dirs and not linked(i)]
    return folders, ((f"{base}/{i.base_name}", i.mtime_ns / 1e9) for i in found if i.type == fs.FileType.File and i.base_name.endswith(settings.extensions))


def list_tree(root: str, settings: Settings = Settings()) -> Iterator[tuple[str, float]]:
    """(path, mtime) of the watched files below a folder. One that can't be read has none."""
    left = [root]
    while left:
        folders, found = _entries(left.pop(), settings)
        yield from found
        left += folders


@dataclass
class Folders(InputPartition):
    """Folders for one task: of `deep` ones everything below, of `flat` ones the files in them."""

    deep: list[str]
    flat: list[str]
    look: int
    first: bool
    parts: list[int]


class Listing(DataSource):
    """format("motif_listing"): at each look one row for each watched file, and one without a path for each part.

    Options: paths (JSON list), parts (of the paths, by checksum; fixed for a checkpoint), quiet (seconds to go on looking after a change), splits (tasks).
    """

    @classmethod
    def name(cls) -> str:
        return "motif_listing"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema):  # noqa: N802  the name that Spark calls
        o = self.options
        return ListingReader(json.loads(o["paths"]), int(o.get("parts", 64)), float(o.get("quiet", 0)), int(o.get("splits", 8)))


class ListingReader(DataSourceStreamReader):
    def __init__(self, roots: list[str], parts: int, quiet: float, splits: int):
        self.roots, self.parts, self.quiet, self.splits = roots, parts, quiet, splits
        self.look, self.rested, self.seen, self.changed = None, False, None, 0.0
        for r in roots:
            system, at = opened(r)
            if system.get_file_info(at).type != fs.FileType.Directory:
                raise FileNotFoundError(r)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"look": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The time of this look in microseconds; that of the last one if nothing can have changed.

        Whether it can is seen here for trees of up to GLANCED files. Larger ones are looked at by every second trigger, as is any
        tree in which a save may still wait for its pause to end.
        """
        now, seen = time.time(), self._glance()
        if self.look is None or seen is not None and seen != self.seen:
            self.changed, due = now, True
        else:
            due = self.rested and (seen is None or now - self.changed <= 2 * self.quiet + 10 * (self.quiet > 0))
        self.rested = not due
        if due:
            self.look, self.seen = max(int(now * 1e6), (self.look or 0) + 1), seen
        return {"look": self.look}

    def _glance(self) -> int | None:
        """A digest of the paths and times of a small tree, whatever their order."""
        total, left = 0, GLANCED
        for root in self.roots:
            for path, mtime in list_tree(root):
                left -= 1
                if left < 0:
                    return None
                total += int.from_bytes(hashlib.blake2b(f"{path}\0{mtime}".encode("utf-8", "surrogateescape"), digest_size=8).digest())
        return total % (1 << 64)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start == end:
            return []
        deep, flat = list(self.roots), []
        while deep and len(deep) < 4 * self.splits and len(flat) < OPENED:
            folder = deep.pop(0)
            flat.append(folder)
            deep += _entries(folder, Settings())[0]
        n = max(1, min(self.splits, len(deep) + len(flat)))
        return [Folders(deep[i::n], flat[i::n], end["look"], start["look"] == 0, list(range(i, self.parts, n))) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        told = partition.look, partition.first
        for part in partition.parts:
            yield part, None, None, *told
        for folder in partition.flat:
            yield from self._rows(_entries(folder, Settings())[1], told)
        for folder in partition.deep:
            yield from self._rows(list_tree(folder), told)

    def _rows(self, found: Iterator[tuple[str, float]], told: tuple) -> Iterator[tuple]:
        for path, mtime in found:
            yield zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.parts, path, mtime, *told


class Snapshot(StatefulProcessor):
    """Of the paths of one part those that are new, or have another time, than at the last look; the state is what is there now.

    With a pause, a path is told once a look finds it as it was first seen so long ago or longer: a burst of saves counts once.
    What was there at the very first look is told only if it is to be filled back. A path that went and came again is new.
    """

    def __init__(self, backfill: bool, quiet: float):
        self.backfill, self.quiet = backfill, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        # since: the look that first saw this time of the path, null once it is told.
        self.there = handle.getValueState("there", "paths array<string>, mtimes array<double>, since array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = {}
        if self.there.exists():
            paths, mtimes, since = self.there.get()
            before = dict(zip(paths, zip(mtimes, since)))
        now, saved = {}, []
        for b in rows:
            for path, mtime, look, first in zip(b["path"], b["mtime"], b["look"], b["first"]):
                if path is None or path in now:
                    continue
                known = before.get(path)
                waits = known[1] if known and known[0] == mtime else None if first and not self.backfill else int(look)
                if waits is not None and look - waits >= self.quiet * 1e6:
                    saved.append((round(mtime * 1e6), path, mtime))
                    waits = None
                now[path] = (mtime, waits)
        if now != before:
            self.there.update((list(now), [m for m, _ in now.values()], [s for _, s in now.values()]))
        if saved:
            yield pd.DataFrame(sorted(saved), columns=["event_seq", "path", "mtime"])

    def close(self) -> None:
        pass


def changed(listing: DataFrame, backfill: bool = False, quiet: float = 0.0) -> DataFrame:
    """(event_seq, path, mtime) of what each look (LISTED rows, one look a micro-batch) finds new or changed."""
    return listing.groupBy("part").transformWithStateInPandas(Snapshot(backfill, quiet), SAVED, "Append", "None")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source: UTF-8, invalid bytes left out. Files that went in the meantime are left out."""
    for b in batches:
        held, size = [], 0
        for row in b.itertuples(index=False):
            try:
                system, at = opened(row.path)
                with system.open_input_stream(at) as f:
                    text = f.read().decode("utf-8", "ignore")
            except OSError:
                continue
            held.append((*row, text))
            size += len(text)
            if size >= HELD:
                yield pd.DataFrame(held, columns=[*b.columns, "source"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=[*b.columns, "source"])


def saves(spark: SparkSession, dirs: list[str], backfill: bool = False, quiet: float = 0.0, parts: int = 64) -> DataFrame:
    """A stream (event_seq, path, mtime, source, language) of saves below folders; event_seq is the time of the save in microseconds.

    Folders may be remote. A part of the paths is one task's at a time and one value of state: take a part for some ten thousand
    files. Start it where the state store is that of mining.STORE; its trigger tells how often the folders are looked at. Folders
    inside others are told once.
    """
    spark.dataSource.register(Listing)
    splits = max(8, spark.sparkContext.defaultParallelism)
    roots = sorted({d.rstrip("/") or "/" for d in dirs})
    listing = spark.readStream.format("motif_listing").options(paths=json.dumps(roots), parts=parts, quiet=quiet, splits=splits).load()
    return changed(listing, backfill, quiet).mapInPandas(_read, f"{SAVED}, source string").withColumn("language", exprs.language_of(F.col("path")))
