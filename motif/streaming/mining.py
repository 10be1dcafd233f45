"""Mining of saved files as a stream: patterns of units, sets of functions and chains of calls, each given once.

A file is one row with all its units, so what concerns the whole file needs no state. Its events are its eligible units, by
structure, its set of functions, and the chain of calls from each unit. Two stateful operators follow: the first counts events
by kind and key up to the threshold, the second lets each pattern, and each set of names of either kind, through once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from motif.functions import exprs, pyast
from motif.functions.parse import file_units
from motif.operators import compositions
from motif.schema import Settings
from motif.storage import settings as session_settings
from motif.streaming.promote import first_of_each

#: The kinds of events: as in compositions, and units.
SET, CHAIN, UNIT = 0, 1, 2
EVENT = (
    "kind int, key string, once string, k int, event_seq long, path string, unit_pos int, source_code string, abstract_signature string, language string, "
    "complexity_score double, node_type string, decorators array<string>, calls array<string>"
)
PROMOTED = f"{EVENT}, contexts array<string>"
ORDER = ["event_seq", "path", "kind", "unit_pos"]
#: The stateful operators keep their state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class CountToK(StatefulProcessor):
    """At event k of a key: that event, with the source of the first one if it is a unit, and the paths of events 1 to k.

    Within a micro-batch events count in their order. State holds k paths and one source at most, and a count after that.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int, source string, paths array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, source, paths = self.seen.get() if self.seen.exists() else (0, None, [])
        best, k = None, None
        for b in rows:
            k = int(b["k"].iloc[0])
            if n < k:
                best = (b if best is None else pd.concat([best, b])).sort_values(ORDER, kind="stable").head(k - n)
        if best is None:
            return
        if n == 0 and key[0] == UNIT:
            source = best["source_code"].iloc[0]
        paths = [*(paths or []), *best["path"]]
        n += len(best)
        self.seen.update((n, None, []) if n >= k else (n, source, paths))
        if n >= k:
            last = best.tail(1)
            if key[0] == UNIT:
                last = last.assign(source_code=[source])
            yield last.assign(contexts=[paths])

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """The first row of each key, in the order of the events that promoted them, and none after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.told.exists():
            return
        first = None
        for b in rows:
            first = (b if first is None else pd.concat([first, b])).sort_values(ORDER, kind="stable").head(1)
        if first is not None:
            self.told.update((True,))
            yield first

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:  # noqa: N802
        self.told.update((True,))

    def close(self) -> None:
        pass


def _once(kind: str, what: Column) -> Column:
    return F.concat(F.lit(f"{kind}\u0001"), what)


def _set_of(names: Column) -> Column:
    return _once("names", F.array_join(F.array_sort(F.array_distinct(names)), "\u0001"))


def known_to(skills: DataFrame) -> DataFrame:
    """(once) of skills that exist, for the initial state of a first batch: patterns by hash. Compositions, whose hash doesn't tell
    their names apart from their order, are compared by hash when they are handed over."""
    return skills.where("pattern_hash is not null").select(_once("hash", F.col("pattern_hash")).alias("once")).distinct()


def events_of(files: DataFrame, settings: Settings) -> DataFrame:
    """EVENT rows of files (event_seq, path, units)."""
    none = F.lit(None)
    fields = [f.split()[0] for f in EVENT.split(", ")[6:]]

    def event(**columns: Column) -> Column:
        kinds = {f.split()[0]: f.split()[1] for f in EVENT.split(", ")} | {"names": "array<string>", "name": "string", "n_lines": "int"}
        return F.struct(*[columns.get(n, none).cast(kinds[n]).alias(n) for n in ("kind", *fields, "names", "name", "n_lines")])

    unit = F.transform("units", lambda u: event(kind=F.lit(UNIT), unit_pos=u["unit_pos"], source_code=u["source_code"], language=u["language"], node_type=u["node_type"], decorators=u["decorators"], calls=u["calls"], name=u["name"], n_lines=u["n_lines"]))
    found = unit
    if settings.detect_compositions:
        shaped = F.transform("units", lambda u: F.struct(u["unit_pos"].alias("unit_pos"), u["name"].alias("name"), u["node_type"].alias("node_type"), u["language"].alias("language"), u["source_code"].alias("source_code"), compositions.simple_calls(u["calls"]).alias("simple")))
        files = files.withColumn("_shaped", shaped)
        every = F.col("_shaped")

        def composed(c: Column) -> Column:
            chain = c["kind"] == CHAIN
            parts = F.array_join(compositions.sources_of(chain, c["key"], every), "\n\n")
            return event(kind=c["kind"], unit_pos=c["unit_pos"], source_code=parts, abstract_signature=F.array_join(F.slice(c["key"], 1, 4), " → "), language=F.get(every, F.lit(0))["language"], complexity_score=F.lit(5.0), node_type=F.lit("composed"), decorators=F.array(), calls=c["key"], names=c["key"])

        long_enough = F.filter(compositions.found_in("_shaped"), lambda c: F.size(c["key"]) >= 2)
        found = F.concat(unit, F.when(F.size("units") >= 2, F.transform(long_enough, composed)).otherwise(F.slice(F.transform("units", lambda u: event()), 1, 0)))
    rows = files.select("event_seq", "path", F.explode(found).alias("e")).select("event_seq", "path", "e.*")
    is_unit, source = F.col("kind") == UNIT, F.col("source_code")
    wanted = (F.col("n_lines") >= settings.min_lines) & (F.lit(settings.detect_classes) | (F.col("node_type") != "class"))
    rows = rows.where(~is_unit | wanted)
    key, complexity = pyast.facts(F.when(is_unit, F.col("language")), source, exprs.token_hash(source), exprs.branch_complexity(source))
    rows = rows.withColumns({"_hash": F.when(is_unit, key), "_complexity": F.when(is_unit, complexity)})
    rows = rows.where(~is_unit | (F.col("_complexity") >= settings.min_complexity) & (F.col("_hash") != ""))
    return rows.select(
        "kind", F.when(is_unit, F.col("_hash")).otherwise(F.array_join("names", "\u0001")).alias("key"), F.when(is_unit, _once("hash", F.col("_hash"))).otherwise(_set_of(F.col("names"))).alias("once"),
        F.when(is_unit, settings.min_frequency).otherwise(settings.min_co_occurrence).alias("k"), "event_seq", "path", "unit_pos", "source_code",
        F.when(is_unit, exprs.signature(F.col("node_type"), F.col("name"), F.col("calls"))).otherwise(F.col("abstract_signature")).alias("abstract_signature"),
        "language", F.coalesce("_complexity", "complexity_score").alias("complexity_score"), "node_type", "decorators", "calls",
    )


def promoted(files: DataFrame, settings: Settings, known: DataFrame | None = None) -> DataFrame:
    """Candidates of a stream of files (event_seq, path, units), with kind and names; those of known (once) not again.

    Start it under STORE. A composition takes its parts from the file that promoted it, a pattern its source from the first one.
    """
    most = max(settings.min_frequency, settings.min_co_occurrence)
    few = first_of_each(events_of(files, settings), most, ["kind", "key"], ORDER)
    counted = few.groupBy("kind", "key").transformWithStateInPandas(CountToK(), StructType.fromDDL(PROMOTED), "Append", "None")
    initial = known.groupBy("once") if known is not None else None
    told = counted.groupBy("once").transformWithStateInPandas(Once(), StructType.fromDDL(PROMOTED), "Append", "None", initial)
    is_unit = F.col("kind") == UNIT
    return told.select(
        "kind", F.when(is_unit, F.col("key")).otherwise(exprs.composite_hash(F.col("calls"))).alias("structural_hash"), "source_code", "abstract_signature", "language", F.col("k").cast("long").alias("frequency"),
        F.get("contexts", F.lit(0)).alias("first_seen_file"), F.when(is_unit, F.col("contexts")).otherwise(F.slice("contexts", 1, 5)).alias("contexts"), "complexity_score", "node_type", "decorators", "calls",
    )


def mine(saves: DataFrame, settings: Settings, on_candidates: Callable[[DataFrame, int], None], checkpoint: str, period: str = "1 second", known: DataFrame | None = None):
    """Starts the loop from saves (event_seq, path, source) to candidates; on_candidates gets each micro-batch's new ones."""
    found = promoted(file_units(saves), settings, known)
    with session_settings(saves.sparkSession, STORE):
        return found.writeStream.outputMode("append").foreachBatch(on_candidates).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()
