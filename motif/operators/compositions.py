"""Compositions: sets of functions that recur across files, and chains of calls, each promoted once.

Units are gathered by file once; sets and chains are expressions over a file's units, so a chain of five hops costs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motif.functions.exprs import let
from motif.operators.patterns import promote

DEPTH = 5
CALLABLE = ("function", "arrow_fn", "hook")


def simple_calls(calls: Column) -> Column:
    return F.transform(F.coalesce(calls, F.array().cast("array<string>")), lambda c: F.element_at(F.split(c, r"\."), -1))


def by_file(units: DataFrame) -> DataFrame:
    """(event_seq, path, units): the units of each event in order; simple: their calls without what stands before the last dot."""
    unit = F.struct("unit_pos", "name", "node_type", "language", "source_code", simple_calls(F.col("calls")).alias("simple"))
    return units.groupBy("event_seq", "path").agg(F.array_sort(F.collect_list(unit), lambda a, b: a["unit_pos"] - b["unit_pos"]).alias("units"))


def _names(units: str = "units") -> Column:
    """Sorted distinct names of functions."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(units, lambda u: u["node_type"].isin(*CALLABLE)), lambda u: u["name"])))


def _last(units: Column, name: Column) -> Column:
    """Of the units with a name, the last one counts."""
    return F.element_at(F.filter(units, lambda u: u["name"] == name), -1)


def _chains(units: str = "units", depth: int = DEPTH) -> Column:
    """Array of (unit_pos, chain): from every unit, the first local call not yet visited, depth times at most.

    The first hop follows the unit's own calls, even if a later unit has the same name.
    """
    every = F.col(units)
    local = F.transform(every, lambda u: u["name"])
    none = F.array().cast("array<string>")

    def hop(state: Column, names: Column) -> Column:
        following = F.get(F.filter(state["calls"], lambda c: F.array_contains(names, c) & ~F.array_contains(state["chain"], c)), F.lit(0))
        return let(
            following,
            lambda n: F.when(n.isNull(), F.struct(state["chain"].alias("chain"), none.alias("calls"))).otherwise(
                F.struct(F.concat(state["chain"], F.array(n)).alias("chain"), _last(every, n)["simple"].alias("calls"))
            ),
        )

    def walk(unit: Column, names: Column) -> Column:
        first = F.struct(F.array(unit["name"]).alias("chain"), unit["simple"].alias("calls"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), first, lambda state, _: hop(state, names), lambda state: state["chain"])

    return let(F.array_distinct(local), lambda names: F.transform(every, lambda u: F.struct(u["unit_pos"].alias("unit_pos"), walk(u, names).alias("chain"))))


def name_sets(units: DataFrame) -> DataFrame:
    """(event_seq, path, names) of each event with at least two units and two function names."""
    found = by_file(units).where(F.size("units") >= 2).select("event_seq", "path", _names().alias("names"))
    return found.where(F.size("names") >= 2)


def call_chains(units: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(event_seq, path, unit_pos, chain) of every unit."""
    return by_file(units).select("event_seq", "path", F.explode(_chains(depth=depth)).alias("c")).select("event_seq", "path", "c.unit_pos", "c.chain")


def joined_chains(units: DataFrame, depth: int = DEPTH) -> DataFrame:
    """call_chains by joins, for files of so many units that one row can't hold them; work grows with the calls, not their square.

    A chain holds depth names at most before its last hop, so the first depth + 1 local calls of a unit are all that can matter:
    what a hop shuffles is bounded for each unit. Chains that have ended keep keys of their own, so they don't meet in one task. A
    name that very many units call is one row of the smaller side, so a join's hot part can be split (AQE does).
    """
    file = ["event_seq", "path"]
    shaped = units.select(*file, "unit_pos", "name", F.array_distinct(simple_calls(F.col("calls"))).alias("simple"))
    names = shaped.where("name is not null").select(*file, "name").distinct()
    called = shaped.select(*file, "unit_pos", F.posexplode("simple").alias("_at", "name")).join(names, [*file, "name"])
    first = called.groupBy(*file, "unit_pos").agg(F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("_c"))
    first = first.select(*file, "unit_pos", F.transform(F.slice("_c", 1, depth + 1), lambda c: c["name"]).alias("local"))
    known = shaped.select(*file, "unit_pos", "name").join(first, [*file, "unit_pos"], "left")
    last = known.where("name is not null").groupBy(*file, "name").agg(F.max_by(F.struct("local"), "unit_pos")["local"].alias("_then")).withColumnRenamed("name", "_next")
    walk = known.select(*file, "unit_pos", F.array("name").alias("chain"), "local")
    for _ in range(depth):
        following = F.get(F.filter("local", lambda c: ~F.array_contains("chain", c)), F.lit(0))
        # An ended chain asks for a name that no unit has.
        walk = walk.withColumn("_n", following).withColumn("_next", F.coalesce("_n", F.concat(F.lit("\u0000"), F.col("unit_pos").cast("string"))))
        chain = F.when(F.col("_n").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("_n")))
        walk = walk.join(last, [*file, "_next"], "left").select(*file, "unit_pos", chain.alias("chain"), F.col("_then").alias("local"))
    return walk.select(*file, "unit_pos", "chain")


def found_in(units: str = "units") -> Column:
    """Array of (kind, unit_pos, key) of a file's units: its set of functions (kind 0), then the chain of every unit (kind 1)."""
    event = lambda kind, pos, key: F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("unit_pos"), key.alias("key"))
    return F.concat(F.array(event(0, F.lit(-1), _names(units))), F.transform(_chains(units), lambda c: event(1, c["unit_pos"], c["chain"])))


def sources_of(chain: Column, key: Column, every: Column) -> Column:
    """The sources of a composition's parts: of a chain in its order, of a set in the order of the units."""
    return F.when(chain, F.transform(key, lambda n: _last(every, n)["source_code"])).otherwise(
        F.transform(F.filter(every, lambda u: F.array_contains(key, u["name"])), lambda u: u["source_code"])
    )


def name_of(chain: Column, key: Column) -> Column:
    few = F.slice(key, 1, 3)
    return F.when(chain, F.array_join(few, "_to_")).otherwise(F.array_join(few, "_and_"))


def compositions(units: DataFrame, k: int = 2) -> DataFrame:
    """Sets and chains at their k-th event; a set of names is promoted once across both kinds, by the earliest event.

    In one event the set comes before the chains, and chains in the order of their units.
    """
    files = by_file(units).where(F.size("units") >= 2)
    events = files.select("event_seq", "path", F.explode(found_in()).alias("e")).select("event_seq", "path", "e.*").where(F.size("key") >= 2)
    when = F.struct("event_seq", "path", "kind", "unit_pos")
    kth = promote(events, ["kind", "key"], ["event_seq", "path", "unit_pos"], k, {}, {"at": when}, {"contexts": F.col("path")})
    once = Window.partitionBy(F.array_sort(F.array_distinct("key"))).orderBy("at")
    kth = kth.withColumn("_r", F.row_number().over(once)).where("_r = 1").select("*", "at.event_seq", "at.path").drop("_r", "at")
    joined = kth.join(files, ["event_seq", "path"])
    chain, key, every = F.col("kind") == 1, F.col("key"), F.col("units")
    return joined.select(
        name_of(chain, key).alias("name"), key.alias("component_names"), sources_of(chain, key, every).alias("component_sources"), F.when(chain, "pipeline").otherwise("co_occurrence").alias("pattern_type"), F.get(every, F.lit(0))["language"].alias("language"),
        "frequency", F.slice("contexts", 1, 5).alias("contexts"), F.when(chain, key).otherwise(F.array().cast("array<string>")).alias("call_chain"),
    )


def combined_source() -> Column:
    return F.array_join("component_sources", "\n\n")
