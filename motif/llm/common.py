"""What the operators of this subpackage share: written intermediate tables, functions over texts, connected components."""

from __future__ import annotations

import atexit
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from motif.storage import fresh_path
from motif.storage import table as table

#: Stands for a missing integer id where ids must be ordered: after every other id.
NO_ID = 2**63 - 1

BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB in this session, unless it asks for less: a task holds one in the JVM, one in its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", spark.conf.get(key).lower())
    now = int(size[1]) << 10 * " kmgtp".index(size[2] or " ") if size else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: nothing more can be removed through it
            return


def written() -> int:
    """How many tables have been written so far; release() takes it."""
    return len(_written)


def release(since: int = 0, keep: int = 0) -> None:
    """Removes the tables written after the first `since`, but for the last `keep`. Results that read them must be saved by then."""
    end = len(_written) - keep
    for spark, path in _written[since:end]:
        _remove(spark, path)
    del _written[since:end]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    The files stay until release() or the end of the Python process, since a result may read them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df, known to have about that many rows at most, in partitions of about `each` rows: little data makes few files."""
    return df.coalesce(max(1, -(-rows // each)))


def _signature(edges: DataFrame) -> tuple:
    """Of a set of edges: its size and an order-free digest."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the least node that it can reach.

    Alternates large-star and small-star steps until the edges are stars around their least nodes. A step needs a
    minimum by node, which is combined before the shuffle, and a join of each node's edges with that one row, which
    adaptive execution splits when a node has very many edges. Each round is written, so lineage stays short.
    """
    a, b = F.col("a"), F.col("b")
    rows = edges.count()
    e = materialize(fitted(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows), "edges")
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(fitted(small.distinct(), before[0]), "edges")
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_ids(classes: DataFrame, edges: DataFrame, node: str, rep: str) -> DataFrame:
    """classes (node, rep, ...) with root, the class's component, and component_id, the least rep in it.

    Only linked classes are aggregated; a class without a link is its own component.
    """
    roots = connected_components(edges).withColumnRenamed("node", node)
    least = classes.select(node, rep).join(roots, node).groupBy("root").agg(F.min(rep).alias("_motif_least"))
    named = roots.join(least, "root")
    own = F.col("root").isNull()
    labelled = classes.join(named, node, "left").withColumn("component_id", F.when(own, F.col(rep)).otherwise(F.col("_motif_least")))
    return labelled.withColumn("root", F.coalesce("root", node)).drop("_motif_least")


def exact(name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(df: DataFrame, column: str, keep: list[str], make: Callable[[], Callable[[list], dict]], fields: str) -> DataFrame:
    """The columns keep of df, as they are, and new fields that a function derives from the texts of a column, which may
    be structs with a field text.

    make() is called once in each task; what it returns gets the texts of an Arrow batch and returns a list or array of
    each field's values. With "_take" among them, row i of the result belongs to row _take[i] of the batch. A new field
    replaces a kept column of its name.
    """
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    keep = [k for k in keep if k not in new.names]
    schema = T.StructType([T.StructField(k, df.schema[k].dataType, True) for k in keep] + list(new.fields))
    df = df.select(*[exact(k).alias(f"_motif_k{i}") for i, k in enumerate(keep)], exact(column).alias("_motif_text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, types = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in _slices(batch):
                got = run(part.column("_motif_text").to_pylist())
                kept = [part.column(f"_motif_k{i}") for i in range(len(keep))]
                if (take := got.get("_take")) is not None:
                    kept = [k.take(pa.array(take, pa.int64())) for k in kept]
                made = [pa.array(got[f.name], types.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=pa.schema([pa.field(n, a.type) for n, a in zip(schema.names, [*kept, *made])]))

    return df.mapInArrow(of, schema)


def _slices(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes of text, so that little of it is held as Python objects at a time."""
    texts = batch.column("_motif_text")
    if pa.types.is_struct(texts.type):
        texts = pc.struct_field(texts, "text")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // size
    at = 0
    while at < len(part):
        end = int(np.searchsorted(part, part[at], side="right"))
        yield batch.slice(at, end - at)
        at = end


def hide(docs: DataFrame, known: tuple = ("doc_id", "text", "lang", "n_chars")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with private names for all columns but the known ones, so that none clashes with a new field; and the way back."""
    private = {c: c if c in known else f"_motif_c{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(private), lambda df: df.select(*[F.col(p).alias(c) for c, p in private.items()])
