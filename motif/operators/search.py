"""Search over a corpus of described rows: keywords, TF-IDF and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from motif.functions import exprs
from motif.storage import kept

FEATURES = 512
MOST_QUERIES = 1000
#: Rows that are compared with a block of queries at once; a score that is beyond all others, in millionths.
PACKED, LAST = 1024, 1 << 40


# English words that carry no meaning of their own.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can "
    "cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself "
    "his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves "
    "out over own same she should so some such than that the their theirs them themselves then there these they this those through "
    "to too under until up us very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def keyword_search(rows: DataFrame, query: str, name: str, description: str, tags: str, code: str, k: int = 5) -> DataFrame:
    """rows with score: the whole query, in any case, in the name .8, the description .5, each tag .3, the code .2."""
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    part = lambda c, w: F.when(has(F.col(c)), F.lit(w)).otherwise(0.0)
    matching = F.size(F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), has)) * F.lit(0.3)
    score = F.round(part(name, 0.8) + part(description, 0.5) + matching + part(code, 0.2), 6)
    scored = rows.withColumn("score", score).where("score > 0") if query.strip() else rows.withColumn("score", score).where("false")
    return scored.orderBy(F.desc("score"), name).limit(k)


def corpus_text(*parts: Column) -> Column:
    """Texts and arrays of texts joined by spaces; null parts are left out."""
    return F.concat_ws(" ", *parts)


def _worded(rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, words): of each row the words of two characters or more that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0))
    return rows.select(key, F.filter(found, lambda w: ~w.isin(words)).alias("words"))


def _neighbours(worded: DataFrame, key: str) -> DataFrame:
    """(key, word, after): each word with the one after it, null for the last."""
    zipped = F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")))
    # The outer form, filtered after: a plain explode makes the optimizer ask for the array's size below, and compute it twice.
    return worded.select(key, F.explode_outer(zipped).alias("_z")).select(key, "_z.*").toDF(key, "word", "after").where("word is not null")


def _pair() -> Column:
    return F.concat("word", F.lit(" "), "after")


def _counted(worded: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, term, tf): of the wanted terms, which are FEATURES or few more, those in a row: words and pairs of neighbours."""
    terms = _neighbours(worded, key).select(key, F.explode(F.array("word", _pair())).alias("term"))
    return terms.join(F.broadcast(wanted.select("term")), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))


def weigh(rows: DataFrame, key: str, text: str, idf: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(key, term, weight) of rows under a fitted model's idf (term, idf), which has FEATURES rows or few more; of unit length."""
    return _unit(_counted(_worded(rows, key, text, STOP_WORDS if words is None else words), key, idf), key, idf)


def _unit(counted: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    weighted = counted.where(F.col(key).isNotNull()).join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # over the features in a row
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))


def skill_text() -> Column:
    """What a skill is found by."""
    return corpus_text(F.col("skill_name"), F.col("description"), F.col("tags"), F.col("category"), F.col("language"))


class TfIdf:
    """A fitted model: weights(key, term, weight) of unit length, idf(term, idf) of at most `features` terms.

    key names a row. Features are the terms with most occurrences in the corpus, ties in order of term; idf is ln((1+n)/(1+df)) + 1.
    The words of the rows are written once. A pair occurs no more often than its first word, which also precedes it in order of
    term, so only pairs that begin with one of the `features` most frequent words are counted; then only features, within rows.
    """

    def __init__(self, rows: DataFrame, key: str, text: str, features: int = FEATURES, words: list[str] | None = None):
        self.key, self.words = key, STOP_WORDS if words is None else words
        first = lambda totals: totals.orderBy(F.desc("total"), "term").limit(features)
        worded = kept(_worded(rows, key, text, self.words), "words")
        total = F.count("*").alias("total")
        often = kept(first(worded.select(F.explode_outer("words").alias("term")).where("term is not null").groupBy("term").agg(total)), "often")
        begun = _neighbours(worded, key).where("after is not null").join(F.broadcast(often.select(F.col("term").alias("word"))), "word", "left_semi")
        best = kept(first(often.unionByName(begun.groupBy(_pair().alias("term")).agg(total))), "features")
        counted = kept(_counted(worded, key, best), "counts")
        self.n = worded.count()
        df = counted.groupBy("term").agg(F.count("*").alias("df"))
        self.idf = df.select("term", (F.log((1 + F.lit(self.n)) / (1 + F.col("df"))) + 1).alias("idf"))  # features rows at most
        self.weights = _unit(counted, key, self.idf)
        self.rows = rows

    def query(self, text: str) -> DataFrame:
        """(term, weight) of a query, of unit length."""
        spark = self.rows.sparkSession
        one = spark.createDataFrame([(0, text)], "q int, text string")
        counted = _counted(_worded(one, "q", "text", self.words), "q", self.idf)
        weighted = counted.join(self.idf, "term").select("term", (F.col("tf") * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy()))  # over a query's terms
        return weighted.select("term", (F.col("w") / norm).alias("weight"))

    def search(self, text: str, k: int = 5) -> DataFrame:
        """(key, score): the k rows with the greatest cosine, those without any common term at zero, ties in order of key."""
        q = self.query(text).withColumnRenamed("weight", "qw")
        hits = self.weights.join(F.broadcast(q), "term").groupBy(self.key).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
        scored = self.rows.select(self.key).join(hits, self.key, "left").select(self.key, F.coalesce("score", F.lit(0.0)).alias("score"))
        return scored.orderBy(F.desc("score"), self.key).limit(k)


def search(rows: DataFrame, query: str, k: int = 5, mode: str = "auto") -> DataFrame:
    """Skills with score. auto: TF-IDF with two skills or more, else keywords; a blank query finds nothing."""
    if not query.strip():
        return rows.withColumn("score", F.lit(0.0)).where("false")
    if mode == "auto":
        mode = "tfidf" if len(rows.take(2)) > 1 else "keyword"
    if mode == "keyword":
        return keyword_search(rows, query, "skill_name", "description", "tags", "code", k)
    hits = TfIdf(rows.withColumn("_text", skill_text()), "skill_name", "_text").search(query, k)
    return rows.join(F.broadcast(hits), "skill_name").orderBy(F.desc("score"), "skill_name")


def hash_buckets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight): the hash vector of each row in sparse form, of unit length; nothing is shuffled."""
    counted = rows.select(key, exprs.run_lengths(exprs.word_buckets(F.col(text))).alias("_c"))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["n"] * c["n"]))
    each = counted.withColumn("_n", norm).select(key, "_n", F.explode_outer("_c").alias("_c")).where("_c is not null")
    return each.select(key, F.col("_c.value").alias("bucket"), F.round(F.col("_c.n") / F.col("_n"), 6).alias("weight"))


def query_vector(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(term, weight) of a query against a corpus: TF-IDF with two rows or more, else its hash vector, by bucket."""
    if len(rows.take(2)) > 1:
        return TfIdf(rows, key, text).query(query)
    one = rows.sparkSession.createDataFrame([(0, query)], "q int, text string")
    return hash_buckets(one, "q", "text").select(F.col("bucket").cast("string").alias("term"), "weight")


def _packed(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """Rows of one length of vector, `most` at the most, in one row, ordered by key: n, dims, kinds, keys, vectors and their lengths.

    Kinds: 0 where the vector or one of its components is null, so that every cosine is zero; 1 where it can be compared.
    """
    keys = rows.schema[key].dataType
    schema = T.StructType().add("n", T.LongType()).add("dims", T.LongType()).add("keys", T.ArrayType(keys)).add("kinds", T.BinaryType()).add("vectors", T.BinaryType()).add("lengths", T.BinaryType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def put(dims: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(dims))
            t = t.take(pc.sort_indices(t, sort_keys=[("key", "ascending")], null_placement="at_start"))
            kinds = t["dims"].is_valid().to_numpy()
            v = np.zeros((len(t), dims))
            v[kinds] = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(kinds.sum(), dims)
            lengths = np.sqrt(np.einsum("ed,ed->e", v, v))
            of = [len(t)], [dims], [t["key"].to_pylist()], [kinds.tobytes()], [v.tobytes()], [lengths.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(of, types)], schema=types)

        types = to_arrow_schema(schema)
        for b in batches:
            dims = pc.fill_null(b.column("dims"), 0).to_numpy()
            for d in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == d))
                while len(some):
                    room = most - sum(map(len, held.get(d, [])))
                    held.setdefault(d, []).append(some.slice(0, room))
                    if len(some) >= room:
                        yield put(d)
                    some = some.slice(room)
        for d in list(held):
            yield put(d)

    whole = F.when(F.forall(vector, lambda x: x.isNotNull()), F.col(vector)).cast("array<double>")
    return rows.select(F.col(key).alias("key"), whole.alias("vector"), F.size(whole).alias("_n")).select("key", "vector", F.when(F.col("_n") >= 0, F.col("_n")).alias("dims")).mapInArrow(pack, schema)


def _best(k: int, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of packed rows and packed queries, (query, key, score) of those that can be among the k nearest.

    All rows of a block are compared with all queries of one by one matrix product. A block gives k of its rows for a query at
    most, ties in order of key, and none that is less than the k-th one of a block that the task has seen.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, least = to_arrow_schema(schema), {}
        for b in batches:
            for r in range(len(b)):
                get = lambda name, r=r: b.column(name)[r]
                sides = []
                for side in ("", "q_"):
                    n, dims = get(side + "n").as_py(), get(side + "dims").as_py()
                    read = lambda name, side=side, **x: np.frombuffer(get(side + name).as_py(), **x)
                    sides.append((n, dims, read("kinds", dtype=bool), read("vectors").reshape(n, dims), read("lengths")))
                (n, dims, kinds, v, lengths), (m, q_dims, q_kinds, q, q_lengths) = sides
                norm = q_lengths[:, None] * lengths[None, :]
                with np.errstate(all="ignore"):
                    score = q @ v.T / norm if dims == q_dims else np.full((m, n), -np.inf)  # -inf: no cosine
                    score[(norm == 0) | ~kinds[None, :] | ~q_kinds[:, None]] = 0.0
                    steps = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5), score)
                    steps = np.where(np.isnan(score), LAST, np.where(score == -np.inf, -LAST, steps)).astype(np.int64)
                place = steps * n + np.arange(n - 1, -1, -1)  # of equal scores the first key is the greatest
                take = np.argpartition(place, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), (m, n))
                found = np.take_along_axis(steps, take, axis=1)
                known = least.get(id_ := get("q_id").as_py())
                good = found >= known[:, None] if known is not None else np.ones(found.shape, dtype=bool)
                if n >= k:
                    least[id_] = found.min(axis=1) if known is None else np.maximum(known, found.min(axis=1))
                at, j = np.nonzero(good)
                value = found[at, j]
                none = value == -LAST
                value = np.where(value == LAST, np.nan, value / 1e6)
                columns = [get("q_keys").values.take(pa.array(at)), get("keys").values.take(pa.array(take[at, j])), pa.array(value, mask=none)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types)], schema=types)

    return of


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score): of each query vector the k rows with the greatest cosine, in double precision, rounded to six digits.

    Rows are packed in blocks of PACKED and queries in blocks of MOST_QUERIES, both written once to the shared folder. Every block meets
    every block in a Cartesian product: the work is queries times rows, by matrix products, and a task holds a pair of blocks.
    """
    blocks = kept(_packed(rows, key, vector, PACKED), "rows")
    asked = kept(_packed(queries, key, vector, MOST_QUERIES).withColumn("id", F.monotonically_increasing_id()), "queries")
    asked = asked.withColumnsRenamed({c: f"q_{c}" for c in asked.columns})
    schema = T.StructType().add("query", queries.schema[key].dataType).add(key, rows.schema[key].dataType).add("score", T.DoubleType())
    scored = blocks.crossJoin(asked).mapInArrow(_best(k, schema), schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
