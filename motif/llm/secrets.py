"""Secret scans with DataFrame functions alone: rules, and two character Markov models.

Rules find assignments of passwords and the like, access keys and long hexadecimal strings. Beside them, every other token
of at least 20 characters that has both a letter and a digit is scored by two first-order Markov models of characters: one of
random strings, one of ordinary identifiers. A token whose mean log-likelihood ratio is above the threshold is a secret.

The models are trained here from labelled samples, `SAMPLE` strings of each label that functions of a row's number make:
digests in several alphabets, and identifiers put together from common words, case styles and version numbers. Counting
their character pairs gives a table of at most SYMBOLS^2 rows for each label, whatever the corpus.

Places in code points: one sign is put before and one after each match, and the characters of the marked text are looked
through once; the place of the k-th sign, less k, is a place in the text. Everything takes time in proportion to a text's
length, but for searches in sorted arrays of spans, which take its logarithm for each token.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the rules. Greedy runs make {n,} the same as + followed by dropping shorter matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_=.-]{20,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
SAMPLE = 4000
THRESHOLD = 0.75

WORDS = (
    "user name data file path index count total value key list map set get put add remove update delete create read write "
    "open close start stop run test main config option default server client request response handler service manager "
    "factory builder parser reader writer buffer stream channel session event queue worker thread pool cache store table "
    "column row query result error message status code type class method function module package version build release "
    "report summary detail page image button window panel layout style color width height size offset length time date "
    "year month week day hour order item price account customer product invoice payment address city country region"
).split()


def _pick(seed: Column, k: int) -> Column:
    words = F.array(*map(F.lit, WORDS))
    return F.get(words, F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(len(WORDS))).cast("int"))


def labelled_sample(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """(label, text): n random strings (1) and n identifiers (0), the same in every run."""
    rows = spark.range(n)
    i = F.col("id")
    raw = F.sha2(i.cast("string"), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(raw)), r"\s", "")
    random = F.element_at(
        F.array(base64, F.lower(raw), F.regexp_replace(base64, "[+/=]", ""), F.upper(F.regexp_replace(base64, "[+/=]", "")), F.translate(base64, "+/=", "-_")),
        (F.pmod(i, F.lit(5)) + 1).cast("int"),
    )
    a, b, c, d = (_pick(i, k) for k in range(4))
    number = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(3000)).cast("string")
    styles = F.array(
        F.concat_ws("_", a, b, c, number),
        F.concat_ws("-", a, b, c, d, number),
        F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d), number),
        F.concat_ws("/", a, b, F.concat(c, F.lit("_"), d, F.lit("."), number)),
        F.upper(F.concat_ws("_", a, b, c, number)),
        F.concat_ws(".", F.lit("com"), a, b, F.concat(F.initcap(c), F.initcap(d)), F.concat(F.lit("v"), number)),
    )
    plain = F.element_at(styles, (F.pmod(i, F.lit(6)) + 1).cast("int"))
    return rows.select(F.lit(1).alias("label"), random.alias("text")).unionByName(rows.select(F.lit(0).alias("label"), plain.alias("text")))


def train(spark: SparkSession, n: int = SAMPLE) -> list[float]:
    """The log-likelihood ratio of each pair of characters, by place in SYMBOLS; unseen pairs count one each."""
    pairs = labelled_sample(spark, n).select("label", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair"))
    counted = pairs.groupBy("label", "pair").count().collect()  # 2 * len(SYMBOLS)^2 rows at most
    size = len(SYMBOLS)
    table = [[1.0] * (size * size) for _ in range(2)]
    for r in counted:
        if all(c in SYMBOLS for c in r["pair"]):
            table[r["label"]][SYMBOLS.index(r["pair"][0]) * size + SYMBOLS.index(r["pair"][1])] += r["count"]
    out = []
    for k in range(size):
        plain, random = (sum(table[x][k * size : (k + 1) * size]) for x in (0, 1))
        out += [math.log(table[1][j] / random) - math.log(table[0][j] / plain) for j in range(k * size, (k + 1) * size)]
    return out


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's character pairs; characters outside SYMBOLS must not occur."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    size = len(SYMBOLS)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    # A transform over one array gives the array a name, so it is made once.
    total = F.element_at(
        F.transform(
            F.array(codes),
            lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda s, i: s + F.get(table, F.get(x, i - 1) * size + F.get(x, i))),
        ),
        1,
    )
    return total / (F.length(token) - 1)


SPANS = "array<struct<start:int,kind:int,end:int>>"
SIGN = "\ue000"  # a private character; in texts it gives way to another one, which no pattern has either


def _places(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end) of all matches in a text without SIGN."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{SIGN}$0{SIGN}"))
    found = F.transform(
        F.array(F.split(marked, "")),
        lambda chars: F.transform(F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.get(chars, i) == SIGN), lambda i, k: i - k),
    )
    pairs = lambda at: F.transform(
        F.sequence(F.lit(0), F.size(at) - 2, F.lit(2)),
        lambda k: F.struct(F.get(at, k).alias("start"), F.lit(kind).alias("kind"), F.get(at, k + 1).alias("end")),
    )
    return F.when(text.rlike(pattern), F.element_at(F.transform(found, pairs), 1)).otherwise(F.array().cast(SPANS))


def _overlapped(span: Column, others: Column) -> Column:
    """Whether a span meets one of others, which are in order and apart: the last that begins before its end decides."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        before = F.get(others, middle)["start"] < span["end"]
        go = state["low"] < state["high"]
        low = F.when(go & before, middle + 1).otherwise(state["low"])
        return F.struct(low.alias("low"), F.when(go & ~before, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(others) + F.lit(1.0))).cast("int") + 1)
    last = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(others).alias("high")), halve, lambda x: x["low"] - 1)
    return (F.size(others) > 0) & F.coalesce(F.get(others, last)["end"] > span["start"], F.lit(False))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts, base_sha256, spans and n_spans of every row of docs (doc_id, text, any more columns).

    A null or empty text has no spans. Repeated rows stay, with equal results; an empty table gives no rows. A token
    that overlaps a span of the rules isn't scored.
    """
    model = train(docs.sparkSession)
    text = F.col("_t")
    # Only the documents' own columns are read; each step is used more than once and stays a projection of its own.
    rows = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), SIGN, "\ue001").alias("_t"))
    none = F.array().cast("array<string>")
    groups = lambda p, k: F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(k))).otherwise(none)
    rows = rows.select(
        "doc_id",
        groups(ASSIGN, 2).alias("_values"),
        groups(TOKEN, 0).alias("_tokens"),
        *[_places(text, p, k).alias(f"_s{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))],
    )
    # What a function over an array needs besides is in the array: an expression it names could be worked out for each element.
    rows = rows.withColumns({"_v": F.arrays_zip("_s0", "_values"), "_t": F.arrays_zip("_s3", "_tokens")})
    long = F.transform(F.filter("_v", lambda x: F.length(x["_values"]) >= 6), lambda x: x["_s0"])
    rows = rows.select("doc_id", "_t", long.alias("_s0"), "_s1", "_s2")
    rows = rows.select("*", F.array_sort(F.concat("_s0", "_s1", "_s2")).alias("_base"), *[F.size(f"_s{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)])

    def secret(x: Column, base: Column) -> Column:
        span, token = x["_s3"], x["_tokens"]
        mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
        met = _overlapped(span, base["_s0"]) | _overlapped(span, base["_s1"]) | _overlapped(span, base["_s2"])
        return F.when(mixed & ~met, likelihood_ratio(token, model) > threshold).otherwise(False)

    more = F.transform(F.array(F.struct("_t", "_s0", "_s1", "_s2")), lambda x: F.transform(F.filter(x["_t"], lambda t: secret(t, x)), lambda t: t["_s3"]))
    rows = rows.withColumn("_more", F.when(F.size("_t") > 0, F.element_at(more, 1)).otherwise(F.array().cast(SPANS)))
    rows = rows.withColumn("_all", F.array_sort(F.concat("_base", "_more")))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown("_base"), 256).alias("base_sha256"), shown("_all").alias("spans"), F.size("_all").cast("long").alias("n_spans"))
