"""Language identification by nearest centroids of TF-IDF character n-grams.

A text becomes lower-case letters with one space between words; its n-grams of one to three characters are counted in
hashed features, damped, weighted by inverse document frequency over all training documents, and normalised. Each
language's vectors, of a bounded sample of labelled rows, are clustered into several centroids (spherical k-means). A text
gets the language of its nearest centroid by cosine. It is rejected if even that is further away, by a margin, than nearly
all texts of that language in the sample were, or if it has no letter. There are so many features that few n-grams of a long
foreign text share one with a language's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, small_batches

FEATURES = 1 << 16
#: The share of a language's sample that may be odd without a say in what is rejected.
ODD = 0.05
#: Texts with fewer features reach less: the cosine of a few n-grams with a broad centroid grows as the root of their number.
ENOUGH = 64
#: Characters whose n-grams are held at once.
PART = 1 << 18


def letter_table() -> np.ndarray:
    """Of each UTF-16 unit: the lower-case letter, or a space for anything else."""
    out = np.full(1 << 16, 32, dtype=np.uint32)
    for i in range(1 << 16):
        out[i] = _letter(chr(i))
    return out


def _letter(c: str) -> int:
    if not c.isalpha():
        return 32
    low = c.lower()
    return ord(low if len(low) == 1 else c)


def _letters(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The letters, or spaces, of code points (or UTF-16 units without surrogates)."""
    if raw.dtype == np.uint16:
        return table[raw]
    out = table[np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]).tolist():
        out[raw == c] = _letter(chr(c))
    return out


def counts(text: str, table: np.ndarray) -> np.ndarray | None:
    """How often each feature occurs in a whole text; None if it has no letter."""
    raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    if ((raw & 0xF800) == 0xD800).any():  # letters beyond 16 bits
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = None
    for at in range(0, len(raw), PART):
        x = _letters(raw[max(0, at - 2) : at + PART], table)
        x = np.r_[np.uint32(32), x, np.uint32(32)]
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
        if len(x) < 3:
            continue
        a, b, c = x[:-2], x[1:-1], x[2:]
        two = b * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA6B)
        three = two ^ a * np.uint32(0xC2B2AE35)
        grams = np.concatenate([two, (three ^ three >> np.uint32(15)) * np.uint32(0x27D4EB2F), b * np.uint32(0x165667B1)]) >> np.uint32(16)
        part = np.bincount(grams, minlength=FEATURES)
        out = part if out is None else out + part
    return out


def vector(tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that a text has, and their weights: a unit vector."""
    k = np.flatnonzero(tf)
    v = np.log1p(tf[k]) * idf[k]
    return k, (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # index into languages of each centroid
    least: np.ndarray  # of each language: rejected below this cosine


def is_training(doc_id: str = "doc_id", lang: str = "lang") -> F.Column:
    return (F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) != 0) & F.col(lang).isNotNull()


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each feature occurs, and how many texts have letters."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, df, n = letter_table(), np.zeros(FEATURES, dtype=np.int64), 0
        for b in batches:
            for t in b["text"]:
                if t and (tf := counts(t, table)) is not None:
                    df += tf > 0
                    n += 1
        k = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.r_[-1, k], "n": np.r_[n, df[k]]})

    rows = docs.select("text").mapInPandas(of, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    df, n = np.zeros(FEATURES), 0
    for r in rows:
        if r["feature"] < 0:
            n = int(r["n"])
        else:
            df[r["feature"]] = r["n"]
    return df, n


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; empty clusters go."""
    starts = [0]
    near = vectors @ vectors[0]
    for _ in range(min(k, len(vectors)) - 1):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[starts[-1]])
    c = vectors[starts]
    for _ in range(rounds):
        mine = np.argmax(vectors @ c.T, axis=1)
        c = np.stack([(mine == i).astype(vectors.dtype) @ vectors for i in np.unique(mine)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(docs: DataFrame, sample: int = 2000, clusters: int = 4, margin: float = 0.3) -> Model:
    """A model from docs (text, lang, doc_id): rows with a language whose crc32(doc_id) mod 5 is not 0.

    Document frequencies count all of them. Centroids come from `sample` rows at most, that is sample / languages rows of
    each language, chosen by hashes of their ids. margin: a text is rejected if its cosine is below this
    share of the cosine that all but ODD of the sample's texts of its language reach; texts of fewer than
    ENOUGH features need less.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(is_training()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    languages = sorted(r["lang"] for r in sizes.select("lang").limit(sample + 1).collect())
    if len(languages) > sample:
        raise ValueError(f"more than {sample} languages")
    df, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((0, FEATURES), np.float32), np.zeros(0, int), np.zeros(0))
    # A share of each language's ids that should hold four times what is wanted goes to the ranking, however many there are.
    each, scale = max(1, sample // len(languages)), 1 << 30
    place = F.xxhash64("doc_id", F.lit(17))
    few = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(F.pmod(place, F.lit(scale)) * F.col("rows") < 4.0 * each * scale)
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    picked = few.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).drop("k")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        table = letter_table()
        found = [vector(tf, idf) for t in pdf["text"] if t and (tf := counts(t, table)) is not None]
        if not found:
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        used = np.unique(np.concatenate([k for k, _ in found]))
        v = np.zeros((len(found), len(used)), dtype=np.float32)
        for row, (k, x) in zip(v, found):
            row[np.searchsorted(used, k)] = x
        few = _clusters(v, clusters)
        few = few[np.bincount(np.argmax(v @ few.T, axis=1), minlength=len(few)) >= ODD * len(v) / clusters]  # odd texts are no centre
        least = float(np.quantile((v @ few.T).max(axis=1), ODD))
        c = np.zeros((len(few), FEATURES), dtype=np.float32)
        c[:, used] = few
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centroid": list(c), "least": [least] * len(c)})

    chosen = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")  # sample rows at most
    chosen = chosen.dropDuplicates(["doc_id", "lang"])
    fitted = chosen.groupBy("lang").applyInPandas(fit, "lang string, centroid array<float>, least double").collect()
    languages = sorted({r["lang"] for r in fitted})
    at = {x: i for i, x in enumerate(languages)}
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    least = np.zeros(len(languages))
    for r in fitted:
        least[at[r["lang"]]] = margin * r["least"]
    centroids = np.array([r["centroid"] for r in fitted], dtype=np.float32).reshape(-1, FEATURES)
    return Model(languages, idf, centroids, np.array([at[r["lang"]] for r in fitted], dtype=int), least)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred, score and rejected of every row, from the text alone.

    A null text, or one without a letter, gets `und`, score 0, and is rejected; so does every text if the model knows no
    language. Equal texts give equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # a few rows of FEATURES floats for each language

    def make() -> Callable[[list], dict]:
        table, m = letter_table(), Model(**shared.value)
        turned = np.ascontiguousarray(m.centroids.T)

        def run(texts: list) -> dict:
            lang, score, rejected = [], [], []
            for t in texts:
                tf = counts(t, table) if t and m.languages else None
                if tf is None:
                    lang.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                features, weights = vector(tf, m.idf)
                cosines = weights @ turned[features]
                k = int(np.argmax(cosines))
                best = min(1.0, max(0.0, float(cosines[k])))
                lang.append(m.languages[m.owner[k]])
                score.append(best)
                rejected.append(bool(best < m.least[m.owner[k]] * min(1.0, len(features) / ENOUGH) ** 0.5))
            return {"lang_pred": lang, "score": score, "rejected": rejected}

        return run

    return map_texts(docs, text, keep, make, "lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; a missing id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def crc_mod(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
