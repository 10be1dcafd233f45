"""Log-probabilities of texts: every segmentation of a text into the pieces of an existing vocabulary counts, by forward recursion.

A text is its words, each behind a space mark, and an end. No piece crosses the start of a word, so a text's marginal
probability is a product over its words, and each distinct word of the corpus goes through its lattice once, wherever it stands.

The vocabulary file states its scores as ranks. A piece of rank r weighs (r + 2.7)^-s, divided by the sum over all pieces; the
exponent s is the one of EXPONENTS under which the training words are likeliest. Single bytes are pieces of the last rank, so
every text has a segmentation. At the end of each word the text ends with a probability learned from the training texts.

Ranks say little of a corpus that the vocabulary was not made for. A learned model (score_texts with learned=True, as the query has
it) starts from them and fits the pieces' probabilities to all distinct training words by expectation and maximisation. Its lattice
of a word also has one arc over the whole word if the training texts hold that, with its count less a discount; what the
discounts leave is the probability of spelling a word by pieces, known words too. So probabilities of all words sum to one.

Words and their counts meet in one shuffle. A task that scores texts knows the most frequent words, HOT at most, by heart;
only the other words of a text travel to their counts, so a word that is in every text is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

EXPONENTS = (0.7, 0.85, 1.0, 1.15, 1.3)
OFFSET = 2.7
SPACE = "▁".encode()
#: So many words, of LONGEST bytes at most, are sent to every task; their number is counted before.
HOT, LONGEST = 1 << 16, 64
#: A task counts the words of so many bytes of texts at once.
HELD = 8 << 20
#: Words are scored so many at a time; those of more bytes one by one, in memory that doesn't grow with their length.
TOGETHER, BATCHED = 4096, 120
#: Rounds of expectation and maximisation, and what each piece's expected count gets in addition.
ROUNDS, ADDED = 2, 0.1


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranked_pieces(path: str) -> dict[bytes, float]:
    """Pieces of a sentencepiece file with their ranks, from its scores; without control pieces, bytes and runs of spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(len(model)):
        piece = model.id_to_piece(i).encode()
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece.rfind(SPACE) <= 0:
            out[piece] = -model.get_score(i)
    return out


def _order(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """What sorts by first, then second, then third, all small and not negative: as one number, several times as fast as lexsort."""
    return np.argsort((first * (int(second.max(initial=0)) + 1) + second) * (int(third.max(initial=0)) + 1) + third)


class Lattice:
    """Marginal log10-probabilities of words over all segmentations, under each exponent."""

    def __init__(self, pieces: dict[bytes, float], exponents: tuple = EXPONENTS, weights: np.ndarray | None = None):
        """weights: natural logarithms of the probability of each piece, and last of each byte, instead of those by ranks."""
        self.places = {p: k for k, p in enumerate(pieces)}
        self.starts = {p[:n] for p in pieces for n in range(1, len(p))}
        self.width = max(map(len, pieces), default=1) + 1
        self.byte = len(pieces)  # the place of every single byte
        ranks = [*pieces.values(), max(pieces.values(), default=0.0) + 1]
        self.weights = []
        for s in exponents:
            raw = [-s * math.log(r + OFFSET) for r in ranks]
            whole = math.log(sum(map(math.exp, raw[:-1])) + 256 * math.exp(raw[-1]))
            self.weights.append([x - whole for x in raw])
        if weights is not None:
            self.weights = [weights.tolist()]
        nodes = {p: k for k, p in enumerate(sorted(self.starts | self.places.keys()), 1)}
        steps = sorted((nodes.get(p[:-1], 0) << 8 | p[-1], k) for p, k in nodes.items())  # of a tree whose root is 0
        self.steps, self.children = np.array([x for x, _ in steps] or [-1], dtype=np.int64), np.array([k for _, k in steps] or [0], dtype=np.int64)
        self.piece_at = np.full(len(nodes) + 1, -1, dtype=np.int64)
        for p, k in self.places.items():
            self.piece_at[nodes[p]] = k
        self.table = np.array(self.weights).T

    def score_all(self, words: list[bytes]) -> np.ndarray:
        """score() of each word: a row for each, a column for each exponent."""
        out = np.empty((len(words), len(self.weights)))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for at in range(0, len(order), TOGETHER):
            few = [k for k in order[at : at + TOGETHER] if len(words[k]) <= BATCHED]
            if few:
                out[few] = self._together([SPACE + words[k] for k in few])
            for k in order[at + len(few) : at + TOGETHER]:
                out[k] = self.score(words[k])
        return out

    def _arcs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """The texts' sizes, and of every arc its text, begin, end and piece, by end and text."""
        sizes = np.array([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        whose = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(raw)) - first[whose]
        found = [(whose, place, place + 1, np.full(len(raw), self.byte))]  # arcs: word, from, to, piece
        begin, node, length = np.arange(len(raw)), np.zeros(len(raw), dtype=np.int64), 0
        while len(begin):
            step = node << 8 | raw[begin + length]
            k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            there = self.steps[k] == step
            begin, node, length = begin[there], self.children[k[there]], length + 1
            piece = self.piece_at[node]
            ends = begin[piece >= 0]
            found.append((whose[ends], place[ends], place[ends] + length, piece[piece >= 0]))
            more = place[begin] + length < sizes[whose[begin]]
            begin, node = begin[more], node[more]
        word, begin, end, piece = (np.concatenate(x) for x in zip(*found))
        by = _order(end, word, begin)
        return sizes, word[by], begin[by], end[by], piece[by]

    def _forward(self, texts: list[bytes], sizes: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Of each text and place, the logarithm of the summed probability of all ways to it."""
        cuts = np.searchsorted(end, np.arange(1, sizes.max() + 2))
        one = self.table.shape[1] == 1  # then in plain vectors, which take half the time
        table = self.table[:, 0] if one else self.table
        sums = np.zeros((len(texts), sizes.max() + 1, *table.shape[1:]))
        for j, (a, z) in enumerate(zip(cuts, cuts[1:]), 1):
            terms = sums[word[a:z], begin[a:z]] + table[piece[a:z]]
            heads = np.flatnonzero(np.r_[True, word[a + 1 : z] != word[a : z - 1]])
            top = np.maximum.reduceat(terms, heads)
            terms -= np.repeat(top, np.diff(np.r_[heads, z - a]), axis=0)
            sums[word[a:z][heads], j] = top + np.log(np.add.reduceat(np.exp(terms), heads))
        return sums[:, :, None] if one else sums

    def _together(self, texts: list[bytes]) -> np.ndarray:
        sizes, *arcs = self._arcs(texts)
        return self._forward(texts, sizes, *arcs)[np.arange(len(texts)), sizes] / math.log(10)

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece, and last any byte, is expected in the words under the first weights. Words of over BATCHED bytes
        are taken in slices of so many, of which only the first has the space mark."""
        out = np.zeros(self.byte + 1)
        texts = [(SPACE + w)[at : at + BATCHED] for w in words for at in range(0, len(SPACE) + len(w), BATCHED)]
        texts.sort(key=len)
        for at in range(0, len(texts), TOGETHER):
            few = texts[at : at + TOGETHER]
            sizes, word, begin, end, piece = self._arcs(few)
            before = self._forward(few, sizes, word, begin, end, piece)[:, :, 0]
            by = _order(begin, word, end)
            word, begin, end, piece = word[by], begin[by], end[by], piece[by]
            weight, after = self.table[piece, 0], np.zeros((len(few), sizes.max() + 1))
            cuts = np.searchsorted(begin, np.arange(sizes.max() + 1))
            for j in range(sizes.max() - 1, -1, -1):
                a, z = cuts[j], cuts[j + 1]
                terms = weight[a:z] + after[word[a:z], end[a:z]]
                heads = np.flatnonzero(np.r_[True, word[a + 1 : z] != word[a : z - 1]])
                top = np.maximum.reduceat(terms, heads)
                terms = np.exp(terms - np.repeat(top, np.diff(np.r_[heads, z - a])))
                after[word[a:z][heads], j] = top + np.log(np.add.reduceat(terms, heads))
            share = np.exp(before[word, begin] + weight + after[word, end] - after[word, 0])
            out += np.bincount(piece, weights=share, minlength=len(out))
        return out

    def score(self, word: bytes) -> list[float]:
        """Of the space mark and the word. Only as many sums are held as the longest piece is long."""
        text, width, places, starts = SPACE + word, self.width, self.places, self.starts
        n, exp, log = len(text), math.exp, math.log
        sums: list = [None] * width
        arcs: list[list] = [[] for _ in range(width)]  # by where they end: (where from, place of the piece)
        sums[0] = [0.0] * len(self.weights)
        for i in range(n + 1):
            here = i % width
            if i:
                into, now = arcs[here], []
                for g, w in enumerate(self.weights):
                    terms = [sums[at][g] + w[p] for at, p in into]
                    top = max(terms)
                    now.append(top + log(sum([exp(x - top) for x in terms])) if len(terms) > 1 else top)
                sums[here], arcs[here] = now, []
            if i == n:
                break
            arcs[(i + 1) % width].append((here, self.byte))
            for j in range(i + 1, min(n, i + width - 1) + 1):
                part = text[i:j]
                if (p := places.get(part)) is not None:
                    arcs[j % width].append((here, p))
                if part not in starts:
                    break
        return [x / math.log(10) for x in sums[n % width]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and at 09-0D and 20


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id) == 1


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words_of() for texts in an Arrow array: of each word its text's place and its place among the distinct words, and these."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # at 09-0D and 20
    of = np.repeat(np.arange(len(split), dtype=np.int32), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(split.flatten())
    which, words = coded.indices.to_numpy(), coded.dictionary
    if (blank := pc.index(words, pa.scalar("", words.type)).as_py()) >= 0:  # of texts that are blank, begin or end so
        some = which != blank
        of, which = of[some], which[some]
    return of, which, words


def _counted(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each word is in training rows and in all rows, of each task's batches."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def drain() -> Iterator[pa.RecordBatch]:
            texts, held = (pa.concat_arrays([b.column(c) for b in waiting]) for c in ("text", "held"))
            of, which, words = words_in(texts)
            trained = ~held.to_numpy(zero_copy_only=False)[of]
            n, c = np.bincount(which, minlength=len(words)), np.bincount(which[trained], minlength=len(words))
            some = np.flatnonzero(n)
            for at in range(0, len(some), 20_000):
                few = some[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(few)), pa.array(c[few]), pa.array(n[few])], names=["word", "c", "n"])
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size > HELD:
                yield from drain()
                size = 0
        if waiting:
            yield from drain()

    rows = docs.select(F.col("text").cast("string").alias("text"), held_out().alias("held"))
    return rows.mapInArrow(count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learned_weights(counted: DataFrame, path: str) -> np.ndarray:
    """Weights of the pieces, and last of a byte, fitted to the distinct training words of (word, c): each counts once, since
    frequent words have arcs of their own. A round sends one number for each piece of the vocabulary to the driver."""
    first = Lattice(ranked_pieces(path), (1.0,))
    weights = np.array(first.weights[0])
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(ranked_pieces(path), (), weights)
            total = np.zeros(lattice.byte + 1)
            for b in batches:
                total += lattice.expected([w.encode() for w in b.column("word").to_pylist()])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "times"])

        got = counted.where("c > 0").select("word").mapInArrow(expect, "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times")).collect()
        if not got:
            break
        times = np.full(len(weights), ADDED)
        times[-1] *= 256
        for r in got:
            times[r["piece"]] += r["times"]
        weights = np.log(times / times.sum())
        weights[-1] -= math.log(256)
    return weights


def word_table(docs: DataFrame, path: str, exponents: tuple = EXPONENTS, learned: bool = False) -> DataFrame:
    """(word, c, n, likely): every distinct word with its counts in training rows and in all rows, and its marginal
    log10-probability under each exponent, or under the learned weights alone."""
    counted = _counted(docs)
    if learned:
        counted = materialize(counted, "counts")
    weights = learned_weights(counted, path) if learned else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(ranked_pieces(path), exponents, weights)
        for b in batches:
            likely = lattice.score_all([w.encode() for w in b.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(likely), pa.list_(pa.float64()))], names=[*b.schema.names, "likely"])

    return counted.mapInArrow(score, "word string, c long, n long, likely array<double>")


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with the greatest n, `most` at the most: counts of n by its logarithm tell down to which n they are so few."""
    short = words.where(F.octet_length("word") <= LONGEST)
    steps = short.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # about 1000 rows at most
    total, least = 0, None
    for row in sorted(steps, reverse=True):
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    return short.where(F.col("n") >= least) if least is not None else short.where("false")


def with_whole_words(words: DataFrame) -> Column:
    """log10 of the probability of a word with an arc over the whole of it, if it is known, beside its spelling by pieces: likely.

    The discount of each count is the share that words met once have among those met once or twice, as is usual.
    """
    n, kinds, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    less = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    spelled = less * kinds / n if n else 1.0
    c, likely = F.col("c"), F.get("likely", F.lit(0))
    # A spelling's probability may be too small for a double, its logarithm never is.
    return F.when(c > 0, F.log10((c - less) / F.lit(float(n or 1)) + spelled * F.pow(F.lit(10.0), likely))).otherwise(math.log10(spelled) + likely)


def score_texts(docs: DataFrame, path: str, hot: int = HOT, learned: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    score is the model's log10-probability of the row's text; base_score that of a word model with half a count added to
    each word, learned from the same rows. learned: whether the model's pieces and whole words are learned from them too. A null, empty or blank text is an end alone. Rows that repeat an id are scored one
    by one. Without a training row no word is known. An empty table gives no rows.
    """
    words = materialize(word_table(docs, path, learned=learned), "words")
    sums = [F.sum(F.col("c") * F.get("likely", F.lit(g))) for g in range(1 if learned else len(EXPONENTS))]
    n, kinds, *fits = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), *sums).first()
    ends = docs.where(~held_out()).count()
    n, kinds = n + ends, kinds + (ends > 0)
    best = max(range(len(fits)), key=lambda g: fits[g] if fits[g] is not None else 0.0)
    whole = n + 0.5 * (kinds + 1)
    words = words.select("word", "n", "c", (with_whole_words(words) if learned else F.get("likely", F.lit(best))).alias("likely"))
    known = _frequent(words, hot).select("word", F.col("c") > 0, F.log10((F.col("c") + 0.5) / F.lit(whole)), "likely").collect()  # hot words at most
    facts = np.array([r[1:] for r in known], dtype=np.float64).reshape(-1, 3)  # whether known, base, likely
    sent = docs.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in known], pa.string()), facts))
    ending = (ends + 0.5) / (n + 1)
    base_end, score_end, goes_on = math.log10((ends + 0.5) / whole), math.log10(ending), math.log10(1 - ending)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"))
    kept = ["row", "doc_id", "held_out"]
    schema = T.StructType([*(rows.schema[k] for k in kept), *T._parse_datatype_string("word string, times long, n_tokens long, n_known long, base_score double, score double")])
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, facts = sent.value
        for batch in batches:
            size = batch.num_rows
            of, which, words = words_in(batch.column("text"))
            place = pc.fill_null(pc.index_in(words, value_set=frequent.cast(words.type)), -1).to_numpy()[which]
            hot = place >= 0
            seen, base, score = (np.bincount(of[hot], weights=facts[place[hot], k], minlength=size) for k in range(3))
            count = np.bincount(of, minlength=size)
            pairs, times = np.unique(of[~hot].astype(np.int64) * max(1, len(words)) + which[~hot], return_counts=True)
            text, word = np.divmod(pairs, max(1, len(words)))
            # A row for each text's other word, then one for each text.
            whose = pa.array(np.r_[text, np.arange(size)])
            blank = lambda a, kind, few=len(pairs): pa.concat_arrays([pa.nulls(few, kind), pa.array(a, kind)])
            arrays = [
                *(batch.column(k).take(whose) for k in kept),
                pa.concat_arrays([words.take(pa.array(word)), pa.nulls(size, words.type)]),
                pa.concat_arrays([pa.array(times, pa.int64()), pa.nulls(size, pa.int64())]),
                blank(count + 1, pa.int64()),
                blank(seen.astype(np.int64) + int(ends > 0), pa.int64()),
                blank(base + base_end, pa.float64()),
                blank(score + score_end + count * goes_on, pa.float64()),
            ]
            out = pa.RecordBatch.from_arrays(arrays, names=schema.names)
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    parts = rows.mapInArrow(score, schema)
    parts = materialize(parts, "scored")
    # A row for a text's other word gets that word's share.
    c, times = F.col("c"), F.col("times")
    rare = parts.where("word is not null").select("row", "word", "times").join(words, "word")
    shares = rare.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"),
        F.when(c > 0, times).otherwise(0).alias("n_known"), (times * F.log10((c + 0.5) / F.lit(whole))).alias("base_score"), (times * F.col("likely")).alias("score"),
    )
    texts = parts.where("word is null").select(*shares.columns)
    added = [F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.lit(n).cast("long").alias("train_tokens")]
    found = texts.unionByName(shares).groupBy("row").agg(*added, *[F.sum(x).alias(x) for x in ("n_known", "base_score", "score")])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
