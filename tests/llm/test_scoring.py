"""Importance resampling and the lattice model against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from motif.llm import lattice, resample
from motif.llm.common import NO_ID

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["Ünï ÜNÏ a1 B2", "", None, " \n", "É" * 30, "x " * 40, "İstanbul 漢字 😀 ok_no-yes", "a"]


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n, m = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in range(10000)]
    rows = []
    for (i, _), (words, f) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    can = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], NO_ID if r[0] is None else r[0], r[2], r[1]))
    drawn = {id(r): k for k, r in enumerate(can[: 5 * len(can) // 100], 1)}
    return sorted((str(r[0]), *r[1:4], drawn.get(id(r))) for r in rows)


def test_buckets_go_on_across_parts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "É", "x1", "漢字", "...", "A-b", "_"], k=rng.randint(0, 40))) for _ in range(200)] + [t or "" for t in ODD]
    for part in (1 << 20, 1, 7):
        monkeypatch.setattr(resample, "PART", part)
        for text in texts:
            got = list(resample.feature_buckets(text))
            n, want = features(text)
            assert sum(k for k, _ in got) == n and Counter(b for _, x in got for b in x.tolist()) == Counter(want)


@pytest.mark.parametrize("digit", [16, 2])
def test_resample_equals_plain_code(spark, make, monkeypatch, digit):
    monkeypatch.setattr(resample, "DIGIT", digit)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    docs = [(k - 100, " ".join(rng.choices(words, k=rng.randint(15, 80)))) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs += [(None, "some words " * 30), (2**63 - 5, "w1 " * 300), (-(2**63), "w2 " * 300), docs[7], docs[7]]
    target = [" ".join(rng.choices(words[:6], k=40)) for _ in range(5)] + [None]
    found = resample.resample(make(docs).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=lambda r: (*r[:4], r[4] or 0))
    want = sorted(plain_resample(docs, target), key=lambda r: (*r[:4], r[4] or 0))
    assert got == want and sum(r[4] is not None for r in got) > 10


def test_the_kth_key_among_ties(spark):
    rng = random.Random(3)
    for rows in (
        [(5, 2), (5, 2), (5, 1), (9, 7), (-(2**62), 0), (2**62, -(2**63)), (2**62, 2**63 - 1), (2**62, 0)],
        [(rng.choice((0, 1, 1 << 40)), rng.randint(-(2**63), 2**63 - 1)) for _ in range(60)],
        [(4, i) for i in range(3)],
    ):
        df = spark.createDataFrame(rows, "score long, id long")
        order = sorted(rows, key=lambda r: (-r[0], r[1]))
        for k in {1, 2, 3, len(rows) // 2, len(rows)} - {0}:
            score, last = resample.kth_key(df, k)
            assert [r for r in order if (-r[0], r[1]) <= (-score, last)][:k] == order[:k]
            assert sum((-r[0], r[1]) < (-score, last) for r in order) <= k


def test_resample_of_little(spark, make):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(make([]), target).count() == 0
    rows = resample.resample(make([(1, "few words"), (None, None)]), target).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in rows} == {(1, 3, None), (None, 0, None)}
    one = resample.resample(make([(k, "word " * 20) for k in range(20)]), target).where("rank is not null").collect()
    assert len(one) == 1 and one[0]["rank"] == 1


PIECES = {"▁t": 2.0, "▁": 30.0, "t": 28.0, "th": 5.0, "▁the": 9.0, "he": 4.0, "e": 25.0, "h": 26.0, "é": 40.0, "▁th": 6.0}


def segmentations(model, text, g):
    """The summed probability of all segmentations, by listing them."""
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        if (k := model.places.get(text[:n])) is not None:
            total += math.exp(model.weights[g][k]) * segmentations(model, text[n:], g)
    return total + math.exp(model.weights[g][model.byte]) * segmentations(model, text[1:], g)


def test_lattice_sums_all_segmentations():
    model = lattice.Lattice({p.encode(): r for p, r in PIECES.items()})
    for w in model.weights:
        assert sum(map(math.exp, w[:-1])) + 256 * math.exp(w[-1]) == pytest.approx(1)
    words = ["the", "thethe", "é", "zé", "", "htht", "eeee", "t" * 10]
    for word, row in zip(words, model.score_all([w.encode() for w in words]), strict=True):
        for g in range(len(lattice.EXPONENTS)):
            assert row[g] == pytest.approx(math.log10(segmentations(model, lattice.SPACE + word.encode(), g)), rel=1e-12)


def test_batches_and_single_words_agree():
    model = lattice.Lattice(lattice.ranked_pieces(lattice.vocabulary_path()))
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéß漢 th", k=rng.randint(0, 30))).encode() for _ in range(300)] + [b"ab" * 500, b"x" * lattice.BATCHED, b"x" * (lattice.BATCHED + 1)]
    assert np.allclose(model.score_all(words), [model.score(w) for w in words], rtol=1e-12)
    assert (np.array([lattice.Lattice({}).score(w) for w in words[:5]]) <= 0).all()


def plain_scores(docs, best):
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) for i, t in docs]
    counts = Counter(w for _, out, ws in tokens if not out for w in ws)
    ends = sum(not out for _, out, _ in tokens)
    n, kinds = counts.total() + ends, len(counts) + (ends > 0)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (kinds + 1)))
    model, rows, end = lattice.Lattice(lattice.ranked_pieces(lattice.vocabulary_path())), [], (ends + 0.5) / (n + 1)
    likely = {w: model.score(w.encode()) for _, _, ws in tokens for w in ws}
    fits = [sum(counts[w] * likely[w][g] for w in counts) for g in range(len(lattice.EXPONENTS))]
    g = fits.index(max(fits))
    assert best is None or g == best
    for i, out, ws in tokens:
        score = sum(likely[w][g] for w in ws) + len(ws) * math.log10(1 - end) + math.log10(end)
        rows.append((str(i), out, len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n, round(sum(base(counts[w]) for w in ws) + base(ends), 6), round(score, 6)))
    return sorted(rows)


@pytest.mark.parametrize("hot", [0, 3, 1 << 16])
def test_scores_equal_plain_code(make, hot):
    rng = random.Random(5)
    words = ["the", "The", "then", "é", "É", "tion", "x" * 130, "漢字", "<0x41>", "▁", "\x1c", "a\x00b"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD)] + [(None, "the é"), (None, None), (3, "again the"), (3, "again the")]
    docs.append((1, "unseen-word " + "long" * 50_000))
    found = lattice.score_texts(make(docs).repartition(3), lattice.vocabulary_path(), hot)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found.collect())
    for a, b in zip(got, plain_scores(docs, None), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_scores_of_little(make):
    assert lattice.score_texts(make([]), lattice.vocabulary_path()).count() == 0
    held = next(k for k in range(20) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = lattice.score_texts(make([(held, "no training here")]), lattice.vocabulary_path()).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 4, 0, 0, 0.0) and row["score"] < 0


def test_likelier_texts_score_higher(make):
    docs = [(k, "the house is on the hill and the sea is near") for k in range(8)] + [(90, "the sea and the house"), (91, "xq zzk vvw qqj kkx")]
    score = {r["doc_id"]: r["score"] for r in lattice.score_texts(make(docs), lattice.vocabulary_path()).collect()}
    assert score[90] > score[91] and all(x < 0 for x in score.values())


def test_the_query_equals_its_sql(spark):
    import duckdb

    from motif.llm import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    found = queries.op11_resample(spark, d)
    want = con.execute(queries.ORACLES["op11_resample"])
    assert found.columns == [c[0] for c in want.description]
    rows = want.fetchall()
    assert set(map(tuple, found.collect())) == set(rows) and sum(r[4] is not None for r in rows) >= 5


def test_expected_pieces_equal_listing_all_segmentations():
    model = lattice.Lattice({p.encode(): r for p, r in PIECES.items()}, (1.0,))

    def ways(text):
        """(probability, counts of pieces) of every segmentation."""
        if not text:
            return [(1.0, Counter())]
        heads = [(n, model.places[text[:n]]) for n in range(1, len(text) + 1) if text[:n] in model.places] + [(1, model.byte)]
        return [(math.exp(model.weights[0][k]) * p, c + Counter([k])) for n, k in heads for p, c in ways(text[n:])]

    words, want = ["the", "é", "", "thethe"], np.zeros(model.byte + 1)
    for w in words:
        found = ways(lattice.SPACE + w.encode())
        for p, c in found:
            for k, times in c.items():
                want[k] += p * times / sum(x for x, _ in found)
    assert np.allclose(model.expected([w.encode() for w in words]), want)
    assert np.isfinite(model.expected([b"x" * 5000, b""])).all()


def test_learned_scores_of_held_out_texts_come_near_the_base(make):
    """Words as in invented prose: the ranks of the vocabulary alone are far below the base score."""
    rng = random.Random(8)
    parts = "th ou en tion les er ing an re st".split()
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(400)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=60))
    docs = [(k, text()) for k in range(200)] + [(301, "new" + "z" * 3000), (302, None)]
    rows = [r for r in lattice.score_texts(make(docs), lattice.vocabulary_path(), learned=True).collect()]
    assert len(rows) == len(docs) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 300]
    tokens, base, score = (sum(r[c] for r in held) for c in ("n_tokens", "base_score", "score"))
    assert held and abs(score - base) < 0.1 * tokens
    plain = [r for r in lattice.score_texts(make(docs), lattice.vocabulary_path()).collect() if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["score"] for r in plain) < base - tokens


def test_words_of_arrow_texts_equal_plain_words():
    import pyarrow as pa

    texts = [*ODD, " a\tB  c\x0b\x0cd\r\ne\x1cf\x85g\xa0h \u2003 \u2028É ", "\x1f", "A\x00B a\x00b", "x" * 5000 + " X", "  ", " lead", "trail\n"]
    for kind in (pa.string(), pa.large_string()):
        of, which, words = lattice.words_in(pa.array(texts, kind))
        found = [[] for _ in texts]
        for k, w in zip(of.tolist(), which.tolist()):
            found[k].append(words[w].as_py().encode())
        assert found == [lattice.words_of(t) for t in texts]
        assert len(set(words.to_pylist())) == len(words)
    for none in ([], [None, " "]):
        of, which, _ = lattice.words_in(pa.array(none, pa.string()))
        assert len(of) == len(which) == 0
