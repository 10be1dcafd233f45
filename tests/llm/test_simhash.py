import re

import numpy as np
import pytest
import xxhash

from motif.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    votes = [sum(xxhash.xxh64(s.encode(), seed=42).intdigest() >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_fingerprints_equal_a_plain_count_of_votes(monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    for text in (None, "", " \t\n", "One", "two words", "Éa B c D e", "a b c a b c", "x\x0by\x1cz w", "w " * 500):
        assert simhash.fingerprint(text) == brute(text)


def components(fps):
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 3):
            a, b = find(int(fps[i])), find(int(fps[j]))
            root[max(a, b)] = min(a, b)
    groups = {}
    for x in fps:
        groups.setdefault(find(int(x)), set()).add(int(x))
    return {frozenset(g) for g in groups.values()}


def linked(spark, fps, cap):
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    rows = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long").distinct(), cap).collect()
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        a, b = r["a"] % 2**64, r["b"] % 2**64
        assert bin(a ^ b).count("1") <= 3 or cap < 4096
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_links_connect_exactly_what_three_bits_connect(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for x in list(fps[:30]):
        for bits in (1, 2, 3, 4):
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    assert linked(spark, fps, 4096) == components(fps)


def test_crowded_groups_are_split_without_losing_links(spark):
    """All fingerprints share a segment; with a small cap they go through finer keys."""
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    for _ in range(400):
        y = base
        for b in rng.choice(32, int(rng.integers(1, 9)), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    assert linked(spark, sorted(fps), 20) == components(fps)


def test_nulls_repeats_and_empty_tables(spark, make):
    same = "the quick brown fox jumps over the lazy dog"
    docs = make([(5, same), (3, same), (3, same), (None, same), (9, None), (8, ""), (7, "other words entirely here")])
    rows = simhash.simhash_groups(docs).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7)], key=str)
    assert simhash.simhash_groups(make([])).collect() == []
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, None, 8, 7], key=str)


def similar_firsts(docs, similarity=0.8):
    """The least id of each group that links of five-word shingles make, by brute force."""
    sets = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in sets})


def test_a_crowd_of_copies_with_many_edits_is_not_compared_pair_by_pair(spark, make, monkeypatch):
    """Copies of one text, most of them too different to link, some pairs of which share edits and link."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    base = [word() for _ in range(150)]
    texts = []
    for n in range(160):
        copy = list(base)
        for i in rng.sample(range(150), rng.randint(0, 14)):
            copy[i] = word()
        texts.append(" ".join(copy))
        if n % 8 == 0:
            copy[rng.randrange(150)] = word()
            texts.append(" ".join(copy))
    docs = list(enumerate(texts))
    compared = []
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *more: compared.append(pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()) or verified(pairs, *more))
    kept = simhash.deduplicate_similar(make(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == similar_firsts(docs)
    assert sum(compared) < 10 * len(docs)


def test_the_stage_links_all_that_share_four_fifths_of_five_word_shingles(spark, make):
    import random

    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    docs = []
    for base in range(12):
        words = [word() for _ in range(120)]
        for edits in (0, 1, 2, 2, 3, 4):
            copy = list(words)
            for i in rng.sample(range(120), edits):
                copy[i] = word()
            docs.append((len(docs), " ".join(copy)))
    docs += [(1000 + i, " ".join(docs[0][1].split()[:100] + [f"tail{i}"])) for i in range(40)] + [(2000, None), (2001, " "), (2002, "one two"), (2003, "One two")]
    kept = corpus_pipeline.near_duplicates(spark, make(docs), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == similar_firsts(docs)
    assert corpus_pipeline.near_duplicates(spark, make([]), "").collect() == []


def test_similar_texts_go_through_variants_of_their_fingerprints_first(spark, make, monkeypatch):
    """Pairs with three or fewer differing bits are candidates whatever shingles are drawn, and are not compared again."""
    import random

    rng = random.Random(23)
    docs = []
    for base in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for edits in (0, 1, 1, 2, 60):
            copy = list(words)
            for i in rng.sample(range(400), edits):
                copy[i] = f"w{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy)))
    sets = {i: simhash.shingles(t) for i, t in docs}
    ids = {i: simhash.xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for i, s in sets.items()}
    fps = {i: simhash.set_fingerprint(s) for i, s in sets.items()}
    near = {frozenset((ids[i], ids[j])) for i in sets for j in sets if i < j and (fps[i] ^ fps[j]).bit_count() <= 3}
    asked, verified = [], simhash._verified
    pairs_of = lambda df: {frozenset(x % 2**64 for x in r) for r in df.select("a", "b").collect()}
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *more: asked.append(pairs_of(pairs)) or verified(pairs, *more))
    kept = simhash.deduplicate_similar(make(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == similar_firsts(docs)
    assert len(near) > 10 and asked[0] == near and not near & set().union(*asked[1:])
