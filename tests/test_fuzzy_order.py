"""Re-keying in rounds gives what going through the events one by one gives."""

import random

import pytest
from pyspark.sql import functions as F

from motif.functions import exprs
from motif.operators import fuzzy
from motif.plans import catalogue

SCHEMA = "structural_hash string, seq long, source_code string"


def sequential(spark, rows, threshold):
    """new_hash by seq, of rows (hash, seq, source), with the tokens of the engine."""
    df = spark.createDataFrame(rows, SCHEMA).select("structural_hash", "seq", exprs.fuzzy_tokens(F.coalesce("source_code", F.lit(""))).alias("t")).orderBy("seq").collect()
    return dict(zip([r["seq"] for r in df], fuzzy.rekey_sequential([(r["structural_hash"], list(r["t"])) for r in df], threshold)))


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_rounds_equal_the_sequence(spark, threshold):
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    base = [[rng.choice(words) for _ in range(12)] for _ in range(4)]
    texts = []
    for _ in range(25):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["", None, "1 2 3", "lonely words of no other text here"]
    rows = []
    for seq in range(160):
        k = rng.choice([0, 0, 0, rng.randrange(len(texts))])  # the first one is most of all events
        rows.append((f"h{k % 23}", seq * 3 - 50, texts[k]))
    want = sequential(spark, rows, threshold)
    for chunks in (1, 7):
        got = {r["seq"]: r["new_hash"] for r in fuzzy.rekey_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, chunks).collect()}
        assert got == want
    assert any(want[s] != h for h, s, _ in rows)


def test_a_chain_of_absorptions(spark):
    """Each text is similar to the one before it, but not to the first: the latest source decides, so all join the first."""
    words = [f"w{chr(97 + k)}" for k in range(24)]
    rows = [(f"h{k}", k, " ".join(words[k : k + 12])) for k in range(8)]
    want = sequential(spark, rows, 0.85)
    assert set(want.values()) == {"h0"}
    assert {r["seq"]: r["new_hash"] for r in fuzzy.rekey_in_order(spark.createDataFrame(rows, SCHEMA), 0.85).collect()} == want


def test_no_events(spark):
    assert fuzzy.rekey_in_order(spark.createDataFrame([], SCHEMA), 0.85).collect() == []


def test_the_query_equals_the_sequence(spark):
    found = catalogue.fuzzy_rekey_order(spark, "/root/testdata/sf0.001").collect()
    items = {r["item_id"]: r["text"] for r in catalogue._edited(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["structural_hash"], r["seq"], items[r["seq"] if r["seq"] < 2_000_000 else r["seq"] % 1_000_000 + 1_000_000]) for r in found]
    assert {r["seq"]: r["new_hash"] for r in found} == sequential(spark, rows, 0.85) and len(found) == len(items) * 2
