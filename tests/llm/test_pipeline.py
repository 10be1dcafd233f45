import random

import corpus_pipeline
import test_scans
import test_simhash
import test_texts
from tokenizers import Tokenizer

from motif.llm import substrings, tokens
from motif.llm.common import materialize
from test_tokens import check_packing


def texts():
    rng = random.Random(11)
    words = "stone river garden window letter market evening number people music".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(6, 12))).capitalize() + ". "
    docs = [(i, "".join(sentence() for _ in range(rng.randint(3, 8)))) for i in range(40)]
    passage = "".join(sentence() for _ in range(6))
    docs += [(50 + i, sentence() + passage + sentence()) for i in range(3)]
    docs += [(60, docs[0][1]), (61, docs[0][1]), (70, "Write to someone@example.org or call +1 (200) 555-2000 about the stone river garden."), (80, None), (81, "12345 !!"), (82, "")]
    return docs


def test_each_stage_and_the_whole_run_against_brute_force(spark, make, tmp_path):
    rows = texts()
    docs, columns = make(rows), make([]).columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "pii", "packing"]

    docs = materialize(stages["language_id"](spark, docs, ""), "t")
    assert docs.columns == columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept == {i: t for i, t in rows if t and any(c.isalpha() for c in t)}

    docs = materialize(stages["simhash_near_dedup"](spark, docs, ""), "t")
    first = set(test_simhash.similar_firsts(list(kept.items())))
    kept = {i: t for i, t in kept.items() if i in first}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and 60 not in kept and docs.columns == columns

    docs = materialize(stages["substring_dedup"](spark, docs, ""), "t")
    gone = test_texts.brute_removed(list(kept.items()))
    left = {i: "".join(p for k, p in enumerate(substrings.split_sentences(t)) if k not in gone.get(i, ())) for i, t in kept.items()}
    left = {i: t for i, t in left.items() if t.strip() or i not in gone}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == left and gone and docs.columns == columns
    assert all(r["n_chars"] == len(r["text"]) and r["removed"] == "r" and r["score"] == 0.5 for r in docs.collect())

    docs = materialize(stages["pii"](spark, docs, ""), "t")
    names = [k.upper() for k, _ in test_scans.PII]
    for i, t in left.items():
        for k, a, b in sorted(test_scans.brute_pii(t), key=lambda s: -s[1]):
            t = t[:a] + f"[{names[k]}]" + t[b:]
        left[i] = t
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == left and docs.columns == columns

    for placed in (stages["packing"](spark, docs, ""), corpus_pipeline.run(spark, str(tmp_path))):
        check_packing(placed.collect(), list(left.items()), Tokenizer.from_file(tokens.tokenizer_path()))


def test_stages_of_null_repeated_and_missing_rows(spark, make):
    """Documents without an id stay, rows that repeat a kept document go in the second stage, null texts go in the first."""
    long = "stone river garden window letter market evening number people music " * 4
    docs = make([(1, long), (1, long), (2, None), (None, long + "end"), (None, long + "end"), (3, ""), (4, "river stone")])
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(stages["language_id"](spark, docs, ""), "t")
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "4", "None", "None"]
    docs = materialize(stages["simhash_near_dedup"](spark, docs, ""), "t")
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "4", "None", "None"]
    docs = materialize(stages["substring_dedup"](spark, docs, ""), "t")
    assert {r["doc_id"]: r["text"] for r in docs.collect()}[1] == long
    docs = materialize(stages["pii"](spark, docs, ""), "t")
    assert {r["doc_id"] for r in stages["packing"](spark, docs, "").collect()} >= {1, 4}


def test_run_reads_documents_and_empty_tables_give_nothing(spark, make, tmp_path):
    for name, rows in (("some", texts()), ("none", [])):
        make(rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(found) == bool(rows)


def test_intermediate_tables_go_and_batches_stay_small(spark, make):
    import os

    from motif.llm import common

    begun = common.written()
    first, last = (common.materialize(make([(i, "x")]), "t") for i in (1, 2))
    paths = [p.removeprefix("file:") for _, p in common._written[begun:]]
    common.release(begun, keep=1)
    assert [os.path.exists(p.replace("//", "/")) for p in paths] == [False, True] and last.count() == 1
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", str(4 << 20)), ("1m", "1m")):
        spark.conf.set(key, given)
        common.small_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.set(key, "64m")
