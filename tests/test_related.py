"""The top-k overlap join against plain loops, with frequent tags, wide rows, copies, ties and odd rows."""

import random

import pytest

from motif.operators.related import related

SCHEMA = "label string, tags array<string>, class string, tag string"


def plainly(rows, k):
    """Each name stands once in rows."""
    sets = {name: {t for t in tags or [] if t is not None} for name, tags, *_ in rows}
    out = []
    for name, mine in sets.items():
        others = sorted((-len(mine & theirs), other) for other, theirs in sets.items() if other != name and mine & theirs)
        out += [(name, other, -n, rank) for rank, (n, other) in enumerate(others[:k], 1)]
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    rows = []
    for i in range(70):
        tags = [t for t in ("all", "half", "third") if r.random() < {"all": 0.9, "half": 0.5, "third": 0.33}[t]]
        tags += r.sample([f"f{j}" for j in range(6)], r.randrange(3)) + r.sample([f"r{j}" for j in range(40)], r.randrange(3))
        rows.append((f"n{r.randrange(10**6)}-{i}", tags + tags[:1], "x", "y"))
    rows += [(f"wide{i}", [f"f{j}" for j in range(6)] + ["all", "half", f"r{i}"], None, None) for i in range(3)]
    rows += [(f"copy{i}", ["all", "half"], None, None) for i in range(12)]
    return rows + [("none", None, None, None), ("empty", [], None, None), ("nulls", [None, "all"], None, None), ("alone", ["nobody else's"], None, None)]


@pytest.mark.parametrize("rare, width, k", [(1000, 8, 3), (4, 2, 3), (0, 8, 2), (0, 1, 1), (2, 3, 5)])
def test_equal_to_plain_loops(spark, rare, width, k):
    rows = rows_of(rare + width)
    # A repeated row counts once; columns named like the operator's own don't disturb it.
    frame = spark.createDataFrame(rows + rows[:5], SCHEMA)
    found = [tuple(r) for r in related(frame, "label", "tags", k, rare, width).collect()]
    assert sorted(found) == plainly(rows, k)


def test_no_rows_and_no_shared_tags(spark):
    assert related(spark.createDataFrame([], SCHEMA), "label", "tags").collect() == []
    assert related(spark.createDataFrame([("a", ["x"], None, None), ("b", ["y"], None, None)], SCHEMA), "label", "tags").collect() == []
