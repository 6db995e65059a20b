"""Decisions and their measure."""

import itertools

import numpy as np
import pytest

from kinmatch.operators import decide


def frame(spark, rows):
    return spark.createDataFrame([(str(q), s, float(p)) for q, s, p in rows], "q string, s1 string, p double")


@pytest.fixture(scope="module")
def links(spark):
    pred = spark.createDataFrame([("a", "47"), ("a", "193"), ("a", "812"), ("c", "9")], "s1 string, q string")
    truth = spark.createDataFrame([("a", "47"), ("a", "812")], "s1 string, q string")
    return pred, truth


@pytest.mark.parametrize(("entry", "value"), [("a", 0.7143), ("b", 1.0), ("c", 0.0)])
def test_f05(spark, links, entry, value):
    got = decide.macro_f05(*links, spark.createDataFrame([(entry,)], "s1 string")).first().f05
    assert got == pytest.approx(value, abs=1e-3)


def test_expected_f(spark):
    got = decide.expected_f(frame(spark, [(1, "a", 0.95), (2, "a", 0.9), (3, "a", 0.2), (4, "b", 0.3)])).collect()
    assert sorted(r.q for r in got) == ["1", "2"]


def test_assign_takes_the_best_and_breaks_ties_by_id(spark):
    got = decide.assign(frame(spark, [(1, "b", 0.8), (1, "a", 0.8), (2, "a", 0.3)]), 0.5).collect()
    assert [(r.q, r.s1) for r in got] == [("1", "a")]


def brute(p):
    """Expected F0.5 of keeping the first k, over all outcomes."""
    p = np.clip(p, 1e-5, 1 - 1e-5)
    values = []
    for k in range(len(p) + 1):
        e = 0.0
        for hit in itertools.product([0, 1], repeat=len(p)):
            w = np.prod([x if h else 1 - x for x, h in zip(p, hit)])
            tp, total = sum(hit[:k]), sum(hit)
            e += w * ((total == 0) if k == 0 else 1.25 * tp / (k + 0.25 * total))
        values.append(e)
    return values


@pytest.mark.parametrize("p", [[0.95], [0.2], [0.45], [0.88, 0.15], [0.92, 0.85], [0.3, 0.25], [0.9, 0.65, 0.1], [0.55, 0.55, 0.5], [0.95, 0.7, 0.4, 0.05], [0.89, 0.75, 0.6, 0.35, 0.08]])
def test_decoder(p):
    values = brute(np.array(p))
    assert values[decide.decode(np.array(p))] == pytest.approx(max(values), abs=1e-9)


def test_decoder_frame(spark):
    got = decide.decode_entries(frame(spark, [(1, "a", 0.95), (2, "a", 0.9), (3, "a", 0.05), (4, "b", 0.2)])).collect()
    assert sorted(r.q for r in got) == ["1", "2"]
