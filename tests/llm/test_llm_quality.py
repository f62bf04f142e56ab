"""The conditional random field against enumeration; held-out accuracy; odd inputs."""

import itertools

import numpy as np
import pytest
from llm_samples import labels, no_documents, odd_documents

from gridprobe.llm import quality
from gridprobe.llm.queries import QUERIES

TEXTS = [b"Hello world.\nABC DEF!!\nfoo bar", "x | y | z\n%%% &&&".encode(), None, b"one\ntwo\nthree\nfour."]


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(0)
    return quality.Field.of(rng.normal(size=quality.N_FEATURES + 4) * 0.3)


def test_marginals_are_sums_over_all_labellings(field):
    lines = quality.with_neighbours(*quality.raw_lines(TEXTS))
    good, pairs, total = quality.marginals(field, lines)
    scores = lines.x @ field.weights
    both = np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(lines.starts, lines.starts[1:])):
        weights = {
            path: np.exp(sum(scores[a + i] * y for i, y in enumerate(path)) + sum(field.moves[p] for p in zip(path, path[1:])))
            for path in itertools.product((0, 1), repeat=b - a)
        }
        z = sum(weights.values())
        assert np.log(z) == pytest.approx(total[d])
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for p, w in weights.items() if p[i]) / z)
        for path, w in weights.items():
            for p in zip(path, path[1:]):
                both[p] += w / z
    assert np.allclose(pairs, both)


def test_gradient(field):
    lines = quality.with_neighbours(*quality.raw_lines(TEXTS))
    truth = np.array([1, 0, 1, 0])
    flat = np.concatenate((field.weights, field.moves.ravel()))
    slope = quality._gradient(field, lines, truth)[1:-1]
    for k in [0, 3, 40, *range(quality.N_FEATURES, quality.N_FEATURES + 4)]:
        e = np.zeros_like(flat)
        e[k] = 1e-5
        up, down = (quality._gradient(quality.Field.of(flat + s * e), lines, truth)[0] for s in (1, -1))
        assert slope[k] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_line_crf_quality"](spark, folder)
    told = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in told if r["held_out"]]
    assert len(held) > 40 and {r["held_out"] for r in told} == {True, False}
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in told)
    assert rows.count() == 1000


def test_odd_documents(spark):
    docs = odd_documents(spark)
    given = labels(spark, [(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (7, None, 0), (99, 0, 1)])
    rows = quality.classified(docs, given).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    without = quality.classified(docs, given.filter("false")).collect()
    assert all(r["score"] == pytest.approx(0.5, abs=1e-6) for r in without)


def test_no_documents(spark):
    assert quality.classified(no_documents(spark), labels(spark, [(1, 1, 0)])).collect() == []
